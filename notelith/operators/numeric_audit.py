"""Repair of quantities, prices, discounts and amounts, and the audit of every line's arithmetic.

The repair applies rules, which are data, one after the other; each is a ``let`` over a struct, so the plan grows with the
number of rules and not with the product of their sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelith.functions import text as tx
from notelith.functions.text import let

TOLERANCE = 0.05


def _dec(x: Column, n: int) -> Column:
    return F.round(x.cast("decimal(28,10)"), n).cast("double")


def _state(q: Column, p: Column, a: Column, d: Column, u: Column) -> Column:
    return F.struct(q.alias("q"), p.alias("p"), a.alias("a"), d.alias("d"), u.alias("u"))


def _some(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, (x.isNotNull() & (x != 0) for x in xs))


class Line:
    """A line's numbers (quantity, price, amount, discount, per) and what follows from them."""

    def __init__(self, state: Column):
        self.q, self.p, self.a, self.d, self.u = (state[x] for x in "qpadu")
        self.factor = (100 - F.coalesce(self.d, F.lit(0.0))) / 100
        #: What one piece costs after the discount, and what all of them do.
        self.unit = self.p * self.factor
        self.expected = self.q / self.u * self.p * self.factor

    def near(self, x: Column, y: Column, share: float) -> Column:
        """Whether two values are within a share of the amount."""
        return F.abs(x - y) <= share * F.greatest(F.lit(1.0), self.a)

    def amount_of(self, q: Column) -> Column:
        return _dec(q / self.u * self.p * self.factor, 2)


@dataclass(frozen=True)
class Rule:
    """Where the numbers of ``needs`` are there (not null, not 0), that of ``lacks`` isn't, and ``when`` holds, ``put`` gives new ones."""

    name: str
    needs: str
    put: dict[str, Callable[[Line], Column]]
    when: Callable[[Line], Column] = lambda x: F.lit(True)
    lacks: str = ""

    def __call__(self, state: Column) -> Column:
        line = Line(state)
        hit = _some(*(getattr(line, n) for n in self.needs)) & self.when(line)
        for n in self.lacks:
            hit = hit & ~_some(getattr(line, n))
        return F.struct(*((F.when(hit, self.put[n](line)).otherwise(state[n]) if n in self.put else state[n]).alias(n) for n in "qpadu"))


def _fewer(x: Line) -> Column:
    return F.try_divide(x.a, x.unit) * x.u


def _price(x: Line) -> Column:
    """The price that the amount asks for, given the discount."""
    return F.try_divide(x.a * x.u, x.q * ((100 - x.d) / 100))


def _discount(x: Line) -> Column:
    return 100 * (1 - F.try_divide(x.a, x.q * x.p))


def _price_of_all(x: Line) -> Column:
    return F.try_divide(x.a, x.q * x.factor)


_unless_null = lambda c: F.coalesce(c, F.lit(True))

# The conditions and bounds under which a number is replaced, in the order in which they apply.
RULES = [
    Rule("price_from_amount", "qa", {"p": lambda x: x.a / x.q}, lacks="p"),
    Rule("quantity_from_amount", "pa", {"q": lambda x: x.a / x.p}, lacks="q"),
    Rule("amount_is_price", "qpa", {"q": lambda x: _dec(x.a / x.p, 2)}, lambda x: (x.q > 10) & _unless_null(x.d < 5) & x.near(x.a, x.p, 0.1)),
    Rule("one_piece", "qpa", {"q": lambda x: F.lit(1.0), "a": lambda x: x.amount_of(F.lit(1.0))}, lambda x: (x.q > 1) & (x.unit > 0) & x.near(x.a, x.unit, 0.1)),
    Rule("far_too_many", "qpa", {"q": lambda x: _dec(_fewer(x), 2)}, lambda x: (x.expected > 0) & (x.a > 0) & (x.q > 50) & (x.p > 1) & (x.a < x.expected * 0.2)),
    Rule(
        "five_times_too_much", "qpa", {"q": lambda x: _dec(_fewer(x), 2), "a": lambda x: x.amount_of(_dec(_fewer(x), 2))},
        lambda x: (x.unit > 0) & (x.q / x.u * x.unit > x.a * 5) & (_fewer(x) > 0),
    ),
    Rule(
        "price_off", "qap", {"p": lambda x: _dec(_price(x), 4)},
        lambda x: x.d.isNotNull() & (x.d < 100) & (_price(x) > 0) & (F.abs(_price(x) - x.p) / F.greatest(_price(x), x.p, F.lit(1e-6)) > TOLERANCE),
    ),
    Rule("discount_missing", "qpa", {"d": lambda x: _dec(_discount(x), 2)}, lambda x: _unless_null((x.d < 0) | (x.d > 80)) & (x.q * x.p > 0) & _discount(x).between(0, 80)),
    Rule(
        "price_too_low", "qap", {"p": _price_of_all},
        lambda x: (x.p > 0) & (_price_of_all(x) > 0) & (x.p < _price_of_all(x) * 0.5) & ~x.near(x.a, x.q * x.p * x.factor, TOLERANCE) & _unless_null(x.d <= 60),
    ),
    Rule("amount_missing", "qp", {"a": lambda x: x.amount_of(x.q)}, lambda x: x.a.isNull()),
]


def repaired(quantity: Column, price: Column, discount: Column, amount: Column, per: Column) -> Column:
    """struct(q, p, a, d, u). A line priced per several units that adds up is left alone; an amount that was read stays."""
    unit = F.when(per.isNull() | (per == 0), 1.0).otherwise(per)
    start = _state(quantity, price, amount, discount, unit)

    def run(s: Column) -> Column:
        expected = Line(s).expected
        fits = (s["u"] > 1) & _some(s["q"], s["p"], s["a"]) & (expected != 0) & (F.abs(expected - s["a"]) <= F.greatest(F.lit(TOLERANCE), 0.05 * F.abs(expected)))
        chain = s
        for rule in RULES:
            chain = let(chain, rule)
        return F.when(F.coalesce(fits, F.lit(False)), s).otherwise(let(chain, lambda r: _state(r["q"], r["p"], F.coalesce(s["a"], r["a"]), r["d"], r["u"])))

    return let(start, run)


def audit_tokens(quantity: Column, price: Column, discount: Column, amount: Column) -> Column:
    """Findings of a line's arithmetic, in a fixed order."""
    base = price * quantity
    usable = _some(price, quantity)
    expected = _dec(base * (100 - F.least(F.greatest(discount, F.lit(0.0)), F.lit(100.0))) / 100, 2)
    valid = discount.between(0, 99.999999999)
    implied = _dec(F.least(F.greatest(100 - F.try_divide(amount, base) * 100, F.lit(0.0)), F.lit(100.0)), 2)
    return F.array_compact(
        F.array(
            F.when(amount < 0, F.lit("importe_negativo")),
            F.when(discount < 0, F.lit("discount_negative")),
            F.when(discount >= 100, F.lit("discount_overflow")),
            F.when(discount >= 100, F.lit("discount_recheck")),
            F.when(usable & discount.isNotNull() & amount.isNull(), F.concat(F.lit("importe_hint="), F.format_string("%.2f", expected))),
            F.when(usable & valid & (F.abs(expected - amount) > TOLERANCE), F.lit("importe_formula")),
            F.when(usable & discount.isNull() & amount.isNotNull(), F.concat(F.lit("discount_hint="), F.format_string("%.2f", implied))),
        )
    )


def trace(quantity: Column, price: Column, discount: Column, amount: Column, stage: Column, warnings: Column) -> Column:
    """What was found about a line, as a struct; ``to_json`` of it (with null fields) is the stored form."""
    source = F.when(F.lower(F.coalesce(stage, F.lit(""))).contains("ocr"), "ocr").otherwise("base")

    def part(value: Column, status: Column) -> Column:
        return F.struct(source.alias("source"), value.alias("original"), status.alias("status"))

    ok = lambda x: F.when(x.isNull(), F.lit("missing")).otherwise(F.lit("ok"))
    of_amount = F.when(amount < 0, "negative").when(F.array_contains(warnings, "importe_formula"), "mismatch").otherwise(ok(amount))
    of_discount = F.when(discount < 0, "negative").when(discount >= 100, "overflow").otherwise(ok(discount))
    return F.struct(
        part(price, ok(price)).alias("precio"), part(discount, of_discount).alias("descuento"), part(amount, of_amount).alias("importe"),
        F.struct(source.alias("source"), quantity.alias("value")).alias("cantidad"), warnings.alias("warnings"),
    )


def with_audit(df, quantity: Column, price: str = "PrecioUnitario", discount: str = "DescuentoPct", amount: str = "Importe", warn: str = "ParseWarn"):
    tokens = audit_tokens(quantity, F.col(price), F.col(discount), F.col(amount))
    return df.withColumn("_t", tokens).withColumn("audit", tx.append_tokens(warn, F.col("_t"))).drop("_t")
