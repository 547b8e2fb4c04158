"""Numbers of documents: reading them, rounding, amounts, comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelith.functions.text import col, fix_glyphs

#: Price units behind a slash.
UNIT_FACTORS = {"U": 1, "D": 10, "C": 100, "M": 1000, "P": 1000}


def to_float_es(c: Column | str) -> Column:
    """'1.234,56/C' -> 1234.56: points group, the comma is the decimal sign, a unit behind a slash goes."""
    text = F.regexp_replace(F.trim(col(c)), r"/[A-Za-z]*\s*$", "")
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def to_num(c: Column | str) -> Column:
    """Either decimal sign."""
    return F.replace(F.trim(col(c)), F.lit(","), F.lit(".")).try_cast("double")


def collapse_number(c: Column | str) -> Column:
    """Blanks between the digits of a number go, a minus behind it comes to the front."""
    joined = F.regexp_replace(col(c), r"([0-9.,])\s+([0-9.,])", "$1$2")
    joined = F.regexp_replace(joined, r"([0-9.,])\s+([0-9.,])", "$1$2")
    return F.regexp_replace(joined, r"^\s*([0-9][0-9.,]*)\s*-\s*$", "-$1")


def money_round(c: Column | str, digits: int = 2) -> Column:
    """Half up on the decimal representation, away from zero."""
    return F.round(col(c), digits)


def calc_amount(quantity: Column | str, price: Column | str, discount: Column | str, per: Column | str) -> Column:
    """quantity / per * price * (100 - discount) / 100, half up on eight decimals, so that binary noise moves no cent; a null or zero per is 1, a null discount 0."""
    unit = F.when(col(per).isNull() | (col(per) == 0), 1.0).otherwise(col(per))
    exact = (col(quantity) / unit * col(price) * (100 - F.coalesce(col(discount), F.lit(0.0))) / 100).cast("decimal(24,8)")
    return F.round(exact, 2).cast("double")


def effective_quantity(*candidates: Column | str) -> Column:
    """The first positive one, else 1."""
    return F.coalesce(*(F.when(col(c) > 0, col(c)) for c in candidates), F.lit(1.0))


def unit_factor(c: Column | str) -> Column:
    """'/C' or 'C' -> 100; a number is itself; null and unknown ones are 1."""
    table = F.create_map(*(F.lit(x) for k, v in UNIT_FACTORS.items() for x in (k, float(v))))
    code = F.upper(F.regexp_replace(col(c), r"[\s/]", ""))
    return F.coalesce(F.try_element_at(table, code), code.try_cast("double"), F.lit(1.0))


def within(a: Column | str, b: Column | str, tolerance: float = 0.02) -> Column:
    """Equal up to the tolerance; two missing values are equal, one isn't equal to a value."""
    x, y = (F.when(F.isnan(col(c)), None).otherwise(col(c)) for c in (a, b))
    return F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())


def split_price_discount(digits: Column | str, quantity: Column | str, amount: Column | str) -> Column:
    """A run of digits that is a price and a discount, both with two decimals, glued together.

    Of all places to cut, the one whose price * quantity * (1 - discount) comes nearest to the amount; struct(error, price,
    discount), compared field by field.
    """
    d = col(digits)

    def candidate(i: Column) -> Column:
        price = F.substring(d, F.lit(1), i).try_cast("double") / 100
        discount = F.substring(d, i + 1, F.length(d)).try_cast("double") / 100
        error = F.round(F.abs(price * col(quantity) * (1 - discount / 100) - col(amount)), 4)
        return F.struct(error.alias("error"), price.alias("price"), F.when(discount <= 100, discount).alias("discount"))

    places = F.sequence(F.lit(1), F.greatest(F.length(d) - 1, F.lit(1)))
    return F.array_min(F.filter(F.transform(places, candidate), lambda x: x["discount"].isNotNull() & x["error"].isNotNull()))


def small_value(c: Column | str, most: float = 5.0) -> Column:
    """A recycling fee: positive and small."""
    return (col(c) > 0) & (col(c) < most)


def split_quantities(block: Column | str, rows: Column | str) -> Column:
    """Quantities of several rows written together: as many tokens as rows, or one digit as often as there are rows; else null."""
    text = F.trim(F.regexp_replace(col(block), r"\s+", " "))
    tokens = F.split(text, " ")
    same = text.rlike(r"^([0-9])\1*$") & (F.length(text) == col(rows))
    each = F.when(same, F.filter(F.split(text, ""), lambda x: x != "")).when(F.size(tokens) == col(rows), tokens)
    return F.transform(each, to_float_es)


def fuzzy_decimals(c: Column | str) -> Column:
    """Numbers with decimals among the tokens of a line, with letters for digits put right: struct(place, value)."""
    tokens = F.split(F.trim(F.regexp_replace(col(c), r"\s+", " ")), " ")
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("place"), F.when(t.rlike("[0-9]"), fix_glyphs(t)).otherwise(t).alias("t")))
    hits = F.filter(placed, lambda x: x["t"].rlike(r"^-?[0-9][0-9.]*,[0-9]{1,4}$"))
    return F.transform(hits, lambda x: F.struct(x["place"].alias("place"), to_float_es(x["t"]).alias("value")))


def per_hundred(price: Column | str, text: Column | str) -> Column:
    """A price that the line marks as one for a hundred, for one."""
    return F.when(col(text).rlike(r"\(100\)|/C(?:$|[^\p{L}\p{N}_])|%\s*U"), col(price) / 100).otherwise(col(price))
