"""Quantities and prices that sources wrote down in different units, brought to m, kg, l or pieces and euro per one.

A hidden Markov model decodes the unit of each record. A series is the records of one line in the order of time, the
hidden state the factor of the unit that the record was written in. What a record says about its unit (behind the
quantity, in the unit field, in the description's suffix, behind the price) is the emission: it costs ``READ_COST`` to
decode another unit than the one named (or, where none is named, than the common one), and little where a unit is named
but can't be read. The jumps of log quantity and log price against the level of the record before are the transitions.
So a unit that was read stands against any single neighbour, and gives way where quantity and price both jump by exactly
another unit's factor on both sides. Series are decoded together, step by step, in arrays.

Scale: one sort by line and time into ranges. A series may lie in many ranges: each range hands the driver the costs
between all first and last states of its first and last series (two small matrices a range, so at most twice the number
of shuffle partitions), the chains of those fix the states at the ranges' edges, and every range is decoded between them.
That is the exact path of the whole series, however it is cut. A series longer than a batch is decoded up to where all
paths have met, so no task holds a long one.

Defined cases
-------------
* The last comma or point of a number is its decimal sign; a text without a number in front is a missing number.
* Missing numbers stay null and cost nothing; null, empty and blank texts say nothing. A price of 0 or less is kept.
* The field beside the value speaks first: quantity text, unit field, description, price for the quantity; price, unit
  field, description, quantity text for the price.
* A package counts with its content, without a unit behind the number its content is pieces.
* A null or unreadable ``UnidadesPor`` is 1 unless the price text says for how many units it is.
* Repeated rows and equal times are ordered by the record's id; repeated records are records. Records of a null line
  belong to no line: they are converted, and pair with nothing. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.functions.text import let
from notelith.operators.skew import join_by_key
from notelith.runtime import durable, ship

# Spellings of units with the common unit and the factor.
UNITS = [
    ("m", 1.0, "m metro metros mt mts"),
    ("m", 0.001, "mm milimetro milimetros"),
    ("m", 0.01, "cm centimetro centimetros"),
    ("m", 1000.0, "km kilometro kilometros"),
    ("kg", 1.0, "kg kgs kilo kilos"),
    ("kg", 0.001, "g gr grs gramo gramos"),
    ("kg", 1000.0, "t tn tm tonelada toneladas"),
    ("l", 1.0, "l lt lts litro litros"),
    ("l", 0.001, "ml mililitro mililitros"),
    ("l", 0.01, "cl centilitro centilitros"),
    ("l", 100.0, "hl hectolitro hectolitros"),
    ("l", 1000.0, "m3 m³"),
    ("ud", 1.0, "u ud uds unid unidad unidades pza pzas pieza piezas"),
    ("ud", 2.0, "par pares"),
    ("ud", 12.0, "doc docena docenas"),
    ("ud", 100.0, "cto ciento cientos"),
    ("ud", 1000.0, "millar millares"),
]
#: Letters of UnidadesPor.
PER_LETTERS = {"U": 1.0, "D": 10.0, "C": 100.0, "M": 1000.0, "P": 1000.0}
#: Names of packages.
PACKAGES = "rollos?|bobinas?|sacos?|botes?|garrafas?|bolsas?|cajas?|cj|paquetes?|bidon|bidones|latas?|palets?"

_NUMBER = r"^\s*([-+]?\d[\d.,]*)\s*(.*?)\s*$"
_PACKAGE = rf"^(?:{PACKAGES})\s*(?:de\b|/)?\s*(\d[\d.,]*)\s*(\S*)$"
_SUFFIX = r"(?:\[|\(cant\. en |Unidad:\s*|servido por |- medido en )([^\[\]()]+?)[\])]?\s*$"
_PRICE = r"^\s*([-+]?\d[\d.,]*)\s*(€|(?i:euros?|eur|céntimos?|centimos?|cts\.?|cént\.?|cent\.?))?\s*(?:/|por\b|x\b)?\s*(\d[\d.,]*)?\s*(.*?)\s*$"

#: The hidden states: the factors of all units.
STATES = np.array(sorted({f for _, f, _ in UNITS}))
_ONE = int(np.flatnonzero(STATES == 1.0)[0])
#: Costs (negative log-likelihoods): another unit than the one named or ruled; another than the common one where a unit can't be read.
READ_COST, UNREADABLE_COST = 12.0, 0.5
#: Spread of the level between records of one line, and the most that one jump may cost.
LEVEL_SPREAD, MAX_JUMP_COST = 0.05, 4.0
#: Records of one series that are held before those are given out whose states are certain.
LONG = 20_000


def _text(c: Column) -> Column:
    """Null where a text says nothing."""
    return F.when(c.rlike(r"\S"), c)


def number(c: Column) -> Column:
    """The last comma or point is the decimal sign."""
    one = F.regexp_replace(c, r"[.,](?=.*[.,])", "")
    return F.replace(one, F.lit(","), F.lit(".")).try_cast("double")


def _groups(c: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that spans the whole text, as an array; one pass of the pattern."""
    marked = F.regexp_replace(c, f"(?s){pattern}", "\u0001".join(f"${i}" for i in range(1, n + 1)))
    return F.when(c.rlike(f"(?s){pattern}"), F.split(marked, "\u0001"))


def _unit(c: Column) -> Column:
    """struct(base, factor, inner), null where the text names no unit that is known; ``inner`` is the factor of a package's unit."""
    struct = lambda base, f: F.struct(F.lit(base).alias("base"), F.lit(f).alias("factor"), F.lit(f).alias("inner"))
    known = F.create_map(*(x for base, f, names in UNITS for n in names.split() for x in (F.lit(n), struct(base, f))))

    def of(folded: Column) -> Column:
        content = F.nullif(F.regexp_extract(folded, _PACKAGE, 1), F.lit(""))
        named = F.nullif(F.regexp_replace(F.regexp_extract(folded, _PACKAGE, 2), r"\.+$", ""), F.lit(""))
        package = let(
            F.try_element_at(known, F.coalesce(named, F.lit("ud"))),
            lambda u: F.when(content.isNotNull() & u.isNotNull(), F.struct(u["base"].alias("base"), (u["factor"] * number(content)).alias("factor"), u["factor"].alias("inner"))),
        )
        return F.when(folded.rlike("[0-9]"), F.coalesce(F.try_element_at(known, folded), package)).otherwise(F.try_element_at(known, folded))

    return F.when(c.isNotNull(), let(F.regexp_replace(F.translate(F.lower(F.trim(c)), "áéíóúü", "aeiouu"), r"\.+$", ""), of))


def read_records(df: DataFrame) -> DataFrame:
    """What the fields say: quantity and price as written (in euro, for one recorded unit), the factors named for each, the unit's own factor and base."""
    quantity, price = _groups(F.col("CantidadServida"), _NUMBER, 2), _groups(F.col("PrecioUnitario"), _PRICE, 4)
    parted = df.select("rec_id", "AlbaranNumero", "Codigo", "recorded_at", "UnidadMedida", "UnidadesPor", "Descripcion", quantity.alias("q"), price.alias("p"))
    said = parted.select(
        "rec_id",
        F.col("AlbaranNumero").alias("note"),
        F.col("Codigo").alias("code"),
        F.col("recorded_at").alias("at"),
        number(F.get("q", 0)).alias("quantity"),
        _text(F.get("q", 1)).alias("in_quantity"),
        _text(F.col("UnidadMedida")).alias("in_field"),
        _text(F.regexp_extract(F.col("Descripcion"), _SUFFIX, 1)).alias("in_description"),
        number(F.get("p", 0)).alias("amount"),
        F.lower(F.get("p", 1)).startswith("c").alias("in_cents"),
        number(F.get("p", 2)).alias("per_text"),
        _text(F.get("p", 3)).alias("in_price"),
        F.upper(F.regexp_replace(F.col("UnidadesPor"), r"[\s/]", "")).alias("per_field"),
    )
    letters = F.create_map(*(F.lit(x) for pair in PER_LETTERS.items() for x in pair))
    fields = ["in_quantity", "in_field", "in_description", "in_price"]
    read = said.withColumns({f"u_{f}": _unit(F.col(f)) for f in fields})
    named = reduce(lambda a, b: a | b, (F.col(f).isNotNull() for f in fields))
    for_quantity = F.coalesce(*(F.col(f"u_{f}") for f in ("in_quantity", "in_field", "in_description", "in_price")))
    for_price = F.coalesce(*(F.col(f"u_{f}") for f in ("in_price", "in_field", "in_description", "in_quantity")))
    positive = lambda c: F.when(c > 0, c)
    per = F.coalesce(F.try_element_at(letters, F.col("per_field")), positive(number(F.col("per_field"))), positive(F.col("per_text")), F.lit(1.0))
    return read.select(
        "rec_id", "note", "code", "at", "quantity",
        (F.when(F.col("in_cents"), F.col("amount") / 100).otherwise(F.col("amount")) / per).alias("price"),
        F.coalesce(for_quantity["factor"], F.lit(1.0)).alias("quantity_factor"),
        F.coalesce(for_price["factor"], F.lit(1.0)).alias("price_factor"),
        F.coalesce(for_quantity["inner"], F.lit(1.0)).alias("unit_factor"),
        for_quantity["base"].alias("base"),
        (named & for_quantity.isNull()).alias("unreadable"),
    )


class Series:
    """Records sorted by series and time as arrays: what they say and where a series begins."""

    def __init__(self, t: pa.Table):
        column = lambda c: t[c].to_numpy().astype(float)
        self.quantity, self.price = column("quantity"), column("price")
        self.quantity_factor, self.price_factor = column("quantity_factor"), column("price_factor")
        self.named = np.searchsorted(STATES, column("unit_factor"))
        self.unreadable = t["unreadable"].to_numpy(zero_copy_only=False).astype(bool)
        own = np.log(STATES[self.named])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.logs = [np.where(np.abs(v) > 0, np.log(np.abs(v)), np.nan) for v in (self.quantity, self.price)]
        # In the unit of factor 1 behind what is fixed: a package's content, a price for another unit.
        self.logs[0] = self.logs[0] + np.log(self.quantity_factor) - own
        self.logs[1] = self.logs[1] - np.log(self.price_factor) + own
        key = pc.binary_join_element_wise(*(pc.fill_null(t[c].cast(pa.string()), "\x00") for c in ("note", "code")), "\x1f")
        self.key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
        n = t.num_rows
        self.first = np.ones(n, dtype=bool)
        if n > 1:
            self.first[1:] = pc.not_equal(self.key.slice(1), self.key.slice(0, n - 1)).to_numpy(zero_copy_only=False)

    def emission(self) -> np.ndarray:
        at = np.arange(STATES.size)
        return np.where(at == self.named[:, None], 0.0, np.where(self.unreadable[:, None], UNREADABLE_COST, READ_COST))

    def converted(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantity and price in the common unit of the decoded states."""
        moved = STATES[state] / STATES[self.named]
        return self.quantity * self.quantity_factor * moved, self.price / self.price_factor / moved


_STEP = np.log(STATES)[None, :] - np.log(STATES)[:, None]  # [from, to]


def _jumps(now: tuple, before: tuple) -> np.ndarray:
    """[record, from, to]: what the jumps of quantity and price cost from each state to each."""
    total = np.zeros((len(now[0]), STATES.size, STATES.size))
    for value, last, sign in zip(now, before, (1, -1), strict=True):
        jump = (value - last)[:, None, None] + sign * _STEP
        total += np.nan_to_num(np.minimum(jump**2 / (2 * LEVEL_SPREAD**2), MAX_JUMP_COST), nan=0.0)
    return total


def viterbi(logs: list[np.ndarray], emission: np.ndarray, first: np.ndarray, entry: np.ndarray | None = None, last_state: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state of each record, costs, back pointers); ``first`` marks where a series begins.

    All series advance together, one record a step. ``entry``: further costs of the first record's states;
    ``last_state``: the state in which the last series has to end.
    """
    n, k = emission.shape
    cost, back = emission.copy(), np.zeros((n, k), dtype=np.int8)
    if entry is not None and n:
        cost[0] = cost[0] + entry
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, n))
    for t in range(1, int(length.max(initial=0))):
        now = start[length > t] + t
        through = cost[now - 1][:, :, None] + _jumps(tuple(v[now] for v in logs), tuple(v[now - 1] for v in logs))
        back[now] = through.argmin(axis=1)
        cost[now] = through.min(axis=1) + emission[now]
    state = np.zeros(n, dtype=np.int64)
    end = start + length - 1
    state[end] = cost[end].argmin(axis=1)
    if last_state is not None and n:
        state[n - 1] = last_state
    for t in range(int(length.max(initial=0)) - 1, 0, -1):
        now = start[length > t] + t
        state[now - 1] = back[now, state[now]]
    return state, cost, back


def _met(back: np.ndarray) -> int:
    """Records of one series, from its first, whose states are the same on all paths."""
    at = np.arange(back.shape[1])
    for t in range(len(back) - 1, 0, -1):
        at = back[t, at]
        if (at == at[0]).all():
            return t
    return 0


_EDGE = "part int, place int, key string, first array<double>, last array<double>, costs array<double>"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last series of a range: the costs from each state of its first record to each of its last there."""
    part, k = TaskContext.get().partitionId(), STATES.size
    place, now = 0, None

    def row() -> pa.RecordBatch:
        values = [[part], [place], [now["key"]], [now["first"]], [now["last"]], [now["costs"].ravel().tolist()]]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.float64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["part", "place", "key", "first", "last", "costs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        s = Series(pa.Table.from_batches([batch]))
        begin = np.flatnonzero(s.first)
        stop = np.append(begin[1:], batch.num_rows)
        emission = s.emission()
        for i, (a, b) in enumerate(zip(begin, stop, strict=True)):
            key = s.key[int(a)].as_py()
            if now is not None and key != now["key"]:
                if place == 0:
                    yield row()
                place, now = 1, None
            if place and now is None and i + 1 < len(begin):
                continue  # a whole series within the range
            at = int(a)
            if now is None:
                now = {"key": key, "first": [float(v[at]) for v in s.logs], "costs": np.where(np.eye(k, dtype=bool), emission[at][None], np.inf)}
                at += 1
            before = now.get("last", now["first"])
            for low in range(at, int(b), 4096):
                high = min(low + 4096, int(b))
                logs = tuple(v[low:high] for v in s.logs)
                last = tuple(np.append(p, v[:-1]) for p, v in zip(before, logs, strict=True))
                for jump, e in zip(_jumps(logs, last), emission[low:high], strict=True):
                    now["costs"] = (now["costs"][:, :, None] + jump[None]).min(axis=1) + e
                before = [float(v[-1]) for v in logs]
            now["last"] = before
            if place == 0 and i + 1 < len(begin):
                yield row()
                place, now = 1, None
    if now is not None:
        yield row()


def _fixed_states(edges: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(range, place) -> first and last state there of each series that goes over an edge."""
    edges = sorted(edges, key=lambda r: (r["part"], r["place"]))
    k, fixed, i = STATES.size, {}, 0
    while i < len(edges):
        j = i + 1
        while j < len(edges) and edges[j]["key"] == edges[i]["key"]:
            j += 1
        chain = [(np.array(r["first"]), np.array(r["last"]), np.array(r["costs"]).reshape(k, k)) for r in edges[i:j]]
        if len(chain) > 1:
            entry, over, out = [np.zeros(k)], [None], [chain[0][2].min(axis=0)]
            for (_, last, _), (first, _, costs) in zip(chain, chain[1:], strict=False):
                jump = _jumps((first[:1], first[1:]), (last[:1], last[1:]))[0]
                through = out[-1][:, None] + jump
                over.append(through.argmin(axis=0))
                entry.append(through.min(axis=0))
                out.append((entry[-1][:, None] + costs).min(axis=0))
            end = int(out[-1].argmin())
            for m in range(len(chain) - 1, -1, -1):
                begin = int((entry[m] + chain[m][2][:, end]).argmin())
                fixed[edges[i + m]["part"], edges[i + m]["place"]] = (begin, end)
                if m:
                    end = int(over[m][begin])
        i = j
    return fixed


def _only(state: int) -> np.ndarray:
    return np.where(np.arange(STATES.size) == state, 0.0, np.inf)


def common_units(df: DataFrame, of_line: bool = True) -> DataFrame:
    """(rec_id, note, code, quantity, price, base) of each record in common units; ``of_line``: records that name no unit get the line's base."""
    ship(df.sparkSession)
    order = ["AlbaranNumero", "Codigo", "recorded_at", "rec_id"]
    raw = df.select("rec_id", "AlbaranNumero", "Codigo", "Descripcion", "CantidadServida", "UnidadMedida", "UnidadesPor", "PrecioUnitario", "recorded_at")
    # Ranges are read from the raw columns, and parsed once.
    read = durable(read_records(raw.repartitionByRange(*order).sortWithinPartitions(*order)).drop("at"))
    fixed = _fixed_states(read.mapInArrow(_edges, _EDGE).collect())  # two small rows a range
    schema = T.StructType(
        [
            T.StructField("rec_id", read.schema["rec_id"].dataType), T.StructField("note", read.schema["note"].dataType), T.StructField("code", read.schema["code"].dataType),
            T.StructField("quantity", T.DoubleType()), T.StructField("price", T.DoubleType()), T.StructField("base", T.StringType()),
        ]
    )

    def given(t: pa.Table, s: Series, state: np.ndarray) -> list[pa.RecordBatch]:
        quantity, price = s.converted(state)
        numbers = lambda v: pa.array(v, pa.float64(), from_pandas=True)  # noqa: E731  NaN comes from null
        return pa.table([t["rec_id"], t["note"], t["code"], numbers(quantity), numbers(price), t["base"]], names=schema.names).to_batches()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, place, entry = None, 0, None
        if (part, 0) in fixed:
            entry = _only(fixed[part, 0][0])
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
            if held.num_rows < 2:
                continue
            s = Series(held)
            cut = int(np.flatnonzero(s.first)[-1])
            if cut:
                whole = held.slice(0, cut)
                s = Series(whole)
                # The first series of the range ends here; its state there is fixed only if it is the only one that was cut.
                first_end = int(np.append(np.flatnonzero(s.first)[1:], cut)[0])
                state, _, _ = viterbi(s.logs, s.emission(), s.first, entry)
                if place == 0 and (part, 0) in fixed:
                    alone = [v[:first_end] for v in s.logs]
                    state[:first_end] = viterbi(alone, s.emission()[:first_end], s.first[:first_end], entry, fixed[part, 0][1])[0]
                yield from given(whole, s, state)
                held, place = held.slice(cut), 1
                entry = _only(fixed[part, 1][0]) if (part, 1) in fixed else None
            elif held.num_rows > LONG:
                state, cost, back = viterbi(s.logs, s.emission(), s.first, entry)
                met = _met(back)
                if met:
                    yield from given(held.slice(0, met), _head(s, met), state[:met])
                    through = cost[met - 1][:, None] + _jumps(tuple(v[met : met + 1] for v in s.logs), tuple(v[met - 1 : met] for v in s.logs))[0]
                    entry, held = through.min(axis=0), held.slice(met)
        if held is not None and held.num_rows:
            s = Series(held)
            state, _, _ = viterbi(s.logs, s.emission(), s.first, entry, fixed[part, place][1] if (part, place) in fixed else None)
            yield from given(held, s, state)

    found = read.mapInArrow(decode, schema)
    if not of_line:
        return found
    line = F.when(F.col("note").isNotNull() & F.col("code").isNotNull(), F.to_json(F.struct("note", "code")))
    found = durable(found.withColumn("_line", line))
    bases = found.where(F.col("_line").isNotNull()).groupBy("_line").agg(F.min_by("base", F.when(F.col("base").isNotNull(), F.col("rec_id"))).alias("_base"), F.count("*").alias("_n"))
    lines = join_by_key(found, bases, "_line", "_n", found.count()).withColumn("base", F.coalesce("base", "_base"))
    return lines.select(*schema.names).unionByName(found.where(F.col("_line").isNull()).select(*schema.names))


def _head(s: Series, n: int) -> Series:
    """The first records of some."""
    out = Series.__new__(Series)
    for name in ("quantity", "price", "quantity_factor", "price_factor", "named"):
        setattr(out, name, getattr(s, name)[:n])
    return out


#: Cells of log values for the search of near pairs: the wider, the fewer records lie near an edge.
CELL = 0.1


def equal_pairs(records: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(rec_a, rec_b) of one line whose quantities and prices both differ by at most the tolerance.

    Log values are cut into cells. One side of a pair lies in its cell, the other also in the neighbour beyond an edge
    that is within reach: each near pair meets once, and no far pair of a large line is made.
    """
    there = records.where(F.col("note").isNotNull() & F.col("code").isNotNull() & F.col("quantity").isNotNull() & F.col("price").isNotNull())
    reach = float(np.log1p(tolerance / (1 - tolerance)) * 1.001)

    def cell(c: str) -> Column:
        v = F.col(c)
        return F.when(v == 0, F.lit(0)).otherwise(F.floor(F.ln(F.abs(v)) / CELL) * 4 + F.when(v > 0, 1).otherwise(2))

    def cells(c: str) -> Column:
        v = F.col(c)
        x = F.ln(F.abs(v)) / CELL
        sign = F.when(v > 0, 1).otherwise(2)
        near = F.array(F.floor(x), F.floor(x - reach / CELL), F.floor(x + reach / CELL))
        return F.when(v == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.array_distinct(near), lambda i: i * 4 + sign))

    a = there.select(F.col("rec_id").alias("rec_a"), "note", "code", F.col("quantity").alias("qa"), F.col("price").alias("pa"), cell("quantity").cast("long").alias("cq"), cell("price").cast("long").alias("cp"))
    b = there.select(F.col("rec_id").alias("rec_b"), "note", "code", F.col("quantity").alias("qb"), F.col("price").alias("pb"), F.explode(cells("quantity")).alias("cq"), cells("price").alias("_cp"))
    b = b.select("rec_b", "note", "code", "qb", "pb", "cq", F.explode("_cp").alias("cp"))

    def near(x: str, y: str) -> Column:
        return F.abs(F.col(x) - F.col(y)) <= F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y))

    met = a.join(b, ["note", "code", "cq", "cp"]).where((F.col("rec_a") < F.col("rec_b")) & near("qa", "qb") & near("pa", "pb"))
    return met.select("rec_a", "rec_b")
