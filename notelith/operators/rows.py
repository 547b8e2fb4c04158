"""Detail rows: projection, stamping, numbering, merging of stages, filling, carrying."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelith.functions import text as tx
from notelith.operators.skew import HOT_ROWS, join_by_key
from notelith.runtime import durable, ship

DETAIL_TEXT = [
    "Proveedor", "Parser", "AlbaranNumero", "FechaAlbaran", "SuPedidoCodigo", "Codigo", "Descripcion", "CantidadFuente", "PrecioFuente",
    "DescuentoFuente", "ImporteFuente", "Pdf", "ParseWarn", "OcrStage", "OcrPipeline", "ParseTrace",
]
DETAIL_NUMBERS = ["CantidadPedida", "CantidadServida", "CantidadPendiente", "UnidadesPor", "PrecioUnitario", "DescuentoPct", "Importe"]


def missing(c: Column | str) -> Column:
    """Null, blank, or a word for nothing."""
    t = F.upper(F.trim(tx.col(c)))
    return F.coalesce(t.isin("", "NAN", "NONE", "NULL", "NAT"), F.lit(True))


def canonical(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The fixed columns: texts trimmed with '' for missing, numbers as doubles with null; columns that lack are added."""
    there = set(df.columns)
    texts = [(F.coalesce(tx.trim_ws(c), F.lit("")) if c in there else F.lit("")).alias(c) for c in DETAIL_TEXT]
    numbers = [(F.nanvl(F.col(c).cast("double"), F.lit(None)) if c in there else F.lit(None).cast("double")).alias(c) for c in DETAIL_NUMBERS]
    page = F.col("Pagina").cast("int") if "Pagina" in there else F.lit(None).cast("int")
    return df.select(*(keep or []), *texts, *numbers, page.alias("Pagina"))


def source_label(stage: Column | str) -> Column:
    return F.when(F.lower(F.coalesce(tx.col(stage), F.lit(""))).contains("ocr"), "ocr").otherwise("base")


def stamp(items: DataFrame, meta: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows with header fields filled from their page's meta where blank, and source labels where missing.

    ``meta`` may hold a page several times: for each field its first value in the order of all fields counts.
    """
    values = [F.min(F.when(~missing(f), F.col(f))).alias(f"_m_{f}") for f in fields]
    joined = items.join(meta.groupBy(*key).agg(*values), key, "left")
    filled = {f: F.when(missing(f), F.col(f"_m_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(filled).drop(*(f"_m_{f}" for f in fields))


def global_index(df: DataFrame, order: list[str]) -> DataFrame:
    """``idx``, 1-based over all rows in an order, without one partition for all: ranges are sorted, counted and shifted.

    What comes to the driver is one count for each partition.
    """
    mask = (1 << 33) - 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    if not offsets:
        return placed.withColumn("idx", F.lit(0).cast("long")).drop("_id")
    shift = F.create_map(*(F.lit(x) for pair in offsets for x in pair))
    return placed.withColumn("idx", F.element_at(shift, part) + F.col("_id").bitwiseAND(F.lit(mask)) + 1).drop("_id")


def largest_group(df: DataFrame, key: list[str]) -> int:
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def place_in_group(df: DataFrame, key: list[str], order: list[str], name: str = "place", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``name``: rows of a key counted from 1 in an order.

    A window while no key has more than ``hot_rows`` rows. Beyond that the rows are numbered over sorted ranges, and the
    number at which a key starts is taken off: a hot key lies in many ranges.
    """
    if largest_group(df, key) <= hot_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    group = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    indexed = durable(global_index(df.withColumn("_g", group), [*key, *order]))
    starts = indexed.groupBy("_g").agg(F.min("idx").alias("_first"), F.count("*").alias("_n"))
    joined = join_by_key(indexed, starts, "_g", "_n", indexed.count(), hot_rows)
    return joined.withColumn(name, (F.col("idx") - F.col("_first") + 1).cast("int")).select(*df.columns, name)


def placeholder_codes(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with quantity and amount but no code get UNK_<supplier>_<place in the whole run> and a warning."""
    lacks = missing("Codigo") & F.col("CantidadServida").isNotNull() & F.col("Importe").isNotNull()
    token = F.lit("missing_code_placeholder")
    code = F.concat(F.lit("UNK_"), tx.key_token(tx.fold_upper("Proveedor")), F.lit("_"), F.lpad(F.col("idx").cast("string"), 4, "0"))
    code = F.when(F.col("idx") > 9999, F.concat(F.lit("UNK_"), tx.key_token(tx.fold_upper("Proveedor")), F.lit("_"), F.col("idx"))).otherwise(code)
    warn = F.when(tx.trim_ws(F.coalesce("ParseWarn", F.lit(""))) == "", token).otherwise(F.concat("ParseWarn", F.lit("|"), token))
    return global_index(df, order).withColumns(
        {"ParseWarn": F.when(lacks, warn).otherwise(F.col("ParseWarn")), "Codigo": F.when(lacks, code).otherwise(F.col("Codigo"))}
    )


def recover_code(code: str, description: str) -> dict[str, Column]:
    """A code of six or more capitals and digits moved from the front of the description where the code is missing."""
    found = F.regexp_extract(F.coalesce(F.col(description), F.lit("")), r"^\s*([A-Z0-9]{6,})\b", 1)
    take = missing(code) & (found != "")
    rest = F.regexp_replace(F.regexp_replace(F.col(description), r"^\s*[A-Z0-9]{6,}\b", ""), "^[ -]+", "")
    return {code: F.when(take, found).otherwise(F.col(code)), description: F.when(take, rest).otherwise(F.col(description))}


def merge_stages(df: DataFrame, key: list[str], order: list[str], stage: str, header: list[str], warn: str | None = "ParseWarn") -> DataFrame:
    """One row from the rows that several stages gave for one place of a page.

    Rows of a stage are counted in order, rows of one place are candidates: other stages before the base one. Header
    fields come from the base stage, a warning is the first that isn't null, other fields the first that isn't missing.
    """
    placed = place_in_group(df, [*key, stage], order, "_place")
    fields = [c for c in df.columns if c not in key]
    kinds = dict(df.dtypes)
    rank = F.struct((F.col(stage) == "base").alias("b"), F.col(stage).alias("s"))

    def lacks(c: str) -> Column:
        return F.trim(F.col(f"`{c}`")).isin("") | F.col(f"`{c}`").isNull() if kinds[c] == "string" else F.col(f"`{c}`").isNull()

    picks = []
    for c in fields:
        value = F.col(f"`{c}`")
        usable = value.isNotNull() if c == warn else ~lacks(c)
        if c in header:
            base_first = F.struct((F.col(stage) != "base").alias("b"), F.col(stage).alias("s"))
            picks.append(F.min_by(F.when(usable, value), F.when(usable, base_first)).alias(c))
        else:
            picks.append(F.min_by(F.when(usable, value), F.when(usable, rank)).alias(c))
    return placed.groupBy(*key, "_place").agg(*picks).drop("_place")


def fill_known(df: DataFrame, known: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Missing fields from a table of known values, one row per key (the least one where it has several)."""
    one = known.groupBy(*key).agg(F.min(F.struct(*fields)).alias("_k"))
    joined = df.join(one, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.col(f"_k.{f}")) for f in fields}).drop("_k")


def fill_forward(df: DataFrame, part: list[str], order: list[str], fields: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Blank fields from the nearest row before; ``weak_location`` says that one of them was blank.

    A window while no part has more than ``hot_rows`` rows; beyond that sorted ranges, each with what the ranges before
    it leave open.
    """
    blank = F.lit(False)
    for f in fields:
        blank = blank | missing(f)
    marked = df.withColumn("weak_location", blank).withColumns({f: F.when(~missing(f), F.col(f)) for f in fields})
    if largest_group(df, part) > hot_rows:
        return _fill_ranges(marked, part, order, fields)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})


def _fill_ranges(df: DataFrame, part: list[str], order: list[str], fields: list[str]) -> DataFrame:
    ship(df.sparkSession)
    ranged = durable(df.repartitionByRange(*part, *order).sortWithinPartitions(*part, *order).withColumn("_p", F.spark_partition_id()))
    keys, n = len(part), len(part) + len(fields)

    def run(rows: Iterator[tuple], key: tuple | None, held: list) -> Iterator[tuple[tuple, list]]:
        for row in rows:
            if row[:keys] != key:
                key, held = row[:keys], [None] * len(fields)
            held = [b if b is not None else a for a, b in zip(held, row[keys:n], strict=True)]
            yield key, held

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a range leaves open: its last key and values, and whether it is of that key alone."""
        key, held, first, p = None, [None] * len(fields), None, None
        for batch in batches:
            for k, held_ in run(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True), key, held):
                key, held, first = k, held_, first if first is not None else k
            p = batch.column(n)[0].as_py() if batch.num_rows else p
        if p is not None:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([repr(key)]), pa.array([key == first]), pa.array([pickle.dumps(held)])], names=["p", "key", "alone", "held"])

    ends = ranged.select(*part, *fields, "_p").mapInArrow(tails, "p int, key string, alone boolean, held binary").collect()  # one row a partition
    open_: dict[int, tuple[str, list]] = {}
    key, held = None, [None] * len(fields)
    for e in sorted(ends, key=lambda e: e.p):
        if key is not None:
            open_[e.p] = (key, held)
        same = e.alone and e.key == key
        own = pickle.loads(bytes(e.held))
        held = [b if b is not None else a for a, b in zip(held, own, strict=True)] if same else own
        key = e.key
    names = [f.name for f in ranged.schema.fields]
    at = [names.index(c) for c in part], [names.index(f) for f in fields]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, started = None, [None] * len(fields), False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_pylist() for i in (*at[0], *at[1])]
            if not started:
                before = open_.get(batch.column(names.index("_p"))[0].as_py())
                first = tuple(c[0] for c in cols[:keys])
                if before and before[0] == repr(first):
                    key, held = first, before[1]
                started = True
            found = list(run(zip(*cols, strict=True), key, held))
            key, held = found[-1]
            arrays = list(batch.columns)
            for j, i in enumerate(at[1]):
                arrays[i] = pa.array([h[j] for _, h in found], batch.column(i).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ranged.mapInArrow(fill, ranged.schema).drop("_p")


def explode_embedded(df: DataFrame, text: str, pattern: str, groups: list[str]) -> DataFrame:
    """Each row, and behind it (``embedded`` true) the row that its text holds, with the pattern's groups as columns."""
    own = F.struct(F.lit(False).alias("embedded"), *(F.lit(None).cast("string").alias(g) for g in groups))
    held = F.struct(F.lit(True).alias("embedded"), *(F.regexp_extract(text, pattern, i + 1).alias(g) for i, g in enumerate(groups)))
    both = F.when(F.col(text).rlike(pattern), F.array(own, held)).otherwise(F.array(own))
    return df.withColumn("_e", F.explode(both)).select(*df.columns, "_e.*")


def islands(lines: DataFrame, part: list[str], order: str, starts: Column) -> DataFrame:
    """``island``: rows that start an item and the lines that continue it; 0 before the first start."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def next_value(part: list[str], order: str, value: Column, reach: int) -> Column:
    """The first value within the rows that follow."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(order).rowsBetween(1, reach))


def last_value(part: list[str], order: str, value: Column, reach: int) -> Column:
    """The nearest value within the rows before."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(order).rowsBetween(-reach, -1))


def zip_by_place(a: DataFrame, b: DataFrame, key: list[str], order_a: list[str], order_b: list[str], how: str = "inner") -> DataFrame:
    """Rows of both sides with one key, first with first, second with second (a queue, first in first out)."""
    first, second = place_in_group(a, key, order_a), place_in_group(b, key, order_b)
    return first.join(second, [*key, "place"], how)
