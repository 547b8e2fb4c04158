"""Differences between two copies of one dataset.

Both copies are reduced to the current state of each key (map-side combined, so a key stored a billion times is no
hot task), hashed into blocks of a bounded number of keys, and compared block by block. Within a block the keys of both
copies share one run of ordinals; each copy has a compressed presence bitmap over them. AND-NOT of the bitmaps gives the
rows that one side lacks, their intersection drives a columnar comparison aligned by ordinal.

Defined cases
-------------
* Null, NaN and '' are "missing" and equal to each other; missing against a value is a difference.
* Numbers differ if they are more than ``tolerance`` apart, other values if they aren't equal.
* A key that occurs more than once counts with its latest version; among equal versions the greatest row counts, so
  repeated rows and ties give the same result in any order. A null version is the oldest.
* Null key parts are values like any other: a null key equals a null key.
* An empty copy makes every row of the other one missing; two empty copies give no rows.
* Columns that are neither keys nor compared are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.runtime import blocks_for, ship

#: Keys of one block: bounds a task's memory, whatever the size of the copies.
KEYS_PER_BLOCK = 50_000


class PresenceBitmap:
    """Presence over ordinals 0..n-1 in containers of 65,536, each kept as runs or as bits, whichever is smaller."""

    SPAN = 1 << 16

    def __init__(self, n: int, ordinals: np.ndarray):
        bits = np.zeros(n, dtype=bool)
        bits[ordinals] = True
        self.n = n
        self.containers = [self._pack(bits[i : i + self.SPAN]) for i in range(0, n, self.SPAN)]

    @staticmethod
    def _pack(bits: np.ndarray) -> tuple[str, int, np.ndarray]:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], bits.view(np.int8), [0]))))
        if edges.size * 4 < bits.size // 8:
            return "runs", bits.size, edges.astype(np.uint32)
        return "bits", bits.size, np.packbits(bits)

    @staticmethod
    def _unpack(container: tuple[str, int, np.ndarray]) -> np.ndarray:
        kind, size, data = container
        if kind == "bits":
            return np.unpackbits(data, count=size).view(bool)
        steps = np.zeros(size + 1, dtype=np.int8)
        steps[data[::2]] = 1
        steps[data[1::2]] -= 1
        return np.cumsum(steps[:-1], dtype=np.int8).view(bool)

    def _each(self, other: PresenceBitmap, op) -> np.ndarray:
        parts = [
            np.flatnonzero(op(self._unpack(a), self._unpack(b))) + i * self.SPAN
            for i, (a, b) in enumerate(zip(self.containers, other.containers, strict=True))
        ]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def and_not(self, other: PresenceBitmap) -> np.ndarray:
        return self._each(other, lambda a, b: a & ~b)

    def intersect(self, other: PresenceBitmap) -> np.ndarray:
        return self._each(other, np.logical_and)


def _columns_differ(a: pa.Array, b: pa.Array, tolerance: float) -> np.ndarray:
    """Of two aligned columns; missing equals missing."""
    if pa.types.is_floating(a.type):
        unequal = pc.greater(pc.abs(pc.subtract(a, b)), tolerance)
        # An infinity less itself is NaN, which is greater than nothing; against another value it is an infinity.
    else:
        unequal = pc.not_equal(a, b)
    one_missing = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(unequal, False), one_missing).to_numpy(zero_copy_only=False)


def _key_text(keys: list[str]) -> Column:
    """One text for a key in which null and every value stay apart."""
    parts = []
    for k in keys:
        c = F.col(f"`{k}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~")))
    return F.concat(*parts)


def _cleaned(df: DataFrame, fields: list[str]) -> list[Column]:
    """The fields as f0, f1, ...: NaN and '' are null."""
    kinds = dict(df.dtypes)
    cols = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f}`")
        if kinds[f] in ("double", "float"):
            c = F.when(F.isnan(c), None).otherwise(c.cast("double"))
        elif kinds[f] == "string":
            c = F.nullif(c, F.lit(""))
        cols.append(c.alias(f"f{i}"))
    return cols


def _latest_of_batch(order: list[str]):
    """Keeps the last row of each key of a batch: a key that lies there often sends little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows > 1:
                at = pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in ("_key", *order)], null_placement="at_start")
                key = batch["_key"].take(at)
                last = np.append(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False), True)
                batch = batch.take(at.filter(pa.array(last)))
            yield batch

    return run


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    version: str,
    tolerance: float = 0.005,
    missing_left: str = "missing_in_left",
    missing_right: str = "missing_in_right",
    keys_per_block: int = KEYS_PER_BLOCK,
) -> DataFrame:
    """One row (keys..., finding) for each missing row and each differing field."""
    ship(left.sparkSession)
    n_blocks = blocks_for(left.count() + right.count(), 2 * keys_per_block, least=8)
    schema = T.StructType([*(left.schema[k] for k in keys), T.StructField("finding", T.StringType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    key_names, field_names = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(len(fields))]

    def side(df: DataFrame) -> DataFrame:
        """The current state of each key, shuffled once: to its block, where both the aggregate and the comparison find it."""
        key = _key_text(keys)
        slim = df.select(
            F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("_block"),
            key.alias("_key"),
            *(F.col(f"`{k}`").alias(n) for k, n in zip(keys, key_names, strict=True)),
            F.col(f"`{version}`").alias("_v"),
            *_cleaned(df, fields),
        )
        united = slim.mapInArrow(_latest_of_batch(["_v", *field_names]), slim.schema).repartition("_block")
        state = united.groupBy("_block", "_key", *key_names).agg(F.max(F.struct("_v", *field_names)).alias("_s"))
        return state.select("_block", "_key", *key_names, *(f"_s.{f}" for f in field_names))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        n_a = a.num_rows
        both = pa.chunked_array([*a["_key"].chunks, *b["_key"].chunks], type=pa.string()).combine_chunks()
        coded = both.dictionary_encode()
        ordinals, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        of_a, of_b = ordinals[:n_a], ordinals[n_a:]
        in_a, in_b = PresenceBitmap(n, of_a), PresenceBitmap(n, of_b)
        row_a, row_b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        row_a[of_a], row_b[of_b] = np.arange(n_a), np.arange(b.num_rows)
        found: list[pa.Table] = []

        def emit(source: pa.Table, rows: np.ndarray, finding: str) -> None:
            if rows.size:
                part = source.take(pa.array(rows))
                found.append(
                    pa.table([*(part[f"k{i}"] for i in range(len(keys))), pa.array([finding] * rows.size)], names=[*keys, "finding"])
                )

        emit(a, row_a[in_a.and_not(in_b)], missing_right)
        emit(b, row_b[in_b.and_not(in_a)], missing_left)
        shared = in_a.intersect(in_b)
        take_a, take_b = pa.array(row_a[shared]), pa.array(row_b[shared])
        for i, field in enumerate(fields):
            x, y = a[f"f{i}"].take(take_a).combine_chunks(), b[f"f{i}"].take(take_b).combine_chunks()
            emit(a, row_a[shared[_columns_differ(x, y, tolerance)]], field)
        if found:
            return pa.concat_tables(found)
        return pa.table([*(a[f"k{i}"].slice(0, 0) for i in range(len(keys))), pa.array([], pa.string())], names=[*keys, "finding"])

    return side(left).groupBy("_block").cogroup(side(right).groupBy("_block")).applyInArrow(compare, schema)
