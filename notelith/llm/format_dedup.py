"""Records that are equal but for whitespace, letter case, punctuation and the order of their fields.

A record's fields become one canonical key. Its 64-bit hash alone, once for many rows of a task, goes to a range of
hashes, whose Bloom filter of the hashes seen tells which are seen again. Those make a second filter: each task builds its
own, and they are merged piece by piece. With it every record is tested where it lies: only possible repeats are shuffled
and grouped by their exact keys, all others are singletons. A filter never misses what it holds, so the result is exact.

Scale: the same plan at every size. The number of ranges grows with the rows, so that a range's filter stays within
``RANGE_BITS`` (8 MB); the filter of repeats has ``BITS_PER_HASH`` bits for each repeated hash up to ``MAX_FILTER_BITS``
(32 MB), which bounds what a task holds and what is broadcast. Beyond some 60 million different repeated records it lets
through more and more of the singletons, which are then shuffled with the repeats. Groups are counted with map-side
combining, and no task gets a whole hot group (``join_by_key``).

Defined cases
-------------
* A record in which any field is null or blank has no key: it is a singleton.
* Letters, accents, digits and number-like characters matter, in any script; all other characters don't.
* In the field with most letters (the description, wherever it stands) a comma or point between two digits is a decimal
  sign; comma and point are the same sign.
* Exact copies count. Rows that share one id count as copies, but an id isn't reported as a copy of itself.
* An empty table gives no rows. Other columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelith.operators.skew import join_by_key
from notelith.runtime import durable, ship

BITS_PER_HASH = 16
RANGE_BITS = 1 << 26
MAX_FILTER_BITS = 1 << 28
#: Hashes of a task that are united before they are sent.
UNITED_ROWS = 1_000_000
#: Words of 64 bits in one piece of the filter.
SEGMENT = 1 << 13
_DECIMAL = "\u0001"
_BETWEEN = "\u0002"


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]", "")


def _with_decimals(c: Column) -> Column:
    marked = F.regexp_replace(F.lower(c), r"(?<=\p{Nd})[.,](?=\p{Nd})", _DECIMAL)
    return F.regexp_replace(marked, rf"[^\p{{L}}\p{{M}}\p{{N}}{_DECIMAL}]", "")


def canonical_key(fields: list[Column]) -> Column:
    """One text for all ways of writing a record, null where a field is null or blank."""
    parts = [F.struct(_letters(c).alias("letters"), _plain(c).alias("plain"), c.alias("raw")) for c in fields]
    ordered = F.sort_array(F.array(*parts), asc=False)
    key = F.transform(
        ordered, lambda x, i: F.when(i == 0, _with_decimals(x["raw"])).otherwise(x["plain"])
    )
    there = None
    for c in fields:
        ok = c.isNotNull() & c.rlike(r"[^\s\p{Z}\p{Cc}]")
        there = ok if there is None else there & ok
    return F.when(there, F.concat_ws(_BETWEEN, key))


def _filter_bits(n_hashes: int) -> int:
    """Bits as a power of two."""
    return min(1 << max(16, math.ceil(math.log2(max(1, n_hashes * BITS_PER_HASH)))), MAX_FILTER_BITS)


def _word(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - (bits.bit_length() - 1 - 6)).cast("int")


def _mask(h: Column) -> Column:
    mask = None
    for k in range(4):
        at = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def _masks(h: np.ndarray) -> np.ndarray:
    mask = np.zeros(h.size, np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return mask


def possible_repeats(hashes: DataFrame, n_rows: int) -> DataFrame:
    """(h) of every hash that occurs more than once, and few others; ``hashes`` has one column of longs."""
    ranges = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * BITS_PER_HASH // RANGE_BITS))
    words = 1 << max(10, math.ceil(math.log2(max(1, n_rows * BITS_PER_HASH // ranges))) - 6)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each hash once for many rows of a task, so a hot record sends next to nothing."""
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], names=["h", "again"])

        for batch in batches:
            held.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= UNITED_ROWS:
                yield out()
                held = []
        if held:
            yield out()

    def sight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's filter of seen hashes tells which are seen again."""
        seen, shift = np.zeros(words, np.uint64), np.uint64(64 - (words.bit_length() - 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(h, kind="stable")
            repeated = np.zeros(h.size, dtype=bool)
            repeated[order[1:]] = h[order[1:]] == h[order[:-1]]
            at, mask = (h >> shift).astype(np.int64), _masks(h)
            again = repeated | ((seen[at] & mask) == mask) | batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            np.bitwise_or.at(seen, at, mask)
            if again.any():
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(again))], names=["h"])

    return hashes.mapInArrow(unite, "h long, again boolean").repartition(ranges, "h").mapInArrow(sight, "h long")


def merged_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(segment, words) of the Bloom filter of all hashes: each task's own, merged piece by piece."""
    words = bits >> 6
    shift = np.uint64(64 - (words.bit_length() - 1))
    segment = min(SEGMENT, words)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, some = np.zeros(words, np.uint64), False
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            np.bitwise_or.at(seen, (h >> shift).astype(np.int64), _masks(h))
            some |= h.size > 0
        if some:
            for i in np.flatnonzero(seen.reshape(-1, segment).any(axis=1)):
                part = seen[int(i) * segment : (int(i) + 1) * segment]
                yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([part.tobytes()])], names=["segment", "words"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # all pieces together are a filter
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), np.uint64)
                held[i] = held[i] | part if i in held else part
        for i, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.view(np.int64)], pa.list_(pa.int64()))], names=["segment", "words"])

    return hashes.mapInArrow(build, "segment int, words binary").repartition("segment").mapInArrow(merge, "segment int, words array<bigint>")


def keyed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    key = canonical_key([F.col(f"`{f}`") for f in fields])
    return df.select(F.col(f"`{id_col}`").alias("id"), key.alias("key")).withColumn("h", F.xxhash64("key"))


def split_repeats(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(possible repeats, certain singletons) of (id, key, h); records without a key are singletons."""
    ship(records.sparkSession)
    have = records.where(F.col("key").isNotNull())
    lack = records.where(F.col("key").isNull())
    again = durable(possible_repeats(have.select("h"), records.count()))
    bits = _filter_bits(again.count())
    segment = min(SEGMENT, bits >> 6)
    filter_ = merged_filter(again, bits)
    word, mask = _word(F.col("h"), bits), _mask(F.col("h"))
    # Bounded: all words of the filter take MAX_FILTER_BITS at most.
    probed = have.withColumn("segment", F.floor(word / F.lit(segment)).cast("int")).join(F.broadcast(filter_), "segment", "left")
    at = F.element_at("words", (F.pmod(word, F.lit(segment)) + 1).cast("int"))
    hit = F.coalesce(at.bitwiseAND(mask) == mask, F.lit(False))
    return probed.where(hit).select("id", "key", "h"), probed.where(~hit).select("id", "key", "h").unionByName(lack)


def _groups(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def copies_found(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(keep_id, dup_id): each further record of a group with the group's smallest id."""
    candidates = durable(split_repeats(keyed(df, id_col, fields))[0].select("id", "key"))
    groups = durable(_groups(candidates).where(F.col("copies") > 1))
    pairs = join_by_key(candidates, groups, "key", "copies", candidates.count()).where(F.col("id") != F.col("keep_id"))
    return pairs.select("keep_id", F.col("id").alias("dup_id"))


def collapse(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(keep_id, copies): one row for each record, however often and in whatever form it lies there."""
    repeats, singles = split_repeats(keyed(df, id_col, fields))
    return _groups(repeats).select("keep_id", "copies").unionByName(
        singles.select(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    )
