import random
import unicodedata
from collections import defaultdict

import pytest
from notelith.llm import format_dedup as fd
from pyspark.sql import functions as F

FIELDS = ["AlbaranNumero", "Codigo", "Descripcion"]
SCHEMA = "line_id long, AlbaranNumero string, Codigo string, Descripcion string, key string, id int, h int, segment int, words string, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "k", 1, 2, 3, "w", 4) for i, r in enumerate(rows, 1)], SCHEMA)


def brute(rows):
    def canon(text, decimals):
        out = []
        for i, ch in enumerate(text.lower()):
            if unicodedata.category(ch)[0] in "LMN":
                out.append(ch)
            elif decimals and ch in ".," and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
                out.append("\x01")
        return "".join(out)

    groups = defaultdict(list)
    for i, row in enumerate(rows, 1):
        if any(x is None or not x.strip() for x in row):
            continue
        ranked = sorted(row, key=lambda x: (sum(c.isalpha() for c in x), canon(x, False)), reverse=True)
        groups[canon(ranked[0], True), canon(ranked[1], False), canon(ranked[2], False)].append(i)
    return {(v[0], x) for v in groups.values() for x in v[1:]}


ROWS = [
    ("AV 001", "X-12", "Tubo de cobre 1,5 mm"),
    ("av001", "x12", "TUBO  de\tcobre 1.5 mm."),
    ("AV 001", "Tubo de cobre 1,5 mm", "X 12"),
    ("AV 001", "X-12", "Tubo de cobre 15 mm"),
    ("AV 001", "X-12", "Túbo de cobre 1,5 mm"),
    ("AV.0.01", "X-12", "Tubo de cobre 1,5 mm"),
    (None, "X-12", "Tubo de cobre 1,5 mm"),
    (" ", "X-12", "Tubo de cobre 1,5 mm"),
    ("AV 001", "X-12", None),
    ("AV 001", "X-12", "Tubo de cobre 1,5 mm"),
    ("A", "B", "C"),
    ("C", "A", "B"),
    ("B", "C", "a."),
]


def test_cases(spark):
    found = {tuple(r) for r in fd.copies_found(frame(spark, ROWS), "line_id", FIELDS).collect()}
    assert found == brute(ROWS) == {(1, 2), (1, 3), (1, 6), (1, 10), (11, 12), (11, 13)}


def test_collapse_counts_every_row_once(spark):
    found = {r.keep_id: r.copies for r in fd.collapse(frame(spark, ROWS), "line_id", FIELDS).collect()}
    assert sum(found.values()) == len(ROWS)
    assert found[1] == 5 and found[11] == 3 and found[7] == 1


def test_random_against_brute_force(spark):
    r = random.Random(3)
    words = ["tubo", "Codo", "cable 1,5", "1.5", "15", "ñ", "N-1", "n1", "(a)", "A"]
    rows = [tuple(r.choice(words) + r.choice(["", " ", ".", "\t"]) + r.choice(words) for _ in range(3)) for _ in range(800)]
    assert {tuple(x) for x in fd.copies_found(frame(spark, rows), "line_id", FIELDS).collect()} == brute(rows)


def test_empty_table_and_long_text(spark):
    assert fd.copies_found(frame(spark, ROWS).where("false"), "line_id", FIELDS).collect() == []
    assert fd.collapse(frame(spark, ROWS).where("false"), "line_id", FIELDS).collect() == []
    rows = [("1", "2", "x y" * 400_000), ("1", "2", "X Y" * 400_000), ("1", "2", "x y" * 400_000 + "z")]
    assert [tuple(r) for r in fd.copies_found(frame(spark, rows), "line_id", FIELDS).collect()] == [(1, 2)]


def test_filter_misses_no_repeat(spark):
    """Repeats within a task and across tasks all pass; most others don't."""
    rows = spark.range(0, 40_000, 1, 8).select(F.xxhash64(F.when(F.col("id") < 500, F.col("id")).when(F.col("id") >= 39_500, F.col("id") - 39_500).otherwise(F.col("id"))).alias("h"))
    records = rows.select(F.monotonically_increasing_id().alias("id"), F.col("h").cast("string").alias("key"), "h")
    repeats, singles = fd.split_repeats(records)
    counts = {r.key: r["count"] for r in repeats.groupBy("key").count().collect()}
    assert sum(1 for n in counts.values() if n == 2) == 500
    assert repeats.count() + singles.count() == 40_000
    assert repeats.count() < 3_000


def test_saturated_filters_and_a_hot_group(spark, monkeypatch):
    """With filters so small that they let everything through, many ranges, and a group above the limit for broadcast, the pairs are the same."""
    from notelith.operators import skew

    rows = [("1", "2", "hot hot")] * 300 + [(str(i), "c", "cold words") for i in range(50)] * 2 + [(str(i), "d", "alone") for i in range(400)]
    want = {tuple(r) for r in fd.copies_found(frame(spark, rows), "line_id", FIELDS).collect()}
    monkeypatch.setattr(fd, "MAX_FILTER_BITS", 1 << 7)
    monkeypatch.setattr(fd, "RANGE_BITS", 1 << 10)
    monkeypatch.setattr(fd, "UNITED_ROWS", 10)
    monkeypatch.setattr(skew.join_by_key, "__defaults__", (100,))
    assert {tuple(r) for r in fd.copies_found(frame(spark, rows), "line_id", FIELDS).collect()} == want == brute(rows)
    collapsed = {r.keep_id: r.copies for r in fd.collapse(frame(spark, rows), "line_id", FIELDS).collect()}
    assert sum(collapsed.values()) == len(rows) and len(collapsed) == 451


def test_one_plan_at_every_size(spark, monkeypatch):
    """A million rows and what stands for billions (bounds a thousand times smaller) are planned alike."""
    import re

    hashes = spark.range(1000).select(F.xxhash64("id").alias("h"))
    plan = lambda df: re.sub(r"[#\d]+", "", df._jdf.queryExecution().optimizedPlan().toString())
    few = plan(fd.possible_repeats(hashes, 1_000_000))
    assert few == plan(fd.possible_repeats(hashes, 4_000_000_000))
    monkeypatch.setattr(fd, "RANGE_BITS", 1 << 16)
    ranges = fd.possible_repeats(hashes, 4_000_000).rdd.getNumPartitions()
    assert ranges == -(-4_000_000 * fd.BITS_PER_HASH // (1 << 16))


@pytest.mark.parametrize("n, bits", [(0, 1 << 16), (10_000, 1 << 18), (1 << 30, 1 << 28)])
def test_filter_size(n, bits):
    assert fd._filter_bits(n) == bits
