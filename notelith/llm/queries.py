"""Registered queries over text corpora and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelith.llm import bpe, confusables, format_dedup, leakage, listings, quality
from notelith.runtime import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether the decoded ids give the text again; null comes back as the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode_corpus(bpe.encode_corpus(docs)).withColumnRenamed("text", "back")
    same = docs.join(back, "doc_id").select((F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))
    return same.groupBy("same").agg(F.count("*").alias("documents"))


LINE_FIELDS = ["AlbaranNumero", "Codigo", "Descripcion"]
ARTICLE_FIELDS = ["Codigo", "Descripcion"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dedup.copies_found(table(spark, sf_dir, "detail_lines"), "line_id", LINE_FIELDS)


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dedup.collapse(table(spark, sf_dir, "detail_lines"), "line_id", LINE_FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, articles = table(spark, sf_dir, "detail_lines"), table(spark, sf_dir, "articles")
    return confusables.look_alikes(lines, articles, "line_id", "art_id", ARTICLE_FIELDS)


def p3_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, articles = table(spark, sf_dir, "detail_lines"), table(spark, sf_dir, "articles")
    return confusables.one_form(lines, articles, "line_id", ARTICLE_FIELDS)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.groups_of_forms(table(spark, sf_dir, "detail_lines"), "Descripcion")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.same_product_pairs(table(spark, sf_dir, "catalog_listings"))


def p5_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.products(table(spark, sf_dir, "catalog_listings"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by item: which test items leaked, into how many documents."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    counts = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(counts, "item_id").select("item_id", "suite", "documents")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = quality.document_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return kinds.where(F.col("kind") != "prose").select("doc_id", "kind")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.corpus_stats(table(spark, sf_dir, "documents"))
    names = {
        "mean_word": "mean_word_length", "symbol_ratio": "symbol_ratio", "digit_ratio": "digit_ratio", "upper_ratio": "upper_ratio", "letters": "letter_ratio",
        "stop_lines": "stop_line_share", "common_words": "common_word_share", "line_length": "mean_line_length", "line_words": "words_per_line",
    }
    return stats.select("doc_id", F.col("words").cast("long").alias("words"), *(F.round(a, 6).alias(b) for a, b in names.items()))


_QUERIES = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p3_found": p3_found,
    "p3_one_form": p3_one_form,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p5_products": p5_products,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
}

#: p1's canonical key. RE2 has no look-around: the decimal sign is marked twice for runs like 1,2,3.
_P1_KEYS = r"""
WITH v AS (SELECT line_id, [AlbaranNumero, Codigo, Descripcion] f FROM detail_lines
           WHERE regexp_matches(AlbaranNumero, '[^\s\p{Z}\p{Cc}]') AND regexp_matches(Codigo, '[^\s\p{Z}\p{Cc}]')
             AND regexp_matches(Descripcion, '[^\s\p{Z}\p{Cc}]')),
s AS (SELECT line_id, list_reverse_sort(list_transform(f, lambda x: {
        'n': length(regexp_replace(x, '[^\p{L}]', '', 'g')),
        'p': regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]', '', 'g'),
        'd': regexp_replace(regexp_replace(regexp_replace(lower(x), '(\p{Nd})[.,](\p{Nd})', '\1' || chr(1) || '\2', 'g'),
             '(\p{Nd})[.,](\p{Nd})', '\1' || chr(1) || '\2', 'g'), '[^\p{L}\p{M}\p{N}\x01]', '', 'g')})) l FROM v),
k AS (SELECT line_id, l[1].d || chr(2) || l[2].p || chr(2) || l[3].p AS key FROM s),
g AS (SELECT line_id, key, min(line_id) OVER (PARTITION BY key) AS keep_id FROM k)
"""

_COMMON = sorted({w for words in quality.COMMON_WORDS.values() for w in words.split()})

_P8_STATS = (
    r"""
WITH d AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) t FROM documents),
p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '') w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]')) l,
             length(regexp_replace(t, '[^\p{L}\p{M}]', '', 'g')) letters, length(regexp_replace(t, '[^\p{N}]', '', 'g')) digits,
             length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) uppers, length(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g')) shown,
             length(regexp_replace(t, '[^.?!…。！？؟।,;:()¿¡«»"''’“”/-]', '', 'g')) marks
      FROM d)
SELECT doc_id, len(w) AS words, round(shown / greatest(len(w), 1), 6) AS mean_word_length,
       round((shown - letters - digits - marks) / greatest(shown, 1), 6) AS symbol_ratio, round(letters / greatest(shown, 1), 6) AS letter_ratio,
       round(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) / greatest(len(l), 1), 6) AS mean_line_length, round(len(w) / greatest(len(l), 1), 6) AS words_per_line,
       round(digits / greatest(shown, 1), 6) AS digit_ratio, round(uppers / greatest(letters, 1), 6) AS upper_ratio,
       round(len(list_filter(l, lambda x: regexp_matches(x, '[.?!…。！？؟।][\s\x0b\x1c-\x1f\x{85}\p{Z}]*$'))) / greatest(len(l), 1), 6) AS stop_line_share,
       round(len(list_filter(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]', '', 'g') IN ("""
    + ", ".join(f"'{w}'" for w in _COMMON)
    + """))) / greatest(len(w), 1), 6) AS common_word_share
FROM p"""
)

_LOOKS = {k: v for t in (confusables.CYRILLIC, confusables.GREEK, confusables.ARMENIAN, confusables.SIGNS) for k, v in t.items()}
_LOOKS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}

# DuckDB only composes: letters with a mark need their own prototypes there.
for _k, _v in list(_LOOKS.items()):
    for _mark in map(chr, (*range(0x300, 0x315), 0x327, 0x328)):
        _a, _b = (unicodedata.normalize("NFC", x + _mark) for x in (_k, _v))
        if len(_a) == len(_b) == 1:
            _LOOKS.setdefault(_a, _b)


def _skeleton_sql(x: str) -> str:
    """The skeleton in composed form; the rules for rarer characters aren't needed for these tables."""
    a, b = ("".join(part).replace("'", "''") for part in zip(*_LOOKS.items(), strict=True))
    return f"nfc_normalize(regexp_replace(replace(replace(translate(nfc_normalize({x}), '{a}', '{b}'), 'ﬂ', 'fl'), 'ﬁ', 'fi'), '\\p{{Cf}}', '', 'g'))"


_P3 = f"""
WITH l AS (SELECT line_id, Codigo, Descripcion, {_skeleton_sql("Codigo")} sc, {_skeleton_sql("Descripcion")} sd FROM detail_lines),
a AS (SELECT art_id, Codigo, Descripcion, {_skeleton_sql("Codigo")} sc, {_skeleton_sql("Descripcion")} sd FROM articles)
"""

_SQL = {
    "p3_found": _P3
    + "SELECT line_id, art_id FROM l JOIN a ON a.sc = l.sc AND a.sd = l.sd WHERE l.Codigo <> a.Codigo OR l.Descripcion <> a.Descripcion",
    "p3_one_form": _P3
    + """, r AS (SELECT sc, sd, min((Codigo, Descripcion)) x FROM a GROUP BY sc, sd)
SELECT line_id, coalesce(x[1], l.sc) AS Codigo, coalesce(x[2], l.sd) AS Descripcion FROM l LEFT JOIN r ON r.sc = l.sc AND r.sd = l.sd""",
    "p3_groups": _P3
    + """, f AS (SELECT sd, Descripcion, count(*) n FROM l WHERE Descripcion IS NOT NULL GROUP BY ALL)
SELECT sd AS skeleton, count(*) AS forms, sum(n) AS records FROM f GROUP BY sd HAVING count(*) > 1""",
    "p8_stats": _P8_STATS,
    "p1_found": _P1_KEYS + "SELECT keep_id, line_id AS dup_id FROM g WHERE line_id <> keep_id",
    "p1_collapsed": _P1_KEYS
    + """SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id UNION ALL
SELECT line_id, 1 FROM detail_lines WHERE line_id NOT IN (SELECT line_id FROM g)""",
    "p6_roundtrip": "SELECT TRUE AS same, count(*) AS documents FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
