"""Whose document is a page? Rule tables scored over its text.

A page is read once, by one alternation of all aliases, whatever their number; what was hit is exploded and joined to
the rule table, so that pages times rules never meet. Structural rules (heads of tables, footers) count on windows of
two lines. Of the suppliers with most alias hits the best score wins, ties go to the first name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelith.functions import text as tx

ALIAS_POINTS = 6
UNKNOWN = "DESCONOCIDO"


def alias_table(sources: list[DataFrame]) -> DataFrame:
    """(supplier, alias) of several sources, each alias once whatever its case; earlier sources win."""
    all_ = reduce(DataFrame.unionByName, (s.select("supplier", "alias", F.lit(i).alias("rank")) for i, s in enumerate(sources)))
    folded = all_.withColumn("alias", tx.fold_upper(tx.normalize_spaces("alias"))).where(F.col("alias") != "")
    return folded.groupBy("alias").agg(F.min_by("supplier", F.struct("rank", "supplier")).alias("supplier")).select("supplier", "alias")


def _alternation(aliases: list[str]) -> str:
    """One pattern for all aliases, with shared beginnings written once, so a place is tried letter by letter and not
    alias by alias; the longest alias at a place wins. Blanks in an alias stand for any white space."""
    tree: dict = {}
    for alias in aliases:
        node = tree
        for ch in alias:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        steps = [(r"\s+" if ch == " " else re.escape(ch)) + pattern(below) for ch, below in sorted(node.items()) if ch]
        if not steps:
            return ""
        body = steps[0] if len(steps) == 1 else f"(?:{'|'.join(steps)})"
        return f"(?:{body})?" if "" in node else body

    firsts = "".join(re.escape(ch) for ch in sorted(tree))
    return f"(?<![A-Z0-9])(?=[{firsts}])({pattern(tree)})(?![A-Z0-9])"


def alias_hits(pages: DataFrame, key: list[str], text: str, aliases: DataFrame, max_aliases: int = 20_000) -> DataFrame:
    """(key..., supplier, hits): different aliases of a supplier that stand on a page.

    The aliases are configuration; more than ``max_aliases`` are an error rather than a pattern that can't be compiled.
    """
    rows = aliases.limit(max_aliases + 1).collect()
    if len(rows) > max_aliases:
        raise ValueError(f"more than {max_aliases} aliases")
    if not rows:
        return pages.select(*key, F.lit("").alias("supplier"), F.lit(0).cast("long").alias("hits")).limit(0)
    found = F.regexp_extract_all(tx.fold_upper(F.coalesce(F.col(text), F.lit(""))), F.lit(_alternation([r["alias"] for r in rows])), 1)
    once = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " ")))
    hit = pages.select(*key, F.explode(once).alias("alias"))
    return hit.join(aliases, "alias").groupBy(*key, "supplier").agg(F.count("*").alias("hits"))


def window_hits(lines: DataFrame, key: list[str], rules: list[tuple[str, str, int]]) -> DataFrame:
    """(key..., supplier, points): rules (supplier, pattern, points) over each line with its next one, one hit a window."""
    w = Window.partitionBy(*key).orderBy("ln")
    pair = tx.fold_upper(F.concat_ws(" ", "line", F.lead("line").over(w)))
    seen = lines.select(*key, pair.alias("pair"))
    by_supplier: dict[str, Column] = {}
    for supplier, pattern, points in rules:
        hit = F.when(F.col("pair").rlike(pattern), points).otherwise(0)
        by_supplier[supplier] = F.greatest(by_supplier[supplier], hit) if supplier in by_supplier else hit
    scores = [F.struct(F.lit(s).alias("supplier"), c.alias("points")) for s, c in by_supplier.items()]
    each = seen.select(*key, F.explode(F.filter(F.array(*scores), lambda x: x["points"] > 0)).alias("s"))
    return each.groupBy(*key, "s.supplier").agg(F.sum("s.points").alias("points"))


def text_hits(pages: DataFrame, key: list[str], text: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(key..., supplier, points): hints (supplier, pattern, points) that stand anywhere on a page, such as words of its footer."""
    folded = pages.select(*key, tx.fold_upper(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    hits = F.array(*(F.when(F.col("_t").rlike(p), F.struct(F.lit(s).alias("supplier"), F.lit(n).alias("points"))) for s, p, n in rules))
    each = folded.select(*key, F.explode(F.array_compact(hits)).alias("s"))
    return each.groupBy(*key, "s.supplier").agg(F.sum("s.points").alias("points"))


def gated(hits: DataFrame, pages: DataFrame, key: list[str], text: str, gates: dict[str, str]) -> DataFrame:
    """The hits without those of suppliers whose gate, a pattern, a page doesn't meet."""
    folded = tx.fold_upper(F.coalesce(F.col(text), F.lit("")))
    shut = F.array_compact(F.array(*(F.when(~folded.rlike(p), F.lit(s)) for s, p in gates.items())))
    out = pages.select(*key, F.explode(shut).alias("supplier"))
    return hits.join(out, [*key, "supplier"], "left_anti")


def scores(hits: DataFrame, structural: DataFrame | None, key: list[str], penalties: dict[str, int] | None = None) -> DataFrame:
    """(key..., supplier, hits, score) of alias hits and of the points of other rules, if there are any."""
    both = hits.select(*key, "supplier", "hits", F.lit(0).cast("long").alias("points"))
    if structural is not None:
        both = both.unionByName(structural.select(*key, "supplier", F.lit(0).cast("long").alias("hits"), F.col("points").cast("long").alias("points")))
    total = both.groupBy(*key, "supplier").agg(F.sum("hits").alias("hits"), F.sum("points").alias("points"))
    off = F.lit(0)
    for supplier, points in (penalties or {}).items():
        off = F.when(F.col("supplier") == supplier, points).otherwise(off)
    return total.select(*key, "supplier", "hits", (F.col("hits") * ALIAS_POINTS + F.col("points") - off).alias("score"))


def best(pages: DataFrame, scored: DataFrame, key: list[str], text: str | None = None, nobody: str | None = None) -> DataFrame:
    """(key..., detected) of every page: most alias hits, then the score, then the name; without a positive score unknown.

    ``nobody``: a pattern that makes a page nobody's, whatever else its ``text`` says.
    """
    order = F.struct((-F.col("hits")).alias("h"), (-F.col("score")).alias("s"), F.col("supplier"))
    top = scored.where(F.col("score") > 0).groupBy(*key).agg(F.min(order).alias("o")).select(*key, F.col("o.supplier").alias("supplier"))
    found = F.coalesce("supplier", F.lit(UNKNOWN))
    if nobody:
        found = F.when(F.col("_nobody"), F.lit(UNKNOWN)).otherwise(found)
    stands = tx.fold_upper(F.coalesce(F.col(text), F.lit(""))).rlike(nobody) if nobody else F.lit(False)
    return pages.select(*key, stands.alias("_nobody")).join(top, key, "left").select(*key, found.alias("detected"))


def registered(registry: DataFrame, auxiliary: list[str]) -> DataFrame:
    """The registry without helpers: names in a list, and those that start with an underscore."""
    name = F.lower("parser")
    return registry.where(~name.startswith("_") & ~name.isin([x.lower() for x in auxiliary]))


def resolve_extractor(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, parser): the extractor of the exact supplier, else of the longest supplier whose name contains it or is contained.

    The exact join comes first; only names without one meet the registry's rows, through a shared first word.
    """
    reg = registry.select(F.upper(F.col("supplier")).alias("_s"), "parser")
    exact = names.select("name").distinct().join(reg, F.upper("name") == F.col("_s"), "left")
    left = exact.where(F.col("parser").isNull()).select("name", F.explode(F.array_distinct(F.split(F.upper("name"), r"\s+"))).alias("word"))
    word = reg.select("_s", "parser", F.explode(F.array_distinct(F.split("_s", r"\s+"))).alias("word"))
    near = left.join(word, "word").where(F.upper("name").contains(F.col("_s")) | F.col("_s").contains(F.upper("name")))
    near = near.groupBy("name").agg(F.min_by("parser", F.struct(-F.length("_s"), "_s")).alias("near"))
    joined = exact.join(near, "name", "left")
    return joined.select("name", F.coalesce("parser", "near", F.lit("generic")).alias("parser"))
