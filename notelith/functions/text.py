"""Text expressions: all of them columns, so they stay inside generated code.

Java's classes are ASCII by default; ``WS`` is white space in any script. Patterns avoid look-around where an oracle in
another dialect has to say the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"

# Latin letters with marks and their plain forms.
ACCENTED = "ÁÀÂÄÃÅáàâäãåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÖÕóòôöõÚÙÛÜúùûüÑñÇçÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuNnCcYyy"

#: Characters that recognition confuses inside numbers.
GLYPHS = ("OQSBIlZG|]", "0058112611")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it occurs there: keeps long chains from growing."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), rf"^{WS}+", ""), rf"{WS}+$", "")


def normalize_spaces(c: Column | str) -> Column:
    """Runs of two or more white-space characters become one blank; a single tab stays."""
    return trim_ws(F.regexp_replace(col(c), rf"{WS}{{2,}}", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.when(F.length(trim_ws(c)) > 0, col(c))


def strip_marks(c: Column | str) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def fold_upper(c: Column | str) -> Column:
    folded = strip_marks(c)
    for a, b in (("ß", "ss"), ("ﬂ", "fl"), ("ﬁ", "fi")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.upper(folded)


def ascii_only(c: Column | str) -> Column:
    return F.regexp_replace(strip_marks(c), r"[^\x00-\x7F]", "")


def key_token(c: Column | str) -> Column:
    """Letters and digits of a key, upper case."""
    return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]", "")


def first_match(c: Column | str, patterns: list[str]) -> Column:
    """The first group of the first pattern that is found; '' if none is."""
    found = [F.nullif(trim_ws(F.regexp_extract(col(c), p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def lines_of(c: Column | str) -> Column:
    """Lines in order, spaces normalized, without blank ones."""
    lines = F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n"), "\n")
    return F.filter(F.transform(lines, normalize_spaces), lambda x: x != "")


def first_match_in_lines(lines: Column | str, patterns: list[str]) -> Column:
    """Line by line, then pattern by pattern."""
    found = F.filter(F.transform(col(lines), lambda x: first_match(x, patterns)), lambda x: x != "")
    return F.coalesce(F.get(found, 0), F.lit(""))


def header_index(lines: Column | str, markers: list[str]) -> Column:
    """Position (from 0) of the first line that contains all markers, or null."""

    def hit(line: Column) -> Column:
        folded = fold_upper(line)
        ok = F.lit(True)
        for m in markers:
            ok = ok & folded.contains(m)
        return ok

    at = F.array_position(F.transform(col(lines), hit), True)
    return F.when(at > 0, (at - 1).cast("int"))


def decimals_in(c: Column | str) -> Column:
    """All numbers with decimals of a line, as written."""
    return F.regexp_extract_all(col(c), F.lit(r"(-?[0-9][0-9.]*,[0-9]+)"), 1)


def fix_glyphs(c: Column | str) -> Column:
    return F.translate(col(c), *GLYPHS)


def squash_doubles(c: Column | str) -> Column:
    """AABB -> AB for capital letters."""
    return F.regexp_replace(col(c), r"([A-Z])\1+", "$1")


def strip_counter(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^[0-9]{1,3}:\s*", "")


def join_code_parts(c: Column | str) -> Column:
    """'ABC 12345' is one token."""
    return F.regexp_replace(col(c), r"(^|[^\p{L}\p{N}_])([A-Za-z]{2,}) ([0-9]{3,})($|[^\p{L}\p{N}_])", "$1$2$3$4")


def keywords(c: Column | str, stop: list[str], n: int = 5) -> Column:
    """The first n words of four letters or more that aren't numbers or stop words."""
    words = F.split(F.regexp_replace(fold_upper(c), "[^A-Z0-9]+", " "), " ")
    good = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$") & ~w.isin(stop))
    return F.slice(good, 1, n)


def hint(c: Column | str, n: int = 80) -> Column:
    return F.substring(key_token(fold_upper(c)), 1, n)


def merge_texts(base: Column | str, extra: Column | str) -> Column:
    """Base, with the extra text behind it unless it is contained."""
    a, b = F.coalesce(col(base), F.lit("")), F.coalesce(col(extra), F.lit(""))
    ta, tb = trim_ws(a), trim_ws(b)
    return F.when(tb == "", a).when(ta == "", tb).when(ta.contains(tb), ta).otherwise(F.concat(ta, F.lit("\n"), tb))


def union_lines(a: Column | str, b: Column | str) -> Column:
    """Lines of both texts, each once, in order."""
    return F.array_union(lines_of(a), lines_of(b))


def append_tokens(existing: Column | str, tokens: Column) -> Column:
    """Tokens behind those that are there, each once, joined with ';'."""
    there = F.filter(F.split(F.coalesce(col(existing), F.lit("")), "[;|]"), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(there, tokens)), ";")


@F.arrow_udf(T.StringType())
def repair_mojibake(texts):
    """UTF-8 read as Latin-1, read again; unchanged where that fails. Not expressible as a column."""
    import pyarrow as pa

    def fix(x):
        try:
            return None if x is None else x.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return x

    return pa.array([fix(x) for x in texts.to_pylist()], pa.string())


def strip_noise_prefix(c: Column | str) -> Column:
    """Marks and lone letters that recognition puts in front of a line: '| . ~ a)' and the like, as often as they come."""
    return F.regexp_replace(col(c), r"^(?:[|~_.,:;'*=\-]+\s*|[a-z]\)\s*)+", "")


def contains_all_of(c: Column | str, groups: list[list[str]]) -> Column:
    """Whether all words of one group stand in a text: headings, telephone lines and other lines that are no rows."""
    folded = fold_upper(c)
    hit = F.lit(False)
    for words in groups:
        all_ = F.lit(True)
        for w in words:
            all_ = all_ & folded.contains(w)
        hit = hit | all_
    return F.coalesce(hit, F.lit(False))


def text_in_box(words: Column | str, x0: float, top: float, x1: float, bottom: float) -> Column:
    """The words whose middle lies in a box, from top to bottom and from left to right."""
    x, y = lambda w: (w["x0"] + w["x1"]) / 2, lambda w: (w["top"] + w["bottom"]) / 2
    inside = F.filter(col(words), lambda w: (x(w) >= x0) & (x(w) <= x1) & (y(w) >= top) & (y(w) <= bottom))
    ordered = F.array_sort(F.transform(inside, lambda w: F.struct(F.round(w["top"]).alias("t"), w["x0"].alias("x"), w["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda w: w["text"]), " ")
