"""One form for texts that look the same: the skeleton of a text.

Decompose, replace each character by the prototype of its look-alikes, decompose again. Texts are looked at as a reader
sees them: whatever is visible (another letter or digit, O and 0 included, case, punctuation, the number of ordinary
spaces, an accent) stays a difference; superscripts and fractions stay what they are.

Defined cases
-------------
* Null gives null, the empty text the empty text.
* Space characters of any width or breaking kind become one ordinary space each; tabs and line ends stay.
* Characters that show nothing (zero-width, joiners, soft hyphen, byte order mark, fillers, selectors of variants) go.
* Letters in a mathematical style, full-width and half-width forms are the plain letter.
* Ties: if several reference rows look like a record, each one is reported. Repeated rows are reported as often.
* Empty tables give no rows; other columns are ignored, whatever their names; texts are read whole.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.runtime import ship

# Letters of other scripts that are drawn as a Latin one, with that one.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j",
}
ARMENIAN = {"Օ": "O", "օ": "o", "ս": "u", "հ": "h"}
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc", strict=True))
#: Latin letters of phonetic alphabets.
PHONETIC = dict(zip("ɑᴄᴏᴠᴡᴢꜱ", "acovwzs", strict=True))
#: Signs drawn alike: micro sign, hyphens of either breaking kind, letter-like signs.
SIGNS = {"µ": "μ", "‐": "-", "‑": "-", "ℓ": "l", "ɡ": "g"}


#: Ways in which a character is another one in a style, a width or without a break: it is drawn as that.
DRAWN_ALIKE = ("<font>", "<wide>", "<narrow>", "<noBreak>")
#: Characters without a mark of their own that aren't format characters: joiners, fillers, selectors of variants.
SHOW_NOTHING = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]


class _Prototypes(dict):
    """Character -> prototype, for ``str.translate``; what no table holds follows from rules and is then kept."""

    def __missing__(self, code: int) -> str | int | None:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" or any(a <= code <= b for a, b in SHOW_NOTHING):
            to: str | int | None = None
        elif kind == "Zs" or code == 0x2800:  # spaces, and the braille cell without a dot
            to = " "
        elif unicodedata.decomposition(ch).startswith(DRAWN_ALIKE) or 0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F:
            # Styles and widths, ligatures and Roman numerals; what that gives may have a prototype of its own.
            plain = unicodedata.normalize("NFKD", ch)
            to = plain if plain == ch else plain.translate(self)
        else:
            to = code
        self[code] = to
        return to


PROTOTYPES = _Prototypes({ord(k): v for t in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC, PHONETIC, SIGNS) for k, v in t.items()})


def skeleton_of(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(PROTOTYPES))


def _each_once(texts: pa.Array, f) -> pa.Array:
    coded = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).dictionary_encode()
    return pa.array([f(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(T.StringType())
def skeleton(texts: pa.Array) -> pa.Array:
    return _each_once(texts, skeleton_of)


@F.arrow_udf(T.StringType())
def shown(texts: pa.Array) -> pa.Array:
    """The skeleton in composed form: what is written where no reference row gives the characters."""
    return _each_once(texts, lambda x: None if x is None else unicodedata.normalize("NFC", skeleton_of(x)))


def look_alikes(records: DataFrame, reference: DataFrame, record_id: str, reference_id: str, fields: list[str]) -> DataFrame:
    """(record id, reference id) where all fields look the same and one at least isn't equal character for character."""
    ship(records.sparkSession)
    a = records.select(F.col(record_id).alias("a"), *(F.col(f"`{f}`").alias(f"a{i}") for i, f in enumerate(fields)))
    b = reference.select(F.col(reference_id).alias("b"), *(F.col(f"`{f}`").alias(f"b{i}") for i, f in enumerate(fields)))
    n = range(len(fields))
    a = a.dropna(subset=[f"a{i}" for i in n]).withColumns({f"s{i}": skeleton(F.col(f"a{i}")) for i in n})
    b = b.dropna(subset=[f"b{i}" for i in n]).withColumns({f"s{i}": skeleton(F.col(f"b{i}")) for i in n})
    differs = F.lit(False)
    for i in n:
        differs = differs | (F.col(f"a{i}") != F.col(f"b{i}"))
    found = a.join(b, [f"s{i}" for i in n]).where(differs)
    return found.select(F.col("a").alias(record_id), F.col("b").alias(reference_id))


def one_form(records: DataFrame, reference: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """Every record with its fields in one form: the reference row's characters where one looks the same, else the shown form."""
    ship(records.sparkSession)
    n = range(len(fields))
    a = records.select(record_id, *(F.col(f"`{f}`").alias(f"a{i}") for i, f in enumerate(fields)))
    a = a.withColumns({f"s{i}": skeleton(F.col(f"a{i}")) for i in n} | {f"o{i}": shown(F.col(f"a{i}")) for i in n})
    b = reference.select(*(F.col(f"`{f}`").alias(f"b{i}") for i, f in enumerate(fields))).dropna()
    b = b.withColumns({f"s{i}": skeleton(F.col(f"b{i}")) for i in n})
    b = b.groupBy(*(f"s{i}" for i in n)).agg(F.min(F.struct(*(f"b{i}" for i in n))).alias("ref"))
    joined = a.join(b, [f"s{i}" for i in n], "left")
    return joined.select(record_id, *(F.coalesce(F.col(f"ref.b{i}"), F.col(f"o{i}")).alias(f) for i, f in enumerate(fields)))


def groups_of_forms(records: DataFrame, field: str) -> DataFrame:
    """(skeleton in composed form, forms, records): the texts that look the same, where they are written in more than one way."""
    ship(records.sparkSession)
    texts = records.select(F.col(f"`{field}`").alias("text")).where(F.col("text").isNotNull())
    forms = texts.groupBy("text").agg(F.count("*").alias("n")).withColumn("skeleton", shown(F.col("text")))
    grouped = forms.groupBy("skeleton").agg(F.count("*").alias("forms"), F.sum("n").alias("records"))
    return grouped.where(F.col("forms") > 1)
