"""Catalogue listings that offer one product: token blocking, a weighted graph of listings, pruning, rules, clusters.

A listing is read into tokens: the manufacturer's reference, measures in common units, series, kind of goods, colour and
all other words (wordings, colours, advertising and units of a trade are a parameter, ``Vocabulary``; what it doesn't know
stays a word). Listings of the same words, reference and tokens are one node (map-side combined, so copies cost nothing).

Blocks are a listing's measures and series together with one of its words. Every two nodes of a block are an edge, which
weighs the sum of the rarities of the blocks that both lie in; a block of more than ``BLOCK_PAIRS`` nodes gives, instead of
pairs, edges from each node to the first of the same tokens in it. Each node prunes edges below the mean of its own (an
edge stays that one of its ends keeps). Attribute rules verify the survivors, and connected components are the products.
Blocks of a reference are exact: each node is linked with the first of its head there (type, words, series), and heads
that agree with each other through blocks by which of the three are known, so no agreeing pair is lost and none is emitted.

Rules: nodes with two different references are different products. One reference is one product if type, words and
series agree where both are known. Without a reference only equal tokens are one product; a listing without one joins
those with a reference only if its tokens occur with a single reference.

Defined cases
-------------
* Null, empty and blank descriptions without a reference are products of their own.
* Codes that aren't a reference (a seller's own, shared ones) say nothing; null codes neither.
* Words that the vocabulary doesn't know are tokens as they are, so unknown goods are grouped by equal words.
* Repeated listing ids are one listing. Empty tables give no rows; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.operators.skew import join_by_key
from notelith.runtime import durable, ship

# Kinds of goods with the wordings under which sellers list them.
TYPES = {
    "abrazadera": ["abrazadera de metal", "abrazadera metalica", "brida abrazadera metalica", "metal pipe clamp"],
    "bateria": ["bateria recargable", "bateria de reserva recargable", "acumulador recargable", "rechargeable battery"],
    "bombilla": ["bombilla led", "lampara led", "lampara de led", "led bulb"],
    "broca": ["broca metal", "broca para metal", "broca hss metal", "metal drill bit"],
    "cable": ["cable flexible", "hilo electrico flexible", "manguera flexible", "flexible cable"],
    "canaleta": ["canaleta adhesiva", "minicanal adhesiva", "canal adhesiva para cables", "adhesive trunking"],
    "cinta": ["cinta aislante", "cinta electrica aislante", "rollo cinta aislante", "insulating tape"],
    "disco": ["disco de corte metal", "disco corte para metal", "disco abrasivo de corte", "metal cutting disc"],
    "electrodo": ["electrodo de soldadura", "electrodo para soldar", "varilla de soldar", "welding electrode"],
    "foco": ["foco led exterior", "foco proyector led de exterior", "proyector led exterior", "outdoor led floodlight"],
    "grasa": ["grasa multiuso", "grasa lubricante multiuso", "lubricante en grasa multiuso", "multipurpose grease"],
    "magnetotermico": ["interruptor magnetotermico", "automatico magnetotermico", "magnetotermico", "circuit breaker"],
    "pintura": ["pintura mate interior", "pintura plastica mate", "pintura plastica interior mate", "matt emulsion paint"],
    "silicona": ["silicona neutra", "sellador de silicona neutra", "sellante silicona neutra", "neutral silicone sealant"],
    "toma": ["toma de corriente", "base de enchufe", "enchufe schuko", "socket outlet"],
    "tornillo": ["tornillo rosca chapa", "tornillo autorroscante", "tirafondo rosca chapa", "self tapping screw"],
    "tubo": ["tubo corrugado", "tuberia corrugada", "corrugado", "corrugated tube"],
    "valvula": ["valvula de esfera", "valvula esferica", "llave de esfera", "ball valve"],
}
# Colours in the catalogues' languages.
COLOURS = {
    "negro": "negro", "black": "negro", "blanco": "blanco", "white": "blanco", "gris": "gris", "grey": "gris", "gray": "gris",
    "rojo": "rojo", "red": "rojo", "verde": "verde", "green": "verde", "azul": "azul", "blue": "azul", "amarillo": "amarillo",
    "yellow": "amarillo", "marron": "marron", "brown": "marron",
}
# Advertising and packaging words that say nothing about the product.
ADVERTISING = [
    "el mejor del mercado", "super precio", "gran calidad", "stock permanente", "ideal para instaladores", "promo verano", "novedad",
    "calidad profesional", "fabricacion europea", "nuevo", "oferta", "top ventas", "best seller", "ultimas unidades", "original",
    "precio web", "uso profesional", "envio 24h", "garantia 2 anos",
]
# Units of technical attributes with their dimension and factor.
UNITS = {
    "mm": ("length", 1.0), "cm": ("length", 10.0), "m": ("length", 1000.0), "mts": ("length", 1000.0), "metros": ("length", 1000.0), "mt": ("length", 1000.0),
    "mm2": ("section", 1.0), "g": ("mass", 1.0), "gr": ("mass", 1.0), "kg": ("mass", 1000.0), "kgs": ("mass", 1000.0),
    "ml": ("volume", 1.0), "cl": ("volume", 10.0), "l": ("volume", 1000.0), "litros": ("volume", 1000.0), "lts": ("volume", 1000.0),
    "v": ("voltage", 1.0), "volt": ("voltage", 1.0), "voltios": ("voltage", 1.0), "a": ("current", 1.0), "amp": ("current", 1.0), "amperios": ("current", 1.0),
    "ah": ("charge", 1.0), "amperios hora": ("charge", 1.0), "ka": ("breaking", 1.0), "w": ("power", 1.0), "vatios": ("power", 1.0), "kw": ("power", 1000.0),
    "k": ("light", 1.0), "kelvin": ("light", 1.0), "bar": ("pressure", 1.0), "bares": ("pressure", 1.0), "rpm": ("speed", 1.0),
    "p": ("poles", 1.0), "polos": ("poles", 1.0), "uds": ("pack", 1.0), "ud": ("pack", 1.0), "unidades": ("pack", 1.0),
}


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.replace("²", "2")).lower()
    return "".join(c for c in text if not unicodedata.combining(c))


_REFERENCE = re.compile(r"\b([a-z]{3})[-. ]?(\d{7})[-. ]?(\d)\b")
_LOAD = re.compile(r"\bcarga\s*(?:max\.?\s*)?(\d+(?:[.,]\d+)?)\s*kg\b")
_PACK = re.compile(r"\b(?:caja de|pack(?: de)?|bolsa de)\s*(\d+)\b")
_SERIES = re.compile(r"\b(?:serie |mod\.? ?)?([a-z]\d[a-z])\b")
_LABELS = re.compile(r"\b(?:marca|serie|mod|color|ref|cod|largo|long|diametro|carga|max)\b|[ø=:|,;()¡!.\-/]")


@dataclass
class Vocabulary:
    """What is known of a trade's words; an empty one leaves every word a token of its own."""

    types: dict[str, list[str]] = field(default_factory=lambda: TYPES)
    colours: dict[str, str] = field(default_factory=lambda: COLOURS)
    advertising: list[str] = field(default_factory=lambda: ADVERTISING)
    units: dict[str, tuple[str, float]] = field(default_factory=lambda: UNITS)

    def __post_init__(self) -> None:
        longest = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) or "(?!)"
        self.type_of = {w: k for k, ws in self.types.items() for w in ws}
        self.type_pattern = re.compile(rf"\b({longest(self.type_of)})\b")
        self.advertising_pattern = re.compile(rf"\b(?:{longest(self.advertising)})\b")
        self.measure_pattern = re.compile(rf"(?<![\w.,])(?:l\s*=\s*|ø\s*)?(\d+(?:[.,]\d+)?)\s*-?\s*(r\.p\.m|{longest(self.units)})(?![a-z0-9])\.?")

    def parse(self, code: str | None, text: str | None) -> dict:
        """What a listing says: reference, type, words, series, colour and measures in common units."""
        t = fold(text or "")
        ref = None
        for source in (fold(code or ""), t):
            m = _REFERENCE.search(source)
            if m:
                ref = "".join(m.groups()).upper()
                break
        t = _REFERENCE.sub(" ", t)
        t = self.advertising_pattern.sub(" ", t)
        measures: list[tuple[str, float]] = []
        m = self.type_pattern.search(t)
        kind = self.type_of[m[1]] if m else None
        t = self.type_pattern.sub(" ", t, count=1)
        for pattern, dimension in ((_LOAD, "load"), (_PACK, "pack")):
            measures += [(dimension, float(m[1].replace(",", "."))) for m in pattern.finditer(t)]
            t = pattern.sub(" ", t)
        for m in self.measure_pattern.finditer(t):
            dimension, factor = ("speed", 1.0) if m[2] == "r.p.m" else self.units[m[2]]
            measures.append((dimension, round(float(m[1].replace(",", ".")) * factor, 6)))
        t = self.measure_pattern.sub(" ", t)
        m = _SERIES.search(t)
        series = m[1] if m else None
        words = _LABELS.sub(" ", _SERIES.sub(" ", t)).split()
        colour = next((self.colours[w] for w in words if w in self.colours), None)
        rest = [w for w in words if w not in self.colours]
        return {"ref": ref, "type": kind, "series": series, "colour": colour, "measures": tuple(sorted(set(measures))), "rest": tuple(sorted(rest))}


DEFAULT = Vocabulary()
parse = DEFAULT.parse


_PART = "\x1f"


def signature(listing: dict) -> str | None:
    """type, brand and other words, series, then the attributes; null if the listing says nothing."""
    head = [listing["type"] or "", " ".join(listing["rest"]), listing["series"] or ""]
    attributes = [f"{d}={v:g}" for d, v in listing["measures"]]
    if listing["colour"]:
        attributes.append(f"colour={listing['colour']}")
    return _PART.join(head + attributes) if any(head) or attributes else None


_WORD = re.compile(r"[^\W_]+")


def read_listings(df: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(listing_id, ref, sig, measures, words, key): the key tells nodes apart and is null for a listing that says nothing."""
    ship(df.sparkSession)
    slim = df.select("listing_id", "Codigo", "Descripcion")
    text = lambda name: T.StructField(name, T.StringType())
    schema = T.StructType([slim.schema["listing_id"], text("ref"), text("sig"), text("measures"), T.StructField("words", T.ArrayType(T.StringType())), text("key")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, sigs, measures, words, keys = [], [], [], [], []
            for code, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = vocabulary.parse(code, said)
                sig = signature(x)
                refs.append(x["ref"])
                sigs.append(sig)
                measures.append(_PART.join([*(f"{d}={v:g}" for d, v in x["measures"]), x["series"] or ""]))
                words.append(sorted({f"type={x['type']}", f"colour={x['colour']}", *x["rest"]} - {"type=None", "colour=None"}))
                wording = " ".join(sorted(set(_WORD.findall(fold(said or "")))))
                keys.append(None if x["ref"] is None and sig is None else "\x1e".join([x["ref"] or "", sig or "", wording]))
            arrays = [batch.column(0), *(pa.array(v, pa.string()) for v in (refs, sigs, measures)), pa.array(words, pa.list_(pa.string())), pa.array(keys, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return slim.mapInArrow(read, schema)


#: Nodes of a block up to which every two of them are an edge.
BLOCK_PAIRS = 64


def token_blocks(nodes: DataFrame) -> DataFrame:
    """(block, me): a node lies in one block for each of its words, together with its measures and series."""
    words = F.when(F.size("words") > 0, F.col("words")).otherwise(F.array(F.lit("")))
    said = nodes.where(F.col("sig").isNotNull()).select(F.struct("node", "sig", "ref", "refs").alias("me"), "measures", F.explode(words).alias("word"))
    return said.select(F.concat_ws("\x1d", "measures", "word").alias("block"), "me")


def weighted_graph(nodes: DataFrame, n_rows: int) -> DataFrame:
    """(a, b, weight) of every two nodes (structs) that meet in blocks, by the rarity of those."""
    blocks = durable(token_blocks(nodes))
    sizes = durable(blocks.groupBy("block").agg(F.count("*").alias("nodes")).where(F.col("nodes") > 1))
    sized = join_by_key(blocks, sizes, "block", "nodes", n_rows)
    rarity = F.log1p(F.lit(float(max(n_rows, 1))) / F.col("nodes"))
    few = sized.where(F.col("nodes") <= BLOCK_PAIRS).groupBy("block", "nodes").agg(F.sort_array(F.collect_list("me")).alias("all"))
    each = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = few.select(F.explode(each).alias("e"), rarity.alias("rarity")).select("e.a", "e.b", "rarity")
    many = sized.where(F.col("nodes") > BLOCK_PAIRS).withColumn("same", F.concat_ws("\x1c", "block", "me.sig"))
    firsts = many.groupBy("same").agg(F.min("me").alias("first"), F.count("*").alias("members"))
    stars = join_by_key(many, firsts, "same", "members", n_rows).where(F.col("me.node") != F.col("first.node"))
    met = pairs.unionByName(stars.select(F.col("first").alias("a"), F.col("me").alias("b"), rarity.alias("rarity")))
    return met.groupBy("a", "b").agg(F.sum("rarity").alias("weight"))


def pruned(graph: DataFrame) -> DataFrame:
    """The edges that weigh at least the mean of one of their ends."""
    ends = graph.select(F.explode(F.array("a.node", "b.node")).alias("end"), "weight").groupBy("end").agg(F.avg("weight").alias("mean"))
    bar = lambda side: ends.select(F.col("end").alias(f"end_{side}"), F.col("mean").alias(f"mean_{side}"))
    far = graph.join(bar("a"), F.col("a.node") == F.col("end_a")).join(bar("b"), F.col("b.node") == F.col("end_b"))
    # Sums of equal terms in another order may differ in the last digits.
    return far.where(F.col("weight") >= F.least("mean_a", "mean_b") * (1 - 1e-9)).select("a", "b", "weight")


def _of_references(nodes: DataFrame, n_rows: int) -> DataFrame:
    """(a, b) within references: nodes with the first of their head, heads with agreeing ones."""
    parts = F.split(F.coalesce("sig", F.lit("")), _PART)
    known = [F.coalesce(F.get(parts, i), F.lit("")) for i in range(3)]
    with_head = nodes.where(F.col("ref").isNotNull()).select("node", F.concat_ws(_PART, "ref", *known).alias("head"))
    heads = durable(with_head.groupBy("head").agg(F.min("node").alias("first"), F.count("*").alias("nodes")))
    to_first = join_by_key(with_head, heads, "head", "nodes", n_rows).where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    said = F.split("head", _PART)
    values = [F.get(said, i + 1) for i in range(3)]
    mask = sum((F.when(v != "", 1 << i).otherwise(0) for i, v in enumerate(values)), F.lit(0))

    def with_kind(other: int) -> Column:
        """The block of this head and heads that know ``other``: by what both know, those of the one kind agree with all of the other."""
        both = (F.when(mask.bitwiseAND(F.lit(other & 1 << i)) != 0, v).otherwise("") for i, v in enumerate(values))
        return F.concat_ws(_PART, F.get(said, 0), F.least(mask, F.lit(other)).cast("string"), F.greatest(mask, F.lit(other)).cast("string"), *both)

    blocks = heads.select(F.col("first").alias("node"), mask.alias("side"), F.explode(F.array(*(F.struct(with_kind(o).alias("block"), (mask != o).alias("two")) for o in range(8)))).alias("t"))
    blocks = durable(blocks.select("node", "side", "t.*"))
    hubs = blocks.groupBy("block").agg(F.min("node").alias("hub"), F.count("*").alias("heads"), (~F.any_value("two") | (F.min("side") < F.max("side"))).alias("linked"))
    met = join_by_key(blocks, hubs.where((F.col("heads") > 1) & F.col("linked")).drop("linked"), "block", "heads", n_rows * 8)
    return to_first.unionByName(met.where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())


def _edges(nodes: DataFrame, n_rows: int) -> DataFrame:
    """(a, b) of verified edges between nodes."""
    refs = nodes.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.count_distinct("ref").alias("refs"), F.count("*").alias("nodes"))
    counted = join_by_key(nodes.select("node", "sig", "ref", "measures", "words"), refs, "sig", "nodes", n_rows)
    survivors = pruned(durable(weighted_graph(counted, n_rows)))
    one_reference = F.col("a.ref").eqNullSafe(F.col("b.ref"))
    open_reference = (F.col("a.ref").isNull() | F.col("b.ref").isNull()) & (F.col("a.refs") == 1)
    verified = survivors.where((F.col("a.sig") == F.col("b.sig")) & (one_reference | open_reference))
    return verified.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).unionByName(_of_references(nodes, n_rows))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, product): the least node that can be reached. Stars of stars: a few rounds, each one written."""
    both = durable(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = durable(both.select(F.col("a").alias("node")).distinct().withColumn("product", F.col("node")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("product").alias("least"))
        joined = labels.join(heard, labels["node"] == heard["a"], "left")
        after = joined.select("node", F.least("product", F.coalesce("least", "product")).alias("product"), (F.col("least") < F.col("product")).alias("moved"))
        after = durable(after)
        labels = after.select("node", "product")
        if after.where("moved").isEmpty():
            break
    return nodes.join(labels, "node", "left").select("key", "listings", F.coalesce("product", "node").alias("product"))


def products(df: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(listing_id, product_id) of every listing; a product is named by its least listing in its least node."""
    read = durable(read_listings(df, vocabulary))
    there = read.where(F.col("key").isNotNull())
    nodes = durable(there.groupBy("key", "ref", "sig").agg(F.min("listing_id").alias("node"), F.count("*").alias("listings"), F.first("measures").alias("measures"), F.first("words").alias("words")))
    n_rows = read.count()
    of_key = durable(_components(nodes.select("key", "listings", "node"), _edges(nodes, n_rows)))
    members = join_by_key(there.select("listing_id", "key"), of_key, "key", "listings", n_rows).select("listing_id", F.col("product").alias("product_id"))
    return members.unionByName(read.where(F.col("key").isNull()).select("listing_id", F.col("listing_id").alias("product_id")))


#: Listings of one product that one task pairs with all others of it.
PAIR_PART = 2_000


def same_product_pairs(df: DataFrame) -> DataFrame:
    """(listing_a, listing_b) of every two listings of one product. A large product's pairs are made in parts."""
    members = durable(products(df).distinct())
    sizes = members.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sized = join_by_key(members, sizes, "product_id", "n", members.count())
    parts = F.ceil(F.col("n") / F.lit(float(PAIR_PART))).cast("int")
    a = sized.select(F.col("listing_id").alias("listing_a"), "product_id", F.pmod(F.hash("listing_id"), parts).alias("part"))
    b = sized.select(F.col("listing_id").alias("listing_b"), "product_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return a.join(b, ["product_id", "part"]).where(F.col("listing_a") < F.col("listing_b")).select("listing_a", "listing_b")
