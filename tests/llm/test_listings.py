import random

from notelith.llm import listings as ls

SCHEMA = "listing_id long, Proveedor string, Codigo string, Descripcion string, node int, ref string, key string, product_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, "S", c, d, 1, "r", "k", 2) for i, c, d in rows], SCHEMA)


def pairs(spark, rows):
    return {tuple(r) for r in ls.same_product_pairs(frame(spark, rows)).collect()}


def test_parse():
    a = ls.parse("ABC000137", "Electrodo de soldadura - Ø 2,5mm - long. 450 mm - F2H - Bulkano - 0,5 kg")
    b = ls.parse("BLK-0000033-1", "WELDING ELECTRODE L=45CM 500 G MARCA BULKANO SERIE F2H DIÁMETRO 0.25 CM ¡GRAN CALIDAD!")
    assert a["ref"] is None and b["ref"] == "BLK00000331" and ls.signature(a) == ls.signature(b)
    assert ls.parse("X 1", "cod. wlm 0000186 2 batería")["ref"] == "WLM00001862"
    assert ls.signature(ls.parse(None, None)) is None and ls.signature(ls.parse("100003", " ")) is None


ROWS = [
    (1, "AA000001", "Ball valve | 25 bar | C2H | Nautrek | color gris | 15 mm"),
    (2, None, "LLAVE DE ESFERA GRIS 1,5 CM MOD. C2H NAUTREK 25BAR OFERTA"),
    (3, "100003", "Ball valve | 16 bar | C2H | Nautrek | gris | 15 mm"),
    (4, "100003", "Bombilla LED 5 W 3000 K 4 uds A2H Yermak"),
    (5, "YRM-0000001-2", "Bombilla LED 5 W 4 uds A2H Yermak"),
    (6, "x", "lámpara led A2H pack 4 3000 kelvin (YRM 0000001 2) Yermak 5 vatios"),
    (7, "YRM.0000009.2", "Bombilla LED 5 W 4 uds A2H Yermak"),
    (8, None, None), (9, None, " "), (10, None, ""), (11, "YRM00000092", None),
    (12, None, "cosa rara"), (13, None, "Rara COSA"),
]


def test_products(spark):
    # 4 says what 6 says and no other reference does: one product; 5 and 7 leave something out and differ in reference.
    assert pairs(spark, ROWS) == {(1, 2), (4, 5), (4, 6), (5, 6), (7, 11), (12, 13)}
    found = {r.listing_id: r.product_id for r in ls.products(frame(spark, ROWS)).collect()}
    assert len(found) == len(ROWS) and found[8] == 8 and found[6] == found[4]


def test_two_references_with_one_signature_stay_apart(spark):
    same = "Bombilla LED 5 W 3000 K 4 uds A2H Yermak"
    assert pairs(spark, [(1, "YRM-0000001-2", same), (2, "YRM-0000002-2", same), (3, None, same), (4, None, same)]) == {(3, 4)}


def test_repeats_empty_and_long(spark):
    assert pairs(spark, [(1, None, "cinta aislante A"), (1, None, "cinta aislante A"), (2, None, "CINTA AISLANTE a")]) == {(1, 2)}
    assert ls.products(frame(spark, ROWS).where("false")).collect() == []
    long = "palabra " * 50_000
    assert pairs(spark, [(1, None, long), (2, None, long.upper()), (3, None, long + "x")]) == {(1, 2)}


def test_hot_product(spark, monkeypatch):
    from notelith.operators import skew

    monkeypatch.setattr(skew.join_by_key, "__defaults__", (20,))
    monkeypatch.setattr(ls, "PAIR_PART", 7)
    rows = [(i, None, "Ball valve 25 bar C2H Nautrek gris 15 mm") for i in range(1, 61)] + ROWS[3:7]
    rows = rows[:60] + [(100 + i, c, d) for i, c, d in rows[60:]]
    found = pairs(spark, rows)
    assert len([p for p in found if p[1] <= 60]) == 60 * 59 // 2


def test_random_against_the_rule(spark):
    r = random.Random(5)
    rows = []
    for i in range(1, 300):
        parts = [r.choice(["Ball valve", "llave de esfera"]), r.choice(["Nautrek", "Yermak"]), r.choice(["a2h", "B2H"]), r.choice(["15 mm", "1,5 cm", "2 cm"]), r.choice(["16 bar", "25bar"]), r.choice(["gris", "grey", "rojo"])]
        r.shuffle(parts)
        rows.append((i, None, " | ".join(parts)))
    keys = {i: ls.signature(ls.parse(c, d)) for i, c, d in rows}
    assert pairs(spark, rows) == {(a, b) for a in keys for b in keys if a < b and keys[a] == keys[b]}


def test_first_listing_of_a_reference_with_a_word_of_its_own(spark):
    same = "BLK-0000033-1"
    rows = [(1, same, "Ball valve C2H Nautrek maravilla 15 mm"), (2, same, "Ball valve C2H Nautrek 15 mm"), (3, same, "Ball valve C2H Nautrek 2 cm"), (4, same, "C2H Nautrek 4 cm")]
    assert pairs(spark, rows) == {(2, 3), (2, 4), (3, 4)}


def test_references_against_all_pairs(spark):
    """Products of listings with references are the components of all agreeing pairs."""
    r = random.Random(8)
    words = lambda *some: r.choice(["", *some])
    rows = []
    for i in range(1, 200):
        text = f"{words('Ball valve', 'Bombilla LED')} {words('Nautrek', 'Yermak', 'Nautrek nuevisimo')} {words('a2h', 'b2h')} {r.choice(['', '15 mm', '16 bar', '2 cm', '25 bar'])}"
        rows.append((i, f"YRM-00000{r.randrange(10, 50)}-2", text))
    read = {i: ls.parse(c, d) for i, c, d in rows}
    head = lambda x: (x["type"] or "", x["rest"], x["series"] or "")
    agree = lambda a, b: a["ref"] == b["ref"] and all(x == y or not x or not y for x, y in zip(head(a), head(b), strict=True))
    least = {i: i for i in read}
    while True:
        after = {i: min(least[j] for j in read if agree(read[i], read[j])) for i in read}
        after = {i: least[after[i]] for i in read}
        if after == least:
            break
        least = after
    assert pairs(spark, rows) == {(a, b) for a in read for b in read if a < b and least[a] == least[b]}


def test_no_link_of_a_reference_is_lost(spark):
    same = "BLK-0000033-1"
    rows = [(1, same, "flexible cable"), (2, same, "Tubo corrugado 5 m"), (3, same, "tubo corrugado rojo")]
    assert pairs(spark, rows) == {(2, 3)}


def counted_nodes(spark, df):
    from notelith.operators.skew import join_by_key
    from pyspark.sql import functions as F

    read = ls.read_listings(df).where("key is not null")
    nodes = read.groupBy("key", "ref", "sig").agg(F.min("listing_id").alias("node"), F.first("measures").alias("measures"), F.first("words").alias("words"))
    refs = nodes.where("sig is not null").groupBy("sig").agg(F.count_distinct("ref").alias("refs"), F.count("*").alias("nodes"))
    return join_by_key(nodes.select("node", "sig", "ref", "measures", "words"), refs, "sig", "nodes", read.count()), read.count()


def test_recall_of_blocks_and_pruning(spark, monkeypatch):
    """Against all pairs of equal tokens: every one is an edge, and stays connected when the graph is pruned to a part."""
    from notelith.runtime import table

    df = table(spark, "/root/testdata/sf0.01", "catalog_listings")
    products = []
    for size in (64, 3):
        monkeypatch.setattr(ls, "BLOCK_PAIRS", size)
        nodes, n = counted_nodes(spark, df)
        graph = ls.weighted_graph(nodes, n)
        all_edges = {(r.a.node, r.b.node): r.a.sig == r.b.sig for r in graph.collect()}
        kept = {(r.a.node, r.b.node) for r in ls.pruned(graph).collect()}
        sigs = {r.node: r.sig for r in nodes.collect()}
        want = {(a, b) for a in sigs for b in sigs if a < b and sigs[a] == sigs[b] is not None}
        if size == 64:
            assert {e for e, same in all_edges.items() if same} == want and len(want) > 50
        assert want and len([e for e in want if e in kept]) >= (0.99 if size == 64 else 0.3) * len(want) and len(kept) < len(all_edges)
        products.append({tuple(r) for r in ls.same_product_pairs(df).collect()})
    assert products[0] == products[1] and len(products[0]) >= len(want) > 0


def test_the_graph_gives_the_products(spark, monkeypatch):
    rows = ROWS[:7]
    before = pairs(spark, rows)
    blocks = ls.token_blocks
    monkeypatch.setattr(ls, "token_blocks", lambda nodes: blocks(nodes).where("false"))
    assert pairs(spark, rows) == {p for p in before if p == (5, 6)} != before  # a reference has blocks of its own


def test_without_a_vocabulary(spark):
    empty = ls.Vocabulary({}, {}, [], {})
    rows = [(1, None, "Zapato rojo"), (2, None, "ROJO, zapato"), (3, None, "red shoe")]
    found = {r.listing_id: r.product_id for r in ls.products(frame(spark, rows), empty).collect()}
    assert found[1] == found[2] != found[3]
