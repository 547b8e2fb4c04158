from notelith.operators import detection, evaluation, extraction, headers, pages, rows, stateful, totals
from notelith.operators.skew import join_by_key
from notelith.plans.layouts import LAYOUTS
from pyspark.sql import functions as F


def test_global_index(spark):
    df = spark.range(0, 1000, 1, 7).select((1000 - F.col("id")).alias("x"), F.lit("a").alias("idx2"))
    found = rows.global_index(df, ["x"]).collect()
    assert sorted((r.x, r.idx) for r in found) == [(i, i) for i in range(1, 1001)]
    assert rows.global_index(df.where("false"), ["x"]).collect() == []


def test_stamp_and_canonical(spark):
    items = spark.createDataFrame([("p", 1, None, "c"), ("p", 2, "9", None)], "Pdf string, Pagina int, AlbaranNumero string, Codigo string")
    meta = spark.createDataFrame([("p", 1, ""), ("p", 1, "7"), ("p", 2, "8")], "Pdf string, Pagina int, AlbaranNumero string")
    assert sorted(r.AlbaranNumero for r in rows.stamp(items, meta, ["Pdf", "Pagina"], ["AlbaranNumero"]).collect()) == ["7", "9"]
    c = rows.canonical(items).collect()[0]
    assert c.FechaAlbaran == "" and c.Importe is None and len(c) == len(rows.DETAIL_TEXT) + len(rows.DETAIL_NUMBERS) + 1


def test_stage_merge(spark):
    data = [("p", "base+ocr", 1, "", "A1", None), ("p", "base+ocr", 2, "N2", None, "w"), ("p", "base", 1, "N1", "B1", ""), ("p", "base", 2, None, "B2", None)]
    df = spark.createDataFrame(data, "Pdf string, OcrStage string, o int, AlbaranNumero string, Codigo string, ParseWarn string")
    found = sorted((r.AlbaranNumero, r.Codigo, r.ParseWarn) for r in rows.merge_stages(df, ["Pdf"], ["o"], "OcrStage", ["AlbaranNumero"]).collect())
    assert found == [("N1", "A1", ""), ("N2", "B2", "w")]


def test_embedded_and_placeholder(spark):
    df = spark.createDataFrame([(1, "A [x 5]"), (2, "B")], "i int, t string")
    assert sorted((r.i, r.embedded, r.n or "") for r in rows.explode_embedded(df, "t", r"\[(x) ([0-9]+)\]", ["x", "n"]).collect()) == [(1, False, ""), (1, True, "5"), (2, False, "")]
    lines = spark.createDataFrame([(1, "Ñandú S.A.", None, 1.0, 2.0, ""), (2, "X", "c", 1.0, 2.0, None), (3, "X", "", None, 2.0, "w")], "i int, Proveedor string, Codigo string, CantidadServida double, Importe double, ParseWarn string")
    assert {r.i: (r.Codigo, r.ParseWarn) for r in rows.placeholder_codes(lines, ["i"]).collect()} == {1: ("UNK_NANDUSA_0001", "missing_code_placeholder"), 2: ("c", None), 3: ("", "w")}


def test_skewed_join(spark):
    left = spark.range(500).select((F.col("id") % 5).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    assert join_by_key(left, groups, "k", "n", 500, hot_rows=50).count() == 500 and join_by_key(left, groups, "k", "n", 500).count() == 500


def test_header_repair(spark):
    good, order = "99900011", "25.001/01"
    data = [(i, "S", good, order, None) for i in range(4)] + [(10, "S", "12", order, None), (11, "S", good, None, None), (12, "S", "94312345678", order, None), (13, None, None, None, None)]
    df = spark.createDataFrame(data, "i int, Proveedor string, AlbaranNumero string, SuPedidoCodigo string, ParseWarn string")
    found = {r.i: (r.AlbaranNumero, r.SuPedidoCodigo) for r in headers.repair(df, "i").collect()}
    assert found[10][0] == good and found[11] == (good, "2500101") and found[13] == (None, None) and len(found) == len(data)


def test_totals_keep_null_groups(spark):
    df = spark.createDataFrame([("s", None, "d", "o", 1.1, None, 3.0, 1), ("s", None, "d", "o", 2.2, 3.0, float("nan"), 2)], "Proveedor string, AlbaranNumero string, FechaAlbaran string, SuPedidoCodigo string, SumaImportesLineas double, NetoComercialPie double, TotalAlbaranPie double, p int")
    r = totals.note_totals(df, ["p"]).collect()
    assert len(r) == 1 and (r[0].SumaImportesLineas, r[0].NetoComercialPie, r[0].TotalAlbaranPie, r[0].Dif_Suma_vs_Neto) == (3.3, 3.0, 3.0, 0.3)


def test_detection(spark):
    docs = spark.createDataFrame([(1, "ACME S.L. albarán"), (2, "Beta y otra vez BETA"), (3, "nada"), (4, None), (5, "ACMETAL beta")], "d int, text string")
    aliases = detection.alias_table([spark.createDataFrame([("Acme", "acme"), ("Acme", "ACME  s.l."), ("Beta", "béta")], "supplier string, alias string")])
    hits = detection.alias_hits(docs, ["d"], "text", aliases)
    lines = pages.explode_lines(docs, ["d"], "text")
    scored = detection.scores(hits, detection.window_hits(lines, ["d"], [("Acme", "ALBARAN", 1)]), ["d"])
    assert {(r.d, r.supplier, r.hits, r.score) for r in scored.collect()} == {(1, "Acme", 1, 7), (2, "Beta", 1, 6), (5, "Beta", 1, 6)}
    assert {r.d: r.detected for r in detection.best(docs, scored, ["d"]).collect()} == {1: "Acme", 2: "Beta", 3: "DESCONOCIDO", 4: "DESCONOCIDO", 5: "Beta"}
    assert detection.alias_hits(docs, ["d"], "text", aliases.where("false")).collect() == []


def test_extraction(spark):
    data = [
        ("a", 1, "ESMERALDA", "Algo\nAB123 Tubo de cobre 2 10,50 21,00\n con refuerzo\nXY999 Codo 4 1.000,00 5,00 3.800,00\nTOTAL 3.821,00"),
        ("b", 1, "ELEKTRA", "4455 antes 1 2 3\nARTICULO CONCEPTO CANTIDAD PRECIO IMPORTE\n4455 Cable 10 100 25,00 2,50\nTOTAL 2,50"),
        ("c", 2, "SALTOKI", "ALBARAN Nº 12345678 FECHA 03/02/2025 PEDIDO 25.001/01\nAA111;Llave;3;2,00;6,00\nSUMA Y SIGUE"),
        ("d", 1, "JUPER", None),
        ("e", 1, "JUPER", "JP100/2 Grapa 5 3\nJP101 Brida 1 4"),
        ("f", 1, "GABYL", "CODIGO DESCRIPCION CANTIDAD\nGB12 Tubo 4 10,00 100 5,00 0,38"),
    ]
    docs = spark.createDataFrame(data, "pdf string, page int, supplier string, text string")
    layouts = extraction.layout_table(spark, LAYOUTS)
    found = {(r.pdf, r.item): (r.code, r.description, r.quantity, r.price, r.discount, r.amount) for r in extraction.extract_rows(docs, layouts, ["pdf", "page"]).collect()}
    assert found == {
        ("a", 1): ("AB123", "Tubo de cobre con refuerzo", 2, 10.5, None, 21), ("a", 2): ("XY999", "Codo", 4, 1000, 5, 3800),
        ("b", 1): ("4455", "Cable", 10, 100, 25, 2.5), ("c", 1): ("AA111", "Llave", 3, 2, None, 6),
        ("e", 1): ("JP100/2", "Grapa", 2, None, None, None), ("e", 2): ("JP101", "Brida", 0, None, None, None), ("f", 1): ("GB12", "Tubo", 4, 10, 5, 0.38),
    }
    head = {r.pdf: r for r in extraction.extract_pages(docs, layouts, ["pdf", "page"]).collect()}
    assert head["c"].note == "12345678" and head["c"].order_code == "25.001/01" and head["c"].date == "03/02/2025" and head["d"].note is None
    generic = {r.pdf: r for r in extraction.generic_page(docs, ["pdf"]).collect()}
    assert generic["a"].amount == 3821 and generic["d"].amount is None
    assert len({x.supplier for x in LAYOUTS}) == 43


def test_page_states(spark):
    schema = "Pdf string, Pagina int, note string, items int, sheet int, sheets int, footer boolean"
    data = [("p", 1, "77777", 3, 1, 2, False), ("p", 2, "77777", 0, 2, 2, False), ("q", 1, None, 0, 1, 1, False), ("q", 2, "5", 1, None, None, False), ("q", 3, None, 0, 2, 2, True), ("q", 4, None, 0, None, None, False)]
    found = [tuple(r) for r in stateful.decide_pages(spark.createDataFrame(data, schema), "Pdf", "Pagina").orderBy("Pdf", "Pagina").collect()]
    assert found == [("p", 1, "rows", "77777"), ("p", 2, "skipped", "77777"), ("q", 1, "fallback", None), ("q", 2, "rows", "5"), ("q", 3, "skipped", "5"), ("q", 4, "fallback", "5")]


def test_greedy_match_against_loop(spark):
    import random

    r = random.Random(2)
    make = lambda: [(i, r.choice(["a", "b", "", None]), r.choice("xyz"), i) for i in range(60)]
    a, b = make(), make()
    left, want = list(b), set()
    for tier, key in enumerate([(1, 2), (2,)]):
        used_a, used_b = {x for _, x, _ in want}, {y for _, _, y in want}
        left = [t for t in b if t[0] not in used_b]
        for p in a:
            if p[0] in used_a or any(p[k] in (None, "") for k in key):
                continue
            for t in left:
                if all(p[k] == t[k] for k in key):
                    want.add((tier, p[0], t[0]))
                    left.remove(t)
                    break
    schema = "{} int, k string, l string, o int"
    found = evaluation.greedy_match(spark.createDataFrame(a, schema.format("p")), spark.createDataFrame(b, schema.format("t")), "p", "t", [["k", "l"], ["l"]], "o")
    assert {tuple(x) for x in found.collect()} == want


def test_repaired_footer(spark):
    lines = spark.createDataFrame([("n", 1, 10.0), ("n", 2, 20.0), ("m", 3, 100.0)], "n string, i int, Importe double")
    meta = spark.createDataFrame([("n", 31.0), ("m", 500.0)], "n string, NetoComercialPie double")
    assert {r.i: r.adjusted for r in totals.reconcile_last_line(lines, meta, ["n"], ["i"]).collect()} == {1: 10.0, 2: 21.0, 3: 100.0}


def test_hot_groups_by_ranges(spark):
    """Places and fills are the same by a window and by sorted ranges, with keys over several ranges."""
    import random

    r = random.Random(1)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), i, r.choice([None, None, None, "", "x", "y", "z"]), float(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, o int, v string, n double").repartition(7)
    by = lambda found: sorted(map(tuple, found.collect()), key=str)
    assert by(rows.place_in_group(df, ["k"], ["o"])) == by(rows.place_in_group(df, ["k"], ["o"], hot_rows=100))
    columns = ["k", "o", "v", "n", "weak_location"]
    assert by(rows.fill_forward(df, ["k"], ["o"], ["v"]).select(*columns)) == by(rows.fill_forward(df, ["k"], ["o"], ["v"], hot_rows=100).select(*columns))
    assert rows.fill_forward(df.where("false"), ["k"], ["o"], ["v"]).collect() == []


def test_box_and_guards(spark):
    from notelith.functions import dates, numeric
    from notelith.functions import text as tx

    words = [("b", 50.0, 60.0, 10.0, 20.0), ("a", 10.0, 20.0, 10.2, 20.0), ("c", 10.0, 20.0, 40.0, 50.0), ("out", 500.0, 510.0, 10.0, 20.0)]
    df = spark.createDataFrame([(words, "|. x) Total", "3 de Febrero de 2025", "1 1O,5 2S,50", "111")], "w array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, t string, d string, n string, q string")
    row = df.select(
        tx.text_in_box("w", 0, 0, 100, 100).alias("box"), tx.strip_noise_prefix("t").alias("bare"), tx.contains_all_of("t", [["NADA"], ["TOTAL"]]).alias("guard"),
        dates.parse_date_words("d").alias("d"), numeric.fuzzy_decimals("n").alias("n"), numeric.split_quantities("q", F.lit(3)).alias("q"), numeric.split_quantities("q", F.lit(2)).alias("none"),
    ).first()
    assert (row.box, row.bare, row.guard, row.d, row.q, row.none) == ("a b c", "Total", True, "03/02/2025", [1, 1, 1], None)
    assert [(x.place, x.value) for x in row.n] == [(1, 10.5), (2, 25.5)]


def test_head_words_on_several_lines_choose_no_layout(spark):
    """The head of ALKAIN needs ART on its own line: a code elsewhere with these letters leaves the page to the layout without a head."""
    split = "CODIGO;DESCRIPCION;CANT;PRECIO;DTO;IMPORTE\nART 37 78930;Tubo de cobre;2;10,50;0,00;21,00"
    docs = spark.createDataFrame([(1, split), (2, "ART;DESCRIPCION;CANT;PRECIO\nAB123;Codo;4;5,00"), (3, None), (4, "ART\tDESCRIP\tCANT\tPRECIO")], "doc int, text string")
    with_head = [x for x in LAYOUTS if x.kind == "rows" and len(x.head) >= 3]
    chosen = docs.withColumn("supplier", extraction.choose_layout("text", with_head, "ESMERALDA"))
    assert {r.doc: r.supplier for r in chosen.collect()} == {1: "ESMERALDA", 2: "ALKAIN", 3: "ESMERALDA", 4: "ALKAIN"}
    found = {r.doc: (r.code, r.quantity, r.amount) for r in extraction.extract_rows(chosen, extraction.layout_table(spark, LAYOUTS), ["doc"]).collect()}
    assert found == {1: ("ART 37 78930", 2, 21), 2: ("AB123", 4, 5)}


def test_fill_keeps_types_in_hot_parts(spark):
    """A double, a number, a day and a time are filled alike below and above the bound of a hot part."""
    import datetime

    day, time = datetime.date(2024, 5, 6), datetime.datetime(2024, 5, 6, 7, 8, 9, 123)
    data = [("a" if i % 3 else "b", i, None if i % 4 else i / 3, None if i % 5 else i, None if i % 7 else day + datetime.timedelta(i), None if i % 6 else time) for i in range(200)]
    df = spark.createDataFrame(data, "p string, i long, x double, n int, d date, t timestamp_ntz").repartition(5)
    few, hot = ({r.i: tuple(r) for r in rows.fill_forward(df, ["p"], ["i"], ["x", "n", "d", "t"], hot_rows=n).collect()} for n in (1000, 10))
    assert few == hot and few[199][2] is not None
