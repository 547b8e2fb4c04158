import datetime
import json

import numpy as np
from notelith.sources import pages, recognition, sinks
from notelith.streaming import pages as streams
from pyspark.sql import functions as F


def test_page_sources(spark, tmp_path):
    (tmp_path / "dumps" / "un pdf").mkdir(parents=True)
    (tmp_path / "dumps" / "un pdf" / "p02_lines.txt").write_text("uno\ndos")
    (tmp_path / "dumps" / "un pdf" / "otro.txt").write_text("x")
    assert [tuple(r) for r in pages.read_page_dumps(spark, str(tmp_path / "dumps")).collect()] == [("un pdf", 2, "uno\ndos")]
    (tmp_path / "t.txt").write_text("a\fb")
    assert [(r.page, r.text) for r in pages.read_text_pages(spark, str(tmp_path / "t.txt")).collect()] == [(1, "a"), (2, "b")]
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "a.PDF").write_bytes(b"x")
    (tmp_path / "pdfs" / "b.txt").write_bytes(b"x")
    assert [r.path[-5:] for r in pages.document_set(spark, str(tmp_path / "pdfs")).collect()] == ["a.PDF"]
    (tmp_path / "l.csv").write_text("a,b\n1,x\nbad,y\n")
    assert [tuple(r) for r in pages.read_lines_csv(spark, str(tmp_path / "l.csv"), "a int, b string").collect()] == [(1, "x"), (None, "y")]


def pdf_of(pages_of_lines, packed):
    """A small file: each page's lines as (x, y, text), with a font in WinAnsi encoding and one with a map to Unicode."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [278 500] >>"}
    cmap = b"1 beginbfchar <0041> <00D1> endbfchar 1 beginbfrange <0100> <0102> <0061> endbfrange"
    objects[4] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"
    objects[5] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    kids = []
    for i, lines in enumerate(pages_of_lines):
        ops = b"BT /F1 10 Tf " + b" ".join(b"1 0 0 1 %d %d Tm %s" % (x, y, t) for x, y, t in lines) + b" ET"
        data, how = (zlib.compress(ops), b"/Filter /FlateDecode") if packed else (ops, b"")
        objects[20 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (21 + 2 * i)
        objects[21 + 2 * i] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), how, data)
        kids.append(b"%d 0 R" % (20 + 2 * i))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (b" ".join(kids), len(kids))
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in sorted(objects.items())) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages_words_and_regions(spark, tmp_path):
    one = [(50, 800, rb"(Albar\341n \(copia\)) Tj"), (300, 800, b"[(12) -20 (345)] TJ"), (50, 780, b"(Codigo  Importe) Tj 0 -12 Td (segunda) Tj"), (50, 700, b"/F2 10 Tf <0041010001010102> Tj")]
    for name, packed in (("a.pdf", True), ("b.pdf", False)):
        (tmp_path / name).write_bytes(pdf_of([one, [(10, 10, b"(fin) Tj")]], packed))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 nonsense")
    (tmp_path / "d.pdf").write_bytes(b"no pdf")
    found = pages.read_pdf_pages(spark, str(tmp_path), words=True)
    rows = {(r.pdf, r.page): r for r in found.collect()}
    for name in ("a.pdf", "b.pdf"):
        page = rows[name, 1]
        assert page.text == "Albarán (copia) 12345\nCodigo Importe\nsegunda\nÑabc" and rows[name, 2].text == "fin"
        assert (page.width, page.height) == (595, 842) and [w.text for w in page.words if w.x0 > 200] == ["12345"]
        word = page.words[0]
        assert word.text == "Albarán" and abs(word.bottom - 42) < 0.01 and word.x1 > word.x0 == 50
    counts = {r.path[-5:]: r.pages for r in pages.page_counts(found).collect()}
    assert counts["a.pdf"] == counts["b.pdf"] == 2 and counts["c.pdf"] == counts["d.pdf"] == 0


def test_programs_that_recognise(tmp_path):
    """Stand-ins for the programs: what they are called with, a second try without cleaning, failures."""
    ocr = tmp_path / "ocr"
    ocr.write_text('#!/bin/sh\necho "$*"; cat\n')
    picky = tmp_path / "picky"
    picky.write_text('#!/bin/sh\nfor a in "$@"; do [ "$a" = --clean ] && exit 3; done\necho "layer $*"; cat\n')
    broken = tmp_path / "broken"
    broken.write_text("#!/bin/sh\nexit 1\n")
    for x in (ocr, picky, broken):
        x.chmod(0o755)
    assert recognition.command_engine(str(ocr), "--psm", "11")(b"text") == "stdin stdout --psm 11\ntext"
    assert recognition.searchable_pdf(str(picky), "--clean", "-l", "spa")(b"pdf") == b"layer -l spa - -\npdf"
    assert recognition.command_engine(str(broken))(b"x") == "" and recognition.searchable_pdf(str(broken), "--clean")(b"x") == b"x"
    both = recognition.union_engine(recognition.command_engine(str(ocr)), recognition.command_engine(str(broken)), lambda b: "text\nmore")
    assert both(b"text") == "stdin stdout\ntext\nmore"


def test_settings(tmp_path):
    assert pages.load_settings(str(tmp_path)) == {} or isinstance(pages.load_settings(str(tmp_path)), dict)
    pages.save_settings({"a": "ñ"}, str(tmp_path))
    assert pages.load_settings(str(tmp_path)) == {"a": "ñ"}
    (tmp_path / "settings.json").write_text("{")
    assert pages.load_settings(str(tmp_path)) == {}


def test_images():
    grey = np.full((60, 200), 200, np.uint8)
    grey[28:32, 20:180] = 40
    assert 40 <= recognition.otsu(grey) < 200 and set(np.unique(recognition.binarise(grey))) == {0, 255}
    tilted = np.full((120, 200), 255, np.uint8)
    for x in range(20, 180):
        tilted[60 + int((x - 100) * 0.1) :][:3, x] = 0
    assert abs(recognition.skew_angle(tilted)) > 4 and abs(recognition.skew_angle(recognition.deskew(tilted))) < 1.5
    assert recognition.prepare(np.full((4, 4), 7, np.uint8)).shape == (4, 4) and recognition.otsu(np.zeros((0, 0), np.uint8)) == 0


def test_recognition_and_cache(spark):
    images = spark.createDataFrame([("a", 1, bytearray(b"x")), ("a", 2, None)], "path string, page int, image binary")
    assert [(r.page, r.text) for r in recognition.recognise(images, lambda b: b.decode() * 2, 3).orderBy("page").collect()] == [(1, "xx"), (2, "")]
    assert recognition.command_engine("no-such-program")(b"x") == "" and recognition.searchable_pdf("no-such-program", "--clean")(b"x") == b"x"
    assert recognition.union_engine(lambda b: "a\n b ", lambda b: "b\nc")(b"") == "a\nb\nc"
    broken = spark.createDataFrame([("a", 1, bytearray(b"x"))], "path string, page int, content binary")
    assert [tuple(r) for r in recognition.regions(broken, 0, 0, 1, 1).collect()] == [("a", 1, None)]
    t = datetime.datetime(2024, 1, 1)
    want = spark.createDataFrame([("a", 1, 11, t), ("b", 1, 11, t)], "path string, page int, psm int, modified timestamp")
    cache = spark.createDataFrame([("a", 1, 11, t, "new"), ("b", 1, 11, t - datetime.timedelta(1), "old"), ("a", 1, 12, t, "other")], "path string, page int, psm int, cached_at timestamp, text string")
    hits, misses = recognition.cached(want, cache, ["psm"])
    assert [(r.path, r.text) for r in hits.collect()] == [("a", "new")] and [r.path for r in misses.collect()] == ["b"]
    rows = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "i int, f string")
    found = recognition.only_missing(rows, "f", ["i"], lambda df: df.where("i = 3").select("i", F.lit("read").alias("value")))
    assert {r.i: r.f for r in found.collect()} == {1: "", 2: "x", 3: "read"}


def test_sinks(spark, sf, tmp_path):
    lines, meta = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("detail_lines", "note_meta"))
    sinks.write_run(lines, meta, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/Lineas")).count() == lines.count() and (tmp_path / "run/Resumen_Proveedor").exists()
    first, second = (sinks.write_new(meta, str(tmp_path / "m")) for _ in range(2))
    assert first != second and spark.read.parquet(second).count() == meta.count()
    errors = spark.createDataFrame([("p", "-", "WARN", "algo")], "pdf string, page string, severity string, msg string")
    sinks.write_errors(errors, lines, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e/errores_txt")).first().value == "p p.- [WARN] algo"
    assert not sinks.write_skipped(errors.where("false"), str(tmp_path / "s")) and sinks.write_skipped(errors, str(tmp_path / "s"))
    sinks.write_trace(spark.createDataFrame([(1, "x", "y")], "z int, Pagina string, Pdf string"), str(tmp_path / "t"))
    assert sinks.ordered_trace(spark.createDataFrame([(1, "x", "y")], "z int, Pagina string, Pdf string")).columns == ["Pdf", "Pagina", "z"]
    assert not sinks.write_debug(errors.withColumnRenamed("pdf", "Pdf"), str(tmp_path / "d"), 0) and sinks.write_debug(errors.withColumnRenamed("pdf", "Pdf"), str(tmp_path / "d"), 2)
    sinks.write_summary(spark, {"pages": 3}, str(tmp_path / "x"))
    assert json.loads(spark.read.text(str(tmp_path / "x/resumen")).first().value) == {"pages": 3}


def test_reports_in_order_and_checks(spark, tmp_path):
    import glob

    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id").repartition(5)
    sinks.write(df, str(tmp_path / "o"), "csv", ["k"])
    keys = [int(line.split(",")[0]) for f in sorted(glob.glob(str(tmp_path / "o/*.csv"))) for line in open(f).read().split()[1:]]
    assert keys == list(range(1000))
    checks = spark.createDataFrame([("b", True, None), ("a", False, "off by one")], "name string, passed boolean, message string")
    assert sinks.write_checks(checks, str(tmp_path / "c"), "r1") == {"checks": 2, "passed": 1}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c/r1/txt")).collect()) == ["FAIL a off by one", "PASS b"]
    assert json.loads(spark.read.text(str(tmp_path / "c/latest")).first().value)["run"] == "r1"


def test_late_pages_are_left_out(spark, tmp_path):
    t = datetime.datetime(2024, 3, 1)
    schema = "ts timestamp, k string"
    for i, days in enumerate(([40, 41], [0, 42])):
        spark.createDataFrame([(t + datetime.timedelta(d), "a") for d in days], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    assert streams.session_counts(stream, "ts", ["k"], "1 day", "2 days").isStreaming and streams.sliding_counts(stream, "ts", "2 days", "1 day", "2 days").isStreaming
    found = streams.run_available(streams.windowed_counts(stream, "ts", ["k"], "1 day", "2 days"), str(tmp_path / "out"))
    assert sum(r.pages for r in found.collect()) <= 4
