import numpy as np
from notelith.llm import quality as q

PROSE = "No obstante, el taller indica que el resto del material está bien y que se envía la copia firmada. El importe de los tubos viene sin la referencia porque hay una caja mojada."
LIST = "Pendiente\n- código de barras\n- albarán original\n- packing list\n- guantes talla 9\n- etiqueta de lote\n- casco y chaleco"
TABLE = "CODIGO;DESCRIPCION;CANT;PRECIO\nAB123;Tubo de cobre;4;10,50\nAB124;Codo;14;1,50\nAB125;Placa;7;3,00\nAB126;Racor;5;2,25"
JUNK = "~~~~~~~~ ~~~~\n:::::::::::\n- - - - - - - -\nl l l I I I | | |\n............... 85\n____________________"


def stats_of(text):
    return dict(zip(q.STATS, q.document_stats([text])[0], strict=True))


def test_statistics_tell_kinds_apart():
    prose, entries, table, junk = (stats_of(x) for x in (PROSE, LIST, TABLE, JUNK))
    assert table["separators"] == 3 and prose["separators"] == entries["separators"] == 0
    assert entries["marked_lines"] > 0.8 and prose["marked_lines"] == table["marked_lines"] == 0
    assert prose["common_words"] > 0.4 > entries["common_words"] and prose["stop_lines"] == 1 and entries["stop_lines"] == 0
    assert junk["letters"] < 0.2 and table["digit_ends"] > 0.7
    assert stats_of("de la " * 100)["new_words"] < 0.3 < stats_of(PROSE)["new_words"]


def test_texts_do_not_mix():
    texts = [PROSE, "", LIST, " \n\t", TABLE, JUNK, "x", "\x00"]
    together = q.document_stats(texts)
    alone = np.concatenate([q.document_stats([t]) for t in texts])
    assert np.allclose(together, alone)
    assert not together[1].any() and not together[3].any()


def test_plain_statistics():
    row = dict(zip(q.STATS, q.document_stats(["The cat sat.\nNo. 12 is RED"])[0], strict=True))
    assert row["words"] == 7 and row["stop_lines"] == 0.5 and round(row["common_words"] * 7) == 3
    assert round(row["digit_ratio"], 4) == round(2 / 20, 4) and round(row["mean_word"], 4) == round(20 / 7, 4)


def frames(spark, n=12):
    texts = [PROSE, LIST, TABLE, JUNK]
    rows = [(i, texts[i % 4] + (" más" if i % 4 == 0 else "\n" + str(i)) * (i % 3), "k", 0.5) for i in range(4 * n)]
    rows += [(1000, None, "k", 0.5), (1001, "", "k", 0.5), (1002, " \n ", "k", 0.5), (1, rows[1][1], "k", 0.5), (2000, PROSE * 3000, "k", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, words double")
    labels = spark.createDataFrame([(i, q.KINDS[i % 4], "t") for i in range(8)] + [(3, None, "t"), (5000, "list", "t"), (2, "other", "t")], "doc_id long, kind string, text string")
    return docs, labels


def test_operator(spark):
    docs, labels = frames(spark)
    found = [(r.doc_id, r.kind) for r in q.document_kinds(docs, labels).collect()]
    assert len(found) == 4 * 12 + 2 and found.count((1, "list")) == 2
    assert all(k == q.KINDS[i % 4] for i, k in found if i < 1000) and (2000, "prose") in found


def test_nothing_to_learn_from(spark):
    docs, labels = frames(spark, 2)
    assert q.document_kinds(docs.where("false"), labels).collect() == []
    assert q.document_kinds(docs, labels.where("false")).collect() == []
    one = docs.where("doc_id = 1")
    assert [r.kind for r in q.document_kinds(one, labels).collect()] == ["list", "list"]


def test_mixture_finds_two_heaps():
    r = np.random.default_rng(1)
    narrow = np.array([[1, 0.9, 0], [0, 0.4, 0], [0, 0, 1]])
    x = np.concatenate([r.normal(0, 0.5, (400, 3)) @ narrow - 2, r.normal(2, 1, (600, 3))])
    m = q._start(x, (x[:, 0] > 0).astype(int))
    before = -np.inf
    for _ in range(20):
        sums = m.sums(x[:500]) + m.sums(x[500:])
        assert sums[0] >= before - 5  # a floor and shrinkage keep it from rising strictly
        before, m = sums[0], m.updated(sums, len(x))
    assert np.allclose(m.sums(x), m.sums(x[:123]) + m.sums(x[123:]))
    heavy = m.means[m.responsibilities(x)[0].sum(axis=0) > 50][:, 0]
    assert heavy.min() < -1 and heavy.max() > 1
