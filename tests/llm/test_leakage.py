import random

from notelith.llm import leakage as lk

ITEM = "El maestro cargador apuntaba fecha adelantada 201 jornadas donde el original decía precinto 213 violado, error que arrastró 3267 placas perforadas hasta el epígrafe consignas del cuaderno"
WORDS = ITEM.split()


def found(text, items=None):
    index = lk.ItemIndex(items or [(7, ITEM)])
    return [index.keys[n] for _, n in index.search([text])]


def test_myers_against_the_table():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        assert lk.myers(a, b) == table(a, b)
    assert lk.myers("x" * 500, "x" * 200 + "y" + "x" * 299) == 1


def test_bits_for_all_hits_against_the_table():
    import numpy as np

    r = np.random.default_rng(2)
    for m, n in ((5, 7), (14, 16), (1, 3)):
        pattern, text = r.integers(0, 3, (60, m)), r.integers(0, 3, (60, n))
        got = lk.reach(pattern, text)
        for p, t, found_ in zip(pattern, text, got, strict=True):
            d = np.zeros((m + 1, n + 1), int)
            d[0], d[:, 0] = np.arange(n + 1), np.arange(m + 1)
            for i in range(1, m + 1):
                for j in range(1, n + 1):
                    d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (p[i - 1] != t[j - 1]))
            assert (d.min(axis=1) == found_).all()


def test_words_split_and_joined_at_line_ends():
    assert found(ITEM.replace("adelantada", "adelan\ntada").replace("original", "orig\ninal")) == [7]
    assert found(ITEM.replace("maestro cargador", "maestrocargador")) == [7]
    assert found(" ".join(WORDS[:15]).replace("donde", "don\nde")) == [7]


def test_distances_decide(monkeypatch):
    """Two letters wrong in a word, and four words wrong in a window, are too many; without the distances they'd pass."""
    some = " ".join(WORDS[:15])
    two, four = some.replace("adelantada", "adelxnyada"), some
    for w in ("maestro", "apuntaba", "adelantada", "original"):
        four = four.replace(w, w[:-1] + "x")
    assert found(some) == [7] and found(two) == [] and found(four) == []
    monkeypatch.setattr(lk, "myers", lambda a, b: 0)
    assert found(two) == [7]
    monkeypatch.undo()
    lost = " ".join(w for i, w in enumerate(WORDS) if i % 5)
    assert found(lost) == []


def test_a_piece_of_many_items(monkeypatch):
    monkeypatch.setattr(lk, "HITS", 7)
    items = [(i, f"el mismo comienzo de todos estos textos que sigue igual hasta aqui y acaba con numero {i} distinto") for i in range(30)]
    assert found(items[4][1] + " . " + items[11][1], items) == sorted(i for i, _ in items)  # 15 equal words
    assert found("el mismo comienzo de todos estos textos que sigue igual hasta aqui", items) == []


def test_passages():
    assert found(f"Buenos días. {ITEM}. Saludos") == [7]
    assert found("antes " + " ".join(WORDS[5:20]) + " después") == [7]
    assert found("antes " + " ".join(WORDS[5:19]) + " después") == []
    assert found("antes " + " ".join(WORDS[2:14]) + " después") == []


def test_writing_does_not_matter():
    flat = ITEM.upper().replace("Í", "I").replace("Ó", "O").replace(",", "")
    assert found(flat) == [7]
    assert found("\r\n".join("> " + " ".join(WORDS[i : i + 4]) for i in range(0, len(WORDS), 4))) == [7]
    assert found("\n".join(f"{i + 1}: " + " ".join(WORDS[4 * i : 4 * i + 4]) for i in range(7))) == [7]
    assert found(ITEM.replace("adelantada", "adelan-\n> tada").replace("perforadas", "perfo-\r\nradas")) == [7]
    assert found(ITEM.replace("original", "ori­ginal").replace(" ", "  ")) == [7]


def test_misread_words():
    assert found(ITEM.replace("maestro", "maest?o").replace("original", "orig1nal").replace("perforadas", "perforarnas")) == [7]
    some = " ".join(WORDS[:15])
    assert found(some.replace("maestro", "mxestro").replace("adelantada", "adelantxda")) == [7]
    worse = " ".join(w[:2] + "x" + w[3:] if len(w) > 4 else w for w in WORDS[:15])
    assert found(worse) == []


def test_other_numbers_names_and_order_are_differences():
    assert found(ITEM.replace("201", "202").replace("213", "214").replace("3267", "3268").replace("consignas", "portes")) == []
    assert found(" ".join(reversed(WORDS))) == []
    assert not lk.misread("201", "202") and not lk.misread("b44580", "b44581") and not lk.misread("del", "el") and lk.misread("ambos", "a0bos")


def test_short_items_count_as_a_whole():
    items = [(1, "hola"), (2, "dos palabras"), (3, "uno dos tres cuatro"), (4, ""), (5, None), (6, "...")]
    assert found("di hola y dos palabras", items) == [1, 2]
    assert found("uno dos tres cuatro cinco", items) == [3]
    assert found("uno dos tres", items) == []


def test_operator(spark):
    docs = spark.createDataFrame(
        [(1, ITEM, "x", 5), (2, None, "x", 5), (3, "", "x", 5), (1, ITEM, "x", 5), (4, "palabra " * 200_000 + ITEM, "x", 5), (5, "nada", "x", 5)],
        "doc_id long, text string, item_id string, suite int",
    )
    items = spark.createDataFrame([(7, ITEM, "y"), (8, ITEM, "y"), (9, None, "y"), (10, "otra cosa " * 10, "y")], "item_id long, text string, doc_id string")
    want = sorted([(1, 7), (1, 8)] * 2 + [(4, 7), (4, 8)])
    assert sorted(tuple(r) for r in lk.leaks(docs, items).collect()) == want
    assert sorted(tuple(r) for r in lk.leaks(docs, items, block_chars=100).collect()) == want  # several blocks
    assert lk.leaks(docs.where("false"), items).collect() == [] and lk.leaks(docs, items.where("false")).collect() == []


def test_against_brute_force():
    """Every 15-word window of every item compared word by word at every place of random mixtures."""
    r = random.Random(4)
    vocabulary = [w + str(i) * 0 + "abcdefghij"[i % 10] * 2 for i, w in enumerate(["tubo", "codo", "cable", "placa", "muelle", "boya", "racor", "lote"] * 3)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(15, 30)))) for i in range(12)]
    texts = []
    for _ in range(150):
        words = r.choices(vocabulary, k=40)
        i, at, n = r.randrange(12), r.randrange(0, 20), r.randint(10, 22)
        part = items[i][1].split()[r.randrange(0, 6) :][:n]
        words[at : at + len(part)] = [w[:-1] + "x" if r.random() < 0.08 else w for w in part]
        texts.append(" ".join(words))
    index = lk.ItemIndex(items)
    want = set()
    for t, text in enumerate(texts):
        words = text.split()
        for n, (_, item) in enumerate(items):
            target = item.split()
            for i in range(len(target) - 14):
                for j in range(len(words) - 14):
                    wrong = [not (a == b) for a, b in zip(target[i : i + 15], words[j : j + 15], strict=True)]
                    bad = sum(wrong)
                    if bad <= 3 and all(a == b or lk.misread(a, b) for a, b in zip(target[i : i + 15], words[j : j + 15], strict=True)):
                        want.add((t, n))
    assert set(index.search(texts)) == want and want


def test_short_items_with_misread_words():
    """Each way of misreading as many words as an item of 2 to 14 words allows leaves an intact piece."""
    from itertools import combinations

    words = ["maestro", "cargador", "apuntaba", "fecha", "adelantada", "jornadas", "donde", "original", "precinto", "violado", "error", "arrastra", "placas", "perforadas"]
    for n in range(2, 15):
        item = words[:n]
        for wrong in combinations(range(n), -(-n // lk.WORDS_PER_ERROR)):
            read = " ".join(w[:-1] + "x" if i in wrong else w for i, w in enumerate(item))
            assert found(f"antes {read} luego", [(1, " ".join(item))]) == [1], (n, wrong)
        worse = " ".join(w[:-1] + "x" if i <= -(-n // lk.WORDS_PER_ERROR) else w for i, w in enumerate(item))
        assert found(f"antes {worse} luego", [(1, " ".join(item))]) == []
