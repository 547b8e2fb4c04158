import random

import pytest
from notelith.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(pair):
    mine, other = pair
    r = random.Random(1)
    for letters in ("abinthe ", "".join(map(chr, range(32, 127))) + "áéñß漢字😀🔧́​ \n\t", "aA1 '", "=-_ \n"):
        for _ in range(700):
            text = "".join(r.choices(letters, k=r.randint(0, 50)))
            assert mine.encode(text) == other.encode_ordinary(text), text


def test_special_and_long(pair):
    mine, other = pair
    for text in ["", None, "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "漢" * 2000, "'s 't 're don't"]:
        assert mine.encode(text) == (other.encode_ordinary(text) if text else [])


def test_neighbours_by_the_merges(pair):
    machine = pair[0].machine
    r = random.Random(2)
    for _ in range(20_000):
        a, b = r.randrange(50_256), r.randrange(50_256)
        assert machine.adjacent(a, b) == (machine.merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])


def test_states_are_bounded():
    machine = bpe.Transducer(bpe.load_ranks(bpe.VOCABULARY), max_states=50)
    r = random.Random(3)
    for _ in range(300):
        piece = "".join(r.choices("abcdefgh", k=12)).encode()
        assert list(machine.encode(piece)) == machine.merged(piece)
    assert len(machine.states) < 50 + 13


def test_decoder_holds_back_parts_of_a_character(pair):
    ids = pair[0].encode("漢字 😀 ñ")
    d = bpe.Decoder(pair[0].machine.bytes_of)
    parts = [d.feed([i]) for i in ids]
    assert "".join(parts) + d.close() == "漢字 😀 ñ" and "" in parts


def test_corpus(spark):
    schema = "doc_id long, text string, ids string, key string"
    docs = spark.createDataFrame([(1, "hola mundo", "a", "b"), (2, "", "a", "b"), (3, None, "a", "b"), (1, "hola mundo", "a", "b")], schema)
    rows = [(r.doc_id, r.ids) for r in bpe.encode_corpus(docs).collect()]
    assert rows.count(rows[0]) == 2 and rows[1:3] == [(2, []), (3, [])]
    back = [r.text for r in bpe.decode_corpus(bpe.encode_corpus(docs)).collect()]
    assert back == ["hola mundo", "", "", "hola mundo"]
    assert bpe.encode_corpus(docs.where("false")).collect() == []
