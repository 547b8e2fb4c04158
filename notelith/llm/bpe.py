"""Encoding a corpus with a byte-level BPE vocabulary through a lazily determinised transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours are: if the merges applied to the
bytes of both give back these two tokens. So for every prefix of a piece of text there is one last token, and the
encoding of all prefixes forms a tree. The transducer reads bytes; its state holds the prefixes from which a vocabulary
token can still reach beyond the bytes read, each with the tokens not yet written. Tokens common to all of them can't
change any more and are written at once: the lookahead is bounded by the longest token. States and transitions are made
when first needed (``Transducer.step``) and kept, up to a bound of states after which the machine starts afresh.

Defined cases
-------------
* Null and empty text both give the empty list of ids.
* Special tokens' strings in a text are ordinary text.
* Repeated rows give repeated rows; other columns of the input are ignored.
* Texts of any length are read whole; a piece between two boundaries of the pattern may be of any length as well.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from notelith.runtime import ship

#: Where the public vocabularies lie; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: States and remembered pieces before a worker's machine starts afresh.
MAX_STATES = 400_000
MAX_PIECES = 200_000
MAX_NEIGHBOURS = 2_000_000
#: Longer pieces aren't remembered.
LONG_PIECE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.wholes: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.reset()

    def reset(self) -> None:
        #: A state: (bytes since its oldest open prefix, ((start, last token, pending tokens), ...) oldest first).
        start = (b"", ((0, -1, ()),))
        self.ids, self.states = {start: 0}, [start]
        #: (state * 256 + byte) -> (next state, tokens written).
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges applied to some bytes, lowest rank first: what defines the encoding."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """What lies at one end of a token while it is merged: (bytes, rank, rank of the merge that ends it), last first."""
        known = self.edges[side].get(token)
        if known is None:
            data, until, known = self.bytes_of[token], 1 << 60, []
            while True:
                rank = self.ranks[data]
                known.append((data, rank, until))
                if len(data) == 1:
                    break
                until, data = rank, self.halves(data, rank)[side]
            self.edges[side][token] = known
        return known

    def halves(self, data: bytes, rank: int) -> list[bytes]:
        """The two parts from whose merge a token comes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def adjacent(self, a: int, b: int) -> bool:
        """Whether no merge across the boundary comes before one that ends a piece beside it; of equal ranks the left one is first."""
        known = self.neighbours.get((a, b))
        if known is None:
            get, known = self.ranks.get, True
            left, right = self.edge(a, 1), self.edge(b, 0)
            for x, from_x, to_x in left:
                for y, from_y, to_y in right:
                    rank = get(x + y)
                    if rank is not None and rank < to_x and rank <= to_y and from_x < to_y and from_y < to_x:
                        known = False
                        break
                if not known:
                    break
            if len(self.neighbours) > MAX_NEIGHBOURS:
                self.neighbours.clear()
            self.neighbours[a, b] = known
        return known

    def whole(self, data: bytes, token: int) -> bool:
        """Whether the merges make one token of a token's own bytes."""
        known = self.wholes.get(token)
        if known is None:
            known = self.wholes[token] = self.merged(data) == [token]
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that are certain now."""
        data, open_ = self.states[state]
        data += bytes((byte,))
        end, new = len(data), None
        for start, last, pending in open_:  # the one last token of the prefix that ends here
            token = self.ranks.get(data[start:])
            if token is not None and (last < 0 or self.adjacent(last, token)) and self.whole(data[start:], token):
                new = (end, token, (*pending, token))
                break
        assert new is not None, "the vocabulary lacks a byte"
        alive = [x for x in open_ if data[x[0] :] in self.prefixes]
        alive.append(new)
        # Tokens that all open prefixes share are certain.
        first = alive[0][2]
        n = len(first)
        for _, _, pending in alive[1:]:
            n = min(n, len(pending))
            while first[:n] != pending[:n]:
                n -= 1
        base = alive[0][0]
        after = (data[base:], tuple((s - base, t, p[n:]) for s, t, p in alive))
        to = self.ids.get(after)
        if to is None:
            to = self.ids[after] = len(self.states)
            self.states.append(after)
        move = self.moves[state << 8 | byte] = (to, first[:n])
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (token := self.ranks.get(piece)) is not None and self.whole(piece, token):
            return (token,)
        if len(self.states) > self.max_states:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self.step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return (*out, *self.states[state][1][-1][2])


class Encoder:
    """Texts to ids: the split pattern, the transducer and the pieces it has lately encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, max_pieces: int = MAX_PIECES):
        self.machine, self.split, self.max_pieces = Transducer(ranks), regex.compile(pattern).findall, max_pieces
        encode = self.machine.encode

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = encode(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= LONG_PIECE:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def encode(self, text: str | None) -> list[int]:
        if len(self.pieces) > self.max_pieces:
            self.pieces.clear()
        if not text:
            return []
        found = self.split(text)
        if len(found) == 1:
            return list(self.pieces[found[0]])
        return list(chain.from_iterable(itemgetter(*found)(self.pieces)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(load_ranks(path))


class Decoder:
    """Ids to text as they come: bytes pass an incremental UTF-8 state machine that holds back what isn't whole yet."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self.machine.decode(b"", True)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: one pass, no shuffle."""
    ship(docs.sparkSession)
    slim = docs.select(key, text)
    schema = T.StructType([slim.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary).encode
        for batch in batches:
            ids = [one(x) for x in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return slim.mapInArrow(encode, schema)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from (key, ids); null ids give null."""
    ship(encoded.sparkSession)
    slim = encoded.select(key, ids)
    schema = T.StructType([slim.schema[key], T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder(vocabulary).machine.bytes_of
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                d = Decoder(bytes_of)
                texts.append(None if x is None else d.feed(x) + d.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return slim.mapInArrow(decode, schema)
