"""Evaluation texts that have got into a corpus.

A document holds an item if it holds the whole item or ``MIN_WORDS`` consecutive words of it, of which one in
``WORDS_PER_ERROR`` may be misread. Pigeonhole: an item is split into pieces of three words side by side. Any window of
15 words holds four of them whole, one more than words may be misread, so one is intact (items of fewer than nine words
have pieces of ``n // (errors + 1)`` words for that). Every exact hit of a piece is extended to both sides by Myers'
bit-parallel distance over words, for all hits at once: what has no window around the piece within the errors allowed and
one more is dropped (a word that a line's end splits is two differences, so such a word costs one of them). In the others,
words that differ are compared by Myers' distance over letters: a misread word is at a distance of one, or of two
where one letter was read as two; two words that were one, or one that was two, are the same if their letters are.

The items are a stated query set: they go to the tasks in blocks of ``BLOCK_CHARS`` characters, each block in one pass
over the corpus, without a shuffle. The number of items per document isn't limited.

Defined cases
-------------
* Letter case, accents, punctuation, spacing, line breaks, hyphens at line ends, characters that show nothing and marks
  at line starts (quote signs, line numbers with a sign) don't matter.
* Numbers, words with a digit and words of up to three letters are never misread: another one is a difference.
* An item of fewer than ``MIN_WORDS`` words counts only as a whole, an item of one word only as it stands. Null, empty and wordless texts and items hold nothing.
* Every row of the corpus counts, repeated ones too; repeated items are reported for each of their ids once.
* Empty tables give no rows. Other columns are ignored, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.runtime import ship

MIN_WORDS = 15
WORDS_PER_ERROR = 7
PIECE = 3
BLOCK_CHARS = 4_000_000
#: Texts are handled together up to so many characters; a longer text is one such part.
PART_CHARS = 1_000_000

_END = "\x1e"
_MARKS = re.compile(r"[̀-ͯ­​-‏⁠﻿]+")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\n[ \t]*(?:[>|]+[ \t]*|\d+[:.)][ \t]+)*(?=[^\W\d_])")
_LINE_START = re.compile(r"^[ \t]*(?:[>|]+[ \t]*|\d+[:.)|][ \t]+)+", re.M)
_DECIMAL = re.compile(r"(?<=\d)[.,](?=\d)")
_WORDS = re.compile(rf"[^\W_]+(?:\?[^\W_]+)*|{_END}")


def words_of(text: str) -> list[str]:
    text = unicodedata.normalize("NFKD", text).lower().replace("\r\n", "\n").replace("\r", "\n")
    text = _HYPHEN.sub("", _MARKS.sub("", text))
    return _WORDS.findall(_DECIMAL.sub("", _LINE_START.sub("", text)))


def myers(a: str, b: str) -> int:
    """Edit distance; the column of differences is one integer's bits, however long the text."""
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for ch in b:
        match = masks.get(ch, 0)
        across = match | down
        diagonal = ((((match & up) + up) ^ up) | match) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        distance += bool(plus & high) - bool(minus & high)
        plus = (plus << 1 | 1) & full
        up = (minus << 1 | ~(across | plus)) & full
        down = plus & across
    return distance


def misread(word: str, read: str) -> bool:
    """Whether ``read`` is ``word`` with one letter wrong: at a distance of one, or of two where a letter was read as two."""
    if len(word) <= 3 or abs(len(word) - len(read)) > 1 or not word.isalpha():
        return False
    return myers(word, read) <= 1 + (len(read) == len(word) + 1)


def reach(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """[hit, i]: the least edit distance of the pattern's first i words to any first words of the text.

    Myers' bits, over words and for all hits at once: one integer a hit holds the column of differences.
    """
    hits, m = pattern.shape
    place = np.arange(m, dtype=np.uint32)
    full = np.uint32((1 << m) - 1)
    up, down = np.full(hits, full, dtype=np.uint32), np.zeros(hits, dtype=np.uint32)
    best = np.broadcast_to(np.arange(m + 1, dtype=np.int16), (hits, m + 1)).copy()
    one = np.uint32(1)
    for j in range(text.shape[1]):
        match = ((pattern == text[:, j : j + 1]).astype(np.uint32) << place).sum(axis=1, dtype=np.uint32)
        across = match | down
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        plus = (plus << one | one) & full
        up = ((minus << one) & full | ~(across | plus)) & full
        down = plus & across
        steps = ((up[:, None] >> place) & one).astype(np.int16) - ((down[:, None] >> place) & one).astype(np.int16)
        np.minimum(best[:, 1:], np.cumsum(steps, axis=1, dtype=np.int16) + np.int16(j + 1), out=best[:, 1:])
        best[:, 0] = 0
    return best


#: Hits that are looked at together.
HITS = 200_000


class ItemIndex:
    """The pieces of a block of items and where they lie."""

    def __init__(self, items: list[tuple[object, str]]):
        self.keys, self.words = [], []
        self.vocabulary: dict[str, int] = {_END: -2}
        pieces: list[tuple[int, int, int, int]] = []
        flat: list[int] = [-3] * MIN_WORDS  # -3: outside of an item, equal to nothing
        self.start: list[int] = []
        for key, text in items:
            words = [w for w in words_of(text or "") if w != _END]
            if not words:
                continue
            n = len(self.keys)
            self.keys.append(key)
            self.words.append(words)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            self.start.append(len(flat))
            flat += ids + [-3] * MIN_WORDS
            # Side by side, so that every window holds more whole pieces than words may be misread; 0 fills up shorter ones.
            size = self.piece_words(len(ids))
            for i in range(0, len(ids) - size + 1, size):
                pieces.append((*(*ids[i : i + size], 0, 0)[:PIECE], n, i))
        self.flat = np.array(flat, dtype=np.int32)
        self.start = np.array(self.start, dtype=np.int64)
        at = np.array(pieces, dtype=np.int64).reshape(-1, PIECE + 2)
        self.base = np.int64(len(self.vocabulary) + 2)
        codes = self.code(at[:, 0], at[:, 1], at[:, 2])
        order = np.argsort(codes, kind="stable")
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.ends = np.append(self.first[1:], len(order))
        self.item, self.place = at[order, PIECE], at[order, PIECE + 1]
        lengths = [len(w) for w in self.words]
        self.size = np.array([self.piece_words(n) for n in lengths], dtype=np.int64)
        self.short = set(self.size.tolist()) & set(range(1, PIECE))
        self.want = np.minimum(lengths, MIN_WORDS).astype(np.int64)
        self.budget = -(-self.want // WORDS_PER_ERROR)

    def code(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        if int(self.base) ** 3 < 1 << 62:
            return (a * self.base + b) * self.base + c
        with np.errstate(over="ignore"):  # a large block: codes may coincide, which the distance sorts out
            return (a * self.base + b) * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) + c

    @staticmethod
    def piece_words(n_words: int) -> int:
        """Words of a piece, so that more pieces than may be misread lie whole in any window."""
        window = min(n_words, MIN_WORDS)
        return max(1, min(PIECE, window // (-(-window // WORDS_PER_ERROR) + 1)))

    def near(self, item: np.ndarray, place: np.ndarray, spot: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which hits have a window around them within the errors and one more: a misread word counts one, one that is split two."""
        m = MIN_WORDS - 1
        step = np.arange(m)
        far = np.arange(m + 2)
        at = self.start[item] + place
        right, left = at + self.size[item], at - 1
        fetch = lambda source, i, outside: np.where((i >= 0) & (i < source.size), source[np.clip(i, 0, source.size - 1)], outside)
        # Behind an end of a text or item nothing is equal; what one side lacks the other may have.
        after = reach(fetch(self.flat, right[:, None] + step, -3), fetch(ids, (spot + self.size[item])[:, None] + far, -4))
        before = reach(fetch(self.flat, left[:, None] - step, -3), fetch(ids, (spot - 1)[:, None] - far, -4))
        rest = self.want[item] - self.size[item]
        least = np.full(item.size, np.iinfo(np.int16).max, dtype=np.int16)
        row = np.arange(item.size)
        for i in range(m + 1):
            there = (rest >= i) & (rest - i <= m)
            least[there] = np.minimum(least[there], after[row[there], i] + before[row[there], (rest - i)[there]])
        return least <= self.budget[item] + 1

    def verify(self, n: int, place: int, spot: int, words: list[str], start: int, end: int) -> bool:
        """Whether words[start:end] hold enough of item n around the piece that both have."""
        item = self.words[n]
        want, size = int(self.want[n]), int(self.size[n])
        if item[place : place + size] != words[spot : spot + size]:
            return False
        wrong: list[int] = []

        def run(i: int, j: int, step: int) -> int:
            """How far the item goes on in the text: equal words, words split or joined at a line's end, misread ones."""
            word = lambda k: item[k] if 0 <= k < len(item) else ""
            read = lambda k: words[k] if start <= k < end else ""
            both = lambda x, y: x + y if step > 0 else y + x
            while word(i) and read(j):
                a, b = word(i), read(j)
                if a == b:
                    i, j = i + step, j + step
                elif read(j + step) and a == both(b, read(j + step)):
                    i, j = i + step, j + 2 * step
                elif word(i + step) and b == both(a, word(i + step)):
                    i, j = i + 2 * step, j + step
                elif misread(a, b):
                    wrong.append(i)
                    i, j = i + step, j + step
                else:
                    break
            return i

        high = run(place + size, spot + size, 1)
        low = run(place - 1, spot - 1, -1) + 1
        return high - low >= want and self._budget(sorted(wrong), low, high, want)

    @staticmethod
    def _budget(wrong: list[int], low: int, high: int, want: int) -> bool:
        """Whether some window of the wanted length has no more misread words than it may."""
        most = -(-want // WORDS_PER_ERROR)
        if len(wrong) <= most:
            return True
        return any(sum(i <= x < i + want for x in wrong) <= most for i in range(low, high - want + 1))

    def search(self, texts: list[str]) -> list[tuple[int, int]]:
        """(index of the text, index of the item) found."""
        words = words_of(f"\n{_END}\n".join(texts))
        words.append(_END)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        ends = np.flatnonzero(ids == -2)
        padded = np.append(ids, [-1, -1])
        a, b, c = padded[:-2], padded[1:-1], padded[2:]
        whole = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        spots, codes = [whole], [self.code(a[whole], b[whole], c[whole])]
        zero = np.int64(0)
        if 2 in self.short:
            two = np.flatnonzero((a > 0) & (b > 0))
            spots.append(two)
            codes.append(self.code(a[two], b[two], zero))
        if 1 in self.short:
            one = np.flatnonzero(a > 0)
            spots.append(one)
            codes.append(self.code(a[one], np.zeros_like(one), zero))
        spot, code = np.concatenate(spots), np.concatenate(codes)
        if not spot.size or not self.codes.size:
            return []
        at = np.searchsorted(self.codes, code)
        at[at == self.codes.size] = 0
        hit = self.codes[at] == code
        spot, at = spot[hit], at[hit]
        count = self.ends[at] - self.first[at]
        upto = np.cumsum(count)
        found: set[tuple[int, int]] = set()
        for low in range(0, int(upto[-1]) if upto.size else 0, HITS):
            # A part of all (place in the texts, place in the items), so that a piece of many items takes no more memory.
            k = np.arange(low, min(low + HITS, int(upto[-1])))
            of = np.searchsorted(upto, k, side="right")
            post = self.first[at[of]] + k - (upto[of] - count[of])
            item, place, here = self.item[post], self.place[post], spot[of]
            text = np.searchsorted(ends, here)
            keep = np.flatnonzero(self.near(item, place, here, ids))
            for i in keep[np.lexsort((here[keep], item[keep], text[keep]))]:
                pair = (int(text[i]), int(item[i]))
                if pair not in found:
                    start = int(ends[pair[0] - 1]) + 1 if pair[0] else 0
                    if self.verify(pair[1], int(place[i]), int(here[i]), words, start, int(ends[pair[0]])):
                        found.add(pair)
        return sorted(found)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document that holds enough of an item."""
    ship(docs.sparkSession)
    slim = docs.select(doc_id, text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    wanted = items.select(item_id, text).where(F.col(text).isNotNull())
    chars = wanted.agg(F.sum(F.length(text))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    schema = T.StructType([docs.schema[doc_id], items.schema[item_id]])

    def search_block(block: int) -> DataFrame:
        rows = wanted.where(F.pmod(F.xxhash64(item_id, text), F.lit(n_blocks)) == block).collect()  # one block of items
        index = ItemIndex([tuple(r) for r in rows])
        handed = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                at = keys = None
                for low, high in _parts(texts):
                    part = [t.replace(_END, " ") if _END in t else t for t in texts[low:high]]
                    for i, n in handed.value.search(part):
                        at, keys = at or [], keys or []
                        at.append(low + i)
                        keys.append(handed.value.keys[n])
                if at:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(keys)], names=[doc_id, item_id])

        return slim.mapInArrow(search, schema)

    found = search_block(0)
    for block in range(1, n_blocks):
        found = found.unionByName(search_block(block))
    return found


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PART_CHARS:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)
