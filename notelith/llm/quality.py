"""Text statistics per document and what they say about its kind: prose, list, table or junk.

Statistics are computed for whole parts of a batch at once: characters become code points, code points flags, and sums
by token, line and document follow from where those begin. A Gaussian mixture is fitted to the standardized statistics
of all documents by expectation-maximization (each round is one pass over the statistics that returns sums of bounded
size), its components get the kinds of the documents that were labelled by hand, and a document the kind that is most
probable under its components. Nothing but the mixture decides; a document of several kinds gets the one that its
statistics over all characters, words and lines are most like.

Defined cases
-------------
* Null, empty and blank texts have no kind and aren't reported; their statistics are 0.
* Every row counts, repeated ones too. Ties between kinds go to the first of prose, list, table, junk.
* Without documents, or without labels, there are no rows: nothing says what a component is.
* Labels for unknown documents, null labels and labels outside the four kinds are ignored; of several labels for one
  document each counts.
* Constant statistics (a corpus of one text) are handled by a floor under the variances.
* Other columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.runtime import durable, ship

KINDS = ["prose", "list", "table", "junk"]
#: Texts are handled together up to so many characters; a longer text is one such part.
PART_CHARS = 1_000_000

# Frequent words of the languages of such mail, by language.
COMMON_WORDS = {
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o ha está si",
    "en": "the of and to in a is that it for was on are with as be this by an or from at which we not have has you will",
    "fr": "le les et des du un une est pour dans au par sur ne pas plus ce nous vous avec sont mais ou été qui je il",
    "pt": "o os e do da em um uma é não com as dos das no na mais foi ao pelo pela ou ser está já nos são",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "it": "il di che è per una sono con non si da ma le gli della del nel alla più anche ha come lo i",
}

LETTER, VOWEL, UPPER, DIGIT, SPACE, STOP, PLAIN, PICTURE, WIDE = (1 << i for i in range(9))
STATS = [
    "words", "mean_word", "symbol_ratio", "digit_ratio", "upper_ratio", "vowel_ratio", "stop_lines", "common_words",
    "line_length", "line_spread", "marked_lines", "line_words", "numbers", "separators", "gaps", "pauses", "digit_ends", "open_ends",
    "short_words", "single_marks", "unbroken", "repeats", "odd_marks", "pictures", "wide", "letters", "new_words", "fullness",
]
#: Statistics without an upper bound are fitted by their logarithms.
LOGARITHMIC = ["words", "mean_word", "line_length", "line_words", "separators", "gaps"]


class _Flags:
    """Flags by code point, made when a code point is first met."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, dtype=bool)
        self.flags = np.zeros(0x110000, dtype=np.uint16)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def add(self, codes: np.ndarray) -> None:
        met = np.zeros(0x110000, dtype=bool)
        met[codes] = True
        for code in np.flatnonzero(met & ~self.known):
            ch = chr(code)
            kind, low = unicodedata.category(ch), ch.lower()
            flag = 0
            if kind[0] == "L":
                flag |= LETTER | (UPPER if kind == "Lu" else 0)
                if unicodedata.normalize("NFD", low)[:1] in "aeiouyαεηιουωаеиоуыэюяø" or code > 0x590:
                    flag |= VOWEL  # scripts beyond Cyrillic and Armenian: no statement
                if code > 0x2E7F:
                    flag |= WIDE
            elif kind[0] == "N":
                flag |= DIGIT
            elif ch.isspace():
                flag |= SPACE
            elif kind[0] == "M":
                flag |= LETTER | VOWEL
            elif ch in ".?!…。！？؟।":
                flag |= STOP
            elif ch in ",;:()¿¡«»\"'’“”-/":
                flag |= PLAIN
            elif kind in ("So", "Sk", "Cn", "Co", "Cc", "Cf", "Cs") or 0x2500 <= code <= 0x25FF:
                flag |= PICTURE
            self.flags[code] = flag
            self.lower[code] = ord(low) if len(low) == 1 else code
            self.known[code] = True


_FLAGS: list[_Flags] = []
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _hash(text: str) -> int:
    h, power = 0, 1
    for ch in text:
        h, power = (h + (ord(ch) + 1) * power) % (1 << 64), power * int(_P) % (1 << 64)
    return h


_COMMON = np.unique(np.array([_hash(w) for ws in COMMON_WORDS.values() for w in ws.split()], dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums between starts; the last runs to the end. Each piece holds one element at least."""
    return np.add.reduceat(values, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


def document_stats(texts: list[str]) -> np.ndarray:
    """One row of STATS for each text; no text may be null."""
    n = len(texts)
    out = np.zeros((n, len(STATS)))
    if not n:
        return out
    if not _FLAGS:
        _FLAGS.append(_Flags())
    joined = "\n\x00\n".join(t.replace("\x00", " ").replace("\r\n", "\n").replace("\r", "\n") for t in texts) + "\n\x00\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _FLAGS[0]
    table.add(codes)
    flag = table.flags[codes]
    size = codes.size

    # Lines: all end with a line feed; a line with the zero character alone ends a text.
    feeds = np.flatnonzero(codes == 10)
    starts = np.append(0, feeds[:-1] + 1)
    is_end = codes[starts] == 0
    text_of = np.cumsum(is_end) - is_end
    count = lambda mask: _sums(mask, starts)
    has = lambda bit: (flag & bit) != 0
    space = has(SPACE)
    letters, vowels, digits, uppers = count(has(LETTER)), count(has(VOWEL)), count(has(DIGIT)), count(has(UPPER))
    spaces, stops, pictures, wide = count(space), count(has(STOP)), count(has(PICTURE)), count(has(WIDE))
    length = feeds - starts
    shown = length + 1 - spaces  # the feed is a space
    shown[is_end] = 0
    symbols = shown - letters - digits - stops - count(has(PLAIN))

    # Tokens.
    before = np.append(True, space[:-1])
    token_at = np.flatnonzero(~space & before)
    token_line = np.searchsorted(feeds, token_at)
    piece = np.append(token_at, size)
    token_end = np.flatnonzero(np.append(~space[:-1] & space[1:], ~space[-1])) + 1
    token_letters = _sums(has(LETTER), token_at)
    token_digits = _sums(has(DIGIT), token_at)
    token_len = token_end - token_at
    numeric = (token_letters == 0) & (token_digits > 0)
    n_lines = starts.size
    by_line = lambda mask: np.bincount(token_line[mask], minlength=n_lines)
    tokens, numbers = by_line(np.ones(token_at.size, bool)), by_line(numeric)
    latin = _sums(codes < 0x250, token_at) - _sums(space, token_at) == token_len
    unbroken = (token_len > 25) & (token_digits > 0) | (token_len > 45) & latin
    long_tokens = np.bincount(token_line, weights=np.where(unbroken, token_len, 0), minlength=n_lines)
    repeats = count(has(LETTER) & np.append(False, codes[1:] == codes[:-1]))
    pair_tokens = by_line((token_len <= 2) & (token_letters + token_digits == token_len))
    single_tokens = by_line(token_len == 1)

    # Words: tokens without the marks around them, by a hash that position doesn't change.
    body = has(LETTER) | has(DIGIT)
    mass = np.where(body, (table.lower[codes].astype(np.uint64) + np.uint64(1)), np.uint64(0))
    with np.errstate(over="ignore"):
        order = np.cumsum(body) - body  # rank among word characters
        step = _powers(_P, int(order[-1]) + 2)
        total = np.append(np.uint64(0), np.cumsum(mass * step[order]))
        back = _powers(_P_INVERSE, int(order[-1]) + 2)
        word_hash = (total[piece[1:]] - total[token_at]) * back[order[token_at]]
    at = np.searchsorted(_COMMON, word_hash)
    at[at == _COMMON.size] = 0
    common_token = _COMMON[at] == word_hash
    common = by_line(common_token)

    # Separators, pauses and the ends of lines.
    next_space = np.append(space[1:], True)
    separators = count((codes == 9) | (codes == ord(";")) & ~next_space | (codes == ord("|")))
    pauses = count(((codes == ord(",")) | (codes == ord(";")) | has(STOP)) & next_space)
    gaps = count(space & next_space & ~before & (codes != 10) & (codes != 9))
    last = np.maximum(feeds - 1, 0)
    while True:  # the last character shown
        step_back = (last > starts) & space[last]
        if not step_back.any():
            break
        last = last - step_back
    first = starts.copy()
    while True:
        step_on = (first < feeds) & space[first]
        if not step_on.any():
            break
        first = first + step_on
    ends_stop, ends_digit = (flag[last] & STOP) != 0, (flag[last] & DIGIT) != 0
    is_letter = has(LETTER)
    amid = np.append(False, is_letter[:-1]) & np.append(is_letter[1:], False)
    odd = count(amid & ~is_letter & ~space & ~has(DIGIT) & ~np.isin(codes, [ord(x) for x in "-'’/.&·,;|:"]))
    with np.errstate(over="ignore"):
        _, once = np.unique(word_hash ^ (token_line.astype(np.uint64) + np.uint64(1)) * _P, return_index=True)
    distinct = np.bincount(token_line[once], minlength=n_lines)

    blank = (shown <= 0) | is_end
    c0, c1, c2, c3 = (codes[np.minimum(first + i, size - 1)] for i in range(4))
    digit0, digit1 = (table.flags[c0] & DIGIT) != 0, (table.flags[c1] & DIGIT) != 0
    close = lambda c: np.isin(c, [ord(")"), ord("."), ord("-")])
    bullet = np.isin(c0, [ord(x) for x in "•*·–—-◦▪"]) & (table.flags[c1] & SPACE != 0) | (c0 == ord("[")) & (c2 == ord("]"))
    number = digit0 & (close(c1) | digit1 & close(c2) | digit1 & ((table.flags[c2] & DIGIT) != 0) & close(c3))
    letter = ((table.flags[c0] & LETTER) != 0) & (c1 == ord(")"))
    times = digit0 & ((c1 == 32) & (c2 == ord("x")) | digit1 & (c2 == 32) & (c3 == ord("x")))
    marked = (bullet | number | letter | times) & ~blank

    # Running text goes on in the next line, often behind a frequent word.
    last_token = np.searchsorted(token_line, np.arange(n_lines), side="right") - 1
    edge = np.append(True, blank[1:] | blank[:-1])
    follows = np.append(~edge[1:], False) & ~blank
    open_end = follows & (tokens > 0) & common_token[np.maximum(last_token, 0)]
    # ... and fills its lines evenly: how long lines are that go on, against the longest of their block.
    block = np.cumsum(edge) - 1
    widest = np.zeros(block[-1] + 1, dtype=np.int64)
    np.maximum.at(widest, block, length)
    fullness = np.where(follows, length / np.maximum(widest[block], 1), 0)

    per_text = lambda v: np.bincount(text_of[~is_end], weights=v[~is_end], minlength=n)[:n]
    chars = np.maximum(per_text(shown), 1)
    n_shown = np.maximum(per_text(~blank), 1)
    n_tokens = per_text(tokens)
    n_words = np.maximum(n_tokens, 1)
    n_letters = np.maximum(per_text(letters), 1)
    mean_length = per_text(np.where(blank, 0, length)) / n_shown
    spread = np.sqrt(np.maximum(per_text(np.where(blank, 0, length.astype(float) ** 2)) / n_shown - mean_length**2, 0))
    values = {
        "words": n_tokens,
        "mean_word": per_text(shown) / n_words,
        "symbol_ratio": per_text(symbols) / chars,
        "digit_ratio": per_text(digits) / chars,
        "upper_ratio": per_text(uppers) / n_letters,
        "vowel_ratio": per_text(vowels) / n_letters,
        "stop_lines": per_text(ends_stop & ~blank) / n_shown,
        "common_words": per_text(common) / n_words,
        "line_length": mean_length,
        "line_spread": spread / np.maximum(mean_length, 1),
        "marked_lines": per_text(marked) / n_shown,
        "line_words": n_tokens / n_shown,
        "numbers": per_text(numbers) / n_words,
        "separators": per_text(separators) / n_shown,
        "gaps": per_text(gaps) / n_shown,
        "pauses": per_text(pauses) / n_words,
        "digit_ends": per_text(ends_digit & ~blank) / n_shown,
        "open_ends": per_text(open_end) / n_shown,
        "short_words": per_text(pair_tokens) / n_words,
        "single_marks": per_text(single_tokens) / n_words,
        "unbroken": per_text(long_tokens) / chars,
        "repeats": per_text(repeats) / n_letters,
        "odd_marks": per_text(odd) / chars,
        "pictures": per_text(pictures) / chars,
        "wide": per_text(wide) / chars,
        "letters": per_text(letters) / chars,
        "new_words": per_text(tokens * np.log1p(distinct) / np.log1p(np.maximum(tokens, 1))) / n_words,
        "fullness": np.where(per_text(follows) > 0, per_text(fullness) / np.maximum(per_text(follows), 1), 1.0),
    }
    for i, name in enumerate(STATS):
        out[:, i] = values[name]
    out[per_text(shown) == 0] = 0
    return out


def _features(stats: np.ndarray) -> np.ndarray:
    """Statistics on scales on which a normal distribution is a fair picture."""
    x = stats.copy()
    for name in LOGARITHMIC:
        x[:, STATS.index(name)] = np.log1p(x[:, STATS.index(name)])
    return x


def corpus_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, one column for each of STATS) of every row: one pass, no shuffle."""
    ship(docs.sparkSession)
    slim = docs.select(doc_id, text)
    schema = T.StructType([slim.schema[doc_id], *(T.StructField(s, T.DoubleType(), False) for s in STATS)])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            parts, low, size = [], 0, 0
            for i, x in enumerate(texts):
                size += len(x)
                if size >= PART_CHARS or i + 1 == len(texts):
                    parts.append(document_stats(texts[low : i + 1]))
                    low, size = i + 1, 0
            if parts:
                stats = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in stats.T)], names=[doc_id, *STATS])

    return slim.mapInArrow(compute, schema)


#: The mixture: components for each kind at the start, and rounds at most (it ends before, where a round gains little).
COMPONENTS_PER_KIND = 5
MAX_ROUNDS = 40
#: The mean log-likelihood of a document has to rise by so much for another round.
LEAST_GAIN = 0.01
#: What is added to each variance, and the part of a covariance between two statistics that is left out.
VARIANCE_FLOOR = 0.02
SHRINKAGE = 0.02
#: At most so many labelled documents (those with the least hashes) start the mixture and name its components.
MAX_LABELS = 20_000


class Mixture:
    """Gaussians with full covariances over standardized features."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.weights, self.means, self.covariances = weights, means, covariances
        roots = np.linalg.cholesky(covariances)
        self.whiten = np.linalg.inv(roots)
        volume = np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)
        self.const = np.log(np.maximum(weights, 1e-12)) - volume - 0.5 * means.shape[1] * np.log(2 * np.pi)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row under each component."""
        square = [(((x - m) @ w.T) ** 2).sum(axis=1) for m, w in zip(self.means, self.whiten, strict=True)]
        return self.const - 0.5 * np.stack(square, axis=1)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        each = np.exp(joint - top)
        total = each.sum(axis=1, keepdims=True)
        return each / total, float((np.log(total) + top).sum())

    def sums(self, x: np.ndarray) -> np.ndarray:
        """What a round needs of some rows: per component its weight, sum and sum of products; the likelihood in front."""
        r, likelihood = self.responsibilities(x)
        products = [(x * r[:, [k]]).T @ x for k in range(r.shape[1])]
        return np.concatenate([[likelihood], r.sum(axis=0), (r.T @ x).ravel(), np.stack(products).ravel()])

    def updated(self, sums: np.ndarray, rows: int) -> Mixture:
        k, d = self.means.shape
        n = sums[1 : 1 + k]
        first, second = sums[1 + k : 1 + k + k * d].reshape(k, d), sums[1 + k + k * d :].reshape(k, d, d)
        held, there = np.maximum(n, 1e-9), n > 1e-6
        means = np.where(there[:, None], first / held[:, None], self.means)
        spread = second / held[:, None, None] - means[:, :, None] * means[:, None, :]
        diagonal = np.eye(d) * np.maximum(np.diagonal(spread, axis1=1, axis2=2), 0)[:, None, :]
        spread = (1 - SHRINKAGE) * spread + SHRINKAGE * diagonal + VARIANCE_FLOOR * np.eye(d)
        return Mixture(n / max(rows, 1), means, np.where(there[:, None, None], spread, self.covariances))


def _start(x: np.ndarray, kinds: np.ndarray) -> Mixture:
    """Components where the labelled documents lie: for each kind a few rounds of k-means from rows spread over it."""
    means, covariances, weights = [], [], []
    for kind in np.unique(kinds):
        rows = x[kinds == kind]
        rows = rows[np.lexsort(rows.T)]
        k = min(COMPONENTS_PER_KIND, len(rows))
        centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
        for _ in range(10):
            nearest = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.stack([rows[nearest == i].mean(axis=0) if (nearest == i).any() else centres[i] for i in range(k)])
        for i in range(k):
            own = rows[nearest == i]
            means.append(centres[i])
            covariances.append(np.diag(np.maximum(own.var(axis=0), 0.2) if len(own) else np.ones(x.shape[1])))
            weights.append(max(len(own), 1) / len(x))
    return Mixture(np.array(weights), np.array(means), np.array(covariances))


def _standardized(batch: pa.RecordBatch, first: int, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    stats = np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))], axis=1).astype(float)
    return (_features(stats) - mean) / scale


def fit_mixture(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", kind: str = "kind") -> tuple | None:
    """(mean, scale, mixture, kinds' shares of the components) over all rows of ``stats``; None without rows or labels."""
    numbers = {s: F.col(s).cast("double") for s in STATS}
    features = [F.log1p(c) if s in LOGARITHMIC else c for s, c in numbers.items()]
    moments = stats.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_pop))).first()
    rows = moments["n"]
    if not rows:
        return None
    mean = np.array([moments[f"avg{i}"] for i in range(len(STATS))])
    scale = np.array([moments[f"stddev_pop{i}"] for i in range(len(STATS))])
    scale = np.where(scale > 1e-9, scale, 1.0)
    known = labels.select(F.col(doc_id).alias("_label_of"), F.col(kind).alias("_kind")).where(F.col("_kind").isin(KINDS))
    known = known.orderBy(F.xxhash64("_label_of"), "_label_of", "_kind").limit(MAX_LABELS)
    labelled = stats.join(known, F.col(doc_id) == F.col("_label_of")).select("_kind", *STATS).toPandas()
    if not len(labelled):
        return None
    kinds = np.array([KINDS.index(k) for k in labelled["_kind"]])
    x = (_features(labelled[STATS].to_numpy(dtype=float)) - mean) / scale
    mixture, before = _start(x, kinds), -np.inf
    for _ in range(MAX_ROUNDS):
        now = mixture

        def sums(batches: Iterator[pa.RecordBatch], now: Mixture = now) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = now.sums(_standardized(batch, 0, mean, scale))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total)], names=["i", "v"])

        found = stats.select(*STATS).mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        total = found.sort_values("i")["v"].to_numpy()
        mixture = mixture.updated(total, rows)
        if total[0] / rows - before < LEAST_GAIN:
            break
        before = total[0] / rows
    r, _ = mixture.responsibilities(x)
    named = np.stack([r[kinds == i].sum(axis=0) for i in range(len(KINDS))], axis=1)
    # A component without a labelled document is named as the nearest one that has some.
    some = named.sum(axis=1) >= 0.5
    for i in np.flatnonzero(~some & some.any()):
        away = ((mixture.means - mixture.means[i]) ** 2).sum(axis=1)
        named[i] = named[np.where(some, away, np.inf).argmin()]
    named = named + 1e-3 * np.bincount(kinds, minlength=len(KINDS)) / len(kinds)
    return mean, scale, mixture, named / named.sum(axis=1, keepdims=True)


def document_kinds(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, probability) of every document with a visible text."""
    slim = docs.select(doc_id, text)
    # Each round reads the statistics again: they are written once, in single precision.
    stats = durable(corpus_stats(slim, doc_id, text).where(F.col("words") > 0).select(doc_id, *(F.col(s).cast("float") for s in STATS)))
    fitted = fit_mixture(stats, labels, doc_id)
    schema = T.StructType([slim.schema[doc_id], T.StructField("kind", T.StringType()), T.StructField("probability", T.DoubleType())])
    if fitted is None:
        return docs.sparkSession.createDataFrame([], schema)
    mean, scale, mixture, named = fitted

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(KINDS, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _standardized(batch, 1, mean, scale)
            probable = mixture.responsibilities(x)[0] @ named
            kind = probable.argmax(axis=1)
            probability = probable[np.arange(len(kind)), kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[kind], pa.string()), pa.array(probability)], names=[doc_id, "kind", "probability"])

    return stats.select(doc_id, *STATS).mapInArrow(classify, schema)
