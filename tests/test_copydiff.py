import math
import random

import numpy as np
from notelith.operators.copydiff import PresenceBitmap, diff_copies

SCHEMA = "Pdf string, Pagina int, Importe double, Codigo string, at long, finding string, _block int, k0 string"
ARGS = dict(keys=["Pdf", "Pagina"], fields=["Importe", "Codigo"], version="at")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "k") for r in rows], SCHEMA)


def diff(spark, a, b, **more):
    return sorted((tuple(r) for r in diff_copies(frame(spark, a), frame(spark, b), **ARGS, **more).collect()), key=str)


def brute(a, b):
    def state(rows):
        best = {}
        for pdf, page, amount, code, at in rows:
            amount = None if amount is None or math.isnan(amount) else amount
            row = (at is not None, at or 0, amount is not None, amount or 0, code or "")
            if (pdf, page) not in best or row > best[pdf, page][0]:
                best[pdf, page] = (row, amount, code or None)
        return best

    x, y, out = state(a), state(b), []
    for k in x.keys() | y.keys():
        if k not in y:
            out.append((*k, "missing_in_right"))
        elif k not in x:
            out.append((*k, "missing_in_left"))
        else:
            (_, p, c), (_, q, d) = x[k], y[k]
            if (p is None) != (q is None) or (p is not None and abs(p - q) > 0.005):
                out.append((*k, "Importe"))
            if c != d:
                out.append((*k, "Codigo"))
    return sorted(out, key=str)


A = [("a", 1, 1.0, "x", 1), ("a", 2, None, "", 1), ("a", 3, 2.0, "y", 1), ("a", 3, 2.5, "y", 2), ("a", 3, 2.5, "y", 2), (None, 1, 1.0, None, 1), ("b", None, 1.0, "q", None), ("é" * 100_000, 1, 1.0, "z" * 300_000, 1)]
B = [("a", 1, 1.004, "x", 9), ("a", 2, float("nan"), None, 1), ("a", 3, 2.0, "Y", 1), ("c", 1, 1.0, "x", 1), (None, 1, None, "", 1), ("b", None, 1.0, "q", None), ("é" * 100_000, 1, 1.0, "z" * 300_001, 1)]


def test_cases(spark):
    want = [("a", 3, "Codigo"), ("a", 3, "Importe"), ("c", 1, "missing_in_left"), (None, 1, "Importe"), ("é" * 100_000, 1, "Codigo")]
    assert diff(spark, A, B) == sorted(want, key=str) == brute(A, B)


def test_empty_copies(spark):
    assert diff(spark, [], []) == []
    assert {r[2] for r in diff(spark, A, [])} == {"missing_in_right"} and {r[2] for r in diff(spark, [], B)} == {"missing_in_left"}


def test_random_and_hot_key_in_small_blocks(spark):
    r = random.Random(1)
    make = lambda: [(r.choice("abcdefgh"), r.randint(1, 40), r.choice([None, float("nan"), 1.0, 1.003, 1.02]), r.choice([None, "", "x", "y"]), r.randint(1, 3)) for _ in range(700)]
    a, b = make() + [("hot", 1, 1.0, "x", i) for i in range(2000)], make() + [("hot", 1, 1.0, "x", 5)]
    assert diff(spark, a, b, keys_per_block=20) == brute(a, b)


def test_bitmaps():
    r = np.random.default_rng(1)
    for n in (1, 70_000, 200_000):
        for density in (0.001, 0.5, 0.999):
            x, y = (np.flatnonzero(r.random(n) < density) for _ in range(2))
            a, b = PresenceBitmap(n, x), PresenceBitmap(n, y)
            assert a.and_not(b).tolist() == np.setdiff1d(x, y).tolist() and a.intersect(b).tolist() == np.intersect1d(x, y).tolist()
    assert {c[0] for c in PresenceBitmap(65_536, np.arange(60_000)).containers} == {"runs"}
