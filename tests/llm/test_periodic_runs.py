"""Periodic runs against every lag of every word."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tapewright.llm import periodic_runs as pr
from tests.llm.data import rows


def brute(x, least=24, times=3):
    out = []
    for p in range(1, len(x) // times + 1):
        at = 0
        while at + p < len(x):
            if x[at] != x[at + p]:
                at += 1
                continue
            start = at
            while at + p < len(x) and x[at] == x[at + p]:
                at += 1
            run = x[start : at + p]
            if len(run) >= max(least, times * p) and not any(run[d:] == run[:-d] for d in range(1, p)):
                out.append((start, len(run), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (8, 3), (6, 2), (10, 4)])
def test_runs_by_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(400):
        n = rng.randrange(150)
        x = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, 20)
            for i in range(a, rng.randrange(a, n)):
                x[i] = x[a + (i - a) % p]
        assert pr.runs_of(np.array(x, np.int64), least, times) == brute(x, least, times)


def test_splitting_reaches_stability():
    # c is frequent enough in the whole, but not in either half once the rare words have split it.
    x = "a a a a c z a a a a c y b b b b c".split()
    ids = pr.word_numbers([w.encode() for w in x])
    assert pr.segments(ids, 4, 3) == [(0, 4), (6, 10), (12, 16)]


def test_long_texts_with_one_run():
    rng = random.Random(3)
    for n, p in ((200_000, 1), (100_000, 7), (60_000, 20_000)):
        base = [rng.randrange(10**6) for _ in range(p)]
        assert pr.runs_of(np.array((base * (n // p + 1))[:n], np.int64)) == [(0, n, p)]


def plain(doc_id, text, damage):
    words = (text or "").encode().split()
    crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if damage and crc % 10 == 0 and words:
        g = crc // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(kept)),
    )


@pytest.mark.parametrize("damage", [False, True])
def test_digests_of_rows(spark, damage):
    """Nulls, empty and long texts, repeated rows and ids, a column named as one of the results."""
    rng = random.Random(1)
    data = [r for r in rows() if len(r[1] or "") < 40_000]
    data = data[:70] + [r for r in data[70:] if len((r[1] or "").split()) < 1000]
    data += [(1000 + k, " ".join(rng.choice("abc") for _ in range(rng.randrange(200))), "a", 0.0) for k in range(60)]
    data += [(2000 + k, "x " * 10 + "one two three " * 12 + "y y " * 15 + "end", "a", 0.0) for k in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, runs double")
    got = pr.run_digests(pr.find_runs(df, damage=damage)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(i, t, damage)) for i, t, *_ in data)


def test_text_keeps_one_period(spark):
    df = spark.createDataFrame([(1, "start " + "again and " * 14 + "again stop")], "doc_id long, text string")
    row = pr.find_runs(df).first()
    assert row.text == "start again and stop" and [tuple(r) for r in row.runs] == [(1, 29, 2)]


def test_no_rows(empty):
    assert pr.run_digests(pr.find_runs(empty)).count() == 0
