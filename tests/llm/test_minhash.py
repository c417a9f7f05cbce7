"""Sketches against the similarities they stand for, and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tapewright.llm import minhash
from tests.llm.data import SCHEMA
from tests.llm.test_copies import brute, rows, sets_of


def pairs_of(rng, n, differ, count):
    """Sets that share n - differ of n shingles."""
    out = []
    for _ in range(count):
        u = rng.integers(0, 2**63, n).astype(np.uint64)
        out.append((np.unique(u[: n - differ // 2]), np.unique(u[differ - differ // 2 :])))
    return out


def test_every_bin_is_filled():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 1, 2, 5, 60, 3000)]
    s = minhash.sketches(sets, 128)
    assert (s != np.iinfo(np.uint64).max).all()
    again = minhash.sketches(sets[::-1], 128)[::-1]
    assert (s == again).all()  # a set's sketch does not depend on its neighbours
    rounds = (s >> np.uint64(64 - int(256).bit_length())).max(axis=1)
    assert rounds[5] <= 1 and rounds[0] >= 128  # many shingles fill in the first rounds, a single one in the last


@pytest.mark.parametrize("n", [7, 20, 100, 1000])
def test_agreement_is_concentrated_and_bands_miss_nothing(n):
    differ = max(1, int(n * 0.15))
    pairs = pairs_of(np.random.default_rng(n), n, differ, 600)
    a, b = minhash.sketches([p for p, _ in pairs], 128), minhash.sketches([q for _, q in pairs], 128)
    share = (a == b).mean(axis=1)
    true = (n - differ) / n
    assert abs(share.mean() - true) < 0.01
    assert share.std() < 1.15 * (true * (1 - true) / 128) ** 0.5  # at most that of independent bins
    assert minhash.agreement(a[0], b[0]) == share[0]
    same = minhash.band_signatures(a, 32, 4) == minhash.band_signatures(b, 32, 4)
    assert same.any(axis=1).all() and same.sum(axis=1).mean() > 12


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (1, 50)])
def test_components_by_brute_force(docs, width, percent):
    sets = sets_of(width)
    options = {"bands": 64, "deep": 2} if percent == 50 else {}
    got = minhash.near_duplicates(docs, width=width, percent=percent, **options).collect()
    want = [(i, len(s), c, i == c) for (i, s), c in zip(sets, brute(sets, percent))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_chain_and_large_group(spark):
    """A chain whose ends are far apart, and many near copies of one text of which not all are linked to the smallest."""
    words = [f"w{k}" for k in range(120)]
    data = [(k, " ".join(words[k : k + 100])) for k in range(0, 20, 2)]
    base = [f"v{k}" for k in range(60)]
    for k in range(150):
        w = list(base)
        w[k % 60] = f"n{k}"
        w[(7 * k + 3) % 60] = f"m{k}"
        data.append((1000 + k, " ".join(w)))
    sets = [(i, {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}) for i, t in data]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), width=3, percent=80).collect()}
    assert got == {i: c for (i, _), c in zip(sets, brute(sets, 80))}
    assert set(got[k] for k in range(0, 20, 2)) == {0}


def test_clashing_columns_and_no_rows(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    names = ["doc_id", "text", "node", "sigs", "root", "part", "kept", "text_key"]
    df = spark.createDataFrame([(1, "a b c", *"xxxxxx"), (2, "a b c", *"xxxxxx")], names)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    only_null = spark.createDataFrame([(None, None, None, None)] * 2, SCHEMA)
    assert [tuple(r) for r in minhash.near_duplicates(only_null).collect()] == [(None, 0, None, True)] * 2
