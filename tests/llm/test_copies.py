"""Exact copies and linked documents against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tapewright.llm import exact_dedup, mixing, ngram_join
from tapewright.llm.common import LOWERED
from tests.llm.data import rows


def norm(text):
    return (text or "").translate(LOWERED)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7}, {"block_bytes": 64, "hash_bits": 3}])
def test_exact_duplicates(docs, options):
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(norm(t), []).append(i)
    got = exact_dedup.exact_duplicates(docs, **options).collect()
    assert len(got) == len(rows())
    want = sorted(
        (str(i), str(max((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows()
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_names_do_not_rest_on_hashes(spark):
    texts = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_duplicates(df, block_bytes=1, hash_bits=1)
    assert [tuple(r) for r in got.groupBy("group_size").count().collect()] == [(2, 128)]


def test_keep_one_has_all_columns(docs):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({norm(t) for _, t, *_ in rows()})


def test_no_rows(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.keep_one(empty).count() == 0
    assert ngram_join.ngram_components(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def sets_of(width):
    out = []
    for i, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", norm(t))
        out.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def brute(sets, percent):
    """Smallest id of each row's component."""
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(sets):
        ids.setdefault(find(k), []).append(i)
    return [min((x for x in ids[find(k)] if x is not None), default=None) for k in range(len(sets))]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 60)])
def test_components(docs, width, percent):
    sets = sets_of(width)
    want = sorted((str(i), len(s), str(c)) for (i, s), c in zip(sets, brute(sets, percent)))
    got = ngram_join.ngram_components(docs, width=width, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("near", [0, 1, 3])
def test_allocations_lose_no_pair(near):
    import numpy as np

    rng = np.random.default_rng(near)
    for _ in range(200):
        top = int(rng.integers(20, 80))
        need = ngram_join.distance(top, 85) + 1
        spare = need // 8
        if need + spare - 2 * near <= spare:
            continue
        a = ngram_join.Allocation(need + spare - 2 * near, near, spare)
        small = np.unique(rng.integers(0, 1 << 63, top).astype(np.uint64))
        changes = int(rng.integers(0, need))  # any pair within the distance must share a signature
        gone = int(rng.integers(0, changes + 1))
        other = np.unique(np.concatenate([small[gone:], rng.integers(0, 1 << 63, changes - gone).astype(np.uint64)]))
        assert len(np.intersect1d(ngram_join.signatures(small, 3, a), ngram_join.signatures(other, 3, a)))


def test_crowded_bands_use_deletions():
    assert ngram_join.allocate(40, 85, 1000).near == 0
    assert ngram_join.allocate(40, 85, 10**9).near > 0


def test_large_groups_are_joined_in_blocks(spark, monkeypatch):
    """Chains of sets around one passage; blocks of four."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"t{g}x{k}" for k in range(18 - v)] + [f"u{g}v{v}x{k}" for k in range(v)]) for g in range(12) for v in (0, 2, 6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [(i, {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)}) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(sets, 85)


def test_keep_one_keeps_the_smallest(docs):
    kept = ngram_join.keep_one(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 60 in ids and not {61, 67, 70, 72} & set(ids)
    assert {73, 74, 75} <= set(ids)  # without words, or alone


def test_keep_one_keeps_one_of_each_component(spark, docs):
    """Components are told apart even where their smallest ids are equal or null."""
    texts = [r.text for r in ngram_join.keep_one(docs, width=5, percent=80).filter("doc_id = 77").collect()]
    assert sorted(texts) == ["other row", "same row", "same row"]  # the repeated row is one document
    near = " ".join(f"w{k}" for k in range(60))
    rest = [(None, "one text"), (None, "another text"), (None, near), (5, near + " end"), (None, "pair"), (None, "PAIR"), (None, "")]
    kept = ngram_join.keep_one(spark.createDataFrame(rest, "doc_id long, text string"), width=5, percent=80).collect()
    got = sorted((str(r.doc_id), r.text.lower()) for r in kept)
    assert got == sorted([("None", "one text"), ("None", "another text"), ("5", near + " end"), ("None", "pair"), ("None", "")])


def all_pairs(sets, percent):
    return [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])]


def test_all_links_are_counted(docs):
    sets = sets_of(4)
    n = [0] * len(sets)
    for a, b in all_pairs(sets, 85):
        n[a] += 1
        n[b] += 1
    got = ngram_join.link_counts(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in got) == sorted((str(i), len(s), k) for (i, s), k in zip(sets, n))


def test_all_links_in_a_family(spark, monkeypatch):
    """Thirty different near copies, in blocks of four: each pair that is linked is listed once."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = [" ".join(f"u{g}x{k}" if k < 2 * (g % 5) else f"p{k}" for k in range(80)) for g in range(30)]
    sets = [(i, {tuple(t.split()[k : k + 4]) for k in range(77)}) for i, t in enumerate(texts)]
    links, members = ngram_join.ngram_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = {}
    for r in members.collect():
        ids.setdefault(bytes(r.node), []).append(r.doc_id)
    got = sorted(tuple(sorted((i, j), reverse=True)) for r in links.collect() for i in ids[bytes(r.p)] for j in ids[bytes(r.q)])
    got += [(i, j) for same in ids.values() for i in same for j in same if j < i]
    assert sorted(got) == sorted(all_pairs(sets, 85)) and len(got) > 100


@pytest.mark.parametrize("keep", [mixing.take_mix, exact_dedup.keep_one, ngram_join.keep_one])
def test_any_column_names_stay(spark, keep):
    """Columns that bear names of the operators' own come back with their values."""
    names = ["row", "id", "key", "sha", "hash", "copies", "copy", "target", "source_size", "_source", "_hash", "_sha", "_kept_id", "kept_id", "kept_sha", "_kept_sha", "_key", "kept_key", "a.b"]
    docs = [(k, f"one two three four five six {k // 2} seven", "s") for k in range(8)] + [(None, None, None), (3, "", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    more = df.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("text"), F.lit("-"))).alias(n) for n in names])
    got = keep(more)
    assert got.columns == more.columns
    rows = got.collect()
    assert rows and all(r[k + 3] == n + (r[1] if r[1] is not None else "-") for r in rows for k, n in enumerate(names))
    assert sorted(map(repr, (r[:3] for r in rows))) == sorted(map(repr, (tuple(r) for r in keep(df).collect())))


def test_repeated_rows_stay_by_their_columns(spark):
    """Of rows that repeat id and text the same one stays, in whichever order and partitions they come."""
    docs = [(1, "same", f"v{k}") for k in range(9)] + [(2, "other", "w")]
    for parts in (1, 5):
        df = spark.createDataFrame(docs[::-1] if parts == 5 else docs, "doc_id long, text string, more string").repartition(parts)
        assert sorted(map(tuple, exact_dedup.keep_one(df).collect())) == [(1, "same", "v0"), (2, "other", "w")]
