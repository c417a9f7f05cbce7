"""Scores, rules and mixes against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import lm_scores, mixing, quality_rules, toxicity
from tests.llm.data import rows, text


def test_measures(docs):
    got = Counter()
    for r in quality_rules.ledger(docs).collect():
        got[(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed & 3)] += 1
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = (len(w) < 50) + 2 * (100 * len(hit) > 50 * len(w))
        want[(str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed)] += 1
    assert got == want


def test_policies_and_ablations(docs):
    led = quality_rules.ledger(docs).cache()
    failed = [r.failed for r in led.collect()]
    for policy in quality_rules.POLICIES.values():
        got = {r.rule: r for r in quality_rules.ablations(led, policy).collect()}
        for k, (name, _) in enumerate(quality_rules.RULES):
            if policy >> k & 1:
                r = got[name]
                assert r.n_failed == sum(f >> k & 1 for f in failed)
                assert r.n_only == sum(f & policy == 1 << k for f in failed)
                assert r.n_kept == sum(not f & policy for f in failed)
                assert r.n_kept_without == sum(not f & policy & ~(1 << k) for f in failed)
    assert quality_rules.judged(led).filter("kept_v2 and not kept_v1").count() == 0


def test_language_model(docs, spark):
    chosen = spark.createDataFrame([(k,) for k in (1, 4, 7, 65, 65)] + [(None,)], "doc_id long")
    models = []
    for pick in (lambda i: True, lambda i: i in (1, 4, 7, 65)):
        three, two, one, c2, c1 = Counter(), Counter(), Counter(), Counter(), Counter()
        for i, t, *_ in rows():
            if pick(i):
                b = b"\n\n" + (t or "").translate(lm_scores.LOWERED).encode()
                for k in range(2, len(b)):
                    three[b[k - 2 : k + 1]] += 1
                    two[b[k - 1 : k + 1]] += 1
                    one[b[k : k + 1]] += 1
                    c2[b[k - 2 : k]] += 1
                    c1[b[k - 1 : k]] += 1
        models.append((three, two, one, c2, c1))

    def loss(m, g):
        three, two, one, c2, c1 = m
        p1 = (one[g[2:]] + 1) / (sum(one.values()) + 256)
        p2 = two[g[1:]] / c1[g[1:2]] if c1[g[1:2]] else p1
        p3 = three[g] / c2[g[:2]] if c2[g[:2]] else p2
        return -math.log(0.6 * p3 + 0.3 * p2 + 0.1 * p1)

    want = []
    for i, t, *_ in rows():
        b = b"\n\n" + (t or "").translate(lm_scores.LOWERED).encode()
        d = [loss(models[1], b[k - 2 : k + 1]) - loss(models[0], b[k - 2 : k + 1]) for k in range(2, min(len(b), 4000))]
        if len(b) < 4000:
            want.append((str(i), len(b) - 2, sum(d) / len(d) if d else 0.0))
    got = [(str(r.doc_id), r.n_tokens, r.score) for r in lm_scores.score_documents(docs, chosen).collect() if r.n_tokens < 3998]
    for (i, n, s), (j, m, z) in zip(sorted(got), sorted(want)):
        assert (i, n) == (j, m) and s == pytest.approx(z, abs=1e-4)


def test_nearest_is_exact():
    rng = random.Random(3)
    vectors = []
    for _ in range(400):
        v = {rng.randrange(30): rng.random() for _ in range(rng.randrange(1, 6))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 30)
    for q in vectors[::7]:
        every = sorted((-round(sum(q[t] * v.get(t, 0) for t in q), 9), k) for k, v in enumerate(vectors))
        want = [(k, -s) for s, k in every if s < 0][:10]
        got = [(k, round(s, 9)) for k, s in index.nearest(q, 10)]
        assert [s for _, s in got] == pytest.approx([s for _, s in want])
        assert {k for k, s in got if s > want[-1][1] + 1e-9} == {k for k, s in want if s > want[-1][1] + 1e-9}


def test_toxicity_learns_words(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        docs.append((i, text(rng, 30).replace("idiot", "melon") + (" grumbleworth" * rng.randint(1, 2) if bad else ""), 1.0))
        labels.append((i, None, int(bad)))
    labels += [(None, 1, 1), (3, 1, None), (9999, 0, 1)]
    d = spark.createDataFrame([*docs, (None, None, 1.0), (501, "", 1.0), (502, None, 1.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = {r.doc_id: r for r in toxicity.scored(d, model).collect()}
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in labels[:500])
    assert got[0].neighbours and not got[501].neighbours
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == 403


def test_toxicity_without_examples(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {0.0}
    assert toxicity.scored(empty, toxicity.train(empty, none)).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, out, total = set(sizes), {}, sum(sizes.values())
    while True:  # plain resharing
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        full = {s for s in left if share[s] > most * sizes[s]}
        if not full:
            return out | share
        out |= {s: most * sizes[s] for s in full}
        left -= full
        if not left:
            return out


def test_mix(docs):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s, _ in rows():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
    assert len(got) == len(rows())
    assert all(abs(taken[s] - want[s]) <= max(largest[s], 1) for s in sizes)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_rows(docs, empty):
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    n = mixed.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert n == sum(r.taken for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(empty).count() == 0
    assert quality_rules.ledger(empty).count() == 0
    assert np.isfinite(lm_scores.losses(np.array([5]), np.array([0.0]))).all()
