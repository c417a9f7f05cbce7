"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are short runs of letters inside words. Labelled examples choose those that tell the labels apart; how many documents hold a
term is counted over the whole corpus. Examples lie in blocks; each term knows its largest weight in each block, so a block whose
bound is below the k-th best similarity found so far is passed over and the k nearest are still exact. Neighbours vote by
similarity, and the votes of the examples on each other give the map from votes to scores.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.bpe import built
from tapewright.llm.common import longs, per_batch, plain_text
from tapewright.session import stage

# Bounds of what is fitted: labelled examples (those of smallest id hash) and terms (those of largest chi square).
MOST_EXAMPLES = 20_000
MOST_TERMS = 2_000
LEAST_CHI2 = 40.0
LEAST_EXAMPLES = 4  # that hold a term
RUNS = (4, 5, 6)  # letters of a term
NEIGHBOURS = 15
PRIOR = 0.25  # similarity that the general share of label 1 counts as
BLOCK = 64  # examples of a block
FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def runs(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(text.lower().split()):
        for k in RUNS:
            out.update(word[i : i + k] for i in range(len(word) - k + 1))
    return out


def longest_runs(counts: dict[str, tuple[int, int]]) -> list[str]:
    """The runs, without those inside a longer one that has the same counts and so says the same."""
    same = {part for run, n in counts.items() for part in (run[1:], run[:-1]) if counts.get(part) == n}
    return sorted(counts.keys() - same)


def terms_of(automaton, text: str) -> dict[int, int]:
    """How often each chosen term is in a text."""
    return Counter(n for _, n in automaton.iter(text.lower()))


def automaton_of(terms: list[str]):
    a = ahocorasick.Automaton()
    for n, t in enumerate(terms):
        a.add_word(t, n)
    if terms:
        a.make_automaton()
    return a


class BlockMaxIndex:
    """Unit vectors in blocks of BLOCK, by term; ``nearest`` gives the exact k largest cosines."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.size = len(vectors)
        blocks = -(-self.size // BLOCK)
        self.largest = np.zeros((n_terms, blocks), np.float32)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for n, v in enumerate(vectors):
            for t, w in v.items():
                postings[t].append((n, w))
                self.largest[t, n // BLOCK] = max(self.largest[t, n // BLOCK], w)
        self.docs = [np.array([n for n, _ in p], np.int64) for p in postings]
        self.weights = [np.array([w for _, w in p]) for p in postings]
        self.starts = [np.searchsorted(d, np.arange(blocks + 1) * BLOCK) for d in self.docs]

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[int, float]]:
        """(example, cosine), nearest first; of equal cosines the smaller number. Only cosines above 0."""
        terms = sorted(query)
        weights = np.array([query[t] for t in terms])
        bounds = (self.largest[terms] * weights[:, None]).sum(0) * (1 + 1e-6)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == k and bounds[b] < -best[-1][0]:
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(terms, weights):
                lo, hi = self.starts[t][b], self.starts[t][b + 1]
                scores[self.docs[t][lo:hi] - b * BLOCK] += w * self.weights[t][lo:hi]
            hit = np.flatnonzero(scores > 0)
            best = sorted(best + [(-round(float(scores[i]), 12), int(b) * BLOCK + int(i)) for i in hit])[:k]
        return [(n, -s) for s, n in best]


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    ids: list[int]
    labels: list[int]
    index: BlockMaxIndex
    share: float  # of label 1 among all examples
    bare: float  # of label 1 among examples without a term
    steps: tuple[list[float], list[float]]  # votes from which a score holds

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: float(w / norm) for t, w in v.items()}

    def vote(self, found: list[tuple[int, float]]) -> float:
        return (PRIOR * self.share + sum(s * self.labels[n] for n, s in found)) / (PRIOR + sum(s for _, s in found))

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[int, float]]]:
        if not counts:
            return self.bare, []
        found = self.index.nearest(self.vector(counts), NEIGHBOURS) if self.index.size else []
        if not found:
            return self.bare, []
        at, values = self.steps
        return values[max(0, bisect_right(at, self.vote(found)) - 1)], [(self.ids[n], s) for n, s in found]


def rising(votes: list[float], labels: list[int]) -> tuple[list[float], list[float]]:
    """Shares of label 1 that never fall with the vote: neighbours out of order are pooled. Smoothed by half a case each way."""
    pools: list[list[float]] = []
    for v, y in sorted(zip(votes, labels)):
        pools.append([v, y, 1])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            v1, y1, n1 = pools.pop()
            pools[-1][1] += y1
            pools[-1][2] += n1
    return [p[0] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]


def fit(rows: list[tuple[int, int, dict[int, int]]], terms: list[str], idf: np.ndarray) -> Model:
    """rows: (id, label, term counts) of the examples, in order of id."""
    bare = [y for _, y, c in rows if not c]
    # Examples with the same rarest terms lie together, so that few blocks can hold a document's neighbours.
    kept = sorted((r for r in rows if r[2]), key=lambda r: (sorted(r[2], key=lambda t: (-idf[t], t)), r[0]))
    model = Model(terms, idf, [r[0] for r in kept], [r[1] for r in kept], BlockMaxIndex([], 0), 0.0, 0.0, ([0.0], [0.0]))
    vectors = [model.vector(r[2]) for r in kept]
    model.index = BlockMaxIndex(vectors, len(terms))
    model.share = sum(r[1] for r in rows) / max(1, len(rows))
    model.bare = (sum(bare) + model.share) / (len(bare) + 1)
    # Each example is judged by the others.
    votes = [model.vote([x for x in model.index.nearest(v, NEIGHBOURS + 1) if x[0] != n][:NEIGHBOURS]) for n, v in enumerate(vectors)]
    if votes:
        model.steps = rising(votes, model.labels)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_EXAMPLES) -> Model:
    """A model of at most ``most`` labelled rows; term frequencies are counted over all of ``docs``.

    Rows without an id or label, and held-out rows, are not learned from; an id with several labels has the largest. Without
    examples every score is 0.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the bound that makes the broadcast small
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    examples = stage(text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-examples")

    def count_runs(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run in runs(t):
                    c = counts.get(run)
                    if c is None:
                        c = counts[run] = [0, 0]
                    c[y > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), longs([c[0] for c in counts.values()]), longs([c[1] for c in counts.values()])], ["run", "n0", "n1"])

    totals = examples.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("y")).first()
    n, y = totals["n"], totals["y"]
    terms: list[str] = []
    if 0 < y < n:
        each = examples.select("text", "label").mapInArrow(count_runs, "run string, n0 long, n1 long").groupBy("run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        # Chi square of the 2 x 2 table of term and label; only terms most of whose examples have label 1.
        held = F.col("n0") + F.col("n1")
        gap = F.col("n1") * F.lit(float(n)) - held * F.lit(float(y))
        chi2 = gap * gap * F.lit(float(n)) / (held * (F.lit(float(n)) - held) * F.lit(float(y)) * F.lit(float(n - y)))
        best = each.filter((held >= LEAST_EXAMPLES) & (held < n) & (2 * F.col("n1") >= held)).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
        terms = longest_runs({r["run"]: (r["n0"], r["n1"]) for r in best.orderBy(F.desc("chi2"), "run").limit(MOST_TERMS).collect()})

    def count_held(batches):
        automaton = automaton_of(terms)
        held, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rows += 1
                if terms:
                    for k in terms_of(automaton, t):
                        held[k] += 1
        yield pa.RecordBatch.from_arrays([longs([-1, *range(len(terms))]), longs([rows, *held.tolist()])], ["term", "n"])

    counted = dict(text.select("text").mapInArrow(count_held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row for each term
    idf = np.array([math.log((1 + counted.get(-1, 0)) / (1 + counted.get(k, 0))) + 1 for k in range(len(terms))])

    def example_terms(batches):
        automaton = automaton_of(terms)
        for batch in batches:
            counts = [terms_of(automaton, t) if terms else {} for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(c) for c in counts], pa.list_(pa.int64())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                ["doc_id", "label", "terms", "counts"],
            )

    seen = examples.select("doc_id", "text", "label").mapInArrow(example_terms, "doc_id long, label int, terms array<long>, counts array<long>").collect()
    return fit(sorted((r["doc_id"], int(r["label"] > 0), dict(zip(r["terms"], r["counts"]))) for r in seen), terms, idf)


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, neighbours and similarities of every row, and its text_key.

    Scores are between 0 and 1. Texts without any of the terms, null and empty ones among them, score as the examples without terms.
    Neighbours are the evidence: ids of the nearest examples, nearest first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = uuid.uuid4().hex

    def start():
        m, automaton = built(f"toxicity {own}", lambda: (sent.value, automaton_of(sent.value.terms)))
        memo: dict[tuple, tuple] = {}

        def work(cols):
            out = []
            for t in cols["text"]:
                counts = terms_of(automaton, t) if m.terms else {}
                key = tuple(sorted(counts.items()))
                if key not in memo:
                    if len(memo) >= 50_000:
                        memo.clear()
                    memo[key] = m.score(counts)
                out.append(memo[key])
            return {
                "doc_id": longs(cols["doc_id"]), "text_key": longs(cols["text_key"]), "score": pa.array([s for s, _ in out], pa.float64()),
                "neighbours": pa.array([[n for n, _ in f] for _, f in out], pa.list_(pa.int64())),
                "similarities": pa.array([[s for _, s in f] for _, f in out], pa.list_(pa.float64())),
            }

        return work

    text = plain_text(text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return per_batch(src, start, "doc_id long, text_key long, score double, neighbours array<long>, similarities array<double>")


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = uuid.uuid4().hex

    def run(batches):
        m, automaton = built(f"toxicity {own}", lambda: (sent.value, automaton_of(sent.value.terms)))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            keep = [m.score(terms_of(automaton, t) if m.terms and t else {})[0] < threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
