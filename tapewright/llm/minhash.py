"""Near duplicates by MinHash sketches that fill in rounds, banding, and verification on the whole sets.

A sketch has one coordinate per bin. In each round every shingle of a set is hashed into one bin with a value; a bin keeps its least
(round, value). Rounds go on until each bin holds something, so a large set needs one or two rounds in all, not one hash per
coordinate; from round ``bins`` on, round bins + k puts every shingle into bin k, so no set leaves a bin empty. Two sets agree in a bin
with the probability of their Jaccard similarity, and, as bins of a round share shingles without replacement, the share of agreeing bins
is concentrated as if the bins were independent.

Sets that agree in all bins of a band are candidates. With r bins a band and b bands, a pair of similarity s meets with probability
1 - (1 - s^r)^b. The default, 4 bins in each of 32 bands, misses a pair of similarity 0.85 once in 10^10 and one of 0.8 once in 10^7
(tests measure it). Candidates are verified on their whole sets. Equal sets are one node from the start; the nodes of a band's group are
compared with its smallest, and groups that then still hold several components are joined exactly in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import longs, per_batch, plain_text, rows_per_batch
from tapewright.llm.components import components
from tapewright.llm.ngram_join import M1, M2, _likely, _of_like_sizes, _of_their_sets, block_joined, mixed, node_of, shingle_sets, verified
from tapewright.session import stage

BANDS, DEEP = 32, 4
ROWS = 256  # of an Arrow batch, which holds whole texts
MET = 1_000_000  # nodes that a task remembers, so as to sketch copies once
WAVE = 1 << 20  # shingles that are hashed at a time
SALTS = 8  # parts into which the rows of one key are dealt before a join


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` 64-bit coordinates per set of shingle hashes; sets must not be empty. The round stands in the top bits."""
    top = np.uint64(64 - int(2 * bins).bit_length())
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    open_sets = np.arange(len(sets))
    for r in range(2 * bins):
        left = []
        for lo, hi in _waves([len(sets[k]) for k in open_sets]):
            these = open_sets[lo:hi]
            sizes = [len(sets[k]) for k in these]
            x = np.concatenate([sets[k] for k in these])
            h = mixed(x ^ mixed(np.full(1, r + 1, np.uint64) * M1))
            place = (h % np.uint64(bins)).astype(np.int64) if r < bins else np.full(len(h), r - bins)
            value = (mixed(h * M2) >> (np.uint64(64) - top)) | (np.uint64(r) << top)
            np.minimum.at(flat, np.repeat(these, sizes) * bins + place, value)
            left.append(these[(out[these] == np.iinfo(np.uint64).max).any(axis=1)])
        open_sets = np.concatenate(left)
        if not len(open_sets):
            break
    return out


def _waves(sizes: list[int]) -> list[tuple[int, int]]:
    """Stretches of sets with about WAVE shingles in all."""
    out, lo, total = [], 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= WAVE or k == len(sizes) - 1:
            out.append((lo, k + 1))
            lo, total = k + 1, 0
    return out


def band_signatures(sketch: np.ndarray, bands: int, deep: int) -> np.ndarray:
    """One 64-bit signature per set and band: a hash of the band's number and its coordinates."""
    parts = sketch.reshape(len(sketch), bands, deep)
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * M2), (len(sketch), bands))
    for k in range(deep):
        out = mixed((out ^ parts[:, :, k]) + M1)
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of two sets' Jaccard similarity: the share of bins in which their sketches agree."""
    return float(np.mean(a == b))


def sketched(docs: DataFrame, *, width: int = 5, bands: int = BANDS, deep: int = DEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, node (null without shingles) and sigs of every row; a set's signatures once in each task."""

    def start():
        met: set[bytes] = set()

        def work(cols):
            sets = shingle_sets(cols["text"], width)
            nodes = [node_of(s) if len(s) else None for s in sets]
            if len(met) > MET:
                met.clear()
            new = []
            for k, node in enumerate(nodes):
                if node is not None and node not in met:
                    met.add(node)
                    new.append(k)
            sigs: list = [None] * len(sets)
            if new:
                for k, s in zip(new, band_signatures(sketches([sets[k] for k in new], bands * deep), bands, deep)):
                    sigs[k] = s.view(np.int64)
            return {
                "doc_id": longs(cols["doc_id"]), "text_key": longs(cols["text_key"]), "n_shingles": longs([len(s) for s in sets]),
                "node": pa.array(nodes, pa.binary()), "sigs": pa.array(sigs, pa.list_(pa.int64())),
            }

        return work

    text = plain_text(text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return per_batch(src, start, "doc_id long, text_key long, n_shingles long, node binary, sigs array<long>")


def dealt_join(rows: DataFrame, short: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to the one row per key of ``short``, which is repeated for each of SALTS parts; ``by`` deals a key's rows into them."""
    parts = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(parts, [key, "part"]).drop("part")


def meetings(profile: DataFrame) -> DataFrame:
    """sig, node, pivot: sets that share a band's signature with others, and the smallest of them.

    Smallest and largest come from partial sums; only signatures with two sets or more go back to the rows.
    """
    rows = profile.filter("sigs is not null").select("node", F.explode("sigs").alias("sig"))
    ends = rows.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last")
    return dealt_join(rows, ends.select("sig", "pivot"), "sig", "node").select("sig", "node", "pivot").distinct()


def node_texts(docs: DataFrame, nodes: DataFrame, width: int, text_col: str) -> DataFrame:
    """node, text: one text of each node (node, text_key)."""
    text = plain_text(text_col)
    likely = _likely(docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")), nodes)
    return _of_their_sets(likely.join(nodes.select("node", "text_key"), "text_key").select("node", "text"), width).dropDuplicates(["node"])


def connecting_links(docs: DataFrame, profile: DataFrame, width: int, percent: int, text_col: str) -> DataFrame:
    """Verified links (p, q) that connect all nodes which any candidate links connect."""
    met = stage(meetings(profile), "minhash-met")
    nodes = profile.filter("node is not null").groupBy("node").agg(F.min("text_key").alias("text_key"), F.min("n_shingles").alias("n"))
    nodes = stage(nodes.join(met.select("node").distinct(), "node", "left_semi"), "minhash-nodes")
    texts = stage(node_texts(docs, nodes, width, text_col), "minhash-texts")

    pairs = met.filter("node <> pivot").select(F.col("pivot").alias("p"), F.col("node").alias("q")).distinct()
    links = stage(verified(_of_like_sizes(pairs, nodes.select("node", "n"), percent), texts, width, percent), "minhash-links")
    rooted = met.join(components(links), "node", "left").select("sig", "pivot", "node", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "minhash-rooted")
    # Groups of two are settled, and so are those within one component. Groups with the same smallest set become one.
    unsettled = rooted.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("n > 2 and low < high").select("sig")
    rest = stage(rooted.join(unsettled, "sig", "left_semi").select(F.col("pivot").alias("group"), "node", "root").distinct(), "minhash-open")
    rest = rest.join(rest.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group")
    return links.unionByName(stage(block_joined(rest, texts, width, percent), "minhash-links"))


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, deep: int = DEEP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Words are separated by ASCII white space, after lower-casing A-Z. Two documents are linked when 100 times the shingles they share
    is at least ``percent`` times all of both; component_id is the smallest document id reachable by links, and the rows of
    that id are kept. A document with fewer words than ``width`` has them all as its one shingle. One without words, or with a null
    text, has no shingles, its own id, and is kept. Rows may repeat: those with the smallest id are all kept. Null ids are passed
    over unless a component has no other. An empty table gives no rows; other columns are not read.
    """
    with rows_per_batch(docs.sparkSession, ROWS):
        profile = stage(sketched(docs, width=width, bands=bands, deep=deep, id_col=id_col, text_col=text_col), "minhash-profile")
        links = stage(connecting_links(docs, profile, width, percent, text_col), "minhash-all-links")
    roots = components(links)
    some = profile.filter("node is not null").select("doc_id", "n_shingles", "node")
    known = some.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    some = stage(dealt_join(some, known, "node", "doc_id"), "minhash-roots")
    ids = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = dealt_join(some, ids, "root", "doc_id").select("doc_id", "n_shingles", "component_id")
    none = profile.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
