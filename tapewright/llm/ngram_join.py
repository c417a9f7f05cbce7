"""Documents linked by the Jaccard similarity of their word n-grams: exact, by partitioned signatures.

The universe of shingles is hashed into segments, as many as the distance that two linked sets of a size band can have
requires: then at least one segment of such a pair holds the same shingles, or, where a segment is indexed with its
one-deletion neighbourhood, differs by at most one. Per size band the allocation with the least expected cost is chosen, from the
band's number of sets; each set leaves out its least selective segments, for which as many further segments make up.

Sets that share a signature are candidates. For components, in each signature's group all are compared with the smallest; groups that
then still hold sets of several components are joined exactly in blocks. Links are verified on the whole sets. Equal sets are one
node from the start, and nodes in one component are not compared again, so no group is expanded into all its pairs. For
the links themselves (``ngram_links``) every pair of a group is joined in such blocks.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import LOWER, UPPER, longs, packed, per_batch, plain_text, rows_per_batch
from tapewright.llm.components import components
from tapewright.session import stage

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHARED = 0.1  # assumed chance that a shingle of one set is in another, for the expected cost of an allocation
CHUNK = 1 << 19  # bytes of text that are hashed at a time
MET = 1_000_000  # nodes that a task remembers, so as to give their rows once
FILTER_BITS = 1 << 25  # 4 MB, whatever the corpus
ROWS = 256  # of an Arrow batch: each holds up to two texts, or gives hundreds of signatures
BLOCK = 512  # sets that are joined with each other or with another block's at a time


ZERO = np.zeros(1, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


FACTORS = mixed(np.arange(1, 65, dtype=np.uint64) * M1) | np.uint64(1)
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * M2)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of some bytes, words being separated by ASCII white space."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    out = size.astype(np.uint64) * M2
    # A sum of bytes times fixed random factors, byte by byte for all words at once; the few long words one by one.
    long = np.flatnonzero(size > len(FACTORS))
    order = np.argsort(-size, kind="stable")[len(long) :]
    size_in_order = size[order]
    for k in range(int(size_in_order[0]) if len(order) else 0):
        these = order[: np.searchsorted(-size_in_order, -k, side="left")]
        out[these] += FACTORS[k] * VALUES[data[starts[these] + k]]
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return starts, mixed(out)


def _combined(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row."""
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed((out ^ h[i : i + n]) + M1)
    return out


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Per text the sorted 64-bit hashes of its distinct shingles; with fewer words the whole sequence is one; without words none."""
    raw = [t.encode().translate(LOWER_BYTES) for t in texts]
    out: list[np.ndarray] = []
    while len(out) < len(raw):
        part, size = [], 0
        while len(out) + len(part) < len(raw) and (not part or size + len(raw[len(out) + len(part)]) < CHUNK):
            part.append(raw[len(out) + len(part)])
            size += len(part[-1]) + 1
        starts, h = word_hashes(np.frombuffer(b"\n".join(part), np.uint8))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in part)])).tolist()
        every = _combined(h, width) if len(h) >= width else h[:0]
        for lo, hi in zip(cuts, cuts[1:]):
            n = hi - lo
            out.append(np.unique(every[lo : hi - width + 1]) if n >= width else _combined(h[lo:hi], n) if n else h[:0])
    return out


def node_of(hashes: np.ndarray) -> bytes:
    """96 bits that stand for a set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())[:12]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def band_tops(percent: int, largest: int) -> list[int]:
    """Largest size of each band; a set's partners that are not smaller lie in its band or the next."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, 100 * tops[-1] // percent))
    return tops


@dataclass(frozen=True)
class Allocation:
    exact: int  # segments indexed by their shingles
    near: int  # segments indexed by their shingles and all one-deletions
    left_out: int  # exact segments that each set may leave out


def distance(top: int, percent: int) -> int:
    """Most shingles by which two linked sets differ if the smaller has at most ``top``."""
    return (top + 100 * top // percent) * (100 - percent) // (100 + percent)


def allocate(top: int, percent: int, sets: int) -> Allocation:
    """The split of a band's required distance into exact and one-deletion segments of least expected cost.

    An exact segment that differs uses up one of the distance, one with a neighbourhood two. Cost: rows of the index, and pairs
    of unrelated sets that would meet.
    """
    need = distance(top, percent) + 1
    spare = need // 8
    best = None
    for near in range(0, min(need // 2, 8) + 1):
        a = Allocation(need + spare - 2 * near, near, spare)
        width = top / (a.exact + near)
        rows = sets * (a.exact - spare + near * (1 + width))
        meet = sets * sets / 2 * (a.exact * SHARED**width + near * width * SHARED ** max(width - 1, 0))
        if best is None or rows + meet < best[0]:
            best = rows + meet, a
    return best[1]


def signatures(hashes: np.ndarray, scheme: int, a: Allocation) -> np.ndarray:
    """64-bit signatures of one set under one band's allocation. Segments are equal ranges of the hash, which is sorted."""
    segments = a.exact + a.near
    bounds, tag = _segments(segments, scheme)
    parts = mixed(hashes + M1)
    total = np.zeros(len(parts) + 1, np.uint64)
    np.cumsum(parts, out=total[1:])
    ends = np.searchsorted(hashes, bounds)
    begins = np.concatenate([ZERO, ends[:-1]])
    sums = (total[ends] - total[begins]) ^ tag
    exact = sums[: a.exact]
    if a.left_out:  # those with the fewest shingles, which many sets share
        exact = exact[np.argsort((ends - begins)[: a.exact], kind="stable")[a.left_out :]]
    if not a.near:
        return mixed(exact)
    out = [exact, sums[a.exact :]]
    for k in range(a.exact, segments):
        out.append((total[ends[k]] - total[begins[k]] - parts[begins[k] : ends[k]]) ^ tag[k])
    return mixed(np.unique(np.concatenate(out)))


@lru_cache(4096)
def _segments(segments: int, scheme: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each segment ends, and what sets its signatures apart."""
    step = (1 << 64) // segments
    bounds = np.array([*(step * k for k in range(1, segments)), (1 << 64) - 1], np.uint64)
    return bounds, mixed(np.arange(segments, dtype=np.uint64) + np.uint64(scheme << 32) + M3)


def profiles(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, band and node (null without shingles) of every row."""

    def start():
        tops = band_tops(percent, 1)

        def work(cols):
            sets = shingle_sets(cols["text"], width)
            if (largest := max(map(len, sets))) > tops[-1]:
                tops[:] = band_tops(percent, 2 * largest)
            return {
                "doc_id": longs(cols["doc_id"]), "text_key": longs(cols["text_key"]), "n_shingles": longs([len(s) for s in sets]),
                "band": pa.array([bisect_left(tops, len(s)) for s in sets], pa.int32()), "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
            }

        return work

    text = plain_text(text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return per_batch(src, start, "doc_id long, text_key long, n_shingles long, band int, node binary")


def signature_rows(docs: DataFrame, plan: dict[int, Allocation], tops: list[int], width: int, text_col: str) -> DataFrame:
    """sig, node: a set's signatures under its own band's allocation and that of the band below. Copies in a task count once."""
    def start():
        met: set[bytes] = set()

        def work(cols):
            sigs, nodes = [np.empty(0, np.uint64)], []
            for s in shingle_sets(cols["text"], width):
                if not len(s) or (node := node_of(s)) in met:
                    continue
                if len(met) >= MET:
                    met.clear()
                met.add(node)
                band = bisect_left(tops, len(s))
                for k in (band, band - 1):
                    if k >= 0 and tops[k] in plan:
                        sigs.append(signatures(s, k, plan[tops[k]]))
                        nodes += [node] * len(sigs[-1])
            return {"sig": pa.array(np.concatenate(sigs).view(np.int64)), "node": pa.array(nodes, pa.binary())}

        return work

    return per_batch(docs.select(plain_text(text_col).alias("text")), start, "sig long, node binary")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (p, q) that are linked, by their whole sets."""

    def start():
        def work(cols):
            first = dict(zip(cols["p"], cols["p_text"]))  # a smallest set stands beside many others
            of = dict(zip(first, shingle_sets(list(first.values()), width)))
            keep = [(p, q) for p, q, b in zip(cols["p"], cols["q"], shingle_sets(cols["q_text"], width)) if linked(of[p], b, percent)]
            return {"p": pa.array([p for p, _ in keep], pa.binary()), "q": pa.array([q for _, q in keep], pa.binary())}

        return work

    q = texts.select(F.col("node").alias("q"), F.col("text").alias("q_text"))
    p = texts.select(F.col("node").alias("p"), F.col("text").alias("p_text"))
    return per_batch(pairs.join(q, "q").join(p, "p").select("p", "q", "p_text", "q_text"), start, "p binary, q binary")


def _block_links(left, right, percent: int, connecting: bool = True) -> list[tuple[bytes, bytes]]:
    """Links between two lists of (node, component, set), or within one, by the rarest shingles: all, or those that connect components."""
    own = left is right
    joined: dict[bytes, bytes] = {}  # components that links found here have joined

    def root(x):
        while (up := joined.get(x, x)) != x:
            x = up
        return x

    every = left if own else left + right
    values, counts = np.unique(np.concatenate([s for *_, s in every]), return_counts=True)
    index: dict[int, list[int]] = {}
    out = []

    def rare(s):
        at = np.searchsorted(values, s)
        first = len(s) - math.ceil(percent * len(s) / 100) + 1
        return at[np.lexsort((at, counts[at]))][:first].tolist()

    def probe(k, item, tokens):
        for j in {j for t in tokens for j in index.get(t, ())}:
            a, b = root(left[j][1]), root(item[1])
            if a != b and linked(left[j][2], item[2], percent):
                out.append((left[j][0], item[0]))
                if connecting:
                    joined[max(a, b)] = min(a, b)

    for k, item in enumerate(left):
        tokens = rare(item[2])
        if own:
            probe(k, item, tokens)
        for t in tokens:
            index.setdefault(t, []).append(k)
    if not own:
        for k, item in enumerate(right):
            probe(k, item, rare(item[2]))
    return out


def block_joined(groups: DataFrame, texts: DataFrame, width: int, percent: int, connecting: bool = True) -> DataFrame:
    """Links (p, q) between nodes of different components in each group, found in blocks of bounded size.

    ``connecting``: only links that join components which no link found before them has joined; otherwise all.
    groups: group, n (its nodes), node, root. A group of up to BLOCK nodes is one task's work; a larger one is dealt into blocks, and
    each pair of blocks is joined on its own. Sets meet by a shingle among the rarest that a link must share.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = groups.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root").join(texts, "node")

    def work(key, frame):
        import pandas as pd

        sets = shingle_sets(frame["text"].tolist(), width)
        items = [(m, (bytes(node), bytes(root), s)) for m, node, root, s in zip(frame["mine"], frame["node"], frame["root"], sets)]
        i, j = key[1], key[2]
        left = [x for m, x in items if m == i]
        found = _block_links(left, left if i == j else [x for m, x in items if m == j], percent, connecting) if left else []
        return pd.DataFrame({"p": [p for p, _ in found], "q": [q for _, q in found]}, dtype=object)

    return dealt.groupBy("group", "i", "j").applyInPandas(work, "p binary, q binary")


def candidates(docs: DataFrame, profile: DataFrame, width: int, percent: int, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that share a signature with others (sig, node, and pivot, the smallest of them), their sizes (node, n) and a text of each."""
    bands = profile.filter("node is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred at most
    tops = band_tops(percent, 1)
    while len(tops) <= max((r["band"] for r in bands), default=0):
        tops = band_tops(percent, 2 * tops[-1])
    sets = {r["band"]: r["n"] for r in bands}
    # A band whose distance is 0 links equal sets only, and those are one node already.
    plan = {tops[k]: allocate(tops[k], percent, sets.get(k, 0) + sets.get(k + 1, 0)) for k in range(len(tops)) if k in sets and distance(tops[k], percent) > 0}

    rows = signature_rows(docs, plan, tops, width, text_col)
    same = Window.partitionBy("sig")
    met = rows.withColumn("pivot", F.min("node").over(same)).withColumn("last", F.max("node").over(same)).filter("pivot < last").select("sig", "node", "pivot").distinct()
    met = stage(met, "ngram-met")

    nodes = profile.filter("node is not null").groupBy("node").agg(F.min("text_key").alias("text_key"), F.min("n_shingles").alias("n"))
    nodes = stage(nodes.join(met.select("node").distinct(), "node", "left_semi"), "ngram-nodes")
    text = plain_text(text_col)
    texts = _likely(docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")), nodes).join(nodes.select("node", "text_key"), "text_key").select("node", "text")
    texts = stage(_of_their_sets(texts, width).dropDuplicates(["node"]), "ngram-texts")
    return met, nodes.select("node", "n"), texts


def _of_like_sizes(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, q) whose sizes allow a link."""
    pairs = pairs.join(sizes.select(F.col("node").alias("p"), F.col("n").alias("np")), "p").join(sizes.select(F.col("node").alias("q"), F.col("n").alias("nq")), "q")
    return pairs.filter(100 * F.least("np", "nq") >= percent * F.greatest("np", "nq")).select("p", "q")


def every_link(docs: DataFrame, profile: DataFrame, width: int, percent: int, text_col: str) -> DataFrame:
    """All linked pairs of nodes (p, q), p being the smaller, each once.

    Nodes that share a signature with the same smallest one are a group; in it all are compared with all, in blocks. As many rows
    as there are links, so a family of n different near copies may give n * (n - 1) / 2.
    """
    met, sizes, texts = candidates(docs, profile, width, percent, text_col)
    groups = stage(met.select(F.col("pivot").alias("group"), "node").distinct(), "ngram-open")
    groups = groups.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group")
    pairs = _of_like_sizes(groups.filter("n = 2 and node <> group").select(F.col("group").alias("p"), F.col("node").alias("q")), sizes, percent)
    large = groups.filter("n > 2").select("group", "n", "node", F.col("node").alias("root"))
    found = verified(pairs, texts, width, percent).unionByName(block_joined(large, texts, width, percent, connecting=False))
    return stage(found.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), "ngram-links")


def node_links(docs: DataFrame, profile: DataFrame, width: int, percent: int, text_col: str) -> DataFrame:
    """Verified links (p, q) that connect all nodes which any links connect."""
    met, sizes, texts = candidates(docs, profile, width, percent, text_col)
    pairs = met.filter("node <> pivot").select(F.col("pivot").alias("p"), F.col("node").alias("q")).distinct()
    links = stage(verified(_of_like_sizes(pairs, sizes, percent), texts, width, percent), "ngram-links")
    roots = components(links)

    # Groups of two are settled; so are those within one component. Groups with the same smallest set become one, so that
    # a set is read once for it, whatever the number of signatures they share.
    rooted = met.join(roots, "node", "left").select("sig", "pivot", "node", F.coalesce("root", "node").alias("root"))
    unsettled = rooted.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("n > 2 and low < high").select("sig")
    rest = stage(rooted.join(unsettled, "sig", "left_semi").select(F.col("pivot").alias("group"), "node", "root").distinct(), "ngram-open")
    rest = rest.join(rest.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group")
    return links.unionByName(stage(block_joined(rest, texts, width, percent), "ngram-links"))


def _likely(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose key may be among the nodes', by a bitmap of FILTER_BITS; the join that follows decides.

    The bitmap keeps texts that nobody asks for out of the shuffle. Its size is fixed: with more nodes than bits it lets all through.
    """
    place = F.pmod("text_key", F.lit(FILTER_BITS))
    bits = nodes.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bit div 8 as int)") + 1, F.lit(1))), 16, 10).cast("int")
    held = texts.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", bit).join(F.broadcast(bits), "bucket")
    return held.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0).select("text_key", "text")


def _of_their_sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows whose text has the node's set; a key that two texts share leads to rows of both."""

    def start():

        def work(cols):
            keep = [(n, t) for n, t, s in zip(cols["node"], cols["text"], shingle_sets(cols["text"], width)) if node_of(s) == n]
            return {"node": pa.array([n for n, _ in keep], pa.binary()), "text": pa.array([t for _, t in keep], pa.string())}

        return work

    return per_batch(texts, start, "node binary, text string")


def ngram_components(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_key and root of every row of ``docs``.

    Words are separated by ASCII white space, after lower-casing A-Z. Two documents are linked when 100 times the shared shingles
    is at least ``percent`` times all of both; component_id is the smallest document id reachable by links. A document without
    words, or with a null text, has no shingles and its own id. Rows may repeat; null ids are passed over unless a
    component has no other. Ids need not tell components apart; root does, and is null without shingles. Shingles and sets are
    told apart by 64 and 96 bits of hash.
    """
    with rows_per_batch(docs.sparkSession, ROWS):
        profile = stage(profiles(docs, width, percent, id_col, text_col), "ngram-profile")
        links = node_links(docs, profile, width, percent, text_col)
    roots = components(links)
    some = profile.filter("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    some = stage(some.select("doc_id", "n_shingles", "text_key", "root"), "ngram-roots")
    ids = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = some.join(ids, "root").select("doc_id", "n_shingles", "component_id", "text_key", "root")
    return out.unionByName(profile.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.col("node").alias("root")))


def ngram_links(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs of different sets (p, q), each once, and the members of every set (doc_id, n_shingles, text_key, node).

    Two rows are linked if their nodes are a pair or the same; documents and links are those of ``ngram_components``. Rows without
    shingles have no node.
    """
    with rows_per_batch(docs.sparkSession, ROWS):
        profile = stage(profiles(docs, width, percent, id_col, text_col), "ngram-profile")
        links = every_link(docs, profile, width, percent, text_col)
    return links, profile.select("doc_id", "n_shingles", "text_key", "node")


def link_counts(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and n_links of every row: how many other rows of ``docs`` it is linked to, rows of equal sets included."""
    links, members = ngram_links(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
    some = members.filter("node is not null")
    rows = some.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    both = links.select(F.col("p").alias("node"), F.col("q").alias("other")).unionByName(links.select(F.col("q").alias("node"), F.col("p").alias("other")))
    others = both.join(rows.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.sum("n").alias("others"))
    of = stage(rows.join(others, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "ngram-counts")
    out = some.join(of, "node").select("doc_id", "n_shingles", "n_links")
    return out.unionByName(members.filter("node is null").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document with the smallest id of each component, with all their columns, whatever their names.

    Rows that share an id are told apart by their texts; rows that repeat both are one document. Rows with a null id stay only
    where a component has no other.
    """
    found = ngram_components(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
    some = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key")
    kept = some.unionByName(found.filter("n_shingles = 0").select("doc_id", "text_key").distinct())
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    rows = packed(docs, id=F.col(id_col), key=F.xxhash64(plain_text(text_col)))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi").select("row.*")
