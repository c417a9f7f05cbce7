"""Periodic runs of words in a text, by recursive frequency splitting and a lag scan.

A run is a stretch of words that repeats with a smallest period q over at least ``times`` periods and ``least`` words, and that no
neighbouring word extends. Each of its words therefore occurs ``times`` times inside it. Words that are rarer than that in a segment
cannot belong to a run of it, so they split it; what is left is counted anew, until no word is too rare. Ordinary prose falls
apart within a few rounds.

What survives is scanned lag by lag. At lag p a run shows as at least ``max(least - p, (times - 1) * p)`` positions in a row that
equal the one p further on, so it is enough to look at positions that far apart: all lags of n words together cost about
n * log(n) looks. A look compares hashes of a few words; hits are extended word by word, so the result rests on no hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import longs, per_batch, plain_text, strings

LEAST, TIMES = 24, 3
LOOK = 8  # words that a look compares at once, at most
FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def word_numbers(words: list[bytes]) -> np.ndarray:
    """The same number for the same word, in the order of first occurrence."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least ``least`` words in which every word occurs ``times`` times or more."""
    todo, done = [(0, len(ids))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        _, at, counts = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[at] < times)
        if not len(rare):
            done.append((lo, hi))
            continue
        edges = np.concatenate([[-1], rare, [hi - lo]])
        wide = np.flatnonzero(np.diff(edges) > least)
        todo += [(lo + int(edges[k]) + 1, lo + int(edges[k + 1])) for k in wide]
    return sorted(done)


def _stretch(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest [start, end) around ``at`` in which x equals itself ``lag`` further on."""
    n = len(x) - lag
    end, step = at, 64
    while end < n:
        off = np.flatnonzero(x[end : min(end + step, n)] != x[end + lag : min(end + step, n) + lag])
        if len(off):
            end += int(off[0])
            break
        end, step = min(end + step, n), 4 * step
    start, step = at, 64
    while start > 0:
        low = max(start - step, 0)
        off = np.flatnonzero(x[low:start] != x[low + lag : start + lag])
        if len(off):
            start = low + int(off[-1]) + 1
            break
        start, step = low, 4 * step
    return start, end


def lag_scan(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of one segment, by period.

    A stretch that has found runs' period as a divisor of the lag is that run again and is passed over.
    """
    look = min([LOOK, *(max(least - p, (times - 1) * p) for p in range(1, least + 1))])
    if len(x) < max(least, look):
        return []
    h = np.zeros(len(x) - look + 1, np.uint64)
    for k in range(look):
        h = (h ^ x[k : k + len(h)].astype(np.uint64)) * FACTOR
        h ^= h >> np.uint64(29)
    found: list[Run] = []
    for lag in range(1, len(x) // times + 1):
        step = max(least - lag, (times - 1) * lag) - look + 1
        last = len(h) - lag
        if last <= 0:
            break
        hits = np.flatnonzero(h[0:last:step] == h[lag : lag + last : step]) * step
        if not len(hits):
            continue
        for s, n, q in found:
            if lag % q == 0:
                hits = hits[(hits < s) | (hits + lag + look > s + n)]
        upto = -1
        for at in hits.tolist():
            if at < upto:
                continue
            start, upto = _stretch(x, at, lag)
            size = upto - start + lag
            if size >= max(least, times * lag) and not any(s == start and n == size for s, n, _ in found):
                found.append((start, size, lag))
    return found


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    return sorted(((lo + s, n, q) for lo, hi in segments(ids, least, times) for s, n, q in lag_scan(ids[lo:hi], least, times)), key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period."""
    keep = np.ones(n, bool)
    for start, size, q in runs:
        keep[start + q : start + size] = False
    return keep


def repeated_tail(words: list[bytes], crc: int) -> list[bytes]:
    """The contract's damage: the words of one document in ten repeat from some word on."""
    g, n = crc // 10, len(words)
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES, damage: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length, period) and text, in which every run keeps one period.

    Words are separated by ASCII white space and compared as they are; ``text`` joins the kept ones by one space. Null texts count
    as empty: no words, no runs, an empty text. ``damage`` first repeats the tails of one document in ten by the CRC-32 of its
    id as text (a null id: of the empty text), to have runs to find. Each row stands alone, so repeated rows and ids give equal
    rows; other columns are neither read nor returned. An empty table gives no rows. A task holds a slice of texts
    at a time, of one text when it is a long one.
    """

    def start():
        def work(cols):
            n, runs, texts = [], [], []
            for crc, t in zip(cols["crc"], cols["text"]):
                words = t.encode().split()
                if damage:
                    words = repeated_tail(words, crc)
                ids = word_numbers(words)
                mine = runs_of(ids, least, times)
                n.append(len(words))
                runs.append([{"start": s, "length": size, "period": q} for s, size, q in mine])
                if mine:
                    words = [words[k] for k in np.flatnonzero(collapsed(len(words), mine)).tolist()]
                texts.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            return {"doc_id": longs(cols["doc_id"]), "n_words": longs(n), "runs": pa.array(runs, kind), "text": strings(texts)}

        return work

    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), crc.alias("crc"), plain_text(text_col).alias("text"))
    return per_batch(src, start, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns: number of runs, the strongest run, and digests of all runs and of the collapsed text.

    The strongest has the greatest length / period, compared in whole numbers; of equal ones the first, then the shorter period.
    """
    best = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a),
    )
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
