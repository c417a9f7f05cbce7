"""Cross-entropy difference: two n-gram models over the same vocabulary of bytes score every document.

Both models are interpolated byte trigrams, counted over all rows: the background over every document, the target over the
chosen ones. Their per-token losses differ by one number for each trigram, so a document's score is the mean of these numbers
over its bytes. The table of trigrams has at most 256 to the third entries, whatever the corpus; only counts grow.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.bpe import built
from tapewright.llm.common import LOWERED, longs, per_batch, plain_text
from tapewright.session import stage

SIZE = 1 << 24
START = b"\n\n"  # what stands before the first byte
WEIGHTS = (0.6, 0.3, 0.1)  # of the trigram, bigram and unigram estimate


def trigrams(text: str) -> np.ndarray:
    """One number below SIZE for each byte of the text after lower-casing A-Z: the byte and the two before it."""
    b = np.frombuffer(START + text.translate(LOWERED).encode(), np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def trigram_counts(docs: DataFrame, target: str = "is_target") -> DataFrame:
    """key, background, target: counts over all rows of ``docs`` (text, is_target). Each task adds up its own rows first."""

    def run(batches):
        counts = np.zeros((2, SIZE), np.int32)
        seen = np.zeros(2, np.int64)

        def flush():
            keys = np.flatnonzero(counts[0])
            out = pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(counts[0][keys].astype(np.int64)), pa.array(counts[1][keys].astype(np.int64))], ["key", "background", "target"])
            counts[:] = 0
            seen[:] = 0
            return out

        def add(k, keys):
            at, n = np.unique(keys, return_counts=True)
            counts[k][at] += n.astype(np.int32)
            seen[k] += len(keys)

        for batch in batches:
            texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held = []
            size = 0
            for text, flag in zip(texts, flags):
                keys = trigrams(text)
                held.append((keys, flag))
                size += len(keys)
                if size > 4_000_000:
                    _add_all(held, add)
                    held, size = [], 0
                    if seen[0] > 1 << 30:  # before a count could leave 32 bits
                        yield flush()
            _add_all(held, add)
        if seen[0]:
            yield flush()

    return docs.select("text", target).mapInArrow(run, "key int, background long, target long").groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def _add_all(held, add) -> None:
    if held:
        add(0, np.concatenate([k for k, _ in held]))
        chosen = [k for k, f in held if f]
        if chosen:
            add(1, np.concatenate(chosen))


def losses(keys: np.ndarray, counts: np.ndarray, weights=WEIGHTS) -> np.ndarray:
    """Negative log probability of the last byte of each key's trigram, of a model with these counts; 256 kinds of bytes."""
    by3 = np.zeros(SIZE)
    by3[keys] = counts
    by2 = by3.reshape(256, 65536).sum(0)  # by the last two bytes
    by1 = by2.reshape(256, 256).sum(0)
    ctx2 = by3.reshape(65536, 256).sum(1)  # of the two bytes before
    ctx1 = by2.reshape(256, 256).sum(1)
    p1 = (by1 + 1) / (by1.sum() + 256)
    one, two = keys & 255, keys & 65535
    w3, w2, w1 = weights
    a, b = ctx2[keys >> 8], ctx1[two >> 8]
    # Without a context the next shorter estimate takes its weight.
    p = w1 * p1[one]
    lower = np.where(b > 0, by2[two] / np.maximum(b, 1), p1[one])
    p += w2 * lower
    p += w3 * np.where(a > 0, by3[keys] / np.maximum(a, 1), lower)
    return -np.log(p)


def loss_difference(rows) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams in order and target loss minus background loss of each."""
    keys = np.array([r[0] for r in rows], np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    background, target = (np.array([r[k] for r in rows], np.float64)[order] for k in (1, 2))
    return keys, (losses(keys, target) - losses(keys, background)).astype(np.float32)


def score_documents(docs: DataFrame, chosen: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chosen_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens (bytes), score and loss sums of every row; lower scores are more like the chosen documents.

    ``chosen`` lists the target documents' ids; repeated and null ids there count once or not at all. Null counts as empty, which
    has no tokens and score 0. Without target documents the target model is uniform. An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    ids = chosen.select(F.col(chosen_id).cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    # Always by sort and merge, as for lists of any length: a list that is just small enough would be broadcast.
    counted = stage(trigram_counts(src.join(ids.hint("merge"), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))), "lm-counts")
    # At most 256 ** 3 rows by construction.
    keys, values = loss_difference(counted.toPandas().to_numpy().tolist())
    model = docs.sparkSession.sparkContext.broadcast((keys, values))
    own = uuid.uuid4().hex

    def start():
        def dense():
            table = np.zeros(SIZE, np.float32)
            table[model.value[0]] = model.value[1]
            return table

        table = built(f"lm {own}", dense)

        def work(cols):
            per = [table[trigrams(t)] for t in cols["text"]]
            n = [len(x) for x in per]
            total = [float(x.sum(dtype=np.float64)) for x in per]
            return {"doc_id": longs(cols["doc_id"]), "n_tokens": longs(n), "loss_difference": pa.array(total, pa.float64()), "score": pa.array([t / m if m else 0.0 for t, m in zip(total, n)], pa.float64())}

        return work

    return per_batch(src, start, "doc_id long, n_tokens long, loss_difference double, score double")
