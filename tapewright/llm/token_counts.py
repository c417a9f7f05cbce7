"""Exact token counts of every prefix by dynamic programming, so that limits and budgets need no second encoding.

A list of tokens is what byte pair encoding gives if and only if each two neighbours are what it gives for their bytes. So
the last token of each prefix follows from the last tokens of shorter ones: it is the vocabulary's token that ends there and
goes together with the last token of what comes before. One more than that prefix's count is the count.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.bpe import MEMO_ENTRIES, Vocabulary, built, from_json, rank_lines
from tapewright.llm.common import longs, per_batch, plain_text


class PrefixCounter:
    def __init__(self, vocabulary: Vocabulary, pattern: str, special: tuple[str, ...] = ()):
        self.v = vocabulary
        self.pieces = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.longest = max(map(len, vocabulary.bytes_of))
        self.ids = {t: n for n, t in enumerate(vocabulary.bytes_of) if t and vocabulary.merge(t) == [n]}
        self.fits: dict[int, bool] = {}
        self.counts: dict[str, int] = {}

    def _fit(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) >= MEMO_ENTRIES:
                self.fits.clear()
            ok = self.fits[key] = self.v.merge(self.v.bytes_of[a] + self.v.bytes_of[b]) == [a, b]
        return ok

    def table(self, piece: bytes) -> list[int]:
        """Token count of each prefix of one pre-token, by bytes from 0 on."""
        n, ids, fits, fit = len(piece), self.ids, self.fits, self._fit
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                token = ids.get(piece[begin:end])
                if token is None:
                    continue
                before = last[begin]
                if begin == 0 or (fits.get(before << 20 | token) if (before << 20 | token) in fits else fit(before, token)):
                    last[end], count[end] = token, count[begin] + 1
                    break
        return count

    def _piece(self, piece: str) -> int:
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) >= MEMO_ENTRIES:
                self.counts.clear()
            raw = piece.encode()
            n = self.counts[piece] = 1 if raw in self.ids else self.table(raw)[-1]
        return n

    def parts(self, text: str):
        """(part, is special) in order."""
        if self.special is None:
            yield text, False
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        known, total = self.counts.get, 0
        for part, special in self.parts(text):
            if special:
                total += 1
                continue
            found = self.pieces(part)
            try:
                total += sum(map(known, found))
            except TypeError:  # one of them is new
                total += sum(map(self._piece, found))
        return total

    def prefixes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte ends of all pre-tokens and the token count up to each."""
        ends, counts = [0], [0]
        for part, special in self.parts(text):
            for p in [part] if special else self.pieces(part):
                ends.append(ends[-1] + len(p.encode()))
                counts.append(counts[-1] + (1 if special else self._piece(p)))
        return np.array(ends), np.array(counts)

    def every_prefix(self, text: str) -> list[int]:
        """Tokens of the first k bytes, for every k, with the pre-tokens of the whole text."""
        out = [0]
        for part, special in self.parts(text):
            for p in [part] if special else self.pieces(part):
                raw, base = p.encode(), out[-1]
                out += [base + 1] * len(raw) if special else [base + c for c in self.table(raw)[1:]]
        return out

    def cut(self, text: str, budget: int) -> int:
        """Bytes of the longest run of whole pre-tokens from the start that needs at most ``budget`` tokens."""
        ends, counts = self.prefixes(text)
        return int(ends[bisect.bisect_right(counts.tolist(), budget) - 1])


def count_tokens(
    docs: DataFrame, *, path: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",), limit: int = 1024, with_prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null counts as empty, which has no tokens.

    ``special`` strings inside a text are one token each, as the vocabulary's library has it by default. ``with_prefixes`` adds
    ``ends`` and ``counts``: the stored prefix table, by which ``tokens_within`` answers budgets.
    """
    data = docs.sparkSession.sparkContext.broadcast(rank_lines(docs.sparkSession, path))

    def start():
        counter = built(f"prefix {path} {pattern} {special}", lambda: PrefixCounter(from_json(data.value), pattern, special))

        def work(cols):
            texts = cols["text"]
            out = {"doc_id": longs(cols["doc_id"]), "n_bytes": longs([len(t.encode()) for t in texts])}
            if with_prefixes:
                tables = [counter.prefixes(t) for t in texts]
                out["n_tokens"] = longs([int(c[-1]) for _, c in tables])
                out |= {k: pa.array([t[i].tolist() for t in tables], pa.list_(pa.int64())) for i, k in enumerate(("ends", "counts"))}
            else:
                out["n_tokens"] = longs([counter.count(t) for t in texts])
            return out

        return work

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    more = ", ends array<long>, counts array<long>" if with_prefixes else ""
    out = per_batch(src, start, f"doc_id long, n_bytes long, n_tokens long{more}")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def tokens_within(counted: DataFrame, budget: int) -> DataFrame:
    """For rows of ``count_tokens(with_prefixes=True)``: cut_bytes and cut_tokens that fit a budget, from the stored table."""
    fit = F.size(F.filter("counts", lambda c: c <= F.lit(budget)))
    return counted.withColumn("cut_bytes", F.element_at("ends", fit)).withColumn("cut_tokens", F.element_at("counts", fit))
