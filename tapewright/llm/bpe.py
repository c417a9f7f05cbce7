"""Byte-level byte pair encoding: a vocabulary with a perfect hash over whole tokens and heap merges over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import longs, per_batch, plain_text, strings

MEMO_ENTRIES = 600_000  # a task's table of pre-tokens met so far starts anew beyond this many; it only saves time


class PerfectHash:
    """Minimal perfect hash of byte strings: 0 to n - 1 without gaps for its keys, -1 for any other string.

    Keys that are alone at their place of a level's table stay there and are numbered in the order of the places; the others go
    on to the next level, which uses other bits. A place keeps its number, and the key stored under it settles membership.
    """

    def __init__(self, keys: list[bytes]):
        self.keys: list[bytes] = []
        self.levels: list[tuple[int, int, list[int]]] = []
        left, level = list(keys), 0
        while left:
            size, salt = max(8, 2 * len(left)), 0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64
            h = np.array([xxhash.xxh3_64_intdigest(k) for k in left], np.uint64)
            at = self._place(h, np.uint64(salt), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = np.where(alone, np.cumsum(alone) - 1 + len(self.keys), -1)
            placed = alone[at]
            self.keys += [left[i] for i in np.flatnonzero(placed)[np.argsort(at[placed])]]
            self.levels.append((salt, size, ranks.tolist()))
            left, level = [left[i] for i in np.flatnonzero(~placed)], level + 1

    @staticmethod
    def _place(h, salt, size):
        mixed = (h ^ (h >> np.uint64(29))) * salt
        return ((mixed >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        h ^= h >> 29
        for salt, size, ranks in self.levels:
            n = ranks[(h * salt % 2**64 >> 32) % size]
            if n >= 0:
                return n if self.keys[n] == key else -1
        return -1


class Vocabulary:
    """Tokens' bytes by id, and for each pair of ids that merges (rank, merged id) as one number."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]] | None = None):
        self.bytes_of = [b""] * (max(tokens.values()) + 1)
        for token, n in tokens.items():
            self.bytes_of[n] = token
        self.byte_ids = [tokens[bytes([b])] for b in range(256)]
        self.whole = PerfectHash(list(tokens))
        self.ids = [tokens[k] for k in self.whole.keys]
        if merges is None:  # ranks alone: any two tokens whose bytes together are a token, by that token's rank
            self.pairs = {
                tokens[t[:k]] << 20 | tokens[t[k:]]: n << 20 | n for t, n in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens
            }
        else:
            self.pairs = {tokens[a] << 20 | tokens[b]: rank << 20 | tokens[a + b] for rank, (a, b) in enumerate(merges)}

    def token_id(self, token: bytes) -> int:
        n = self.whole.find(token)
        return -1 if n < 0 else self.ids[n]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged first, of equal ones the leftmost.

        The bytes form a linked list; a heap holds the pairs that could merge, and pairs that have changed since are
        passed over. Time grows with n log n.
        """
        ids = [self.byte_ids[b] for b in piece]
        n, pairs = len(ids), self.pairs
        heap = []
        for i in range(n - 1):
            v = pairs.get(ids[i] << 20 | ids[i + 1])
            if v is not None:
                heap.append(v << 40 | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            x = heapq.heappop(heap)
            i, v = x & 0xFFFFFFFFFF, x >> 40
            j = after[i]
            if j >= n or ids[i] < 0 or pairs.get(ids[i] << 20 | ids[j]) != v:
                continue
            ids[i], ids[j] = v & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                v = pairs.get(ids[i] << 20 | ids[k])
                if v is not None:
                    heapq.heappush(heap, v << 40 | i)
            k = before[i]
            if k >= 0:
                v = pairs.get(ids[k] << 20 | ids[i])
                if v is not None:
                    heapq.heappush(heap, v << 40 | k)
        return [x for x in ids if x >= 0]


def rank_lines(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file of fixed size, read where the driver can see it; it goes to the tasks as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def from_ranks(data: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})


def from_json(data: bytes) -> Vocabulary:
    """A vocabulary with merges whose bytes are written as letters: printable ones as themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    raw = lambda s: bytes(letters[c] for c in s)
    model = json.loads(data)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Vocabulary({raw(t): n for t, n in model["vocab"].items()}, [(raw(a), raw(b)) for a, b in merges])


_BUILT: dict[str, object] = {}


def built(key: str, make):
    """One per Python worker, whatever number of tasks it runs."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


class Codec:
    """Encodes texts to little-endian ids and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.token_id(raw)
        ids = [whole] if whole >= 0 else self.vocabulary.merge(raw)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        memo, out = self.memo, []
        for p in self.pieces(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                ids = memo[p] = self.piece(p)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_tokens, ids_sha256, decoded (binary), decoded_sha256 of every row.

    Null counts as empty, which has no ids. Texts are encoded whole; no special tokens are known.
    """
    data = docs.sparkSession.sparkContext.broadcast(rank_lines(docs.sparkSession, path))

    def start():
        codec = built(f"codec {path} {pattern}", lambda: Codec(from_ranks(data.value), pattern))

        def work(cols):
            ids = [codec.encode(t) for t in cols["text"]]
            back = [codec.decode(x) for x in ids]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            return {
                "doc_id": longs(cols["doc_id"]), "ids": pa.ListArray.from_arrays(pa.array(ends), flat), "n_tokens": longs(np.diff(ends)),
                "ids_sha256": strings([hashlib.sha256(x).hexdigest() for x in ids]), "decoded": pa.array(back, pa.binary()),
                "decoded_sha256": strings([hashlib.sha256(x).hexdigest() for x in back]),
            }

        return work

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    return per_batch(src, start, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")
