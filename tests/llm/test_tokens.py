"""Encoding and counting against the libraries that define them."""

from __future__ import annotations

import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tapewright.llm import bpe, token_counts
from tests.llm.data import rows

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(bpe.from_json(open(JSON, "rb").read()), P.PATTERN, ("<|endoftext|>",))


def test_encode_and_decode(docs, library):
    want = []
    for i, t, *_ in rows():
        ids = library.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((str(i), len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode()), tuple(ids)))
    got = bpe.encode_documents(docs, path=RANKS, pattern=P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == sorted(want)


def test_every_letter_and_space(library):
    codec = bpe.Codec(bpe.from_ranks(open(RANKS, "rb").read()), P.PATTERN)
    for c in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F700)]:
        text = f"a{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}\n"
        assert list(struct.unpack(f"<{len(codec.encode(text)) // 4}I", codec.encode(text))) == library.encode_ordinary(text), hex(c)


def test_perfect_hash():
    keys = [b"%d" % k for k in range(3000)] + [b""]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.find, keys)) == list(range(len(keys)))
    assert h.find(b"absent") == -1 and bpe.PerfectHash([]).find(b"x") == -1


def test_counts(docs):
    t = Tokenizer.from_file(JSON)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows())
    got = token_counts.count_tokens(docs, path=JSON, pattern=P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_every_prefix_of_a_piece(counter):
    for piece in (b" unbelievable", "naïve日本".encode(), b"aaaaaaaaaaaaaaaaaaaa", b"\xff\xfe\x00"):
        assert counter.table(piece) == [len(counter.v.merge(piece[:k])) for k in range(len(piece) + 1)]


def test_budgets_from_stored_prefixes(spark, docs, counter):
    counted = token_counts.count_tokens(docs, path=JSON, pattern=P.PATTERN, with_prefixes=True)
    for r in token_counts.tokens_within(counted, 20).collect():
        assert r.cut_tokens <= 20 and (r.cut_bytes == r.n_bytes or r.n_tokens > 20)
    for _, t, *_ in rows()[:30]:
        cut = counter.cut(t, 20)
        assert counter.count(t.encode()[:cut].decode()) <= 21  # the cut end may split white space anew
        assert counter.every_prefix(t)[-1] == counter.count(t) and len(counter.every_prefix(t)) == len(t.encode()) + 1


def test_no_rows(empty):
    assert bpe.encode_documents(empty, path=RANKS, pattern=P.PATTERN).count() == 0
    assert token_counts.count_tokens(empty, path=JSON, pattern=P.PATTERN).count() == 0
