"""Quality rules as a ledger of bit masks: measure once, judge often.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy is a mask with
a version: a document stays if it fails none of its rules. Changing a policy, or asking what a rule alone removes, reads the
stored masks and never the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import longs, per_batch, plain_text

# Fixed values of the contract: the symbols that count, and white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

# Name and condition of each rule; its place is its bit. The first two are the contract's base rules. All are integer
# conditions on the ledger's measurements, so that any engine judges alike.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "10 * n_shouts > 3 * n_words"),
)
BASE = 0b11
POLICIES = {"v1": BASE, "v2": (1 << len(RULES)) - 1}


def covered(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(ids) < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if kinds >= 1 << 21:  # three numbers would not fit 63 bits
        a = np.unique(a * kinds + b, return_inverse=True)[1]
        key = a * kinds + c
    else:
        key = (a * kinds + b) * kinds + c
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[back] > 1
    if not hit.any():
        return 0
    word = np.zeros(len(ids), bool)
    word[:-2] |= hit
    word[1:-1] |= hit
    word[2:] |= hit
    return int(word.sum())


def measure(text: str) -> tuple[int, int, int, int, int, int, int]:
    words = text.encode().split()  # bytes split at ASCII white space only
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), covered(ids, len(seen)), text.count("!!"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts")


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id, the measurements and failed (one bit per rule) of every row.

    Null and empty texts have no words and measure 0 throughout. Repeated rows and null ids are kept as they are.
    """

    def start():
        def work(cols):
            out = np.array([measure(t) for t in cols["text"]], np.int64)
            return {"doc_id": longs(cols["doc_id"])} | {m: pa.array(out[:, k]) for k, m in enumerate(MEASURES)}

        return work

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    measured = per_batch(src, start, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def passes(policy: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy).cast("long")) == 0


def judged(rows: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """``rows`` of a ledger with a boolean kept_<version> for each policy."""
    return rows.withColumns({f"kept_{name}": passes(mask) for name, mask in policies.items()})


def ablations(rows: DataFrame, policy: int, rules=RULES) -> DataFrame:
    """Per rule of a policy: n_failed, n_only (failing no other rule of it), n_kept_without and n_kept.

    Documents are counted by mask first; there are at most 2 to the number of rules of those, whatever the corpus.
    """
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy).cast("long")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    own = [(k, name) for k, (name, _) in enumerate(rules) if policy >> k & 1]
    each = counts.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(1 << k).cast("long").alias("bit")) for k, name in own])))
    hit = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    bit, mask = F.col("rule.bit"), F.col("mask")
    return each.groupBy(F.col("rule.name").alias("rule")).agg(
        hit(mask.bitwiseAND(bit) != 0)("n_failed"), hit(mask == bit)("n_only"), hit(mask.bitwiseAND(F.bitwise_not(bit)) == 0)("n_kept_without"), hit(mask == 0)("n_kept")
    )
