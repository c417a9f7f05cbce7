"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a fixed 60-bit hash of its id. Per source, words are summed by the hash's leading 12 bits; the running sums
show in which bucket the budget ends, and only that bucket is summed again by the next 12 bits, until it holds one hash value.
What lies below the threshold found this way is taken. No rows are sorted; larger budgets take supersets of smaller ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import WORD, packed, plain_text
from tapewright.session import stage

# Fixed values of the contract: weights in the order of the sources, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
HASH_BITS, STEP_BITS = 60, 12


def id_hash(id_col: str = "doc_id") -> Column:
    """60 bits of the MD5 of the id as text (null: of the word null); the same in every engine and on every rerun."""
    digits = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words) and hash of every row."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(plain_text(text_col), F.lit(WORD)).cast("long").alias("size"), id_hash(id_col).alias("hash")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target and weight, from one row per source (source, source_size).

    Weights repeat over the sources by code point, null last. Targets share the whole by weight; none exceeds ``most`` times
    its source, and the excess goes to the others by weight. With sources in the order of what they can take per unit of
    weight, those before the first that can take its share are full, which settles all shares at once.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cases = F.expr(f"CASE (n - 1) % {len(weights)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)) + " END")
    s = sizes.withColumn("n", F.row_number().over(order)).withColumn("weight", cases).withColumn("most", F.lit(most) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    s = s.withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("share", (F.sum("source_size").over(all_rows) - F.col("full_before")) / (F.sum("weight").over(all_rows) - F.col("weight_before")))
    s = s.withColumn("level", F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "n", "share"))).over(all_rows)["share"])
    return s.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most"))).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies of every document, and the hash up to which documents get one copy more.

    ``rows`` is a table that can be read several times: source, size, hash.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stage(
        targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "rest", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("below")), "mix-plan"
    )
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        # ``at``: the leading bits of the bucket in which the budget ends; ``below``: words of all hashes before it.
        inside = rows.join(plan.select(F.col("source").alias("s"), "at"), F.col("source").eqNullSafe(F.col("s"))).filter(F.shiftright("hash", shift + STEP_BITS) == F.col("at"))
        sums = inside.groupBy("s", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("s").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(running))
        hit = sums.join(plan, F.col("s").eqNullSafe(F.col("source")))
        # The last bucket that begins within the budget: half of what it holds counts at the last step, so that the
        # nearer end is taken.
        start = F.col("below") + F.col("upto") - F.col("words")
        fits = (start + F.col("words") / 2 <= F.col("rest")) if shift == 0 else (start <= F.col("rest"))
        found = hit.filter(fits).groupBy("source").agg(F.max(F.struct("bucket", start.alias("start"))).alias("hit"))
        found = found.select(F.col("source").alias("s"), "hit")
        left = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
        nothing = F.shiftleft("at", STEP_BITS) - (1 if shift == 0 else 0)
        plan = stage(
            left.select("source", "source_size", "target", "whole", "rest", F.coalesce("hit.bucket", nothing).alias("at"), F.coalesce("hit.start", F.col("below")).alias("below")), "mix-plan"
        )
    return plan.select("source", "source_size", "target", "whole", F.col("at").alias("threshold"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(rows, source_targets(sizes, weights, most))


def with_copies(rows: DataFrame, plan: DataFrame, source_col: str = "source", hash_col: str = "hash") -> DataFrame:
    """``rows`` with source_size, target and copies: how often the mix takes each."""
    p = plan.select(F.col("source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"), F.col("threshold").alias("_threshold"))
    out = rows.join(p, F.col(source_col).eqNullSafe(F.col("_source")))
    return out.withColumn("copies", F.col("_whole") + (F.col(hash_col) <= F.col("_threshold")).cast("long")).drop("_source", "_whole", "_threshold")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, **cols) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs``.

    Null texts have no words; a null source is a source of its own and comes last; rows that share an id share its hash and
    are taken together. A source without words takes nothing. Each source's taken words come as near to its target as
    whole documents allow. An empty table gives no rows.
    """
    rows = stage(sized(docs, **cols), "mix-sizes")
    out = with_copies(rows, mix_plan(rows, weights, most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns, whatever their names.

    Null texts have no words and rows that share an id are taken together, as in ``mix``. An empty table gives no rows.
    """
    rows = stage(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col), "mix-sizes")
    out = with_copies(packed(docs, source=F.col(source_col), hash=id_hash(id_col)), mix_plan(rows))
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
