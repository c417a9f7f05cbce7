"""Time-based splits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapewright.params import TEST_MONTHS, VAL_MONTHS, WALK_TEST_MONTHS, WALK_TRAIN_MONTHS
from tapewright.session import stage

BLOCK_ROWS = 100_000  # copies of one row that a task writes at once


def times_counted(df: DataFrame, ts: str) -> DataFrame:
    """Stage table of distinct times ``t`` with their number of rows ``n``.

    A year of minutes is half a million rows however many symbols there are, so what only depends on times is asked of it.
    """
    return stage(df.groupBy(F.col(ts).alias("t")).agg(F.count(F.lit(1)).alias("n")), "times")


def time_split(
    df: DataFrame, ts: str = "ts", tie: str = "symbol", val_months: int = VAL_MONTHS, test_months: int = TEST_MONTHS
) -> DataFrame:
    """Adds ``split``: test is the last months, validation those before, train the rest.

    Falls back to 60/20/20 by row rank when train or validation would be empty. The input is read once for its times and once
    for the result.
    """
    times = times_counted(df, ts)
    test_start = times.agg(F.max("t")).scalar() - F.expr(f"INTERVAL {test_months} MONTH")
    # Two steps, as month ends may move at each.
    val_start = test_start - F.expr(f"INTERVAL {val_months} MONTH")

    def part(t: Column) -> Column:
        return F.when(t < val_start, F.lit("train")).when(t < test_start, F.lit("val")).otherwise(F.lit("test"))

    parts = times.select(part(F.col("t")).alias("split"))
    counts = parts.agg(*[F.count_if(F.col("split") == c).alias(c) for c in ("train", "val")]).first()
    if counts["train"] and counts["val"]:
        return df.withColumn("split", part(F.col(ts)))
    return ratio_split(df, ts, tie, times=times)


def rank_place(groups: DataFrame, key: str, rank: int) -> DataFrame:
    """One row: the ``key`` whose ``n`` rows hold this rank, and the number of them that come before it as ``offset``.

    Keys are dealt into ordered ranges; the ranges are summed, and only the one with the wanted rank is ordered. The driver sees
    one number per range.
    """
    ranged = stage(groups.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    before, part = 0, -1
    for part, n in sorted(ranged.groupBy("_range").agg(F.sum("n")).collect()):
        if rank < before + n:
            break
        before += n
    upto = F.sum("n").over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    rows = ranged.filter(F.col("_range") == part).select(key, "n", (F.lit(rank - before) - upto + F.col("n")).alias("offset"))
    return stage(rows.filter(F.col("offset").between(0, F.col("n") - 1)).drop("n"), "place")


def ratio_split(
    df: DataFrame,
    ts: str = "ts",
    tie: str = "symbol",
    train: float = 0.6,
    upto_val: float = 0.8,
    times: DataFrame | None = None,
) -> DataFrame:
    """60/20/20 by position in the order of time, then ``tie``; rows equal in both follow a digest of the whole row.

    Only the two places where the split changes are looked for: first the time, then tie and digest inside that time. All other
    rows are compared with these places as they pass, without a shuffle, so a table with one single time is spread over tasks
    like any other. Rows equal in all three are counted and dealt by number. Missing times and ties come first.
    """
    times = times_counted(df, ts) if times is None else times
    n = times.agg(F.sum("n")).first()[0] or 0
    key = F.struct(F.col(ts).alias("t"), F.col(tie).alias("tie"), F.xxhash64(*df.columns).alias("digest"))
    keyed = df.select(F.struct(*df.columns).alias("row"), key.alias("key"))
    split, shared = F.lit("test"), []
    for name, rank in (("val", math.floor(n * upto_val)), ("train", math.floor(n * train))):
        if rank >= n:
            split = F.lit(name)
            continue
        time = rank_place(times, "t", rank)
        same = keyed.filter(F.col("key.t").eqNullSafe(time.select("t").scalar())).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        place = rank_place(same, "key", time.first()["offset"])
        split = F.when(F.col("key") < place.select("key").scalar(), F.lit(name)).otherwise(split)
        if offset := place.first()["offset"]:
            shared.append((name, place, offset))
    placed = keyed.withColumn("split", split)
    if shared:
        mixed = reduce(lambda x, y: x | y, [F.col("key") == place.select("key").scalar() for _, place, _ in shared])
        placed = placed.filter(~mixed).unionByName(_dealt(placed.filter(mixed), shared))
    return placed.select("row.*", "split")


def _dealt(rows: DataFrame, shared: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Rows of a key through which a split's end goes: its first ``offset`` rows get that split, the others keep theirs.

    Equal rows are one counted row until the end, then repeated in blocks that are spread over tasks.
    """
    counted = rows.groupBy("row", "key", "split").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("start", upto - F.col("n"))
    ends = [(name, F.when(F.col("key") == place.select("key").scalar(), F.lit(offset)).otherwise(0)) for name, place, offset in reversed(shared)]
    pieces, done = [], F.lit(0)
    for name, end in ends:
        taken = F.least(F.greatest(end - F.col("start"), F.lit(0)), F.col("n")) - done
        pieces.append(F.struct(F.lit(name).alias("split"), F.greatest(taken, F.lit(0)).cast("long").alias("n")))
        done = done + F.greatest(taken, F.lit(0))
    pieces.append(F.struct(F.col("split"), (F.col("n") - done).cast("long").alias("n")))
    parts = counted.select("row", "key", F.explode(F.array(*pieces)).alias("p")).filter("p.n > 0")
    blocks = parts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("p.n") - 1) / BLOCK_ROWS))))
    size = F.least(F.lit(BLOCK_ROWS), F.col("p.n") - F.col("_block") * BLOCK_ROWS).cast("int")
    copies = blocks.repartition("p", "_block").withColumn("_copy", F.explode(F.sequence(F.lit(1), size)))
    return copies.select("row", "key", F.col("p.split").alias("split"))


def fold_bounds(
    df: DataFrame, ts: str = "ts", train_months: int = WALK_TRAIN_MONTHS, test_months: int = WALK_TEST_MONTHS
) -> DataFrame:
    """One row with the array ``folds`` of (fold, start, cut, stop) that fit between the first and last time.

    A fold starts ``test_months`` after the one before; the calendar clamps month ends at each step.
    """
    t, step, reach = F.col(ts).cast("timestamp_ntz"), F.expr(f"INTERVAL {test_months} MONTH"), F.expr(f"INTERVAL {train_months} MONTH")
    span = df.agg(F.min(t).alias("lo"), F.max(t).alias("last"))
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.months_between("last", "lo") / test_months), F.lit(1)).cast("int"))
    starts = F.aggregate(steps, F.array("lo"), lambda got, _: F.concat(got, F.array(F.element_at(got, -1) + step)))
    spans = F.transform(
        starts, lambda at, i: F.struct(i.alias("fold"), at.alias("start"), (at + reach).alias("cut"), (at + reach + step).alias("stop"))
    )
    return span.select(F.filter(spans, lambda f: f["stop"] <= F.col("last") + F.expr("INTERVAL 1 DAY")).alias("folds"))


def walk_forward(
    df: DataFrame, ts: str = "ts", train_months: int = WALK_TRAIN_MONTHS, test_months: int = WALK_TEST_MONTHS
) -> DataFrame:
    """Rows tagged with every ``fold`` and ``role`` (train, test) they take part in.

    Fold bounds follow from the first and last time alone; rows pick theirs from that short list.
    Folds without rows on either side are left out. Bounds and sides are asked of the distinct times, so the input is read once
    for these and once for the result.
    """
    times = times_counted(df, ts).select(F.col("t").alias(ts))
    t = F.col(ts).cast("timestamp_ntz")
    folds = fold_bounds(times, ts, train_months, test_months).scalar()
    mine = F.filter("_folds", lambda f: (t >= f["start"]) & (t < f["stop"]))

    def tagged(rows: DataFrame) -> DataFrame:
        role = F.when(t < F.col("_f.cut"), F.lit("train")).otherwise(F.lit("test"))
        listed = rows.withColumn("_folds", folds).withColumn("_f", F.explode(mine))
        return listed.select(*rows.columns, F.col("_f.fold").alias("fold"), role.alias("role"))

    sides = tagged(times).groupBy("fold").agg(F.count_distinct("role").alias("n"))
    whole = sides.filter("n = 2").agg(F.collect_list("fold")).scalar()
    return tagged(df).filter(F.array_contains(whole, F.col("fold")))
