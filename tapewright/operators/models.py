"""Training, scoring, calibration and blending of classifiers with Spark MLlib."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapewright.functions.columns import finite_or_zero
from tapewright.operators.metrics import average_precision, decide

# --- Fixed values: ensemble search -------------------------------------------
WEIGHTS = tuple(0.5 + 0.05 * k for k in range(11))
DEFAULT_WEIGHT = 0.70
SEED = 42


@dataclass(frozen=True)
class TreeParams:
    rounds: int = 100
    depth: int = 5
    step: float = 0.1
    subsample: float = 1.0
    bins: int = 32


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``features`` vector of finite single-precision values next to the kept columns."""
    clean = df.select(*keep, *[finite_or_zero(F.col(c).cast("double")).cast("float").cast("double").alias(f"_v_{c}") for c in columns])
    return VectorAssembler(inputCols=[f"_v_{c}" for c in columns], outputCol="features").transform(clean).select(*keep, "features")


def balanced(df: DataFrame, target: str = "y") -> DataFrame:
    """``weight``: positives count as much as negatives in total."""
    pos = F.sum(F.col(target)).cast("double")
    ratio = df.agg(F.when(pos > 0, (F.count(F.lit(1)) - pos) / F.when(pos > 0, pos)).otherwise(F.lit(1.0))).scalar()
    return df.withColumn("weight", F.when(F.col(target) == 1, ratio).otherwise(F.lit(1.0)))


def train_trees(rows: DataFrame, params: TreeParams = TreeParams()):
    """Boosted trees on rows with ``features``, ``y`` and ``split``; stops early on the val split."""
    known = rows.filter(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")
    gbt = GBTClassifier(
        labelCol="y", featuresCol="features", weightCol="weight", validationIndicatorCol="is_val", maxIter=params.rounds,
        maxDepth=params.depth, stepSize=params.step, subsamplingRate=params.subsample, maxBins=params.bins, seed=SEED,
    )
    return gbt.fit(balanced(known))


def train_sequences(rows: DataFrame, penalty: float = 0.01):
    """Second scorer on flattened lookback sequences."""
    known = balanced(rows.filter(F.col("split") == "train"))
    return LogisticRegression(labelCol="y", featuresCol="features", weightCol="weight", maxIter=50, regParam=penalty).fit(known)


def sequence_vectors(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    flat = F.transform(F.flatten("seq"), lambda v: v.cast("double"))
    return df.select(*keep, array_to_vector(flat).alias("features"))


def with_score(model, rows: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """Probability of the positive class."""
    scored = model.transform(rows)
    return scored.select(*keep, vector_to_array("probability")[1].alias(name))


def importances(spark: SparkSession, model, columns: Sequence[str], top: int = 20) -> DataFrame:
    """The most important features of a tree model. One value per feature, so the list is short."""
    pairs = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def search(rows: DataFrame, candidates: Iterable[TreeParams], first_rounds: int = 4, parallel: int = 4) -> list[tuple[TreeParams, float]]:
    """Candidates with their average precision on the val split, best first, by successive halving.

    All are fitted for a few rounds; the better half goes on with twice as many, until one is left, which gets all its rounds. Each
    candidate is listed with the rounds it got. Fits of one step run side by side; of equal ones the first stays.
    """
    validation = rows.filter(F.col("split") == "val").withColumn("_one", F.lit(1))

    def measured(p: TreeParams) -> tuple[TreeParams, float]:
        scored = with_score(train_trees(rows, p), validation, "p", ["y", "_one"])
        ap = average_precision(scored, ["_one"], "p", "y").first()
        return p, float(ap["pr_auc"]) if ap else 0.0

    left, rounds, results = list(candidates), first_rounds, {}
    with ThreadPoolExecutor(parallel) as pool:
        while left:
            tried = list(pool.map(measured, [replace(p, rounds=min(rounds, p.rounds)) for p in left]))
            results.update(zip(left, tried))
            better = sorted(left, key=lambda p: -results[p][1])
            going = [p for p in better if results[p][0].rounds < p.rounds]
            left = going[: max(1, len(left) // 2)]
            rounds = 2 * rounds if len(left) > 1 else max((p.rounds for p in left), default=0)
    return sorted(results.values(), key=lambda r: (-r[0].rounds, -r[1]))


def calibrate(scored: DataFrame, score: str, target: str, decimals: int = 6) -> IsotonicRegressionModel:
    """Isotonic calibration.

    For the fit, scores are counted per value at ``decimals`` places first, which bounds the points at
    ten to that power (a million) whatever the number of rows. Scoring takes scores in full.
    """
    points = scored.groupBy(F.round(score, decimals).alias("_x")).agg(
        F.avg(F.col(target).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w")
    )
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(points)


def calibrated(model: IsotonicRegressionModel, scored: DataFrame, score: str, name: str) -> DataFrame:
    out = model.transform(scored.withColumn("_x", F.col(score).cast("double")))
    return out.withColumn(name, F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0))).drop("_x", "calibrated")


def blend(a: Column, b: Column, weight: Column | float = DEFAULT_WEIGHT) -> Column:
    w = F.lit(weight) if isinstance(weight, float) else weight
    return (w * a + (1 - w) * b).cast("float")


def best_weight(df: DataFrame, by: Sequence[str], a: str, b: str, target: str) -> DataFrame:
    """Per key the weight of ``a`` with the highest average precision.

    Weight 1 stands unless another one is strictly better; of equals the smallest. All weights are
    measured in one job.
    """
    rows = df.withColumn("w", F.explode(F.array(*[F.lit(w) for w in WEIGHTS])))
    rows = rows.withColumn("_s", blend(F.col(a), F.col(b), F.col("w")))
    ap = average_precision(rows, [*by, "w"], "_s", target).withColumn("pr_auc", F.round("pr_auc", 12))
    order = F.struct(F.col("pr_auc"), F.col("w") == 1.0, -F.col("w"))
    out = ap.groupBy(*by).agg(F.max_by("w", order).alias("_w"), F.max("pr_auc").alias("pr_auc"), F.max("positives").alias("_p"))
    none = F.col("_p") == 0
    return out.select(
        *by,
        F.when(none, F.lit(DEFAULT_WEIGHT)).otherwise(F.round("_w", 2)).alias("w_gbm"),
        F.when(none, F.lit(0.0)).otherwise(F.col("pr_auc")).alias("val_pr_auc"),
    )


def padded(bars: DataFrame, scores: DataFrame, names: Sequence[str], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Bars with sequence scores; bars too early in their day for a sequence score 0."""
    return bars.join(scores.select(*keys, *names), list(keys), "left").fillna(0.0, subset=list(names))


def predictions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Stored form: decision, and probabilities as four-decimal floats."""
    out = scored.withColumn("label", decide(F.col("peak_prob"), F.col("trough_prob"), threshold))
    return out.withColumns({c: F.round(c, 4).cast("float") for c in ("peak_prob", "trough_prob")})
