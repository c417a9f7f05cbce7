"""Queries that train and apply models on features of the session bars."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tapewright.operators import features as X
from tapewright.operators import models as M
from tapewright.operators.bars import recent_dates
from tapewright.operators.joins import rounded
from tapewright.operators.labels import label_bars
from tapewright.operators.metrics import average_precision
from tapewright.operators.splits import ratio_split
from tapewright.params import PEAK, TROUGH, label_variant
from tapewright.plans import inputs as I
from tapewright.plans.inputs import with_tables
from tapewright.plans.registry import query
from tapewright.session import stage

KEYS = ["symbol", "ts"]
TARGETS = {"peak_prob": PEAK, "trough_prob": TROUGH}
TREES = M.TreeParams()  # rounds end by early stopping on the val split


def _features(bars):
    return X.clean_features(X.build_features(label_bars(bars, label_variant("L2"))))


def _training(spark, folder):
    """Labelled features with their split, written once: boosting reads them many times."""
    return stage(ratio_split(_features(I.session(spark, folder))), "training")


def _rows(df, label, columns):
    y = (F.col("label") == label).cast("double")
    return M.assemble(df.withColumn("y", y), columns, [*KEYS, "split", "y", "label"])


def _tree_models(df, columns):
    """Models of both targets, fitted side by side: a fit is hundreds of short jobs, each of which leaves cores idle at its end."""
    with ThreadPoolExecutor(len(TARGETS)) as pool:
        models = pool.map(lambda label: M.train_trees(_rows(df, label, columns), TREES), TARGETS.values())
        return dict(zip(TARGETS, models))


def _tree_scores(df, columns, models):
    rows = M.assemble(df.withColumn("y", F.lit(0.0)), columns, [*KEYS, "split", "label"])
    out = M.with_score(models["peak_prob"], rows, "peak_prob", [*KEYS, "split", "label", "features"])
    return M.with_score(models["trough_prob"], out.withColumnRenamed("peak_prob", "p"), "trough_prob", [*KEYS, "split", "label", "p"]).withColumnRenamed("p", "peak_prob")


@query("M-01 M-08 P-09 P-10 P-11 P-12 S-15")
def tree_predictions(spark, folder):
    df = _training(spark, folder)
    columns = X.feature_columns(df)
    return M.predictions(_tree_scores(df, columns, _tree_models(df, columns)))


@query("M-04 K-02")
def tree_importances(spark, folder):
    df = _training(spark, folder)
    columns = X.feature_columns(df)
    model = M.train_trees(_rows(df, PEAK, columns), TREES)
    return M.importances(spark, model, columns)


@query("M-03")
def tree_search(spark, folder):
    df = _training(spark, folder)
    rows = stage(_rows(df, PEAK, X.feature_columns(df)), "rows")
    found = M.search(rows, [M.TreeParams(depth=d, step=s, subsample=u) for d in (3, 5) for s in (0.05, 0.1) for u in (0.8, 1.0)])
    return spark.createDataFrame(
        [(p.depth, p.step, p.subsample, p.rounds, ap) for p, ap in found], "depth int, step double, subsample double, rounds int, val_pr_auc double"
    )


def _sequence_scores(df, lookback=5):
    """Scores of both targets from lookback sequences; training and scoring never cross a day."""
    columns = X.feature_columns(df)
    seq = X.sequences(df, lookback, "drop", columns)
    out = None
    for name, label in TARGETS.items():
        rows = M.sequence_vectors(seq.withColumn("y", (F.col("label") == label).cast("double")), [*KEYS, "split", "y"])
        scored = M.with_score(M.train_sequences(rows), rows, f"seq_{name}", KEYS)
        out = scored if out is None else out.join(scored, KEYS)
    return M.padded(df.select(*KEYS, "split", "label"), out, [f"seq_{n}" for n in TARGETS])


@query("M-05 M-10 M-13 W-23")
def sequence_predictions(spark, folder):
    return _sequence_scores(_training(spark, folder))


@query("M-06")
def calibrated_scores(spark, folder):
    scores = stage(_sequence_scores(_training(spark, folder)), "seq_scores")
    val = scores.filter(F.col("split") == "val").withColumn("y", F.col("label") == PEAK)
    model = M.calibrate(val, "seq_peak_prob", "y")
    return M.calibrated(model, scores, "seq_peak_prob", "calibrated_prob")


def _ensemble(spark, folder):
    """Tree scores, calibrated sequence scores and their blend per target, as long rows."""
    df = _training(spark, folder)
    columns = X.feature_columns(df)
    trees = _tree_scores(df, columns, _tree_models(df, columns))
    both = stage(trees.join(_sequence_scores(df).drop("split", "label"), KEYS), "both")
    parts = []
    for name, label in TARGETS.items():
        rows = both.withColumn("y", F.col("label") == label)
        model = M.calibrate(rows.filter(F.col("split") == "val"), f"seq_{name}", "y")
        rows = M.calibrated(model, rows, f"seq_{name}", "seq_prob")
        parts.append(rows.select(*KEYS, "split", "y", F.lit(name).alias("target"), F.col(name).alias("tree_prob"), "seq_prob"))
    long = stage(parts[0].unionByName(parts[1]), "scorers")
    weights = M.best_weight(long.filter(F.col("split") == "val"), ["target"], "tree_prob", "seq_prob", "y")
    return long.join(weights, "target").withColumn("prob", M.blend(F.col("tree_prob"), F.col("seq_prob"), F.col("w_gbm")))


@query("M-12 F-14 M-07")
def ensemble_predictions(spark, folder):
    e = _ensemble(spark, folder)
    wide = e.groupBy(*KEYS).agg(*[F.max(F.when(F.col("target") == n, F.col("prob").cast("double"))).alias(n) for n in TARGETS])
    return M.predictions(wide)


@query("M-11")
def ensemble_comparison(spark, folder):
    test = stage(_ensemble(spark, folder).filter(F.col("split") == "test"), "test")
    parts = [average_precision(test, ["target"], s, "y").select("target", F.col("pr_auc").alias(s)) for s in ("tree_prob", "seq_prob", "prob")]
    out = parts[0].join(parts[1], "target").join(parts[2], "target")
    return out.withColumn("improvement", F.col("prob") - F.col("tree_prob"))


@query("M-09 P-15 P-13")
def latest_day_predictions(spark, folder):
    """The latest day of every symbol, with five earlier days as context for its features."""
    df = _training(spark, folder)
    columns = X.feature_columns(df)
    models = _tree_models(df, columns)
    recent = _features(recent_dates(I.session(spark, folder))).filter("is_target").withColumn("split", F.lit("latest"))
    return M.predictions(_tree_scores(recent, columns, models))


PAIRED = "SELECT symbol, peak_prob AS a, trough_prob AS b, label = 1 AS y FROM scored"


@query(
    "M-07 F-14",
    with_tables(
        f"""SELECT symbol, round(w, 2) AS w_gbm, round(pr_auc, 8) AS val_pr_auc FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(pr_auc, 12) DESC, k = 10 DESC, k) AS rn FROM (
          SELECT symbol, k, w, sum(pos * cp / cn) / sum(pos) AS pr_auc FROM (
            SELECT *, sum(n) OVER x AS cn, sum(pos) OVER x AS cp FROM (
              SELECT symbol, k, w, CAST(w * a + (1 - w) * b AS FLOAT) AS s, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (y) AS DOUBLE) AS pos
              FROM ({PAIRED}), (SELECT k, CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * k AS w FROM range(0, 11) r(k)) GROUP BY ALL)
            WINDOW x AS (PARTITION BY symbol, k ORDER BY s DESC)) GROUP BY 1, 2, 3)) WHERE rn = 1""",
        "scored",
    ),
)
def ensemble_weights(spark, folder):
    rows = I.scored(spark, folder).select("symbol", F.col("peak_prob").alias("a"), F.col("trough_prob").alias("b"), (F.col("label") == 1).alias("y"))
    return rounded(M.best_weight(rows, ["symbol"], "a", "b", "y"), ["val_pr_auc"])


@query(
    "M-10",
    with_tables(
        """SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol, date ORDER BY ts) >= 5 THEN peak_prob ELSE 0 END AS seq_prob FROM scored""",
        "scored",
    ),
)
def padded_scores(spark, folder):
    s = I.scored(spark, folder)
    late = X.drop_early_bars(s, 5).withColumnRenamed("peak_prob", "seq_prob")
    return M.padded(s.select("symbol", "ts"), late, ["seq_prob"])


@query(
    "F-14 M-08",
    with_tables(
        """SELECT symbol, ts, CAST(round(peak_prob, 4) AS FLOAT) AS peak_prob, CAST(round(trough_prob, 4) AS FLOAT) AS trough_prob,
          CAST(CASE WHEN peak_prob >= 0.5 AND peak_prob > trough_prob THEN 1 WHEN trough_prob >= 0.5 AND trough_prob > peak_prob THEN 2 ELSE 0 END AS TINYINT) AS label
        FROM scored""",
        "scored",
    ),
)
def stored_prediction_form(spark, folder):
    return M.predictions(I.scored(spark, folder).select("symbol", "ts", "peak_prob", "trough_prob"))
