"""Queries on turning points and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import labels as L
from tapewright.operators.bars import resample, session_bars
from tapewright.operators.joins import by_split_dates, rounded, truth_beside_predictions
from tapewright.params import LabelVariant, label_variant
from tapewright.plans.inputs import minute_bars, scored, session, with_tables
from tapewright.plans.registry import query

# The SQL twin measures peaks with joins inside a day instead of arrays. Troughs are peaks of -close.
TURNS = """d0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY symbol, date) AS n,
    CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY ts) - 1 AS INTEGER) AS i,
    first_value(open) OVER (PARTITION BY symbol, date ORDER BY ts) AS o FROM {bars}),
  d1 AS MATERIALIZED (SELECT symbol, date, ts, i, n, o, kind, CASE WHEN kind = 1 THEN close ELSE -close END AS x
    FROM d0, (VALUES (1), (2)) k(kind) WHERE n >= {least}),
  r0 AS (SELECT *, CASE WHEN x IS DISTINCT FROM lag(x) OVER w THEN 1 ELSE 0 END AS c FROM d1 WINDOW w AS (PARTITION BY kind, symbol, date ORDER BY i)),
  r1 AS (SELECT *, sum(c) OVER (PARTITION BY kind, symbol, date ORDER BY i) AS run FROM r0),
  r2 AS (SELECT kind, symbol, date, run, x, min(i) AS a, max(i) AS b FROM r1 GROUP BY 1, 2, 3, 4, 5),
  r3 AS (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM r2 WINDOW w AS (PARTITION BY kind, symbol, date ORDER BY run)),
  cand AS MATERIALIZED (SELECT kind, symbol, date, CAST((a + b) // 2 AS INTEGER) AS i, x AS h FROM r3 WHERE x > px AND x > nx),
  w0 AS (SELECT c.kind, c.symbol, c.date, c.i, c.h, coalesce(max(d.i) FILTER (d.i < c.i AND d.x > c.h), -1) AS lo,
           coalesce(min(d.i) FILTER (d.i > c.i AND d.x > c.h), 1000000) AS hi
         FROM cand c JOIN d1 d USING (kind, symbol, date) GROUP BY 1, 2, 3, 4, 5),
  w1 AS (SELECT c.kind, c.symbol, c.date, c.i, c.h, c.lo, c.hi, c.h - greatest(min(d.x) FILTER (d.i > c.lo AND d.i <= c.i), min(d.x) FILTER (d.i < c.hi AND d.i >= c.i)) AS prom
         FROM w0 c JOIN d1 d USING (kind, symbol, date) GROUP BY c.kind, c.symbol, c.date, c.i, c.h, c.lo, c.hi),
  w2 AS (SELECT c.kind, c.symbol, c.date, c.i, c.h, c.prom, h - prom * 0.5 AS lev, max(d.i) FILTER (d.i < c.i AND d.x <= h - prom * 0.5) AS l,
           min(d.i) FILTER (d.i > c.i AND d.x <= h - prom * 0.5) AS r
         FROM w1 c JOIN d1 d USING (kind, symbol, date) GROUP BY c.kind, c.symbol, c.date, c.i, c.h, c.lo, c.hi, c.prom),
  meas AS MATERIALIZED (SELECT c.kind, c.symbol, c.date, c.i, c.h, c.prom,
           (r - (lev - rx.x) / (ry.x - rx.x)) - (l + (lev - lx.x) / (ly.x - lx.x)) AS width
         FROM w2 c JOIN d1 lx ON (lx.kind, lx.symbol, lx.date, lx.i) = (c.kind, c.symbol, c.date, c.l)
         JOIN d1 ly ON (ly.kind, ly.symbol, ly.date, ly.i) = (c.kind, c.symbol, c.date, c.l + 1)
         JOIN d1 rx ON (rx.kind, rx.symbol, rx.date, rx.i) = (c.kind, c.symbol, c.date, c.r)
         JOIN d1 ry ON (ry.kind, ry.symbol, ry.date, ry.i) = (c.kind, c.symbol, c.date, c.r - 1)),
  rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind, symbol, date ORDER BY h DESC, i DESC) AS k FROM meas),
  kept AS (SELECT kind, symbol, date, dist, k, [i] AS ids FROM rk, (VALUES {distances}) v(dist) WHERE k = 1
    UNION ALL SELECT r.kind, r.symbol, r.date, p.dist, r.k,
      CASE WHEN len(list_filter(p.ids, lambda q: abs(q - r.i) < p.dist)) > 0 THEN p.ids ELSE list_append(p.ids, r.i) END
    FROM kept p JOIN rk r ON (p.kind, p.symbol, p.date, p.k + 1) = (r.kind, r.symbol, r.date, r.k)),
  fin AS (SELECT kind, symbol, date, dist, unnest(arg_max(ids, k)) AS i FROM kept GROUP BY 1, 2, 3, 4),
  apart AS MATERIALIZED (SELECT m.*, dist FROM meas m JOIN fin USING (kind, symbol, date, i))"""


def turn_sql(body: str, v: LabelVariant, needs: str = "sess", bars: str = "sess", extra: str = "") -> str:
    src = TURNS.format(bars=bars, least=10, distances=f"({v.distance})")
    sel = f""", sel AS MATERIALIZED (SELECT a.*, b.ts, b.n FROM apart a JOIN (SELECT * FROM d1 WHERE kind = 1) b USING (symbol, date, i)
      WHERE prom >= b.o * CAST({v.prominence} AS DOUBLE) AND width >= {v.width})"""
    return with_tables(body, needs, recursive=True, extra=(extra + ", " if extra else "") + src + sel)


POINTS = "SELECT symbol, date, kind, i AS bar, ts, round(prom, 8) AS prominence, round(width, 8) AS width FROM sel"


@query("W-20", turn_sql(POINTS, label_variant("L1")))
def turning_points_strict(spark, folder):
    return rounded(L.turning_points(session(spark, folder), label_variant("L1")), ["prominence", "width"])


@query("W-20", turn_sql(POINTS, label_variant("L2")))
def turning_points_sensitive(spark, folder):
    return rounded(L.turning_points(session(spark, folder), label_variant("L2")), ["prominence", "width"])


LABELLED = """SELECT b.symbol, b.date, b.ts, b.close, CASE WHEN t.prom IS NOT NULL AND (p.prom IS NULL OR t.prom > p.prom) THEN 2
    WHEN p.prom IS NOT NULL THEN 1 ELSE 0 END AS label
  FROM (SELECT * FROM d0 WHERE n >= 10) b
  LEFT JOIN (SELECT * FROM sel WHERE kind = 1) p ON (p.symbol, p.date, p.i + {s}) = (b.symbol, b.date, b.i)
  LEFT JOIN (SELECT * FROM sel WHERE kind = 2) t ON (t.symbol, t.date, t.i + {s}) = (b.symbol, b.date, b.i)"""


@query("W-21 P-05 U-01", turn_sql(LABELLED.format(s=1), label_variant("L2")))
def labels_next_bar(spark, folder):
    return L.label_bars(session(spark, folder), label_variant("L2")).select("symbol", "date", "ts", "close", "label")


@query("W-21", turn_sql(LABELLED.format(s=0), label_variant("L3")))
def labels_same_bar(spark, folder):
    return L.label_bars(session(spark, folder), label_variant("L3")).select("symbol", "date", "ts", "close", "label")


FIVE = """five AS MATERIALIZED (SELECT symbol, CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS DATE) AS date, time_bucket(INTERVAL 5 MINUTE, ts) AS ts,
  arg_min(open, ts) AS open, arg_max(close, ts) AS close FROM sess GROUP BY 1, 2, 3)"""


@query("W-21 A-01", turn_sql(LABELLED.format(s=1), label_variant("L1", "5m"), bars="five", extra=FIVE))
def labels_five_minutes(spark, folder):
    five = session_bars(resample(minute_bars(spark, folder)), "us")
    return L.label_bars(five, label_variant("L1", "5m")).select("symbol", "date", "ts", "close", "label")


@query(
    "J-01 A-38",
    with_tables(
        """SELECT s.symbol, s.ts, coalesce(m.label, s.label) AS label FROM scored s
        LEFT JOIN (SELECT symbol, ts, CAST(volume % 3 AS INTEGER) AS label FROM bars WHERE volume % 10 = 0) m ON s.symbol = m.symbol AND s.ts = m.ts""",
        "scored",
    ),
)
def labels_overridden(spark, folder):
    manual = minute_bars(spark, folder).filter(F.col("volume") % 10 == 0)
    manual = manual.select("symbol", "ts", (F.col("volume") % 3).cast("int").alias("label"))
    return L.apply_overrides(scored(spark, folder), manual).select("symbol", "ts", "label")


@query(
    "A-38",
    with_tables(
        """SELECT symbol, ts, CAST(label AS INTEGER) AS label FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn FROM (
          SELECT symbol, ts, volume % 3 AS label, -1 AS seq FROM sess WHERE volume % 4 = 0
          UNION ALL SELECT symbol, ts, volume % 2, 1 FROM sess WHERE volume % 8 = 0
          UNION ALL SELECT symbol, ts, 2, 2 FROM sess WHERE volume % 24 = 0)) WHERE rn = 1 AND label <> 0""",
        "sess",
    ),
)
def label_edits(spark, folder):
    s = session(spark, folder)

    def edits(modulus, label, seq):
        return s.filter(F.col("volume") % modulus == 0).select("symbol", "ts", label.cast("int").alias("label"), F.lit(seq).cast("long").alias("seq"))

    v = F.col("volume")
    return L.edit_overrides(edits(4, v % 3, 0).drop("seq"), edits(8, v % 2, 1).union(edits(24, F.lit(2), 2)))


@query(
    "A-07 X-02",
    with_tables(
        """SELECT CAST(sum(n) AS BIGINT) AS total_bars, CAST(sum(n) - sum(p) - sum(t) AS BIGINT) AS n_neither, CAST(sum(p) AS BIGINT) AS n_peaks,
          CAST(sum(t) AS BIGINT) AS n_troughs, round(sum(p) / sum(n), 8) AS peak_ratio, round(sum(t) / sum(n), 8) AS trough_ratio,
          count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_days, round(avg(p), 8) AS avg_peaks_per_day,
          round(avg(t), 8) AS avg_troughs_per_day, round(stddev_samp(p), 8) AS std_peaks_per_day, round(stddev_samp(t), 8) AS std_troughs_per_day
        FROM (SELECT symbol, date, count(*) AS n, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 2) AS t FROM scored GROUP BY 1, 2)""",
        "scored",
    ),
)
def label_summary(spark, folder):
    out = L.label_statistics(scored(spark, folder))
    return rounded(out, [c for c in out.columns if c.endswith(("ratio", "day"))])


@query("A-08", with_tables("SELECT symbol, label, count(*) AS n FROM scored GROUP BY 1, 2", "scored"))
def label_counts(spark, folder):
    return L.label_counts(scored(spark, folder))


GRID = """SELECT b.symbol, b.date, b.n AS n_bars, CAST(pct AS DOUBLE) AS prominence_pct, dist AS distance, w AS width,
    count(*) FILTER (a.kind = 1 AND prom >= b.o * CAST(pct AS DOUBLE) AND a.width >= w) AS n_peaks,
    count(*) FILTER (a.kind = 2 AND prom >= b.o * CAST(pct AS DOUBLE) AND a.width >= w) AS n_troughs
  FROM (SELECT DISTINCT symbol, date, CAST(n AS INTEGER) AS n, o FROM d1) b
  CROSS JOIN (VALUES (0.001), (0.002), (0.003), (0.005), (0.007), (0.01)) p(pct) CROSS JOIN (VALUES (3), (5), (7), (10)) q(dist)
  CROSS JOIN (VALUES (1), (2), (3), (5)) r(w) LEFT JOIN apart a USING (symbol, date, dist) GROUP BY ALL"""


@query(
    "A-36 J-11",
    with_tables(
        f"""SELECT symbol, date, n_bars, prominence_pct, distance, width, CAST(n_peaks AS INTEGER) AS n_peaks, CAST(n_troughs AS INTEGER) AS n_troughs,
          CAST(n_peaks + n_troughs AS INTEGER) AS total_labels, round((n_peaks + n_troughs) / n_bars, 8) AS label_ratio FROM ({GRID})""",
        "sess",
        recursive=True,
        extra=TURNS.format(bars="sess", least=1, distances="(3), (5), (7), (10)"),
    ),
)
def labelling_grid(spark, folder):
    return rounded(L.parameter_grid(session(spark, folder)), ["label_ratio"])


@query(
    "J-16",
    with_tables(
        """SELECT p.symbol, p.ts, p.peak_prob, t.label AS true_label FROM scored p JOIN scored t ON p.symbol = t.symbol AND p.ts = t.ts
        WHERE t.volume % 2 = 0""",
        "scored",
    ),
)
def truth_beside_scores(spark, folder):
    s = scored(spark, folder)
    truth = s.filter(F.col("volume") % 2 == 0)
    return truth_beside_predictions(s.select("symbol", "ts", "peak_prob"), truth)


@query(
    "J-17",
    with_tables(
        """SELECT s.symbol, s.ts, CASE WHEN d.date < DATE '2024-01-18' THEN 'train' WHEN d.date < DATE '2024-01-25' THEN 'val' ELSE 'test' END AS split
        FROM sess s JOIN (SELECT DISTINCT date FROM sess) d ON s.date = d.date""",
        "sess",
    ),
)
def bars_with_split(spark, folder):
    s = session(spark, folder)
    day = F.col("date")
    split = F.when(day < "2024-01-18", "train").when(day < "2024-01-25", "val").otherwise("test")
    return by_split_dates(s.select("symbol", "ts", "date"), s.select("date", split.alias("split"))).select("symbol", "ts", "split")
