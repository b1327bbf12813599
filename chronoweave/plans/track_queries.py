"""Queries over event tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks as tr
from . import adapters as ad
from .adapters import sql

Q, S = {}, {}


def _q(query_sql):
    def register(f):
        Q[f.__name__], S[f.__name__] = f, query_sql
        return f

    return register


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_ASKED = dict(asked="SELECT DISTINCT job_id, t + 0.25 * k AS t FROM points, range(2) r(k)")


def _asked(spark, d):
    return ad.points(spark, d).select("job_id", F.explode(F.array("t", F.col("t") + 0.25)).alias("t")).distinct()


def _asof(cond: str) -> dict[str, str]:
    return _ASKED | dict(
        befores=f"SELECT q.job_id, q.t, p.t AS bt, p.x AS bx, p.y AS bputy FROM asked q ASOF LEFT JOIN points p ON q.job_id = p.job_id AND q.t {'>' if cond == '<' else '>='} p.t",
        around=f"SELECT b.*, p.t AS at_, p.x AS ax, p.y AS ay FROM befores b ASOF LEFT JOIN points p ON b.job_id = p.job_id AND b.t {'<=' if cond == '<' else '<'} p.t",
    )


@_q(sql("""SELECT job_id, round(t, 6) AS t, round(CASE WHEN bt IS NULL THEN ax WHEN at_ IS NULL OR at_ - bt > 1.5 OR at_ - bt <= 0 THEN bx ELSE bx + (ax - bx) * ((t - bt) / (at_ - bt)) END, 6) AS x,
  round(CASE WHEN bt IS NULL THEN ay WHEN at_ IS NULL OR at_ - bt > 1.5 OR at_ - bt <= 0 THEN bputy ELSE bputy + (ay - bputy) * ((t - bt) / (at_ - bt)) END, 6) AS y FROM around""", **_asof("<")))  # fmt: skip
def asof_hold_interpolate(spark, d):
    return _rounded(tr.position_at(_asked(spark, d), ad.points(spark, d), 1.5), "t", "x", "y")


_LINEAR = """SELECT job_id, round(t, 6) AS t, round(CASE WHEN bt IS NULL THEN ax WHEN at_ IS NULL OR at_ - bt <= 0 THEN bx ELSE bx + (ax - bx) * ((t - bt) / (at_ - bt)) END, 6) AS x,
  round(CASE WHEN bt IS NULL THEN ay WHEN at_ IS NULL OR at_ - bt <= 0 THEN bputy ELSE bputy + (ay - bputy) * ((t - bt) / (at_ - bt)) END, 6) AS y FROM around"""


@_q(sql(_LINEAR, **_asof("<=")))
def asof_linear(spark, d):
    return _rounded(tr.position_linear(_asked(spark, d), ad.points(spark, d)), "t", "x", "y")


_GRID = "SELECT job_id, i, least(i * (1.0::DOUBLE / 2.0), duration) AS t FROM (SELECT job_id, duration, unnest(range(CAST(floor(duration / (1.0::DOUBLE / 2.0)) AS BIGINT) + 1)) AS i FROM durations)"


@_q(sql("""SELECT g.job_id, g.i, round(g.t, 6) AS t, round(CASE WHEN bt IS NULL THEN ax WHEN at_ IS NULL OR at_ - bt > 1.5 OR at_ - bt <= 0 THEN bx ELSE bx + (ax - bx) * ((a.t - bt) / (at_ - bt)) END, 6) AS x,
  round(CASE WHEN bt IS NULL THEN ay WHEN at_ IS NULL OR at_ - bt > 1.5 OR at_ - bt <= 0 THEN bputy ELSE bputy + (ay - bputy) * ((a.t - bt) / (at_ - bt)) END, 6) AS y FROM ticks g JOIN around a ON g.job_id = a.job_id AND g.t = a.t""",
    ticks=_GRID, **(_asof("<") | dict(asked="SELECT DISTINCT job_id, t FROM ticks"))))
def resample_grid(spark, d):
    return _rounded(tr.resample(ad.points(spark, d), ad.durations(spark, d), 2.0, 1.5), "t", "x", "y")


_REST = dict(
    rested="""SELECT a.job_id, a.t, a.x, a.y, count(b.t) > 0 AND coalesce(bool_and(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) <= 0.3), true) AND coalesce(a.t - min(b.t) >= 0.5, false) AS resting
      FROM points a LEFT JOIN points b ON a.job_id = b.job_id AND b.t < a.t AND a.t - b.t <= 1.0 GROUP BY a.job_id, a.t, a.x, a.y""",
)


@_q(sql("SELECT job_id, round(t, 6) AS t, resting FROM rested", **_REST))
def resting_points(spark, d):
    return _rounded(tr.resting(ad.points(spark, d), 0.3, 1.0).select("job_id", "t", "resting"), "t")


@_q(sql("""SELECT job_id, round(t, 6) AS t, x, y, kind, CASE kind WHEN 'click' THEN 1.0::DOUBLE WHEN 'dwell' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM
  (SELECT job_id, t, greatest(0.0, least(1.0, x)) AS x, greatest(0.0, least(1.0, y)) AS y,
    CASE WHEN EXISTS (SELECT 1 FROM points c WHERE c.job_id = r.job_id AND c.kind = 'click' AND abs(r.t - c.t) <= 0.25) THEN 'click' WHEN resting THEN 'dwell' ELSE 'movement' END AS kind FROM rested r)""", **_REST))  # fmt: skip
def classify_points(spark, d):
    p = ad.points(spark, d)
    return _rounded(tr.classify(p.drop("kind", "weight"), p.where("kind = 'click'"), 0.25, 0.3, 1.0), "t")


_GAPS = dict(deltas="SELECT job_id, t - lag(t) OVER (PARTITION BY job_id ORDER BY t) AS gap, x, y FROM points")


@_q(sql("SELECT job_id, round(CASE WHEN len(g) > 0 THEN g[len(g) // 2 + 1] ELSE 0.05 END, 6) AS gap FROM (SELECT job_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS g FROM deltas GROUP BY job_id)", **_GAPS))
def upper_median_gap(spark, d):
    return _rounded(tr.upper_median_gap(ad.points(spark, d)), "gap")


@_q(sql("""SELECT job_id, n_gaps, round(mean_gap, 6) AS mean_gap, round(median_gap, 6) AS median_gap, round(min_gap, 6) AS min_gap, round(max_gap, 6) AS max_gap, round(g[least(CAST(floor(len(g) * 0.95) AS BIGINT), len(g) - 1) + 1], 6) AS p95_gap, normalized FROM
  (SELECT job_id, count(gap) FILTER (gap > 0) AS n_gaps, avg(gap) FILTER (gap > 0) AS mean_gap, median(gap) FILTER (gap > 0) AS median_gap, min(gap) FILTER (gap > 0) AS min_gap, max(gap) FILTER (gap > 0) AS max_gap,
    list_sort(list(gap) FILTER (gap > 0)) AS g, bool_and(x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) AS normalized FROM deltas GROUP BY job_id)""", **_GAPS))  # fmt: skip
def sampling_stats(spark, d):
    return _rounded(tr.sampling_stats(ad.points(spark, d)), "mean_gap", "median_gap", "min_gap", "max_gap", "p95_gap")


_CLUSTERS = dict(
    clustered="""SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1.2 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t) AS cluster FROM
      (SELECT *, t - lag(t) OVER (PARTITION BY job_id ORDER BY t) AS gap FROM points WHERE kind IN ('click', 'dwell'))""",
    regions="""SELECT job_id, round(min(t), 6) AS t_in, round(max(t), 6) AS t_out, round(greatest(0.5 / 1.35, least(1 - 0.5 / 1.35, sum(x * weight) / CASE sum(weight) WHEN 0 THEN 1 ELSE sum(weight) END)), 6) AS cx,
      round(greatest(0.5 / 1.35, least(1 - 0.5 / 1.35, sum(y * weight) / CASE sum(weight) WHEN 0 THEN 1 ELSE sum(weight) END)), 6) AS cy FROM clustered GROUP BY job_id, cluster HAVING max(t) - min(t) >= 0.6""",
    parted="""SELECT job_id, CASE WHEN t_in - prev < 0.7 THEN prev + (t_in - prev) / 2 + 0.35 / 2 ELSE t_in END AS t_in, t_out, cx, cy FROM (SELECT *, lag(t_out) OVER (PARTITION BY job_id ORDER BY t_in) AS prev FROM regions)""",
)


@_q(sql("SELECT job_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(min(t), 6) AS t_in, round(max(t), 6) AS t_out FROM clustered GROUP BY job_id, cluster", **_CLUSTERS))
def gap_clusters(spark, d):
    c = tr.clusters(ad.points(spark, d), 1.2).groupBy("job_id", "cluster").agg(F.count("*").alias("n"), F.min("t").alias("t_in"), F.max("t").alias("t_out"))
    return _rounded(c, "t_in", "t_out")


def _regions(spark, d):
    return tr.zoom_regions(ad.points(spark, d), 1.2, 0.6, 1.35)


@_q(sql("SELECT * FROM regions", **_CLUSTERS))
def zoom_regions(spark, d):
    return _regions(spark, d)


@_q(sql("SELECT job_id, round(t_in, 6) AS t_in, t_out, cx, cy FROM parted WHERE t_out > t_in", **_CLUSTERS))
def separate_regions(spark, d):
    return _rounded(tr.separate(_regions(spark, d), 0.35), "t_in")


@_q(sql("""SELECT job_id, i, round(1 + 0.35 * w, 6) AS zoom, round(x + 0.5 * greatest(0.0, 1 - w), 6) AS cx, round(y + 0.5 * greatest(0.0, 1 - w), 6) AS cy FROM
  (SELECT g.job_id, g.i, coalesce(sum(w), 0) AS w, coalesce(sum(cx * w), 0) AS x, coalesce(sum(cy * w), 0) AS y FROM ticks g LEFT JOIN
    (SELECT g.job_id, g.i, cx, cy, greatest(0.0, least(1.0, (g.t - (t_in - 0.35)) / 0.35, ((t_out + 0.35) - g.t) / 0.35)) AS w FROM ticks g JOIN regions r ON g.job_id = r.job_id) z ON z.job_id = g.job_id AND z.i = g.i GROUP BY g.job_id, g.i)""",
    ticks=_GRID, **_CLUSTERS))
def zoom_envelope(spark, d):
    e = tr.envelope(tr.grid(ad.durations(spark, d), 2.0), _regions(spark, d), 1.35, 0.35)
    return e.select("job_id", "i", *(F.round(c, 6).alias(c) for c in ("zoom", "cx", "cy")))


_BUCKETS = """SELECT job_id, CAST(floor(t / 2.0) AS BIGINT) AS bucket, count(*) FILTER (kind = 'click') AS n_clicks, count(*) FILTER (kind = 'dwell') AS n_dwell, count(*) AS n, avg(x) FILTER (kind <> 'movement') AS mean_x, avg(y) FILTER (kind <> 'movement') AS mean_y
  FROM points JOIN durations USING (job_id) WHERE t < duration GROUP BY 1, 2 HAVING count(*) FILTER (kind <> 'movement') > 0"""


@_q(sql("SELECT job_id, bucket, n_clicks, n_dwell, round(n_dwell / n, 6) AS dwell_share FROM b", b=_BUCKETS))
def focus_buckets(spark, d):
    return _rounded(tr.focus_buckets(ad.points(spark, d)), "dwell_share").select("job_id", "bucket", "n_clicks", "n_dwell", "dwell_share")


@_q(sql("SELECT job_id, bucket, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM b", b=_BUCKETS))
def focus_bucket_positions(spark, d):
    return _rounded(tr.focus_buckets(ad.points(spark, d)), "mean_x", "mean_y").select("job_id", "bucket", "mean_x", "mean_y")


# the smoothed path at two frames a second: its state runs on, which the SQL says by recursion
_PATH = _asof("<=") | dict(
    frames="SELECT job_id, unnest(range(greatest(CAST(round_even(duration * 2.0, 0) AS BIGINT), 1))) AS i FROM durations",
    asked="SELECT job_id, i / 2.0::DOUBLE AS t FROM frames",
    target="SELECT job_id, CAST(t * 2 AS BIGINT) AS i, x, y FROM (" + _LINEAR.replace("round(t, 6) AS t", "t").replace(", 6) AS", ", 15) AS") + ")",
)
_WALK = """WITH RECURSIVE {0},
path AS (SELECT job_id, i, least(greatest(x, 0.158), 1 - 0.158) AS cx, 0.5::DOUBLE AS cy, 0.0::DOUBLE AS step FROM target WHERE i = 0
  UNION ALL SELECT job_id, i, nx, 0.5::DOUBLE, abs(nx - cx) FROM (SELECT t.job_id, t.i, p.cx, least(greatest(p.cx + d * CASE WHEN sqrt(d * d + e * e) > 0.012 THEN 0.012 / sqrt(d * d + e * e) ELSE 1 END, 0.158), 1 - 0.158) AS nx
    FROM path p JOIN target t ON t.job_id = p.job_id AND t.i = p.i + 1, LATERAL (SELECT (1 - exp(-0.5 / 0.25)) * (t.x - p.cx) AS d, (1 - exp(-0.5 / 0.25)) * (t.y - 0.5) AS e)))
{1}"""


def _walk(body):
    return _WALK.format(",\n".join(f"{k} AS ({v})" for k, v in (ad.CTES | {k: _PATH[k] for k in ("frames", "asked", "befores", "around", "target")}).items()), body)


def _path(spark, d):
    return tr.crop_path(ad.points(spark, d), ad.durations(spark, d), fps=2.0)


@_q(_walk("SELECT job_id, i, round(i / 2.0, 6) AS t, round(cx, 6) AS cx, round(cy, 6) AS cy FROM path"))
def crop_path(spark, d):
    return _path(spark, d).select("job_id", F.col("i").cast("long").alias("i"), "t", "cx", "cy")


@_q(_walk("SELECT job_id, round(max(step), 3) AS max_step FROM path GROUP BY job_id"))
def crop_max_step(spark, d):
    return tr.max_step(_path(spark, d)).select("job_id", F.round("max_step", 3).alias("max_step"))


@_q(sql("""SELECT job_id, kind, id AS i, CAST(v AS BIGINT) AS x FROM (SELECT *, lag(v) OVER (PARTITION BY job_id, kind ORDER BY id) AS prev FROM (SELECT job_id, kind, id, round_even(x * 10, 0) AS v FROM points)) WHERE v IS DISTINCT FROM prev"""))
def change_only_emission(spark, d):
    f = ad.points(spark, d).select("job_id", "kind", F.col("id").alias("i"), (F.col("x") * 10).alias("x"))
    return tr.change_only(f, "kind", "x")


@_q(sql("""SELECT job_id, block_ix, round(greatest(t_in - 0.2::DOUBLE * (1 - k / 4), 0.0), 6) AS t, round(k / 4 * -12.0, 6) AS gain_db FROM blocks, range(1, 5) r(k)
  UNION ALL SELECT job_id, block_ix, round(t_out + 0.2::DOUBLE * (k / 4), 6), round((1 - k / 4) * -12.0, 6) FROM blocks, range(1, 5) r(k)"""))
def duck_envelope(spark, d):
    return _rounded(tr.duck_envelope(ad.blocks(spark, d)), "t", "gain_db")


@_q(sql("""SELECT job_id, CAST(count(*) AS BIGINT) AS n_spans, round(sum(source_out - source_in), 6) AS seconds FROM spans GROUP BY job_id"""))
def output_duration(spark, d):
    s = ad.spans(spark, d).groupBy("job_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("source_out") - F.col("source_in")).alias("seconds"))
    return _rounded(s, "seconds")


@_q(_walk("""SELECT job_id, 'crop_step' AS "check", 'FAIL' AS severity, 'path jumps' AS message, round(max(step), 3) AS value, 0.005::DOUBLE AS "limit" FROM path GROUP BY job_id HAVING max(step) > 0.005 + 1e-9"""))
def crop_continuity_findings(spark, d):
    from ..operators import checks

    return checks.crop_continuity(tr.max_step(_path(spark, d)), 0.005).withColumn("value", F.round("value", 3))
