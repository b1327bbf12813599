"""Event tracks per job: as-of joins, resampling, classification, clusters, zoom regions and smoothed paths.

A track is points(job_id, t, x, y, ...), at most one for each job and time unless said otherwise. As-of joins are one union and one window, never a
join of every query with every sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import EPS, trapezoid
from . import review, scan
from .intervals import near_points


def _brackets(queries: DataFrame, track: DataFrame, inclusive: bool) -> DataFrame:
    """Each query (job_id, t, ...) with the samples around it: before (t < q, or t <= q if inclusive) and after, as structs of t, x, y."""
    q = queries.withColumn("s", F.lit(None).cast("struct<t:double,x:double,y:double>"))
    rows = q.unionByName(track.select("job_id", "t", F.struct("t", "x", "y").alias("s")), allowMissingColumns=True)
    turn = F.col("s").isNull().cast("int") if inclusive else F.col("s").isNotNull().cast("int")
    return scan.around(rows.withColumn("turn", turn), F.col("t"), ["t", "turn"], "s").where("s IS NULL").select(*queries.columns, "before", "after")


def _between(before: Column, after: Column, t: Column, axis: str) -> Column:
    return before[axis] + (after[axis] - before[axis]) * ((t - before["t"]) / (after["t"] - before["t"]))


def _asked(queries: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """job_id, keep, t. Times that are asked for by themselves are asked once; rows that keep more are all there, so that no table of frames is joined to its own positions."""
    return queries.where("job_id IS NOT NULL").select("job_id", *keep, "t") if keep else queries.select("job_id", "t").distinct()


def position_at(queries: DataFrame, track: DataFrame, hold: float = 0.15, keep: tuple[str, ...] = ()) -> DataFrame:
    """Positions by holding over gaps longer than `hold` and interpolating over others; the ends clamp. A sample exactly at t is `after`. keep: more columns of the queries."""
    b = _brackets(_asked(queries, keep), track, inclusive=False)
    gap = F.col("after.t") - F.col("before.t")
    one = F.coalesce("before", "after")
    still = F.col("before").isNull() | F.col("after").isNull() | (gap > hold) | (gap <= 0)
    axis = lambda c: F.when(still, one[c]).otherwise(_between(F.col("before"), F.col("after"), F.col("t"), c))
    return b.select("job_id", *keep, "t", axis("x").alias("x"), axis("y").alias("y"))


def position_linear(queries: DataFrame, track: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Plain linear interpolation, clamped at the ends; without samples the middle of the frame. keep: more columns of the queries."""
    b = _brackets(_asked(queries, keep), track, inclusive=True)
    one = F.coalesce("before", "after")
    still = F.col("before").isNull() | F.col("after").isNull() | (F.col("after.t") - F.col("before.t") <= 0)
    axis = lambda c: F.coalesce(F.when(still, one[c]).otherwise(_between(F.col("before"), F.col("after"), F.col("t"), c)), F.lit(0.5))
    return b.select("job_id", *keep, "t", axis("x").alias("x"), axis("y").alias("y"))


def grid(durations: DataFrame, hz: float) -> DataFrame:
    """job_id, i, t: times 0, step, ... not beyond the duration."""
    step = F.lit(1.0 / hz)
    rows = durations.select("job_id", "duration", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / step).cast("int"))).alias("i"))
    return rows.select("job_id", "i", F.least(F.col("i") * step, F.col("duration")).alias("t"))


def resample(track: DataFrame, durations: DataFrame, hz: float = 30.0, hold: float = 0.15) -> DataFrame:
    """The track on a fixed grid over the whole duration: job_id, i, t, x, y."""
    return position_at(grid(durations, hz), track, hold, keep=("i",))


def _gaps(track: DataFrame) -> DataFrame:
    """The track with `gap`, the time since the sample before; null for the first."""
    return scan.neighbour(track, F.col("t"), ["t"], {"last_t": "t"}, back=True).withColumn("gap", F.col("t") - F.col("last_t")).drop("last_t")


def upper_median_gap(track: DataFrame) -> DataFrame:
    """job_id, gap: the upper middle of the sorted sample gaps; 0.05 for fewer than two samples."""
    gaps = _gaps(track).select("job_id", F.col("gap").alias("value"))
    middle = review.at_rank(gaps, lambda n: F.floor(n / 2))
    return middle.select("job_id", F.coalesce("value", F.lit(0.05)).alias("gap"))


def resting(track: DataFrame, radius: float = 0.01, window: float = 0.3) -> DataFrame:
    """The track with `resting`: all earlier samples within the window are within the radius, there are some, and they reach back half of it."""
    # a range frame on whole milliseconds, a little wide; the filter is exact
    w = Window.partitionBy("job_id").orderBy(F.floor(F.col("t") * 1000)).rangeBetween(-int(window * 1000) - 2, 0)
    past = F.filter(F.collect_list(F.struct("t", "x", "y")).over(w), lambda z: (z["t"] < F.col("t")) & (F.col("t") - z["t"] <= window))
    near = F.forall("past", lambda z: F.hypot(z["x"] - F.col("x"), z["y"] - F.col("y")) <= radius)
    reach = F.col("t") - F.array_min(F.transform("past", lambda z: z["t"])) >= window / 2
    return track.withColumn("past", past).withColumn("resting", (F.size("past") > 0) & near & F.coalesce(reach, F.lit(False))).drop("past")


def classify(track: DataFrame, clicks: DataFrame, click_window: float, radius: float = 0.01, window: float = 0.3) -> DataFrame:
    """job_id, t, x, y, kind, weight: click near a click's time, else dwell while resting, else movement; x and y clamped to the frame.

    Clicks are found by buckets as wide as the window, so the band join is an equi-join on three neighbouring buckets.
    """
    b = F.floor(F.col("t") / click_window).cast("long")
    c = clicks.select("job_id", F.col("t").alias("c"), F.explode(F.array(b - 1, b, b + 1)).alias("bucket"))
    t = resting(track, radius, window).withColumn("bucket", b)
    near = t.join(c, ["job_id", "bucket"]).where(F.abs(F.col("t") - F.col("c")) <= click_window).select("job_id", "t").distinct().withColumn("clicked", F.lit(True))
    kind = F.when(F.col("clicked"), "click").when(F.col("resting"), "dwell").otherwise("movement")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x)))
    return t.join(near, ["job_id", "t"], "left").select("job_id", "t", unit("x").alias("x"), unit("y").alias("y"), kind.alias("kind"), F.when(kind == "click", 1.0).when(kind == "dwell", 0.6).otherwise(0.3).alias("weight"))


def sampling_stats(track: DataFrame) -> DataFrame:
    """job_id, n_gaps, mean_gap, median_gap, min_gap, max_gap, p95_gap, normalized: of positive gaps only."""
    rows = _gaps(track).select("job_id", "x", "y", F.when(F.col("gap") > 0, F.col("gap")).alias("gap"))
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    per = rows.groupBy("job_id").agg(
        F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.bool_and(inside).alias("normalized")
    )
    p95 = review.at_rank(rows.select("job_id", F.col("gap").alias("value")), lambda n: F.floor(n * 0.95)).withColumnRenamed("value", "p95_gap")
    return per.join(p95, "job_id")


def clusters(points: DataFrame, min_gap: float) -> DataFrame:
    """Notable points (click, dwell, manual) with `cluster`: a new one begins after a gap of more than min_gap."""
    gaps = _gaps(points.where(F.col("kind").isin("click", "dwell", "manual")))
    new = F.coalesce(F.col("gap") > min_gap, F.lit(True))
    # of points at one time the first one has the gap, so it comes first here, too
    order = ["t", F.col("gap").desc_nulls_first()]
    return scan.running(gaps, F.col("t"), order, {"cluster": ("sum", new.cast("int"))}, inclusive=True).drop("gap")


def zoom_regions(points: DataFrame, min_gap: float, min_dwell: float, zoom: float) -> DataFrame:
    """job_id, t_in, t_out, cx, cy: clusters that last, around their weighted middle, kept inside the frame; rounded to 6 places."""
    half = 1.0 / zoom / 2
    per = clusters(points, min_gap).groupBy("job_id", "cluster").agg(F.min("t").alias("t_in"), F.max("t").alias("t_out"), F.sum(F.col("x") * F.col("weight")).alias("sx"), F.sum(F.col("y") * F.col("weight")).alias("sy"), F.sum("weight").alias("sw"))
    total = F.when(F.col("sw") == 0, 1.0).otherwise(F.col("sw"))
    mid = lambda s: F.greatest(F.lit(half), F.least(F.lit(1 - half), F.col(s) / total))
    return per.where(F.col("t_out") - F.col("t_in") >= min_dwell).select("job_id", F.bround("t_in", 6).alias("t_in"), F.bround("t_out", 6).alias("t_out"), F.bround(mid("sx"), 6).alias("cx"), F.bround(mid("sy"), 6).alias("cy"))


def separate(regions: DataFrame, ease: float) -> DataFrame:
    """Regions closer than two eases to the one before begin later; those emptied go."""
    prev = F.lag("t_out").over(Window.partitionBy("job_id").orderBy("t_in"))
    gap = F.col("t_in") - prev
    return regions.withColumn("t_in", F.when(gap < 2 * ease, prev + gap / 2 + ease / 2).otherwise(F.col("t_in"))).where("t_out > t_in")


def envelope(times: DataFrame, regions: DataFrame, zoom: float, ease: float) -> DataFrame:
    """times (job_id, t, ...) with zoom, cx, cy: regions blended at each time by their trapezoids; without any, the whole frame."""
    r = regions.select(F.col("job_id").alias("j"), F.col("t_in").alias("r_in"), F.col("t_out").alias("r_out"), "cx", "cy")
    wide = r.withColumn("lo", F.col("r_in") - ease).withColumn("hi", F.col("r_out") + ease)
    near = near_points(times, F.col("t"), wide, "lo", "hi", F.col("t").between(F.col("lo"), F.col("hi")), "left")
    w = F.coalesce(trapezoid(F.col("t"), F.col("r_in"), F.col("r_out"), ease), F.lit(0.0))
    w = F.when(F.col("j").isNull(), 0.0).otherwise(w)
    per = near.withColumn("w", w).groupBy(*times.columns).agg(F.sum("w").alias("w"), F.sum(F.coalesce("cx", F.lit(0.0)) * F.col("w")).alias("x"), F.sum(F.coalesce("cy", F.lit(0.0)) * F.col("w")).alias("y"))
    rest = 0.5 * F.greatest(F.lit(0.0), 1 - F.col("w"))
    return per.select(*times.columns, (1 + (zoom - 1) * F.col("w")).alias("zoom"), (F.col("x") + rest).alias("cx"), (F.col("y") + rest).alias("cy"))


def focus_buckets(points: DataFrame, bucket: float = 2.0) -> DataFrame:
    """job_id, bucket, n_clicks, n_dwell, dwell_share, mean_x, mean_y: buckets with something notable. A point exactly at the end is not counted."""
    end = F.max("t").over(Window.partitionBy("job_id"))
    notable = F.col("kind").isin("click", "dwell")
    rows = points.withColumn("end", end).where("t < end").withColumn("bucket", F.floor(F.col("t") / bucket))
    per = rows.groupBy("job_id", "bucket").agg(F.count_if(F.col("kind") == "click").alias("n_clicks"), F.count_if(F.col("kind") == "dwell").alias("n_dwell"), F.count("*").alias("n"), F.avg(F.when(notable, F.col("x"))).alias("mean_x"), F.avg(F.when(notable, F.col("y"))).alias("mean_y"))
    return per.where("n_clicks + n_dwell > 0").select("job_id", "bucket", "n_clicks", "n_dwell", (F.col("n_dwell") / F.col("n")).alias("dwell_share"), "mean_x", "mean_y")


PATH = "job_id long, i int, t double, cx double, cy double"


def crop_path(track: DataFrame, durations: DataFrame, fps: float = 30.0, lag_ms: float = 250.0, max_step: float = 0.012, half_w: float = 0.158, half_h: float = 0.5) -> DataFrame:
    """A lagging, rate-limited path after the track, kept inside the frame: PATH. State runs from frame to frame, so each job is one group of an Arrow function."""
    frames = durations.select("job_id", F.explode(F.sequence(F.lit(0), F.greatest(F.bround(F.col("duration") * fps), F.lit(1)).cast("int") - 1)).alias("i")).withColumn("t", F.col("i") / F.lit(fps))
    at = position_linear(frames, track, keep=("i",))
    alpha = 1 - float(np.exp(-(1 / fps) / (max(lag_ms, 1.0) / 1000)))

    def follow(pdf):
        pdf = pdf.sort_values("i")
        lo_x, hi_x, lo_y, hi_y = half_w, 1 - half_w, half_h, 1 - half_h
        clamp = lambda v, lo, hi: min(max(v, lo), hi)
        cx = cy = None
        out = []
        for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist()):
            if cx is None:
                cx, cy = clamp(x, lo_x, hi_x), clamp(y, lo_y, hi_y)
            else:
                dx, dy = alpha * (x - cx), alpha * (y - cy)
                step = float(np.hypot(dx, dy))
                if step > max_step:
                    dx, dy = dx * max_step / step, dy * max_step / step
                cx, cy = clamp(cx + dx, lo_x, hi_x), clamp(cy + dy, lo_y, hi_y)
            out.append((round(cx, 6), round(cy, 6)))
        return pdf[["job_id", "i", "t"]].assign(cx=[o[0] for o in out], cy=[o[1] for o in out])

    return at.groupBy("job_id").applyInPandas(follow, PATH)


def max_step(path: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("i")
    step = F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))
    return path.select("job_id", step.alias("step")).groupBy("job_id").agg(F.coalesce(F.max("step"), F.lit(0.0)).alias("max_step"))


def change_only(frames: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose rounded value differs from the row before, per job and key; the first always stays."""
    w = Window.partitionBy("job_id", key).orderBy("i")
    v = F.bround(value).cast("long")
    return frames.withColumn("v", v).withColumn("prev", F.lag("v").over(w)).where(~F.col("v").eqNullSafe(F.col("prev"))).select("job_id", key, "i", F.col("v").alias(value))


def duck_envelope(captions: DataFrame, duck_db: float = -12.0, ramp: float = 0.2, steps: int = 4) -> DataFrame:
    """job_id, block_ix, t, gain_db: ramps down before and up after each caption, in steps; never before 0."""
    share = F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: k / steps))
    base = captions.select("job_id", "block_ix", "t_in", "t_out", share.alias("f"))
    down = base.select("job_id", "block_ix", F.greatest(F.col("t_in") - F.lit(ramp) * (1 - F.col("f")), F.lit(0.0)).alias("t"), (F.col("f") * duck_db).alias("gain_db"))
    up = base.select("job_id", "block_ix", (F.col("t_out") + F.lit(ramp) * F.col("f")).alias("t"), ((1 - F.col("f")) * duck_db).alias("gain_db"))
    return down.unionByName(up)
