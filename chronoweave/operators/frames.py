"""Geometry of the frame and selections on documents: safe areas, window fits, overlays of a kind, word emphasis, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHAR_RATIO = 0.58


def safe_pixels(top: Column, right: Column, bottom: Column, left: Column, width: Column, height: Column) -> Column:
    """The safe area in whole pixels, rounded inward."""
    return F.struct(F.ceil(left * width).alias("x0"), F.ceil(top * height).alias("y0"), F.floor((1 - right) * width).alias("x1"), F.floor((1 - bottom) * height).alias("y1"))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), F.greatest(hi, lo))


def captions_fit(max_chars: Column, type_scale: Column, box_w: Column, width: Column, height: Column) -> Column:
    return max_chars * CHAR_RATIO * type_scale * height <= box_w * width


def window_fit(source_w: Column, source_h: Column, width: Column, height: Column, zoom: Column) -> Column:
    """The part of the source that has the output's shape, tightened by the zoom (below 1 it loosens nothing), in shares."""
    zoom = F.greatest(zoom, F.lit(1.0))
    aspect = (width / height) / (source_w / source_h)
    return F.struct((F.least(F.lit(1.0), aspect) / zoom).alias("w"), (F.least(F.lit(1.0), 1 / aspect) / zoom).alias("h"))


def even(v: Column) -> Column:
    return F.greatest(F.bround(v / 2).cast("long") * 2, F.lit(2))


def frame_count(duration: Column, fps: float) -> Column:
    return F.greatest(F.bround(duration * fps).cast("long"), F.lit(1))


def narration_path(source: Column, synthesized: Column, has_audio: Column, audio_path: Column, path: Column) -> Column:
    return F.when(synthesized, audio_path).when(has_audio, path)


def one_pill(overlays: DataFrame, durations: DataFrame, least: float = 0.4) -> DataFrame:
    """The first overlay without times stays, others of its kind go; the rest are clamped to the recording and go if shorter than `least`."""
    r = F.row_number().over(Window.partitionBy("job_id").orderBy("ix"))
    pills = overlays.where("t_in IS NULL").withColumn("r", r).where("r = 1").drop("r")
    timed = overlays.where("t_in IS NOT NULL").join(durations, "job_id")
    timed = timed.withColumns({"t_in": F.greatest("t_in", F.lit(0.0)), "t_out": F.least("t_out", "duration")}).where(F.col("t_out") - F.col("t_in") >= least - 1e-6).drop("duration")
    return pills.unionByName(timed)


def emphasize(words: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every word with `emphasis`, set by the distinct places chosen(job_id, ix) that exist."""
    c = chosen.select("job_id", "ix").distinct().withColumn("emphasis", F.lit(True))
    return words.join(c, ["job_id", "ix"], "left").withColumn("emphasis", F.coalesce("emphasis", F.lit(False)))


def dropped_places(words: DataFrame, chosen: DataFrame) -> DataFrame:
    return chosen.select("job_id", "ix").distinct().join(words, ["job_id", "ix"], "left_anti")


def per_profile(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every job for every profile; profiles are a handful of rows."""
    return jobs.crossJoin(F.broadcast(profiles))


def stage_log(log: DataFrame) -> DataFrame:
    """job_id, n_ran, n_cached of (job_id, stage, cached)."""
    return log.groupBy("job_id").agg(F.count_if(~F.col("cached")).alias("n_ran"), F.count_if("cached").alias("n_cached"))


def least_capacity(profiles: DataFrame, key: str) -> DataFrame:
    """key, capacity: the fewest characters that a block may have in any of the profiles (max_chars, max_lines), 64 without any."""
    return profiles.groupBy(key).agg(F.coalesce(F.min(F.col("max_chars") * F.col("max_lines")), F.lit(64)).alias("capacity"))


def with_path(docs: DataFrame, path: str, value: Column) -> DataFrame:
    """Set a dotted path that exists; an unknown one is an error, no level is made."""
    docs.select(path)
    head, _, rest = path.partition(".")
    return docs.withColumn(head, F.col(head).withField(rest, value) if rest else value)
