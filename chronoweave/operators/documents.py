"""Whole edit documents: rules across their parts, content keys by stage, artifacts that are put in, text for a prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import word_budget
from ..functions.time import EPS
from ..sources.recordings import content_key
from .frames import with_path


def past_the_end(durations: DataFrame, **parts: DataFrame) -> DataFrame:
    """job_id, part, n, furthest: spans (job_id, t_out) that end after the recording does. A null end is open and never past it."""
    all_ = reduce(DataFrame.unionByName, (df.select("job_id", F.lit(name).alias("part"), F.col("t_out").cast("double").alias("t_out")) for name, df in parts.items()))
    late = all_.join(durations.select("job_id", "duration"), "job_id").where(F.col("t_out") > F.col("duration") + EPS)
    return late.groupBy("job_id", "part").agg(F.count("*").alias("n"), F.max("t_out").alias("furthest"))


def caption_overlaps(captions: DataFrame) -> DataFrame:
    """job_id, block_ix, next_ix: neighbours by start (ties by block_ix) that share more than EPS of time."""
    w = Window.partitionBy("job_id").orderBy("t_in", "block_ix")
    rows = captions.withColumn("n", F.lead(F.struct(F.col("block_ix").alias("ix"), "t_in", "t_out")).over(w))
    return rows.where((F.col("t_in") < F.col("n.t_out") - EPS) & (F.col("n.t_in") < F.col("t_out") - EPS)).select("job_id", "block_ix", F.col("n.ix").alias("next_ix"))


def stage_keys(docs: DataFrame, key: str, reads: dict[str, tuple[int, list[str], list[str]]]) -> DataFrame:
    """key, stage, cache_key for each stage of `reads` (name -> version, input columns, parameter columns).

    A key covers what its stage reads and nothing else, so a changed column gives new keys to the stages that read it only.
    """
    each = [F.struct(F.lit(stage).alias("stage"), content_key(F.lit(stage), F.lit(version), inputs, params).alias("cache_key")) for stage, (version, inputs, params) in reads.items()]
    return docs.select(key, F.explode(F.array(*each)).alias("s")).select(key, "s.stage", "s.cache_key")


def reusable(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """The keys with `path`, the artifact that stage_cache(cache_key, path) holds for them; null where the stage has to run. One key, one artifact."""
    return keys.join(cache.select("cache_key", "path"), "cache_key", "left").select(*keys.columns, "path")


def put_in(docs: DataFrame, path: str, value: Column, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, refused): the documents with `value` at a dotted path, by whether all rules hold then; null does not hold."""
    changed = with_path(docs, path, value)
    holds = reduce(Column.__and__, (F.coalesce(rule, F.lit(False)) for rule in rules.values()), F.lit(True))
    return changed.where(holds), changed.where(~holds)


def _two(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.00"))


def edit_content(durations: DataFrame, words: DataFrame, removals: DataFrame, points: DataFrame) -> DataFrame:
    """job_id, content: what a model is shown to rank a recording; formats and fixed lines are those of the surveyed prompt.

    words(job_id, ix, t_in, t_out, text), removals(job_id, t_in, t_out, kind), points(job_id, t, kind): seconds have two decimals; activity is
    told by two seconds up to the last point, movement alone is not. One string for each job, so a job's words meet in one task.
    """
    range_ = F.concat(F.lit("["), _two(F.col("t_in")), F.lit("-"), _two(F.col("t_out")), F.lit("] "))
    lines = lambda rows, order, line, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), by)
    said = words.groupBy("job_id").agg(lines(words, ["ix"], F.concat(range_, "text"), " ").alias("said"))
    cut = removals.groupBy("job_id").agg(lines(removals, ["t_in", "t_out"], F.concat(F.lit("  "), range_, "kind"), "\n").alias("cut"))
    ends = points.groupBy("job_id").agg(F.max("t").alias("end"))
    per = points.join(ends, "job_id").where("t < end").groupBy("job_id", "end", F.floor(F.col("t") / 2).alias("b"))
    n = per.agg(F.count_if(F.col("kind") == "click").alias("clicks"), F.count_if(F.col("kind") == "dwell").alias("dwell"), F.count("*").alias("n")).where((F.col("clicks") + F.col("dwell") > 0) & (F.col("b") * 2.0 < F.col("end") - EPS))
    one = lambda x: F.call_function("format_number", x, F.lit("0.0"))
    line = F.concat(F.lit("["), one(F.col("b") * 2.0), F.lit("-"), one(F.least(F.col("b") * 2.0 + 2.0, F.col("end"))), F.lit("] "), F.col("clicks").cast("string"), F.lit(" clicks, "), F.call_function("format_number", F.col("dwell") / F.col("n") * 100, F.lit("0")), F.lit("% dwell"))
    active = ends.join(n.groupBy("job_id").agg(lines(n, ["b"], line, "\n").alias("active")), "job_id", "left").select("job_id", F.concat(F.lit("cursor activity by 2s bucket:\n"), F.coalesce("active", F.lit("  (no clicks or dwell)"))).alias("active"))
    j = durations.select("job_id", "duration").join(said, "job_id", "left").join(cut, "job_id", "left").join(active, "job_id", "left")
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("Source duration: "), _two(F.col("duration")), F.lit("s")), F.lit(""),
        F.lit("Transcript, [start-end] word:"), F.coalesce("said", F.lit("  (no speech)")), F.lit(""),
        F.lit("Removals already proposed by arithmetic (accept or reject each):"), F.coalesce("cut", F.lit("  (none)")), F.lit(""),
        F.coalesce("active", F.lit("cursor: no track")),
    )
    return j.select("job_id", content.alias("content"))


def _one(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0"))


def _in_order(lines: Column, order: list[str], by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, lines.alias("line")))), lambda x: x["line"]), by)


def attention(points: DataFrame) -> DataFrame:
    """job_id, attention: where clicks and rests were, by two seconds up to the last point of points(job_id, t, x, y, kind); movement alone is not told."""
    ends = points.groupBy("job_id").agg(F.max("t").alias("end"))
    notable = points.join(ends, "job_id").where("t < end").where(F.col("kind").isin("click", "dwell"))
    start = F.col("b") * 2.0
    per = notable.groupBy("job_id", "end", F.floor(F.col("t") / 2).alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_if(F.col("kind") == "click").alias("clicks"), F.count_if(F.col("kind") == "dwell").alias("dwell"))
    at = F.concat(F.lit("] at ("), _two(F.col("x")), F.lit(", "), _two(F.col("y")), F.lit("), "), F.col("clicks").cast("string"), F.lit(" clicks, "), F.col("dwell").cast("string"), F.lit(" dwell"))
    line = F.concat(F.lit("["), _one(start), F.lit("-"), _one(F.least(start + 2.0, F.col("end"))), at)
    told = per.where(start < F.col("end") - EPS).groupBy("job_id").agg(_in_order(line, ["b"], "\n").alias("told"))
    head = F.lit("cursor attention by 2s bucket, normalized source coordinates:\n")
    return ends.join(told, "job_id", "left").select("job_id", F.concat(head, F.coalesce("told", F.lit("  (no clicks or dwell)"))).alias("attention"))


def overlay_content(durations: DataFrame, words: DataFrame, points: DataFrame, templates: list[str]) -> DataFrame:
    """job_id, content: what a model is shown to place overlays; formats and fixed lines are those of the surveyed prompt. A job's words meet in one task."""
    word = F.concat(F.lit("["), _two(F.col("t_in")), F.lit("-"), _two(F.col("t_out")), F.lit("] "), F.col("text"))
    said = words.groupBy("job_id").agg(_in_order(word, ["ix"], " ").alias("said"))
    j = durations.select("job_id", "duration").join(said, "job_id", "left").join(attention(points), "job_id", "left")
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("Source duration: "), _two(F.col("duration")), F.lit("s")), F.lit(""),
        F.lit("Templates available: " + ", ".join(templates)), F.lit(""),
        F.lit("Transcript, [start-end] word:"), F.coalesce("said", F.lit("  (no speech)")), F.lit(""),
        F.coalesce("attention", F.lit("cursor: no track")),
    )
    return j.select("job_id", content.alias("content"))


def _stripped(c: str) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def script_content(jobs: DataFrame, activity: DataFrame, per_second: float = 2.5) -> tuple[DataFrame, DataFrame]:
    """(drafts, without): job_id, content for each of jobs(job_id, brief, duration) that has a brief, and the jobs that have none. activity(job_id, active): what
    edit_content tells of the cursor. The budget of words is one at least; fixed lines are those of the surveyed prompt."""
    brief = jobs.withColumn("brief", _stripped("brief"))
    j = brief.where("brief <> ''").join(activity.select("job_id", "active"), "job_id", "left")
    words = word_budget(F.col("duration"), per_second)
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("Recording length: "), _two(F.col("duration")), F.lit("s")),
        F.concat(F.lit("Word budget: about "), words.cast("string"), F.lit(f" words (at {per_second:g} words/second; going over is a failed job, not a long one)")), F.lit(""),
        F.lit("Brief, in the author's own words:"), F.col("brief"), F.lit(""),
        F.coalesce("active", F.lit("cursor: no track")),
    )
    return j.select("job_id", content.alias("content")), brief.where("brief = ''").select("job_id")


def copy_content(renders: DataFrame) -> DataFrame:
    """job_id, profile, content of renders(job_id, profile, width, height, duration, spoken, script): what a model is shown to describe a render. The script is
    told only where it differs from what is heard; fixed lines are those of the surveyed prompt."""
    r = renders.withColumns({"spoken": _stripped("spoken"), "script": _stripped("script")})
    head = F.concat(F.lit("Render: "), "profile", F.lit(" ("), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("), "), _one(F.col("duration")), F.lit("s as edited."))
    heard = F.when(F.col("spoken") != "", F.col("spoken")).otherwise("(nothing is said in this render)")
    script = F.when((F.col("script") != "") & (F.col("script") != F.col("spoken")), F.concat(F.lit("\n\nThe full script, for context (the render above is the edit of it):\n"), "script")).otherwise("")
    return r.select("job_id", "profile", F.concat(head, F.lit("\n\nWhat a viewer of this render hears:\n"), heard, script).alias("content"))
