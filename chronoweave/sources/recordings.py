"""Readers of recordings' side files and of versioned documents; each has a parsing half that works on any DataFrame of raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from . import schemas

VERSION = 3


def _with_job(df: DataFrame) -> DataFrame:
    return df.withColumn("job_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))


def pixel_points(raw: DataFrame) -> DataFrame:
    """raw: job_id and schemas.PIXEL_EVENTS -> job_id, t, x, y in shares of the frame."""
    s = raw.select("job_id", "width", "height", F.explode("samples").alias("s"))
    return s.select("job_id", F.col("s.t").alias("t"), (F.col("s.x") / F.col("width")).alias("x"), (F.col("s.y") / F.col("height")).alias("y"))


def read_pixel_events(spark: SparkSession, path: str) -> DataFrame:
    """Unknown keys are ignored; job_id is the file's folder."""
    return pixel_points(_with_job(spark.read.schema(schemas.PIXEL_EVENTS).option("multiLine", True).json(path)))


def cursor_points(raw: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, clicks) on the recording's clock: time_ms / 1000 - start; rows before 0 are dropped, of clicks only presses stay."""
    j = raw.join(starts, "job_id")
    at = lambda c: F.col(c) / 1000 - F.col("start_time")
    moves = j.select("job_id", "start_time", F.explode("moves").alias("m")).select("job_id", at("m.time_ms").alias("t"), "m.x", "m.y").where("t >= 0")
    clicks = j.select("job_id", "start_time", F.explode("clicks").alias("c")).where("c.down").select("job_id", at("c.time_ms").alias("t")).where("t >= 0")
    return moves, clicks


def read_bundle(spark: SparkSession, path: str, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cursor_points(_with_job(spark.read.schema(schemas.CURSOR).option("multiLine", True).json(path)), starts)


def asr_words(segments: DataFrame) -> DataFrame:
    """segments(job_id, pos, from_ms, to_ms, text) -> job_id, ix, t_in, t_out, text.

    Empty segments and [notes] or (notes) are dropped; punctuation alone joins the word before it, and is dropped before the first.
    """
    s = segments.withColumn("text", F.trim("text")).where(F.col("text") != "").where(~F.col("text").rlike(r"^[\[(].*[\])]$"))
    word = ~F.col("text").rlike(r"(?U)^[^\w]+$")
    w = Window.partitionBy("job_id").orderBy("pos")
    s = s.withColumn("is_word", word).withColumn("island", F.sum(word.cast("int")).over(w)).where("island > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    per = s.groupBy("job_id", "island").agg((F.min_by("from_ms", "pos") / 1000).alias("t_in"), (F.greatest(F.max("to_ms"), F.min_by("from_ms", "pos")) / 1000).alias("t_out"), text.alias("text"))
    return per.select("job_id", (F.col("island") - 1).alias("ix"), "t_in", "t_out", "text")


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    raw = _with_job(spark.read.schema(schemas.ASR).option("multiLine", True).json(path))
    s = raw.select("job_id", F.posexplode("transcription").alias("pos", "s"))
    return asr_words(s.select("job_id", "pos", F.col("s.offsets.from").alias("from_ms"), F.col("s.offsets.to").alias("to_ms"), F.col("s.text").alias("text")))


def silence_spans(log: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """log(job_id, line, text) -> job_id, t_in, t_out. A second start replaces the first, an end without a start counts for nothing.

    A start that nothing ends is closed at the duration if durations are given, and dropped otherwise.
    """
    number = F.regexp_extract("text", r"silence_(start|end): *(-?[0-9.]+)", 2).cast("double")
    marks = log.select("job_id", "line", F.regexp_extract("text", r"silence_(start|end):", 1).alias("mark"), number.alias("t")).where("mark <> ''")
    w = Window.partitionBy("job_id").orderBy("line")
    rows = marks.withColumn("next_mark", F.lead("mark").over(w)).withColumn("next_t", F.lead("t").over(w)).where("mark = 'start'")
    start = F.greatest("t", F.lit(0.0))
    if durations is None:
        return rows.where("next_mark = 'end'").select("job_id", start.alias("t_in"), F.col("next_t").alias("t_out"))
    closed = rows.where("next_mark = 'end' OR next_mark IS NULL").join(durations, "job_id")
    return closed.select("job_id", start.alias("t_in"), F.coalesce("next_t", "duration").alias("t_out"))


def last_fragment(log: DataFrame) -> DataFrame:
    """log(job_id, line, text) of event lines -> job_id, fragment, fenced: the last non-empty assistant text, of it the fenced block, else the outermost braces."""
    e = log.where(F.trim("text").startswith("{")).withColumn("e", F.from_json("text", schemas.AGENT_EVENT))
    parts = F.transform(F.filter("e.message.content", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    said = e.where("e.type = 'message_end' AND e.message.role = 'assistant'").select("job_id", "line", F.regexp_replace(F.array_join(parts, ""), r"^\s+|\s+$", "").alias("said")).where("said <> ''")
    last = said.groupBy("job_id").agg(F.max_by("said", "line").alias("said"))
    fence = F.regexp_extract("said", r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    fenced = F.col("said").rlike(r"(?s)```(?:json)?\s*\n.*?```")
    braces = F.regexp_extract("said", r"(?s)(\{.*\})", 1)
    return last.select("job_id", F.when(fenced, F.regexp_replace(fence, r"^\s+|\s+$", "")).when(braces != "", braces).otherwise(F.col("said")).alias("fragment"), fenced.alias("fenced"))


#: From each version to the next; a step sees rows of its version only.
MIGRATIONS = {1: lambda df: df, 2: lambda df: df.withColumn("provenance", F.coalesce("provenance", F.lit("unknown")))}


def migrate(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, quarantined): documents carried step by step to VERSION; unknown, missing or newer versions stay behind. Columns: spec_version, provenance, ..."""
    known = F.col("spec_version").between(1, VERSION)
    bad = specs.where(~F.coalesce(known, F.lit(False)))
    good = specs.where(known)
    for v, step in MIGRATIONS.items():
        old = step(good.where(F.col("spec_version") == v)).withColumn("spec_version", F.lit(v + 1).cast(specs.schema["spec_version"].dataType))
        good = good.where(F.col("spec_version") != v).unionByName(old)
    return good, bad


def read_specs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """migrate() over JSON documents of schemas.SPECS, one a file; provenance is its column here. A version that is no whole number is none."""
    raw = spark.read.schema(schemas.SPECS).option("multiLine", True).json(path)
    return migrate(raw.withColumn("provenance", F.col("source.provenance")))


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file), host (a struct), body: the whole JSON text; measurements differ too much for one schema."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("body"))
    return text.select("name", F.from_json(F.get_json_object("body", "$.host"), schemas.HOST).alias("host"), "body")


def content_key(stage: Column, version: Column, inputs: list[str], params: list[str]) -> Column:
    """sha256 of compact JSON with keys in sorted order, nulls kept: equal inputs and parameters have equal keys."""
    inner = lambda cols: F.sha2(F.to_json(F.struct(*sorted(cols, key=str)), {"ignoreNullFields": "false"}), 256)
    whole = F.struct(inner(inputs).alias("input_hash"), inner(params).alias("params_hash"), stage.alias("stage"), version.alias("stage_version"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def flatten(docs: DataFrame, key: str) -> DataFrame:
    """key, path, value: every leaf of every other column by its path, array elements by [i]; null leaves and empty arrays give nothing.

    The schema says which paths there are, so this is one projection and one explode, at any depth.
    """

    def walk(col: Column, kind, path: Column) -> Column:
        if isinstance(kind, StructType):
            return F.flatten(F.array(*(walk(col[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields)))
        if isinstance(kind, ArrayType):
            each = F.transform(F.coalesce(col, F.array().cast(kind)), lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return F.flatten(each)
        return F.array(F.struct(path.alias("path"), col.cast("string").alias("value")))

    parts = [walk(F.col(f.name), f.dataType, F.lit(f.name)) for f in docs.schema.fields if f.name != key]
    return docs.select(key, F.explode(F.flatten(F.array(*parts))).alias("l")).select(key, "l.path", "l.value").where("value IS NOT NULL")


def scripted_take(spark: SparkSession, beats: int = 4, slot: float = 6.0, hz: float = 30.0) -> DataFrame:
    """A generated track (beat, i, t, x, y): an S-shaped move over 40 % of each slot, then rest with a small wobble. Closed form for each row."""
    targets = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 0.5), (0.26, 0.30), (0.72, 0.34), (0.58, 0.42), (0.31, 0.62))))
    n = int(beats * slot * hz)
    r = spark.range(n).select(F.col("id").alias("i"), (F.col("id") / F.lit(hz)).alias("t")).withColumn("beat", F.floor(F.col("t") / slot).cast("int")).withColumn("p", F.least((F.col("t") - F.col("beat") * slot) / (0.4 * slot), F.lit(1.0)))
    s = F.col("p") * F.col("p") * (3 - 2 * F.col("p"))
    a, b = F.element_at(targets, F.col("beat") % 5 + 1), F.element_at(targets, (F.col("beat") + 1) % 5 + 1)
    wobble = lambda f, w: F.when(F.col("p") >= 1, 0.002 * f(F.col("t") * w)).otherwise(0.0)
    return r.select("beat", "i", "t", (a["x"] + (b["x"] - a["x"]) * s + wobble(F.sin, 7.3)).alias("x"), (a["y"] + (b["y"] - a["y"]) * s + wobble(F.cos, 5.1)).alias("y"))
