"""Generated documents: whole edit documents of a scripted take, any number of jobs, in closed form for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The take's beats: words, where the cursor goes, tier, place of a hesitation, clicks as shares of the slot, label (fixed values).
BEATS = (
    ("here is the dashboard we are shipping today", 0.26, 0.30, "essential", None, [0.45], None),
    ("so um clicking through to the settings panel", 0.72, 0.34, "supporting", 1, [0.45], "Settings"),
    ("the export button is the part people miss", 0.58, 0.42, "essential", None, [0.40, 0.52], "Export"),
    ("and that is the whole flow end to end", 0.31, 0.62, "optional", None, [0.45], None),
)
#: Seconds of a beat, and the share of it that is speech (fixed values).
SLOT, SPEECH = 6.0, 0.72
_BEAT = "words string, x double, y double, tier string, filler int, clicks array<double>, label string"


def take(jobs: DataFrame, beats: tuple = BEATS, slot: float = SLOT) -> dict[str, DataFrame]:
    """The tables words, captions, segments, removals, overlays, clicks and durations of one take for each of jobs(job_id).

    A beat's words share its speech evenly and are one caption; the rest of the slot is a silence that is removed, and so is the hesitation. Overlays: a chip on the second
    beat, a box on the third, an arrow within the first silence (which an edit drops), and a pill over the whole output. Every second is removed or in a segment.
    """
    spark = jobs.sparkSession
    rows = spark.createDataFrame([(i, *b) for i, b in enumerate(beats)], "beat int, " + _BEAT)
    b = jobs.select("job_id").join(F.broadcast(rows))  # a few rows, one for each beat
    b = b.withColumns({"t_in": F.col("beat") * F.lit(slot), "w": F.split("words", " ")}).withColumns({"speech_end": F.col("t_in") + slot * SPEECH, "slot_end": F.col("t_in") + slot})
    width = (F.col("speech_end") - F.col("t_in")) / F.size("w")
    at = lambda k: F.col("t_in") + k * width
    words = b.select("*", F.posexplode("w").alias("word_ix", "text")).select("job_id", F.col("beat").alias("block_ix"), "word_ix", at(F.col("word_ix")).alias("t_in"), at(F.col("word_ix") + 1).alias("t_out"), "text")
    captions = b.select("job_id", F.col("beat").alias("block_ix"), "t_in", F.col("speech_end").alias("t_out"), F.col("words").alias("text"))
    piece = lambda t_in, t_out: F.struct(t_in.alias("t_in"), t_out.alias("t_out"))
    whole = F.array(piece(F.col("t_in"), F.col("speech_end")))
    halves = F.array(piece(F.col("t_in"), at(F.col("filler"))), piece(at(F.col("filler") + 1), F.col("speech_end")))
    segments = b.select("job_id", "tier", F.concat(F.lit("beat "), F.col("beat").cast("string")).alias("reason"), F.explode(F.when(F.col("filler").isNull(), whole).otherwise(halves)).alias("p")).select("job_id", "p.t_in", "p.t_out", "tier", "reason")
    removals = b.select("job_id", F.col("speech_end").alias("t_in"), F.col("slot_end").alias("t_out"), F.lit("silence").alias("kind"))
    removals = removals.unionByName(b.where("filler IS NOT NULL").select("job_id", at(F.col("filler")).alias("t_in"), at(F.col("filler") + 1).alias("t_out"), F.lit("filler").alias("kind")))
    none = F.lit(None).cast("double")
    title = F.coalesce("label", F.initcap(F.array_join(F.slice("w", -2, 2), " ")))
    overlay = lambda rows, ix, template, text, x, y, t_in, t_out: rows.select("job_id", F.lit(ix).alias("ix"), F.lit(template).alias("template"), text.alias("text"), x.alias("x"), y.alias("y"), t_in.alias("t_in"), t_out.alias("t_out"))
    chips = [overlay(b.where(F.col("beat") == i + 1), i, name, title, F.col("x"), F.col("y"), F.col("t_in") + slot * 0.08, F.col("speech_end")) for i, name in enumerate(("label_chip", "highlight_box"))]
    gap = F.col("slot_end") - F.col("speech_end")
    arrow = overlay(b.where("beat = 0"), 2, "callout_arrow", F.lit("lands inside a removal"), F.lit(0.5), F.lit(0.5), F.col("speech_end") + gap * 0.1, F.col("slot_end") - gap * 0.1)
    pill = overlay(b.where("beat = 0"), 3, "progress_pill", F.lit(None).cast("string"), none, none, none, none)
    clicks = b.select("job_id", "x", "y", "t_in", F.explode("clicks").alias("share")).select("job_id", (F.col("t_in") + slot * F.col("share")).alias("t"), "x", "y")
    return {
        "words": words, "captions": captions, "segments": segments, "removals": removals, "overlays": chips[0].unionByName(chips[1]).unionByName(arrow).unionByName(pill),
        "clicks": clicks, "durations": jobs.select("job_id", F.lit(slot * len(beats)).alias("duration")),
    }


def broken(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same take with three faults for checks to find: the hesitation's removal is off by half a word, so both its edges cut words; the first word is one of 34 letters; the chip sits over the captions."""
    off = (F.col("t_out") - F.col("t_in")) / 2
    filler = F.col("kind") == "filler"
    removals = tables["removals"].withColumns({"t_in": F.when(filler, F.col("t_in") + off).otherwise(F.col("t_in")), "t_out": F.when(filler, F.col("t_out") + off).otherwise(F.col("t_out"))})
    first = (F.col("block_ix") == 0) & (F.col("word_ix") == 0)
    words = tables["words"].withColumn("text", F.when(first, "w" * 34).otherwise(F.col("text")))
    chip = F.col("template") == "label_chip"
    overlays = tables["overlays"].withColumns({"x": F.when(chip, 0.5).otherwise(F.col("x")), "y": F.when(chip, 0.78).otherwise(F.col("y"))})
    return tables | {"removals": removals, "words": words, "overlays": overlays}


def jobs(spark: SparkSession, n: int) -> DataFrame:
    """job_id 0 to n - 1."""
    return spark.range(n).select(F.col("id").alias("job_id"))
