"""Quality checks. Each gives findings(job_id, check, severity, message, value, limit); none stops another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import EPS
from .intervals import furthest

FINDINGS = ("job_id", "check", "severity", "message", "value", "limit")


def _finding(rows: DataFrame, check: str, severity: str | Column, message: str, value: Column, limit: Column | float) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    lim = limit if isinstance(limit, Column) else F.lit(float(limit))
    return rows.select("job_id", F.lit(check).alias("check"), sev.alias("severity"), F.lit(message).alias("message"), value.cast("double").alias("value"), lim.cast("double").alias("limit"))


def _findings(rows: DataFrame, *parts: tuple[Column, str, str, str, Column, float]) -> DataFrame:
    """Of each row the findings (condition, check, severity, message, value, limit) whose condition holds, in one pass: a union of filters would make the rows anew for each."""
    each = lambda check, severity, message, value, limit: F.struct(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit")
    )
    found = F.array_compact(F.array(*(F.when(condition, each(*what)) for condition, *what in parts)))
    return rows.select("job_id", F.explode(found).alias("f")).select("job_id", "f.*")


def duration_drift(projected: DataFrame, facts: DataFrame, limit: float = 0.25) -> DataFrame:
    """projected(job_id, seconds), facts(job_id, actual): a missing render fails as well."""
    j = projected.join(facts, "job_id", "left")
    off = F.abs(F.col("actual") - F.col("seconds"))
    return _findings(j, (F.col("actual").isNull(), "render_missing", "FAIL", "no render", F.lit(None), limit), (off > limit, "duration", "FAIL", "duration differs", off, limit))


def loudness(facts: DataFrame, target: float = -14.0, ceiling: float = -1.0, limit: float = 1.0) -> DataFrame:
    """facts(job_id, integrated, peak): off target or over the ceiling fails, no measurement warns."""
    off = F.abs(F.col("integrated") - target)
    return _findings(
        facts,
        (F.col("integrated").isNull(), "loudness", "WARN", "not measured", F.lit(None), limit),
        (off > limit, "loudness", "FAIL", "off target", off, limit),
        (F.col("peak") > ceiling, "true_peak", "FAIL", "over the ceiling", F.col("peak"), ceiling),
    )


def edit_totality(covered: DataFrame, durations: DataFrame) -> DataFrame:
    """covered(job_id, seconds): segments and removals together are as long as the recording; no edit yet is a note."""
    j = durations.join(covered, "job_id", "left")
    off = F.abs(F.col("seconds") - F.col("duration"))
    return _findings(j, (F.col("seconds").isNull(), "edit_empty", "INFO", "no edit yet", F.lit(None), 0.0), (off > EPS, "edit_totality", "FAIL", "edit does not cover the recording", off, EPS))


def budget(thresholds: DataFrame, has_edit: Column) -> DataFrame:
    """thresholds(job_id, budget, overrun): over budget fails, or warns where nothing has been edited."""
    return _finding(thresholds.where(F.col("overrun") > EPS), "budget", F.when(has_edit, "FAIL").otherwise("WARN"), "over budget", F.col("overrun"), F.col("budget"))


def crop_continuity(steps: DataFrame, ceiling: float = 0.012) -> DataFrame:
    return _finding(steps.where(F.col("max_step") > ceiling + 1e-9), "crop_step", "FAIL", "path jumps", F.col("max_step"), ceiling)


def transcript(rates: DataFrame, ceiling: float = 0.10) -> DataFrame:
    """rates(job_id, expected_words, n_real, n_at_seam, wer): nothing expected is a note; else the verdict and two notes."""
    some = F.col("expected_words") > 0
    return _findings(
        rates,
        (F.col("expected_words") == 0, "transcript", "INFO", "nothing expected", F.lit(0.0), ceiling),
        (some & (F.col("wer") > ceiling), "transcript", "FAIL", "words differ", F.col("wer"), ceiling),
        (some, "transcript_seams", "INFO", "differences at cuts", F.col("n_at_seam"), 0.0),
        (some, "transcript_words", "INFO", "words expected", F.col("expected_words"), 0.0),
    )


def captions(blocks: DataFrame, min_display: float, max_chars: int, max_lines: int) -> DataFrame:
    """blocks(job_id, t_in, t_out, text): overlaps, too short, too long words, too many lines; one finding of each kind per job."""
    from ..functions.text import wrapped

    nxt = F.lead("t_in").over(Window.partitionBy("job_id").orderBy("t_in"))
    lines = wrapped(F.split("text", " "), max_chars)
    rows = blocks.withColumn("lap", F.coalesce(nxt < F.col("t_out") - EPS, F.lit(False))).withColumn("dur", F.col("t_out") - F.col("t_in")).withColumn("longest", F.array_max(F.transform(lines, F.length))).withColumn("n_lines", F.size(lines))
    per = rows.groupBy("job_id").agg(F.count_if("lap").alias("laps"), F.min("dur").alias("briefest"), F.max("longest").alias("longest"), F.max("n_lines").alias("lines"))
    return _findings(
        per,
        (F.col("laps") > 0, "caption_overlap", "FAIL", "captions overlap", F.col("laps"), 0.0),
        (F.col("briefest") < min_display - EPS, "caption_display", "WARN", "too brief", F.col("briefest"), min_display),
        (F.col("longest") > max_chars, "caption_line_length", "FAIL", "line too long", F.col("longest"), max_chars),
        (F.col("lines") > max_lines, "caption_line_count", "FAIL", "too many lines", F.col("lines"), max_lines),
    )


def dialogue_to_bed(audio: DataFrame, least: float = 12.0) -> DataFrame:
    """audio(job_id, narration_gain_db, music_gain_db, duck_db, has_bed)."""
    gap = F.col("narration_gain_db") - (F.col("music_gain_db") + F.col("duck_db"))
    return _finding(audio.where("has_bed").where(gap < least), "dialogue_to_bed", "FAIL", "bed too loud", gap, least)


def overlay_collisions(overlays: DataFrame, captions_: DataFrame, frame_s: float = 0.25) -> DataFrame:
    """job_id, ix, verdict, frame: at most one for each overlay, at its first bad frame; outside the frame goes before over a caption.

    overlays(job_id, ix, t_in, t_out, x, y): about 12 frames of each are looked at. captions_(job_id, t_in, t_out) lie in the lower fifth.
    """
    a, b = F.floor(F.col("t_in") / frame_s), F.greatest(F.floor(F.col("t_out") / frame_s), F.floor(F.col("t_in") / frame_s) + 1)
    frames = overlays.withColumn("a", a.cast("long")).withColumn("b", b.cast("long"))
    step = F.greatest(F.floor((F.col("b") - F.col("a")) / 12), F.lit(1)).cast("long")
    frames = frames.select("job_id", "ix", "x", "y", F.explode(F.sequence(F.col("a"), F.col("b") - 1, step)).alias("frame"))
    outside = (F.col("x") < 0.06) | (F.col("x") > 0.94) | (F.col("y") < 0.06) | (F.col("y") > 0.94)
    c = captions_.select(F.col("job_id").alias("j"), F.floor(F.col("t_in") / frame_s).alias("c_in"), F.floor(F.col("t_out") / frame_s).alias("c_out"))
    low = frames.where((F.col("y") >= 0.78) & ~outside)
    # a caption is on screen if one of those that begin by the frame ends at or after it
    shown = furthest(low, F.col("frame"), c.select(F.col("j").alias("job_id"), "c_in", F.col("c_out").cast("double").alias("c_out")), "c_in", "c_out", True)
    over = shown.where(F.col("reach") >= F.col("frame")).select("job_id", "ix", "frame", F.lit("over_caption").alias("verdict"))
    bad = frames.where(outside).select("job_id", "ix", "frame", F.lit("outside").alias("verdict")).unionByName(over)
    return bad.groupBy("job_id", "ix").agg(F.min_by("verdict", F.struct("frame", F.when(F.col("verdict") == "outside", 0).otherwise(1))).alias("verdict"), F.min("frame").alias("frame"))


def overlay_boxes(overlays: DataFrame, rects: DataFrame, captions_: DataFrame, safe: tuple[int, int, int, int], caption_box: tuple[int, int, int, int], size: tuple[int, int], fps: float) -> DataFrame:
    """job_id, ix, verdict, frame as in overlay_collisions, by the overlays' pixel boxes and what each frame shows.

    overlays(job_id, ix, t_in, t_out, x, y, width, height, dx, dy): a point of the source in shares (null: at the safe area's lower left), the
    drawn size, and how far from the point it is drawn. rects(job_id, frame, x, y, w, h): the part of the source that each frame shows, from
    frame 0 without gaps. safe and caption_box: left, top, right, bottom in pixels. A box is moved into the safe area; one that is too large
    leaves it. captions_(job_id, t_in, t_out) are on screen from t_in to before t_out.
    """
    left, top, right, bottom = safe
    n = rects.groupBy("job_id").agg(F.max("frame").alias("last"))
    o = overlays.join(n, "job_id").withColumn("a", F.floor(F.col("t_in") * fps).cast("long")).withColumn("b", F.least(F.floor(F.col("t_out") * fps).cast("long"), F.col("last") + 1)).where("a < b")
    step = F.greatest(F.floor((F.col("b") - F.col("a")) / 12), F.lit(1)).cast("long")
    frames = o.select(*(F.col(c).alias(f"o_{c}") for c in ("ix", "x", "y", "width", "height", "dx", "dy")), "job_id", F.explode(F.sequence(F.col("a"), F.col("b") - 1, step)).alias("frame"))
    # frames made from durations are many more bytes than Spark's estimate says, so they are no broadcast
    j = frames.join(rects.select("job_id", "frame", "x", "y", "w", "h").hint("merge"), ["job_id", "frame"])

    def placed(anchor: str, origin: str, part: str, pixels: int, shift: str, lo: int, hi: int, extent: str, without: Column) -> Column:
        at = F.bround((F.col(anchor) - F.col(origin)) / F.col(part) * pixels).cast("long") + F.col(shift)
        return F.when(F.col(anchor).isNull(), without).otherwise(F.least(F.greatest(at, F.lit(lo)), F.greatest(F.lit(hi) - F.col(extent), F.lit(lo))))

    x = placed("o_x", "x", "w", size[0], "o_dx", left, right, "o_width", F.lit(left))
    y = placed("o_y", "y", "h", size[1], "o_dy", top, bottom, "o_height", F.lit(bottom) - F.col("o_height"))
    box = j.select("job_id", F.col("o_ix").alias("ix"), "frame", x.alias("x0"), y.alias("y0"), "o_width", "o_height").withColumn("x1", F.col("x0") + F.col("o_width")).withColumn("y1", F.col("y0") + F.col("o_height"))
    outside = (F.col("x0") < left) | (F.col("y0") < top) | (F.col("x1") > right) | (F.col("y1") > bottom)
    on = (F.col("x0") < caption_box[2]) & (caption_box[0] < F.col("x1")) & (F.col("y0") < caption_box[3]) & (caption_box[1] < F.col("y1"))
    # the boxes are made once: those outside go along with those on the captions' place
    bad = box.withColumn("outside", outside).where(F.col("outside") | on).select("job_id", "ix", "frame", "outside")
    shown = furthest(bad, F.col("frame") / fps, captions_.select("job_id", (F.col("t_in") - EPS).alias("t_in"), "t_out"), "t_in", "t_out", True)
    found = shown.where(F.col("outside") | (F.col("reach") > F.col("frame") / fps)).withColumn("verdict", F.when(F.col("outside"), "outside").otherwise("over_caption"))
    return found.groupBy("job_id", "ix").agg(F.min_by("verdict", "frame").alias("verdict"), F.min("frame").alias("frame"))


def overlay_findings(verdicts: DataFrame) -> DataFrame:
    """How many overlays of a job leave the safe area, and how many sit on a caption."""
    n = verdicts.groupBy("job_id").agg(F.count_if(F.col("verdict") == "outside").alias("out"), F.count_if(F.col("verdict") == "over_caption").alias("over"))
    return _findings(n, (F.col("out") > 0, "overlay_safe_area", "FAIL", "overlays leave the safe area", F.col("out"), 0.0), (F.col("over") > 0, "overlay_occlusion", "FAIL", "overlays sit on a caption", F.col("over"), 0.0))


def mid_word(cuts: DataFrame) -> DataFrame:
    """cuts(job_id, n): jobs whose removals begin or end within a word."""
    return _finding(cuts.where("n > 0"), "cut_mid_word", "FAIL", "cuts inside words", F.col("n"), 0.0)


def verify(*findings: DataFrame) -> DataFrame:
    """All checks' findings in one table. No check stops another; a job that all pass has no row."""
    return reduce(DataFrame.unionByName, (f.select(*FINDINGS) for f in findings))


def rollup(findings: DataFrame) -> DataFrame:
    """job_id, passed, n_fail, n_warn, n_info."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("job_id").agg((n("FAIL") == 0).alias("passed"), n("FAIL").alias("n_fail"), n("WARN").alias("n_warn"), n("INFO").alias("n_info"))


def violation_rate(calls: DataFrame, key: str) -> DataFrame:
    """key, n_calls, n_violations, rate: null, not 0, without calls. calls(key, called, violated)."""
    return calls.groupBy(key).agg(F.count_if("called").alias("n_calls"), F.count_if("violated").alias("n_violations")).withColumn("rate", F.try_divide("n_violations", "n_calls"))


def range_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with `violations`: the names of the rules that do not hold (null does not hold), joined by commas; good rows left out."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.withColumn("violations", F.array_join(broken, ",")).where("violations <> ''")
