"""Interval algebra per job: merge, subtract, complement, coalesce, split, and projection onto the edited time axis.

Every operator works within job_id, as equi-key of its joins and partition of its windows. Interval joins have a second equi-key, a bucket
of BUCKET seconds (of COARSE seconds for long spans), so a job's rows meet only what is near them in time, and a hot job is spread over its buckets;
whether a span overlaps any other is told by a running maximum, without a join. What runs over a job's rows in order does so in chunks of time (scan.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import EPS, contains, covers, holds, overlaps, tier_rank
from . import scan


#: Seconds of an interval join's buckets: about as long as spans are, so that each is in a few buckets and each bucket has a few of them.
BUCKET = 8.0
#: Intervals in more buckets than this go by coarse ones, so wide; those end at this many from zero on either side.
MOST, COARSE, FAR = 256, 32768.0, 1 << 16


def _order(*cols: str):
    return Window.partitionBy("job_id").orderBy(*cols)


def _fine(t: Column) -> Column:
    return F.floor(t / BUCKET).cast("long")


def _coarse(t: Column) -> Column:
    """The first and the last one are open, so that no interval is in more than 2 * FAR of them."""
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), t / COARSE)).cast("long")


def _edges(t_in: Column, t_out: Column) -> tuple[Column, Column, Column]:
    """Where an interval begins and ends, widened by a little more than the predicates' tolerance, and whether it is long. An interval that ends before it begins has what is between."""
    lo, hi = F.least(t_in, t_out) - 2 * EPS, F.greatest(t_in, t_out) + 2 * EPS
    return lo, hi, hi - lo >= BUCKET * (MOST - 2)


def near_points(points: DataFrame, t: Column, spans: DataFrame, t_in: str, t_out: str, condition: Column, how: str = "inner") -> DataFrame:
    """points join spans (with job in the column j) where the condition holds, which must say that t is within the span give or take EPS. A point is looked up
    in the fine buckets and in the coarse ones, where long spans are; with how="left" a point without a match in either has an empty row for it.

    A span is many rows here, which Spark's estimate of its size doesn't know of, so the spans are never sent to the driver as a broadcast."""
    lo, hi, long = _edges(F.col(t_in), F.col(t_out))
    both = lambda is_long, b: F.struct(F.lit(is_long).alias("long"), b.alias("b"))
    left = points.withColumn("__bucket", F.explode(F.array(both(False, _fine(t)), both(True, _coarse(t)))))
    every = F.when(long, F.transform(F.sequence(_coarse(lo), _coarse(hi)), lambda b: both(True, b))).otherwise(F.transform(F.sequence(_fine(lo), _fine(hi)), lambda b: both(False, b)))
    right = spans.withColumn("__near", F.explode(every))
    return left.join(right.hint("merge"), (F.col("job_id") == F.col("j")) & (F.col("__bucket") == F.col("__near")) & condition, how).drop("__bucket", "__near")


def _places(t_in: Column, t_out: Column) -> Column:
    """(long, b, first, own) for each bucket of an interval: a long one's coarse buckets, a short one's fine and coarse ones. first: its first bucket of the kind; own: it is long."""
    lo, hi, long = _edges(t_in, t_out)
    place = lambda is_long, b, first: F.struct(F.lit(is_long).alias("long"), b.alias("b"), first.alias("first"), long.alias("own"))
    coarse = F.transform(F.sequence(_coarse(lo), _coarse(hi)), lambda b: place(True, b, _coarse(lo)))
    return F.when(long, coarse).otherwise(F.concat(F.transform(F.sequence(_fine(lo), _fine(hi)), lambda b: place(False, b, _fine(lo))), coarse))


def meeting(left: DataFrame, a_in: str, a_out: str, right: DataFrame, b_in: str, b_out: str) -> DataFrame:
    """left join right (with job in the column j) where they overlap. A pair meets once: in fine buckets if both are short, else in coarse ones, and in the first that both have.
    No broadcast, as in near_points."""
    a = left.withColumn("__a", F.explode(_places(F.col(a_in), F.col(a_out))))
    b = right.withColumn("__b", F.explode(_places(F.col(b_in), F.col(b_out))))
    same = (F.col("job_id") == F.col("j")) & (F.col("__a.long") == F.col("__b.long")) & (F.col("__a.b") == F.col("__b.b"))
    once = (F.col("__a.b") == F.greatest("__a.first", "__b.first")) & (F.col("__a.long") == (F.col("__a.own") | F.col("__b.own")))
    return a.join(b.hint("merge"), same & once & overlaps(F.col(a_in), F.col(a_out), F.col(b_in), F.col(b_out))).drop("__a", "__b")


def furthest(rows: DataFrame, at: Column, others: DataFrame, t_in: str, t_out: str, at_ties: bool) -> DataFrame:
    """rows with `reach`: the latest t_out of the job's others that begin before `at` (at_ties: or there). One running maximum, no join."""
    q = rows.select("job_id", at.alias("__at"), F.lit(1).alias("__turn_of"), F.lit(None).cast("double").alias("__out"), F.struct(*rows.columns).alias("__row"))
    o = others.select("job_id", F.col(t_in).alias("__at"), F.lit(0 if at_ties else 2).alias("__turn_of"), F.col(t_out).alias("__out"), F.lit(None).cast(q.schema["__row"].dataType).alias("__row"))
    seen = scan.running(q.unionByName(o), F.col("__at"), ["__at", "__turn_of"], {"reach": ("max", F.col("__out"))}, inclusive=True)
    return seen.where("__row IS NOT NULL").select("__row.*", "reach")


def merge(spans: DataFrame) -> DataFrame:
    """job_id, t_in, t_out, kind: spans that touch become one, of the kind that comes first. Ties in t_in go by ord."""
    at, order = F.col("t_in"), ["t_in", "ord", "t_out"]
    reached = scan.running(spans, at, order, {"reach": ("max", F.col("t_out"))})
    new = F.coalesce(F.col("t_in") > F.col("reach") + EPS, F.lit(True))
    islands = scan.running(reached, at, order, {"island": ("sum", new.cast("long"))}, inclusive=True)
    return islands.groupBy("job_id", "island").agg(F.min("t_in").alias("t_in"), F.max("t_out").alias("t_out"), F.min_by("kind", F.struct(*order)).alias("kind")).drop("island")


def subtract(spans: DataFrame, cuts: DataFrame) -> DataFrame:
    """job_id, span_in, t_in, t_out: what is left of each span once the cuts are out; nothing shorter than EPS."""
    s = spans.select("job_id", F.col("t_in").alias("a"), F.col("t_out").alias("b"))
    c = cuts.select(F.col("job_id").alias("j"), F.col("t_in").alias("x"), F.col("t_out").alias("y"))
    hit = meeting(s, "a", "b", c, "x", "y")
    edges = hit.select("job_id", "a", "b", F.greatest("x", "a").alias("x"), F.least("y", "b").alias("y"))
    edges = edges.unionByName(s.select("job_id", "a", "b", F.col("b").alias("x"), F.col("b").alias("y")))
    before = F.max("y").over(Window.partitionBy("job_id", "a", "b").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1))
    pieces = edges.withColumn("from", F.coalesce(before, F.col("a"))).where(F.col("x") - F.col("from") > EPS)
    return pieces.select("job_id", F.col("a").alias("span_in"), F.col("from").alias("t_in"), F.col("x").alias("t_out")).distinct()


def complement(removals: DataFrame, durations: DataFrame) -> DataFrame:
    """job_id, t_in, t_out: the gaps that removals leave in [0, duration]; a job without removals is one gap."""
    tail = durations.select("job_id", F.col("duration").alias("t_in"), F.col("duration").alias("t_out"))
    rows = removals.select("job_id", "t_in", "t_out").unionByName(tail)
    reached = scan.running(rows, F.col("t_in"), ["t_in", "t_out"], {"reach": ("max", F.col("t_out"))})
    return reached.withColumn("from", F.coalesce("reach", F.lit(0.0))).where(F.col("t_in") > F.col("from") + EPS).select("job_id", F.col("from").alias("t_in"), F.col("t_in").alias("t_out"))


def coalesce(segments: DataFrame) -> DataFrame:
    """job_id, t_in, t_out, tier, reason: neighbours that touch and agree in tier and reason become one."""
    at = F.col("t_in")
    beside = scan.neighbour(segments, at, ["t_in"], {"last_out": "t_out", "last_tier": "tier", "last_reason": "reason"}, back=True)
    same = (F.abs(F.col("t_in") - F.col("last_out")) <= EPS) & (F.col("tier") == F.col("last_tier")) & F.col("reason").eqNullSafe(F.col("last_reason"))
    islands = scan.running(beside, at, ["t_in"], {"island": ("sum", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))}, inclusive=True)
    return islands.groupBy("job_id", "island").agg(F.min("t_in").alias("t_in"), F.max("t_out").alias("t_out"), F.first("tier").alias("tier"), F.first("reason").alias("reason")).drop("island")


def covering(points: DataFrame, proposals: DataFrame, default_tier: str = "essential", default_reason: str = "uncovered") -> DataFrame:
    """Each point (job_id, t, ...) with tier and reason of the proposal listed last (largest pos) that covers it."""
    p = proposals.select(F.col("job_id").alias("j"), F.col("t_in").alias("p_in"), F.col("t_out").alias("p_out"), "pos", F.col("tier").alias("p_tier"), F.col("reason").alias("p_reason"))
    hit = near_points(points, F.col("t"), p, "p_in", "p_out", covers(F.col("p_in"), F.col("p_out"), F.col("t")), "left")
    best = hit.groupBy(*points.columns).agg(F.max_by(F.struct("p_tier", "p_reason"), "pos").alias("best"))
    return best.select(*points.columns, F.coalesce("best.p_tier", F.lit(default_tier)).alias("tier"), F.coalesce("best.p_reason", F.lit(default_reason)).alias("reason"))


def reconcile(proposals: DataFrame, removals: DataFrame, durations: DataFrame) -> DataFrame:
    """Segments of what removals leave: split at every proposal's edge, named by the covering proposal, joined again where equal."""
    gaps = complement(removals, durations).select("job_id", F.col("t_in").alias("a"), F.col("t_out").alias("b"))
    edges = proposals.select("job_id", F.explode(F.array("t_in", "t_out")).alias("e"))
    inner = near_points(edges, F.col("e"), gaps.withColumnRenamed("job_id", "j"), "a", "b", (F.col("e") > F.col("a")) & (F.col("e") < F.col("b"))).drop("j")
    cuts = inner.select("job_id", "a", "b", "e").unionByName(gaps.withColumn("e", F.col("a"))).unionByName(gaps.withColumn("e", F.col("b"))).distinct()
    parts = cuts.withColumn("next", F.lead("e").over(Window.partitionBy("job_id", "a", "b").orderBy("e"))).where(F.col("next") - F.col("e") > EPS)
    mids = parts.select("job_id", F.col("e").alias("t_in"), F.col("next").alias("t_out"), ((F.col("e") + F.col("next")) / 2).alias("t"))
    return coalesce(covering(mids, proposals).drop("t"))


def budget_threshold(segments: DataFrame, budgets: DataFrame) -> DataFrame:
    """job_id, budget, tier, total, overrun: the loosest tier whose total fits, else essential over budget. segments: job_id, tier, dur."""
    rank = tier_rank(F.col("tier"))
    totals = segments.groupBy("job_id").agg(*(F.coalesce(F.sum(F.when(rank >= k, F.col("dur"))), F.lit(0.0)).alias(f"d{k}") for k in range(3)))
    each = totals.crossJoin(F.broadcast(budgets))  # a few rows, one for each render profile
    fits = lambda k: F.col(f"d{k}") <= F.col("budget") + EPS
    tier = F.when(fits(0), "optional").when(fits(1), "supporting").otherwise("essential")
    total = F.when(fits(0), F.col("d0")).when(fits(1), F.col("d1")).otherwise(F.col("d2"))
    return each.select("job_id", "budget", tier.alias("tier"), total.alias("total"), F.greatest(total - F.col("budget"), F.lit(0.0)).alias("overrun"))


def kept_spans(segments: DataFrame, thresholds: DataFrame) -> DataFrame:
    """job_id, budget, span_ix, source_in, source_out, output_in: selected segments, touching ones merged, laid end to end."""
    t = thresholds.select("job_id", "budget", tier_rank(F.col("tier")).alias("least"))
    chosen = segments.join(t, "job_id").where(tier_rank(F.col("tier")) >= F.col("least"))
    at, by = F.col("t_in"), ("job_id", "budget")
    reached = scan.running(chosen, at, ["t_in"], {"reach": ("max", F.col("t_out"))}, by=by)
    new = F.coalesce(F.col("t_in") > F.col("reach") + EPS, F.lit(True))
    runs = scan.running(reached, at, ["t_in"], {"run": ("sum", new.cast("long"))}, inclusive=True, by=by)
    return lay_out(runs.groupBy("job_id", "budget", "run").agg(F.min("t_in").alias("source_in"), F.max("t_out").alias("source_out")), "budget")


def lay_out(runs: DataFrame, *more: str) -> DataFrame:
    """Give spans (source_in, source_out) their place in the output."""
    totals = {"span_ix": ("sum", F.lit(1)), "output_in": ("sum", F.col("source_out") - F.col("source_in"))}
    placed = scan.running(runs.select("job_id", *more, "source_in", "source_out"), F.col("source_in"), ["source_in"], totals, by=("job_id", *more))
    return placed.select("job_id", *more, F.coalesce("span_ix", F.lit(0)).cast("int").alias("span_ix"), "source_in", "source_out", F.coalesce("output_in", F.lit(0.0)).alias("output_in"))


def span_cuts(spans: DataFrame) -> DataFrame:
    """The output times where two spans meet."""
    return spans.where("span_ix > 0").drop("span_ix", "source_in", "source_out").withColumnRenamed("output_in", "cut")


def _on(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("job_id").alias("j"), "span_ix", "source_in", "source_out", "output_in")


def _to_output(t):
    return F.col("output_in") + (t - F.col("source_in"))


def project_captions(blocks: DataFrame, words: DataFrame, spans: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Captions in output time: job_id, block_ix, span_ix, t_in, t_out, n_words, text.

    A block is cut by the spans it overlaps; a word goes where its middle is; pieces without words are dropped. With
    a minimum display time, shorter pieces are held up to the next one's start (which may also shorten them).
    """
    pairs = meeting(blocks, "t_in", "t_out", _on(spans), "source_in", "source_out").drop("j")
    w = words.select("job_id", "block_ix", "word_ix", F.col("t_in").alias("w_in"), F.col("t_out").alias("w_out"), "text")
    mid = (F.col("w_in") + F.col("w_out")) / 2
    inside = pairs.join(w, ["job_id", "block_ix"]).where(contains(F.col("source_in"), F.col("source_out"), mid))
    first = F.min_by("w_in", "word_ix")
    last = F.max_by("w_out", "word_ix")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "text"))), lambda x: x["text"]), " ")
    cut = inside.groupBy("job_id", "block_ix", "t_in", "t_out", "span_ix", "source_in", "source_out", "output_in").agg(first.alias("f"), last.alias("l"), F.count("*").alias("n_words"), text.alias("text"))
    out = cut.select("job_id", "block_ix", "span_ix", _to_output(F.greatest("t_in", "source_in", "f")).alias("t_in"), _to_output(F.least("t_out", "source_out", "l")).alias("t_out"), "n_words", "text")
    if minimum > 0:
        ends = spans.groupBy("job_id").agg(F.sum(F.col("source_out") - F.col("source_in")).alias("end"))
        held = F.least(F.greatest(F.col("t_out"), F.col("t_in") + minimum), F.coalesce("next_in", "end"))
        out = scan.neighbour(out, F.col("t_in"), ["t_in", "block_ix"], {"next_in": "t_in"}).join(ends, "job_id").withColumn("t_out", F.when(F.col("t_out") - F.col("t_in") < minimum, held).otherwise(F.col("t_out"))).drop("end", "next_in")
    return out


def project_overlays(overlays: DataFrame, spans: DataFrame, least: float = 0.15) -> DataFrame:
    """Overlays in output time: job_id, ix, template, t_in, t_out. Pieces shorter than `least` go; null times span the whole output."""
    timed = overlays.where("t_in IS NOT NULL AND t_out IS NOT NULL")
    pairs = meeting(timed, "t_in", "t_out", _on(spans), "source_in", "source_out")
    lo, hi = F.greatest("t_in", "source_in"), F.least("t_out", "source_out")
    pieces = pairs.where(hi - lo >= least).select("job_id", "ix", "template", _to_output(lo).alias("t_in"), _to_output(hi).alias("t_out"))
    whole = overlays.where("t_in IS NULL OR t_out IS NULL").join(spans.groupBy("job_id").agg(F.sum(F.col("source_out") - F.col("source_in")).alias("end")), "job_id")
    return pieces.unionByName(whole.select("job_id", "ix", "template", F.lit(0.0).alias("t_in"), F.col("end").alias("t_out")))


def dropped_overlays(overlays: DataFrame, spans: DataFrame, least: float = 0.15) -> DataFrame:
    """Overlays of which no piece is left."""
    return overlays.join(project_overlays(overlays, spans, least), ["job_id", "ix"], "left_anti")


def project_regions(regions: DataFrame, spans: DataFrame, ease: float = 0.35) -> DataFrame:
    """Zoom regions in output time; only pieces longer than the ease stay."""
    pairs = meeting(regions, "t_in", "t_out", _on(spans), "source_in", "source_out")
    lo, hi = F.greatest("t_in", "source_in"), F.least("t_out", "source_out")
    return pairs.where(hi - lo > ease).select("job_id", "region_ix", "span_ix", _to_output(lo).alias("t_in"), _to_output(hi).alias("t_out"))


def output_at(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(job_id, t) -> output_t by the first span that holds t, null where it is cut."""
    hit = near_points(points, F.col("t"), _on(spans), "source_in", "source_out", holds(F.col("source_in"), F.col("source_out"), F.col("t")), "left")
    return hit.groupBy("job_id", "t").agg(F.min_by(_to_output(F.col("t")), "source_in").alias("output_t"))


def source_at(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(job_id, t) in output time -> source_t; past the end it is the last span's end, without spans 0."""
    there = _on(spans).withColumn("out_end", F.col("output_in") + (F.col("source_out") - F.col("source_in")))
    hit = near_points(points, F.col("t"), there, "output_in", "out_end", contains(F.col("output_in"), F.col("out_end"), F.col("t")), "left")
    mapped = hit.groupBy("job_id", "t").agg(F.min_by(F.col("source_in") + (F.col("t") - F.col("output_in")), "source_in").alias("m"))
    ends = spans.groupBy("job_id").agg(F.max("source_out").alias("end"))
    return mapped.join(ends, "job_id", "left").select("job_id", "t", F.coalesce("m", "end", F.lit(0.0)).alias("source_t"))


def expected_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words whose middle a span holds, clamped to it and mapped to output time."""
    mid = (F.col("t_in") + F.col("t_out")) / 2
    hit = near_points(words, mid, _on(spans), "source_in", "source_out", holds(F.col("source_in"), F.col("source_out"), mid))
    first = hit.groupBy("job_id", "ix", "t_in", "t_out", "text").agg(F.min_by(F.struct("source_in", "source_out", "output_in"), "source_in").alias("s")).select("*", "s.*")
    return first.select("job_id", "ix", _to_output(F.greatest("t_in", "source_in")).alias("t_in"), _to_output(F.least("t_out", "source_out")).alias("t_out"), "text")


def words_after_edit(words: DataFrame, removals: DataFrame, segments: DataFrame) -> DataFrame:
    """Words whose middle lies in no removal and in a selected segment (half open, unlike expected_words)."""
    mid = (F.col("t_in") + F.col("t_out")) / 2
    inside = F.coalesce(F.col("reach") - EPS > mid, F.lit(False))  # some interval began at or before the middle and ends after it
    kept = furthest(words, mid + EPS, removals, "t_in", "t_out", True).where(~inside).drop("reach")
    return furthest(kept, mid + EPS, segments, "t_in", "t_out", True).where(inside).drop("reach")


def mid_word_cuts(removals: DataFrame, words: DataFrame) -> DataFrame:
    """job_id, n, first_edge: removal edges strictly inside a word."""
    edges = removals.select("job_id", F.col("t_in").alias("r_in"), F.posexplode(F.array("t_in", "t_out")).alias("side", "edge"))
    w = words.select(F.col("job_id").alias("j"), F.col("t_in").alias("w_in"), F.col("t_out").alias("w_out"))
    hit = near_points(edges, F.col("edge"), w, "w_in", "w_out", (F.col("w_in") + EPS < F.col("edge")) & (F.col("edge") < F.col("w_out") - EPS))
    return hit.groupBy("job_id").agg(F.count("*").alias("n"), F.min_by("edge", F.struct("r_in", "w_in", "side")).alias("first_edge"))


def overlapping(spans: DataFrame, others: DataFrame, how: str = "left_semi") -> DataFrame:
    """Spans that overlap (left_anti: that overlap none) of the others."""
    # of those that begin before the span ends, does one end after it begins?
    far = furthest(spans, F.col("t_out") - EPS, others, "t_in", "t_out", False)
    hit = F.coalesce(F.col("t_in") < F.col("reach") - EPS, F.lit(False))
    return far.where(hit if how == "left_semi" else ~hit).drop("reach")


def override_rate(removals: DataFrame, proposals: DataFrame) -> DataFrame:
    """job_id, n_proposed, n_rejected, rejected_rate, trim_share: what became of the proposals. Jobs without either get no row."""
    proposed = proposals.groupBy("job_id").agg(F.count("*").alias("n_proposed"))
    rejected = overlapping(proposals, removals, "left_anti").groupBy("job_id").agg(F.count("*").alias("n_rejected"))
    by_trim = overlapping(removals, proposals).groupBy("job_id").agg(F.count("*").alias("n_trim"))
    all_ = removals.groupBy("job_id").agg(F.count("*").alias("n_removals"))
    j = proposed.join(rejected, "job_id", "left").join(all_, "job_id").join(by_trim, "job_id", "left")
    n = F.coalesce("n_rejected", F.lit(0))
    return j.select("job_id", "n_proposed", n.alias("n_rejected"), (n / F.col("n_proposed")).alias("rejected_rate"), (F.coalesce("n_trim", F.lit(0)) / F.col("n_removals")).alias("trim_share"))


def partition_violations(removals: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """job_id, starts_late, n_overlaps, n_gaps, ends_off: how removals and segments fail to tile [0, duration]. Jobs without fault get no row."""
    both = removals.select("job_id", "t_in", "t_out").unionByName(segments.select("job_id", "t_in", "t_out"))
    rows = scan.neighbour(both, F.col("t_in"), ["t_in", "t_out"], {"prev": "t_out"}, back=True)
    per = rows.groupBy("job_id").agg(F.min("t_in").alias("a"), F.max("t_out").alias("b"), F.count_if(F.col("t_in") < F.col("prev") - EPS).alias("n_overlaps"), F.count_if(F.col("t_in") > F.col("prev") + EPS).alias("n_gaps"))
    j = per.join(durations, "job_id").select("job_id", (F.abs("a") > EPS).alias("starts_late"), "n_overlaps", "n_gaps", (F.abs(F.col("b") - F.col("duration")) > EPS).alias("ends_off"))
    return j.where("starts_late OR ends_off OR n_overlaps > 0 OR n_gaps > 0")


def removals_by_kind(removals: DataFrame) -> DataFrame:
    """job_id, kind, n, seconds, position: for review, in order of first appearance."""
    return removals.groupBy("job_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("t_out") - F.col("t_in")).alias("seconds"), F.min("t_in").alias("first")).withColumn("position", F.row_number().over(_order("first", "kind"))).drop("first")
