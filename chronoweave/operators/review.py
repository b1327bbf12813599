"""Corrections, document diffs, replays, the corpus of accepted edits, and the store's views."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField

from ..functions.time import EPS, approx_eq, tier_rank
from . import scan


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names; a temporary one only where none is named on a local master."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def _tier_name(rank: Column) -> Column:
    return F.when(rank == 0, "optional").when(rank == 1, "supporting").when(rank == 2, "essential")


def _near_key(t: Column) -> Column:
    """Times within EPS share one of these keys, so an approximate join stays an equi-join."""
    return F.array_distinct(F.array(F.round(t - EPS, 5), F.round(t + EPS, 5)))


def matched_removals(removals: DataFrame, corrections: DataFrame, how: str = "left_semi") -> DataFrame:
    """Removals whose both ends a correction names within EPS (left_anti: the others)."""
    r = removals.withColumn("__k", F.explode(_near_key(F.col("t_in")))).withColumn("__row", F.struct(*removals.columns))
    c = corrections.select(F.col("job_id").alias("j"), F.col("t_in").alias("c_in"), F.col("t_out").alias("c_out"), F.explode(_near_key(F.col("t_in"))).alias("k"))
    hit = r.join(c, (F.col("job_id") == F.col("j")) & (F.col("__k") == F.col("k")) & approx_eq(F.col("t_in"), F.col("c_in")) & approx_eq(F.col("t_out"), F.col("c_out")), "left_semi").select(*removals.columns).distinct()
    return hit if how == "left_semi" else removals.join(hit, removals.columns, "left_anti")


def stale_corrections(removals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that match no removal any more."""
    return matched_removals(corrections, removals, "left_anti")


def reinstated_segments(reinstated: DataFrame, segments: DataFrame) -> DataFrame:
    """job_id, t_in, t_out, tier: a reinstated removal is as important as its most important neighbour, essential without any."""
    s = segments.select(F.col("job_id").alias("j"), F.col("t_in").alias("s_in"), F.col("t_out").alias("s_out"), tier_rank(F.col("tier")).alias("rank"))
    ends = s.select("j", "rank", F.explode(F.array(F.struct(F.col("s_out").alias("at"), F.lit("before").alias("side")), F.struct(F.col("s_in").alias("at"), F.lit("after").alias("side")))).alias("e")).select("j", "rank", "e.at", "e.side")
    ends = ends.select("j", "rank", "at", "side", F.explode(_near_key(F.col("at"))).alias("k"))
    r = reinstated.select("job_id", "t_in", "t_out", F.explode(F.array(F.struct(F.col("t_in").alias("own"), F.lit("before").alias("which")), F.struct(F.col("t_out").alias("own"), F.lit("after").alias("which")))).alias("o")).select("job_id", "t_in", "t_out", "o.own", "o.which")
    r = r.select("*", F.explode(_near_key(F.col("own"))).alias("rk"))
    hit = r.join(ends, (F.col("job_id") == F.col("j")) & (F.col("rk") == F.col("k")) & (F.col("which") == F.col("side")) & approx_eq(F.col("own"), F.col("at")), "left")
    return hit.groupBy("job_id", "t_in", "t_out").agg(_tier_name(F.coalesce(F.max("rank"), F.lit(2))).alias("tier"))


def segment_changes(proposed: DataFrame, corrected: DataFrame, removed_before: DataFrame, removed_after: DataFrame) -> DataFrame:
    """job_id, path, before, after: removals taken back and tiers changed, keyed by start to 6 places."""
    path = lambda kind, c: F.format_string(kind + "[%.3f]", F.col(c))
    gone = removed_before.withColumn("k", F.round("t_in", 6)).join(removed_after.withColumn("k", F.round("t_in", 6)), ["job_id", "k"], "left_anti").select("job_id", path("removals", "k").alias("path"), F.lit("removed").alias("before"), F.lit(None).cast("string").alias("after"))
    p, c = (x.select("job_id", F.round("t_in", 6).alias("k"), F.col("tier").alias(n)) for x, n in ((proposed, "before"), (corrected, "after")))
    tiers = p.join(c, ["job_id", "k"]).where("before <> after").select("job_id", path("segments", "k").alias("path"), "before", "after")
    return gone.unionByName(tiers)


def deep_merge(base: DataFrame, override: DataFrame) -> DataFrame:
    """(name, path, value) rows: an override's value where it has one, the base's elsewhere; null values are values of neither."""
    return base.join(override.withColumnRenamed("value", "o"), ["name", "path"], "full_outer").select("name", "path", F.coalesce("o", "value").alias("value"))


def tunable_overrides(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, path, value, changed): known paths only; an override within EPS of the value changes nothing."""
    o = overrides.select("name", "path", F.col("value").alias("o"))
    new = F.abs(F.col("o") - F.col("value")) > EPS
    changed = F.coalesce(new, F.lit(False))
    return profiles.join(o, ["name", "path"], "left").select("name", "path", F.when(changed, F.col("o")).otherwise(F.col("value")).alias("value"), changed.alias("changed"))


def unknown_paths(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(profiles, ["name", "path"], "left_anti")


def drift(approved: DataFrame, proposed: DataFrame) -> DataFrame:
    """(job_id, path, before, after) of flattened documents that disagree; numbers within EPS agree; an absent side is null."""
    j = approved.select("job_id", "path", F.col("value").alias("before")).join(proposed.select("job_id", "path", F.col("value").alias("after")), ["job_id", "path"], "full_outer")
    a, b = (F.expr(f"try_cast({c} AS DOUBLE)") for c in ("before", "after"))
    same = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= EPS).otherwise(F.col("before").eqNullSafe(F.col("after")))
    return j.where(~same)


#: Bookkeeping that a replay never repeats (fixed list).
NOT_REPLAYED = ("created_at", "job_id")


def deterministic_drift(approved: DataFrame, proposed: DataFrame, fields: list[tuple[str, StructField]]) -> DataFrame:
    """drift() of what a replay must repeat, with the stage that sets it: fields are a schema's leaves (schemas.leaves), of which those of
    deterministic origin count, without bookkeeping. A path's [i] stands for any element; paths that the schema hasn't are left out."""
    stages = {p: f.metadata["stage"] for p, f in fields if f is not None and f.metadata.get("origin") == "deterministic" and p not in NOT_REPLAYED}
    found = drift(approved, proposed).withColumn("stage", F.create_map(*(F.lit(x) for kv in stages.items() for x in kv))[F.regexp_replace("path", r"\[[0-9]+\]", "[]")])
    return found.where("stage IS NOT NULL").select("job_id", "path", "stage", "before", "after")


def boundary_drift(approved: DataFrame, proposed: DataFrame, durations: DataFrame) -> DataFrame:
    """job_id, cut, drift: the distance from each approved cut to the nearest proposed one; the duration where there is none.

    Both neighbours come from one pass over the union of cuts, in chunks, not from a join of all with all.
    """
    rows = approved.select("job_id", "cut", F.lit(None).cast("double").alias("p")).distinct().unionByName(proposed.select("job_id", "cut", F.col("cut").alias("p")).distinct())
    near = scan.around(rows, F.col("cut"), ["cut", F.col("p").isNull()], "p")
    # a proposal at the same time stands before the approved cut
    near = near.where("p IS NULL").select("job_id", "cut", F.least(F.col("cut") - F.col("before"), F.col("after") - F.col("cut")).alias("d"))
    return near.join(durations, "job_id").select("job_id", "cut", F.coalesce("d", "duration").alias("drift"))


def edit_summary(segments: DataFrame, removals: DataFrame, durations: DataFrame) -> DataFrame:
    """job_id, retained, essential (shares of the duration; 1 without segments), n_segments, n_removals."""
    s = segments.groupBy("job_id").agg(F.count("*").alias("n_segments"), F.sum(F.col("t_out") - F.col("t_in")).alias("kept"), F.coalesce(F.sum(F.when(F.col("tier") == "essential", F.col("t_out") - F.col("t_in"))), F.lit(0.0)).alias("best"))
    r = removals.groupBy("job_id").agg(F.count("*").alias("n_removals"))
    j = durations.where("duration > 0").join(s, "job_id", "left").join(r, "job_id", "left")
    share = lambda c: F.when(F.col("n_segments").isNull(), 1.0).otherwise(F.col(c) / F.col("duration"))
    return j.select("job_id", share("kept").alias("retained"), share("best").alias("essential"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_removals", F.lit(0)).alias("n_removals"))


def run_distribution(values: DataFrame, tolerance: float) -> DataFrame:
    """job_id, n, middle, spread, within: of (job_id, value, approved) over runs; the median is exact, the mean of the two middles."""
    return values.groupBy("job_id").agg(F.count("*").alias("n"), F.median("value").alias("middle"), (F.max("value") - F.min("value")).alias("spread"), F.max("approved").alias("approved")).select("job_id", "n", "middle", "spread", (F.abs(F.col("middle") - F.col("approved")) <= tolerance + EPS).alias("within"))


#: Cells of a histogram, and how often one cell is cut up again.
CELLS, REFINED = 1024, 2


def nearest_rank(values: DataFrame, fraction: float) -> DataFrame:
    """job_id, value: the element at half-even round(fraction * (n - 1)) of the sorted values, nulls left out (a job of nulls only: null)."""
    return at_rank(values, lambda n: F.bround((n - 1) * F.lit(fraction)))


def at_rank(values: DataFrame, place_of: Callable[[Column], Column]) -> DataFrame:
    """job_id, value: of each job's n sorted values the one at place_of(n), from 0, the last one at most; nulls are left out (a job of nulls only: null).

    The rank is looked for in a histogram of CELLS cells, then in one of the cell that holds it, REFINED times; what is in the last cell is counted by value. Nothing
    of a job is collected: tables have CELLS rows a job, and only values of one cell go on. NaN is larger than all other values.
    """
    v = values.where("value IS NOT NULL").select("job_id", F.col("value").cast("double").alias("value"))
    finite = (~F.isnan("value")) & (F.abs("value") < float("inf"))
    ends = v.groupBy("job_id").agg(F.count("*").alias("n"), F.min(F.when(finite, F.col("value"))).alias("lo"), F.max(F.when(finite, F.col("value"))).alias("hi"))
    # left: how many smaller values are still to be passed by
    place = ends.select("job_id", F.least(place_of(F.col("n")), F.col("n") - 1).cast("long").alias("left"), "lo", "hi")
    job = Window.partitionBy("job_id")
    rows = v
    for _ in range(REFINED):
        share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        cell = F.when(F.isnan("value"), CELLS + 2).when(F.col("value") == float("inf"), CELLS + 1).when(F.col("value") == float("-inf"), -1)
        cell = cell.when(F.col("hi") > F.col("lo"), F.floor(share * CELLS)).otherwise(0).cast("int")
        placed = rows.join(place, "job_id").withColumn("cell", cell)
        counts = placed.groupBy("job_id", "cell").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.min(F.when(finite, F.col("value"))).alias("lo"), F.max(F.when(finite, F.col("value"))).alias("hi"))
        before = F.coalesce(F.sum("n").over(job.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("before", before).where("before <= left AND left < before + n")
        place = held.select("job_id", (F.col("left") - F.col("before")).alias("left"), "lo", "hi")
        rows = placed.select("job_id", "cell", "value").join(held.select("job_id", "cell"), ["job_id", "cell"], "left_semi").select("job_id", "value")
    each = rows.groupBy("job_id", "value").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(job.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = each.withColumn("before", before).join(place.select("job_id", "left"), "job_id").where("before <= left AND left < before + n").select("job_id", "value")
    return values.select("job_id").distinct().join(found, "job_id", "left")


def corpus_exclusions(rows: DataFrame) -> DataFrame:
    """profile, reason, n: the first reason that applies, in this order. rows: profile, verified, has_profile, provenance."""
    reason = F.when(~F.col("verified"), "unverified").when(~F.col("has_profile"), "no_profile").when(F.col("provenance") == "synthetic", "synthetic").when(F.col("provenance") == "unknown", "unknown").otherwise("accepted")
    return rows.withColumn("reason", reason).groupBy("profile", "reason").agg(F.count("*").alias("n"))


def tunable_spread(values: DataFrame, default: float) -> DataFrame:
    """job_id, n, n_corrected, oldest, newest of (job_id, at, id, value): corrected is further than EPS from the default."""
    return values.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("value") - default) > EPS).alias("n_corrected"), F.min_by("value", F.struct("at", "id")).alias("oldest"), F.max_by("value", F.struct("at", "id")).alias("newest"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key. An aggregate with partial maxima, not a window, so hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def windowed_median(values: DataFrame, last: int, least: int) -> DataFrame:
    """job_id, n, middle: the median of the last values, where there are enough (an extension)."""
    w = Window.partitionBy("job_id").orderBy(F.col("at").desc(), F.col("id").desc())
    return values.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last).groupBy("job_id").agg(F.count("*").alias("n"), F.median("value").alias("middle")).where(F.col("n") >= least)


def preference_changes(values: DataFrame, last: int, least: int) -> DataFrame:
    """profile, key, old_value, new_value, caused_by, changed_at of values(profile, key, at, id, value): each value after which the median of the last ones, of
    `least` or more, is another one than before by more than EPS (an extension). Nulls are left out. Each row looks at `last` values; streaming.preference_changes does the same by state."""
    w = Window.partitionBy("profile", "key").orderBy("at", "id")
    recent = F.array_sort(F.collect_list("value").over(w.rowsBetween(1 - last, Window.currentRow)))
    n = F.size("recent")
    middle = (F.get("recent", F.floor((n - 1) / 2).cast("int")) + F.get("recent", F.floor(n / 2).cast("int"))) / 2
    rows = values.where("value IS NOT NULL").withColumn("recent", recent).withColumn("new_value", F.when(n >= least, middle)).withColumn("old_value", F.lag("new_value").over(w))
    moved = rows.where(F.col("new_value").isNotNull() & F.coalesce(F.abs(F.col("new_value") - F.col("old_value")) > EPS, F.lit(True)))
    return moved.select("profile", "key", "old_value", "new_value", F.col("id").alias("caused_by"), F.col("at").alias("changed_at"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_oldest: str) -> DataFrame:
    """Rows by key: new ones replace old ones, but the column keep_oldest stays the oldest."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    rest = [c for c in old.columns if c not in (key, keep_oldest)]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "__v").alias("r"), F.min(keep_oldest).alias(keep_oldest)).select(key, "r.*", keep_oldest).select(*old.columns)


def _jump_sums(nodes: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(finished, still) of nodes(pid, up, acc): pid, acc of nodes whose ancestors end, with acc summed over all below them; and what still has
    an ancestor after so many rounds. Round k adds what is 2**k to 2**(k+1) - 1 levels below; each node is one row throughout."""
    for _ in range(rounds):
        if nodes.where("up IS NOT NULL").isEmpty():
            break
        below = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("pid")).agg(F.sum("acc").alias("more"))
        above = nodes.select(F.col("pid").alias("up"), F.col("up").alias("next"))
        moved = nodes.join(above, "up", "left").select("pid", F.col("next").alias("up"), "acc")
        nodes = checkpointed(moved.join(below, "pid", "left").select("pid", "up", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    return nodes.where("up IS NULL").select("pid", "acc"), nodes.where("up IS NOT NULL")


def tree_sum(processes: DataFrame) -> DataFrame:
    """root, total of (pid, parent, rss): a process and all below it, at any depth; in a cycle each process counts once.

    Sums jump: each round doubles how far every process looks up, so a tree of depth n takes log2(n) rounds of one row a process, each cut off by a checkpoint; no pairs
    of ancestors and descendants are made. Processes that still look up after that many rounds hang on a cycle: its members are cut off from each other, sum what hangs on
    them, and share the total. Pids are unique; a null parent, one that is not in the table and a process's own pid are none; a null rss counts as 0.
    """
    p = checkpointed(processes.select("pid", "parent", F.coalesce("rss", F.lit(0)).alias("acc")))
    known = p.select(F.col("pid").alias("up"))
    nodes = checkpointed(p.withColumn("up", F.when(F.col("parent") != F.col("pid"), F.col("parent"))).join(known, "up", "left_semi").select("pid", "up", "acc"))
    nodes = checkpointed(nodes.unionByName(p.join(nodes.select("pid"), "pid", "left_anti").select("pid", F.lit(None).cast(nodes.schema["up"].dataType).alias("up"), "acc")))
    rounds = max(1, nodes.count()).bit_length() + 1
    done, still = _jump_sums(nodes, rounds)
    if still.isEmpty():
        return done.select(F.col("pid").alias("root"), F.col("acc").alias("total"))
    # whoever is looked up to after more steps than there are processes is in a cycle
    members = checkpointed(still.select(F.col("up").alias("pid")).distinct())
    hanging = nodes.join(still.select("pid"), "pid", "left_semi")
    in_cycle = members.withColumn("cyclic", F.lit(True))
    cut = checkpointed(hanging.join(in_cycle, "pid", "left").select("pid", F.when(F.col("cyclic").isNull(), F.col("up")).alias("up"), "acc"))
    sums, _ = _jump_sums(cut, rounds)
    sums = checkpointed(sums)
    # each cycle is called by its least pid, found by doubling too
    ring = checkpointed(nodes.join(members, "pid", "left_semi").select("pid", "up", F.least("pid", "up").alias("name")))
    for _ in range(rounds):
        far = ring.select(F.col("pid").alias("up"), F.col("up").alias("next"), F.col("name").alias("other"))
        ring = checkpointed(ring.join(far, "up").select("pid", F.col("next").alias("up"), F.least("name", "other").alias("name")))
    named = ring.select("pid", "name").join(sums, "pid")
    totals = named.groupBy("name").agg(F.sum("acc").alias("total"))
    cyclic = named.join(totals, "name").select(F.col("pid").alias("root"), "total")
    beside = sums.join(members, "pid", "left_anti").select(F.col("pid").alias("root"), F.col("acc").alias("total"))
    return done.select(F.col("pid").alias("root"), F.col("acc").alias("total")).unionByName(cyclic).unionByName(beside)


def burst_and_sustained(runs: DataFrame) -> DataFrame:
    """job_id, burst, sustained, peak of (job_id, run, wall, rss): the first run; the median of the others (the first if alone); the largest."""
    first = F.min("run").over(Window.partitionBy("job_id"))
    r = runs.withColumn("is_first", F.col("run") == first)
    per = r.groupBy("job_id").agg(F.max(F.when(F.col("is_first"), F.col("wall"))).alias("burst"), F.median(F.when(~F.col("is_first"), F.col("wall"))).alias("rest"), F.max("rss").alias("peak"))
    return per.select("job_id", "burst", F.coalesce("rest", "burst").alias("sustained"), "peak")
