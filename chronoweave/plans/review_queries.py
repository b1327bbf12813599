"""Queries over corrections, replays, the corpus of accepted edits and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, intervals, review as rv
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


_CORR = dict(corrections="SELECT job_id, t_in + 4e-7 AS t_in, t_out AS t_out FROM removals WHERE CAST(floor(t_in * 10) AS BIGINT) % 5 = 0",
    hit="SELECT * FROM removals r WHERE EXISTS (SELECT 1 FROM corrections c WHERE c.job_id = r.job_id AND abs(c.t_in - r.t_in) <= 1e-6 AND abs(c.t_out - r.t_out) <= 1e-6)")


def _corrections(spark, d):
    return ad.removals(spark, d).where(F.floor(F.col("t_in") * 10) % 5 == 0).select("job_id", (F.col("t_in") + 4e-7).alias("t_in"), "t_out")


@_q(sql("SELECT job_id, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out, kind FROM removals r WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.job_id = r.job_id AND h.t_in = r.t_in)", **_CORR))
def apply_corrections(spark, d):
    return _rounded(rv.matched_removals(ad.removals(spark, d), _corrections(spark, d), "left_anti"), "t_in", "t_out")


@_q(sql("SELECT job_id, round(t_in, 6) AS t_in FROM (SELECT job_id, t_in + 1e-5 AS t_in, t_out FROM corrections) c WHERE NOT EXISTS (SELECT 1 FROM removals r WHERE c.job_id = r.job_id AND abs(c.t_in - r.t_in) <= 1e-6 AND abs(c.t_out - r.t_out) <= 1e-6)", **_CORR))
def stale_corrections(spark, d):
    off = _corrections(spark, d).withColumn("t_in", F.col("t_in") + 1e-5)
    return _rounded(rv.stale_corrections(ad.removals(spark, d), off).select("job_id", "t_in"), "t_in")


@_q(sql("""SELECT job_id, round(a, 6) AS t_in, round(b, 6) AS t_out, CASE coalesce(max(rank), 2) WHEN 0 THEN 'optional' WHEN 1 THEN 'supporting' ELSE 'essential' END AS tier FROM
  (SELECT h.job_id, h.t_in AS a, h.t_out AS b, CASE s.tier WHEN 'optional' THEN 0 WHEN 'supporting' THEN 1 WHEN 'essential' THEN 2 END AS rank FROM hit h
   LEFT JOIN tier_segments s ON s.job_id = h.job_id AND (abs(s.t_out - h.t_in) <= 1e-6 OR abs(s.t_in - h.t_out) <= 1e-6)) GROUP BY job_id, a, b""", **_CORR))  # fmt: skip
def reinstated_tier(spark, d):
    hit = rv.matched_removals(ad.removals(spark, d), _corrections(spark, d))
    return _rounded(rv.reinstated_segments(hit, ad.tier_segments(spark, d)), "t_in", "t_out")


_RAISED = "SELECT *, CASE WHEN l_linenumber = 1 AND tier = 'optional' THEN 'supporting' ELSE tier END AS raised FROM line_segments"


@_q(sql("""SELECT job_id, printf('segments[%.3f]', t_in) AS path, tier AS before, raised AS after FROM raised WHERE tier <> raised
  UNION ALL SELECT job_id, printf('removals[%.3f]', t_in), 'removed', NULL FROM line_segments WHERE tier = 'optional' AND l_linenumber = 2""", raised=_RAISED))
def spec_diff(spark, d):
    p = ad.line_segments(spark, d)
    c = p.withColumn("tier", F.when((F.col("l_linenumber") == 1) & (F.col("tier") == "optional"), "supporting").otherwise(F.col("tier")))
    before = p.where("tier = 'optional'")
    return rv.segment_changes(p, c, before, before.where("l_linenumber <> 2"))


_PROFILES = [("shorts_9x16", "duration_budget", 15.0), ("shorts_9x16", "focus.zoom_factor", 1.0), ("shorts_9x16", "captions.max_lines", 3.0), ("demo_16x9", "duration_budget", 180.0), ("demo_16x9", "focus.zoom_factor", 1.35), ("demo_16x9", "captions.max_lines", 2.0)]
_PROFILE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}', {v}::DOUBLE)" for n, p, v in _PROFILES) + ") v(name, path, value)"
_OVER_SQL = "SELECT CASE nation.n_regionkey % 2 WHEN 0 THEN 'shorts_9x16' ELSE 'demo_16x9' END AS name, CASE n_nationkey % 4 WHEN 0 THEN 'duration_budget' WHEN 1 THEN 'focus.zoom_factor' WHEN 2 THEN 'captions.max_lines' ELSE 'unknown.path' END AS path, max(n_nationkey)::DOUBLE AS value FROM nation GROUP BY 1, 2"


def _profiles(spark):
    return spark.createDataFrame(_PROFILES, "name string, path string, value double")


def _overrides(spark, d):
    n = ad.read(spark, d, "nation")
    name = F.when(F.col("n_regionkey") % 2 == 0, "shorts_9x16").otherwise("demo_16x9")
    k = F.col("n_nationkey") % 4
    path = F.when(k == 0, "duration_budget").when(k == 1, "focus.zoom_factor").when(k == 2, "captions.max_lines").otherwise("unknown.path")
    return n.groupBy(name.alias("name"), path.alias("path")).agg(F.max("n_nationkey").cast("double").alias("value"))


@_q(f"WITH p AS ({_PROFILE_SQL}), o AS ({_OVER_SQL}) SELECT coalesce(o.name, p.name) AS name, coalesce(o.path, p.path) AS path, coalesce(o.value, p.value) AS value FROM p FULL JOIN o ON p.name = o.name AND p.path = o.path")
def deep_merge(spark, d):
    return rv.deep_merge(_profiles(spark), _overrides(spark, d))


@_q(f"WITH p AS ({_PROFILE_SQL}), o AS ({_OVER_SQL}) SELECT p.name, p.path, CASE WHEN abs(o.value - p.value) > 1e-6 THEN o.value ELSE p.value END AS value, coalesce(abs(o.value - p.value) > 1e-6, false) AS changed FROM p LEFT JOIN o ON p.name = o.name AND p.path = o.path")
def tunable_overrides(spark, d):
    return rv.tunable_overrides(_profiles(spark), _overrides(spark, d))


@_q(f"WITH p AS ({_PROFILE_SQL}), o AS ({_OVER_SQL}) SELECT name, path, value FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.name = o.name AND p.path = o.path)")
def unknown_paths(spark, d):
    return rv.unknown_paths(_profiles(spark), _overrides(spark, d)).select("name", "path", "value")


_LEAVES = """SELECT o_orderkey AS job_id, path, CASE path WHEN 'status' THEN o_orderstatus WHEN 'priority' THEN o_orderpriority ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS value FROM orders, (VALUES ('status'), ('priority'), ('total')) v(path)"""


@_q(f"""WITH a AS ({_LEAVES}), b AS (SELECT job_id, path, CASE WHEN path = 'status' AND job_id % 7 = 0 THEN 'X' ELSE value END AS value FROM a WHERE NOT (path = 'priority' AND job_id % 11 = 0))
SELECT a.job_id, a.path, a.value AS before, b.value AS after FROM a LEFT JOIN b ON a.job_id = b.job_id AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value""")
def document_drift(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.floor("o_totalprice").cast("string").alias("total"))
    a = o.unpivot("job_id", ["status", "priority", "total"], "path", "value")
    b = a.where("NOT (path = 'priority' AND job_id % 11 = 0)").withColumn("value", F.when((F.col("path") == "status") & (F.col("job_id") % 7 == 0), "X").otherwise(F.col("value")))
    return rv.drift(a, b)


@_q(sql("""SELECT a.job_id, round(a.cut, 6) AS cut, round(coalesce(min(abs(a.cut - b.cut)), any_value(duration)), 6) AS drift FROM (SELECT DISTINCT job_id, t_in AS cut FROM removals) a JOIN durations USING (job_id)
  LEFT JOIN (SELECT job_id, t_out AS cut FROM removals WHERE kind = 'silence') b ON a.job_id = b.job_id GROUP BY a.job_id, a.cut"""))
def boundary_drift(spark, d):
    r = ad.removals(spark, d)
    return _rounded(rv.boundary_drift(r.select("job_id", F.col("t_in").alias("cut")), r.where("kind = 'silence'").select("job_id", F.col("t_out").alias("cut")), ad.durations(spark, d)), "cut", "drift")


@_q(sql("""SELECT job_id, round(coalesce(kept / duration, 1.0), 6) AS retained, round(coalesce(best / duration, 1.0), 6) AS essential, coalesce(n_segments, 0) AS n_segments, coalesce(n_removals, 0) AS n_removals FROM durations
  LEFT JOIN (SELECT job_id, count(*) AS n_segments, sum(t_out - t_in) AS kept, coalesce(sum(t_out - t_in) FILTER (tier = 'essential'), 0.0) AS best FROM tier_segments GROUP BY job_id) USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS n_removals FROM removals GROUP BY job_id) USING (job_id) WHERE duration > 0"""))
def edit_summary(spark, d):
    return _rounded(rv.edit_summary(ad.tier_segments(spark, d), ad.removals(spark, d), ad.durations(spark, d)), "retained", "essential")


def _prices(spark, d):
    return ad.read(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_totalprice").alias("value"), F.lit(150000.0).alias("approved"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))


@_q("SELECT o_custkey AS job_id, count(*) AS n, round(median(o_totalprice), 6) AS middle, round(max(o_totalprice) - min(o_totalprice), 6) AS spread, abs(median(o_totalprice) - 150000.0) <= 30000 + 1e-6 AS within FROM orders GROUP BY o_custkey")
def run_distribution(spark, d):
    return _rounded(rv.run_distribution(_prices(spark, d), 30000.0), "middle", "spread")


@_q("SELECT job_id, v[least(CAST(round_even((len(v) - 1) * 0.9::DOUBLE, 0) AS BIGINT), len(v) - 1) + 1] AS value FROM (SELECT o_custkey AS job_id, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_custkey)")
def nearest_rank_percentile(spark, d):
    return rv.nearest_rank(_prices(spark, d), 0.9)


@_q("""SELECT o_orderpriority AS profile, CASE WHEN o_orderstatus = 'P' THEN 'unverified' WHEN o_orderkey % 10 = 0 THEN 'no_profile' WHEN o_custkey % 4 = 0 THEN 'synthetic' WHEN o_custkey % 4 = 1 THEN 'unknown' ELSE 'accepted' END AS reason, count(*) AS n FROM orders GROUP BY 1, 2""")
def corpus_exclusions(spark, d):
    o = ad.read(spark, d, "orders")
    p = F.when(F.col("o_custkey") % 4 == 0, "synthetic").when(F.col("o_custkey") % 4 == 1, "unknown").otherwise("recorded")
    return rv.corpus_exclusions(o.select(F.col("o_orderpriority").alias("profile"), (F.col("o_orderstatus") != "P").alias("verified"), (F.col("o_orderkey") % 10 != 0).alias("has_profile"), p.alias("provenance")))


@_q("SELECT o_custkey AS job_id, count(*) AS n, count(*) FILTER (abs(o_totalprice - 150000.0) > 1e-6) AS n_corrected, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS oldest, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS newest FROM orders GROUP BY o_custkey")
def tunable_spread(spark, d):
    return rv.tunable_spread(_prices(spark, d), 150000.0)


_LATEST = "SELECT * FROM (SELECT o_custkey AS job_id, o_orderkey AS id, o_orderstatus = 'F' AS passed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"


def _latest(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("passed"), F.col("o_orderdate").alias("at"))
    return rv.latest(o, ["job_id"], ["at", "id"]).select("job_id", "id", "passed")


@_q(f"SELECT job_id, id, passed FROM ({_LATEST})")
def latest_verification(spark, d):
    return _latest(spark, d)


@_q(f"SELECT job_id, id FROM ({_LATEST}) WHERE passed")
def verified_jobs(spark, d):
    return _latest(spark, d).where("passed").select("job_id", "id")


@_q("SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def job_listing(spark, d):
    return ad.read(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))


@_q("SELECT job_id, count(*) AS n, round(median(v), 6) AS middle FROM (SELECT o_custkey AS job_id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 10 GROUP BY job_id HAVING count(*) >= 5")
def windowed_median(spark, d):
    return _rounded(rv.windowed_median(_prices(spark, d), 10, 5), "middle")


@_q("SELECT o_orderkey % 1000 AS key, max_by(o_orderstatus, o_orderkey) AS status, strftime(min(o_orderdate), '%Y-%m-%d') AS created FROM orders GROUP BY 1")
def upsert_jobs(spark, d):
    o = ad.read(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))
    newest = rv.latest(o, ["key"], ["id"])
    old = o.join(newest, ["key", "id"], "left_anti").groupBy("key").agg(F.max("id").alias("id"), F.lit("old").alias("status"), F.min("created").alias("created"))
    return rv.upsert(old, newest.select("key", "id", "status", "created"), "key", "created").select("key", "status", "created")


@_q("WITH RECURSIVE p AS (SELECT c_custkey AS pid, c_custkey // 3 AS parent, c_custkey % 100 AS rss FROM customer), b(root, pid, depth) AS (SELECT pid, pid, 0 FROM p UNION ALL SELECT b.root, p.pid, depth + 1 FROM b JOIN p ON p.parent = b.pid AND p.pid <> b.pid WHERE depth < 40) SELECT root, CAST(sum(rss) AS BIGINT) AS total FROM (SELECT DISTINCT root, pid FROM b) JOIN p USING (pid) GROUP BY root")
def process_tree_sum(spark, d):
    c = ad.read(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 3).alias("parent"), (F.col("c_custkey") % 100).alias("rss"))
    return rv.tree_sum(c)


@_q("""SELECT job_id, burst, coalesce(rest, burst) AS sustained, peak FROM (SELECT l_orderkey AS job_id, max(wall) FILTER (run = f) AS burst, median(wall) FILTER (run <> f) AS rest, max(rss) AS peak FROM
  (SELECT l_orderkey, wall, rss, run, min(run) OVER (PARTITION BY l_orderkey) AS f FROM (SELECT l_orderkey, l_quantity AS wall, l_extendedprice AS rss, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS run FROM lineitem)) GROUP BY l_orderkey)""")
def burst_sustained(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rv.burst_and_sustained(ad.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.row_number().over(w).alias("run"), F.col("l_quantity").alias("wall"), F.col("l_extendedprice").alias("rss")))


# checks

_B = "SELECT job_id, budget, greatest(total - budget, 0.0) AS overrun FROM (SELECT job_id, budget, CASE WHEN d0 <= budget + 1e-6 THEN d0 WHEN d1 <= budget + 1e-6 THEN d1 ELSE d2 END AS total FROM (SELECT job_id, sum(dur) AS d0, coalesce(sum(dur) FILTER (tier <> 'optional'), 0) AS d1, coalesce(sum(dur) FILTER (tier = 'essential'), 0) AS d2 FROM line_segments GROUP BY job_id), budgets)"


def _overruns(spark, d):
    return intervals.budget_threshold(ad.line_segments(spark, d), ad.budgets(spark))


@_q(sql("""SELECT job_id, 'budget' AS "check", CASE WHEN job_id % 2 = 0 THEN 'FAIL' ELSE 'WARN' END AS severity, 'over budget' AS message, overrun AS value, budget AS "limit" FROM b WHERE overrun > 1e-6""", b=_B))
def budget_findings(spark, d):
    return checks.budget(_overruns(spark, d), F.col("job_id") % 2 == 0)


_FACTS = """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 17 <> 0 THEN -14.0::DOUBLE + (o_orderkey % 7 - 3) * 0.5::DOUBLE END AS integrated, -3.0::DOUBLE + (o_orderkey % 5) * 0.75::DOUBLE AS peak,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 9 * 0.1::DOUBLE + 10 END AS actual FROM orders"""


def _facts(spark, d):
    k = F.col("o_orderkey")
    return ad.read(spark, d, "orders").select(k.alias("job_id"), F.when(k % 17 != 0, -14.0 + (k % 7 - 3) * 0.5).alias("integrated"), (-3.0 + (k % 5) * 0.75).alias("peak"), F.when(k % 13 != 0, (k % 9) * 0.1 + 10).alias("actual"))


_LOUD = """SELECT job_id, 'loudness' AS "check", 'WARN' AS severity, 'not measured' AS message, CAST(NULL AS DOUBLE) AS value, 1.0::DOUBLE AS "limit" FROM facts WHERE integrated IS NULL
  UNION ALL SELECT job_id, 'loudness', 'FAIL', 'off target', abs(integrated + 14.0), 1.0 FROM facts WHERE abs(integrated + 14.0) > 1.0 UNION ALL SELECT job_id, 'true_peak', 'FAIL', 'over the ceiling', peak, -1.0 FROM facts WHERE peak > -1.0"""


@_q(f"WITH facts AS ({_FACTS}) {_LOUD}")
def loudness_findings(spark, d):
    return checks.loudness(_facts(spark, d))


_DUR = """SELECT job_id, 'render_missing' AS "check", 'FAIL' AS severity, 'no render' AS message, CAST(NULL AS DOUBLE) AS value, 0.25::DOUBLE AS "limit" FROM facts WHERE actual IS NULL
  UNION ALL SELECT job_id, 'duration', 'FAIL', 'duration differs', round(abs(actual - 10.0), 6), 0.25 FROM facts WHERE abs(actual - 10.0) > 0.25"""


@_q(f"WITH facts AS ({_FACTS}) {_DUR}")
def duration_findings(spark, d):
    f = _facts(spark, d)
    return _rounded(checks.duration_drift(f.select("job_id", F.lit(10.0).alias("seconds")), f), "value")


@_q(f"""WITH facts AS ({_FACTS}), f AS ({_LOUD} UNION ALL {_DUR})
SELECT job_id, count(*) FILTER (severity = 'FAIL') = 0 AS passed, count(*) FILTER (severity = 'FAIL') AS n_fail, count(*) FILTER (severity = 'WARN') AS n_warn, count(*) FILTER (severity = 'INFO') AS n_info FROM f GROUP BY job_id""")
def report_rollup(spark, d):
    f = _facts(spark, d)
    return checks.rollup(checks.loudness(f).unionByName(checks.duration_drift(f.select("job_id", F.lit(10.0).alias("seconds")), f)))


@_q(sql("""SELECT job_id, 'edit_totality' AS "check", 'FAIL' AS severity, 'edit does not cover the recording' AS message, round(abs(seconds - duration), 6) AS value, 1e-6::DOUBLE AS "limit" FROM durations JOIN (SELECT job_id, sum(s) AS seconds FROM
  (SELECT job_id, t_out - t_in AS s FROM removals UNION ALL SELECT job_id, t_out - t_in FROM gaps WHERE t_in > 1) GROUP BY job_id) USING (job_id) WHERE abs(seconds - duration) > 1e-6"""))
def edit_totality_findings(spark, d):
    gaps = intervals.complement(ad.removals(spark, d), ad.durations(spark, d)).where("t_in > 1")
    both = ad.removals(spark, d).select("job_id", "t_in", "t_out").unionByName(gaps)
    covered = both.groupBy("job_id").agg(F.sum(F.col("t_out") - F.col("t_in")).alias("seconds"))
    return _rounded(checks.edit_totality(covered, ad.durations(spark, d)), "value")


_CAP = """WITH RECURSIVE c AS (SELECT conv_id * 100 AS job_id, turn, turn * 2.0::DOUBLE AS t_in, turn * 2.0::DOUBLE + CASE WHEN turn % 5 = 4 THEN 2.5 WHEN turn % 3 = 0 THEN 0.5 ELSE 2.0 END AS t_out, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM conversations),
x AS (SELECT *, coalesce(lead(t_in) OVER (PARTITION BY job_id ORDER BY t_in) < t_out - 1e-6, false) AS lap FROM c),
per AS (SELECT job_id, count(*) FILTER (lap) AS laps, min(t_out - t_in) AS briefest FROM x GROUP BY job_id),
rows_ AS (SELECT job_id, turn, i, length(w[i]) AS n FROM (SELECT job_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM c)),
state AS (SELECT job_id, turn, i, 1 AS line, n AS size FROM rows_ WHERE i = 1
  UNION ALL SELECT r.job_id, r.turn, r.i, CASE WHEN s.size + 1 + r.n <= 200 THEN s.line ELSE s.line + 1 END, CASE WHEN s.size + 1 + r.n <= 200 THEN s.size + 1 + r.n ELSE r.n END FROM state s JOIN rows_ r ON r.job_id = s.job_id AND r.turn = s.turn AND r.i = s.i + 1),
lines AS (SELECT job_id, max(line) AS n_lines, max(size) AS longest FROM state GROUP BY job_id)
SELECT job_id, 'caption_overlap' AS "check", 'FAIL' AS severity, 'captions overlap' AS message, laps::DOUBLE AS value, 0.0::DOUBLE AS "limit" FROM per WHERE laps > 0
UNION ALL SELECT job_id, 'caption_display', 'WARN', 'too brief', briefest, 0.8 FROM per WHERE briefest < 0.8 - 1e-6
UNION ALL SELECT job_id, 'caption_line_length', 'FAIL', 'line too long', longest, 200.0 FROM lines WHERE longest > 200
UNION ALL SELECT job_id, 'caption_line_count', 'FAIL', 'too many lines', n_lines, 9.0 FROM lines WHERE n_lines > 9"""


@_q(_CAP)
def caption_checks(spark, d):
    c = ad.read(spark, d, "conversations")
    t = F.col("turn") * 2.0
    blocks = c.select((F.col("conv_id") * 100).alias("job_id"), t.alias("t_in"), (t + F.when(F.col("turn") % 5 == 4, 2.5).when(F.col("turn") % 3 == 0, 0.5).otherwise(2.0)).alias("t_out"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return checks.captions(blocks, 0.8, 200, 9)


@_q("""SELECT o_orderkey AS job_id, 'dialogue_to_bed' AS "check", 'FAIL' AS severity, 'bed too loud' AS message, 30.0::DOUBLE - o_orderkey % 25 AS value, 12.0::DOUBLE AS "limit" FROM orders WHERE o_custkey % 3 <> 0 AND 30.0 - o_orderkey % 25 < 12""")
def dialogue_findings(spark, d):
    a = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit(0.0).alias("narration_gain_db"), F.lit(-18.0).alias("music_gain_db"), (F.col("o_orderkey") % 25 - 12).cast("double").alias("duck_db"), (F.col("o_custkey") % 3 != 0).alias("has_bed"))
    return checks.dialogue_to_bed(a)


@_q(sql("""SELECT job_id, ix, arg_min(verdict, frame * 2 + CASE verdict WHEN 'outside' THEN 0 ELSE 1 END) AS verdict, min(frame) AS frame FROM
  (SELECT f.*, CASE WHEN x < 0.06 OR x > 0.94 OR y < 0.06 OR y > 0.94 THEN 'outside' WHEN y >= 0.78 AND EXISTS (SELECT 1 FROM blocks c WHERE c.job_id = f.job_id AND f.frame BETWEEN floor(c.t_in / 0.25) AND floor(c.t_out / 0.25)) THEN 'over_caption' END AS verdict FROM
    (SELECT job_id, ix, x, y, unnest(range(a, b, greatest((b - a) // 12, 1))) AS frame FROM (SELECT job_id, id AS ix, x, y, CAST(floor(t / 0.25) AS BIGINT) AS a, CAST(greatest(floor((t + 2.0) / 0.25), floor(t / 0.25) + 1) AS BIGINT) AS b FROM points)) f) WHERE verdict IS NOT NULL GROUP BY job_id, ix"""))
def overlay_collisions(spark, d):
    o = ad.points(spark, d).select("job_id", F.col("id").alias("ix"), F.col("t").alias("t_in"), (F.col("t") + 2.0).alias("t_out"), "x", "y")
    return checks.overlay_collisions(o, ad.blocks(spark, d))


@_q("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus <> 'O') AS n_calls, count(*) FILTER (o_orderstatus = 'P') AS n_violations, CASE WHEN count(*) FILTER (o_orderstatus <> 'O') > 0 THEN count(*) FILTER (o_orderstatus = 'P') / count(*) FILTER (o_orderstatus <> 'O') END AS rate FROM orders GROUP BY 1")
def violation_rate(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") != "O").alias("called"), (F.col("o_orderstatus") == "P").alias("violated"))
    return checks.violation_rate(o, "priority")


@_q("SELECT * FROM (SELECT event_id AS id, concat_ws(',', CASE WHEN NOT value >= 5 THEN 'value_low' END, CASE WHEN NOT value <= 200 THEN 'value_high' END, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'type' END) AS violations FROM events) WHERE violations <> ''")
def range_violations(spark, d):
    e = ad.read(spark, d, "events")
    return checks.range_violations(e, {"value_low": F.col("value") >= 5, "value_high": F.col("value") <= 200, "type": F.col("event_type").isin("click", "view", "error")}).select(F.col("event_id").alias("id"), "violations")


_ALL = """SELECT job_id, "check", severity, message, round(value, 6) AS value, "limit" FROM (%s)""" % " UNION ALL ".join(f"SELECT * FROM ({S[n]})" for n in ("loudness_findings", "duration_findings", "edit_totality_findings", "budget_findings", "dialogue_findings"))


@_q(_ALL)
def all_findings(spark, d):
    parts = [f(spark, d).withColumn("value", F.col("value").cast("double")) for f in (loudness_findings, duration_findings, edit_totality_findings, budget_findings, dialogue_findings)]
    return _rounded(checks.verify(*parts), "value")


def _leaves(spark, d, changed):
    """A document with three segments for each order, flattened. changed: as a replay would leave it."""
    o = ad.read(spark, d, "orders")
    n, k = F.col("i").cast("string"), F.col("o_orderkey") % 5 == 0
    at = lambda name, v: F.struct(F.concat(F.lit("segments["), n, F.lit("]." + name)).alias("path"), v.cast("string").alias("value"))
    start = F.col("o_totalprice") + F.col("i") + (F.when(k & (F.col("i") == 1), 1.0).otherwise(0.0) if changed else 0.0)
    tier = F.when(k, "essential").otherwise(F.col("o_orderstatus")) if changed else F.col("o_orderstatus")
    lines = o.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(F.col("o_orderkey").alias("job_id"), F.explode(F.array(at("t_in", start), at("tier", tier), at("note", tier))).alias("x")).select("job_id", "x.path", "x.value")
    head = F.array(*(F.struct(F.lit(p).alias("path"), v.cast("string").alias("value")) for p, v in (("created_at", F.lit("b" if changed else "a")), ("source.duration", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1.0 if changed else 0.0).otherwise(0.0)))))
    return lines.unionByName(o.select(F.col("o_orderkey").alias("job_id"), F.explode(head).alias("x")).select("job_id", "x.path", "x.value"))


@_q("""SELECT o_orderkey AS job_id, 'segments[1].t_in' AS path, 'trim' AS stage, round(o_totalprice + 1, 6) AS before, round(o_totalprice + 2, 6) AS after FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'source.duration', 'ingest', round(o_totalprice, 6), round(o_totalprice + 1, 6) FROM orders WHERE o_orderkey % 7 = 0""")
def deterministic_drift(spark, d):
    from ..sources import schemas as sc

    document = sc.struct(sc.field("job_id", sc.S), sc.field("created_at", sc.S), sc.field("source", sc.SOURCE), sc.field("segments", sc.ArrayType(sc.struct(sc.field("t_in", sc.D, "trim"), sc.field("tier", sc.S, "edit", "model")))))
    found = rv.deterministic_drift(_leaves(spark, d, False), _leaves(spark, d, True), sc.leaves(document))
    return _rounded(found.withColumn("before", F.col("before").cast("double")).withColumn("after", F.col("after").cast("double")), "before", "after")
