"""The test tables seen as jobs: plain projections, said once for Spark and once in SQL.

A job is a user of `events`; six hours are one second. Everything else (silences, removals, spans, segments, proposals, captions,
words) follows from a job's events or from the turns of `conversations`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import intervals


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark, sf_dir) -> DataFrame:
    """job_id, id, t, x, y, kind, weight, event_type."""
    e = read(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    first = F.min("us").over(Window.partitionBy("user_id"))
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "dwell").otherwise("movement")
    e = e.withColumn("us", us)
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), ((F.col("us") - first) / 1e6 / 21600).alias("t"), F.least(F.col("value") / 500, F.lit(1.0)).alias("x"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("y"), kind.alias("kind"), F.when(kind == "click", 1.0).when(kind == "dwell", 0.6).otherwise(0.3).alias("weight"), "event_type",
    )


def durations(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).groupBy("job_id").agg(F.max("t").alias("duration"))


def _next(p: DataFrame) -> DataFrame:
    return p.withColumn("nxt", F.lead("t").over(Window.partitionBy("job_id").orderBy("t", "id")))


def silences(spark, sf_dir) -> DataFrame:
    return _next(points(spark, sf_dir)).where("nxt - t > 2.0").select("job_id", F.col("t").alias("t_in"), F.col("nxt").alias("t_out"), F.lit("silence").alias("kind"), F.lit(0).alias("ord"))


def fillers(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir).where("event_type = 'error'").join(durations(spark, sf_dir), "job_id").where("t < duration")
    return p.select("job_id", F.col("t").alias("t_in"), F.least(F.col("t") + 0.5, F.col("duration")).alias("t_out"), F.lit("filler").alias("kind"), F.lit(1).alias("ord"))


def removals(spark, sf_dir) -> DataFrame:
    return intervals.merge(silences(spark, sf_dir).unionByName(fillers(spark, sf_dir)))


def spans(spark, sf_dir) -> DataFrame:
    gaps = intervals.complement(removals(spark, sf_dir), durations(spark, sf_dir))
    return intervals.lay_out(gaps.withColumnsRenamed({"t_in": "source_in", "t_out": "source_out"}))


def tier_segments(spark, sf_dir) -> DataFrame:
    tier = F.when(F.col("event_type").isin("signup", "purchase"), "essential").when(F.col("event_type").isin("click", "view"), "supporting").otherwise("optional")
    return _next(points(spark, sf_dir)).where("nxt IS NOT NULL").select("job_id", F.col("t").alias("t_in"), F.col("nxt").alias("t_out"), tier.alias("tier"), F.lit("event").alias("reason"))


def proposals(spark, sf_dir) -> DataFrame:
    tier = F.when(F.col("event_type").isin("signup", "purchase"), "essential").when(F.col("event_type").isin("click", "view"), "supporting").otherwise("optional")
    return points(spark, sf_dir).select("job_id", F.col("id").alias("pos"), F.col("t").alias("t_in"), (F.col("t") + 3.0).alias("t_out"), tier.alias("tier"), F.col("event_type").alias("reason"))


def blocks(spark, sf_dir) -> DataFrame:
    p = _next(points(spark, sf_dir)).where("nxt IS NOT NULL")
    return p.select("job_id", F.col("id").alias("block_ix"), F.col("t").alias("t_in"), F.least(F.col("nxt"), F.col("t") + 3.0).alias("t_out"), "event_type")


def block_words(spark, sf_dir) -> DataFrame:
    b = blocks(spark, sf_dir).withColumn("word_ix", F.explode(F.sequence(F.lit(0), F.lit(2))))
    step = (F.col("t_out") - F.col("t_in")) / 3
    return b.select("job_id", "block_ix", "word_ix", (F.col("t_in") + step * F.col("word_ix")).alias("t_in"), (F.col("t_in") + step * (F.col("word_ix") + 1)).alias("t_out"), F.concat("event_type", F.col("word_ix").cast("string")).alias("text"))


def overlays(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    timed = p.where("event_type IN ('signup', 'purchase')").select("job_id", F.col("id").alias("ix"), F.col("event_type").alias("template"), F.col("t").alias("t_in"), (F.col("t") + 2.0).alias("t_out"))
    whole = p.select("job_id").distinct().select("job_id", F.lit(-1).cast("long").alias("ix"), F.lit("pill").alias("template"), F.lit(None).cast("double").alias("t_in"), F.lit(None).cast("double").alias("t_out"))
    return timed.unionByName(whole)


def line_segments(spark, sf_dir) -> DataFrame:
    """Orders as jobs: line items are segments, laid end to end."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    end = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tier = F.when(F.col("l_returnflag") == "R", "essential").when(F.col("l_returnflag") == "A", "supporting").otherwise("optional")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", (end - F.col("l_quantity")).alias("t_in"), end.alias("t_out"), F.col("l_quantity").alias("dur"), tier.alias("tier"))


def budgets(spark) -> DataFrame:
    return spark.createDataFrame([(35.0,), (96.0,), (180.0,)], "budget double")


def turn_words(spark, sf_dir) -> DataFrame:
    """conv_id, turn, ix, t_in, t_out, text: the words of each turn as a metronome says them."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    w = c.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("ix", "text"))
    return w.select("conv_id", "turn", "ix", (F.col("ix") * F.lit(0.4)).alias("t_in"), (F.col("ix") * F.lit(0.4) + 0.32).alias("t_out"), "text")


_TIER = "CASE WHEN event_type IN ('signup', 'purchase') THEN 'essential' WHEN event_type IN ('click', 'view') THEN 'supporting' ELSE 'optional' END"

#: Common table expressions, each from those before it.
CTES = {
    "points": """SELECT user_id AS job_id, event_id AS id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE / 21600 AS t, least(value / 500, 1.0::DOUBLE) AS x,
      CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS y, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'dwell' ELSE 'movement' END AS kind,
      CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS weight, event_type FROM events""",
    "durations": "SELECT job_id, max(t) AS duration FROM points GROUP BY job_id",
    "nexts": "SELECT *, lead(t) OVER (PARTITION BY job_id ORDER BY t, id) AS nxt FROM points",
    "silences": "SELECT job_id, t AS t_in, nxt AS t_out, 'silence' AS kind, 0 AS ord FROM nexts WHERE nxt - t > 2.0",
    "fillers": "SELECT job_id, t AS t_in, least(t + 0.5, duration) AS t_out, 'filler' AS kind, 1 AS ord FROM points JOIN durations USING (job_id) WHERE event_type = 'error' AND t < duration",
    "raw_removals": "SELECT * FROM silences UNION ALL SELECT * FROM fillers",
    "reached": "SELECT *, max(t_out) OVER (PARTITION BY job_id ORDER BY t_in, ord, t_out ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM raw_removals",
    "islands": "SELECT *, sum(CASE WHEN reach IS NULL OR t_in > reach + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t_in, ord, t_out ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM reached",
    "removals": "SELECT job_id, min(t_in) AS t_in, max(t_out) AS t_out, first(kind ORDER BY t_in, ord, t_out) AS kind FROM islands GROUP BY job_id, island",
    "edged": "SELECT *, coalesce(max(t_out) OVER (PARTITION BY job_id ORDER BY t_in, t_out ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS since FROM (SELECT job_id, t_in, t_out FROM removals UNION ALL SELECT job_id, duration, duration FROM durations)",
    "gaps": "SELECT job_id, since AS t_in, t_in AS t_out FROM edged WHERE t_in > since + 1e-6",
    "spans": """SELECT job_id, row_number() OVER w - 1 AS span_ix, t_in AS source_in, t_out AS source_out,
      coalesce(sum(t_out - t_in) OVER (PARTITION BY job_id ORDER BY t_in ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS output_in FROM gaps WINDOW w AS (PARTITION BY job_id ORDER BY t_in)""",
    "tier_segments": f"SELECT job_id, t AS t_in, nxt AS t_out, {_TIER} AS tier, 'event' AS reason FROM nexts WHERE nxt IS NOT NULL",
    "proposals": f"SELECT job_id, id AS pos, t AS t_in, t + 3.0 AS t_out, {_TIER} AS tier, event_type AS reason FROM points",
    "blocks": "SELECT job_id, id AS block_ix, t AS t_in, least(nxt, t + 3.0) AS t_out, event_type FROM nexts WHERE nxt IS NOT NULL",
    "block_words": "SELECT job_id, block_ix, k AS word_ix, t_in + (t_out - t_in) / 3 * k AS t_in, t_in + (t_out - t_in) / 3 * (k + 1) AS t_out, event_type || k AS text FROM blocks, range(3) r(k)",
    "overlays": "SELECT job_id, id AS ix, event_type AS template, t AS t_in, t + 2.0 AS t_out FROM points WHERE event_type IN ('signup', 'purchase') UNION ALL SELECT DISTINCT job_id, -1, 'pill', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM points",
    "line_segments": """SELECT l_orderkey AS job_id, l_linenumber, sum(l_quantity) OVER w - l_quantity AS t_in, sum(l_quantity) OVER w AS t_out, l_quantity AS dur,
      CASE l_returnflag WHEN 'R' THEN 'essential' WHEN 'A' THEN 'supporting' ELSE 'optional' END AS tier FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "budgets": "SELECT unnest([35.0::DOUBLE, 96.0::DOUBLE, 180.0::DOUBLE]) AS budget",
    "turn_words": r"""SELECT conv_id, turn, ix - 1 AS ix, (ix - 1) * 0.4::DOUBLE AS t_in, (ix - 1) * 0.4::DOUBLE + 0.32::DOUBLE AS t_out, w[ix] AS text FROM
      (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS ix FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL))""",
}


def sql(body: str, **more: str) -> str:
    """A query over the common expressions, and more of its own."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in (CTES | more).items()) + "\n" + body
