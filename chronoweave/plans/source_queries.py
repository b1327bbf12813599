"""Queries over parsers, documents and frame geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from ..sources import recordings as rec
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


_SEG = "SELECT conv_id * 1000 + turn AS job_id, ix AS pos, ix * 400 AS from_ms, ix * 400 + 320 AS to_ms, CASE WHEN ix % 7 = 3 THEN '[noise]' WHEN ix % 5 = 0 THEN ' ,' ELSE text END AS text FROM turn_words"


@_q(sql(r"""SELECT job_id, CAST(island - 1 AS BIGINT) AS ix, first(from_ms ORDER BY pos) / 1000.0::DOUBLE AS t_in, greatest(max(to_ms), first(from_ms ORDER BY pos)) / 1000.0::DOUBLE AS t_out, string_agg(text, '' ORDER BY pos) AS text FROM
  (SELECT *, sum(CASE WHEN regexp_matches(text, '[\p{L}\p{M}\p{N}\p{Pc}]') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY pos) AS island FROM (SELECT job_id, pos, from_ms, to_ms, trim(text) AS text FROM seg) WHERE text <> '' AND NOT regexp_matches(text, '^[\[(].*[\])]$')) WHERE island > 0 GROUP BY job_id, island""", seg=_SEG))
def asr_words_cleanup(spark, d):
    ix = F.col("ix")
    s = ad.turn_words(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), ix.alias("pos"), (ix * 400).alias("from_ms"), (ix * 400 + 320).alias("to_ms"), F.when(ix % 7 == 3, "[noise]").when(ix % 5 == 0, " ,").otherwise(F.col("text")).alias("text"))
    return rec.asr_words(s)


@_q(sql("SELECT job_id, greatest(round(t_in, 4), 0.0) AS t_in, round(t_out, 4) AS t_out FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t_in) AS r FROM silences) WHERE r % 4 <> 0"))
def silence_log_parse(spark, d):
    from pyspark.sql import Window

    s = ad.silences(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy("t_in")))
    start = s.select("job_id", (F.col("r") * 2).alias("line"), F.concat(F.lit("[f] silence_start: "), F.round("t_in", 4).cast("decimal(20,4)").cast("string")).alias("text"))
    end = s.where("r % 4 <> 0").select("job_id", (F.col("r") * 2 + 1).alias("line"), F.concat(F.lit("[f] silence_end: "), F.round("t_out", 4).cast("decimal(20,4)").cast("string"), F.lit(" | silence_duration: 1")).alias("text"))
    return rec.silence_spans(start.unionByName(end))


@_q("""SELECT conv_id AS job_id, CASE WHEN conv_id % 3 = 0 THEN '{"a": ' || t || '}' WHEN conv_id % 3 = 1 THEN '{"b": ' || t || '}' ELSE 'turn ' || t END AS fragment, conv_id % 3 = 0 AS fenced FROM (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id)""")
def agent_last_fragment(spark, d):
    c = ad.read(spark, d, "conversations").select("conv_id", "turn", "role")
    t = F.col("turn").cast("string")
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('Here:\n```json\n{"a": '), t, F.lit("}\n``` done"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('It is {"b": '), t, F.lit("} then"))).otherwise(F.concat(F.lit("turn "), t))
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    event = F.to_json(F.struct(F.lit("message_end").alias("type"), F.struct("role", F.array(block("thinking", F.lit("hm")), block("text", said)).alias("content")).alias("message")))
    log = c.select(F.col("conv_id").alias("job_id"), (F.col("turn") * 2).alias("line"), event.alias("text")).unionByName(c.select(F.col("conv_id").alias("job_id"), (F.col("turn") * 2 + 1).alias("line"), F.lit("{ not json").alias("text")))
    return rec.last_fragment(log)


@_q("""SELECT event_id AS id, sha256('{"input_hash":"' || sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') || '","params_hash":"' || sha256('{"event_id":' || event_id || '}') || '","stage":"focus","stage_version":2}') AS key FROM events""")
def content_key(spark, d):
    return ad.read(spark, d, "events").select(F.col("event_id").alias("id"), rec.content_key(F.lit("focus"), F.lit(2), ["user_id", "event_type"], ["event_id"]).alias("key"))


@_q("""SELECT o_orderkey AS job_id, 3 AS spec_version, CASE WHEN o_orderkey % 5 IN (1, 2) AND o_orderkey % 2 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'recorded' END AS provenance FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3""")
def migrate_v1(spark, d):
    k = F.col("o_orderkey")
    specs = ad.read(spark, d, "orders").select(k.alias("job_id"), (k % 5).cast("int").alias("spec_version"), F.when(k % 2 == 1, "recorded").alias("provenance"))
    return rec.migrate(specs)[0]


@_q("""SELECT o_orderkey AS job_id, path, value FROM (SELECT o_orderkey, 'head.status' AS path, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'head.customer', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT l_orderkey, 'items[' || (r - 1) || '].line', CAST(l_linenumber AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT l_orderkey, 'items[' || (r - 1) || '].part', CAST(l_partkey AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders))""")
def flatten_document(spark, d):
    items = ad.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))).alias("items"))
    o = ad.read(spark, d, "orders")
    docs = o.join(items, o["o_orderkey"] == items["l_orderkey"], "left").select(F.col("o_orderkey").alias("job_id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("head"), "items")
    return rec.flatten(docs, "job_id")


@_q("SELECT user_id AS job_id, event_id AS id, round(event_id * 37 / 1000.0::DOUBLE - 5.5::DOUBLE, 6) AS t FROM events WHERE event_id * 37 / 1000.0::DOUBLE - 5.5::DOUBLE >= 0 AND event_type = 'click'")
def recorder_clicks(spark, d):
    e = ad.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.struct((F.col("event_id") * 37).cast("double").alias("time_ms"), (F.col("event_type") == "click").alias("down"), F.col("event_id").alias("id")).alias("c"))
    raw = e.groupBy("job_id").agg(F.collect_list("c").alias("clicks"), F.array().cast("array<struct<time_ms:double,x:double,y:double>>").alias("moves"))
    _, clicks = rec.cursor_points(raw, raw.select("job_id", F.lit(5.5).alias("start_time")))
    return clicks.select("job_id", F.bround((F.col("t") + 5.5) * 1000 / 37).cast("long").alias("id"), F.round("t", 6).alias("t"))


@_q(sql("""SELECT job_id, ix, template, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out FROM (SELECT job_id, ix, template, greatest(t_in, 0.0) AS t_in, least(t_out, duration) AS t_out FROM overlays JOIN durations USING (job_id) WHERE t_in IS NOT NULL AND least(t_out, duration) - greatest(t_in, 0.0) >= 0.4 - 1e-6
  UNION ALL SELECT job_id, min(ix), 'pill', NULL, NULL FROM overlays WHERE t_in IS NULL GROUP BY job_id)"""))
def first_of_kind(spark, d):
    return _rounded(frames.one_pill(ad.overlays(spark, d), ad.durations(spark, d)), "t_in", "t_out")


@_q(f"WITH w AS ({ad.CTES['turn_words']}) SELECT conv_id * 1000 + turn AS job_id, ix, ix IN (2, 5) AND turn % 2 = 0 AS emphasis FROM w")
def word_emphasis(spark, d):
    w = ad.turn_words(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), "turn", "ix")
    chosen = w.where("turn % 2 = 0").select("job_id", F.explode(F.array(F.lit(2), F.lit(5), F.lit(5), F.lit(99999))).alias("ix")).distinct()
    return frames.emphasize(w, chosen).select("job_id", "ix", "emphasis")


@_q("""SELECT p_partkey AS id, CAST(ceil(0.05::DOUBLE * w) AS BIGINT) AS x0, CAST(floor((1 - 0.07::DOUBLE) * w) AS BIGINT) AS x1, greatest(CAST(round_even(w / 3 / 2, 0) AS BIGINT) * 2, 2) AS even_third, round(least(1.0, (9.0::DOUBLE / 16) / (w / h)) / 1.35, 6) AS window_w,
  20 * 0.58::DOUBLE * 0.03::DOUBLE * h <= 0.66::DOUBLE * w AS fits FROM (SELECT p_partkey, p_size * 40.0::DOUBLE AS w, p_size * 20.0::DOUBLE AS h FROM part)""")
def frame_geometry(spark, d):
    p = ad.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 40.0).alias("w"), (F.col("p_size") * 20.0).alias("h"))
    safe = frames.safe_pixels(F.lit(0.1), F.lit(0.07), F.lit(0.1), F.lit(0.05), F.col("w"), F.col("h"))
    fit = frames.window_fit(F.col("w"), F.col("h"), F.lit(9.0), F.lit(16.0), F.lit(1.35))
    return p.select("id", safe["x0"].alias("x0"), safe["x1"].alias("x1"), frames.even(F.col("w") / 3).alias("even_third"), F.round(fit["w"], 6).alias("window_w"), frames.captions_fit(F.lit(20), F.lit(0.03), F.lit(0.66), F.col("w"), F.col("h")).alias("fits"))


@_q("SELECT user_id AS job_id, name, count(*) AS n_ran FROM events, (VALUES ('shorts_9x16'), ('demo_16x9')) p(name) WHERE event_type <> 'view' GROUP BY ALL")
def stage_runs_per_profile(spark, d):
    log = ad.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), (F.col("event_type") == "view").alias("cached"))
    counted = frames.stage_log(log).where("n_ran > 0").drop("n_cached")
    return frames.per_profile(counted, spark.createDataFrame([("shorts_9x16",), ("demo_16x9",)], "name string")).select("job_id", "name", "n_ran")


@_q("SELECT n_regionkey AS region, min(n_nationkey * 3 + 20) AS capacity FROM nation GROUP BY 1")
def least_capacity(spark, d):
    n = ad.read(spark, d, "nation").select(F.col("n_regionkey").alias("region"), (F.col("n_nationkey") * 3 + 20).alias("max_chars"), F.lit(1).alias("max_lines"))
    return frames.least_capacity(n, "region")


@_q("SELECT o_orderkey AS job_id, 'checked' AS status, o_custkey AS customer FROM orders")
def dotted_path_set(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("head"))
    return frames.with_path(o, "head.status", F.lit("checked")).select("job_id", "head.status", "head.customer")


@_q("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'voice-' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'take-' || o_orderkey END AS narration FROM orders")
def narration_source(spark, d):
    k = F.col("o_orderkey")
    name = lambda x: F.concat(F.lit(x), k.cast("string"))
    return ad.read(spark, d, "orders").select(k.alias("job_id"), frames.narration_path(k, k % 3 == 0, k % 3 == 1, name("voice-"), name("take-")).alias("narration"))
