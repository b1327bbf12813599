"""Queries over whole edit documents and the record store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import checks, documents, review, sketches, stages
from ..sources import store
from . import adapters as ad, interval_queries, review_queries, text_queries, track_queries
from .adapters import sql

Q, S = {}, {}


def _q(query_sql):
    def register(f):
        Q[f.__name__], S[f.__name__] = f, query_sql
        return f

    return register


@_q(sql("""SELECT job_id, part, count(*) AS n, round(max(t_out), 6) AS furthest FROM
  (SELECT job_id, 'overlay' AS part, t_out FROM overlays UNION ALL SELECT job_id, 'segment', t_out FROM proposals UNION ALL SELECT job_id, 'removal', t_out FROM removals UNION ALL SELECT job_id, 'caption', t_out FROM blocks UNION ALL SELECT job_id, 'focus', t FROM points) JOIN durations USING (job_id)
  WHERE t_out > duration + 1e-6 GROUP BY job_id, part"""))
def past_the_end(spark, d):
    focus = ad.points(spark, d).select("job_id", F.col("t").alias("t_out"))
    found = documents.past_the_end(ad.durations(spark, d), overlay=ad.overlays(spark, d), segment=ad.proposals(spark, d), removal=ad.removals(spark, d), caption=ad.blocks(spark, d), focus=focus)
    return found.withColumn("furthest", F.round("furthest", 6))


@_q(sql("""SELECT job_id, block_ix, next_ix FROM (SELECT job_id, pos AS block_ix, t_in, t_out, lead(pos) OVER w AS next_ix, lead(t_in) OVER w AS a, lead(t_out) OVER w AS b FROM proposals WINDOW w AS (PARTITION BY job_id ORDER BY t_in, pos)) WHERE t_in < b - 1e-6 AND a < t_out - 1e-6"""))
def caption_overlaps(spark, d):
    return documents.caption_overlaps(ad.proposals(spark, d).withColumnRenamed("pos", "block_ix"))


_KEYS = """SELECT o_orderkey AS job_id, stage, sha256('{"input_hash":"' || sha256(i) || '","params_hash":"' || sha256(p) || '","stage":"' || stage || '","stage_version":' || v || '}') AS cache_key FROM
  (SELECT o_orderkey, 'trim' AS stage, 2 AS v, '{"o_custkey":' || o_custkey || '}' AS i, '{"o_orderstatus":"' || o_orderstatus || '"}' AS p FROM orders
   UNION ALL SELECT o_orderkey, 'captions', 1, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}', '{"o_orderpriority":"' || o_orderpriority || '"}' FROM orders)"""
_READS = {"trim": (2, ["o_custkey"], ["o_orderstatus"]), "captions": (1, ["o_orderkey", "o_custkey"], ["o_orderpriority"])}


@_q(_KEYS)
def stage_keys(spark, d):
    return documents.stage_keys(ad.read(spark, d, "orders"), "o_orderkey", _READS).withColumnRenamed("o_orderkey", "job_id")


@_q(f"""WITH k AS ({_KEYS}), c AS (SELECT DISTINCT cache_key FROM k JOIN orders ON o_orderkey = job_id WHERE o_orderstatus = 'F')
SELECT job_id, stage, CASE WHEN cache_key IN (SELECT cache_key FROM c) THEN 'artifacts/' || cache_key END AS path FROM k""")
def reusable_artifacts(spark, d):
    o = ad.read(spark, d, "orders")
    done = documents.stage_keys(o.where("o_orderstatus = 'F'"), "o_orderkey", _READS).select("cache_key").distinct().withColumn("path", F.concat(F.lit("artifacts/"), "cache_key"))
    return documents.reusable(documents.stage_keys(o, "o_orderkey", _READS), done).select(F.col("o_orderkey").alias("job_id"), "stage", "path")


@_q("SELECT o_orderkey AS job_id, CASE WHEN o_totalprice * 2 <= 300000 THEN 'valid' ELSE 'refused' END AS outcome, round(o_totalprice * 2, 2) AS price FROM orders")
def artifact_put_in(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.struct(F.col("o_totalprice").alias("price")).alias("head"))
    valid, refused = documents.put_in(o, "head.price", F.col("head.price") * 2, {"price": F.col("head.price") <= 300000})
    both = valid.withColumn("outcome", F.lit("valid")).unionByName(refused.withColumn("outcome", F.lit("refused")))
    return both.select("job_id", "outcome", F.round("head.price", 2).alias("price"))


@_q(r"""WITH c AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id * 1000 + turn AS VARCHAR) AS job_id, CASE WHEN turn % 5 = 0 THEN ' ' ELSE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') END AS said FROM conversations),
s AS (SELECT id, job_id, trim(said) AS said, list_filter(string_split(regexp_replace(trim(said), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM c),
f AS (SELECT *, regexp_replace(coalesce(s[1], ''), '[.!?]+$', '') AS first FROM s),
t AS (SELECT *, CASE WHEN length(first) > 70 THEN regexp_replace(substr(first, 1, 69), '(?s) [^ ]*$', '') || '…' ELSE first END AS title FROM f)
SELECT id, CASE WHEN said = '' THEN job_id ELSE substr(title, 1, 120) END AS title, sha256(CASE WHEN said = '' THEN 'Screen recording ' || job_id || '. No narration to describe it.' ELSE substr(array_to_string(s[1:3], ' '), 1, 5000) END) AS description_sha256 FROM t""")
def copy_or_name(spark, d):
    c = ad.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("text")).alias("text"))
    copy = tx.copy_of(F.col("text"), F.col("id").cast("string"))
    return c.select("id", copy["title"].alias("title"), F.sha2(copy["description"], 256).alias("description_sha256"))


@_q(sql("""SELECT job_id, sha256('Source duration: ' || printf('%.2f', duration) || 's' || chr(10) || chr(10) || 'Transcript, [start-end] word:' || chr(10) || coalesce(said, '  (no speech)') || chr(10) || chr(10)
  || 'Removals already proposed by arithmetic (accept or reject each):' || chr(10) || coalesce(cut, '  (none)') || chr(10) || chr(10) || 'cursor activity by 2s bucket:' || chr(10) || coalesce(act, '  (no clicks or dwell)')) AS content_sha256 FROM durations
  LEFT JOIN (SELECT job_id, string_agg(printf('[%.2f-%.2f] ', t_in, t_out) || text, ' ' ORDER BY block_ix * 3 + word_ix) AS said FROM block_words GROUP BY job_id) USING (job_id)
  LEFT JOIN (SELECT job_id, string_agg(printf('  [%.2f-%.2f] ', t_in, t_out) || kind, chr(10) ORDER BY t_in, t_out) AS cut FROM removals GROUP BY job_id) USING (job_id)
  LEFT JOIN (SELECT job_id, string_agg(printf('[%.1f-%.1f] ', b * 2.0::DOUBLE, least(b * 2.0::DOUBLE + 2, duration)) || clicks || ' clicks, ' || printf('%.0f', dwell / n * 100) || '% dwell', chr(10) ORDER BY b) AS act FROM
    (SELECT job_id, duration, floor(t / 2) AS b, count(*) FILTER (kind = 'click') AS clicks, count(*) FILTER (kind = 'dwell') AS dwell, count(*) AS n FROM points JOIN durations USING (job_id) WHERE t < duration GROUP BY ALL)
    WHERE clicks + dwell > 0 AND b * 2.0::DOUBLE < duration - 1e-6 GROUP BY job_id) USING (job_id)"""))
def edit_content(spark, d):
    w = ad.block_words(spark, d).withColumn("ix", F.col("block_ix") * 3 + F.col("word_ix"))
    c = documents.edit_content(ad.durations(spark, d), w, ad.removals(spark, d), ad.points(spark, d))
    return c.select("job_id", F.sha2("content", 256).alias("content_sha256"))


_BOX = """SELECT o.job_id, o.ix, frame, w, h, least(greatest(CAST(round_even((x - (frame % 5) * 0.1::DOUBLE) / 0.5 * 1080, 0) AS BIGINT) + dx, 54), greatest(1026 - w, 54)) AS x0,
  least(greatest(CAST(round_even((y - (frame % 3) * 0.1::DOUBLE) / 0.5 * 1920, 0) AS BIGINT) + dy, 96), greatest(1728 - h, 96)) AS y0 FROM
  (SELECT *, unnest(range(a, b, greatest((b - a) // 12, 1))) AS frame FROM
    (SELECT job_id, id AS ix, x, y, 200 + id % 800 AS w, 100 + id % 90 AS h, -(id % 50) AS dx, id % 30 AS dy, CAST(floor(t * 8) AS BIGINT) AS a, least(CAST(floor((t + 2.0) * 8) AS BIGINT), CAST(floor(duration * 8) AS BIGINT) + 1) AS b FROM points JOIN durations USING (job_id)) WHERE a < b) o"""


@_q(sql("""SELECT job_id, ix, arg_min(verdict, frame) AS verdict, min(frame) AS frame FROM
  (SELECT *, CASE WHEN x0 < 54 OR y0 < 96 OR x0 + w > 1026 OR y0 + h > 1728 THEN 'outside' WHEN x0 < 972 AND 108 < x0 + w AND y0 < 1632 AND 1344 < y0 + h
    AND EXISTS (SELECT 1 FROM blocks c WHERE c.job_id = box.job_id AND c.t_in - 1e-6 <= frame / 8.0::DOUBLE AND frame / 8.0::DOUBLE < c.t_out) THEN 'over_caption' END AS verdict FROM box) WHERE verdict IS NOT NULL GROUP BY job_id, ix""", box=_BOX))
def overlay_boxes(spark, d):
    i = F.col("id")
    o = ad.points(spark, d).select("job_id", i.alias("ix"), F.col("t").alias("t_in"), (F.col("t") + 2.0).alias("t_out"), "x", "y", (200 + i % 800).alias("width"), (100 + i % 90).alias("height"), (-(i % 50)).alias("dx"), (i % 30).alias("dy"))
    rects = ad.durations(spark, d).select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") * 8))).alias("frame"))
    rects = rects.select("job_id", "frame", (F.col("frame") % 5 * F.lit(0.1)).alias("x"), (F.col("frame") % 3 * F.lit(0.1)).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))
    return checks.overlay_boxes(o, rects, ad.blocks(spark, d), (54, 96, 1026, 1728), (108, 1344, 972, 1632), (1080, 1920), 8.0)


@_q("SELECT o_orderkey AS id, o_custkey AS job_id, o_orderstatus AS profile FROM orders WHERE o_orderstatus = 'P'")
def accepted_by_profile(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("profile"))
    return store.accepted(o, "P")


@_q("SELECT DISTINCT o_custkey AS job_id, o_orderstatus AS profile FROM orders")
def rendered_profiles(spark, d):
    return store.rendered_profiles(ad.read(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("profile")))


#: A document for each order, and what became of it: by the order's number one column is another one now.
_CHANGED = {0: "source_digest", 1: "asr", 2: "narration_script", 3: "capacity", 4: "trim", 5: "focus", 6: "profile_encode", 7: "profile_budget"}
_STALE = """WITH RECURSIVE reads(stage, col) AS (VALUES
    ('transcribe', 'source_digest'), ('transcribe', 'asr'), ('tts', 'narration_script'), ('align', 'narration_script'), ('align', 'asr'), ('plan_captions', 'capacity'), ('trim', 'trim'),
    ('plan_edit', 'focus'), ('plan_overlays', 'focus'), ('plan_focus', 'focus'), ('compile', 'source_digest'), ('compile', 'focus'), ('compile', 'narration_script'), ('compile', 'profile_budget'),
    ('render', 'source_digest'), ('render', 'profile_encode'), ('verify_transcript', 'profile_budget'), ('verify', 'source_digest'), ('verify', 'focus'), ('verify', 'narration_script'),
    ('verify', 'profile_encode'), ('verify', 'profile_budget'), ('metadata', 'narration_script')),
  follows(stage, first) AS (VALUES ('plan_captions', 'transcribe'), ('plan_captions', 'align'), ('emphasis', 'plan_captions'), ('trim', 'transcribe'), ('trim', 'align'), ('align', 'tts'), ('plan_edit', 'trim'),
    ('plan_edit', 'transcribe'), ('plan_edit', 'align'), ('plan_overlays', 'transcribe'), ('plan_overlays', 'align'), ('compile', 'plan_focus'), ('render', 'compile'), ('verify_transcript', 'render'),
    ('verify_transcript', 'transcribe'), ('verify_transcript', 'align'), ('verify', 'plan_focus'), ('verify', 'compile'), ('verify', 'render'), ('verify', 'verify_transcript'), ('verify', 'trim')),
  has(recipe, stage) AS (SELECT r, stage FROM (SELECT stage FROM reads UNION SELECT 'emphasis') s, (VALUES ('recorded'), ('synthesized')) v(r) WHERE stage NOT IN ('tts', 'align') AND r = 'recorded' OR stage <> 'transcribe' AND r = 'synthesized'),
  docs AS (SELECT o_orderkey AS job_id, CASE o_custkey % 2 WHEN 0 THEN 'recorded' ELSE 'synthesized' END AS recipe, ['source_digest', 'asr', 'narration_script', 'capacity', 'trim', 'focus', 'profile_encode', 'profile_budget'][CAST(o_orderkey % 9 AS INT) + 1] AS col FROM orders),
  dirty(job_id, recipe, stage, own) AS (
    SELECT job_id, d.recipe, r.stage, true FROM docs d JOIN reads r ON r.col = d.col JOIN has h ON h.recipe = d.recipe AND h.stage = r.stage
    UNION SELECT job_id, x.recipe, f.stage, false FROM dirty x JOIN follows f ON f.first = x.stage JOIN has h ON h.recipe = x.recipe AND h.stage = f.stage)
SELECT job_id, recipe, stage, bool_or(own) AS own FROM dirty GROUP BY job_id, recipe, stage"""


@_q(_STALE)
def stale_stages(spark, d):
    o = ad.read(spark, d, "orders")
    k = F.col("o_orderkey") % 9
    held = {"source_duration": F.col("o_totalprice"), "source_has_audio": F.lit(True), "model_id": F.lit("m")} | {c: F.col("o_orderstatus") for c in _CHANGED.values()}
    doc = lambda values: o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("created_at"), *(v.alias(n) for n, v in values.items()))
    before, now = doc(held), doc(held | {c: F.when(k == n, "new").otherwise(held[c]) for n, c in _CHANGED.items()}).withColumn("created_at", F.lit(None))
    found = [stages.stale(before.where(F.col("c") % 2 == r), now.where(F.col("c") % 2 == r), name).withColumn("recipe", F.lit(name)) for r, name in enumerate(("recorded", "synthesized"))]
    return found[0].unionByName(found[1])


_TEMPLATES = ["callout_arrow", "highlight_box", "label_chip", "progress_pill"]


@_q(sql("""SELECT job_id, sha256('Source duration: ' || printf('%.2f', duration) || 's' || chr(10) || chr(10) || 'Templates available: callout_arrow, highlight_box, label_chip, progress_pill' || chr(10) || chr(10) || 'Transcript, [start-end] word:' || chr(10)
  || coalesce(said, '  (no speech)') || chr(10) || chr(10) || 'cursor attention by 2s bucket, normalized source coordinates:' || chr(10) || coalesce(act, '  (no clicks or dwell)')) AS content_sha256 FROM durations
  LEFT JOIN (SELECT job_id, string_agg(printf('[%.2f-%.2f] ', t_in, t_out) || text, ' ' ORDER BY block_ix * 3 + word_ix) AS said FROM block_words GROUP BY job_id) USING (job_id)
  LEFT JOIN (SELECT job_id, string_agg(printf('[%.1f-%.1f] at (%.2f, %.2f), ', b * 2.0::DOUBLE, least(b * 2.0::DOUBLE + 2, duration), x, y) || clicks || ' clicks, ' || dwell || ' dwell', chr(10) ORDER BY b) AS act FROM
    (SELECT job_id, duration, floor(t / 2) AS b, avg(floor(x * 64) / 64) AS x, avg(floor(y * 64) / 64) AS y, count(*) FILTER (kind = 'click') AS clicks, count(*) FILTER (kind = 'dwell') AS dwell FROM points JOIN durations USING (job_id) WHERE t < duration AND kind IN ('click', 'dwell') GROUP BY ALL)
    WHERE b * 2.0::DOUBLE < duration - 1e-6 GROUP BY job_id) USING (job_id)"""))
def overlay_content(spark, d):
    w = ad.block_words(spark, d).withColumn("ix", F.col("block_ix") * 3 + F.col("word_ix"))
    # places in 64ths, so that sums do not depend on their order
    p = ad.points(spark, d).withColumns({c: F.floor(F.col(c) * 64) / 64 for c in ("x", "y")})
    c = documents.overlay_content(ad.durations(spark, d), w, p, _TEMPLATES)
    return c.select("job_id", F.sha2("content", 256).alias("content_sha256"))


_SPOKEN = r"SELECT conv_id * 1000 + turn AS job_id, turn, coalesce(text, '') AS said, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS brief, length(coalesce(text, '')) / 15.0::DOUBLE AS duration FROM conversations"


@_q(f"""SELECT job_id, sha256('Recording length: ' || printf('%.2f', duration) || 's' || chr(10) || 'Word budget: about ' || CAST(greatest(floor(duration * 2.5), 1) AS BIGINT) || ' words (at 2.5 words/second; going over is a failed job, not a long one)'
  || chr(10) || chr(10) || 'Brief, in the author''s own words:' || chr(10) || brief || chr(10) || chr(10) || 'cursor: no track') AS content_sha256 FROM ({_SPOKEN}) WHERE brief <> ''""")
def script_content(spark, d):
    c = ad.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), F.col("text").alias("brief"), (F.length(F.coalesce("text", F.lit(""))) / F.lit(15.0)).alias("duration"))
    drafts, _ = documents.script_content(c, spark.createDataFrame([], "job_id long, active string"))
    return drafts.select("job_id", F.sha2("content", 256).alias("content_sha256"))


@_q(f"""SELECT job_id, 'short' AS profile, sha256('Render: short (1080x1920), ' || printf('%.1f', duration) || 's as edited.' || chr(10) || chr(10) || 'What a viewer of this render hears:' || chr(10) || CASE WHEN heard = '' THEN '(nothing is said in this render)' ELSE heard END
  || CASE WHEN brief NOT IN ('', heard) THEN chr(10) || chr(10) || 'The full script, for context (the render above is the edit of it):' || chr(10) || brief ELSE '' END) AS content_sha256 FROM (SELECT *, CASE turn % 3 WHEN 0 THEN brief WHEN 1 THEN '' ELSE 'A few words.' END AS heard FROM ({_SPOKEN}))""")
def copy_content(spark, d):
    c = ad.read(spark, d, "conversations")
    heard = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, " ").otherwise("A few words.")
    r = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), F.lit("short").alias("profile"), F.lit(1080).alias("width"), F.lit(1920).alias("height"), (F.length(F.coalesce("text", F.lit(""))) / F.lit(15.0)).alias("duration"), heard.alias("spoken"), F.col("text").alias("script"))
    return documents.copy_content(r).select("job_id", "profile", F.sha2("content", 256).alias("content_sha256"))


@_q("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS current, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS proposed FROM orders""")
def document_views(spark, d):
    o = ad.read(spark, d, "orders").withColumnRenamed("o_orderkey", "job_id")
    return store.document_views(o.select("job_id", F.col("o_orderstatus").alias("document")), o.where("job_id % 3 = 0").select("job_id", F.col("o_orderpriority").alias("document")))


@_q("SELECT CAST(l_suppkey AS BIGINT) AS profile, fraction, CAST(count(*) AS BIGINT) AS n, true AS within FROM lineitem, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) f(fraction) GROUP BY ALL")
def sketched_quantiles(spark, d):
    """Sketches by profile and run, merged over runs, held against exact ranks: each is within 3 % of its rank."""
    v = ad.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("profile"), (F.col("l_orderkey") % 5).alias("run"), F.col("l_extendedprice").alias("value"))
    q = sketches.quantiles(sketches.merged(sketches.sketched(v, ["profile", "run"]), ["profile"]), [0.1, 0.5, 0.9])
    j = q.join(v.select("profile", F.col("value").alias("v")), "profile").groupBy("profile", "fraction", "n").agg(F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    share = F.col("fraction") * F.col("n")
    within = (F.col("below") - 0.03 * F.col("n") - 1 <= share) & (share <= F.col("upto") + 0.03 * F.col("n") + 1)
    return j.select(F.col("profile").cast("long").alias("profile"), "fraction", F.col("n").cast("long").alias("n"), within.alias("within"))


@_q("""SELECT profile, key, old_value, new_value, caused_by, changed_at FROM (SELECT *, lag(new_value) OVER w AS old_value FROM (SELECT event_type AS profile, CAST(user_id % 10 AS VARCHAR) AS key, event_id AS caused_by, ts AS changed_at,
    CASE WHEN count(*) OVER v >= 3 THEN median(value) OVER v END AS new_value FROM events WHERE value IS NOT NULL WINDOW v AS (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY profile, key ORDER BY changed_at, caused_by)) WHERE new_value IS NOT NULL AND coalesce(abs(new_value - old_value) > 1e-6, true)""")
def preference_changes(spark, d):
    e = ad.read(spark, d, "events").select(F.col("event_type").alias("profile"), (F.col("user_id") % 10).cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "value")
    return review.preference_changes(e, 7, 3)


def _overlay_findings(spark, d):
    return checks.overlay_findings(overlay_boxes(spark, d))


_PARTS = ("loudness_findings", "duration_findings", "edit_totality_findings", "budget_findings", "dialogue_findings", "caption_checks")
_ALL = " UNION ALL ".join(
    [f"SELECT * FROM ({review_queries.S[n]})" for n in _PARTS] + [f"SELECT * FROM ({track_queries.S['crop_continuity_findings']})", f"SELECT * FROM ({text_queries.S['transcript_findings']})"]
    + [f"""SELECT job_id, '{check}', 'FAIL', '{message}', count(*), 0.0 FROM ({S['overlay_boxes']}) WHERE verdict = '{verdict}' GROUP BY job_id"""
       for check, verdict, message in (("overlay_safe_area", "outside", "overlays leave the safe area"), ("overlay_occlusion", "over_caption", "overlays sit on a caption"))]
    + [f"SELECT job_id, 'cut_mid_word', 'FAIL', 'cuts inside words', n, 0.0 FROM ({interval_queries.S['cut_mid_word']})"]
)


@_q(f"""SELECT job_id, "check", severity, message, round(value, 6) AS value, "limit" FROM ({_ALL})""")
def every_finding(spark, d):
    """All checks of the library in one table."""
    parts = [review_queries.Q[n](spark, d) for n in _PARTS] + [track_queries.Q["crop_continuity_findings"](spark, d), text_queries.Q["transcript_findings"](spark, d)]
    parts += [_overlay_findings(spark, d), checks.mid_word(interval_queries.cut_mid_word(spark, d))]
    return checks.verify(*(p.withColumn("value", F.col("value").cast("double")) for p in parts)).withColumn("value", F.round("value", 6))
