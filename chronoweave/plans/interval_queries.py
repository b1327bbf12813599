"""Interval algebra, budget and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
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


@_q(sql("SELECT job_id, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out, kind FROM removals"))
def interval_merge(spark, d):
    return _rounded(ad.removals(spark, d), "t_in", "t_out")


_CUTS = "SELECT job_id, t - 0.4 AS x, t + 0.4 AS y FROM points WHERE event_type = 'view'"


@_q(sql("""SELECT DISTINCT job_id, round(a, 6) AS span_in, round(since, 6) AS t_in, round(x, 6) AS t_out FROM before WHERE x - since > 1e-6""",
    cuts=_CUTS,
    clipped="""SELECT s.job_id, s.t_in AS a, s.t_out AS b, greatest(x, s.t_in) AS x, least(y, s.t_out) AS y FROM silences s JOIN cuts c ON s.job_id = c.job_id AND s.t_in < y - 1e-6 AND x < s.t_out - 1e-6
      UNION ALL SELECT job_id, t_in, t_out, t_out, t_out FROM silences""",
    before="SELECT *, coalesce(max(y) OVER (PARTITION BY job_id, a, b ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS since FROM clipped"))
def interval_subtract(spark, d):
    cuts = ad.points(spark, d).where("event_type = 'view'").select("job_id", (F.col("t") - 0.4).alias("t_in"), (F.col("t") + 0.4).alias("t_out"))
    return _rounded(iv.subtract(ad.silences(spark, d), cuts), "span_in", "t_in", "t_out")


@_q(sql("SELECT job_id, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out FROM gaps"))
def interval_complement(spark, d):
    return _rounded(iv.complement(ad.removals(spark, d), ad.durations(spark, d)), "t_in", "t_out")


_COALESCED = """SELECT job_id, round(min(t_in), 6) AS t_in, round(max(t_out), 6) AS t_out, any_value(tier) AS tier, any_value(reason) AS reason FROM
  (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY t_in) AS island FROM
    (SELECT *, coalesce(abs(t_in - lag(t_out) OVER w) <= 1e-6 AND tier = lag(tier) OVER w AND reason = lag(reason) OVER w, false) AS same FROM {0} WINDOW w AS (PARTITION BY job_id ORDER BY t_in)))
  GROUP BY job_id, island"""


@_q(sql(_COALESCED.format("tier_segments")))
def interval_coalesce(spark, d):
    return _rounded(iv.coalesce(ad.tier_segments(spark, d)), "t_in", "t_out")


@_q(sql(_COALESCED.format("named"),
    cuts="""SELECT g.job_id, g.t_in AS a, g.t_out AS b, e FROM gaps g JOIN (SELECT job_id, unnest([t_in, t_out]) AS e FROM proposals) p ON g.job_id = p.job_id AND e > g.t_in AND e < g.t_out
      UNION SELECT job_id, t_in, t_out, t_in FROM gaps UNION SELECT job_id, t_in, t_out, t_out FROM gaps""",
    parts="SELECT * FROM (SELECT *, lead(e) OVER (PARTITION BY job_id, a, b ORDER BY e) AS n FROM cuts) WHERE n - e > 1e-6",
    named="""SELECT job_id, e AS t_in, n AS t_out, coalesce(arg_max(tier, pos), 'essential') AS tier, coalesce(arg_max(reason, pos), 'uncovered') AS reason FROM
      (SELECT q.job_id, e, n, tier, reason, pos FROM parts q LEFT JOIN proposals p ON q.job_id = p.job_id AND (e + n) / 2 >= p.t_in - 1e-6 AND (e + n) / 2 < p.t_out + 1e-6) GROUP BY job_id, e, n"""))  # fmt: skip
def boundary_split_reconcile(spark, d):
    return _rounded(iv.reconcile(ad.proposals(spark, d), ad.removals(spark, d), ad.durations(spark, d)), "t_in", "t_out")


_THRESHOLDS = dict(
    totals="SELECT job_id, coalesce(sum(dur), 0) AS d0, coalesce(sum(dur) FILTER (tier <> 'optional'), 0) AS d1, coalesce(sum(dur) FILTER (tier = 'essential'), 0) AS d2 FROM line_segments GROUP BY job_id",
    thresholds="""SELECT job_id, budget, CASE WHEN d0 <= budget + 1e-6 THEN 'optional' WHEN d1 <= budget + 1e-6 THEN 'supporting' ELSE 'essential' END AS tier,
      CASE WHEN d0 <= budget + 1e-6 THEN d0 WHEN d1 <= budget + 1e-6 THEN d1 ELSE d2 END AS total FROM totals, budgets""",
)
_KEPT = _THRESHOLDS | dict(
    chosen="""SELECT s.*, budget FROM line_segments s JOIN thresholds t USING (job_id) WHERE CASE s.tier WHEN 'optional' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END >= CASE t.tier WHEN 'optional' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END""",
    runs="""SELECT job_id, budget, run, min(t_in) AS source_in, max(t_out) AS source_out FROM (SELECT *, sum(CASE WHEN reach IS NULL OR t_in > reach + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, budget ORDER BY t_in) AS run FROM
      (SELECT *, max(t_out) OVER (PARTITION BY job_id, budget ORDER BY t_in ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chosen)) GROUP BY job_id, budget, run""",
    laid="""SELECT job_id, budget, row_number() OVER w - 1 AS span_ix, source_in, source_out, coalesce(sum(source_out - source_in) OVER (PARTITION BY job_id, budget ORDER BY source_in ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS output_in
      FROM runs WINDOW w AS (PARTITION BY job_id, budget ORDER BY source_in)""",
)


@_q(sql("SELECT job_id, budget, tier, total, greatest(total - budget, 0.0) AS overrun FROM thresholds", **_THRESHOLDS))
def budget_threshold(spark, d):
    return iv.budget_threshold(ad.line_segments(spark, d), ad.budgets(spark))


def _kept(spark, d):
    s = ad.line_segments(spark, d)
    return iv.kept_spans(s, iv.budget_threshold(s, ad.budgets(spark)))


@_q(sql("SELECT * FROM laid", **_KEPT))
def kept_spans(spark, d):
    return _kept(spark, d)


@_q(sql("SELECT job_id, budget, output_in AS cut FROM laid WHERE span_ix > 0", **_KEPT))
def span_cuts(spark, d):
    return iv.span_cuts(_kept(spark, d))


_PIECES = dict(
    pairs="SELECT b.job_id, block_ix, b.t_in, b.t_out, span_ix, source_in, source_out, output_in FROM blocks b JOIN spans s ON b.job_id = s.job_id AND b.t_in < source_out - 1e-6 AND source_in < b.t_out - 1e-6",
    pieces="""SELECT job_id, block_ix, span_ix, output_in + (greatest(t_in, source_in, f) - source_in) AS t_in, output_in + (least(t_out, source_out, l) - source_in) AS t_out, n_words, text FROM
      (SELECT p.job_id, p.block_ix, p.t_in, p.t_out, span_ix, source_in, source_out, output_in, arg_min(w.t_in, word_ix) AS f, arg_max(w.t_out, word_ix) AS l, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_ix) AS text
       FROM pairs p JOIN block_words w ON p.job_id = w.job_id AND p.block_ix = w.block_ix AND (w.t_in + w.t_out) / 2 >= source_in - 1e-6 AND (w.t_in + w.t_out) / 2 < source_out - 1e-6
       GROUP BY p.job_id, p.block_ix, p.t_in, p.t_out, span_ix, source_in, source_out, output_in)""",
    ends="SELECT job_id, sum(source_out - source_in) AS stop FROM spans GROUP BY job_id",
)


@_q(sql("""SELECT job_id, block_ix, span_ix, round(t_in, 6) AS t_in, round(CASE WHEN t_out - t_in < 0.8 THEN least(greatest(t_out, t_in + 0.8), coalesce(nxt, stop)) ELSE t_out END, 6) AS t_out, n_words, text
  FROM (SELECT *, lead(t_in) OVER (PARTITION BY job_id ORDER BY t_in, block_ix) AS nxt FROM pieces) JOIN ends USING (job_id)""", **_PIECES))  # fmt: skip
def caption_projection(spark, d):
    return _rounded(iv.project_captions(ad.blocks(spark, d), ad.block_words(spark, d), ad.spans(spark, d), 0.8), "t_in", "t_out")


_SHOWN = dict(
    ends=_PIECES["ends"],
    shown="""SELECT o.job_id, ix, template, output_in + (greatest(t_in, source_in) - source_in) AS t_in, output_in + (least(t_out, source_out) - source_in) AS t_out FROM overlays o JOIN spans s ON o.job_id = s.job_id AND t_in < source_out - 1e-6 AND source_in < t_out - 1e-6
      WHERE least(t_out, source_out) - greatest(t_in, source_in) >= 0.15 UNION ALL SELECT job_id, ix, template, 0.0, stop FROM overlays JOIN ends USING (job_id) WHERE t_in IS NULL""",
)


@_q(sql("SELECT job_id, ix, template, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out FROM shown", **_SHOWN))
def overlay_projection(spark, d):
    return _rounded(iv.project_overlays(ad.overlays(spark, d), ad.spans(spark, d)), "t_in", "t_out")


@_q(sql("SELECT job_id, ix, template FROM overlays o WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.job_id = o.job_id AND s.ix = o.ix)", **_SHOWN))
def overlay_dropped(spark, d):
    return iv.dropped_overlays(ad.overlays(spark, d), ad.spans(spark, d)).select("job_id", "ix", "template")


@_q(sql("""SELECT r.job_id, region_ix, span_ix, round(output_in + (greatest(t_in, source_in) - source_in), 6) AS t_in, round(output_in + (least(t_out, source_out) - source_in), 6) AS t_out FROM
  (SELECT job_id, id AS region_ix, t AS t_in, t + 1.5 AS t_out FROM points WHERE kind = 'click') r JOIN spans s ON r.job_id = s.job_id AND t_in < source_out - 1e-6 AND source_in < t_out - 1e-6
  WHERE least(t_out, source_out) - greatest(t_in, source_in) > 0.35"""))  # fmt: skip
def zoom_projection(spark, d):
    regions = ad.points(spark, d).where("kind = 'click'").select("job_id", F.col("id").alias("region_ix"), F.col("t").alias("t_in"), (F.col("t") + 1.5).alias("t_out"))
    return _rounded(iv.project_regions(regions, ad.spans(spark, d)), "t_in", "t_out")


@_q(sql("""SELECT p.job_id, round(p.t, 6) AS t, round(arg_min(output_in + (p.t - source_in), source_in), 6) AS output_t FROM points p LEFT JOIN spans s ON p.job_id = s.job_id AND p.t >= source_in - 1e-6 AND p.t <= source_out + 1e-6 GROUP BY p.job_id, p.t"""))
def time_map_source_to_output(spark, d):
    return _rounded(iv.output_at(ad.points(spark, d).select("job_id", "t"), ad.spans(spark, d)), "t", "output_t")


@_q(sql("""SELECT job_id, round(t, 6) AS t, round(coalesce(m, stop, 0.0), 6) AS source_t FROM (SELECT p.job_id, p.t, arg_min(source_in + (p.t - output_in), source_in) AS m FROM (SELECT DISTINCT job_id, t / 2 AS t FROM points) p
  LEFT JOIN spans s ON p.job_id = s.job_id AND p.t >= output_in - 1e-6 AND p.t < output_in + (source_out - source_in) - 1e-6 GROUP BY p.job_id, p.t) LEFT JOIN (SELECT job_id, max(source_out) AS stop FROM spans GROUP BY job_id) USING (job_id)"""))  # fmt: skip
def time_map_output_to_source(spark, d):
    halves = ad.points(spark, d).select("job_id", (F.col("t") / 2).alias("t")).distinct()
    return _rounded(iv.source_at(halves, ad.spans(spark, d)), "t", "source_t")


_IXWORDS = dict(ixwords="SELECT job_id, block_ix * 3 + word_ix AS ix, t_in, t_out, text FROM block_words")


def _ixwords(spark, d):
    return ad.block_words(spark, d).select("job_id", (F.col("block_ix") * 3 + F.col("word_ix")).alias("ix"), "t_in", "t_out", "text")


@_q(sql("""SELECT job_id, ix, round(output_in + (greatest(t_in, source_in) - source_in), 6) AS t_in, round(output_in + (least(t_out, source_out) - source_in), 6) AS t_out, text FROM
  (SELECT w.*, source_in, source_out, output_in, row_number() OVER (PARTITION BY w.job_id, ix ORDER BY source_in) AS r FROM ixwords w JOIN spans s ON w.job_id = s.job_id AND (t_in + t_out) / 2 >= source_in - 1e-6 AND (t_in + t_out) / 2 <= source_out + 1e-6) WHERE r = 1""", **_IXWORDS))  # fmt: skip
def expected_transcript(spark, d):
    return _rounded(iv.expected_words(_ixwords(spark, d), ad.spans(spark, d)), "t_in", "t_out")


@_q(sql("""SELECT job_id, count(*) AS n_words, sha256(string_agg(text, ' ' ORDER BY t_in, ix)) AS text_sha256 FROM ixwords w WHERE
  NOT EXISTS (SELECT 1 FROM removals r WHERE r.job_id = w.job_id AND (w.t_in + w.t_out) / 2 >= r.t_in - 1e-6 AND (w.t_in + w.t_out) / 2 < r.t_out - 1e-6)
  AND EXISTS (SELECT 1 FROM tier_segments s WHERE s.job_id = w.job_id AND tier <> 'optional' AND (w.t_in + w.t_out) / 2 >= s.t_in - 1e-6 AND (w.t_in + w.t_out) / 2 < s.t_out - 1e-6) GROUP BY job_id""", **_IXWORDS))  # fmt: skip
def transcript_after_edit(spark, d):
    left = iv.words_after_edit(_ixwords(spark, d), ad.removals(spark, d), ad.tier_segments(spark, d).where("tier <> 'optional'"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_in", "ix", "text"))), lambda x: x["text"]), " ")
    return left.groupBy("job_id").agg(F.count("*").alias("n_words"), F.sha2(text, 256).alias("text_sha256"))


@_q(sql("""SELECT job_id, count(*) AS n, round(first(edge ORDER BY r_in, w_in, side), 6) AS first_edge FROM
  (SELECT r.job_id, r.t_in AS r_in, w.t_in AS w_in, side, CASE side WHEN 0 THEN r.t_in ELSE r.t_out END AS edge, w.t_out AS w_out FROM removals r, range(2) k(side), ixwords w WHERE w.job_id = r.job_id)
  WHERE w_in + 1e-6 < edge AND edge < w_out - 1e-6 GROUP BY job_id""", **_IXWORDS))  # fmt: skip
def cut_mid_word(spark, d):
    return _rounded(iv.mid_word_cuts(ad.removals(spark, d), _ixwords(spark, d)), "first_edge")


_HIT = "EXISTS (SELECT 1 FROM silences o WHERE o.job_id = s.job_id AND s.t_in < o.t_out - 1e-6 AND o.t_in < s.t_out - 1e-6)"


@_q(sql(f"SELECT job_id, pos, reason FROM proposals s WHERE {_HIT}"))
def overlap_semi(spark, d):
    return iv.overlapping(ad.proposals(spark, d), ad.silences(spark, d)).select("job_id", "pos", "reason")


@_q(sql(f"SELECT job_id, pos, reason FROM proposals s WHERE NOT {_HIT}"))
def overlap_anti(spark, d):
    return iv.overlapping(ad.proposals(spark, d), ad.silences(spark, d), "left_anti").select("job_id", "pos", "reason")


@_q(sql("""SELECT p.job_id, n_proposed, coalesce(n_rejected, 0) AS n_rejected, round(coalesce(n_rejected, 0) / n_proposed, 6) AS rejected_rate, round(coalesce(n_trim, 0) / n_removals, 6) AS trim_share FROM
  (SELECT job_id, count(*) AS n_proposed FROM proposals GROUP BY job_id) p
  LEFT JOIN (SELECT job_id, count(*) AS n_rejected FROM proposals s WHERE NOT EXISTS (SELECT 1 FROM removals o WHERE o.job_id = s.job_id AND s.t_in < o.t_out - 1e-6 AND o.t_in < s.t_out - 1e-6) GROUP BY job_id) r USING (job_id)
  JOIN (SELECT job_id, count(*) AS n_removals FROM removals GROUP BY job_id) a USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS n_trim FROM removals s WHERE EXISTS (SELECT 1 FROM proposals o WHERE o.job_id = s.job_id AND s.t_in < o.t_out - 1e-6 AND o.t_in < s.t_out - 1e-6) GROUP BY job_id) t USING (job_id)"""))  # fmt: skip
def override_rate(spark, d):
    return _rounded(iv.override_rate(ad.removals(spark, d), ad.proposals(spark, d)), "rejected_rate", "trim_share")


@_q(sql("""SELECT job_id, abs(a) > 1e-6 AS starts_late, n_overlaps, n_gaps, abs(b - duration) > 1e-6 AS ends_off FROM
  (SELECT job_id, min(t_in) AS a, max(t_out) AS b, count(*) FILTER (t_in < prev - 1e-6) AS n_overlaps, count(*) FILTER (t_in > prev + 1e-6) AS n_gaps FROM
    (SELECT *, lag(t_out) OVER (PARTITION BY job_id ORDER BY t_in, t_out) AS prev FROM (SELECT job_id, t_in, t_out FROM removals UNION ALL SELECT job_id, t_in, t_out FROM tier_segments)) GROUP BY job_id) JOIN durations USING (job_id)
  WHERE abs(a) > 1e-6 OR abs(b - duration) > 1e-6 OR n_overlaps > 0 OR n_gaps > 0"""))  # fmt: skip
def partition_violations(spark, d):
    return iv.partition_violations(ad.removals(spark, d), ad.tier_segments(spark, d), ad.durations(spark, d))


@_q(sql("SELECT job_id, kind, n, round(seconds, 6) AS seconds, row_number() OVER (PARTITION BY job_id ORDER BY f, kind) AS position FROM (SELECT job_id, kind, count(*) AS n, sum(t_out - t_in) AS seconds, min(t_in) AS f FROM removals GROUP BY job_id, kind)"))
def removals_by_kind(spark, d):
    return _rounded(iv.removals_by_kind(ad.removals(spark, d)), "seconds")
