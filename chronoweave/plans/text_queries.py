"""Queries over transcripts and texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.time import clock
from ..operators import transcripts as ts
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


_TURNS = dict(said="SELECT conv_id * 1000 + turn AS job_id, ix, t_in, t_out, text FROM turn_words", lengths="SELECT job_id, max(t_out) AS duration FROM said GROUP BY job_id")


def _said(spark, d):
    return ad.turn_words(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), "ix", "t_in", "t_out", "text")


def _lengths(spark, d):
    return _said(spark, d).groupBy("job_id").agg(F.max("t_out").alias("duration"))


def _heard(spark, d):
    w = _said(spark, d).where("ix % 17 <> 0")
    return w.withColumn("text", F.when(F.col("ix") % 23 == 0, "other").otherwise(F.col("text")))


_WORDY = ("the", "of", "and", "to")
_BARE = r"lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}'']', '', 'g')) IN ('the', 'of', 'and', 'to')"


@_q(sql(f"SELECT job_id, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out, 'filler' AS kind FROM said WHERE {_BARE}", **_TURNS))
def filler_spans(spark, d):
    return _rounded(ts.filler_spans(_said(spark, d), list(_WORDY)).drop("ord"), "t_in", "t_out")


@_q(sql("""SELECT job_id, round(greatest(t_in, 0.0), 6) AS t_in, round(least(t_out, duration), 6) AS t_out, kind FROM (SELECT job_id, min(t_in) AS t_in, max(t_out) AS t_out, first(kind ORDER BY t_in, ord, t_out) AS kind FROM
    (SELECT *, sum(CASE WHEN reach2 IS NULL OR t_in > reach2 + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t_in, ord, t_out ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM
      (SELECT *, max(t_out) OVER (PARTITION BY job_id ORDER BY t_in, ord, t_out ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach2 FROM both_)) GROUP BY job_id, isl) JOIN durations USING (job_id) WHERE least(t_out, duration) - greatest(t_in, 0.0) > 1e-6""",
    cuts="SELECT job_id, t - 0.4 AS x, t + 0.4 AS y FROM points WHERE event_type = 'view'",
    clipped="""SELECT s.job_id, s.t_in AS a, s.t_out AS b, greatest(x, s.t_in) AS x, least(y, s.t_out) AS y FROM silences s JOIN cuts c ON s.job_id = c.job_id AND s.t_in < y - 1e-6 AND x < s.t_out - 1e-6
      UNION ALL SELECT job_id, t_in, t_out, t_out, t_out FROM silences""",
    before="SELECT *, coalesce(max(y) OVER (PARTITION BY job_id, a, b ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS since FROM clipped",
    both_="""SELECT DISTINCT job_id, since + 0.12 AS t_in, x - 0.12 AS t_out, 'silence' AS kind, 0 AS ord FROM before WHERE x - since > 1e-6 AND x - since >= 0.6 - 1e-6 AND x - 0.12 > since + 0.12 UNION ALL SELECT job_id, t_in, t_out, kind, ord FROM fillers"""))
def trim_proposals(spark, d):
    words = ad.points(spark, d).where("event_type = 'view'").select("job_id", (F.col("t") - 0.4).alias("t_in"), (F.col("t") + 0.4).alias("t_out"))
    return _rounded(ts.trim_proposals(ad.silences(spark, d), words, ad.fillers(spark, d), ad.durations(spark, d)), "t_in", "t_out")


_BLOCKS = r"""WITH RECURSIVE {0},
rows_ AS (SELECT *, length(text) AS n, coalesce(regexp_matches(text, '[.!?…][''")\]]*$') AND lead(t_in) OVER w IS NOT NULL OR lead(t_in) OVER w - t_out >= 0.45, false) AS stops, row_number() OVER w AS r FROM said WINDOW w AS (PARTITION BY job_id ORDER BY ix)),
state AS (SELECT job_id, r, ix, 0 AS own, 0 AS block, n AS size, 1 AS k FROM rows_ WHERE r = 1
  UNION ALL SELECT job_id, r, ix, own, CASE WHEN stop THEN own + 1 ELSE own END, CASE WHEN stop THEN 0 ELSE size END, CASE WHEN stop THEN 0 ELSE k END FROM
    (SELECT w.job_id, w.r, w.ix, CASE WHEN s.k > 0 AND s.size + 1 + w.n > 42 THEN s.block + 1 ELSE s.block END AS own, CASE WHEN s.k = 0 OR s.size + 1 + w.n > 42 THEN w.n ELSE s.size + 1 + w.n END AS size,
      CASE WHEN s.k > 0 AND s.size + 1 + w.n > 42 THEN 1 ELSE s.k + 1 END AS k, NOT (s.k > 0 AND s.size + 1 + w.n > 42) AND s.k + 1 >= 2 AND w.stops AS stop FROM state s JOIN rows_ w ON w.job_id = s.job_id AND w.r = s.r + 1))
SELECT job_id, ix, own AS block FROM state"""


@_q(_BLOCKS.format(",\n".join(f"{k} AS ({v})" for k, v in {"turn_words": ad.CTES["turn_words"], "said": _TURNS["said"]}.items())))
def pack_blocks(spark, d):
    return ts.pack_blocks(_said(spark, d), 42).select("job_id", "ix", "block")


_LINES = """WITH RECURSIVE {0},
rows_ AS (SELECT *, length(text) AS n, ix AS r FROM said),
state AS (SELECT job_id, r, 0 AS line, n AS size FROM rows_ WHERE r = 0
  UNION ALL SELECT w.job_id, w.r, CASE WHEN s.size + 1 + w.n <= 42 THEN s.line ELSE s.line + 1 END, CASE WHEN s.size + 1 + w.n <= 42 THEN s.size + 1 + w.n ELSE w.n END FROM state s JOIN rows_ w ON w.job_id = s.job_id AND w.r = s.r + 1)
SELECT state.job_id AS job_id, line, string_agg(text, ' ' ORDER BY ix) AS text FROM state JOIN said ON said.job_id = state.job_id AND said.ix = state.r GROUP BY ALL"""


@_q(_LINES.format(",\n".join(f"{k} AS ({v})" for k, v in {"turn_words": ad.CTES["turn_words"], "said": _TURNS["said"]}.items())))
def wrap_lines(spark, d):
    c = ad.read(spark, d, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    return c.select("job_id", F.posexplode(tx.wrapped(F.col("w"), 42)).alias("line", "text"))


@_q(sql("""SELECT job_id, block_ix, word_ix, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out FROM (SELECT job_id, block_ix, word_ix, greatest(lo, least(a, hi)) AS t_in, greatest(lo, least(b, hi)) AS t_out FROM
    (SELECT w.job_id, w.block_ix, word_ix, w.t_in AS a, coalesce(lead(w.t_in) OVER (PARTITION BY w.job_id, w.block_ix ORDER BY word_ix), b.t_out) AS b, b.t_in AS lo, b.t_out AS hi FROM block_words w JOIN blocks b ON b.job_id = w.job_id AND b.block_ix = w.block_ix
     UNION ALL SELECT w.job_id, w.block_ix, -1, b.t_in, w.t_in, b.t_in, b.t_out FROM block_words w JOIN blocks b ON b.job_id = w.job_id AND b.block_ix = w.block_ix WHERE word_ix = 0 AND w.t_in > b.t_in))
  WHERE round_even(greatest(t_in, 0) * 100, 0) <> round_even(greatest(t_out, 0) * 100, 0)"""))  # fmt: skip
def active_word_windows(spark, d):
    return _rounded(ts.active_windows(ad.blocks(spark, d), ad.block_words(spark, d)), "t_in", "t_out")


#: Alignment cell by cell, by growing i + j, within a band that every way of at most so many edits stays in: each cell hands its cost and way to the three that follow it, and takes the best of what it is
#: handed (pairs before omissions before insertions). left_(job_id, i, key), right_(job_id, j, key) and sizes(job_id, n, m, band) come before it; best(job_id, cost, way) after.
_WALK = """handed AS (
  SELECT job_id, 0 AS k, 0 AS i, 0 AS j, 0 AS cost, 0 AS turn, '' AS way FROM sizes
  UNION ALL
  SELECT job_id, k, i, j, cost, turn, way FROM (
    WITH here AS (SELECT job_id, k, i, j, min({'cost': cost, 'turn': turn, 'way': way}) AS best FROM handed WHERE i + j = k GROUP BY ALL),
    ahead AS (
      SELECT h.job_id, h.k + 1 AS k, h.i + 1 AS i, h.j + 1 AS j, best.cost + CASE WHEN l.key = r.key THEN 0 ELSE 1 END AS cost, 0 AS turn, best.way || CASE WHEN l.key = r.key THEN '=' ELSE 'S' END AS way
      FROM here h JOIN left_ l ON l.job_id = h.job_id AND l.i = h.i + 1 JOIN right_ r ON r.job_id = h.job_id AND r.j = h.j + 1
      UNION ALL SELECT job_id, k + 1, i + 1, j, best.cost + 1, 1, best.way || 'O' FROM here
      UNION ALL SELECT job_id, k + 1, i, j + 1, best.cost + 1, 2, best.way || 'I' FROM here
      UNION ALL SELECT job_id, k + 1, i, j, cost, turn, way FROM handed WHERE i + j > k
    )
    SELECT a.* FROM ahead a JOIN sizes s ON s.job_id = a.job_id WHERE i <= n AND j <= m AND 2 * (i - j) <= band + n - m AND 2 * (j - i) <= band - n + m
  )
), best AS (
  SELECT job_id, b.cost AS cost, b.way AS way FROM (SELECT h.job_id, min({'cost': cost, 'turn': turn, 'way': way}) AS b FROM handed h JOIN sizes s ON s.job_id = h.job_id AND h.i = n AND h.j = m GROUP BY h.job_id)
)"""
_EDGE = r"lower(regexp_replace(text, '^[^\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}]+$', '', 'g'))"
_HEARD = "SELECT job_id, ix, t_in, t_out, CASE WHEN ix % 23 = 0 THEN 'other' ELSE text END AS text FROM said WHERE ix % 17 <> 0"
_DIFF = dict(
    turn_words=ad.CTES["turn_words"], said=_TURNS["said"], heard=_HEARD,
    left_=f"SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ix) AS i, t_in, t_out, text, {_EDGE} AS key FROM said",
    right_=f"SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ix) AS j, t_in, t_out, text, {_EDGE} AS key FROM heard",
    sizes="SELECT job_id, count(*) AS n, count(*) FILTER (ix % 17 <> 0) AS m, count(*) FILTER (ix % 17 = 0 OR ix % 23 = 0) AS band FROM said GROUP BY job_id",
)
_STEPS = dict(
    letters="SELECT job_id, p, substr(way, p, 1) AS letter, length(replace(substr(way, 1, p), 'I', '')) AS i, length(replace(substr(way, 1, p), 'O', '')) AS j FROM (SELECT job_id, way, unnest(range(1, length(way) + 1)) AS p FROM best)",
    diff="""SELECT d.job_id, CAST(p - 1 AS INTEGER) AS step, CASE letter WHEN 'S' THEN 'substitution' WHEN 'O' THEN 'omission' ELSE 'insertion' END AS kind, l.text AS expected, r.text AS actual,
      CASE letter WHEN 'I' THEN r.t_in ELSE l.t_in END AS "at", CASE letter WHEN 'I' THEN r.t_out ELSE l.t_out END AS until
      FROM letters d LEFT JOIN left_ l ON l.job_id = d.job_id AND l.i = d.i AND letter <> 'I' LEFT JOIN right_ r ON r.job_id = d.job_id AND r.j = d.j AND letter <> 'O' WHERE letter <> '='""",
)
_RATES = _STEPS | dict(
    lengths=_TURNS["lengths"], cuts="SELECT job_id, unnest(range(1, greatest(1, CAST(floor(duration / 10) AS BIGINT)) + 1)) * 10.0::DOUBLE AS cut FROM lengths",
    seams="SELECT d.job_id, step, bool_or(cut IS NOT NULL) AS seam FROM diff d LEFT JOIN cuts c ON c.job_id = d.job_id AND cut >= d.at - 0.3::DOUBLE AND cut <= until + 0.3::DOUBLE GROUP BY ALL",
)


def _walked(body: str, before: dict[str, str], after: dict[str, str], ways: bool = True) -> str:
    """ways=False: the cost alone."""
    walk = _WALK if ways else re.sub(r"best\.way \|\| (CASE [^,]*? END|'.')", "''", _WALK)
    ctes = lambda x: ",\n".join(f"{k} AS {'MATERIALIZED ' * (k in ('left_', 'right_', 'sizes'))}({v})" for k, v in x.items())
    return f"WITH RECURSIVE {ctes(before)},\n{walk}" + (",\n" + ctes(after) if after else "") + "\n" + body


@_q(_walked("SELECT job_id, step, kind, expected, actual, round(d.at, 6) AS \"at\", round(until, 6) AS until FROM diff d", _DIFF, _STEPS))
def word_diff(spark, d):
    return _rounded(ts.word_diff(_said(spark, d), _heard(spark, d)), "at", "until")


@_q(_walked("""SELECT s.job_id, s.n AS expected_words, count(step) FILTER (NOT seam) AS n_real, count(step) FILTER (seam) AS n_at_seam, count(step) FILTER (NOT seam) / s.n AS wer
  FROM sizes s LEFT JOIN seams e ON e.job_id = s.job_id GROUP BY s.job_id, s.n""", _DIFF, _RATES))  # fmt: skip
def transcript_wer(spark, d):
    cuts = _lengths(spark, d).select("job_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("duration") / 10).cast("int")))).alias("k")).select("job_id", (F.col("k") * 10.0).alias("cut"))
    return ts.word_error_rate(_said(spark, d), _heard(spark, d), cuts)


_KEY = r"lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}'']+', '', 'g'))"
#: A range's longest run that both sides share: runs along diagonals, clipped to the range; of several the first in the script, then in what was heard.
_LONGEST = """SELECT r.job_id, a0, a1, b0, b1, min({'short': -(least(i0 + n, a1, i0 + b1 - j0) - greatest(i0, a0, i0 + b0 - j0)), 'i': greatest(i0, a0, i0 + b0 - j0), 'd': j0 - i0}) AS best
  FROM ranges r JOIN runs u ON u.job_id = r.job_id WHERE least(i0 + n, a1, i0 + b1 - j0) > greatest(i0, a0, i0 + b0 - j0) GROUP BY r.job_id, a0, a1, b0, b1"""
_ALIGNED = f"""WITH RECURSIVE turn_words AS ({ad.CTES["turn_words"]}), said AS ({_TURNS["said"]}), heard AS ({_HEARD}), lengths AS ({_TURNS["lengths"]}),
script AS MATERIALIZED (SELECT job_id, ix, row_number() OVER (PARTITION BY job_id ORDER BY ix) - 1 AS i, text, {_KEY} AS key, greatest(length({_KEY}), 1) AS size FROM said),
other AS MATERIALIZED (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ix) - 1 AS j, t_in, t_out, {_KEY} AS key FROM heard),
met AS (SELECT s.job_id, i, j, i - row_number() OVER (PARTITION BY s.job_id, i - j ORDER BY i) AS island FROM script s JOIN other o ON o.job_id = s.job_id AND o.key = s.key),
runs AS MATERIALIZED (SELECT job_id, min(i) AS i0, min(j) AS j0, count(*) AS n FROM met GROUP BY job_id, i - j, island),
ranges AS (
  SELECT job_id, 0::BIGINT AS a0, count(*) AS a1, 0::BIGINT AS b0, count(*) FILTER (ix % 17 <> 0) AS b1 FROM said GROUP BY job_id
  UNION ALL
  SELECT job_id, CASE side WHEN 0 THEN a0 ELSE best.i - best.short END, CASE side WHEN 0 THEN best.i ELSE a1 END, CASE side WHEN 0 THEN b0 ELSE best.i + best.d - best.short END, CASE side WHEN 0 THEN best.i + best.d ELSE b1 END
  FROM ({_LONGEST}) l, range(2) s(side) WHERE CASE side WHEN 0 THEN a0 < best.i AND b0 < best.i + best.d ELSE best.i - best.short < a1 AND best.i + best.d - best.short < b1 END
), anchors AS (SELECT job_id, best.i + k AS i, best.i + best.d + k AS j FROM (SELECT job_id, best, unnest(range(-best.short)) AS k FROM ({_LONGEST}) l)),
heard_at AS (SELECT s.*, o.t_in AS h_in, o.t_out AS h_out FROM script s LEFT JOIN anchors a ON a.job_id = s.job_id AND a.i = s.i LEFT JOIN other o ON o.job_id = a.job_id AND o.j = a.j),
gaps AS (SELECT h.*, duration, count(h_in) OVER w AS gap, coalesce(last_value(h_out IGNORE NULLS) OVER w, 0.0) AS since, coalesce(first_value(h_in IGNORE NULLS) OVER (PARTITION BY h.job_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), duration) AS upto
  FROM heard_at h JOIN lengths USING (job_id) WINDOW w AS (PARTITION BY h.job_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
shares AS (SELECT *, sum(CASE WHEN h_in IS NULL THEN size ELSE 0 END) OVER (PARTITION BY job_id, gap ORDER BY i) AS cum, sum(CASE WHEN h_in IS NULL THEN size ELSE 0 END) OVER (PARTITION BY job_id, gap) AS total FROM gaps),
placed AS MATERIALIZED (SELECT job_id, ix, i, text, h_in IS NOT NULL AS anchored, duration, CASE WHEN h_in IS NOT NULL THEN h_in ELSE since + (greatest(upto, since) - since) * ((cum - size) / total) END AS a,
  CASE WHEN h_in IS NOT NULL THEN h_out ELSE since + (greatest(upto, since) - since) * (cum / total) END AS b FROM shares),
clear AS (
  SELECT job_id, i, a, greatest(b, a + 0.04::DOUBLE) AS b FROM (SELECT job_id, i, greatest(a, 0.0) AS a, b FROM placed WHERE i = 0)
  UNION ALL SELECT job_id, i, a, greatest(b, a + 0.04::DOUBLE) FROM (SELECT p.job_id, p.i, greatest(p.a, c.b) AS a, p.b FROM clear c JOIN placed p ON p.job_id = c.job_id AND p.i = c.i + 1)
), cleared AS MATERIALIZED (SELECT * FROM clear),
wall AS (
  SELECT job_id, i, greatest(least(a, duration - 0.04::DOUBLE), 0.0) AS a, duration AS b FROM (SELECT c.*, duration, max(c.i) OVER (PARTITION BY c.job_id) AS last FROM cleared c JOIN lengths USING (job_id)) WHERE i = last AND b > duration
  UNION ALL SELECT c.job_id, c.i, greatest(least(c.a, w.a - 0.04::DOUBLE), 0.0), w.a FROM wall w JOIN cleared c ON c.job_id = w.job_id AND c.i = w.i - 1 AND c.b > w.a
)
SELECT p.job_id, CAST(p.ix AS INTEGER) AS ix, p.text, round(coalesce(w.a, c.a), 6) AS t_in, round(coalesce(w.b, c.b), 6) AS t_out, anchored FROM placed p JOIN cleared c ON c.job_id = p.job_id AND c.i = p.i LEFT JOIN wall w ON w.job_id = p.job_id AND w.i = p.i"""


@_q(_ALIGNED)
def align_words(spark, d):
    return _rounded(ts.align_words(_said(spark, d).select("job_id", "ix", "text"), _heard(spark, d), _lengths(spark, d)), "t_in", "t_out")


@_q(r"""
WITH raw AS (SELECT page_id, unnest(range(len(parts))) AS i, parts FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages)),
one AS (SELECT page_id, i, substr(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(parts[i + 1]), '^#+', '')), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS tag FROM raw),
firsts AS (SELECT page_id, tag, min(i) AS i FROM one WHERE tag <> '' GROUP BY page_id, tag),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM firsts)
SELECT p.page_id, coalesce(string_agg(tag, ',' ORDER BY k.i), '') AS tags FROM pages p LEFT JOIN kept k ON k.page_id = p.page_id AND r <= 30 GROUP BY p.page_id""")
def tag_normalize(spark, d):
    return ad.read(spark, d, "pages").select("page_id", F.array_join(tx.tags(F.split("url", "/")), ",").alias("tags"))


@_q(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, s, regexp_replace(coalesce(s[1], ''), '[.!?]+$', '') AS first FROM s)
SELECT doc_id, CASE WHEN length(first) > 70 THEN regexp_replace(substr(first, 1, 69), '(?s) [^ ]*$', '') || '…' ELSE first END AS title, sha256(array_to_string(s[1:3], ' ')) AS description_sha256 FROM f""")
def fallback_copy(spark, d):
    t = F.col("text")
    return ad.read(spark, d, "documents").select("doc_id", tx.fallback_title(t).alias("title"), F.sha2(tx.fallback_description(t), 256).alias("description_sha256"))


@_q(sql("""SELECT id, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS clock FROM (SELECT id, CAST(round_even(greatest(t * 100, 0.0) * 100, 0) AS BIGINT) AS cs FROM points)"""))
def clock_format(spark, d):
    return ad.points(spark, d).select("id", clock(F.col("t") * 100).alias("clock"))


@_q(sql(r"""SELECT conv_id * 1000 + turn AS job_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, CAST(greatest(floor(length(text) / 15.0 * 2.5), 1) AS BIGINT) AS budget FROM conversations WHERE text IS NOT NULL"""))
def word_budget(spark, d):
    c = ad.read(spark, d, "conversations").where("text IS NOT NULL")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), tx.word_count(F.col("text")).cast("long").alias("n_words"), tx.word_budget(F.length("text") / 15.0).cast("long").alias("budget"))


@_q(r"""SELECT conv_id * 1000 + turn AS job_id, sha256(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''), ' ')) AS tokens_sha256,
  sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha256 FROM conversations WHERE text IS NOT NULL""")
def plain_tokens_and_escape(spark, d):
    c = ad.read(spark, d, "conversations").where("text IS NOT NULL")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), F.sha2(F.array_join(tx.plain_tokens(F.col("text")), " "), 256).alias("tokens_sha256"), F.sha2(tx.escaped(F.col("text")), 256).alias("escaped_sha256"))


@_q(sql(r"""SELECT job_id, ix, lower(regexp_replace(text, '^[^\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}]+$', '', 'g')) AS edge, lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}'']+', '', 'g')) AS key FROM said""", **_TURNS))
def word_keys(spark, d):
    w = F.col("text")
    return _said(spark, d).select("job_id", "ix", tx.edge_normalized(w).alias("edge"), tx.alignment_key(w).alias("key"))


@_q(sql("""SELECT job_id, string_agg(CASE WHEN ix = 2 THEN '<' || text || '>' WHEN ix IN (2, 5) THEN '*' || text || '*' ELSE text END, ' ' ORDER BY ix) AS line FROM said GROUP BY job_id""", **_TURNS))
def markup_tokens(spark, d):
    c = ad.read(spark, d, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where("size(w) > 0")
    return c.select("job_id", tx.marked(F.col("w"), 2, F.array(F.lit(2), F.lit(5)), ("<", ">"), ("*", "*")).alias("line"))


@_q(sql("""SELECT job_id, string_agg(text, chr(10) ORDER BY ix) || CASE WHEN max(n) > 20 THEN chr(10) || '... and ' || (max(n) - 20) || ' more' ELSE '' END AS report FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM said) WHERE ix < 20 GROUP BY job_id""", **_TURNS))
def truncated_report(spark, d):
    c = ad.read(spark, d, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where("size(w) > 0")
    return c.select("job_id", tx.first_and_more(F.col("w"), 20).alias("report"))


def _plain_pairs(spark, d):
    both = _said(spark, d).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ix", "text"))).alias("e"))
    heard = _heard(spark, d).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ix", "text"))).alias("h"))
    line = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), " ")
    return both.join(heard, "job_id", "left").select("job_id", line("e").alias("expected"), line("h").alias("heard"))


_TOKENS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
_PLAIN = dict(
    turn_words=ad.CTES["turn_words"], said=_TURNS["said"], heard=_HEARD, own=f"SELECT job_id, ix, {_TOKENS.format('text')} AS t FROM said", other=f"SELECT job_id, ix, {_TOKENS.format('text')} AS t FROM heard",
    left_="SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ix, k) AS i, t[k] AS key FROM (SELECT job_id, ix, t, unnest(range(1, len(t) + 1)) AS k FROM own)",
    right_="SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ix, k) AS j, t[k] AS key FROM (SELECT job_id, ix, t, unnest(range(1, len(t) + 1)) AS k FROM other)",
    sizes="""SELECT o.job_id, CAST(sum(len(o.t)) AS BIGINT) AS n, CAST(coalesce(sum(len(h.t)), 0) AS BIGINT) AS m, sum(CASE WHEN o.ix % 17 = 0 THEN len(o.t) WHEN o.ix % 23 = 0 THEN greatest(len(o.t), 1) ELSE 0 END) AS band
      FROM own o LEFT JOIN other h ON h.job_id = o.job_id AND h.ix = o.ix GROUP BY o.job_id""",
)


@_q(_walked("SELECT b.job_id AS job_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(cost / n, 4) END AS wer FROM best b JOIN sizes s ON s.job_id = b.job_id", _PLAIN, {}, ways=False))
def plain_wer(spark, d):
    return ts.plain_error_rate(_plain_pairs(spark, d))


_FOUND = """SELECT job_id, 'transcript' AS "check", 'FAIL' AS severity, 'words differ' AS message, n_real / n AS value, 0.1::DOUBLE AS "limit" FROM counted WHERE n_real / n > 0.1
  UNION ALL SELECT job_id, 'transcript_seams', 'INFO', 'differences at cuts', 0.0, 0.0 FROM counted UNION ALL SELECT job_id, 'transcript_words', 'INFO', 'words expected', n, 0.0 FROM counted"""
_COUNTED = _STEPS | dict(counted="SELECT s.job_id, n, count(step) AS n_real FROM sizes s LEFT JOIN diff d ON d.job_id = s.job_id GROUP BY s.job_id, n")


@_q(_walked(_FOUND, _DIFF, _COUNTED))
def transcript_findings(spark, d):
    from ..operators import checks

    return checks.transcript(ts.word_error_rate(_said(spark, d), _heard(spark, d), spark.createDataFrame([], "job_id long, cut double")))
