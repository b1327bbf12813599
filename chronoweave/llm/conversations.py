"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow (s?(ua)+)?.

Turns lie hash-partitioned by conversation and in order. A recursive query of DuckDB runs over each batch of a partition: each recursion advances one turn
for all the batch's conversations at once and keeps, for each state of the grammar, the least cost and, of equal costs, the audit that is least in
ASCII. A conversation that goes on beyond a piece of PIECE turns (or beyond the batch) has each further piece walked from every state that it may begin in; the
pieces are put together afterwards. That is right as two audits of equal cost over the same turns never begin with each other: what one has more would be paid insertions.

Faults, places and audits travel without the texts; these are sorted once, beside the audits, to be written out again turn by turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import CRC_TABLE_SQL, crc_sql, stash

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. What an initial leads to.
LEADS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
#: Turns that one recursion walks at most.
PIECE = 1024
#: Kinds of turns: fit, unfit (blank or duplicate, must go), truncated.
FIT, UNFIT, CUT = 0, 1, 2
_SPACE = " \t\n\x0b\x0c\r"
_INITIALS = "sua-"
#: Where conversations are damaged: one key in 20 for each of these.
DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the turns as a checksum of conv_id and turn damages them. copies is 0 for a dropped turn and 2 for a repeated one.
    Nulls are one space, in the checksum too, but that conv_id and turn stay null."""
    blank = F.lit(" ")
    k = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(k == AS_USER, "user").otherwise(role).alias("role"),
        F.when(k == EMPTY, "").when(k == UNSTOP, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(k == DROP, 0).when(k == REPEAT, 2).otherwise(1).alias("copies"),
    )


def _name(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1, in order), turn, initial (-: none of s, u, a), fault (blank, duplicate, truncated or null), illegal, new_turn of turns(conv_id, turn, role, text, copies).

    The order is by turn, nulls first, then role, then the text's SHA-256; equal turns are copies. A turn is a duplicate if role and text stand earlier in the conversation.
    """
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    each = turns.where("copies > 0").select("conv_id", "turn", "role", _name(F.col("text")).alias("h"), (F.length(end) == 0).alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), "copies")
    distinct = each.groupBy("conv_id", "turn", "role", "h", "blank", "cut").agg(F.sum("copies").alias("n"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "h").orderBy(F.col("turn").asc_nulls_first())) > 1
    copies = distinct.withColumn("seen", seen).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen") | (F.col("copy") > 1), "duplicate").when(F.col("cut"), "truncated")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "h", "copy")
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(w)
    illegal = F.coalesce(~F.concat(before, initial).isin("su", "ua", "au"), F.lit(False))
    new_turn = F.coalesce(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(w)), F.lit(False))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    return copies.select("conv_id", F.row_number().over(w).alias("i"), "turn", known.alias("initial"), fault.alias("fault"), illegal.alias("illegal"), new_turn.alias("new_turn"))


def _inserted(state: int, k: int) -> int:
    """The state after k inserted turns; what may be inserted is given by the state."""
    for _ in range(k):
        state = LEADS["u"].get(state) or LEADS["a"][state]
    return state


def _moves() -> pa.Table:
    """(s1, code, s2, cost, letters): what can be done before and with a turn. More than two insertions in a row come back to a state that was there before."""
    rows = []
    for s in range(4):
        for k in range(3):
            at, paid, letters = _inserted(s, k), INSERT * k, "I" * k
            for c, initial in enumerate(_INITIALS):
                for kind in (FIT, UNFIT, CUT):
                    code = 3 * c + kind
                    rows.append((s, code, at, paid + DELETE, letters + "D"))
                    if kind != UNFIT:
                        more = paid + TRUNCATED * (kind == CUT)
                        if at in LEADS.get(initial, {}):
                            rows.append((s, code, LEADS[initial][at], more, letters + "K"))
                        rows.append((s, code, _inserted(at, 1), more + REROLE, letters + "R"))
    return pa.table({n: list(v) for n, v in zip(("s1", "code", "s2", "cost", "letters"), zip(*rows))})


_WALK = """
WITH RECURSIVE walk(c, i, f, s, cost, audit) AS (
  SELECT c, 0, f, f, 0, '' FROM seeds
  UNION ALL
  SELECT c, i, f, s, best.cost, best.audit FROM (
    SELECT walk.c, walk.i + 1 AS i, walk.f, moves.s2 AS s, min({'cost': walk.cost + moves.cost, 'audit': walk.audit || moves.letters}) AS best
    FROM walk JOIN turns ON turns.c = walk.c AND turns.i = walk.i + 1 JOIN moves ON moves.s1 = walk.s AND moves.code = turns.code GROUP BY ALL)
)
SELECT walk.c, f, s, cost, audit FROM walk JOIN pieces ON pieces.c = walk.c AND pieces.n = walk.i ORDER BY walk.c
"""

VERDICTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _verdicts(batches):
    """VERDICTS for each conversation of a partition that is sorted by conv_id and i."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.register("moves", _moves())
    key, sums, span, states = None, None, None, None  # of the conversation that may go on

    def verdict():
        gaps = span[1] - span[0] + 1 - int(sums[4]) if span else 0
        cost, audit = min((cost + INSERT * k, audit + "I" * k) for s, (cost, audit) in states.items() for k in range(3) if _inserted(s, k) in ENDS)
        return (key[0], min(gaps, 2**63 - 1), *(int(x) for x in sums[:4]), cost, audit)

    for b in batches:
        if not b.num_rows:
            continue
        conv, turn = b.column("conv_id"), b.column("turn")
        ids, none = np.asarray(conv.fill_null(0)), np.asarray(conv.is_null())
        begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))
        fault, initial = b.column("fault").to_pylist(), b.column("initial").to_pylist()
        kind = np.array([FIT if x is None else CUT if x == "truncated" else UNFIT for x in fault])
        code = 3 * np.array([_INITIALS.index(x) for x in initial]) + kind
        counted = np.array([[x == "blank" for x in fault], [x == "duplicate" for x in fault], [x == "truncated" for x in fault], b.column("illegal").to_pylist(), b.column("new_turn").to_pylist()], np.int64)
        counted = np.add.reduceat(counted, begin, axis=1).T
        # pieces of conversations, and the states that each may begin in
        size = np.diff(np.concatenate([begin, [len(ids)]]))
        owner = np.repeat(np.arange(len(begin)), size)
        place = np.arange(len(ids)) - begin[owner]
        first = np.flatnonzero(place % PIECE == 0)
        piece = np.cumsum(place % PIECE == 0) - 1
        names = [None if none[x] else int(ids[x]) for x in begin]
        goes_on = key is not None and names[0] == key[0]
        anywhere = (place[first] > 0) | ((owner[first] == 0) & goes_on)
        tables = {
            "turns": pa.table({"c": piece, "i": place % PIECE + 1, "code": code}), "pieces": pa.table({"c": np.arange(len(first)), "n": np.diff(np.concatenate([first, [len(ids)]]))}),
            "seeds": pa.table({"c": np.repeat(np.arange(len(first)), np.where(anywhere, 4, 1)), "f": np.concatenate([np.arange(4 if x else 1) for x in anywhere])}),
        }
        for name, t in tables.items():
            con.register(name, t)
        walked = con.execute(_WALK).fetchall()
        out, at = [], 0
        turns, p = turn.to_pylist(), 0
        for o, name in enumerate(names):
            if not (o == 0 and goes_on):
                if key is not None:
                    out.append(verdict())
                key, sums, span, states = (name,), np.zeros(5, np.int64), None, {0: (0, "")}
            sums = sums + counted[o]
            known = [t for t in turns[begin[o] : begin[o] + size[o]] if t is not None]
            if known:
                span = (min(known[0], span[0]), max(known[-1], span[1])) if span else (known[0], known[-1])
            while p < len(first) and owner[first[p]] == o:
                after: dict[int, tuple[int, str]] = {}
                while at < len(walked) and walked[at][0] == p:
                    _, f, s, cost, audit = walked[at]
                    if f in states:
                        way = (states[f][0] + cost, states[f][1] + audit)
                        after[s] = min(after.get(s, way), way)
                    at += 1
                states, p = after, p + 1
        yield _record(out, VERDICTS)
    if key is not None:
        yield _record([verdict()], VERDICTS)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.strip().split(" ") for x in schema.split(",")]
    types = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def verdicts(turns: DataFrame) -> DataFrame:
    """VERDICTS of each conversation of turns(conv_id, turn, role, text, copies) that has any.

    gaps: turn numbers missing between the first and the last; blank, duplicate, truncated: turns by their first fault; illegal: neighbours whose roles may not follow each other;
    cost, audit: the cheapest edits and their initials (K kept, R other role, D deleted, I inserted), in order. A role that begins with none of s, u, a can't be kept.
    One conversation is walked in one task, PIECE turns at a time; its audit has a letter for each turn.
    """
    placed = faults(turns).sortWithinPartitions("conv_id", "i")
    return placed.mapInArrow(_verdicts, VERDICTS)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _write_out(batches):
    """REPAIRED of a partition that has, for each conversation, the audit (kind 0) and then its turns in order."""
    key, audit, p, state, place = None, "", 0, 0, 0
    for b in batches:
        rows = []

        def put(edit, role, text):
            nonlocal state, place
            state = LEADS[role[0]][state]
            rows.append((key[0], place, edit, role, text))
            place += 1

        def insertions():
            nonlocal p
            while p < len(audit) and audit[p] == "I":
                put("I", "user" if state != 2 else "assistant", "")
                p += 1

        for conv, kind, plan, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "audit", "role", "text"))):
            if kind == 0:
                insertions()
                key, audit, p, state, place = (conv,), plan, 0, 0, 0
                continue
            insertions()
            edit, p = audit[p], p + 1
            if edit != "D":
                put(edit, role if edit == "K" else "user" if state != 2 else "assistant", text)
        if b.num_rows:
            yield _record(rows, REPAIRED)
    rows = []
    while p < len(audit):
        rows.append((key[0], place, "I", "user" if state != 2 else "assistant", ""))
        state, place, p = _inserted(state, 1), place + 1, p + 1
    yield _record(rows, REPAIRED)


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """REPAIRED: the turns that verdicts(turns) leaves, in the order that audits were made for, with what was done to each. A partition's rows come in
    order of conv_id and place."""
    copies = turns.where("copies > 0").select("conv_id", "turn", "role", "text", "copies", _name(F.col("text")).alias("h"))
    each = copies.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "h", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    plans = audits.select("conv_id", F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("h"), F.lit(None).cast("string").alias("text"))
    both = plans.unionByName(each).repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    order = ("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "h")
    return both.sortWithinPartitions(*order).select("conv_id", "kind", "audit", "role", "text").mapInArrow(_write_out, REPAIRED)


def _digest(batches):
    key, sha = None, None
    schema = "conv_id long, sha256 string"
    for b in batches:
        done = []
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if key is None or key[0] != conv:
                if key is not None:
                    done.append((key[0], sha.hexdigest()))
                key, sha = (conv,), hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if b.num_rows:
            yield _record(done, schema)
    if key is not None:
        yield _record([(key[0], sha.hexdigest())], schema)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, sha256 of the lines role:text of repaired(): a conversation of any length goes through without being held."""
    return rows.mapInArrow(_digest, "conv_id long, sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id (a null one is one, too): VERDICTS of the damaged turns, and repaired_sha256 of what the repair leaves.

    A conversation without turns after the damage has zeros, an empty audit and the hash of nothing. Texts may be empty or of any length; turns may
    repeat (copies of each other) or be null (first). An empty table gives no rows; other columns are not read.
    """
    turns = damaged(conversations)
    found = stash(verdicts(turns), "verdicts")
    named = digests(repaired(turns, found))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    a, b = (x.withColumnRenamed("conv_id", f"__{n}").hint("merge") for n, x in (("a", found), ("b", named)))
    both = ids.join(a, F.col("conv_id").eqNullSafe(F.col("__a")), "left").join(b, F.col("conv_id").eqNullSafe(F.col("__b")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


REPORT_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations
), hashed AS (SELECT *, {crc_sql("x")} % 20 AS k FROM keyed, crc_table),
turns AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
    substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS both_ FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), judged AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN core[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (both_ NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
), grammar(s1, c, s2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts AS (
  SELECT s AS s1, s AS s2, 0 AS paid, '' AS letters FROM range(4) r(s) UNION ALL SELECT s1, s2, 5, 'I' FROM grammar WHERE c <> 's'
  UNION ALL SELECT g.s1, h.s2, 10, 'II' FROM grammar g JOIN grammar h ON h.s1 = g.s2 WHERE g.c <> 's' AND h.c <> 's'
), steps AS (
  SELECT s1, s2, '' AS c, paid + 2 AS cost, letters || 'D' AS letters, true AS goes FROM inserts
  UNION ALL SELECT n.s1, g.s2, '', paid + 1, letters || 'R', false FROM inserts n JOIN grammar g ON g.s1 = n.s2 WHERE g.c <> 's'
  UNION ALL SELECT n.s1, g.s2, g.c, paid, letters || 'K', false FROM inserts n JOIN grammar g ON g.s1 = n.s2
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, s, best.cost, best.audit FROM (
    SELECT w.conv_id, w.i + 1 AS i, p.s2 AS s, min({{'cost': w.cost + p.cost + CASE WHEN t.fault = 'truncated' AND NOT p.goes THEN 5 ELSE 0 END, 'audit': w.audit || p.letters}}) AS best
    FROM walk w JOIN judged t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN steps p ON p.s1 = w.s AND p.c IN ('', t.c) AND (p.goes OR t.fault NOT IN ('blank', 'duplicate')) GROUP BY ALL)
), done AS (
  SELECT w.conv_id, min({{'cost': w.cost + paid, 'audit': audit || letters}}) AS best FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN inserts e ON e.s1 = w.s AND e.s2 IN (0, 3) GROUP BY w.conv_id
), letters AS (SELECT conv_id, p, substr(best.audit, p, 1) AS edit, length(replace(substr(best.audit, 1, p), 'I', '')) AS i FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS p FROM done)),
stay AS (SELECT l.conv_id, p, edit, t.role, t.text, t.c, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS place FROM letters l LEFT JOIN judged t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i AND l.edit <> 'I' WHERE edit <> 'D'),
begun AS (SELECT conv_id, max(CASE WHEN place = 1 AND edit = 'K' AND c = 's' THEN 1 ELSE 0 END) AS with_s FROM stay GROUP BY conv_id),
texts AS (
  SELECT s.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - with_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS lines
  FROM stay s JOIN begun b ON b.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY s.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
