"""Transcripts: caption blocks, filler and trim proposals, alignment, differences and word error rates.

Words are (job_id, ix, t_in, t_out, text). Steps whose state runs from word to word work on one array per job: folds in SQL where the state
is small, an Arrow function over rows of whole transcripts where it is a table or a backward pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import FILLERS, alignment_key, bare, edge_normalized, plain_tokens
from ..functions.time import EPS
from . import alignment, intervals, scan


def filler_spans(words: DataFrame, fillers: list[str] | tuple[str, ...] = FILLERS) -> DataFrame:
    return words.where(bare(F.col("text")).isin(*fillers)).select("job_id", "t_in", "t_out", F.lit("filler").alias("kind"), F.lit(1).alias("ord"))


def trim_proposals(silences: DataFrame, words: DataFrame, fillers: DataFrame, durations: DataFrame, min_silence: float = 0.6, pad: float = 0.12) -> DataFrame:
    """Removals: silences without the words in them, long enough, padded; and fillers; merged and kept within the recording."""
    left = intervals.subtract(silences, words).where(F.col("t_out") - F.col("t_in") >= min_silence - EPS)
    shrunk = left.select("job_id", (F.col("t_in") + pad).alias("t_in"), (F.col("t_out") - pad).alias("t_out"), F.lit("silence").alias("kind"), F.lit(0).alias("ord")).where("t_out > t_in")
    merged = intervals.merge(shrunk.unionByName(fillers.select("job_id", "t_in", "t_out", "kind", "ord"))).join(durations, "job_id")
    lo, hi = F.greatest("t_in", F.lit(0.0)), F.least("t_out", "duration")
    return merged.select("job_id", lo.alias("t_in"), hi.alias("t_out"), "kind").where(F.col("t_out") - F.col("t_in") > EPS)


def _follows(n: np.ndarray, stops: np.ndarray, last: np.ndarray, limit: int, min_words: int) -> np.ndarray:
    """Where the block after one that begins with each word begins; last: the place of the last word of the word's job. n: letters of a word."""
    at, reach = np.arange(len(n)), np.cumsum(n + 1)
    fits = np.searchsorted(reach, reach - n + limit, "right")
    stop = np.append(np.flatnonzero(stops), len(n) + min_words)
    return np.clip(np.minimum(fits, stop[np.searchsorted(stop, at + min_words - 1)] + 1), at + 1, last + 1)


def _numbered(words: DataFrame, by: list[str], order: list[str], limit: int, pause: float, min_words: int) -> DataFrame:
    """words less __letters and __full, with `block`: the blocks of each group from its first word on. The words of a group come in order, a batch at a time; what is kept is the block that is still open."""
    others = [c for c in words.columns if c not in ("__letters", "__full")]

    def run(batches):
        held, block = None, 0  # the words of the block that is open where the last batch ended, and its number
        for b in batches:
            if not b.num_rows:
                continue
            w = b.select([*by, "t_in", "t_out", "__letters", "__full"])
            k = held.num_rows if held else 0
            w = pa.concat_batches([held, w]) if k else w
            size, ends = np.asarray(w.column("__letters")), np.asarray(w.column("__full").fill_null(False))
            (t_in, has_in), (t_out, has_out) = ((np.asarray(w.column(c).cast(pa.float64()).fill_null(0.0)), np.asarray(w.column(c).is_valid())) for c in ("t_in", "t_out"))
            new = np.append(True, np.any([np.asarray(pc.not_equal(w.column(c)[1:], w.column(c)[:-1])) for c in by], axis=0))
            begin, of = np.flatnonzero(new), np.cumsum(new) - 1
            last = np.append(begin[1:], len(size))[of] - 1
            stops = np.append(~new[1:] & has_in[1:] & (ends[:-1] | has_out[:-1] & ~(t_in[1:] - t_out[:-1] < pause)), False)
            follows, starts, at = _follows(size, stops, last, limit, min_words), np.zeros(len(size), bool), begin
            while len(at):
                starts[at] = True
                at = follows[at][follows[at] <= last[at]]
            count = np.cumsum(starts)
            number = count - count[begin][of]
            number[: last[0] + 1] += block
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(number[k:].astype(np.int32))], names=[*others, "block"])
            held, block = w.slice(np.flatnonzero(starts)[-1]), number[-1]

    kinds = words.select(*others, F.lit(None).cast("int").alias("block")).schema
    return words.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kinds)


def pack_blocks(words: DataFrame, limit: int, pause: float = 0.45, min_words: int = 2) -> DataFrame:
    """The words with `block`: full blocks end; else, from min_words (2 or more) on, sentences and pauses end them, but never before the last word.

    Where the next block begins depends on where this one does and on nothing before it. A job's words come in order, a batch at a time, and every job of a batch goes from block to block at once; what is
    kept from batch to batch is the block that is still open, so a job may have any length. With scan.HOT_JOBS a job's words are numbered in pieces, in many tasks. ix: places in order, as they are counted;
    ties are broken by t_in, t_out and text.
    """
    if min_words < 2:
        raise ValueError("a block ends early with two words at least")
    others, order = [c for c in words.columns if c not in ("job_id", "ix")], ["ix", "t_in", "t_out", "text"]
    full = F.col("text").rlike("[.!?…]['\")\\]]*$")
    sized = words.where("job_id IS NOT NULL AND ix IS NOT NULL").select("*", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("__letters"), full.alias("__full"))
    if scan.in_chunks(words):
        numbered = _in_pieces(sized, order, limit, pause, min_words)
    else:
        numbered = _numbered(sized, ["job_id"], order, limit, pause, min_words)
    return numbered.select("job_id", "ix", "block", *others)


#: Words that are looked at together.
PIECE = 256


def _in_pieces(words: DataFrame, order: list[str], limit: int, pause: float, min_words: int) -> DataFrame:
    """_numbered for hot jobs.

    A piece of PIECE words is a table, for each place of its head where a block may begin first, of where the first block beyond it begins and how many begin within; the pieces of a job are gone through from table
    to table, and each piece is numbered from where it is entered. A job is its words in pieces and one row of tables; a word's text is not in them.
    """
    at = F.col("ix") / F.lit(PIECE) * scan.CHUNK  # a chunk of the scans is a piece of places
    placed = scan.running(words, at, order, {"__r": ("sum", F.lit(1))}).withColumn("__r", F.coalesce("__r", F.lit(0)))  # words before
    # a piece sees the head of the next one, as far as a block that begins within it may reach: words have no less than no letters
    size, reach = max(PIECE, limit + 2), limit + 2
    own = F.floor(F.col("__r") / size)
    slim = scan.neighbour(placed.select("job_id", "ix", "t_in", "t_out", "__letters", "__full", "__r"), at, ["ix", "__r"], {"__next": "t_in"})
    stops = F.when(F.col("__next").isNull(), False).otherwise(F.col("__full") | (F.col("__next") - F.col("t_out") >= pause))
    pieces = F.when(F.col("__r") % size < reach, F.array(own, own - 1)).otherwise(F.array(own))
    seen = slim.select("job_id", F.struct(F.col("__r").alias("r"), F.col("__letters").alias("n"), F.coalesce(stops, F.lit(False)).alias("stops")).alias("w"), F.explode(pieces).alias("piece")).where("piece >= 0")
    per = seen.groupBy("job_id", "piece").agg(F.array_sort(F.collect_list("w")).alias("w"))

    def tables(batches):
        for b in batches:
            w, length = b.column("w").flatten(), np.asarray(pc.list_value_length(b.column("w"))).astype(np.int64)
            n, stops = (np.asarray(pc.struct_field(w, f)) for f in ("n", "stops"))
            begin = np.cumsum(length) - length
            to = _follows(n, stops, np.repeat(begin + length - 1, length), limit, min_words)
            beyond, blocks = np.repeat(begin + np.minimum(length, size), length), np.ones(len(n), np.int64)
            # from block to block within a piece, twice as far each time
            while len(on := np.flatnonzero(to < beyond)):
                blocks[on], to[on] = blocks[on] + blocks[to[on]], to[to[on]]
            head = np.arange(len(n)) - np.repeat(begin, length) < np.repeat(np.minimum(size, reach), len(n))
            ways = pa.StructArray.from_arrays([pa.array((to - beyond)[head].astype(np.int32)), pa.array(blocks[head])], ["out", "n"])
            ends = np.append(0, np.cumsum(np.minimum(length, reach))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("piece"), pa.ListArray.from_arrays(pa.array(ends), ways)], names=["job_id", "piece", "ways"])

    kinds = per.select("job_id", "piece", F.lit(None).cast("array<struct<out: int, n: bigint>>").alias("ways")).schema
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("block"), F.array().cast("array<struct<piece: bigint, at: int, block: bigint>>").alias("all"))

    def enter(acc: Column, t: Column) -> Column:
        here = F.struct(t["piece"].alias("piece"), acc["at"].alias("at"), acc["block"].alias("block"))
        way_on = F.get(t["ways"], acc["at"])
        # a block may reach over a short last piece: then nothing begins in it
        return F.struct(F.coalesce(way_on["out"], F.lit(0)).alias("at"), (acc["block"] + F.coalesce(way_on["n"], F.lit(0))).alias("block"), F.concat(acc["all"], F.array(here)).alias("all"))

    entries = per.mapInArrow(tables, kinds).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ways"))).alias("t")).select("job_id", F.explode(F.aggregate("t", start, enter)["all"]).alias("e"))
    entries = entries.select("job_id", F.col("e.piece").alias("__piece"), F.col("e.at").alias("__at"), F.col("e.block").alias("__first"))
    entered = placed.withColumn("__piece", own).join(entries, ["job_id", "__piece"])
    # words before the entry are of the block that was open
    before = F.col("__r") % size < F.col("__at")
    open_ = entered.where(before).withColumn("block", F.lit(-1))
    later = _numbered(entered.where(~before), ["job_id", "__piece"], ["__r"], limit, pause, min_words)
    return later.unionByName(open_.select(*later.columns)).withColumn("block", (F.col("__first") + F.col("block")).cast("int"))


def active_windows(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """job_id, block_ix, word_ix (-1: none lit), t_in, t_out: a word is lit until the next begins; windows that print as nothing go."""
    from ..functions.time import clock

    w = Window.partitionBy("job_id", "block_ix").orderBy("word_ix")
    j = words.select("job_id", "block_ix", "word_ix", F.col("t_in").alias("w_in")).join(blocks.select("job_id", "block_ix", F.col("t_in").alias("lo"), F.col("t_out").alias("hi")), ["job_id", "block_ix"])
    lit = j.withColumn("until", F.coalesce(F.lead("w_in").over(w), F.col("hi")))
    lead_in = j.where("word_ix = 0 AND w_in > lo").select("job_id", "block_ix", F.lit(-1).alias("word_ix"), F.col("lo").alias("a"), F.col("w_in").alias("b"), "lo", "hi")
    rows = lit.select("job_id", "block_ix", "word_ix", F.col("w_in").alias("a"), F.col("until").alias("b"), "lo", "hi").unionByName(lead_in)
    inside = lambda c: F.greatest("lo", F.least(F.col(c), F.col("hi")))
    out = rows.select("job_id", "block_ix", "word_ix", inside("a").alias("t_in"), inside("b").alias("t_out"))
    return out.where(clock(F.col("t_in")) != clock(F.col("t_out")))


DIFFERENCES = "job_id long, step int, kind string, expected string, actual string, at double, until double"
_KINDS = pa.array(["match", "substitution", "omission", "insertion"])


def _arrays(words: DataFrame, name: str, key: Column) -> DataFrame:
    each = F.struct("ix", F.col("t_in").cast("double").alias("t_in"), F.col("t_out").cast("double").alias("t_out"), "text", key.alias("key"))
    return words.groupBy("job_id").agg(F.array_sort(F.collect_list(each)).alias(name))


class _Pairs:
    """Two columns of arrays of words side by side: all words of each, where each job's begin, and numbers that are equal where their keys are."""

    def __init__(self, batch: pa.RecordBatch, left: str, right: str):
        columns = [batch.column(c) for c in (left, right)]
        self.words = [c.flatten() for c in columns]
        self.begin = [np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(c), 0)))]) for c in columns]
        keys = pa.concat_arrays([pc.struct_field(w, "key") for w in self.words])
        codes = np.asarray(keys.dictionary_encode().indices.fill_null(-1)).astype(np.int64)
        self.codes = codes[: len(self.words[0])], codes[len(self.words[0]) :]

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(c[s[row] : s[row + 1]] for c, s in zip(self.codes, self.begin))

    def take(self, side: int, at: np.ndarray, field: str) -> pa.Array:
        """A field of one side's words at these places, null for -1."""
        return pc.struct_field(self.words[side], field).take(pa.array(at, mask=at < 0))


def word_diff(expected: DataFrame, heard: DataFrame) -> DataFrame:
    """DIFFERENCES by word, matches left out; words that agree but for case and outer punctuation match.

    Of optimal alignments that which, seen from the end, has pairs before omissions before insertions. A pair of transcripts is aligned in one task, in
    memory that grows with the root of its length times its differences (alignment.edits).
    """

    def run(batches):
        for b in batches:
            pairs, found = _Pairs(b, "e", "h"), []
            for row in range(b.num_rows):
                kinds = alignment.edits(*pairs.of(row))
                step = np.flatnonzero(kinds != alignment.MATCH)
                i, j = (np.where(x[step] < 0, -1, x[step] + s[row]) for x, s in zip(alignment.places(kinds), pairs.begin))
                found.append((np.full(len(step), row), step.astype(np.int32), kinds[step], i, j))
            if not found:
                continue
            row, step, kind, i, j = (np.concatenate(x) for x in zip(*found))
            from_heard = pa.array(i < 0)
            times = [pc.if_else(from_heard, pairs.take(1, j, f), pairs.take(0, i, f)) for f in ("t_in", "t_out")]
            columns = [b.column("job_id").take(pa.array(row)), pa.array(step), _KINDS.take(pa.array(kind)), pairs.take(0, i, "text"), pairs.take(1, j, "text"), *times]
            yield pa.RecordBatch.from_arrays(columns, names=["job_id", "step", "kind", "expected", "actual", "at", "until"])

    key = edge_normalized(F.col("text"))
    both = _arrays(expected, "e", key).join(_arrays(heard, "h", key), "job_id", "full_outer")
    return both.select(F.col("job_id").cast("long").alias("job_id"), "e", "h").mapInArrow(run, DIFFERENCES)


def word_error_rate(expected: DataFrame, heard: DataFrame, cuts: DataFrame, seam: float = 0.30) -> DataFrame:
    """job_id, expected_words, n_real, n_at_seam, wer: differences within `seam` of a cut (job_id, cut) are the cut's doing."""
    d = word_diff(expected, heard)
    # a recording's cuts are many rows that Spark's estimate doesn't know of, so they are no broadcast
    near = d.join(cuts.select(F.col("job_id").alias("j"), "cut").hint("merge"), (F.col("job_id") == F.col("j")) & (F.col("cut") >= F.col("at") - seam) & (F.col("cut") <= F.col("until") + seam), "left_semi").select("job_id", "step").withColumn("seam", F.lit(True))
    per = d.join(near, ["job_id", "step"], "left").groupBy("job_id").agg(F.count_if(F.col("seam").isNull()).alias("n_real"), F.count_if(F.col("seam")).alias("n_at_seam"))
    n = expected.groupBy("job_id").agg(F.count("*").alias("expected_words"))
    j = n.join(per, "job_id", "left")
    real = F.coalesce("n_real", F.lit(0))
    return j.select("job_id", "expected_words", real.alias("n_real"), F.coalesce("n_at_seam", F.lit(0)).alias("n_at_seam"), (real / F.col("expected_words")).alias("wer"))


def plain_error_rate(pairs: DataFrame) -> DataFrame:
    """job_id, wer of (job_id, expected, heard) texts: edits of plain tokens by the number expected, to 4 places; 0 where nothing is expected.

    Each different word of a pair becomes one character, so that Spark's edit distance of strings is that of words.
    """
    t = pairs.select("job_id", F.coalesce(plain_tokens(F.col("expected")), F.array()).alias("e"), F.coalesce(plain_tokens(F.col("heard")), F.array()).alias("h"))
    t = t.withColumn("all", F.array_union("e", "h"))
    # numbers from 1 on, past the surrogates, as UTF-16: two units where one is not enough
    code = lambda x: F.array_position("all", x) + F.when(F.array_position("all", x) >= 0xD800, 0x800).otherwise(0)
    sign = lambda x: F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32")
    text = lambda c: F.array_join(F.transform(c, sign), "")
    rate = F.levenshtein(text(F.col("e")), text(F.col("h"))) / F.size("e")
    return t.select("job_id", F.when(F.size("e") == 0, 0.0).otherwise(F.round(rate, 4)).alias("wer"))


ALIGNED = "job_id long, ix int, text string, t_in double, t_out double, anchored boolean"


def _times(size: np.ndarray, anchors: list[tuple[int, int, int]], t_in: np.ndarray, t_out: np.ndarray, duration: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and whether it is heard of each word of a script, whose words have these sizes; anchors pair runs of them with runs of heard words."""
    n = len(size)
    start, stop, known = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for i, j, k in anchors:
        start[i : i + k], stop[i : i + k], known[i : i + k] = t_in[j : j + k], t_out[j : j + k], True
    fixed = np.flatnonzero(known)
    left, right = np.concatenate([[-1], fixed]), np.concatenate([fixed, [n]])
    for lo, hi in zip(left[right - left > 1].tolist(), right[right - left > 1].tolist()):
        a = stop[lo] if lo >= 0 else 0.0
        b = max(a, start[hi] if hi < n else duration)
        edge = a + (b - a) * np.concatenate([[0], np.cumsum(size[lo + 1 : hi])]) / size[lo + 1 : hi].sum()
        start[lo + 1 : hi], stop[lo + 1 : hi] = edge[:-1], edge[1:]
    clear = 0.0
    for i in range(n):
        start[i] = max(start[i], clear)
        clear = stop[i] = max(stop[i], start[i] + least)
    if duration > 0:
        wall = duration
        for i in range(n - 1, -1, -1):
            if stop[i] <= wall:
                break
            stop[i] = wall
            wall = start[i] = max(min(start[i], wall - least), 0.0)
    return start, stop, known


def align_words(script: DataFrame, heard: DataFrame, durations: DataFrame, least: float = 0.04) -> DataFrame:
    """ALIGNED: script words (job_id, ix, text) with times from heard words that match in order; others share the time between by length.

    Anchors are the longest run of words that both have, then the longest before and after it, and so on (alignment.common_runs). Times never overlap, no word is
    shorter than `least`, and a crowded tail gives way before the recording's end.
    """

    def run(batches):
        for b in batches:
            pairs = _Pairs(b, "s", "h")
            size = np.maximum(np.asarray(pc.utf8_length(pc.struct_field(pairs.words[0], "key"))), 1).astype(float)
            t_in, t_out = (np.asarray(pc.struct_field(pairs.words[1], f)) for f in ("t_in", "t_out"))
            duration, found = np.asarray(b.column("duration").fill_null(0.0)), []
            for row in range(b.num_rows):
                (s0, s1), (h0, h1) = ((s[row], s[row + 1]) for s in pairs.begin)
                found.append(_times(size[s0:s1], alignment.common_runs(*pairs.of(row)), t_in[h0:h1], t_out[h0:h1], duration[row], least))
            if not found:
                continue
            start, stop, known = (np.concatenate(x) for x in zip(*found))
            jobs = b.column("job_id").take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(pairs.begin[0]))))
            text, ix = (pc.struct_field(pairs.words[0], f) for f in ("text", "ix"))
            yield pa.RecordBatch.from_arrays([jobs, ix.cast(pa.int32()), text, pa.array(start), pa.array(stop), pa.array(known)], names=["job_id", "ix", "text", "t_in", "t_out", "anchored"])

    key = alignment_key(F.col("text"))
    s = script.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ix", "text", key.alias("key")))).alias("s"))
    j = s.join(_arrays(heard, "h", key), "job_id", "left").join(durations, "job_id")
    return j.select(F.col("job_id").cast("long").alias("job_id"), "s", "h", F.col("duration").cast("double").alias("duration")).mapInArrow(run, ALIGNED)
