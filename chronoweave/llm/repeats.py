"""Repeated windows of fixed length, resolved from sparse anchors by recursion on what is still undecided.

An anchor is a place in a document that every equal window shares at the same offset. It stands for a run of
windows, so few tuples are sorted. A tuple is (a, b, doc, pos): a names the anchor's own text, b the text of its whole run of windows,
pos packs where the anchor is and how far its run reaches to both sides. Tuples are dealt by a and sorted externally
by Spark; one pass over the sorted tuples then settles most runs:

- no other tuple has this a: no window of the run is repeated;
- an earlier tuple has the same a and b: every window of the run is repeated;
- others have this a but another b: undecided.

Undecided runs go down a level: their windows in groups of a few neighbouring offsets, then single windows. All names
are hashes of exact text with 128 bits together; whatever the group's size, the pass keeps one tuple.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, ramp, slices, stash, with_own
from .rolling import mix

TUPLES = "a long, b long, doc long, pos long, done boolean, more binary"
#: Bytes of text that a task looks at together.
SLICE = 1 << 19
#: Undecided runs that a task cuts up together.
RUNS = 1 << 11


def pack_pos(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Anchor at `at`; its run is the windows that start from at - left to at + right."""
    return at.astype(np.int64) << 16 | left.astype(np.int64) << 8 | (right.astype(np.int64) + 128)


def unpack_pos(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the run's windows."""
    at = pos >> 16
    return at - (pos >> 8 & 0xFF), at + (pos & 0xFF) - 128


def tuples(a, b, doc, pos, done=None, more=None) -> pa.RecordBatch:
    signed = lambda x: pa.array(x.view(np.int64))
    n = len(a)
    return pa.RecordBatch.from_arrays([signed(a), signed(b), pa.array(doc), pa.array(pos), pa.array(np.zeros(n, bool) if done is None else done), pa.nulls(n, pa.binary()) if more is None else more], names=["a", "b", "doc", "pos", "done", "more"])


def settled_here(a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of tuples in (doc, pos) order: which need not be sorted, since an earlier one here is equal; which are repeated for sure."""
    if len(a) < 2 or (np.diff(doc) < 0).any():
        none = np.zeros(len(a), bool)
        return none, none
    key = a ^ mix(b)
    order = np.argsort(key, kind="stable")
    i, j = order[1:], order[:-1]
    same = np.concatenate([[False], (a[i] == a[j]) & (b[i] == b[j]) & ((doc[i] != doc[j]) | (pos[i] != pos[j]))])
    later, sure = np.zeros(len(a), bool), np.zeros(len(a), bool)
    later[order] = same
    sure |= later
    if both:
        sure[order[:-1]] |= same[1:]
    return later, sure


def settling(both: bool) -> Callable:
    """The function over batches that settles tuples dealt by a and sorted by (a, b, doc, pos). done: the run's windows are repeated. Otherwise undecided.

    both: a window is repeated if an equal one stands anywhere else; else only if an equal one stands earlier. Tuples at one
    place are one. The first tuple of each b stays in play where there are several b, as what later windows may be equal to.
    """

    def settle(batches):
        held = None
        was_multiple = False
        for batch in batches:
            done = np.asarray(batch.column("done"))
            if done.any():
                yield batch.filter(pa.array(done))
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            a, b, doc, pos = (np.asarray(t.column(c)) for c in ("a", "b", "doc", "pos"))
            new_a = np.concatenate([[True], a[1:] != a[:-1]])
            new_b = new_a | np.concatenate([[True], b[1:] != b[:-1]])
            i = np.arange(len(a))
            first = np.maximum.accumulate(np.where(new_b, i, 0))
            later = (doc != doc[first]) | (pos != pos[first])
            group = np.cumsum(new_a) - 1
            several = np.bincount(group, new_b) > 1
            several[0] |= was_multiple and held is not None and a[0] == held.column("a")[0].as_py()
            hit = later.copy()
            if both:
                hit[first[later]] = True
            out = np.flatnonzero(hit)
            if len(out):
                r = t.take(pa.array(out))
                yield tuples(*(np.asarray(r.column(c)) for c in ("a", "b", "doc", "pos")), np.ones(len(out), bool))
            open_ = np.flatnonzero(new_b & several[group])
            if len(open_):
                yield t.take(pa.array(open_))
            held, was_multiple = t.slice(int(first[-1]), 1), bool(several[-1])

    return settle


def dealt(t: DataFrame) -> DataFrame:
    return t.repartition("a").sortWithinPartitions("a", "b", "doc", "pos")


def removed_runs(docs: DataFrame, window: int, step: int, anchors: Callable, sequence: Callable, name: Callable, both: bool) -> DataFrame:
    """doc, runs: for every document with repeated windows, their packed (first, last) starts as int32 pairs.

    anchors(batches) yields tuples; sequence(texts) gives (numbers or bytes of all texts, each text's bounds), and name(values, starts, ends,
    seed) names stretches of them. step: so many neighbouring offsets go together on the second level. docs: doc_id (no nulls), text.
    """
    first = stash(dealt(docs.mapInArrow(anchors, TUPLES)).mapInArrow(settling(both), TUPLES).select("doc", "pos", "done"), "runs")
    open_ = first.where("NOT done").groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("open"))

    def finer(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                data, bounds = sequence(batch.column("text"))
                lists = batch.column("open")
                n_open = np.asarray(lists.value_lengths())
                bases = np.repeat(bounds[:-1], n_open)
                docs = np.repeat(np.asarray(batch.column("doc_id")), n_open)
                all_pos = np.asarray(lists.flatten())
                for part in range(0, len(all_pos), RUNS):
                    base, doc, pos = (x[part : part + RUNS] for x in (bases, docs, all_pos))
                    lo, hi = unpack_pos(pos)
                    at = pos >> 16
                    # groups of `step` offsets from the anchor: offset o = at - start, group o // step
                    g_first, g_last = (at - hi) // step, (at - lo) // step
                    n = g_last - g_first + 1
                    rep = lambda x: np.repeat(x, n)  # noqa: E731, B023
                    g = ramp(n) + rep(g_first)
                    top, low = rep(at) - g * step, rep(at) - g * step - (step - 1)  # all starts of the group
                    s0, s1 = np.maximum(low, rep(lo)), np.minimum(top, rep(hi))
                    off = rep(base)
                    core = name(data, off + top, off + low + window, 3) + g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    union = mix(name(data, off + s0, off + s1 + window, 4) + (top - s1).astype(np.uint64) * np.uint64(64) + (s0 - low).astype(np.uint64))
                    # the names of its single windows, for the last level
                    starts = s0[:, None] + np.arange(step)
                    inside = starts <= s1[:, None]
                    single = np.zeros(starts.shape, np.uint64)
                    x = (off[:, None] + starts)[inside]
                    single[inside] = name(data, x, x + window, 4)
                    more = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * step), len(g), [None, pa.py_buffer(np.ascontiguousarray(single).tobytes())]).cast(pa.binary())
                    yield tuples(mix(core), union, rep(doc), pack_pos(s0, np.zeros(len(g)), s1 - s0), None, more)

    groups = dealt(docs.join(open_.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "open").mapInArrow(finer, TUPLES))

    def singles(batches):
        for b in batches:
            done = np.asarray(b.column("done"))
            if done.any():
                yield b.filter(pa.array(done))
            b = b.filter(pa.array(~done))
            if not b.num_rows:
                continue
            names = np.frombuffer(b"".join(b.column("more").to_pylist()), np.uint64).reshape(-1, step)
            lo, hi = unpack_pos(np.asarray(b.column("pos")))
            starts = lo[:, None] + np.arange(step)
            inside = starts <= hi[:, None]
            rows = np.nonzero(inside)[0]
            at = starts[inside]
            zero = np.zeros(len(at))
            a = mix(names[inside] ^ np.asarray(b.column("a")).view(np.uint64)[rows])
            yield tuples(a, names[inside], np.asarray(b.column("doc"))[rows], pack_pos(at, zero, zero))

    # one worker a task settles and cuts up: each worker beside another costs an executor 100 to 200 MB
    settle = settling(both)
    third = dealt(groups.mapInArrow(lambda batches: singles(settle(batches)), TUPLES)).mapInArrow(settle, TUPLES)
    done = first.where("done").select("doc", "pos").union(third.where("done").select("doc", "pos"))
    # unpack_pos, in columns
    run = F.expr("shiftleft(shiftright(pos, 16) - (shiftright(pos, 8) & 255), 32) | (shiftright(pos, 16) + (pos & 255) - 128)")
    return done.select("doc", run.alias("run")).groupBy("doc").agg(F.collect_set("run").alias("runs"))


def cover(runs: np.ndarray, window: int, n: int) -> tuple[np.ndarray, int]:
    """Of n positions, which any window of the runs covers; how many maximal covered stretches there are."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, runs >> 32, 1)
    np.add.at(step, (runs & 0xFFFFFFFF) + window, -1)
    covered = np.cumsum(step[:-1]) > 0
    return covered, int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())


def identified(docs: DataFrame) -> tuple[DataFrame, Callable]:
    """doc_id (a long in the order of the ids, without nulls) and texts without nulls; and what gives the ids back to a result."""
    own, names = with_own(docs.select("doc_id", "text"))
    out = own.select(F.col("__own").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if names is None:
        return out, lambda rows: rows.withColumn("doc_id", F.when(F.col("doc_id") >= NO_ID, F.col("doc_id")))

    def named(rows: DataFrame) -> DataFrame:
        columns = rows.columns
        return rows.withColumnRenamed("doc_id", "__own").join(names, "__own").select(*columns)

    return out, named


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    return docs.join(runs.withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "text", "runs")
