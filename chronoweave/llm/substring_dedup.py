"""Repeated word sequences: every word that a window of 35 words covers which also starts elsewhere is removed.

Fixed-block anchors. Reference blocks are the non-overlapping blocks of 18 words of each document; a window of 35 words holds a
whole one of its own document, wherever it starts. The blocks are indexed; every rolling window of 18 words
of every document probes the index. Blocks and hits that are equal meet, and the windows around them are compared as maximal runs,
then in ever smaller groups (repeats.py), so a block with many hits makes no pairs.

A filter of fixed size, built from all blocks, keeps most probes that hit nothing from being sorted. It may
let a miss through, never hold a hit back; a corpus that fills it only sorts more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffer_of, slices
from .repeats import SLICE, cover, identified, pack_pos, removed_runs, settled_here, tuples, with_runs
from .rolling import cut_long, each, mix, of_bytes, of_numbers, words

#: Bits of the filter: 16 MB, whatever the corpus.
FILTER_BITS = 27
#: Offsets that stay together on the second level.
STEP = 6


def word_names(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal words equal, and each text's bounds among them."""
    data, bounds = buffer_of(column)
    start, end, first = words(data, bounds)
    return of_bytes(data, start, end, 7), first


def _grams(word: np.ndarray, bounds: np.ndarray, window: int, block: int, skipped: int):
    """Of texts with a window: places, owners and names of all blocks of words; which are reference blocks."""
    name = each(word, block)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(name)]
    at = np.arange(len(name))
    ok = (at + block <= bounds[owner + 1]) & (bounds[owner + 1] - bounds[owner] >= window) if len(name) else np.zeros(0, bool)
    at, owner, name = at[ok], owner[ok], name[ok]
    return at, owner, name, (at - bounds[owner] + skipped) % block == 0


def _bits(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    down = np.uint64(64 - FILTER_BITS)
    return name >> down, (name * np.uint64(0x9E3779B97F4A7C15)) >> down


def index_filter(docs: DataFrame, window: int, block: int) -> np.ndarray:
    """The filter of all reference blocks: 2**FILTER_BITS bits."""

    def bits(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                for word, bounds, skipped in cut_long(*word_names(batch.column("text")), SLICE, window - 1):
                    *_, name, reference = _grams(word, bounds, window, block, skipped)
                    x = np.unique(np.concatenate(_bits(name[reference])))
                    if len(x):
                        cell, first = np.unique(x >> np.uint64(6), return_index=True)
                        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (x & np.uint64(63)), first).view(np.int64))], names=["cell", "bits"])

    got = docs.select("text").mapInArrow(bits, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(got.column("cell"))] = np.asarray(got.column("bits"))
    return out.view(np.uint8)


def remove_repeats(docs: DataFrame, window: int = 35, with_kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space); with_kept: that text, too.

    Words are what stands between space and \\t to \\r; a null text has none. Windows lie within one document and are judged on
    the input. Rows with one doc_id are one document, and rows without one that have equal texts: equal windows at the same place of it
    are one. Texts may be of any length; an empty table gives no rows.
    """
    block = (window + 1) // 2
    if not 12 <= window <= 127:
        raise ValueError("windows of 12 to 127 words")
    docs, named = identified(docs)
    known = docs.sparkSession.sparkContext.broadcast(index_filter(docs, window, block))

    def anchors(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                for word, bounds, skipped in cut_long(*word_names(batch.column("text")), SLICE, window - 1):
                    at, owner, name, reference = _grams(word, bounds, window, block, skipped)
                    x, y = _bits(name)
                    full = known.value
                    hit = (full[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & (full[(y >> np.uint64(3)).astype(np.int64)] >> (y & np.uint64(7)).astype(np.uint8)) & 1
                    use = np.flatnonzero(reference | (hit == 1))
                    at, owner, name = at[use], owner[use], name[use]
                    lo = np.maximum(bounds[owner], at - (window - block))
                    hi = np.minimum(at, bounds[owner + 1] - window)
                    doc, base = np.asarray(batch.column("doc_id"))[owner], bounds[owner] - skipped
                    b = mix(of_numbers(word, lo, hi + window, 2) + (at - lo).astype(np.uint64))
                    pos = pack_pos(at - base, at - lo, hi - at)
                    later, sure = settled_here(name, b, doc, pos, True)
                    yield tuples(name[~later], b[~later], doc[~later], pos[~later])
                    yield tuples(mix(doc[sure].view(np.uint64)), b[sure], doc[sure], pos[sure], np.ones(int(sure.sum()), bool))

    runs = removed_runs(docs, window, STEP, anchors, word_names, of_numbers, both=True)

    def assemble(batches):
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text, run in zip(batch.column("text").to_pylist(), batch.column("runs")):
                    w = text.encode().split()
                    n, removed = len(w), 0
                    if run.is_valid:
                        covered, _ = cover(np.asarray(run.values), window, n)
                        removed = int(covered.sum())
                        w = [x for x, c in zip(w, covered.tolist()) if not c]
                    kept = b" ".join(w)
                    out.append((n, removed, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return named(with_runs(docs, runs).mapInArrow(assemble, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"))
