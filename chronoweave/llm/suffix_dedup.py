"""Repeated byte strings: every byte that a string of 100 bytes covers which also starts earlier is removed.

This takes the place of external induced sorting, which can't meet the disk budget (README.md has the figures): no suffix array is made
and no common-prefix values are kept. What is left of the idea is that few places are sorted and all others follow from them. Each window of
100 bytes has a sample, the leftmost smallest of the hashes of its KMER-byte strings, so equal windows have the same sample at the same
offset. One tuple stands for a run of neighbouring windows with one sample; tuples are grouped by Spark's external shuffle and sort, and
only what a level leaves undecided is named anew with longer strings (repeats.py).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffer_of, slices
from .repeats import SLICE, cover, identified, pack_pos, removed_runs, settled_here, tuples, with_runs
from .rolling import cut_long, each, eights, mix, of_bytes

KMER = 32
#: Offsets that stay together on the second level.
STEP = 8


def sampled_runs(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, first, last): each run of neighbouring windows, by start, that have the same sample. Windows lie within one text."""
    n = len(data) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    valid = np.zeros(n, bool)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        valid[s : max(s, e - window + 1)] = True
    span = window - KMER + 1  # k-mers in a window
    low_bits = np.uint64((1 << 17) - 1)
    at = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 16):  # what a processor's cache holds
        some = each(data[lo : lo + (1 << 16) + window - 1], KMER)
        # the smallest hash wins, the leftmost of equal ones
        low, have = some & ~low_bits | np.arange(len(some), dtype=np.uint64), 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        at[lo : lo + len(low)] = (low & low_bits).astype(np.int64) + lo
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none
    at = at[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(start) > 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return at[first], start[first], start[last]


def remove_repeats(docs: DataFrame, window: int = 100, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256; with_kept: the bytes that stay, too.

    Texts are UTF-8 bytes, a null is empty; windows never cross documents and are judged on the input. Earlier means a smaller doc_id,
    or an earlier start in the same one. Rows with one doc_id are one document for this order, so repeated rows do not remove each other;
    rows with a null doc_id are documents of their own below all others, in a fixed order, equal texts among them one. Texts may be of
    any length; an empty table gives no rows.
    """
    if not KMER + STEP < window < 160 + KMER:
        raise ValueError("windows of 41 to 191 bytes")

    def anchors(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                for data, bounds, skipped in cut_long(*buffer_of(batch.column("text")), SLICE, window - 1):
                    at, lo, hi = sampled_runs(data, bounds, window)
                    owner = np.searchsorted(bounds, at, side="right") - 1
                    doc, base = np.asarray(batch.column("doc_id"))[owner], bounds[owner] - skipped
                    view = eights(data)
                    a = of_bytes(data, at, at + KMER, 1, view)
                    b = mix(of_bytes(data, lo, hi + window, 2, view) + (at - lo).astype(np.uint64))
                    pos = pack_pos(at - base, at - lo, hi - at)
                    later, sure = settled_here(a, b, doc, pos, False)
                    a = np.where(later, mix(doc.view(np.uint64)), a)
                    yield tuples(a, b, doc, pos, sure)

    docs, named = identified(docs)
    runs = removed_runs(docs, window, STEP, anchors, buffer_of, of_bytes, both=False)

    def assemble(batches):
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text, run in zip(batch.column("text").to_pylist(), batch.column("runs")):
                    raw = text.encode()
                    removed, spans = 0, 0
                    kept = raw
                    if run.is_valid:
                        covered, spans = cover(np.asarray(run.values), window, len(raw))
                        removed = int(covered.sum())
                        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                    out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return named(with_runs(docs, runs).mapInArrow(assemble, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
