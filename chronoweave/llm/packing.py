"""Best-fit packing of documents into token sequences, after Martello-Toth dominance reduction.

The instance is the histogram of piece lengths, never longer than the sequence length, whatever the
corpus. Sets that provably dominate every alternative for one of their items are fixed first; best-fit
decreasing packs what is left. The plan says, for the k-th piece of each length, which
sequence and offset it gets; Spark numbers the pieces of each length and looks their places up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, stash, texts
from .tokens import encoder, vocabulary

#: The pieces of one length are numbered in groups of about so many, so that no length needs one task.
GROUP = 100_000


def pieces(docs: DataFrame, sequence: int = 2048, end_id: int = 0, vocab: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. A null or empty text is the end id alone."""
    vocab = vocab or vocabulary()

    def cut(batches):
        for whole in batches:
            for batch in slices(whole):
                ids, at = encoder(vocab).encode(batch.column("text"))
                rows = []
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    edges = [0, *range(len(own) % sequence or sequence, len(own) + 1, sequence)]
                    rows += [(doc, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Slot s holds pieces number first[s]..first[s] + times[s] - 1 of its length, in sequences base[s]..., at offset[s]. Sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    n_sequences: int
    n_fixed: int


def _dominating(left: np.ndarray, w: int, size: int) -> tuple[list[int], int] | None:
    """The set of at most three lengths that dominates all others with w, and how many times it may be fixed; None where there is none."""
    room = size - w
    others = left[: room + 1].copy()
    if w <= room:
        others[w] -= 1
    present = np.flatnonzero(others)
    alone = int(left[w]) if 2 * w > size else 1
    if not len(present):
        return [w], alone
    longest = int(present[-1])
    times = lambda *xs: min([alone, *(int(others[x]) // xs.count(x) for x in xs)])
    if longest == room:
        return [w, longest], times(longest)
    small = np.repeat(present[:3], np.minimum(others[present[:3]], 3))[:3]
    if len(small) < 2 or small[:2].sum() > room:
        return [w, longest], times(longest)
    if len(small) == 3 and small.sum() <= room:
        return None
    # two fit, not three: the best two, a >= b
    a = present
    b = np.searchsorted(present, np.minimum(a, room - a), side="right") - 1
    ok = (b >= 0) & ((present[b] != a) | (others[a] > 1))
    step = (b > 0) & ~ok
    b, ok = np.where(step, b - 1, b), ok | step
    if not ok.any():
        return [w, longest], times(longest)
    k = int(np.flatnonzero(ok)[np.argmax((a + present[b])[ok])])
    best, second = int(a[k]), int(present[b[k]])
    if longest >= best + second:
        return [w, longest], times(longest)
    longer = present[present > second]
    pair = np.repeat(longer[:2], np.minimum(others[longer[:2]], 2))[:2]
    if best == longest and (len(pair) < 2 or pair.sum() > room):
        return [w, best, second], times(best, second)
    return None


def plan(counts: np.ndarray) -> Plan:
    """counts[l]: how many pieces of length l there are, for l up to the sequence length."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    bins: list[tuple[list[tuple[int, int]], int]] = []  # ((length, how many) of one sequence, so many such sequences)

    def fix(items: list[int], n: int) -> None:
        """Put these lengths into n sequences for good."""
        for x in items:
            left[x] -= n
        bins.append(([(x, 1) for x in items], n))

    # Dominance, after Martello and Toth: a set with w is fixed if every other set with w could trade its pieces for this one's, each for one
    # at least as long. That holds for {w, size - w}; where no two pieces fit beside w, for w and the longest that fits; and where two fit
    # but not three, for w with that piece if no two are longer together, or with the best two, if one of them is the longest that
    # fits and no pair that fits has both longer than the other.
    changed = True
    while changed:
        changed = False
        for w in range(size, 0, -1):
            while left[w]:
                n = _dominating(left, w, size)
                if n is None:
                    break
                fix(*n)
                changed = True
    fixed = sum(n for _, n in bins)

    # Best fit, longest first. Equal half-filled sequences are one entry: room left -> [(content, how many)].
    open_: dict[int, list[tuple[tuple, int]]] = {}
    for w in range(size, 0, -1):
        n = int(left[w])
        while n:
            room = min((r for r in open_ if r >= w), default=None)
            if room is None:
                room, content, m = size, (), n
            else:
                content, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // w  # after one piece the same sequence is still the best fit
            full = min(m, n // each)
            if full:
                open_.setdefault(room - each * w, []).append(((content, w, each), full))
                n -= full * each
                m -= full
            if n and m:
                some = min(n, each)
                open_.setdefault(room - some * w, []).append(((content, w, some), 1))
                n -= some
                m -= 1
            if m and content:
                open_.setdefault(room, []).append((content, m))
    for entries in open_.values():
        for content, m in entries:
            items = []
            while content:
                content, w, k = content
                items.append((w, k))
            bins.append((items[::-1], m))

    used = np.zeros(size + 1, np.int64)
    slots, base = [], 0
    for items, m in bins:
        at = 0
        for w, k in items:
            for _ in range(k):
                slots.append((w, used[w], m, base, at))
                used[w] += m
                at += w
        base += m
    s = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*(s[:, i].copy() for i in range(5)), n_sequences=base, n_fixed=fixed)


def pack(docs: DataFrame, sequence: int = 2048, end_id: int = 0, vocab: str | None = None) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than a sequence are cut; their first piece may be shorter. Repeated rows and rows with a null doc_id are
    documents of their own, a null or empty text is one end id, an empty table gives no rows. Pieces of one length take the places
    for it in the order of a hash, then doc_id and piece. The driver sees the histogram only: a number for each length and for each GROUP pieces.
    """
    cut = stash(pieces(docs, sequence, end_id, vocab), "pieces")
    counts = np.zeros(sequence + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    salts = np.maximum(1, -(-counts // GROUP))
    first = np.cumsum(salts) - salts
    many = {n: int(k) for n, k in enumerate(salts) if k > 1}
    groups = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("length").cast("int")], F.lit(1)) if many else F.lit(1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), groups).cast("int"))
    # one number for each group: the pieces of its length in the groups before it
    hist = np.zeros(int(salts.sum()), np.int64)
    for r in salted.groupBy("length", "salt").count().collect():
        hist[first[r["length"]] + r["salt"]] = r["count"]
    before = np.cumsum(hist) - hist
    before -= np.repeat(before[first], salts)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((plan(counts), first, before))

    def place(batches):
        p, first, base = known.value
        starts = p.length << 44 | p.first
        for b in batches:
            length, salt, number = (np.asarray(b.column(c)) for c in ("length", "salt", "number"))
            k = base[first[length] + salt] + number - 1
            s = np.searchsorted(starts, length << 44 | k, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(p.base[s] + k - p.first[s]), pa.array(p.offset[s])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")).cast("long"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
