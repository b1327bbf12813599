"""Near-duplicates by SimHash: segment-popcount embedding, grid range-join, exact verification.

A fingerprint's 64 bits are 32 segments of two bits; each segment's count of set bits (0, 1 or 2) is one coordinate. The
Manhattan distance of two such points is never more than the Hamming distance of their fingerprints. Within
distance 3, one half of the coordinates (16 of 32) is at distance 0 or 1, so the grid's cells are the points of a half, and a
fingerprint visits its own cell and those one step up. Fingerprints that meet in a cell are verified on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, keep_firsts, slices, stash, texts
from .components import components

#: A cell with more fingerprints than this is dealt out in blocks, each two of which meet in one group.
BLOCK = 1024
_PAIRS = 0x5555555555555555


def _fingerprint(data: bytes, shingle: int, digest) -> int:
    words = data.lower().split()  # bytes: only A-Z change, and only space and \t-\r separate
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    begin = (ends - size)[: len(words) - shingle + 1].tolist()
    end = (ends - 1)[shingle - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for lo in range(0, len(begin), 1 << 16):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(begin[lo : lo + (1 << 16)], end[lo : lo + (1 << 16)])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: a bit is set if it is in more than half of the XXH64 of all the text's shingles of words.

    A text of fewer words is one shingle; one without words (or null) has fingerprint 0.
    """

    def compute(batches):
        import xxhash

        for whole in batches:
            for batch in slices(whole):
                fp = [_fingerprint((x or "").encode(), shingle, xxhash.xxh64_intdigest) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(compute, "doc_id long, fp long")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b reduced to (node, smallest node of its component here): at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (old == label).all():
            break
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _met(groups: np.ndarray, fp: np.ndarray, bits: int):
    """(i, i + d) of rows of equal group within so many bits, for d = 1, 2, ...; the rows are sorted by group, and go as far as the groups reach."""
    i, d = np.arange(len(fp) - 1), 1
    while len(i):
        i = i[i + d < len(fp)]
        i = i[groups[i] == groups[i + d]]
        near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
        if len(near):
            yield near, near + d
        d += 1


def _verify(groups: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal group, as stars; so many at a time that a dense group's links are never held together."""
    a = b = np.zeros(0, np.int64)
    held_a, held_b, n = [], [], 0
    for i, j in _met(groups, fp, bits):
        held_a.append(fp[i].view(np.int64))
        held_b.append(fp[j].view(np.int64))
        n += len(i)
        if n > 1 << 20:
            a, b = _stars(np.concatenate([a, *held_a]), np.concatenate([b, *held_b]))
            held_a, held_b, n = [], [], 0
    return _stars(np.concatenate([a, *held_a]), np.concatenate([b, *held_b]))


def _firsts(groups: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first one before it and the first one after it, by distance in the group, within so many bits: links themselves, at most two a row."""
    back, on = np.full(len(fp), -1), np.full(len(fp), -1)
    for i, j in _met(groups, fp, bits):
        back[j] = np.where(back[j] < 0, i, back[j])
        on[i] = np.where(on[i] < 0, j, on[i])
    rows = np.arange(len(fp))
    a, b = np.concatenate([rows[back >= 0], rows[on >= 0]]), np.concatenate([back[back >= 0], on[on >= 0]])
    return fp[a].view(np.int64), fp[b].view(np.int64)


def links(prints: DataFrame, bits: int = 3, trees: bool = True) -> DataFrame:
    """Of distinct fingerprints fp: links (a, b) at 3 or fewer differing bits, as trees that connect all that all such links connect. Without trees
    each pair is within the bits itself, to be verified further: for each fingerprint the next ones in every cell (a selection, not all)."""
    if bits > 3:
        raise ValueError("cells one step apart find all links up to 3 bits only")
    x, y = F.col("fp").bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_PAIRS))
    e = x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))  # each two bits: how many are set
    cells = []
    for half in (0, 1):
        c = F.shiftrightunsigned(e, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        own = F.struct((c * 2 + half).alias("cell"), F.lit(True).alias("own"))
        up = [F.when(F.shiftrightunsigned(c, 2 * i).bitwiseAND(F.lit(3)) < 2, F.struct(((c + (1 << 2 * i)) * 2 + half).alias("cell"), F.lit(False).alias("own"))) for i in range(16)]
        cells += [own, *up]
    # few bytes become many rows here, so the rows are dealt out in full first, by another key than the one they came grouped by
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.lit("deal"), "fp"))
    visits = prints.select("fp", F.explode(F.array_compact(F.array(*cells))).alias("v")).select("fp", "v.cell", "v.own")
    # cells where somebody lives and somebody else comes by; large ones in blocks
    full = visits.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("lived_in")).where("n > 1 AND lived_in")
    met = visits.join(full.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cell")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("fp", "cell", mine.alias("i"), other.alias("j")).select("fp", F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("g"))

    find = _verify if trees else _firsts

    def verify(batches):
        held_g, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            g = np.concatenate([held_g, np.asarray(b.column("g"))])
            fp = np.concatenate([held_fp, np.asarray(b.column("fp")).view(np.uint64)])
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            a, c = find(g[:whole], fp[:whole], bits)
            held_g, held_fp = g[whole:], fp[whole:]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])
        a, c = find(held_g, held_fp, bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(verify, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, its own included.

    Equal fingerprints are one before any join, so copies cost no pairs. Texts without words have fingerprint 0 and
    link like any other; repeated rows stay; a null doc_id gets a component but names none. An empty table gives no rows.
    """
    with Scratch() as s:
        each = s.keep(stash(fingerprints(docs, shingle), "fingerprints"))
        distinct = stash(each.groupBy("fp").agg(F.min("doc_id").alias("head")), "distinct")
        tree = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
        least = distinct.join(tree, "fp").groupBy("root").agg(F.min("head").alias("least"))
        named = tree.join(least, "root").select("fp", "least")
        # written, so that the last join is of two plain shuffles, whose hot fingerprints Spark may split
        heads = s.keep(stash(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "head").alias("component_id")), "heads"))
    return each.join(heads, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """The documents less all but the first (smallest doc_id) of each group; the columns stay as they are. Rows with one doc_id are one document;
    rows without one are documents of their own after all others, equal texts among them one. An empty table gives no rows."""
    return keep_firsts(docs, lambda d: near_duplicates(d, shingle, bits))
