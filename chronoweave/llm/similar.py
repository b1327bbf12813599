"""Near copies at a similarity: SimHash fingerprints and MinHash bands find most of them, rare shingles the rest, the sets of word shingles decide.

A text is the set of its shingles of five words (A-Z in lower case). Texts whose sets have a Jaccard similarity of 0.8 or more are
linked. Equal sets are one before any join. Texts that share a band meet as its smallest and largest member with each other, so
that a band that very many texts share makes no pairs of all with all; each pair is then verified on the whole sets. What these
selections leave apart meets by its rarest shingles (_missed), which is exact: no component that links of 0.8 connect stays in two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import simhash
from .common import Scratch, buffer_of, keep_firsts, keep_ids, ramp, slices, stash, texts
from .components import components
from .rolling import each, mix, of_bytes, of_numbers, words

SHINGLE = 5
#: A pair of similarity 0.8 shares one of 20 bands of 5 minima with probability 0.9996.
BANDS, ROWS = 20, 5
_ODD, _ADD = np.random.default_rng(8).integers(1, 2**64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles, sorted, and the texts' bounds. A text of fewer words is one shingle; one without words has none."""
    data, bounds = buffer_of(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    start, end, first = words(data, bounds)
    word, n = of_bytes(data, start, end), np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    five = each(word, SHINGLE, 11)
    at = np.flatnonzero(owner[: 1 - SHINGLE] == owner[SHINGLE - 1 :]) if len(owner) >= SHINGLE else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    h = np.concatenate([five[at], of_numbers(word, first[short], first[short + 1], 11)])
    owner = np.concatenate([owner[at], short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def _names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]])


def _bands(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS numbers for each text that has shingles, one row each."""
    begin = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(begin), BANDS), np.uint64)
    if len(begin):
        for k in range(BANDS * ROWS):
            band = out[:, k // ROWS]
            band[:] = mix(np.minimum.reduceat(h * _ODD[k] + _ADD[k], begin) + band * np.uint64(3) + np.uint64(k))
    return out


def _fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A SimHash of each set of shingles: the bits that more than half of the shingles' hashes have."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    have = np.flatnonzero(np.diff(bounds) > 0)
    if len(have):
        begin, half = bounds[:-1][have], np.diff(bounds)[have]
        for k in range(64):
            ones = np.add.reduceat((h >> np.uint64(k) & np.uint64(1)).astype(np.int64), begin)
            out[have] |= (2 * ones > half).astype(np.uint64) << np.uint64(k)
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, name (of the set), n (its size), fp (its SimHash), bands (none if the set is empty)."""

    def compute(batches):
        for whole in batches:
            for b in slices(whole):
                h, bounds = shingle_sets(b.column("text"))
                have = np.diff(bounds) > 0
                offsets = np.concatenate([[0], np.cumsum(have * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_bands(h, bounds).ravel().view(np.int64)))
                prints = pa.array(_fingerprints(h, bounds).view(np.int64))
                size = pa.array(np.diff(bounds).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_names(h, bounds).view(np.int64)), size, prints, bands], names=["doc_id", "name", "n", "fp", "bands"])

    return texts(docs).mapInArrow(compute, "doc_id long, name long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """name, shingles."""

    def compute(batches):
        for whole in batches:
            for b in slices(whole):
                h, bounds = shingle_sets(b.column("text"))
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_names(h, bounds).view(np.int64)), sets], names=["name", "shingles"])

    return texts(docs).mapInArrow(compute, "name long, shingles array<long>")


def _postings(docs: DataFrame, begin: bool = False) -> DataFrame:
    """name, s: each shingle of each set (begin: of its n shingles the smallest n - ceil(0.8 n) + n // 10 + 1 only)."""

    def compute(batches):
        for whole in batches:
            for b in slices(whole):
                h, bounds = shingle_sets(b.column("text"))
                n = np.diff(bounds)
                names = np.repeat(_names(h, bounds), n)
                if begin:
                    first = ramp(n) < np.repeat(n - (4 * n + 4) // 5 + n // 10 + 1, n)
                    names, h = names[first], h[first]
                for at in range(0, len(h), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in (names, h)], names=["name", "s"])

    return texts(docs).mapInArrow(compute, "name long, s long")


def _missed(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of all sets (name, head, n, root): every link (a, b) of similarity 0.8 or more between names of different roots.

    The sets of such a pair share 0.8 of the larger one's shingles. So in any order that is the same for all sets, the first n - ceil(0.8 n) + t shingles of the one and of the other have
    t in common, for any t. By their size, with t = n // 10 + 1, that tells which sets can have a partner at all: those that share that many of their first ones (as many as the smallest partner has to) with anybody.
    Of these, shingles of one root only come first: they meet nobody, and a set with enough of them is done. The others follow, the rarest first, with t = 1. They are
    all that such a pair can share, so they decide without the texts. Pairs that meet are as many as sets of different roots that share their rarest shingles: few, unless very many sets are
    made of the same frequent shingles and yet are no copies.
    """
    by = Window.partitionBy("s")
    several = lambda c: F.min(c).over(by) != F.max(c).over(by)
    least = F.ceil(4 * F.col("n") / 5)
    some = _postings(docs, begin=True).withColumn("several", several("name")).where("several").select("name", "s").distinct().groupBy("name").count()
    asked = stash(sets.join(some, "name").where(F.col("count") >= F.floor(least / 10) + 1).select("name", "head", "n", "root"), "asked")
    heads = asked.select(F.col("head").alias("doc_id")).distinct()
    seen = _postings(keep_ids(texts(docs), heads)).select("name", "s", F.count("*").over(by).alias("c"), several("name").alias("several")).where("several")
    held = seen.groupBy("name").agg(F.collect_set(F.struct("c", "s")).alias("w")).join(asked, "name").where(F.size("w") >= least)
    held = stash(held.select("name", "n", "root", "w"), "held")
    seen = held.select("name", "root", F.explode("w").alias("x")).select("name", "root", "x.*").withColumn("several", several("root")).where("several")
    left = seen.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("w"))
    left = left.join(held.select("name", "n", "root"), "name").where(F.size("w") >= least)
    left = stash(left.select("name", "n", "root", F.size("w").alias("k"), F.transform("w", lambda x: x["s"]).alias("w")), "left")
    # n - k shingles come before those in w
    firsts = left.select("name", "n", "root", "k", F.explode(F.slice("w", F.lit(1), (F.col("k") - least + 1).cast("int"))).alias("s"))
    x, y = (firsts.select("s", *(F.col(c).alias(c + i) for c in ("name", "n", "root", "k"))) for i in "xy")
    fits = (F.col("namex") < F.col("namey")) & (F.col("rootx") != F.col("rooty")) & (9 * F.least("kx", "ky") >= 4 * (F.col("nx") + F.col("ny")))
    pairs = stash(x.join(y, "s").where(fits).select(F.col("namex").alias("a"), F.col("namey").alias("b")).distinct(), "met")
    half = stash(pairs.join(left.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("w").alias("x")), "a"), "met-halves")
    both = half.join(left.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("w").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def near_copies(docs: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of similarity 0.8 or more reach, its own included.

    Candidates are texts whose SimHash differs in `bits` bits at most and texts that share a band, then texts that are still apart and share their rarest shingles, which leaves none out; every one is verified on the whole sets, so
    nothing is linked by fingerprints alone.

    Texts without words are copies of each other. Repeated rows stay; a null doc_id gets a component but names none. An empty table gives no rows.
    """
    with Scratch() as s:
        each = s.keep(stash(_sketches(docs), "sketches"))
        distinct = stash(each.groupBy("name").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "sets")
        filled = distinct.where(F.size("bands") > 0)
        # equal fingerprints meet like those that share a band
        visits = filled.select("name", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("fp"), "fp")))).alias("band"))
        ends = visits.groupBy("band").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi")
        met = visits.join(ends, "band").select("name", F.explode(F.array("lo", "hi")).alias("other")).where("name <> other")
        prints = stash(filled.groupBy("fp").agg(F.min("name").alias("name")), "prints")
        alike = simhash.links(prints.select("fp"), bits, trees=False)
        alike = alike.join(prints.select(F.col("fp").alias("a"), "name"), "a").join(prints.select(F.col("fp").alias("b"), F.col("name").alias("other")), "b")
        both = met.select("name", "other").unionByName(alike.select("name", "other"))
        pairs = stash(both.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct(), "pairs")
        # the whole sets: only of the texts in question
        asked = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        heads = distinct.join(asked, "name").select(F.col("head").alias("doc_id")).distinct()
        sets = stash(_sets(keep_ids(texts(docs), heads)).dropDuplicates(["name"]), "shingles")
        # written between the joins, so that each is of two plain shuffles, whose hot texts Spark may split
        half = stash(pairs.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x"), "halves")
        shared = F.size(F.array_intersect("x", "y"))
        links = half.join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b").where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
        found = components(links).withColumnRenamed("node", "name")
        rooted = filled.select("name", "head", "n").join(found, "name", "left").select("name", "head", "n", F.coalesce("root", "name").alias("root"))
        missed = _missed(docs, rooted)
        # each name hangs on its root, so the links found at first need not be gone through again
        tree = components(found.select(F.col("name").alias("a"), F.col("root").alias("b")).unionByName(missed)).withColumnRenamed("node", "name")
        least = distinct.select("name", "head").join(tree, "name").groupBy("root").agg(F.min("head").alias("least"))
        named = s.keep(stash(distinct.select("name", "head").join(tree.join(least, "root").select("name", "least"), "name", "left").select("name", F.coalesce("least", "head").alias("component_id")), "heads"))
    return each.join(named, "name").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents less all but the first (smallest doc_id) of each group; the columns stay as they are. Rows with one doc_id are one document;
    rows without one are documents of their own after all others, equal texts among them one. An empty table gives no rows."""
    return keep_firsts(docs, near_copies)
