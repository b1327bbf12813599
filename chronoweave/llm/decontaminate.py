"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and capitalised words (names) are typed placeholders, everything else is
itself in lower case without the punctuation around it. Windows of tokens are hash-joined with the benchmark's. Where
windows meet, the match is grown along its diagonal, and the slots are compared: the words behind placeholders must be the same as
the benchmark's in a run of a window's length (an exact copy), or replaced one for one throughout (a re-parameterised copy). Anything else is no match.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ramp, slices, stash, texts
from .rolling import each, mix

#: Tokens of a window; a shorter item is one window. Items under SHORTEST tokens are found as exact copies only.
WINDOW, SHORTEST = 13, 6
#: At least this share of a window's tokens are words, not placeholders; other windows meet under their own words, as exact copies only.
LITERAL = 0.5
#: A re-parameterised match must reach over this share of the item.
REPLACED_SHARE = 0.6
#: Benchmarks with up to so many bytes of text are broadcast to the scan (about 20 bytes in a worker for each); beyond, windows are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Words whose tokens a worker remembers.
_MEMORY = 500_000
#: Meetings of windows that are looked at together.
PAIRS = 1 << 20

_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?")
_MEASURE = re.compile(r"[+-]?[0-9][0-9.,]*[a-zµ°]{1,4}")
#: Units (fixed list).
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s min h hz w kw v ms sec second seconds minute minutes hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars euro euros cent cents percent degree degrees".split())
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER, UNIT, NAME, MEASURE = "\0number", "\0unit", "\0name", "\0measure"


def token(word: str) -> str:
    """The template token of a word; '' if it is punctuation only."""
    if not word.isalpha():
        if _NUMBER.fullmatch(word.strip("()[]{}\"'.,;:!?")):
            return NUMBER
        word = _EDGES.sub("", word)
        if not word:
            return ""
        if _NUMBER.fullmatch(word):
            return NUMBER
        if _MEASURE.fullmatch(word):
            return MEASURE
    low = word.lower()
    if low in UNITS:
        return UNIT
    if word[0].isupper():
        return NAME
    return low


def slot(word: str) -> str:
    """What a placeholder stands for."""
    return _EDGES.sub("", word).lower() or word


def _number(t: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(t.encode()) | 1 if t else 0


_known: dict[str, int] = {}


def canonical(some: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(token numbers, each text's bounds, words, which word each token is)."""
    if len(_known) > _MEMORY:
        _known.clear()
    words: list[str] = []
    counts = np.zeros(len(some), np.int64)
    for i, text in enumerate(some):
        w = text.split()
        counts[i] = len(w)
        words += w
    code = list(map(_known.get, words))
    missing = {w for w, c in zip(words, code) if c is None}
    if missing:
        new = {w: _number(token(w)) for w in missing}
        _known.update((w, c) for w, c in new.items() if len(w) < 64)
        code = [new[w] if c is None else c for w, c in zip(words, code)]
    n = np.array(code, np.uint64)
    at = np.flatnonzero(n)
    return n[at], np.searchsorted(at, np.concatenate([[0], np.cumsum(counts)])), words, at


#: Tells names by own words from names by template.
_OWN = 1 << 32
_PLACEHOLDERS = np.array(sorted(map(_number, (NUMBER, UNIT, NAME, MEASURE))), np.uint64)


def windows(number: np.ndarray, bounds: np.ndarray, size: int, words: list[str], word_at: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place, name) of the windows of `size` tokens: named by their template, or by their own words if few are literal. whole: only those that are a whole text."""
    n = len(number) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.ones(n, bool)
    for k in range(1, size):  # not across texts
        cut = bounds[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    literal = np.concatenate([[0], np.cumsum(~np.isin(number, _PLACEHOLDERS))])
    template = (literal[size:] - literal[:-size]) >= LITERAL * size if size >= SHORTEST else np.zeros(n, bool)
    if whole:
        full = np.zeros(n, bool)
        full[bounds[:-1][np.diff(bounds) == size]] = True
        ok &= full
    at = np.flatnonzero(ok)
    name = each(number, size, 11)[at] ^ np.uint64(size)
    mine = ~template[at]
    if mine.any():
        step = np.zeros(len(number) + 1, np.int64)
        step[at[mine]] += 1
        np.subtract.at(step, at[mine] + size, 1)
        own = np.zeros(len(number), np.uint64)
        where = np.flatnonzero(np.cumsum(step[:-1]))
        own[where] = [_number(slot(words[k])) for k in word_at[where].tolist()]
        name[mine] = each(own, size, 11)[at[mine]] ^ np.uint64(size + _OWN)
    return at, mix(name)


class Benchmark:
    """The items' tokens, and the sorted names of their windows."""

    def __init__(self, ids: list[int], some: list[str]):
        self.ids = ids
        self.number, self.bounds, words, at = canonical(some)
        self.words = [words[i] for i in at]
        size = np.diff(self.bounds)
        self.sizes = sorted({WINDOW} | {int(s) for s in size if 0 < s < WINDOW})
        places, names = [], []
        for s in self.sizes:
            place, h = windows(self.number, self.bounds, s, words, at, whole=s < WINDOW)
            places.append(place)
            names.append(h)
        self.place, self.name = np.concatenate(places), np.concatenate(names)
        order = np.argsort(self.name, kind="stable")
        self.place, self.name = self.place[order], self.name[order]
        self.item = np.searchsorted(self.bounds, self.place, side="right") - 1
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.name >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, some: list[str]):
        """(text, item, kind, words matched, first word) for each item that a text holds, at most one for each."""
        number, bounds, words, at = canonical(some)
        found = np.zeros((0, 3), np.int64)  # text, item, diagonal: of a text and an item no more than they have tokens together
        for s in self.sizes:
            place, name = windows(number, bounds, s, words, at)
            maybe = np.flatnonzero(self.screen[(name >> np.uint64(44)).astype(np.int64)])
            left = np.searchsorted(self.name, name[maybe], side="left")
            n = np.searchsorted(self.name, name[maybe], side="right") - left
            maybe, left, n = maybe[n > 0], left[n > 0], n[n > 0]
            owner = np.searchsorted(bounds, place[maybe], side="right") - 1
            upto, k = np.cumsum(n), 0
            while k < len(maybe):
                end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, side="right")))
                some = np.repeat(left[k:end], n[k:end]) + ramp(n[k:end])
                rows = np.stack([np.repeat(owner[k:end], n[k:end]), self.item[some], np.repeat(place[maybe[k:end]], n[k:end]) - self.place[some]], axis=1)
                found, k = np.unique(np.concatenate([found, rows]), axis=0), end
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)])) if len(found) else np.zeros(0, np.int64)
        for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(found)]):
            text, item, diagonals = int(found[b, 0]), int(found[b, 1]), found[b:e, 2].tolist()
            best = None
            a0, a1 = int(self.bounds[item]), int(self.bounds[item + 1])
            for d in diagonals:
                lo, hi = max(a0, int(bounds[text]) - d), min(a1, int(bounds[text + 1]) - d)
                same = self.number[lo:hi] == number[lo + d : hi + d]
                # the longest stretch of equal tokens
                edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - s < min(WINDOW, a1 - a0):
                        continue
                    for kind, i, j in self._judged(lo + s, lo + e, min(WINDOW, a1 - a0), d, words, at):
                        if kind == "exact" or j - i >= REPLACED_SHARE * (a1 - a0):
                            got = (kind == "exact", j - i, -(i + d - int(bounds[text])))
                            best = max(best, got) if best else got
            if best:
                yield text, self.ids[item], "exact" if best[0] else "replaced", best[1], -best[2]

    def _judged(self, begin: int, end: int, least: int, d: int, words: list[str], at: np.ndarray) -> list[tuple[str, int, int]]:
        """(exact, begin, end) of the runs of `least` tokens or more whose slots are equal, too; where there is none, (replaced, begin, end) if slots are replaced one for one throughout."""
        slots = [(j, slot(self.words[j]), slot(words[at[j + d]])) for j in range(begin, end) if self.number[j] in _PLACEHOLDERS]
        cuts = [begin - 1, *(j for j, a, b in slots if a != b), end]
        runs = [("exact", i + 1, j) for i, j in zip(cuts, cuts[1:]) if j - i - 1 >= least]
        if runs:
            return runs
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        one_for_one = all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for _, a, b in slots)
        return [("replaced", begin, end)] if one_for_one else []


RESULT = "doc_id long, item_id long, kind string, n_matched int, first_token int"


def _rows(found, ids: pa.Array) -> pa.RecordBatch:
    doc = ids.to_pylist()
    rows = [(doc[t], i, k, n, f) for t, i, k, n, f in found]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["doc_id", "item_id", "kind", "n_matched", "first_token"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")


def _small(items: DataFrame, broadcast_bytes: int):
    """The benchmark as a broadcast, if its texts are that small. Repeated rows of one item are one."""
    items = items.distinct()
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
        return None
    some = items.orderBy("item_id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(Benchmark([r["item_id"] for r in some], [r["text"] for r in some]))


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, kind (exact or replaced), n_matched (tokens), first_token: each benchmark item that a document holds.

    Null texts hold nothing and null items or ones without a token are nowhere. Items under SHORTEST tokens are found as exact copies
    only. Rows of documents are searched one by one, whether their doc_id is null or repeated; repeated rows of an item (same id and text)
    are one, those with one id and several texts are items of their own. Of several places the longest exact match is told, else the longest replaced one, the first on ties. An empty table on
    either side gives no rows.
    """
    items = _items(benchmark)
    docs = texts(docs)
    shared = _small(items, broadcast_bytes)
    if shared is None:
        return _joined(docs.withColumn("key", F.lit(None).cast("long")), items).drop("key")

    def scan(batches):
        for whole in batches:
            for b in slices(whole):
                yield _rows(shared.value.matches([x or "" for x in b.column("text").to_pylist()]), b.column("doc_id"))

    return docs.mapInArrow(scan, RESULT)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """leaks() for a large benchmark, and each row's key (one is made where it is null)."""
    items = items.distinct()

    # a large benchmark: windows meet in a join, and only texts and items that share one are compared
    def lengths(batches):
        for whole in batches:
            for b in slices(whole):
                n = np.diff(canonical(b.column("text").to_pylist())[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(n, WINDOW).astype(np.int32))], names=["n"])

    def named(sizes, of_items):
        def run(batches):
            for whole in batches:
                for b in slices(whole):
                    number, bounds, words, word_at = canonical([x or "" for x in b.column("text").to_pylist()])
                    ids = np.asarray(b.column(0))
                    for s in sizes:
                        at, name = windows(number, bounds, s, words, word_at, whole=of_items and s < WINDOW)
                        owner = np.searchsorted(bounds, at, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(name.view(np.int64))], names=["key", "name"])

        return run

    # at most WINDOW + 1 rows
    sizes = sorted({r[0] for r in items.select("text").mapInArrow(lengths, "n int").distinct().collect() if r[0]} | {WINDOW})
    numbered = stash(docs.where("text IS NOT NULL").withColumn("key", F.coalesce("key", F.monotonically_increasing_id())).select("key", "doc_id", "text"), "docs")
    listed = stash(items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "text"), "items")
    left = numbered.select("key", "text").mapInArrow(named(sizes, False), "key long, name long").distinct()
    right = listed.select("item", "text").mapInArrow(named(sizes, True), "key long, name long").distinct().withColumnRenamed("key", "item")
    pairs = stash(left.join(right, "name").select("key", "item").distinct(), "pairs")
    both = numbered.join(pairs, "key").join(listed.select("item", "item_id", F.col("text").alias("item_text")), "item").select("key", "doc_id", "text", "item_id", "item_text")

    def compare(batches):
        for b in batches:
            for key, doc, text, item, other in zip(*(b.column(c).to_pylist() for c in range(5))):
                found = _rows(Benchmark([item], [other]).matches([text]), pa.array([doc], pa.int64()))
                yield found.append_column("key", pa.array([key] * found.num_rows, pa.int64()))

    return both.mapInArrow(compare, RESULT + ", key long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they are. Rows are judged one by one, as leaks() does: a row's
    doc_id, null or repeated, says nothing about another's. With a small benchmark one scan judges and passes on."""
    shared = _small(_items(benchmark), broadcast_bytes)
    if shared is None:
        keyed = stash(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")
        held = _joined(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("__key").alias("key")), _items(benchmark))
        return keyed.join(held.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)

    def judge(batches):
        for whole in batches:
            for b in slices(whole):
                held = {t for t, *_ in shared.value.matches([x or "" for x in b.column("text").cast("string").to_pylist()])}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
