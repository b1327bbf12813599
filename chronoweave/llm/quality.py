"""Quality rules: fixed base rules, then a calibrated logistic regression over hashed word and character n-grams.

Features are the shares of a text's words, word pairs and strings of four characters that fall into each hash bin. The regression
is fitted on a bounded sample of labelled rows (SAMPLE, chosen by a hash of doc_id), Platt-calibrated on a
held-out quarter of it, and scored in Arrow batches on every document against a fixed threshold. Texts of any length are scored in
steps of CHUNK bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffer_of, slices, texts
from .rolling import eights, mix, of_bytes, sums, words

#: At most so many labelled rows are fitted on. Every document is scored.
SAMPLE = 2000
#: Hash bins of each of the three kinds of n-grams. The driver holds 6 bytes for each row and bin that occurs in it: 295 MB at most.
BINS = 1 << 14
#: Bytes of text whose character n-grams are looked at together.
CHUNK = 1 << 18
#: A document is kept if its calibrated probability of being good is at least this.
THRESHOLD = 0.7
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & ~_SPACES
#: By the first byte of a character in UTF-8: which bits of the four bytes from there on are its own.
_OWN_BITS = np.array([0xFF if b < 0xC0 else 0xFFFF if b < 0xE0 else 0xFFFFFF if b < 0xF0 else 0xFFFFFFFF for b in range(256)], np.uint32)


def _mixed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    return h ^ mix(text.astype(np.uint64) + np.uint64(1))


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more; which of them are not the first."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


class Texts:
    """A slice of texts as arrays: its words, their hashes, and which text each belongs to."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = buffer_of(column)
        self.n = len(column)
        self.start, self.end, self.first = words(self.data, self.bounds)
        self.view = eights(self.data)
        self.word = of_bytes(self.data, self.start, self.end, view=self.view)
        self.n_words = np.diff(self.first)
        self.owner = np.repeat(np.arange(self.n), self.n_words)

    def base(self) -> dict[str, np.ndarray]:
        word_chars = sums(_STARTS[self.data], self.bounds)
        n_symbols = sums(_SYMBOLS[self.data], self.bounds)
        # lines: each text's stretches between new lines
        breaks = np.flatnonzero(self.data == 10)
        # by owner, then start: the empty last line of a text that ends in a line break starts at the same byte as the next text's first line
        owner = np.concatenate([np.arange(self.n), np.searchsorted(self.bounds, breaks, side="right") - 1])
        order = np.lexsort((np.concatenate([self.bounds[:-1], breaks + 1]), owner))
        line_start = np.concatenate([self.bounds[:-1], breaks + 1])[order]
        line_end = np.concatenate([self.bounds[1:], breaks])[np.lexsort((np.concatenate([self.bounds[1:], breaks]), owner))]
        owner = owner[order]
        has_word = np.searchsorted(self.start, line_end) > np.searchsorted(self.start, line_start)
        line_start, line_end, owner = line_start[has_word], line_end[has_word], owner[has_word]
        _, later = _repeated(_mixed(of_bytes(self.data, line_start, line_end, 2, self.view), owner))
        n_dup_lines = np.bincount(owner[later], minlength=self.n)
        # windows of three words
        n_repeat = np.zeros(self.n, np.int64)
        if len(self.word) > 2:
            w = mix(mix(self.word[:-2]) + self.word[1:-1] * np.uint64(3)) + self.word[2:] * np.uint64(5)
            at = np.flatnonzero(self.owner[:-2] == self.owner[2:])
            twice, _ = _repeated(_mixed(mix(w[at]), self.owner[at]))
            hit = np.zeros(len(self.word), bool)
            for k in range(3):
                hit[at[twice] + k] = True
            n_repeat = np.bincount(self.owner[hit], minlength=self.n)
        failed = (self.n_words < 50) | (100 * n_repeat > 50 * self.n_words)
        return {"n_words": self.n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed}

    def grams(self):
        """(kind, bins, bounds of each text's part): words, word pairs, then characters, these in several parts."""
        mask = np.uint64(BINS - 1)
        yield 0, (self.word & mask).astype(np.int32), self.first
        at = np.flatnonzero(self.owner[:-1] == self.owner[1:])
        yield 1, (mix(self.word[at] * np.uint64(3) + self.word[at + 1]) & mask).astype(np.int32), np.searchsorted(at, self.first)
        for lo in range(0, len(self.data), CHUNK):
            some = self.data[lo : lo + CHUNK + 16]  # three more characters are sure to be in
            place = np.flatnonzero((some & 0xC0) != 0x80)
            char = self.view[lo + place].astype(np.uint32) & _OWN_BITS[some[place]]
            own = int(np.searchsorted(place, CHUNK))
            place = place[: min(own, max(0, len(place) - 3)) + 3] + lo
            n = max(0, len(place) - 3)
            h = char[:n]
            for k in (1, 2, 3):
                h = h * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                h += char[k : n + k]
            h *= np.uint32(0x85EBCA77)
            inside = place[3:] < self.bounds[np.searchsorted(self.bounds, place[:n], side="right")]
            yield 2, (h[inside] >> np.uint32(32 - 14)).astype(np.int32), np.searchsorted(place[:n][inside], self.bounds)


@dataclass
class Model:
    weights: np.ndarray  # kinds x BINS
    slope: float
    offset: float

    def probability(self, t: Texts) -> np.ndarray:
        """The calibrated probability of being good."""
        total, n = np.zeros((3, t.n)), np.zeros((3, t.n))
        for kind, bins, bounds in t.grams():
            total[kind] += sums(self.weights[kind][bins], bounds)
            n[kind] += np.diff(bounds)
        z = (total / np.maximum(n, 1)).sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id -> bins and shares of its features, for the few rows to fit on."""

    def features(batches):
        for whole in batches:
            for b in slices(whole):
                t = Texts(b.column("text"))
                counts: list[dict[int, np.ndarray]] = [{} for _ in range(t.n)]
                for kind, x, bounds in t.grams():
                    for i in np.flatnonzero(np.diff(bounds)).tolist():
                        own = np.bincount(x[bounds[i] : bounds[i + 1]], minlength=BINS).astype(np.int32)
                        counts[i][kind] = counts[i][kind] + own if kind in counts[i] else own
                bins, shares = [], []
                for own in counts:
                    c = np.zeros((3, BINS))
                    for kind, x in own.items():
                        c[kind] = x / x.sum()
                    seen = np.flatnonzero(c)
                    bins.append(seen.astype("<u2").tobytes())
                    shares.append(c.ravel()[seen].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(bins), pa.array(shares)], names=["doc_id", "quality", "bins", "shares"])

    return docs.mapInArrow(features, "doc_id long, quality int, bins binary, shares binary")


def _logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 120, penalty: float = 1e-6) -> np.ndarray:
    """Class-balanced logistic regression by accelerated gradient steps; no intercept, calibration has one."""
    size = np.array([len(b) for b, _ in rows])
    bins, share = np.concatenate([b for b, _ in rows]), np.concatenate([s for _, s in rows]).astype(np.float64)
    row, head = np.repeat(np.arange(len(rows)), size), np.concatenate([[0], np.cumsum(size)])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    square = np.bincount(row, share**2, len(rows))
    rate = 4 / (3 * max(square.max(), 1e-9) / 3 + penalty)
    w = v = np.zeros(3 * BINS)
    for k in range(steps):
        z = sums(v[bins] * share, head)
        r = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        new = v - rate * (np.bincount(bins, r[row] * share, 3 * BINS) + penalty * v)
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log-odds, by Newton's method with Platt's smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * b
        b = b - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), g)
    return float(b[0] / scale), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled rows. Without rows of both classes there is nothing to learn: None. A doc_id labelled both ways counts as bad; of documents with one doc_id, one is taken."""
    labelled = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    some = labelled.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row for each label, however often its document is there
    one = _rows(texts(docs).join(F.broadcast(some), "doc_id")).groupBy("doc_id").agg(F.min(F.struct("quality", "bins", "shares")).alias("r"))
    got = one.select("doc_id", "r.*").toPandas().sort_values("doc_id")
    y = got["quality"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return None
    rows = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(s, "<f4")) for b, s in zip(got["bins"], got["shares"])]
    held = np.arange(len(rows)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(rows), bool)
    w = _logistic([r for r, h in zip(rows, held) if not h], y[~held])
    use = held if held.any() else ~held
    z = np.array([w[b] @ s for (b, s), h in zip(rows, use) if h])
    return Model(w.reshape(3, BINS), *_platt(z, y[use]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    A null or empty text has no words and fails the base rules. Repeated rows, and rows with a null doc_id, are judged one by one. Where
    the labels teach nothing, the base rules alone decide. Texts may be of any length; an empty table gives no rows.
    """
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for whole in batches:
            for b in slices(whole):
                t = Texts(b.column("text"))
                base = t.base()
                p = shared.value.probability(t) if shared.value else np.ones(t.n)
                kept = ~base["base_failed"] & (p >= threshold)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v) for v in base.values()), pa.array(kept), pa.array(p)], names=["doc_id", *base, "kept", "probability"])

    return texts(docs).mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with their columns as they are; judged and passed on in one scan.

    Nulls, repeated rows and empty tables are as in score(); other columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def judge(batches):
        for whole in batches:
            for b in slices(whole):
                t = Texts(b.column("text"))
                ok = ~t.base()["base_failed"]
                if shared.value:
                    ok &= shared.value.probability(t) >= threshold
                yield b.filter(pa.array(ok))

    return docs.mapInArrow(judge, docs.schema)
