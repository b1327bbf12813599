"""Spelling variants by full neighbourhoods: every string one edit away from a word is generated and looked up in the vocabulary.

For each word all its deletions, replacements and insertions over the letters that the vocabulary has are made, each distinct string once:
about 2 * length * letters of them. A candidate that is a word is a near word; equality is the join, so no distance is ever computed. The
candidates are numbers at first (the hash of a string with one place changed follows from that of the string), and a filter of the vocabulary
keeps most that are no words from being written out as strings and shuffled. It lets some through, which the join drops, and holds none back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import CRC_TABLE_SQL, Scratch, crc_sql, stash, texts, unstash
from .rolling import mix

#: Shorter words, and words that occur only once, have no variants and are none.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is this many times as frequent as its variant.
TIMES = 10
#: One word in so many is damaged where the caller asks for it.
DAMAGE = 31
#: Bits of the filter for each word, and the bits at which it stops growing (64 MB).
BITS_PER_WORD, MOST_BITS = 16, 29
#: Candidates that a task makes at once.
AT_ONCE = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = np.uint64(0x9E3779B97F4A7C15)
DELETE, REPLACE, INSERT = 0, 1, 2


def _damaged(doc_id: Column, run: Column) -> Column:
    """The run, less one letter where the checksum of doc_id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, damage: bool = True) -> DataFrame:
    """word, n of maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z are lower-cased) with LEAST_LETTERS letters and LEAST_COUNT uses or more."""
    # a run that is too short stays so, so the pattern needn't find it
    runs = texts(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    lower = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = lower.select((_damaged(F.col("doc_id"), F.col("run")) if damage else F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, one after the other, and the words' bounds."""
    strings = column.to_pylist()
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.uint64), np.concatenate([[0], np.cumsum(size)])


def _code(letter: np.ndarray) -> np.ndarray:
    return mix(letter + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P, np.uint64)]), dtype=np.uint64)


def _by_length(column: pa.Array):
    """(which words, their letters as rows) for each length."""
    letters, bounds = _letters(column)
    size = np.diff(bounds)
    for length in np.unique(size):
        which = np.flatnonzero(size == length)
        yield which, letters[bounds[which][:, None] + np.arange(length)]


def _hashes(word: np.ndarray) -> np.ndarray:
    """One number for each row of letters: a sum of letters' codes times powers of the place."""
    return (_code(word) * _powers(word.shape[1])[: word.shape[1]]).sum(axis=1, dtype=np.uint64)


def _probes(h: np.ndarray, bits: int):
    """Three places in the filter for each hash."""
    h = mix(h)
    down = np.uint64(64 - bits)
    return h >> down, (h * _P) >> down, (h * np.uint64(0xD6E8FEB86659FD93)) >> down


def word_filter(words: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A filter of the words' hashes as bytes, and the power of two of its bits: BITS_PER_WORD a word, 2**MOST_BITS at most."""
    bits = min(MOST_BITS, max(16, int(n * BITS_PER_WORD - 1).bit_length()))

    def cells(batches):
        for b in batches:
            for _, word in _by_length(b.column("word")):
                x = np.unique(np.concatenate(_probes(_hashes(word), bits)))
                cell, first = np.unique(x >> np.uint64(6), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (x & np.uint64(63)), first).view(np.int64))], names=["cell", "bits"])

    got = words.select("word").mapInArrow(cells, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(got.column("cell"))] = np.asarray(got.column("bits"))
    return out.view(np.uint8), bits


def _neighbours(word: np.ndarray, alphabet: np.ndarray):
    """(kind, place, hashes, real) for rows of letters. Hashes: words by letters (by one for a deletion). real: the strings that no other place gives."""
    n, length = word.shape
    power = _powers(length + 1)
    code, letter = _code(word), _code(alphabet)
    here = code * power[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(here, axis=1, dtype=np.uint64)], axis=1)
    after = before[:, -1:] - before  # from a place on, where it stands
    back = pow(int(_P), -1, 2**64)
    for i in range(length):
        # the letters that follow move one place down
        yield DELETE, i, (before[:, i] + after[:, i + 1] * np.uint64(back))[:, None], (word[:, i : i + 1] != word[:, i - 1 : i]) if i else np.ones((n, 1), bool)
        yield REPLACE, i, (before[:, i] + after[:, i + 1])[:, None] + (letter * power[i])[None, :], word[:, i : i + 1] != alphabet[None, :]
    for i in range(length + 1):
        # of a run of equal letters, one more goes in front
        yield INSERT, i, (before[:, i] + after[:, i] * _P)[:, None] + (letter * power[i])[None, :], (word[:, i - 1 : i] != alphabet[None, :]) if i else np.ones((n, len(alphabet)), bool)


def candidates(words: DataFrame, alphabet: str, seen: np.ndarray, bits: int) -> DataFrame:
    """word, n, near: the strings one edit away from a word that the filter lets through, each once for a word."""
    shared = words.sparkSession.sparkContext.broadcast(seen)
    marks = np.array([ord(c) for c in alphabet], np.uint64)

    def make(batches):
        held = shared.value

        def hit(place: np.ndarray) -> np.ndarray:
            return (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

        for b in batches:
            for which, all_words in _by_length(b.column("word")):
                step = max(1, AT_ONCE // max(1, len(marks)))
                for lo in range(0, len(which), step):
                    rows, word = which[lo : lo + step], all_words[lo : lo + step]
                    found = []
                    for kind, place, h, real in _neighbours(word, marks):
                        h = mix(h)
                        down = np.uint64(64 - bits)
                        at = np.flatnonzero((hit(h >> down) & real).ravel())
                        x = h.ravel()[at]
                        for odd in (_P, np.uint64(0xD6E8FEB86659FD93)):
                            more = hit((x * odd) >> down)
                            at, x = at[more], x[more]
                        if len(at):
                            r, c = np.divmod(at, h.shape[1])
                            found.append((rows[r], np.full(len(r), kind, np.int8), np.full(len(r), place, np.int32), c.astype(np.int16)))
                    if found:
                        row, kind, place, c = (np.concatenate(x) for x in zip(*found))
                        letter = pa.array(list(alphabet) or [""]).take(pa.array(c))
                        yield pa.RecordBatch.from_arrays([b.column("word").take(pa.array(row)), b.column("n").take(pa.array(row)), pa.array(kind), pa.array(place), letter], names=["word", "n", "kind", "place", "letter"])

    found = words.select("word", "n").mapInArrow(make, "word string, n long, kind byte, place int, letter string")
    rest = F.substring("word", F.col("place") + F.when(F.col("kind") == INSERT, 1).otherwise(2), F.length("word"))
    middle = F.when(F.col("kind") == DELETE, "").otherwise(F.col("letter"))
    return found.select("word", "n", F.concat(F.substring("word", F.lit(1), F.col("place")), middle, rest).alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): where forms lead in the end. A form is TIMES as frequent as its variant, so there are no cycles, and
    as every round doubles the steps that it looks ahead, a handful of rounds."""
    with Scratch() as s:
        known = stash(forms.select("word", F.col("form").alias("root")), "roots")
        while True:
            step = known.select(F.col("word").alias("root"), F.col("root").alias("up"))
            further = stash(known.join(step, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
            unstash(known)
            known = further
            if known.where("moved").isEmpty():
                return s.keep(known)


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n), which has each word once and is read several times.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near word of largest n (ties:
    smallest in code-point order) if that n is TIMES its own or more, else null; root is where forms lead to in the end, the word itself without a form.
    An empty vocabulary gives no rows.
    """
    with Scratch() as s:
        n = words.count()
        # at most the 90 letters of the pattern
        alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
        seen, bits = word_filter(words, n)
        dealt = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
        met = candidates(dealt, alphabet, seen, bits).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
        best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
        near = met.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
        is_form = -F.col("best.less") >= TIMES * F.col("n")
        each = s.keep(stash(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near"))
        ends = s.keep(roots(each.where("form IS NOT NULL")))
    out = words.join(each.hint("merge"), "word", "left").join(ends.select("word", "root").hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants() of the words of all texts, of which one run in DAMAGE has lost a letter: see vocabulary().

    Null texts have no words; a null doc_id counts as an empty one in the checksum. Rows may repeat, each counts; texts may be of any length. An empty table gives no rows.
    """
    return variants(stash(vocabulary(docs), "vocabulary"))


#: The checksum is that of zlib; its table follows from the polynomial. Near words meet by what is left when one place is taken out.
VARIANTS_SQL = rf"""
WITH {CRC_TABLE_SQL}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
sums AS (
  SELECT run, n, {crc_sql('x')} AS h
  FROM each, crc_table
), damaged AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM sums),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM vocab, range(40) r(i) WHERE i < length(word)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT v.word, v.n, l.word, l.n FROM vocab v JOIN less l ON l.rest = v.word
  UNION SELECT l.word, l.n, v.word, v.n FROM vocab v JOIN less l ON l.rest = v.word
), best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n),
forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 10 * n),
steps AS (
  SELECT f.word, coalesce(f8.form, f7.form, f6.form, f5.form, f4.form, f3.form, f2.form, f.form) AS root FROM forms f LEFT JOIN forms f2 ON f2.word = f.form LEFT JOIN forms f3 ON f3.word = f2.form
  LEFT JOIN forms f4 ON f4.word = f3.form LEFT JOIN forms f5 ON f5.word = f4.form LEFT JOIN forms f6 ON f6.word = f5.form LEFT JOIN forms f7 ON f7.word = f6.form LEFT JOIN forms f8 ON f8.word = f7.form
)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n FROM vocab v LEFT JOIN best b ON b.word = v.word LEFT JOIN forms f ON f.word = v.word LEFT JOIN steps s ON s.word = v.word
"""
