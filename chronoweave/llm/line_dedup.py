"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

The edit distance counts words. A line within distance 1 of an earlier line, anywhere in the corpus, goes; equal lines are distance 0.
Every variant of a line within the bound gets a hashed key: for a changed word its place and all other words, for
a missing word the rest. Lines meet under equal keys, each with the earliest of the key only, so a key that
very many lines share makes no pairs; then the distance is verified word by word.

Variants are emitted only for lines that can have a partner: of two lines within distance 1, one's first
half or last half is also the other's. Hashes of halves are counted first, which drops most lines and loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, stash, with_own

#: Shorter lines go only if an equal one stands before them: one changed word makes them another line.
MIN_WORDS = 8
#: How a line meets another under a key: with a word changed, as the one with a word more, as the one with a word less.
CHANGED, LONGER, SHORTER = 0, 1, 2
#: Tables that name up to so many lines or keys (100 bytes each at most) are broadcast, after these have been counted; larger ones are joined by shuffle.
BROADCAST_ITEMS = 500_000
_BLANK = " \t\n\x0b\x0c\r"


def _words(line: Column) -> Column:
    """A line without any word gives one empty word."""
    return F.split(F.btrim(line, F.lit(_BLANK)), "[ \\t-\\r]+")


def _small(df: DataFrame, items: int) -> DataFrame:
    """df, to be broadcast if it names few things."""
    return F.broadcast(df) if items <= BROADCAST_ITEMS else df


def _with_texts(per_doc: DataFrame) -> DataFrame:
    """A table that grows with the documents, to be joined to their texts by shuffle at every size, so that small inputs cost in proportion what large ones do."""
    return per_doc.hint("merge")


def _halves(words: Column) -> Column:
    """Four names: first and last half for a partner with at most as many words, and for one with a word more."""
    n = F.size(words)
    keys = []
    for longest in (n, n + 1):
        k = F.floor(longest / 2).cast("int")  # ceil((longest - 1) / 2)
        keys += [F.xxhash64(longest, F.lit("first"), F.slice(words, F.lit(1), k)), F.xxhash64(longest, F.lit("last"), F.slice(words, n - k + 1, k))]
    return F.array(*keys)


def _distance_at_most_1(a: Column, b: Column) -> Column:
    n, m = F.size(a), F.size(b)
    differing = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))

    def dropped(long: Column, short: Column) -> Column:
        # where the words first differ, the longer line has the word that the other lacks
        at = F.array_position(F.zip_with(long, short, lambda x, y: x.eqNullSafe(y)), False).cast("int")
        return F.concat(F.slice(long, F.lit(1), at - 1), F.slice(long, at + 1, F.size(long))) == short

    return F.when(n == m, differing <= 1).when(n == m + 1, dropped(a, b)).when(m == n + 1, dropped(b, a)).otherwise(F.lit(False))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line: the lines that go. docs: doc_id, text. Lines at the same place of equal doc_ids are one."""
    words = F.col("words")
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body")).select("doc_id", "line", _words(F.col("body")).alias("words")).where(F.get("words", F.lit(0)) != "")
    # short lines have no halves, so they meet equal lines only
    lines = stash(each.select("doc_id", "line", F.xxhash64(words).alias("h"), F.hash(words).alias("g"), F.when(F.size(words) >= MIN_WORDS, _halves(words)).alias("halves")), "lines")
    first = stash(lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")), "first")
    # lines that share a half with another line; which half says where they may differ
    halves = lines.select("h", F.posexplode("halves").alias("which", "half"))
    shared = stash(halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("half"), "halves")
    sharing = halves.join(_small(shared, shared.count()), "half").groupBy("h").agg(*(F.max(F.col("which") == k).alias(n) for k, n in enumerate(("same_first", "same_last", "short_first", "short_last"))))
    at = stash(first.join(sharing, "h").select("h", "first", "same_first", "same_last", (F.col("short_first") | F.col("short_last")).alias("short")), "partners")
    # their words: only of the documents and lines in question
    wanted = stash(at.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h", "first", "same_first", "same_last", "short")).alias("wanted")), "wanted")
    found = docs.join(_with_texts(wanted), "doc_id").select(F.split("text", "\n").alias("parts"), "wanted")
    # each line is looked up in its text's array, which is split once and not copied for each line
    with_line = F.transform("wanted", lambda x: F.struct(F.get("parts", x["line"]).alias("body"), *(x[c].alias(c) for c in ("h", "first", "same_first", "same_last", "short"))))
    found = found.select(F.explode(with_line).alias("w")).select("w.*")
    chosen = stash(found.select("h", "first", "same_first", "same_last", "short", _words(F.col("body")).alias("words")).where(F.xxhash64("words") == F.col("h")).dropDuplicates(["h"]), "words")
    # the variants, by running exclusive-or of the hashes of words and their places
    spread = chosen.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    w = Window.partitionBy("h").orderBy("i")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here, moved = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    walk = spread.select("h", "same_first", "same_last", "short", F.size("words").alias("n"), F.posexplode("words").alias("i", "word")).select("h", "same_first", "same_last", "short", "n", "i", here.alias("x"), moved.alias("y"))
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walk = walk.select("h", "same_first", "same_last", "short", "n", "i", "x", F.bit_xor("x").over(everything).alias("all"), F.bit_xor("x").over(up_to).alias("x_to"), F.bit_xor("y").over(everything).bitwiseXOR(F.bit_xor("y").over(up_to)).alias("y_after"))
    half = F.floor(F.col("n") / 2)
    here_may_differ = (F.col("same_first") & (F.col("i") >= half)) | (F.col("same_last") & (F.col("i") < F.col("n") - half))
    changed = F.struct(F.xxhash64(F.lit("changed"), "n", "i", F.col("all").bitwiseXOR(F.col("x"))).alias("key"), F.lit(CHANGED).alias("role"))
    missing = F.struct(F.xxhash64(F.lit("missing"), F.col("n") - 1, F.col("x_to").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("y_after"))).alias("key"), F.lit(LONGER).alias("role"))
    whole = F.struct(F.xxhash64(F.lit("missing"), "n", "all").alias("key"), F.lit(SHORTER).alias("role"))
    keys = F.array_compact(F.array(F.when(here_may_differ, changed), F.when(here_may_differ, missing), F.when((F.col("i") == 0) & F.col("short"), whole)))
    variants = stash(walk.select("h", F.explode(keys).alias("v")).select("h", "v.key", "v.role"), "variants")
    # most keys are one line's alone; for the others, the earliest line in each role
    common = stash(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    met = stash(variants.join(_small(common, common.count()), "key").join(chosen.select("h", "first"), "h"), "met")
    least = met.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, F.struct("first", "h"))).alias(f"e{r}") for r in (CHANGED, LONGER, SHORTER)))
    earliest = F.when(F.col("role") == CHANGED, F.col(f"e{CHANGED}")).when(F.col("role") == LONGER, F.col(f"e{SHORTER}")).otherwise(F.col(f"e{LONGER}"))
    pairs = met.join(least, "key").select("h", "first", earliest.alias("e")).where(F.col("e.first") < F.col("first")).select("h", F.col("e.h").alias("other")).distinct()
    mine, theirs = chosen.select("h", F.col("words").alias("a")), chosen.select(F.col("h").alias("other"), F.col("words").alias("b"))
    near = pairs.join(mine, "h").join(theirs, "other").where(_distance_at_most_1(F.col("a"), F.col("b"))).select("h").distinct()
    # a line goes if an equal one stands before it, or a near one before the first of its equals
    verdict = first.join(near.withColumn("near", F.lit(True)), "h", "left").where("n > 1 OR near")
    gone = lines.select("doc_id", "line", "h", "g").join(verdict, ["h", "g"]).where(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "line") > F.col("first")))
    return gone.select("doc_id", "line")


def _bitmaps(gone: DataFrame) -> DataFrame:
    """doc_id, __n, __gone of (doc_id, line): how many lines go, and a bit for each line of a text up to the last that goes, 64 to a number."""
    words = gone.groupBy("doc_id", F.floor(F.col("line") / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line") % 64)).alias("bits"))
    before = F.lag("at", 1, -1).over(Window.partitionBy("doc_id").orderBy("at"))
    # numbers in between, of which no line goes, are filled in
    each = words.select("doc_id", "at", F.bit_count("bits").alias("n"), F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("at") - before - 1), F.array("bits")).alias("bits"))
    per = each.groupBy("doc_id").agg(F.sum("n").alias("__n"), F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("b"))
    return per.select("doc_id", "__n", F.flatten(F.transform("b", lambda x: x["bits"])).alias("__gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with `text` less the lines that go, and n_lines, n_removed; other columns stay as they are.

    A line with a word goes if an earlier line (smaller doc_id, or earlier in the same text) has the same words or, where both have
    MIN_WORDS words or more, is within one word of it. Lines are judged on the input, not on what is left. Null texts stay null, with no lines.
    Rows with one doc_id are one document, so they do not remove each other's lines; rows with a null doc_id are documents of their own below
    all others, in a fixed order, equal texts among them one. Texts may have any number of lines of any length. Input columns called n_lines or n_removed are replaced. An empty table gives no rows.
    """
    keyed, _ = with_own(docs)
    with Scratch() as s:
        gone = removed_lines(keyed.select(F.col("__own").alias("doc_id"), F.col("text").cast("string").alias("text")))
        per_doc = s.keep(stash(_bitmaps(gone).withColumnRenamed("doc_id", "__own"), "gone"))
    parts = F.split(F.col("text").cast("string"), "\n")
    stays = lambda _, i: F.coalesce(F.call_function("getbit", F.get("__gone", F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0
    kept = F.array_join(F.filter(parts, stays), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    n_removed = F.coalesce("__n", F.lit(0)).cast("long")
    out = keyed.join(_with_texts(per_doc), "__own", "left").withColumns({"n_lines": n_lines, "n_removed": n_removed})
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text").cast("string")).otherwise(kept))
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents less the lines that go, n_chars brought up to date; a document that lost lines and has no word left goes, too."""
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null for a null text)."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS line, list_filter(regexp_split_to_array(parts[i + 1], '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), s AS (
  SELECT doc_id, line, words, len(words) AS n, array_to_string(words, ' ') AS own FROM l WHERE len(words) > 0
), f AS (
  SELECT own, any_value(words) AS words, any_value(n) AS n, min(doc_id * 1000000 + line) AS first FROM s GROUP BY own
), k AS (
  SELECT * FROM f WHERE n >= 8
), v AS (
  SELECT own, n, first, i, md5_number(array_to_string(list_concat(words[1:i], words[i + 2:]), ' ')) AS rest FROM (SELECT own, n, first, words, unnest(range(n)) AS i FROM k)
), c AS (SELECT n, i, rest, min(first) AS first FROM v GROUP BY n, i, rest
), near AS (
  SELECT v.own FROM v JOIN c USING (n, i, rest) WHERE c.first < v.first
  UNION SELECT v.own FROM v JOIN k ON md5_number(k.own) = v.rest AND k.n = v.n - 1 WHERE k.first < v.first
  UNION SELECT k.own FROM v JOIN k ON md5_number(k.own) = v.rest AND k.n = v.n - 1 WHERE v.first < k.first
), gone AS (
  SELECT s.doc_id, s.line FROM s JOIN f USING (own) WHERE s.doc_id * 1000000 + s.line > f.first OR s.own IN (SELECT own FROM near)
), per AS (SELECT doc_id, list(line) AS lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN lines IS NULL THEN text ELSE array_to_string([parts[i + 1] for i in range(len(parts)) if NOT list_contains(lines, i)], chr(10)) END) AS kept_sha256
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents) d LEFT JOIN per ON per.doc_id = d.doc_id
"""
