"""Text functions on columns. Word characters are Unicode's throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Hesitations that are cut by default (fixed list).
FILLERS = ("um", "uh", "erm", "uhm", "mmm", "hmm")


def bare(word: Column) -> Column:
    """Lower case, without anything but word characters and apostrophes: for the filler list."""
    return F.lower(F.regexp_replace(word, r"(?U)[^\w']", ""))


def edge_normalized(word: Column) -> Column:
    """Without leading and trailing non-word characters, in lower case (ß stays ß)."""
    return F.lower(F.regexp_replace(word, r"(?U)^\W+|\W+$", ""))


def alignment_key(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"(?U)[^\w']+", ""))


def plain_tokens(text: Column) -> Column:
    """Lower-case ASCII letters and digits, split at everything else."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def word_budget(seconds: Column, per_second: float = 2.5) -> Column:
    """How many words fit, one at least."""
    return F.greatest(F.floor(seconds * per_second).cast("int"), F.lit(1))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")


def fallback_title(text: Column) -> Column:
    """The first sentence without its end; over 70 characters it is cut at 69, less the last partial word, with an ellipsis."""
    first = F.regexp_replace(F.coalesce(F.get(sentences(text), F.lit(0)), F.lit("")), r"[.!?]+$", "")
    cut = F.substring(first, 1, 69)
    whole = F.when(F.locate(" ", cut) > 0, F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(first) > 70, F.concat(whole, F.lit("…"))).otherwise(first)


def fallback_description(text: Column) -> Column:
    return F.array_join(F.slice(sentences(text), 1, 3), " ")


def copy_of(spoken: Column, job_id: Column) -> Column:
    """A struct of title (120 characters at most) and description (5000), from what is said; of the job's name where nothing is."""
    said = F.regexp_replace(F.coalesce(spoken, F.lit("")), r"^\s+|\s+$", "")
    title, told = F.substring(fallback_title(said), 1, 120), F.substring(fallback_description(said), 1, 5000)
    # fixed text
    none = F.struct(job_id.alias("title"), F.concat(F.lit("Screen recording "), job_id, F.lit(". No narration to describe it.")).alias("description"))
    return F.when(said == "", none).otherwise(F.struct(title.alias("title"), F.when(told == "", title).otherwise(told).alias("description")))


def tags(raw: Column) -> Column:
    """Trimmed, without #, lower case, joined by hyphens, ASCII, 40 characters; the first 30 different ones in order."""

    def one(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), "^#+", "")
        x = F.regexp_replace(F.lower(x), r"[\s_]+", "-")
        x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9-]", ""), "^-+|-+$", "")
        return F.substring(x, 1, 40)

    return F.slice(F.array_distinct(F.filter(F.transform(raw, one), lambda x: x != "")), 1, 30)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def wrapped(words: Column, max_chars: int) -> Column:
    """An array of lines, filled greedily; a longer word has a line of its own."""
    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(w) <= max_chars
        return F.when(acc["line"].isNull(), F.struct(acc["lines"].alias("lines"), w.alias("line"))).when(fits, F.struct(acc["lines"].alias("lines"), F.concat_ws(" ", acc["line"], w).alias("line"))).otherwise(F.struct(F.concat(acc["lines"], F.array(acc["line"])).alias("lines"), w.alias("line")))

    return F.aggregate(words, zero, add, lambda acc: F.array_compact(F.concat(acc["lines"], F.array(acc["line"]))))


def marked(words: Column, active: int | None, emphasized: Column, lit: tuple[str, str], strong: tuple[str, str]) -> Column:
    """The words as one line: the active one between the lit marks, else emphasized places (an array) between the strong ones."""

    def one(w: Column, i: Column) -> Column:
        plain = F.when(F.array_contains(emphasized, i), F.concat(F.lit(strong[0]), w, F.lit(strong[1]))).otherwise(w)
        return plain if active is None else F.when(i == active, F.concat(F.lit(lit[0]), w, F.lit(lit[1]))).otherwise(plain)

    return F.array_join(F.transform(words, one), " ")


def first_and_more(items: Column, n: int) -> Column:
    """The first n of an array as lines, and how many more there are."""
    more = F.when(F.size(items) > n, F.array(F.format_string("... and %d more", F.size(items) - n))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(items, 1, n), more), "\n")
