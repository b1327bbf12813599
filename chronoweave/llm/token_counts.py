"""Token counts by section: documents are encoded once, whole, and each token goes to one section by its characters.

Sections are the stretches of a text between new lines; a new line belongs to the section that it ends. Tokens and
sections are both in order of their characters, so the interval join of the two is one merge. A token whose
characters lie in several sections is allocated by a rule:

first    to the section of its first character (the default)
last     to the section of its last character
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts
from .tokens import encoder, vocabulary

RULES = ("first", "last")


def section_token_counts(docs: DataFrame, rule: str = "first", vocab: str | None = None) -> DataFrame:
    """doc_id, section (from 0), n_chars, n_tokens, n_crossing (tokens allocated here that also lie in another section).

    The tokens of a document's sections add up to the tokens of its whole text. An empty or null text has one section
    without characters and tokens. Repeated rows are counted one by one; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocab = vocab or vocabulary()

    def count(batches):
        for whole in batches:
            for batch in slices(whole):
                some = [x or "" for x in batch.column("text").to_pylist()]
                ids, at, begin, end = encoder(vocab, True).encode(some)
                lines = [x.split("\n") for x in some]
                n_sections = np.fromiter(map(len, lines), np.int64, len(lines))
                chars = np.fromiter((len(y) + 1 for x in lines for y in x), np.int64, int(n_sections.sum()))
                last = np.cumsum(n_sections) - 1
                chars[last] -= 1
                # all texts in one row of characters; the sections' ends in it
                ends = np.cumsum(chars)
                n_chars = np.fromiter(map(len, some), np.int64, len(some))
                shift = np.repeat(np.cumsum(n_chars) - n_chars, np.diff(at))
                to_first = np.searchsorted(ends, begin + shift, side="right")
                to_last = np.searchsorted(ends, np.maximum(end - 1, begin) + shift, side="right")
                to = to_first if rule == "first" else to_last
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.asarray(batch.column("doc_id").fill_null(0)), n_sections), pa.int64(), mask=np.repeat(np.asarray(batch.column("doc_id").is_null()), n_sections)),
                        pa.array((np.arange(len(chars)) - np.repeat(last - n_sections + 1, n_sections)).astype(np.int32)),
                        pa.array(chars),
                        pa.array(np.bincount(to, minlength=len(chars))),
                        pa.array(np.bincount(to[to_first != to_last], minlength=len(chars))),
                    ],
                    names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing"],
                )

    return texts(docs).mapInArrow(count, "doc_id long, section int, n_chars long, n_tokens long, n_crossing long")
