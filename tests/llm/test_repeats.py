"""Byte-string and word-sequence dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from edge_cases import WORD, documents, some_texts

from chronoweave.llm import substring_dedup, suffix_dedup


def brute_bytes(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        step = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                step[s] += 1
                step[s + window] -= 1
            seen.add(w)
        c = np.cumsum(step[:-1]) > 0
        kept = bytes(b for b, x in zip(raw, c) if not x)
        out[i] = (len(raw), int(c.sum()), int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def brute_words(docs, window):
    words = {i: WORD.findall(t or "") for i, t in docs}
    n = Counter(tuple(w[s : s + window]) for w in words.values() for s in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {k for s in range(len(w) - window + 1) if n[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed,window", [(1, 100), (2, 100), (3, 64)])
def test_bytes(spark, seed, window):
    texts = some_texts(seed)
    got = suffix_dedup.remove_repeats(documents(spark, texts), window).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == brute_bytes(list(enumerate(texts)), window)


@pytest.mark.parametrize("seed,window", [(1, 35), (2, 35), (3, 20)])
def test_words(spark, seed, window):
    texts = some_texts(seed)
    got = substring_dedup.remove_repeats(documents(spark, texts), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got} == brute_words(list(enumerate(texts)), window)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    texts = some_texts(4)
    monkeypatch.setattr(substring_dedup, "index_filter", lambda *_: np.full(1 << (substring_dedup.FILTER_BITS - 3), 255, np.uint8))
    got = substring_dedup.remove_repeats(documents(spark, texts)).collect()
    assert {r.doc_id: r.kept for r in got} == {i: x[3] for i, x in brute_words(list(enumerate(texts)), 35).items()}


def test_order_follows_doc_id_not_rows(spark):
    t = "abcdefghij" * 10 + "".join(chr(97 + i * i % 26) for i in range(60))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(documents(spark, [t, t], [9, 4])).collect()}
    assert got[9] == len(t) and got[4] < len(t)


def test_null_ids_and_repeated_rows(spark):
    t = "".join(random.Random(3).choices("abcdefghij", k=150))
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.remove_repeats(documents(spark, [t, t, t], [None, 5, 5])).collect())
    assert got == [(-1, 0), (5, 150), (5, 150)]
    alone = suffix_dedup.remove_repeats(documents(spark, [t, t], [5, 5])).collect()
    assert [r.n_removed for r in alone] == [0, 0]
    words = " ".join(f"w{i}" for i in range(40))
    assert [r.n_removed for r in substring_dedup.remove_repeats(documents(spark, [words, words], [5, 5])).collect()] == [0, 0]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0
