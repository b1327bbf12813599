"""The part-by-part encoder against whole-text encoding; token files, counts and packing on top of it."""

import zlib

import numpy as np
import pytest
from edge_cases import documents, some_texts
from hypothesis import given, settings, strategies as st

from chronoweave.llm import packing, token_counts, token_files, tokens


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


@pytest.fixture(scope="module")
def parts():
    return tokens.Encoder(tokens.vocabulary(), spans=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé² 12\n\t _.,!中", max_size=30), min_size=1, max_size=4))
def test_encoder(whole, parts, texts):
    ids, at, begin, end = parts.encode(texts)
    for i, t in enumerate(texts):
        e = whole.encode(t, add_special_tokens=False)
        s = slice(at[i], at[i + 1])
        assert e.ids == ids[s].tolist()
        assert e.offsets == list(zip(begin[s].tolist(), end[s].tolist()))


def expected(whole, texts, end_id):
    return [np.array(whole.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4") for t in texts]


def test_file_round_trip(spark, whole):
    texts = some_texts()
    order = list(range(len(texts)))[::-1]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(documents(spark, texts, order).repartition(3)).collect()}
    start = 0
    for i, ids in sorted(zip(order, expected(whole, texts, 2))):
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_numbers(x):
    control, data = token_files.encode_numbers(np.array(x, np.uint32))
    assert len(control) == -(-len(x) // 4)
    assert token_files.decode_numbers(control, data, len(x)).tolist() == x


def test_section_counts(spark, whole):
    texts = some_texts()
    got = {(r.doc_id, r.section): (r.n_chars, r.n_tokens, r.n_crossing) for r in token_counts.section_token_counts(documents(spark, texts)).collect()}
    want = {}
    for d, t in enumerate(texts):
        t = t or ""
        lines = t.split("\n")
        edges = np.cumsum([0] + [len(x) + 1 for x in lines])
        edges[-1] -= 1
        n, crossing = [0] * len(lines), [0] * len(lines)
        for b, e in whole.encode(t, add_special_tokens=False).offsets:
            k = max(i for i in range(len(lines)) if edges[i] <= b)
            n[k] += 1
            crossing[k] += max(e, b + 1) > edges[k + 1]
        want |= {(d, k): (int(edges[k + 1] - edges[k]), n[k], crossing[k]) for k in range(len(lines))}
    assert got == want
    last = token_counts.section_token_counts(documents(spark, ["a\n\n\nb"]), rule="last").orderBy("section").collect()
    assert sum(r.n_tokens for r in last) == len(whole.encode("a\n\n\nb", add_special_tokens=False).ids)


def test_packing(spark, whole):
    texts = some_texts()
    got = packing.pack(documents(spark, texts)).orderBy("doc_id", "piece").collect()
    ids = expected(whole, texts, 0)
    for d, x in enumerate(ids):
        own = [r for r in got if r.doc_id == d]
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(x) // 2048)
        assert sum(r.length for r in own) == len(x) and all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    assert len(used) == -(-sum(map(len, ids)) // 2048)
    assert packing.pack(documents(spark, [])).count() == 0


def best(lengths, size):
    """The least number of sequences, by trying everything."""
    lengths = sorted(lengths, reverse=True)

    def fits(k):
        def place(i, rooms):
            if i == len(lengths):
                return True
            for j in {r: j for j, r in enumerate(rooms)}.values():
                if rooms[j] >= lengths[i] and place(i + 1, rooms[:j] + (rooms[j] - lengths[i],) + rooms[j + 1 :]):
                    return True
            return False

        return place(0, (size,) * k)

    return next(k for k in range(len(lengths) + 1) if fits(k))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_plan_is_close_to_the_best_and_what_it_fixes_is_optimal(lengths):
    counts = np.bincount(lengths, minlength=13)
    p = packing.plan(counts)
    used, rest = np.zeros(p.n_sequences, int), []
    for n, first, times, base, _ in zip(p.length, p.first, p.times, p.base, p.offset):
        used[base : base + times] += n
        rest += [int(n)] * sum(k >= p.n_fixed for k in range(base, base + times))
    assert used.sum() == sum(lengths) and (used <= 12).all()
    assert best(lengths, 12) <= p.n_sequences <= best(lengths, 12) + 1
    assert best(lengths, 12) == p.n_fixed + best(rest, 12)


@pytest.mark.parametrize("group", [packing.GROUP, 3])
def test_packing_of_repeated_rows_and_null_ids(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    docs = documents(spark, ["a b c"] * 20 + ["<|endoftext|> x"] * 3 + [None, ""], [7] * 10 + [None] * 10 + [1, 1, 2, 3, None])
    got = packing.pack(docs, sequence=16).collect()
    assert len(got) == 25
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(some)]).tolist()]
        assert [o for o, _ in sorted(some)] == ends[:-1] and ends[-1] <= 16


def test_files_and_counts_of_no_rows_null_ids_and_repeated_rows(spark, whole):
    assert token_files.round_trip(documents(spark, [])).count() == 0
    assert token_counts.section_token_counts(documents(spark, [])).count() == 0
    docs = documents(spark, ["b c\r\nd", "a", "a", "<|endoftext|>", None], [4, None, 4, 2, None])
    got = token_files.round_trip(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 2, 4, 4]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert sorted(r.n_tokens for r in got) == sorted(len(x) for x in expected(whole, ["b c\r\nd", "a", "a", "<|endoftext|>", None], 2))
    counts = token_counts.section_token_counts(docs).collect()
    assert sorted((str(r.doc_id), r.section, r.n_tokens) for r in counts) == sorted([("None", 0, 1), ("None", 0, 0), ("2", 0, 1), ("4", 0, 4), ("4", 1, 1), ("4", 0, 1)])


#: Letters, signs and white space that stand beside each other in all ways.
ODD = ["a", "Z", "é", "ß", "×", "÷", "中", "…", "—", "'", "'s", "'ll", "’", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\xa0", "\u3000", ",", ".", "!?", "$$$", "_", "12", "3.14", "😀", "<|endoftext|>", "<", "word", "\x00", "\x85", "½", "(", "\x1f", "ﬁ", "l'été", "don't", "I'M", "x" * 300]


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_of_columns(seed, monkeypatch):
    import random

    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokens.vocabulary()), tokens.Ids(tokens.vocabulary())
    monkeypatch.setattr(tokens, "CAPACITY", 3000)  # so that much is forgotten on the way
    rng = random.Random(seed)
    for k in range(60):
        texts = ["".join(rng.choice(ODD) + " " * (rng.random() < 0.4) for _ in range(rng.randint(0, 14))) for _ in range(40)] + [None, ""]
        texts = [x.strip() if x and k % 3 == 0 else x for x in texts]
        ids, bounds = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert own.encode([])[1].tolist() == [0] and own.encode([None, ""])[1].tolist() == [0, 0, 0]


def test_ids_of_a_tokenizer_that_may_not_be_cut(tmp_path):
    import json

    from tokenizers import Tokenizer

    told = json.load(open(tokens.vocabulary(), encoding="utf-8"))
    told["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    texts = ["a b, c", "", " x", "$$ y\nz"]
    ids, bounds = tokens.Ids(str(path)).encode(texts)
    library = Tokenizer.from_file(str(path))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(x, add_special_tokens=False).ids for x in texts]
