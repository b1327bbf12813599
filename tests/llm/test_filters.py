"""SimHash, line dedup, quality, personal data and decontamination against plain restatements."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from edge_cases import WORD, documents, some_texts

from chronoweave.llm import decontaminate, line_dedup, pii, quality, simhash


def fingerprint(text, k=3):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, bits=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if i < j and (a ^ b).bit_count() <= bits:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    texts = some_texts(5) + ["A b C d", "a B c D"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    want = components(list(range(len(texts))), prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in enumerate(prints)}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_links_find_every_near_fingerprint(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(prints)[:20]:
        for _ in range(8):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    from chronoweave.llm.components import components as roots

    got = {r.node: r.root for r in roots(simhash.links(df)).collect()}
    signed = {x - (1 << 64) if x >> 63 else x for x in prints}
    want = components(sorted(signed), [x & (2**64 - 1) for x in sorted(signed)])
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({k: got.get(k, k) for k in signed}) == groups(want)


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ["a b c d", "a b c d", "q w e r t", None, ""], [3, 1, 2, 8, None])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2, 8]
    assert simhash.keep_one(docs).columns == docs.columns


def near_words(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(docs):
    lines = [((d, k), [w for w in re.split(r"[ \t-\r]+", x) if w]) for d, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    long = lambda *ws: min(map(len, ws)) >= line_dedup.MIN_WORDS
    return {p for p, w in lines if w and any(q < p and (w == v or long(w, v) and near_words(w, v)) for q, v in lines)}


def test_lines(spark):
    base = [f"word{i}" for i in range(12)]
    variants = [" ".join(base), " ".join(base[:5] + ["other"] + base[6:]), " ".join(base[1:]), " ".join(base[:-1]), " ".join(["new"] + base), " ".join(base[:6] + ["in"] + base[6:]), " ".join(base[:3] + ["x", "y"] + base[5:]), "  ".join(base), " ".join(base[2:])]
    texts = some_texts(6)[:-2] + ["\n".join(variants[::-1]), variants[0] + "\nshort line\n" + variants[3], "short line\nshort line"]
    docs = list(enumerate(texts))
    gone = brute_lines(docs)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    for d, t in docs:
        if t is None:
            assert (got[d].text, got[d].n_lines, got[d].n_removed) == (None, 0, 0)
            continue
        parts = t.split("\n")
        kept = "\n".join(x for k, x in enumerate(parts) if (d, k) not in gone)
        assert (got[d].text, got[d].n_lines, got[d].n_removed) == (kept, len(parts), len(parts) - sum((d, k) not in gone for k in range(len(parts))))
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_lines_of_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(10))
    got = sorted((r.doc_id or -1, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, [t, t, t], [None, 4, 4])).collect())
    assert got == [(-1, 0), (4, 1), (4, 1)]


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    n = {}
    for k in range(len(w) - 2):
        n.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for at in n.values() if len(at) > 1 for k in at for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_base_rules(spark):
    texts = some_texts(7) + ["a b c a b c", "x\nx\n\n\nx y\nx", "# * $ % & | < >"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(documents(spark, texts), labels).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert all(r.kept == (not r.base_failed) for r in got)  # nothing to learn from


def test_quality_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    some, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.score(docs, some).where("NOT base_failed").join(rest, "doc_id").toPandas()
    assert ((got["kept"] == (got["quality"] == 1)).mean()) > 0.95
    assert set(quality.keep_good(docs, some).columns) == set(docs.columns)


def test_personal_data(spark):
    texts = ["mail a.b@c.de, x@y and _q@r.s.t@u.v.w", "ip 1.2.3.4 300.1.1.1 1.2.3.4.5 010.001.000.255", "card 4111 1111 1111 1111 and 4111111111111112", "+1 (555) 123-4567 or +44 1 or (555) 123-4567", "call me: 555-123-4567", "9" * 3000, None, "", "é@ü.de", "me at host dot com"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m)), "phone": lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15}
    for r in pii.find(documents(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(patterns) for m in re.finditer(patterns[kind], t) if ok[kind](m[0]))
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert pii.find(documents(spark, [])).count() == 0


def test_em_follows_the_labelers_that_agree():
    code = lambda kind, base, *v: pii._code(kind, base, v)
    yes, no = code(3, False, 1, 2, 2, 2, 1), code(2, False, 0, 0, 0, 0, 1)
    p = pii.fit({yes: 100, no: 300, code(3, True, 2, 2, 2, 1, 1): 200, code(2, True, 2, 2, 2, 1, 1): 100})
    assert p[yes] >= pii.ACCEPT and p[no] < 0.1
    assert pii._decode(pii._code(3, True, (2, 0, 1, 2, 0), (1, 0, 1, 1))) == (3, True, [2, 0, 1, 2, 0], [1, 0, 1, 1])


def test_recall_of_added_spans(spark):
    import random

    rng = random.Random(4)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    prose = lambda: " ".join(word() for _ in range(30))
    planted = [
        lambda: ("email", "contact ", f"{word()}.{word()} at {word()} dot com"), lambda: ("email", "write to ", f"{word()} [at] {word()} [dot] org"),
        lambda: ("phone", "call ", f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{d(4)}"), lambda: ("phone", "tel. ", f"00{rng.choice(['44', '49', '33'])} {d(3)} {d(7)}"),
        lambda: ("ip", "server ", f"{rng.randint(1, 126)}[.]{rng.randint(1, 255)}[.]{rng.randint(1, 255)}[.]{rng.randint(1, 255)}"), lambda: ("ip", "host ", ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8))),
    ]
    harmless = [lambda: f"order {d(16)}", lambda: f"at {rng.randint(10, 23)}:{rng.randint(10, 59)}:30", lambda: f"sha=\"{d(3)}-{d(3)}-{d(4)}", lambda: f"version {d(2)}.{d(2)}", lambda: "meet at home dot", lambda: "std::vector a::b"]
    base = [lambda: f"mail {word()}@{word()}.com", lambda: f"+44 {d(4)} {d(6)}", lambda: f"ip {rng.randint(1, 126)}.1.2.3", lambda: "card 4111 1111 1111 1111"]
    texts, wanted = [], set()
    for i in range(600):
        kind, cue, span = rng.choice(planted)()
        text = prose() + " " + rng.choice(harmless)() + " and " + rng.choice(base)() + " " + prose() + " " + cue
        wanted.add((i, kind, len(text), len(text) + len(span)))
        texts.append(text + span + ", " + prose() + " " + rng.choice(harmless)())
    added = set()
    for r in pii.find(documents(spark, texts)).collect():
        own = {(pii.KINDS[k], s, e) for s, k, e in pii.base_spans(texts[r.doc_id])}
        added |= {(r.doc_id, k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(","))} - {(r.doc_id, *x) for x in own}
    assert len(added & wanted) >= 0.9 * len(wanted)
    assert len(added & wanted) >= 0.9 * len(added)


def test_personal_data_of_null_ids_and_repeated_rows(spark):
    got = pii.find(documents(spark, ["a@b.de", "a@b.de", "c@d.fr"], [None, 2, 2])).collect()
    assert sorted((str(r.doc_id), r.n_email) for r in got) == [("2", 1), ("2", 1), ("None", 1)]


ITEM = "If Anna buys 12 apples for 3 dollars each and then sells 5 of them to Bob who pays 4 dollars for every apple how much money does Anna have left after all"


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, limit):
    filler = "some clean words that stand before and after it in the document without any meaning at all"
    texts = [
        f"{filler} {ITEM} {filler}",
        filler + " " + ITEM.replace("Anna", "Maria").replace("12", "30").replace("Bob", "Tom") + " " + filler,
        filler + " " + ITEM.replace("Anna buys", "Maria buys").replace("12", "30").replace("Bob who", "Tom who").replace("pays 4 dollars", "pays 6 euros") + " " + filler,  # Anna stays elsewhere: not one for one
        filler, None, "", ITEM.upper(), "(" + ITEM.replace(" apples", ' "apples"') + ")",
    ]
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (4, ITEM + " unrelated"), (1, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(documents(spark, texts), bench, limit).collect()}
    assert {(0, 1, "exact"), (1, 1, "replaced"), (7, 1, "exact")} <= got
    assert {d for d, _, _ in got} == {0, 1, 7}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(documents(spark, texts), bench, limit).collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.leaks(documents(spark, []), bench, limit).count() == 0
    assert decontaminate.leaks(documents(spark, texts), bench.where("false"), limit).count() == 0
