"""Spelling variants, HTML extraction and conversation repair against restatements on small inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from edge_cases import documents, some_texts

from chronoweave.llm import conversations as cv, html_text as ht, spelling as sp


def _words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def _one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(n):
    form = {}
    near = {w: [v for v in n if v != w and _one_apart(v, w)] for w in n}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def _misspelt(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿÀz") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    lines = []
    for w in base:
        lines += [w] * rng.choice([1, 2, 30, 400])
        for _ in range(6):
            i = rng.randrange(len(w))
            lines += [w[:i] + rng.choice(["", "a", "b", w[i] * 2, "zz"]) + w[i + 1 :]] * rng.choice([1, 2, 3])
    rng.shuffle(lines)
    return [" ".join(lines[k::7]) + (". X-" if k % 2 else "×\t") for k in range(7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed):
    texts = _misspelt(seed) + some_texts(seed) + ["aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaab aaaaaaaab"]
    ids = [None if i % 9 == 5 else i for i in range(len(texts))]
    got = sp.spelling_variants(documents(spark, texts, ids))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = _variants(_words(zip(ids, texts)))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50 and any(r[1] for r in want)


def test_spelling_chains_and_nothing(spark):
    words = {"aaaaaaa": 10000, "aaaaaab": 900, "aaaaabb": 80, "aaaabbb": 7, "ccccccc": 5}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in sp.variants(table).collect()} == _variants(words)
    assert sp.spelling_variants(documents(spark, [])).count() == 0
    assert sp.spelling_variants(documents(spark, [None, "", "no long ones"])).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    texts = _misspelt(3)
    monkeypatch.setattr(sp, "MOST_BITS", 6)
    assert {tuple(r) for r in sp.spelling_variants(documents(spark, texts)).collect()} == _variants(_words(enumerate(texts)))


PAGE = """<!doctype html><html><head><title>Title &amp; more</title><style>p{}</style></head><body class="has-sidebar">
<header class="top"><h1>Site</h1></header><nav><a href=1>One</a></nav><div id="cookie-notice">We use cookies</div><div class="wrap"><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1></header><p>One  two
 <b>th</b>ree <a href=x>link</a>&nbsp;&eacute;&#8211;.<p>Short<br>line<ul><li>a<li>b</ul><script>no("</p>")</script><form><input value=1>Send</form><section><h2>S</h2><div>Loose<p>Last</p>end</div></section>
<section class="comments"><article class="comment"><p>I like this very much indeed, what a good long comment.</p></article></section></article>
<aside>Side</aside></div><footer>&copy; All</footer></body></html>"""


def test_main_text():
    assert ht.main_text(PAGE) == "Head & line\nOne two three link é–.\nShort line\na\nb\nS\nLoose\nLast\nend"
    body = "<div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><div><h1>Title</h1><div>%s<p>short</p></div><div>%s</div></div><div>Imprint</div>"
    one, two = ("".join(f"<p>{w} part of the text, long enough, {k}.</p>" for k in range(9)) for w in ("first", "second"))
    lines = ht.main_text(body % (one, two)).split("\n")
    assert lines[0] == "Title" and lines[10] == "short" and len(lines) == 20  # no article element: density finds both parts and nothing around them
    assert ht.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert ht.main_text("<table><tr><td>x<td>y<tr><td>z</table>") == "x y\nz"
    assert ht.main_text("") == ht.main_text("<!-- never closed <p>x") == ht.main_text("<nav>x</nav>") == ""
    assert ht.main_text("<p>cut <b") == "cut" and ht.main_text("<div>" * 5000 + "deep" + "<p>" * 5000) == "deep"
    assert ht.main_text("<article><p>" + "w " * 2_000_000 + "</article>") == " ".join(["w"] * 2_000_000)


def test_extract(spark, sf):
    rows = [(1, "u", PAGE, 3, "x"), (1, "u", PAGE, 3, "x"), (None, None, None, 3, "x"), (2, "v", "", 3, "x"), (3, "w", "<p>a</p>", None, None)]
    got = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string"))
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, len(ht.main_text(PAGE))), (1, len(ht.main_text(PAGE))), (2, 0), (3, 1)]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    # the articles of the given pages, by their tags alone
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    texts = {r.page_id: r.text for r in ht.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)(?:</article>|<footer|$)", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert texts[r.page_id] == "\n".join(b for b in blocks if b)


def _turns(rows):
    """Turns after the damage, in order, with their faults."""
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k != 0:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    by = defaultdict(list)
    for conv, turn, role, text in out:
        by[conv].append((turn, role, text))
    for turns in by.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
    return by


def _report(rows):
    by, out = _turns(rows), set()
    for conv in {r[0] for r in rows}:
        turns, seen, faults = by.get(conv, []), set(), []
        for _, role, text in turns:
            core = re.sub("[\x20\x09-\x0d]+$", "", text)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in turns]
        numbers = {t for t, _, _ in turns if t is not None}
        best = (0, "", [])
        if turns:
            best = None
            # every choice for every turn, and insertions in every gap; roles are tried, not derived
            gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
            frontier = {(): (0, "")}
            for k in range(len(turns) + 1):
                grown = {}
                for done, (cost, audit) in frontier.items():
                    for gap in gaps:
                        at, c, a = done + tuple((g, "") for g in gap), cost + 5 * len(gap), audit + "I" * len(gap)
                        nexts = [(at, c, a)]
                        if k < len(turns):
                            _, role, text = turns[k]
                            nexts = [(at, c + 2, a + "D")]
                            if faults[k] not in ("blank", "duplicate"):
                                more = 5 * (faults[k] == "truncated")
                                nexts += [(at + ((role, text),), c + more, a + "K")] + [(at + ((r, text),), c + more + 1, a + "R") for r in ("user", "assistant")]
                        for at2, c2, a2 in nexts:
                            if re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] for r, _ in at2)) and all(r[:1] for r, _ in at2):
                                grown[at2] = min(grown.get(at2, (c2, a2)), (c2, a2))
                frontier = grown
            best = min((c, a, list(at)) for at, (c, a) in frontier.items() if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in at)))
        text = "\n".join(f"{r}:{t}" for r, t in best[2])
        gap = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        out.add((conv, gap, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(text.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, i int, audit string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], CONVERSATIONS)


def test_conversation_repair(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""])
            rows.append((None if conv == 7 else conv, rng.choice([turn, turn + 1, None, turn]), role, rng.choice(["Fine.", "So?", "cut off", " \t", "", None, f"own {turn}!", "end. \n"])))
    rows += rows[:5]
    got = cv.report(_frame(spark, rows))
    assert {tuple(r) for r in got.collect()} == _report(rows)
    assert cv.report(_frame(spark, [])).count() == 0
    gone = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = cv.report(_frame(spark, [(gone, 0, "user", "x")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversations_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"{t}."])) for c in (1, 2) for t in range(700)]
    whole = {tuple(r) for r in cv.report(_frame(spark, rows)).collect()}
    monkeypatch.setattr(cv, "PIECE", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert {tuple(r) for r in cv.report(_frame(spark, rows)).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hi.", 1), (1, 1, "assistant", "Yes.", 1), (1, 2, "user", "No.", 2), (2, 0, "user", " ", 1)], "conv_id long, turn long, role string, text string, copies int")
    found = cv.verdicts(turns)
    assert {(r.conv_id, r.audit, r.cost, r.blank, r.duplicate) for r in found.collect()} == {(1, "RKDD", 5, 0, 1), (2, "D", 2, 1, 0)}
    rows = [tuple(r)[1:] for r in cv.repaired(turns, found).where("conv_id = 1").orderBy("place").collect()]
    assert rows == [(0, "R", "user", "Hi."), (1, "K", "assistant", "Yes.")]
