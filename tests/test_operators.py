"""Small cases with known answers: edges, ties, empty inputs, and what SQL can't say."""

from contextlib import contextmanager
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronoweave.operators import alignment, intervals, review, scan, tracks, transcripts
from chronoweave.sources import recordings, schemas

SPAN = "job_id long, t_in double, t_out double, kind string, ord int"


def spans(spark, *rows):
    return spark.createDataFrame([(1, a, b, k, o) for a, b, k, o in rows], SPAN)


def test_merge_keeps_the_earliest_kind_and_the_listed_order_on_ties(spark):
    got = intervals.merge(spans(spark, (0.0, 1.0, "filler", 1), (0.0, 0.5, "silence", 0), (1.0, 2.0, "filler", 1), (3.0, 4.0, "filler", 1))).orderBy("t_in").collect()
    assert [(r.t_in, r.t_out, r.kind) for r in got] == [(0.0, 2.0, "silence"), (3.0, 4.0, "filler")]


def test_complement_of_nothing_is_everything(spark):
    d = spark.createDataFrame([(1, 10.0)], "job_id long, duration double")
    got = intervals.complement(spans(spark), d).collect()
    assert [(r.t_in, r.t_out) for r in got] == [(0.0, 10.0)]


@pytest.mark.parametrize("budget,tier,total", [(10.0, "optional", 10.0), (9.0, "supporting", 7.0), (5.0, "essential", 4.0), (2.0, "essential", 4.0)])
def test_the_loosest_tier_that_fits(spark, budget, tier, total):
    s = spark.createDataFrame([(1, "essential", 4.0), (1, "supporting", 3.0), (1, "optional", 3.0)], "job_id long, tier string, dur double")
    r = intervals.budget_threshold(s, spark.createDataFrame([(budget,)], "budget double")).first()
    assert (r.tier, r.total, r.overrun) == (tier, total, max(0.0, total - budget))


def test_expected_words_of_two_spans(spark):
    w = spark.createDataFrame([(1, i, 0.4 * i, 0.4 * i + 0.32, t) for i, t in enumerate("one two three four five six".split())], "job_id long, ix int, t_in double, t_out double, text string")
    s = spark.createDataFrame([(1, 0, 0.0, 0.8, 0.0), (1, 1, 1.6, 2.4, 0.8)], "job_id long, span_ix int, source_in double, source_out double, output_in double")
    got = intervals.expected_words(w, s).orderBy("ix").collect()
    assert [r.text for r in got] == ["one", "two", "five", "six"]
    assert got[2].t_in == pytest.approx(0.8)


def test_hold_over_a_long_gap_even_at_the_sample_itself(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0), (1, 1.1, 0.0, 0.0)], "job_id long, t double, x double, y double")
    q = spark.createDataFrame([(1, 1.0), (1, 1.05), (1, 5.0)], "job_id long, t double")
    got = {r.t: r.x for r in tracks.position_at(q, t, 0.15).collect()}
    assert got[1.0] == 0.0 and got[1.05] == pytest.approx(0.5) and got[5.0] == 0.0


def test_linear_without_samples_is_the_middle(spark):
    t = spark.createDataFrame([], "job_id long, t double, x double, y double")
    r = tracks.position_linear(spark.createDataFrame([(1, 1.0)], "job_id long, t double"), t).first()
    assert (r.x, r.y) == (0.5, 0.5)


def plain_steps(a, b):
    """An optimal alignment from the whole table: from the end, pairs before omissions before insertions."""
    table = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = min(table[i - 1][j - 1] + (x != y), table[i - 1][j] + 1, table[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and table[i][j] == table[i - 1][j] + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), max_size=60))
def test_alignment_is_optimal_and_in_order(a, b):
    codes = [np.array([ord(c) for c in x], np.int64) for x in (a, b)]
    steps = list(zip(*(x.tolist() for x in alignment.places(alignment.edits(*codes)))))
    assert steps == plain_steps(a, b)
    small, alignment.SMALL = alignment.SMALL, 0  # rows made again on the way back
    try:
        assert list(zip(*(x.tolist() for x in alignment.places(alignment.edits(*codes))))) == steps
    finally:
        alignment.SMALL = small
    assert [i for i, _ in steps if i >= 0] == list(range(len(a))) and [j for _, j in steps if j >= 0] == list(range(len(b)))
    assert sum(i < 0 or j < 0 or a[i] != b[j] for i, j in steps) == distance(a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_anchors_are_the_longest_runs(a, b):
    codes = [np.array([ord(c) for c in x], np.int64) for x in (a, b)]
    pairs = [(i + k, j + k) for i, j, n in alignment.common_runs(*codes) for k in range(n)]
    assert pairs == [(m.a + k, m.b + k) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]


def test_long_transcripts_in_little_memory():
    rng = np.random.default_rng(3)
    a = rng.zipf(1.3, 20_000) % 5000
    b = a[rng.random(len(a)) > 0.01].copy()
    b[rng.random(len(b)) < 0.01] = 5001
    import tracemalloc

    tracemalloc.start()
    kinds = alignment.edits(a, b)
    runs = alignment.common_runs(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # the table would be 1600 MB
    tracemalloc.stop()
    i, j = alignment.places(kinds)
    assert (i[i >= 0] == np.arange(len(a))).all() and (j[j >= 0] == np.arange(len(b))).all()
    assert ((kinds == alignment.MATCH) == [x >= 0 and y >= 0 and a[x] == b[y] for x, y in zip(i, j)]).all() and (kinds != 0).sum() < 500
    assert sum(n for *_, n in runs) > 19_000


def plain_wer(reference, hypothesis):
    import re

    a, b = (re.sub(r"[^a-z0-9\s]", " ", x.lower()).split() for x in (reference, hypothesis))
    return round(distance(a, b) / len(a), 4) if a else 0.0


def test_plain_error_rate(spark):
    many = " ".join(f"w{i}" for i in range(300))
    pairs = [("Don't stop, now!", "dont stop now"), ("", "some words"), ("a b c", None), ("é ß x", "x"), (many, many.replace("w7 ", "x ").replace("w250", "")), ("same words", "same words")]
    df = spark.createDataFrame([(i, e, h) for i, (e, h) in enumerate(pairs)], "job_id long, expected string, heard string")
    assert {r.job_id: r.wer for r in transcripts.plain_error_rate(df).collect()} == {i: plain_wer(e, h or "") for i, (e, h) in enumerate(pairs)}


def test_tree_sum_at_any_depth_and_in_cycles(spark):
    chain = [(i, i - 1 if i else None, 1) for i in range(60)]
    cycle = [(100, 102, 5), (101, 100, 7), (102, 101, 9), (103, 102, 1), (104, 104, 2)]
    got = {r.root: r.total for r in review.tree_sum(spark.createDataFrame(chain + cycle, "pid long, parent long, rss long")).collect()}
    assert got == {i: 60 - i for i in range(60)} | {100: 22, 101: 22, 102: 22, 103: 1, 104: 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_sum_of_any_graph(spark, seed):
    import random

    rng = random.Random(seed)
    parent = {i: rng.choice([None, i, 999, *range(40)]) for i in range(40)}
    parent |= {50: 51, 51: 50, 52: 50, 53: 52, 54: 51, 60: 61, 61: 62, 62: 60}
    rss = {i: rng.randint(0, 9) for i in parent}

    def below(root):
        seen, todo = set(), [root]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [i for i, p in parent.items() if p == x]
        return sum(rss[i] for i in seen)

    rows = [(i, p, rss[i]) for i, p in parent.items()]
    got = {r.root: r.total for r in review.tree_sum(spark.createDataFrame(rows, "pid long, parent long, rss long")).collect()}
    assert got == {i: below(i) for i in parent}


def test_tree_sum_of_a_long_chain(spark):
    chain = spark.range(100_000).selectExpr("id AS pid", "CASE WHEN id > 0 THEN id - 1 END AS parent", "1L AS rss")
    r = review.tree_sum(chain).selectExpr("count(*) AS n", "sum(abs(total - (100000 - root))) AS off").first()
    assert (r.n, r.off) == (100_000, 0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60)), max_size=12), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60)), max_size=12))
def test_interval_joins_in_buckets_find_what_a_plain_join_finds(spark, a, b):
    cols = "job_id long, t_in double, t_out double, kind string, ord int"
    left, right = (spark.createDataFrame([(i % 2, t / 3, (t + n) / 3, "k", i) for i, (t, n) in enumerate(x)], cols) for x in (a, b))
    rows = lambda x: [(i % 2, t / 3, (t + n) / 3, i) for i, (t, n) in enumerate(x)]
    meets = lambda x, y: x[0] == y[0] and x[1] < y[2] - 1e-6 and y[1] < x[2] - 1e-6
    other = right.selectExpr("job_id j", "t_in o_in", "t_out o_out", "ord o")
    assert sorted((r.ord, r.o) for r in intervals.meeting(left, "t_in", "t_out", other, "o_in", "o_out").collect()) == sorted((x[3], y[3]) for x in rows(a) for y in rows(b) if meets(x, y))
    assert sorted(r.ord for r in intervals.overlapping(left, right).collect()) == sorted(x[3] for x in rows(a) if any(meets(x, y) for y in rows(b)))
    assert sorted(r.ord for r in intervals.overlapping(left, right, "left_anti").collect()) == sorted(x[3] for x in rows(a) if not any(meets(x, y) for y in rows(b)))


def test_word_diff_and_rate(spark):
    cols = "job_id long, ix int, t_in double, t_out double, text string"
    e = spark.createDataFrame([(1, i, i * 0.4, i * 0.4 + 0.3, t) for i, t in enumerate("One, two three four".split())], cols)
    h = spark.createDataFrame([(1, i, i * 0.4, i * 0.4 + 0.3, t) for i, t in enumerate("one too three four five".split())], cols)
    got = [(r.kind, r.expected, r.actual) for r in transcripts.word_diff(e, h).orderBy("step").collect()]
    assert got == [("substitution", "two", "too"), ("insertion", None, "five")]
    r = transcripts.word_error_rate(e, h, spark.createDataFrame([(1, 0.5)], "job_id long, cut double")).first()
    assert (r.n_real, r.n_at_seam, r.wer) == (1, 1, 0.25)


def plain_blocks(words, limit, pause, least):
    import re

    out, block, size, count = [], 0, 0, 0
    for k, (a, b, text) in enumerate(words):
        last = k + 1 == len(words)
        ends = not last and (re.search("[.!?…]['\")\\]]*$", text) is not None or words[k + 1][0] - b >= pause)
        if count and size + len(text) + 1 > limit:
            block, size, count, stop = block + 1, len(text), 1, False
        else:
            size, count = size + 1 + len(text) if count else len(text), count + 1
            stop = count >= least and ends
        out.append(block)
        if stop:
            block, size, count = block + 1, 0, 0
    return out


@pytest.mark.parametrize("limit,least", [(42, 2), (10, 3), (300, 2)])
def test_blocks_by_jumps(spark, monkeypatch, limit, least):
    import random

    rng = random.Random(limit)
    jobs = {}
    for job, n in enumerate([1, 2, 7, 255, 256, 257, 700, 1500]):
        t, words = 0.0, []
        for _ in range(n):
            t += rng.choice([0.0, 0.1, 0.5])
            words.append((t, t + 0.3, "x" * rng.choice([0, 1, 2, 5, 9, 60]) + rng.choice(["", "", "", ".", '?"', "…"])))
            t += 0.3
        jobs[job] = words
    rows = [(j, i, a, b, x) for j, ws in jobs.items() for i, (a, b, x) in enumerate(ws)]
    df = spark.createDataFrame(rows, "job_id long, ix int, t_in double, t_out double, text string")
    monkeypatch.setattr(transcripts, "PIECE", 64)
    got = {}
    for r in transcripts.pack_blocks(df, limit, min_words=least).orderBy("job_id", "ix").collect():
        got.setdefault(r.job_id, []).append(r.block)
    assert got == {j: plain_blocks(ws, limit, 0.45, least) for j, ws in jobs.items()}
    assert transcripts.pack_blocks(df.where("false"), limit).count() == 0


WORDS = "job_id long, ix int, t_in double, t_out double, text string"


@pytest.mark.parametrize("batch", [1, 5, 64])
def test_blocks_go_on_from_batch_to_batch(spark, batch):
    import random

    rng = random.Random(batch)
    jobs = {j: [(i * 0.5, i * 0.5 + rng.choice([0.0, 0.1, 0.4]), "x" * rng.choice([0, 1, 3, 8, 50]) + rng.choice(["", "", "."])) for i in range(n)] for j, n in enumerate([1, 2, 5, 6, 64, 65, 300])}
    rows = [(j, i, *w) for j, ws in jobs.items() for i, w in enumerate(ws)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in transcripts.pack_blocks(spark.createDataFrame(rows, WORDS), 20, min_words=3).orderBy("job_id", "ix").collect():
            got.setdefault(r.job_id, []).append(r.block)
            assert (r.t_in, r.t_out, r.text) == jobs[r.job_id][r.ix]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {j: plain_blocks(ws, 20, 0.45, 3) for j, ws in jobs.items()}


def test_blocks_are_made_in_one_pass(spark):
    df = spark.range(4000).selectExpr("id % 40 AS job_id", "CAST(id AS int) AS ix", "id * 0.4D AS t_in", "id * 0.4D + 0.3 AS t_out", "'word' AS text")
    plan = transcripts.pack_blocks(df, 42)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("Range (") == 1


def test_words_at_one_place_stay_as_many_as_they_are(spark):
    words = [(0.0, 0.3, "aa"), (0.1, 0.4, "bb"), (0.2, 0.5, "cc"), (0.3, 0.6, "dd")]
    df = spark.createDataFrame([(1, i // 2, *w) for i, w in enumerate(words)] + [(1, None, 0.0, 0.1, "x"), (None, 0, 0.0, 0.1, "x")], WORDS)
    got = [(r.text, r.block) for r in transcripts.pack_blocks(df, 8).orderBy("t_in").collect()]
    assert got == list(zip(["aa", "bb", "cc", "dd"], plain_blocks(words, 8, 0.45, 2))) and got[-1][1] == 1


@pytest.mark.parametrize("limit,least", [(10, 2), (42, 3), (100, 2)])
def test_blocks_of_hot_jobs(spark, monkeypatch, limit, least):
    import random

    rng = random.Random(limit)
    jobs = {j: [(i * 0.5, i * 0.5 + rng.choice([0.0, 0.1, 0.4]), "x" * rng.choice([0, 0, 1, 3, 8, 120]) + rng.choice(["", "", "."])) for i in range(n)] for j, n in enumerate([1, 63, 64, 65, 102, 103, 130, 900])}
    # every other place holds two words
    rows = [(j, i - i % 4 % 3 // 2, *w) for j, ws in jobs.items() for i, w in enumerate(ws)]
    monkeypatch.setattr(transcripts, "PIECE", 64)
    with hot_jobs(spark):
        got = {}
        for r in transcripts.pack_blocks(spark.createDataFrame(rows, WORDS), limit, min_words=least).orderBy("job_id", "t_in").collect():
            got.setdefault(r.job_id, []).append((r.t_in, r.t_out, r.text, r.block))
    assert got == {j: [(*w, k) for w, k in zip(ws, plain_blocks(ws, limit, 0.45, least))] for j, ws in jobs.items()}


def test_aligned_words_stay_in_order_and_inside(spark):
    script = spark.createDataFrame([(1, i, t) for i, t in enumerate("a b c d e f".split())], "job_id long, ix int, text string")
    heard = spark.createDataFrame([(1, 0, 0.1, 0.2, "b"), (1, 1, 0.5, 0.6, "e")], "job_id long, ix int, t_in double, t_out double, text string")
    got = transcripts.align_words(script, heard, spark.createDataFrame([(1, 0.65)], "job_id long, duration double")).orderBy("ix").collect()
    assert [r.anchored for r in got] == [False, True, False, False, True, False]
    assert all(x.t_out <= y.t_in + 1e-9 for x, y in zip(got, got[1:])) and got[-1].t_out <= 0.65 + 1e-9
    assert SequenceMatcher(None, "abcdef", "be", autojunk=False).ratio() > 0


@pytest.mark.parametrize("fraction", [0.0, 0.37, 0.9, 1.0])
def test_nearest_rank_of_odd_values(spark, fraction):
    inf = float("inf")
    jobs = {1: [1e300, -1e300, 0.0, 1e-300, 2e-300, -1e-300, 5.0], 2: [7.0] * 9, 3: [inf, -inf, 0.0, 1.0], 4: [2.0], 5: [k**0.5 for k in range(3000)] + [3.0] * 500, 6: [inf] * 3 + [1.0]}
    rows = [(j, x) for j, xs in jobs.items() for x in xs] + [(1, None), (9, None)]
    got = {r.job_id: r.value for r in review.nearest_rank(spark.createDataFrame(rows, "job_id long, value double"), fraction).collect()}
    assert got == {j: sorted(xs)[min(round(fraction * (len(xs) - 1)), len(xs) - 1)] for j, xs in jobs.items()} | {9: None}


@contextmanager
def hot_jobs(spark):
    spark.conf.set(scan.HOT_JOBS, "true")
    try:
        yield
    finally:
        spark.conf.unset(scan.HOT_JOBS)


def test_running_values_in_chunks_are_those_of_one_window(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, rng.uniform(-50, 50), float(rng.randint(-5, 5))]), i, rng.uniform(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "job_id long, t double, i int, x double")
    at, order = F.col("t"), ["t", "i"]
    run = lambda inc: scan.running(df, at, order, {"m": ("max", F.col("x")), "s": ("sum", F.lit(1))}, inc)
    near = lambda back: scan.neighbour(df, at, order, {"o": "i", "y": "x"}, back)
    known = df.withColumn("v", F.when(F.col("i") % 7 == 0, F.col("x")))
    results = lambda: [sorted(map(repr, d.collect())) for d in (run(True), run(False), near(True), near(False), scan.around(known, at, order, "v"))]
    whole = results()
    by_job = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by_job.setdefault(r[0], []).append(r[2])
    assert {r.i: r.s for r in run(True).collect()} == {i: k + 1 for ids in by_job.values() for k, i in enumerate(ids)}
    assert {r.i: r.o for r in near(False).collect()} == {i: n for ids in by_job.values() for i, n in zip(ids, [*ids[1:], None])}
    monkeypatch.setattr(scan, "CHUNK", 0.75)
    with hot_jobs(spark):
        assert results() == whole


def test_tracks_in_chunks(spark, monkeypatch):
    import random

    rng = random.Random(12)
    rows = [(j, round(t, 2), rng.random(), rng.random(), rng.choice(["click", "dwell", "movement"])) for j in (1, 2) for t in sorted({rng.uniform(0, 60) for _ in range(90)})]
    track = spark.createDataFrame([*rows, (3, 1.0, 0.5, 0.5, "click"), (1, rows[5][1], 0.1, 0.1, "click")], "job_id long, t double, x double, y double, kind string")
    d = spark.createDataFrame([(1, 61.0), (2, 70.0)], "job_id long, duration double")
    cuts, other = track.where("kind = 'click'").select("job_id", F.col("t").alias("cut")), track.where("kind = 'dwell'").select("job_id", F.col("t").alias("cut"))
    single = track.dropDuplicates(["job_id", "t"]).cache()
    results = lambda: [sorted(map(repr, x.collect())) for x in (tracks.resample(single, d, 3.0), tracks.upper_median_gap(single), tracks.sampling_stats(single).drop("mean_gap"), tracks.clusters(track, 0.6).select("job_id", "t", "cluster"), review.boundary_drift(cuts, other, d))]
    whole = results()
    gaps = {}
    for j in (1, 2):
        t = sorted(r.t for r in single.where(f"job_id = {j}").collect())
        gaps[j] = sorted(b - a for a, b in zip(t, t[1:]))
    assert {r.job_id: r.gap for r in tracks.upper_median_gap(single).collect()} == {j: g[len(g) // 2] for j, g in gaps.items()} | {3: 0.05}
    monkeypatch.setattr(scan, "CHUNK", 6.0)
    with hot_jobs(spark):
        assert results() == whole


def test_intervals_in_chunks(spark, monkeypatch):
    import random

    rng = random.Random(9)
    s = spans(spark, *((t, t + rng.uniform(0.1, 3), rng.choice(["a", "b"]), i) for i, t in enumerate(rng.uniform(0, 60) for _ in range(80))))
    d = spark.createDataFrame([(1, 70.0)], "job_id long, duration double")
    ordered = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()])
    results = lambda: [ordered(intervals.merge(s)), ordered(g := intervals.complement(s, d)), ordered(intervals.lay_out(g.withColumnsRenamed({"t_in": "source_in", "t_out": "source_out"})))]
    whole = results()
    monkeypatch.setattr(scan, "CHUNK", 2.0)
    with hot_jobs(spark):
        assert results() == whole and len(whole[0]) > 5


def test_spans_of_any_length(spark):
    import time

    left = spans(spark, (0.0, 1e9, "long", 0), (5.0, 6.0, "short", 1), (-1e12, 1e18, "broken", 2), (3e9, 3e9 + 1, "far", 3))
    right = spans(spark, (5.5, 7.0, "x", 0), (2e9, 9e9, "y", 1), (-4e3, 4e3, "z", 2), (8e8, 8e8 + 1, "w", 3)).selectExpr("job_id j", "t_in o_in", "t_out o_out", "kind other")
    began = time.time()
    got = sorted((r.kind, r.other) for r in intervals.meeting(left, "t_in", "t_out", right, "o_in", "o_out").collect())
    assert got == [("broken", "w"), ("broken", "x"), ("broken", "y"), ("broken", "z"), ("far", "y"), ("long", "w"), ("long", "x"), ("long", "z"), ("short", "x"), ("short", "z")]
    points = spark.createDataFrame([(1, 5.7), (1, 8e8 + 0.5), (1, 3e9 + 0.5), (1, 5e17), (1, None)], "job_id long, t double")
    inside = (F.col("t") >= F.col("o_in")) & (F.col("t") < F.col("o_out"))
    found = sorted((r.t, r.kind) for r in intervals.near_points(points, F.col("t"), left.selectExpr("job_id j", "t_in o_in", "t_out o_out", "kind"), "o_in", "o_out", inside).collect())
    assert found == [(5.7, "broken"), (5.7, "long"), (5.7, "short"), (8e8 + 0.5, "broken"), (8e8 + 0.5, "long"), (3e9 + 0.5, "broken"), (3e9 + 0.5, "far"), (5e17, "broken")]
    assert time.time() - began < 40


def test_nearest_rank_and_empty(spark):
    v = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.9)], "job_id long, value double")
    assert review.nearest_rank(v, 0.9).first().value == 0.9
    assert review.nearest_rank(v.where("false"), 0.9).count() == 0


def test_open_silence_is_dropped_unless_a_duration_closes_it(spark):
    log = spark.createDataFrame([(1, 0, "x silence_start: -0.5"), (1, 1, "y silence_end: 2 | d"), (1, 2, "silence_end: 3"), (1, 3, "silence_start: 4"), (1, 4, "silence_start: 5")], "job_id long, line int, text string")
    assert [(r.t_in, r.t_out) for r in recordings.silence_spans(log).collect()] == [(0.0, 2.0)]
    d = spark.createDataFrame([(1, 9.0)], "job_id long, duration double")
    assert sorted((r.t_in, r.t_out) for r in recordings.silence_spans(log, d).collect()) == [(0.0, 2.0), (5.0, 9.0)]


def test_metadata_survives_parquet(spark, tmp_path):
    df = spark.createDataFrame([], schemas.SEGMENTS)
    df.write.parquet(str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).schema["tier"].metadata["origin"] == "model"
    assert [p for p, _ in schemas.leaves(schemas.AUDIO, only_learnable=True)] == ["music_gain_db", "duck_db"]


def test_migration_quarantines_what_it_does_not_know(spark):
    s = spark.createDataFrame([(1, 1, None), (2, 3, None), (3, 4, "x"), (4, None, "y")], "job_id int, spec_version int, provenance string")
    good, bad = recordings.migrate(s)
    assert sorted((r.job_id, r.spec_version, r.provenance) for r in good.collect()) == [(1, 3, "unknown"), (2, 3, None)]
    assert sorted(r.job_id for r in bad.collect()) == [3, 4]


def test_short_sequences_are_aligned_without_names(monkeypatch):
    import random

    import numpy as np

    from chronoweave.operators import alignment

    rng = random.Random(3)
    pairs = [tuple(np.array([rng.randint(0, most) for _ in range(rng.randint(0, 120))], np.int64) for _ in "ab") for most in (1, 5, 40, 200) for _ in range(60)]
    pairs += [(a, np.delete(a, slice(0, None, 17))) for a, _ in pairs]
    want = [alignment.runs_by_names(a, b) for a, b in pairs]
    made = []
    names = alignment._Names
    monkeypatch.setattr(alignment, "_Names", lambda a, b: made.append(len(a)) or names(a, b))
    assert [alignment.common_runs(a, b) for a, b in pairs] == want and not made
    alignment.common_runs(np.arange(2000), np.arange(2000))
    assert made == [2000]
