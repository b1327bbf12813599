"""Generated documents: what an edit makes of them is known."""

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import checks, intervals
from chronoweave.sources import generated


@pytest.fixture(scope="module")
def take(spark):
    return {k: v.cache() for k, v in generated.take(generated.jobs(spark, 3)).items()}


def test_what_the_take_holds(take):
    n = {k: v.where("job_id = 1").count() for k, v in take.items()}
    assert n == {"words": 33, "captions": 4, "segments": 5, "removals": 5, "overlays": 4, "clicks": 5, "durations": 1}
    assert intervals.partition_violations(take["removals"], take["segments"], take["durations"]).count() == 0
    assert {(r.text, round(r.t, 2)) for r in take["overlays"].where("job_id = 0 AND ix < 2").withColumn("t", F.col("t_in")).collect()} == {("Settings", 6.48), ("Export", 12.48)}


def test_budgets_choose_tiers(spark, take):
    s = take["segments"].withColumn("dur", F.col("t_out") - F.col("t_in"))
    t = intervals.budget_threshold(s, spark.createDataFrame([(15.0,), (180.0,)], "budget double"))
    assert {(r.budget, r.tier, round(r.total, 1)) for r in t.collect()} == {(15.0, "supporting", 12.4), (180.0, "optional", 16.7)}
    spans = intervals.kept_spans(s, t).where("budget = 180").drop("budget")
    dropped = intervals.dropped_overlays(take["overlays"], spans)
    assert {(r.job_id, r.template) for r in dropped.collect()} == {(j, "callout_arrow") for j in range(3)}
    words = take["words"].withColumn("ix", F.col("block_ix") * 100 + F.col("word_ix"))
    assert {r.text for r in words.join(intervals.expected_words(words, spans).select("job_id", "ix"), ["job_id", "ix"], "left_anti").collect()} == {"um"}


def test_a_broken_take_is_found_out(take):
    bad = generated.broken(take)
    cuts = intervals.mid_word_cuts(bad["removals"], bad["words"])
    assert {(r.job_id, r.n) for r in cuts.collect()} == {(j, 2) for j in range(3)}
    assert checks.mid_word(cuts).count() == 3 and intervals.mid_word_cuts(take["removals"], take["words"]).count() == 0
    assert bad["words"].where("length(text) = 34").count() == 3
