import pytest

import __spark_entry__

EXPLODED = "resample_grid crop_path crop_max_step crop_continuity_findings zoom_envelope overlay_boxes transcript_wer time_map_source_to_output caption_projection".split()


@pytest.mark.parametrize("name", EXPLODED)
def test_rows_that_durations_and_spans_become_are_no_broadcast(spark, sf, name):
    """Spark takes a table of durations and the frames that it becomes for equally large; as a broadcast they fill the driver."""
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(plan):
        if "BroadcastExchange" in line:
            for below in plan[at + 1 :]:
                if depth(below) <= depth(line) or "Aggregate" in below:
                    break
                assert "Generate explode(sequence" not in below and "Generate explode(CASE" not in below, f"{line.strip()} holds {below.strip()}"


def test_findings_of_one_check_are_made_in_one_pass(spark, sf):
    """Each of a check's findings would align the transcripts anew. The error rate itself asks for the differences twice."""
    plan = __spark_entry__.queries()["transcript_findings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2
    plan = __spark_entry__.queries()["every_finding"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and plan.count("FlatMapGroupsInPandas") == 1
