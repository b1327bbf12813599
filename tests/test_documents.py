"""Documents and the store: what the queries over the test tables cannot show."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import checks, documents
from chronoweave.sources import recordings, schemas, store


def test_a_changed_column_moves_the_keys_of_its_readers_only(spark):
    reads = {"trim": (1, ["a"], []), "captions": (1, ["a", "b"], ["c"])}
    df = spark.createDataFrame([(1, 1, 1, 1)], "job_id int, a int, b int, c int")
    keys = lambda x: {r.stage: r.cache_key for r in documents.stage_keys(x, "job_id", reads).collect()}
    before, after = keys(df), keys(df.withColumn("b", F.lit(2)))
    assert before["trim"] == after["trim"] and before["captions"] != after["captions"]
    assert len(set(before.values())) == 2


def test_copy_of_silence_is_the_name(spark):
    df = spark.createDataFrame([("j1", None), ("j2", " \n"), ("j3", "Hello there. Bye!\n"), ("j4", "...")], "job_id string, said string")
    got = {r.job_id: (r.c.title, r.c.description) for r in df.select("job_id", tx.copy_of(F.col("said"), F.col("job_id")).alias("c")).collect()}
    assert got["j1"] == ("j1", "Screen recording j1. No narration to describe it.") and got["j2"][0] == "j2"
    assert got["j3"] == ("Hello there", "Hello there. Bye!") and got["j4"] == ("", "...")


def test_open_ends_and_touching_captions_are_legal(spark):
    d = spark.createDataFrame([(1, 10.0)], "job_id int, duration double")
    o = spark.createDataFrame([(1, None), (1, 10.0000005), (1, 10.5)], "job_id int, t_out double")
    assert [tuple(r) for r in documents.past_the_end(d, overlay=o).collect()] == [(1, "overlay", 1, 10.5)]
    c = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 1.5, 3.0)], "job_id int, block_ix int, t_in double, t_out double")
    assert [tuple(r) for r in documents.caption_overlaps(c).collect()] == [(1, 1, 2)]


def test_prompt_without_speech_or_track(spark):
    d = spark.createDataFrame([(1, 2.125)], "job_id int, duration double")
    w = spark.createDataFrame([], "job_id int, ix int, t_in double, t_out double, text string")
    r = spark.createDataFrame([], "job_id int, t_in double, t_out double, kind string")
    p = spark.createDataFrame([], "job_id int, t double, kind string")
    assert documents.edit_content(d, w, r, p).first().content == "\n".join(
        [f"Source duration: {2.125:.2f}s", "", "Transcript, [start-end] word:", "  (no speech)", "", "Removals already proposed by arithmetic (accept or reject each):", "  (none)", "", "cursor: no track"]
    )


def test_overlay_boxes_and_findings(spark):
    o = spark.createDataFrame([(1, 0, 0.0, 1.0, None, None, 10, 10, 0, 0), (1, 1, 0.0, 1.0, 0.5, 0.1, 200, 10, 0, 0), (1, 2, 0.0, 1.0, 0.5, 0.1, 10, 10, 0, 0)], "job_id int, ix int, t_in double, t_out double, x double, y double, width int, height int, dx int, dy int")
    rects = spark.createDataFrame([(1, f, 0.0, 0.0, 1.0, 1.0) for f in range(4)], "job_id int, frame long, x double, y double, w double, h double")
    c = spark.createDataFrame([(1, 0.5, 2.0)], "job_id int, t_in double, t_out double")
    got = checks.overlay_boxes(o, rects, c, (5, 5, 95, 95), (0, 80, 100, 95), (100, 100), 4.0)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "over_caption", 2), (1, 1, "outside", 0)]
    assert sorted((r.check, r.value) for r in checks.overlay_findings(got).collect()) == [("overlay_occlusion", 1.0), ("overlay_safe_area", 1.0)]


def test_spec_files_and_measurements(spark, tmp_path):
    for n, v in ((1, 2), (2, 4), (3, None)):
        (tmp_path / f"s{n}.json").write_text(json.dumps({"job_id": f"j{n}", "spec_version": v, "source": {"duration": 3.0}}, indent=1))
    good, bad = recordings.read_specs(spark, str(tmp_path / "s*.json"))
    assert [(r.job_id, r.spec_version, r.provenance) for r in good.collect()] == [("j1", 3, "unknown")]
    assert sorted(r.job_id for r in bad.collect()) == ["j2", "j3"]
    (tmp_path / "encode.json").write_text(json.dumps({"host": {"cpu": "x", "memory_gb": 8.0}, "runs": [1]}, indent=2))
    m = recordings.read_measurements(spark, str(tmp_path / "encode.json")).first()
    assert (m.name, m.host.cpu, m.host.memory_gb) == ("encode", "x", 8.0) and json.loads(m.body)["runs"] == [1]


def test_store_tables_append_scan_delete(spark, tmp_path):
    for table, schema in store.TABLES.items():
        store.append(spark.createDataFrame([], schema), str(tmp_path), table)
        assert store.scan(spark, str(tmp_path), table).columns == schema.fieldNames()
    rows = spark.createDataFrame([(2, "b", "p", "{}", None, None), (1, "a", "p", "{}", None, None), (3, "c", "q", "{}", None, None)], schemas.ACCEPTED_SPECS)
    store.append(rows, str(tmp_path), "accepted_specs", "profile")
    back = store.scan(spark, str(tmp_path), "accepted_specs")
    assert [r.job_id for r in store.accepted(back, "p").collect()] == ["a", "b"]
    assert [r.profile for r in store.profiles_of(back).collect()] == ["p", "q"]
    assert store.delete(back, rows.where("id = 1"), ["id"]).count() == 2


def test_versions_are_whole_or_not_there(spark, tmp_path):
    from pyspark.sql import functions as F

    root = f"file://{tmp_path}"
    one = store.publish_version(spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, v int"), root, "specs")
    two = store.publish_version(spark.createDataFrame([("a", 3)], "job_id string, v int"), root, "specs")
    broken = spark.range(100).select(F.col("id").cast("string").alias("job_id"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit(1)).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.publish_version(broken.repartition(8), root, "specs")
    assert {(r.version, r.n) for r in store.versions(spark, root, "specs").collect()} == {(one, 2), (two, 1)}
    assert [tuple(r) for r in store.read_version(spark, root, "specs").collect()] == [("a", 3)]
    assert sorted(tuple(r) for r in store.read_version(spark, root, "specs", one).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(LookupError):
        store.read_version(spark, root, "specs", "none")


def test_a_proposal_stands_beside_its_correction_only(spark):
    p = spark.createDataFrame([("a", "p1"), ("b", "p2")], "job_id string, document string")
    views = lambda c: sorted(tuple(r) for r in store.document_views(p, spark.createDataFrame(c, "job_id string, document string")).collect())
    assert views([("a", "c1"), ("z", "c9")]) == [("a", "c1", "p1"), ("b", "p2", None)]
    assert views([]) == [("a", "p1", None), ("b", "p2", None)]


def test_stale_stages(spark):
    from chronoweave.operators import stages

    cols = "job_id string, asr string, trim string, focus string, profile_encode string, created_at string, extra string"
    was = spark.createDataFrame([("a", "m", "t", "f", "e", "1", "x"), ("b", "m", "t", "f", "e", "1", "x"), ("c", "m", None, "f", "e", "1", "x")], cols)
    now = spark.createDataFrame([("a", "m", "t", "f", "e2", "2", "y"), ("b", "m", "t2", "f", "e", "1", "x"), ("c", "m", None, "f", "e", "9", "x"), ("d", "m", "t", "f", "e", "1", "x")], cols)
    got = {}
    for r in stages.stale(was, now, "recorded").collect():
        got.setdefault(r.job_id, {})[r.stage] = r.own
    assert got["a"] == {"render": True, "verify_transcript": False, "verify": True}
    assert got["b"] == {"trim": True, "plan_edit": False, "verify": False}
    assert "c" not in got and set(got["d"]) == set(stages.RECIPES["recorded"]) and all(got["d"].values())
    with pytest.raises(ValueError, match="follows"):
        stages.keys(was, "x", stages={"b": stages.Stage((), after=("a",)), "a": stages.Stage(())})


def test_stale_stages_meet_as_documents(spark):
    from chronoweave.operators import stages

    docs = spark.createDataFrame([("a", "m", "t", "f")], "job_id string, asr string, trim string, focus string")
    plan = stages.stale(docs, docs, "recorded")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Join") and "sha2" not in plan[plan.index("Join") :]


def test_sketches_of_runs_merge(spark):
    from chronoweave.operators import sketches

    v = spark.range(20_000).selectExpr("id % 2 AS job_id", "id % 7 AS run", "CAST(pmod(hash(id), 10007) AS DOUBLE) AS value").cache()
    q = {(r.job_id, r.fraction): r for r in sketches.quantiles(sketches.merged(sketches.sketched(v, ["job_id", "run"]), ["job_id"]), [0.05, 0.5, 0.95]).collect()}
    for job in (0, 1):
        exact = sorted(r.value for r in v.where(f"job_id = {job}").collect())
        for f in (0.05, 0.5, 0.95):
            assert q[job, f].n == len(exact) and abs(sum(x <= q[job, f].value for x in exact) / len(exact) - f) < 0.03


def test_zoom_below_one_loosens_nothing(spark):
    from pyspark.sql import functions as F

    from chronoweave.operators import frames

    fit = lambda z: tuple(spark.range(1).select(frames.window_fit(F.lit(1920.0), F.lit(1080.0), F.lit(1080.0), F.lit(1920.0), F.lit(z)).alias("f")).first().f)
    assert fit(0.5) == fit(1.0) == pytest.approx((0.31640625, 1.0)) and fit(2.0) == pytest.approx((0.158203125, 0.5))


def test_prompts(spark):
    jobs = spark.createDataFrame([(1, "  Show the export. ", 24.0), (2, " ", 3.0), (3, None, 3.0)], "job_id long, brief string, duration double")
    drafts, without = documents.script_content(jobs, spark.createDataFrame([(1, "cursor activity by 2s bucket:")], "job_id long, active string"))
    assert drafts.first().content.startswith("Recording length: 24.00s\nWord budget: about 60 words (at 2.5 words/second; going over")
    assert drafts.first().content.endswith("\n\nBrief, in the author's own words:\nShow the export.\n\ncursor activity by 2s bucket:")
    assert sorted(r.job_id for r in without.collect()) == [2, 3]
