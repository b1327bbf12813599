"""The pipeline on the smallest tables: each stage's contract on its own input."""

import corpus_pipeline
from test_tokens import whole  # noqa: F401

from chronoweave.llm import common


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns, counts = docs.columns, [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and all(name == "line dedup" or after[k] == before[k] for k in after)
        before = after
        counts.append(len(before))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]


def test_stages_take_nulls_repeated_rows_and_empty_tables(spark, sf):
    from edge_cases import documents, some_texts

    texts = some_texts(9)
    docs = documents(spark, [*texts, *texts[:3], "<|endoftext|>", None], [*range(len(texts)), 0, None, None, None, 3])
    for rows in (docs, docs.where("false")):
        got = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = common.stash(stage(spark, got, sf), "stage")
            assert got.columns == rows.columns
        assert corpus_pipeline.STAGES[-1][1](spark, got, sf).count() >= got.count()
        for _, stage in corpus_pipeline.STAGES[1:4]:  # the quality stage drops most of these
            assert common.stash(stage(spark, rows, sf), "stage").columns == rows.columns


def test_run_leaves_one_table(spark, sf):
    import os

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("packed")


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
