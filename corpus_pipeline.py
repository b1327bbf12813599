"""From raw documents to packed training sequences, in five stages over whole tables.

quality rules -> line dedup -> SimHash near-dedup -> benchmark decontamination -> best-fit packing. Each stage takes what the one
before it kept, with the columns of documents; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import decontaminate, line_dedup, packing, quality, similar
from chronoweave.llm.common import Scratch, stash, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts go; equal rows stay or go together; without labels the base rules decide."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that repeat an earlier one. Null texts stay; of equal lines the one with the smallest doc_id, then place, stays."""
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; texts without words are copies of each other. Rows with one doc_id are one
    document; rows without one are documents of their own after all others, equal texts among them one."""
    # fingerprints and bands only propose; a Jaccard similarity of 0.8 on the five-word shingles decides
    return similar.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are judged one by one; null texts hold nothing; an empty benchmark drops nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document and where it lies. A null or empty text is one end id; equal rows are documents of their own."""
    return packing.pack(docs, sequence=2048, end_id=0)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

#: The quality model, fingerprints and packing can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage read and wrote on the way is deleted once its own table is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch() as all_stages:
        for name, stage in STAGES[:-1]:
            with Scratch() as own:
                docs = own.keep(stash(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        with Scratch() as own:
            packed = own.keep(stash(STAGES[-1][1](spark, docs, sf_dir), "packed"))
        all_stages.keep(packed)
    return packed
