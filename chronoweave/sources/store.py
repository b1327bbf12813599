"""The record store: append-only parquet tables by job and profile. Views (operators/review.py) pick the latest rows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schemas

TABLES = {
    "jobs": schemas.JOBS, "stage_cache": schemas.STAGE_CACHE, "accepted_specs": schemas.ACCEPTED_SPECS, "pref_changes": schemas.PREF_CHANGES,
    "verifications": schemas.VERIFICATIONS, "reviews": schemas.REVIEWS, "findings": schemas.FINDINGS,
}


def append(df: DataFrame, root: str, table: str, partition: str | None = None) -> None:
    out = df.write.mode("append")
    (out.partitionBy(partition) if partition else out).parquet(f"{root}/{table}")


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}")


def delete(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The table without the rows of those keys."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def profiles_of(rows: DataFrame) -> DataFrame:
    return rows.select("profile").distinct().orderBy("profile")


def accepted(specs: DataFrame, profile: str) -> DataFrame:
    """What was accepted under one profile, oldest first."""
    return specs.where(F.col("profile") == profile).orderBy("id")


def rendered_profiles(verifications: DataFrame) -> DataFrame:
    """job_id, profile: what each job has been rendered and verified for."""
    return verifications.select("job_id", "profile").distinct()


def publish(df: DataFrame, path: str) -> None:
    """JSON documents, one folder for each job."""
    df.write.mode("overwrite").partitionBy("job_id").json(path)


#: A published version of a table of documents: where it is and what it replaces. A version is there once its row is.
VERSIONS = "version STRING, published_at LONG, n LONG"


def publish_version(df: DataFrame, root: str, name: str) -> str:
    """Write the documents as a new version of a table and return its name. A version is written whole, by any number of tasks, and becomes visible by one row in the list of versions at
    the end: a task or driver that fails before that leaves nothing that readers see, and readers of an older version keep their files."""
    spark, version = df.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}/data/{version}")
    n = spark.read.schema(df.schema).parquet(f"{root}/{name}/data/{version}").count()
    spark.createDataFrame([(version, time.time_ns(), n)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/{name}/versions")
    return version


def versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """VERSIONS of a table, as many rows as it was published."""
    return spark.read.schema(VERSIONS).parquet(f"{root}/{name}/versions")


def read_version(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A published version whole, the latest if none is named."""
    known = versions(spark, root, name)
    row = (known if version is None else known.where(F.col("version") == version)).agg(F.max("version")).first()[0]
    if row is None:
        raise LookupError(f"{name} has no such version")
    return spark.read.parquet(f"{root}/{name}/data/{row}")


def document_views(proposed: DataFrame, corrected: DataFrame, key: str = "job_id") -> DataFrame:
    """key, current, proposed of two tables (key, document): current is the corrected document where there is one; the proposal stands beside it only
    while a correction does, and is current again once that is withdrawn. A correction without a proposal counts for nothing."""
    c = corrected.select(key, F.col("document").alias("corrected"))
    j = proposed.join(c, key, "left")
    return j.select(key, F.coalesce("corrected", "document").alias("current"), F.when(F.col("corrected").isNotNull(), F.col("document")).alias("proposed"))
