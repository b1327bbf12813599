"""What several operators share: tables, the shared folder, and reading texts out of Arrow batches."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only doc_id and the text; whatever else the table carries never travels."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is named, a temporary one of our own on a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own_dir[app] = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
    return _own_dir[app]


class _Open(threading.local):
    """The Scratches that this thread is in: queries that run beside each other in one driver don't share any."""

    def __init__(self):
        self.scratches: list[Scratch] = []


class Scratch:
    """with Scratch() as s: every table that stash() writes inside is deleted at the end, but for s.keep(table), which outlives it."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> "Scratch":
        _open.scratches.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.remove(next(t for t in self.tables if t is df))
        if len(_open.scratches) > 1:
            _open.scratches[-2].tables.append(df)
        return df

    def __exit__(self, *_) -> None:
        _open.scratches.remove(self)
        for df in self.tables:
            unstash(df)


_open = _Open()


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. A lost executor costs nothing then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if _open.scratches:
        _open.scratches[-1].tables.append(out)
    return out


def unstash(df: DataFrame) -> None:
    """Delete a table that stash() wrote, once nothing reads it any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        df._stash_path = None
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Ids of documents without one are below this (or, where they come last, from -NO_ID on), if all others lie between.
NO_ID = -(2**62)


def own_id(last: bool = False) -> Column:
    """doc_id, or for a null one a number below (last: above) all others by the text: rows without an id are documents of their own, equal texts one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_text = F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1)) + (F.lit(2**62) if last else F.lit(-(2**63)))
    return F.coalesce(F.col("doc_id").cast("long"), by_text)


def with_own(docs: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """docs with the column __own, a long without nulls in the order of doc_id; and, where ids of any size stand in the way of own_id(), a table __own, doc_id.

    That table numbers the ids in their order, by a range partitioning; without it, numbers below NO_ID (last: from -NO_ID on) are null ids and all others are ids.
    """
    ends = docs.select(F.col("doc_id").cast("long").alias("i")).agg(F.min("i"), F.max("i")).first()
    if ends[0] is None or (ends[0] >= NO_ID and ends[1] < -NO_ID):
        return docs.withColumn("__own", own_id(last)), None
    i = F.col("doc_id").cast("long")
    text = F.when(i.isNull(), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    order = ["__last", F.col("__i").asc_nulls_first(), "__h"]
    keys = docs.select(i.alias("__i"), text.alias("__h")).distinct().withColumn("__last", F.col("__i").isNull() if last else F.col("__i").isNotNull())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbers of rows within ordered partitions are in order; written, so that they stay what they are
    names = stash(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).select("__i", "__h", F.monotonically_increasing_id().alias("__own")), "ids")
    keyed = docs.withColumns({"__id": i, "__text": text})
    found = keyed.join(names, keyed["__id"].eqNullSafe(names["__i"]) & keyed["__text"].eqNullSafe(names["__h"])).select(*docs.columns, "__own")
    return found, names.select("__own", F.col("__i").alias("doc_id"))


def keep_firsts(docs: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents that are first in their component, with their columns as they are. components(doc_id, text) gives doc_id, component_id.
    Rows with one doc_id are one document; rows without one come after all others."""
    keyed, _ = with_own(docs, last=True)
    groups = components(keyed.select(F.col("__own").alias("doc_id"), F.col("text").cast("string").alias("text")))
    firsts = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    return keyed.join(firsts, F.col("__own") == F.col("__first"), "left_semi").select(*docs.columns)


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids, null equal to null; columns as they are."""
    ids = ids.select(F.col("doc_id").alias("__kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__kept_id"]), "left_semi").select(*docs.columns)


def slices(batch: pa.RecordBatch, limit: int = 2 << 20, column: str = "text"):
    """Cut a batch so that each part holds about `limit` bytes of text (one row at least), to bound a task's memory."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n+1 row boundaries in it. A null is an empty text."""
    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    else:
        column = column.cast(pa.large_string())
        off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


#: For DuckDB, which has no checksum of this kind: its table of 256 entries, made by the rule, and the checksum of hex digits by that table.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
)"""


def crc_sql(digits: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT for i in range(length({digits}) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
