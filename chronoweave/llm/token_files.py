"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

The id that occurs most often over the whole corpus becomes 0, and so on. A number takes 1 to 4 bytes; two bits of a
control byte say how many, four numbers to a control byte. The file is a table with one row for each
block of documents: (part, chunk) in ascending doc_id order, the documents' ids and lengths, control bytes and data bytes. A block is
decoded with one lookup of its control bytes and no loop over its numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_dir, slices, stash, texts, unstash
from .tokens import encoder, vocabulary

#: How many bytes each of a control byte's four numbers takes.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
BLOCK = "part int, chunk int, nulls int, doc_ids binary, counts binary, control binary, data binary"


def encode_numbers(x: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned numbers below 2**32."""
    x = x.astype("<u4")
    size = 1 + (x > 0xFF) + (x > 0xFFFF).astype(np.int64) + (x > 0xFFFFFF)
    code = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    code[: len(x)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    wide = x.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), wide[np.arange(4) < size[:, None]].tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write(docs: DataFrame, path: str, end_id: int = 2, vocab: str | None = None, block_ids: int = 1 << 18) -> None:
    """Encode all documents into a token file at `path` (blocks) and `path`-ranks (the table of ids by rank).

    A null or empty text is the end id alone; rows with equal doc_id stay documents of their own, ordered by a hash of the text; null doc_ids
    come first. An empty table gives a file without blocks. A block ends once it has block_ids ids; a longer text is a block of its own.
    Only the counts of ids, as many as the vocabulary has, reach the driver.
    """
    vocab = vocab or vocabulary()
    spark = docs.sparkSession

    def tokenise(batches):
        part, chunk = TaskContext.get().partitionId(), 0
        held: list = []
        n = 0
        for whole in batches:
            for batch in slices(whole):
                ids, at = encoder(vocab).encode(batch.column("text"))
                size = np.diff(at)
                with_end = np.insert(ids, at[1:], end_id).astype("<u4")
                held.append((np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("doc_id").is_null()), size + 1, with_end))
                n += len(with_end)
                if n >= block_ids:
                    yield block(part, chunk, held)
                    chunk, held, n = chunk + 1, [], 0
        if held:
            yield block(part, chunk, held)

    def block(part, chunk, held):
        d, none, c, x = (np.concatenate(a) for a in zip(*held))
        narrow = x.astype("<u2").tobytes() if x.max(initial=0) < 1 << 16 else x.tobytes()
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "nulls": pa.array([int(none.sum())], pa.int32()), "doc_ids": pa.array([d.astype("<i8").tobytes()]), "counts": pa.array([c.astype("<u4").tobytes()]), "ids": pa.array([narrow])})

    def widened(counts: bytes, ids: bytes) -> np.ndarray:
        n = int(np.frombuffer(counts, "<u4").sum(dtype=np.int64))
        return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)

    # rows with one doc_id, or none, may be very many: they are split and ordered by their texts
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    raw = stash(ordered.mapInArrow(tokenise, "part int, chunk int, nulls int, doc_ids binary, counts binary, ids binary"), "ids")

    def count(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for counts, ids in zip(b.column("counts").to_pylist(), b.column("ids").to_pylist()):
                c = np.bincount(widened(counts, ids))
                if len(c) > len(total):
                    total = np.pad(total, (0, len(c) - len(total)))
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    ranked = raw.select("counts", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    by_rank = ranked["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.mode("overwrite").parquet(f"{path}-ranks")

    def code(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in b.schema.names}
                control, data = encode_numbers(shared.value[widened(row["counts"], row.pop("ids"))])
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for k, v in (row | {"control": control, "data": data}).items()})

    raw.mapInArrow(code, BLOCK).write.mode("overwrite").parquet(path)
    unstash(raw)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What the file holds, per document: doc_id, start, n_tokens, ids_crc32; the ids are decoded for it. A file without blocks gives no rows."""
    by_rank = np.frombuffer(spark.read.parquet(f"{path}-ranks").first()[0], "<u4")
    ids_of = spark.sparkContext.broadcast(by_rank)

    def decode(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, chunk, nulls, docs, counts, control, data = (b.column(k)[i].as_py() for k in ("part", "chunk", "nulls", "doc_ids", "counts", "control", "data"))
                counts = np.frombuffer(counts, "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                ids = ids_of.value[decode_numbers(control, data, int(ends[-1]))]
                crc = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts)]
                d = np.frombuffer(docs, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), part, np.int32)), pa.array(np.full(len(d), chunk, np.int32)), pa.array(d, pa.int64(), mask=np.arange(len(d)) < nulls), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "chunk", "doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCK).parquet(path)
    # where each block begins: within its part by a window, over the parts by their totals (a row for each part)
    def total(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("chunk"), pa.array([int(np.frombuffer(c, "<u4").sum(dtype=np.int64)) for c in b.column("counts").to_pylist()], pa.int64())], names=["part", "chunk", "n"])

    sizes = stash(blocks.select("part", "chunk", "counts").mapInArrow(total, "part int, chunk int, n long"), "sizes")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")
    bases = spark.createDataFrame(list(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist())), "part int, base long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("before", before).join(bases, "part").select("part", "chunk", (F.col("before") + F.col("base")).alias("at"))
    rows = blocks.mapInArrow(decode, "part int, chunk int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "chunk"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 2, vocab: str | None = None) -> DataFrame:
    """Write a token file into the shared folder and report on it from what is read back; nulls, ties and empty tables as in write()."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, end_id, vocab)
    return read(docs.sparkSession, path)
