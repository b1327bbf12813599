"""Running values over a job's rows in order; for hot jobs without a window over a whole job.

By default these are plain windows by job, which sort a job in one task: the cheapest plan as long as a job is one recording. Where some jobs are very large, the session's setting
HOT_JOBS ("true") gives the same rows another way. A job's rows are cut into chunks by where they stand (a time, an index). Each chunk's total is made by a partial aggregate; what comes before (or after) a chunk is carried to it by a window over
chunks, of which a job has few; and the carried value enters its chunk as one more row, in front of (or behind) the others. Windows then run within a chunk, so a hot job's rows
are sorted in as many tasks as it has chunks. Rows that stand at one place are in one chunk. The price is that the rows are read twice, for the totals and for the result, and twice again by each
further operator on top; so tables between such operators should be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds of a chunk.
CHUNK = 1024.0
#: The session's setting that asks for chunks.
HOT_JOBS = "chronoweave.hotJobs"
_TOTAL = {"max": F.max, "sum": F.sum}


def chunk_of(at: Column) -> Column:
    return F.floor(at / CHUNK)


def in_chunks(rows: DataFrame) -> bool:
    return rows.sparkSession.conf.get(HOT_JOBS, "false") == "true"


def running(rows: DataFrame, at: Column, order: list, values: dict[str, tuple[str, Column]], inclusive: bool = False, by: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """rows with, for each name in values, the running "max" or "sum" of a column over what comes before the row (inclusive: and the row) in its group.

    order must begin with what `at` says; at: where rows stand, a number of seconds. Nulls count for nothing, where nothing comes before the value is null; rows whose `at` is null come first.
    """
    if not in_chunks(rows):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        return rows.select("*", *(_TOTAL[kind](v).over(w).alias(n) for n, (kind, v) in values.items()))
    own = {f"__{n}": v for n, (_, v) in values.items()}
    each = rows.withColumns(own | {"__chunk": chunk_of(at), "__turn": F.lit(1)})
    totals = each.groupBy(*by, "__chunk").agg(*(_TOTAL[kind](f"__{n}").alias(f"__{n}") for n, (kind, _) in values.items()))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "__chunk", F.lit(0).alias("__turn"), *(_TOTAL[kind](f"__{n}").over(before).alias(f"__{n}") for n, (kind, _) in values.items()))
    w = Window.partitionBy(*by, "__chunk").orderBy("__turn", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    both = each.unionByName(carried, allowMissingColumns=True)
    out = both.select(*rows.columns, "__turn", *(_TOTAL[kind](f"__{n}").over(w).alias(n) for n, (kind, _) in values.items()))
    return out.where(F.col("__turn") == 1).drop("__turn")


def _around(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Both values by running forward, once in either order: a frame that ends with the partition would be gone through anew from every row."""
    up_to = lambda *o: F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"before": up_to(*order), "after": up_to(*(F.desc(c) for c in order))})


def around(rows: DataFrame, at: Column, order: list[str], value: str, by: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """rows with `before` and `after`: the last value that is not null up to the row and the first from the row on, in order; null where there is none."""
    if not in_chunks(rows):
        return _around(rows, list(by), order, value)
    each = rows.withColumns({"__chunk": chunk_of(at), "__turn": F.lit(1), "__v": F.col(value)})
    where = F.struct(*order)
    known = F.col("__v").isNotNull()
    edges = each.groupBy(*by, "__chunk").agg(F.max_by("__v", F.when(known, where)).alias("last"), F.min_by("__v", F.when(known, where)).alias("first"))
    chunks = Window.partitionBy(*by).orderBy("__chunk")
    earlier = F.last("last", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("first", ignorenulls=True).over(chunks.rowsBetween(1, Window.unboundedFollowing))
    sides = edges.select(*by, "__chunk", earlier.alias("earlier"), later.alias("later"))
    side = lambda turn, v: F.struct(F.lit(turn).alias("__turn"), F.col(v).alias("__v"))
    sides = sides.select(*by, "__chunk", F.explode(F.array(side(0, "earlier"), side(2, "later"))).alias("s"))
    both = each.unionByName(sides.select(*by, "__chunk", "s.*"), allowMissingColumns=True)
    return _around(both, [*by, "__chunk"], ["__turn", *order], "__v").where(F.col("__turn") == 1).select(*rows.columns, "before", "after")


def neighbour(rows: DataFrame, at: Column, order: list[str], values: dict[str, str], back: bool = False, by: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """rows with, for each (name, column) in values, the next row's (back: the last row's) value in order; null at the end. at and order as in running()."""
    step = F.lag if back else F.lead
    if not in_chunks(rows):
        return rows.select("*", *(step(c).over(Window.partitionBy(*by).orderBy(*order)).alias(n) for n, c in values.items()))
    each = rows.withColumns({"__chunk": chunk_of(at), "__turn": F.lit(1), "__v": F.struct(*(F.col(c).alias(n) for n, c in values.items()))})
    edge = (F.max_by if back else F.min_by)("__v", F.struct(*order))
    edges = each.groupBy(*by, "__chunk").agg(edge.alias("__v"))
    chunks = Window.partitionBy(*by).orderBy("__chunk")
    carried = edges.select(*by, "__chunk", F.lit(0 if back else 2).alias("__turn"), step("__v").over(chunks).alias("__v"))
    w = Window.partitionBy(*by, "__chunk").orderBy("__turn", *order)
    both = each.unionByName(carried, allowMissingColumns=True).withColumn("__n", step("__v").over(w))
    return both.where(F.col("__turn") == 1).select(*rows.columns, *(F.col(f"__n.{n}").alias(n) for n in values))
