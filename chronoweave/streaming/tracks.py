"""Event streams: bucket summaries and sessions with watermarks. The same boundaries as the batch operators, late rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.time import EPS


def focus_buckets(events: DataFrame, bucket: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """events(job_id, ts, kind, x, y), streaming: job_id, start, n_clicks, n_dwell, mean_x, mean_y for each bucket with something notable."""
    notable = F.col("kind").isin("click", "dwell")
    per = events.withWatermark("ts", lateness).groupBy("job_id", F.window("ts", bucket).alias("w"))
    out = per.agg(F.count_if(F.col("kind") == "click").alias("n_clicks"), F.count_if(F.col("kind") == "dwell").alias("n_dwell"), F.avg(F.when(notable, F.col("x"))).alias("mean_x"), F.avg(F.when(notable, F.col("y"))).alias("mean_y"))
    return out.where("n_clicks + n_dwell > 0").select("job_id", F.col("w.start").alias("start"), "n_clicks", "n_dwell", "mean_x", "mean_y")


def clusters(events: DataFrame, gap: str = "1200 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """Sessions of notable events: job_id, t_in, t_out, n. An event exactly `gap` later still belongs."""
    per = events.where(F.col("kind").isin("click", "dwell", "manual")).withWatermark("ts", lateness).groupBy("job_id", F.session_window("ts", gap).alias("w"))
    return per.agg(F.min("ts").alias("t_in"), F.max("ts").alias("t_out"), F.count("*").alias("n")).drop("w")


CHANGES = "profile string, key string, old_value double, new_value double, caused_by long, changed_at timestamp"


def preference_changes(values: DataFrame, last: int, least: int) -> DataFrame:
    """review.preference_changes of a stream values(profile, key, at, id, value): the rows for pref_changes as they come up. State by profile and key is the last values
    and the median before, no more; values count in order within a batch, and in the order of batches."""

    def step(key, frames, state):
        import pandas as pd

        recent, old = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = []
        for at, id_, value in pd.concat(frames).sort_values(["at", "id"])[["at", "id", "value"]].itertuples(index=False):
            recent = [*recent, value][-last:]
            if len(recent) >= least:
                ordered = sorted(recent)
                new = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
                if old is None or abs(new - old) > EPS:
                    rows.append((*key, old, new, id_, at))
                old = new
        state.update((recent, old))
        yield pd.DataFrame(rows, columns=["profile", "key", "old_value", "new_value", "caused_by", "changed_at"])

    known = values.where("value IS NOT NULL").select("profile", "key", F.col("at").cast("timestamp").alias("at"), "id", "value")
    return known.groupBy("profile", "key").applyInPandasWithState(step, CHANGES, "recent array<double>, old double", "append", "NoTimeout")
