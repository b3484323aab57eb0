"""Continuous batching, append sinks and resumable runs."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def budgeted(rows: Iterator[dict], step: Callable[[list[dict]], list[bool]], size: Callable[[dict], float], limit: float,
             max_steps: int = 10_000) -> Iterator[dict]:
    """Keep a working set within a size budget: step all its rows, release finished ones, refill.

    A row larger than the budget is admitted only when nothing else is active.
    """
    active: list[dict] = []
    used, waiting, steps = 0.0, next(rows, None), {}
    while active or waiting is not None:
        while waiting is not None and (not active or used + size(waiting) <= limit):
            active.append(waiting)
            used += size(waiting)
            steps[id(waiting)] = 0
            waiting = next(rows, None)
        done = step(active)
        rest = []
        for row, ok in zip(active, done):
            steps[id(row)] += 1
            if ok or steps[id(row)] >= max_steps:
                row["converged"], row["n_steps"] = bool(ok), steps.pop(id(row))
                used -= size(row)
                yield row
            else:
                rest.append(row)
        active = rest


def relax_continuously(frames: DataFrame, step: Callable, size: Callable, limit: float, max_steps: int = 10_000) -> DataFrame:
    """Run ``budgeted`` in every partition; rows leave a task as soon as they converge."""
    cols = frames.columns
    schema = ", ".join(f"{c} {t}" for c, t in frames.dtypes) + ", converged boolean, n_steps int"

    def run(batches):
        rows = (r for b in batches for r in b.to_dict("records"))
        for r in budgeted(rows, step, size, limit, max_steps):
            yield pd.DataFrame([r])[[*cols, "converged", "n_steps"]]

    return frames.mapInPandas(run, schema)


def append_stream(stream: DataFrame, path: str, checkpoint: str, when: str = "converged"):
    """Append finished rows of a stream to a Parquet table as they arrive (exactly once)."""
    return (stream.where(when).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def first_seen_bins(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Occupancy bins of a stream at their first appearance, with state bounded by a watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def remaining(cases: DataFrame, done_path: str, key: list[str]) -> DataFrame:
    """Cases without a finished result; everything when nothing has been written yet."""
    if not os.path.exists(done_path):
        return cases
    done = cases.sparkSession.read.parquet(done_path).select(*key).distinct()
    return cases.join(done, key, "left_anti")


def rerun_actions(known: DataFrame, found: DataFrame) -> DataFrame:
    """``case, action``: skip_unknown_case, copy_complete or rerun.

    ``known``: ``case``; ``found``: ``case, complete``.
    """
    k = known.select("case").distinct().withColumn("_k", F.lit(True))
    act = F.when(F.col("_k").isNull(), "skip_unknown_case").when(F.col("complete"), "copy_complete").otherwise("rerun")
    return found.join(k, "case", "left").select("case", act.alias("action"))
