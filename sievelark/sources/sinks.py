"""Writers for result tables and small reports."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from sievelark.functions.exprs import format_float


def run_tag(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def write_json(path: str, payload) -> None:
    """One small document (a summary or manifest), written by the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, default=str)


def write_records(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def flat_text(df: DataFrame) -> DataFrame:
    """All columns as text for CSV: blanks for NULL, semicolons instead of commas."""
    cols = []
    for c, t in df.dtypes:
        v = F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        cols.append(F.coalesce(F.translate(v, ",", ";"), F.lit("")).alias(c))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; missing columns of a fixed list become blanks."""
    if columns:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    flat_text(df).write.mode("overwrite").option("header", True).csv(path)


def write_rows(df: DataFrame, folder: str, name: str, title: str, limit: int = 100) -> None:
    """The same rows as JSON lines and CSV, and the first ``limit`` of them as a Markdown table."""
    write_records(df, os.path.join(folder, f"{name}.json"))
    write_csv(df, os.path.join(folder, f"{name}.csv"))
    markdown(df, os.path.join(folder, f"{name}.md"), title, limit)


def markdown(df: DataFrame, path: str, title: str, limit: int = 100) -> None:
    """A table of the first ``limit`` rows; a longer result says how many rows there are."""
    rows = flat_text(df).limit(limit + 1).collect()
    more = [] if len(rows) <= limit else ["", f"{limit} of {df.count()} rows"]
    rows = rows[:limit]
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(r) + " |" for r in rows]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines + more) + "\n")


def write_by_category(df: DataFrame, path: str, category: str) -> None:
    """One folder per category, for example rejection reasons."""
    df.write.mode("overwrite").partitionBy(category).parquet(path)


def write_rounds(picks: DataFrame, path: str) -> None:
    picks.write.mode("overwrite").partitionBy("round").parquet(path)


def metric_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Wide metrics to ``key, metric, value`` rows."""
    values = [c for c, t in df.dtypes if c not in key]
    return df.select(*key, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(key, values, "metric", "value")


def surface_report(surface: DataFrame, path: str) -> None:
    """Surface atoms with eight-decimal coordinates and scores."""
    cols = [format_float(c, 8).alias(c) if t == "double" else F.col(c) for c, t in surface.where("found").dtypes]
    surface.where("found").select(*cols).write.mode("overwrite").option("header", True).csv(path)


def append_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite many small files into few large ones."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
