"""Parquet table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sievelark.functions.exprs import as_double


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """The embeddings table with double vectors."""
    e = table(spark, base, "embeddings")
    return e.select("vec_id", as_double("embedding").alias("embedding"), "label")
