"""Parquet table access for the driver's test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it. How a scan is
    split is the session's business (``session.get_spark``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
