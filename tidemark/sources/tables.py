"""The parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "models", "mentions", "benchmarks", "community_benchmarks", "benchmark_aliases", "benchmark_facets", "resolutions",
    "portfolio_similarity", "eval_items",
)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of `folder`; only the columns that a plan uses are read."""
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
