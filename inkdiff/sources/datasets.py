"""Labelled pairs and tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled clause pairs of JSON files that hold one array each. A missing path raises."""
    return spark.read.schema(schemas.LABELLED_PAIRS).json(path, multiLine=True)


TABLES = {"users": schemas.USERS, "sessions": schemas.SESSIONS, "comparison_log": schemas.COMPARISON_LOG}


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty parquet tables of users, sessions and the comparison log where they are missing."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
