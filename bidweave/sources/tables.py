"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns that say which rows are one record; of redeliveries the latest ``loaded_at`` counts.
RECORD_KEY = {"items": "seq", "pages": "page_id"}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table as delivered, redelivered rows included."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def latest(df: DataFrame, key: str, stamp: str = "loaded_at") -> DataFrame:
    """One row for each ``key``: the one loaded last, NULL stamps first of all; a NULL key stays out.

    Rows of one key share their content, so ties between equal stamps don't matter.
    """
    order = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last())
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("__nth", F.row_number().over(order))
        .where("__nth = 1")
        .drop("__nth")
    )


def records(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table with one row for each record."""
    df = table(spark, directory, name)
    return latest(df, RECORD_KEY[name]) if name in RECORD_KEY else df
