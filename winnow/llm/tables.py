"""Shared plumbing of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.graph import components
from winnow.storage import written

__all__ = ["components", "named", "small_batches", "written"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB from here on in this session: batches of ten thousand long texts
    would fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the wanted columns under own names, so that others' names can't clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
