"""Record schema, and typed empty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a citation record and their types (fixed values).
RECORD = {
    "Order": "bigint", "ID": "string", "Title": "string", "Abstract": "string", "DOI": "string", "Authors": "string", "URL": "string", "Journal": "string", "Journal_short": "string",
    "Article_type": "string", "Mesh": "string", "Author_keywords": "string", "Keywords": "string", "Topic": "string", "Published": "string", "Year": "int", "N_citations": "int",
    "Source": "string", "Source_type": "string", "Creation_date": "timestamp", "FileID": "string",
}

#: What a unified record keeps, in order (fixed values).
JOINED = ("Order", "DOI", "ID", "Title", "Abstract", "Authors", "Year", "URL", "Journal", "Journal_short", "Keywords", "Mesh", "Article_type", "N_citations", "Source", "Source_type", "FileID")

#: Label columns from the most to the least authoritative (fixed values).
LABELS = ("Rev_prediction_new", "Rev_prediction", "Rev_manual")

ANNOTATION = {"Rev_manual": "string", "Rev_previous": "string", "Rev_prediction": "string", "Rev_prediction_new": "string", "Predicted_label": "string", "Pred_Med": "double", "Pred_Low": "double", "Pred_Up": "double", "Pred_delta": "double"}

JOURNAL = ("Session_ID", "Query_ID", "Source", "Type", "Input_files", "Output_file", "Timestamp", "Filter", "N_results", "Query")


def empty(spark: SparkSession, columns: dict[str, str]) -> DataFrame:
    """A frame without rows that has these columns and types."""
    return spark.createDataFrame([], T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items())))


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The frame with just these columns; missing ones are typed nulls."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[k.lower()]}`") if k.lower() in have else F.lit(None)).cast(v).alias(k) for k, v in columns.items()))
