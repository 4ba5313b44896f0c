"""An extension: Medline files dropped into a folder, parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def medline_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, ID) of the records of each new file; stateless, so files count once."""
    texts = spark.readStream.format("text").option("wholetext", True).schema("value string").load(folder)
    each = texts.select(F.input_file_name().alias("path"), F.explode(F.regexp_extract_all("value", F.lit(r"(?:^|\n)PMID- *(\d+)"), 1)).alias("n"))
    return each.select("path", F.concat(F.lit("PMID:"), "n").alias("ID"))
