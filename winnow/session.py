"""A Spark session with the settings that the operators like."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Memory of the driver where none is named (fixed value).
MEMORY = "16g"


def session(name: str = "winnow", cores: int | None = None, memory: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one.  Unless the environment or ``conf`` names a master, it is local,
    with ``cores`` cores, all but one by default, and ``memory`` for the driver."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if "spark.master" not in conf and "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or max(1, (os.cpu_count() or 2) - 1)}]").config("spark.driver.memory", memory or MEMORY)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
