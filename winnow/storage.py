"""Tables in the cluster's shared folder, to cut lineage and share results between plans."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: This process's part of the shared folder.
RUN = uuid.uuid4().hex
_own: list[str] = []
_lock = threading.Lock()
_writing: dict[int, tuple[int, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset, as in tests, a temporary one that
    goes with the process, but only if driver and executors are one machine; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        folder = tempfile.mkdtemp(prefix="winnow-")
        atexit.register(shutil.rmtree, folder, True)
        _own.append("file://" + folder)
    return _own[0]


@contextmanager
def _cleaning(spark: SparkSession):
    """CLEANUP on while any thread of the session writes, then as it was."""
    key = id(spark._jsparkSession)
    with _lock:
        depth, before = _writing.get(key, (0, None))
        if not depth:
            before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writing[key] = depth + 1, before
    try:
        yield
    finally:
        with _lock:
            depth, before = _writing.pop(key)
            if depth > 1:
                _writing[key] = depth - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and a lost executor
    costs only what it was doing.  The write's own shuffle files go when it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow/{RUN}/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process has written: call it when the results are saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/winnow/{RUN}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
