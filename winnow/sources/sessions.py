"""Review sessions: folders of records, annotations, results, draws and term tables as Parquet."""

from __future__ import annotations

import os
import re
import shutil
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of session files and their folders (fixed values).
KINDS = ("Records", "Annotations", "Results", "Samples", "DTM")


def safe_now() -> str:
    """The time as text that paths can hold."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H.%M.%S")


def create_session(records: DataFrame, name: str, folder: str, dtm: DataFrame | None = None, duplicate: str = "fill", stamp: bool = True) -> str:
    """The new session's path.  If the name is taken: fill writes into it, skip leaves it, add takes
    the next free ``_rN``, replace empties it first, and stop is an error."""
    path = os.path.join(folder, name)
    if os.path.isdir(path):
        if duplicate == "stop":
            raise FileExistsError(path)
        if duplicate == "skip":
            return path
        if duplicate == "replace":
            shutil.rmtree(path)
        elif duplicate == "add":
            base, n = re.sub(r"_r\d+$", "", path), 2
            while os.path.isdir(f"{base}_r{n}"):
                n += 1
            path = f"{base}_r{n}"
    suffix = f"_{safe_now()}" if stamp else ""
    records.write.mode("overwrite").parquet(os.path.join(path, f"Records{suffix}.parquet"))
    if dtm is not None:
        dtm.write.mode("overwrite").parquet(os.path.join(path, "DTM.parquet"))
    return path


def iteration_number(file: Column) -> Column:
    """The number that a file's name starts with, or 0."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract(file, r"([^/]+)$", 1), r"^(\d+)\.", 1), F.lit("")).cast("int"), F.lit(0))


def session_files(name: str, folder: str, which: tuple[str, ...] = KINDS) -> dict[str, list[str]]:
    """A session's files by kind, in order of iteration."""
    found: dict[str, list[str]] = {k: [] for k in which}
    for top, dirs, _ in os.walk(os.path.join(folder, name)):
        for d in sorted(dirs):
            for kind in which:
                if d.endswith(".parquet") and kind in d and not (kind == "Records" and "Annotation" in d):
                    found[kind].append(os.path.join(top, d))
    number = lambda p: int(m[1]) if (m := re.match(r"(\d+)\.", os.path.basename(p))) else 0
    return {k: sorted(v, key=lambda p: (number(p), p)) for k, v in found.items()}


@contextmanager
def locked(path: str):
    """One process at a time in a session."""
    mark = os.path.join(path, ".lock")
    try:
        os.close(os.open(mark, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        raise RuntimeError(f"{path} is being worked on") from None
    try:
        yield
    finally:
        os.unlink(mark)
