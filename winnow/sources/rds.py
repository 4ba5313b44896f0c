"""A reader of R's serialised data frames (.rds) in the binary form, by R's public format description."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

# type numbers of the format (fixed values)
SYMBOL, PAIRS, LANGUAGE, STRING, LOGICAL, INTEGER, REAL, TEXTS, LIST = 1, 2, 6, 9, 10, 13, 14, 16, 19
ALTERNATIVE, PAIRS_WITH, NULL, REFERENCE = 238, 239, 254, 255
#: The integer that stands for a missing value (fixed value).
MISSING = -(2**31)


class Value(NamedTuple):
    """A vector, or a list of values, with its attributes by name."""

    data: Any
    attributes: dict[str, Any]


class Stream:
    """Objects of an uncompressed stream, read front to back."""

    def __init__(self, body: bytes):
        if body[:2] != b"X\n":
            raise ValueError("not a binary serialised object")
        self.body, self.at, self.seen = body, 2, []
        version, _, _ = self.integers(3)
        if version not in (2, 3):
            raise ValueError(f"no reader for version {version}")
        if version == 3:
            self.take(self.integers(1)[0])  # the writer's encoding; texts carry their own mark

    def take(self, n: int) -> bytes:
        part = self.body[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("the file ends early")
        self.at += n
        return part

    def integers(self, n: int) -> tuple[int, ...]:
        return struct.unpack(f">{n}i", self.take(4 * n))

    def size(self) -> int:
        n = self.integers(1)[0]
        if n == -1:  # a long vector: two halves
            high, low = struct.unpack(">II", self.take(8))
            n = (high << 32) + low
        return n

    def pairs(self, flags: int) -> list[tuple[Any, Any]]:
        """(name, value) of a list of pairs; its own attributes are of no use here."""
        out = []
        while flags & 0xFF in (PAIRS, LANGUAGE, PAIRS_WITH):
            if flags & 0x200 or flags & 0xFF == PAIRS_WITH:
                self.item()
            name = self.item() if flags & 0x400 else None
            out.append((name, self.item()))
            flags = self.integers(1)[0]
        if flags & 0xFF != NULL:
            out.append((None, self.item(flags)))
        return out

    def item(self, flags: int | None = None) -> Any:
        flags = self.integers(1)[0] if flags is None else flags
        kind = flags & 0xFF
        if kind == NULL:
            return None
        if kind == REFERENCE:
            return self.seen[(flags >> 8 or self.integers(1)[0]) - 1]
        if kind == SYMBOL:
            self.seen.append(name := self.item())
            return name
        if kind in (PAIRS, LANGUAGE, PAIRS_WITH):
            return self.pairs(flags)
        if kind == STRING:
            n = self.integers(1)[0]
            # bit 2 of the level marks Latin-1
            return None if n == -1 else self.take(n).decode("latin-1" if flags >> 12 & 4 else "utf-8", "replace")
        if kind == ALTERNATIVE:
            return self.alternative()
        if kind in (LOGICAL, INTEGER):
            n = self.size()
            data: Any = np.frombuffer(self.take(4 * n), ">i4")
        elif kind == REAL:
            n = self.size()
            data = np.frombuffer(self.take(8 * n), ">f8")
        elif kind in (TEXTS, LIST):
            data = [self.item() for _ in range(self.size())]
        else:
            raise ValueError(f"no reader for objects of type {kind}")
        attributes = dict(self.item()) if flags & 0x200 else {}
        return Value(data != 0 if kind == LOGICAL and not (data == MISSING).any() else data, attributes | ({"logical": True} if kind == LOGICAL else {}))

    def alternative(self) -> Value:
        """Vectors that are stored by rule: ranges, numbers to be shown as text, and wrapped ones."""
        (_, kind), *_ = self.item()
        state, attributes = self.item(), self.item()
        if kind in ("compact_intseq", "compact_realseq"):
            n, start, step = state.data
            whole = start + step * np.arange(int(n))
            out = Value(whole.astype(">i4") if kind == "compact_intseq" else whole, {})
        elif kind == "deferred_string":
            out = Value([None if v is None else f"{v:.15g}" if isinstance(v, float) else str(v) for v in column(state[0][1]).to_pylist()], {})
        elif kind.startswith("wrap_"):
            out = state.data[0] if isinstance(state, Value) else state[0][1]
        else:
            raise ValueError(f"no reader for vectors stored as {kind}")
        return Value(out.data, out.attributes | dict(attributes or []))


def column(value: Value) -> pa.Array:
    """A vector as an Arrow array: factors as their levels, dates and times by their classes."""
    data, classes = value.data, value.attributes.get("class")
    classes = set(classes.data) if classes else set()
    if isinstance(data, list):
        if all(v is None or isinstance(v, str) for v in data):
            return pa.array(data, pa.string())
        raise ValueError("columns of lists have no reader")
    if value.attributes.get("logical"):
        return pa.array(data.astype(np.int32) != 0, pa.bool_(), mask=data == MISSING)
    whole = data.dtype.kind == "i"
    missing = data == MISSING if whole else np.isnan(data)
    if "factor" in classes:
        levels = value.attributes["levels"].data
        return pa.array([None if m else levels[v - 1] for v, m in zip(data.tolist(), missing.tolist(), strict=True)], pa.string())
    for name, unit, kind in (("Date", 1, pa.date32()), ("POSIXct", 1_000_000, pa.timestamp("us", "UTC"))):
        if name in classes:
            parts = np.floor(np.where(missing, 0, data).astype(np.float64) * unit + (0.5 if unit > 1 else 0)).astype(np.int64)
            return pa.array(parts, pa.int64(), mask=missing).cast(pa.int32() if name == "Date" else pa.int64()).cast(kind)
    # a missing number is one of the not-a-numbers; both become null
    return pa.array(data.astype(np.int32) if whole else data.astype(np.float64), mask=missing)


def read_frame(content: bytes) -> dict[str, pa.Array]:
    """The columns of a data frame in a file's bytes, packed by gzip, bzip2, xz or not at all."""
    for mark, unpack in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
        if content.startswith(mark):
            content = unpack(content)
    found = Stream(content).item()
    if not isinstance(found, Value) or not isinstance(found.data, list) or "names" not in found.attributes:
        raise ValueError("not a data frame")
    return {n: column(v) for n, v in zip(found.attributes["names"].data, found.data, strict=True)}


def read_rds(spark: SparkSession, path: str) -> DataFrame:
    """Data frames of one or more files, one task a file.

    Columns and types come from the first file; other files' columns are matched by name and cast."""
    files = spark.read.format("binaryFile").load(path)
    schema = pa.schema([(n, v.type) for n, v in read_frame(files.orderBy("path").select("content").first().content).items()])

    def rows(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                found = read_frame(content)
                size = max((len(v) for v in found.values()), default=0)
                yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) if f.name in found else pa.nulls(size, f.type) for f in schema], schema=schema)

    return files.select("content").mapInArrow(rows, from_arrow_schema(schema))
