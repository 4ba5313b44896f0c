"""Operator 9: packing along a space-filling curve.

A document's vector counts its hashed words; a fixed random projection takes it to ``DIMS``
coordinates, each brought to ``BITS`` bits by the normal distribution function, and the Hilbert index
of the cell is its key.  Documents are range-sorted by that key (ties by a hash of id and text, so
that copies spread over ranges), which puts alike documents next to each other.  The ranges hold
about as many characters each, by approximate quantiles of the key weighed by text length; each is
one stream of tokens, cut every ``length`` tokens.  Only the end of a range falls short; it is cut at falling powers
of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import named, small_batches
from .tokens import encoder
from .words import Words, mix, slices

DIMS, BITS = 4, 8
#: Bits of the tie-breaking hash in a range's key; characters that one entry of the quantiles stands for.
TIE, UNIT = 28, 2048


def coordinates(words: Words) -> np.ndarray:
    """(texts, DIMS) cells: sums of random signs of the words, by the square root of their number."""
    hashes = words.hashes(fold=True)
    out = np.zeros((len(words.counts), DIMS), np.int64)
    scale = np.sqrt(np.maximum(words.counts, 1)) * 2.0
    steps = mix(hashes + np.uint64(99))
    for d in range(DIMS):
        sign = ((steps >> np.uint64(8 * d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.r_[0, np.cumsum(sign)]
        value = (sums[words.first[1:]] - sums[words.first[:-1]]) / scale
        share = 1 / (1 + np.exp(-1.702 * np.clip(value, -20, 20)))
        out[:, d] = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of cells, by turning axes to a Gray code of the index (Skilling)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Packer:
    """Cuts a stream of documents into sequences and yields their pieces."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.filled = length, first, 0
        self.open: list[list] = []

    def add(self, doc, ids: bytes) -> list[list]:
        total, start, done = len(ids) // 4, 0, []
        while start < total:
            size = min(total - start, self.length - self.filled)
            body = ids[4 * start : 4 * (start + size)]
            self.open.append([doc, start, size, total, self.sequence, self.filled, body])
            start, self.filled = start + size, self.filled + size
            if self.filled == self.length:
                done += self.open
                self.open, self.filled, self.sequence = [], 0, self.sequence + 1
        return done

    def close(self) -> list[list]:
        """The last, short sequence, cut again at falling powers of two."""
        rest, self.open = self.open, []
        left, self.filled = self.filled, 0
        out = []
        room = at = 0
        for doc, start, size, total, _, _, body in rest:
            while size:
                if not room:
                    room, at = 1 << (left.bit_length() - 1), 0
                    left -= room
                    self.sequence += 1
                part = min(size, room)
                out.append([doc, start, part, total, self.sequence - 1, at, body[: 4 * part]])
                start, size, body, room, at = start + part, size - part, body[4 * part :], room - part, at + part
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and, with ``ids``, the
    piece's token ids: one row for each piece of a document of ``docs``.

    A document is its text's ids and then ``end_id``; a null text is empty, so every row gives at
    least one id.  Repeated rows are packed each; rows with a null id are packed under it.  Other
    columns are ignored; an empty table gives an empty result.  Reruns on the same input and
    partition count agree.
    """
    docs = named(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches, cuts=None):
        """(doc_id, key, text), and with the ranges' bounds each row's range by binary search."""
        for batch in batches:
            for piece in slices(batch, 2):
                curve = hilbert(coordinates(Words(piece.column(2))))
                tie = piece.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - TIE)
                key = (curve << TIE) | tie.astype(np.int64)
                columns, names = [piece.column(0), pa.array(key), piece.column(2)], ["doc_id", "key", "text"]
                if cuts is not None:
                    columns, names = [*columns, pa.array(np.searchsorted(cuts, key, "right").astype(np.int32))], [*names, "range"]
                yield pa.RecordBatch.from_arrays(columns, names)

    def packed(batches):
        from pyspark import TaskContext

        out = Packer(length, TaskContext.get().partitionId() << 40)
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()

        def block(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [pa.array(columns[i], pa.int64()) for i in (0, 1, 2)] + [pa.array([zlib.crc32(b) for b in columns[6]], pa.int64())] + [pa.array(columns[i], pa.int64()) for i in (3, 4, 5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                flat = np.frombuffer(b"".join(columns[6]), np.int32)
                arrays.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(columns[2])].astype(np.int32), flat))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        rows: list = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += out.add(doc, encode(text.as_py()) + end)
                if len(rows) >= 4096:
                    yield block(rows)
                    rows = []
        yield block([*rows, *out.close()])

    told = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), "text")
    row = "doc_id long, key long, text string"
    weighed = told.mapInArrow(keyed, row).select("key", F.explode(F.array_repeat(F.lit(0), F.ceil((F.length("text") + 1) / UNIT).cast("int"))))
    found = weighed.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] if parts > 1 else None
    cuts = np.array(sorted(set(found or [])), np.int64)
    # keys are made again rather than written with all texts
    sorted_ = told.mapInArrow(lambda batches: keyed(batches, cuts), row + ", range int").repartitionById(parts, "range").sortWithinPartitions("key", "doc_id", "text").select("doc_id", "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return sorted_.mapInArrow(packed, schema + ", ids array<int>" * ids)
