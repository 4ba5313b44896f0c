"""Operator 7: exact top-k inner products by a Voronoi kNN join.

Vectors are integers; x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared length,
and a query a 0.  The squared distance is then M + |q|^2 - 2 <x, q>, so the nearest are the best.

1. Equal vectors are one row with their smallest ids, combined in the map tasks first.
2. A sample of the vectors, the square root of their number within fixed bounds, are pivots; data and
   queries go to the cell of their nearest one.
3. The cells' summaries (radii, and the smallest distances to the pivot) bound how far the k-th
   neighbour of any query of a cell can be, and so which data a group of query cells can need.
4. Data are replicated to just those groups, each cut into chunks of about ``CHUNK`` rows by how many
   it gets; each (group, chunk) task solves its part, and the parts' best are merged.

Vectors too long for 64-bit products, if there are any, are left out of this and set against all others
in whole numbers of any size, in blocks (``_of_any_size``); the best of both count.
"""

from __future__ import annotations

import heapq
import math
import zlib
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import named, written

#: Vectors sampled as pivots, at least and at most; queries of one group; data rows of one chunk.
PIVOTS, MOST_PIVOTS, GROUP, CHUNK = 64, 1024, 2048, 1 << 16
#: Squared lengths in cells stay below this, and so do inner products, by Cauchy and Schwarz.
LONGEST = 2.0**62
#: Rows of a block of data where vectors are of any size.
BLOCK = 4096


def integers(column: pa.Array) -> list[np.ndarray | list[int] | None]:
    """floor(256 * x) of each vector; None where it or a component is null or not finite.  Where the
    squared length is too large for 64-bit products, a list of Python's integers."""
    out: list[np.ndarray | list[int] | None] = []
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    upto = np.cumsum(sizes)
    for valid, b, n in zip(np.asarray(column.is_valid()), upto, sizes, strict=True):
        own = values[b - n : b]
        if not valid or not np.isfinite(own).all():
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            x = np.floor(256 * own)
            fine = (x * x).sum() < LONGEST
        # from 2 ** 52 on there is nothing to floor, and 256 * x may be no double any more
        out.append(x.astype("<i8") if fine else [256 * int(v) if abs(v) >= 2.0**52 else math.floor(256 * v) for v in own.tolist()])
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the binaries, padded with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column):
        row = np.frombuffer(x.as_buffer(), "<i8")
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Between extended vectors and extended pivots."""
    square = (x.astype(float) ** 2).sum(1) + extra**2
    pivot = (pivots.astype(float) ** 2).sum(1) + pivot_extra**2
    both = products(x, pivots).astype(float) + extra[:, None] * pivot_extra
    return np.sqrt(np.maximum(square[:, None] + pivot - 2 * both, 0))


def slack(width: int, longest: float) -> float:
    """More than sums of six computed distances can be off by.

    A squared distance is a sum of ``width`` + 1 rounded products, each at most 4 * ``longest``, and
    its root is off by the root of that error at most."""
    return 8 * float(np.sqrt((width + 16) * 2.0**-52 * 8 * max(longest, 1.0)))


def bounds(between: np.ndarray, query_radius: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """For each query cell, how far the k-th neighbour of its queries can be at most; ``near`` has the
    smallest distances to each pivot, infinite where there are fewer."""
    out = np.full(len(between), np.inf)
    if near.size >= k:
        for i in range(len(between)):
            out[i] = np.partition((between[i][:, None] + near).ravel(), k - 1)[k - 1] + query_radius[i]
    return out


def grouped(counts: np.ndarray, between: np.ndarray, size: int) -> list[list[int]]:
    """Neighbouring query cells put together until a group has ``size`` queries; a larger cell is a
    group by itself, once for each ``size`` queries."""
    left, groups, now, filled = [int(i) for i in np.flatnonzero(counts)], [], [], 0
    at = left[0] if left else 0
    while left:
        at = min(left, key=lambda i: between[at, i])
        left.remove(at)
        if counts[at] > size:
            groups += [[at]] * -(-int(counts[at]) // size)
            continue
        if filled + counts[at] > size:
            groups.append(now)
            now, filled = [], 0
        now, filled = [*now, at], filled + int(counts[at])
    return [*groups, now] if now else groups


def top_products(vectors: DataFrame, every: int = 20, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose vec_id is divisible
    by ``every``; ties go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
    shorter vectors count as padded with zeros.  With fewer candidates than k, all come.  Rows
    repeated with one id count once.  An empty table gives an empty result.  A score beyond 64 bits
    among the k best is an error, as no long can hold it.
    """
    rows = named(vectors, vec_id="vec_id", embedding="embedding").where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = k + 1

    def read(batches):
        for batch in batches:
            found = []
            for i, x in zip(batch.column(0).to_pylist(), integers(batch.column(1)), strict=True):
                if isinstance(x, list):
                    found.append((i, None, None, None, ",".join(map(str, x))))
                elif x is not None:
                    found.append((i, x.tobytes(), len(x), float((x.astype(float) ** 2).sum()), None))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            types = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["vec_id", "vec", "dims", "square", "long"])

    def merged(batches):
        held: dict[bytes, list[int]] = {}

        def block():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["vec", "ids"])
            held.clear()

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault(x, [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > most:
                        ids.remove(max(ids))
            if len(held) > 50_000:
                yield from block()
        yield from block()

    every_row = written(rows.mapInArrow(read, "vec_id long, vec binary, dims long, square double, long string"), "vectors")
    rows = every_row.where("long is null").drop("long")
    width, longest = rows.agg(F.max("dims"), F.max("square")).first()
    width, longest = int(width or 0), float(longest or 0)
    data = rows.select("vec_id", "vec").mapInArrow(merged, "vec binary, ids array<long>").groupBy("vec")
    data = written(data.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")), "distinct")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec")
    queries = written(asked.select("vec").distinct(), "queries")
    wanted = min(MOST_PIVOTS, max(PIVOTS, int(data.count() ** 0.5)))
    sample = [r.vec for r in data.orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()]
    pivots = matrix(pa.array(sample, pa.binary()), width)
    extra = lambda x: np.sqrt(np.maximum(longest - (x.astype(float) ** 2).sum(1), 0))
    pivot_extra = extra(pivots)
    between = distances(pivots, pivot_extra, pivots, pivot_extra) if len(sample) else np.zeros((0, 0))

    def data_cells(batches):
        for batch in batches:
            x = matrix(batch.column(0), width)
            far = distances(x, extra(x), pivots, pivot_extra)
            cell = far.argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell])], ["vec", "ids", "cell", "far"])

    def query_cells(batches):
        for batch in batches:
            x = matrix(batch.column(0), width)
            far = distances(x, np.zeros(len(x)), pivots, pivot_extra)
            cell = far.argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell])], ["vec", "cell", "far"])

    def nearest(batches):
        """A task's smallest distances in each cell; a row counts as often as it has ids."""
        held: dict[int, list[float]] = {}
        for batch in batches:
            for cell, far, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[cell] = sorted([*held.get(cell, []), *[far] * n])[:most]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["cell", "near"])

    data = written(data.mapInArrow(data_cells, "vec binary, ids array<long>, cell int, far double"), "cells")
    queries = written(queries.mapInArrow(query_cells, "vec binary, cell int, far double"), "query-cells")
    near = np.full((len(sample), most), np.inf)
    for r in data.select("cell", "far", F.size("ids").alias("n")).mapInArrow(nearest, "cell int, near array<double>").groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near")).collect():
        near[r.cell, : len(r.near)] = r.near
    radius, asking = np.zeros(len(sample)), np.zeros(len(sample), np.int64)
    for r in queries.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r.cell], asking[r.cell] = r.far, r.n
    reach = bounds(between, radius, near, most)
    groups = grouped(asking, between, GROUP)
    of_cell: dict[int, list[int]] = {}
    for g, cells in enumerate(groups):
        for c in cells:
            of_cell.setdefault(c, []).append(g)

    off = slack(width, longest)

    def needed(cell: np.ndarray, far: np.ndarray):
        """Each group with the places of the data rows that it can need."""
        for g, cells in enumerate(groups):
            gap = np.abs(between[np.ix_(cells, cell)] - far) - radius[cells][:, None]
            yield g, np.flatnonzero((gap <= reach[cells][:, None] + off).any(0))

    def sized(batches):
        """How many data rows each group gets of a task."""
        sizes = np.zeros(len(groups), np.int64)
        for batch in batches:
            for g, need in needed(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                sizes[g] += len(need)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(groups)), pa.int32()), pa.array(sizes)], ["g", "n"])

    chunks = np.ones(len(groups), np.int64)
    for r in data.select("cell", "far").mapInArrow(sized, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        chunks[r.g] = max(1, -(-r.n // CHUNK))

    def spread(batches):
        """Each data row to the groups that can need it, once a group."""
        for batch in batches:
            name = np.array([zlib.crc32(x) for x in batch.column(0).to_pylist()], np.int64)
            for g, need in needed(batch.column(2).to_numpy(), batch.column(3).to_numpy()):
                at = pa.array(need)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), g, np.int32)), pa.array(name[need] % chunks[g], pa.int32()), pa.array(np.ones(len(need), np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["g", "c", "kind", "vec", "ids"])

    def asked_of(batches):
        """Each query to all chunks of its group."""
        for batch in batches:
            g = np.array([of_cell[c][zlib.crc32(v) % len(of_cell[c])] for v, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int32)
            for c in range(int(chunks[g].max(initial=0))):
                some = np.flatnonzero(chunks[g] > c)
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(g[some]), pa.array(np.full(n, c, np.int32)), pa.array(np.zeros(n, np.int32)), batch.column(0).take(pa.array(some)), pa.nulls(n, pa.list_(pa.int64()))], ["g", "c", "kind", "vec", "ids"])

    def solved(batches):
        """Rows come sorted by task, queries first; the best of a task's data for each query."""
        now, asking, best = None, [], None

        def done():
            score, first, ids = best
            keep = first < np.iinfo(np.int64).max
            q, r = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array([asking[i] for i in q], pa.binary()), pa.array(score[q, r]), pa.array([ids[i][j] for i, j in zip(q, r, strict=True)], pa.list_(pa.int64()))], ["vec", "score", "ids"])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                task, kind, vecs = tuple(key[a, :2]), key[a, 2], batch.column(3).slice(a, b - a)
                if task != now:
                    if best is not None:
                        yield from done()
                    now, asking, best = task, [], None
                if kind == 0:
                    asking += vecs.to_pylist()
                    continue
                if not asking:
                    continue
                if best is None:
                    q = matrix(pa.array(asking, pa.binary()), width)
                    best = np.zeros((len(q), most), np.int64), np.full((len(q), most), np.iinfo(np.int64).max), [[None] * most for _ in q]
                ids = batch.column(4).slice(a, b - a).to_pylist()
                first = np.array([x[0] for x in ids])
                at = np.argsort(first, kind="stable")
                score = products(q, matrix(vecs, width)[at])
                n = len(at)
                some = np.argsort(-score, axis=1, kind="stable")[:, :most] if n <= most else _best(score, most)
                both = np.concatenate([best[0], np.take_along_axis(score, some, 1)], 1)
                firsts = np.concatenate([best[1], first[at][some]], 1)
                empty = firsts == np.iinfo(np.int64).max
                choice = np.lexsort((firsts, -both, empty), axis=1)[:, :most]
                names = [[(old[c] if c < most else ids[at[new[c - most]]]) for c in row] for old, new, row in zip(best[2], some, choice, strict=True)]
                best = np.take_along_axis(both, choice, 1), np.take_along_axis(firsts, choice, 1), names
        if best is not None:
            yield from done()

    schema = "g int, c int, kind int, vec binary, ids array<long>"
    tasks = data.mapInArrow(spread, schema).union(queries.mapInArrow(asked_of, schema))
    tasks = tasks.repartition(parts, "g", "c").sortWithinPartitions("g", "c", "kind")
    found = tasks.mapInArrow(solved, "vec binary, score long, ids array<long>")
    found = found.select("vec", F.explode(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("low"), x.alias("id")))).alias("hit"))
    found = found.groupBy("vec").agg(F.slice(F.sort_array(F.collect_list("hit")), 1, most).alias("hits"))
    own = asked.distinct().join(found, "vec").select("vec_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("vec_id")), 1, k).alias("hits"))
    own = own.select(F.col("vec_id").alias("query_id"), F.posexplode("hits"))
    own = own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.low")).alias("score"))
    too_long = every_row.where("long is not null")
    if too_long.isEmpty():
        return own
    asked_all, asked_long = (x.where(F.col("vec_id") % every == 0) for x in (every_row, too_long))
    more = _of_any_size(asked_all, too_long, k).union(_of_any_size(asked_long, rows.withColumn("long", F.lit(None).cast("string")), k))
    both = own.drop("rank").unionByName(more).distinct()
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int")).where(F.col("rank") <= k)
    lowest = F.raise_error(F.lit("a score below 64 bits is among the best"))
    return both.select("query_id", "rank", "vec_id", F.when(F.col("score") == np.iinfo(np.int64).min, lowest).otherwise(F.col("score")).cast("long").alias("score"))


def _of_any_size(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of all rows with other ids the k best of each block of data, by whole
    numbers of any size; scores below 64 bits come as the smallest of them."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries, data = (x.select("vec_id", "vec", "long").distinct() for x in (queries, data))
    groups, chunks = (max(1, -(-x.count() // size)) for x, size in ((queries, GROUP), (data, BLOCK)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(own(groups).alias("g"), every(chunks).alias("c"), F.lit(0).alias("kind"), "vec_id", "vec", "long")
    told = data.select(every(groups).alias("g"), own(chunks).alias("c"), F.lit(1).alias("kind"), "vec_id", "vec", "long")
    tasks = asked.union(told).repartition(parts, "g", "c").sortWithinPartitions("g", "c", "kind")
    limits = np.iinfo(np.int64)

    def solved(batches):
        now, asking = None, []

        def done():
            out = [(q, i, max(score, int(limits.min))) for q, _, best in asking for score, _, i in best]
            if any(x[2] > limits.max for x in out):
                raise ArithmeticError("a score beyond 64 bits is among the best")
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for g, c, kind, i, vec, long in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (g, c) != now:
                    yield done()
                    now, asking = (g, c), []
                x = np.frombuffer(vec, "<i8").tolist() if long is None else [int(v) for v in long.split(",")]
                if kind == 0:
                    asking.append((i, x, []))
                    continue
                for q, y, best in asking:
                    if q != i:
                        hit = sum(map(mul, x, y)), -i, i
                        if len(best) < k:
                            heapq.heappush(best, hit)
                        elif hit > best[0]:
                            heapq.heapreplace(best, hit)
        yield done()

    return tasks.mapInArrow(solved, "query_id long, vec_id long, score long")


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, ties to the left."""
    n = score.shape[1]
    if np.abs(score).max(initial=0) >= 2.0**62 / n:  # no room for the place beside the score
        return np.argsort(-score, axis=1, kind="stable")[:, :k]
    key = score * n + np.arange(n - 1, -1, -1)
    return np.argpartition(-key, k - 1, axis=1)[:, :k]
