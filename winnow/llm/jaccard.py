"""Operator 1: exact n-gram Jaccard join with set-relation skipping, and its components.

Each text becomes the set of its distinct word n-grams (64-bit identities).  The join keeps every
pair of different sets with ``100 * |x & y| >= percent * |x | y|`` as a connection and returns the
connected components, in four steps:

1. *Signatures.*  Two linked sets of sizes in neighbouring classes (ratio ``percent`` / 100) differ in
   at most H elements.  The universe is hashed into more than H parts, so one part at least is the
   same in both: each set gives one signature a part, for its own class and for the next one.  This
   holds for any subset of the universe, so elements in more than ``COMMON`` of the documents (by
   counts of all elements in a fixed number of slots) are left out: shared passages link nothing.  Sets
   that have little else sign their parts of the whole universe too, so that what they lack links nothing.
   Parts of one element, which one shared passage makes equal, sign only where larger ones are too few.  A task sends
   each signature once, in one block a bucket, with the first set that has it, and links its other
   sets to that one itself.
2. *Families.*  Sets that share a signature, directly or by way of others, form a family; every link
   lies within one.  Two texts that merely share a passage share no whole part, so families stay
   those of near copies.
3. *Set-relation skipping* within a family (Skipper below).  Index lists are in blocks of one set size
   and one position, and blocks that the position bound rules out are skipped whole.  A set that
   differs little from one with computed overlaps takes these over and corrects them with the lists
   of the few differing elements.  A family above ``CHUNK_BYTES`` is cut into chunks and joined chunk
   against chunk, so that no task holds more than two of them.
4. *Components* over the spanning edges that the tasks return, then over the copies of each set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import components, small_batches, written
from .words import Words, mix, runs, slices

#: Bytes of the sets of a family that one chunk holds, about.
CHUNK_BYTES = 4 << 20
#: Signatures that a map task holds before it sends them.
HELD = 1 << 20
#: Slots that elements are counted in; a slot with more than this share of the documents' number, and
#: COMMON_LEAST at least, is one of very common elements.
SLOTS, COMMON, COMMON_LEAST = 1 << 20, 1e-3, 50
#: Most sets of a family in a chunk, and computed overlaps that are kept to derive others from.
CHUNK_SETS, KEPT_ROWS = 1500, 256
#: A filter of fixed size that spares sets outside all families the way to the join, as long as the
#: members are fewer than its bits; the join itself decides.
MEMBER_BITS = 1 << 26
#: Bits of a signature that are kept beside its bucket: a chance match only adds a candidate.
SHIFT = np.uint64(40)
KEPT = (np.uint64(1) << SHIFT) - np.uint64(1)
#: Added to the numbers of the schemes that sign all elements.
WHOLE = 1 << 20
#: The same for parts of two elements or more; at these percentages, with at most so many elements a part
#: as a mean, more parts hold two than elements may differ.  Above, few of the usual parts hold only one.
LARGE, LARGE_PERCENT, LARGE_LOAD = 1 << 21, range(79, 85), 2.4


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-grams; of fewer words, the whole sequence as one; of none, none."""
    if not len(words):
        return words
    return np.unique(runs(words, min(n, len(words))))


def set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set's content."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    bounds = np.r_[0, np.cumsum(sizes)]
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x1234567, 0x89ABCDE):
            sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(mix(flat ^ np.uint64(salt)), out=sums[1:])
            out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def classes(percent: int, upto: int) -> np.ndarray:
    """Lowest sizes of the size classes up to one above ``upto``."""
    lows = [1, 1 * 100 // percent + 1]
    while lows[-2] <= upto:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows, np.int64)


def signatures(x: np.ndarray, size: int, percent: int, lows: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set of ``size`` elements, ``x`` those that are not very common and ``whole``
    all of them: for its class and the next, a hash of what each part holds.

    If more of a set's parts hold something than elements differ from any set that it may link with, one
    of these is the same in both.  A part of one element is the same in all sets with that element, so a
    passage that two texts share would link them by itself; where parts of two elements or more are enough,
    the set signs only these.  Others sign them too, and parts of a second, coarser kind that hold anything.
    Sets that have too few of these sign the parts of ``whole`` as well, under a tag of their own.  So of two linked
    sets either one has enough parts of a kind, and the other signs that kind as well, or both go on to the next.
    Only where the parts of ``whole`` are too few as well do empty parts have signatures;
    parts are so many that sets of a dozen elements or more rarely come to that."""
    k = int(np.searchsorted(lows, size, "right")) - 1
    out = []
    for scheme in (k, k + 1):
        most = int(lows[scheme + 1]) - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        parts = differ + differ // 5 + math.isqrt(9 * differ // 4) + 2
        # of this set and any that it links with in this scheme
        differ = (size + min(size * 100 // percent, most)) * (100 - percent) // (100 + percent)
        if percent in LARGE_PERCENT:
            own, held = _part_hashes(x, max(parts, int(most / LARGE_LOAD)), scheme + LARGE)
            out.append(own[held > 1])
            if len(out[-1]) > differ:
                continue
        own, held = _part_hashes(x, parts, scheme)
        full = held > 0
        if full.sum() > differ:
            out.append(own[full])
        elif whole is None:
            out.append(own)
        else:
            all_, held = _part_hashes(whole, parts, scheme + WHOLE)
            out += [own[full], all_[held > 0] if (held > 0).sum() > differ else all_]
    return np.concatenate(out)


def _part_hashes(x: np.ndarray, parts: int, scheme: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of what each part holds, and how many elements these are."""
    with np.errstate(over="ignore"):
        part = (mix(x ^ np.uint64(0xA5A5A5A5)) % np.uint64(parts)).astype(np.int64)
        held = np.zeros(parts, np.uint64)
        np.add.at(held, part, mix(x ^ np.uint64(0x5EED)))
        tag = np.uint64(scheme) * np.uint64(0x100000001B3) + np.uint64(1)
        return mix(mix(held) + mix(np.arange(parts, dtype=np.uint64) + tag * np.uint64(0x9E3779B97F4A7C15))), np.bincount(part, minlength=parts)


def led(bucket: np.ndarray, rest: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted keys (bucket and signature), their owners, the owner that comes first with the same
    key, and where a key begins."""
    key = (bucket << SHIFT) | rest
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    opens = np.r_[True, key[1:] != key[:-1]]
    return key, owner, owner[np.flatnonzero(opens)][np.cumsum(opens) - 1], opens


def block(rest: np.ndarray, owner: np.ndarray, names: np.ndarray) -> bytes:
    """Signatures of one bucket with their sets: the different names once, then five bytes of each
    signature and two or four of its owner's number."""
    some, place = np.unique(owner, return_inverse=True)
    kind = "<u2" if len(some) <= 1 << 16 else "<u4"
    return b"".join([np.array([len(some), len(rest)], np.int64).tobytes(), names[some].tobytes(), rest.astype("<u4").tobytes(), (rest >> np.uint64(32)).astype(np.uint8).tobytes(), place.astype(kind).tobytes()])


def unblock(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(body, np.int64, 2).tolist()
    at = 16 + 8 * n
    low, high = np.frombuffer(body, "<u4", m, at), np.frombuffer(body, np.uint8, m, at + 4 * m)
    place = np.frombuffer(body, "<u2" if n <= 1 << 16 else "<u4", m, at + 5 * m)
    return low | (high.astype(np.uint64) << np.uint64(32)), np.frombuffer(body, np.int64, n, 16)[place]


def _rows(bucket, body, a, b) -> pa.RecordBatch:
    n = len(bucket)
    numbers = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([numbers(bucket), pa.nulls(n, pa.binary()) if body is None else pa.array(body, pa.binary()), numbers(a), numbers(b)], ["bucket", "body", "a", "b"])


def sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for piece in slices(batch, 1):
            words = Words(piece.column(1))
            hashes = words.hashes(fold=True)
            yield piece, [shingles(hashes[a:b], n) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def slots(x: np.ndarray) -> np.ndarray:
    return (mix(x ^ np.uint64(0xC0FFEE)) % np.uint64(SLOTS)).astype(np.int64)


def member_bit(sid: np.ndarray) -> np.ndarray:
    return (mix(sid.view(np.uint64)) % np.uint64(MEMBER_BITS)).astype(np.int64)


def find_parent(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


class Skipper:
    """Joins the sets of one family (or of two chunks of it) by set-relation skipping."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sets = percent, sets
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        token, local, df = np.unique(flat, return_inverse=True, return_counts=True)
        # rare elements first: positions then tell most
        rank = np.empty(len(token), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(token))
        local = rank[local]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((local, owner))
        local = local[order]
        bounds = np.r_[0, np.cumsum(self.sizes)]
        self.elements = [local[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        position = np.arange(len(local)) - np.repeat(bounds[:-1], self.sizes)
        # lists by element; within one, blocks of one size and one position
        order = np.lexsort((owner, position, self.sizes[owner], local))
        self.owner, self.position = owner[order], position[order]
        self.at = np.r_[0, np.cumsum(np.bincount(local, minlength=len(token)))]
        self.direct: list[int] = []
        self.rows = np.zeros((0, len(sets)), np.int64)
        self.dead = np.zeros((0, len(sets)), bool)
        self.skipped = self.derived = self.computed = 0

    def need(self, n: int, m: np.ndarray) -> np.ndarray:
        """The least overlap that links sets of n and m elements."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def lists(self, elements: np.ndarray) -> np.ndarray:
        """Places of all entries of these elements' lists."""
        start, size = self.at[elements], self.at[elements + 1] - self.at[elements]
        return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))

    def slack(self, n: int) -> int:
        return n // 8

    def compute(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Overlaps of x with all sets, but for those that a skipped block rules out (dead)."""
        n, elements = int(self.sizes[x]), self.elements[x]
        places = self.lists(elements)
        size = self.at[elements + 1] - self.at[elements]
        i, j = np.repeat(np.arange(n), size), self.position[places]
        owner = self.owner[places]
        m = self.sizes[owner]
        bound = np.minimum(i, j) + np.minimum(n - i, m - j)
        skip = bound < self.need(n, m) - 2 * self.slack(n)
        self.skipped += int(skip.sum())
        dead = np.zeros(len(self.sets), bool)
        dead[owner[skip]] = True
        return np.bincount(owner[~skip], minlength=len(self.sets)), dead

    def overlaps(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Taken over from the most similar set with computed overlaps if the two differ little."""
        n = int(self.sizes[x])
        if self.direct:
            shared = np.where(self.dead[:, x], 0, self.rows[:, x])
            differ = self.sizes[self.direct] + n - 2 * shared
            best = int(differ.argmin())
            y = self.direct[best]
            if differ[best] <= min(self.slack(n), self.slack(int(self.sizes[y]))):
                self.derived += 1
                add = np.setdiff1d(self.elements[x], self.elements[y], assume_unique=True)
                drop = np.setdiff1d(self.elements[y], self.elements[x], assume_unique=True)
                k = len(self.sets)
                row = self.rows[best] + np.bincount(self.owner[self.lists(add)], minlength=k) - np.bincount(self.owner[self.lists(drop)], minlength=k)
                return row, self.dead[best]
        row, dead = self.compute(x)
        if len(self.direct) < KEPT_ROWS:
            self.rows, self.dead = np.vstack([self.rows, row[None]]), np.vstack([self.dead, dead[None]])
            self.direct.append(x)
        else:  # the oldest gives way
            at = self.computed % KEPT_ROWS
            self.rows[at], self.dead[at], self.direct[at] = row, dead, x
        self.computed += 1
        return row, dead

    def edges(self) -> list[tuple[int, int]]:
        """Edges that connect just the sets which links connect."""
        parent, out = list(range(len(self.sets))), []
        for x in np.argsort(self.sizes, kind="stable").tolist():
            row, dead = self.overlaps(x)
            linked = (row * (100 + self.percent) >= self.percent * (self.sizes[x] + self.sizes)) & ~dead
            for y in np.flatnonzero(linked).tolist():
                a, b = find_parent(parent, x), find_parent(parent, y)
                if a != b:
                    parent[a] = b
                    out.append((x, y))
        return out


def join_family(members: dict[tuple[int, int], np.ndarray], percent: int) -> list[tuple]:
    keys = list(members)
    return [(keys[a], keys[b]) for a, b in Skipper([members[k] for k in keys], percent).edges()] if len(keys) > 1 else []


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (see ``jaccard_links``)."""
    return jaccard_links(docs, id_column, text_column, n, percent).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 5, percent: int = 80, tag: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, root) for each row of ``docs``, and its ``tag`` (long) if one is given.

    ``root`` is the same for the rows of a component, whatever their ids, and null where there are no shingles.

    ``component_id`` is the smallest id in the row's component of linked texts, the row itself
    included.  A null or empty text has no shingles and links with nothing; rows with a null id are
    returned with their own links, and give no component its id unless no other row does.  Repeated
    rows stay.  An empty table gives an empty result.  Other columns are ignored.
    """
    tags = [] if tag is None else [tag.cast("long").alias("tag")]
    docs = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"), *tags)
    small_batches(docs.sparkSession)
    tags = ["tag"] * len(tags)
    tagged, docs = docs, docs.select("id", "text")

    def summaries(batches):
        for piece, sets in sets_of(batches, n):
            one, two = set_ids(sets)
            columns = [piece.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(one), pa.array(two), *piece.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sid", "chk", *tags])

    def counted(batches):
        """A task's counts of elements by slot, in pieces."""
        counts = np.zeros(SLOTS, np.int32)
        for _, sets in sets_of(batches, n):
            counts += np.bincount(slots(np.concatenate(sets)), minlength=SLOTS).astype(np.int32)
        step = SLOTS // 64
        for i in range(64):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([counts[i * step : (i + 1) * step].tobytes()], pa.binary())], ["piece", "body"])

    def summed(batches):
        """The very common slots of each piece, as bits."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(body, np.int32).astype(np.int64)
                sums[i] = sums[i] + counts if i in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x > limit).tobytes() for x in sums.values()], pa.binary())], ["piece", "body"])

    def signed(batches):
        """Blocks of signatures by bucket, and links (bucket random, a and b set) that a task makes."""
        sigs: list[np.ndarray] = []
        owners: list[int] = []
        seen: set[int] = set()
        lows, held = classes(percent, 1 << 40), 0

        def flush():
            flat, names = np.concatenate(sigs), np.array(owners, np.int64)
            owner = np.repeat(np.arange(len(names)), [len(x) for x in sigs])
            key, owner, lead, opens = led(flat % np.uint64(parts), (flat // np.uint64(parts)) & KEPT, owner)
            bucket, rest = (key >> SHIFT).astype(np.int64), key & KEPT
            pair = np.unique(np.stack([lead[~opens], owner[~opens]], 1), axis=0)
            bucket, rest, owner = bucket[opens], rest[opens], owner[opens]
            cuts = np.searchsorted(bucket, np.arange(parts + 1))
            for i in range(parts):
                if cuts[i] < cuts[i + 1]:
                    yield _rows([i], [block(rest[cuts[i] : cuts[i + 1]], owner[cuts[i] : cuts[i + 1]], names)], None, None)
            pair = names[pair[pair[:, 0] != pair[:, 1]]]
            yield _rows(np.arange(len(pair)) % parts, None, pair[:, 0], pair[:, 1])

        for _, sets in sets_of(batches, n):
            ids, _ = set_ids(sets)
            for sid, x in zip(ids.tolist(), sets, strict=True):
                if len(x) and sid not in seen:
                    seen.add(sid)
                    sigs.append(signatures(x[~common.value[slots(x)]], len(x), percent, lows, x))
                    owners.append(sid)
                    held += len(sigs[-1])
            if held >= HELD:
                yield from flush()
                sigs, owners, held = [], [], 0
                seen.clear()
        if sigs:
            yield from flush()

    def chained(batches):
        """Sets with one signature link to the first of them; links that tasks made pass."""
        blocks: list[tuple] = []
        for batch in batches:
            made = np.asarray(batch.column(2).is_valid())
            if made.any():
                yield batch.filter(pa.array(made)).select(["a", "b"])
            some = batch.filter(pa.array(~made))
            for bucket, body in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                rest, owner = unblock(body)
                blocks.append((np.full(len(rest), bucket, np.int32), rest, owner))
        if blocks:
            bucket, rest, owner = map(np.concatenate, zip(*blocks, strict=True))
            blocks.clear()
            # a partition's few buckets by number, to leave room in the key
            _, owner, lead, opens = led(np.unique(bucket, return_inverse=True)[1].astype(np.uint64), rest, owner)
            pair = np.unique(np.stack([lead[~opens], owner[~opens]], 1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def filtered(batches):
        """A task's bits of family members, in pieces."""
        bits = np.zeros(MEMBER_BITS // 8, np.uint8)
        for batch in batches:
            at = member_bit(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        step = len(bits) // 64
        for i in range(64):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([bits[i * step : (i + 1) * step].tobytes()], pa.binary())], ["piece", "body"])

    def united(batches):
        all_: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.frombuffer(body, np.uint8)
                all_[i] = all_[i] | bits if i in all_ else bits
        yield pa.RecordBatch.from_arrays([pa.array(list(all_), pa.int32()), pa.array([x.tobytes() for x in all_.values()], pa.binary())], ["piece", "body"])

    def contents(batches):
        seen: set[tuple[int, int]] = set()
        for _, sets in sets_of(batches, n):
            ids, checks = set_ids(sets)
            at = member_bit(ids)
            some = (member.value[at >> 3] >> (at & 7)) & 1
            sets = [x if known else x[:0] for x, known in zip(sets, some, strict=True)]
            rows = []
            for key in zip(ids.tolist(), checks.tolist(), sets, strict=True):
                if len(key[2]) and key[:2] not in seen:
                    seen.add(key[:2])
                    rows.append((*key[:2], key[2].tobytes()))
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["sid", "chk", "body"])

    def joined(batches):
        """Rows come sorted by task; a task's sets are held, then joined."""
        now, members = None, {}

        def done():
            pairs = join_family(members, percent)
            return pa.RecordBatch.from_arrays([pa.array([(p[k][0], p[k][1]) for p in pairs], pa.struct([("sid", pa.int64()), ("chk", pa.int64())])) if pairs else pa.array([], pa.struct([("sid", pa.int64()), ("chk", pa.int64())])) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            task = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, sid, chk, body in zip(task, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if key != now:
                    if len(members) > 1:
                        yield done()
                    now, members = key, {}
                if (sid, chk) not in members:
                    members[sid, chk] = np.frombuffer(body.as_buffer(), np.uint64)
        if len(members) > 1:
            yield done()

    spark = docs.sparkSession
    rows = written(tagged.mapInArrow(summaries, "id long, n long, sid long, chk long" + ", tag long" * len(tags)), "sets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(COMMON_LEAST, COMMON * rows.count())
    pieces = docs.mapInArrow(counted, "piece int, body binary").repartition(min(parts, 64), "piece").mapInArrow(summed, "piece int, body binary")
    bits = np.zeros(SLOTS, bool)
    for r in pieces.collect():  # SLOTS bits in all
        bits[r.piece * (SLOTS // 64) : (r.piece + 1) * (SLOTS // 64)] = np.unpackbits(np.frombuffer(r.body, np.uint8)).astype(bool)
    common = spark.sparkContext.broadcast(bits)
    sigs = docs.select("id", "text").mapInArrow(signed, "bucket long, body binary, a long, b long")
    pairs = sigs.repartitionById(parts, F.col("bucket").cast("int")).mapInArrow(chained, "a long, b long").distinct()
    family = components(pairs).select(F.col("node").alias("sid"), F.col("root").alias("family"))
    family = written(family, "families")
    sizes = rows.where("n > 0").select("sid", "chk", "n").distinct().join(family, "sid").groupBy("family").agg(F.ceil(F.greatest(F.sum("n") * 8 / CHUNK_BYTES, F.count("*") / CHUNK_SETS)).cast("int").alias("k"))
    members = family.join(sizes, "family").hint("shuffle_hash")
    pieces = family.select("sid").mapInArrow(filtered, "piece int, body binary").repartition(min(parts, 64), "piece").mapInArrow(united, "piece int, body binary")
    bits = np.zeros((64, MEMBER_BITS // 8 // 64), np.uint8)
    for r in pieces.collect():  # MEMBER_BITS bits in all
        bits[r.piece] = np.frombuffer(r.body, np.uint8)
    member = spark.sparkContext.broadcast(bits.ravel())
    bodies = docs.mapInArrow(contents, "sid long, chk long, body binary").join(members, "sid")
    chunk = F.pmod(F.xxhash64("chk", "sid"), F.col("k")).cast("int")
    tasks = bodies.withColumn("c", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tasks = tasks.select("family", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "sid", "chk", "body")
    tasks = tasks.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    edges = tasks.mapInArrow(joined, "a struct<sid:long,chk:long>, b struct<sid:long,chk:long>")
    roots = components(edges).select(F.col("node.sid").alias("sid"), F.col("node.chk").alias("chk"), "root")
    single = F.struct("sid", "chk")
    rooted = rows.where("n > 0").join(roots, ["sid", "chk"], "left").select("id", "n", F.coalesce("root", single).alias("root"), *tags)
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")  # so that the join can be split
    linked = rooted.join(least, "root").select("id", "n", "component_id", "root", *tags)
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(None).cast(rooted.schema["root"].dataType).alias("root"), *tags)
    return linked.union(alone).toDF("doc_id", "n_shingles", "component_id", "root", *tags)
