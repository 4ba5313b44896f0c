"""Operator 12: a trie of conversation prefixes, merged from the partitions' own tries.

A node is a distinct sequence of first turns; its key is a 128-bit hash of its parent's key and its
last turn, so every partition names nodes alike.  Partitions read their conversations as a stream and
pass on locally combined node tables: a shared prefix is one row a partition, however many
conversations have it.  Tables are merged by key twice, first in parts, and sums, minima and lists of
ends with them; lists are kept in blocks of ids, so none outgrows a row.  A row also has the keys of
its ancestors at distances 1, 2, 4, ...: with them, sums over subtrees take one merge for each doubling
of the depth, bottom-up, instead of one for each level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import named, small_batches, written

#: Nodes that a task holds before it passes them on; parts of a first merge; bits of an id within a block of ends.
HELD, PARTS, BLOCK_BITS = 1 << 17, 16, 16
HEADS = 5
NODE = "key binary, depth long, jumps array<binary>, chars long, conv_id long, n long, block long, ends array<long>"
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _taken(conv_id: Column) -> Column:
    """Turns that a conversation takes over from another one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEADS + 1)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, own, turn, digest, chars): the turns taken over (own = 0) and all own ones (own = 1) of
    each conversation; a reader leaves out the first own ones, as many as it takes.  A digest stands for
    role and text.  Turns of one number go by their digests."""
    told = named(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = told.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    first = F.row_number().over(_by("conv_id", "turn", "digest"))
    heads = turns.where("conv_id % 100 = 0").withColumn("i", first.cast("long")).where(F.col("i") <= HEADS).select(F.col("conv_id").alias("head_id"), "i", "digest", "chars")
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("head_id"), _taken(F.col("conv_id")).alias("h"))
    taken = convs.join(heads, "head_id").where("i <= h").select("conv_id", F.lit(0).alias("own"), F.col("i").alias("turn"), "digest", "chars")
    return taken.unionByName(turns.select("conv_id", F.lit(1).alias("own"), "turn", "digest", "chars"))


def _by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_first() for c in order))


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node tables of a partition's conversations, which come in order of conv_id and turn."""
    nodes: dict[bytes, list] = {}
    ends: dict[tuple[bytes, int], list[int]] = {}
    path: list[bytes] = [ROOT]
    now, skip = None, 0

    def seen(key: bytes, chars: int) -> None:
        node = nodes.get(key)
        if node is None:
            d = len(path) - 1
            nodes[key] = [d, [path[d - (1 << k)] for k in range(d.bit_length())], chars, now, 1]
        else:
            node[4] += 1

    def ended() -> None:
        ends.setdefault((path[-1], now >> BLOCK_BITS), []).append(now)

    def told() -> Iterator[pa.RecordBatch]:
        rows = [(key, *node, None, None) for key, node in nodes.items()] + [(key, None, None, None, None, None, block, ids) for (key, block), ids in ends.items()]
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        names = ["key", "depth", "jumps", "chars", "conv_id", "n", "block", "ends"]
        for at in range(0, len(rows), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[at : at + (1 << 14)], strict=True), kinds, strict=True)], names=names)
        nodes.clear()
        ends.clear()

    for batch in batches:
        for conv, own, digest, chars in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            if conv != now:
                if now is not None:
                    ended()
                    if len(nodes) + len(ends) > HELD:
                        yield from told()
                now, path, skip = conv, [ROOT], zlib.crc32(str(conv).encode()) % (HEADS + 1)
                seen(ROOT, 0)
            if own and skip:
                skip -= 1
                continue
            path.append(hashlib.blake2b(path[-1] + bytes.fromhex(digest), digest_size=16).digest())
            seen(path[-1], chars)
            if len(nodes) > HELD:
                yield from told()
    if now is not None:
        ended()
    yield from told()


def _merged(nodes: DataFrame, *keys: str) -> DataFrame:
    same = (F.first(c).alias(c) for c in ("depth", "jumps", "chars"))
    return nodes.groupBy(*keys).agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): blocks of a node's ids in order, as one stream through the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        keys, found = [], []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if state:
                        keys.append(now)
                        found.append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
            keys, found = [], []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    parts = ends.groupBy("key", "block", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")).agg(F.flatten(F.collect_list("ends")).alias("ends"))
    whole = parts.groupBy("key", "block").agg(F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("ends"))), lambda x: x.cast("string")), ",").alias("ids"))
    return whole.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node.

    Conversations are rebuilt first (``rebuilt``).  A node goes by its smallest member and its depth; the
    root, at depth 0, is there if any conversation is, and has no parent.  Turns sort by number, null first,
    those of one number by digest; repeated rows are turns of their own; null roles and texts are empty; rows
    without a conv_id take no part; an empty table gives no rows.  A conversation is read by one task, as a
    stream of digests; its keys have to fit there, 16 bytes a turn.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    turns = rebuilt(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "own", F.col("turn").asc_nulls_first(), "digest")
    partial = written(turns.mapInArrow(_partial_tries, NODE), "trie_partial")
    first = partial.where("depth is not null").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    nodes = written(_merged(_merged(first, "key", "part"), "key"), "trie_nodes")
    ends = _end_digests(partial.where("depth is null"))

    parent = F.get("jumps", F.lit(0))
    children = nodes.where("depth > 0").groupBy(parent.alias("key")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    sums = own.select(
        "key", "jumps", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved_tokens"),
        F.col("conv_id"), F.col("depth"), F.col("n"), "n_children",
    )
    facts = ("conv_id", "depth", "n", "n_children")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for k in range(deepest.bit_length()):  # sums over descendants nearer than 2**k give those nearer than 2**(k + 1)
        here = F.struct("key", "jumps", "n_leaves", "saved_tokens", *facts)
        none = (F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in facts)
        above = F.struct(F.get("jumps", F.lit(k)).alias("key"), F.lit(None).cast("array<binary>").alias("jumps"), "n_leaves", "saved_tokens", *none)
        both = sums.select(F.explode(F.when(F.size("jumps") > k, F.array(here, above)).otherwise(F.array(here))).alias("x")).select("x.*")
        sums = both.groupBy("key").agg(
            F.first("jumps", True).alias("jumps"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
            *(F.max(c).alias(c) for c in facts),
        )
        if k % 8 == 7:
            sums = written(sums, "trie_sums")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = sums.join(ends, "key", "left").withColumn("parent", F.when(F.col("depth") > 0, parent)).join(above, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
