"""Operator 10: exact substring dedup by matching statistics on compressed FM-indexes.

A window is ``width`` consecutive words; a word goes if a window over it also starts in a document
with a smaller id.  Words are 64-bit identities (words.py).

1. *Anchors.*  The least hash among a window's ``ANCHOR``-word runs is its anchor, a fifth of all
   places.  Only windows with an anchor that two documents hold can repeat.  Map tasks send their
   distinct anchors in one block a bucket, each with the number of its documents, and confirm those
   that they hold twice themselves.  Confirmed anchors return in one block for each part of the
   documents, so that rows don't grow with documents.
2. *Contents.*  Neighbouring windows with the same confirmed anchor make one content, which goes to
   the shard of its anchor; of an anchor in more than ``HOT_SHARE`` of the documents each window goes
   to the shard of its own hash instead.  A task sends the same content once, and at its end the
   smallest document id that it met the content in, if that was not the first.
3. *FM-index.*  A shard indexes its different contents and streams them by backward search over the
   wavelet levels: the matching statistics of every window end, and the smallest document id in the
   suffix interval of those that reach ``width`` in several places.
4. Contents return to the documents by an equi-join on their hash.  Exact copies need none of this:
   every word of a text that a smaller id has too goes, if it has a window.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex, least
from .jaccard import set_ids
from .tables import named, small_batches, written
from .words import Words, mix, runs, slices

ANCHOR = 5
#: An anchor in more than this share of the documents, and in HOT_LEAST at least, is very common.
HOT_SHARE, HOT_LEAST = 1e-4, 256
#: Window ends that are searched at once; words of one index, about.
ENDS, SHARD_WORDS = 1 << 16, 1 << 19
#: Anchors that a map task holds before it sends them.
HELD = 1 << 19
#: Kinds of blocks: anchors of a bucket, confirmed ones for a part of the documents, very common ones.
ANCHORS, CONFIRMED, COMMON = 0, 1, 2
#: Bytes of blocks that are sent in one batch, about.
BLOCK_BYTES = 4 << 20


def anchors(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor: its place and hash."""
    hashes = runs(words, ANCHOR)
    view = np.lib.stride_tricks.sliding_window_view(hashes, width - ANCHOR + 1)
    place = view.argmin(1) + np.arange(len(view))
    return place, hashes[place]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array of known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def kept_texts(words: Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by single spaces."""
    start, end = words.start[keep], words.end[keep]
    step = np.zeros(len(words.data) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    owner = np.repeat(np.arange(len(words.counts)), words.counts)[keep]
    more = np.r_[owner[1:] == owner[:-1], False] if len(owner) else np.zeros(0, bool)
    data = words.data.copy()
    data[end[more]] = 32
    mask[end[more]] = True
    bounds = np.r_[0, np.cumsum(mask)][words.bounds]
    flat = data[mask].tobytes()
    return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def index_contents(contents: dict[int, tuple[np.ndarray, int]], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(content, smallest document id of each of its windows) of one shard."""
    keys = list(contents)
    flat = np.concatenate([contents[k][0] for k in keys])
    sizes = np.array([len(contents[k][0]) for k in keys])
    _, symbols = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(len(flat) + len(keys), np.int32)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = symbols + 1
    owner = np.repeat(np.array([contents[k][1] for k in keys]), sizes + 1)
    index = FMIndex(text, width)
    starts = ends - sizes
    counts = sizes - width + 1
    at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(int(counts.sum())) + width
    smallest = np.repeat(np.array([contents[k][1] for k in keys]), counts)
    owner = owner[index.suffixes]
    for a in range(0, len(at), ENDS):
        length, low, high = index.matches(text, at[a : a + ENDS], width)
        several = np.flatnonzero(length == width)
        smallest[a + several] = least(owner, low[several], high[several])
    upto = np.cumsum(counts)
    for k, b, c in zip(keys, upto, counts, strict=True):
        yield k, smallest[b - c : b]


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for each row of ``docs``.

    ``removed`` holds the places (start, end exclusive) of removed words as little-endian 32-bit
    pairs in a binary, null for none; a row whose whole text a smaller id has too gets (0, n_words).
    A null text has no words.  Rows with a null id keep all words and count for nobody; rows with
    the same id don't count for each other.  An empty table gives an empty result.
    """
    docs = named(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def summaries(batches):
        for batch in batches:
            for piece in slices(batch, 2):
                words = Words(piece.column(2))
                hashes = words.hashes()
                one, two = set_ids(_placed(hashes, words))
                shas = [hashlib.sha256(x).hexdigest() for x in kept_texts(words, np.ones(len(words.start), bool))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(words.counts, pa.int64()), pa.array(one), pa.array(two), pa.array(shas)], ["doc_id", "key", "n", "sid", "chk", "sha"])

    def sent(batches):
        """Blocks of anchors by bucket, and those confirmed here by the part of their documents."""
        held: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        known: dict[int, int] = {}
        size = 0

        def flush():
            hashes = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            ids = np.array(owners, np.int64)
            at = np.lexsort((owner, hashes))
            hashes, owner = hashes[at], owner[at]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            count = np.diff(np.r_[first, len(hashes)])
            twice = np.repeat(count > 1, count)
            yield from _blocks(by_part(hashes[twice], ids[owner[twice]], parts))
            hashes, owner = hashes[first], owner[first]
            yield from _blocks((ANCHORS, b, _packed(ids, owner[x], hashes[x], count[x])) for b, x in _places(hashes % np.uint64(parts)))

        for batch in batches:
            for piece in slices(batch, 2):
                words = Words(piece.column(2))
                hashes = words.hashes()
                names, _ = set_ids(_placed(hashes, words))
                for i, (doc, key) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                    if doc is None or words.counts[i] < width:
                        continue
                    if (name := int(names[i])) in known:
                        owners[known[name]] = min(owners[known[name]], (doc, key))
                        continue
                    known[name] = len(held)
                    held.append(np.unique(anchors(hashes[words.first[i] : words.first[i + 1]], width)[1]))
                    owners.append((doc, key))
                    size += len(held[-1])
                if size >= HELD:
                    yield from flush()
                    held, owners, size = [], [], 0
                    known.clear()
        if held:
            yield from flush()

    def confirmed(batches):
        """One bucket's blocks: anchors that several documents hold, in one block for each part of the
        documents, however many they are; very common ones.  What a map task has confirmed passes."""
        held: list[tuple] = []
        for batch in batches:
            told = np.asarray(batch.column(0)) == ANCHORS
            if not told.all():
                yield batch.filter(pa.array(~told))
            held += [_unpacked(x) for x in batch.filter(pa.array(told)).column(2).to_pylist()]
        if not held:
            return
        hashes, ids, count = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        at = np.argsort(hashes, kind="stable")
        hashes, ids, count = hashes[at], ids[at], count[at]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        times = np.diff(np.r_[first, len(hashes)])
        several = np.repeat(times > 1, times)
        yield from _blocks(by_part(hashes[several], ids[several], parts))
        total = np.add.reduceat(count, first)
        hot = total >= least_hot
        if hot.any():
            yield from _blocks([(COMMON, 0, np.stack([hashes[first][hot].view(np.int64), total[hot].astype(np.int64)], 1).tobytes())])

    kind = "kind int, at long, body binary"
    rows = written(docs.mapInArrow(summaries, "doc_id long, key long, n long, sid long, chk long, sha string"), "texts")
    least_id = rows.where(F.col("doc_id").isNotNull()).groupBy("sid", "chk").agg(F.min("doc_id").alias("least"))
    least_id = written(least_id, "least")  # so that the join can be split
    rows = written(rows.join(least_id, ["sid", "chk"], "left").select("doc_id", "key", "n", "sha", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy")), "texts")
    least_hot = max(HOT_LEAST, HOT_SHARE * rows.count())
    found = written(docs.mapInArrow(sent, kind).repartitionById(parts, F.col("at").cast("int")).mapInArrow(confirmed, kind), "confirmed")
    # at most 1 / HOT_SHARE times the anchors of an average document
    hot = [np.frombuffer(r.body, np.int64).reshape(-1, 2) for r in found.where(F.col("kind") == COMMON).select("body").toLocalIterator()]
    hot = np.concatenate([*hot, np.zeros((0, 2), np.int64)])
    common = spark.sparkContext.broadcast(np.sort(hot[:, 0].view(np.uint64)))

    def contents(batches):
        """(shard, content, words, doc, key, start): words only where a task first meets a content.
        A row without a start tells that the content is in a smaller document than the first met.

        Rows come sorted: of each part first the documents that are nobody's copy, then blocks of
        confirmed anchors, then texts."""
        met: dict[int, int] = {}
        lower: dict[int, int] = {}
        now, firsts, wanted = None, set(), {}

        def sent_rows(out):
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["shard", "content", "body", "doc_id", "key", "start"])

        def lowered():
            rows = ((shard, name, None, met[name], None, None) for name, shard in lower.items())
            while some := list(itertools.islice(rows, 8192)):
                yield sent_rows(some)

        for batch in batches:
            for (part, step), some in _runs(batch):
                if part != now:
                    now, firsts, wanted = part, set(), {}
                ids = list(zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True))
                if step == 0:
                    firsts.update(ids)
                    continue
                if step == 1:
                    for own, sizes, flat in map(_unparted, some.column(5).to_pylist()):
                        cuts = np.cumsum(sizes)
                        for name, a, b in zip(map(tuple, own.tolist()), (cuts - sizes).tolist(), cuts.tolist(), strict=True):
                            if name in firsts:
                                wanted.setdefault(name, []).append(flat[a:b])
                    continue
                for piece in slices(some.take(pa.array([i for i, name in enumerate(ids) if name in wanted], pa.int64())), 4):
                    words = Words(piece.column(4))
                    hashes = words.hashes()
                    out: list[tuple] = []
                    for i, (doc, key) in enumerate(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                        if (doc, key) not in wanted:  # a repeated row
                            continue
                        own = hashes[words.first[i] : words.first[i + 1]]
                        place, anchor = anchors(own, width)
                        known = among(anchor, np.unique(np.concatenate(wanted.pop((doc, key)))))
                        single = among(anchor, common.value) & known
                        opens = known & (np.r_[True, place[1:] != place[:-1]] | single)
                        last = known & (np.r_[place[1:] != place[:-1], True] | single)
                        for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(last).tolist(), strict=True):
                            body = own[a : b + width]
                            name = hashlib.blake2b(body.tobytes(), digest_size=8).digest()
                            shard = name if single[a] else anchor[a].tobytes()
                            shard, name = int.from_bytes(shard, "little", signed=True), int.from_bytes(name, "little", signed=True)
                            if name not in met:
                                out.append((shard, name, body.tobytes(), doc, key, a))
                                met[name] = doc
                                continue
                            out.append((None, name, None, doc, key, a))
                            if doc < met[name]:
                                met[name], lower[name] = doc, shard
                    yield sent_rows(out)
                    if len(met) > 1_000_000:
                        yield from lowered()
                        met.clear()
                        lower.clear()
        yield from lowered()

    def searched(batches):
        """(content, least) of a task's contents, indexed in shards of about SHARD_WORDS words; contents
        with a common window have one shard number and stay together."""
        shard_of: dict[int, int] = {}
        bodies: dict[int, np.ndarray] = {}
        smallest: dict[int, int] = {}
        size = 0
        for batch in batches:
            for shard, name, body, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                smallest[name] = min(smallest.get(name, doc), doc)
                if name not in bodies and body.is_valid:
                    shard_of[name], bodies[name] = shard, np.frombuffer(body.as_buffer(), np.uint64).copy()
                    size += len(bodies[name])
        shards: dict[int, list[int]] = {}
        for name, number in zip(bodies, (mix(np.array([shard_of[x] for x in bodies], np.int64).view(np.uint64)) % np.uint64(size // SHARD_WORDS + 1)).tolist(), strict=True):
            shards.setdefault(number, []).append(name)
        for names in shards.values():
            rows = ((name, found.tobytes()) for name, found in index_contents({name: (bodies.pop(name), smallest[name]) for name in names}, width))
            while some := list(itertools.islice(rows, 8192)):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.binary())], ["content", "least"])

    def decided(batches):
        """Starts of the windows that go, of each (doc, key, start, least)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, key, start = (batch.column(i).to_numpy() for i in range(3))
            sizes = np.asarray(pa.compute.binary_length(batch.column(3))).astype(np.int64) // 8
            flat = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gone = flat < doc[row]
            row, place = row[gone], (place[gone] + start[row[gone]]).astype("<i4")
            cuts = np.flatnonzero(np.r_[True, (doc[row[1:]] != doc[row[:-1]]) | (key[row[1:]] != key[row[:-1]])]) if len(row) else np.zeros(0, np.int64)
            ends = np.r_[cuts[1:], len(row)] if len(cuts) else cuts
            bodies = [place[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[cuts]]), pa.array(key[row[cuts]]), pa.array(bodies, pa.binary())], ["doc_id", "key", "gone"])

    def cut(batches):
        for batch in batches:
            for piece in slices(batch, 2):
                words = Words(piece.column(2))
                step = np.zeros(len(words.start) + 1, np.int32)
                for i, bodies in enumerate(piece.column(3).to_pylist()):
                    starts = np.unique(np.frombuffer(b"".join(bodies), "<i4")) + words.first[i]
                    step[starts] += 1
                    step[starts + width] -= 1
                gone = np.cumsum(step[:-1]) > 0
                shas = [hashlib.sha256(x).hexdigest() for x in kept_texts(words, ~gone)]
                sums = np.r_[0, np.cumsum(gone)][words.first]
                places = []
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    flips = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
                    places.append(flips.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(np.diff(sums), pa.int64()), pa.array(shas), pa.array(places, pa.binary())], ["doc_id", "key", "n_removed", "kept_sha256", "removed"])

    ids = ["doc_id", "key"]
    part = F.pmod("key", F.lit(parts)).alias("part")
    none = {"id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "body": F.lit(None).cast("binary")}
    firsts = rows.where(~F.col("copy") & F.col("doc_id").isNotNull() & (F.col("n") >= width)).select(part, F.lit(0).alias("step"), *ids, none["text"].alias("text"), none["body"].alias("body"))
    blocks = found.where(F.col("kind") == CONFIRMED).select(F.col("at").alias("part"), F.lit(1).alias("step"), *(none["id"].alias(c) for c in ids), none["text"].alias("text"), "body")
    whole_texts = docs.where("doc_id is not null").select(part, F.lit(2).alias("step"), *ids, "text", none["body"].alias("body"))
    dealt = firsts.union(blocks).union(whole_texts).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "step")
    made = dealt.mapInArrow(contents, "shard long, content long, body binary, doc_id long, key long, start int")
    made = written(made, "contents")
    answers = made.where("shard is not null").repartition(parts, "shard").select("shard", "content", "body", "doc_id").mapInArrow(searched, "content long, least binary")
    gone = made.where("start is not null").select("doc_id", "key", "start", "content").join(answers, "content").select("doc_id", "key", "start", "least").mapInArrow(decided, "doc_id long, key long, gone binary")
    gone = written(gone.groupBy(*ids).agg(F.collect_list("gone").alias("gone")), "gone")
    after = docs.repartition(parts, *ids).join(gone.hint("shuffle_hash"), ids).select("doc_id", "key", "text", "gone").mapInArrow(cut, "doc_id long, key long, n_removed long, kept_sha256 string, removed binary")
    after = after.dropDuplicates(ids)
    out = rows.join(after, ids, "left")
    whole = F.col("copy") & (F.col("n") >= width)
    ends = F.concat(F.unhex(F.lit("00000000")), F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright("n", s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16, 24)))))
    return out.select(
        "doc_id", F.col("n").alias("n_words"), F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), F.when(whole, ends).otherwise(F.col("removed")).alias("removed"),
    )


def _placed(hashes: np.ndarray, words: Words) -> list[np.ndarray]:
    """Hashes that tell a word's place too, so that a sum over them tells a text."""
    place = np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)
    with np.errstate(over="ignore"):
        both = mix(hashes + mix(place.astype(np.uint64) + np.uint64(77)))
    return [both[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _places(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of what falls into it, in their order."""
    if not len(bucket):
        return
    at = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[at], return_index=True)
    for b, x in zip(found.tolist(), np.split(at, first[1:]), strict=True):
        yield int(b), x


def _packed(ids: np.ndarray, owner: np.ndarray, hashes: np.ndarray, count: np.ndarray) -> bytes:
    """Anchors with their owners (doc, key), each owner once, and numbers of documents."""
    some, place = np.unique(owner, return_inverse=True)
    return b"".join([np.int64(len(some)).tobytes(), ids[some].tobytes(), hashes.tobytes(), place.astype("<i4").tobytes(), count.astype("<i4").tobytes()])


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    at = 8 + 16 * n
    m = (len(body) - at) // 16
    owner = np.frombuffer(body, np.int64, 2 * n, 8).reshape(n, 2)
    return np.frombuffer(body, np.uint64, m, at), owner[np.frombuffer(body, "<i4", m, at + 8 * m)], np.frombuffer(body, "<i4", m, at + 12 * m)


def by_part(hashes: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """One block of confirmed anchors for each part of the documents (key modulo ``parts``)."""
    order = np.lexsort((ids[:, 1], ids[:, 0], ids[:, 1] % parts))
    hashes, ids = hashes[order], ids[order]
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(1)]) if len(ids) else np.zeros(0, np.int64)
    sizes, own = np.diff(np.r_[first, len(ids)]), ids[first]
    upto = np.r_[0, np.cumsum(sizes)]
    for part, x in _places(own[:, 1] % parts):
        a, b = int(x[0]), int(x[-1]) + 1  # neighbours, as they are sorted
        yield CONFIRMED, part, b"".join([np.int64(b - a).tobytes(), own[a:b].tobytes(), sizes[a:b].astype("<i4").tobytes(), hashes[upto[a] : upto[b]].tobytes()])


def _unparted(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    return np.frombuffer(body, np.int64, 2 * n, 8).reshape(n, 2), np.frombuffer(body, "<i4", n, 8 + 16 * n), np.frombuffer(body, np.uint64, -1, 8 + 20 * n)


def _blocks(rows) -> Iterator[pa.RecordBatch]:
    """Rows (kind, at, body) in batches of about BLOCK_BYTES."""
    some: list[tuple] = []
    size = 0
    for row in rows:
        some.append(row)
        size += len(row[2])
        if size > BLOCK_BYTES:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, at, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(body, pa.binary())], ["kind", "at", "body"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batch cut where (part, step) changes."""
    if not batch.num_rows:
        return
    key = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)], 1)
    cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield (int(key[a, 0]), int(key[a, 1])), batch.slice(a, b - a)
