"""Operator 3: cross-entropy difference of matched target and background n-gram models.

Both models are interpolated bigram models over one vocabulary, all words of the corpus.  The
background is the rest of the corpus, its counts weighed down to the target's number of tokens, so
that the two are matched in size.  A document's score is the mean over its tokens of the target's
loss minus the background's: the lower, the more like the target.  A document's own counts are left
out of the model that holds them, so none is scored by itself.

Words and pairs are counted exactly, each by a 64-bit identity, and nothing that grows with the
corpus is broadcast or collected:

1. Documents are gathered in chunks of about ``CHUNK_BYTES`` of text, one row each.
2. A chunk sends its different words and pairs with their counts, one block a bucket of identities.
3. A bucket sums them over all chunks and answers each block in its own order, so that answers need
   no identities.
4. A chunk meets its answers by its number, and its documents are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import named, small_batches, written
from .words import Words, mix, slices

#: Bytes of text of a chunk, about; a longer text is one by itself.
CHUNK_BYTES = 5 << 20
#: Identities of a bucket that are sorted at once, about.
RANGE = 1 << 18
#: Weight of the pair's part in a model.
SHARE = 0.6


def packed(counts: np.ndarray) -> bytes:
    """Counts of a byte each, and what is beyond a byte."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return low.tobytes() + counts[low == 255].astype("<i8").tobytes()


def unpacked(body: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n counts from byte ``at`` on, and where they end."""
    out = np.frombuffer(body, np.uint8, n, at).astype(np.int64)
    more = np.flatnonzero(out == 255)
    out[more] = np.frombuffer(body, "<i8", len(more), at + n)
    return out, at + n + 8 * len(more)


class Grams:
    """Words and pairs of some texts: ``word`` and ``pair`` give each token's place among the different
    identities, sorted by bucket and identity; ``pair`` is the token with the one before it, which
    exists where ``inner``.  ``bounds`` cuts the identities into buckets."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, parts: int):
        n = len(hashes)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.inner = np.ones(n, bool)
        self.inner[(np.cumsum(counts) - counts)[counts > 0]] = False
        at = np.flatnonzero(self.inner)
        with np.errstate(over="ignore"):
            pairs = mix(hashes[at - 1] * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[at] ^ np.uint64(0xB16))) | np.uint64(1)
        # an identity's last bit tells pairs from words
        both = np.concatenate([hashes & ~np.uint64(1), pairs])
        self.names, place = np.unique(both, return_inverse=True)
        bucket = ((self.names >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.names, place = self.names[order], rank[place]
        self.bounds = np.searchsorted(bucket[order], np.arange(parts + 1))
        self.word, self.pair = place[:n], np.zeros(n, np.int64)
        self.pair[at] = place[n:]

    def counts(self, in_target: np.ndarray) -> np.ndarray:
        """(target, rest) occurrences of each identity; ``in_target`` is by text."""
        mine = in_target[self.owner]
        out = np.zeros((2, len(self.names)), np.int64)
        for i, use in enumerate((mine, ~mine)):
            for place in (self.word[use], self.pair[use & self.inner]):
                out[i] += np.bincount(place, minlength=len(self.names))
        return out

    def own(self, place: np.ndarray, use: np.ndarray) -> np.ndarray:
        """How often each token's word or pair occurs in its own text; 0 where not ``use``."""
        out = np.zeros(len(place), np.int64)
        _, where, count = np.unique(self.owner[use] * np.int64(len(self.names)) + place[use], return_inverse=True, return_counts=True)
        out[use] = count[where]
        return out

    def losses(self, counts: np.ndarray, in_target: np.ndarray, totals: np.ndarray, vocabulary: int) -> list[np.ndarray]:
        """Each token's loss in bits under the target and under the background."""
        every = np.ones(len(self.word), bool)
        own_word, own_pair = self.own(self.word, every), self.own(self.pair, self.inner)
        before = np.r_[np.int64(0), np.arange(len(self.word) - 1)] if len(self.word) else self.word
        tokens = np.bincount(self.owner, minlength=len(in_target))[self.owner]
        matched = totals[0] / totals[1] if totals[1] else 1.0
        out = []
        for i, scale in enumerate((1.0, matched)):
            mine = (in_target if i == 0 else ~in_target)[self.owner]
            word = np.maximum(counts[i][self.word] - own_word * mine, 0)
            alone = (word * scale + 1) / (np.maximum(totals[i] - tokens * mine, 0) * scale + max(vocabulary, 1))
            left = np.where(self.inner & (scale > 0), word[before], 0)
            pair = np.maximum(counts[i][self.pair] - own_pair * mine, 0)
            known = left > 0
            out.append(-np.log2(np.where(known, SHARE * pair / np.maximum(left, 1) + (1 - SHARE) * alone, alone)))
        return out


def summed(names: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Each identity's whole counts in place of its parts, whose type has room for them; the number of words, and of their occurrences.

    It goes by ranges of identities of about RANGE entries, which bounds what sorting takes."""
    bits = np.uint64(max(1, int(len(names) // RANGE).bit_length()))
    words, tokens = 0, np.zeros(2, np.int64)
    mixed = (mix(names >> np.uint64(1)) >> (np.uint64(64) - bits)).astype(np.int32)
    for k in range(1 << int(bits)):
        at = np.flatnonzero(mixed == k)
        found, place = np.unique(names[at], return_inverse=True)
        single = (found & np.uint64(1)) == 0
        words += int(single.sum())
        for i in (0, 1):
            sums = np.bincount(place, weights=counts[i, at], minlength=len(found)).astype(counts.dtype)
            tokens[i] += sums[single].sum(dtype=np.int64)
            counts[i, at] = sums[place]
    return words, tokens


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of ``docs``; losses are
    means in bits a token, score is their difference.

    ``targets`` holds the ids (doc_id) of the target corpus.  A null or empty text has no tokens and
    null losses.  Rows with a null id are background.  Repeated rows count each.  Without targets all
    scores are 0; an empty table gives an empty result.
    """
    docs = named(docs, doc_id="doc_id", text="text").select("doc_id", F.col("text").cast("string"))
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = named(targets, t="doc_id").where("t is not null").distinct().withColumn("in_target", F.lit(True))
    flagged = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("t"), "left").select(F.spark_partition_id().alias("part"), F.coalesce("in_target", F.lit(False)).alias("in_target"), "doc_id", "text")

    def gathered(batches):
        """Rows (chunk, documents as an Arrow batch); a chunk's number holds its task's."""
        held: list[pa.RecordBatch] = []
        size = made = 0

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(held[0].column(0)[0].as_py() << 32) + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])

        for batch in batches:
            for piece in slices(batch, 3):
                held.append(piece)
                size += piece.nbytes
                if size >= CHUNK_BYTES:
                    yield done()
                    held, size, made = [], 0, made + 1
        if held:
            yield done()

    def opened(body: pa.Buffer) -> tuple[pa.Array, np.ndarray, np.ndarray, Grams]:
        """A chunk's ids, targets, numbers of words, and grams."""
        held, ids, in_target = [], [], []
        for batch in pa.ipc.open_stream(body):
            for piece in slices(batch, 3):
                held.append((words := Words(piece.column(3))).hashes(fold=True))
                ids.append(piece.column(2))
                in_target.append((np.asarray(piece.column(1)), words.counts))
        targets, counts = (np.concatenate(x) for x in zip(*in_target, strict=True))
        return pa.concat_arrays(ids), targets, counts, Grams(np.concatenate(held), counts, parts)

    def counted(batches):
        """Blocks (bucket, chunk, body): number of identities, identities, counts in target and rest."""
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, in_target, _, grams = opened(body.as_buffer())
                counts = grams.counts(in_target)
                cuts = list(zip(grams.bounds[:-1].tolist(), grams.bounds[1:].tolist(), strict=True))
                some = [i for i, (a, b) in enumerate(cuts) if a < b]
                bodies = [b"".join([np.int64(cuts[i][1] - cuts[i][0]).tobytes(), grams.names[slice(*cuts[i])].tobytes(), *(packed(c[slice(*cuts[i])]) for c in counts)]) for i in some]
                yield _rows(some, [chunk] * len(some), bodies)

    def answered(batches):
        """Blocks (bucket, chunk, body): counts over all chunks, in the order of the chunk's block; and
        with a null chunk, the bucket's number of words and of tokens in target and rest."""
        keys, names, counts = [], [], []
        for batch in batches:
            for bucket, chunk, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = int(np.frombuffer(body, np.int64, 1)[0])
                one, at = unpacked(body, 8 + 8 * n, n)
                both = np.stack([one, unpacked(body, at, n)[0]])
                keys.append((bucket, chunk, n))
                names.append(np.frombuffer(body, np.uint64, n, 8).copy())
                counts.append(both.astype(np.uint32) if both.max() < 1 << 32 else both)
        if not keys:
            return
        names, counts = np.concatenate(names), np.concatenate(counts, 1)
        if counts.sum(1, dtype=np.int64).max() >= 1 << 32:
            counts = counts.astype(np.int64)
        vocabulary, tokens = summed(names, counts)
        yield _rows([keys[0][0]], [None], [np.array([vocabulary, *tokens], np.int64).tobytes()])
        at = 0
        for bucket, chunk, n in keys:
            yield _rows([bucket], [chunk], [np.int64(n).tobytes() + packed(counts[0, at : at + n]) + packed(counts[1, at : at + n])])
            at += n

    def scored(batches):
        """Rows come sorted by chunk, its documents (bucket -1) first, then its answers by bucket."""
        now, answers = None, []

        def done():
            ids, in_target, counts, grams = opened(now)
            told = np.concatenate([*answers, np.zeros((2, 0), np.int64)], 1)
            if told.shape[1] != len(grams.names):
                raise RuntimeError(f"{told.shape[1]} answers for {len(grams.names)} words and pairs")
            means = []
            for loss in grams.losses(told, in_target, totals, vocabulary):
                means.append(np.diff(np.r_[0, np.cumsum(loss)][np.r_[0, np.cumsum(counts)]]) / np.maximum(counts, 1))
            columns = [pa.array(x, mask=counts == 0) for x in (*means, means[0] - means[1])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

        for batch in batches:
            for bucket, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = body.as_buffer()
                if bucket < 0:
                    if now:
                        yield from done()
                    now, answers = body, []
                    continue
                n = int(np.frombuffer(body, np.int64, 1)[0])
                one, at = unpacked(body, 8, n)
                answers.append(np.stack([one, unpacked(body, at, n)[0]]))
        if now:
            yield from done()

    kind = "bucket long, chunk long, body binary"
    chunks = written(flagged.mapInArrow(gathered, "chunk long, body binary"), "chunks")
    answers = written(chunks.mapInArrow(counted, kind).repartitionById(parts, F.col("bucket").cast("int")).mapInArrow(answered, kind), "answers")
    sums = np.zeros(3, np.int64)
    for r in answers.where("chunk is null").select("body").collect():  # a row a task
        sums += np.frombuffer(r.body, np.int64)
    vocabulary, totals = int(sums[0]), sums[1:].astype(float)
    both = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "body").union(answers.where("chunk is not null").select("chunk", "bucket", "body"))
    own = docs.schema["doc_id"].dataType.simpleString()
    return both.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(scored, f"doc_id {own}, n_tokens long, target_loss double, background_loss double, score double")


def _rows(bucket: list, chunk: list, body: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(body, pa.binary())], ["bucket", "chunk", "body"])
