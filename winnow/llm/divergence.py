"""Operator 11: which sources of a language differ from each other, and by which terms.

Terms become integers.  Everything about a term of a language comes to one partition, sorted by the
term's UTF-8 bytes; the terms of enough documents form sorted arrays there, and a term's number is its
place in its array.  So numbers keep the order of the bytes, the counts of a source are a dense vector
over an array, and of equal values the smaller number is the smaller term.  Each chunk is at most
``CHUNK_ROWS`` counts or one term, so nothing grows with the corpus but the number of chunks; sums of
a language are joined to its chunks, broadcast only if they are counted to be few.

A share of a billion is ``1 + floor(10**9 * (count + 1) / (total + terms))``, and the divergence of
shares p from q is ``floor((p - q)**2 / q)``, in whole numbers throughout: 64 bits hold them for less
than 2**31 terms a language and 9 * 10**15 words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import named, small_batches, written
from .words import slices

#: What a task holds before it passes counts on: different (source, term), and bytes of text read.
HELD_TERMS, HELD_BYTES = 1 << 18, 1 << 27
#: Counts in a chunk; cells of a dense matrix; cells that a task sums before passing them on.
CHUNK_ROWS, CELLS, HELD_CELLS = 1 << 16, 1 << 20, 1 << 21
#: Groups of languages and sources whose sums are broadcast; with more of them it is a plain join.
FEW_GROUPS = 50_000

_table = bytearray(b" " * 256)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _table[_b] = _b | 32 if 65 <= _b <= 90 else _b
TABLE = bytes(_table)


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters a-z, A-Z and code points from U+0080, with A-Z lower-cased."""
    return text.translate(TABLE).split()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), summed for as long as they fit.  The empty term stands for the group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = read = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in held.items():
            names = [b"", *words]
            for at in range(0, len(names), 1 << 15):
                part = names[at : at + (1 << 15)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([words[x] for x in part], pa.int64()), pa.array([docs[x] for x in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part in slices(batch, 2):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                found = terms_of(text or b"")
                before = len(words)
                words.update(found)
                docs.update(set(found))
                size += len(words) - before + 1
                read += len(text or b"")
                if size > HELD_TERMS or read > HELD_BYTES:
                    yield from told()
                    held, size, read = {}, 0, 0
    yield from told()


def _chunks(least: int):
    """Sorted counts of (lang, term, source) as chunks: the kept terms in order and the counts by number."""

    def chunk(lang: str, rows: list[tuple[bytes, str, int, int]]) -> dict:
        terms = np.empty(len(rows), object)
        terms[:] = [r[0] for r in rows]
        sources, group = np.unique(np.array([r[1] for r in rows], object), return_inverse=True)
        n, docs = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        kept = terms[starts][(np.add.reduceat(docs, starts) >= least) & (terms[starts] != b"")]
        ids = np.searchsorted(kept, terms)
        known = ids < len(kept)
        known[known] = kept[ids[known]] == terms[known]
        ids, own, n = ids[known], group[known], n[known]
        sums = np.bincount(own, weights=n, minlength=len(sources)).astype(np.int64)
        return {"lang": lang, "terms": kept.tolist(), "sources": sources.tolist(), "sums": sums, "groups": own.astype(np.int32), "ids": ids.astype(np.int32), "counts": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lang: str, rows: list) -> pa.RecordBatch:
            x = chunk(lang, rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([x["lang"]], pa.string()), pa.array([x["terms"]], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([x["sources"]], pa.list_(pa.string())),
                 pa.array([x["sums"]], pa.list_(pa.int64())), pa.array([x["groups"]], pa.list_(pa.int32())), pa.array([x["ids"]], pa.list_(pa.int32())), pa.array([x["counts"]], pa.list_(pa.int64()))],
                names=["lang", "terms", "sources", "sums", "groups", "ids", "counts"])

        rows: list = []
        now = last = None
        for batch in batches:
            columns = [batch.column(0), batch.column(1).cast(pa.binary()), *batch.columns[2:]]
            for lang, term, source, n, docs in zip(*(c.to_pylist() for c in columns), strict=True):
                if rows and (lang != now or len(rows) >= CHUNK_ROWS and term != last):
                    yield out(now, rows)
                    rows = []
                now, last = lang, term
                rows.append((term, source, n, docs))
        if rows:
            yield out(now, rows)

    return run


def shares(counts: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / total), by long division with three digits a step."""
    rest, found = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digits
    return found + 1


def _scores(top: int):
    """Of each chunk: the divergence sums of source pairs, and each source's leading terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        leading: dict[tuple[str, str], list[tuple[int, str]]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for lang, (sources, sums) in pairs.items():
                    for i, a in enumerate(sources):
                        for b, value in zip(sources, sums[i].tolist(), strict=True):
                            if a != b:
                                yield lang, a, "pair", b, value
                for (lang, source), found in leading.items():
                    for value, term in sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]:
                        yield lang, source, "term", term, value

            buffer: list[tuple] = []
            for row in rows():
                buffer.append(row)
                if len(buffer) >= 1 << 15:
                    yield _scored(buffer)
                    buffer = []
            if buffer:
                yield _scored(buffer)
            pairs.clear()
            leading.clear()

        for batch in batches:
            for x in batch.to_pylist():
                size, names, totals = x["kept"], [g["source"] for g in x["all"]], np.array([g["n"] for g in x["all"]], np.int64)
                place = {s: i for i, s in enumerate(names)}
                row = np.array([place[s] for s in x["sources"]], np.int64)[np.array(x["groups"], np.int64)]
                ids, counts, terms = np.array(x["ids"], np.int64), np.array(x["counts"], np.int64), x["terms"]
                if x["lang"] not in pairs:
                    if sum(len(s) ** 2 for s, _ in pairs.values()) + len(names) ** 2 > HELD_CELLS:
                        yield from told()
                    pairs[x["lang"]] = names, np.zeros((len(names), len(names)), np.int64)
                sums, lang_total = pairs[x["lang"]][1], int(totals.sum())
                width = max(1, CELLS // len(names))
                for at in range(0, len(terms), width):
                    n = min(width, len(terms) - at)
                    here = (ids >= at) & (ids < at + n)
                    dense = np.bincount(row[here] * n + ids[here] - at, weights=counts[here], minlength=len(names) * n).astype(np.int64).reshape(len(names), n)
                    p, q = shares(dense, totals[:, None] + size), shares(dense.sum(0), lang_total + size)
                    for i in range(len(names)):
                        sums[i] += ((p[i] - p) ** 2 // p).sum(1)
                        more = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                        value = (p[i][more] - q[more]) ** 2 // q[more]
                        best = np.lexsort((more, -value))[:top]
                        found = leading.setdefault((x["lang"], names[i]), [])
                        found += [(int(value[j]), terms[at + int(more[j])]) for j in best]
                        if len(found) > 8 * top + 1000:
                            found[:] = sorted(found, key=lambda y: (-y[0], y[1].encode()))[:top]
                if sum(map(len, leading.values())) > HELD_CELLS:
                    yield from told()
        yield from told()

    return run


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for each language and source that occurs.

    Terms count if ``least`` documents of the language have them.  Part ``pair`` ranks the other sources
    of the language by the divergence from them over all such terms; part ``term`` ranks the terms that
    the source has more of than its language, the ``top`` first ones.  Of equal values the item smaller
    in UTF-8 comes first.  Null texts, languages and sources are empty strings; each row is a document,
    also if it repeats another; doc_id takes no part.  A source without terms still has its pairs, with 0
    in a language without kept terms.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = named(docs, lang="lang", source="source", text="text")
    counted = docs.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long")
    counted = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    ordered = counted.sortWithinPartitions("lang", "term", "source")
    chunks = written(ordered.mapInArrow(_chunks(least), "lang string, terms array<string>, sources array<string>, sums array<long>, groups array<int>, ids array<int>, counts array<long>"), "divergence_chunks")

    groups = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.sums").alias("n"))
    groups = written(groups, "divergence_groups")
    kept = chunks.groupBy(F.col("lang").alias("kept_lang")).agg(F.sum(F.size("terms").cast("long")).alias("kept"))
    told = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all"))
    facts = told.join(kept, F.col("lang") == F.col("kept_lang")).select(F.col("lang").alias("fact_lang"), "all", "kept")
    facts = F.broadcast(facts) if groups.count() <= FEW_GROUPS else facts

    with_facts = chunks.where(F.size("terms") > 0).join(facts, F.col("lang") == F.col("fact_lang")).drop("fact_lang")
    scored = written(with_facts.mapInArrow(_scores(top), "lang string, source string, part string, item string, value long"), "divergence_scores")

    by_value = (F.col("value").desc(), F.col("item"))
    one, other = told.select("lang", F.explode("all.source").alias("source"), F.col("all.source").alias("others")), F.explode("others").alias("item")
    every = one.select("lang", "source", other, F.lit(0).cast("long").alias("value")).where("item <> source")
    pairs = scored.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(every).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))
    # the leading terms of all tasks first meet in parts, so that no one has to rank those of all tasks
    terms = scored.where("part = 'term'").select("lang", "source", "item", "value", F.pmod(F.xxhash64("item"), F.lit(64)).alias("bucket"))
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "bucket").orderBy(*by_value))).where(F.col("rank") <= top).drop("rank", "bucket")
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).where(F.col("rank") <= top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
