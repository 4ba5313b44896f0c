import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from winnow.llm.tables import written

from .helpers import frame, prose, words
from .test_jaccard import brute as near_copies
from .test_pii import brute as spans


def rows_of(df):
    return sorted(map(tuple, df.select(*P.COLUMNS).collect()), key=str)


def least_rows(rows):
    """Of each component of near copies the row with the least id, null last, and then the least values."""
    worded = [r for r in rows if words(r[1])]
    roots = {i: c for i, _, c in near_copies([(i, r[1]) for i, r in enumerate(worded)], 5, 80)}
    best: dict = {}
    for i, r in enumerate(worded):
        key = (r[0] is None, r[0] or 0)
        if roots[i] not in best or key < best[roots[i]][0]:
            best[roots[i]] = key, r
    return [r for _, r in best.values()] + [r for r in rows if not words(r[1])]


def test_near_copies_under_repeated_ids(spark):
    a, b, c = prose(11, 60), prose(12, 60), prose(13, 60)
    for rows, want in (
        ([(1, a), (2, a), (2, b)], [(1, a), (2, b)]), ([(5, a), (5, b)], [(5, a), (5, b)]), ([(5, a), (5, a)], [(5, a)]), ([(None, a), (7, a + " x"), (None, c)], [(7, a + " x"), (None, c)]),
        ([(3, None), (3, None), (4, " ")], [(3, None), (3, None), (4, " ")]), ([(3, b), (2, b + " y"), (2, c), (1, c)], [(2, b + " y"), (1, c)]),
    ):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        found = P.jaccard_stage(spark, docs, "").collect()
        assert sorted([(r.doc_id, r.text) for r in found], key=str) == sorted(want, key=str)


def test_stage_names():
    assert [name for name, _ in P.STAGES] == ["quality_rules", "jaccard_join", "pii", "mixing", "packing"]


def test_stages_on_odd_texts(spark):
    docs, kept = frame(spark), {}
    for name, stage in P.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, "")
        if name == "packing":
            break
        assert out.columns == list(P.COLUMNS) and [f.dataType for f in out.schema] == [docs.schema[c].dataType for c in P.COLUMNS]
        after = rows_of(out)
        kept[name] = {r[0] for r in after}
        if name == "quality_rules":
            assert set(after) <= set(before)
            assert all(len(words(r[1])) >= 20 for r in after if r[0] is not None)
        if name == "jaccard_join":
            assert after == sorted(least_rows(before), key=str)
        if name == "pii":
            assert [r[0] for r in after] == [r[0] for r in before]
            assert not any(spans(r[1] or "") for r in after) and all(r[4] == len(r[1]) for r in after if r[1] is not None)
        if name == "mixing":
            assert set(after) <= set(before)
        docs = written(out, name)
    ids = {r[0]: sum(r[0] == x[0] for x in before) for r in before}
    pieces = out.collect()
    total: dict = {}
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {d: ids[d] * next(r.doc_tokens for r in pieces if r.doc_id == d) for d in ids}


@pytest.mark.parametrize("at", range(4))
def test_rows_without_id_and_empty_tables(spark, at):
    stage = P.STAGES[at][1]
    assert stage(spark, frame(spark, []), "").count() == 0
    texts = [prose(i, 60) for i in range(6)]
    docs = frame(spark, texts).selectExpr("CAST(NULLIF(NULLIF(doc_id, 1), 2) AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars", "key")
    out = rows_of(stage(spark, docs, ""))
    if at < 3:
        assert sorted(r[1] for r in out) == sorted(texts)


def test_run(spark, tmp_path):
    rows = [prose(i, 40 + i % 30) for i in range(60)]
    rows += [rows[0], rows[1] + " tail", "$$$ ### " * 60]
    frame(spark, rows).select(*P.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    found = P.run(spark, str(tmp_path)).collect()
    assert {60, 61, 62}.isdisjoint(r.doc_id for r in found) and len({r.doc_id for r in found}) > 10
