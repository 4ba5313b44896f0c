import hashlib
import random

import numpy as np
import pytest

from winnow.llm import substrings
from winnow.llm.fmindex import FMIndex, least
from winnow.llm.substrings import remove_repeats

from .helpers import frame, prose, words


def brute(rows, width):
    first: dict = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            if d is not None:
                g = tuple(w[i : i + width])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - width + 1) if d is not None and first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(docs, width=13):
    return sorted((tuple(r)[:4] for r in remove_repeats(docs, width).collect()), key=str)


def test_odd_texts(spark):
    docs = frame(spark)
    assert rows_of(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


@pytest.mark.parametrize("hot", [False, True])
def test_common_passages(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substrings, "HOT_LEAST", 5)
    r = random.Random(2)
    passages = [prose(50 + i, r.randint(10, 30)) for i in range(4)]
    texts = []
    for i in range(80):
        parts = [prose(1000 + i, r.randint(0, 25))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(passages).split(" ")
            a = r.randrange(len(w))
            parts += [" ".join(w[a:] if r.random() < 0.3 else w), prose(r.randrange(10**6), r.randint(0, 9))]
        texts.append(" ".join(parts))
    texts += texts[:10]
    docs = frame(spark, texts)
    expected = brute(list(enumerate(texts)), 13)
    assert sum(x[2] for x in expected) > 500
    assert rows_of(docs) == expected


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("order", ["last", "falling", "random"])
def test_ids_in_any_order(spark, parts, order):
    r = random.Random(8)
    passage = prose(70, 50)
    texts = [f"{prose(2000 + i, 20)} {passage} {prose(3000 + i, 9)}" for i in range(60)]
    texts += texts[20:24]  # exact copies
    rows = list(enumerate(texts))
    r.shuffle(rows)
    if order == "last":  # the smallest come last
        rows.sort(key=lambda x: x[0] < 3)
    elif order == "falling":
        rows.sort(reverse=True)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    expected = brute(rows, 13)
    assert sum(x[2] for x in expected) >= 59 * 50
    assert rows_of(docs) == expected


def test_blocks_do_not_grow_with_documents():
    """A bucket's confirmed anchors are one block for each part of the documents."""
    r = np.random.default_rng(3)
    for n in (100, 10_000):
        ids = np.stack([r.integers(0, n, 4 * n), np.zeros(4 * n, np.int64)], 1)
        ids[:, 1] = ids[:, 0] * 31 - 5
        hashes = r.integers(0, 1 << 60, 4 * n).astype(np.uint64)
        found = list(substrings.by_part(hashes, ids, 16))
        assert len(found) == 16
        told = [(part, *doc, h) for _, part, body in found for own, sizes, flat in [substrings._unparted(body)] for doc, some in zip(own.tolist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True) for h in some.tolist()]
        assert sorted(told) == sorted((int(k % 16), int(d), int(k), int(h)) for (d, k), h in zip(ids, hashes, strict=True))


def test_removed_places(spark):
    found = remove_repeats(frame(spark, [prose(1, 40), prose(2, 5) + " " + prose(1, 20) + " " + prose(3, 4)])).collect()
    cut = next(r for r in found if r.doc_id == 1)
    assert np.frombuffer(cut.removed, "<i4").tolist() == [5, 25] and cut.n_removed == 20


def test_empty_table(spark):
    assert rows_of(frame(spark, [])) == []


def test_index_finds_all_occurrences():
    r = np.random.default_rng(5)
    text = r.integers(1, 4, 300)
    text[[60, 130, 299]] = 0
    index = FMIndex(text, 4)
    ends = np.flatnonzero(text) + 1
    length, low, high = index.matches(text, ends, 4)
    for e, n, a, b in zip(ends, length, low, high, strict=True):
        pattern = text[e - n : e]
        places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]
        assert sorted(index.suffixes[a:b]) == places
    whole = length == 4
    assert (least(index.suffixes, low[whole], high[whole]) == [index.suffixes[a:b].min() for a, b in zip(low[whole], high[whole], strict=True)]).all()
