import math
import random

import numpy as np
import pytest

from winnow.llm import knn
from winnow.llm.knn import top_products


def brute(rows, every, k):
    vecs = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vecs[i] = [math.floor(256 * x) for x in v]
    out = []
    for q in sorted(i for i in vecs if i % every == 0):
        score = sorted((-sum(a * b for a, b in zip(vecs[q], v, strict=False)), i) for i, v in vecs.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])]
    return out


@pytest.mark.parametrize(("pivots", "chunk"), [(3, 10), (64, 1 << 16)])
def test_against_brute_force(spark, monkeypatch, pivots, chunk):
    monkeypatch.setattr(knn, "PIVOTS", pivots)
    monkeypatch.setattr(knn, "MOST_PIVOTS", pivots)
    monkeypatch.setattr(knn, "GROUP", 7)
    monkeypatch.setattr(knn, "CHUNK", chunk)
    r = np.random.default_rng(0)
    center = r.normal(size=(5, 8))
    rows = [(i, [float(np.float32(x)) for x in center[i % 5] + 0.1 * r.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[4][1]) for i in range(60)]  # one very common vector
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8), (510, [0.5, 0.25]), (520, []), (4, rows[4][1])]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, cell int, vec int")
    found = sorted(map(tuple, top_products(frame, every=10, k=5).collect()))
    assert found == brute(rows, 10, 5)


def test_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert top_products(frame([])).collect() == []
    assert top_products(frame([(0, [1.0])])).collect() == []
    assert sorted(map(tuple, top_products(frame([(0, [1.0]), (20, [-1.0]), (3, [1.0])])).collect())) == [(0, 1, 3, 65536), (0, 2, 20, -65536), (20, 1, 0, -65536), (20, 2, 3, -65536)]


@pytest.mark.parametrize("block", [4096, 7])
def test_large_scores(spark, monkeypatch, block):
    """Scores near 64 bits are exact, and so are those of vectors with longer products."""
    monkeypatch.setattr(knn, "BLOCK", block)
    r = random.Random(6)
    rows = [(i, [float(r.randrange(-(1 << 20), 1 << 20)) for _ in range(4)]) for i in range(80)]
    rows += [(80, [2.0**23, 1.0]), (81, [2.0**22 + 0.5, -3.0]), (82, [0.0, 0.0, 0.0, 0.0, 1e300]), (83, [0.0]), (84, [-0.001]), (85, [-(2.0**23) - 0.25, 3.0]), (86, [0.0, 2.0**23 + 8]), (90, [-1.0, 2.0**23]), (80, [2.0**23, 1.0])]
    found = sorted(map(tuple, top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=5).collect()))
    assert found == brute(rows, 10, 5)
    assert max(abs(x[3]) for x in found) > 1 << 55


def test_the_best_is_a_long_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0**23, 0.0]), (2, [0.5, 1.0])]
    found = sorted(map(tuple, top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=5).collect()))
    assert found == [(0, 1, 1, 549755813888), (0, 2, 2, 32768)]


@pytest.mark.parametrize("sign", [1, -1])
def test_scores_that_no_long_holds(spark, sign):
    rows = [(0, [1e300]), (1, [sign * 1e300])]
    with pytest.raises(Exception, match="64 bits"):
        top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=5).collect()


def test_best_of_any_size():
    score = np.array([[5, 9, 9, 1, 9], [-(1 << 62), 1 << 62, 3, 1 << 62, 0]])
    assert sorted(knn._best(score[:1], 2)[0]) == [1, 2] and sorted(knn._best(score[1:], 3)[0]) == [1, 2, 3]
    assert sorted(knn._best(score[1:], 1)[0]) == [1]
