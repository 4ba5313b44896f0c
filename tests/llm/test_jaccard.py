import random

import numpy as np
import pytest

from winnow.llm import jaccard
from winnow.llm.jaccard import Skipper, classes, jaccard_components, signatures

from .helpers import frame, words


def sets(text, n):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    parent = list(range(len(rows)))
    s = [sets(t, n) for _, t in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(s[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_odd_texts(spark, n, percent):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, jaccard_components(docs, n=n, percent=percent).collect()), key=str) == brute(rows, n, percent)


def test_near_copies_in_chunks(spark, monkeypatch):
    r = random.Random(4)
    base = [str(r.random()) for _ in range(60)]
    texts = []
    for _ in range(120):
        x = list(base)
        for _ in range(r.randint(0, 3)):
            x[r.randrange(60)] = str(r.random())
        texts.append(" ".join(x[: r.randint(54, 60)]))
    docs = frame(spark, texts)
    expected = brute(list(enumerate(texts)), 3, 90)
    assert 3 < len({x[2] for x in expected}) < 110
    assert sorted(map(tuple, jaccard_components(docs, n=3, percent=90).collect()), key=str) == expected
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 8000)
    assert sorted(map(tuple, jaccard_components(docs, n=3, percent=90).collect()), key=str) == expected


def test_empty_table(spark):
    assert jaccard_components(frame(spark, []), n=3, percent=90).collect() == []


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    r = np.random.default_rng(1)
    lows = classes(percent, 10**6)
    for _ in range(300):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 1 << 60, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, n // 8) + 1))
        y = np.unique(np.r_[x[drop:], r.integers(0, 1 << 60, int(r.integers(0, max(1, n // 8) + 1))).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if len(y) and both and 100 * both >= percent * (len(x) + len(y) - both):
            for common in (0, 3):  # without and with a third of the universe left out
                rest = [v[v % np.uint64(3) > 0] if common else v for v in (x, y)]
                assert np.intersect1d(signatures(rest[0], len(x), percent, lows), signatures(rest[1], len(y), percent, lows)).size


@pytest.mark.parametrize("percent", [80, 90])
def test_what_sets_lack_links_nothing(percent):
    """Different sets with few elements that are not very common have signatures of their own."""
    r = np.random.default_rng(3)
    lows = classes(percent, 10**6)
    owners: dict[int, set[int]] = {}
    for i in range(400):
        x = np.unique(r.integers(0, 1 << 60, int(r.integers(15, 300))).astype(np.uint64))
        rest = x[: len(x) * (i % 3) // 2]  # none, half or all of it
        for s in np.unique(signatures(rest, len(x), percent, lows, x)).tolist():
            owners.setdefault(s, set()).add(i)
    assert len({i for some in owners.values() if len(some) > 1 for i in some}) <= 40  # 267 and 134 when empty parts signed


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature_of_whole_sets(percent):
    r = np.random.default_rng(4)
    lows = classes(percent, 10**6)
    seen = 0
    for _ in range(600):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 1 << 60, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, n // 8) + 1))
        y = np.unique(np.r_[x[drop:], r.integers(0, 1 << 60, int(r.integers(0, max(1, n // 8) + 1))).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if len(y) and both and 100 * both >= percent * (len(x) + len(y) - both):
            for share in range(8):  # sevenths of the universe that stay
                rest = [v[v % np.uint64(7) < share] for v in (x, y)]
                assert np.intersect1d(signatures(rest[0], len(x), percent, lows, x), signatures(rest[1], len(y), percent, lows, y)).size
                seen += 1
    assert seen > 800


def test_shared_passages_link_little():
    """A part of one element is the same in all texts with a passage: a ring of texts that each share
    one with the next is no family."""
    r = np.random.default_rng(5)
    lows = classes(80, 10**6)
    passages = [r.integers(0, 1 << 60, 12).astype(np.uint64) for _ in range(300)]
    owners: dict[int, set[int]] = {}
    for i in range(300):
        own = r.integers(0, 1 << 60, int(r.integers(200, 400))).astype(np.uint64)
        x = np.unique(np.r_[own, passages[i], passages[i - 1]])
        for s in np.unique(signatures(x, len(x), 80, lows, x)).tolist():
            owners.setdefault(s, set()).add(i)
    assert sum(len(some) > 1 for some in owners.values()) <= 30  # hundreds when these parts signed


@pytest.mark.parametrize("percent", [79, 80, 90])
def test_linked_sets_at_the_bound_share_a_signature(percent):
    """Of sets as different as the bound allows, both ways, with and without common elements left out."""
    r = np.random.default_rng(6)
    lows = classes(percent, 10**6)
    for _ in range(600):
        n = int(r.integers(2, 400))
        x = np.unique(r.integers(0, 1 << 60, n).astype(np.uint64))
        n = len(x)
        swaps = bool(r.integers(2))  # elements exchanged, or only dropped
        drop = n * (100 - percent) // (100 + percent) if swaps else n * (100 - percent) // 100
        y = np.unique(np.r_[x[r.permutation(n)[drop:]], r.integers(0, 1 << 60, drop if swaps else 0).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        assert 100 * both >= percent * (n + len(y) - both)
        for share in (7, 6, 5, 3, 1):
            rest = [v[v % np.uint64(7) < share] for v in (x, y)]
            assert np.intersect1d(signatures(rest[0], n, percent, lows, x), signatures(rest[1], len(y), percent, lows, y)).size


def test_skipping_and_derived_answers_are_exact():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 1 << 40, 150).astype(np.uint64))
    family = []
    for _ in range(80):
        cut = int(r.integers(0, 6))
        keep = base[np.sort(r.permutation(len(base))[cut:])]
        family.append(np.unique(np.r_[keep, r.integers(0, 1 << 40, int(r.integers(0, 6))).astype(np.uint64)]))
    family += [base[:60], base[40:], base[:145]]
    join = Skipper(family, 90)
    for x in range(len(family)):
        row, dead = join.overlaps(x)
        for y in range(len(family)):
            both = len(np.intersect1d(family[x], family[y]))
            linked = 100 * both >= 90 * (len(family[x]) + len(family[y]) - both)
            assert (bool(row[y] * 190 >= 90 * (len(family[x]) + len(family[y]))) and not dead[y]) == linked
    assert join.derived and join.skipped
