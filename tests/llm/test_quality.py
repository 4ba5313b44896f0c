import math
import re
from collections import Counter

import numpy as np
import pytest

from winnow.llm import quality
from winnow.llm.quality import quality_rules

from .helpers import frame, prose, words


def base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics(spark):
    docs = frame(spark)
    found = quality_rules(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == docs.count()
    for r in found:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_verdicts(spark):
    clean = [prose(i, 60 + i) for i in range(150)]
    junk = [" ".join(x + "$$$" for x in words(prose(900 + i, 60))) for i in range(12)] + [prose(800 + i, 60).upper().replace(" ", "!! ") for i in range(12)]
    found = {r.doc_id: r.kept for r in quality_rules(frame(spark, clean + junk)).collect()}
    assert all(found[i] for i in range(150))
    assert not any(found[150 + i] for i in range(24))


def test_empty_table(spark):
    assert quality_rules(frame(spark, [])).collect() == []


def plain_em(patterns, names, least):
    """The mixture by plain loops: (log likelihood, chance of being good by votes)."""
    classes, chances, before, total = range(len(quality.KINDS) + 1), {}, None, 0.0
    for votes, _ in patterns:
        bad = [sum(v < 0 for k, v in zip(names, votes) if k in kind) for kind in quality.KINDS]
        bad = [x if x >= least else 0 for x in bad]
        chances[votes] = [1.0 if not any(bad) else 0.0, *(x / max(1, sum(bad)) for x in bad)]
    for _ in range(300):
        size, ones, zeros = [1.0 for _ in classes], [[1.0] * len(names) for _ in classes], [[1.0] * len(names) for _ in classes]
        for votes, n in patterns:
            for c in classes:
                size[c] += n * chances[votes][c]
                for k, v in enumerate(votes):
                    if v:
                        (ones if v < 0 else zeros)[c][k] += n * chances[votes][c]
        now, total = [x for c in classes for x in (size[c] / sum(size), *(a / (a + b) for a, b in zip(ones[c], zeros[c])))], 0.0
        for votes, n in patterns:
            like = []
            for c in classes:
                p = size[c] / sum(size)
                for a, b, v in zip(ones[c], zeros[c], votes):
                    p *= (a / (a + b) if v < 0 else b / (a + b)) if v else 1.0
                like.append(p)
            chances[votes] = [x / sum(like) for x in like]
            total += n * math.log(sum(like))
        if before and max(abs(x - y) for x, y in zip(now, before)) < 1e-7:
            break
        before = now
    return total, {votes: p[0] for votes, p in chances.items()}


def voted(seed, rows):
    names = list(quality.rules())
    r = np.random.default_rng(seed)
    kind = r.choice(4, rows, p=[0.8, 0.1, 0.06, 0.04])
    chance = np.full((4, len(names)), 0.03)
    for c, rules in enumerate(quality.KINDS):
        chance[c + 1, [names.index(k) for k in rules]] = 0.85
    return names, kind, np.where(r.random((rows, len(names))) < 0.15, 0, np.where(r.random((rows, len(names))) < chance[kind], -1, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_estimates_against_plain_loops(spark, seed):
    names, _, votes = voted(seed, 250)
    docs = spark.createDataFrame(votes.tolist(), ", ".join(f"{k} int" for k in names))
    patterns = list(Counter(map(tuple, votes.tolist())).items())
    found, n = quality.vote_counts(docs, names)
    assert sorted(zip(map(tuple, found.tolist()), n)) == sorted(patterns)
    expected = max((plain_em(patterns, names, least) for least in (1, 2)), key=lambda x: x[0])[1]
    for r in docs.distinct().withColumn("p", quality.posterior(quality.estimate(found, n, names), names)).collect():
        assert r.p == pytest.approx(expected[tuple(r)[:-1]], abs=1e-6)


def test_recovers_the_classes():
    names, kind, votes = voted(3, 8000)
    rows, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(rows, n.astype(float), names)
    assert model[0][0] == pytest.approx(0.8, abs=0.02) and all(x == pytest.approx(0.03, abs=0.02) for x in model[0][1].values())
    for c, rules in enumerate(quality.KINDS):
        assert all(model[c + 1][1][k] == pytest.approx(0.85, abs=0.06) for k in rules)
