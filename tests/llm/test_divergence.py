import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import types as T

from winnow.llm import divergence
from winnow.llm.divergence import shares, source_divergence, terms_of

from .helpers import odd_texts, prose

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "source", "term", "n", "item", "value", "part", "rank", "kept")] + [T.StructField("doc_id", T.LongType())])


def brute(rows, top=200):
    rows = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in own for t in set(r[2]))
        kept = sorted((t for t in docs if docs[t] >= 3), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if docs[t] >= 3)
        whole = sum(counts.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        p_of = {s: {t: p(c, t) for t in kept} for s, c in counts.items()}
        q_of = {t: p(whole, t) for t in kept}
        for s in counts:
            pairs = [(o, sum((p_of[s][t] - p_of[o][t]) ** 2 // p_of[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p_of[s][t] - q_of[t]) ** 2 // q_of[t]) for t in kept if counts[s][t] > 0 and p_of[s][t] > q_of[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7, i) for i, r in enumerate(rows)], SCHEMA)


def rows():
    texts = odd_texts()
    data = [(t, ["en", "de", None, "xx"][i % 4], ["a", "é", None, "🎉", "b", ""][i % 6]) for i, t in enumerate(texts)]
    data += [(prose(s, 40) + " É é Ünder_score's A1b2 \x00nul ﬁ Ω", ["en", "de"][s % 2], ["a", "b", "c", "ü", "￮", "🎉"][s % 6]) for s in range(30)]
    return data + data[:6] + [("only here", "zz", "a"), ("other words", "zz", "b"), ("", "zz", None), ("tie one tie", "t", "a"), ("tie one two", "t", "b"), ("two one tie two", "t", "c")]


def test_terms():
    assert terms_of("It's A_b2C É\x7fx\u0085y".encode()) == [x.encode() for x in ("it", "s", "a", "b", "c", "É", "x\u0085y")]


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 999_999_999_999, 8_999_999_999_999_998], np.int64)
    for total in (8_999_999_999_999_999, 9_000_000_000_000_000):
        assert shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


@pytest.mark.parametrize(("chunk", "cells", "held"), [(1 << 16, 1 << 20, 1 << 18), (7, 20, 50)])
def test_brute_force(spark, monkeypatch, chunk, cells, held):
    monkeypatch.setattr(divergence, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    data = rows()
    for top in (200, 3):
        found = source_divergence(frame(spark, data).repartition(3), top=top).collect()
        assert len(found) == len(set(found))
        assert {tuple(r) for r in found} == brute(data, top)


def test_joined_sums(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEW_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD_CELLS", 10)
    data = rows()
    assert {tuple(r) for r in source_divergence(frame(spark, data)).collect()} == brute(data)


def test_empty_and_single(spark):
    assert source_divergence(frame(spark, [])).collect() == []
    assert source_divergence(frame(spark, [(None, None, None)])).collect() == []
    found = {tuple(r) for r in source_divergence(frame(spark, list(product([None, "x"], [None], ["a", "b"])))).collect()}
    assert found == {("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)}
