import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from winnow.llm import prefix_trie as trie

COLUMNS = "conv_id long, turn long, role string, text string, key string, n string, depth string, own string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], COLUMNS)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1]) if node else 0
    return {
        (m[0], len(v), members[v[:-1]][0] if v else None, len(m), children[v], leaves[v], saved[v], hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(v)).encode()).hexdigest())
        for v, m in members.items()
    }


def rows():
    r = random.Random(5)
    texts = ["hi", "", None, "é漢🎉", "a:b", "1:user", "long " * 50]
    data = []
    for conv in [*range(40), *range(95, 130), 200, 201, 305, 399, 100_000, 100_001, 70_000]:
        data += [(conv, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(r.choice([1, 2, 3, 7, 9]))]
    data += [(7000 + i, t, "user", f"same {t}") for i in range(60) for t in range(9)]  # copies
    data += [(8000, t, "user", str(t)) for t in range(70)]  # a deep one
    return data + data[:5] + [(None, 0, "user", "nobody"), (450, 0, "user", "gone"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "assistant", "tie")]


@pytest.mark.parametrize(("held", "bits"), [(1 << 17, 16), (5, 2)])
def test_brute_force(spark, monkeypatch, held, bits):
    monkeypatch.setattr(trie, "HELD", held)
    monkeypatch.setattr(trie, "BLOCK_BITS", bits)
    data = rows()
    random.Random(1).shuffle(data)
    found = trie.prefix_trie(frame(spark, data).repartition(5)).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute(data)


def test_turnless_and_empty(spark):
    assert trie.prefix_trie(frame(spark, [])).collect() == []
    assert trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    lone = [c for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6 > 1][:2]  # all turns taken over, from none
    data = [(c, 0, "user", "x") for c in lone]
    assert {tuple(r) for r in trie.prefix_trie(frame(spark, data)).collect()} == brute(data)
