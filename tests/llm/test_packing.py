import zlib

import numpy as np
import pytest

from winnow.llm.packing import hilbert, pack
from winnow.llm.queries import tokenizer_path
from winnow.llm.tokens import encoder

from .helpers import frame


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_ids_agree_with_the_tokenizer():
    import random

    r, e = random.Random(1), encoder(tokenizer_path())
    assert e.fast is not None
    for _ in range(3000):
        text = "".join(r.choice("ab A1. \n\t  é漢'  !<|>\x1c\x85s") for _ in range(r.randint(0, 40)))
        assert e.encode(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces(spark):
    docs = frame(spark)
    found = pack(docs, tokenizer_path(), length=64).collect()
    e = encoder(tokenizer_path())
    ids = {r.doc_id: [*np.frombuffer(e.encode(r.text or ""), "<u4").tolist(), 0] for r in docs.collect()}
    sequences: dict = {}
    count: dict = {}
    for r in found:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i in range(r.start, r.start + r.length):
            count[r.doc_id, i] = count.get((r.doc_id, i), 0) + 1
    for d, x in ids.items():
        assert all(count[d, i] == (2 if d == 3 else 1) for i in range(len(x)))  # document 3 comes twice
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert sorted(map(str, found)) == sorted(map(str, pack(docs, tokenizer_path(), length=64).collect()))


def test_empty_table(spark):
    assert pack(frame(spark, []), tokenizer_path()).collect() == []
