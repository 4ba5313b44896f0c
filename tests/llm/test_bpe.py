import hashlib
import random

import pytest

from winnow.llm.bpe import Bpe, decode_ids, digests, encode_texts
from winnow.llm.queries import tokenizer_path

from .helpers import frame, odd_texts


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Bpe(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


def same(both, text):
    own, library = both
    ids = own.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, text[:80]
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(both):
    for text in odd_texts():
        same(both, text or "")
    for text in ("<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext|", " <|endoftext|>  <|endoftext|> ", "it's WE'LL 'S '' 'sx", "a\x00b\x1c\x1d \x85\xa0  　x", "\r\n\r\n  \n x  "):
        same(both, text)


def test_every_code_point(both):
    codes = [*range(0xD800), *range(0xE000, 0x14000), *range(0x14000, 0x110000, 61)]  # each of the planes in use, then some
    for start in range(0, len(codes), 1024):
        same(both, "".join(f"a{chr(c)}1{chr(c)} " for c in codes[start : start + 1024]))
    own = both[0]
    for text in ("".join(f"a{c}{c}1{c} {c}x_ " for c in map(chr, range(start, start + 1024))) for start in range(0, 0xD800, 1024)):
        text = "".join(c for c in text if c not in own.odd)
        assert own.plain_text.findall(text) == own.any_text.findall(text)


def test_random_texts_and_long_runs(both):
    r = random.Random(3)
    for alphabet in ("ab", "abc ", "the an is", "0123456789", "éüñ ß", "=-_* ", "漢字かな", "aaab\n ", "🎉👍 x"):
        for n in (1, 2, 3, 5, 9, 30, 200, 4000):
            same(both, "".join(r.choice(alphabet) for _ in range(n)))
    words = list(both[1].get_vocab())
    for _ in range(200):  # joints of tokens, where merges cross
        same(both, "".join(w for w in r.sample(words, 6)).replace("Ġ", " "))
    for text in ("a" * 20_000, " " * 20_000, "ab" * 10_000, "=" * 20_001, "\n" * 5000):
        same(both, text)


def test_broken_bytes(both):
    own, library = both
    for ids in ([107], [164, 96], [107, 107, 50256, 198], [26825, 107]):
        assert own.decode(b"".join(i.to_bytes(4, "little") for i in ids)) == library.decode(ids, skip_special_tokens=False)


def test_query_by_the_library(spark, both):
    docs = frame(spark)
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(decode_ids(encode_texts(docs, tokenizer_path()), tokenizer_path())).collect()}
    want = set()
    for r in docs.collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        said = both[1].decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert rows == want
    assert encode_texts(frame(spark, []), tokenizer_path()).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        Bpe(public_tokenizers.path("word_bpe_49k.json"))
