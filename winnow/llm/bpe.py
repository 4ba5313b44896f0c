"""Operator 13: byte-pair encoding and decoding by dynamic programming over prefixes.

For each prefix of a piece of text there is exactly one last token that its encoding can have.  An
automaton over the vocabulary gives, at each position, the tokens that are suffixes of the prefix; of
these the one is right that begins the piece or is compatible with the last token of the prefix before
it.  Two tokens are compatible if merging their joint bytes would give just these two, which a walk
down the right edge of the one and the left edge of the other tells.  Following the last tokens back
from the end gives the ids.  A piece of n bytes takes n steps, however long it is.

Pieces are what the tokenizer file's own splitter cuts; most are words that come again, and a bounded
table keeps their ids.  Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import named, small_batches
from .tokens import PATTERN, byte_signs
from .words import slices

#: Entries of the two tables that a process keeps, and the longest piece in them; they only save time.
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 1 << 18, 1 << 20, 64
NEVER = 1 << 40


def _other_letters(tokenizer) -> tuple[str, str]:
    """Code points that the regex library, but not the tokenizer, takes for letters and for numbers.

    Tables of different Unicode versions differ in code points given out between them.  Only those that
    Python's own older table doesn't have yet can be such; the tokenizer's splitter is asked about each.
    """
    import regex

    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    wrong = []
    for kind, like in (("L", "a"), ("N", "1")):
        new = (c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c) == "Cn")
        wrong.append("".join(c for c in new if len(tokenizer.pre_tokenizer.pre_tokenize_str(like + c)) > 1))
    return wrong[0], wrong[1]


def _ranges(signs: str) -> str:
    """A character class of the code points, as ranges."""
    codes = np.unique(np.array([ord(c) for c in signs], np.int64))
    parts = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return "".join(rf"\U{p[0]:08x}-\U{p[-1]:08x}" for p in parts if len(p))


class Bpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split, decoder = told["model"], told.get("pre_tokenizer") or {}, told.get("decoder") or {}
        if (
            model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or decoder.get("type") != "ByteLevel"
            or told.get("normalizer") or model.get("dropout") or model.get("ignore_merges")
            or any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in told["added_tokens"])
        ):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        signs, vocab = byte_signs(), model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for word, i in vocab.items():
            self.bytes[i] = bytes(signs[c] for c in word) if word not in self.special else word.encode()
        for word, i in self.special.items():
            self.bytes[i] = word.encode()

        # each token is one byte or is made by one merge of two earlier ones
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.made[whole] >= 0 or max(self.made[a], self.made[b]) >= rank:
                raise ValueError(f"{path}: merges don't make each token once, from earlier ones")
            self.rank[a << 32 | b] = rank
            self.left[whole], self.right[whole], self.made[whole] = a, b, rank
        self.fitting: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

        self.automaton = ahocorasick.Automaton()
        whole = [False] * size
        ordered = sorted((i for word, i in vocab.items() if word not in self.special), key=lambda i: self.made[i])
        for i in ordered:  # a token that its own bytes don't give can be in no encoding
            a, b = self.left[i], self.right[i]
            whole[i] = a < 0 or whole[a] and whole[b] and not self._crossed(a, b, top=False)
            if whole[i]:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()

        letters, numbers = _other_letters(Tokenizer.from_file(path))
        letter = rf"[\p{{L}}--[{_ranges(letters)}]]" if letters else r"\p{L}"
        number = rf"[\p{{N}}--[{_ranges(numbers)}]]" if numbers else r"\p{N}"
        exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^ES]").replace(r"\p{L}", letter).replace(r"\p{N}", number).replace("[^ES]", rf"[^\s{letter}{number}]")
        self.any_text = regex.compile("(?V1)" + exact)
        # the faster library's classes give the same pieces for texts without the code points that it sees otherwise
        self.plain_text = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        odd: set[str] = set()
        for ours, theirs in ((letter, r"[^\W\d_]"), (number, r"\d"), (r"\s", r"\s")):
            odd |= set(regex.findall("(?V1)" + ours, every)) ^ set(re.findall(theirs, every))
        self.odd = frozenset(odd)
        self.apart = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _crossed(self, a: int, b: int, top: bool = True) -> bool:
        """Whether merging would at some time join the end of token a and the start of token b.

        The pieces at the border are undone from last made to first.  Two pieces that are there together
        get joined if their rank comes before what the left one next goes into, and not after what the
        right one does: of equal pairs the left one is merged first.
        """
        rank, made = self.rank, self.made
        next_a = next_b = NEVER
        while True:
            if top:
                r = rank.get(a << 32 | b, NEVER)
                if r < next_a and r <= next_b and r < NEVER:
                    return True
            top = True
            if made[a] > made[b]:
                next_a, a = made[a], self.right[a]
            elif made[b] >= 0:
                next_b, b = made[b], self.left[b]
            else:
                return False

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.fitting.get(key)
        if found is None:
            if len(self.fitting) >= KEPT_PAIRS:
                self.fitting.clear()
            found = self.fitting[key] = not self._crossed(a, b)
        return found

    def piece(self, text: str) -> bytes:
        """The ids of one piece."""
        signs = text.encode().decode("latin-1")
        last = [-1] * len(signs)
        for end, (token, length) in self.automaton.iter(signs):
            if last[end] < 0:
                before = end - length
                if before < 0 or last[before] >= 0 and self._fits(last[before], token):
                    last[end] = token
        found, at = [], len(signs) - 1
        while at >= 0:
            found.append(last[at])
            at -= len(self.bytes[last[at]])
        return np.array(found[::-1], "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        words = (self.plain_text if self.odd.isdisjoint(text) else self.any_text).findall(text)
        ids = list(map(self.words.get, words))
        if None in ids:
            for i, known in enumerate(ids):
                if known is None:
                    word = words[i]
                    ids[i] = self.words.get(word) or self.piece(word)
                    if len(word) <= KEPT_LENGTH:
                        if len(self.words) >= KEPT_WORDS:
                            self.words.clear()
                        self.words[word] = ids[i]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text; strings of special tokens in it are these tokens."""
        if self.apart is None or not self.apart.search(text):
            return self._part(text)
        parts = self.apart.split(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if i % 2 else self._part(x) for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def bpe(path: str) -> Bpe:
    """One for each process."""
    return Bpe(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of every whole text, packed; null texts are empty.

    Rows are taken one by one: repeated rows and null ids give a row each, an empty table none; columns
    other than doc_id and text don't matter.  ``path`` is a tokenizers file, there on every executor.
    """
    small_batches(docs.sparkSession)
    docs = named(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(path).encode
        for batch in batches:
            for part in slices(batch, 1):
                ids = [encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the encoded rows with the text that their ids stand for."""
    small_batches(encoded.sparkSession)
    encoded = named(encoded, doc_id="doc_id", n_tokens="n_tokens", ids="ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = bpe(path).decode
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(decode, part.column(2).to_pylist())), pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """What the contract asks of each document."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
