"""Token ids of texts by a public byte-level BPE.

The file is for the tokenizers library.  Where its merges are in the order of its ids, as they are in
a byte-level vocabulary, ranks alone give the same ids, and tiktoken takes them ten times as fast;
texts that may hold a special token's string, or that it can't split, go to the tokenizer itself.
Ids are kept as little-endian 32-bit bytes.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

#: The pre-tokenizer's own pattern (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """A tiktoken encoding that gives the same ids; None where that isn't sure."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        plain = told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.special = [x["content"] for x in told["added_tokens"]]
        vocab, merges = told["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        ids = [vocab.get("".join(x), -1) for x in merges]
        if not plain or ids != sorted(ids) or told["model"].get("dropout") or told["model"].get("ignore_merges"):
            return None
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in word): i for word, i in vocab.items() if word not in self.special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if self.fast is None or any(x in text for x in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            try:
                ids = self.fast.encode_ordinary(text)
            except ValueError:  # the splitter's stack, on extreme runs of one kind
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each process."""
    return Encoder(path)
