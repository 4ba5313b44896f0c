"""Operator 6: personal data by fixed patterns and a linear-chain conditional random field.

The patterns find emails, addresses, cards and phones; the field (crf.py), trained on a small
labelled table, adds spans that no pattern has: unusual forms, grouped or mistyped numbers.  Tokens
without a digit or @ are outside by definition, so Viterbi runs over the short chains between them,
many at a time.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import TAGS, Field, core, features, labelled, train, usable
from .tables import named, small_batches
from .words import Words, slices

KINDS = ("email", "ip", "card", "phone")
_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can only begin where a run of digits does, and runs are taken whole
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digits = re.compile(r"[^0-9]+")
_token = re.compile(r"[^\x20\x09-\x0D]+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Tokens, padded, that are decoded at once; a longer chain is decoded alone.
TOKENS = 1 << 17


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, by kind and start; those that fail their test drop out."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _ip.finditer(text):
        if all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() <= 38 and 16 <= len(x := _digits.sub("", m.group())) <= 19 and luhn(x):
            out.append(("card", m.start(), m.end()))
    for m in _phone.finditer(text):
        if 8 <= len(_digits.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def field_chains(text: str) -> list[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Chains of usable tokens: the tokens' places without punctuation, and their features."""
    chains, now = [], []
    tokens = list(_token.finditer(text))
    for i, m in enumerate(tokens):
        if usable(m.group()):
            now.append(i)
        if now and (now[-1] != i or i == len(tokens) - 1):
            places, feats = [], []
            for j in now:
                t = tokens[j].group()
                a, b = core(t)
                places.append((tokens[j].start() + a, tokens[j].start() + b))
                feats.append(features(tokens[j - 1].group() if j else "", t, tokens[j + 1].group() if j + 1 < len(tokens) else ""))
            chains.append((places, feats))
            now = []
    return chains


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field decodes, by text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    all_ = [(i, places, feats) for i, text in enumerate(texts) for places, feats in field_chains(text)]
    all_.sort(key=lambda x: len(x[1]))
    sizes = [len(x[1]) for x in all_]
    a = 0
    while a < len(all_):
        b = a + 1
        while b < len(all_) and b - a < 2048 and (b - a + 1) * sizes[b] <= TOKENS:
            b += 1
        some, a = all_[a:b], b
        for (i, places, _), tags in zip(some, field.decode([x[2] for x in some]), strict=True):
            for place, tag in zip(places, tags, strict=True):
                if place[0] < place[1] and TAGS[tag][0] == "B":
                    out[i].append((TAGS[tag][2:], *place))
                elif TAGS[tag][0] == "I" and out[i] and out[i][-1][0] == TAGS[tag][2:]:
                    out[i][-1] = (out[i][-1][0], out[i][-1][1], place[1])
    return out


@lru_cache(2)
def default_field() -> Field:
    return train(labelled())


def trained(table: DataFrame, most: int = 5000) -> Field:
    """A field from a labelled table (tokens array, tags array), of which it takes ``most`` rows."""
    return train([(r.tokens, r.tags) for r in table.orderBy(F.xxhash64("tokens")).limit(most).collect()])


def merged(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All base spans, and those added ones that touch none of them; by kind and start."""
    taken: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    last = [bisect.bisect_left(starts, s[2]) - 1 for s in added]  # the last that begins before the end
    free = [s for s, i in zip(added, last, strict=True) if i < 0 or taken[i][1] <= s[1]]
    order = [*KINDS, "ssn"]
    return sorted({*base, *free}, key=lambda s: (order.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, field: Field | None = None, mask: bool = False) -> DataFrame:
    """(row's columns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) and, with ``mask``,
    masked_text, for each row of ``docs``.

    Offsets are code points, ends exclusive.  A null text is empty and stays null when masked.
    Repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    field = field or default_field()
    small_batches(docs.sparkSession)
    docs = named(docs, doc_id="doc_id", text="text").select("doc_id", F.col("text").cast("string"))
    signs = np.zeros(256, bool)
    signs[[*range(48, 58), 64]] = True
    empty = hashlib.sha256(b"").hexdigest()

    def find(batches):
        for batch in batches:
            for piece in slices(batch, 1):
                words = Words(piece.column(1))
                hits = np.r_[0, np.cumsum(signs[words.data])][words.bounds]
                some = np.flatnonzero(np.diff(hits))
                texts = piece.column(1).take(pa.array(some)).to_pylist()
                n = piece.num_rows
                counts, shas, spans = np.zeros((len(KINDS), n), np.int64), [empty] * n, [""] * n
                masks = dict.fromkeys(range(0))
                for i, text, added in zip(some.tolist(), texts, field_spans(texts, field), strict=True):
                    base = pattern_spans(text)
                    for k, kind in enumerate(KINDS):
                        counts[k, i] = sum(s[0] == kind for s in base)
                    found = merged(base, added)
                    shas[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
                    if mask and found:
                        masks[i] = masked(text, found)
                columns = [piece.column(0), *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
                if mask:
                    whole = piece.column(1)
                    if masks:
                        chosen = np.zeros(n, bool)
                        chosen[list(masks)] = True
                        whole = pa.compute.replace_with_mask(whole, pa.array(chosen), pa.array([masks[i] for i in sorted(masks)], whole.type))
                    columns.append(whole)
                    names.append("masked_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.mapInArrow(find, schema + ", masked_text string" * mask)
