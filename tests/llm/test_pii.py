import hashlib
import random
import re

import numpy as np
import pytest

from winnow.llm import crf
from winnow.llm.pii import default_field, field_spans, find_pii, luhn, merged, pattern_spans

from .helpers import frame


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(x := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(x)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_patterns_against_plain_matching():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "b.", "@", ".", "-", " ", "+", "1", "22", "255", "(", ")", "é", "4111 1111 1111 1111", "10.0.0.1"]) for _ in range(r.randint(0, 16)))
        assert pattern_spans(text) == brute(text), text


def test_odd_texts(spark):
    docs = frame(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = find_pii(docs, mask=True).collect()
    assert len(found) == docs.count()
    for r in found:
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    masked = next(r.masked_text for r in found if "[EMAIL]" in (r.masked_text or ""))
    assert not re.search(r"@|10\.0|4111|555", masked) and masked.endswith(" end")


def test_held_out_accuracy():
    field, gold, hit, false = default_field(), 0, 0, 0
    for tokens, tags in crf.labelled(seed=91, n=300):
        spans, at = [], 0
        for token, tag in zip(tokens, tags, strict=True):
            a, b = crf.core(token)
            if tag[0] == "B":
                spans.append((tag[2:], at + a, at + b))
            elif tag[0] == "I":
                spans[-1] = (*spans[-1][:2], at + b)
            at += len(token) + 1
        found = set(field_spans([" ".join(tokens)], field)[0])
        gold, hit, false = gold + len(spans), hit + len(found & set(spans)), false + len(found - set(spans))
    assert hit >= 0.97 * gold and false <= 0.03 * gold


@pytest.mark.parametrize("length", [1, 2, 5])
def test_viterbi_against_all_paths(length):
    r = np.random.default_rng(length)
    k = 4
    field = crf.Field({f"f{i}": i for i in range(6)}, r.normal(size=(6, len(crf.TAGS))), r.normal(size=(len(crf.TAGS),) * 2))
    field.emit[:, k:], field.move[:, k:] = -99, -99
    chains = [[[f"f{r.integers(6)}" for _ in range(2)] for _ in range(length)] for _ in range(5)] + [[["f0"]]]
    for chain, tags in zip(chains, field.decode(chains), strict=True):
        import itertools

        score = [field.emit[[field.names[f] for f in feats]].sum(0) for feats in chain]
        total = lambda p: sum(s[t] for s, t in zip(score, p, strict=True)) + sum(field.move[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))  # noqa: E731,B023
        assert total(tags) == pytest.approx(max(total(p) for p in itertools.product(range(k), repeat=len(chain))))


def test_spans_in_long_chains():
    field = default_field()
    for filler in range(58, 70):  # the span lies over any cut at 64 tokens
        text = "12 " * filler + "(555) 123-4567 " + "12 " * 80
        at = 3 * filler
        assert ("phone", at, at + 14) in field_spans([text], field)[0], filler
    numbers = " ".join(f"(555) 123-{i:04}" for i in range(3000))
    found = field_spans([numbers, "call (555) 123-4567 now"], field)
    assert all(any(a <= 15 * i and 15 * i + 14 <= b for _, a, b in found[0]) for i in range(3000)) and found[1] == [("phone", 5, 19)]


def test_empty_table(spark):
    assert find_pii(frame(spark, [])).collect() == []


def test_whole_tokens_count():
    """Features read whole tokens: what differs after thousands of characters tells tokens apart."""
    long = "7a" * 5000
    assert crf.features("", long + "-", "") == crf.features("", long, "") or crf.core(long + "-") != crf.core(long)
    for a, b in ((long, long + "#1"), (long + "77", long + "a77"), ("1" * 9999, "1" * 9999 + "@x")):
        assert crf.features("", a, "") != crf.features("", b, "")
    texts = [f"tel {long} x", f"{long} {'9' * 10_000} 555-123-4567 {long}"]
    assert field_spans(texts, default_field())[1] == [s for s in field_spans([texts[1]], default_field())[0]]
    assert ("phone", 20002, 20014) in field_spans(texts, default_field())[1]


def test_merged_against_all_pairs():
    r = random.Random(12)
    for _ in range(3000):
        def spans(kinds, n):
            return [(r.choice(kinds), a, a + r.randint(1, 8)) for a in (r.randrange(60) for _ in range(r.randint(0, n)))]

        base, added = spans(["email", "ip", "card", "phone"], 6), spans(["phone", "ssn"], 6)
        free = [s for s in added if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        order = ["email", "ip", "card", "phone", "ssn"]
        assert merged(base, added) == sorted({*base, *free}, key=lambda s: (order.index(s[0]), s[1], s[2]))
