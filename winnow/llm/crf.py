"""A linear-chain conditional random field over word-shape features, in numpy."""

from __future__ import annotations

import random
import re

import numpy as np

KINDS = ("email", "ip", "card", "phone", "ssn")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words that announce a number.
CUES = {"call", "tel", "phone", "fax", "mobile", "card", "visa", "credit", "account", "ssn", "social", "security", "ip", "address", "host", "server", "email", "mail", "contact", "version", "license", "page", "chapter", "year", "id", "order"}

_trim = re.compile(r"^[^\w+(@]+|[^\w)]+$")


def core(token: str) -> tuple[int, int]:
    """Start and end of the token without punctuation around it."""
    end = len(token)
    while end and not (token[end - 1].isalnum() or token[end - 1] in ")_"):
        end -= 1
    start = 0
    while start < end and not (token[start].isalnum() or token[start] in "+(@_"):
        start += 1
    return start, end


def shape(token: str) -> str:
    """Runs of letters and digits as class and length (letters: one or more), other signs as they are."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", token, re.S):
        s = m.group()
        out.append(f"9{min(len(s), 20)}" if s[0] in "0123456789" else ("a" if len(s) == 1 else "a+") if s[0].isalpha() else s)
    return "".join(out)


def features(before: str, token: str, after: str) -> list[str]:
    """What the field sees of a token and its neighbours."""
    a, b = core(token)
    own = token[a:b]
    digits = sum(c in "0123456789" for c in own)
    kind = "".join(sorted({"9" if c in "0123456789" else "a" if c.isalpha() else c for c in own}))
    near = lambda x: (x.strip(".,:;!?()").lower() if x.strip(".,:;!?()").lower() in CUES else "9" if any(c in "0123456789" for c in x) else "a" if x else "^")
    return [
        "bias", f"shape={shape(own)}", f"kind={kind}", f"digits={digits if digits < 5 else '5-9' if digits < 10 else '10-12' if digits < 13 else '13-19' if digits < 20 else '20+'}",
        f"before={near(before)}", f"after={near(after)}", f"signs={re.sub(r'[0-9A-Za-z]+|[^ -~]+', '', own)}", f"ended={token[b:b + 1] in ',.;' and bool(token[b:b + 1])}",
        f"before={near(before)},kind={kind}", f"beforeshape={shape(before[core(before)[0]:core(before)[1]]) if near(before) == '9' else '-'}",
        f"aftershape={shape(after[core(after)[0]:core(after)[1]]) if near(after) == '9' else '-'}",
    ]


def usable(token: str) -> bool:
    """Tokens without a digit or @ are outside by definition, which splits a text into short chains."""
    return any(c in "0123456789@" for c in token)


class Field:
    """Weights of features by tag and of tag pairs; chains start and end next to an outside token."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, chains: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(chains, tokens, tags) scores, padded, and the chains' lengths."""
        sizes = np.array([len(c) for c in chains])
        out = np.zeros((len(chains), int(sizes.max(initial=1)), len(TAGS)))
        for i, chain in enumerate(chains):
            for t, feats in enumerate(chain):
                known = [self.names[f] for f in feats if f in self.names]
                out[i, t] = self.emit[known].sum(0)
        return out, sizes

    def decode(self, chains: list[list[list[str]]]) -> list[list[int]]:
        """Viterbi over all chains at once, longest first dropped out."""
        if not chains:
            return []
        score, sizes = self.scores(chains)
        n, length, k = score.shape
        best = score[:, 0] + self.move[0]
        back = np.zeros((n, length, k), np.int8)
        for t in range(1, length):
            paths = best[:, :, None] + self.move[None]
            back[:, t] = paths.argmax(1)
            after = paths.max(1) + score[:, t]
            best = np.where((t < sizes)[:, None], after, best)
        tag = (best + self.move[:, 0]).argmax(1)
        out = np.zeros((n, length), np.int64)
        for t in range(length - 1, -1, -1):
            inside = t < sizes
            out[inside, t] = tag[inside]
            if t:
                tag = np.where(inside, back[np.arange(n), t, tag], tag)
        return [row[:size].tolist() for row, size in zip(out, sizes, strict=True)]


def train(rows: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Maximises the penalised conditional likelihood of (tokens, tags) rows by Adam on exact
    forward-backward gradients."""
    chains, tags = [], []
    for tokens, labels in rows:
        padded = ["", *tokens, ""]
        now: list = []
        for i, (token, label) in enumerate(zip([*tokens, ""], [*labels, "O"], strict=True)):
            if usable(token):
                now.append((features(padded[i], token, padded[i + 2]), TAGS.index(label)))
            elif now:
                chains.append([x[0] for x in now])
                tags.append([x[1] for x in now])
                now = []
    count: dict[str, int] = {}
    for chain in chains:
        for feats in chain:
            for f in feats:
                count[f] = count.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(count))}
    k, n, length = len(TAGS), len(chains), max(map(len, chains))
    sizes = np.array([len(c) for c in chains])
    mask = np.arange(length) < sizes[:, None]
    token_of, feature_of = np.array([(i * length + t, names[f]) for i, c in enumerate(chains) for t, feats in enumerate(c) for f in feats]).T
    gold = np.zeros((n, length), np.int64)
    for i, t in enumerate(tags):
        gold[i, : len(t)] = t
    hot = np.eye(k)[gold] * mask[:, :, None]
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
    summed = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    for step in range(1, steps + 1):
        score = np.zeros((n * length, k))
        np.add.at(score, token_of, emit[feature_of])
        score = score.reshape(n, length, k)
        ahead, behind = np.zeros((n, length, k)), np.zeros((n, length, k))
        ahead[:, 0] = score[:, 0] + move[0]
        for t in range(1, length):
            ahead[:, t] = summed(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
        behind[np.arange(n), sizes - 1] = move[:, 0]
        for t in range(length - 2, -1, -1):
            inner = summed(move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None], 2)
            behind[:, t] = np.where((t + 1 < sizes)[:, None], inner, behind[:, t])
        total = summed(ahead[np.arange(n), sizes - 1] + move[:, 0], 1)
        odds = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        gap = (odds - hot).reshape(n * length, k)
        grad_emit = np.zeros_like(emit)
        np.add.at(grad_emit, feature_of, gap[token_of])
        grad_move = np.zeros_like(move)
        for t in range(1, length):
            live = t < sizes
            pair = np.exp(ahead[live, t - 1, :, None] + move + (score[live, t] + behind[live, t])[:, None] - total[live, None, None])
            grad_move += pair.sum(0) - np.einsum("ia,ib->ab", hot[live, t - 1], hot[live, t])
        grad_move[0] += (odds[:, 0] - hot[:, 0]).sum(0)
        last = np.arange(n), sizes - 1
        grad_move[:, 0] += (odds[last] - hot[last]).sum(0)
        for weight, grad, (one, two) in zip((emit, move), (grad_emit / n, grad_move / n), moments, strict=True):
            grad = grad + decay * weight / 10
            one += 0.1 * (grad - one)
            two += 0.01 * (grad**2 - two)
            weight -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    for b, tag in enumerate(TAGS):  # an inner tag only follows its own kind
        if tag.startswith("I-"):
            for a in range(k):
                if TAGS[a][2:] != tag[2:]:
                    move[a, b] = -1e6
    return Field(names, emit, move)


def labelled(seed: int = 5, n: int = 1200) -> list[tuple[list[str], list[str]]]:
    """The default small labelled table: n short token rows with their tags, made from a few forms."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syllables = ["an", "er", "the", "ou", "st", "re", "la", "de", "en", "sch", "ung", "ción", "é", "qu", "mi", "to", "ra"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    octet = lambda: str(r.randint(0, 255))
    host = lambda: r.choice(["mail", "web", ""]) + r.choice(["", d(1)]) + word().replace("ó", "o").replace("é", "e") + "." + r.choice(["com", "org", "example.com", "co.uk"])
    user = lambda: r.choice([word(), word() + "." + d(2), word() + d(3), word() + "_" + word()])
    forms = {
        "email": [lambda: [user() + "@" + host()], lambda: [user() + "@" + word()], lambda: [user() + "@[" + ".".join(octet() for _ in range(4)) + "]"]],
        "ip": [lambda: [".".join(octet() for _ in range(4))], lambda: [".".join(octet() for _ in range(4)) + ":" + d(r.randint(2, 4))]],
        "card": [lambda: [d(16)], lambda: [d(4) for _ in range(4)], lambda: ["-".join(d(4) for _ in range(4))], lambda: [d(15)], lambda: [d(4), d(6), d(5)]],
        "phone": [
            lambda: ["+" + d(1), f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"{d(3)}-{d(3)}-{d(4)}"], lambda: ["+" + d(2), d(3), d(7)],
            lambda: ["+" + d(2) + d(9)], lambda: [f"{d(3)}.{d(3)}.{d(4)}"], lambda: ["0" + d(3), d(3), d(4)],
        ],
        "ssn": [lambda: [f"{d(3)}-{d(2)}-{d(4)}"]],
    }
    plain = [
        lambda: r.choice("0123456789") + "." + r.choice("0123456789"), lambda: "v" + d(1) + "." + d(1) + "." + d(1), lambda: d(1), lambda: d(2), lambda: d(3), lambda: r.choice(["19", "20"]) + d(2),
        lambda: "$" + d(2) + "." + d(2), lambda: d(2) + "%", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: d(1) + "," + d(3),
        lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40]))) + '"', lambda: word() + d(1), lambda: d(1) + "st", lambda: d(5), lambda: d(8), lambda: f"{d(1)}.{d(1)}.{d(1)}",
        lambda: "@" + word(), lambda: "#" + d(4), lambda: d(24), lambda: "[" + d(2) + "]", lambda: d(2) + "-" + d(2), lambda: f"{d(3)}-{d(3)}", lambda: "sha256:" + d(6), lambda: word() + "-" + d(2),
    ]
    rows = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 3)):
                tokens.append(r.choice(sorted(CUES)) if r.random() < 0.2 else word())
                tags.append("O")
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                parts = r.choice(forms[kind])()
                labels = ["B-" + kind] + ["I-" + kind] * (len(parts) - 1)
            else:
                parts = [r.choice(plain)() for _ in range(r.choice([1, 1, 1, 2]))]
                labels = ["O"] * len(parts)
            parts[-1] += r.choice(["", "", "", ".", ",", ";", "!!", "###", "%%%", "***", "&&&", "$$$"])
            tokens += parts
            tags += labels
        if r.random() < 0.7:
            tokens.append(word())
            tags.append("O")
        rows.append((tokens, tags))
    return rows
