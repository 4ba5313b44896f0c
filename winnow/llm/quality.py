"""Operator 4 [native]: weak supervision for document quality.

Rules over native text statistics vote good (1), bad (-1) or abstain (0).  The counts of the vote
patterns, at most 3 ** rules rows whatever the corpus, drive an expectation-maximisation of a mixture
of one good class and one class for each kind of junk (KINDS): the classes' shares and, for each
class and rule, how often its votes are bad ones.  A document's posterior probability of being good
decides, instead of a demand that it pass every rule.

Nothing but the votes says which rules to trust: a rule whose bad votes agree with no other rule's is
noise to the model.  Each kind of junk is therefore seen by several rules.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import named, written

SPACES = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A word that the next one repeats.
TWIN = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++(?=\1(?![^\x20\x09-\x0D]))"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(x: Column, by: int) -> Column:
    """Hashes of each element with the one ``by`` places on: twice the length."""
    n = F.greatest(F.size(x) - by, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column, width: int) -> Column:
    """Words within windows that occur twice or more."""

    def count(places: Column) -> Column:
        inner = F.aggregate(F.sequence(F.lit(1), F.size(places)), F.lit(0), lambda sum_, i: sum_ + F.least(F.lit(width), F.coalesce(F.get(places, i) - F.get(places, i - 1), F.lit(width))))
        return F.when(F.size(places) > 0, inner).otherwise(0)

    def repeated(z: Column) -> Column:
        value = lambda i: F.get(z, i)["w"]
        twice = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: (value(i) == value(i + 1)) | ((i > 0) & (value(i) == value(F.greatest(i - 1, F.lit(0))))))
        return let(F.sort_array(F.transform(twice, lambda i: F.get(z, i)["i"])), count)

    return let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), repeated)


def repeat_words(hashes: Column) -> Column:
    """Words in 8-word windows found twice or more.  Two equal windows hold five equal pairs of
    4-word windows, so the 8-word windows are made only where that many 4-word windows repeat."""

    def by_four(four: Column) -> Column:
        return F.when(F.size(four) - F.size(F.array_distinct(four)) < 5, 0).otherwise(_covered(_joined(four, 4), 8))

    return F.when(F.size(hashes) < 9, 0).otherwise(let(_joined(_joined(hashes, 1), 2), by_four))


def statistics(docs: DataFrame) -> DataFrame:
    """Text statistics of each row, computed within it; a null text has no words."""
    docs = named(docs, doc_id="doc_id", text="text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform("words", lambda x: F.xxhash64(x))
    fewer = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    docs = docs.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]{{2,}}")).cast("long").alias("n_runs"), F.regexp_count("text", F.lit(rf"[{SYMBOLS}][^\x20\x09-\x0D]*")).cast("long").alias("n_marked"),
        F.length(F.regexp_replace("text", r"\P{L}++", "")).cast("long").alias("n_letters"), F.regexp_count("text", F.lit(TWIN)).cast("long").alias("n_twins"), fewer(SYMBOLS).alias("n_symbols"), fewer("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÑÓÖÚÜ").alias("n_upper"), fewer("!").alias("n_shouts"),
        F.regexp_count("text", F.lit("!{2,}")).cast("long").alias("n_cries"), lines.alias("lines"), hashes.alias("hashes"),
    )
    return docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_runs", "n_marked", "n_letters", "n_twins", "n_upper", "n_shouts", "n_cries", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"), repeat_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, as integer comparisons over ``statistics``; too few words are the base rule's matter."""
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _vote(F.col("n_symbols") * 4 > n, F.col("n_symbols") * 20 <= n),
        "runs": _vote(F.col("n_runs") * 10 > n, F.col("n_runs") * 50 <= n),
        "marked": _vote(F.col("n_marked") * 10 > n, F.col("n_marked") * 50 <= n),
        "letters": _vote(F.col("n_letters") * 100 < c * 70, F.col("n_letters") * 100 >= c * 85),
        "repetition": _vote(F.col("n_repeat_words") * 100 > n * 30, F.col("n_repeat_words") * 100 <= n * 10),
        "twins": _vote(F.col("n_twins") * 20 > n, F.col("n_twins") * 100 <= n),
        "lines": _vote(F.col("n_dup_lines") * 2 > F.col("n_lines"), F.col("n_dup_lines") * 20 <= F.col("n_lines")),
        "capitals": _vote(F.col("n_upper") * 10 > c * 4, F.col("n_upper") * 10 <= c * 2),
        "shouting": _vote(F.col("n_shouts") * 5 > n, F.col("n_shouts") * 50 <= n),
        "cries": _vote(F.col("n_cries") * 10 > n, F.col("n_cries") * 50 <= n),
        "variety": _vote((n >= 50) & (F.col("n_distinct") * 10 < F.least(n, F.lit(2000))), F.col("n_distinct") * 4 >= F.least(n, F.lit(2000))),
        "word_length": _vote((c < n * 2) | (c > n * 15), (c >= n * 3) & (c <= n * 10)),
    }


#: The kinds of junk, by the rules that see them; other rules only add evidence.
KINDS = (("symbols", "runs", "marked", "letters"), ("repetition", "twins", "variety", "lines"), ("capitals", "shouting", "cries"))


def posterior(model: list[tuple[float, dict[str, float]]], names: list[str]) -> Column:
    """The probability that a document with these votes is good: the first class's.

    What each vote adds to the log odds of a class is looked up in array literals: plans of different
    models then share their generated code, which literals by themselves would be compiled into."""
    (share, good), others = model[0], None
    for part, bad in model[1:]:
        odds = F.lit(math.log(part / share))
        for k in names:
            odds = odds + F.get(F.array(*map(F.lit, (math.log(bad[k] / good[k]), 0.0, math.log((1 - bad[k]) / (1 - good[k]))))), F.col(k) + 1)
        others = F.exp(odds) if others is None else others + F.exp(odds)
    return 1 / (1 + others)


def vote_counts(voted: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns and how often each occurs: at most 3 ** rules rows, however many documents."""
    code = sum(((F.col(name) + 1) * 3**k for k, name in enumerate(names)), F.lit(0).cast("long"))
    rows = voted.groupBy(code.alias("code")).agg(F.count("*").alias("n")).orderBy("code").collect()
    codes = np.array([r.code for r in rows], np.int64)
    return codes[:, None] // 3 ** np.arange(len(names)) % 3 - 1, np.array([r.n for r in rows], float)


def started(votes: np.ndarray, names: list[str], least: int) -> np.ndarray:
    """Classes to start from: the kinds in proportion to their bad votes if they have ``least``, else good."""
    bad = np.stack([(votes[:, [names.index(k) for k in kind]] < 0).sum(1) for kind in KINDS], 1)
    bad = np.where(bad >= least, bad, 0)
    total = bad.sum(1, keepdims=True)
    return np.concatenate([total == 0, bad / np.maximum(total, 1)], 1)


def maximise(votes: np.ndarray, n: np.ndarray, chances: np.ndarray, steps: int, pseudo: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, shares of the classes, shares of bad votes by class and rule) after
    expectation-maximisation from each pattern's chances by class.

    An abstention is no evidence.  ``pseudo`` counts stand on either side of each share, the same for
    all classes."""
    bad, good = (votes < 0).astype(float), (votes > 0).astype(float)
    last = None
    for _ in range(steps):
        weight = n[:, None] * chances
        sizes = weight.sum(0) + pseudo
        ones, zeros = weight.T @ bad + pseudo, weight.T @ good + pseudo
        now = sizes / sizes.sum(), ones / (ones + zeros)
        log = np.log(now[0]) + bad @ np.log(now[1]).T + good @ np.log(1 - now[1]).T
        top = log.max(1, initial=-np.inf)
        all_ = top + np.log(np.exp(log - top[:, None]).sum(1))
        chances = np.exp(log - all_[:, None])
        if last and max(np.abs(x - y).max() for x, y in zip(now, last, strict=True)) < 1e-7:
            break
        last = now
    return float(n @ all_), *now


def estimate(votes: np.ndarray, n: np.ndarray, names: list[str], steps: int = 300, pseudo: float = 1.0) -> list[tuple[float, dict[str, float]]]:
    """Each class's share and, by rule, the share of bad votes among its votes: the likeliest of two
    starts, from one and from two bad votes of a kind on."""
    found = (maximise(votes, n, started(votes, names, least), steps, pseudo) for least in (1, 2))
    _, shares, bad = max(found, key=lambda x: x[0])
    return [(share, dict(zip(names, row, strict=True))) for share, row in zip(shares.tolist(), bad.tolist(), strict=True)]


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Statistics, base_failed, posterior and kept for each row of ``docs``.

    A null or empty text has no words and fails the base rule.  Repeated rows each count and each
    get a row; other columns are ignored; an empty table gives an empty result.
    """
    names = list(rules())
    stats = written(statistics(docs), "quality")
    voted = stats.select("*", *(v.alias(k) for k, v in rules().items()))
    model = estimate(*vote_counts(voted, names), names)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    voted = voted.withColumn("posterior", posterior(model, names)).withColumn("base_failed", failed)
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior", *names,
    )
