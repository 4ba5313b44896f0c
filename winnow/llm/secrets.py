"""Operator 8 [native]: secret scans with a random forest against false positives.

Candidates are runs of 16 or more key characters with a digit, or what a cue word assigns.  Features,
all native columns: length, character classes and letter transitions, entropy, dictionary coverage,
the path, and the neighbouring words.  The dictionary is a table that stays the same whatever is
scanned, such as the words of a public vocabulary; the letter transitions are those of its words.  A
random forest trained from labelled findings gives each candidate its probability of being a secret,
which so depends on the candidate, its neighbours and its path alone.
"""

from __future__ import annotations

import json
import math
import random
import re
import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let, words_of
from .tables import named, written

#: Words of programs whose share of a candidate is one of its coverages, and cues in neighbouring words.
DICTIONARY = ("password", "example", "sample", "placeholder", "change", "your", "here", "token", "secret", "test", "dummy", "default", "value", "name", "key", "file", "image", "user", "class", "method", "function", "version", "build", "config", "index", "module", "object", "string", "number", "package", "service", "release", "update", "public", "private")
#: Everyday words that made passphrases consist of.
EVERYDAY = ("apple", "beach", "bottle", "candle", "castle", "cloud", "copper", "dragon", "eagle", "forest", "garden", "guitar", "harbor", "island", "jacket", "kitchen", "ladder", "lemon", "magnet", "meadow", "monkey", "mountain", "orange", "paper", "pepper", "pirate", "planet", "pocket", "rabbit", "river", "rocket", "saddle", "silver", "summer", "sunset", "ticket", "tiger", "violin", "window", "winter")
#: What stands for a secret that is not there, and names of digests at the start of a candidate.
PLACEHOLDER = "your|my|example|sample|dummy|test|placeholder|change|here|todo|foo|bar|x{4,}|0{6,}|123456"
DIGEST = "^(sha|md|blake)[0-9]{1,3}[a-z]?[-:]"
#: How keys of well-known issuers begin (fixed values).
ISSUED = "^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|sk-|glpat-|AIza)"
FOR = "token|secret|passw|pwd|api.?key|auth|bearer|credential|private"
AGAINST = "sha|md5|etag|commit|checksum|hash|digest|integrity|uuid|guid|revision|version|example|dummy|sample|fixture|isbn|order|id"
KEY = "[A-Za-z0-9_+/.~-]"
#: Each candidate inside a word: whole runs, with padding.  One before an assignment sign is a name, unless
#: it has 16 characters and a digit or is assigned itself.
VALUE = rf"""(?<!{KEY})(?:{KEY}{{8,}}+={{1,2}}(?!{KEY}|[=:]|["'(<\[{{]+{KEY})|{KEY}{{8,}}+(?!\\?["']?[=:])|(?={KEY}*[0-9]){KEY}{{16,}}+|(?<=[=:]\\?["']?){KEY}{{8,}}+)"""
#: The name that a candidate is assigned to, at the end of what is before it in its word.
NAME = rf"""({KEY}*\\?["']?[=:])\\?["'(<\[{{]*$"""
FEATURES = ("length", "transitions", "letter_runs", "digits", "vowels", "hex", "uuid", "entropy", "surprise", "coverage", "known", "placeholder", "digest", "issued", "cue", "spoken", "contra", "assigned", "path_test", "path_code")


def candidates(docs: DataFrame, path_column: str | None = None) -> DataFrame:
    """(doc_id, path, place, candidate, before, after): place is the word's number in the text; a word
    can have several candidates."""
    columns = {"doc_id": "doc_id", "text": "text"} | ({"path": path_column} if path_column else {})
    docs = named(docs, **columns)
    path = F.coalesce(F.col("path").cast("string"), F.lit("")) if path_column else F.lit("")
    docs = docs.select("doc_id", path.alias("path"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(f"[0-9]|(?i:{FOR})"))
    docs = docs.select("doc_id", "path", words_of(F.col("text")).alias("words"))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    keyed = lambda w: (F.length(w) >= 16) & w.rlike(r"[A-Za-z0-9_+/.~-]{16}") & w.rlike("[0-9]")
    assigned = lambda w, i: (F.length(w) >= 8) & (word(i - 1).rlike("[=:]$") | w.rlike("[=:]")) & F.concat_ws(" ", word(i - 2), word(i - 1), w).rlike(f"(?i:{FOR})")
    places = F.filter(F.transform("words", lambda w, i: F.when(keyed(w) | assigned(w, i), i)), lambda x: x.isNotNull())
    docs = docs.select("doc_id", "path", "words", F.explode(places).alias("place"))
    docs = docs.select("doc_id", "path", "place", word(F.col("place")).alias("word"), *(F.concat_ws(" ", *(word(F.col("place") + d) for d in ds)).alias(name) for name, ds in (("before", (-3, -2, -1)), ("after", (1, 2)))))
    docs = docs.withColumns({"found": F.regexp_extract_all("word", F.lit(VALUE), F.lit(0)), "between": F.split("word", VALUE, -1)})
    # an assignment within the word is part of what comes before
    inside = lambda i: F.regexp_extract(F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.get("between", i)), NAME, 1)
    docs = docs.select("doc_id", "path", "place", "before", "after", F.explode(F.transform("found", lambda c, i: F.struct(c.alias("candidate"), inside(i).alias("inside")))).alias("c"))
    return docs.select("doc_id", "path", "place", "c.candidate", F.trim(F.concat_ws(" ", "before", "c.inside")).alias("before"), "after")


def entropy(text: Column) -> Column:
    """Bits a character."""

    def of(chars: Column) -> Column:
        n = F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + let(F.size(F.filter(chars, lambda x: x == c)) / n, lambda p: -p * F.log2(p)))

    return let(F.split(text, ""), of)


def dictionary(docs: DataFrame, least: int = 3, base: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """(word): lower-case words of 4 to 20 letters that stand alone, not within key characters, in at
    least ``least`` documents, and those of ``base``.  It grows with the corpus; counts combine before
    the shuffle."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    alone = F.lit(rf"(?<![\p{{L}}0-9_+/.~-])\p{{L}}{{4,20}}+(?![0-9_+/~-]|\.[\p{{L}}0-9])")
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, alone, F.lit(0)))).alias("word"))
    told = docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, base)).cast("array<string>")).alias("word")).where(F.length("word") >= 4)
    counts = each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.select("word").union(told).distinct()


def vocabulary_words(spark: SparkSession, path: str, base: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """(word): lower-case words of 4 to 20 letters a to z that a public byte-level vocabulary, a file of the
    tokenizers library, has whole with the blank before them, and ``base``.  The file bounds the table."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    words = {t[1:].lower() for t in tokens if re.fullmatch("Ġ[A-Za-z]{4,20}", t)} | {w for w in base if len(w) >= 4}
    return spark.createDataFrame([(w,) for w in sorted(words)], "word string")


#: Classes of characters in transitions: the letters a to z, a digit, anything else.
CLASSES = 28


def _classes(text: Column) -> Column:
    of = lambda c: F.when((c >= "a") & (c <= "z"), F.ascii(c) - 97).when((c >= "0") & (c <= "9"), 26).otherwise(27)
    return F.transform(F.split(F.lower(text), ""), of)


def _pairs(codes: Column) -> Column:
    """Numbers of neighbouring classes."""
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda x, y: x * CLASSES + y)


def transitions(words: DataFrame) -> list[float]:
    """Bits of surprise of each pair of classes, the second after the first, in the dictionary's words,
    with one pseudo-count a pair: CLASSES ** 2 numbers."""
    rows = words.select(F.explode(let(_classes(F.col("word")), _pairs)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()
    counts = [1.0] * CLASSES**2
    for r in rows:
        counts[r.pair] += r.n
    totals = [sum(counts[x * CLASSES : (x + 1) * CLASSES]) for x in range(CLASSES)]
    return [math.log2(totals[i // CLASSES] / n) for i, n in enumerate(counts)]


def with_features(found: DataFrame, words: DataFrame, surprises: list[float]) -> DataFrame:
    """Candidates with their features; ``words`` is the dictionary, ``surprises`` its ``transitions``."""
    c, n = F.col("candidate"), F.length("candidate")
    parts = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))).alias("part"))
    covered = parts.withColumn("word", F.lower("part")).join(words, "word").groupBy(F.col("candidate").alias("covered")).agg(F.sum(F.length("part")).alias("letters"))
    found = found.join(covered, c == F.col("covered"), "left").withColumn("known", F.coalesce(F.col("letters"), F.lit(0)) / n).drop("covered", "letters")
    table = F.array(*map(F.lit, surprises))
    surprise = let(_pairs(_classes(c)), lambda x: F.aggregate(x, F.lit(0.0), lambda s, i: s + F.get(table, i)) / F.greatest(F.size(x), F.lit(1)))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    left = F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), ""))
    flag = lambda column: column.cast("double")
    near = F.concat_ws(" ", "before", "after")
    return found.select(
        "*", n.cast("double").alias("length"), ((F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / n).alias("transitions"), (F.regexp_count(c, F.lit("[A-Za-z]{4,}")) / n).alias("letter_runs"),
        share("[0-9]").alias("digits"), share("[aeiouAEIOU]").alias("vowels"), flag(c.rlike("^[0-9a-fA-F]+$")).alias("hex"), flag(c.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("uuid"),
        entropy(c).alias("entropy"), surprise.alias("surprise"), (1 - left / n).alias("coverage"), flag(F.col("before").rlike(f"(?i)({FOR})")).alias("cue"),
        (1 - F.length(F.regexp_replace(c, f"(?i)({PLACEHOLDER})", "")) / n).alias("placeholder"), flag(c.rlike(f"(?i){DIGEST}")).alias("digest"), flag(c.rlike(ISSUED)).alias("issued"), flag(F.col("before").rlike("(?i)(passw|passphrase|pwd)")).alias("spoken"),
        flag(near.rlike(rf"(?i)(\b|_)({AGAINST})(\b|_|[0-9])")).alias("contra"), flag(F.col("before").rlike("[=:][\"']?$")).alias("assigned"),
        flag(F.col("path").rlike("(?i)test|example|spec|mock|fixture|doc|sample")).alias("path_test"), flag(F.col("path").rlike(r"(?i)\.(py|js|ts|go|java|rb|env|ya?ml|json|toml|ini|cfg|properties|sh)$")).alias("path_code"),
    )


def labelled(spark: SparkSession, seed: int = 3, n: int = 1600) -> DataFrame:
    """The default labelled findings: (path, candidate, before, after, label), made from a few forms."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    letters, hexes, base = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: r.choice(DICTIONARY)
    filler = lambda: " ".join(pick("aeionrstl", r.randint(2, 7)) for _ in range(2))
    syllables = lambda k: "".join(pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) + r.choice(["", pick("nrst", 1)]) for _ in range(k))
    spoken = lambda: r.choice(["password", "passwd", "pwd", "db_password", "DB_PASSWORD", "passphrase", "admin password", "PGPASSWORD"]) + r.choice(["=", ":", " =", '":', '="'])

    def passed() -> str:
        """What people choose: syllables or words with digits and signs, and phrases of several words."""
        part = lambda: r.choice([syllables(r.randint(2, 3)), r.choice(EVERYDAY)])
        kind = r.randrange(4)
        if kind == 0:
            return part() + pick(string.digits, r.randint(1, 4)) + part() + r.choice(["", pick(string.digits, r.randint(1, 2))])
        if kind == 1:
            return r.choice(["", "-", "_", "."]).join(r.choice(EVERYDAY) for _ in range(r.randint(3, 5)))
        if kind == 2:
            return part().title() + r.choice(["", "-", "_"]) + part().title() + pick(string.digits, r.randint(2, 4))
        return pick(letters, r.randint(8, 18))

    def not_there() -> str:
        """What stands where a password would."""
        one = r.choice(["password", "secret", "token", "passwd", "key", "value"])
        first, last = r.choice(["your", "my", "example", "changeme", "sample", "test", "dummy", "insert"]), r.choice(["here", "123", "example", "placeholder", ""])
        return r.choice([r.choice(["_", "-", "", "."]).join(x for x in (first, one, last) if x), "x" * r.randint(8, 20), "changeme" + pick(string.digits, 2), r.choice(["required", "incorrect", "optional", "undefined", "disabled", "protected", "expired.", "mismatch", "settings", "minimum8", "password", "credentials", "generated", "encrypted"])])

    cue = lambda: r.choice(["token", "secret", "api_key", "apikey", "password", "auth_token", "client_secret", "private_key", "Authorization Bearer"])
    rows = []
    for i in range(n):
        code = r.choice(["src/app.py", "config/prod.env", "deploy.yaml", "web/index.js", "src0", "src7", "notes.txt", ""])
        test = r.choice(["tests/test_api.py", "docs/example.md", "spec/fixtures/a.json", code, code])
        if i % 2:
            value = r.choice([pick(hexes, r.choice([32, 40, 64])), pick(letters, r.randint(20, 44)), pick(base, 40), "AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(letters, 36), "xoxb-" + pick(string.digits, 12) + "-" + pick(letters, 24), "sk_live_" + pick(letters, 24)])
            if r.random() < 0.35:
                rows.append((code, passed(), f"{filler()} {spoken()}", filler(), 1.0))
                continue
            bare = value[:4] in ("AKIA", "ghp_", "xoxb", "sk_l") and r.random() < 0.4
            before = filler() if bare else f"{filler().split()[0]} {cue()} {r.choice('=:')}"
            rows.append((code, value, before, filler(), 1.0))
        else:
            kind = r.randrange(16)
            if kind == 0:
                row = (test, pick(hexes, 40), r.choice(["commit", "revision =", "sha1:", "git hash"]), filler())
            elif kind == 1:
                row = (test, "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid =", "id:", "request", "guid ="]), filler())
            elif kind == 2:
                row = (test, r.choice(["your_", "my_", "example_", "test_", "dummy_"]) + word() + "_" + word() + "_" + pick(string.digits, r.randint(1, 4)), f"{cue()} =", filler())
            elif kind == 3:
                row = (test, pick(hexes, 32), r.choice(["md5", "checksum:", "etag", "digest ="]), filler())
            elif kind == 4:
                part = lambda: r.choice([word(), r.choice(EVERYDAY), f"{word()}-{pick(string.digits, r.randint(1, 4))}", word() + pick(string.digits, 2)])
                row = (test, "/".join([word(), *(part() for _ in range(r.randint(1, 4))), word() + pick(string.digits, 2)]) + r.choice([".png", ".html", ".py", ".md", "/index.html", ""]), filler(), filler())
            elif kind == 5:
                row = (test, r.choice([word(), word().title()]) + "".join(r.choice([word(), r.choice(EVERYDAY)]).title() for _ in range(r.randint(2, 4))) + pick(string.digits, 1), filler() + r.choice(["", " ="]), filler())
            elif kind == 6:
                row = (test, pick(string.digits, r.randint(16, 20)), filler(), filler())
            elif kind == 9:
                name = "".join(pick("bcdfglmnprst", 1) + pick("aeiou", 1) for _ in range(r.randint(4, 7)))
                row = (test, name, r.choice(["user", "user_name", "owner", "host", "title", "label", "login"]) + r.choice(['":', ":", "=", " =", '" :']), filler())
            elif kind in (10, 11):
                row = (code, not_there(), f"{filler()} {spoken() if r.random() < 0.7 else cue() + r.choice([' =', '=', ':'])}", filler())
            elif kind in (13, 14, 15):
                # parts of mail addresses, hosts and names in running text, without a cue
                name = r.choice([pick(string.ascii_lowercase, r.randint(4, 9)), syllables(r.randint(2, 4)), r.choice(EVERYDAY), f"{syllables(2)}.{syllables(2)}"])
                host = f"{r.choice(['mail', 'www', 'smtp', syllables(2)])}{pick(string.digits, r.randint(0, 2))}.{r.choice(['example', syllables(3)])}.{r.choice(['com', 'org', 'net'])}"
                row = (test, r.choice([name + r.choice(["", ".", "_", "-"]) + pick(string.digits, r.randint(1, 4)), host]), filler(), r.choice([filler(), ""]))
            elif kind == 12:
                size, length = r.choice([("sha256", 43), ("sha384", 64), ("sha512", 86)])
                row = (code, f"{size}-{pick(base, length)}" + "=" * (-length % 4), r.choice(['integrity="', "integrity:", '"integrity":', filler(), ""]), filler())
            elif kind == 7:
                row = (test, ".".join(str(r.randint(0, 20)) for _ in range(3)) + "-" + word() + "." + pick(string.digits, 6), "version =", filler())
            else:
                row = (test, r.choice(["xxxxxxxxxxxxxxxx1234", "1234567890123456", "0000000000000000abcd", "abcdefabcdef12345678", "deadbeef" * 4]), f"{cue()} =", filler())
            rows.append((*row, 0.0))
    return spark.createDataFrame(rows, "path string, candidate string, before string, after string, label double")


def train(findings: DataFrame, words: DataFrame, surprises: list[float], most: int = 20_000, trees: int = 30, depth: int = 7, seed: int = 11) -> PipelineModel:
    """The forest, fitted to labelled findings, of which it takes ``most`` rows by hash."""
    order = (F.xxhash64("candidate", "before"), "candidate", "before", "after", "path", "label")
    sample = with_features(findings.orderBy(*order).limit(most), words, surprises).orderBy(*order).coalesce(1)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(sample)


def scan_secrets(docs: DataFrame, path_column: str | None = None, findings: DataFrame | None = None, threshold: float = 0.5, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, place, path, candidate, probability, is_secret): a row for each candidate.

    ``place`` is the number of its word in the text.  ``findings`` (path, candidate, before, after,
    label) replaces the default labelled ones; ``words`` (word) is the dictionary, without which it is the
    table's own (``dictionary``), so that a verdict then depends on the other rows too.  A null or empty text has no candidates; a null path is
    empty.  Repeated rows give repeated findings; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    found = written(candidates(docs, path_column), "candidates")
    words = written(dictionary(named(docs, text="text")) if words is None else words.select("word").distinct(), "dictionary")
    surprises = transitions(words)
    model = train(labelled(spark) if findings is None else findings, words, surprises)
    chance = F.round(F.get(vector_to_array("probability"), 1), 6)
    return model.transform(with_features(found, words, surprises)).select("doc_id", F.col("place").cast("long").alias("place"), "path", "candidate", chance.alias("probability"), (chance >= threshold).alias("is_secret"))
