"""Small documents with every odd case, and brute-force versions of the operators' results."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *(T.StructField(n, T.StringType()) for n in ("key", "n", "words", "size", "root", "bucket", "z")),
])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "the", "ou", "é", "sch", "ra"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_texts():
    base = prose(1, 120)
    near = base.split(" ")
    near[7] = "changed"
    passage = prose(5, 30)
    long = prose(6, 20_000)
    return [
        base, base, base.upper(), " ".join(near), base + " tail", None, "", "   \n\t", "one", "one two", "One two", " é ü x", prose(2, 60) + "\n" + passage + "\n" + prose(3, 60),
        passage + " " + prose(4, 80), prose(9, 12), prose(9, 12), prose(9, 13), prose(9, 13), "a b c d e f g h " * 30, "line one here\n" * 12, long, long + " more",
        "x" * 5000, "9" * 3000, "mail a.b@c.d.org, ip 10.0.0.1 card 4111 1111 1111 1111 or 4111111111111112 tel +1 (017) 555-7713 end", "### $$$ %%% " * 40, "WORD!! LOUD!! " * 40,
        "<|endoftext|> and </s>[INST] x", "tabs\tand\x0bverticals\x0cfeeds  double  spaces ",
    ]


def frame(spark, rows=None):
    """Texts as documents with ids from 0, one row twice, and one without an id."""
    texts = odd_texts() if rows is None else rows
    data = [(i, t, "en", [None, "b", "a", "ä"][i % 4], len(t) if t else None, *["x"] * 7) for i, t in enumerate(texts)]
    if rows is None:
        data += [data[3], (None, "no id here but some words to count", None, None, None, *["y"] * 7)]
    return spark.createDataFrame(data, SCHEMA)
