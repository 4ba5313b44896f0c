"""Corpus pipeline: quality rules, n-gram Jaccard join, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars), in the input's types;
other columns of the input are dropped.  Rows with a null doc_id go through each stage like others.

1. quality_rules removes the documents that the rules reject.
2. jaccard_join keeps one row of each component of near copies (five-word shingles, similarity 0.8 or
   more), that with the smallest doc_id; texts without words link with nothing and stay.
3. pii replaces personal data in the texts by its kind in brackets.
4. mixing repeats each document as often as the mix takes it; those taken 0 times go.
5. packing returns the pieces of the packed sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.jaccard import jaccard_links
from winnow.llm.mixing import mix
from winnow.llm.packing import pack
from winnow.llm.pii import find_pii
from winnow.llm.quality import quality_rules
from winnow.llm.queries import tokenizer_path
from winnow.llm.tables import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _decided(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with the facts found for their doc_id; repeated rows have the same ones."""
    facts = facts.withColumnRenamed("doc_id", "fact_id")
    return docs.join(facts.hint("shuffle_hash"), _same("doc_id", "fact_id")).drop("fact_id")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Rows that share a doc_id stay if any of them is kept."""
    found = quality_rules(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return _decided(docs.select(*COLUMNS), found.where("kept")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the one with the smallest doc_id, null last, and of
    rows that share it the one with the least values.  Rows are told apart by doc_id and text, so two
    texts under one doc_id are two documents.  Texts without words link with nothing and all stay."""
    tag = F.xxhash64("text")
    found = jaccard_links(docs, n=5, percent=80, tag=tag)
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tag")).alias("least")).select("least.doc_id", "least.tag")
    first = first.select(F.col("doc_id").alias("first_id"), F.col("tag").alias("first_tag"))
    rows = docs.select(*COLUMNS, tag.alias("tag"), F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")).alias("worded"))
    kept = rows.where("worded").join(first.hint("shuffle_hash"), (F.col("tag") == F.col("first_tag")) & _same("doc_id", "first_id"))
    one = kept.groupBy("tag", "doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("rest")).select("doc_id", "rest.*")
    return one.select(*COLUMNS).unionByName(rows.where("not worded").select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows where it was known."""
    kept = F.struct(*(F.col(c) for c in COLUMNS if c != "text"))
    masked = find_pii(docs.select(kept.alias("doc_id"), "text"), mask=True)
    size = F.when(F.col("doc_id.n_chars").isNotNull(), F.length("masked_text")).cast(docs.schema["n_chars"].dataType)
    return masked.select(*(size.alias(c) if c == "n_chars" else F.col("masked_text").alias(c) if c == "text" else F.col(f"doc_id.{c}").alias(c) for c in COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    found = mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    return _decided(docs.select(*COLUMNS), found).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return pack(docs, tokenizer_path(), length=1024, ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation and the trained field have no SQL; tests/llm compares each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
