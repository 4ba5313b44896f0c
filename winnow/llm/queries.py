"""The registered queries of this subpackage: thin digests over the operators, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, sql
from .chat import digests, prefix_targets
from .divergence import source_divergence
from .jaccard import jaccard_components
from .knn import top_products
from .lm import cross_entropy_difference
from .mixing import mix
from .packing import pack
from .pii import find_pii
from .prefix_trie import prefix_trie
from .quality import quality_rules
from .secrets import scan_secrets, vocabulary_words
from .substrings import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(prefix_targets(told.unionByName(own)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), width=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=1024, ids=False)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    found = cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary_words(spark, tokenizer_path())
    return scan_secrets(table(spark, sf_dir, "documents"), path_column="source", words=words)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    return bpe.digests(bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), path), path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op4_quality_rules": op4_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_exact_topk": op7_exact_topk,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": sql.JACCARD,
    "op2_chat_formatting": sql.CHAT,
    "op5_mixing": sql.MIXING,
    "op7_exact_topk": sql.TOPK,
    "op10_substring_dedup": sql.SUBSTRINGS,
    "op11_source_divergence": sql.DIVERGENCE,
    "op12_prefix_trie": sql.TRIE,
}
