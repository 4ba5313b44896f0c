"""The registered queries: the operators over the test tables, each with DuckDB SQL where SQL can say it.

Documents stand for records: the first line is the title, the rest the abstract; labels stand for
reviews, events for journals and sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.functions.numbers import interval, path_safe, percent
from winnow.operators import bart, decide, dtm, reporting, rules
from winnow.operators import performance as perf
from winnow.operators import records as R
from winnow.schema import RECORD, conform
from winnow.sources import parsers, search
from winnow.sources.dates import year_predicate
from winnow.sources.parsers import parse_pubmed
from winnow.sources.search import latest, source_paths, wos_records
from winnow.sources.sessions import iteration_number
from winnow.storage import RUN, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").withColumns({"title": title, "abstract": F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)")})


def records(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return conform(docs.select((F.col("doc_id") + 1).alias("Order"), F.col("doc_id").cast("string").alias("ID"), F.col("title").alias("Title"), F.col("abstract").alias("Abstract"), F.col("source").alias("Source"), (F.col("n_chars") % 1000).cast("int").alias("N_citations")), RECORD)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "y").otherwise("n").alias("target"), "toxic")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(id, term, val) of all words."""
    docs = table(spark, d, "documents")
    return dtm.terms_of(docs, "doc_id", F.regexp_replace(F.lower("text"), T.NON_WORD, " "))


def common_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return dtm.text_to_dtm(docs, "doc_id", F.regexp_replace(F.lower("text"), T.NON_WORD, " "), min_freq=20)


# SQL building blocks
DOCS = "docs AS (SELECT *, split_part(text, chr(10), 1) AS title, substring(text, length(split_part(text, chr(10), 1)) + 2) AS abstract FROM documents)"
LABELS = "lab AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'y' ELSE 'n' END AS target, toxic FROM labels)"
TOK = r"tok AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM documents)"
COMMON = TOK + ", dtm AS (SELECT * FROM tok WHERE term IN (SELECT term FROM tok GROUP BY term HAVING count(*) >= 20))"
PAIRS = (
    COMMON
    + ", norm AS (SELECT term, count(*) AS n FROM dtm GROUP BY term), pairs AS (SELECT a.term AS a, b.term AS b, count(*) AS c, any_value(na.n) AS na, any_value(nb.n) AS nb"
    + " FROM dtm a JOIN dtm b ON a.doc_id = b.doc_id AND a.term < b.term JOIN norm na ON na.term = a.term JOIN norm nb ON nb.term = b.term"
    + " GROUP BY a.term, b.term HAVING count(*) * count(*) * 100 >= 81 * any_value(na.n) * any_value(nb.n))"
)
KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({}, ' *; *', ';', 'g'), '[\"'']+', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_signif(x: str, digits: int) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round(({x}) * pow(10.0, {digits} - 1 - floor(log10(abs({x}))))) / pow(10.0, {digits} - 1 - floor(log10(abs({x})))) END"


def sql_plain(x: str) -> str:
    return rf"regexp_replace(regexp_replace(printf('%.6f', CAST({x} AS DOUBLE)), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


def sql_percent(x: str) -> str:
    y = f"(({x}) * 100)"
    return sql_plain(f"CASE WHEN abs({y}) < 1 THEN {sql_signif(y, 2)} ELSE {sql_signif(y, 3)} END") + " || '%'"


# records


@query(f"SELECT doc_id, nullif(nullif({CLEAN.format('text')}, ''), 'NA') AS text_clean FROM documents")
def clean_textfields(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("text_clean"))
    return R.clean_textfields(docs)


@query(f"WITH {DOCS} SELECT doc_id, {KEY.format('title')} AS uid FROM docs")
def title_key(spark, d):
    return documents(spark, d).select("doc_id", T.title_key(F.col("title")).alias("uid"))


UID = f"u AS (SELECT *, coalesce(nullif({KEY.format('title')}, ''), 'id:' || doc_id) AS uid FROM docs)"


@query(f"""
WITH {DOCS}, {UID},
s AS (SELECT uid, source, min(doc_id) AS first_at FROM u WHERE source IS NOT NULL GROUP BY uid, source),
j AS (SELECT uid, string_agg(source, ';' ORDER BY first_at, source) AS sources FROM s GROUP BY uid)
SELECT min(doc_id) + 1 AS ord_min, nullif({CLEAN.format('arg_min(title, doc_id)')}, '') AS first_title, string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY doc_id) AS ids,
  any_value(j.sources) AS sources, CAST(max(n_chars % 1000) AS INTEGER) AS n_max FROM u LEFT JOIN j USING (uid) GROUP BY uid""")
def fix_duplicates(spark, d):
    out = R.fix_duplicates(records(spark, d))
    return out.select(F.col("Order").alias("ord_min"), F.col("Title").alias("first_title"), F.col("ID").alias("ids"), F.col("Source").alias("sources"), F.col("N_citations").alias("n_max"))


@query(f"WITH {DOCS}, {UID}, g AS (SELECT uid, count(*) AS n FROM u GROUP BY uid) SELECT CAST(sum(n) AS BIGINT) AS n_in, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_groups FROM g")
def dedup_counts(spark, d):
    groups = R.duplicate_keys(records(spark, d)).groupBy("UID").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_in"), F.count("*").alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_groups"))


@query(f"WITH {DOCS}, k AS (SELECT doc_id, {KEY.format('title')} AS uid FROM docs) SELECT doc_id FROM k WHERE doc_id % 2 = 1 AND uid NOT IN (SELECT uid FROM k WHERE doc_id % 2 = 0)")
def dedup_anti_prev(spark, d):
    keys = documents(spark, d).select("doc_id", T.title_key(F.col("title")).alias("uid"))
    return keys.where("doc_id % 2 = 1").join(keys.where("doc_id % 2 = 0").select("uid").distinct(), "uid", "left_anti").select("doc_id")


@query(f"""
WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS id, title, source, CAST(NULL AS INTEGER) AS year FROM docs
UNION ALL SELECT 'C' || conv_id || '.' || turn, split_part(text, chr(10), 1), role, CAST(NULL AS INTEGER) FROM conversations""")
def join_sources_union(spark, d):
    one = documents(spark, d).select(F.col("doc_id").cast("string").alias("ID"), F.col("title").alias("Title"), F.col("source").alias("Source"))
    told = table(spark, d, "conversations")
    two = told.select(F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("ID"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("Title"), F.col("role").alias("Source"))
    return R.join_records([one, two], dedup=False).select(F.col("ID").alias("id"), F.col("Title").alias("title"), F.col("Source").alias("source"), F.col("Year").alias("year"))


@query("SELECT doc_id, lower(source) || '; ' || lang AS keywords FROM documents")
def keyword_normalise(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", R.keyword_list(F.concat_ws(" ; ", F.upper("source"), F.concat(F.lit("*"), "lang"), F.concat(F.lit("'"), "source", F.lit("'")), F.lit(""))).alias("keywords"))


YEARS = {"1995-1996": "BETWEEN 1995 AND 1996", ">1996": "> 1996", ">=1996": ">= 1996", "<1994": "< 1994", "<=1994": "<= 1994", "1995": "= 1995"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS form, count(*) AS n FROM orders WHERE year(o_orderdate) {v}" for k, v in YEARS.items()))
def year_filter(spark, d):
    year = F.year("o_orderdate")
    counts = table(spark, d, "orders").agg(*(F.count_if(year_predicate(k, year)).alias(k) for k in YEARS))
    return counts.unpivot([], [F.col(f"`{k}`") for k in YEARS], "form", "n")


@query("SELECT DISTINCT concat_ws('/', 'base', 's' || user_id % 5, 'q' || event_id % 2, event_type || '.csv') AS path FROM events WHERE user_id % 5 IN (0, 1) AND event_id % 2 = 1")
def extract_paths(spark, d):
    e = table(spark, d, "events")
    journal = e.select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("Session_ID"), F.concat(F.lit("q"), (F.col("event_id") % 2).cast("string")).alias("Query_ID"), F.col("event_type").alias("Source"), F.concat("event_type", F.lit(".csv")).alias("Output_file"))
    return source_paths(journal, "base", sessions=["s0", "s1"], queries=["q1"])


@query("SELECT user_id, event_type, event_id AS last_event_id, value AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def journal_upsert(spark, d):
    return latest(table(spark, d, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("last_event_id"), F.col("value").alias("last_value")), ["user_id", "event_type"], ["ts", "last_event_id"]).drop("ts")


@query(f"WITH {LABELS} SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'n' END, target) AS target FROM documents d LEFT JOIN lab USING (doc_id)")
def coalesce_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(labels(spark, d), "doc_id", "left")
    rows = rows.select("doc_id", F.when(F.col("toxic") == 1, "n").alias("Rev_prediction"), F.col("target").alias("Rev_manual"))
    return rows.select("doc_id", R.coalesce_labels(rows).alias("target"))


@query(rf"""
WITH {DOCS}, {LABELS}, k AS (SELECT doc_id, regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]+', '', 'g') AS uid FROM docs),
old AS (SELECT DISTINCT uid, target FROM k JOIN lab USING (doc_id))
SELECT doc_id, old.target AS rev_previous FROM k LEFT JOIN old ON k.uid = old.uid""")
def import_classification(spark, d):
    now = records(spark, d)
    before = now.join(labels(spark, d).select(F.col("doc_id").cast("string").alias("ID"), F.col("target").alias("Rev_manual")), "ID")
    return R.import_classification(now, before).select(F.col("ID").cast("long").alias("doc_id"), F.col("Rev_previous").alias("rev_previous"))


BOOLEAN = "(tion* AND (there OR elle)) AND (schlich OR ció*) NOT (when where) NOT other"
PATTERN = "|".join(R.query_terms(BOOLEAN))


@query(rf"""
WITH {DOCS}, s AS (SELECT doc_id, len(regexp_extract_all(title || ' ' || abstract, '{PATTERN}')) / (2 * len(regexp_extract_all(title || ' ' || abstract, '[\p{{L}}\p{{N}}_]+')) + 1) AS score FROM docs)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS ord FROM s""")
def query_match_rank(spark, d):
    docs = documents(spark, d)
    scored = docs.select("doc_id", R.query_score(F.concat_ws(" ", "title", "abstract"), BOOLEAN).alias("score"))
    return R.ranked(scored, [F.col("score").desc(), F.col("doc_id")], "ord").select("doc_id", "score", "ord")


@query(r"""
WITH f AS (SELECT DISTINCT 'S' || user_id % 2 || '/' || CASE WHEN event_id % 13 = 0 THEN 'Annotations.parquet' ELSE event_id % 13 || '.Annotations.parquet' END AS file FROM events),
i AS (SELECT file, coalesce(CAST(nullif(regexp_extract(file, '/(\d+)\.', 1), '') AS INTEGER), 0) AS iter FROM f)
SELECT file, iter, row_number() OVER (ORDER BY iter, file) AS pos FROM i""")
def session_files_order(spark, d):
    e = table(spark, d, "events")
    n = (F.col("event_id") % 13).cast("string")
    files = e.select(F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string"), F.lit("/"), F.when(n == "0", "Annotations.parquet").otherwise(F.concat(n, F.lit(".Annotations.parquet")))).alias("file")).distinct()
    return R.ranked(files.withColumn("iter", iteration_number(F.col("file"))), [F.col("iter"), F.col("file")], "pos").select("file", "iter", "pos")


# text


STOP_LIST = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@query(rf"""
WITH {DOCS}, a AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(lower(title), '-', '_'), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda x: CASE WHEN list_contains({STOP_LIST}, x) THEN '' ELSE x END), '') AS t FROM docs),
b AS (SELECT doc_id, replace(replace(regexp_replace(t, '''(s|re|t|d)\b', '', 'g'), '''', ''), '_', ' ') AS t FROM a)
SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g')), 'na') AS tokens FROM b""")
def tokenize_text(spark, d):
    return documents(spark, d).select("doc_id", T.tokenized_text(F.col("title")).alias("tokens"))


@query("SELECT doc_id, upper(source) || '_Tree_A_and_B ' || upper(source) || '_Tree_A_and_B.sh.' || lang || ' ' || upper(source) || '_Tree_A_and_B.sh.*use ' || lang || '_only' AS tokens FROM documents")
def tokenize_mesh(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.tokenized_mesh(F.concat(F.upper("source"), F.lit(" Tree, (A & B)/"), "lang", F.lit("/*use ; "), "lang", F.lit("-only"))).alias("tokens"))


@query("SELECT c_custkey, replace(n_name, ' ', '') || '_' || left(c_mktsegment, 1) || 'B Doe_JT' AS token FROM customer JOIN nation ON c_nationkey = n_nationkey")
def tokenize_authors(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", T.tokenized_authors(F.concat("n_name", F.lit(", "), "c_mktsegment", F.lit("  B.; Doe, John T"))).alias("token"))


LEMMAS = {"is": "be", "was": "be", "are": "be", "die": "der", "das": "der", "les": "le", "la": "le", "de": "du"}


@query(f"WITH {TOK}, lem(t, l) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in LEMMAS.items())}) SELECT DISTINCT doc_id, coalesce(l, term) AS lemma FROM tok LEFT JOIN lem ON t = term")
def lemma_lookup(spark, d):
    docs = table(spark, d, "documents")
    words = F.filter(F.split(F.lower("text"), T.NON_WORD), lambda x: x != "")
    return docs.select("doc_id", F.explode(F.array_distinct(T.lemmatised(words, LEMMAS))).alias("lemma"))


@query(f"WITH {TOK}, {LABELS}, f AS MATERIALIZED (SELECT term FROM tok JOIN lab USING (doc_id) GROUP BY term HAVING count(*) >= 20) SELECT doc_id, term, 1 AS val FROM tok WHERE term IN (SELECT term FROM f)")
def dtm_long(spark, d):
    docs = table(spark, d, "documents")
    seen = labels(spark, d).select(F.col("doc_id").alias("id"))
    return dtm.text_to_dtm(docs, "doc_id", F.regexp_replace(F.lower("text"), T.NON_WORD, " "), 20, freq_ids=seen).withColumnRenamed("id", "doc_id")


TEN = ["the", "and", "of", "to", "is", "de", "la", "le", "die", "und"]


@query(f"WITH {TOK} SELECT doc_id, {', '.join(f'CAST(max(CASE WHEN term = {t!r} THEN 1 ELSE 0 END) AS INTEGER) AS t_{t}' for t in TEN)} FROM tok GROUP BY doc_id")
def dtm_pivot(spark, d):
    return dtm.pivoted(tokens(spark, d), TEN).toDF("doc_id", *(f"t_{t}" for t in TEN))


@query(f"WITH {PAIRS} SELECT a, b, c, na, nb, round(c / sqrt(na * nb), 6) AS sim FROM pairs")
def cosine_pairs(spark, d):
    p = dtm.cosine_pairs(common_terms(spark, d), 9, 10)
    return p.select("a", "b", "c", "na", "nb", F.round(F.col("c") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("sim"))


GROUPS = PAIRS + ", e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT DISTINCT a, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.a), comp AS (SELECT a AS term, min(r) AS component FROM reach GROUP BY a)"


@query(f"WITH RECURSIVE {GROUPS} SELECT term, component FROM comp")
def synonym_components(spark, d):
    return dtm.synonym_components(common_terms(spark, d))


@query(f"WITH RECURSIVE {GROUPS}, n AS (SELECT component, string_agg(term, '.' ORDER BY term) AS name FROM comp GROUP BY component) SELECT doc_id, coalesce(name, dtm.term) AS term, max(1) AS val FROM dtm LEFT JOIN comp ON comp.term = dtm.term LEFT JOIN n USING (component) GROUP BY 1, 2")
def synonym_merge(spark, d):
    return dtm.merge_synonyms(common_terms(spark, d)).withColumnRenamed("id", "doc_id")


# cliques grow by a later term that all members know; those of ten or fewer that no term can join stay
CLIQUES = PAIRS.replace(">= 81 *", ">= 64 *") + """, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), near AS (SELECT a AS term, list(b) AS near FROM e GROUP BY a),
grown AS (SELECT [a, b] AS c FROM e WHERE a < b UNION ALL SELECT list_append(g.c, n.term) FROM grown g JOIN near n ON n.term > g.c[-1] AND list_has_all(n.near, g.c) WHERE len(g.c) < 10)"""


@query(f"WITH RECURSIVE {CLIQUES} SELECT array_to_string(c, '._.') AS clique, CAST(len(c) AS INTEGER) AS size FROM grown g WHERE NOT EXISTS (SELECT 1 FROM near n WHERE list_has_all(n.near, g.c))")
def ngram_cliques(spark, d):
    from winnow.storage import written

    edges = dtm.cosine_pairs(written(common_terms(spark, d), "terms"), 4, 5).select("a", "b")
    return dtm.maximal_cliques(edges).select(F.array_join("clique", "._.").alias("clique"), "size")


@query(f"WITH {PAIRS} SELECT x.doc_id, a || '._.' || b AS pair FROM pairs JOIN dtm x ON x.term = a JOIN dtm y ON y.term = b AND y.doc_id = x.doc_id")
def ngram_presence(spark, d):
    from winnow.storage import written

    terms = written(common_terms(spark, d), "terms")
    pairs = dtm.cosine_pairs(terms, 9, 10).select(F.array("a", "b").alias("clique"), F.lit(2).alias("size"))
    return dtm.ngram_presence(terms, pairs).select(F.col("id").alias("doc_id"), F.array_join("clique", "._.").alias("pair"))


def sql_count(column: str) -> str:
    return rf"len(list_distinct(list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')))"


@query(f"WITH {DOCS} SELECT doc_id, {sql_count('title')} AS title_n, {sql_count('abstract')} AS abstr_n FROM docs WHERE {sql_count('text')} > 0")
def feature_counts(spark, d):
    docs = documents(spark, d)
    words = lambda c: F.array_join(F.filter(F.split(F.lower(c), T.NON_WORD), lambda x: x != ""), " ")
    both = dtm.terms_of(docs, "doc_id", words("title")).withColumn("field", F.lit("TITLE")).unionByName(dtm.terms_of(docs, "doc_id", words("abstract")).withColumn("field", F.lit("ABSTR")))
    wide = dtm.feature_counts(both).groupBy("id").agg(*(F.coalesce(F.sum(F.when(F.col("field") == f, F.col("n"))), F.lit(0)).alias(n) for f, n in (("TITLE", "title_n"), ("ABSTR", "abstr_n"))))
    return wide.withColumnRenamed("id", "doc_id")


@query(f"""
WITH {TOK}, {LABELS}, m AS (SELECT greatest(CAST(floor(count(*) * 0.05) AS BIGINT), 1) AS least FROM lab)
SELECT term, CAST(sum(CASE WHEN target = 'y' THEN least ELSE 1 END) AS BIGINT) AS wdf FROM tok JOIN lab USING (doc_id) CROSS JOIN m GROUP BY term, least HAVING wdf >= least""")
def training_weights(spark, d):
    now = records(spark, d).join(labels(spark, d).select(F.col("doc_id").cast("string").alias("ID"), F.col("target").alias("Rev_manual")), "ID", "left")
    least, weights = dtm.training_frequency(now)
    counted = tokens(spark, d).join(weights.withColumn("id", F.col("id").cast("long")), "id")
    return counted.groupBy("term").agg(F.sum("w").cast("long").alias("wdf")).where(F.col("wdf") >= least)


@query(f"WITH {LABELS} SELECT doc_id, CAST(unnest(range(1, CASE WHEN target = 'y' THEN 11 ELSE 2 END)) AS INTEGER) AS copy FROM lab")
def oversample(spark, d):
    return decide.oversampled(labels(spark, d), F.col("target"), 10).select("doc_id", "copy")


@query(f"WITH {TOK}, lem(t, l) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in LEMMAS.items())}) SELECT doc_id, coalesce(l, term) AS term, max(1) AS val FROM tok LEFT JOIN lem ON t = term GROUP BY 1, 2")
def lemma_join(spark, d):
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "token string, lemma string")
    return dtm.lemmatised_terms(tokens(spark, d), lemmas).withColumnRenamed("id", "doc_id")


@query()
def training_set(spark, d):
    """The five field tables over labelled records: titles and abstracts of documents, sources as headings."""
    docs = documents(spark, d).join(labels(spark, d), "doc_id", "left")
    now = docs.select(F.col("doc_id").cast("string").alias("ID"), F.col("title").alias("Title"), F.col("abstract").alias("Abstract"), F.lit("Doe, John").alias("Authors"), F.concat_ws(";", "lang", "source").alias("Keywords"), F.concat("source", F.lit("/*"), "lang").alias("Mesh"), F.col("target").alias("Rev_manual"))
    return dtm.training_set(now, 0.05)


# decisions

DRAWS = "draws AS (SELECT doc_id, draw, ((doc_id * 37 + draw * 11) % 101 + 0.5::DOUBLE) / 102 / (1 + draw % 3) AS p FROM documents, range(20) t(draw))"
QUANTS = DRAWS + ", q AS (SELECT doc_id, quantile_cont(p, 0.05) AS pred_low, quantile_cont(p, 0.5) AS pred_med, quantile_cont(p, 0.95) AS pred_up FROM draws GROUP BY doc_id)"
ZONE = (
    f"{QUANTS}, {LABELS}, t AS (SELECT q.*, target, toxic FROM q LEFT JOIN lab USING (doc_id)), edge AS (SELECT max(pred_up) FILTER (target = 'n' AND doc_id % 7 = 0) AS neg, min(pred_low) FILTER (target = 'y' AND doc_id % 7 = 0) AS pos FROM t), "
    "z AS (SELECT t.*, CASE WHEN pred_low > neg AND pred_low > pos THEN 'y' WHEN pred_up < neg AND pred_up < pos THEN 'n' ELSE 'unk' END AS lab0 FROM t, edge), "
    "zone AS (SELECT *, CASE WHEN doc_id % 7 = 0 AND target IS NOT NULL AND lab0 <> target AND lab0 <> 'unk' THEN 'check' ELSE lab0 END AS predicted_label FROM z)"
)


def pseudo_draws(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("draw"))
    return docs.withColumn("p", ((F.col("id") * 37 + F.col("draw") * 11) % 101 + F.lit(0.5)) / 102 / (1 + F.col("draw") % 3))


def pseudo_zone(spark, d):
    preds = decide.posterior_quantiles(pseudo_draws(spark, d), (0.05, 0.5, 0.95))
    told = labels(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.col("target")).alias("target"), F.col("target").alias("rev_manual"), "toxic")
    return decide.uncertainty_zone(preds.join(told, "id", "left"))


@query(f"WITH {DRAWS} SELECT doc_id, draw % 5 AS draw, round(avg(p), 9) AS p FROM draws GROUP BY 1, 2")
def ensemble_mean(spark, d):
    members = pseudo_draws(spark, d).select("id", (F.col("draw") % 5).cast("long").alias("draw"), F.floor(F.col("draw") / 5).alias("model"), "p")
    return decide.ensemble_mean(members).select(F.col("id").alias("doc_id"), "draw", F.round("p", 9).alias("p"))


@query(f"WITH {QUANTS} SELECT doc_id, round(pred_low, 9) AS pred_low, round(pred_med, 9) AS pred_med, round(pred_up, 9) AS pred_up, round(pred_up - pred_low, 9) AS pred_delta FROM q")
def posterior_quantiles(spark, d):
    q = decide.posterior_quantiles(pseudo_draws(spark, d), (0.05, 0.5, 0.95))
    return q.select(F.col("id").alias("doc_id"), *(F.round(c, 9).alias(c) for c in ("pred_low", "pred_med", "pred_up", "pred_delta")))


@query(f"WITH {ZONE} SELECT doc_id, predicted_label FROM zone")
def uncertainty_zone(spark, d):
    return pseudo_zone(spark, d).select(F.col("id").alias("doc_id"), "predicted_label")


@query(f"""
WITH {ZONE} SELECT doc_id, CASE WHEN toxic = 1 OR predicted_label = 'n' OR (target IS NOT NULL AND predicted_label = target) THEN NULL ELSE coalesce(CASE WHEN doc_id % 5 = 0 THEN target END, '*') END AS rev_prediction_new FROM zone""")
def review_flags(spark, d):
    zone = pseudo_zone(spark, d).withColumns({"rev_prediction": F.when(F.col("toxic") == 1, "y"), "rev_previous": F.when(F.col("id") % 5 == 0, F.col("rev_manual"))})
    return decide.review_flags(zone).select(F.col("id").alias("doc_id"), "rev_prediction_new")


@query(f"WITH {LABELS} SELECT count(*) = count(target) AS all_labelled, count(*) FILTER (target = 'y') AS n_pos, count(target) / count(*) AS labelled_ratio FROM documents LEFT JOIN lab USING (doc_id)")
def stop_rules(spark, d):
    rows = table(spark, d, "documents").join(labels(spark, d), "doc_id", "left")
    return decide.stop_statistics(rows, F.col("target")).select("all_labelled", "n_pos", "labelled_ratio")


@query(f"""
WITH {LABELS}, c AS (SELECT coalesce(CASE WHEN doc_id % 3 > 0 THEN target END, 'unlab.') || ' -> ' || CASE WHEN toxic = 1 THEN 'n' ELSE target END AS change FROM lab), g AS (SELECT change, count(*) AS n FROM c GROUP BY change)
SELECT change, n, {sql_percent('n / sum(n) OVER ()')} AS pct FROM g""")
def compute_changes(spark, d):
    return decide.changes(labels(spark, d), F.when(F.col("doc_id") % 3 > 0, F.col("target")), F.when(F.col("toxic") == 1, "n").otherwise(F.col("target")))


# reports


@query(f"WITH g AS (SELECT CASE WHEN doc_id % 9 > 0 THEN lang END AS level, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM g) SELECT level, n, level || ': ' || n || ' (' || {sql_percent('n / total')} || ')' AS pct_text FROM t WHERE level IS NOT NULL")
def summarise_vector(spark, d):
    return reporting.summarise_vector(table(spark, d, "documents"), F.when(F.col("doc_id") % 9 > 0, F.col("lang")))


MULTI = "multi AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN [source] ELSE list_distinct([source, 'src1']) END AS s FROM documents)"


def multi_source(spark, d):
    docs = documents(spark, d)
    return docs.select("doc_id", T.title_key(F.col("title")).alias("ID"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat_ws("; ", "source", F.lit("src1"))).alias("Source"))


@query(f"""
WITH {MULTI}, e AS (SELECT unnest(s) AS source, len(s) = 1 AS own FROM (SELECT s FROM multi)), n AS (SELECT count(*) AS total FROM multi),
g AS (SELECT source, count(*) AS records, count(*) FILTER (own) AS source_specific FROM e GROUP BY source UNION ALL SELECT 'Total', count(*), count(*) FILTER (len(s) = 1) FROM multi)
SELECT source, records, {sql_percent('records / total')} AS perc, source_specific, {sql_percent('source_specific / records')} AS source_specific_perc FROM g, n""")
def summarise_by_source(spark, d):
    return reporting.summarise_by_source(multi_source(spark, d))


@query(f"""
WITH {DOCS}, r AS (SELECT doc_id % 3 AS session, {KEY.format('title')} AS id, source FROM docs), f AS (SELECT id, min((session, source)) AS m FROM r GROUP BY id)
SELECT m[1] AS session, m[2] AS source, count(*) AS records FROM f GROUP BY 1, 2""")
def sources_by_session(spark, d):
    docs = documents(spark, d).select("doc_id", T.title_key(F.col("title")).alias("ID"), F.col("source").alias("Source"))
    return reporting.sources_by_session(docs, F.col("doc_id") % 3)


@query(f"""
WITH {DOCS}, {MULTI}, r AS (SELECT doc_id % 3 AS session, {KEY.format('title')} AS id, s FROM docs JOIN multi USING (doc_id)), f AS (SELECT id, min(session) AS first FROM r GROUP BY id),
n AS (SELECT CAST(session AS VARCHAR) AS session, s FROM r JOIN f ON r.id IS NOT DISTINCT FROM f.id AND session = first UNION ALL SELECT 'All Sessions', s FROM r WHERE session = (SELECT max(session) FROM r)),
t AS (SELECT session, count(*) AS total FROM n GROUP BY session), e AS (SELECT session, len(s) = 1 AS own, unnest(s) AS source FROM n),
g AS (SELECT session, source, count(*) AS records, count(*) FILTER (own) AS source_specific FROM e GROUP BY 1, 2)
SELECT session, source, records, {sql_percent('records / total')} AS perc, source_specific, {sql_percent('source_specific / records')} AS source_specific_perc FROM g JOIN t USING (session) UNION ALL SELECT session, 'Total', total, NULL, NULL, NULL FROM t""")
def session_source_summary(spark, d):
    docs = multi_source(spark, d)
    return reporting.session_source_summary(docs, F.col("doc_id") % 3)


@query(f"WITH {MULTI} SELECT CAST(len(s) AS INTEGER) AS n_sources, count(*) AS n_records, count(*) / (SELECT count(*) FROM multi) AS prop FROM multi GROUP BY 1")
def source_distribution(spark, d):
    return reporting.source_distribution(multi_source(spark, d))


INDICATORS = ["Target: y", "Target: n", "Change: unlab. -> y", "Change: unlab. -> n", "Change: y -> n", "Change: n -> y", "N. features", "Note"]


@query(f"""
WITH v AS (SELECT CAST(user_id % 4 + 1 AS INTEGER) AS iter, CAST(event_id % 8 AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT iter, {', '.join(f'CAST(coalesce(max(n) FILTER (k = {i}), 0) AS BIGINT) AS k{i}' for i in range(8))} FROM v GROUP BY iter),
o AS (SELECT iter, k0, k1, k2, k3, k4, k5, k6 FROM w UNION ALL SELECT 0, k4, k5, k4, k5, 0, 0, 0 FROM w WHERE iter = (SELECT min(iter) FROM w))
SELECT iter AS iteration, k0 AS positives, k1 AS negatives, k0 + k1 AS total, k2 + k3 + k4 + k5 AS changes, k6 AS n_features FROM o""")
def iteration_summary(spark, d):
    names = F.array(*map(F.lit, INDICATORS))
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 4 + 1).cast("int").alias("iter"), F.get(names, (F.col("event_id") % 8).cast("int")).alias("Indicator")).agg(F.count("*").alias("n"))
    results = counts.select("iter", "Indicator", F.when(F.col("Indicator") == "Note", "text").otherwise(F.col("n").cast("string")).alias("Value"))
    return reporting.iteration_summary(results).select("iteration", "positives", "negatives", "total", "changes", "n_features")


@query("""
WITH v AS (SELECT CAST(event_id % 3 AS INTEGER) AS session, CAST(user_id % 4 + 1 AS INTEGER) AS iter, count(*) FILTER (event_id % 8 = 0) AS pos, count(*) FILTER (event_id % 8 = 4) AS yn FROM events GROUP BY 1, 2)
SELECT session, iter AS iteration, pos AS positives FROM v UNION ALL SELECT 0, 0, yn FROM v WHERE session = 0 AND iter = (SELECT min(iter) FROM v WHERE session = 0)""")
def iterations_by_session(spark, d):
    names = F.array(*map(F.lit, INDICATORS))
    rows = table(spark, d, "events").groupBy((F.col("event_id") % 3).cast("int").alias("session"), (F.col("user_id") % 4 + 1).cast("int").alias("iter"), F.get(names, (F.col("event_id") % 8).cast("int")).alias("Indicator")).agg(F.count("*").cast("string").alias("Value"))
    return reporting.iteration_summary_by_session(rows).select("session", "iteration", "positives")


@query(f"""
WITH {LABELS}, r AS (SELECT target, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM lab), b AS (SELECT *, CAST(ceil(r / 20) * 20 AS BIGINT) AS bin FROM r)
SELECT DISTINCT least(bin, n) AS step, count(*) FILTER (target = 'y') OVER (ORDER BY bin) AS yes, count(*) FILTER (target = 'n') OVER (ORDER BY bin) AS no FROM b""")
def classification_trend(spark, d):
    return reporting.classification_trend(labels(spark, d).select(F.col("doc_id").alias("Order"), "target"), F.col("target"))


@query(f"WITH {DRAWS}, {LABELS} SELECT target AS label, CAST(least(greatest(floor((ln(p / (1 - p)) + 10) / 20 * 20), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM draws JOIN lab USING (doc_id) GROUP BY 1, 2")
def predictive_density(spark, d):
    return reporting.predictive_density(pseudo_draws(spark, d), labels(spark, d).select(F.col("doc_id").alias("id"), F.col("target").alias("label")))


SAMPLED = (
    f"{DRAWS}, {LABELS}, o AS (SELECT target AS label, doc_id, draw, p, row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws(':', '1', CAST(doc_id AS VARCHAR), CAST(draw AS VARCHAR)))) AS r FROM draws JOIN lab USING (doc_id)),"
    " x AS (SELECT label, ln(p / (1 - p)) AS x FROM o WHERE r <= 2000),"
    " f0 AS (SELECT label, count(*) AS n, min(x) AS least, max(x) AS most, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM x GROUP BY label),"
    " f1 AS (SELECT *, CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END * 0.9 * pow(n, -0.2) AS bw FROM f0),"
    " f AS (SELECT label, n, bw, least - 3 * bw AS low, (most - least + 6 * bw) / 511 AS step FROM f1),"
    " a AS (SELECT label, (x - low) / step AS at_ FROM x JOIN f USING (label)), k AS (SELECT label, at_, CAST(least(floor(at_), 510) AS INTEGER) AS k FROM a),"
    " b AS (SELECT label, k, sum(w) AS w FROM (SELECT label, k, 1 - (at_ - k) AS w FROM k UNION ALL SELECT label, k + 1, at_ - k FROM k) GROUP BY label, k)"
)


@query(f"""
WITH {SAMPLED} SELECT label, g.place, round(1 / (1 + exp(-(any_value(low) + g.place * any_value(step)))), 9) AS prob,
  round(sum(w * exp(-pow((g.place - k) * step / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 9) AS dens
FROM b JOIN f USING (label), (SELECT CAST(i AS INTEGER) AS place FROM range(512) t(i)) g GROUP BY label, g.place""")
def kernel_densities(spark, d):
    """Densities of 2,000 sampled draws a label; the sample is the feature."""
    told = labels(spark, d).select(F.col("doc_id").alias("id"), F.col("target").alias("label"))
    some = reporting.sampled_draws(pseudo_draws(spark, d).join(told, "id"), ["label"], 2000)
    return reporting.kernel_densities(some, ["label"]).select("label", "place", F.round("prob", 9).alias("prob"), F.round("dens", 9).alias("dens"))


@query(f"""
WITH {DRAWS}, {LABELS}, a AS (SELECT doc_id, it.iter, CASE WHEN doc_id % 3 > 0 THEN target END AS manual, CASE WHEN doc_id % 5 = 0 THEN target END AS new, doc_id % 97 / 100 AS low, doc_id % 89 / 90 AS up FROM lab, (SELECT unnest([1, 2]) AS iter) it),
t AS (SELECT iter AS came, iter AS iteration, doc_id, CASE WHEN new IS NOT NULL THEN '*' ELSE manual END AS label, low, up FROM a UNION ALL SELECT 2, 3, doc_id, coalesce(new, manual), low, up FROM a WHERE iter = 2),
l AS (SELECT iteration, max(up) FILTER (label = 'n') AS neg_lim, min(low) FILTER (label = 'y') AS pos_lim FROM t GROUP BY iteration)
SELECT CAST(iteration AS INTEGER) AS iteration, label, CAST(least(greatest(floor((ln(p / (1 - p)) + 10) / 20 * 20), 0), 19) AS INTEGER) AS bin, count(*) AS n, any_value(neg_lim) AS neg_lim, any_value(pos_lim) AS pos_lim
FROM t JOIN draws USING (doc_id) JOIN l USING (iteration) WHERE label IS NOT NULL GROUP BY 1, 2, 3""")
def densities_by_iteration(spark, d):
    iters = F.explode(F.array(F.lit(1), F.lit(2))).alias("iter")
    manual, new = F.when(F.col("doc_id") % 3 > 0, F.col("target")), F.when(F.col("doc_id") % 5 == 0, F.col("target"))
    annotations = labels(spark, d).select(F.col("doc_id").alias("ID"), iters, manual.alias("Rev_manual"), new.alias("Rev_prediction_new"), (F.col("doc_id") % 97 / 100).alias("Pred_Low"), (F.col("doc_id") % 89 / 90).alias("Pred_Up"))
    return reporting.densities_by_iteration(annotations, pseudo_draws(spark, d).select("*", iters))


# rules

RULES = {"r1": [("the", 1), ("of", 1)], "r2": [("the", 1), ("is", 0)], "r3": [("le", 1), ("la", 1), ("the", 0)], "r4": [("die", 1)], "r5": [("de", 1), ("les", 1), ("y", 0)], "r6": [("the", 1), ("of", 1), ("and", 0)]}
RULE_TEXTS = [rules.rule_text(r) for r in RULES.values()]


def _exists(term: str, want: int) -> str:
    return f"{'' if want else 'NOT '}EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = lab.doc_id AND t.term = '{term}')"


RULE_HITS = f"{TOK}, {LABELS}, hits AS (" + " UNION ALL ".join(f"SELECT '{rules.rule_text(r)}' AS rule, {len(r)} AS size, doc_id, target FROM lab WHERE {' AND '.join(_exists(*x) for x in r)}" for r in RULES.values()) + ")"
RULE_SCORES = RULE_HITS + ", rs AS (SELECT rule, any_value(size) AS size, count(*) FILTER (target = 'y') AS pos, count(*) FILTER (target = 'n') AS neg FROM hits GROUP BY rule), ranked AS (SELECT *, pos - neg AS score, CAST(row_number() OVER (ORDER BY pos - neg DESC, size, rule) AS INTEGER) AS rnk FROM rs)"
RULE_CUM = RULE_SCORES + ", first AS (SELECT doc_id, any_value(target) AS target, min(rnk) AS rnk FROM hits JOIN ranked USING (rule) GROUP BY doc_id), cum AS (SELECT r.rule, r.pos, r.neg, r.score, r.rnk, count(*) FILTER (f.target = 'y') AS cum_pos, count(*) FILTER (f.target = 'n') AS cum_neg FROM ranked r LEFT JOIN first f ON f.rnk <= r.rnk GROUP BY ALL)"


def rule_tables(spark, d):
    return rules.rules_frame(spark, RULE_TEXTS), tokens(spark, d), labels(spark, d).select(F.col("doc_id").alias("id"), "target")


@query(f"WITH {RULE_SCORES} SELECT rule, pos, neg, score FROM ranked")
def rule_eval(spark, d):
    return rules.rule_scores(*rule_tables(spark, d))


@query(f"WITH {RULE_CUM} SELECT rule, rnk, cum_pos, cum_neg FROM cum")
def rule_cumulative(spark, d):
    return rules.cumulative(*rule_tables(spark, d)).select("rule", "rnk", "cum_pos", "cum_neg")


@query(f"WITH {RULE_CUM} SELECT rule, cum_pos, row_number() OVER (PARTITION BY cum_pos ORDER BY rnk) = 1 AS selected_rule FROM cum")
def rule_selection(spark, d):
    return rules.selection(*rule_tables(spark, d)).select("rule", "cum_pos", "selected_rule")


@query(rf"""
WITH {RULE_HITS}, g AS (SELECT rule, term, count(*) FILTER (target = 'y') AS p, count(*) FILTER (target = 'n') AS neg FROM hits JOIN tok USING (doc_id) WHERE NOT regexp_full_match(term, '\d+|[\p{{L}}\p{{N}}_]{{1,3}}') GROUP BY 1, 2)
SELECT rule, term, neg FROM g WHERE p = 0 AND neg > 0""")
def negative_candidates(spark, d):
    return rules.negative_candidates(*rule_tables(spark, d))


@query(f"""
WITH {COMMON}, i AS (SELECT term, count(*) % 100 / 40.0 AS score FROM dtm GROUP BY term), f AS (SELECT DISTINCT doc_id, term FROM dtm JOIN i USING (term) WHERE score > 1.25), n AS (SELECT count(DISTINCT doc_id) AS n FROM dtm)
SELECT doc_id, term FROM f WHERE term IN (SELECT term FROM f, n GROUP BY term, n HAVING count(*) < n)""")
def important_presence(spark, d):
    from winnow.storage import written

    terms = written(common_terms(spark, d), "terms")
    importance = terms.groupBy("term").agg((F.count("*") % 100 / 40.0).alias("score"))
    return rules.important_presence(terms, importance).select(F.col("id").alias("doc_id"), "term")


# the greedy choice: what a rule's step leaves of its negatives goes on to the next step
GREEDY = rf"""{RULE_HITS}, cand AS (SELECT rule, term, list(doc_id) AS docs FROM hits JOIN tok USING (doc_id) WHERE NOT regexp_full_match(term, '\d+|[\p{{L}}\p{{N}}_]{{1,3}}') GROUP BY 1, 2 HAVING count(*) FILTER (target = 'y') = 0),
cover AS (SELECT rule, 0 AS step, '' AS term, list(doc_id) AS left_, CAST([] AS BIGINT[]) AS out_ FROM (SELECT DISTINCT rule, unnest(docs) AS doc_id FROM cand) GROUP BY rule UNION ALL
SELECT rule, step, term, left_, out_ FROM (SELECT v.rule, v.step + 1 AS step, c.term, list_filter(v.left_, lambda x: NOT list_contains(c.docs, x)) AS left_, list_concat(v.out_, list_intersect(c.docs, v.left_)) AS out_,
row_number() OVER (PARTITION BY v.rule ORDER BY len(list_intersect(c.docs, v.left_)) DESC, c.term) AS place FROM cover v JOIN cand c ON c.rule = v.rule WHERE len(v.left_) > 0 AND list_has_any(c.docs, v.left_)) WHERE place = 1)"""


@query(f"WITH RECURSIVE {GREEDY} SELECT rule, CAST(step AS INTEGER) AS step, term FROM cover WHERE step > 0")
def negative_greedy(spark, d):
    return rules.negative_terms(*rule_tables(spark, d))


CHAINED = GREEDY + """, chain AS (SELECT v.rule AS base, v.step, v.rule || coalesce(string_agg(' & V__' || w.term || ' %in% "0"', '' ORDER BY w.step), '') AS rule, any_value(v.out_) AS out_ FROM cover v LEFT JOIN cover w ON w.rule = v.rule AND w.step BETWEEN 1 AND v.step GROUP BY v.rule, v.step),
more AS (SELECT c.rule, h.size + c.step AS size, h.doc_id, h.target FROM chain c JOIN hits h ON h.rule = c.base WHERE c.step = 0 OR NOT list_contains(c.out_, h.doc_id)
UNION ALL SELECT rule, size, doc_id, target FROM hits WHERE rule NOT IN (SELECT base FROM chain))"""


@query(f"WITH RECURSIVE {CHAINED}{RULE_CUM.removeprefix(RULE_HITS).replace('hits', 'more')} SELECT *, row_number() OVER (PARTITION BY cum_pos ORDER BY rnk) = 1 AS selected_rule FROM cum")
def selection_with_negatives(spark, d):
    """Rules with their negative chains, scored and selected."""
    from winnow.storage import written

    base, presence, targets = rule_tables(spark, d)
    presence = written(presence, "presence")
    chosen = written(rules.negative_terms(base, presence, targets), "negative_terms")
    return rules.selection_with_negatives(base, chosen, presence, targets)


@query()
def simplify_rules(spark, d):
    base, presence, targets = rule_tables(spark, d)
    return rules.simplified(base.select("rule"), presence, targets)


def _query_sql(r) -> str:
    return rules.rules_to_query([rules.rule_text(r)])[1:-1].replace("'", "''")


@query(" UNION ALL ".join(f"SELECT '{rules.rule_text(r)}' AS rule, '{_query_sql(r)}' AS query" for r in RULES.values()))
def rules_to_query(spark, d):
    return rules.rules_frame(spark, RULE_TEXTS).select("rule", rules.query_column(F.col("lits")).alias("query"))


# models


@query(f"""
WITH {COMMON}, {LABELS}, y AS (SELECT doc_id, CASE WHEN target = 'y' THEN 1 ELSE 0 END AS y FROM lab), n AS (SELECT count(*) AS n, sum(y) AS pos FROM y),
h AS (SELECT term, count(*) AS n1, sum(y) AS y1 FROM dtm JOIN y USING (doc_id) GROUP BY term), c AS (SELECT *, n - n1 AS n0, pos - y1 AS y0 FROM h, n)
SELECT term, round(ln((y1 / n1) / (y0 / n0)), 6) AS estimate, round(ln((y1 / n1) / (y0 / n0)) / sqrt(1 / y1 + 1 / y0), 6) AS statistic FROM c WHERE y1 > 0 AND y0 > 0 AND n0 > 0""")
def var_imp_poisson(spark, d):
    y = labels(spark, d).select(F.col("doc_id").alias("id"), (F.col("target") == "y").cast("int").alias("y"))
    out = decide.poisson_importance(common_terms(spark, d), y)
    return out.select("term", F.round("estimate", 6).alias("estimate"), F.round("statistic", 6).alias("statistic"))


@query(f"""
WITH {COMMON}, {LABELS}, i AS (SELECT term, count(*) / 1000.0 AS value, count(*) % 100 / 40.0 AS score FROM dtm GROUP BY term), w AS (SELECT * FROM i WHERE score > 1.5 ORDER BY value DESC, term LIMIT 15),
y AS (SELECT doc_id, CASE WHEN coalesce(target, 'n') = 'y' THEN 1 ELSE 0 END AS y FROM documents LEFT JOIN lab USING (doc_id)), n AS (SELECT count(*) AS n, sum(y) AS pos FROM y),
h AS (SELECT term, count(*) AS n1, sum(y) AS y1 FROM dtm JOIN y USING (doc_id) WHERE term IN (SELECT term FROM w) GROUP BY term), c AS (SELECT *, n - n1 AS n0, pos - y1 AS y0 FROM h, n),
p AS (SELECT term, ln((y1 / n1) / (y0 / n0)) AS estimate, ln((y1 / n1) / (y0 / n0)) / sqrt(1 / y1 + 1 / y0) AS statistic FROM c WHERE y1 > 0 AND y0 > 0 AND n0 > 0)
SELECT term, round(CAST(value AS DOUBLE), 6) AS value, round(CAST(score AS DOUBLE), 6) AS score, round(estimate, 6) AS estimate, round(statistic, 6) AS statistic FROM w LEFT JOIN p USING (term)""")
def var_imp_extracted(spark, d):
    from winnow.storage import written

    terms = written(common_terms(spark, d), "terms")
    importance = terms.groupBy("term").agg((F.count("*") / 1000.0).alias("value"), (F.count("*") % 100 / 40.0).alias("score"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ID")).join(labels(spark, d).select(F.col("doc_id").alias("ID"), F.col("target").alias("Rev_manual")), "ID", "left")
    out = decide.extract_importance(importance, terms, rows)
    return out.select("term", *(F.round(c, 6).alias(c) for c in ("value", "score", "estimate", "statistic")))


@query("WITH p AS (SELECT l_partkey % 50 AS term, l_suppkey % 10 AS model, avg(l_discount) AS prop FROM lineitem GROUP BY 1, 2) SELECT term, round(avg(prop), 9) AS value, round(avg(prop) / stddev_samp(prop), 6) AS score, count(*) AS n_models FROM p GROUP BY term")
def var_imp_score(spark, d):
    props = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("term"), (F.col("l_suppkey") % 10).alias("model")).agg(F.avg("l_discount").alias("prop"))
    return decide.importance(props).select("term", F.round("value", 9).alias("value"), F.round("score", 6).alias("score"), "n_models")


@query("""
SELECT 'GridSession.' || m || 'Mods.' || CASE WHEN r THEN 'y' ELSE 'n' END || 'Resamp.' || i || 'Init.' || p || 'Mult.' || w || 'Quant' AS session, r AS resample, i AS n_init, m AS n_models, p AS pos_mult, w AS quant
FROM (SELECT unnest([false, true]) AS r), (SELECT unnest([50, 100, 250, 500]) AS i), (SELECT unnest([1, 5, 10, 20, 40, 60]) AS m), (SELECT unnest([1, 10, 20]) AS p), (SELECT unnest([80, 90, 98]) AS w)""")
def param_grid(spark, d):
    g = perf.parameter_grid(spark)
    return g.select("session", "resample", "n_init", "n_models", "pos_mult", F.round((F.get("quant", 2) - F.get("quant", 0)) * 100).cast("int").alias("quant"))


GRID_SQL = """
i AS (SELECT 'GridSession.' || user_id % 5 || 'Mods.' || CASE WHEN user_id % 2 = 0 THEN 'y' ELSE 'n' END || 'Resamp.' || user_id % 3 || 'Init.1Mult.90Quant' AS session, event_id % 12 AS iter, count(*) AS tot_labeled, count(*) FILTER (value > 50) AS pos_labels FROM events GROUP BY 1, 2),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY iter DESC) AS r FROM i) WHERE r = 1),
s AS (SELECT session, pos_labels / tot_labeled AS pos_rate, pos_labels / 5000 AS sensitivity, 1 - tot_labeled / 10000 AS efficiency, pos_labels / 5000 * (1 - tot_labeled / 10000) AS score FROM l)"""


def grid_table(spark, d):
    u = F.col("user_id")
    name = F.concat(F.lit("GridSession."), (u % 5).cast("string"), F.lit("Mods."), F.when(u % 2 == 0, "y").otherwise("n"), F.lit("Resamp."), (u % 3).cast("string"), F.lit("Init.1Mult.90Quant"))
    rows = table(spark, d, "events").groupBy(name.alias("session"), (F.col("event_id") % 12).alias("iter")).agg(F.count("*").alias("tot_labeled"), F.count_if(F.col("value") > 50).alias("pos_labels"))
    return perf.grid_scores(rows, 5000, 10000)


@query(f"WITH {GRID_SQL} SELECT session, round(pos_rate, 9) AS pos_rate, round(sensitivity, 9) AS sensitivity, round(efficiency, 9) AS efficiency, round(score, 9) AS score FROM s")
def grid_scores(spark, d):
    return grid_table(spark, d).select("session", *(F.round(c, 9).alias(c) for c in ("pos_rate", "sensitivity", "efficiency", "score")))


@query(rf"WITH {GRID_SQL} SELECT cluster, session FROM (SELECT regexp_extract(session, '([yn])Resamp', 1) AS cluster, session, row_number() OVER (PARTITION BY cluster ORDER BY sensitivity DESC, efficiency DESC, session DESC) AS r FROM s) WHERE r = 1")
def grid_best(spark, d):
    scores = grid_table(spark, d)
    return perf.best_by_cluster(scores.withColumn("cluster", perf.session_parameters(F.col("session"))["resamp"])).select("cluster", "session")


@query()
def grid_clusters(spark, d):
    scores = grid_table(spark, d)
    return perf.grid_clusters(scores.withColumns(perf.session_parameters(F.col("session"))), least=3).select("session", "cluster", "rule")


@query(f"WITH {LABELS} SELECT count(*) FILTER (target = 'y') AS obs_positives, count(target) AS n_reviewed, count(*) AS total_records FROM documents LEFT JOIN lab USING (doc_id)")
def performance_obs(spark, d):
    rows = table(spark, d, "documents").join(labels(spark, d), "doc_id", "left")
    return decide.stop_statistics(rows, F.col("target")).select(F.col("n_pos").alias("obs_positives"), F.col("n_labelled").alias("n_reviewed"), F.col("n_records").alias("total_records"))


# Newton's steps, one relation each; the prior is that of the operator
NEWTON = (
    f"WITH {ZONE}, r AS (SELECT pred_low AS x, (target = 'y')::INT AS y FROM q JOIN lab USING (doc_id)), m AS (SELECT avg(x) AS mean FROM r), d AS (SELECT x - mean AS x, y FROM r, m), s0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
    + "".join(
        f", e{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) - 4 * any_value(a) / (18.75 + any_value(a) ** 2) AS ga, sum((y - p) * x) - 4 * any_value(b) / (6.75 + any_value(b) ** 2) AS gb,"
        f" sum(p * (1 - p)) + 4 / (18.75 + any_value(a) ** 2) AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p) * x * x) + 4 / (6.75 + any_value(b) ** 2) AS hbb"
        f" FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM d, s{i})),"
        f" s{i + 1} AS (SELECT a + greatest(least((hbb * ga - hab * gb) / (haa * hbb - hab * hab), 2), -2) AS a, b + greatest(least((haa * gb - hab * ga) / (haa * hbb - hab * hab), 2), -2) AS b FROM e{i})"
        for i in range(12)
    )
    + " SELECT round(a - b * mean, 6) AS intercept, round(b, 6) AS slope FROM s12, m"
)


@query(NEWTON)
def positivity_mode(spark, d):
    """The surrogate model's mode over all labelled records."""
    rows = decide.posterior_quantiles(pseudo_draws(spark, d), (0.05, 0.5, 0.95)).join(labels(spark, d), F.col("id") == F.col("doc_id"))
    (at_mean, slope), _, mean = perf.positivity_mode(rows.select(F.col("pred_low").alias("x"), (F.col("target") == "y").cast("int").alias("y")), 12)
    return spark.createDataFrame([(round(float(at_mean - slope * mean), 6), round(float(slope), 6))], "intercept double, slope double")


@query()
def performance_sim(spark, d):
    zone = pseudo_zone(spark, d)
    return perf.performance(zone, F.col("rev_manual"), "pred_low")


@query()
def cumulative_bands(spark, d):
    docs = table(spark, d, "documents").join(labels(spark, d), "doc_id", "left").select((F.col("doc_id") + 1).alias("Order"), F.col("doc_id").alias("ID"), "target")
    return perf.cumulative_bands(docs, F.col("target"), F.lit(0.3))


@query()
def bart_ensemble(spark, d):
    """The ensemble of the review loop, by its default settings, on all common terms: it trains on the
    labelled documents and predicts all; the mean probability of each."""
    from winnow.plans.review import Settings

    told = labels(spark, d).select(F.col("doc_id").alias("id"), "target")
    own = Settings()
    draws, _ = bart.ensemble(common_terms(spark, d), told, own.n_models, own.resample, own.pos_mult, own.seed, **own.learner)
    return draws.select("id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p"), 6).alias("p"))


@query(f"WITH {QUANTS} SELECT doc_id, round(pred_low, 9) AS pred_low, round(pred_med, 9) AS pred_med, round(pred_up, 9) AS pred_up FROM q")
def array_quantiles(spark, d):
    arrays = pseudo_draws(spark, d).groupBy("id").agg(F.collect_list("p").alias("p"))
    return decide.array_quantiles(arrays, (0.05, 0.5, 0.95)).select(F.col("id").alias("doc_id"), *(F.round(c, 9).alias(c) for c in ("pred_low", "pred_med", "pred_up")))


@query(f"""
WITH {COMMON}, {DRAWS}, t AS (SELECT draw, sum(p) AS s, count(*) AS n FROM draws GROUP BY draw), c AS (SELECT draw, term, sum(p) AS s1, count(*) AS n1 FROM draws JOIN dtm USING (doc_id) GROUP BY draw, term),
g AS (SELECT draw, term, round(s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) - s * s / n, 9) AS gain FROM c JOIN t USING (draw) WHERE n1 >= 5 AND n - n1 >= 5 AND n >= 10),
b AS (SELECT draw, term FROM g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY draw ORDER BY gain DESC, term) = 1)
SELECT 'V__' || term || ' %in% "' || w || '"' AS rule, count(*) AS n FROM b, (VALUES ('0'), ('1')) v(w) GROUP BY 1""")
def tree_first_rules(spark, d):
    """The first split of one regression tree a draw, on all common terms."""
    return bart.extract_rules(pseudo_draws(spark, d), common_terms(spark, d).select("id", "term"), depth=1)


@query()
def tree_rules(spark, d):
    """Node rules of one regression tree a draw, on all common terms."""
    return bart.extract_rules(pseudo_draws(spark, d), common_terms(spark, d).select("id", "term"))


# sources


@query("""
WITH p AS (SELECT conv_id, string_agg(role, '; ' ORDER BY turn) AS roles FROM conversations WHERE turn % 2 = 1 GROUP BY conv_id)
SELECT DISTINCT CAST(conv_id AS VARCHAR) AS ut, roles FROM conversations LEFT JOIN p USING (conv_id)""")
def wos_join(spark, d):
    told = table(spark, d, "conversations").withColumn("ut", F.col("conv_id").cast("string"))
    part = told.where("turn % 2 = 1").select("ut", F.col("turn").cast("int").alias("position"), F.col("role").alias("value"))
    return wos_records(told.select("ut").distinct(), {"roles": part})


@query("""
SELECT 'u' || doc_id AS url, CASE WHEN lang < 'x' THEN lang || ';x' ELSE 'x;' || lang END AS Keywords, CASE WHEN doc_id % 3 = 0 THEN 'Humans' END AS Mesh,
  CASE WHEN source < 'b' THEN source || ';b' WHEN source = 'b' THEN 'b' ELSE 'b;' || source END AS Author_keywords FROM documents""")
def json_keywords(spark, d):
    """Keyword groups of articles' metadata, made of each document's columns."""
    group = lambda kind, *words: F.struct(F.lit(kind).alias("type"), F.array(*words).alias("kwd"))
    base = F.array(group("IEEE Terms", F.col("lang")), group("INSPEC: Terms", F.lit("x"), F.col("lang")), group("Author Keywords", F.col("source"), F.lit("b")))
    mesh = F.array(group("MeSH Terms", F.lit("Humans")))
    docs = table(spark, d, "documents").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, F.concat(base, mesh)).otherwise(base).alias("keywords"))).alias("json"))
    return search.ieee_keywords(docs)


@query("SELECT page_id, url AS body FROM pages")
def website_bodies(spark, d):
    """Captured bodies, half of them in base64, decoded."""
    odd = F.col("page_id") % 2 == 1
    pages = table(spark, d, "pages").select("page_id", odd.alias("coded"), F.when(odd, F.base64(F.encode("url", "UTF-8"))).otherwise(F.col("url")).alias("raw"))
    return pages.select("page_id", search.decoded_resource(F.col("raw"), F.col("coded")).alias("body"))


@query("""
WITH j AS (SELECT 's' || user_id % 5 AS session, 'q' || event_id % 2 AS query, event_type AS source, lpad(CAST(event_id AS VARCHAR), 9, '0') AS stamp, CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS VARCHAR) END AS n FROM events)
SELECT session, query, source, max(stamp) AS stamp, arg_max(n, stamp) FILTER (n IS NOT NULL) AS n_results FROM j GROUP BY ALL""")
def journal_latest_values(spark, d):
    """A journal brought up to date: the latest known value of each column."""
    text = lambda x: F.col(x).cast("string")
    rows = table(spark, d, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("Session_ID"), F.concat(F.lit("q"), (F.col("event_id") % 2).cast("string")).alias("Query_ID"), F.col("event_type").alias("Source"), F.lit("API").alias("Type"),
        F.lit("out.csv").alias("Output_file"), F.lpad(text("event_id"), 9, "0").alias("Timestamp"), F.when(F.col("event_id") % 3 > 0, text("event_id")).alias("N_results"), "event_id",
    )
    old, new = (rows.where(f"event_id % 4 {x} 2").drop("event_id") for x in ("<", ">="))
    return search.upserted(old, new).select(F.col("Session_ID").alias("session"), F.col("Query_ID").alias("query"), F.col("Source").alias("source"), F.col("Timestamp").alias("stamp"), F.col("N_results").alias("n_results"))


def export(spark, d, columns: dict) -> DataFrame:
    """A tabular export made of the documents' columns."""
    docs = table(spark, d, "documents").withColumn("id", F.col("doc_id").cast("string"))
    return docs.select(*(v.alias(k) for k, v in columns.items()))


def parsed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c.lower()) for c in columns))


@query("SELECT 'WOS:' || doc_id AS id, 'Study of ' || source AS title, 'Roe, Jane;Doe, John T' AS authors, CAST(n_chars % 50 AS INTEGER) AS n_citations, CASE WHEN doc_id % 2 = 0 THEN 'MAY 1 ' ELSE '' END || '2019' AS published, 'WOS' AS source FROM documents")
def parse_wos_table(spark, d):
    rows = export(spark, d, {
        "UT (Unique WOS ID)": F.concat(F.lit("WOS:"), "id"), "Article Title": F.concat(F.lit(" Study  of "), "source"), "Author Full Names": F.lit("Roe, Jane; Doe, John T"), "Times Cited, All Databases": (F.col("n_chars") % 50).cast("string"),
        "Publication Date": F.when(F.col("doc_id") % 2 == 0, "MAY 1"), "Publication Year": F.lit("2019"),
    })
    return parsed(parsers.parse_wos(rows), "ID", "Title", "Authors", "N_citations", "Published", "Source")


@query("SELECT 'IEEE:' || doc_id AS id, 'https://x.org/document/' || doc_id AS url, 'Journals' AS article_type, source || ';' || lang || CASE WHEN doc_id % 2 = 0 THEN ';c' ELSE '' END AS keywords, 'IEEE' AS source FROM documents")
def parse_ieee_table(spark, d):
    rows = export(spark, d, {
        "PDF Link": F.concat(F.lit("https://x.org/document/"), "id"), "Document Title": F.lit("T"), "Document Identifier": F.lit("IEEE Journals"), "IEEE Terms": F.col("source"), "INSPEC Controlled Terms": F.col("lang"),
        "INSPEC Non-Controlled Terms": F.when(F.col("doc_id") % 2 == 0, "c"),
    })
    return parsed(parsers.parse_ieee(rows), "ID", "URL", "Article_type", "Keywords", "Source")


@query("SELECT 'EM:' || doc_id AS id, 'Last, A;Other, B C' AS authors, source || ' word' AS keywords, lang || ';b' AS author_keywords, 'Embase' AS source FROM documents")
def parse_embase_table(spark, d):
    rows = export(spark, d, {"PUI": F.col("id"), "Title": F.lit("T"), "Author Names": F.lit("Last A., Other B.C."), "Emtree drugs": F.concat("source", F.lit(" word (a note)")), "Author Keywords": F.concat("lang", F.lit(",b")), "Embase Accession ID": F.lit("1")})
    return parsed(parsers.parse_embase(rows), "ID", "Authors", "Keywords", "Author_keywords", "Source")


@query("SELECT 'SCP:2-s2.0-' || doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN 'Text of ' || lang END AS abstract, 'Last, A;Other, B C' AS authors, CAST(n_chars % 9 AS INTEGER) AS n_citations, '2020' AS published, 'Scopus' AS source FROM documents")
def parse_scopus_table(spark, d):
    rows = export(spark, d, {
        "EID": F.concat(F.lit("2-s2.0-"), "id"), "Title": F.lit("T"), "Abstract": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Text of "), "lang")).otherwise("[No abstract available]"), "Authors": F.lit("Last A., Other B.C."),
        "Cited by": (F.col("n_chars") % 9).cast("string"), "Year": F.lit("2020"),
    })
    return parsed(parsers.parse_scopus(rows), "ID", "Abstract", "Authors", "N_citations", "Published", "Source")


@query("SELECT doc_id, lower(source) || '_one b_' || lang || ' x' AS tokens FROM documents")
def tokenize_keywords(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.tokenized_keywords(F.concat(F.upper("source"), F.lit(" one ; B-"), "lang", F.lit(";  x"))).alias("tokens"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang FROM documents WHERE NOT (doc_id % 5 > 0 AND lang = 'en') AND (doc_id % 2 = 1 OR doc_id % 5 > 0)")
def not_in(spark, d):
    """Null as a value: kept where it isn't listed, out where it is."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"))
    return docs.where(F.when(F.col("doc_id") % 2 == 1, R.not_in(F.col("lang"), ["en"])).otherwise(R.not_in(F.col("lang"), ["en", None])))


@query(f"""
WITH v AS (SELECT doc_id, doc_id / 7919 AS b, (doc_id * 37 % 101) / 101 AS a, (doc_id * 11 % 97) / 97 AS c FROM documents), w AS (SELECT doc_id, list_sort([a, b, c]) AS x FROM v)
SELECT doc_id, {sql_percent('x[2]')} || ' [' || {sql_percent('x[1]')} || ', ' || {sql_percent('x[3]')} || ']' AS shares FROM w""")
def format_interval(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", interval(F.array((i * 37 % 101) / 101, i / 7919, (i * 11 % 97) / 97), True).alias("shares"))


@query("""
SELECT * FROM (VALUES ('efficiency', '50% [25%, 75%]'), ('sensitivity', '99.5% [90%, 100%]'), ('used_prop', '0.12% [0.1%, 0.25%]'), ('total', '12.3 [10, 14.6]'), ('records', '1200')) x(indicator, value)""")
def format_performance(spark, d):
    rows = [("efficiency", 0.25, 0.5, 0.75), ("sensitivity", 0.9, 0.995, 1.0), ("used_prop", 0.001, 0.0012, 0.0025), ("total", 10.0, 12.34, 14.56), ("records", 1200.0, 1200.0, 1200.0)]
    return reporting.format_performance(spark.createDataFrame(rows, "indicator string, low double, mid double, high double"))


@query(f"""
WITH {DOCS}, r AS (SELECT doc_id % 3 AS session, {KEY.format('title')} AS id, source FROM docs), f AS (SELECT id, min((session, source)) AS m FROM r GROUP BY id),
g AS (SELECT m[1] AS session, m[2] AS source, count(*) AS n FROM f GROUP BY 1, 2)
SELECT session, string_agg(source || ':' || n, ',' ORDER BY source) AS sources FROM g GROUP BY session""")
def source_lists(spark, d):
    lists = reporting.source_lists(sources_by_session(spark, d))
    return lists.select("session", F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("sources"))


@query(f"""
WITH {LABELS}, a AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN target END AS before, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN toxic = 1 THEN 'n' ELSE 'y' END END AS new FROM documents LEFT JOIN lab USING (doc_id)),
t AS (SELECT coalesce(new, before, 'unlab.') AS t, coalesce(before, 'unlab.') AS b, new FROM a), n AS (SELECT count(*) AS n FROM t)
SELECT 'Iter' AS Indicator, '3' AS Value UNION ALL SELECT 'Target: ' || t, CAST(count(*) AS VARCHAR) FROM t GROUP BY t UNION ALL SELECT 'Change: ' || b || ' -> ' || t, CAST(count(*) AS VARCHAR) FROM t GROUP BY b, t
UNION ALL SELECT 'Total_labeled', count(*) FILTER (t <> 'unlab.') || ' (' || {sql_percent("count(*) FILTER (t <> 'unlab.') / any_value(n)")} || ')' FROM t, n
UNION ALL SELECT 'New_labels', count(*) FILTER (t <> b AND t <> '*') || ' (' || {sql_percent("count(*) FILTER (t <> b AND t <> '*') / any_value(n)")} || ')' FROM t, n
UNION ALL SELECT 'Reviewed predictions', CAST(count(new) AS VARCHAR) FROM t""")
def consolidate_results(spark, d):
    """Results after a review: label indicators anew, others kept."""
    from winnow.plans.review import consolidated

    docs = table(spark, d, "documents").select("doc_id").join(labels(spark, d), "doc_id", "left")
    seen = docs.select(F.col("doc_id").alias("ID"), F.when(F.col("doc_id") % 3 > 0, F.col("target")).alias("Rev_manual"), F.lit(None).cast("string").alias("Rev_prediction"), F.when(F.col("doc_id") % 4 == 0, F.when(F.col("toxic") == 1, "n").otherwise("y")).alias("Rev_prediction_new"))
    before = spark.createDataFrame([("Iter", "3"), ("Target: y", "1"), ("Change: n -> y", "7"), ("Reviewed predictions", "0")], "Indicator string, Value string")
    return consolidated(before, seen)


MEDLINE = "PMID- 1{id}\nTI  - {title}\nAB  - First line\n      and more.\nFAU - Roe, Jane\nFAU - Doe, John T\nLID - 10.1/x{id} [doi]\nDP  - 2020 Feb 29\nMH  - Humans\nMH  - *Birds/genetics\n"


@query("SELECT 'PMID:1' || doc_id AS id, 'Study ' || doc_id AS title, 'First line and more.' AS abstract, '10.1/x' || doc_id AS doi, 'Roe, Jane;Doe, John T' AS authors, 'Humans;*Birds/genetics' AS mesh, '2020 Feb 29' AS published FROM documents")
def parse_medline(spark, d):
    """Medline text made of each document's id, ten records a file, parsed again."""
    docs = table(spark, d, "documents").select("doc_id", F.format_string(MEDLINE.replace("{id}", "%1$d").replace("{title}", "Study %1$d"), "doc_id").alias("t"))
    files = docs.groupBy(F.floor(F.col("doc_id") / 10).cast("string").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("value"))
    out = parse_pubmed(files)
    return out.select(F.col("ID").alias("id"), F.col("Title").alias("title"), F.col("Abstract").alias("abstract"), F.col("DOI").alias("doi"), F.col("Authors").alias("authors"), F.col("Mesh").alias("mesh"), F.col("Published").alias("published"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H.%M.%S') AS stamp FROM events")
def path_stamps(spark, d):
    return table(spark, d, "events").select("event_id", path_safe(F.col("ts")).alias("stamp"))


def _exported(spark, name: str) -> str:
    """A new path in the cluster's shared folder, for an export that is read again."""
    return f"{shared_dir(spark)}/winnow/{RUN}/{name}-{uuid.uuid4().hex}"


@query(ORACLE_SQL["parse_medline"])
def medline_files(spark, d):
    """Medline files written from the documents, read again in splits."""
    path = _exported(spark, "export") + ".nbib"
    docs = table(spark, d, "documents").select(F.format_string(MEDLINE.replace("{id}", "%1$d").replace("{title}", "Study %1$d"), "doc_id").alias("value"))
    docs.write.text(path)
    out = parsers.read_bib_files(spark, [path])[path.rsplit("/", 1)[-1]]
    return out.select(F.col("ID").alias("id"), F.col("Title").alias("title"), F.col("Abstract").alias("abstract"), F.col("DOI").alias("doi"), F.col("Authors").alias("authors"), F.col("Mesh").alias("mesh"), F.col("Published").alias("published"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def import_table(spark, d):
    """Whole documents written as quoted text over several lines, imported by their suffix."""
    path = _exported(spark, "export") + ".csv"
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "NA").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return parsers.import_data(spark, path).select("doc_id", "lang", "source", "text", "n_chars")


@query(rf"""
WITH {DOCS}, {UID},
s AS (SELECT uid, source, min(doc_id) AS first_at FROM u WHERE source IS NOT NULL GROUP BY uid, source),
j AS (SELECT uid, string_agg(source, ';' ORDER BY first_at, source) AS sources FROM s GROUP BY uid),
g AS (SELECT uid, min(doc_id) + 1 AS ord_min, string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY doc_id) AS ids, arg_min(title, doc_id) AS title FROM u GROUP BY uid),
k AS (SELECT *, regexp_replace(lower(nullif({CLEAN.format('title')}, '')), '[^\p{{L}}\p{{N}}_\s]+', '', 'g') AS loose FROM g),
{LABELS}, old AS (SELECT DISTINCT regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]+', '', 'g') AS loose, target FROM docs JOIN lab USING (doc_id))
SELECT ord_min, ids, j.sources, CAST(NULL AS VARCHAR) AS rev_manual, old.target AS rev_previous FROM k LEFT JOIN j USING (uid) LEFT JOIN old ON k.loose = old.loose""")
def annotation_file(spark, d):
    """Records of all documents, unified, with the labels of an earlier review of the same works."""
    now = records(spark, d)
    before = now.join(labels(spark, d).select(F.col("doc_id").cast("string").alias("ID"), F.col("target").alias("Rev_manual")), "ID")
    out = R.annotation_table([now], classification=before)
    return out.select(F.col("Order").alias("ord_min"), F.col("ID").alias("ids"), F.col("Source").alias("sources"), F.col("Rev_manual").alias("rev_manual"), F.col("Rev_previous").alias("rev_previous"))


@query(f"SELECT doc_id, {sql_percent('doc_id / 7919')} AS text FROM documents")
def percent_format(spark, d):
    return table(spark, d, "documents").select("doc_id", percent(F.col("doc_id") / 7919).alias("text"))


@query(f"""
SELECT c AS component, t AS term, {sql_signif('v * 10000', 3)} AS inclusion_rate, {sql_signif('s', 3)} AS score, {sql_plain(sql_signif('exp(e)', 3))} AS rr, {sql_plain(sql_signif('z', 3))} AS statistic
FROM (VALUES ('Abstract', 'Heart & Failure', 0.00123456::DOUBLE, 2.34567::DOUBLE, 0.5::DOUBLE, 3.14159::DOUBLE), ('Mesh term', 'Birds | Bees Wax', 0.02::DOUBLE, 1.5::DOUBLE, -1.25::DOUBLE, -2.0::DOUBLE), ('Keyword', 'Covid', 0.000345678::DOUBLE, 10.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE)) x(c, t, v, s, e, z)""")
def format_var_imp(spark, d):
    rows = [("ABSTR__heart._.failure", 0.00123456, 2.34567, 0.5, 3.14159), ("MESH__birds.bees_wax", 0.02, 1.5, -1.25, -2.0), ("KEYS__covid", 0.000345678, 10.0, 0.0, 0.5)]
    return reporting.format_importance(spark.createDataFrame(rows, "term string, value double, score double, estimate double, statistic double"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Records unified without duplicates and ranked by a boolean query."""
    unique = R.join_records([records(spark, d)])
    return R.order_by_query_match(unique, BOOLEAN).select("Order", "ID", "Title", "Source", "N_citations")

