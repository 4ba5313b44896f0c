"""Search services: query builders, page parsers and the journal of search sessions.

Fetching needs a network and keys, so it is a function that the caller passes in; everything around
it, from query text to records and journal, is here."""

from __future__ import annotations

import base64
import csv
import os
import re
import warnings
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.records import clean_textfields
from winnow.schema import JOURNAL, RECORD, conform, empty
from winnow.sources.dates import clean_year_filter
from winnow.sources.pages import read_pages
from winnow.sources.parsers import import_data, parse_pubmed, read_bib_files
from winnow.sources.xlsx import write_xlsx
from winnow.storage import written

Fetch = Callable[[str], tuple[int, Callable[[int, int], str]]]


def pubmed_query(query: str, year: str | None = None, fields: str | None = None) -> str:
    years = clean_year_filter(year, "pubmed", query)
    parts = [query, f"({years})" if years else "", fields or ""]
    return " AND ".join(p for p in parts if p)


def wos_query(query: str, year: str | None = None, fields: str | None = None) -> str:
    """Bare queries search topics; FIELD = (...) ones are kept, with even spacing."""
    query = query.strip()
    query = re.sub(r"\b([A-Z]{2}) ?= ?", r"\1 = ", query) if re.search(r"\b[A-Z]{2} ?=", query) else f"TS = ({query})"
    parts = [query, clean_year_filter(year, "wos", query), fields or ""]
    return " AND ".join(p for p in parts if p)


def ieee_query(query: str, year: str | None = None, fields: str | None = None, page: int = 1, rows: int = 100) -> str:
    years = clean_year_filter(year, "ieee", query)
    text = re.sub(r"\s+", "%20", query.strip())
    parts = [f"queryText={text}", f"ranges={years}_Year" if years else "", fields or "", f"pageNumber={page}", f"rowsPerPage={rows}"]
    return "&".join(p for p in parts if p)


def search_pubmed(spark: SparkSession, query: str, fetch: Fetch, year: str | None = None, fields: str | None = None, limit: int | None = None, page: int = 200, timestamp: Column | None = None) -> DataFrame:
    """Records of a search: ``fetch(query)`` gives their number and the function that gets a Medline page
    by its first record and length, which runs on the executors, a page a task (``read_pages``)."""
    total, get = fetch(pubmed_query(query, year, fields))
    # written: numbering reads them twice, and a page may have cost many tries
    pages = written(read_pages(spark, get, total, page, limit), "pages")
    rows = parse_pubmed(pages.select(F.format_string("%015d", "start").alias("path"), "value"), timestamp, numbered_by="path")
    return rows.withColumn("Source_type", F.lit("API"))


def search_wos(spark: SparkSession, query: str, fetch: Callable[[str], tuple[list[tuple], dict[str, list[tuple]]]], year: str | None = None, fields: str | None = None, timestamp: Column | None = None) -> DataFrame:
    """Records of ``fetch(query)``: rows (ut, title, abstract, doi, journal, article_type, published,
    n_citations), and rows (ut, position, value) for Authors, Author_keywords, Keywords and Topic."""
    rows, parts = fetch(wos_query(query, year, fields))
    base = spark.createDataFrame(rows, "ut string, Title string, Abstract string, DOI string, Journal string, Article_type string, Published string, N_citations int").dropDuplicates(["ut"])
    tables = {n: spark.createDataFrame(parts.get(n, []), "ut string, position int, value string") for n in ("Authors", "Author_keywords", "Keywords", "Topic")}
    out = wos_records(base, tables)
    first = {r[0]: i + 1 for i, r in reversed(list(enumerate(rows)))}
    order = spark.createDataFrame(list(first.items()) or [], "ut string, Order long")
    out = out.join(order, "ut").withColumns({"ID": F.col("ut"), "Source": F.lit("WOS"), "Source_type": F.lit("API"), "Creation_date": timestamp if timestamp is not None else F.current_timestamp()})
    return conform(clean_textfields(out), RECORD)


def search_ieee(spark: SparkSession, query: str, fetch: Callable[[str], list[tuple]], year: str | None = None, fields: str | None = None, limit: int | None = None, timestamp: Column | None = None) -> DataFrame:
    """Records of ``fetch(query)``: rows (url, title, abstract, doi, authors, journal, article_type,
    published, n_citations, json), json being the article's metadata with its keyword groups."""
    rows = fetch(ieee_query(query, year, fields))[:limit]
    kind = "Order long, URL string, Title string, Abstract string, DOI string, Authors string, Journal string, Article_type string, Published string, N_citations int, json string"
    base = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], kind)
    words = ieee_keywords(base.select(F.col("URL").alias("url"), "json")).withColumnRenamed("url", "u_")
    out = base.join(words, F.col("URL") == F.col("u_"), "left").drop("u_", "json")
    own = {"ID": F.concat(F.lit("IEEE:"), F.regexp_extract("URL", r"(\d+)/?$", 1)), "Source": F.lit("IEEE"), "Source_type": F.lit("API"), "Creation_date": timestamp if timestamp is not None else F.current_timestamp()}
    return conform(clean_textfields(out.withColumns(own)), RECORD)


def wos_records(records: DataFrame, parts: dict[str, DataFrame], separator: str = "; ") -> DataFrame:
    """Records (ut, ...) left-joined with one joined text for each of ``parts`` (ut, position, value)."""
    out = records
    for name, rows in parts.items():
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]), separator)
        out = out.join(rows.where("value is not null").groupBy("ut").agg(text.alias(name)), "ut", "left")
    return out


def ieee_keywords(metadata: DataFrame) -> DataFrame:
    """(url, Keywords, Mesh, Author_keywords) of (url, json), an article's metadata."""
    kind = "keywords array<struct<type:string,kwd:array<string>>>"
    each = metadata.select("url", F.explode(F.from_json("json", kind)["keywords"]).alias("k"))
    group = F.when(F.col("k.type") == "Author Keywords", "Author_keywords").when(F.lower("k.type").contains("mesh"), "Mesh").otherwise("Keywords")
    texts = each.select("url", group.alias("g"), F.explode("k.kwd").alias("w")).groupBy("url", "g").agg(F.array_join(F.array_sort(F.collect_set("w")), ";").alias("text"))
    return texts.groupBy("url").agg(*(F.max(F.when(F.col("g") == n, F.col("text"))).alias(n) for n in ("Keywords", "Mesh", "Author_keywords")))


def decoded_resource(body: Column, is_base64: Column) -> Column:
    """A captured response body as text."""
    return F.when(is_base64, F.decode(F.unbase64(body), "UTF-8")).otherwise(body)


def website_resources(captured: list[dict], url_filter: str = "", type_filter: str = "") -> list[dict]:
    """Captured browser responses {url, type, body, base64} that match, decoded; capturing is the caller's."""
    keep = [r for r in captured if re.search(url_filter, r["url"]) and re.search(type_filter, r.get("type", ""))]
    return [r | {"body": base64.b64decode(r["body"]).decode("utf-8", "replace") if r.get("base64") else r["body"]} for r in keep]


def upserted(journal: DataFrame, new: DataFrame) -> DataFrame:
    """The journal with new rows: for each session, query, source and type the latest non-null values."""
    keys = ["Session_ID", "Query_ID", "Source", "Type"]
    rows = journal.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    when = F.struct(F.coalesce("Timestamp", F.lit("")).alias("t"), F.col("Output_file"))
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in rest)).select(*journal.columns)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order, whole."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def source_paths(journal: DataFrame, folder: str, sessions: list[str] | None = None, queries: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """(path) of the output files of the chosen sessions, queries and sources, each once."""
    out = journal
    for column, wanted in (("Session_ID", sessions), ("Query_ID", queries), ("Source", sources)):
        if wanted:
            out = out.where(F.col(column).isin(wanted))
    return out.select(F.concat_ws("/", F.lit(folder), "Session_ID", "Query_ID", "Output_file").alias("path")).distinct()


def read_journal(spark: SparkSession, path: str) -> DataFrame | None:
    """The journal at a path of .csv or .xlsx, all text; None if there is none yet."""
    if not re.search(r"\.(csv|xlsx?)$", path):
        raise ValueError("a journal is a csv or xlsx file")
    if not os.path.exists(path):
        return None
    return conform(import_data(spark, path), dict.fromkeys(JOURNAL, "string"))


def write_journal(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The journal with new rows, the last one by Timestamp of each session, query, source and type; it
    goes to the file in one step, so that a failure leaves the old one.

    A journal is a small file by nature: a row for each source of a query."""
    old = read_journal(spark, path)
    key = ["Session_ID", "Query_ID", "Source", "Type"]
    rows = latest(new if old is None else old.unionByName(new), key, ["Timestamp", "Output_file"]).select(*JOURNAL).orderBy(*key).collect()
    whole = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in JOURNAL))
    stem, suffix = os.path.splitext(path)
    draft = f"{stem}.draft{suffix}"
    if suffix == ".csv":
        with open(draft, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(JOURNAL)
            out.writerows(["NA" if v is None else v for v in r] for r in rows)
    else:
        write_xlsx(draft, {"Journal": whole})
    os.replace(draft, path)
    return whole


def search_session(spark: SparkSession, query: str, fetchers: dict[str, Callable[[str, str | None], DataFrame]], folder: str, session: str, name: str = "Query1", year: str | None = None, actions: tuple[str, ...] = ("API", "parsed"), overwrite: bool = False, now: str | None = None, skip_on_failure: bool = False, journal: str | None = None) -> DataFrame:
    """New journal rows after searching and parsing into ``folder/session/name``.

    API results of each fetcher and the raw files that carry a source's name are written as CSV
    folders; results that exist stay unless ``overwrite``.  A source's failure is an error, or a
    warning if ``skip_on_failure``, and the others go on.  With a path of a ``journal`` the rows go
    there too (``write_journal``) and the whole journal is returned; sources without records leave no row."""
    now = now or datetime.now(UTC).strftime("%Y-%m-%dT%H.%M.%S")
    place = os.path.join(folder, session, name)
    os.makedirs(place, exist_ok=True)
    rows = []
    for source, fetch in fetchers.items():
        for action in actions:
            out = os.path.join(place, f"{source}_{action}.csv")
            raw = sorted(f for f in os.listdir(place) if source.lower() in f.lower() and not re.search(r"(API|parsed)\.csv$", f))
            if (os.path.exists(out) and not overwrite) or (action == "parsed" and not raw):
                continue
            try:
                if action == "API":
                    found = fetch(query, year)
                else:
                    found = reduce(DataFrame.unionByName, read_bib_files(spark, [os.path.join(place, f) for f in raw]).values(), empty(spark, RECORD))
                found = conform(found, RECORD).withColumn("FileID", F.lit(os.path.relpath(out, folder)))
                found = written(found, "search")  # fetched once, for the count and the file
                if not (n := found.count()):
                    continue
                found.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(out)
            except Exception as failure:
                if not skip_on_failure:
                    raise
                warnings.warn(f"{action} of {source} failed: {failure}", stacklevel=2)
                continue
            rows.append((session, name, source, action, ", ".join(raw) if action == "parsed" else None, os.path.basename(out), now, year, str(n), query))
    new = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in JOURNAL))
    return write_journal(spark, journal, new) if journal else new
