"""Parsers of database exports into the record schema, and file readers."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.functions.text import replaced
from winnow.operators.records import clean_textfields
from winnow.schema import RECORD, conform
from winnow.sources.rds import read_rds
from winnow.sources.xlsx import read_xlsx


def import_data(spark: SparkSession, source: str | DataFrame, sheet: str | int = 0) -> DataFrame:
    """A table by its suffix: .csv, .xls(x), .rds, .parquet; frames pass."""
    if isinstance(source, DataFrame):
        return source
    suffix = source.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, source)
    if suffix in ("xlsx", "xls"):
        return read_xlsx(spark, source, sheet)
    if suffix == "rds":
        return read_rds(spark, source)
    if suffix == "parquet":
        return spark.read.parquet(source)
    raise ValueError(f"no reader for {source}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields over several lines, all text; types follow in the parsers."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("nullValue", "NA").csv(path)


def _numbered(df: DataFrame) -> DataFrame:
    """Plus Order, the row's number in its file: such files are read whole and in order, one task a file."""
    if "Order" in df.columns:
        return df
    placed = df.withColumns({"f_": F.input_file_name(), "o_": F.monotonically_increasing_id()})
    return placed.withColumn("Order", F.row_number().over(Window.partitionBy("f_").orderBy("o_")).cast("bigint")).drop("f_", "o_")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _finished(df: DataFrame, source: str, columns: dict[str, Column], timestamp: Column | None) -> DataFrame:
    out = _numbered(df)
    own = {"Source": F.lit(source), "Source_type": F.lit("parsed"), "Creation_date": timestamp if timestamp is not None else F.current_timestamp()}
    out = out.select("Order", *(v.alias(k) for k, v in (columns | own).items()))
    return conform(clean_textfields(out), RECORD)


def parse_pubmed(texts: DataFrame, timestamp: Column | None = None, numbered_by: str | None = None) -> DataFrame:
    """Medline records of whole-file texts (path, value): one row a record, all by expressions.  Order
    counts within each text, or over all of them by ``numbered_by``."""
    body = replaced(F.col("value"), ("\r", ""), (r"\n[ \t]{2,}", " "))
    each = texts.select("path", F.posexplode(F.split(body, r"\n+(?=PMID-)"))).where(F.col("col").rlike(r"(?:^|\n)PMID-"))
    order = F.row_number().over(Window.partitionBy("path").orderBy("pos")).cast("bigint")
    rows = each.select("path", order.alias("Order"), F.col("col").alias("record"))
    if numbered_by:  # a page's records come after those of the pages before: one small row a page
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"))
        upto = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select("path", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
        rows = rows.join(before, "path").withColumn("Order", F.col("Order") + F.col("before"))
    return medline_records(rows.select("Order", "record"), timestamp)


def read_medline(spark: SparkSession, path: str | list[str], timestamp: Column | None = None) -> DataFrame:
    """The same of files of any size: records are cut at their delimiter, so splits of a file are read by
    several tasks.  A record's number in its file is its place in its split after the records of the
    splits before it, which are counted first."""
    told = spark.read.option("lineSep", "\nPMID-").text(path)
    lines = told.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("path", "split").orderBy("at")))
    # what comes before the first delimiter is a record only if the file begins with one
    heads = (F.col("split") == 0) & (F.col("place") == 1)
    starts = F.rlike("value", F.lit(r"^\s*PMID-"))
    rows = lines.where(~heads | starts).withColumn("record", F.when(heads, F.col("value")).otherwise(F.concat(F.lit("PMID-"), "value")))
    before = rows.groupBy("path", "split").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(F.col("path").alias("p_"), F.col("split").alias("s_"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("path", "split").orderBy("at")))
    numbered = numbered.join(before, (F.col("path") == F.col("p_")) & (F.col("split") == F.col("s_")))
    clean = replaced(F.col("record"), ("\r", ""), (r"\n[ \t]{2,}", " "))
    return medline_records(numbered.select((F.col("place") + F.col("before")).cast("bigint").alias("Order"), clean.alias("record")), timestamp)


def medline_records(rows: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Records of (Order, record), a record's Medline text with continued lines joined."""
    record = F.concat(F.lit("\n"), F.regexp_replace("record", r"^\s+", ""))
    one = lambda tag: F.nullif(F.regexp_extract(record, rf"\n{tag} *- (.*)", 1), F.lit(""))
    every = lambda tag: F.nullif(F.array_join(F.regexp_extract_all(record, F.lit(rf"\n{tag} *- (.*)"), 1), "; "), F.lit(""))
    doi = lambda tag: F.nullif(F.regexp_extract(record, rf"\n{tag} *- (\S+) \[doi\]", 1), F.lit(""))
    number = F.regexp_extract(record, r"\nPMID- *(\d+)", 1)
    return _finished(rows, "Pubmed", {
        "ID": F.concat(F.lit("PMID:"), number), "Title": F.coalesce(one("TI"), one("BTI")), "Abstract": one("AB"), "DOI": F.coalesce(doi("LID"), doi("AID")), "Authors": every("FAU"),
        "URL": F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), number), "Journal": one("JT"), "Journal_short": one("TA"), "Article_type": every("PT"), "Mesh": every("MH"), "Author_keywords": every("OT"), "Published": one("DP"),
    }, timestamp)


def parse_wos(entries: DataFrame, timestamp: Column | None = None) -> DataFrame:
    c = lambda n: _column(entries, n)
    return _finished(entries, "WOS", {
        "ID": c("UT (Unique WOS ID)"), "Title": c("Article Title"), "Abstract": c("Abstract"), "DOI": c("DOI"), "Authors": c("Author Full Names"), "Journal": c("Source Title"), "Journal_short": c("Journal ISO Abbreviation"),
        "Article_type": c("Document Type"), "Author_keywords": c("Author Keywords"), "Keywords": c("Keywords Plus"), "Topic": c("WoS Categories"), "N_citations": c("Times Cited, All Databases"),
        "Published": F.nullif(F.concat_ws(" ", c("Publication Date"), c("Publication Year")), F.lit("")),
    }, timestamp)


def parse_ieee(entries: DataFrame, timestamp: Column | None = None) -> DataFrame:
    c = lambda n: _column(entries, n)
    number = F.regexp_extract(c("PDF Link"), r"(\d+)$", 1)
    return _finished(entries, "IEEE", {
        "ID": F.concat(F.lit("IEEE:"), number), "Title": c("Document Title"), "Abstract": c("Abstract"), "DOI": c("DOI"), "URL": c("PDF Link"), "Authors": c("Authors"), "Journal": c("Publication Title"),
        "Article_type": F.regexp_replace(c("Document Identifier"), "IEEE ", ""), "Mesh": c("Mesh_Terms"), "Author_keywords": c("Author Keywords"),
        "Keywords": F.nullif(F.concat_ws(";", c("IEEE Terms"), c("INSPEC Controlled Terms"), c("INSPEC Non-Controlled Terms")), F.lit("")), "N_citations": c("Article Citation Count"), "Published": c("Online Date"),
    }, timestamp)


def author_style(authors: Column) -> Column:
    """"Last A., Other B.C." as "Last, A; Other, BC" in the comma style."""
    return replaced(authors, (",", ";"), (r" (?=[\p{L}\p{N}_]\.)", ", "), (r"\.", " "))


def parse_embase(entries: DataFrame, timestamp: Column | None = None) -> DataFrame:
    c = lambda n: _column(entries, n)
    emtree = [F.col(f"`{n}`") for n in entries.columns if "Emtree" in n]
    words = replaced(F.concat_ws(";", *emtree), (",", ";"), (r"\([^()]*\)", "")) if emtree else F.lit(None).cast("string")
    return _finished(entries, "Embase", {
        "ID": F.concat(F.lit("EM:"), c("PUI")), "Title": c("Title"), "Abstract": c("Abstract"), "DOI": c("DOI"), "Authors": author_style(c("Author Names")), "Journal": c("Source title"),
        "Author_keywords": replaced(c("Author Keywords"), (",", ";")), "Keywords": F.nullif(words, F.lit("")), "Article_type": c("Publication Type"), "Published": c("Date of Publication"),
    }, timestamp)


def parse_scopus(entries: DataFrame, timestamp: Column | None = None) -> DataFrame:
    c = lambda n: _column(entries, n)
    return _finished(entries, "Scopus", {
        "ID": F.concat(F.lit("SCP:"), c("EID")), "Title": c("Title"), "Abstract": F.regexp_replace(c("Abstract"), r"\[No abstract available\]", ""), "DOI": c("DOI"), "URL": c("Link"), "Authors": author_style(c("Authors")),
        "Journal": c("Source title"), "Author_keywords": c("Author Keywords"), "Keywords": c("Index Keywords"), "Article_type": c("Document Type"), "N_citations": c("Cited by"), "Published": c("Year"),
    }, timestamp)


#: A source's parser, and the column that gives its exports away (fixed values).
PARSERS = {"wos": (parse_wos, "UT (Unique WOS ID)"), "ieee": (parse_ieee, "IEEE Terms"), "embase": (parse_embase, "Embase Accession ID")}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, value)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def sniffed(df: DataFrame) -> str | None:
    """The source of a tabular export, by its columns."""
    for name, (_, column) in list(PARSERS.items())[:2]:
        if column in df.columns:
            return name
    if "Source" in df.columns and df.where(F.contains("Source", F.lit("Scopus"))).limit(1).count():
        return "scopus"
    return "embase" if "Embase Accession ID" in df.columns else None


def read_bib_file(spark: SparkSession, path: str, timestamp: Column | None = None) -> DataFrame | None:
    """One export or earlier result as records; None with a warning where nothing knows it."""
    name = os.path.basename(path.rstrip("/"))
    if name.endswith(("parsed.csv", "API.csv")):
        return conform(read_csv(spark, path), RECORD)
    if name.lower().endswith((".nbib", ".txt")):
        if spark.read.text(path).where(F.contains("value", F.lit("PMID-"))).limit(1).count():
            return read_medline(spark, path, timestamp)
    elif name.lower().endswith((".csv", ".xlsx", ".xls")):
        df = import_data(spark, path)
        source = sniffed(df)
        if source:
            parser = parse_scopus if source == "scopus" else PARSERS[source][0]
            return parser(df, timestamp)
    warnings.warn(f"no parser knows {path}", stacklevel=2)
    return None


def read_bib_files(spark: SparkSession, paths: list[str], timestamp: Column | None = None) -> dict[str, DataFrame]:
    """Records by file name, of the files that are known."""
    found = {os.path.basename(p): read_bib_file(spark, p, timestamp) for p in paths}
    return {k: v.withColumn("FileID", F.coalesce("FileID", F.lit(k))) for k, v in found.items() if v is not None}
