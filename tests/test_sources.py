import pytest
from pyspark.sql import functions as F

from winnow.sources import dates, parsers, search, sessions, xlsx
from winnow.streaming.drops import medline_ids

NBIB = """
PMID- 101
TI  - A long title that
      goes on
AB  - Some text.
FAU - Wu, Joseph T
FAU - Leung, Kathy
LID - S0140 [pii]
LID - 10.1016/x [doi]
JT  - Lancet (London)
TA  - Lancet
PT  - Journal Article
MH  - Humans
MH  - *Birds/genetics
OT  - *model
DP  - 2020 Feb 29

PMID- 102
BTI - Book title
AID - 10.1/book [doi]
DP  - 2017 Aug
"""


def test_pubmed(spark, tmp_path):
    (tmp_path / "Pubmed.nbib").write_text(NBIB.replace("\n", "\r\n"))
    found = parsers.read_bib_files(spark, [f"{tmp_path}/Pubmed.nbib"])["Pubmed.nbib"].orderBy("Order").collect()
    assert [(r.Order, r.ID, r.Title, r.DOI, r.Published) for r in found] == [(1, "PMID:101", "A long title that goes on", "10.1016/x", "2020 Feb 29"), (2, "PMID:102", "Book title", "10.1/book", "2017 Aug")]
    assert (found[0].Authors, found[0].Mesh, found[0].Source_type) == ("Wu, Joseph T;Leung, Kathy", "Humans;*Birds/genetics", "parsed")


def test_tabular_exports(spark, tmp_path):
    wos = spark.createDataFrame([("WOS:1", "T", "A", "5", "MAY", "2020")], ["UT (Unique WOS ID)", "Article Title", "Abstract", "Times Cited, All Databases", "Publication Date", "Publication Year"])
    xlsx.write_xlsx(f"{tmp_path}/wos.xlsx", {"s": wos})
    (tmp_path / "em.csv").write_text('Embase Accession ID,PUI,Title,Author Names,Emtree drug,Emtree disease\n1,9,T,"Doe J., Roe A.B.","a (x), b","c (y)"\n')
    (tmp_path / "sc.csv").write_text("Source,EID,Title,Authors,Abstract,Cited by,Year\nScopus,2-s,T,Doe J.,[No abstract available],4,2019\n")
    (tmp_path / "ie.csv").write_text("IEEE Terms,PDF Link,Document Title,Document Identifier,INSPEC Controlled Terms\nt1,https://x/7,T,IEEE Conferences,t2\n")
    (tmp_path / "no.csv").write_text("a,b\n1,2\n")
    with pytest.warns(UserWarning):
        found = {k: v.first() for k, v in parsers.read_bib_files(spark, [f"{tmp_path}/{n}" for n in ("wos.xlsx", "em.csv", "sc.csv", "ie.csv", "no.csv")]).items()}
    assert (found["wos.xlsx"].ID, found["wos.xlsx"].N_citations, found["wos.xlsx"].Published) == ("WOS:1", 5, "MAY 2020")
    assert (found["em.csv"].ID, found["em.csv"].Authors, found["em.csv"].Keywords) == ("EM:9", "Doe, J;Roe, A B", "a;b;c")
    assert (found["sc.csv"].ID, found["sc.csv"].Abstract, found["sc.csv"].N_citations) == ("SCP:2-s", None, 4)
    assert (found["ie.csv"].ID, found["ie.csv"].Keywords, found["ie.csv"].Article_type) == ("IEEE:7", "t1;t2", "Conferences")


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b", None), (None, "é & 'q'")], "x string, y string")
    with pytest.raises(ValueError):
        xlsx.write_xlsx(f"{tmp_path}/small.xlsx", {"two": df}, most=0)
    xlsx.write_xlsx(f"{tmp_path}/t.xlsx", {"one": df.limit(0), "two": df})
    assert xlsx.read_xlsx(spark, f"{tmp_path}/t.xlsx", "two").collect() == df.collect()


@pytest.mark.parametrize(("form", "wos", "years"), [("2001-2003", "PY = 2001-2003", {2001, 2003}), ("<2001", "PY = 1985-2000", {1999}), (">= 2001", None, {2001, 2003, 2010}), ("2001", "PY = 2001-2001", {2001})])
def test_year_filters(spark, form, wos, years):
    if wos:
        assert dates.clean_year_filter(form, "wos") == wos
    df = spark.createDataFrame([(y,) for y in (1999, 2001, 2003, 2010)], "y int")
    assert {r.y for r in df.where(dates.year_predicate(form, F.col("y"))).collect()} == years


def test_year_filter_errors():
    with pytest.raises(ValueError, match="not a year"):
        dates.clean_year_filter("20x1", "wos")
    with pytest.warns(UserWarning):
        assert dates.clean_year_filter("2001", "pubmed", "a AND 1999[PDAT]") == ""
    assert dates.clean_year_filter(None, "wos") == ""
    assert dates.clean_year_filter("<2001", "ieee_api") == "x_2000"
    assert search.wos_query("a AND b", "2001") == "TS = (a AND b) AND PY = 2001-2001"
    assert search.wos_query("TI=x") == "TI = x"
    assert search.pubmed_query("a", "2001") == "a AND (2001[PDAT]:2001[PDAT])"


def test_search_session_and_journal(spark, tmp_path):
    fetch = lambda q, y: search.search_pubmed(spark, q, lambda text: (2, lambda start, n: NBIB if n == 2 else NBIB.split("\n\n")[start]), y, limit=1)
    (tmp_path / "S1" / "Query1").mkdir(parents=True)
    (tmp_path / "S1" / "Query1" / "pubmed_raw.nbib").write_text(NBIB)
    new = search.search_session(spark, "q", {"Pubmed": fetch}, str(tmp_path), "S1", now="2020")
    assert {(r.Type, r.N_results) for r in new.collect()} == {("API", "1"), ("parsed", "2")}
    assert search.search_session(spark, "q", {"Pubmed": fetch}, str(tmp_path), "S1").count() == 0
    later = new.where("Type = 'API'").withColumns({"Timestamp": F.lit("2021"), "N_results": F.lit("7"), "Filter": F.lit(None).cast("string")})
    assert {(r.Type, r.N_results) for r in search.upserted(new, later).collect()} == {("API", "7"), ("parsed", "2")}
    paths = [r.path for r in search.source_paths(new, str(tmp_path), sessions=["S1"]).collect()]
    found = parsers.read_bib_files(spark, paths)
    assert sum(t.count() for t in found.values()) == 3


def test_page_metadata(spark):
    rows = spark.createDataFrame([("u", '{"keywords": [{"type": "IEEE Keywords", "kwd": ["b", "a"]}, {"type": "Author Keywords ", "kwd": ["x"]}, {"type": "Author Keywords", "kwd": ["y"]}]}')], "url string, json string")
    r = search.ieee_keywords(rows).first()
    assert (r.Keywords, r.Author_keywords) == ("a;b;x", "y")
    base = spark.createDataFrame([("1",)], "ut string")
    part = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a"), ("1", 3, None)], "ut string, position int, value string")
    assert search.wos_records(base, {"Authors": part}).first().Authors == "a; b"
    assert search.website_resources([{"url": "x/y", "body": "aGk=", "base64": True}, {"url": "z", "body": ""}], "y")[0]["body"] == "hi"


def test_sessions(spark, tmp_path):
    df = spark.range(2)
    sessions.create_session(df, "A", str(tmp_path), dtm=df, stamp=False)
    for i in (10, 2, 1):
        df.write.parquet(f"{tmp_path}/A/{i}.Annotations.parquet")
    names = [p.rsplit("/", 1)[1] for p in sessions.session_files("A", str(tmp_path))["Annotations"]]
    assert names == ["1.Annotations.parquet", "2.Annotations.parquet", "10.Annotations.parquet"]
    assert sessions.create_session(df, "A", str(tmp_path), duplicate="add").endswith("A_r2")
    with pytest.raises(FileExistsError):
        sessions.create_session(df, "A", str(tmp_path), duplicate="stop")
    with sessions.locked(f"{tmp_path}/A"), pytest.raises(RuntimeError), sessions.locked(f"{tmp_path}/A"):
        pass


def test_dropped_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nbib").write_text(NBIB)
    stream = medline_ids(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("ids").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert {r.ID for r in spark.table("ids").collect()} == {"PMID:101", "PMID:102"}


def test_searches_with_given_pages(spark):
    rows = [("WOS:2", "B", None, "10/b", "J", "Article", "2020", 3), ("WOS:1", "A", None, None, "J", None, None, None), ("WOS:2", "B", None, "10/b", "J", "Article", "2020", 3)]
    asked = []
    found = search.search_wos(spark, "x", lambda q: asked.append(q) or (rows, {"Authors": [("WOS:2", 2, "Roe, A"), ("WOS:2", 1, "Doe, J")]}), "2020").orderBy("Order").collect()
    assert asked == ["TS = (x) AND PY = 2020-2020"]
    assert [(r.Order, r.ID, r.Authors, r.Source_type) for r in found] == [(1, "WOS:2", "Doe, J;Roe, A", "API"), (2, "WOS:1", None, "API")]
    pages = [("https://x/document/7/", "T", "A", None, "A. Doe", "J", "Conf", "May 2020", 1, '{"keywords": [{"type": "INSPEC", "kwd": ["a"]}]}')] * 2
    got = search.search_ieee(spark, "x y", lambda q: pages, limit=1).collect()
    assert [(r.ID, r.Keywords, r.N_citations) for r in got] == [("IEEE:7", "a", 1)]
    assert search.ieee_query("x y", "2020") == "queryText=x%20y&ranges=2020_2020_Year&pageNumber=1&rowsPerPage=100"
    assert search.search_wos(spark, "x", lambda q: ([], {})).count() == 0


@pytest.mark.parametrize("size", ["100", "333", "1000000"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_medline_splits(spark, tmp_path, size, end):
    """Any split size gives the records of the whole text, in order."""
    texts = [f"PMID- {i}{chr(10)}TI  - Title {i} é PMID- in it{chr(10)}      goes on{chr(10)}AB  - {'word ' * (i % 40)}{chr(10)}{chr(10) * (i % 3)}" for i in range(60)]
    for name, head in (("a.nbib", ""), ("b.nbib", "\n\n"), ("c.nbib", "a line before\n")):
        (tmp_path / name).write_text((head + "".join(texts)).replace("\n", end), newline="")
    (tmp_path / "d.nbib").write_text("")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, size if k.endswith("PartitionBytes") else "0")
        for name in ("a.nbib", "b.nbib", "c.nbib", "d.nbib"):
            columns = ("Order", "ID", "Title", "Abstract")
            found = parsers.read_medline(spark, f"{tmp_path}/{name}").select(*columns).orderBy("Order").collect()
            assert found == parsers.parse_pubmed(parsers.read_texts(spark, f"{tmp_path}/{name}")).select(*columns).orderBy("Order").collect()
            assert [r.Order for r in found] == list(range(1, 61 if name != "d.nbib" else 1))
        if size == "100":
            assert spark.read.option("lineSep", "\nPMID-").text(f"{tmp_path}/a.nbib").rdd.getNumPartitions() > 10
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
