"""Serialised data frames, journals, pages, importance, sessions' sources and densities."""

import datetime
import gzip
import os
import struct

import pytest
from pyspark.sql import functions as F

from winnow.operators import decide, reporting
from winnow.sources import parsers, rds, search
from winnow.sources.pages import read_pages


def i4(*v):
    return struct.pack(f">{len(v)}i", *v)


def text(s):
    return i4(9, -1) if s is None else i4(0x40009, len(s.encode())) + s.encode()


def symbol(s):
    return i4(1) + text(s)


def attrs(**named):
    return b"".join(i4(0x402) + symbol(k.replace("_", ".")) + v for k, v in named.items()) + i4(254)


def texts(*v, more=b""):
    return i4(0x210 if more else 16, len(v)) + b"".join(map(text, v)) + more


def integers(*v, more=b"", kind=13):
    return i4(kind | (0x200 if more else 0), len(v), *v) + more


def reals(*v, more=b""):
    return i4(14 | (0x200 if more else 0), len(v)) + struct.pack(f">{len(v)}d", *v) + more


def stored(kind, state, more=i4(254)):
    return i4(238) + i4(2) + symbol(kind) + i4(2) + symbol("base") + i4(2) + integers(13) + i4(254) + state + more


NA, NAN = rds.MISSING, float("nan")
COLUMNS = {
    "s": texts("é", None, ""),
    "i": integers(1, NA, 3),
    "d": reals(0.5, NAN, -2.0),
    "l": integers(1, 0, NA, kind=10),
    "f": integers(2, NA, 1, more=attrs(levels=texts("lo", "hi"), **{"class": texts("factor")})),
    "day": reals(18321.0, NAN, 0.0, more=attrs(**{"class": texts("Date")})),
    "at": reals(1.25, 0.0, NAN, more=attrs(**{"class": texts("POSIXct", "POSIXt")})),
    "range": stored("compact_intseq", reals(3.0, 5.0, 1.0)),
    "wrapped": stored("wrap_string", i4(19, 2) + texts("a", "b", "c") + integers(0, 0)),
    "shown": stored("deferred_string", i4(2) + integers(7, NA, 9) + i4(2) + integers(0) + i4(254)),
}


def frame(columns, version=3):
    head = b"X\n" + i4(version, 0x40102, 0x30500) + (i4(5) + b"UTF-8" if version == 3 else b"")
    marks = attrs(names=texts(*columns), row_names=integers(NA, -3), **{"class": texts("data.frame")})
    return head + i4(0x313, len(columns)) + b"".join(columns.values()) + marks


@pytest.mark.parametrize(("version", "pack"), [(2, bytes), (3, gzip.compress)])
def test_serialised_frames(spark, tmp_path, version, pack):
    (tmp_path / "t.rds").write_bytes(pack(frame(COLUMNS, version)))
    found = parsers.import_data(spark, f"{tmp_path}/t.rds")
    assert dict(found.dtypes) == {"s": "string", "i": "int", "d": "double", "l": "boolean", "f": "string", "day": "date", "at": "timestamp", "range": "int", "wrapped": "string", "shown": "string"}
    rows = [tuple(r) for r in found.drop("at").collect()]
    assert rows == [("é", 1, 0.5, True, "hi", datetime.date(2020, 2, 29), 5, "a", "7"), (None, None, None, False, None, None, 6, "b", None), ("", 3, -2.0, None, "lo", datetime.date(1970, 1, 1), 7, "c", "9")]
    assert [r[0] for r in found.select(F.unix_micros("at")).collect()] == [1_250_000, 0, None]


def test_serialised_files_of_other_forms(spark, tmp_path):
    (tmp_path / "a.rds").write_bytes(frame({"s": COLUMNS["s"], "i": COLUMNS["i"]}))
    (tmp_path / "b.rds").write_bytes(frame({"i": COLUMNS["range"], "more": COLUMNS["d"]}))
    found = rds.read_rds(spark, f"{tmp_path}/*.rds")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([("é", 1), (None, None), ("", 3), (None, 5), (None, 6), (None, 7)], key=repr)
    assert rds.read_frame(frame({})) == {}
    for body in (b"A\n1", frame(COLUMNS)[:-30], b"X\n" + i4(2, 0, 0) + integers(1)):
        with pytest.raises(ValueError):
            rds.read_frame(body)


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_journal_on_disk(spark, tmp_path, kind):
    path = f"{tmp_path}/journal.{kind}"
    names = ["Session_ID", "Query_ID", "Source", "Type", "Input_files", "Output_file", "Timestamp", "Filter", "N_results", "Query"]
    row = lambda source, time, n, note=None: ("S1", "Q1", source, "API", None, f"{source}.csv", time, note, n, 'a AND "b, c"')
    make = lambda *rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    assert search.read_journal(spark, path) is None
    search.write_journal(spark, path, make(row("WOS", "2020", "5", "2019"), row("IEEE", "2020", "1")))
    search.write_journal(spark, path, make(row("WOS", "2021", "7")))
    search.write_journal(spark, path, make(row("IEEE", "2019", "9")))  # older than what is there
    assert [tuple(r) for r in search.read_journal(spark, path).orderBy("Source").collect()] == [row("IEEE", "2020", "1"), row("WOS", "2021", "7")]
    with pytest.raises(ValueError):
        search.read_journal(spark, f"{tmp_path}/journal.txt")


def test_failing_sources(spark, tmp_path):
    def fails(query, year):
        raise OSError("no answer")

    page = "PMID- 1\nTI  - T\n"
    fetchers = {"WOS": fails, "Pubmed": lambda q, y: search.search_pubmed(spark, q, lambda text: (1, lambda start, n: page), y)}
    with pytest.raises(OSError):
        search.search_session(spark, "q", fetchers, str(tmp_path), "S0")
    with pytest.warns(UserWarning, match="API of WOS failed"):
        got = search.search_session(spark, "q", fetchers, str(tmp_path), "S1", skip_on_failure=True, journal=f"{tmp_path}/j.csv")
    assert [(r.Source, r.N_results) for r in got.collect()] == [("Pubmed", "1")]
    # what exists is not searched anew, and stays in the journal
    with pytest.warns(UserWarning):
        again = search.search_session(spark, "q", fetchers, str(tmp_path), "S1", skip_on_failure=True, journal=f"{tmp_path}/j.csv")
    assert again.count() == 1
    none = search.search_session(spark, "q", {"Pubmed": lambda q, y: search.search_pubmed(spark, q, lambda text: (0, lambda start, n: ""), y)}, str(tmp_path), "S2")
    assert none.count() == 0


def test_pages_are_partitions_and_asked_for_again(spark, tmp_path):
    """10,000 records in 50 pages; one page fails twice, and only that one is asked for again."""
    folder = str(tmp_path)

    def get(start, count):
        import os
        import uuid

        open(f"{folder}/{start}.{count}.{uuid.uuid4().hex}", "w").close()
        if start == 4200 and sum(f.startswith("4200.") for f in os.listdir(folder)) < 3:
            raise OSError("not now")
        return "\n\n".join(f"PMID- {i}\nTI  - Title {i}" for i in range(start, start + count))

    pages = read_pages(spark, get, 12_345, limit=9_990, wait=0)
    assert pages.rdd.getNumPartitions() == 50
    # sorted here: a range exchange would read all pages once more to sample them
    assert sorted((r.start, r.value.count("PMID-")) for r in pages.collect()) == [(s, 200 if s < 9800 else 190) for s in range(0, 9990, 200)]
    asked = [f.split(".")[0] for f in os.listdir(folder)]
    assert {x: asked.count(x) for x in set(asked)} == {str(s): 3 if s == 4200 else 1 for s in range(0, 9990, 200)}
    found = search.search_pubmed(spark, "q", lambda text: (10_000, get)).select("Order", "ID", "Title").orderBy("Order").collect()
    assert [tuple(r) for r in found] == [(i + 1, f"PMID:{i}", f"Title {i}") for i in range(10_000)]
    assert read_pages(spark, get, 0).count() == 0
    with pytest.raises(Exception, match="never"):
        read_pages(spark, never, 5, tries=2, wait=0).collect()
    with pytest.raises(ValueError):
        read_pages(spark, get, 5, page=0)


def never(start, count):
    raise OSError("never")


def test_extracted_importance(spark):
    terms = [("a", 9.0, 2.0), ("b", 9.0, 1.6), ("c", 8.0, 3.0), ("low", 10.0, 1.5), ("TITLE.count", 11.0, 9.0), ("none", 7.0, None)]
    importance = spark.createDataFrame(terms, "term string, value double, score double")
    dtm = spark.createDataFrame([(i, t, 1) for t, ids in {"a": (1, 2, 3), "b": (4, 5), "low": (1,)}.items() for i in ids], "id int, term string, val int")
    records = spark.createDataFrame([(1, "y", "n"), (2, None, "y"), (3, None, None), (4, None, "y"), (5, None, None), (6, None, None)], "ID int, Rev_prediction string, Rev_manual string")
    found = {r.term: r for r in decide.extract_importance(importance, dtm, records).collect()}
    assert set(found) == {"a", "b", "c"}
    # of 3 records with a, 2 are y; of 3 without, 1
    assert found["a"].estimate == pytest.approx(0.6931471805599453)
    assert found["a"].statistic == pytest.approx(0.6931471805599453 / 1.5**0.5)
    assert found["c"].estimate is None
    assert [r.term for r in decide.extract_importance(importance, dtm, records, num=1).collect()] == ["a"]


def test_sources_of_sessions(spark):
    rows = [(1, "x", "A"), (1, "x", "A"), (1, "y", "A; B"), (2, "x", "A; B"), (2, "z", "B"), (1, None, "A"), (2, None, "B")]
    records = spark.createDataFrame(rows, "session int, ID string, Source string")
    found = {(r.session, r.source): (r.records, r.perc, r.source_specific) for r in reporting.session_source_summary(records, F.col("session")).collect()}
    assert found == {
        ("1", "A"): (4, "100%", 3), ("1", "B"): (1, "25%", 0), ("1", "Total"): (4, None, None), ("2", "B"): (1, "100%", 1), ("2", "Total"): (1, None, None),
        ("All Sessions", "A"): (1, "33.3%", 0), ("All Sessions", "B"): (3, "100%", 2), ("All Sessions", "Total"): (3, None, None),
    }
    assert {r.session for r in reporting.session_source_summary(records, F.col("session"), global_totals=False).collect()} == {"1", "2"}
    assert reporting.session_source_summary(records.limit(0), F.col("session")).count() == 0


def test_densities(spark):
    notes = spark.createDataFrame([(1, "a", "y", None, 0.6, 0.9), (1, "b", "n", None, 0.1, 0.3), (1, "c", None, "n", 0.2, 0.5), (1, "d", None, None, 0.0, 1.0)], "iter int, ID string, Rev_manual string, Rev_prediction_new string, Pred_Low double, Pred_Up double")
    draws = spark.createDataFrame([(1, i, p) for i in "abcd" for p in (0.2, 0.7)], "iter int, id string, p double")
    found = {(r.iteration, r.label): (r.n, r.neg_lim, r.pos_lim) for r in reporting.densities_by_iteration(notes, draws, bins=1).collect()}
    assert found == {(1, "y"): (2, 0.3, 0.6), (1, "n"): (2, 0.3, 0.6), (1, "*"): (2, 0.3, 0.6), (2, "y"): (2, 0.5, 0.6), (2, "n"): (4, 0.5, 0.6)}
