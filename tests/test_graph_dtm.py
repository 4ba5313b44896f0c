import itertools
import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import dtm, graph


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert set(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect())) == expected


def near_of(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def subsets(edges, most=10):
    """Maximal cliques of at most so many nodes, by looking at all sets."""
    near = near_of(edges)
    whole = [set(s) for n in range(2, len(near) + 1) for s in itertools.combinations(sorted(near), n) if all(b in near[a] for a, b in itertools.combinations(s, 2))]
    return sorted(sorted(s) for s in whole if len(s) <= most and not any(s < t for t in whole))


def grown(edges, most):
    """The same for larger graphs: cliques grow by a later node, and those stay that no node can join."""
    near, found, now = near_of(edges), [], [[x] for x in sorted({x for e in edges for x in e})]
    while now:
        now = [[*c, x] for c in now for x in near[c[-1]] if x > c[-1] and all(x in near[y] for y in c)]
        found += [c for c in now if len(c) <= most and not set.intersection(*(near[x] for x in c))]
    return sorted(found)


@pytest.mark.parametrize("block", [64, 2])
def test_cliques_against_all_subsets(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    r = random.Random(2)
    edges, want = [], []
    for g in range(25):  # many small graphs at once
        own = [(f"{g:02}{a}", f"{g:02}{b}") for a, b in itertools.combinations(range(9), 2) if r.random() < (0.3 + g % 5 / 8)]
        edges += own
        want += [(own, g)]
    for most in (3, 10):
        found = sorted(x.clique for x in graph.maximal_cliques(spark.createDataFrame(edges, "a string, b string"), most).collect())
        assert found == sorted(c for own, _ in want for c in subsets(own, most))


def test_cliques_of_a_dense_component(spark):
    r = random.Random(4)
    edges = [(a, b) for a, b in itertools.combinations(range(60), 2) if r.random() < 0.35] + [(100 + a, 100 + b) for a, b in itertools.combinations(range(40), 2) if (a, b) != (0, 1)]
    edges += [(5, 100), (5, 101)]
    for most in (3, 4, 10):
        found = sorted(x.clique for x in graph.maximal_cliques(spark.createDataFrame(edges, "a long, b long"), most).collect())
        near = near_of(edges)
        want = [c for c in grown([e for e in edges if max(e) < 60], most) if not set.intersection(*(near[x] for x in c))]
        assert found == sorted(want + [c for c in ([5, 100], [5, 101])])


def test_classes_count_with_their_terms(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")]
    terms = [("a", "a"), ("a", "a2"), ("b", "b"), ("c", "c"), ("d", "d"), *(("d", f"d{i}") for i in range(4)), ("e", "e"), ("e", "e2"), ("f", "f")]
    classes = spark.createDataFrame(terms, "node string, term string")
    found = {tuple(x.clique) for x in graph.maximal_cliques(spark.createDataFrame(edges, "a string, b string"), 5, classes).collect()}
    assert found == {("a", "a2", "b", "c"), ("e", "e2")}


def test_only_too_large_cliques(spark):
    edges = [(a, b) for a, b in itertools.combinations("abcd", 2)]
    assert graph.maximal_cliques(spark.createDataFrame(edges, "a string, b string"), max_terms=3).count() == 0


@pytest.mark.parametrize(("num", "den"), [(1, 10), (1, 3), (1, 2), (7, 10), (9, 10)])
def test_cosine_by_brute_force(spark, num, den):
    r = random.Random(7)
    rows = {(d, f"t{int(r.paretovariate(0.6)) % 70:02}"): r.choice([1, 1, 1, 2]) for d in range(60) for _ in range(int(r.paretovariate(0.7)) % 50 + 1)}
    weights = {d: r.choice([1, 1, 9]) for d in range(0, 60, 2)}
    table = spark.createDataFrame([(d, t, v) for (d, t), v in rows.items()], "id long, term string, val int")
    by = {}
    for (d, t), v in rows.items():
        by.setdefault(t, {})[d] = v
    want = set()
    for a, b in itertools.combinations(sorted(by), 2):
        c, na, nb = (sum(weights.get(d, 1) * x[d] * y[d] for d in x.keys() & y.keys()) for x, y in ((by[a], by[b]), (by[a], by[a]), (by[b], by[b])))
        if c and c * c * den * den >= na * nb * num * num:
            want.add((a, b, c, na, nb))
    found = dtm.cosine_pairs(table, num, den, spark.createDataFrame(list(weights.items()), "id long, w int")).collect()
    assert {tuple(x) for x in found} == want and len(found) == len(want)


def test_equal_terms(spark):
    table = spark.createDataFrame([(i, t, 1 + (t == "z")) for t in ("x", "y", "z", "u") for i in range(3 + (t == "u"))], "id long, term string, val int")
    assert {tuple(r) for r in dtm.equal_terms(table).collect()} == {("x", "x"), ("y", "x"), ("z", "z"), ("u", "u")}
    assert {tuple(r) for r in dtm.synonym_components(table, 95, 100).collect()} == {("x", "x"), ("y", "x"), ("z", "x")}


def docs(spark):
    rows = [(i, " ".join(["heart failure" if i % 2 else "lung", "x*" if i == 3 else "x", f"w{i}"])) for i in range(20)]
    return spark.createDataFrame([*rows, (99, None)], "ID long, t string")


def test_stars_frequencies_and_merges(spark):
    table = dtm.text_to_dtm(docs(spark), "ID", F.col("t"), 5, label="T")
    assert {(r.term, r.val) for r in table.collect()} == {("T__heart", 1), ("T__failure", 1), ("T__lung", 1), ("T__x", 1), ("T__x", 2)}
    merged = dtm.merge_synonyms(table)
    assert {r.term for r in merged.collect()} == {"T__failure.heart", "T__lung", "T__x"}
    grams = dtm.add_ngrams(table, label="T")
    assert {r.term for r in grams.collect() if "._." in r.term} >= {"T__failure._.heart._.x"}


def test_weighted_cosine(spark):
    table = dtm.text_to_dtm(docs(spark), "ID", F.col("t"), 5)
    weights = spark.createDataFrame([(1, 3)], "id long, w int")
    pair = next(r for r in dtm.cosine_pairs(table, 1, 2, weights).collect() if (r.a, r.b) == ("failure", "x"))
    assert (pair.c, pair.na, pair.nb) == (10 + 2 + 1, 12, 20 + 2 + 3)


def test_parts_of_speech(spark):
    pos = spark.createDataFrame([("lung", "Adverb"), ("heart", "Adverb"), ("heart", "Noun")], "word string, pos string")
    assert {r.term for r in dtm.text_to_dtm(docs(spark), "ID", F.col("t"), 5, pos=pos).collect()} == {"heart", "failure", "x"}


def test_training_set(spark):
    rows = [(str(i), f"Title heart {i % 3}", "Background: some text about lungs" if i % 2 else None, "Doe, J", "k1; k2", "Humans; *Birds", "y" if i < 3 else "n" if i < 9 else None) for i in range(12)]
    records = spark.createDataFrame(rows, "ID string, Title string, Abstract string, Authors string, Keywords string, Mesh string, Rev_manual string")
    out = dtm.training_set(records, 0.3).collect()
    assert {r.field for r in out} == {"TITLE", "ABSTR", "AUTH", "KEYS", "MESH"}
    assert any("Birds" in r.term and r.val == 2 for r in out) and not any("background" in r.term for r in out)


@pytest.mark.parametrize(("num", "den", "weighted"), [(9, 10, False), (9, 10, True), (3, 4, True), (1, 2, True)])
def test_cosine_pairs_against_all_pairs(spark, num, den, weighted):
    r = random.Random(num * den + weighted)
    docs = {}
    for i in range(120):
        docs[i] = {f"t{t}": r.choice([1, 1, 2]) for t in range(25) if r.random() < 0.25}
        for group in range(6):  # terms that nearly always come together
            if r.random() < 0.3:
                docs[i] |= {f"g{group}{x}": r.choice([1, 1, 1, 2]) for x in "abc" if r.random() < 0.99}
        if r.random() < 0.97:
            docs[i] |= {"all": 1, "any": 1}
    w = {i: r.choice([1, 1, 5]) if weighted else 1 for i in docs}
    n, both = {}, {}
    for i, terms in docs.items():
        for a, x in terms.items():
            n[a] = n.get(a, 0) + w[i] * x * x
            for b, y in terms.items():
                if a < b:
                    both[a, b] = both.get((a, b), 0) + w[i] * x * y
    expected = {(a, b, c, n[a], n[b]) for (a, b), c in both.items() if c * c * den * den >= n[a] * n[b] * num * num}
    table = spark.createDataFrame([(i, t, v) for i, terms in docs.items() for t, v in terms.items()], "id int, term string, val int")
    weights = spark.createDataFrame(list(w.items()), "id int, w int") if weighted else None
    assert len(expected) > 2
    assert {tuple(x) for x in dtm.cosine_pairs(table, num, den, weights).collect()} == expected


def test_terms_are_dealt_by_document_before_they_are_rows(spark):
    docs = spark.createDataFrame([(1, "a b* b a"), (1, "b c"), (2, None), (None, "d d*"), (3, "")], "id long, text string")
    lemmas = spark.createDataFrame([("b", "c"), ("x", "y")], "token string, lemma string")
    terms = dtm.terms_of(docs, "id", F.col("text"))
    assert sorted(map(tuple, terms.collect()), key=str) == sorted([(1, "a", 1), (1, "b", 2), (1, "c", 1), (None, "d", 2)], key=str)
    found = dtm.lemmatised_terms(terms, F.broadcast(lemmas))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 1), (1, "c", 2), (None, "d", 2)], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(id#") == 1 and ", term#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(id#" in x)


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(1, "a b* b"), (2, None), (3, "*"), (4, "")], "id long, text string")
    terms = dtm.terms_of(docs, "id", F.regexp_replace("text", "[^a-z*]+", " "))
    assert {tuple(r) for r in terms.collect()} == {(1, "a", 1), (1, "b", 2)}
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize("least", [1, 3, 20])
def test_pairs_by_equal_parts(spark, least):
    r = random.Random(least)
    by = {}
    for i in range(150):
        docs = set(r.sample(range(400), min(400, int(least * r.choice([1, 1, 1.3, 2, 5])))))
        by[f"t{i}"] = docs
        for x in "abc"[: i % 4]:
            by[f"t{i}{x}"] = {d if r.random() < 0.96 else r.randrange(400) for d in docs}
    expected = {(a, b) for a, b in itertools.combinations(sorted(by), 2) if 100 * len(by[a] & by[b]) ** 2 >= 81 * len(by[a]) * len(by[b])}
    n = {t: len(docs) for t, docs in by.items()}
    table = spark.createDataFrame([(d, t, 1, n[t]) for t, docs in by.items() for d in docs], "id int, term string, val int, n long")
    assert {(x.a, x.b) for x in dtm.cosine_pairs(table.drop("n"), 9, 10).collect()} == expected and len(expected) > 20
    found = {(x.a, x.b) for x in dtm._part_candidates(table, 9, 10).collect()}
    assert found >= expected and (least < 20 or len(found) < 2 * len(expected))


@pytest.mark.parametrize("weighted", [False, True])
def test_few_pairs_are_summed_over_later_documents(spark, monkeypatch, weighted):
    """Common terms of different documents meet in the prefixes; what each class of documents can hold of both rules them out."""
    kept = {}
    real = dtm.written

    def seen(df, name):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(dtm, "written", seen)
    r = random.Random(5)
    sets = {f"t{i:02}": {d for d in range(600) if r.random() < 0.5} for i in range(24)}
    sets["twin"] = {d for d in sets["t03"] if r.random() < 0.98}
    rows = [(d, t, 1) for t, ds in sets.items() for d in ds] + [(d, f"pad{d}_{i}", 1) for d in range(600) for i in range(d % 40)]
    weights = spark.createDataFrame([(d, 1 + d % 3) for d in range(600)], "id long, w int") if weighted else None
    found = {(x.a, x.b): x.c for x in dtm.cosine_pairs(spark.createDataFrame(rows, "id long, term string, val int").where("term not like 'pad%' or id % 40 < 39"), 4, 5, weights).collect() if not x.a.startswith("pad")}
    assert found == {("t03", "twin"): sum(1 + d % 3 if weighted else 1 for d in sets["t03"] & sets["twin"])}
    common = lambda name: kept[name].where("a not like 'pad%'").count()
    assert common("candidates") > 100 and common("likely") < 10
    assert "term" not in kept["prefixes"].columns  # the many pairs have numbers
