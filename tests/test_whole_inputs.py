"""Registered queries take whole inputs, on tables made here."""

from winnow.queries import QUERIES


def tables(spark, path, texts, good):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_training_set_has_ends_of_abstracts(spark, tmp_path):
    texts = [f"Study of birds\n{'filler words again ' * 40} zebrafish larvae" for _ in range(6)]
    found = QUERIES["training_set"](spark, tables(spark, tmp_path, texts, [1, 0] * 3)).collect()
    assert any("zebrafish" in r.term for r in found if r.field == "ABSTR")


def test_negative_chains_are_whole(spark, tmp_path):
    texts = ["die wort"] * 3 + [f"die nega{i}" for i in range(5)]
    found = QUERIES["selection_with_negatives"](spark, tables(spark, tmp_path, texts, [1] * 3 + [0] * 5)).collect()
    chains = {r.rule: r for r in found if "V__die" in r.rule}
    assert sorted(rule.count("V__nega") for rule in chains) == [0, 1, 2, 3, 4, 5]
    whole = max(chains.values(), key=lambda r: r.rule.count("V__nega"))
    assert (whole.pos, whole.neg) == (3, 0)
