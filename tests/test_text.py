import pytest
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.functions.numbers import interval, percent


def one(spark, f, *values):
    return [r.v for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("v")).collect()]


def test_authors(spark):
    assert one(spark, T.tokenized_authors, "Wu, Joseph T; Leung, Kathy", "J. A. Smith; K. Lee", None, "Müller, Änne-Marie") == ["Wu_JT Leung_K", "Smith_JA Lee_K", None, "Müller_Ä"]


def test_keywords_and_mesh(spark):
    assert one(spark, T.tokenized_keywords, "Nosocomial infection; game theory") == ["nosocomial_infection game_theory"]
    assert one(spark, T.tokenized_mesh, "Coronavirus Infections/*epidemiology/transmission", "Humans; Birds (wild)", None) == ["Coronavirus_Infections Coronavirus_Infections.sh.*epidemiology Coronavirus_Infections.sh.transmission", "Humans Birds_wild", None]


def test_text(spark):
    assert one(spark, T.tokenized_text, "The state-of-the-art isn't Smith's (new) IDEA!", None, "NA") == ["state of the art isn smith new idea", None, None]
    assert one(spark, lambda x: T.tokenized_text(x, lemmas={"mice": "mouse"}), "Mice and cats") == ["mouse cats"]


def test_cleaned(spark):
    assert one(spark, T.cleaned, "  a ;  b \"c\"  ", "NA", "", "it's") == ["a;b c", None, None, "it s"]


def test_keys(spark):
    assert one(spark, T.title_key, "A Title: été 2!") == ["atitleété2"]
    assert one(spark, T.loose_title_key, "A Title: été 2!") == ["a title été 2"]


def test_numbers(spark):
    df = spark.createDataFrame([(0.00456,), (0.333,), (0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(percent(F.col("x"))).collect()] == ["0.46%", "33.3%", "50%", None]
    assert spark.range(1).select(interval(F.array(F.lit(0.6), F.lit(0.3), F.lit(0.4)), True)).first()[0] == "40% [30%, 60%]"


@pytest.mark.parametrize("digits", [1, 3])
def test_signif(spark, digits):
    from winnow.functions.numbers import signif

    values = [123.456, -0.00123456, 0.0, 9.999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(signif(F.col("x"), digits)).collect()]
    assert got == [pytest.approx(float(f"{v:.{digits}g}")) for v in values]
