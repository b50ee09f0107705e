import pytest
from pyspark.sql import functions as F

from veritable.functions import scores, wording


def show(spark, value, expr):
    return spark.createDataFrame([(value,)], "v double").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value, text",
    [(500000.0, "500,000"), (2346.05, "2,346"), (34.493, "34.49"), (0.05, "0.05"), (1.5, "1.5"), (-1234.0, "-1,234"),
     (0.0, "0"), (99.999, "100"), (0.12345, "0.1235"), (float("inf"), "Infinity"), (100.5, "100"), (101.5, "102")],
)
def test_human_number(spark, value, text):
    assert show(spark, value, wording.human_number) == text


@pytest.mark.parametrize("value, text", [(1234.5, "1,234.5"), (0.001, "0"), (12.0, "12"), (3.14159, "3.14")])
def test_chart_number(spark, value, text):
    assert show(spark, value, wording.chart_number) == text


@pytest.mark.parametrize("value, text", [(466.0, "about 5.5×"), (480.0, "almost 6×"), (250.0, "about 3.5×"), (-300.0, "about 4×")])
def test_multiple(spark, value, text):
    assert show(spark, value, wording.multiple_phrase) == text


@pytest.mark.parametrize("value, text", [(12.4, "+12%"), (-50.0, "-50%"), (200.0, "+200%"), (201.0, "about 3× more")])
def test_signed_percent(spark, value, text):
    assert show(spark, value, wording.signed_percent) == text


@pytest.mark.parametrize(
    "text, first",
    [("One. Two.", "One."), ("Value 500000.0 is high. More.", "Value 500000.0 is high."),
     ("All of it (r 0.5, n 10)", "All of it"), ("A (b) c! D", "A (b) c!"), ("", ""), (None, "")],
)
def test_first_sentence(spark, text, first):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(wording.first_sentence(F.col("t"))).first()[0] == first


def test_scores_stay_in_bounds(spark):
    rows = [(n, e / 4) for n in (0, 1, 25, 50, 10_000) for e in range(-2, 7)]
    df = spark.createDataFrame(rows, "n long, e double")
    found = df.select(
        "n", "e", scores.confidence(F.col("n"), F.col("e")).alias("c"),
        scores.trust(F.col("n"), F.col("e"), F.lit(0.9)).alias("t"),
    ).collect()
    assert all(0 <= r.c <= 1 and 0 <= r.t <= 100 for r in found)
    by = {(r.n, r.e): (r.c, r.t) for r in found}
    assert by[25, 0.5] == (0.25, 22) and by[50, 1.0] == (1.0, 0) and by[10_000, 0.0] == (0.0, 90)


def test_trust_rounds_half_to_even(spark):
    df = spark.createDataFrame([(50, 0.005), (50, 0.015), (50, 0.025)], "n long, c double")
    found = [r[0] for r in df.select(scores.trust(F.col("n"), F.lit(0.0), F.col("c"))).collect()]
    assert found == [0, 2, 2]
