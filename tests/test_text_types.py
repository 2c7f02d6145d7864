"""Texts that cannot be numbers or dates are not tried as such, with the same results."""

import pytest
from pyspark.sql import functions as F

from orderlens.functions.columns import NUMBER_SHAPE, WHITESPACE, clean_text, strip_blank, text_to_double
from orderlens.operators import clean


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NUMBERS = ["1", "-2.5", "+3", "1e5", "1E-5", ".5", "5.", "1d", "2.5F", "0x1p3", "0x1.8P-2", "NaN", "nan", "inf", "-Infinity", "+INF",
           "infinit", "\x011\x02", " 7 ", "", "-", "+", ".", "e5", "1-2", "1998-01-02", "n/a", "In Transit", "1,5", "１", "--1", "1 2", "0x", "1e", None]


def test_number_shape_refuses_no_number(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string")
    both = df.select(text_to_double("t").cast("string").alias("a"), F.col("t").try_cast("double").cast("string").alias("b"))
    assert all(r.a == r.b for r in both.collect())
    # the dates are not tried: a failed cast is an exception
    assert [r[0] for r in df.where("t rlike '[a-zA-Z]{3} |[0-9]-[0-9]'").select(F.col("t").rlike(NUMBER_SHAPE)).collect()] == [False] * 2


def test_blank_ends(spark):
    texts = [a + x + b for a in ("", " ", "\t\n", "\x1f", "\x85", " ", "　", "é", "​") for b in ("", " ", " ", "\x1c", "ü")
             for x in ("", "a", "a b", "N/A")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(set(t) - set(WHITESPACE) or not t.strip() for t in texts)
    for r in df.select("t", strip_blank("t").alias("s"), clean_text("t", ("N/A",)).alias("c")).collect():
        assert r.s == (r.t.strip() or None), r
        assert r.c == (None if r.t == "N/A" else r.t.strip() or None), r


@pytest.mark.parametrize("text", ["1998-01-02", "1998-01-02 03:04", "1998-01-02 03:04:05", "1998-01-02t03:04:05", "1/2/1998", "1/2/1998 3:04",
                                  "01/02/1998 13:04:05", "1998-01-02 03:04:05.25", "not a date", "1998-13-01", "1998/01/02", " 1998-01-02", "", None])
def test_formats_are_tried_where_they_may_fit(spark, text):
    df = spark.createDataFrame([(text,)], "order_date string")
    every = F.coalesce(*[F.try_to_timestamp("order_date", F.lit(f)) for f in clean.TIMESTAMP_FORMATS], F.col("order_date").try_cast("timestamp"))
    got = clean.coerce_timestamps(df)
    assert got.first()[0] == df.select(every.cast("timestamp_ntz")).first()[0]
    assert plan(got).count("RLIKE") >= len(clean.TIMESTAMP_FORMATS)
