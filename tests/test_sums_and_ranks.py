"""Sums without loss, line order written as text, and exact ranks on odd values."""

from __future__ import annotations

from datetime import date

from orderlens.functions import columns as C
from orderlens.functions.selection import exact_medians, kth_smallest
from orderlens.operators import features, models, orders
from pyspark.sql import functions as F


def _sum(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(C.money_sum("x").alias("s")).first().s


def test_money_is_not_cut(spark):
    tiny = spark.range(10_000).select(F.lit(0.00004).alias("x"))
    assert tiny.agg(C.money_sum("x").alias("s")).first().s == 0.4
    many = spark.range(100_000).select(F.lit(314.640015).alias("x"))
    assert many.agg(C.money_sum("x").alias("s")).first().s == 31464001.5
    assert _sum(spark, [1e15, 0.25]) == 1e15 + 0.25
    assert _sum(spark, [1e30, 1.0, None]) == 1e30
    assert _sum(spark, [float("inf"), 1.0]) == float("inf")
    assert _sum(spark, [None, None]) == 0.0


LINES = ("order_id string, order_item_id string, order_item_total double, order_item_quantity double, order_profit_per_order double, "
         "delivery_status string, late_delivery_risk int, days_for_shipping_real int, days_for_shipment_scheduled int, shipping_mode string")


def test_text_line_order_and_fractional_quantity(spark):
    rows = [("A-6", "10", 1.000001, 0.5, 1.0, "New status", 1, 3, 2, "late mode"), ("A-6", "9", 2.000002, 0.5, 1.0, "New status", 1, 3, 2, "first mode"),
            ("A-6", "11", 3.0, 0.7, 1.0, None, 1, 3, 2, None)]
    got = orders.build_orders(spark.createDataFrame(rows, LINES), profit_rule="auto").collect()
    assert len(got) == 1
    row = got[0]
    assert row.shipping_mode == "first mode" and row.quantity == 1.7 and row.revenue == 6.000003
    assert row.order_profit_per_order == 1.0  # constant inside the order: first, not sum
    assert row.delivery_timing_group == "New status"  # unknown text passes through


def test_features_read_the_same_date_forms(spark):
    rows = [(1, 1, "1/31/2018 22:56", 1, 2, "a", "r", "m", "s", "t", 1.5, 2.0, 3, 0.25, 7, "c")]
    df = spark.createDataFrame(rows, "order_id int, line int, order_date string, late_delivery_risk int, days_for_shipment int, shipping_mode string, "
                               "order_region string, market string, customer_segment string, type string, order_item_total double, "
                               "order_profit_per_order double, order_item_quantity int, order_item_discount double, order_item_cardprod_id int, category_id string")
    row = features.order_features(df, ["line"]).first()
    assert row.order_month == 1 and row.quantity == 3 and row.order_date.date() == date(2018, 1, 31)


def test_medians_end_on_infinity(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, inf, inf, inf, None, float("nan"))], "x double")
    assert exact_medians(df, ["x"]) == {"x": inf}
    df = spark.createDataFrame([(x,) for x in (-inf, 1.0, 2.0, inf, None)], "x double")
    assert exact_medians(df, ["x"]) == {"x": 1.5}


def test_ranks_of_64_bit_hashes(spark):
    df = spark.range(2001).select(F.xxhash64("id").alias("h"))
    ordered = sorted(r.h for r in df.collect())
    for k in (1, 700, 2001):
        assert kth_smallest(df, {"h": F.col("h")}, {"h": k}, integral=True)["h"] == ordered[k - 1]


def test_unknown_category_is_all_zeros(spark):
    from pyspark.ml import Pipeline

    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "c")], "n double, c string")
    fitted = Pipeline(stages=models.linear_stages(["n"], ["c"])).fit(train)
    seen, unseen = (fitted.transform(spark.createDataFrame([(1.0, c)], "n double, c string")).first()["c__ohe"] for c in ("b", "zzz"))
    assert seen.toArray().tolist() == [0.0, 1.0, 0.0] and unseen.toArray().tolist() == [0.0, 0.0, 0.0]
