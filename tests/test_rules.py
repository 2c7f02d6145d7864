"""Literal rows for the pandas-vs-Spark rules (FIXTURES.md §5)."""

import math

import pytest
from pyspark.sql import functions as F

from orderlens.functions import columns as C
from orderlens.functions.contracts import ContractError
from orderlens.operators import clean, orders
from orderlens.operators.order_kpi import value_share


def test_bin_edges(spark):
    ps = [0.0, 0.30, 0.300001, 0.40, 0.70, 1.0, -0.1, 1.1, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    rows = df.select("i", C.risk_level_4("p").alias("l4"), C.risk_level_3("p").alias("l3"),
                     C.flag_at("p", 0.30).alias("f30"), C.flag_at("p", 0.40).alias("f40")) \
        .orderBy("i").collect()
    assert [r.l4 for r in rows] == ["Low", "Low", "Watch", "Watch", "High", "Critical", None, None, None]
    assert [r.l3 for r in rows] == ["Low", "Low", "Low", "Low", "Medium", "High", None, None, None]
    # 0.30 is flagged yet Low; 0.40 is flagged at 0.40 yet Watch
    assert [r.f30 for r in rows] == [0, 1, 1, 1, 1, 1, 0, 1, 0]
    assert [r.f40 for r in rows] == [0, 0, 0, 1, 1, 1, 0, 1, 0]


def test_division_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (0.0, -5.0), (10.0, 5.0)], "r double, p double")
    got = [(r.g, r.s) for r in df.select(C.ratio_with_inf("p", "r").alias("g"),
                                         C.ratio_or_zero("p", "r").alias("s")).collect()]
    assert got[0] == (0.0, 0.0)
    assert got[1][0] == math.inf and got[1][1] == 0.0
    assert got[2][0] == -math.inf and got[2][1] == 0.0
    assert got[3] == (0.5, 0.5)


def test_missing_group_and_all_missing_sum(spark):
    df = spark.createDataFrame([(None, None), (None, None), ("a", 1.0)], "d string, x double")
    got = {r.d: r.s for r in df.groupBy("d").agg(C.money_sum("x").alias("s")).collect()}
    assert got == {None: 0.0, "a": 1.0}


def test_first_non_missing(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (1, 3, "c"), (2, 2, "y"), (2, 1, "x")],
                               "k int, line int, v string")
    got = {r.k: r.f for r in df.groupBy("k").agg(C.first_non_missing("v", ["line"]).alias("f")).collect()}
    assert got == {1: "b", 2: "x"}


def test_distinct_with_missing(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None), (3, "a"), (3, "a")], "k int, v string")
    got = {r.k: (r.n, r.nm, r.many) for r in df.groupBy("k").agg(
        C.nunique("v").alias("n"), C.nunique_with_missing("v").alias("nm"),
        C.has_many_values("v").alias("many")).collect()}
    assert got == {1: (1, 2, True), 2: (0, 1, False), 3: (1, 1, False)}


def test_share_denominators(spark):
    df = spark.createDataFrame([("Late",), (None,), ("On Time",)], "delivery_timing_group string")
    r = df.agg(value_share("delivery_timing_group", "Late").alias("kpi"),
               C.rate(F.col("delivery_timing_group") == "Late").alias("bd")).first()
    assert r.kpi == 0.5 and abs(r.bd - 1 / 3) < 1e-15


def test_unknown_status_passes_through(spark):
    df = spark.createDataFrame([("Lost in transit",), ("Late delivery",), (None,)], "delivery_status string")
    got = [r.t for r in df.select(orders.timing_from_status("delivery_status").alias("t")).collect()]
    assert got == ["Lost in transit", "Late", None]


def test_normalize_names(spark):
    df = spark.createDataFrame([(1, 2)], ["  Days for shipping (real) ", "Order  Id"])
    assert clean.normalize_names(df).columns == ["days_for_shipping_real", "order_id"]
    with pytest.raises(ContractError):
        clean.normalize_names(spark.createDataFrame([(1, 2)], ["A b", "a_b"]))


def test_whitespace_and_tokens(spark):
    df = spark.createDataFrame([("\tx\t",), (" y ",), ("   ",), ("n/a",), (" z ",)], "s string")
    got = [r.s for r in clean.clean_strings(df).collect()]
    assert got == ["x", "y", None, None, "z"]


def test_timestamp_and_numeric_coercion(spark):
    df = spark.createDataFrame([("2000-04-10", "12.5", "3"), ("not a date", "n/a", "x"),
                                ("1/31/2017 22:56", "NaN", "4")],
                               "order_date string, sales string, late_delivery_risk string")
    out = clean.coerce_numeric(clean.coerce_timestamps(df)).collect()
    assert str(out[0].order_date) == "2000-04-10 00:00:00" and out[0].sales == 12.5
    assert out[1].order_date is None and out[1].sales is None and out[1].late_delivery_risk is None
    assert str(out[2].order_date) == "2017-01-31 22:56:00" and out[2].sales is None


def test_profit_and_timing_defaults(spark):
    df = spark.createDataFrame([(None, 3, 2), (-1.0, None, 2), (2.0, 1, 2)],
                               "order_profit_per_order double, days_for_shipping_real int, "
                               "days_for_shipment_scheduled int")
    out = clean.derive_line_columns(df).collect()
    assert [r.profit_status for r in out] == ["Profit", "Loss", "Profit"]
    assert [r.delivery_timing_group for r in out] == ["Late", "On Time", "Early"]


def test_weekday_and_day_name(spark):
    from orderlens.operators.clean import with_calendar
    df = spark.createDataFrame([("2024-01-01",)], "d string").select(
        F.to_timestamp("d").alias("order_date"))
    r = with_calendar(df).select("order_day_of_week", "order_month", "order_year",
                                 F.weekday("order_date").alias("wd")).first()
    assert (r.order_day_of_week, r.order_month, r.order_year, r.wd) == ("Monday", "2024-01", 2024, 0)


def test_first_value_flags_count_distinct(spark):
    # a hot key (most rows), repeated values, missing values, a key with none
    from orderlens.functions.shapes import distinct_count, flag_first_values
    rows = [(1, p % 7 if p % 5 else None, f"c{p % 3}") for p in range(300)]
    rows += [(2, 4, None), (2, 4, None), (3, None, None)]
    df = spark.createDataFrame(rows, "k int, p int, c string").repartition(4, "k")
    got = {r.k: (r.np, r.nc) for r in flag_first_values(df, "k", ["p", "c"]).groupBy("k").agg(
        distinct_count("p").alias("np"), distinct_count("c").alias("nc")).collect()}
    want = {r.k: (r.np, r.nc) for r in df.groupBy("k").agg(
        F.countDistinct("p").alias("np"), F.countDistinct("c").alias("nc")).collect()}
    assert got == want == {1: (7, 3), 2: (1, 0), 3: (0, 0)}


def test_auto_profit_rule_from_order_table(spark):
    # D3 as a scalar subquery: 'first' when every order holds one profit value
    # (repeated on each line; missing counts as a value), else 'sum'
    schema = ("order_id long, order_item_id int, order_item_total double, order_item_quantity int, "
              "order_profit_per_order double, delivery_status string, late_delivery_risk int, "
              "days_for_shipping_real int, days_for_shipment_scheduled int")
    base = [(1, 1, 10.0, 1, 5.0, "Late delivery", 1, 3, 2), (1, 2, 20.0, 2, 5.0, "Late delivery", 1, 3, 2),
            (2, 1, 7.0, 1, -2.0, "Shipping on time", 0, 2, 2), (2, 2, 3.0, 1, -2.0, "Shipping on time", 0, 2, 2)]
    const = spark.createDataFrame(base, schema)
    varied = spark.createDataFrame(base + [(2, 3, 1.0, 1, -1.0, "Shipping on time", 0, 2, 2)], schema)
    got = {r.order_id: r.order_profit_per_order for r in orders.build_orders(const).collect()}
    assert got == {1: 5.0, 2: -2.0}
    assert spark.range(1).select(orders.choose_profit_rule(const)).first()[0] == "first"
    got = {r.order_id: r.order_profit_per_order for r in orders.build_orders(varied).collect()}
    assert got == {1: 10.0, 2: -5.0}
    assert spark.range(1).select(orders.choose_profit_rule(varied)).first()[0] == "sum"


def test_rule_follows_from_the_written_table(spark, tmp_path):
    schema = ("order_id long, order_item_id int, order_item_total double, order_item_quantity int, "
              "order_profit_per_order double, delivery_status string, late_delivery_risk int, "
              "days_for_shipping_real int, days_for_shipment_scheduled int")
    df = spark.createDataFrame([(1, 1, 1.0, 1, 2.0, "Late delivery", 1, 3, 2),
                                (1, 2, 1.0, 1, 3.0, "Late delivery", 1, 3, 2)], schema)
    for frame, rule, profit in ((df, "sum", 5.0), (df.filter("order_item_id = 1"), "first", 2.0), (df.limit(0), "first", None)):
        path = str(tmp_path / f"{rule}{profit}")
        orders.order_candidates(frame).write.parquet(path)
        written = spark.read.parquet(path)
        assert orders.written_rule(written) == rule
        got = orders.finish_orders(written, rule).first()
        assert (got and got.order_profit_per_order) == profit
    with pytest.raises(ValueError):
        orders.build_orders(df, profit_rule="last")
