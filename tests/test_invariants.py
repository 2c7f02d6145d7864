
import pytest
from pyspark.sql import functions as F

from orderlens.operators import clean, line_kpi, order_kpi, orders
from orderlens.sources.fixtures import LINE_ORDER, fx_lines


@pytest.fixture(scope="module")
def lines(spark, sf):
    return clean.derive_line_columns(fx_lines(spark, sf)).cache()


@pytest.fixture(scope="module")
def built(lines):
    return orders.build_orders(lines, LINE_ORDER).cache()


def kpi(df, name):
    return df.filter(F.col("kpi") == name).first().value


def test_dimension_sums_equal_totals(lines):
    k = line_kpi.line_kpis(lines)
    bd = line_kpi.line_breakdown(lines)
    for dim in line_kpi.LINE_DIMENSIONS:
        s = bd.filter(F.col("dimension") == dim).agg(F.sum("order_lines"), F.sum("revenue")).first()
        assert s[0] == kpi(k, "Order Lines") == 6000
        assert abs(s[1] - kpi(k, "Revenue")) < 1e-3


def test_shares_add_up(built):
    k = order_kpi.order_kpis(built)
    total = sum(kpi(k, n) for n in ("Late Delivery Rate", "On-Time Delivery Rate",
                                    "Early Delivery Rate", "Cancellation Rate"))
    assert abs(total - 1.0) < 1e-12


def test_line_and_order_totals_agree(lines, built):
    lk, ok = line_kpi.line_kpis(lines), order_kpi.order_kpis(built)
    for name in ("Revenue", "Profit", "Unique Orders"):
        assert kpi(lk, name) == kpi(ok, name)
    assert kpi(lk, "Profit from Late Deliveries") == kpi(ok, "Late Orders Profit")
    assert kpi(ok, "Unique Orders") == 1473


def test_fixture_facts(lines, built):
    assert lines.filter(F.col("late_delivery_risk") == 1).count() == 3127
    counts = {r.delivery_timing_group: r.orders for r in orders.value_counts(
        built, "delivery_timing_group").collect()}
    assert counts == {"Late": 753, "On Time": 182, "Early": 466, "Canceled": 72}
    conflicts = {r.field: r.conflicting_orders for r in orders.field_conflicts(lines).collect()}
    assert conflicts["order_status"] == 1111 and conflicts["order_date"] == 0
    assert lines.sparkSession.range(1).select(orders.choose_profit_rule(lines)).first()[0] == "sum"


def test_dirty_fixture_profile(spark, sf):
    from orderlens.sources.fixtures import fx_lines_raw
    prof = {r.metric: r.value for r in clean.cleaning_profile(
        clean.prepare_lines(fx_lines_raw(spark, sf))).collect()}
    assert prof["rows_before"] == 6116 and prof["rows_after"] == 6000
    assert prof["duplicates_removed"] == 116
