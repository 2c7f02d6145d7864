import pytest

from orderlens.functions.contracts import (
    ContractError, assert_dates, assert_unique, present, require_columns,
)
from orderlens.operators import decision, features
from orderlens.sources.io import read_lines


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_lines(spark, str(tmp_path / "absent.csv"))


def test_required_columns_sorted(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ContractError, match="b, c"):
        require_columns(df, {"c", "a", "b"}, "t")
    assert present(df, ["z", "a"]) == ["a"]


def test_invalid_dates_abort(spark):
    df = spark.createDataFrame([(1, None)], "order_id int, order_date timestamp")
    with pytest.raises(ContractError):
        assert_dates(df, "order_date")


def test_invalid_date_ends_the_feature_job(spark):
    columns = ("order_id int, line int, order_date string, late_delivery_risk int, days_for_shipment int, shipping_mode string, order_region string, "
               "market string, customer_segment string, type string, order_item_total double, order_profit_per_order double, "
               "order_item_quantity int, order_item_discount double, order_item_cardprod_id int, category_id string")
    rest = (1, 2, "a", "r", "m", "s", "t", 1.5, 2.0, 3, 0.25, 7, "c")
    df = spark.createDataFrame([(1, 1, "2018-01-31", *rest), (1, 2, "no date", *rest)], columns)
    with pytest.raises(Exception, match="invalid values in order_date"):
        features.order_features(df, ["line"]).collect()
    assert features.order_features(df, ["line"], check_dates=False).count() == 1


def _orders(spark, rows):
    return spark.createDataFrame(rows, "order_id long, revenue double, order_profit_per_order double, "
                                 "delivery_timing_group string, shipping_mode string, order_region string, "
                                 "market string, customer_segment string, shipping_delay_days int, loss_flag int")


def _scores(spark, rows):
    return spark.createDataFrame(rows, "order_id long, late_delivery_risk int, late_delivery_probability double")


ROW = ("Late", "Standard Class", "West", "Europe", "Consumer", 1, 0)


@pytest.mark.parametrize("scores,orders", [
    ([(1, 1, 0.5), (1, 1, 0.5)], [(1, 10.0, 1.0, *ROW)]),                      # duplicate left
    ([(1, 1, 0.5)], [(1, 10.0, 1.0, *ROW), (1, 11.0, 1.0, *ROW)]),             # duplicate right
    ([(1, 1, 0.5), (2, 0, 0.1)], [(1, 10.0, 1.0, *ROW)]),                      # order absent
    ([(1, 1, 0.5)], [(1, None, 1.0, *ROW)]),                                   # revenue missing
])
def test_join_checks(spark, scores, orders):
    with pytest.raises(ContractError):
        decision.decision_table(_scores(spark, scores), _orders(spark, orders))


def test_join_ok_and_unique(spark):
    out = decision.decision_table(_scores(spark, [(1, 1, 0.35)]), _orders(spark, [(1, 10.0, -1.0, *ROW)]))
    r = out.first()
    assert (r.prediction_030, r.prediction_040, r.risk_level, r.prediction_result_030,
            r.revenue_at_risk_030, r.revenue_at_risk_040, r.recommended_action) == \
        (1, 0, "Watch", "True Positive", 10.0, 0.0, "Review if Capacity Allows")
    assert_unique(out, "order_id")
