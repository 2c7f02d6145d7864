"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole driver tables (through the fixture mapping)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.operators import clean, line_kpi, order_kpi, orders
from orderlens.sources.fixtures import LINE_ORDER, fx_lines, fx_lines_constant, fx_lines_raw, fx_lines_text
from orderlens.sources.io import infer_numbers

Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark, d):
    return clean.derive_line_columns(fx_lines(spark, d))


def _orders(spark, d):
    # one lazy plan, the profit rule a scalar subquery: each query prunes it down to the scan
    return orders.build_orders(fx_lines(spark, d), LINE_ORDER)


def _timing_groups(spark, d):
    # no profit column is read, so the rule need not be found
    return orders.build_orders(fx_lines(spark, d), LINE_ORDER, "sum").select("delivery_timing_group")


def _line_bd(spark, d):
    return line_kpi.line_breakdown(_lines(spark, d))


def _order_bd(spark, d):
    return order_kpi.order_breakdown(_orders(spark, d), unique_keys=True)


QUERIES: dict[str, Query] = {
    # A raw file's text columns, typed by what they hold, named, cleaned and derived
    "a1_typed_lines": lambda s, d: clean.prepare_lines(infer_numbers(fx_lines_text(s, d))),
    # B: cleaning and data quality
    "b13_duplicate_count": lambda s, d: clean.duplicate_count(clean.type_lines(fx_lines_raw(s, d))),
    "b14_clean_lines": lambda s, d: clean.clean_lines(fx_lines_raw(s, d)),
    "b15_missing_by_column": lambda s, d: clean.missing_by_column(clean.clean_lines(fx_lines_raw(s, d))),
    "b16_cleaning_profile": lambda s, d: clean.cleaning_profile(clean.type_lines(fx_lines_raw(s, d))),
    # C: line-level KPIs
    "c10_line_kpis": lambda s, d: line_kpi.line_kpis(_lines(s, d)),
    "c11_line_breakdown": _line_bd,
    "c14_worst_late_lines": lambda s, d: line_kpi.worst_late_lines(_line_bd(s, d)),
    "c14_worst_late_lines_600": lambda s, d: line_kpi.worst_late_lines(_line_bd(s, d), min_orders=600),
    "c15_worst_profit_lines": lambda s, d: line_kpi.worst_profit_lines(_line_bd(s, d)),
    "c15_worst_profit_lines_600": lambda s, d: line_kpi.worst_profit_lines(_line_bd(s, d), min_orders=600),
    # D: lines → orders
    "d1_field_conflicts": lambda s, d: orders.field_conflicts(fx_lines(s, d)),
    "d2_profit_constant": lambda s, d: orders.profit_constant_per_order(fx_lines(s, d)),
    "d4_build_orders": _orders,
    "d4_build_orders_constant": lambda s, d: orders.build_orders(fx_lines_constant(s, d), LINE_ORDER),
    "d9_timing_counts": lambda s, d: orders.value_counts(_timing_groups(s, d), "delivery_timing_group"),
    "d10_orders_profile": lambda s, d: orders.orders_profile(fx_lines(s, d), LINE_ORDER),
    # E: order-level KPIs
    "e7_order_kpis": lambda s, d: order_kpi.order_kpis(_orders(s, d), unique_keys=True),
    "e8_order_breakdown": _order_bd,
    "e11_worst_late_orders": lambda s, d: order_kpi.worst_late_orders(_order_bd(s, d)),
    "e11_worst_late_orders_600": lambda s, d: order_kpi.worst_late_orders(_order_bd(s, d), min_orders=600),
    "e12_worst_margin_orders": lambda s, d: order_kpi.worst_margin_orders(_order_bd(s, d)),
    "e12_worst_margin_orders_600": lambda s, d: order_kpi.worst_margin_orders(_order_bd(s, d), min_orders=600),
}


# ---- F: features, split, fitted statistics, metrics on fixed scores ----------

from pyspark.sql import functions as F  # noqa: E402

from orderlens.operators import evaluate, features, models  # noqa: E402
from orderlens.plans.stage_tables import feature_table, order_table, score_table  # noqa: E402
from orderlens.sources.fixtures import fx_absent_scores, fx_scores  # noqa: E402

NUMERIC_FEATURES = ("days_for_shipment", "order_value", "quantity", "discount", "unique_products",
                    "unique_categories", "order_month", "order_day_of_week")
CATEGORICAL_FEATURES = ("shipping_mode", "order_region", "market", "customer_segment", "order_type")


def _features(s, d):
    return features.order_features(fx_lines(s, d), LINE_ORDER)


def _train(s, d):
    return features.split_frames(feature_table(s, d))[0]


def _test(s, d):
    return features.split_frames(feature_table(s, d))[1]


def _medians(s, d):
    med = features.fit_medians(_train(s, d), NUMERIC_FEATURES)
    return s.createDataFrame([(c, med[c]) for c in NUMERIC_FEATURES], "feature string, median double")


def _scaler(s, d):
    train = _train(s, d)
    filled = features.impute(train, features.fit_medians(train, NUMERIC_FEATURES), {})
    return models.scaler_table(filled, NUMERIC_FEATURES).select(
        "feature", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


def _test_codes(s, d):
    # a market that no training order has
    test = _test(s, d).withColumn("market", F.when(F.col("order_id") % 50 == 0, "ATLANTIS").otherwise(F.col("market")))
    coded = models.fit_ordinal(_train(s, d), CATEGORICAL_FEATURES)(test)
    return coded.select("order_id", *[F.col(f"{c}__code").cast("int").alias(f"{c}_code") for c in CATEGORICAL_FEATURES])


def _scores(s, d):
    return fx_scores(fx_lines(s, d))


def _grid(s, d):
    return evaluate.threshold_metrics(_scores(s, d), exclude=("baseline",))


def _final(s, d):
    sc = score_table(s, d)
    best = evaluate.select_best(evaluate.threshold_metrics(sc, exclude=("baseline",)))
    return evaluate.final_predictions(sc, best, orders=_test(s, d))


QUERIES.update({
    "f2_order_features": _features,
    "f5_time_split": lambda s, d: feature_table(s, d).select("order_id", "order_date", "split"),
    "f6_split_profile": lambda s, d: features.split_profile(feature_table(s, d)),
    "f8_medians": _medians,
    "f9_modes": lambda s, d: features.mode_table(_train(s, d), CATEGORICAL_FEATURES),
    "f12_ordinal_codes": lambda s, d: features.ordinal_codes(_train(s, d), CATEGORICAL_FEATURES),
    "f10_scaler": _scaler,
    "f12_test_codes": _test_codes,
    "f15_baselines": lambda s, d: features.baseline_scores(_test(s, d), _train(s, d)),
    "f21_predictions": lambda s, d: evaluate.predictions(_scores(s, d)),
    "f22_accuracy": lambda s, d: evaluate.accuracy(evaluate.predictions(_scores(s, d))),
    "f23_roc_auc": lambda s, d: evaluate.roc_auc(_scores(s, d)),
    "f24_class_report": lambda s, d: evaluate.class_report(evaluate.predictions(_scores(s, d))),
    "f25_metrics_at_050": lambda s, d: evaluate.metrics_at(_scores(s, d), 0.5),
    "f26_model_comparison": lambda s, d: evaluate.model_comparison(_scores(s, d)),
    "f27_threshold_grid": _grid,
    "f28_select_best": lambda s, d: evaluate.select_best(_grid(s, d)),
    "f29_final_predictions": _final,
})


# ---- G, H: decision table and dashboard aggregates ---------------------------

from orderlens.operators import dashboard, decision  # noqa: E402

DECISION_MODEL = "model_a"


def _model_scores(s, d):
    return score_table(s, d).filter(F.col("model") == DECISION_MODEL).drop("model")


def _decision(s, d):
    # the score table's join with the order table was checked when it was written
    return decision.decision_table(_model_scores(s, d), order_table(s, d), validate=False)


QUERIES.update({
    "g2_join_scores": lambda s, d: decision.join_scores(_model_scores(s, d), order_table(s, d)),
    "g4_orphan_scores": lambda s, d: decision.orphan_scores(fx_absent_scores(_model_scores(s, d)), order_table(s, d)),
    "g10_decision_table": _decision,
    "g11_risk_distribution": lambda s, d: decision.risk_distribution(_decision(s, d)),
    "g12_confusion_counts": lambda s, d: decision.confusion_counts(_decision(s, d)),
    "g13_decision_profile": lambda s, d: decision.decision_profile(_decision(s, d)),
    "h1_headline": lambda s, d: dashboard.headline(_decision(s, d)),
    "h2_late_by_mode": lambda s, d: dashboard.late_by_mode(_decision(s, d)),
    "h3_revenue_flagged_by_region": lambda s, d: dashboard.revenue_flagged_by_region(_decision(s, d)),
    "h4_review_workload": lambda s, d: dashboard.review_workload(_decision(s, d)),
    "h5_review_queue": lambda s, d: dashboard.review_queue(_decision(s, d)),
    "h5_review_queue_overall": lambda s, d: dashboard.review_queue_overall(_decision(s, d)),
})


# ---- F16-F19: fitted models (rows-only check: scores of a fitted model have no SQL twin) ----

from orderlens.plans import jobs  # noqa: E402


def _fitted_decision(s, d):
    # the chain of the last two scripts: fitted scores of the best pair, joined to the orders
    run = jobs.model_comparison_run(s, None, LINE_ORDER, which=("baseline", "logistic"), split=feature_table(s, d))
    return decision.decision_table(run["final_predictions"], order_table(s, d))


QUERIES.update({
    "f19_logistic_scores": lambda s, d: jobs.fitted_scores(s, feature_table(s, d), "logistic"),
    "f26_fitted_comparison": lambda s, d: jobs.model_comparison_run(
        s, None, LINE_ORDER, split=feature_table(s, d))["comparison"].drop("fit_seconds"),
    "g10_fitted_decision": _fitted_decision,
})

#: full-size fits of F17 and F18: registered beside QUERIES, which the oracle and plan tests go through
FOREST_AND_BOOSTING = {
    "f17_forest_scores": lambda s, d: jobs.fitted_scores(s, feature_table(s, d), "forest"),
    "f18_boosting_scores": lambda s, d: jobs.fitted_scores(s, feature_table(s, d), "boosting"),
}
