"""Decision table: scores joined to orders with flags, levels, exposure and
actions (G1-G13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import RISK4_LABELS, flag_at, map_values, risk_level_4
from orderlens.functions.contracts import ContractError, present, require_columns

# Contracts, exported order columns, thresholds and label maps of the decision table.
DECISION_ORDER_REQUIRED = (
    "order_id", "revenue", "order_profit_per_order", "delivery_timing_group", "shipping_mode",
    "order_region", "market", "customer_segment", "shipping_delay_days", "loss_flag",
)
SCORE_REQUIRED = ("order_id", "late_delivery_risk", "late_delivery_probability")
DECISION_ORDER_COLUMNS = (
    "order_id", "order_date", "shipping_date", "revenue", "order_profit_per_order",
    "delivery_timing_group", "shipping_mode", "order_region", "market", "customer_segment",
    "days_for_shipping_real", "days_for_shipment_scheduled", "shipping_delay_days", "quantity",
    "unique_products", "unique_categories", "order_lines", "loss_flag",
)
DECISION_THRESHOLDS = ((0.30, "030"), (0.40, "040"))
CONFUSION = {(1, 1): "True Positive", (0, 0): "True Negative",
             (0, 1): "False Positive", (1, 0): "False Negative"}
ACTIONS = {
    "Low": "Standard Monitoring",
    "Watch": "Review if Capacity Allows",
    "High": "Priority Review",
    "Critical": "Immediate Intervention",
}


def decision_columns(orders: DataFrame) -> DataFrame:
    """G1: the exported order columns that exist."""
    require_columns(orders, DECISION_ORDER_REQUIRED, "orders")
    return orders.select(*present(orders, DECISION_ORDER_COLUMNS))


def join_scores(scores: DataFrame, orders: DataFrame) -> DataFrame:
    """Scores left-joined to the order columns on ``order_id`` (both at
    order grain: one shuffle each side, none when both are stored
    partitioned or bucketed by ``order_id``)."""
    require_columns(scores, SCORE_REQUIRED, "scores")
    return scores.select(*SCORE_REQUIRED).join(decision_columns(orders), "order_id", "left")


def validate_join(joined: DataFrame, key: str = "order_id", column: str = "revenue") -> DataFrame:
    """G3 + G4 in one job: a key seen twice after the left join means a
    duplicate on either side; a missing ``column`` means an order that is
    absent or has no revenue."""
    row = (joined.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                   F.max(F.col(column).isNull().cast("int")).alias("orphan"))
           .agg(F.max("n").alias("max_n"), F.max("orphan").alias("orphans")).first())
    if row["max_n"] is not None and row["max_n"] > 1:
        raise ContractError(f"join on {key} is not one-to-one")
    if row["orphans"]:
        raise ContractError(f"scored orders without {column} in the order table")
    return joined


def orphan_scores(scores: DataFrame, orders: DataFrame) -> DataFrame:
    """Diagnosis for G4: scored orders with no order row at all."""
    return scores.join(orders.select("order_id"), "order_id", "left_anti")


def confusion_label(y: str, yhat: str):
    """Outcome label from two integers; missing label → NULL."""
    yc, pc = F.col(y), F.col(yhat)
    expr = None
    for (a, b), label in CONFUSION.items():
        cond = (yc == a) & (pc == b)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def with_decision_columns(joined: DataFrame,
                          thresholds: Sequence[tuple[float, str]] = DECISION_THRESHOLDS) -> DataFrame:
    """Flags, four-level risk, confusion labels, revenue and profit
    at risk per threshold, recommended action — one projection."""
    p = "late_delivery_probability"
    cols = {}
    for t, tag in thresholds:
        cols[f"prediction_{tag}"] = flag_at(p, t)
    cols["risk_level"] = risk_level_4(p)
    out = joined.withColumns(cols)
    more = {}
    for _, tag in thresholds:
        more[f"prediction_result_{tag}"] = confusion_label("late_delivery_risk", f"prediction_{tag}")
    for _, tag in thresholds:
        more[f"revenue_at_risk_{tag}"] = F.when(F.col(f"prediction_{tag}") == 1, F.col("revenue")) \
            .otherwise(F.lit(0.0))
    for _, tag in thresholds:
        more[f"profit_at_risk_{tag}"] = F.when(
            F.col(f"prediction_{tag}") == 1, F.col("order_profit_per_order")).otherwise(F.lit(0.0))
    more["recommended_action"] = map_values("risk_level", ACTIONS)
    return out.withColumns(more)


def decision_table(scores: DataFrame, orders: DataFrame, validate: bool = True) -> DataFrame:
    """The dashboard table."""
    joined = join_scores(scores, orders)
    if validate:
        validate_join(joined)
    return with_decision_columns(joined)


def risk_distribution(decision: DataFrame) -> DataFrame:
    """Orders per risk level, empty levels listed with 0 and a missing
    level listed when present. The four labels are generated in the plan
    (no side table), the counts come from one grouping."""
    counts = decision.groupBy("risk_level").agg(F.count(F.lit(1)).alias("orders"))
    wide = counts.agg(*[F.coalesce(F.sum(F.when(F.col("risk_level") == lab, F.col("orders"))),
                                   F.lit(0)).alias(lab) for lab in RISK4_LABELS],
                      F.sum(F.when(F.col("risk_level").isNull(), F.col("orders"))).alias("missing"))
    rows = [F.struct(F.lit(i + 1).alias("level_order"), F.lit(lab).alias("risk_level"),
                     F.col(f"`{lab}`").cast("long").alias("orders"))
            for i, lab in enumerate(RISK4_LABELS)]
    rows.append(F.struct(F.lit(len(RISK4_LABELS) + 1).alias("level_order"),
                         F.lit(None).cast("string").alias("risk_level"),
                         F.col("missing").cast("long").alias("orders")))
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.filter(F.col("risk_level").isNotNull() | F.col("orders").isNotNull())


def confusion_counts(decision: DataFrame,
                     thresholds: Sequence[tuple[float, str]] = DECISION_THRESHOLDS) -> DataFrame:
    """Orders per outcome label at each threshold (missing labels left
    out), all thresholds in one grouping."""
    stacked = decision.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"prediction_result_{tag}").alias("prediction_result"))
        for t, tag in thresholds])).alias("c")).select("c.*")
    return (stacked.filter(F.col("prediction_result").isNotNull())
            .groupBy("threshold", "prediction_result").agg(F.count(F.lit(1)).alias("orders")))


def decision_profile(decision: DataFrame) -> DataFrame:
    """Rows and columns exported, first and last order date."""
    return decision.agg(F.count(F.lit(1)).alias("rows_exported"),
                        F.lit(len(decision.columns)).alias("columns_exported"),
                        F.min("order_date").alias("first_order_date"),
                        F.max("order_date").alias("last_order_date"))


__all__ = ["decision_table", "join_scores", "validate_join", "with_decision_columns",
           "risk_distribution", "confusion_counts", "decision_profile", "orphan_scores"]
