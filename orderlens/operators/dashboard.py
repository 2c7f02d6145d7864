"""Dashboard aggregates over the decision table (H1-H5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.columns import money_sum
from orderlens.operators.decision import DECISION_THRESHOLDS

P = "late_delivery_probability"


def _per_threshold(decision: DataFrame, thresholds: Sequence[tuple[float, str]]) -> DataFrame:
    """Counts for every threshold in one aggregate, unfolded to one row per
    threshold afterwards (rows are never multiplied by the thresholds)."""
    risk = F.col("late_delivery_risk")
    aggs = [F.count(F.lit(1)).alias("orders"), F.count_if(risk == 1).alias("late_orders")]
    for _, tag in thresholds:
        flag = F.col(f"prediction_{tag}") == 1
        aggs += [F.count_if(flag).alias(f"flagged_{tag}"),
                 F.count_if(flag & (risk == 1)).alias(f"tp_{tag}"),
                 money_sum(f"revenue_at_risk_{tag}").alias(f"rev_{tag}"),
                 money_sum(f"profit_at_risk_{tag}").alias(f"profit_{tag}")]
    one = decision.agg(*aggs)
    return one.select("orders", "late_orders", F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"flagged_{tag}").alias("flagged_orders"),
                 F.col(f"tp_{tag}").alias("tp"), F.col(f"rev_{tag}").alias("revenue_flagged"),
                 F.col(f"profit_{tag}").alias("profit_flagged"))
        for t, tag in thresholds])).alias("t")).select("orders", "late_orders", "t.*")


def headline(decision: DataFrame,
             thresholds: Sequence[tuple[float, str]] = DECISION_THRESHOLDS) -> DataFrame:
    """H1: per threshold: orders, late rate, flagged orders, late orders
    detected, revenue flagged."""
    t = _per_threshold(decision, thresholds)
    return t.select("threshold", "orders",
                    F.when(F.col("orders") > 0, F.col("late_orders") / F.col("orders"))
                    .alias("late_delivery_rate"),
                    "flagged_orders", F.col("tp").alias("late_orders_detected"), "revenue_flagged")


def review_workload(decision: DataFrame,
                    thresholds: Sequence[tuple[float, str]] = DECISION_THRESHOLDS) -> DataFrame:
    """H4: per threshold: orders to review, true and false positives, recall,
    precision, revenue and profit under review."""
    t = _per_threshold(decision, thresholds)
    tp, flagged, late = F.col("tp"), F.col("flagged_orders"), F.col("late_orders")
    return t.select("threshold", "flagged_orders", tp.alias("true_positives"),
                    (flagged - tp).alias("false_positives"),
                    F.when(late > 0, tp / late).otherwise(F.lit(0.0)).alias("recall"),
                    F.when(flagged > 0, tp / flagged).otherwise(F.lit(0.0)).alias("precision"),
                    "revenue_flagged", "profit_flagged")


def late_by_mode(decision: DataFrame) -> DataFrame:
    """H2: actual and predicted late rate per shipping mode."""
    return decision.groupBy("shipping_mode").agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg(F.col("late_delivery_risk").cast("double")).alias("late_delivery_rate"),
        F.avg(F.col("prediction_030").cast("double")).alias("flagged_rate_030"),
        F.avg(F.col("prediction_040").cast("double")).alias("flagged_rate_040"))


def revenue_flagged_by_region(decision: DataFrame) -> DataFrame:
    """H3: flagged orders and revenue at risk per region, both thresholds."""
    return decision.groupBy("order_region").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("prediction_030").cast("long").alias("flagged_030"),
        F.sum("prediction_040").cast("long").alias("flagged_040"),
        money_sum("revenue_at_risk_030").alias("revenue_at_risk_030"),
        money_sum("revenue_at_risk_040").alias("revenue_at_risk_040"))


QUEUE_COLUMNS = ("order_id", P, "revenue", "risk_level", "recommended_action")


def review_queue(decision: DataFrame, threshold: float = 0.30, k: int = 20,
                 by: str = "order_region") -> DataFrame:
    """H5: the ``k`` flagged orders to review first in each ``by`` group:
    highest probability, then highest revenue, then order id. The
    ``row_number() <= k`` filter lets Spark cut each group to ``k`` rows inside
    every map task before the shuffle (window group limit), so a hot group
    never moves whole."""
    w = Window.partitionBy(by).orderBy(F.col(P).desc(), F.col("revenue").desc_nulls_last(),
                                       F.col("order_id").asc())
    flagged = decision.filter(F.col(P) >= threshold)
    return (flagged.select(by, *QUEUE_COLUMNS)
            .withColumn("queue_rank", F.row_number().over(w))
            .filter(F.col("queue_rank") <= k))


def review_queue_overall(decision: DataFrame, threshold: float = 0.30, k: int = 50) -> DataFrame:
    """H5 overall: the ``k`` flagged orders to review first (partial top-k)."""
    order = [F.col(P).desc(), F.col("revenue").desc_nulls_last(), F.col("order_id").asc()]
    top = decision.filter(F.col(P) >= threshold).select("order_region", *QUEUE_COLUMNS) \
        .orderBy(*order).limit(k)
    return top.withColumn("queue_rank", F.row_number().over(Window.orderBy(*order)))
