"""Line-level KPIs and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import money_sum, ratio_or_zero, ratio_with_inf
from orderlens.functions.contracts import present, require_columns
from orderlens.functions.shapes import dimension_totals, kpi_table, top_k

# Required columns, KPI names and dimensions of the line-level report.
LINE_REQUIRED = (
    "order_id", "revenue_value", "order_profit_per_order", "late_delivery_risk",
    "days_for_shipping_real", "days_for_shipment_scheduled", "shipping_delay_days",
)
LINE_DIMENSIONS = ("shipping_mode", "market", "order_region", "category_name", "customer_segment")
LINE_KPI_NAMES = (
    "Unique Orders", "Order Lines", "Revenue", "Profit", "Profit Margin",
    "Late Delivery Rate", "On-Time Delivery Rate", "Average Shipping Days",
    "Average Scheduled Shipping Days", "Average Delay Days", "Loss-Making Orders",
    "Profit from Late Deliveries",
)


def _avg_of(sum_col: str, n_col: str):
    return F.when(F.col(n_col) > 0, F.col(sum_col).cast("double") / F.col(n_col))


def line_kpis(df: DataFrame) -> DataFrame:
    """Twelve KPIs as ``(kpi_order, kpi, value)``.

    Two distinct counts over ``order_id`` would expand every line twice; instead
    lines are first combined per order (map-side partial aggregation, and no
    shuffle at all when the input is already partitioned by ``order_id``), then
    one global aggregate reads the much smaller order grain."""
    require_columns(df, LINE_REQUIRED, "order lines")
    p = F.col("order_profit_per_order")
    risk = F.col("late_delivery_risk")
    per_order = df.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        money_sum("revenue_value").alias("revenue"),
        money_sum(p).alias("profit"),
        F.sum(risk).alias("risk_sum"), F.count(risk).alias("risk_n"),
        F.sum("days_for_shipping_real").alias("real_sum"),
        F.count("days_for_shipping_real").alias("real_n"),
        F.sum("days_for_shipment_scheduled").alias("sched_sum"),
        F.count("days_for_shipment_scheduled").alias("sched_n"),
        F.sum("shipping_delay_days").alias("delay_sum"),
        F.count("shipping_delay_days").alias("delay_n"),
        F.max(F.when(p < 0, 1).otherwise(0)).alias("has_loss"),
        money_sum(F.when(risk == 1, p)).alias("late_profit"),
    )
    known = F.col("order_id").isNotNull()
    totals = per_order.agg(
        F.count("order_id").alias("unique_orders"),
        F.sum("n_lines").alias("order_lines"),
        money_sum("revenue").alias("revenue"),
        money_sum("profit").alias("profit"),
        F.sum("risk_sum").alias("risk_sum"), F.sum("risk_n").alias("risk_n"),
        F.sum("real_sum").alias("real_sum"), F.sum("real_n").alias("real_n"),
        F.sum("sched_sum").alias("sched_sum"), F.sum("sched_n").alias("sched_n"),
        F.sum("delay_sum").alias("delay_sum"), F.sum("delay_n").alias("delay_n"),
        F.coalesce(F.sum(F.when(known, F.col("has_loss"))), F.lit(0)).alias("loss_orders"),
        money_sum("late_profit").alias("late_profit"),
    )
    late_rate = _avg_of("risk_sum", "risk_n")
    values = [
        F.col("unique_orders"), F.col("order_lines"), F.col("revenue"), F.col("profit"),
        ratio_or_zero("profit", "revenue"), late_rate, F.lit(1.0) - late_rate,
        _avg_of("real_sum", "real_n"), _avg_of("sched_sum", "sched_n"),
        _avg_of("delay_sum", "delay_n"), F.col("loss_orders"), F.col("late_profit"),
    ]
    return kpi_table(totals, list(zip(LINE_KPI_NAMES, values)))


def line_breakdown(df: DataFrame, dims: Sequence[str] = LINE_DIMENSIONS) -> DataFrame:
    """Per dimension value (missing kept): lines, distinct orders,
    revenue, profit, late rate, mean shipping and delay days, margin.

    All dimensions in one pass (``dimension_totals``); no group is ever
    collected whole."""
    require_columns(df, LINE_REQUIRED, "order lines")
    dims = present(df, dims)
    means = {"late_delivery_rate": "late_delivery_risk", "avg_shipping_days": "days_for_shipping_real",
             "avg_delay_days": "shipping_delay_days"}
    sums = {f"__{part}_{c}": fn(c) for c in means.values()
            for part, fn in (("sum", F.col), ("n", lambda c: F.col(c).isNotNull().cast("long")))}
    bd = dimension_totals(df, dims, "order_id", sums,
                          {"revenue": F.col("revenue_value"), "profit": F.col("order_profit_per_order")})
    return bd.select(
        "dimension", "dimension_value", F.col("rows").alias("order_lines"),
        F.col("unique_keys").alias("unique_orders"), "revenue", "profit",
        *[_avg_of(f"__sum_{c}", f"__n_{c}").alias(name) for name, c in means.items()],
        ratio_with_inf("profit", "revenue").alias("profit_margin"))


def worst_late_lines(bd: DataFrame, k: int = 10, min_orders: int = 100,
                     dims: Sequence[str] = LINE_DIMENSIONS) -> DataFrame:
    """C14: the ``k`` highest late rates among groups with ``min_orders`` orders."""
    return top_k(bd, dims, "late_delivery_rate", k, min_orders, descending=True)


def worst_profit_lines(bd: DataFrame, k: int = 10, min_orders: int = 100,
                       dims: Sequence[str] = LINE_DIMENSIONS) -> DataFrame:
    """The ``k`` lowest profits among groups with ``min_orders`` orders."""
    return top_k(bd, dims, "profit", k, min_orders, descending=False)
