"""Order-level KPIs and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import money_sum, ratio_or_zero, ratio_with_inf
from orderlens.functions.contracts import present, require_columns
from orderlens.functions.shapes import dimension_totals, kpi_table, top_k

# Required columns, timing labels, KPI names and dimensions of the order report.
ORDER_KPI_REQUIRED = (
    "order_id", "revenue", "order_profit_per_order", "delivery_timing_group",
    "days_for_shipping_real", "days_for_shipment_scheduled", "shipping_delay_days", "loss_flag",
)
ORDER_DIMENSIONS = ("shipping_mode", "market", "order_region", "customer_segment")
ORDER_KPI_NAMES = (
    "Unique Orders", "Revenue", "Profit", "Profit Margin", "Late Delivery Rate",
    "On-Time Delivery Rate", "Early Delivery Rate", "Cancellation Rate",
    "Average Shipping Days", "Average Scheduled Shipping Days", "Average Delay Days",
    "Loss-Making Orders", "Loss-Making Order Rate", "Late Orders Revenue", "Late Orders Profit",
)
LATE, ON_TIME, EARLY, CANCELED = "Late", "On Time", "Early", "Canceled"


def value_share(column: str, value: str):
    """Share of ``value`` among non-missing values; 0 when absent."""
    c = F.col(column)
    return F.when(F.count(c) > 0, F.count_if(c == value) / F.count(c)).otherwise(F.lit(0.0))


def order_kpis(orders: DataFrame, unique_keys: bool = False) -> DataFrame:
    """Fifteen KPIs as ``(kpi_order, kpi, value)`` from one aggregate.

    ``unique_keys=True`` (the output of ``build_orders``) counts ids without a
    distinct aggregate."""
    require_columns(orders, ORDER_KPI_REQUIRED, "orders")
    g = F.col("delivery_timing_group")
    late = g == LATE
    n_orders = F.count("order_id") if unique_keys else F.count_distinct("order_id")
    one = orders.agg(
        n_orders.alias("unique_orders"),
        money_sum("revenue").alias("revenue"),
        money_sum("order_profit_per_order").alias("profit"),
        value_share("delivery_timing_group", LATE).alias("late"),
        value_share("delivery_timing_group", ON_TIME).alias("on_time"),
        value_share("delivery_timing_group", EARLY).alias("early"),
        value_share("delivery_timing_group", CANCELED).alias("canceled"),
        F.avg("days_for_shipping_real").alias("real"),
        F.avg("days_for_shipment_scheduled").alias("sched"),
        F.avg("shipping_delay_days").alias("delay"),
        F.coalesce(F.sum("loss_flag"), F.lit(0)).alias("loss_orders"),
        F.avg("loss_flag").alias("loss_rate"),
        money_sum(F.when(late, F.col("revenue"))).alias("late_revenue"),
        money_sum(F.when(late, F.col("order_profit_per_order"))).alias("late_profit"),
    )
    values = [
        F.col("unique_orders"), F.col("revenue"), F.col("profit"),
        ratio_or_zero("profit", "revenue"), F.col("late"), F.col("on_time"), F.col("early"),
        F.col("canceled"), F.col("real"), F.col("sched"), F.col("delay"),
        F.col("loss_orders"), F.col("loss_rate"), F.col("late_revenue"), F.col("late_profit"),
    ]
    return kpi_table(one, list(zip(ORDER_KPI_NAMES, values)))


def order_breakdown(orders: DataFrame, dims: Sequence[str] = ORDER_DIMENSIONS,
                    unique_keys: bool = False) -> DataFrame:
    """Per dimension value (missing kept): orders, revenue, profit, late,
    on-time and cancellation rates (missing status stays in the denominator),
    loss rate, mean shipping and delay days, margin — one pass for all
    dimensions."""
    require_columns(orders, ORDER_KPI_REQUIRED, "orders")
    dims = present(orders, dims)
    g = F.col("delivery_timing_group")
    means = {"loss_order_rate": "loss_flag", "avg_shipping_days": "days_for_shipping_real",
             "avg_delay_days": "shipping_delay_days"}
    shares = {"late_delivery_rate": LATE, "on_time_delivery_rate": ON_TIME, "cancellation_rate": CANCELED}
    sums = {name: F.when(g == value, 1).otherwise(0) for name, value in shares.items()}
    for c in means.values():
        sums |= {f"__sum_{c}": F.col(c), f"__n_{c}": F.col(c).isNotNull().cast("long")}
    bd = dimension_totals(orders, dims, "order_id", sums,
                          {"revenue": F.col("revenue"), "profit": F.col("order_profit_per_order")}, unique_keys)
    return bd.select(
        "dimension", "dimension_value", F.col("unique_keys").alias("unique_orders"), "revenue", "profit",
        *[(F.col(name) / F.col("rows")).alias(name) for name in shares],
        *[F.when(F.col(f"__n_{c}") > 0, F.col(f"__sum_{c}").cast("double") / F.col(f"__n_{c}")).alias(name)
          for name, c in means.items()],
        ratio_with_inf("profit", "revenue").alias("profit_margin"))


def worst_late_orders(bd: DataFrame, k: int = 10, min_orders: int = 100,
                      dims: Sequence[str] = ORDER_DIMENSIONS) -> DataFrame:
    """The ``k`` highest late rates among groups with enough orders."""
    return top_k(bd, dims, "late_delivery_rate", k, min_orders, descending=True)


def worst_margin_orders(bd: DataFrame, k: int = 10, min_orders: int = 100,
                        dims: Sequence[str] = ORDER_DIMENSIONS) -> DataFrame:
    """The ``k`` lowest margins among groups with enough orders."""
    return top_k(bd, dims, "profit_margin", k, min_orders, descending=False)
