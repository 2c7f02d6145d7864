"""Order features, exact time split and train-fitted statistics.

Fitted statistics are computed on the training side only, with distributed
aggregates; what reaches the driver is the fitted value per column (a
median, a mode, a class prior), never data rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from orderlens.functions.columns import first_non_missing, line_order_keys, money_sum, quantity_sum
from orderlens.functions.contracts import ContractError, known_date, require_columns
from orderlens.functions.selection import exact_medians, key_struct, kth_key, literal_key
from orderlens.functions.shapes import distinct_count, flag_first_values
from orderlens.operators.clean import coerce_timestamps

# Required columns, model features and leakage exclusions of the reference.
FEATURE_REQUIRED = ("order_id", "order_date", "late_delivery_risk", "days_for_shipment",
                    "shipping_mode")
FEATURES = (
    "days_for_shipment", "shipping_mode", "order_region", "market", "customer_segment",
    "order_type", "order_value", "quantity", "discount", "unique_products",
    "unique_categories", "order_month", "order_day_of_week",
)
LEAKAGE_COLUMNS = ("delivery_status", "days_for_shipping_real", "shipping_date", "order_status")
LABEL = "late_delivery_risk"
TRAIN_FRACTION = 0.8


def to_model_names(lines: DataFrame) -> DataFrame:
    """The model input names the scheduled days ``days_for_shipment``; accept
    cleaned lines that carry the renamed column."""
    if "days_for_shipment" not in lines.columns and "days_for_shipment_scheduled" in lines.columns:
        return lines.withColumnRenamed("days_for_shipment_scheduled", "days_for_shipment")
    return lines


def order_features(lines: DataFrame, line_order: Sequence[str], with_profit: bool = True,
                   check_dates: bool = True) -> DataFrame:
    """One row per order: first values of eight fields in line order,
    summed value, profit, quantity and discount, distinct products and
    categories, month and weekday (Monday = 0) of the order date. The date check
    rides on the same aggregate: a line of a known order without a date ends the job
    that reads ``order_date``, with an error that names the column."""
    df = to_model_names(lines)
    require_columns(df, FEATURE_REQUIRED, "model lines")
    if isinstance(df.schema["order_date"].dataType, StringType):
        df = coerce_timestamps(df, ["order_date"])
    firsts = [("order_date", "order_date"), (LABEL, LABEL),
              ("days_for_shipment", "days_for_shipment"), ("shipping_mode", "shipping_mode"),
              ("order_region", "order_region"), ("market", "market"),
              ("customer_segment", "customer_segment"), ("type", "order_type")]
    order = line_order_keys(df, line_order)
    aggs = [first_non_missing(src, order).alias(dst) for src, dst in firsts]
    aggs.append(money_sum("order_item_total").alias("order_value"))
    if with_profit:
        aggs.append(money_sum("order_profit_per_order").alias("order_profit"))
    aggs += [quantity_sum(df, "order_item_quantity").alias("quantity"),
             money_sum("order_item_discount").alias("discount")]
    distinct = [("order_item_cardprod_id", "unique_products"), ("category_id", "unique_categories")]
    aggs += [distinct_count(c).alias(n) for c, n in distinct]
    known = flag_first_values(df.filter(F.col("order_id").isNotNull()), "order_id",
                              [c for c, _ in distinct])
    if check_dates:
        aggs.append(F.count_if(F.col("order_date").isNull()).alias("__no_date"))
    orders = known.groupBy("order_id").agg(*aggs)
    if check_dates:
        kind = orders.schema["order_date"].dataType
        orders = orders.withColumn("order_date", known_date(F.col("order_date"), F.col("__no_date"), "order_date").cast(kind)) \
            .drop("__no_date")
    return orders.withColumns({
        "order_month": F.month("order_date"),
        "order_day_of_week": F.weekday("order_date"),
    })


def _sort_keys(df: DataFrame, column: str) -> list:
    """Sort keys of a column of any orderable type, missing last. Texts: whole numbers first,
    by value, then the others by their bytes."""
    c = F.col(column)
    if not isinstance(df.schema[column].dataType, StringType):
        return [c.isNull(), c]
    return [c.isNull(), F.coalesce(F.trim(c).try_cast("long"), F.lit((1 << 63) - 1)), c]


def time_split(features: DataFrame, frac: float = TRAIN_FRACTION,
               order: Sequence[str] = ("order_date", "order_id")) -> DataFrame:
    """add ``split``: the first ``int(frac * n)`` orders by (date, id) are
    'train', the rest 'test'. The boundary key is found exactly from a sorted
    sample and counting passes (``functions.selection``), not a global sort
    into one partition; the split itself is then a plain filter expression.
    Ids and dates may be of any orderable type."""
    keys = [k for c in order for k in _sort_keys(features, c)]
    narrow = features.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = narrow.count()
        k = int(n * frac)
        if k <= 0:
            return features.withColumn("split", F.lit("test"))
        if k >= n:
            return features.withColumn("split", F.lit("train"))
        bound = kth_key(narrow, [F.col(f"__k{i}") for i in range(len(keys))], k)
    finally:
        narrow.unpersist()
    first = key_struct(keys) <= literal_key(features, keys, bound)
    return features.withColumn("split", F.when(first, "train").otherwise("test"))


def split_frames(split_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (split_df.filter(F.col("split") == "train").drop("split"),
            split_df.filter(F.col("split") == "test").drop("split"))


def split_profile(split_df: DataFrame) -> DataFrame:
    """size and first/last order date of each side."""
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("orders"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"))


def route_columns(df: DataFrame, features: Sequence[str] = FEATURES) -> tuple[list[str], list[str]]:
    """numeric vs categorical features by column type."""
    numeric = [c for c in features if isinstance(df.schema[c].dataType, NumericType)]
    return numeric, [c for c in features if c not in numeric]


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """F8: exact median per numeric column on the training side."""
    return exact_medians(train, columns)


def mode_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F9 as a table: most frequent non-missing value per column, lowest value
    on ties. Values are counted with a distributed ``groupBy``; the ranking
    window sees only distinct values, and ``rank == 1`` lets Spark keep just
    the leader per column before the window's shuffle."""
    stacked = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("s")).select("s.*").filter(F.col("value").isNotNull())
    counts = stacked.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value").asc())
    return (counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
            .select("feature", F.col("value").alias("mode"), F.col("n").alias("frequency")))


def fit_modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    got = {r["feature"]: r["mode"] for r in mode_table(train, columns).collect()}
    return {c: got.get(c) for c in columns}


def impute(df: DataFrame, medians: dict, modes: dict) -> DataFrame:
    """Fill numerics with medians (after casting to double, so 2.5 stays 2.5)
    and categoricals with modes."""
    num = {c: v for c, v in medians.items() if v is not None}
    cat = {c: v for c, v in modes.items() if v is not None}
    out = df.withColumns({c: F.col(c).cast("double") for c in medians})
    return out.fillna(num).fillna(cat) if (num or cat) else out


def ordinal_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F12 fitted table: ``(feature, category, code)``, codes 0.. in sorted
    category order (unknown categories get -1 when applied)."""
    stacked = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
        for c in columns])).alias("s")).select("s.*").filter(F.col("category").isNotNull())
    w = Window.partitionBy("feature").orderBy("category")
    return (stacked.distinct()
            .withColumn("code", (F.dense_rank().over(w) - 1).cast("int")))


def majority_class(train: DataFrame, label: str = LABEL) -> DataFrame:
    """one row, the most frequent class (lowest on ties)."""
    return (train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(label).asc()).limit(1).select(label))


def class_prior(train: DataFrame, label: str = LABEL) -> DataFrame:
    """one row, the share of the positive class."""
    return train.agg(F.avg(F.col(label).cast("double")).alias("prior"))


def baseline_scores(test: DataFrame, train: DataFrame, label: str = LABEL) -> DataFrame:
    """F14-F15 applied: majority class and prior probability for every test order, both
    fitted on ``train`` by scalar subqueries of the one plan."""
    return test.select("order_id", label,
                       majority_class(train, label).scalar().alias("majority_prediction"),
                       class_prior(train, label).scalar().alias("prior_probability"))


def feature_frame(features: DataFrame, columns: Sequence[str] = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """the model columns, and ``keep`` to report with the scores. A leakage column among
    the model columns is an error."""
    leaks = sorted(set(columns) & set(LEAKAGE_COLUMNS))
    if leaks:
        raise ContractError(f"not known before shipping, so no model features: {', '.join(leaks)}")
    require_columns(features, columns, "order features")
    return features.select("order_id", LABEL, *columns, *[c for c in keep if c not in (*columns, "order_id", LABEL)])
