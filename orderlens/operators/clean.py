"""Cleaning, derivations and data-quality profile of order lines.

B1-B12 are one projection (Catalyst collapses the chained ``select``s); the
only shuffle is the exact de-duplication, over the columns read and not the
derived ones, and the profile (B13, B15, B16) is computed from that same
grouped table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orderlens.functions.columns import clean_text, nan_to_null, text_to_double
from orderlens.functions.contracts import ContractError, present
from orderlens.sources.io import PANDAS_NA_TOKENS

# The reference's alias renames, parsed columns, numeric targets.
ALIASES = {
    "days_for_shipping": "days_for_shipping_real",
    "days_for_shipment": "days_for_shipment_scheduled",
}
TIMESTAMP_COLUMNS = ("order_date", "shipping_date")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm", "M/d/yyyy", "M/d/yyyy H:mm:ss",
                     "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")
NUMERIC_TARGETS = ("days_for_shipping_real", "days_for_shipment_scheduled", "late_delivery_risk",
                   "order_item_total", "sales", "order_profit_per_order")
COPIES = "__copies"
TIMING_FROM_DELAY = ("Late", "On Time", "Early")


def _normalize(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalize_names(df: DataFrame) -> DataFrame:
    """B1: strip, lower-case, runs of other characters → ``_``; raise when two
    columns end up with the same name."""
    names = [_normalize(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, new in zip(df.columns, names):
        if new in seen:
            raise ContractError(f"columns {seen[new]!r} and {old!r} both normalise to {new!r}")
        seen[new] = old
    return df.toDF(*names)


def rename_aliases(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """B2: rename the two shipping-day aliases when present."""
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})


def clean_strings(df: DataFrame, na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """Missing-text tokens → NULL, strip whitespace, empty → NULL, for
    every text column in one projection."""
    return df.select(*[
        clean_text(F.col(f.name), na_tokens).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _may_fit(c: Column, fmt: str) -> Column:
    """Whether the text has the spaces, colons and slashes of the format, in their order: only
    then is it tried, since every failed try costs an exception in the JVM. Formats with more
    than numbers and marks are always tried."""
    if not re.fullmatch(r"(?:[yMdHms :/-]|'T')+", fmt) or "MMM" in fmt:
        return F.lit(True)
    return c.rlike("^" + re.sub("[^ :/]+", "[^ :/]+", fmt) + "$")


def coerce_timestamps(df: DataFrame, columns: Sequence[str] = TIMESTAMP_COLUMNS,
                      formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """Parse text with the first format that fits; bad text → NULL."""
    out = {}
    for c in present(df, columns):
        if isinstance(df.schema[c].dataType, StringType):
            # last resort: the cast, which also takes fractions of a second
            parsed = F.coalesce(*[F.when(_may_fit(F.col(c), f), F.try_to_timestamp(F.col(c), F.lit(f))) for f in formats],
                                F.col(c).try_cast("timestamp"))
        else:
            parsed = F.col(c)
        out[c] = parsed.cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def coerce_numeric(df: DataFrame, targets: Sequence[str] = NUMERIC_TARGETS) -> DataFrame:
    """Coerce to doubles, fractions kept; bad text → NULL, NaN → NULL."""
    out = {c: nan_to_null(text_to_double(c) if isinstance(df.schema[c].dataType, StringType) else F.col(c).try_cast("double"))
           for c in present(df, targets)}
    return df.withColumns(out) if out else df


def with_delay(df: DataFrame) -> DataFrame:
    """B6 + B7: delay days and the timing group from its sign (missing → On Time)."""
    if not {"days_for_shipping_real", "days_for_shipment_scheduled"} <= set(df.columns):
        return df
    delay = F.col("days_for_shipping_real") - F.col("days_for_shipment_scheduled")
    late, on_time, early = TIMING_FROM_DELAY
    return df.withColumns({
        "shipping_delay_days": delay,
        "delivery_timing_group": F.when(delay > 0, late).when(delay < 0, early).otherwise(on_time),
    })


def with_calendar(df: DataFrame) -> DataFrame:
    """Order year, ``yyyy-MM`` month text, English day name."""
    if "order_date" not in df.columns:
        return df
    d = F.col("order_date")
    return df.withColumns({
        "order_year": F.year(d),
        "order_month": F.date_format(d, "yyyy-MM"),
        "order_day_of_week": F.date_format(d, "EEEE"),
    })


def with_revenue(df: DataFrame) -> DataFrame:
    """Revenue is ``order_item_total`` when that column exists, else ``sales``
    (a choice made on the schema, not per row)."""
    for source in ("order_item_total", "sales"):
        if source in df.columns:
            return df.withColumn("revenue_value", F.col(source))
    return df


def with_profit_status(df: DataFrame) -> DataFrame:
    """Loss when profit < 0, else Profit (missing → Profit)."""
    if "order_profit_per_order" not in df.columns:
        return df
    return df.withColumn("profit_status",
                         F.when(F.col("order_profit_per_order") < 0, "Loss").otherwise("Profit"))


def derive_line_columns(df: DataFrame) -> DataFrame:
    """B6-B12 on typed lines."""
    return with_profit_status(with_revenue(with_calendar(with_delay(df))))


def type_lines(raw: DataFrame, na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """Named, cleaned and typed lines, as one projection."""
    df = rename_aliases(normalize_names(raw))
    return coerce_numeric(coerce_timestamps(clean_strings(df, na_tokens)))


def prepare_lines(raw: DataFrame, na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """Everything before de-duplication, as one projection."""
    return derive_line_columns(type_lines(raw, na_tokens))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (missing values compare equal)."""
    return df.dropDuplicates()


def clean_lines(raw: DataFrame, na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """The cleaned order-line table. The derived columns follow from the typed ones, so
    rows are compared, and shuffled, without them."""
    return derive_line_columns(drop_exact_duplicates(type_lines(raw, na_tokens)))


def _row_groups(df: DataFrame) -> DataFrame:
    """Distinct rows with their multiplicity: the one shuffle of the profile."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy of each distinct row. Typed lines will do: columns
    derived from them make no two rows differ."""
    return _row_groups(df).agg(
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).cast("long").alias("duplicates"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing cells per column, only columns with any, ranked: most first, ties in
    column order."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("column_position"), F.lit(c).alias("column_name"),
                 F.col(c).cast("long").alias("missing_cells"))
        for i, c in enumerate(df.columns)
    ])).alias("m")).select("m.*")
    w = Window.orderBy(F.col("missing_cells").desc(), F.col("column_position").asc())  # a row per column
    return long.filter(F.col("missing_cells") > 0).withColumn("rank", F.row_number().over(w))


def counted_lines(raw: DataFrame, na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """B1-B14 with the number of copies of each distinct line: the table to write where both the
    cleaned lines and their profile are wanted."""
    return derive_line_columns(_row_groups(type_lines(raw, na_tokens)))


def profile_of(counted: DataFrame) -> DataFrame:
    """B16 from counted lines: rows before and after de-duplication, columns, duplicates removed
    and missing cells after."""
    columns = [c for c in counted.columns if c != COPIES]
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    agg = counted.agg(F.coalesce(F.sum(COPIES), F.lit(0)).cast("long").alias("before"), F.count(F.lit(1)).alias("after"),
                      F.coalesce(F.sum(nulls), F.lit(0)).alias("missing"))
    values = [("rows_before", F.col("before")), ("rows_after", F.col("after")), ("columns", F.lit(len(columns)).cast("long")),
              ("duplicates_removed", F.col("before") - F.col("after")), ("missing_cells", F.col("missing"))]
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("metric_order"), F.lit(n).alias("metric"), v.alias("value")) for i, (n, v) in enumerate(values)
    ])).alias("m")).select("m.*")


def cleaning_profile(typed: DataFrame) -> DataFrame:
    """B16 from one grouping of the typed lines; the derived columns (B6-B12) are added to the
    distinct rows and count as columns and cells too."""
    return profile_of(derive_line_columns(_row_groups(typed)))


__all__ = [
    "normalize_names", "rename_aliases", "clean_strings", "coerce_timestamps", "coerce_numeric",
    "with_delay", "with_calendar", "with_revenue", "with_profit_status", "derive_line_columns",
    "type_lines", "prepare_lines", "drop_exact_duplicates", "clean_lines", "counted_lines", "profile_of",
    "duplicate_count", "missing_by_column", "cleaning_profile",
]
