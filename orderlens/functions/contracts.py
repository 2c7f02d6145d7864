"""Schema contracts and data checks.

The schema checks look only at ``df.columns`` and run no job. The data checks
are the only eager actions in the library: each one is a distributed
aggregate or filter that returns at most one row to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a column contract or a data check."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], table: str = "input") -> DataFrame:
    """A3: raise with the sorted list of absent columns."""
    absent = missing_columns(df, required)
    if absent:
        raise ContractError(f"missing columns in {table}: {', '.join(absent)}")
    return df


def present(df: DataFrame, candidates: Iterable[str]) -> list[str]:
    """A4: the candidates that exist, in candidate order."""
    have = set(df.columns)
    return [c for c in candidates if c in have]


def assert_dates(df: DataFrame, column: str) -> DataFrame:
    """abort when any value of ``column`` is missing (unparsable)."""
    if df.filter(F.col(column).isNull()).limit(1).count():
        raise ContractError(f"invalid values in {column}")
    return df


def known_date(value: Column, missing: Column, column: str) -> Column:
    """F1 inside a plan: ``value``, or the job ends with an error where ``missing`` counts any
    missing (unparsable) value of ``column``. No pass of its own over the data."""
    return F.when(missing > 0, F.raise_error(F.lit(f"invalid values in {column}")).cast("timestamp")).otherwise(value)


def assert_unique(df: DataFrame, key: str, table: str = "input") -> DataFrame:
    """Abort when a key occurs twice (one-to-one join validation)."""
    dup = df.groupBy(key).count().filter(F.col("count") > 1).limit(1)
    if dup.count():
        raise ContractError(f"duplicate {key} in {table}")
    return df
