"""Column expressions that give Spark the missing-value and division rules of

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen and partial (map-side) aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

# Sums of money are exact to 18 decimals; a group with a value of 10^20 or more is summed as doubles.
MONEY = "decimal(38,18)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum0(c: str | Column) -> Column:
    """The sum of an all-missing group is 0, not NULL."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def money_sum(c: str | Column) -> Column:
    """Sum as a double, 0 when all missing. The values are summed as decimals as wide
    as a double's digits, so the result does not depend on their order; a group that
    holds a value too large for that (or an infinity) is summed as doubles instead."""
    c = col(c)
    exact = c.try_cast(MONEY)
    return F.coalesce(F.when(F.count(exact) == F.count(c), F.try_sum(exact)).cast("double"),
                      F.sum(c.cast("double")), F.lit(0.0))


def quantity_sum(df: DataFrame, c: str) -> Column:
    """Sum of a quantity: whole numbers stay whole, fractions are kept."""
    return sum0(c).cast("long") if isinstance(df.schema[c].dataType, IntegralType) else money_sum(c)


def mean(c: str | Column) -> Column:
    """Mean that skips missing values (NaN must be nulled at ingest)."""
    return F.avg(col(c)).cast("double")


def rate(cond: Column) -> Column:
    """Share of rows where ``cond`` holds; a NULL condition counts as False and
    stays in the denominator (N10, breakdown form)."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def nunique(c: str | Column) -> Column:
    """Distinct count that ignores missing."""
    return F.count_distinct(col(c))


def nunique_with_missing(c: str | Column) -> Column:
    """Distinct count where missing counts as one more value."""
    return F.count_distinct(col(c)) + F.max(F.when(col(c).isNull(), 1).otherwise(0))


def has_many_values(c: str | Column) -> Column:
    """``nunique(dropna=False) > 1`` without a distinct aggregate: a group holds
    more than one value (missing counted) iff min < max, or it mixes missing
    and present values. Uses only min/max/count, so it aggregates map-side and
    needs no Expand or second shuffle."""
    c = col(c)
    n_present = F.count(c)
    spread = F.coalesce(F.min(c) < F.max(c), F.lit(False))  # all-missing group: no spread
    return spread | ((n_present > 0) & (n_present < F.count(F.lit(1))))


def line_order_keys(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Sort keys of the line order. Numbers that a file without a schema holds as text
    compare as numbers ("9" before "10"); texts that are no numbers come first, as text."""
    keys = []
    for c in order:
        if isinstance(df.schema[c].dataType, StringType):
            keys.append(F.col(c).try_cast("decimal(38,6)").alias(f"__{c}_number"))
        keys.append(F.col(c))
    return keys


def first_non_missing(c: str, order_cols: Sequence[str | Column]) -> Column:
    """First non-missing value of ``c`` in line order.

    ``F.first`` has no defined order after a shuffle; the minimum of a
    struct led by the line-order key does, and it is a plain aggregate."""
    s = F.struct(*[col(o) for o in order_cols], F.col(c).alias("__v"))
    return F.min(F.when(F.col(c).isNotNull(), s)).getField("__v")


def ratio_with_inf(num: str | Column, den: str | Column) -> Column:
    """Group margin; x/0 is +-inf and 0/0 is 0."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return (F.when(den != 0, num / den)
            .when(num > 0, F.lit(float("inf")))
            .when(num < 0, F.lit(float("-inf")))
            .otherwise(F.lit(0.0)))


def ratio_or_zero(num: str | Column, den: str | Column) -> Column:
    """Scalar margin, 0 when the denominator is 0."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


# The characters Python's str.strip removes: every code point that isspace().
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def strip_blank(c: str | Column) -> Column:
    """Strip Unicode whitespace at both ends; empty text becomes NULL.
    ``btrim`` with a character set, not a regular expression (several times
    faster per value), and only where an end is not plainly visible: the code points
    33 to 132 hold no whitespace, so most texts pass after a look at their two ends."""
    c = col(c)
    seen = F.ascii(c).between(33, 132) & F.ascii(F.substring(c, -1, 1)).between(33, 132)
    return F.when(seen, c).otherwise(F.nullif(F.btrim(c, F.lit(WHITESPACE)), F.lit("")))


def null_tokens(c: str | Column, tokens: Sequence[str]) -> Column:
    """Text tokens that a CSV reader of the reference reads as missing."""
    if not tokens:
        return col(c)
    return F.when(~col(c).isin(list(tokens)), col(c))


def clean_text(c: str | Column, tokens: Sequence[str]) -> Column:
    """``strip_blank(null_tokens(c, tokens))`` with the column itself inside, not the token test
    once for every mention of it."""
    return F.when(~col(c).isin(list(tokens)), strip_blank(c)) if tokens else strip_blank(c)


#: what every text has that casts to a double (Java's decimal and hexadecimal forms, with type
#: letters and control characters around, the names of NaN and infinity in any case)
NUMBER_SHAPE = (r"^[\x00-\x20]*[+-]?([0-9.][0-9a-fA-FxX.]*([eEpP][+-]?[0-9]+)?[fFdD]?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"
                r"[\x00-\x20]*$")


def text_to_double(c: str | Column) -> Column:
    """``try_cast`` to double; texts that cannot be numbers are not tried, since every failure
    costs an exception in the JVM (tens of times the cast)."""
    c = col(c)
    return F.when(c.rlike(NUMBER_SHAPE), c.try_cast("double"))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


# Bin edges and labels of the reference's risk levels.
RISK3_EDGES = (0.0, 0.40, 0.70, 1.0)
RISK3_LABELS = ("Low", "Medium", "High")
RISK4_EDGES = (0.0, 0.30, 0.40, 0.70, 1.0)
RISK4_LABELS = ("Low", "Watch", "High", "Critical")


def right_closed_bins(p: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest edge included; outside → NULL."""
    p = col(p)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = ((p >= lo) if i == 0 else (p > lo)) & (p <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def risk_level_3(p: str | Column) -> Column:
    return right_closed_bins(p, RISK3_EDGES, RISK3_LABELS)


def risk_level_4(p: str | Column) -> Column:
    return right_closed_bins(p, RISK4_EDGES, RISK4_LABELS)


def flag_at(p: str | Column, threshold: float) -> Column:
    """``p >= threshold`` as 0/1; missing probability gives 0."""
    return F.when(col(p) >= F.lit(threshold), 1).otherwise(0)


def map_values(c: str | Column, mapping: dict, default: Column | None = None) -> Column:
    """Dictionary lookup as a ``when`` chain (stays in codegen)."""
    c = col(c)
    expr = None
    for key, value in mapping.items():
        expr = (F.when(c == F.lit(key), F.lit(value)) if expr is None
                else expr.when(c == F.lit(key), F.lit(value)))
    return expr.otherwise(default) if default is not None else expr
