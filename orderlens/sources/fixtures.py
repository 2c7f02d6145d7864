"""Order-line test tables derived from the driver's TPC-H-style tables
(FIXTURES.md). The column mapping is kept once, as SQL expressions, and used
by both sides: Spark evaluates it with ``F.expr`` over a DataFrame join, the
DuckDB oracle inlines it as a CTE.

Join order is chosen for scale: lineitem meets part on the part key first,
orders meet customer (with the fixed-size nation and region tables
broadcast), and the last join is on the order key, so the result leaves
hash-partitioned by ``order_id`` and every later ``groupBy('order_id')``
reuses that partitioning without another shuffle. The number of partitions
follows the number of lines (``line_tasks``), so a task's share of the lines,
and with it its memory, stays the same however large the input is.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.sources.io import load_tables

# The fixture mapping of FIXTURES.md §2 (column, SQL expression).
_REAL = "(o_orderkey * 7919 + o_custkey * 104729) % 7"
_SCHED = ("case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 "
          "when '3-MEDIUM' then 2 else 4 end")
FX_LINES_COLUMNS: list[tuple[str, str]] = [
    ("order_id", "l_orderkey"),
    ("line_no", "l_linenumber"),
    ("supp_key", "l_suppkey"),
    ("order_item_cardprod_id", "l_partkey"),
    ("order_item_quantity", "cast(l_quantity as int)"),
    ("sales", "cast(l_extendedprice as decimal(18,4))"),
    ("order_item_discount", "cast(l_extendedprice * l_discount as decimal(18,4))"),
    ("order_item_total", "cast(l_extendedprice * (1 - l_discount) as decimal(18,4))"),
    ("order_profit_per_order",
     "cast(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice as decimal(18,4))"),
    ("order_date", "cast(o_orderdate as date)"),
    ("shipping_date", f"cast(o_orderdate as date) + cast({_REAL} as int)"),
    ("days_for_shipping_real", f"cast({_REAL} as int)"),
    ("days_for_shipment_scheduled", _SCHED),
    ("shipping_mode", "case o_orderpriority when '1-URGENT' then 'Same Day' when '2-HIGH' "
                      "then 'First Class' when '3-MEDIUM' then 'Second Class' "
                      "else 'Standard Class' end"),
    ("delivery_status", f"case when o_custkey % 23 = 0 then 'Shipping canceled' "
                        f"when {_REAL} > {_SCHED} then 'Late delivery' "
                        f"when {_REAL} = {_SCHED} then 'Shipping on time' "
                        f"else 'Advance shipping' end"),
    ("late_delivery_risk", f"case when o_custkey % 23 <> 0 and {_REAL} > {_SCHED} "
                           f"then 1 else 0 end"),
    ("market", "r_name"),
    ("order_region", "n_name"),
    ("customer_segment", "c_mktsegment"),
    ("category_name", "case when l_partkey % 13 = 0 then null else p_type end"),
    ("category_id", "p_brand"),
    ("order_status", "l_linestatus"),
    ("type", "o_orderstatus"),
]

# The dirty-text overrides of FIXTURES.md §3.
FX_RAW_OVERRIDES: dict[str, str] = {
    "order_date": ("case when l_orderkey % 97 = 0 then 'not a date' "
                   "else cast(cast(o_orderdate as date) as string) end"),
    "category_name": "case when l_partkey % 13 = 0 then '  ' else concat(' ', p_type, ' ') end",
    "order_item_total": ("case when l_partkey % 101 = 0 then 'n/a' else cast(cast(l_extendedprice "
                         "* (1 - l_discount) as decimal(18,4)) as string) end"),
    "order_profit_per_order": ("case when l_suppkey % 9 = 0 then '' else cast(cast(l_extendedprice "
                               "* (1 - l_discount) - l_quantity * p_retailprice as decimal(18,4)) "
                               "as string) end"),
}
FX_RAW_OVERRIDES["days_for_shipping_real"] = (
    f"case when l_partkey % 89 = 0 then '2.5' else cast(cast({_REAL} as int) as string) end")
FX_RAW_DUP_FILTER = "l_orderkey % 50 = 0"

# The fixed score formulas of FIXTURES.md §4 (model, SQL expression).
FX_SCORE_MODELS: list[tuple[str, str]] = [
    ("model_a", "cast((order_id * 37) % 71 + 30 * risk as double) / 100"),
    ("model_b", "cast((order_id * 53) % 61 + 40 * risk as double) / 100"),
    ("baseline", "cast(55 as double) / 100"),
]

# A profit that is one value per order (FIXTURES.md §2.1), and the score rows of
# absent orders (§4.1): which orders lend their key, and the key no order has.
FX_CONSTANT_PROFIT = "cast(((o_orderkey * 31 + o_custkey * 17) % 20001 - 6000) * 0.01 as decimal(18,4))"
FX_ABSENT_FILTER, FX_ABSENT_KEY = "order_id % 29 = 0", "-1 - order_id"
# Headers as a raw file carries them, two under the names that are renamed later.
FX_RAW_HEADERS = {"days_for_shipping_real": "Days for Shipping", "days_for_shipment_scheduled": "Days for  Shipment ",
                  "order_id": " Order Id", "order_item_total": "Order Item Total"}

LINE_ORDER = ("line_no", "order_item_cardprod_id", "supp_key", "sales")

FX_JOIN_SQL = ("lineitem JOIN orders ON l_orderkey = o_orderkey "
               "JOIN customer ON o_custkey = c_custkey "
               "JOIN nation ON c_nationkey = n_nationkey "
               "JOIN region ON n_regionkey = r_regionkey "
               "JOIN part ON l_partkey = p_partkey")

TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


#: lines that one task joins, sorts and combines at most, on average, and rows of part or customer
#: beyond which lines or orders meet that table in as many tasks; fewer tasks than the last are left to Spark
LINES_A_TASK, PARTS_A_TASK, LEAST_TASKS = 1 << 17, 1 << 17, 8


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the lines of ``sf_dir``, a power of two (so tables bucketed by a smaller one get
    whole buckets from every task). The row count comes from the Parquet footers."""
    lines = load_tables(spark, sf_dir, ("lineitem",))["lineitem"].count()
    return 1 << max(0, ceil(lines / LINES_A_TASK) - 1).bit_length()


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir, TABLES)
    tasks = line_tasks(spark, sf_dir)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(tasks, key) if tasks > LEAST_TASKS else df

    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_extendedprice", "l_discount", "l_linestatus")
    part = t["part"].select("p_partkey", "p_type", "p_brand", "p_retailprice")
    # nation (25 rows) and region (5 rows) have a fixed size: safe to broadcast
    geo = (F.broadcast(t["nation"].select("n_nationkey", "n_name", "n_regionkey"))
           .join(F.broadcast(t["region"].select("r_regionkey", "r_name")),
                 F.col("n_regionkey") == F.col("r_regionkey")))
    cust = t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment") \
        .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                "o_orderpriority")
    if tasks > LEAST_TASKS and t["customer"].count() > PARTS_A_TASK:  # a smaller table may be broadcast
        orders, cust = dealt(orders, "o_custkey"), dealt(cust, "c_custkey")
    orders = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    if tasks > LEAST_TASKS and part.count() > PARTS_A_TASK:  # a smaller table may be broadcast
        li, part = dealt(li, "l_partkey"), dealt(part, "p_partkey")
    lines = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return dealt(lines, "l_orderkey").join(dealt(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, typed order lines (FIXTURES.md §2)."""
    return _joined(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in FX_LINES_COLUMNS])


def fx_lines_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean lines with a profit that is constant inside every order (FIXTURES.md §2.1)."""
    named = dict(FX_LINES_COLUMNS) | {"order_profit_per_order": FX_CONSTANT_PROFIT}
    return _joined(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in named.items()])


def fx_lines_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty lines as a file without a schema holds them: all text, under raw headers."""
    raw = fx_lines_raw(spark, sf_dir)
    return raw.select(*[F.col(c).cast("string").alias(FX_RAW_HEADERS.get(c, c)) for c in raw.columns])


def fx_lines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text order lines with exact duplicates (FIXTURES.md §3). The
    duplicated rows are generated with ``explode`` in the same pass (one join,
    not a union of two joins)."""
    j = _joined(spark, sf_dir)
    copies = F.when(F.expr(FX_RAW_DUP_FILTER), 2).otherwise(1)
    cols = [F.expr(FX_RAW_OVERRIDES.get(n, e)).alias(n) for n, e in FX_LINES_COLUMNS]
    # copies of a mark are exploded, not of the wide row: the row is built once, after them
    return j.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*cols)


def fx_scores(lines: DataFrame, per_order: DataFrame | None = None) -> DataFrame:
    """Fixed scores per order and model, long form (FIXTURES.md §4).

    One ``groupBy('order_id')`` (no shuffle after ``fx_lines``), then the three
    models are generated per row with ``explode``: no join. An order table
    that already holds the (per-order constant) label can be passed as
    ``per_order`` instead."""
    if per_order is None:
        per_order = lines.groupBy("order_id").agg(F.max("late_delivery_risk").alias("risk"))
    else:
        per_order = per_order.select("order_id", F.col("late_delivery_risk").alias("risk"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("p"))
                       for m, e in FX_SCORE_MODELS])
    return (per_order.select("order_id", "risk", F.explode(models).alias("s"))
            .select(F.col("s.model").alias("model"), "order_id",
                    F.col("risk").alias("late_delivery_risk"),
                    F.col("s.p").alias("late_delivery_probability")))


def fx_absent_scores(scores: DataFrame) -> DataFrame:
    """The scores, and some more under order ids that no order has (FIXTURES.md §4.1)."""
    absent = scores.filter(F.expr(FX_ABSENT_FILTER)).withColumn("order_id", F.expr(FX_ABSENT_KEY))
    return scores.unionByName(absent.select(*scores.columns))


# ---- the same mapping as SQL text, for the DuckDB oracle -------------------

def fx_lines_sql() -> str:
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in FX_LINES_COLUMNS)
    return f"SELECT\n  {cols}\nFROM {FX_JOIN_SQL}"


def fx_lines_constant_sql() -> str:
    named = dict(FX_LINES_COLUMNS) | {"order_profit_per_order": FX_CONSTANT_PROFIT}
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in named.items())
    return f"SELECT\n  {cols}\nFROM {FX_JOIN_SQL}"


def fx_lines_raw_sql() -> str:
    cols = ",\n  ".join(f"{FX_RAW_OVERRIDES.get(n, e)} AS {n}" for n, e in FX_LINES_COLUMNS)
    return (f"SELECT\n  {cols}\nFROM {FX_JOIN_SQL}\nUNION ALL\n"
            f"SELECT\n  {cols}\nFROM {FX_JOIN_SQL} WHERE {FX_RAW_DUP_FILTER}")


def fx_scores_sql(lines_cte: str = "fx_lines") -> str:
    per = f"(SELECT order_id, max(late_delivery_risk) AS risk FROM {lines_cte} GROUP BY order_id)"
    parts = [f"SELECT '{m}' AS model, order_id, risk AS late_delivery_risk, {e} AS "
             f"late_delivery_probability FROM {per}" for m, e in FX_SCORE_MODELS]
    return "\nUNION ALL\n".join(parts)
