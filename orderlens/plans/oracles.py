"""Oracle SQL for DuckDB, one statement per registered query.

Each statement sees only the driver's raw tables and inlines the fixture
mapping as a CTE; it restates every operator in plain SQL (independent of
the Spark code), with the same output names and types.
"""

from __future__ import annotations

from orderlens.sources.fixtures import (
    FX_ABSENT_FILTER, FX_ABSENT_KEY, FX_LINES_COLUMNS, fx_lines_constant_sql, fx_lines_raw_sql, fx_lines_sql, fx_scores_sql,
)
from orderlens.sources.io import PANDAS_NA_TOKENS


LINE_DIMS = ("shipping_mode", "market", "order_region", "category_name", "customer_segment")
ORDER_DIMS = ("shipping_mode", "market", "order_region", "customer_segment")
ORDER_FIELDS = ("order_date", "shipping_date", "delivery_status", "late_delivery_risk",
                "days_for_shipping_real", "days_for_shipment_scheduled", "shipping_mode", "market",
                "order_region", "customer_segment", "order_status")
LINE_ORDER_SQL = "line_no, order_item_cardprod_id, supp_key, sales"


def msum(x: str) -> str:
    """Sum of the values as they are written, to 18 decimals; texts between, as the casts round."""
    return f"coalesce(CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE), 0.0::DOUBLE)"


def mean(x: str) -> str:
    return f"(CASE WHEN count({x}) > 0 THEN CAST(sum({x}) AS DOUBLE) / count({x}) END)"


def share(cond: str) -> str:
    return f"(CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE) / count(*))"


def margin_inf(p: str, r: str) -> str:
    return (f"(CASE WHEN {r} <> 0 THEN {p} / {r} WHEN {p} > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN {p} < 0 THEN CAST('-inf' AS DOUBLE) ELSE 0.0::DOUBLE END)")


def margin0(p: str, r: str) -> str:
    return f"(CASE WHEN {r} <> 0 THEN {p} / {r} ELSE 0.0::DOUBLE END)"


def ctes(**named: str) -> str:
    # materialised: each is computed once, however many parts of a statement read it
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED (\n{v}\n)" for k, v in named.items())


FX = fx_lines_sql()
FX_RAW = fx_lines_raw_sql()

# ---- B: cleaning ------------------------------------------------------------

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in PANDAS_NA_TOKENS)
_RAW_TEXT = {"order_date", "order_item_total", "order_profit_per_order", "shipping_mode",
             "delivery_status", "market", "order_region", "customer_segment", "category_name",
             "category_id", "order_status", "type"}


def _s(c: str) -> str:
    return (f"(CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE "
            f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '') END)")


def _num(expr: str) -> str:
    return f"(CASE WHEN isnan(try_cast({expr} AS DOUBLE)) THEN NULL ELSE try_cast({expr} AS DOUBLE) END)"


def _prep_select() -> str:
    cols = []
    for name, _ in FX_LINES_COLUMNS:
        if name == "order_date":
            e = (f"CAST(coalesce(try_strptime({_s(name)}, '%Y-%m-%d %H:%M:%S'), "
                 f"try_strptime({_s(name)}, '%Y-%m-%d'), try_strptime({_s(name)}, '%m/%d/%Y %H:%M'), "
                 f"try_strptime({_s(name)}, '%m/%d/%Y')) AS TIMESTAMP)")
        elif name == "shipping_date":
            e = f"CAST({name} AS TIMESTAMP)"
        elif name in ("order_item_total", "order_profit_per_order", "days_for_shipping_real"):
            e = _num(_s(name))
        elif name in ("sales", "days_for_shipment_scheduled", "late_delivery_risk"):
            e = _num(name)
        elif name in _RAW_TEXT:
            e = _s(name)
        else:
            e = name
        cols.append(f"{e} AS {name}")
    return "SELECT " + ",\n  ".join(cols) + "\nFROM raw"


def _derive_select(src: str) -> str:
    return f"""SELECT *,
  days_for_shipping_real - days_for_shipment_scheduled AS shipping_delay_days,
  CASE WHEN days_for_shipping_real - days_for_shipment_scheduled > 0 THEN 'Late'
       WHEN days_for_shipping_real - days_for_shipment_scheduled < 0 THEN 'Early'
       ELSE 'On Time' END AS delivery_timing_group,
  CAST(year(order_date) AS INTEGER) AS order_year,
  strftime(order_date, '%Y-%m') AS order_month,
  dayname(order_date) AS order_day_of_week,
  order_item_total AS revenue_value,
  CASE WHEN order_profit_per_order < 0 THEN 'Loss' ELSE 'Profit' END AS profit_status
FROM {src}"""


B_CTES = dict(raw=FX_RAW, typed=_prep_select(), prep=_derive_select("typed"))
_PREP_COLS = [n for n, _ in FX_LINES_COLUMNS] + [
    "shipping_delay_days", "delivery_timing_group", "order_year", "order_month",
    "order_day_of_week", "revenue_value", "profit_status"]

# the same lines from text: whole numbers become BIGINT, decimals DOUBLE
_WHOLE = ("order_id", "line_no", "supp_key", "order_item_cardprod_id", "order_item_quantity")
A1 = ctes(**B_CTES) + "\nSELECT * REPLACE (" + ", ".join(
    [f"CAST({c} AS BIGINT) AS {c}" for c in _WHOLE]
    + ["CAST(CAST(order_item_discount AS VARCHAR) AS DOUBLE) AS order_item_discount"]) + ") FROM prep"

B13 = ctes(**B_CTES) + """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM prep)) AS BIGINT) AS duplicates
FROM prep"""

B14 = ctes(**B_CTES) + "\nSELECT DISTINCT * FROM prep"

B15 = ctes(**B_CTES, clean="SELECT DISTINCT * FROM prep") + "\nSELECT * FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT {i} AS column_position, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) "
    f"AS BIGINT) AS missing_cells FROM clean" for i, c in enumerate(_PREP_COLS)) + "\n) WHERE missing_cells > 0"

B15 = f"SELECT *, CAST(row_number() OVER (ORDER BY missing_cells DESC, column_position) AS INTEGER) AS rank FROM ({B15})"

_NULLS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _PREP_COLS)
B16 = ctes(**B_CTES, clean="SELECT DISTINCT * FROM prep") + f"""
SELECT 1 AS metric_order, 'rows_before' AS metric, CAST(count(*) AS BIGINT) AS value FROM prep
UNION ALL SELECT 2, 'rows_after', CAST(count(*) AS BIGINT) FROM clean
UNION ALL SELECT 3, 'columns', CAST({len(_PREP_COLS)} AS BIGINT)
UNION ALL SELECT 4, 'duplicates_removed', CAST((SELECT count(*) FROM prep) - count(*) AS BIGINT) FROM clean
UNION ALL SELECT 5, 'missing_cells', CAST(coalesce(sum({_NULLS}), 0) AS BIGINT) FROM clean"""

# ---- C: line KPIs ------------------------------------------------------------

LINES = """SELECT *, days_for_shipping_real - days_for_shipment_scheduled AS shipping_delay_days,
  order_item_total AS revenue_value FROM fx_lines"""

_C10_AGG = f"""SELECT count(DISTINCT order_id) AS unique_orders, count(*) AS order_lines,
  {msum('revenue_value')} AS revenue, {msum('order_profit_per_order')} AS profit,
  {mean('late_delivery_risk')} AS late_rate, {mean('days_for_shipping_real')} AS real_days,
  {mean('days_for_shipment_scheduled')} AS sched_days, {mean('shipping_delay_days')} AS delay_days,
  count(DISTINCT CASE WHEN order_profit_per_order < 0 THEN order_id END) AS loss_orders,
  {msum('CASE WHEN late_delivery_risk = 1 THEN order_profit_per_order END')} AS late_profit
FROM lines"""
_C10_ROWS = [("Unique Orders", "unique_orders"), ("Order Lines", "order_lines"),
             ("Revenue", "revenue"), ("Profit", "profit"),
             ("Profit Margin", margin0("profit", "revenue")), ("Late Delivery Rate", "late_rate"),
             ("On-Time Delivery Rate", "1.0::DOUBLE - late_rate"),
             ("Average Shipping Days", "real_days"),
             ("Average Scheduled Shipping Days", "sched_days"),
             ("Average Delay Days", "delay_days"), ("Loss-Making Orders", "loss_orders"),
             ("Profit from Late Deliveries", "late_profit")]


def kpi_rows(rows, src: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {i + 1} AS kpi_order, '{k}' AS kpi, CAST({e} AS DOUBLE) AS value FROM {src}"
        for i, (k, e) in enumerate(rows))


C10 = ctes(fx_lines=FX, lines=LINES, k=_C10_AGG) + "\n" + kpi_rows(_C10_ROWS, "k")


def _line_bd_sql() -> str:
    parts = [f"""SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS dimension_value,
  count(*) AS order_lines, count(DISTINCT order_id) AS unique_orders,
  {msum('revenue_value')} AS revenue, {msum('order_profit_per_order')} AS profit,
  {mean('late_delivery_risk')} AS late_delivery_rate,
  {mean('days_for_shipping_real')} AS avg_shipping_days,
  {mean('shipping_delay_days')} AS avg_delay_days
FROM lines GROUP BY {d}""" for d in LINE_DIMS]
    return "SELECT *, " + margin_inf("profit", "revenue") + " AS profit_margin FROM (\n" + \
        "\nUNION ALL\n".join(parts) + "\n)"


C11_CTES = dict(fx_lines=FX, lines=LINES, bd=_line_bd_sql())
C11 = ctes(**C11_CTES) + "\nSELECT * FROM bd"


def top_k_sql(dims, metric: str, desc: bool, min_orders: int, k: int = 10) -> str:
    rank = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {i + 1}" for i, d in enumerate(dims)) + " END"
    direction = "DESC NULLS LAST" if desc else "ASC NULLS LAST"
    return f"""SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY {metric} {direction}, {rank}, dimension_value ASC NULLS LAST) AS rn
  FROM bd WHERE unique_orders >= {min_orders}) WHERE rn <= {k}"""


# ---- D: orders -----------------------------------------------------------------

def _first(c: str) -> str:
    return f"first({c} ORDER BY {LINE_ORDER_SQL}) FILTER (WHERE {c} IS NOT NULL)"


ORDERS = f"""SELECT *,
  days_for_shipping_real - days_for_shipment_scheduled AS shipping_delay_days,
  CASE delivery_status WHEN 'Late delivery' THEN 'Late' WHEN 'Shipping on time' THEN 'On Time'
       WHEN 'Advance shipping' THEN 'Early' WHEN 'Shipping canceled' THEN 'Canceled'
       ELSE delivery_status END AS delivery_timing_group,
  CASE WHEN order_profit_per_order < 0 THEN 1 ELSE 0 END AS loss_flag
FROM (
  SELECT order_id, {msum('order_item_total')} AS revenue,
    CAST(coalesce(sum(order_item_quantity), 0) AS BIGINT) AS quantity,
    {msum('order_profit_per_order')} AS order_profit_per_order,
    {", ".join(f"{_first(c)} AS {c}" for c in ORDER_FIELDS)},
    count(DISTINCT order_item_cardprod_id) AS unique_products,
    count(DISTINCT category_name) AS unique_categories,
    count(*) AS order_lines
  FROM fx_lines WHERE order_id IS NOT NULL GROUP BY order_id)"""

D1 = ctes(fx_lines=FX, per=("SELECT order_id, " + ", ".join(
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in ORDER_FIELDS)
    + " FROM fx_lines WHERE order_id IS NOT NULL GROUP BY order_id")) + "\n" + "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS field_order, '{c}' AS field, CAST(count(*) FILTER (WHERE {c} > 1) AS BIGINT) "
    f"AS conflicting_orders FROM per" for i, c in enumerate(ORDER_FIELDS))

D2 = ctes(fx_lines=FX) + """
SELECT coalesce(bool_and(n <= 1), true) AS profit_is_constant FROM (
  SELECT order_id, count(DISTINCT order_profit_per_order)
         + max(CASE WHEN order_profit_per_order IS NULL THEN 1 ELSE 0 END) AS n
  FROM fx_lines WHERE order_id IS NOT NULL GROUP BY order_id)"""

D_CTES = dict(fx_lines=FX, orders_t=ORDERS)
D4 = ctes(**D_CTES) + "\nSELECT * FROM orders_t"
D4_CONSTANT = ctes(fx_lines=fx_lines_constant_sql(), orders_t=ORDERS.replace(
    f"{msum('order_profit_per_order')} AS order_profit_per_order",
    f"CAST({_first('order_profit_per_order')} AS DOUBLE) AS order_profit_per_order")) + "\nSELECT * FROM orders_t"
D9 = ctes(**D_CTES) + """
SELECT *, CAST(row_number() OVER (ORDER BY orders DESC, delivery_timing_group ASC NULLS LAST) AS INTEGER) AS rank
FROM (SELECT delivery_timing_group, count(*) AS orders FROM orders_t GROUP BY 1)"""
D10 = ctes(**D_CTES) + """
SELECT 1 AS metric_order, 'source_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM fx_lines
UNION ALL SELECT 2, 'unique_orders', CAST(count(*) AS VARCHAR) FROM orders_t
UNION ALL SELECT 3, 'output_columns', '21'
UNION ALL SELECT 4, 'profit_rule', 'sum'"""

# ---- E: order KPIs ---------------------------------------------------------------

def _share_of(v: str) -> str:
    g = "delivery_timing_group"
    return (f"(CASE WHEN count({g}) > 0 THEN CAST(count(*) FILTER (WHERE {g} = '{v}') AS DOUBLE) "
            f"/ count({g}) ELSE 0.0::DOUBLE END)")


_E7_AGG = f"""SELECT count(DISTINCT order_id) AS unique_orders, {msum('revenue')} AS revenue,
  {msum('order_profit_per_order')} AS profit,
  {_share_of('Late')} AS late, {_share_of('On Time')} AS on_time, {_share_of('Early')} AS early,
  {_share_of('Canceled')} AS canceled,
  {mean('days_for_shipping_real')} AS real_days, {mean('days_for_shipment_scheduled')} AS sched_days,
  {mean('shipping_delay_days')} AS delay_days, coalesce(sum(loss_flag), 0) AS loss_orders,
  {mean('loss_flag')} AS loss_rate,
  {msum("CASE WHEN delivery_timing_group = 'Late' THEN revenue END")} AS late_revenue,
  {msum("CASE WHEN delivery_timing_group = 'Late' THEN order_profit_per_order END")} AS late_profit
FROM orders_t"""
_E7_ROWS = [("Unique Orders", "unique_orders"), ("Revenue", "revenue"), ("Profit", "profit"),
            ("Profit Margin", margin0("profit", "revenue")), ("Late Delivery Rate", "late"),
            ("On-Time Delivery Rate", "on_time"), ("Early Delivery Rate", "early"),
            ("Cancellation Rate", "canceled"), ("Average Shipping Days", "real_days"),
            ("Average Scheduled Shipping Days", "sched_days"), ("Average Delay Days", "delay_days"),
            ("Loss-Making Orders", "loss_orders"), ("Loss-Making Order Rate", "loss_rate"),
            ("Late Orders Revenue", "late_revenue"), ("Late Orders Profit", "late_profit")]
E7 = ctes(**D_CTES, k=_E7_AGG) + "\n" + kpi_rows(_E7_ROWS, "k")


def _order_bd_sql() -> str:
    g = "delivery_timing_group"
    parts = [f"""SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS dimension_value,
  count(DISTINCT order_id) AS unique_orders,
  {msum('revenue')} AS revenue, {msum('order_profit_per_order')} AS profit,
  {share(f"{g} = 'Late'")} AS late_delivery_rate, {share(f"{g} = 'On Time'")} AS on_time_delivery_rate,
  {share(f"{g} = 'Canceled'")} AS cancellation_rate, {mean('loss_flag')} AS loss_order_rate,
  {mean('days_for_shipping_real')} AS avg_shipping_days, {mean('shipping_delay_days')} AS avg_delay_days
FROM orders_t GROUP BY {d}""" for d in ORDER_DIMS]
    return "SELECT *, " + margin_inf("profit", "revenue") + " AS profit_margin FROM (\n" + \
        "\nUNION ALL\n".join(parts) + "\n)"


E8_CTES = dict(**D_CTES, bd=_order_bd_sql())
E8 = ctes(**E8_CTES) + "\nSELECT * FROM bd"

ORACLES: dict[str, str] = {
    "a1_typed_lines": A1,
    "b13_duplicate_count": B13,
    "b14_clean_lines": B14,
    "b15_missing_by_column": B15,
    "b16_cleaning_profile": B16,
    "c10_line_kpis": C10,
    "c11_line_breakdown": C11,
    "c14_worst_late_lines": ctes(**C11_CTES) + "\n" + top_k_sql(LINE_DIMS, "late_delivery_rate", True, 100),
    "c14_worst_late_lines_600": ctes(**C11_CTES) + "\n" + top_k_sql(LINE_DIMS, "late_delivery_rate", True, 600),
    "c15_worst_profit_lines": ctes(**C11_CTES) + "\n" + top_k_sql(LINE_DIMS, "profit", False, 100),
    "c15_worst_profit_lines_600": ctes(**C11_CTES) + "\n" + top_k_sql(LINE_DIMS, "profit", False, 600),
    "d1_field_conflicts": D1,
    "d2_profit_constant": D2,
    "d4_build_orders": D4,
    "d4_build_orders_constant": D4_CONSTANT,
    "d9_timing_counts": D9,
    "d10_orders_profile": D10,
    "e7_order_kpis": E7,
    "e8_order_breakdown": E8,
    "e11_worst_late_orders": ctes(**E8_CTES) + "\n" + top_k_sql(ORDER_DIMS, "late_delivery_rate", True, 100),
    "e11_worst_late_orders_600": ctes(**E8_CTES) + "\n" + top_k_sql(ORDER_DIMS, "late_delivery_rate", True, 600),
    "e12_worst_margin_orders": ctes(**E8_CTES) + "\n" + top_k_sql(ORDER_DIMS, "profit_margin", False, 100),
    "e12_worst_margin_orders_600": ctes(**E8_CTES) + "\n" + top_k_sql(ORDER_DIMS, "profit_margin", False, 600),
}


# ---- F: features, split, fitted statistics, metrics ---------------------------------

FEAT = f"""SELECT *, CAST(month(order_date) AS INTEGER) AS order_month,
  CAST(isodow(order_date) - 1 AS INTEGER) AS order_day_of_week
FROM (
  SELECT order_id, {_first('order_date')} AS order_date,
    {_first('late_delivery_risk')} AS late_delivery_risk,
    {_first('days_for_shipment_scheduled')} AS days_for_shipment,
    {_first('shipping_mode')} AS shipping_mode, {_first('order_region')} AS order_region,
    {_first('market')} AS market, {_first('customer_segment')} AS customer_segment,
    {_first('type')} AS order_type,
    {msum('order_item_total')} AS order_value, {msum('order_profit_per_order')} AS order_profit,
    CAST(coalesce(sum(order_item_quantity), 0) AS BIGINT) AS quantity,
    {msum('order_item_discount')} AS discount,
    count(DISTINCT order_item_cardprod_id) AS unique_products,
    count(DISTINCT category_id) AS unique_categories
  FROM fx_lines WHERE order_id IS NOT NULL GROUP BY order_id)"""
SPLIT = """SELECT *, CASE WHEN row_number() OVER (ORDER BY order_date, order_id)
    <= CAST(floor(0.8 * count(*) OVER ()) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM feat"""
F_CTES = dict(fx_lines=FX, feat=FEAT, split_t=SPLIT,
              train=("SELECT * FROM split_t WHERE split = 'train'"),
              test=("SELECT * FROM split_t WHERE split = 'test'"))
NUMERIC = ("days_for_shipment", "order_value", "quantity", "discount", "unique_products",
           "unique_categories", "order_month", "order_day_of_week")
CATEGORICAL = ("shipping_mode", "order_region", "market", "customer_segment", "order_type")


def _median_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, (CAST(min(x) FILTER (WHERE rn = (n + 1) // 2) AS DOUBLE)
    + CAST(min(x) FILTER (WHERE rn = n // 2 + 1) AS DOUBLE)) / 2 AS median
FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n
      FROM train WHERE {c} IS NOT NULL)"""


F8 = ctes(**F_CTES) + "\n" + "\nUNION ALL\n".join(_median_sql(c) for c in NUMERIC)
_CAT_LONG = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM train WHERE {c} IS NOT NULL"
    for c in CATEGORICAL)
F9 = ctes(**F_CTES, cat=_CAT_LONG) + """
SELECT feature, value AS mode, n AS frequency FROM (
  SELECT feature, value, count(*) AS n FROM cat GROUP BY feature, value)
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) = 1"""
F12 = ctes(**F_CTES, cat=_CAT_LONG) + """
SELECT feature, value AS category,
  CAST(dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT feature, value FROM cat)"""
F10 = ctes(**F_CTES) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev FROM train"
    for c in NUMERIC)
F12_TEST = ctes(**F_CTES, seen=("SELECT * REPLACE (CASE WHEN order_id % 50 = 0 THEN 'ATLANTIS' ELSE market END AS market) FROM test"),
                **{f"codes_{c}": f"SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM train WHERE {c} IS NOT NULL)"
                   for c in CATEGORICAL}) + "\nSELECT seen.order_id, " + ", ".join(
    f"CAST(coalesce(codes_{c}.code, -1) AS INTEGER) AS {c}_code" for c in CATEGORICAL) + " FROM seen " + " ".join(
    f"LEFT JOIN codes_{c} ON codes_{c}.v = seen.{c}" for c in CATEGORICAL)
F15 = ctes(**F_CTES) + """
SELECT order_id, late_delivery_risk,
  (SELECT late_delivery_risk FROM train GROUP BY late_delivery_risk
   ORDER BY count(*) DESC, late_delivery_risk ASC LIMIT 1) AS majority_prediction,
  (SELECT CAST(sum(late_delivery_risk) AS DOUBLE) / count(*) FROM train) AS prior_probability
FROM test"""

SCORES = fx_scores_sql("fx_lines")
S_CTES = dict(fx_lines=FX, scores=SCORES)
_P = "late_delivery_probability"
RISK3 = (f"CASE WHEN {_P} >= 0.0::DOUBLE AND {_P} <= 0.4::DOUBLE THEN 'Low' "
         f"WHEN {_P} > 0.4::DOUBLE AND {_P} <= 0.7::DOUBLE THEN 'Medium' "
         f"WHEN {_P} > 0.7::DOUBLE AND {_P} <= 1.0::DOUBLE THEN 'High' END")
PRED = (f"SELECT *, CASE WHEN {_P} > 0.5::DOUBLE THEN 1 ELSE 0 END AS predicted_late_delivery, "
        f"{RISK3} AS risk_level FROM scores")
F21 = ctes(**S_CTES) + "\n" + PRED
F22 = ctes(**S_CTES, pred=PRED) + """
SELECT model, CAST(count(*) FILTER (WHERE late_delivery_risk = predicted_late_delivery) AS DOUBLE)
  / count(*) AS accuracy FROM pred GROUP BY model"""
AUC = f"""SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
    CAST(sum(CAST(pos AS HUGEINT) * (2 * neg_below + neg)) AS DOUBLE)
    / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc
FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM (SELECT model, CAST({_P} AS DOUBLE) AS p,
          count(*) FILTER (WHERE late_delivery_risk = 1) AS pos,
          count(*) FILTER (WHERE late_delivery_risk = 0) AS neg
        FROM scores GROUP BY model, p))
GROUP BY model"""
F23 = ctes(**S_CTES) + "\n" + AUC


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0::DOUBLE END)"


def metrics_cols() -> str:
    fp, fn = "(pp - tp)", "(pos - tp)"
    tn = f"(n - pp - {fn})"
    return (f"CASE WHEN n > 0 THEN CAST(tp + {tn} AS DOUBLE) / n END AS accuracy, "
            f"{_div('tp', 'pp')} AS precision, {_div('tp', 'pos')} AS recall, "
            f"{_div('2 * tp', f'2 * tp + {fp} + {fn}')} AS f1, CAST(pp AS BIGINT) AS predicted_late_orders")


def grid_sql(thresholds: str, where: str = "") -> str:
    return f"""SELECT model, threshold, {metrics_cols()} FROM (
  SELECT model, t AS threshold, count(*) AS n, count(*) FILTER (WHERE late_delivery_risk = 1) AS pos,
    count(*) FILTER (WHERE {_P} >= t AND late_delivery_risk = 1) AS tp,
    count(*) FILTER (WHERE {_P} >= t) AS pp
  FROM scores, (SELECT unnest({thresholds}::DOUBLE[]) AS t) {where}
  GROUP BY model, t)"""


GRID = grid_sql("[0.3, 0.4, 0.5, 0.6, 0.7]", "WHERE model <> 'baseline'")
F25 = ctes(**S_CTES) + "\n" + grid_sql("[0.5]")
F26 = ctes(**S_CTES, auc=AUC, m=grid_sql("[0.5]")) + """
SELECT auc.model, roc_auc, threshold, accuracy, precision, recall, f1, predicted_late_orders,
  CAST(row_number() OVER (ORDER BY f1 DESC NULLS LAST, roc_auc DESC NULLS LAST, auc.model) AS INTEGER) AS rank
FROM auc JOIN m ON auc.model = m.model"""
F27 = ctes(**S_CTES) + "\n" + GRID
BEST = "SELECT * FROM grid ORDER BY f1 DESC, recall DESC, precision DESC, model ASC, threshold ASC LIMIT 1"
F28 = ctes(**S_CTES, grid=GRID) + "\n" + BEST


def _report_rows() -> str:
    d = _div
    p1, r1, f1 = d("tp", "tp + fp"), d("tp", "tp + fn"), d("2 * tp", "2 * tp + fp + fn")
    p0, r0, f0 = d("tn", "tn + fn"), d("tn", "tn + fp"), d("2 * tn", "2 * tn + fn + fp")
    n, s0, s1 = "(tp + fp + fn + tn)", "(tn + fp)", "(tp + fn)"

    def w(a, b):
        return f"(CASE WHEN {n} > 0 THEN ({a} * {s0} + {b} * {s1}) / {n} END)"

    rows = [(1, "0", p0, r0, f0, s0), (2, "1", p1, r1, f1, s1),
            (3, "accuracy", "NULL", "NULL", d("tp + tn", n), n),
            (4, "macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            (5, "weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n)]
    return "\nUNION ALL\n".join(
        f"SELECT model, {o} AS row_order, '{lab}' AS label, CAST({pr} AS DOUBLE) AS precision, "
        f"CAST({rc} AS DOUBLE) AS recall, CAST({f} AS DOUBLE) AS f1_score, CAST({s} AS BIGINT) AS support FROM c"
        for o, lab, pr, rc, f, s in rows)


F24 = ctes(**S_CTES, pred=PRED, c="""SELECT model,
  count(*) FILTER (WHERE late_delivery_risk = 1 AND predicted_late_delivery = 1) AS tp,
  count(*) FILTER (WHERE late_delivery_risk = 0 AND predicted_late_delivery = 1) AS fp,
  count(*) FILTER (WHERE late_delivery_risk = 1 AND predicted_late_delivery = 0) AS fn,
  count(*) FILTER (WHERE late_delivery_risk = 0 AND predicted_late_delivery = 0) AS tn
FROM pred GROUP BY model""") + "\n" + _report_rows()

_CHOSEN = """SELECT *, (SELECT threshold FROM best) AS threshold FROM scores WHERE model = (SELECT model FROM best)"""
F29 = ctes(**F_CTES, scores=SCORES, grid=GRID, best=BEST, chosen=_CHOSEN) + f"""
SELECT t.order_id, t.order_date, s.late_delivery_risk, t.shipping_mode, t.order_region, t.market,
  t.customer_segment, t.order_value, t.order_profit, s.{_P},
  CASE WHEN s.{_P} >= s.threshold THEN 1 ELSE 0 END AS predicted_late_delivery,
  {RISK3.replace(_P, 's.' + _P)} AS risk_level,
  CASE WHEN s.late_delivery_risk = (CASE WHEN s.{_P} >= s.threshold THEN 1 ELSE 0 END) THEN 1 ELSE 0 END
    AS prediction_correct
FROM chosen s JOIN test t ON t.order_id = s.order_id"""

ORACLES.update({
    "f2_order_features": ctes(fx_lines=FX, feat=FEAT) + "\nSELECT * FROM feat",
    "f5_time_split": ctes(**F_CTES) + "\nSELECT order_id, order_date, split FROM split_t",
    "f6_split_profile": ctes(**F_CTES) + """
SELECT split, count(*) AS orders, min(order_date) AS first_order_date, max(order_date) AS last_order_date
FROM split_t GROUP BY split""",
    "f8_medians": F8,
    "f9_modes": F9,
    "f12_ordinal_codes": F12,
    "f10_scaler": F10,
    "f12_test_codes": F12_TEST,
    "f15_baselines": F15,
    "f21_predictions": F21,
    "f22_accuracy": F22,
    "f23_roc_auc": F23,
    "f24_class_report": F24,
    "f25_metrics_at_050": F25,
    "f26_model_comparison": F26,
    "f27_threshold_grid": F27,
    "f28_select_best": F28,
    "f29_final_predictions": F29,
})

# ---- G, H: decision table and dashboard ------------------------------------------------

_DEC_ORDER_COLS = ("order_date", "shipping_date", "revenue", "order_profit_per_order",
                   "delivery_timing_group", "shipping_mode", "order_region", "market",
                   "customer_segment", "days_for_shipping_real", "days_for_shipment_scheduled",
                   "shipping_delay_days", "quantity", "unique_products", "unique_categories",
                   "order_lines", "loss_flag")
SC = "SELECT order_id, late_delivery_risk, late_delivery_probability FROM scores WHERE model = 'model_a'"
JOINED = ("SELECT s.order_id, s.late_delivery_risk, s.late_delivery_probability, "
          + ", ".join(f"o.{c}" for c in _DEC_ORDER_COLS)
          + " FROM sc s LEFT JOIN orders_t o ON s.order_id = o.order_id")


def _conf(tag: str) -> str:
    f = f"prediction_{tag}"
    return (f"CASE WHEN late_delivery_risk = 1 AND {f} = 1 THEN 'True Positive' "
            f"WHEN late_delivery_risk = 0 AND {f} = 0 THEN 'True Negative' "
            f"WHEN late_delivery_risk = 0 AND {f} = 1 THEN 'False Positive' "
            f"WHEN late_delivery_risk = 1 AND {f} = 0 THEN 'False Negative' END")


FLAGS = f"""SELECT *,
  CASE WHEN {_P} >= 0.3::DOUBLE THEN 1 ELSE 0 END AS prediction_030,
  CASE WHEN {_P} >= 0.4::DOUBLE THEN 1 ELSE 0 END AS prediction_040,
  CASE WHEN {_P} >= 0.0::DOUBLE AND {_P} <= 0.3::DOUBLE THEN 'Low'
       WHEN {_P} > 0.3::DOUBLE AND {_P} <= 0.4::DOUBLE THEN 'Watch'
       WHEN {_P} > 0.4::DOUBLE AND {_P} <= 0.7::DOUBLE THEN 'High'
       WHEN {_P} > 0.7::DOUBLE AND {_P} <= 1.0::DOUBLE THEN 'Critical' END AS risk_level
FROM joined"""
DEC = f"""SELECT *, {_conf('030')} AS prediction_result_030, {_conf('040')} AS prediction_result_040,
  CASE WHEN prediction_030 = 1 THEN revenue ELSE 0.0::DOUBLE END AS revenue_at_risk_030,
  CASE WHEN prediction_040 = 1 THEN revenue ELSE 0.0::DOUBLE END AS revenue_at_risk_040,
  CASE WHEN prediction_030 = 1 THEN order_profit_per_order ELSE 0.0::DOUBLE END AS profit_at_risk_030,
  CASE WHEN prediction_040 = 1 THEN order_profit_per_order ELSE 0.0::DOUBLE END AS profit_at_risk_040,
  CASE risk_level WHEN 'Low' THEN 'Standard Monitoring' WHEN 'Watch' THEN 'Review if Capacity Allows'
    WHEN 'High' THEN 'Priority Review' WHEN 'Critical' THEN 'Immediate Intervention' END
    AS recommended_action
FROM flags"""
G_CTES = dict(fx_lines=FX, orders_t=ORDERS, scores=SCORES, sc=SC, joined=JOINED, flags=FLAGS, dec=DEC)


def _threshold_rows(select_cols: str) -> str:
    parts = []
    for t, tag in (("0.3", "030"), ("0.4", "040")):
        parts.append(f"""SELECT {t}::DOUBLE AS threshold, {select_cols.format(tag=tag)} FROM dec""")
    return "\nUNION ALL\n".join(parts)


H1_COLS = ("count(*) AS orders, CAST(count(*) FILTER (WHERE late_delivery_risk = 1) AS DOUBLE) / count(*) "
           "AS late_delivery_rate, count(*) FILTER (WHERE prediction_{tag} = 1) AS flagged_orders, "
           "count(*) FILTER (WHERE prediction_{tag} = 1 AND late_delivery_risk = 1) AS late_orders_detected, "
           + msum("revenue_at_risk_{tag}") + " AS revenue_flagged")
H4_COLS = ("count(*) FILTER (WHERE prediction_{tag} = 1) AS flagged_orders, "
           "count(*) FILTER (WHERE prediction_{tag} = 1 AND late_delivery_risk = 1) AS true_positives, "
           "count(*) FILTER (WHERE prediction_{tag} = 1 AND late_delivery_risk <> 1) AS false_positives, "
           "CASE WHEN count(*) FILTER (WHERE late_delivery_risk = 1) > 0 THEN "
           "CAST(count(*) FILTER (WHERE prediction_{tag} = 1 AND late_delivery_risk = 1) AS DOUBLE) "
           "/ count(*) FILTER (WHERE late_delivery_risk = 1) ELSE 0.0::DOUBLE END AS recall, "
           "CASE WHEN count(*) FILTER (WHERE prediction_{tag} = 1) > 0 THEN "
           "CAST(count(*) FILTER (WHERE prediction_{tag} = 1 AND late_delivery_risk = 1) AS DOUBLE) "
           "/ count(*) FILTER (WHERE prediction_{tag} = 1) ELSE 0.0::DOUBLE END AS precision, "
           + msum("revenue_at_risk_{tag}") + " AS revenue_flagged, "
           + msum("profit_at_risk_{tag}") + " AS profit_flagged")
_QUEUE = f"order_id, {_P}, revenue, risk_level, recommended_action"

ORACLES.update({
    "g2_join_scores": ctes(**{k: G_CTES[k] for k in ("fx_lines", "orders_t", "scores", "sc", "joined")})
    + "\nSELECT * FROM joined",
    "g4_orphan_scores": ctes(**{k: G_CTES[k] for k in ("fx_lines", "orders_t", "scores", "sc")})
    + f"""
SELECT * FROM (SELECT * FROM sc UNION ALL SELECT * REPLACE ({FX_ABSENT_KEY} AS order_id) FROM sc WHERE {FX_ABSENT_FILTER})
WHERE order_id NOT IN (SELECT order_id FROM orders_t)""",
    "g10_decision_table": ctes(**G_CTES) + "\nSELECT * FROM dec",
    "g11_risk_distribution": ctes(**G_CTES) + """
SELECT level_order, l.risk_level, CAST(coalesce(n, 0) AS BIGINT) AS orders FROM
  (VALUES (1, 'Low'), (2, 'Watch'), (3, 'High'), (4, 'Critical')) l(level_order, risk_level)
  LEFT JOIN (SELECT risk_level, count(*) AS n FROM dec GROUP BY risk_level) c ON l.risk_level = c.risk_level
UNION ALL
SELECT 5, NULL, count(*) FROM dec WHERE risk_level IS NULL HAVING count(*) > 0""",
    "g12_confusion_counts": ctes(**G_CTES) + """
SELECT 0.3::DOUBLE AS threshold, prediction_result_030 AS prediction_result, count(*) AS orders
FROM dec WHERE prediction_result_030 IS NOT NULL GROUP BY 2
UNION ALL
SELECT 0.4::DOUBLE, prediction_result_040, count(*) FROM dec WHERE prediction_result_040 IS NOT NULL GROUP BY 2""",
    "g13_decision_profile": ctes(**G_CTES) + """
SELECT count(*) AS rows_exported, 30 AS columns_exported, min(order_date) AS first_order_date,
  max(order_date) AS last_order_date FROM dec""",
    "h1_headline": ctes(**G_CTES) + "\n" + _threshold_rows(H1_COLS),
    "h2_late_by_mode": ctes(**G_CTES) + """
SELECT shipping_mode, count(*) AS orders,
  CAST(sum(late_delivery_risk) AS DOUBLE) / count(*) AS late_delivery_rate,
  CAST(sum(prediction_030) AS DOUBLE) / count(*) AS flagged_rate_030,
  CAST(sum(prediction_040) AS DOUBLE) / count(*) AS flagged_rate_040
FROM dec GROUP BY shipping_mode""",
    "h3_revenue_flagged_by_region": ctes(**G_CTES) + f"""
SELECT order_region, count(*) AS orders, CAST(sum(prediction_030) AS BIGINT) AS flagged_030,
  CAST(sum(prediction_040) AS BIGINT) AS flagged_040,
  {msum('revenue_at_risk_030')} AS revenue_at_risk_030, {msum('revenue_at_risk_040')} AS revenue_at_risk_040
FROM dec GROUP BY order_region""",
    "h4_review_workload": ctes(**G_CTES) + "\n" + _threshold_rows(H4_COLS),
    "h5_review_queue": ctes(**G_CTES) + f"""
SELECT order_region, {_QUEUE}, CAST(queue_rank AS INTEGER) AS queue_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY order_region ORDER BY {_P} DESC, revenue DESC NULLS LAST,
    order_id ASC) AS queue_rank
  FROM dec WHERE {_P} >= 0.3::DOUBLE) WHERE queue_rank <= 20""",
    "h5_review_queue_overall": ctes(**G_CTES) + f"""
SELECT order_region, {_QUEUE}, CAST(row_number() OVER (ORDER BY {_P} DESC, revenue DESC NULLS LAST,
    order_id ASC) AS INTEGER) AS queue_rank
FROM dec WHERE {_P} >= 0.3::DOUBLE
ORDER BY {_P} DESC, revenue DESC NULLS LAST, order_id ASC LIMIT 50""",
})
