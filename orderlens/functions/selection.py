"""Exact k-th smallest values without a global sort.

A global ``row_number()`` or an exact ``percentile`` puts every row of a table into one
task. Here a bracket is found first, cheaply and mergeably, then one wide counting pass
tells how many values lie below and inside it, and only the values inside, few by then,
are ranked.

* Numbers (:func:`kth_values`): ``percentile_approx`` sketches of all columns in one
  aggregate give the brackets. Three jobs, whatever the number of columns; a bracket that
  still holds more than ``INSIDE`` rows is narrowed by a sketch of its inside.
* Composite keys of any orderable types (:func:`kth_key`): the bracket comes from a sorted
  sample of at most about ``SAMPLE`` rows.

Sketch and sample only place the bracket. The counting pass checks that the rank lies
inside, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.columns import nan_to_null

#: rows of a bracket that are ranked in one window
INSIDE = 1 << 20
#: columns shorter than this are their own bracket
SMALL = 1 << 16
#: percentiles that a sketch is asked for, and its accuracy (rank error: one in so many)
GRID, ACCURACY = 1000, 10_000
#: rows of the sample that brackets a composite key, about
SAMPLE = 1 << 19

Ranks = Callable[[int], Sequence[int]]


def _within(x: Column, low, high) -> Column:
    inside = x.isNotNull()
    if low is not None:
        inside = inside & (x >= F.lit(low))
    if high is not None:
        inside = inside & (x <= F.lit(high))
    return inside


class _Bracket:
    """What is known of one column: bounds (None: none), values below them, values inside, wanted ranks."""

    def __init__(self):
        self.low = self.high = None
        self.below, self.inside = 0, None
        self.ranks: list[int] = []

    def tighter(self, grid: list) -> tuple:
        """Bounds two percentiles (several times the sketch's error) beside the wanted ranks."""
        first, last = (GRID * (r - self.below) / self.inside for r in (self.ranks[0], self.ranks[-1]))
        return grid[max(0, int(first) - 2)], grid[min(GRID, ceil(last) + 2)]


def kth_values(df: DataFrame, values: Mapping[str, Column], ranks: Ranks, integral: bool = False) -> dict[str, list]:
    """``{name: [value at each rank]}`` of the non-missing values of each named expression.

    ``ranks(n)`` gives the 1-based ranks wanted of n values, in rising order. Integral columns
    are compared as longs, all others as doubles, where NaN is missing. A column without
    values, or a rank beyond n, gives an empty list."""
    x = {n: c.cast("long") if integral else nan_to_null(c.cast("double")) for n, c in values.items()}
    state = {n: _Bracket() for n in x}
    asked = F.expr("array(" + ", ".join(f"{i / GRID}D" for i in range(GRID + 1)) + ")")
    open_names = list(x)
    while open_names:
        at = {n: _within(x[n], state[n].low, state[n].high) for n in open_names}
        got = df.agg(*[F.count_if(at[n]).alias(f"n{i}") for i, n in enumerate(open_names)],
                     *[F.percentile_approx(F.when(at[n], x[n]), asked, F.lit(ACCURACY)).alias(f"p{i}")
                       for i, n in enumerate(open_names)]).first()
        trial = {}
        for i, n in enumerate(open_names):
            s = state[n]
            if s.inside is None:
                s.inside = got[f"n{i}"]
                s.ranks = [r for r in ranks(s.inside) if 1 <= r <= s.inside] if s.inside else []
            if s.ranks and s.inside > SMALL:
                trial[n] = s.tighter(got[f"p{i}"])
        # the counting pass: all brackets at once, no row is multiplied
        counted = df.agg(*[c for i, (n, (low, high)) in enumerate(trial.items()) for c in (
            F.count_if(x[n] < F.lit(low)).alias(f"b{i}"), F.count_if(_within(x[n], low, high)).alias(f"n{i}"))]).first() \
            if trial else None
        open_names = []
        for i, (n, (low, high)) in enumerate(trial.items()):
            s, below, inside = state[n], counted[f"b{i}"], counted[f"n{i}"]
            if below < s.ranks[0] and s.ranks[-1] <= below + inside:
                shrunk = inside <= s.inside // 2
                s.low, s.high, s.below, s.inside = low, high, below, inside
                if inside > INSIDE and low != high and shrunk:
                    open_names.append(n)
    return _ranked(df, x, state)


def _ranked(df: DataFrame, x: Mapping[str, Column], state: Mapping[str, _Bracket]) -> dict[str, list]:
    """The values at the wanted ranks, from the distinct values inside each bracket."""
    out: dict[str, list] = {n: [] for n in x}
    wide = [n for n in x if state[n].ranks and state[n].low is not None and state[n].low == state[n].high]
    for n in wide:
        out[n] = [state[n].low] * len(state[n].ranks)
    names = [n for n in x if state[n].ranks and n not in wide]
    if not names:
        return out
    rows = F.array(*[F.when(_within(x[n], state[n].low, state[n].high), F.struct(F.lit(i).alias("i"), x[n].alias("x")))
                     for i, n in enumerate(names)])
    found = df.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
    counts = found.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.lit(False)
    for i, n in enumerate(names):
        for r in state[n].ranks:
            r -= state[n].below
            wanted = wanted | ((F.col("i") == i) & (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r))
    picked = counts.withColumn("upto", upto).where(wanted).select("i", "x", "upto").collect()
    for i, n in enumerate(names):
        own = sorted((r["upto"], r["x"]) for r in picked if r["i"] == i)
        out[n] = [next(v for upto, v in own if upto >= r - state[n].below) for r in state[n].ranks]
    return out


def kth_smallest(df: DataFrame, values: Mapping[str, Column], ranks: Mapping[str, int],
                 integral: bool = False) -> dict[str, object]:
    """``{name: k-th smallest non-missing value}``, ``ranks[name]`` 1-based; None where there are fewer."""
    groups: dict[int, list[str]] = {}
    for n in values:
        groups.setdefault(int(ranks[n]), []).append(n)
    out: dict[str, object] = {}
    for k, names in groups.items():
        got = kth_values(df, {n: values[n] for n in names}, lambda n, k=k: [k], integral)
        out.update({n: v[0] if v else None for n, v in got.items()})
    return out


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column, all columns together: the mean of the two middle values for
    even counts, missing ignored, as NumPy's ``nanmedian`` gives."""
    got = kth_values(df, {c: F.col(c) for c in columns}, lambda n: [(n + 1) // 2, n // 2 + 1])
    return {c: (float(v[0]) if v[0] == v[-1] else (float(v[0]) + float(v[-1])) / 2.0) if v else None
            for c, v in got.items()}


# ---- composite keys ---------------------------------------------------------------------

def literal_key(df: DataFrame, keys: Sequence[Column], bound: Sequence[object]) -> Column:
    """``bound`` as a struct of the same types as ``keys``, for comparisons with ``F.struct(*keys)``."""
    types = [f.dataType for f in df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema.fields]
    return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(bound, types))])


def key_struct(keys: Sequence[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def kth_key(df: DataFrame, keys: Sequence[Column], k: int) -> list[object]:
    """The k-th smallest composite key (1-based, lexicographic, missing parts first).

    The key's parts may be of any orderable types. A row's key should be unique, or nearly: many
    copies of one key still give the right result, but are grouped in one pass of their own."""
    rows = df.select(key_struct(keys).alias("key"))
    low = high = None
    below, inside = 0, rows.count()
    if not 1 <= k <= inside:
        raise ValueError(f"rank {k} of {inside} rows")

    def bounded(low, high) -> DataFrame:
        cond = F.lit(True)
        if low is not None:
            cond = cond & (F.col("key") >= literal_key(df, keys, low))
        if high is not None:
            cond = cond & (F.col("key") <= literal_key(df, keys, high))
        return rows.where(cond)

    while inside > INSIDE:
        held = bounded(low, high)
        every = ceil(inside / SAMPLE)
        sample = held.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0)
        place = F.row_number().over(Window.orderBy("key"))  # a sample of bounded size
        placed = sample.withColumn("place", place).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))
        share = (k - below) / inside
        near, reach = F.col("size") * share, 4 * sqrt(SAMPLE) + 1
        got = placed.where((F.col("place") == F.floor(near - reach)) | (F.col("place") == F.ceil(near + reach))) \
            .select("key", (F.col("place") < near).alias("lower")).collect()
        new_low = next((list(r["key"]) for r in got if r["lower"]), low)
        new_high = next((list(r["key"]) for r in got if not r["lower"]), high)
        if (new_low, new_high) == (low, high):
            break
        less = F.lit(False) if new_low is None else F.col("key") < literal_key(df, keys, new_low)
        over = F.lit(False) if new_high is None else F.col("key") > literal_key(df, keys, new_high)
        c = rows.agg(F.count_if(less).alias("b"), F.count_if(over).alias("a"), F.count(F.lit(1)).alias("n")).first()
        if not c["b"] < k <= c["n"] - c["a"]:
            break
        shrunk = c["n"] - c["a"] - c["b"] <= inside // 2
        low, high, below, inside = new_low, new_high, c["b"], c["n"] - c["a"] - c["b"]
        if low == high:
            return low
        if not shrunk:
            break
    counts = bounded(low, high).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where((F.col("upto") >= k - below) & (F.col("upto") - F.col("n") < k - below)).first()
    return list(found["key"])
