"""Late-delivery classifiers on Spark ML.

Imputation values are fitted exactly on the training side
(``features.fit_medians`` / ``fit_modes``); encoders, scaler and classifiers
are ``pyspark.ml`` stages fitted on the training side only and applied to
the test side. Every fit is a series of distributed jobs over the cached
training table.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil, inf, isqrt, nextafter

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.evaluate import score_buckets
from orderlens.operators.features import LABEL, feature_frame, fit_medians, fit_modes, impute, route_columns

# Model names and hyper-parameters of the reference's four models.
BASELINE = "Dummy Baseline"
LOGISTIC = "Logistic Regression"
FOREST = "Random Forest"
BOOSTING = "HistGradientBoosting"
LOGISTIC_MAX_ITER = 1000
LOGISTIC_TOL = 1e-4  # the reference library's default stopping tolerance
FOREST_TREES, FOREST_DEPTH, FOREST_MIN_LEAF, FOREST_SEED = 300, 15, 5, 42
# the reference library's early stop of boosting: above so many rows, on such a share held
# out, after so many rounds that improve the loss by no more than the tolerance
EARLY_STOP_ROWS, VALIDATION_SHARE, PATIENCE, STOP_TOL = 10_000, 0.1, 10, 1e-7
BOOSTING_ROUNDS, BOOSTING_RATE, BOOSTING_DEPTH, BOOSTING_BINS, BOOSTING_SEED = 200, 0.08, 5, 255, 42
WEIGHT, HELD_OUT, VECTOR = "__w", "__held_out", "features"
#: split points per feature of the forest: every node of 300 trees keeps counts for each
FOREST_BINS = 32
#: rows of the tree models' table in one partition at least (each sends the counts of all open nodes);
#: beyond so many partitions of that size they hold more rows, up to so many (300 trees' counts: 1.2 KB a row)
ROWS_A_PARTITION, SMALL_PARTITIONS, ROWS_AT_MOST = 2_500, 20, 250_000
#: rows up to which Spark takes split points from all rows (or up to the square of its maxBins,
#: whose root must stay in 32 bits); beyond, from a sample of so many
SPLIT_ROWS, MOST_BINS = 10_000, 46_340


@dataclass
class TreeInput:
    """The table that both tree models are fitted on (numbers and codes, label, weight, held-out
    mark), and what gives other rows the same columns."""
    table: DataFrame
    rows: int
    columns: list[str]
    encode: object  # DataFrame -> DataFrame with the columns


@dataclass
class Prepared:
    """Training and test sides imputed with training statistics."""
    train: DataFrame
    test: DataFrame
    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    trees: TreeInput | None = None

    def persist(self) -> Prepared:
        self.train, self.test = (df.persist(StorageLevel.MEMORY_AND_DISK) for df in (self.train, self.test))
        return self

    def release(self) -> None:
        for df in (self.train, self.test, *([self.trees.table] if self.trees else [])):
            df.unpersist()


def prepare(train: DataFrame, test: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> Prepared:
    """The model columns (and ``keep`` on the test side), routed by type, with medians
    and modes fitted on train imputed on both sides."""
    train, test = feature_frame(train, features), feature_frame(test, features, keep)
    numeric, categorical = route_columns(train, features)
    medians, modes = fit_medians(train, numeric), fit_modes(train, categorical)
    return Prepared(impute(train, medians, modes), impute(test, medians, modes),
                    numeric, categorical, medians, modes)


def with_balanced_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """``class_weight='balanced'``: w = n / (2 · n_class), from one small count."""
    counts = {r[label]: r["n"] for r in
              train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(counts.values()), len(counts)
    w = None
    for cls, c in counts.items():
        w = (F.when(F.col(label) == cls, F.lit(n / (k * c))) if w is None
             else w.when(F.col(label) == cls, F.lit(n / (k * c))))
    return train.withColumn(WEIGHT, w)


def _indexers(categorical: Sequence[str]) -> StringIndexer:
    # alphabetical codes as the reference's encoders; unseen or missing → extra index
    return StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__idx" for c in categorical],
                         handleInvalid="keep", stringOrderType="alphabetAsc")


def linear_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Scaled numerics + one-hot categoricals (unknown → all zeros)."""
    return [
        VectorAssembler(inputCols=list(numeric), outputCol="__num"),
        StandardScaler(inputCol="__num", outputCol="__num_scaled", withMean=True, withStd=True),
        _indexers(categorical),
        OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                      outputCols=[f"{c}__ohe" for c in categorical],
                      dropLast=True),  # the last index is the unknown value
        VectorAssembler(inputCols=["__num_scaled", *[f"{c}__ohe" for c in categorical]],
                        outputCol="features"),
    ]


def scaler_table(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """F10 as a table: the mean and (sample) deviation that the scaler takes from the training side."""
    vectors = VectorAssembler(inputCols=list(numeric), outputCol="__num").transform(train)
    fitted = StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True, withStd=True).fit(vectors)
    return train.sparkSession.createDataFrame(
        [(c, float(m), float(s)) for c, m, s in zip(numeric, fitted.mean, fitted.std)], "feature string, mean double, stddev double")


def fit_ordinal(train: DataFrame, categorical: Sequence[str]):
    """F12 as a fitted stage: alphabetical codes, unknown → -1."""
    model = _indexers(categorical).fit(train)
    sizes = dict(zip(categorical, (len(labels) for labels in model.labelsArray)))

    def apply(df: DataFrame) -> DataFrame:
        coded = model.transform(df)
        return coded.withColumns({
            f"{c}__code": F.when(F.col(f"{c}__idx") == sizes[c], F.lit(-1.0))
            .otherwise(F.col(f"{c}__idx")) for c in categorical})
    return apply


@dataclass
class Fitted:
    name: str
    seconds: float
    transform: object  # DataFrame -> DataFrame with late_delivery_probability
    rounds: int | None = None  # trees in use, where the fit chooses their number


def _probability(df: DataFrame) -> DataFrame:
    return df.withColumn("late_delivery_probability", vector_to_array("probability")[1])


def fit_baseline(prep: Prepared) -> Fitted:
    """class prior as the probability of every test order."""
    t0 = time.perf_counter()
    prior = float(prep.train.agg(F.avg(F.col(LABEL).cast("double"))).first()[0])
    secs = time.perf_counter() - t0
    return Fitted(BASELINE, secs,
                  lambda df: df.withColumn("late_delivery_probability", F.lit(prior)))


def fit_logistic(prep: Prepared, max_iter: int = LOGISTIC_MAX_ITER, tol: float = LOGISTIC_TOL) -> Fitted:
    """F16: L2 logistic regression with balanced class weights. ``regParam=1/n``
    with weights summing to n is the reference library's C = 1."""
    t0 = time.perf_counter()
    train = with_balanced_weights(prep.train)
    n = prep.train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol=WEIGHT,
                            maxIter=max_iter, tol=tol, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, family="binomial")
    model: PipelineModel = Pipeline(stages=[*linear_stages(prep.numeric, prep.categorical), lr]) \
        .fit(train)
    secs = time.perf_counter() - t0
    return Fitted(LOGISTIC, secs, lambda df: _probability(model.transform(df)))


def tree_input(prep: Prepared, fit_rows: int | None = None) -> TreeInput:
    """F12-F13 for both tree models, made once: ordinal codes beside the numbers, class weights,
    and the tenth held out where boosting stops early, of all training rows. A caller that
    wants a trial fit names ``fit_rows``, about as many rows picked by a hash of the order id."""
    if prep.trees is None:
        encode = fit_ordinal(prep.train, prep.categorical)
        columns = [*prep.numeric, *[f"{c}__code" for c in prep.categorical]]
        n, steps = prep.train.count(), 1_000_003
        rows = n if fit_rows is None else min(n, fit_rows)
        picked = prep.train if rows == n else prep.train.filter(
            F.pmod(F.xxhash64("order_id"), F.lit(steps)) < int(steps * rows / n))
        held_out = F.lit(False) if rows <= EARLY_STOP_ROWS else \
            F.pmod(F.xxhash64("order_id", F.lit("held out")), F.lit(steps)) < int(steps * VALIDATION_SHARE)
        table = (encode(with_balanced_weights(picked)).withColumn(HELD_OUT, held_out)
                 .repartition(tree_partitions(rows, prep.train.sparkSession.sparkContext.defaultParallelism), "order_id")
                 .sortWithinPartitions("order_id")
                 .select(*columns, LABEL, WEIGHT, HELD_OUT).persist(StorageLevel.MEMORY_AND_DISK))
        prep.trees = TreeInput(table, rows, columns, encode)
    return prep.trees


def tree_partitions(rows: int, parallel: int) -> int:
    """Partitions of the tree models' table: few, as each sends the counts of every open node,
    and more only where one would hold too many rows."""
    share = min(max(ROWS_A_PARTITION, rows / SMALL_PARTITIONS), ROWS_AT_MOST)
    return max(1, min(parallel, ceil(rows / share)))


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Upper edges of ``bins`` bins of about equally many rows, for each column with more distinct
    values than that: the values at which the running count of all rows reaches a multiple of
    n / ``bins``, the largest value left out. Exact: a sketch only places the ranges in which the
    running counts are made."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("p")) for c in columns])).alias("v")).select("v.*")
    counts = stacked.groupBy("feature", "p").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        wide = [r["feature"] for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values")).collect()
                if r["values"] > bins]
        if not wide:
            return {}
        placed = score_buckets(counts.where(F.col("feature").isin(wide)), "feature")
        of_feature = Window.partitionBy("feature")
        ranges = placed.groupBy("feature", "b").agg(F.sum("n").alias("size")).select(
            "feature", "b", (F.sum("size").over(of_feature.orderBy("b")) - F.col("size")).alias("before"),
            F.sum("size").over(of_feature).alias("rows"))
        inside = F.sum("n").over(Window.partitionBy("feature", "b").orderBy("p"))
        running = placed.withColumn("inside", inside).join(ranges, ["feature", "b"]) \
            .withColumn("upto", F.col("before") + F.col("inside"))
        reached = F.expr(f"upto * {bins} div rows > (upto - n) * {bins} div rows and upto < rows")
        found = running.where(reached).select("feature", "p").collect()
    finally:
        counts.unpersist()
    return {c: sorted(r["p"] for r in found if r["feature"] == c) for c in columns if c in wide}


def tree_vectors(made: TreeInput, table: DataFrame, rows: int, bins: int) -> tuple:
    """F13 for one tree model: what adds the vector to rows with ``made.columns``, and the ``maxBins``
    of its fit on ``table``. Spark takes a tree's split points from a sample where the table has
    more rows than 10,000 and the square of ``maxBins``. There, columns of many values are replaced by the
    number of their bin of all rows (:func:`bin_edges`), and ``maxBins`` is the root of the rows, so
    that Spark samples nothing; no column has more than ``bins`` values then, so there are no more split points."""
    if rows <= max(SPLIT_ROWS, bins ** 2):
        edges = {}
    else:
        edges, bins = bin_edges(table, made.columns, bins), min(MOST_BINS, max(bins, isqrt(rows) + 1))
    # a value up to an edge lies left of it; Bucketizer's ranges start at their lower bound
    bucketizer = Bucketizer(inputCols=list(edges), outputCols=[f"{c}__bin" for c in edges], splitsArray=[
        sorted({-inf, inf, *(nextafter(x, inf) for x in xs)}) for xs in edges.values()]) if edges else None
    assembler = VectorAssembler(inputCols=[f"{c}__bin" if c in edges else c for c in made.columns], outputCol=VECTOR)

    def vectors(df: DataFrame) -> DataFrame:
        if edges:
            df = bucketizer.transform(df)
            for c in edges:  # bins are numbers in order: trees would take the attribute's values for categories
                df = df.withMetadata(f"{c}__bin", {})
        return assembler.transform(df)
    return vectors, bins


def _tree_fit(prep: Prepared, fit, name: str) -> Fitted:
    made = tree_input(prep)
    t0 = time.perf_counter()
    model, vectors = fit(made)
    secs = time.perf_counter() - t0
    return Fitted(name, secs, lambda df: _probability(model.transform(vectors(made.encode(df)))), model.getNumTrees)


def fit_forest(prep: Prepared, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH,
               bins: int = FOREST_BINS) -> Fitted:
    """random forest, balanced class weights, sqrt features per split, fitted on all training
    rows; ``bins`` bounds the split points per feature."""
    def fit(made: TreeInput) -> tuple:
        vectors, most = tree_vectors(made, made.table, made.rows, bins)
        rf = RandomForestClassifier(featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT,
                                    numTrees=trees, maxDepth=depth, minInstancesPerNode=FOREST_MIN_LEAF,
                                    featureSubsetStrategy="sqrt", bootstrap=True, seed=FOREST_SEED,
                                    maxBins=most, maxMemoryInMB=512)
        return rf.fit(vectors(made.table)), vectors

    return _tree_fit(prep, fit, FOREST)


def stop_round(losses: Sequence[float], patience: int = PATIENCE, tol: float = STOP_TOL) -> int | None:
    """The 1-based round after which boosting stops: the first whose last ``patience`` losses
    all fail to beat the one before them by more than ``tol``; None if it goes on."""
    for t in range(patience, len(losses)):
        if min(losses[t - patience + 1:t + 1]) >= losses[t - patience] - tol:
            return t + 1
    return None


def fit_boosting(prep: Prepared, rounds: int = BOOSTING_ROUNDS) -> Fitted:
    """gradient-boosted trees (depth 5 ≤ 32 leaves, 255 bins, rate 0.08).
    The reference grows leaf-wise trees; Spark grows them depth-wise. A leaf holds at
    least 20 rows, the reference library's default. Above ``EARLY_STOP_ROWS`` rows a tenth
    is held out and rounds end by the library's rule (:func:`stop_round`). Spark's fit
    cannot go on from earlier trees, so it is repeated with twice the rounds until the rule
    or ``rounds`` ends it, and once more with the rounds found; equal seeds give equal
    trees. ``Fitted.rounds`` tells how many are in use."""
    def fit(made: TreeInput) -> tuple:
        early = made.rows > EARLY_STOP_ROWS
        rest = made.table.filter(~F.col(HELD_OUT)) if early else made.table
        vectors, most = tree_vectors(made, rest, rest.count(), BOOSTING_BINS)
        fitted, held_out = vectors(rest), vectors(made.table.filter(HELD_OUT))

        def boost(n: int):
            return GBTClassifier(featuresCol=VECTOR, labelCol=LABEL, maxIter=n, stepSize=BOOSTING_RATE,
                                 maxDepth=BOOSTING_DEPTH, maxBins=most, seed=BOOSTING_SEED,
                                 minInstancesPerNode=20, maxMemoryInMB=512).fit(fitted)

        if not early:
            return boost(rounds), vectors
        n = min(rounds, PATIENCE + 2)
        while True:
            model = boost(n)
            stop = stop_round(model.evaluateEachIteration(held_out))
            if stop is not None or n == rounds:
                return model if stop in (None, n) else boost(stop), vectors
            n = min(rounds, 2 * n)

    return _tree_fit(prep, fit, BOOSTING)


def score(fitted: Fitted, test: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """long-form scores ``(model, order_id, label, probability, keep...)``."""
    out = fitted.transform(test)
    return out.select(F.lit(fitted.name).alias("model"), "order_id", LABEL,
                      F.col("late_delivery_probability").cast("double"), *keep)
