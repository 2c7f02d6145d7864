"""Scans and sinks (A1, A2, A5).

Text input is read with a fixed schema (all strings unless one is given), so
no inference pass runs over the data; types are then coerced column-wise
with ``try_cast`` by ``operators.clean``. ``infer_types=True`` gives numbers
their types as the reference's reader does, by one aggregate over the text.
Parquet is the format between stages; CSV only at the edges. Tables that
later stages join by one key can be written bucketed by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from orderlens.functions.columns import clean_text, nan_to_null, text_to_double
from orderlens.session import ensure_checkpoint_dir, keep_methods_compiled

# The text tokens pandas' CSV reader reads as missing by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def _load(reader, path: str, fmt: str) -> DataFrame:
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as exc:  # A2: missing-input guard
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"input not found: {path}") from exc
        raise


def read_lines(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "csv", header: bool = True, infer_types: bool = False) -> DataFrame:
    """A1: read an order-line table. CSV is read with a header and a fixed
    schema, or as text columns when none is given; ``infer_types`` then types
    the columns that hold numbers only (see ``infer_numbers``)."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", header).option("multiLine", False)
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", False)
    elif schema is not None:
        reader = reader.schema(schema)
    df = _load(reader, path, fmt)
    return infer_numbers(df) if infer_types else df


def infer_numbers(df: DataFrame, na_tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """Type text columns by what they hold, missing tokens and blanks left out: whole numbers
    become longs, other numbers doubles, anything else stays text, and so does a column
    without values. One aggregate over all text columns; two counts each reach the driver."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    keep_methods_compiled(df.sparkSession)  # dozens of texts cleaned and typed in one projection
    value = {c: clean_text(F.col(f"`{c}`"), na_tokens) for c in texts}
    # the values are projected first, so the three counts of a column share one cleaning
    got = df.select(*[v.alias(f"v{i}") for i, v in enumerate(value.values())]).agg(*[e for i in range(len(texts)) for e in (
        F.count(f"v{i}").alias(f"n{i}"), F.count(text_to_double(f"v{i}")).alias(f"d{i}"),
        F.count_if(F.col(f"v{i}").rlike(r"^[+-]?[0-9]+$") & F.col(f"v{i}").try_cast("long").isNotNull()).alias(f"l{i}"))]).first()
    typed = {}
    for i, c in enumerate(texts):
        n = got[f"n{i}"]
        if n and got[f"l{i}"] == n:
            typed[c] = value[c].try_cast("long")
        elif n and got[f"d{i}"] == n:
            typed[c] = nan_to_null(value[c].try_cast("double"))
    return df.select(*[typed[c].alias(c) if c in typed else F.col(f"`{c}`") for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _load(spark.read, path, fmt)


def load_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def input_signature(spark: SparkSession, paths: Sequence[str]) -> str:
    """One text that changes when any file under ``paths`` changes: name, size or time of change.
    Spark lists the files; their contents are not read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    marks = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                      F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).cast("string").alias("mark")).first()
    return f"{marks['n']}_{marks['bytes']}_{marks['mark']}".replace("-", "m")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int | None = None,
                   partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table of the session's catalog, bucketed and sorted by ``key``, into the shared
    checkpoint folder, and read it back. Tables with one key and as many buckets join without
    an exchange, and a reader takes only the columns it needs. ``df`` should already be
    partitioned by ``key``; the default is a bucket for each of the session's shuffle
    partitions, so that every task writes whole buckets."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = (df.write.mode("overwrite").format("parquet").option("path", f"{ensure_checkpoint_dir(spark)}/{table}")
              .bucketBy(buckets, key).sortBy(key))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    return spark.table(table)


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared checkpoint folder and read it back.
    A reader takes the columns it needs, in batches; of a checkpoint every pass takes whole rows
    out of Java objects, one by one, which cost more than computing them."""
    spark = df.sparkSession
    path = write_table(df, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", partition_by=partition_by or None)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def drop_path(spark: SparkSession, at: str) -> None:
    """Remove a folder that a job of this session wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """A5: overwrite a table; Parquet by default, CSV with a header on request."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path
