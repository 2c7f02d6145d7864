"""Helpers shared by the training-data operators: tables in the shared folder and
numpy work on whole Arrow text columns inside Spark tasks."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: bytes of text that one numpy step works on (a longer single text is a step of its own)
STEP_BYTES = 1 << 20
#: texts in one such step at most
STEP_TEXTS = 4096
#: code points of the ASCII white space that separates words: space, \t, \n, \v, \f, \r
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests) it becomes a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove a query's shuffle files when it ends, for queries made and run to their end inside."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Remove a stored table that no later plan reads."""
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/llm-" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------------- numpy on text columns

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    raw, offs = utf8(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = min(i + STEP_TEXTS, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def string_array(raw: np.ndarray, offs: np.ndarray) -> pa.Array:
    """The texts of a step (see :func:`steps`) as an Arrow string column, without a copy of their bytes."""
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))


def byte_class(word_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(word_bytes)] = True
    return out


#: ``[^\x20\x09-\x0D]+`` on UTF-8 bytes
NOT_WHITE = byte_class(set(range(256)) - {0x20, 9, 10, 11, 12, 13})
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOL = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums, wrapping at 2^64, from which :func:`span_hash` takes any substring's hash."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SYMBOL[raw] * _powers(len(raw))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end): equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def words(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document) of the words of documents that lie end to end in ``raw``."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    here, before = inside[1:] == 1, inside[:-1] == 1
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    return start, end, np.searchsorted(start, offs)


def word_hashes(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool = True):
    """(hash, start, end, first) of all words; ``raw`` is lower-cased first where asked."""
    raw = LOWER[raw] if lower else raw
    start, end, first = words(raw, offs, kind)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # blocks, so that a very long text needs no sums over all of it at once
        j = max(i + 1, int(np.searchsorted(end, start[i] + 4 * STEP_BYTES, "right")))
        base = start[i]
        sums = prefix_sums(raw[base:end[j - 1]])
        out[i:j] = span_hash(sums, start[i:j] - base, end[i:j] - base)
        i = j
    return out, start, end, first


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (length len(h) - k + 1; empty if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += h[j:j + n]
    return mix(out)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges [lo, hi), one after another."""
    size = hi - lo
    if not len(lo) or not size.sum():
        return np.zeros(0, np.int64)
    out = np.ones(int(size.sum()), np.int64)
    keep = size > 0
    lo, size = lo[keep], size[keep]
    at = np.cumsum(size) - size
    out[at] = lo - np.concatenate([[0], lo[:-1] + size[:-1] - 1])
    out[0] = lo[0]
    return np.cumsum(out)


def in_process(key: tuple, build):
    """An object that the tasks of one Python worker share, built by the first of them.

    Only caches belong here: a task must give the same rows whether it finds one or not.
    """
    held = sys.modules.setdefault("_orderlens_task_objects", types.ModuleType("_orderlens_task_objects")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def give_back() -> None:
    """Return unused memory to the system: a worker that Spark reuses must not keep the peak of every task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_text(df: DataFrame, text: str, new_fields: str, make) -> DataFrame:
    """Append columns computed from whole texts, batch by batch, in bounded memory.

    ``make()`` runs once per task and returns ``work(batch, raw, offsets)``, which returns
    one Arrow array per field of ``new_fields`` (a DDL string) for the batch's rows.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(new_fields).fields])
    new_types = [f.type for f in to_arrow_schema(T.StructType.fromDDL(new_fields))]
    k = names.index(text)

    def run(batches):
        work = make()
        for batch in batches:
            for i, j, raw, offs in steps(batch.column(k)):
                part = batch.slice(i, j - i)
                new = [a if isinstance(a, pa.Array) else pa.array(a, t)
                       for a, t in zip(work(part, raw, offs), new_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.names)
        give_back()

    return df.mapInArrow(run, schema)
