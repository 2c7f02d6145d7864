"""Repeated substrings: every byte covered by a 400-byte string that starts anywhere else.

Blockwise suffix processing with a cover sample. A content-defined cover takes the place
of the arithmetic difference cover: the sample holds, for every 400-byte string, the
position of its smallest 32-byte gram hash. Equal strings hold the sampled position at
the same offset, so two suffixes always meet at a sampled position, and a suffix bucket
is the set of strings around equal sampled grams. Buckets are worked on by Spark one
shuffle partition at a time; long ties are resolved by ranks (64-bit fingerprints)
computed beforehand, in three steps:

1. runs: neighbouring starts that share a sampled position, compared as a whole;
2. cells: 41 neighbouring starts of runs that share a bucket but differ;
3. single starts of cells whose common 360 bytes agree while the whole differs.

Every step first collapses equal members (a partial aggregate), so a passage that many
documents hold is one row per task, and only members that are still undecided go on. A
plain construction would shuffle every suffix (figures in the README).

Defined cases: a null or empty text and one of fewer than 400 bytes lose nothing; repeated
rows are documents of their own and lose all their repeated bytes; null doc ids are kept;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import STEP_BYTES, map_text, mix, prefix_sums, ranges, span_hash, store, text_or_empty

LENGTH, GRAM = 400, 32
#: starts that share a sampled position at most: 369 = 9 cells of 41
REACH = LENGTH - GRAM + 1
CELL = 41
#: positions of a very long text that are worked on at once
PIECE = 4 * STEP_BYTES
_LOW = np.uint64((1 << 24) - 1)


def _smallest_in_window(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(key) - w + 1
    pad = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:len(key)] = key
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def _runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lo, hi, offset of the sample, bucket, fingerprint) of the runs of starts, positions in ``raw``."""
    none = np.zeros(0, np.int64)
    lo, hi = offs[:-1], offs[1:] - LENGTH + 1
    starts = ranges(lo, np.maximum(lo, hi))
    if not len(starts):
        return none, none, none, none, none
    sums = prefix_sums(raw)
    at = np.arange(len(raw) - GRAM + 1)
    gram = span_hash(sums, at, at + GRAM)
    sample = (_smallest_in_window((gram & ~_LOW) | at.astype(np.uint64), REACH) & _LOW).astype(np.int64)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (sample[1:] != sample[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, a = starts[first], starts[last], sample[first]
    return lo, hi, a - lo, gram[a].view(np.int64), span_hash(sums, lo, hi + LENGTH).view(np.int64)


RUNS = pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("off", pa.int64()), ("bucket", pa.int64()), ("same", pa.int64())])


def _list_of_structs(kind: pa.StructType, columns: list[np.ndarray], ends: np.ndarray) -> pa.Array:
    fields = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), fields)


def sample_runs(docs: DataFrame) -> DataFrame:
    """id, k, h, n_bytes, sha (of the whole text) and the runs of every document (id, k, h, t)."""
    def make():
        def work(batch, raw, offs):
            if len(raw) > PIECE and len(offs) == 2:  # a very long text, piece by piece
                parts = []
                for p in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
                    piece = raw[p:p + PIECE + LENGTH - 1]
                    lo, hi, *rest = _runs(piece, np.array([0, len(piece)]))
                    parts.append((lo + p, hi + p, *rest))
                found = [np.concatenate(x) for x in zip(*parts)]
            else:
                found = list(_runs(raw, offs))
            ends = np.searchsorted(found[0], offs)
            doc = np.searchsorted(offs, found[0], "right") - 1
            found[0], found[1] = found[0] - offs[doc], found[1] - offs[doc]
            view = memoryview(np.ascontiguousarray(raw))
            at = offs.tolist()
            sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])]
            return [np.diff(offs), sha, _list_of_structs(RUNS, found, ends)]
        return work
    return map_text(docs, "t", "n_bytes long, sha string, runs array<struct<lo:long,hi:long,off:long,bucket:long,same:long>>", make).drop("t")


CLASS = ["bucket", "off", "len", "same"]


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(spans known to be repeated, members to look into) of one step.

    Rows: k, h, lo, hi, off, bucket, same, n. A class of equal members that counts two or
    more is repeated whole; one member of each class goes on if its bucket holds others.
    """
    rows = rows.withColumn("len", F.col("hi") - F.col("lo"))
    classes = store(rows.groupBy(*CLASS).agg(F.sum("n").alias("n"), F.min(F.struct("k", "h", "lo", "hi")).alias("one")), name)
    twice = classes.where("n > 1").select(*CLASS)
    known = rows.join(twice, CLASS, "left_semi").select("k", "h", "lo", "hi")
    several = classes.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    left = classes.join(several, "bucket", "left_semi").select("one.*", "off", "n")
    return known, left


def _per_text(texts: DataFrame, spans: DataFrame, fields: list[str]) -> DataFrame:
    """Texts with the list of their spans."""
    lists = spans.groupBy("k", "h").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return texts.join(lists.hint("shuffle_hash"), ["k", "h"])


ROWS = ["k long", "h long", "lo long", "hi long", "off long", "bucket long", "same long", "n long"]


def _fingerprints(texts: DataFrame, cells: bool) -> DataFrame:
    """Rows of the next step for the spans (lo, hi, off, n) of texts: cells, or single starts."""
    names = [x.split()[0] for x in ROWS]

    def run(batches):
        for batch in batches:
            for k, h, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                inner = spans.values
                lo, hi, off, n = (np.asarray(inner.field(x)) for x in ("lo", "hi", "off", "n"))
                for s in range(0, len(lo), 4096):
                    out = [np.asarray(x) for x in _span_rows(text.as_buffer(), lo[s:s + 4096], hi[s:s + 4096], off[s:s + 4096], n[s:s + 4096], cells)]
                    size = len(out[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k)), pa.array(np.full(size, h)), *(pa.array(x) for x in out)], names)

    return texts.select("k", "h", "t", "spans").mapInArrow(run, ", ".join(ROWS))


def _span_rows(data, lo, hi, off, n, cells: bool):
    raw = np.frombuffer(data, np.uint8)
    base = int(lo.min())
    sums = prefix_sums(raw[base:int(hi.max()) + LENGTH])
    if not cells:
        p = ranges(lo, hi + 1)
        bucket = span_hash(sums, p - base, p - base + LENGTH).view(np.int64)
        zero = np.zeros(len(p), np.int64)
        return p, p, zero, bucket, zero, np.repeat(n, hi - lo + 1)
    a = lo + off
    c0, c1 = (a - hi) // CELL, (a - lo) // CELL
    c = ranges(c0, c1 + 1)
    i = np.repeat(np.arange(len(lo)), c1 - c0 + 1)
    top = a[i] - CELL * c  # the last start of the cell; its first is CELL - 1 before
    p, q = np.maximum(lo[i], top - CELL + 1), np.minimum(hi[i], top)
    common = span_hash(sums, top - base, top - CELL + 1 + LENGTH - base)
    return (p, q, top - p, mix(common + c.astype(np.uint64)).view(np.int64),
            span_hash(sums, p - base, q + LENGTH - base).view(np.int64), n[i])


def _remove(texts: DataFrame) -> DataFrame:
    """(k, h, n_removed, n_spans, kept): texts without their repeated bytes."""
    def run(batches):
        for batch in batches:
            for k, h, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, np.asarray(spans.values.field("lo")), 1)
                np.add.at(edge, np.asarray(spans.values.field("hi")) + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone].tobytes()
                spans_n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                yield pa.RecordBatch.from_pylist([{"k": k, "h": h, "n_removed": int(gone.sum()), "n_spans": spans_n, "kept": kept}], KEPT)
    return texts.select("k", "h", "t", "spans").mapInArrow(run, "k long, h long, n_removed long, n_spans long, kept binary")


KEPT = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def repeated_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, changed): base figures of every row (doc_id, k, h, n_bytes, sha of the text),
    and for each text that loses bytes (k, h) the counts and the bytes that stay."""
    # k and h name a text; the doc_id alone need not be unique or set
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("t").alias("h"), "t")
    base = store(sample_runs(texts), "runs")
    runs = base.select("k", "h", F.explode("runs").alias("r")).select("k", "h", "r.*", F.lit(1).cast("long").alias("n"))
    known1, left = _settle(runs, "run-classes")
    spans = store(known1.select("k", "h", "lo", "hi", F.lit(0).cast("long").alias("off"), F.lit(0).cast("long").alias("n"))
                  .unionByName(left.select("k", "h", "lo", "hi", "off", "n")), "run-spans")
    shared = store(_per_text(texts.select("k", "h", "t"), spans, ["lo", "hi", "off", "n"]), "shared-texts")
    known = [shared.select("k", "h", F.explode(F.filter("spans", lambda x: x["n"] == 0)).alias("s")).select("k", "h", "s.lo", "s.hi")]
    open_runs = shared.withColumn("spans", F.filter("spans", lambda x: x["n"] > 0)).where(F.size("spans") > 0)
    cells = store(_fingerprints(open_runs, True), "cells")
    known2, left = _settle(cells, "cell-classes")
    known.append(known2)
    only = shared.select("k", "h", "t")
    starts = store(_fingerprints(_per_text(only, left, ["lo", "hi", "off", "n"]), False).select("k", "h", "lo", "bucket", "n"), "starts")
    twice = starts.groupBy("bucket").agg(F.sum("n").alias("c")).where("c > 1").select("bucket")
    known.append(starts.join(twice, "bucket", "left_semi").select("k", "h", "lo", F.col("lo").alias("hi")))
    repeated = known[0].unionByName(known[1]).unionByName(known[2])
    changed = _remove(_per_text(only.dropDuplicates(["k", "h"]), repeated, ["lo", "hi"]))
    return base.drop("runs"), changed
