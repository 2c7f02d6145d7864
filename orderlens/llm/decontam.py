"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words and a block is two words. For every length class of test strings
a shift table, indexed by the block's hash, tells how far a search may jump: positions
whose block ends no test string are skipped. Where the shift is zero, the suffix-hash
bucket (last block, then first block) selects test strings, and a direct comparison of
the words' bytes confirms the occurrence. Many cursors advance at once in numpy.

Test strings are broadcast in slices of at most :data:`SLICE` windows; a larger benchmark
takes further passes over the documents, never a larger broadcast.

Defined cases: null and empty texts have no words and no hits; an item without words has
no window; items that share an id count once; repeated documents are searched each for
itself; input columns pass through inside ``doc``; an empty benchmark hits nothing.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import ALNUM, LOWER, lower_ascii, map_text, mix, text_or_empty, word_hashes

WINDOW = 10
#: test strings that one pass broadcasts at most (about 100 bytes each)
SLICE = 200_000
#: words that one cursor searches
STRETCH = 256
TABLE = 1 << 16


def windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", k: int = WINDOW) -> DataFrame:
    """(item, window): every k consecutive words of an item; a shorter item is one window."""
    found = F.regexp_extract_all(lower_ascii(text_or_empty(text)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    w = benchmark.select(F.col(item).cast("string").alias("item"), found.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1)))
    return (w.select("item", "w", F.explode(starts).alias("i"))
            .select("item", F.array_join(F.slice("w", F.col("i"), k), " ").alias("window")).distinct())


def _blocks(h: np.ndarray, b: int) -> np.ndarray:
    """Hash of the block that ends at each word (for the first b - 1 words: of no use)."""
    if b == 1:
        return mix(h)
    out = h.copy()
    out[1:] += mix(h[:-1])
    return mix(out)


class WuManber:
    """Shift tables and suffix buckets of test strings that all have ``m`` words."""

    def __init__(self, m: int, strings: list[bytes]):
        self.m, self.b, self.strings = m, min(2, m), strings
        raw = np.frombuffer(b" ".join(strings), np.uint8)
        h = word_hashes(raw, np.array([0, len(raw)]), ALNUM)[0].reshape(len(strings), m)
        self.shift = np.full(TABLE, m - self.b + 1, np.int64)
        blocks = np.stack([_blocks(row, self.b) for row in h])
        for j in range(m - 1, self.b - 2, -1):
            np.minimum.at(self.shift, blocks[:, j] & np.uint64(TABLE - 1), m - 1 - j)
        self.keys = self.key(blocks[:, m - 1], blocks[:, self.b - 1])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.order = self.keys[order], order

    @staticmethod
    def key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return mix(last + mix(first))

    def search(self, h: np.ndarray, first: np.ndarray, same) -> list[tuple[int, int]]:
        """(string, last word) of all occurrences; ``same(string, start, end)`` compares directly."""
        blocks = _blocks(h, self.b)
        size = np.diff(first)
        per = np.maximum(0, -(-(size - self.m + 1) // STRETCH))
        doc = np.repeat(np.arange(len(size)), per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        at = first[doc] + self.m - 1 + k * STRETCH
        end = np.minimum(at + STRETCH, first[doc + 1])
        stops = []
        while len(at):
            jump = self.shift[blocks[at] & np.uint64(TABLE - 1)]
            stops.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < end
            at, end = at[on], end[on]
        if not stops:
            return []
        stop = np.concatenate(stops)
        keys = self.key(blocks[stop], blocks[stop - self.m + self.b])
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = []
        for p, a, b in zip(stop[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            out += [(s, p) for s in self.order[a:b].tolist() if same(self.strings[s], p - self.m + 1, p + 1)]
        return out


def _pass(df: DataFrame, rows: list[tuple[str, list[str]]]) -> DataFrame:
    """Search one slice of test strings; append to the spans and items found by earlier passes."""
    by_size: dict[int, list[tuple[bytes, list[str]]]] = {}
    for window, items in rows:
        by_size.setdefault(window.count(" ") + 1, []).append((window.encode("utf-8"), items))
    shared = df.sparkSession.sparkContext.broadcast(by_size)
    held = df.columns

    def make():
        engines = [(WuManber(m, [s for s, _ in found]), [i for _, i in found]) for m, found in sorted(shared.value.items())]

        def work(batch, raw, offs):
            h, start, end, first = word_hashes(raw, offs, ALNUM)
            low = LOWER[raw].tobytes()

            def same(string: bytes, a: int, b: int) -> bool:
                return string == b" ".join(low[start[i]:end[i]] for i in range(a, b))

            n = len(first) - 1
            spans: list[list] = [list(x) for x in batch.column(held.index("spans")).to_pylist()]
            items: list[set] = [set(x) for x in batch.column(held.index("items")).to_pylist()]
            for engine, ids in engines:
                hits = engine.search(h, first, same)
                docs = np.searchsorted(first, np.array([p for _, p in hits], np.int64), "right") - 1
                for (s, p), d in zip(hits, docs.tolist()):
                    spans[d].append((p - engine.m + 1 - int(first[d]), p + 1 - int(first[d])))
                    items[d].update(ids[s])
            merged = [_merge(x) for x in spans]
            return [np.diff(first), pa.array(merged, SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    [sum(y["end"] - y["start"] for y in x) for x in merged] if n else []]

        return work

    found = map_text(df, "t", "n_words2 long, spans2 array<struct<start:int,end:int>>, items2 array<string>, n_hit2 long", make)
    return found.select("doc", "t", F.col("n_words2").alias("n_words"), F.transform("spans2", lambda x: F.struct(
        x["start"], x["end"])).alias("spans"), F.col("items2").alias("items"), F.col("n_hit2").alias("n_hit"))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(spans: list) -> list[dict]:
    """Union of word spans (as tuples or as rows of an earlier pass), in order."""
    out: list[dict] = []
    for a, b in sorted((x["start"], x["end"]) if isinstance(x, dict) else x for x in spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", slice_size: int = SLICE) -> DataFrame:
    """``doc``, ``n_words``, ``n_hit`` (words inside any occurrence), ``spans`` (word ranges) and ``items``."""
    strings = windows(benchmark).cache()
    n = strings.count()
    slices = max(1, ceil(n / slice_size))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty(text).alias("t"),
                     F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
                     F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("n_hit"))
    for k in range(slices):
        mine = strings.where(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == k)
        df = _pass(df, [(r.window, r["items"]) for r in mine.groupBy("window").agg(F.collect_set("item").alias("items")).collect()])
    strings.unpersist()
    return df.drop("t")
