"""Hard negatives by bounds along spanning trees of the anchors.

Anchors with one label are cut into blocks of near ones, and each block is joined up by its
minimum spanning tree. A row's score with an anchor differs from its score with the anchor's
parent by at most the edge's length times the row's norm, so a score (or interval) at the
parent bounds the child's. Only rows whose interval overlaps what an anchor still wants, a
score window cut at its k-th best so far, are scored again, and so become exact for the
next step down the tree.

The anchors are a stated query set against all rows, in blocks: slices of at most
:data:`SLICE_BYTES` of anchors are broadcast in turn, and every row meets each slice where
it lies, without a shuffle. What a task found is its best k of each anchor and window; one
row in :data:`SEED_EVERY` is searched first, and its k-th best is a bound below which no
task of the full search has to send anything. Bounds never decide a result.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part; vectors are compared with vectors of the same length only; a row with the
anchor's own id is not another row; anchors that repeat count once, other rows that repeat
each count; ties go to the smaller id; an anchor without positives has no rows; very long
vectors make smaller steps; scores that no 64-bit integer holds are an error; other columns
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.llm.shared import drop_stored, store, table_path

#: anchors in one spanning tree at most
BLOCK = 512
#: bytes of anchor vectors that one search broadcasts
SLICE_BYTES = 8 << 20
#: anchors that one task sorts into blocks, about
ANCHORS_A_TASK = 8192
#: one row in so many is searched first, for bounds
SEED_EVERY = 64
#: bytes of row vectors that one numpy step works on
STEP_BYTES = 1 << 20
#: sums up to this are exact in doubles
EXACT = float(1 << 53)

ROW = "id long, label string, vec array<double>"
PLANTED = "slice long, block long, pos int, parent int, edge double, id long, label string, vec array<double>"
FOUND_NEGATIVES = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "anchor int, anchor_id long, window int, id long, score long"


def _taking_part(rows: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("string").alias("label"),
                        F.col(f"`{vector}`").cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(finite))


def _matrices(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their floor(scale * x) as a matrix of doubles) for each length of vector in a list column."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(np.float64)
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, np.floor(scale * flat[first[rows][:, None] + np.arange(d)])


# --------------------------------------------------------------------------- trees

def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: parents come first, ``parent`` is a place in ``order``."""
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int32), np.zeros(n)
    near, link, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        if k:
            parent[k], edge[k] = link[at], near[at]
        far = np.linalg.norm(x - x[at], axis=1)
        closer = left & (far < near)
        near[closer], link[closer] = far[closer], k
        if k + 1 < n:
            at = int(np.where(left, near, np.inf).argmin()) if np.isfinite(near[left]).any() else int(left.argmax())
    return order, parent, edge


def _cells(batches):
    """Append the signs of 16 fixed random projections, so that a sort brings near anchors together."""
    for batch in batches:
        cell = np.zeros(batch.num_rows, np.int64)
        for rows, x in _matrices(batch.column(2), 1.0):
            signs = x @ np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], 16)) > 0
            cell[rows] = signs @ (1 << np.arange(16))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])


def _plant(scale: float, block: int, slice_bytes: int):
    def run(batches):
        task, n_blocks, used = TaskContext.get().partitionId(), 0, 0
        rows = ((i, t, v) for b in batches for i, t, v in zip(*(b.column(c).to_pylist() for c in ("id", "label", "vec"))))

        def cut():
            for _, same in groupby(rows, lambda r: (r[1], len(r[2]))):
                held = []
                for r in same:
                    held.append(r)
                    if len(held) == block:
                        yield held
                        held = []
                if held:
                    yield held

        for held in cut():
            x = np.floor(scale * np.array([v for _, _, v in held], np.float64).reshape(len(held), -1))
            order, parent, edge = spanning_tree(x)
            held = [held[k] for k in order]
            ids, labels, vecs = zip(*held)
            used += x.nbytes
            out = [pa.array([(task << 20) + used // slice_bytes] * len(held), pa.int64()),
                   pa.array([(task << 40) + n_blocks] * len(held), pa.int64()), pa.array(range(len(held)), pa.int32()),
                   pa.array(parent), pa.array(edge), pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(vecs, pa.list_(pa.float64()))]
            n_blocks += 1
            yield pa.RecordBatch.from_arrays(out, ["slice", "block", "pos", "parent", "edge", "id", "label", "vec"])

    return run


def plant_trees(anchors: DataFrame, scale: float, block: int = BLOCK, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The anchors by slice and block, in tree order, as a stored table."""
    anchors = store(anchors.dropDuplicates(["id", "label", "vec"]).mapInArrow(_cells, f"{ROW}, cell long"), "anchors")
    tasks = anchors.count() // ANCHORS_A_TASK + 1
    near = anchors.repartitionByRange(tasks, "label", F.size("vec"), "cell", "id").sortWithinPartitions("label", F.size("vec"), "cell", "id")
    planted = store(near.mapInArrow(_plant(scale, block, slice_bytes), PLANTED), "trees")
    drop_stored(anchors.sparkSession, anchors)
    return planted


# --------------------------------------------------------------------------- search

def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties by smaller id, in that order."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
    return scores[order], ids[order]


class Block:
    """One tree, and what each of its anchors still wants in each of its windows (lowest score, highest score)."""

    def __init__(self, label: str, ids: list[int], x: np.ndarray, parent: list[int], edge: list[float], windows: list[list[tuple]], same: bool):
        self.label, self.ids, self.x, self.parent, self.same = label, ids, x, parent, same
        # a little longer, so that rounding never cuts a bound
        self.edge = [e + 1e-9 * (e + a) + 1e-6 for e, a in zip(edge, np.linalg.norm(x, axis=1).tolist())]
        self.windows = windows
        self.peak = float(np.abs(x).max(initial=0))
        self.best = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in w] for w in windows]
        self.floor = [[low for low, _ in w] for w in windows]

    def meet(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, k: int) -> None:
        """Take in rows of the right labels: bound, rescore what overlaps, keep each window's best k."""
        n, exact = len(ids), self.peak * float(np.abs(x).max(initial=0)) * x.shape[1] < EXACT
        low, high = np.full((len(self.ids), n), -np.inf), np.full((len(self.ids), n), np.inf)
        vectors = self.x if exact else [[int(v) for v in a] for a in self.x]
        rows = x if exact else np.array([[int(v) for v in r] for r in x], object).reshape(n, -1)
        for i, p in enumerate(self.parent):
            floors = [(w, f, top) for w, (f, (_, top)) in enumerate(zip(self.floor[i], self.windows[i])) if f <= top]
            if p >= 0:
                reach = self.edge[i] * norm
                low[i], high[i] = low[p] - reach, high[p] + reach
            if not floors and p >= 0:
                continue
            want_low, want_high = min((f for _, f, _ in floors), default=np.inf), max((t for _, _, t in floors), default=-np.inf)
            hit = np.flatnonzero((high[i] >= want_low) & (low[i] <= want_high)) if p >= 0 else np.arange(n)
            if not len(hit):
                continue
            if exact:
                s = x @ vectors[i] if 2 * len(hit) > n else x[hit] @ vectors[i]
                hit = np.arange(n) if 2 * len(hit) > n else hit
            else:
                s = rows[hit] @ np.array(vectors[i], object) if x.shape[1] else np.zeros(len(hit), object)
            low[i, hit] = high[i, hit] = s.astype(np.float64)
            if not exact:  # a rounded score must not cut its children's bounds
                low[i, hit], high[i, hit] = np.nextafter(low[i, hit], -np.inf), np.nextafter(high[i, hit], np.inf)
            for w, f, top in floors:
                own = np.flatnonzero((s >= f) & (s <= top) & (ids[hit] != self.ids[i]))
                if len(own):
                    held = self.best[i][w]
                    self.best[i][w] = held = _first(np.concatenate([held[0], s[own]]), np.concatenate([held[1], ids[hit][own]]), k)
                    if len(held[0]) == k:
                        self.floor[i][w] = max(f, held[0][-1])


def _search(rows: DataFrame, trees: list[dict], windows: dict, k: int, same: bool, scale: float) -> DataFrame:
    """Each task's best k of every (anchor, window). ``windows`` has, by number of the anchor, its (lowest, highest) scores."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, windows))

    def run(batches):
        trees, windows = shared.value
        blocks: dict[int, list[Block]] = {}
        starts: dict[int, int] = {}
        for t in trees:
            n = len(t["ids"])
            b = Block(t["label"], t["ids"], t["x"], t["parent"], t["edge"], [windows.get(t["start"] + i, []) for i in range(n)], same)
            starts[id(b)] = t["start"]
            blocks.setdefault(b.x.shape[1], []).append(b)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            labels = batch.column(1).dictionary_encode()
            code, names = np.asarray(labels.indices), labels.dictionary.to_pylist()
            for found, x in _matrices(batch.column(2), scale):
                d = x.shape[1]
                if d not in blocks:
                    continue
                size = max(1, STEP_BYTES // (8 * max(d, 1)))
                for a in range(0, len(found), size):
                    part, y = found[a:a + size], x[a:a + size]
                    norm = np.linalg.norm(y, axis=1)
                    for name in sorted({b.label for b in blocks[d]}):
                        mine = code[part] == (names.index(name) if name in names else -1)
                        mine = np.flatnonzero(mine if same else ~mine)
                        if len(mine):
                            z, m, i = y[mine], norm[mine], ids[part][mine]
                            for b in blocks[d]:
                                if b.label == name:
                                    b.meet(i, z, m, k)
        for group in blocks.values():
            for b in group:
                got = [(starts[id(b)] + i, b.ids[i], w, int(j), int(s)) for i, per in enumerate(b.best)
                       for w, (scores, found) in enumerate(per) for s, j in zip(scores, found)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (
                        pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor", "anchor_id", "window", "id", "score"])

    found = rows.mapInArrow(run, FOUND)
    place = F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _seeded(rows: DataFrame, trees: list[dict], windows: dict, k: int, same: bool, scale: float) -> DataFrame:
    """The search over all rows, its windows cut at the k-th best that a sample of the rows has to offer."""
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SEED_EVERY)) == 0)
    kth = _search(sample, trees, windows, k, same, scale).where(F.col("place") == k).select("anchor", "window", "score").collect()
    bound = {(r.anchor, r.window): r.score for r in kth}
    cut = {a: [(max(low, bound.get((a, w), low)), high) for w, (low, high) in enumerate(ws)] for a, ws in windows.items()}
    return _search(rows, trees, cut, k, same, scale)


def _slices(planted: DataFrame, slice_bytes: int) -> list[list[int]]:
    """The tasks' slices, small ones together, so that how many tasks planted them does not matter."""
    sizes = planted.groupBy("slice").agg(F.sum(8 * F.size("vec") + 8).alias("bytes")).collect()
    out: list[list[int]] = []
    used = 0
    for r in sorted(sizes, key=lambda r: r.slice):
        if not out or used + r.bytes > slice_bytes:
            out.append([])
            used = 0
        out[-1].append(r.slice)
        used += r.bytes
    return out


def _trees(planted: DataFrame, parts: list[int], scale: float) -> list[dict]:
    """Some slices' blocks on the driver (``SLICE_BYTES`` of vectors and a block at most)."""
    out, start = [], 0
    rows = sorted(planted.where(F.col("slice").isin(parts)).collect(), key=lambda r: (r.block, r.pos))
    for _, group in groupby(rows, lambda r: r.block):
        held = list(group)
        x = np.floor(scale * np.array([r.vec for r in held], np.float64).reshape(len(held), -1))
        out.append({"label": held[0].label, "ids": [r.id for r in held], "x": x, "parent": [r.parent for r in held],
                    "edge": [r.edge for r in held], "start": start})
        start += len(held)
    return out


def mine_hard_negatives(rows: DataFrame, anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
                        scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                        block: int = BLOCK, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    Vectors are floor(scale * x), scores their integer inner products. An anchor's positives
    are its best ``positives`` other rows of its label; a positive's negatives are the best
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.
    ``anchor`` and ``label`` are columns over ``rows``.
    """
    spark = rows.sparkSession
    base = _taking_part(rows, vec_id, vector, label)
    planted = plant_trees(_taking_part(rows.where(anchor), vec_id, vector, label), scale, block, slice_bytes)
    path = table_path(spark, "negatives")
    spark.createDataFrame([], FOUND_NEGATIVES).write.parquet(path)
    for parts in _slices(planted, slice_bytes):
        trees = _trees(planted, parts, scale)
        everything = {t["start"] + i: [(float("-inf"), float("inf"))] for t in trees for i in range(len(t["ids"]))}
        chosen: dict[int, list] = {}
        for r in _seeded(base, trees, everything, positives, True, scale).collect():  # at most ``positives`` rows an anchor
            chosen.setdefault(r.anchor, []).append((r.place, r.id, r.score))
        # 100 * n >= low * p and 100 * n <= high * p, in whole numbers
        windows = {a: [(-(-low * p // 100), high * p // 100) for _, _, p in sorted(found)] for a, found in chosen.items()}
        found = _seeded(base, trees, windows, negatives, False, scale)
        pairs = [(a, w, i, p) for a, held in chosen.items() for w, (_, i, p) in enumerate(sorted(held))]
        named = spark.createDataFrame(pairs, "anchor int, window int, positive_id long, positive_score long")
        out = found.join(F.broadcast(named), ["anchor", "window"])  # bounded by the slice
        out.select("anchor_id", "positive_id", (F.col("window") + 1).alias("positive_rank"), F.col("place").cast("int").alias("rank"),
                   F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    drop_stored(spark, planted)
    return spark.read.schema(FOUND_NEGATIVES).parquet(path)
