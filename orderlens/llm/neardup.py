"""MinHash near-duplicates with tensored banding.

A document has two collections of half keys, each half key made of ``R`` minhash values.
The table keys are all pairs of one half key from either collection, so ``M * M`` tables
of ``2 * R`` values cost ``2 * M * R`` minhash computations instead of ``M * M * 2 * R``.
A half key that no other text has is dropped before pairs are formed.

Exact copies of a shingle set are one node from the start (pre-aggregated). In a table
bucket every member is paired with the bucket's smallest member; buckets that still hold
several components after these links were confirmed compare their members in blocks of
bounded size, so a link that does not pass by a smallest member is found too, and no
bucket is cut short. All candidates are confirmed on full shingle sets.

Defined cases: null, empty and white-only texts have an empty set and are linked with
nothing; a text of fewer than five words is one shingle, a very long one is a numpy step of
its own; rows without a doc_id are linked with nothing; repeated rows fall together, and
different texts under one doc_id are members of their own, which the id does not link;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.components import components
from orderlens.llm.shared import NOT_WHITE, give_back, map_text, mix, ranges, store, text_or_empty, window_hash, word_hashes

SHINGLE = 5
#: similarity, in percent, from which documents are linked
SIMILAR = 75
#: half keys in a collection, and minhash values in a half key
M, R = 16, 3
#: signature: the least value in each of so many bins of one more hash, a byte each
BINS = 512
#: percent of the filled bins that must agree before sets are compared (75 less 4 standard deviations)
AGREE = 67
#: pairs with fewer filled bins go to the exact check untested: colliding bins weigh too much there
FEW_BINS = 32
#: members of a bucket that are compared in one block
BLOCK = 1024

_RANDOM = np.random.default_rng(75)
_XOR = _RANDOM.integers(0, 1 << 63, 2 * M * R, dtype=np.uint64)
_MUL = _RANDOM.integers(0, 1 << 62, 2 * M * R, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's distinct shingle hashes, sorted, one document after another."""
    h, _, _, first = word_hashes(raw, offs, NOT_WHITE)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), np.maximum(0, size - SHINGLE + 1))
    values = window_hash(h, SHINGLE)[ranges(first[:-1], first[:-1] + np.maximum(0, size - SHINGLE + 1))]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(size == k)
        if len(short):
            values = np.concatenate([values, mix(window_hash(h, k)[first[short]] + np.uint64(k))])
            doc = np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(len(size) + 1))


def _reduce(op, values: np.ndarray, first: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.uint64)
    if full.any():
        out[full] = op.reduceat(values, first[:-1][full])
    return out


def sketch(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two set hashes, half keys [n, 2 M], signature bytes [n, BINS]) of shingle sets."""
    full = np.diff(first) > 0
    one = _reduce(np.add, mix(values), first, full)
    two = _reduce(np.add, mix(values * _MUL[0] + _XOR[0]), first, full)
    n = len(first) - 1
    halves = np.zeros((n, 2 * M), np.uint64)
    for k in range(2 * M):
        for r in range(R):
            low = _reduce(np.minimum, (values ^ _XOR[k * R + r]) * _MUL[k * R + r], first, full)
            halves[:, k] = mix(halves[:, k] + low)
        halves[:, k] = mix(halves[:, k] + np.uint64(k))
    v = mix(values ^ _XOR[-1])
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    bin_of = np.repeat(np.arange(n), np.diff(first)) * BINS + (v % np.uint64(BINS)).astype(np.int64)
    np.minimum.at(least, bin_of, v)
    signature = np.where(least == np.iinfo(np.uint64).max, 0, 1 + (least >> np.uint64(20)) % np.uint64(255)).astype(np.uint8).reshape(n, BINS)
    return one, two, halves, signature


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(rows.reshape(-1).view(np.int64)))


def sketches(docs: DataFrame) -> DataFrame:
    """(id, h, n, s1, s2, a, b, signature) of whole texts; ``docs`` has id, t and its hash h."""
    def make():
        def work(batch, raw, offs):
            values, first = shingle_sets(raw, offs)
            one, two, halves, signature = sketch(values, first)
            return [np.diff(first), one.view(np.int64), two.view(np.int64), _lists(np.ascontiguousarray(halves[:, :M])),
                    _lists(np.ascontiguousarray(halves[:, M:])), pa.array([x.tobytes() for x in signature], pa.binary())]
        return work
    return map_text(docs, "t", "n long, s1 long, s2 long, a array<long>, b array<long>, signature binary", make).drop("t")


def _shared_halves(nodes: DataFrame, side: str) -> DataFrame:
    """(node, places and values of the half keys that at least two nodes have)."""
    rows = nodes.select("node", F.posexplode(side).alias("place", "half"))
    twice = rows.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    return rows.join(twice, "half").groupBy("node").agg(F.collect_list(F.struct("place", "half")).alias(side))


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, ia, ib, node): all pairs of shared half keys, and their places in the collections."""
    halves = _shared_halves(nodes, "a").join(_shared_halves(nodes, "b"), "node")
    keys = halves.select("node", "b", F.explode("a").alias("x")).select("node", F.explode("b").alias("y"), "x")
    return keys.select(F.xxhash64("x.half", "y.half").alias("key"), F.col("x.place").cast("byte").alias("ia"),
                       F.col("y.place").cast("byte").alias("ib"), "node")


def _agree(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether signatures agree in enough of the bins that either has filled, or fill too few to tell."""
    filled = ((left > 0) | (right > 0)).sum(axis=1)
    return (filled < FEW_BINS) | (100 * ((left == right) & (left > 0)).sum(axis=1) >= AGREE * filled)


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose set sizes and signatures allow the similarity."""
    x, y = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}")) for k in "uv")
    near = pairs.join(x, "u").join(y, "v").where(f"100 * least(nu, nv) >= {SIMILAR} * greatest(nu, nv)")

    def keep(batches):
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(_agree(left, right)))

    return near.select("u", "v", "su", "sv").mapInArrow(keep, "u long, v long")


def confirm(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v): pairs whose full shingle sets reach the similarity."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = wanted.join(nodes.select("node", "id", "h", "s1"), "node").select("node", "id", "h", "s1")

    def make():
        def work(batch, raw, offs):
            values, first = shingle_sets(raw, offs)
            one = _reduce(np.add, mix(values), first, np.diff(first) > 0)
            return [pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), first[1:].tolist())], pa.binary()), one.view(np.int64)]
        return work

    read = texts.join(wanted.withColumnsRenamed({"id": "of", "h": "oh"}), F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh")))
    sets = (map_text(read.select("node", "s1", "t"), "t", "hashes binary, found long", make).where("found = s1")
            .groupBy("node").agg(F.first("hashes").alias("hashes")))
    sets = store(sets, "sets")

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                good.append(100 * both >= SIMILAR * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))
        give_back()

    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}")) for k in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "hu", "hv").mapInArrow(check, "u long, v long")


def _across(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of promising members of different components in the same bucket, each once.

    ``members``: key, ia, ib, node, component, n, a, b, signature, blocks. A bucket of many
    blocks is compared block by block: a member is sent to every pair of blocks that holds
    its own. Of the buckets that two members share, only the one made of their first common
    half keys reports them.
    """
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    sent = members.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "ia", "ib",
                       "node", "component", "n", F.concat("a", "b").alias("halves"), "signature")
    sent = sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n")

    def compare(batches):
        held: list = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            groups = [table.column(k).to_numpy() for k in range(3)]
            change = np.flatnonzero(np.any([g[1:] != g[:-1] for g in groups], axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from pairs_of(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from pairs_of(pa.Table.from_batches(held))
        give_back()

    def pairs_of(table):
        key, i, j, mine, ia, ib, node, part, size = (table.column(k).to_numpy() for k in range(9))
        halves = table.column(9).combine_chunks().flatten().to_numpy().reshape(-1, 2 * M)
        signature = np.frombuffer(b"".join(table.column(10).to_pylist()), np.uint8).reshape(-1, BINS)
        start = np.ones(len(key), bool)
        start[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.cumsum(start)
        at, step = np.arange(len(key)), 1
        while len(at):
            at = at[at + step < len(key)]
            # rows of a group are in order of size: once a size is too large, all later ones are
            at = at[(group[at] == group[at + step]) & (100 * size[at] >= SIMILAR * size[at + step])]
            cross = at[(part[at] != part[at + step]) & ((i[at] == j[at]) | (mine[at] != mine[at + step]))]
            for k in range(0, len(cross), 1 << 14):
                x = cross[k:k + (1 << 14)]
                same = halves[x] == halves[x + step]
                x = x[(same[:, :M].argmax(1) == ia[x]) & (same[:, M:].argmax(1) == ib[x])]
                x = x[_agree(signature[x], signature[x + step])]
                if len(x):
                    u, v = node[x], node[x + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
            step += 1

    return sent.mapInArrow(compare, "u long, v long")


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", null_ids: bool = False) -> DataFrame:
    """(id, h, n, leader) for every row: the hash of its text, its set's size, and the (id, h) that
    leads its group, the smallest one, rows without an id last. A row without words has no
    leader, and one without an id has none unless ``null_ids`` asks for them.

    Rows are told apart by id and text, so two texts under one id are two members."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = store(sketches(texts), "sketches")
    member = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    taking = rows.where("n > 0" if null_ids else "n > 0 and id is not null")
    same = taking.groupBy("s1", "s2", "n").agg(F.min(member).alias("first"), F.min_by(F.struct("a", "b", "signature"), member).alias("x"))
    # a class of equal sets is a node; its number holds from here on, as the table is stored
    classes = store(same.withColumn("node", F.monotonically_increasing_id()).select(
        "s1", "s2", "n", "node", "first", F.col("first.id").alias("id"), F.col("first.h").alias("h"), "x.*"), "classes")
    keys = store(table_keys(classes), "keys")
    lead = keys.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("c")).where("c > 1")
    pairs = keys.join(lead, "key").where("node != u").select("u", F.col("node").alias("v")).distinct()
    links = store(confirm(store(promising(pairs, classes), "pairs"), texts, classes), "links")
    found = store(components(links), "components")
    # buckets that hold several components
    placed = keys.join(found.withColumnRenamed("component", "c"), "node", "left").select(
        "key", "ia", "ib", "node", F.coalesce("c", "node").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo != hi")
    members = (placed.join(open_keys.select("key", F.ceil(F.col("c") / BLOCK).alias("blocks")), "key")
               .join(classes.select("node", "n", "a", "b", "signature"), "node"))
    more = store(_across(members), "across").join(links, ["u", "v"], "left_anti")
    late = store(confirm(store(more, "late"), texts, classes), "late-links")
    if not late.isEmpty():
        joined = found.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = store(components(joined.unionByName(late)), "components")
    of_class = classes.select("s1", "s2", "n", "node", "first").join(found, "node", "left").select(
        "s1", "s2", "n", "first", F.coalesce("component", "node").alias("c"))
    leaders = of_class.groupBy("c").agg(F.min("first").alias("leader"))
    of_class = of_class.join(leaders, "c").select("s1", "s2", "n", F.struct("leader.id", "leader.h").alias("leader"))
    out = rows.select("id", "h", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left")
    return out.select("id", "h", "n", F.when(F.lit(null_ids) | F.col("id").isNotNull(), F.col("leader")).alias("leader"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row. Where one id stands on several
    texts each is a member of its own; a row without an id has no component."""
    return (groups(docs, text, doc_id)
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("leader.id", "id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
