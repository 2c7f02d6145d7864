"""Phrase collocations counted in counting quotient filters.

Texts are coded in chunks: each chunk holds one language's words as numbers of a dictionary
of its own. Words frequent enough to be part of a candidate get numbers that hold for the
whole language (a candidate's words and parts are at least as frequent as itself, so leaving
the others out loses nothing), and the chunks are recoded by a join with their dictionaries,
not by a broadcast. An n-gram is its packed word numbers; an invertible permutation scatters
it, the first bits select a shard, the next ones are the quotient and all others the
remainder. A filter keeps, of one shard, the run length of each quotient, the remainders in
order and a counter for each: nothing is lost, and filters of different chunks merge like
sorted lists. Pairs are counted first; longer n-grams only where all pairs inside are
frequent, which a bitmap of at most 2^28 bits tells (it may let others pass, never the
reverse).

Defined cases: a null text is empty, a null language is ``und``; texts without words count
nothing; a very long text is a chunk of its own; repeated documents count each; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.llm.shared import LOWER, drop_stored, mix, steps, store

#: bytes of text that a task codes at a time
CHUNK = 8 << 20
#: words in one row of a coded chunk, about
ROW_WORDS = 1 << 12
#: n-grams that a task holds before it packs them into filters
HELD = 1 << 22
#: n-grams of a shard, about, before those of all chunks are merged
SHARD = 1 << 21
#: buckets in which the frequent words of a language are numbered
NUMBERED = 256
#: log2 of the fewest and the most bits of the bitmap of frequent pairs, and of those in a row of it
LEAST_BITS, MOST_BITS, ROW_BITS = 20, 28, 19

#: what ends a piece, and what separates words inside it
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP = BREAK.copy()
GAP[[0x20, 9]] = True

U = np.uint64
#: rows of a chunk's dictionary, and (codes not null) its words in order, ``at`` counting rows
CODED = "chunk long, lang string, at int, word string, count int, codes binary"
FILTER = "lang string, n int, shard long, held binary"
COUNTED = "lang string, g array<int>, f long"


# --------------------------------------------------------------------------- words

def code_words(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of the texts, whether it follows the one before in a piece)."""
    raw = LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, bool)
    edge[:-1] |= BREAK[raw]
    ends = np.cumsum(edge, dtype=np.int32)  # texts and pieces begun so far
    follows = np.zeros(len(start), bool)
    follows[1:] = ends[start[1:]] == ends[end[:-1] - 1]
    size = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size), pa.py_buffer(raw[inside[1:-1]]))
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.string()), np.asarray(coded.indices).astype(np.int32), follows


def _code(chunk: int):
    """Code texts by language, ``chunk`` bytes at a time: the dictionary with counts, and each
    word's number, doubled, plus one where it follows the word before in a piece."""

    def rows(made: int, lang: str, at, word=None, count=None, codes=None):
        n = len(at)
        columns = [np.full(n, made), [lang] * n, at, *([None] * n if x is None else x for x in (word, count, codes))]
        types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types)],
                                          ["chunk", "lang", "at", "word", "count", "codes"])

    def run(batches):
        held: dict[str, list] = {}
        size, made = 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal made
            for lang, parts in held.items():
                lengths = np.concatenate([np.diff(o) for _, o in parts])
                words, codes, follows = code_words(np.concatenate([r for r, _ in parts]), np.concatenate([[0], np.cumsum(lengths)]))
                yield rows(made, lang, np.arange(len(words)), words, np.bincount(codes, minlength=len(words)))
                packed = (2 * codes + follows).astype(np.int32)
                cut = [packed[i:i + ROW_WORDS].tobytes() for i in range(0, len(packed), ROW_WORDS)]
                yield rows(made, lang, np.arange(len(cut)), codes=cut)
                made += 1
            held.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(1).filter(pa.array(np.asarray(langs.indices) == k))
                for _, _, raw, offs in steps(own, chunk):
                    held.setdefault(lang, []).append((raw, offs))
                    size += len(raw)
                    if size >= chunk:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def _number(found: DataFrame) -> DataFrame:
    """Number each language's words from 1, nearly without gaps, in ``NUMBERED`` buckets at a time."""
    bucket = F.pmod(F.xxhash64("word"), F.lit(NUMBERED))
    place = F.row_number().over(W.partitionBy("lang", "bucket").orderBy("word")) - 1
    return (found.withColumn("bucket", bucket).withColumn("id", (place * NUMBERED + F.col("bucket") + 1).cast("int"))
            .select("lang", "word", "id", "f"))


def _recode(codes: pa.Table, numbers: pa.Table) -> pa.Table:
    """One chunk as numbers of its language, in rows; 0 stands between words that do not follow each other."""
    codes = codes.sort_by("at")
    packed = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in codes.column("codes").to_pylist())])
    ids = np.zeros(int(packed.max(initial=0)) // 2 + 1, np.int32)
    ids[np.asarray(numbers.column("place"))] = np.asarray(numbers.column("id"))
    seq = ids[packed >> 1]
    known = seq > 0
    follows = (packed & 1 == 1) & known
    follows[1:] &= known[:-1]
    out = np.stack([np.zeros(len(seq), np.int32), seq], axis=1)  # a gap, then the word
    out = out[np.stack([known & ~follows, known], axis=1)]
    gaps = np.flatnonzero(out == 0)  # rows end at gaps, so that no n-gram is cut
    at = np.unique(gaps[np.minimum(np.searchsorted(gaps, np.arange(0, len(out), ROW_WORDS)), max(len(gaps) - 1, 0))]) if len(out) else gaps
    seqs = [x.tobytes() for x in np.split(out, at) if len(x)]
    return pa.table([pa.array([codes.column("lang")[0].as_py()] * len(seqs), pa.string()), pa.array(seqs, pa.binary())], ["lang", "seq"])


# --------------------------------------------------------------------------- filters

class Permutation:
    """An invertible scattering of pairs (a, z) of ``bits`` and ``more`` bits."""

    ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)

    def __init__(self, bits: int, more: int):
        self.bits, self.more = bits, more
        self.mask, self.rest = U((1 << bits) - 1), U((1 << more) - 1)
        self.half = U(bits - bits // 2)

    def _stir(self, a: np.ndarray) -> np.ndarray:
        for odd in self.ODD:
            a = (a * U(odd)) & self.mask
            a = a ^ (a >> self.half)
        return a

    def _unstir(self, a: np.ndarray) -> np.ndarray:
        for odd in self.ODD[::-1]:
            a = a ^ (a >> self.half)  # shifts of half the bits or more undo themselves
            a = (a * U(pow(odd, -1, 1 << 64))) & self.mask
        return a

    def scatter(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self._stir(a ^ (mix(z + U(1)) & self.mask))
        z = z ^ (mix(a + U(2)) & self.rest)
        return self._stir(a ^ (mix(z + U(3)) & self.mask)), z

    def restore(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self._unstir(a) ^ (mix(z + U(3)) & self.mask)
        z = z ^ (mix(a + U(2)) & self.rest)
        return self._unstir(a) ^ (mix(z + U(1)) & self.mask), z


def _least(x: np.ndarray, bits: int) -> bytes:
    """The low bytes of 64-bit numbers that hold ``bits`` bits."""
    return x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :(bits + 7) // 8].tobytes()


def _wide(raw: bytes, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    size = (bits + 7) // 8
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(U)


def _small(x: np.ndarray) -> tuple[bytes, bytes]:
    """Counters of a byte each; those of 255 and more follow at full width."""
    return np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].astype("<i8").tobytes()


def _counters(low: bytes, more: bytes) -> np.ndarray:
    out = np.frombuffer(low, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(more, "<i8")
    return out


class QuotientFilter:
    """Scattered n-grams of one shard, in order, with their counts.

    ``bits`` are the bits of ``a`` below the shard's; packed, the first of them (the quotient)
    are told by run lengths and only the others, with all of ``z``, are written out.
    """

    def __init__(self, a: np.ndarray, z: np.ndarray, count: np.ndarray, bits: int, more: int):
        self.a, self.z, self.count, self.bits, self.more = a, z, count, bits, more

    @classmethod
    def of(cls, a: np.ndarray, z: np.ndarray, count: np.ndarray | None, bits: int, more: int) -> QuotientFilter:
        """Sort n-grams and add up the counts of equal ones (1 each if none are given)."""
        if bits + more <= 64:
            both = a << U(more) | z
            order = np.argsort(both, kind="stable") if count is not None else None
            both = both[order] if order is not None else np.sort(both)
            a, z = (both >> U(more), both & U((1 << more) - 1)) if more else (both, np.zeros(len(both), U))
        else:
            order = np.lexsort((z, a))
            a, z = a[order], z[order]
        if not len(a):
            return cls(a, z, np.zeros(0, np.int64), bits, more)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (z[1:] != z[:-1])])
        at = np.flatnonzero(new)
        total = np.diff(np.concatenate([at, [len(a)]])) if count is None else np.add.reduceat(count[order], at)
        return cls(a[at], z[at], total, bits, more)

    def split(self, shard_bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The filters of the shards that the first ``shard_bits`` bits select."""
        left = self.bits - shard_bits
        edges = np.searchsorted(self.a, np.arange((1 << shard_bits) + 1, dtype=U) << U(left)) if shard_bits else np.array([0, len(self.a)])
        for s in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[s], edges[s + 1]
            yield s, QuotientFilter(self.a[i:j] & U((1 << left) - 1), self.z[i:j], self.count[i:j], left, self.more)

    def pack(self) -> bytes:
        n = len(self.a)
        q = min(self.bits, max(0, n.bit_length() - 1), 30)
        low = self.bits - q
        runs, more_runs = _small(np.bincount((self.a >> U(low)).astype(np.int64), minlength=1 << q))
        counts, more_counts = _small(self.count)
        parts = [runs, more_runs, _least(self.a & U((1 << low) - 1), low), _least(self.z, self.more), counts, more_counts]
        return b"".join([np.array([n, q, self.bits, self.more, *map(len, parts)], "<i8").tobytes(), *parts])

    @classmethod
    def unpack(cls, raw: bytes) -> QuotientFilter:
        n, q, bits, more, *sizes = np.frombuffer(raw, "<i8", 10).tolist()
        ends = np.cumsum([80, *sizes]).tolist()
        runs, more_runs, rest, z, counts, more_counts = (raw[i:j] for i, j in zip(ends, ends[1:]))
        low = bits - q
        quotient = np.repeat(np.arange(1 << q, dtype=U), _counters(runs, more_runs))
        return cls(quotient << U(low) | _wide(rest, n, low), _wide(z, n, more), _counters(counts, more_counts), bits, more)

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        first = filters[0]
        return cls.of(*(np.concatenate([getattr(f, x) for f in filters]) for x in ("a", "z", "count")), first.bits, first.more)


def _widths(n: int, word_bits: int) -> tuple[int, int]:
    """Bits of an n-gram's first two words, and of the others."""
    return 2 * word_bits, (n - 2) * word_bits


def _fill(word_bits: int, shard_bits: int, lengths: tuple[int, ...], frequent=None):
    """Count the n-grams of recoded chunks in filters. ``frequent``: a broadcast bitmap of the pairs worth a look."""

    def run(batches):
        held: dict[tuple[str, int], list] = {}
        size = 0

        def flush():
            out = []
            for (lang, n), parts in held.items():
                bits, more = _widths(n, word_bits)
                a, z = Permutation(bits, more).scatter(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
                out += [(lang, n, s, f.pack()) for s, f in QuotientFilter.of(a, z, None, bits, more).split(shard_bits)]
            held.clear()
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 64]), (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                                                 ["lang", "n", "shard", "held"])

        for batch in batches:
            for lang, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(seq.as_buffer(), np.int32).astype(U)
                pair = x[:-1] << U(word_bits) | x[1:]
                good = (x[:-1] > 0) & (x[1:] > 0)
                if frequent is not None:
                    good[good] = look_up(frequent.value, lang, pair[good])
                for n in lengths:
                    on = good
                    for k in range(1, n - 1):
                        on = on[:-1] & good[k:]
                    at = np.flatnonzero(on)
                    z = np.zeros(len(at), U)
                    for k in range(2, n):
                        z = z << U(word_bits) | x[at + k]
                    held.setdefault((lang, n), []).append((pair[at], z))
                    size += len(at)
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _merge(word_bits: int, shard_bits: int, min_count: int):
    """Merge one shard's filters of all chunks and read back the n-grams found often enough."""

    def run(key, table):
        lang, n, shard = (k.as_py() for k in key)
        bits, more = _widths(n, word_bits)
        merged = QuotientFilter.merge([QuotientFilter.unpack(b) for b in table.column("held").to_pylist()])
        often = merged.count >= min_count
        a = merged.a[often] | (U(shard) << U(bits - shard_bits))
        a, z = Permutation(bits, more).restore(a, merged.z[often])
        mask = U((1 << word_bits) - 1)
        words = [a >> U(word_bits), a & mask, *(z >> U(word_bits * (n - 3 - k)) & mask for k in range(n - 2))]
        flat = np.stack(words, axis=1).astype(np.int32).reshape(-1)
        g = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, n, dtype=np.int32), flat)
        return pa.table([pa.array([lang] * len(g), pa.string()), g, pa.array(merged.count[often], pa.int64())], ["lang", "g", "f"])

    return run


def count_ngrams(seqs: DataFrame, lengths: tuple[int, ...], word_bits: int, shard_bits: int, min_count: int, frequent=None) -> DataFrame:
    """(lang, g, f): all n-grams of the given lengths that occur ``min_count`` times."""
    shard_bits = min(shard_bits, 2 * word_bits)
    filters = seqs.mapInArrow(_fill(word_bits, shard_bits, lengths, frequent), FILTER)
    return filters.groupBy("lang", "n", "shard").applyInArrow(_merge(word_bits, shard_bits, min_count), COUNTED)


# --------------------------------------------------------------------------- frequent pairs

def _places(bits: int, lang: str, pair: np.ndarray) -> np.ndarray:
    return mix(pair + mix(np.array([crc32(lang.encode())], U))) >> U(64 - bits)


def look_up(bitmap: np.ndarray, lang: str, pair: np.ndarray) -> np.ndarray:
    p = _places(int(len(bitmap) * 8).bit_length() - 1, lang, pair)
    return (bitmap[(p >> U(3)).astype(np.int64)] >> (p & U(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(pairs: DataFrame, word_bits: int) -> np.ndarray:
    """A bitmap that holds every pair, of 16 bits a pair within fixed bounds; it is put together from
    rows of 2^19 bits that Spark makes, so the driver gets 32 MB at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * pairs.count()).bit_length()))

    def place(batches):
        for batch in batches:
            g = np.asarray(batch.column(1).flatten()).astype(U).reshape(-1, 2)
            for lang in set(batch.column(0).to_pylist()):
                own = g[np.asarray(pc.equal(batch.column(0), lang))]
                p = np.unique(_places(bits, lang, own[:, 0] << U(word_bits) | own[:, 1]))
                yield pa.RecordBatch.from_arrays([pa.array((p >> U(ROW_BITS)).astype(np.int32)), pa.array((p & U((1 << ROW_BITS) - 1)).astype(np.int32))],
                                                 ["row", "bit"])

    def row(key, table):
        out = np.zeros(1 << ROW_BITS, np.uint8)
        out[np.asarray(table.column("bit"))] = 1
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["row", "held"])

    rows = (pairs.select("lang", "g").mapInArrow(place, "row int, bit int").distinct()
            .groupBy("row").applyInArrow(row, "row int, held binary"))
    bitmap = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows.collect():
        bitmap[r.row << (ROW_BITS - 3):(r.row + 1) << (ROW_BITS - 3)] = np.frombuffer(r.held, np.uint8)
    return bitmap


# --------------------------------------------------------------------------- phrases

def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def score_phrases(counted: DataFrame, single: DataFrame) -> DataFrame:
    """(lang, g, a, l, r, score): the lowest-scoring cut of each n-gram of two words or more.

    ``counted`` and ``single`` are (lang, g, f) of n-grams and of words. Each cut looks up its
    two parts by equi-joins, which Spark can split for a word that begins very many.
    """
    parts = counted.unionByName(single)
    cuts = counted.select("lang", "g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("g", F.lit(1), F.col("k")), "rest": F.slice("g", F.col("k") + 1, F.size("g"))})
    cuts = cuts.join(parts.select("lang", F.col("g").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("g").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.withColumn("total", _exact("l") + _exact("r")).withColumn("times", _exact("a") * F.lit(2000000).cast("decimal(7,0)"))
    scored = scored.withColumn("score", F.expr("times div total"))
    best = scored.groupBy("lang", "g").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    return best.select("lang", "g", "a", "cut.l", "cut.r", "cut.score")


def longest_around(counted: DataFrame) -> DataFrame:
    """(lang, g, around): for each n-gram inside longer ones, the largest count of those."""
    size = F.size("g")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("g", i, m))))
    longer = counted.where(size > 2).select("lang", "f", F.explode(spans).alias("g"))
    return longer.groupBy("lang", "g").agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, longest: int = 4, top: int = 2000,
                 share: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` (3 or 4) words.

    A phrase that lies inside a longer one found at least ``share`` times in a hundred of its
    own occurrences is left out. Products are taken in decimals, so they may pass 64 bits.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    coded = store(texts.mapInArrow(_code(chunk), CODED), "coded")
    entries = coded.where("codes is null").select("chunk", "lang", "at", "word", "count")
    total = store(entries.groupBy("lang").agg(F.sum("count").alias("n")), "totals")
    known = entries.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= min_count)
    words = store(_number(known), "words")
    word_bits = max(1, int(words.agg(F.max("id")).first()[0] or 0).bit_length())
    most = total.agg(F.max("n")).first()[0] or 0
    shard_bits = max(0, (int(most) // SHARD).bit_length())
    numbers = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), F.col("at").alias("place"), "id")
    codes = coded.where("codes is not null").select("chunk", "lang", "at", "codes")
    seqs = store(codes.groupBy("chunk").cogroup(numbers.groupBy("of")).applyInArrow(_recode, "lang string, seq binary"), "seqs")
    drop_stored(spark, coded)
    pairs = store(count_ngrams(seqs, (2,), word_bits, shard_bits, min_count), "pairs")
    shared = spark.sparkContext.broadcast(bitmap_of(pairs, word_bits))
    longer = store(count_ngrams(seqs, tuple(range(3, longest + 1)), word_bits, shard_bits, min_count, shared), "ngrams")
    drop_stored(spark, seqs)
    counted = pairs.unionByName(longer)
    scored = score_phrases(counted, words.select("lang", F.array("id").alias("g"), "f"))
    kept = scored.join(longest_around(counted), ["lang", "g"], "left").where(
        F.col("around").isNull() | (_exact("around") * 100 < _exact("a") * share))
    # by score and count first, all ties included; their words, which settle ties, come after
    place = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    first = kept.withColumn("place", place).where(F.col("place") <= top).select("lang", "g", "a", "l", "r", "score")
    spelled = (first.select("*", F.posexplode("g").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
               .groupBy("lang", "g", "a", "l", "r", "score")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(total, "lang")
    out = store(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    for table in (total, words, pairs, longer):
        drop_stored(spark, table)
    return out
