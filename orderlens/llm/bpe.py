"""Byte-level BPE encoding and decoding.

Encoding folds ranked merges over the byte arrays of distinct words. :func:`encode_words`
does it with Spark's higher-order functions: a fold whose state is the array of pieces
and whose ranks come from a literal table. :func:`encode` applies the same fold to the
distinct words that a task meets, because joining every word occurrence of the corpus to
a table of encoded words moves more bytes than the corpus has (figures in the README).
Decoding is native: each id picks its piece from a literal table, and the binary pieces
are concatenated.

Defined cases: a null text is empty; an empty text has no ids; repeated rows are encoded
each for itself; input columns pass through inside ``doc``; any byte sequence is covered
because all 256 single bytes have a rank.
"""

from __future__ import annotations

import base64
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import in_process, map_text, ranges, string_array, text_or_empty

#: distinct words, and units, that a task keeps at most; beyond it they are forgotten and encoded anew
CACHE_WORDS = 700_000
#: the same where byte-level encoding is one of several operators in a session, whose workers keep it
FOLDED_WORDS = 250_000
#: marks that are a word of their own after letters and before white space
MARKS = frozenset(".,;:!?")
#: slots of the literal rank table
SLOTS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file (token in base64, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold ranked merges: join the neighbours of lowest rank until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i:i + 1] for i in range(len(word))]
    if len(parts) > 512:
        return _merge_long(parts, ranks)
    pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == 1 << 30:
            break
        i = pairs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap, for very long words (n log n instead of n squared)."""
    import heapq

    n = len(parts)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(parts)
    heap = [(ranks[live[i] + live[i + 1]], i, live[i], live[i + 1]) for i in range(n - 1) if live[i] + live[i + 1] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if live[i] != a or j >= n or live[j] != b:
            continue
        live[i], live[j] = a + b, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            if x >= 0 and y < n and live[x] + live[y] in ranks:
                heapq.heappush(heap, (ranks[live[x] + live[y]], x, live[x], live[y]))
    return [ranks[p] for p in live if p]


class UnitEncoder:
    """Ids of whole texts from the ids of their distinct words.

    A word is a match of ``pattern``. Texts are cut at spaces and line ends into units,
    which recur and are kept with their ids; the words of new units are matched, and only
    words not met before are encoded. The pattern starts a match at a space or line end
    that stands between two characters that are not white, so units can be matched each
    for itself; a text where white space touches white space is matched as a whole.
    ``encode_many(words)`` returns each word's ids as uint32 little-endian bytes. The
    pattern is that of the public byte-level vocabularies: contractions, or an optional
    space with letters, digits or marks, or white space.
    """

    def __init__(self, pattern: str, encode_many, limit: int = CACHE_WORDS):
        import regex

        self.find, self.encode_many, self.limit = regex.compile(pattern).findall, encode_many, limit
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}  # no ids: not to be matched for itself

    def matched(self, texts: list[str]) -> list[bytes]:
        return self._joined([self.find(t) for t in texts])

    def _joined(self, found: list[list[str]]) -> list[bytes]:
        ids = self._ids_of(set().union(*found))
        return [b"".join(map(ids, f)) for f in found]

    def _ids_of(self, wanted: set[str]):
        """Lookup of the ids of words, after those not met before were encoded."""
        new = wanted.difference(self.words)
        if new:
            if len(self.words) + len(new) > self.limit:
                self.words.clear()
                new = wanted
            new = list(new)
            self.words.update(zip(new, self.encode_many(new)))
        return self.words.__getitem__

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text: Arrow cuts the texts and numbers their units, so that only distinct ones are looked up."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return []
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        pieces, at = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        heads = _strings(pieces.take(pa.array(at[:-1])))
        ended = pc.equal(pieces.take(pa.array(at[1:] - 1)), "\n").to_numpy(zero_copy_only=False) & (np.diff(at) > 1)
        inside = np.ones(len(pieces), bool)
        inside[at[:-1]] = False
        inside[at[1:][ended] - 1] = False
        units = pieces.filter(pa.array(inside)).dictionary_encode()
        found = self._found(_strings(units.dictionary))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, arena, odd = np.cumsum(size) - size, np.frombuffer(b"".join(found), np.uint32), size == 0
        codes = units.indices.to_numpy()
        first = np.concatenate([[0], np.cumsum(inside)])[at]  # first unit of each text
        flat = arena[ranges(start[codes], start[codes] + size[codes])].tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(size[codes])])[first]).tolist()
        odd = np.diff(np.concatenate([[0], np.cumsum(odd[codes])])[first]) > 0
        end = self.matched(["\n"])[0] if ended.any() else b""
        out = [b"".join([head, flat[i:j], end if e else b""]) for head, i, j, e in zip(self.matched(heads), ends, ends[1:], ended.tolist())]
        # white space touches white space
        odd = [k for k, (head, o) in enumerate(zip(heads, odd.tolist())) if o or head and (head[0].isspace() or head[-1].isspace())]
        for k, ids in zip(odd, self.matched([column[k].as_py() for k in odd])):
            out[k] = ids
        return out

    def _found(self, units: list[str]) -> list[bytes]:
        """What is kept for each of these distinct units, after those not met before were added."""
        found = list(map(self.units.get, units))
        at = [k for k, ids in enumerate(found) if ids is None]
        if len(self.units) + len(at) > self.limit:
            self.units.clear()
            at = range(len(units))
        self._add([units[k] for k in at])
        for k in at:
            found[k] = self.units[units[k]]
        return found

    def _add(self, new: list[str]) -> None:
        # letters, and letters before one mark, need no matching; a stem before a mark is kept as the unit that it is
        plain, marked, rest = [], [], []
        for u in new:
            (plain if u.isalpha() else marked if u[-1:] in MARKS and u[:-1].isalpha() else rest).append(u)
        stems = [u[:-1] for u in marked]
        plain += set(stems).difference(self.units, plain)
        self.units.update(zip(plain, self.encode_many([" " + u for u in plain])))
        marks = self._ids_of({u[-1] for u in marked})
        self.units.update(zip(marked, map(add, map(self.units.__getitem__, stems), [marks(u[-1]) for u in marked])))
        self.units.update(dict.fromkeys(rest, b""))
        rest = [u for u in rest if (body := u[1:] if u[:1] == "\n" else u) and body.strip() == body]
        self.units.update(zip(rest, self._joined([self._words_of(u) for u in rest])))

    def _words_of(self, unit: str) -> list[str]:
        """The words of a unit that stands at a line's start, or after a space."""
        if unit[0] != "\n":
            return self.find(" " + unit)
        if unit[1:].isalpha():
            return ["\n", unit[1:]]
        return ["\n", unit[1:-1], unit[-1]] if unit[-1] in MARKS and unit[1:-1].isalpha() else self.find(unit)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class MergeTable:
    """The merges of a vocabulary as sorted arrays, to fold many words at once in numpy.

    Every split of a token into two tokens is a mergeable pair, whose rank is the token's.
    """

    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.ranks = ranks
        self.keys, self.values = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(1, np.int64), np.full(1, self.NONE))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours; NONE for pairs that do not merge (or with a -1, an empty place)."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), self.values[at], self.NONE)

    def fold(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most ``width`` bytes: each round joins every word's first pair of lowest rank."""
        n = len(words)
        sizes = np.array([len(w) for w in words])
        parts = np.full((n, width), -1, np.int64)
        inside = np.arange(width) < sizes[:, None]
        parts[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        rows = np.arange(n)
        done = np.empty((n, width), np.int64)
        column = np.arange(width)
        while len(rows):
            i = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), i]
            ended = best == self.NONE
            if ended.any():
                done[rows[ended]] = parts[ended]
                go = ~ended
                rows, parts, ranks, i, best = rows[go], parts[go], ranks[go], i[go], best[go]
            if not len(rows):
                break
            at = np.arange(len(rows))
            parts[at, i] = best
            move = np.minimum(column + (column > i[:, None]), width - 1)  # close the gap behind i
            full = parts[:, -1].copy()
            parts = np.take_along_axis(parts, move, 1)
            parts[full >= 0, -1] = -1
            ranks = np.take_along_axis(ranks, move[:, :-1].clip(max=width - 2), 1)
            ranks[:, -1] = self.NONE
            left, right = np.maximum(i - 1, 0), np.minimum(i + 1, width - 1)
            ranks[at, np.minimum(i, width - 2)] = np.where(i < width - 1, self.rank(best, np.where(i < width - 1, parts[at, right], -1)), self.NONE)
            has = i > 0
            ranks[at[has], left[has]] = self.rank(parts[at[has], left[has]], best[has])
        sizes = (done >= 0).sum(1)
        flat = done[done >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [flat[b - 4 * k:b] for b, k in zip(ends, sizes.tolist())]

    def __call__(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        by_width: dict[int, list[int]] = {}
        raw = [w.encode("utf-8") for w in words]
        for k, w in enumerate(raw):
            whole = self.ranks.get(w)
            out.append(None if whole is None else whole.to_bytes(4, "little"))
            if whole is None:
                by_width.setdefault(next((x for x in (8, 16, 32, 64) if len(w) <= x), 0), []).append(k)
        for width, places in by_width.items():
            for p in range(0, len(places), 4096):
                some = places[p:p + 4096]
                ids = (self.fold([raw[k] for k in some], width) if width
                       else [np.array(merge_word(raw[k], self.ranks), "<u4").tobytes() for k in some])
                for k, x in zip(some, ids):
                    out[k] = x
        return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc`` (all input columns) and ``ids`` (array<int>) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(MergeTable(read_ranks(ranks_path)).__dict__)  # a fixed vocabulary file
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty(text).alias("t"))

    def make():
        def build():
            table = MergeTable.__new__(MergeTable)
            table.__dict__.update(shared.value)
            return UnitEncoder(pattern, table, FOLDED_WORDS)

        encoder = in_process(("merges", ranks_path, pattern), build)

        def work(batch, raw, offs):
            out = encoder(string_array(raw, offs))
            ends = np.cumsum([0, *(len(x) // 4 for x in out)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), np.int32)))]

        return work

    return map_text(df, "t", "ids array<int>", make).select("doc", "ids")


def literal_vocabulary(ranks: dict[bytes, int]) -> Column:
    """The pieces by id, in hex, as one literal array (missing ids are empty)."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return F.split(F.lit(" ".join(pieces)), " ", -1)


def decode(ids: Column, ranks_path: str) -> Column:
    """Binary text of an array of ids: its pieces, concatenated."""
    pieces = literal_vocabulary(read_ranks(ranks_path))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def _slot(piece_hex: bytes) -> int:
    h = xxhash.xxh64_intdigest(piece_hex, seed=42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % SLOTS


def literal_ranks(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal array of hash slots, each ``,hex=rank,hex=rank,``: Spark searches
    a literal map from its start, which a vocabulary of 50,000 entries makes too slow."""
    slots = [","] * SLOTS
    for token, rank in ranks.items():
        key = token.hex()
        slots[_slot(key.encode())] += f"{key}={rank},"
    return F.split(F.lit(" ".join(slots)), " ", -1)


def encode_words(words: DataFrame, ranks_path: str, word: str = "word") -> DataFrame:
    """(word, ids) of distinct words with higher-order functions alone.

    The state of the fold is the array of pieces (hex). A round scores all neighbouring
    pairs from the literal table, joins the first pair of lowest rank, and repeats; a word
    of n bytes needs at most n - 1 rounds, and rounds without a ranked pair change nothing.
    """
    table = literal_ranks(read_ranks(ranks_path))

    def rank(piece: Column) -> Column:
        slot = F.get(table, F.pmod(F.xxhash64(piece), F.lit(SLOTS)).cast("int"))
        key = F.concat(F.lit(","), piece, F.lit("="))
        at = F.position(key, slot)
        tail = F.substring(slot, at + F.char_length(key), F.lit(12))
        return F.when(at > 0, F.substring_index(tail, ",", 1).cast("int"))

    one = F.struct(F.lit(None).cast("int").alias("r"), F.lit(None).cast("int").alias("i"))

    def step(parts: Column, _: Column) -> Column:
        best = F.aggregate(
            F.sequence(F.lit(0), F.size(parts) - 2), one,
            lambda acc, i: F.when(
                (F.size(parts) > 1) & (F.coalesce(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.lit(1 << 30))
                                       < F.coalesce(acc["r"], F.lit(1 << 30))),
                F.struct(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))).alias("r"), i.cast("int").alias("i"))).otherwise(acc),
            lambda acc: acc["i"])
        at = F.transform(F.array(best), lambda i: F.when(i.isNull(), parts).otherwise(F.concat(
            F.slice(parts, 1, i), F.array(F.concat(F.get(parts, i), F.get(parts, i + 1))),
            F.slice(parts, i + 3, F.greatest(F.size(parts) - i - 2, F.lit(0))))))
        return F.get(at, F.lit(0))

    spelled = F.regexp_extract_all(F.lower(F.hex(F.encode(F.col(word), "utf-8"))), F.lit("(..)"), F.lit(1))
    rounds = F.sequence(F.lit(1), F.greatest(F.size(spelled), F.lit(1)))
    folded = F.aggregate(rounds, spelled, step)
    return words.select(F.col(word), F.transform(folded, rank).alias("ids"))
