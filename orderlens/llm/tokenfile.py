"""Token-id files: documents in doc_id order, each compressed by itself with one shared
zstandard dictionary that is trained on serialized id arrays.

A file image holds the dictionary's hash, the doc ids, token counts, an offset index and
the frames, so that a short document is read without touching the rest. Images are rows
of a Parquet table in the shared folder: Spark's commit protocol makes the write safe
against lost executors, and any store that Spark reaches can hold them.

Order: a range partitioning on doc_id (ties by the text's hash) and a sort inside each
partition; the position of a document in the whole needs one total per partition.

Defined cases: a null text is empty and has only the end id; null doc ids come first;
repeated rows are written each for itself; other columns are not written; an empty table
gives no images; a sample too small for training gives an empty dictionary.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array
from itertools import accumulate, chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.bpe import UnitEncoder
from orderlens.llm.shared import in_process, steps, store, string_array, text_or_empty

END_ID = 2
#: the dictionary is trained on this many documents (smallest hash of the id) of at most so many bytes
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 1 << 15
DICTIONARY_BYTES = 1 << 16
#: an image is closed when its frames reach this size
IMAGE_BYTES = 1 << 21
#: bytes of text that are encoded at once: the more, the fewer distinct units are looked up
ENCODE_BYTES = 1 << 22
MAGIC = b"IDZ1"
#: magic, hash of the dictionary, number of documents
HEADER = "<4s32sQ"


def library_words(path: str):
    """Encoder of words with the tokenizers library; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    merge, hidden = tokenizer.model.tokenize, [(chr(b), c) for b, c in byte_alphabet().items() if chr(b) != c]

    def spelled(words: list[str]) -> list[str]:
        """The words in the vocabulary's byte characters, all in one pass where no word holds a NUL."""
        text = "\0".join(words).encode("utf-8").decode("latin-1")
        if text.count("\0") != len(words) - 1:
            return [spelled([w])[0] if "\0" not in w else "\u0100".join(spelled(w.split("\0"))) for w in words]
        for b, c in hidden:
            if b != "\0" and b in text:
                text = text.replace(b, c)
        return text.split("\0")

    def many(words: list[str]) -> list[bytes]:
        # a word is one match of the pre-tokenizer, so its byte characters can go to the library's model at once
        found = list(map(merge, spelled(words)))
        flat = array("I", map(attrgetter("id"), chain.from_iterable(found))).tobytes()
        ends = list(accumulate(map(len, found), initial=0))
        return [flat[4 * i:4 * j] for i, j in pairwise(ends)]

    return many


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the others follow from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def train_dictionary(docs: DataFrame, path: str, pattern: str) -> bytes:
    """A dictionary trained on the serialized ids of a bounded sample."""
    h = F.xxhash64("id", F.lit(1))
    # the ids alone first: a limit on whole rows would send so many texts from every task to the driver
    least = [r.h for r in docs.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).collect()]
    rows = (docs.select("id", "t").where((h <= F.lit(max(least, default=0))) & (F.octet_length("t") <= SAMPLE_BYTES))
            .orderBy(h, F.xxhash64("t")).limit(SAMPLE_DOCS).collect())
    encoder = UnitEncoder(pattern, library_words(path))
    samples = encoder([r.t for r in rows])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compression(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def pack_image(ids: list, counts: list[int], frames: list[bytes], digest: bytes) -> bytes:
    """magic, dictionary hash, n | doc ids, null flags, token counts, n + 1 frame offsets | frames."""
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
    return b"".join([struct.pack(HEADER, MAGIC, digest, len(ids)), np.array([x or 0 for x in ids], "<i8").tobytes(),
                     np.array([x is None for x in ids], "u1").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Image:
    """Random access to the documents of one file image."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, n = struct.unpack_from(HEADER, data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not an id image, or another dictionary")
        at = struct.calcsize(HEADER)
        self.data, self.n = data, n
        self.ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, "u1", n, at + 8 * n)
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n)
        self.base = at + 13 * n + 8 * (n + 1)
        self.reader = zstandard.ZstdDecompressor(dict_data=_compression(dictionary))

    def tokens(self, k: int) -> bytes:
        """Ids of document ``k`` as little-endian uint32 bytes, reading its frame alone."""
        a, b = int(self.offsets[k]) + self.base, int(self.offsets[k + 1]) + self.base
        return self.reader.decompress(self.data[a:b], max_output_size=4 * int(self.counts[k]))


def write_images(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, bytes]:
    """(table of images, dictionary). Table: part, before (ids of the part before the image), n_docs, n_ids, image."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("t"))
    dictionary = train_dictionary(rows, path, pattern)
    digest = hashlib.sha256(dictionary).digest()
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")

    def run(batches):
        encoder = in_process(("library", path, pattern), lambda: UnitEncoder(pattern, library_words(path)))
        writer = zstandard.ZstdCompressor(level=3, dict_data=_compression(shared.value), write_content_size=True)
        end, part = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        before, ids, counts, frames, size = 0, [], [], [], 0

        def close():
            data = pack_image(ids, counts, frames, digest)
            return pa.RecordBatch.from_pylist([{"part": part, "before": before, "n_docs": len(ids), "n_ids": sum(counts), "image": data}], IMAGES)

        for batch, i, j, raw, offs in ((b, *s) for b in batches for s in steps(b.column(1), ENCODE_BYTES)):
            texts = encoder(string_array(raw, offs))
            for key, tokens in zip(batch.column(0).slice(i, j - i).to_pylist(), texts):
                tokens += end
                ids.append(key)
                counts.append(len(tokens) // 4)
                frames.append(writer.compress(tokens))
                size += len(frames[-1])
                if size >= IMAGE_BYTES:
                    yield close()
                    before, ids, counts, frames, size = before + sum(counts), [], [], [], 0
        if ids:
            yield close()

    images = ordered.mapInArrow(run, "part int, before long, n_docs long, n_ids long, image binary")
    return store(images, "images"), dictionary


IMAGES = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])


def read_images(images: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the images alone."""
    spark = images.sparkSession
    totals = {r.part: r.n for r in images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row per partition
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    shared = spark.sparkContext.broadcast((base, dictionary))

    def run(batches):
        first, words = shared.value
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                image = Image(data.as_py(), words)
                start = first[part] + before + np.cumsum(image.counts, dtype=np.int64) - image.counts
                yield pa.RecordBatch.from_arrays([
                    pa.array(image.ids, pa.int64(), mask=image.null.astype(bool)), pa.array(start, pa.int64()),
                    pa.array(image.counts.astype(np.int64)), pa.array([zlib.crc32(image.tokens(k)) for k in range(image.n)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return images.select("part", "before", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
