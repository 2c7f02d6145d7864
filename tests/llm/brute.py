"""Brute-force versions of the operators' contracts over lists of (doc_id, text)."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

WORD = re.compile("[^\x20\x09-\x0D]+")
BENCH = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(docs):
    out = {}
    for i, t in docs:
        w = WORD.findall(t)
        seen, dup, cover = set(), 0, set()
        count = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        for k in range(len(w) - 7):
            if count[tuple(w[k:k + 8])] > 1:
                cover.update(range(k, k + 8))
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        out[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))
    return out


def bpe(docs):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: e.encode_ordinary(t) for i, t in docs}


def decontam(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = BENCH.findall(low(t or ""))
        for k in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[k:k + 10])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = BENCH.findall(low(t)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k:k + m])]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def unigram(docs):
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in docs}
    c: Counter = Counter()
    for i, x in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(x)
    n, v = sum(c.values()), len(c)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
            for i, x in tokens.items()}


def token_files(docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    at, out = 0, {}
    for i, x in sorted(docs):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def repeats(rows, length=400):
    """(n_bytes, n_removed, n_spans, sha) of each row, in order."""
    texts = [t.encode() for t in rows]
    count = Counter(b[k:k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        edge = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def near(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, label = sorted(sets), {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, x in enumerate(ids):
        for y in ids[:n]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                a, b = root(x), root(y)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def personal(docs):
    from orderlens.llm.pii import KINDS, PATTERNS

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split("."))
                or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15)

    out = {}
    for i, t in docs:
        found = sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], t) if ok(kind, m[0]))
        out[i] = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
    return out
