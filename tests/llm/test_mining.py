"""URL filters, hard negatives and phrases against brute force, on odd rows included."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import hardneg, phrases, urltrie

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.net/en/1", "http://a.example.net/en", "http://example.net/en/", "http://net/", "http://net",
        "http://badexample.net/en/", "x://y.example.com/de/3?u=http://z.net/", "http://example.com/fr/", "http://www.org/fr/a//b#q", "http://org:80/fr/",
        "http://a..net//", "http://.net/", "http://example.net?/en/", "http://example.net/EN/", "://deep.sub.example.com/de/", "http://x.org/english",
        "http://example.net/en/" + "long/" * 20000, "http://" + "l." * 5000 + "net/", "http://é.net/ü/", "http://x.org/fr"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("x.org", "/eng", "block"),
         ("x.org", None, "allow"), ("Example.NET", "/en/", "block"), (None, "/", "block"), ("", "/", "block"), ("lost.net", "/", None), ("é.net", "/ü", "allow")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules: dict = {}
    for h, p, v in RULES:
        if h and v:
            key = (h.lower(), p or "")
            rules[key] = max(rules.get(key, ""), v)
    fits = [(h.count("."), len(p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("slice_bytes", [urltrie.SLICE_BYTES, 20])
def test_urls(spark, slice_bytes):
    rows = [(k, u, "h", "p", "r", "v", "b") for k, u in enumerate(URLS + URLS[:6])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, best string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urltrie.judge_urls(pages, rules, slice_bytes=slice_bytes)
    assert out.columns == ["page", "host", "path", "rule", "verdict"]
    got = {r.page.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {r[0]: judge(r[1]) for r in rows}
    assert urltrie.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urltrie.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


# --------------------------------------------------------------------------- hard negatives

def negatives(rows, every, k_positive=5, k_negative=10):
    """rows: (id, label, vector); anchors have ids divisible by ``every``."""
    known = [(i, t, [math.floor(256 * x) for x in v]) for i, t, v in rows
             if None not in (i, t, v) and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for i, t, v in known:
        if i % every or (i, t, tuple(v)) in done:
            continue
        done.add((i, t, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, u) for j, u, w in known if j != i and len(w) == len(v))
        for rank_p, (p, j, _) in enumerate([s for s in scored if s[2] == t][:k_positive], 1):
            fit = [s for s in scored if s[2] != t and 30 * -p <= 100 * -s[0] <= 90 * -p][:k_negative]
            out += [(i, j, rank_p, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(rows, **options):
    out = hardneg.mine_hard_negatives(rows, F.col("vec_id") % 10 == 0, F.col("label"), **options)
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    centre = r.normal(size=(4, 8))
    rows = [(k, 0 if k % 3 else int(r.integers(4)), [float(x) for x in centre[k % 4] * (k % 2) + r.normal(size=8)]) for k in range(400)]
    rows += [(1000 + k, k % 2, rows[20][2]) for k in range(40)]  # many equal vectors, ties by id
    rows += [(5, 0, rows[5][2]), (30, rows[30][1], rows[30][2]), (30, 2, rows[31][2])]  # repeated rows, one id on two rows
    rows += [(2000, 1, None), (2010, None, rows[1][2]), (None, 1, rows[1][2]), (2020, 1, [1.0] * 7 + [float("nan")]), (2030, 1, [float("inf")] * 8),
             (2040, 1, [1.0] * 7 + [None]), (2050, 1, [1.0, 2.0]), (2060, 0, [2.0, 2.0]), (2070, 1, [1.5, 1.0]), (2080, 1, []), (2090, 2, []), (2100, 1, []),
             (-10, 0, rows[2][2])]
    return rows


SCHEMA = "vec_id long, label long, embedding array<double>, id string, window string, score string, anchor string"


def test_hard_negatives(spark, vectors):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in vectors], SCHEMA).repartition(5)
    expected = negatives(vectors, 10)
    assert len(expected) > 1000 and mined(frame) == expected
    assert mined(frame, block=4, slice_bytes=1500) == expected  # several slices of small trees
    assert mined(frame.limit(0)) == [] and mined(frame.where("vec_id = 2050")) == []


def test_hard_negatives_beyond_doubles(spark):
    r = np.random.default_rng(6)
    rows = [(k, k % 3, [float(x) * 2.0 ** 21 for x in r.normal(size=3)]) for k in range(60)]
    assert max(abs(256 * x) for _, _, v in rows for x in v) ** 2 * 3 > hardneg.EXACT
    frame = spark.createDataFrame([(*x, "", "", "", "") for x in rows], SCHEMA)
    assert mined(frame, block=5) == negatives(rows, 10) != []


def test_spanning_tree_bounds_hold():
    r = np.random.default_rng(7)
    x, y = np.floor(256 * r.normal(size=(50, 16))), np.floor(256 * r.normal(size=(200, 16)))
    order, parent, edge = hardneg.spanning_tree(x)
    assert sorted(order) == list(range(50)) and parent[0] == -1 and (parent[1:] < np.arange(1, 50)).all() and (parent[1:] >= 0).all()
    scores = y @ x[order].T
    gap = np.abs(scores[:, 1:] - scores[:, parent[1:]])
    assert (gap <= edge[1:] * np.linalg.norm(y, axis=1)[:, None] * (1 + 1e-9)).all()
    # only rows that can matter are scored again: with known parents, close children need none
    b = hardneg.Block("a", list(range(50)), x[order], parent.tolist(), edge.tolist(), [[(1e7, 2e7)]] * 50, False)
    b.meet(np.arange(200), y, np.linalg.norm(y, axis=1), 10)
    assert all(len(s) == 0 for per in b.best for s, _ in per)


# --------------------------------------------------------------------------- phrases

def collocations(docs, min_count, top=2000, longest=4, share=80):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {g: a for g, a in c.items() if len(g) > 1 and a >= min_count}
        around = Counter()
        for g, a in often.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    around[g[i:i + m]] = max(around[g[i:i + m]], a)
        rows = []
        for g, a in often.items():
            score, _, left, right = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            if not (g in around and 100 * around[g] >= share * a):
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(8)
    words = ["New", "york", "city", "the", "of", "é", "日本", "a-b", "x", "\u00a0", "UNIT"] + [f"w{k}" for k in range(40)]
    docs = []
    for k in range(200):
        w = [words[int(j)] for j in r.zipf(1.3, 60) % len(words)]
        docs.append((["en", "fr", None, "en"][k % 4], "".join(x + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", ";"]) for x in w)))
    docs += [("en", None), (None, ""), ("", "one two one two one two one two"), ("en", ". , \n"), ("fr", "New york city " * 4000), ("en", "same same same same same"),
             ("en", docs[0][1]), ("en", docs[0][1])]
    return docs


@pytest.mark.parametrize("chunk,held", [(phrases.CHUNK, phrases.HELD), (700, 100)])
def test_collocations(spark, texts, monkeypatch, chunk, held):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "ROW_WORDS", 1 + held // 10)
    monkeypatch.setattr(phrases, "SHARD", held)
    frame = spark.createDataFrame([(a, b, 1, "w", "g") for a, b in texts], "lang string, text string, f long, word string, g string").repartition(3)

    def run(**options):
        return sorted(tuple(r) for r in phrases.collocations(frame, chunk=chunk, **options).collect())

    assert run(min_count=4) == collocations(texts, 4)
    assert run(min_count=2, longest=3, top=7, share=50) == collocations(texts, 2, 7, 3, 50)
    if held > 100:
        assert phrases.collocations(frame.limit(0)).count() == 0


def test_quotient_filters_lose_nothing():
    r = np.random.default_rng(9)
    for bits, more in ((2, 0), (5, 0), (34, 0), (34, 17), (34, 34), (62, 62)):
        a, z = (r.integers(0, 1 << b, 3000, dtype=np.uint64) if b else np.zeros(3000, np.uint64) for b in (bits, more))
        a[1000:], z[1000:] = a[0], z[0]  # one very frequent entry
        p = phrases.Permutation(bits, more)
        s, t = p.scatter(a, z)
        assert all((x == y).all() for x, y in zip(p.restore(s, t), (a, z)))
        whole = Counter(zip(s.tolist(), t.tolist()))
        for shard_bits in (0, 2):
            shards: dict = {}
            for part in (slice(0, 1100), slice(1100, 1101), slice(1101, None)):  # three filters, packed and merged shard by shard
                for k, f in phrases.QuotientFilter.of(s[part], t[part], None, bits, more).split(shard_bits):
                    shards.setdefault(k, []).append(phrases.QuotientFilter.unpack(f.pack()))
            found: Counter = Counter()
            for k, filters in shards.items():
                m = phrases.QuotientFilter.merge(filters)
                found.update({(int(x) | k << (bits - shard_bits), int(y)): int(c) for x, y, c in zip(m.a, m.z, m.count)})
            assert found == whole


def test_frequent_pairs_are_all_in_the_bitmap(spark):
    pairs = [("en", [k, 3 * k]) for k in range(1, 3000)] + [("fr", [7, k]) for k in range(1, 500)]
    bitmap = phrases.bitmap_of(spark.createDataFrame(pairs, "lang string, g array<int>"), 17)
    for lang in ("en", "fr"):
        own = np.array([g[0] << 17 | g[1] for t, g in pairs if t == lang], np.uint64)
        assert phrases.look_up(bitmap, lang, own).all()
    other = np.arange(10 ** 9, 10 ** 9 + 5000, dtype=np.uint64)
    assert phrases.look_up(bitmap, "en", other).mean() < 0.05


def test_scores_pass_64_bits(spark):
    counted = spark.createDataFrame([("en", [1, 2], 9 * 10 ** 18)], "lang string, g array<int>, f long")
    single = spark.createDataFrame([("en", [1], 9 * 10 ** 18 + 5), ("en", [2], 9 * 10 ** 18 + 7)], "lang string, g array<int>, f long")
    assert phrases.score_phrases(counted, single).first().score == 2000000 * 9 * 10 ** 18 // (18 * 10 ** 18 + 12)
