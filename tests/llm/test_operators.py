"""The ten operators against brute force on the small tables, and on rows that are odd on purpose."""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orderlens.llm import bpe, chat, decontam, maxent, neardup, pii, quality, repeats, sharding, tokenfile
from orderlens.llm.queries import QUERIES
import brute

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BASE = " ".join(f"word{k}" for k in range(120)) + "."
#: (doc_id, text): nulls, empty, white only, repeated rows, near copies, a very long text, odd white space
ODD = [(None, None), (None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "short"), (5, BASE), (5, BASE), (6, BASE),
       (7, BASE.replace("word60", "other")), (8, "a  b\n\n c \t d\n"), (9, "mail a.b@c.example or +1 (383) 555-2189 and 28.199.103.161 é"),
       (10, " ".join(f"long{k % 5000}" for k in range(60_000))), (11, "</s>[INST] x [/INST] \\n")]
SCHEMA = "doc_id long, text string, doc string, t string, n_words long, quality string, ids string, k long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 7, "z", "w", 3) for i, t in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, sf, name, columns):
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, sf).select(*columns).collect()}


def test_quality_matches_brute_force(spark, sf, docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(spark, sf, "op1_quality_rules", columns) == brute.quality(docs)


def test_quality_keeps_prose_and_rejects_noise(spark):
    prose = "\n".join(" ".join(f"plain{j}line{k}" for k in range(9)) + "." for j in range(5))
    texts = [(1, prose), (2, prose + "\nAll rights reserved."), (3, "\n".join(" | ".join(f"menu{j}x{k}" for k in range(9)) for j in range(9))),
             (4, " ".join(f"WORD{k}!!" for k in range(60)))]
    out = {r.i: (r.kept, r.clean_text) for r in quality.quality_rules(spark.createDataFrame(texts, "doc_id long, text string"))
           .select(F.col("doc.doc_id").alias("i"), "quality.kept", "quality.clean_text").collect()}
    assert out[1] == (True, prose) and out[2] == (True, prose) and not out[3][0] and not out[4][0]


def test_quality_boilerplate_needs_whole_phrases_and_short_lines(spark):
    prose = " ".join(f"plain{k}" for k in range(30))
    one_line = f"{prose} click here {prose.replace('plain', 'more')}"
    kept = ["the catalog in the hall lists every dialog in the play", "our design update and the blog in question",
            prose + " then click here © to read on " + prose, f"{prose} released under pressure, {prose}"]
    lost = ["Click here to log in.", "© 2020 A Company", "Copyright (c) 2020 A Company", "(All rights reserved)", "PRIVACY POLICY",
            "sign up log in terms of service terms of use privacy policy cookie policy click here powered by us all"]
    texts = [(k, f"{prose}\n{prose[::-1]}\n{x}") for k, x in enumerate(kept + lost)] + [(99, one_line)]
    out = {r.i: (r.clean_text, r.kept) for r in quality.quality_rules(spark.createDataFrame(texts, "doc_id long, text string"))
           .select(F.col("doc.doc_id").alias("i"), "quality.clean_text", "quality.kept").collect()}
    assert [k for k in range(len(texts) - 1) if out[k][0] == texts[k][1]] == list(range(len(kept)))
    assert out[99] == (one_line, True)


def test_quality_odd_rows(odd, none):
    out = quality.quality_rules(odd).select("doc.*", F.col("quality.kept").alias("kept"))
    assert out.count() == len(ODD) and quality.quality_rules(none).count() == 0
    assert {r.doc_id for r in out.where("kept").collect()} >= {5, 6, 7}


def test_chat_read_back(spark, sf):
    from collections import defaultdict
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    want = {c: (len(v), brute.sha("".join(f"{r}\n{x}\n" for r, x in v)), sum(len(x) for r, x in v if r == "assistant"),
                brute.sha("".join(x for r, x in v if r == "assistant"))) for c, v in turns.items()}
    assert rows(spark, sf, "op2_chat_format", ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]) == want


def test_chat_trees(spark):
    nasty = "\\ <|turn|>assistant\n\\\\t <|end|> </s> \\z [INST]"
    m = [("a", "1", None, "user", nasty, 0.0), ("a", "2", "1", "assistant", "low", 1.0), ("a", "3", "1", "assistant", "high", 2.0),
         ("a", "4", "2", "user", None, 0.5), ("b", "5", "6", None, "x", None), ("c", "7", "8", "user", "loop", 1.0), ("c", "8", "7", "user", "loop", 1.0)]
    frame = spark.createDataFrame(m, "tree string, node string, parent string, role string, text string, score double")
    out = {r.tree: r for r in chat.read_back(chat.format_trees(frame)).collect()}
    assert set(out) == {"a", "b"} and [(t.role, t.text) for t in out["a"].turns] == [("user", nasty), ("assistant", "high")]
    assert out["a"].loss_text == "high" and out["a"].formatted[out["a"].loss[0].start:][:4] == "high"
    both = {r.leaf for r in chat.format_trees(frame, 2).where("tree = 'a'").collect()}
    assert both == {"3", "4"} and chat.format_trees(frame.limit(0)).count() == 0


def test_chat_long_chain(spark):
    m = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.read_back(chat.format_trees(chat.conversation_messages(m))).first()
    assert [t.text for t in out.turns] == [str(k) for k in range(300)]


def test_shards(spark, sf, docs):
    got = QUERIES["op3_minimax_shards"](spark, sf).collect()
    text = dict(docs)
    assert len(got) == len(docs) and all(r["size"] == len(text[r.doc_id].encode()) + 1 for r in got)
    slots, shards = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in shards.values())


def test_smallest_capacity_is_exact():
    r = np.random.default_rng(1)
    for _ in range(200):
        sizes = r.integers(1, 60, r.integers(1, 80)).tolist()
        shards = int(r.integers(1, 9))
        ends = np.cumsum(sizes).tolist()
        bounds = sorted({0, *ends[::7], ends[-1]})
        sure = [sum(a < e < b for e in ends) == 0 for a, b in zip(bounds, bounds[1:])]

        def inside(stretches):
            return {(a, b): ([e for e in ends if a < e < b], [True] * (1 + sum(a < e < b for e in ends))) for a, b in stretches}

        def needed(capacity):
            n, held = 1, 0
            for s in sizes:
                n, held = (n + 1, s) if held + s > capacity else (n, held + s)
            return n

        best = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)
        assert sharding.plan_cuts(bounds, sure, shards, inside)[0] == best


def test_shards_odd_rows(odd, none):
    out = sharding.assign_shards(odd).collect()
    assert len(out) == len(ODD) and len({r.shard for r in out if r["size"] == len(BASE) + 1}) <= 2
    assert sharding.assign_shards(none).count() == 0


def test_bpe_matches_library(spark, sf, docs):
    ids = brute.bpe(docs)
    want = {i: (len(x), brute.sha(",".join(map(str, x))), brute.sha(t)) for (i, t), x in zip(docs, (ids[i] for i, _ in docs))}
    assert rows(spark, sf, "op4_byte_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want


def test_bpe_odd_rows(spark, odd, none):
    want = brute.bpe([(k, t or "") for k, (_, t) in enumerate(ODD)])
    out = bpe.encode(odd, RANKS, PATTERN).select("doc.text", "ids", bpe.decode(F.col("ids"), RANKS).alias("back")).collect()
    by_text = {t or "": want[k] for k, (_, t) in enumerate(ODD)}
    assert len(out) == len(ODD) and all(by_text[r.text or ""] == r.ids and bytes(r.back) == (r.text or "").encode() for r in out)
    assert bpe.encode(none, RANKS, PATTERN).count() == 0


def test_bpe_fold_of_words_with_higher_order_functions(spark):
    words = [" the", "erblanthou", " Öffentlichkeit", "\n", "zzzzzz", "x", " éléonore"]
    got = {r.word: r.ids for r in bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()}
    ranks = bpe.read_ranks(RANKS)
    table = bpe.MergeTable(ranks)
    for w, fold in zip(words, table(words)):
        want = bpe.merge_word(w.encode(), ranks)
        assert got[w] == want == np.frombuffer(fold, "<u4").tolist()
    long = "ab" * 2000
    assert bpe.merge_word(long.encode(), ranks) == brute.bpe([(0, long)])[0]


def test_decontamination(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(spark, sf, "op5_decontaminate", columns) == brute.decontam(docs, items)


@pytest.mark.parametrize("slice_size", [200_000, 3])
def test_decontamination_odd_rows(spark, odd, none, slice_size):
    items = [(1, None), (2, ""), (3, "Word5 WORD6"), (4, "short"), (5, " ".join(f"word{k}" for k in range(40, 55))), (5, "é"), (None, "no id here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontam([(k, t or "") for k, (_, t) in enumerate(ODD)], [(i if i is not None else "null", t) for i, t in items if i is not None])
    out = decontam.find_benchmark(odd, bench.where("item_id is not null"), slice_size=slice_size).select("doc.text", "n_words", "n_hit", F.size("items").alias("n")).collect()
    by_text = {t or "": want[k][:3] for k, (_, t) in enumerate(ODD)}
    assert all(by_text[r.text or ""] == (r.n_words, r.n_hit, r.n) for r in out) and len(out) == len(ODD)
    assert decontam.find_benchmark(none, bench).count() == 0 and decontam.find_benchmark(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_language_model(spark, sf, docs):
    want, got = brute.unigram(docs), QUERIES["op6_maxent_score"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution():
    m = maxent.Model([(k + 1, 1000 - k) for k in range(maxent.HEAD)], {b: (50, 7) for b in range(maxent.BUCKETS)})
    m.class_weights += np.random.default_rng(0).normal(0, 1, m.class_weights.shape).astype(np.float32)
    total = 0.0
    for out in range(maxent.OUTPUTS):
        total += 10 ** m.score(np.array([3, 5, out]), np.array([0, 3]))[2]
    assert total == pytest.approx(1, abs=1e-3)


def test_language_model_histories_are_words():
    """Two rare words of the same first bytes are different histories, and what follows them is learned."""
    text = " ".join(["xxrareone left", "xxraretwo right"] * 400)
    h, bucket, begin = maxent.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    words, count = np.unique(h.view(np.int64), return_counts=True)
    own = [int(x) for x in h[[1, 3]].view(np.int64)]  # left, right: the only words of their own
    m = maxent.Model([(w, int(c)) for w, c in zip(words, count) if w in own], {int(bucket[0]): (800, 2)})
    assert bucket[0] == bucket[2]
    state = [np.zeros_like(m.class_weights), np.zeros_like(m.word_weights)]
    for _ in range(20):
        m.learn(m.outputs(h, bucket), h, begin, np.arange(len(h)), state)
    only = h[[0, 1, 0, 3]], bucket[[0, 1, 0, 3]], np.array([0, 2, 4])  # each word after xxrareone alone
    s = m.score(m.outputs(*only[:2]), only[2], only[0])
    assert s[1] > s[3] + 0.3


def test_language_model_size_follows_the_corpus():
    small, large = maxent.sizes(5_000), maxent.sizes(50_000_000)
    assert small == (maxent.CLASS_SIZE, maxent.CLASS_ROWS) and large[0] ** 2 > 4 * maxent.OUTPUTS and large[1] > 10 * maxent.CLASS_ROWS
    m = maxent.Model([(k + 1, 5000 - k) for k in range(20 * 20 - maxent.BUCKETS)], {b: (50, 7) for b in range(maxent.BUCKETS)}, 20, 1 << 15)
    assert m.class_weights.shape == (1 << 15, 20) and m.word_weights.shape == (1 << 16, 20)
    m.class_weights += np.random.default_rng(0).normal(0, 1, m.class_weights.shape).astype(np.float32)
    assert sum(10 ** m.score(np.array([3, 5, out]), np.array([0, 3]))[2] for out in range(400)) == pytest.approx(1, abs=1e-3)


def test_language_model_learns_from_every_position():
    begin = np.array([0, 1, 1, 8, 13, 2013])
    seen = np.concatenate([maxent.positions(begin, k) for k in range(maxent.ROUNDS)])
    assert sorted(seen) == list(range(2013))


def test_language_model_sums_gradients_by_row():
    r = np.random.default_rng(8)
    at, g = r.integers(0, 50, (300, 4)), r.normal(0, 1, (300, 7))
    at[:40] = 3  # a frequent feature
    want = np.zeros((50, 7))
    np.add.at(want, at.reshape(-1), np.repeat(g, 4, axis=0))
    row, total = maxent._sum_by_row(at, g)
    assert (row == np.unique(at)).all() and np.allclose(total, want[row], atol=1e-12)


def test_language_model_sends_no_more_than_its_text(spark):
    """Each learning task sends changes of the model's size: the larger the model, the fewer tasks."""
    for n_words, n_train in ((400_000, 22_000_000), (2_000_000, 111_000_000), (90_000_000, 6_600_000_000)):
        side, n_rows = maxent.sizes(n_words)
        model = maxent.Model.of({"class_weights": np.empty((n_rows, side), np.float32), "word_weights": np.empty((2 * n_rows, side), np.float32)})
        n, weights = maxent.learners(n_train, model), 3 * n_rows * side
        assert n == maxent.LEAST_LEARNERS or n * weights <= n_train / maxent.SENT_TOKENS < (n + 1) * weights
    texts = spark.createDataFrame([(f"the sea {i} on the shore",) for i in range(200)], "t string").repartition(6).localCheckpoint()
    few, all_ = (maxent.train(texts, maxent.Model([], {}), rounds=1, most=n) for n in (1, None))
    one = maxent.train(texts.coalesce(1), maxent.Model([], {}), rounds=1)
    assert np.allclose(few.class_weights, one.class_weights) and not np.allclose(few.class_weights, all_.class_weights)


def test_language_model_rounds_leave_no_shuffle_files(spark):
    import time

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for f in files.getAllFiles().mkString("|").split("|") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}

    texts = spark.createDataFrame([(f"the sea {i} on the shore",) for i in range(200)], "t string").repartition(4)
    texts = texts.select("t").localCheckpoint()
    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(key, None)
    model = maxent.train(texts, maxent.Model([], {}))
    assert np.abs(model.class_weights).sum() > 0 and spark.conf.get(key, None) == set_before
    for _ in range(100):  # Spark removes them in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before


def test_language_model_odd_rows(odd, none):
    assert maxent.score_documents(odd).count() == len(ODD) and maxent.score_documents(none).count() == 0


def test_token_files(spark, sf, docs):
    assert rows(spark, sf, "op7_token_files", ["doc_id", "start", "n_tokens", "ids_crc32"]) == brute.token_files(docs)


def test_units_are_numbered_by_arrow_and_words_kept_once():
    import public_tokenizers
    import pyarrow as pa

    from orderlens.llm.bpe import UnitEncoder

    asked = []

    def spell(words):
        asked.extend(words)
        return [w.encode("utf-32-le") for w in words]

    encoder = UnitEncoder(public_tokenizers.PATTERN, spell)
    texts = ["on the sea, the sea", "", " the\nsea the, \n", "x\ty  the sea\n", "\n\n a1 b's the", "\u00e9t\u00e9 sea, on"]
    got = encoder(pa.array(texts))
    assert [x.decode("utf-32-le") for x in got] == texts and encoder(texts) == got
    # a word of letters is kept as its unit alone
    assert encoder.units["sea"].decode("utf-32-le") == " sea" and encoder.units["sea,"].decode("utf-32-le") == " sea,"
    fresh = UnitEncoder(public_tokenizers.PATTERN, spell)
    asked.clear()
    fresh(["0 sea the sea, the sea"])
    assert sorted(asked) == [" sea", " the", ",", "0"] and set(fresh.words) == {",", "0"}
    assert fresh(["0 the sea"] * 3) == [fresh(["0 the sea"])[0]] * 3


def test_token_files_odd_rows(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    images, dictionary = tokenfile.write_images(odd, path, PATTERN)
    out = sorted(tokenfile.read_images(images, dictionary).collect(), key=lambda r: r.start)
    assert len(out) == len(ODD) and [r.doc_id for r in out[:2]] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    with pytest.raises(ValueError):
        tokenfile.Image(bytes(images.first().image), dictionary + b"x")
    assert tokenfile.read_images(*tokenfile.write_images(none, path, PATTERN)).count() == 0


def test_repeated_substrings(spark, sf, docs):
    want = dict(zip([i for i, _ in docs], brute.repeats([t for _, t in docs])))
    assert rows(spark, sf, "op8_repeated_substrings", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want


def test_repeated_substrings_odd_rows(spark, odd, none):
    r = np.random.default_rng(5)
    part = "".join(r.choice(list("abcdé "), 900))
    texts = [t for _, t in ODD if t is None or len(t) < 10_000] + [part, "x" + part[100:700], part[300:800] + part[300:800], "a" * 1000, part[:399], "b" * 400, "b" * 401]
    frame = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    base, changed = repeats.repeated_substrings(frame)
    out = base.join(changed, ["k", "h"], "left").select("n_bytes", F.coalesce("n_removed", F.lit(0)), F.coalesce("n_spans", F.lit(0)),
                                                        F.coalesce(F.sha2("kept", 256), "sha")).collect()
    assert sorted(map(tuple, out)) == sorted(brute.repeats([t or "" for t in texts]))
    base, changed = repeats.repeated_substrings(none)
    assert base.count() == 0 and changed.count() == 0


def test_personal_data_base(spark, sf, docs):
    want = brute.personal(docs)
    got = {r.doc_id: r for r in QUERIES["op9_personal_data"](spark, sf).collect()}
    assert all(got[i].base_sha256 == brute.sha(",".join(x)) and set(x) <= set(got[i].spans.split(",") if got[i].spans else []) for i, x in want.items())


def test_personal_data_odd_rows_and_mask(odd, none):
    out = pii.find_personal_data(odd).select("doc.doc_id", "spans", pii.mask(F.col("doc.text"), F.col("spans")).alias("masked")).collect()
    assert len(out) == len(ODD)
    assert next(r.masked for r in out if r.doc_id == 9) == "mail [EMAIL] or [PHONE] and [IP] é"
    assert pii.find_personal_data(none).count() == 0


def test_tagger_gradients_and_learning():
    r = np.random.default_rng(0)
    tagger = pii.Tagger()
    kinds, tags = r.integers(0, pii.SYMBOL_COUNT, (3, 6)), r.integers(0, len(pii.TAGS), (3, 6))
    loss, grads = tagger.gradients(kinds, tags)
    for name, at in (("move", (1, 2)), ("out", (3, 4)), ("fh", (2, 5)), ("bx", (1, 7)), ("embed", (int(kinds[0, 0]), 1))):
        p, step = tagger.p[name], 1e-5
        p[at] += step
        up = tagger.gradients(kinds, tags)[0]
        p[at] -= 2 * step
        down = tagger.gradients(kinds, tags)[0]
        p[at] += step
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)
    texts = [f"ab{k} mail u{k}@host{k % 7}.example end +1 (38{k % 10}) 555-21{k % 90 + 10} x" for k in range(600)]
    windows, gold = [], []
    for t in texts:
        y = np.zeros(pii.WINDOW + len(t), np.int64)
        for a, b, k in pii.base_spans(t):
            y[a:b], y[a] = 2 + 2 * k, 1 + 2 * k
        windows.append(pii._cut(pii.symbols(t), np.array([0]))[0])
        gold.append(y[:pii.WINDOW])
    tagger = pii.Tagger()
    tagger.fit(np.stack(windows[:500]), np.stack(gold[:500]), epochs=12)
    assert (tagger.decode(np.stack(windows[500:]))[0] == np.stack(gold[500:])).mean() > 0.97


def test_tagger_skips_viterbi_only_where_nothing_is_tagged():
    r = np.random.default_rng(4)
    tagger = pii.Tagger()
    tagger.p = {k: (3 * v).astype(np.float32) for k, v in tagger.p.items()}
    tagger.p["move"] = r.normal(0, 0.3, tagger.p["move"].shape).astype(np.float32)
    for lift in (0, 4, 8, 16):
        tagger.p["out_b"][0] = lift
        kinds = r.integers(0, pii.SYMBOL_COUNT, (400, 20))
        e = tagger.scores(kinds)
        assert np.allclose(e.transpose(1, 0, 2), tagger.emissions(kinds)[0], atol=1e-4)
        skipped = tagger.outside(e)
        tagger.outside = lambda e: np.zeros(e.shape[1], bool)
        assert not (tagger.decode(kinds)[0][skipped] > 0).any()
        del tagger.outside
    assert skipped.any()


def test_tagger_decodes_only_open_parts_exactly():
    """The parts that Viterbi runs on give the best path of the whole window, and are few where little is tagged."""
    r = np.random.default_rng(4)
    for lift, most in ((0, 1), (3, 1), (9, 0.1)):
        tagger = pii.Tagger()
        tagger.p = {k: (3 * v).astype(np.float32) for k, v in tagger.p.items()}
        tagger.p["move"] = r.normal(0, 1, tagger.p["move"].shape).astype(np.float32)
        tagger.p["out_b"][0] = lift
        kinds = r.integers(0, pii.SYMBOL_COUNT, (300, 40))
        e = tagger.scores(kinds)
        best, back = e[0].astype(np.float64), []
        for x in e[1:]:
            s = best[:, :, None] + tagger.p["move"]
            back.append(s.argmax(1))
            best = s.max(1) + x
        want = [best.argmax(1)]
        for x in back[::-1]:
            want.append(x[np.arange(300), want[-1]])
        want = np.stack(want[::-1], 1)
        assert (tagger.decode(kinds)[0] == want).all()
        _, start, end = tagger.open_parts(e)
        assert (end - start).sum() <= most * kinds.size and (want > 0).sum() <= (end - start).sum()


def test_tagger_scores_little_more_than_the_text():
    """Overlap and padding of the windows that are scored."""
    seen = []

    class Counting(pii.Tagger):
        def decode(self, kinds):
            seen.append(kinds.size)
            return super().decode(kinds)

    texts = ["a text of some words " * k for k in range(1, 240)]
    assert pii.tagged(Counting(), texts[:2]) is not None
    seen.clear()
    tagger = Counting()
    tagger.p["out_b"][0] = 50
    pii.tagged(tagger, texts)
    size = sum(map(len, texts))
    assert size <= sum(seen) <= 1.25 * size


def test_personal_data_beyond_the_patterns(spark):
    """Held-out forms that the base patterns miss, put into prose that the tagger has not seen."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null")
    tagger = pii.train_tagger(rows.where("doc_id % 2 = 0").select(F.col("text").alias("t")))
    prose = [x.text[:300] for x in rows.where("doc_id % 2 = 1 and n_chars > 400 and not text rlike '[0-9@]'").orderBy("doc_id").limit(240).collect()]
    r = np.random.default_rng(77)
    base = {"email": "kim.lee@post.example.org", "ip": "10.20.30.40", "card": "4111111111111111", "phone": "+1 (383) 555-2189"}
    planted, want = [], {}
    for d, text in enumerate(prose):
        at = text.index(" ", 100) + 1
        kind = pii.KINDS[d % 4]
        new = pii.rewritten(kind, base[kind], r, ["anna", "bruno", "harbor", "winter"]) if d < 160 else pii.harmless(r, ["anna", "bruno", "harbor", "winter"])
        if d < 160:
            want[d] = f"{kind}:{at}:{at + len(new)}"
        planted.append((d, text[:at] + new + " " + text[at:]))
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {x.doc_id: (x.base, x.all) for x in pii.find_personal_data(df, tagger=tagger).select(
        "doc.doc_id", pii.spans_text(F.col("base")).alias("base"), pii.spans_text(F.col("spans")).alias("all")).collect()}
    found = {(d, x) for d, (_, a) in got.items() for x in a.split(",") if x}
    missed = [d for d, x in want.items() if x not in got[d][0].split(",")]  # few forms are base matches too
    hit = [d for d in missed if (d, want[d]) in found]
    wrong = [(d, x) for d, x in found if x not in got[d][0].split(",") and want.get(d) != x]
    print("recall", len(hit), len(missed), "wrong", len(wrong))
    assert len(missed) > 140 and len(hit) >= 0.7 * len(missed) and len(wrong) <= 0.15 * len(hit)


def test_near_duplicates(spark, sf, docs):
    assert rows(spark, sf, "op10_near_duplicates", ["doc_id", "n_shingles", "component_id", "kept"]) == brute.near(docs)


def test_near_duplicates_filter_loses_no_small_sets():
    r = np.random.default_rng(3)
    for n in (4, 8, 20):  # a quarter of the shingles is missing: exactly 75 %
        full = r.integers(0, 1 << 63, (1500, n), dtype=np.uint64)
        left, right = (neardup.sketch(np.sort(x, axis=1).reshape(-1), np.arange(0, x.size + 1, x.shape[1]))[3] for x in (full, full[:, :3 * n // 4]))
        assert neardup._agree(left, right).all()
    other = neardup.sketch(np.sort(r.integers(0, 1 << 63, (50, 200), dtype=np.uint64), axis=1).reshape(-1), np.arange(0, 50 * 200 + 1, 200))[3]
    assert not neardup._agree(other[:25], other[25:]).any()


def test_near_duplicates_chain_and_odd_rows(spark, odd, none):
    words = [f"w{k}" for k in range(400)]
    chain = []
    for k in range(12):  # each text shares enough with the next one only
        words = [*words[22:], *(f"c{k}_{j}" for j in range(22))]
        chain.append((100 + k, " ".join(words)))
    frame = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()} == brute.near(chain)
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.doc_id in (5, 6, 7)} == {5}
    assert all(r.component_id is None for r in out if r.doc_id is None) and neardup.near_duplicates(none).count() == 0


def test_near_duplicates_with_repeated_and_missing_ids(spark, sf):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    rows = [(1, a), (1, b), (2, a.replace("a100", "other")), (3, b.replace("b100", "other")), (None, a), (None, "alone here"), (None, "alone here"),
            (None, ""), (None, None), (4, ""), (1, a), (7, "x"), (7, "y")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(frame).collect()))
    assert got == sorted([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True), (7, 7, True), (7, 7, True)] + [(0, 0, True)] * 5)
    kept = corpus_pipeline.near_duplicate_stage(spark, frame, sf)
    # one row of each group, texts without words as they are
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, a), (1, b), (0, "alone here"), (0, ""), (0, ""), (4, ""), (7, "x"), (7, "y")])
    assert kept.columns == frame.columns


def test_pipeline(spark, sf, odd, none, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "ids", "n_tokens"}
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    for frame in (odd, none):
        frame = frame.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, frame, sf).cache()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert done.columns == columns, name
                frame = done
        assert done.count() == frame.count()


def test_queries_are_plain_json_names():
    assert json.dumps(sorted(QUERIES)) and len(QUERIES) == 13
