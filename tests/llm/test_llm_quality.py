"""The quality model covers whole texts of all trusted documents; sharded scoring equals the whole model."""

import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality


def test_scores_equal_the_model_of_all_trusted_text(spark):
    rng = random.Random(5)
    vocabulary = ["the", "water", "of", "reading", "é", "number", "and", "zebra", "quick", "fox"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    tail = " ".join(f"qx{i % 7}jz" for i in range(300))
    texts += ["the water " * 500 + tail, tail, tail, "", None, "a" * 3000, "unseen ÿþ \x00 bytes"]
    rows = [(i, t, "en") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    marks = spark.createDataFrame([(i, 1) for i, *_ in rows if i % len(texts) <= 60], "doc_id bigint, quality int")
    ours = [(t or "",) for i, t, _ in rows if i % len(texts) <= 60 and zlib.crc32(str(i).encode()) % 5]
    assert any(tail in t and len(t) > 5000 for t, in ours)
    whole = quality.kneser_ney(quality.gram_counts(spark.createDataFrame(ours, "text string")))
    by_text = {}
    for r in quality.digest(docs, marks).collect():
        data = np.frombuffer((rows[r["doc_id"]][1] or "").encode(), np.uint8)
        assert r["n_bytes"] == len(data)
        by_text.setdefault(rows[r["doc_id"]][1], set()).add(r["perplexity"])
        if not len(data):
            assert r["perplexity"] is None
            continue
        code = quality.grams(data, np.array([0, len(data)]))
        assert r["perplexity"] == pytest.approx(np.exp(-np.log(whole.probabilities(code)).mean()), rel=1e-9)
    assert all(len(x) == 1 for x in by_text.values())


def test_packed_entries_come_back():
    rng = np.random.default_rng(3)
    for n_grams in (1, 2, 500):
        gram = np.unique(rng.integers(0, 1 << 32, n_grams, dtype=np.uint32))
        per = rng.integers(1, 6, len(gram))
        doc = np.concatenate([np.sort(rng.integers(0, 1 << 16, n)) for n in per]).astype(np.uint16)
        doc[:1], times = 65535 if per[0] == 1 else 0, rng.integers(1, 256, len(doc)).astype(np.uint8)
        got = quality.decode(quality.encode(gram, per, doc, times))
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, (gram, per, doc, times), strict=True))


def test_filter_keeps_every_trusted_document(spark):
    ids = spark.range(0, 4000, 3).withColumnRenamed("id", "doc_id")
    docs = spark.range(-2000, 6000).withColumnRenamed("id", "doc_id").withColumn("_bits", quality.F.lit("clash")).unionByName(spark.createDataFrame([(None, "x"), (3, "again")], "doc_id bigint, _bits string"))
    some = quality.likely(docs.withColumnRenamed("_bits", "text"), ids)
    assert some.columns == ["doc_id", "text"]
    got = [r["doc_id"] for r in some.collect()]
    assert got.count(3) == 2 and {r["doc_id"] for r in ids.collect()} <= set(got) and len(got) < 1500
    assert quality.likely(docs, ids.withColumn("doc_id", quality.F.col("doc_id").cast("string"))).count() == docs.count()
    assert quality.likely(docs.limit(0).withColumnRenamed("_bits", "text"), ids).count() == 0


def test_grams_beyond_the_common_ones_are_scored_by_their_shards(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 400))) for _ in range(50)] + ["the the " * 400, "zz unseen ÿ", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id bigint, text string").repartition(3)
    parts = quality.tables(quality.gram_counts(docs.filter("doc_id < 40")))
    whole = quality.collect(parts)
    for most, full in ((1, False), (60, False), (1 << 18, True)):
        common = quality.head(parts, most)
        assert all(common.all_grams) == all(common.all_contexts) == full
        assert all(len(x) <= max(most, 1 << 16) for x in (*common.gram, *common.context)) and len(common.gram[3]) <= most
        got = {}
        for r in quality.score(docs, parts, most=most).collect():
            got.setdefault(r["row"]["text"] or "", set()).add(r["perplexity"])
        assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(texts)) - 1
        for text, (found,) in got.items():
            data = np.frombuffer(text.encode(), np.uint8)
            code = quality.grams(data, np.array([0, len(data)]))
            sure = common.settles(code)
            assert np.array_equal(common.probabilities(code[sure]), whole.probabilities(code[sure])) and (sure.all() or not full)
            assert found is None if not len(data) else found == pytest.approx(np.exp(-np.log(whole.probabilities(code)).mean()), rel=1e-9)


def test_common_grams_and_trusted_texts_are_not_shuffled(spark):
    texts = ["the water of the river " * 40, "no such letters: ÿþ"]
    parts = quality.tables(quality.gram_counts(spark.createDataFrame([(texts[0],)], "text string")))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.array([0, len(texts[0]), len(data)])
    lost, packed = quality._pack(quality.W.Texts(0, 2, data, bounds), quality.head(parts))
    assert len(lost) == 2 and (lost > 0).all() and not packed
    lost, packed = quality._pack(quality.W.Texts(0, 2, data, bounds), quality.head(parts, 2))
    assert packed
    seen = []
    real, quality.gram_counts = quality.gram_counts, lambda texts, *order: seen.append(texts) or real(texts, *order)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        quality.train(spark.range(200).selectExpr("id AS doc_id", "repeat('some text ', 5) AS text"), spark.range(0, 200, 2).selectExpr("id AS doc_id", "1 AS quality"))
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        quality.gram_counts = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
