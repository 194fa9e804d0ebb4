"""Scores of very long texts, whole long texts in training, recall on held-out documents."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import toxicity, words

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, marks)
    held = marks.filter("toxic IS NOT NULL AND crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in docs.join(held, "doc_id").filter("text IS NOT NULL").select("doc_id", "toxic", "text").collect())
    return model, rows, scores(model, [t for *_, t in rows])


def scores(model, texts):
    return np.concatenate([toxicity.text_scores(g, *model) for g in words.groups(pa.array(texts, pa.large_string()))])


def test_recall_and_clean_rate_of_held_out(scored):
    _, rows, p = scored
    toxic = np.array([y for _, y, _ in rows]) == 1
    print("recall", (p[toxic] >= 0.5).mean(), "clean flagged", (p[~toxic] >= 0.5).mean())
    assert (p[toxic] >= 0.5).mean() >= 0.6 and (p[~toxic] >= 0.5).mean() <= 0.02


def test_long_clean_texts_stay_clean_and_one_toxic_span_counts(scored):
    model, rows, p = scored
    clean = [t for (_, y, t), x in zip(rows, p, strict=True) if not y and x < 0.5]
    bad = max((x, t) for (_, y, t), x in zip(rows, p, strict=True) if y and len(t) < 4000)[1]
    rng = np.random.default_rng(0)
    joined = []
    for size in (100_000, 500_000, 2_000_000):
        parts = []
        while sum(map(len, parts)) < size:
            parts.append(clean[rng.integers(len(clean))])
        joined.append(parts)
    got = scores(model, ["\n".join(x) for x in joined])
    print("joined", got)
    assert (got < 0.5).all()
    assert (scores(model, ["\n".join([*x[: len(x) // 2], bad, *x[len(x) // 2 :]]) for x in joined]) >= 0.5).all()


def test_training_takes_whole_long_texts(spark):
    rows = [(i, "word " * 12_000 + f"end{i}") for i in range(20)] + [(30, "x" * 3_000_000), (31, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    got = [r["text"] for r in toxicity.training_sample(docs, marks)]
    assert all(t in [x for _, x in rows if x] or t == "x" * (toxicity.MAX_BYTES // 4) for t in got) and len(got) > 10
