"""Near-duplicates, embeddings, personal data, the pipeline and the registered queries."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import components, decontaminate, embedding_dedup, hnsw, mix, near_duplicates, private_data, queries, records, toxicity, words

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


# components


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(60)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(110)], "none": []}[kind]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == classes([(u, v) for u, v in edges if u != v])


def classes(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


# near-duplicates


def bag(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """Smallest doc_id by row number, with every pair compared."""
    bags = [bag(t) for _, t in rows]
    links = []
    for (i, a), (j, b) in itertools.combinations(enumerate(bags), 2):
        if (not a and not b and rows[i][1] and rows[i][1] == rows[j][1]) or (a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values())):
            links.append((i, j))
    top = classes(links)
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[top.get(i, i)].append(doc_id)
    return {i: min((x for x in ids[top.get(i, i)] if x is not None), default=None) for i in range(len(rows))}


def near_rows(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(None, "null id text one two three"), (1, None), (2, ""), (3, "###"), (4, "###"), (5, "one two"), (6, "One, TWO!"), (7, "two one"), (8, "a a a a a a a a"), (9, "a a a a a a a a"), (9, "a a a a a a a a"), (10, "a a a a a a a a a a a a a a")]
    n = 100
    for size, copies, edits in ((60, 30, 2), (60, 30, 8), (200, 12, 10), (400, 5, 1)):
        original = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            w = list(original)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    passage = [rng.choice(vocabulary) for _ in range(50)]
    for _ in range(60):  # a shared passage is no near copy
        rows.append((n, " ".join(passage + [rng.choice(vocabulary) for _ in range(30)])))
        n += 1
    return rows


@pytest.mark.parametrize("small", [32, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_duplicates, "SMALL", small)
    monkeypatch.setattr(near_duplicates, "BLOCK_NODES", 16)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash")).withColumn("keys", F.lit(1))
    want = brute_classes(rows)
    got = near_duplicates.digest(docs).collect()
    assert len(got) == len(rows)
    assert collections.Counter((str(r["doc_id"]), str(r["component_id"])) for r in got) == collections.Counter((str(rows[i][0]), str(c)) for i, c in want.items())
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    out = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert collections.Counter(str(x) for x, _ in out) == collections.Counter(str(c) for c in {(c if c is not None else ("null", i)): c for i, c in want.items()}.values())


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates.digest(none).count() == 0 and near_duplicates.keep_one(none).count() == 0
    same = spark.createDataFrame([(i, "the very same text as all the others have") for i in range(300)], "doc_id bigint, text string")
    assert {tuple(r) for r in near_duplicates.digest(same).select("component_id").collect()} == {(0,)}
    assert [r["doc_id"] for r in near_duplicates.keep_one(same).collect()] == [0]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    error = []
    for trial in range(20):
        h = words.mix(np.arange(150, dtype=np.uint64) + np.uint64(1000 * trial))
        a = rng.integers(0, 30, 150) * rng.integers(0, 2, 150)
        b = np.maximum(0, a + rng.integers(-4, 5, 150))
        row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = near_duplicates.signatures(2, row, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), slots=800)
        error.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.015 and np.max(np.abs(error)) < 0.08


# embeddings


def test_graph_finds_nearest_nodes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[500:800] = x[499] + 0.05 * rng.normal(size=(300, 32))  # a dense group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, sizes = hnsw.Graph.order(len(x))
    graph = hnsw.Graph.build(x[order].astype(np.float32), sizes)
    graph, more = hnsw.Graph.load(graph.dump(exact=x[order], extra=np.arange(3)))
    assert more["extra"].tolist() == [0, 1, 2] and (more["exact"] == x[order]).all()
    q = x[:200].astype(np.float32)
    ids, near = graph.search(q, 64)
    truth = (q @ graph.vectors.T).max(axis=1)
    assert (near[:, 0] >= truth - 1e-4).mean() >= 0.97
    assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in ids)


def embedding_rows():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2, None):
        centre = rng.normal(size=8)
        for k in range(120):
            v = centre + rng.normal(size=8) * (0.12 if k < 60 else 2.0)
            rows.append((n, [float(np.float32(x)) for x in v], label))
            n += 1
    same = rows[3][1]
    rows += [(n + i, same, 0) for i in range(40)] + [(n + 50, same, 1), (n + 51, None, 0), (n + 52, [], 0), (n + 53, [0.0] * 8, 0), (n + 54, [float("nan")] * 8, 0), (n + 55, [None] + same[1:], 0), (n + 56, [float("inf")] + same[1:], 0)]
    return rows + [(n + 57, [x * 1e30 for x in same], 0), (n + 58, same[:5], 0), (n + 59, [x * 2 for x in same[:5]], 0)]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rows = embedding_rows()
    monkeypatch.setattr(embedding_dedup, "MIN_SHARDS", 3)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("shard", F.lit(1))
    ok = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = []
    for i, j in itertools.combinations(ok, 2):
        if label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93:
            links.append((i, j))
    n, top = collections.Counter(x for pair in links for x in pair), classes(links)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    assert got == [(i, n[i], top.get(i, i), top.get(i, i) == i) for i, _, _ in sorted(rows, key=lambda r: r[0])]


def test_embeddings_of_one_large_label(spark):
    """Shards of more than 1,000 nodes, searched by graph: dense groups, chains, lone pairs and unlike vectors, against brute force."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 24))
    x[:400] = x[0] + 0.15 * rng.normal(size=(400, 24))  # nearly all linked
    for k in range(400, 1000):  # groups of 2 to 20
        x[k] = x[k - k % (2 + k // 100 * 2)] + 0.2 * rng.normal(size=24)
    for k in range(1000, 1400):  # chains: each near the one before
        x[k] = x[k - 1] + 0.3 * rng.normal(size=24) if k % 40 else x[k]
    x[3000:3600] = x[1400:2000] + 0.25 * rng.normal(size=(600, 24))  # pairs
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), "hot") for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    top = classes(list(zip(*(i.tolist() for i in np.nonzero(np.triu(linked))), strict=True)))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= linked.sum(axis=1)).all() and n.sum() >= 0.999 * linked.sum(), (n.sum(), linked.sum())
    assert [got[i]["component_id"] for i in range(len(x))] == [top.get(i, i) for i in range(len(x))]


def test_no_embeddings(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(none).count() == 0


# personal data

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return [True, kind == 1 and all(int(p) <= 255 for p in value.split(".")), 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][kind]


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(6)
    alphabet = "a1 .@-+()_%é😀2345\n9,"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(800)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111  1111 1111 1111 1111", "+1 (619) 555-0053", "1" * 20000, "a" * 20000, "1 " * 3000, "call 619-555-0053 now", "john (at) mail [dot] com", "256.1.1.1 00255.1.1.1", "+12345678901234567", "x " * 20000 + "me@a.org"]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[3]])), "doc_id int, text string").withColumn("t", F.lit("clash")).withColumn("base", F.lit(1)).repartition(4)
    for r in private_data.digest(docs).collect():
        t = ([*texts, texts[3]])[r["doc_id"]] or ""
        spans = [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in p.finditer(t) if holds(k, m.group())]
        written = ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in spans) for x in range(4)], t[:200]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        all_spans = r["spans"].split(",") if r["spans"] else []
        assert set(written.split(",")) - {""} <= set(all_spans)
        order = [(private_data.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in all_spans]
        assert order == sorted(order)
    assert private_data.digest(docs.limit(0)).count() == 0


def test_personal_data_is_native(spark):
    plan = private_data.detect(spark.createDataFrame([(1, "x")], "doc_id int, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# pipeline and queries


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mix", "records"]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs if not outs else outs[-1], SF)
        rows = out.collect()
        outs.append(spark.createDataFrame(rows, out.schema))
        if name != "records":
            assert out.columns == docs.columns
    ids = [sorted(r["doc_id"] for r in o.select("doc_id").collect()) for o in outs]
    scores = toxicity.digest(docs, marks).collect()
    assert ids[0] == sorted(r["doc_id"] for r in scores if not r["predicted"])
    rows = [(r["doc_id"], r["text"]) for r in outs[0].collect()]
    assert ids[1] == sorted(set(brute_classes(rows).values()))
    flagged = {r["doc_id"] for r in decontaminate.digest(outs[1], benchmark).collect() if r["contaminated"]}
    assert ids[2] == [i for i in ids[1] if i not in flagged]
    assert set(ids[3]) <= set(ids[2])
    sizes = {r["doc_id"]: r for r in mix.digest(outs[2]).collect()}
    assert all(n <= 3 for n in collections.Counter(ids[3]).values()) and all(i in sizes for i in ids[3])
    assert ids[4] == ids[3]
    assert [r["n_tokens"] for r in outs[4].orderBy("start").collect()] == [r["n_tokens"] for r in records.digest(outs[3], queries.tokenizer_path()).orderBy("start").collect()]


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_mix_of_rows_without_id(spark, monkeypatch):
    """Rows without id are spread over the buckets by their text, and the mix is the same in a second run."""
    monkeypatch.setattr(mix, "BUCKET_DOCS", 16)
    rows = [(None, "w " * (1 + i % 7) + str(i), "hot") for i in range(2000)] + [(i, "a b c", "small") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    slim = docs.select(F.struct("text").alias("row"), F.col("doc_id").alias("id"), mix._text_key("doc_id"), "source", mix.words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    first = sorted((r["row"]["text"], r["before"], r["taken"]) for r in mix.plan(slim).filter("id IS NULL").collect())
    assert len({b for _, b, _ in first}) == 2000 and slim.filter("id IS NULL").select("text_key").distinct().count() == 2000
    target = mix.source_targets(slim).filter("source = 'hot'").first()["target"]
    assert sum(t for *_, t in first) == int(target)
    assert first == sorted((r["row"]["text"], r["before"], r["taken"]) for r in mix.plan(slim.repartition(3)).filter("id IS NULL").collect())


def edge_tables(spark, folder, empty=()):
    fill = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{fill} {i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en", "hot" if i % 3 else None, 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "hot", 0), (None, None, None, "hot", None), (None, "no id " + fill, "en", "hot", 1), (None, "no id either", "en", None, 1)]
    rows += [(62, "one", "en", "a", 3)] * 2 + [(63, " \t\n", "en", "a", 3), (64, "the passage of the test that nobody should train on at all", "en", "a", 1), (65, "x " * 200_000, "en", "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    for c in ("row", "score", "size", "key", "position", "copy", "component", "tie"):
        docs = docs.withColumn(c, F.lit("clash"))
    marks = spark.createDataFrame([(i, 1, int(i == 3)) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([("b1", "the passage of the test that nobody should train on at all"), ("b2", None), (None, "")], "item_id string, text string")
    for name, df in (("documents", docs), ("labels", marks), ("benchmark", items)):
        (df.limit(0) if name in empty else df).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return rows, docs.columns


@pytest.mark.parametrize("empty", [(), ("documents",), ("labels", "benchmark")])
def test_pipeline_edges(spark, tmp_path, empty):
    """Null and repeated ids, null, empty and long texts, null sources, clashing columns and empty tables."""
    rows, columns = edge_tables(spark, tmp_path, empty)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        got = out.collect()
        docs = spark.createDataFrame(got, out.schema)
        kept.append(collections.Counter((r["doc_id"], r["text"]) for r in got))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if "documents" in empty:
        assert not out and not any(kept)
        return
    given = collections.Counter(r[:2] for r in rows)
    assert sum(given.values()) - sum(kept[0].values()) <= (0 if "labels" in empty else 3)  # of few labels little is learned
    assert not kept[0] - given and not kept[1] - kept[0] and not kept[2] - kept[1]
    # null and blank texts are no copies of each other; of the repeated row one stays
    assert all(kept[1][x] == 1 for x in ((60, None), (61, ""), (None, None), (62, "one"), (None, "no id either")))
    assert kept[2][64, rows[-2][1]] == (1 if "benchmark" in empty else 0) and sum(kept[1].values()) - sum(kept[2].values()) == (0 if "benchmark" in empty else 1)
    assert all(n <= 3 * kept[2][x] for x, n in kept[3].items())
    assert len(out) == sum(kept[3].values()) and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_each_operator_has_one_query():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)

    def norm(v):
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    assert sorted(tuple(map(norm, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(norm, r)) for r in cursor.fetchall())
