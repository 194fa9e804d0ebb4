"""Words, decontamination, mixing and record files against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, mix, queries, records, words
from ledgerloom.session import scratch_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["", None, "One two", "ONE Two, three! fünf sechs 7", "a" * 5000, "x\ty\r\nz\x0b\x0c  ", "日本 語😀", "word " * 3000, "..."]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("group", [1, 40, 1 << 20])
def test_words_are_those_of_the_pattern(group):
    for member, pattern in ((words.ALNUM, WORD), (words.NOT_SPACE, re.compile(r"[^\x20\x09-\x0D]+"))):
        got = []
        for g in words.groups(pa.array(TEXTS, pa.string()), group):
            w = words.words(g, member)
            rows = [[] for _ in range(g.hi - g.lo)]
            for a, b, r in zip(w.start, w.end, w.row, strict=True):
                rows[r].append(lower(g.data[a:b].tobytes().decode()))
            got += rows
        assert got == [pattern.findall(lower(t or "")) for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    g = next(words.groups(pa.array(["the cat THE cat", "cat the"], pa.string())))
    w = words.words(g, words.ALNUM)
    names = [g.data[a:b].tobytes().lower() for a, b in zip(w.start, w.end, strict=True)]
    assert len(set(w.hash.tolist())) == 2 and len({(n, h) for n, h in zip(names, w.hash.tolist(), strict=True)}) == 2
    blocks = words.hashes(g.data, w.start, w.end, block=5)
    assert (blocks == w.hash).all()


def brute_hits(text, items):
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        x = WORD.findall(lower(t or ""))
        grams = [x[i : i + 10] for i in range(len(x) - 9)] if len(x) >= 10 else [x] if x else []
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (10, "short ITEM!"), (None, "no id here"), (3, None), (4, ""), (5, "..."), (1, "one two three four five six seven eight nine ten eleven")]
DOCS = [
    (1, "so One, two three four five six seven eight nine TEN eleven twelve"),
    (2, "two three four five six seven eight nine ten eleven - short item and short item"),
    (3, None),
    (4, ""),
    (5, "no id here"),
    (5, "no id here"),
    (None, "one two three"),
    (6, "short\titem " * 400 + "clean " * 2000),
    (7, "shortitem short items"),
]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


@pytest.mark.parametrize("shard_bytes", [1 << 20, 150])
def test_decontamination_equals_brute_force(spark, shard_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumn("spans", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("n_words", F.lit(1))
    got = sorted(map(tuple, decontaminate.digest(docs, bench(spark), shard_bytes=shard_bytes).collect()), key=str)
    assert got == sorted(((i, *brute_hits(t, BENCH)) for i, t in DOCS), key=str)


def test_decontamination_removes_documents_or_spans(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumn("spans", F.lit("kept"))
    clean = decontaminate.decontaminate(docs, bench(spark))
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(((i, t, "kept") for i, t in DOCS if not brute_hits(t, BENCH)[4]), key=str)
    cut = decontaminate.decontaminate(docs, bench(spark), remove="spans")
    rows = cut.collect()
    assert len(rows) == len(DOCS) and not any(brute_hits(r["text"], BENCH)[4] for r in rows)
    assert next(r["text"] for r in rows if r["doc_id"] == 6).split() == ["clean"] * 2000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert decontaminate.digest(none, bench(spark)).count() == 0
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    assert not any(r["contaminated"] for r in decontaminate.digest(docs, bench(spark).limit(0)).collect())
    assert mix.digest(none).count() == 0 and mix.mix(none).count() == 0
    assert records.digest(none, queries.tokenizer_path()).count() == 0


def mix_docs():
    rows = [(i, "w " * (i % 37), f"s{i % 5}") for i in range(400)] + [(i, "v " * 50, "s0") for i in range(400, 700)]
    return rows + [(1000, None, None), (1001, "a b", None), (1002, "", "empty"), (7, "w " * 7, "s2"), (7, "w " * 7, "s2"), (None, "x y z", "é")]


def brute_targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * size[s]}
        if not over:
            return size, target
        capped |= over


def test_mix_meets_targets(spark):
    rows = mix_docs()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size, target = brute_targets(rows)
    joined = mix.digest(docs).collect()
    assert len(joined) == len(rows)
    again = mix.digest(docs.repartition(7)).collect()
    assert sorted(map(str, joined)) == sorted(map(str, again))
    source = {}
    for i, _, s in rows:
        source.setdefault(i, s)
    taken = {}
    for r in joined:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
        assert (r["first_position"] is None) == (r["taken"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1


def test_mix_repeats_whole_documents(spark):
    rows = mix_docs()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("position", F.lit("clash")).withColumn("size", F.lit(0))
    size, target = brute_targets(rows)
    out = mix.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {(r["doc_id"], r["text"], r["source"]) for r in got} <= set(rows)
    for s in size:
        words_ = sum(len((r["text"] or "").split()) for r in got if r["source"] == s)
        assert abs(words_ - target[s]) <= 50  # the longest document


def test_curriculum_inverts_the_demand(spark):
    q = spark.range(1, 100).select((F.col("id") / 100).alias("q"))
    for weight, a in mix.SLOPES.items():
        df = q.select("q", F.lit(0).alias("source_size"), (F.col("q") * 1000).alias("before"), F.lit(0).alias("size"), F.lit(0).alias("extra"), F.lit(0).alias("passes"), F.lit(1000.0).alias("target"), F.lit(weight).alias("weight"))
        for r in df.select("q", mix.position(F.lit(0)).alias("t")).collect():
            assert (1 - a) * r["t"] + a * r["t"] ** 2 == pytest.approx(r["q"])


RECORD_TEXTS = [
    (5, "Hello World, it's fine... don't!! 3.14 ÉCOLE école"),
    (1, None),
    (9, ""),
    (3, "a<|endoftext|>b <|ENDOFTEXT|> c"),
    (None, "no id"),
    (3, "ties by text"),
    (3, "ties by text"),
    (12, "é Å ﬁ İstanbul ΑΣ ß “quoted” x≠ the‑end #tag ###. a_b, it's. don't."),
    (13, "word " * 5000 + "z" * 3000),
    (14, "日本語 العربية  nbsp  em"),
]


def test_records_equal_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(RECORD_TEXTS, "doc_id bigint, text string").withColumn("file", F.lit("clash"))
    t = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted(records.digest(docs, queries.tokenizer_path(), str(tmp_path / "r")).collect(), key=lambda r: r["start"])
    ids = {(i, x): [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in RECORD_TEXTS}
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in RECORD_TEXTS), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in ((k, ids[k]) for k in RECORD_TEXTS))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    chosen = records.read_index(spark, str(tmp_path / "r")).filter("doc_id IN (5, 13)").orderBy(F.rand(1))
    read = {r["doc_id"]: r["ids"] for r in records.read_records(spark, str(tmp_path / "r"), chosen).collect()}
    assert read == {i: ids[i, x] for i, x in RECORD_TEXTS if i in (5, 13)}


def test_several_files_keep_the_order(spark):
    docs = spark.range(500).select((500 - F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    path = records.write(docs, scratch_path(spark, "records"), queries.tokenizer_path(), file_bytes=2000)
    rows = sorted(records.read_index(spark, path).collect(), key=lambda r: r["start"])
    assert len({r["file"] for r in rows}) > 3
    assert [r["doc_id"] for r in rows] == list(range(1, 501)) and rows[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))


def test_damage_is_noticed():
    data = bytearray(records.frame(records.pack(7, b"\x01\x00\x02\x00", 2)))
    payload, end = records.unframe(data)
    assert end == len(data) and records.unpack(payload)[0] == 7 and records.unpack(payload)[1].tolist() == [1, 2]
    for at in (0, 9, 14, len(data) - 3, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(broken)
    with pytest.raises(ValueError):
        records.unframe(data[:-4])


def test_starts_follow_the_numbers_of_files(spark):
    """Names have at least five digits: part-100000 comes after part-99999."""
    rows = [(f"part-{n}-x.txt", 0, i, 0, 10, 0, i + 3, 0) for i, n in enumerate(("00000", "00999", "01000", "99999", "100000", "100001", "1000000"))]
    names = [f.split()[0] for f in records._ROW.split(", ")]
    got = records.with_starts(spark.createDataFrame(rows[::-1], names)).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == [0, 3, 7, 12, 18, 25, 33]


def test_rows_of_one_id_go_to_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(None, "same text of every row")] * 4000 + [(5, f"text {i}") for i in range(2000)], "doc_id bigint, text string").repartition(4)
    path = records.write(docs, str(tmp_path / "r"), queries.tokenizer_path(), file_bytes=20_000)
    index = records.read_index(spark, path)
    files = {r["doc_id"]: r["n"] for r in index.groupBy("doc_id").agg(F.countDistinct("file").alias("n")).collect()}
    assert files[None] >= 3 and files[5] >= 2 and index.count() == 6000
    rows = sorted((r["start"], r["doc_id"] is not None, r["n_tokens"]) for r in index.collect())
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)  # documents without an id first
    at = 0
    for start, _, n in rows:
        assert start == at
        at += n


def test_other_tokenizers_encode_whole_texts():
    """A file that splits in another way isn't encoded word by word."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = records.WordEncoder(path)
    assert not encoder.by_words and records.WordEncoder(queries.tokenizer_path()).by_words
    texts = ["Two words  and\n\nspace ", "", "don't", "x" * 5000]
    group = next(words.groups(pa.array(texts)))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in records.encode_texts(group, encoder, False)] == want
