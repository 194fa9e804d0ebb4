"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, scanned over whole documents.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is
``size`` consecutive words of an item; an item of fewer words, but not none, is one window. Every document
window is looked up by hash; a hit is verified word for word before it counts.

The windows are broadcast in shards of at most ``SHARD_BYTES`` of text. A benchmark that fits in one shard takes one pass
without a shuffle; a larger one takes one pass a shard, each written before the next, so what is
broadcast never grows with the benchmark.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; an item
with a null id contributes windows but no item id; repeated items count once; repeated documents get equal rows; an empty benchmark
hits nothing. Columns of the documents are carried in a struct, so their names cannot clash with results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.arrow import small_batches
from ledgerloom.session import materialize

WINDOW = 10
SHARD_BYTES = 8 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (gram, n, item): each window as its words joined by a space, its word count and its item id as text."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    grams = F.expr(
        f"CASE WHEN size(w) >= {size} THEN transform(sequence(0, size(w) - {size}), i -> slice(w, i + 1, {size})) "
        "WHEN size(w) > 0 THEN array(w) ELSE array() END"
    )
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w"))
        .select("item", F.explode(grams).alias("g"))
        .select(F.array_join("g", " ").alias("gram"), F.size("g").alias("n"), "item")
        .distinct()
    )


class _Grams:
    """One shard's windows: sorted hashes for each window length, and the exact words and items behind each hash."""

    def __init__(self, rows) -> None:
        by_gram: dict[tuple[int, str], list[str]] = defaultdict(list)
        for gram, n, item in rows:
            by_gram[(n, gram)].append(item)
        self.hashes: dict[int, np.ndarray] = {}
        self.items: dict[int, dict[int, list[tuple[str, list[str]]]]] = defaultdict(lambda: defaultdict(list))
        for (n, gram), items in by_gram.items():
            self.items[n][self.hash_of(gram, n)].append((gram, [x for x in items if x is not None]))
        for n, found in self.items.items():
            self.hashes[n] = np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))
            self.items[n] = dict(found)
        self.items = dict(self.items)

    @staticmethod
    def hash_of(gram: str, n: int) -> int:
        data = np.frombuffer(gram.encode(), dtype=np.uint8)
        start, end, _ = W.find(data, np.array([0, len(data)]), W.ALNUM)
        return int(W.run_hashes(W.hashes(data, start, end), n)[0])


def _member(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions in h of values in the sorted set; a bit filter over the top 16 bits goes first."""
    seen = np.zeros(1 << 16, dtype=bool)
    seen[sorted_hashes >> np.uint64(48)] = True
    maybe = np.flatnonzero(seen[h >> np.uint64(48)])
    at = np.searchsorted(sorted_hashes, h[maybe])
    at[at == len(sorted_hashes)] = 0
    return maybe[sorted_hashes[at] == h[maybe]]


def _scan(texts: W.Texts, grams: _Grams) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int, int]]], dict[int, set[str]]]:
    """Words of each row, verified spans by row as (first word, end word, first byte, end byte), and items by row."""
    w = W.words(texts, W.ALNUM)
    rows = texts.hi - texts.lo
    n_words = np.bincount(w.row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n_words)])
    spans: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for n, known in grams.hashes.items():
        h = W.run_hashes(w.hash, n)
        if not len(h):
            continue
        for i in _member(known, h).tolist():
            if w.row[i] != w.row[i + n - 1]:
                continue
            gram = b" ".join(texts.data[w.start[k] : w.end[k]].tobytes().lower() for k in range(i, i + n)).decode()
            for exact, found in grams.items[n][int(h[i])]:
                if exact == gram:
                    row = int(w.row[i])
                    at = i - int(first[row])
                    base = int(texts.bounds[row])
                    spans[row].append((at, at + n, int(w.start[i]) - base, int(w.end[i + n - 1]) - base))
                    items[row].update(found)
    return n_words, spans, items


def _merge(spans) -> list[tuple[int, int, int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


_SPAN = pa.struct([(k, pa.int64()) for k in ("word", "word_end", "byte", "byte_end")])
_SPAN_SQL = "array<struct<word:bigint,word_end:bigint,byte:bigint,byte_end:bigint>>"


def _pass(state: DataFrame, windows) -> DataFrame:
    """One scan of (row, text, n_words, spans, items) with one shard of windows; earlier spans and items are kept."""
    sent = state.sparkSession.sparkContext.broadcast([tuple(r) for r in windows])

    def run(batches):
        grams = _Grams(sent.value)
        for batch in batches:
            n_all, spans_all, items_all = [], [], []
            old_spans, old_items = batch.column("spans"), batch.column("items")
            for texts in W.groups(batch.column("text")):
                n_words, spans, items = _scan(texts, grams)
                n_all.append(n_words)
                for row in range(texts.hi - texts.lo):
                    s = spans.get(row, [])
                    before = old_spans[texts.lo + row].as_py() or []
                    s = _merge([*s, *(tuple(x.values()) for x in before)]) if s or before else []
                    spans_all.append([dict(zip(("word", "word_end", "byte", "byte_end"), x, strict=True)) for x in s])
                    items_all.append(sorted({*items.get(row, ()), *(old_items[texts.lo + row].as_py() or [])}))
            n = np.concatenate(n_all) if n_all else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(n, pa.int64()), pa.array(spans_all, pa.list_(_SPAN)), pa.array(items_all, pa.list_(pa.string()))],
                names=["row", "text", "n_words", "spans", "items"],
            )

    return small_batches(state).mapInArrow(run, state.schema)


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES, carry: list[str] | None = None, keep_text: bool = True) -> DataFrame:
    """(row struct of ``carry`` or all columns, text, n_words, spans, items) for each document.

    ``keep_text`` False returns a null text (less to send back) where one pass is enough."""
    grams = benchmark_windows(benchmark, size)
    total = grams.agg(F.sum(F.octet_length("gram") + F.coalesce(F.octet_length("item"), F.lit(0)) + 32)).head()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry is not None else F.struct("*")
    state = docs.select(row.alias("row"), F.col("text"), F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(_SPAN_SQL).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    if shards > 1:
        grams = materialize(grams.withColumn("shard", F.pmod(F.xxhash64("gram", "item"), F.lit(shards))), "windows")
    for k in range(shards):
        mine = grams.filter(F.col("shard") == k).select("gram", "n", "item") if shards > 1 else grams
        state = _pass(state, mine.collect())  # at most about shard_bytes
        if k < shards - 1:
            state = materialize(state, "scanned")
    return state if keep_text else state.drop("text")


def n_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["word_end"] - s["word"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """The documents' columns without contaminated documents (``remove="documents"``) or, with ``"spans"``, all of them with the hit
    words cut from their texts (a line break stands for each span; cutting repeats until no window is left)."""
    if remove == "documents":
        return find_windows(docs, benchmark, **options).filter(F.size("spans") == 0).select("row.*")
    if remove != "spans":
        raise ValueError(f"remove: {remove!r}")
    columns = docs.columns
    while True:
        found = find_windows(docs, benchmark, **options)
        cut = F.expr(
            "CASE WHEN size(spans) = 0 THEN row.text ELSE concat_ws('\n', "
            "transform(sequence(0, size(spans)), i -> decode(substring(encode(row.text, 'UTF-8'), "
            "int(if(i = 0, 0, spans[i - 1].byte_end)) + 1, "
            "int(if(i = size(spans), octet_length(row.text), spans[i].byte) - if(i = 0, 0, spans[i - 1].byte_end))), 'UTF-8'))) END"
        )
        out = materialize(found.select(F.col("row"), cut.alias("cut"), F.size("spans").alias("hits")), "decontaminated")
        docs = out.select(*(F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns))
        if not out.filter("hits > 0").limit(1).count():
            return docs


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = find_windows(docs, benchmark, carry=["doc_id"], **options)
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit("spans").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item, len(g) AS n, list_aggregate(g, 'string_agg', ' ') AS gram FROM (
    SELECT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(len(w) - 9), lambda i: w[i + 1 : i + 10]) ELSE [w] END) AS g
    FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
win AS (
  SELECT r, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, win.n AS n, item FROM win JOIN grams USING (n, gram)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
per AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN per USING (r)
"""
