"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text; documents whose perplexity is above a quantile of
their language's trusted documents are rejected.

Trusted documents are labelled quality 1. The model is counted over the whole texts of all of them with crc32(doc_id as text) mod 5 other than 0. Grams of
``ORDER`` bytes (texts start after zero bytes) are counted in map tasks and summed. Continuation counts, context totals and discounts are grouped, and
probabilities joined, order by order, on keys of (context) and (suffix), which Spark shards by hash. No gram is cut off.

Trusted texts are found by a join on doc_id. At most ``FEW_IDS`` trusted ids (``FEW_IDS_BYTES``) are broadcast to it, so no text is shuffled. Of more ids, a bitmap of their
hashes, of ``FILTER_BITS`` bits at any size, is broadcast first, so that few other texts are shuffled to that join; the join decides in every case.

Scoring: about ``HEAD`` most frequent grams and contexts of each order, at most, go to every task (orders 1 and 2 have 256 and 65,536 grams, so they go whole). Each text's grams are
counted, and a gram that these tables settle gets its loss in place. For a gram they don't settle, the (document, gram, count) rows of a group of texts are packed by shard:
differences of sorted values, bytes of equal significance together, compressed. A shard is a hash of the last two bytes of a
gram's context, so it holds the grams and contexts of the orders above 2 that its rows can fall back to.
Packed rows meet the shard's whole table in one shuffle, and each document's losses are summed over the shards.

A document's perplexity is exp of the mean -log p of its bytes. Its threshold is the ``QUANTILE`` of the perplexities of all trusted documents of its lang,
or of all trusted documents where its lang (null included) has none.

Defined results: null and empty texts have no perplexity and are rejected; without trusted documents nothing has a threshold and all texts with bytes are
kept; a doc_id with several labels is trusted if one of them is; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import words as W
from ledgerloom.llm.arrow import id_remainder, small_batches
from ledgerloom.operators.joins import bounded_small
from ledgerloom.session import materialize

ORDER = 4
#: Shards of the tables, as a power of two; each is held by several tasks where there are more partitions.
SHARD_BITS = 6
PACK_BYTES = 4 << 20
#: Bits of the filter on trusted ids: at most FILTER_BITS / 64 rows are broadcast.
FILTER_BITS = 1 << 25
#: Trusted ids that are broadcast as they are: rows and bytes.
FEW_IDS, FEW_IDS_BYTES = 1 << 20, 64 << 20
#: Most frequent grams and most frequent contexts of an order that every task holds.
HEAD = 1 << 18
#: Orders whose tables every task holds whole.
LOW = 2
QUANTILE = 0.995
HELD_OUT = 5


def grams(data: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The code of the gram that ends at each byte: its last ``order`` bytes, the latest lowest; zeros before a text's start."""
    code = data.astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(1, order):
        earlier = np.zeros(len(data), np.uint32)
        earlier[k:] = data[:-k]
        earlier[place < k] = 0
        code |= earlier << np.uint32(8 * k)
    return code


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c) over all texts."""

    def run(batches):
        for batch in batches:
            for g in W.groups(batch.column("text")):
                gram, c = np.unique(grams(g.data, g.bounds, order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "c"])

    return small_batches(texts).select("text").mapInArrow(run, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(of_counts: dict[int, int]) -> tuple[float, float, float]:
    """For counts 1, 2 and 3 or more, from the numbers of grams seen 1 to 4 times."""
    n = [of_counts.get(k, 0) for k in range(1, 5)]
    if not (n[0] and n[1]):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.9 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True))


@dataclass
class Model:
    """Sorted codes and probabilities of grams by order (from 1), and sorted contexts and their mass for lower orders."""

    gram: list[np.ndarray]
    p: list[np.ndarray]
    context: list[np.ndarray]
    mass: list[np.ndarray]

    def probabilities(self, code: np.ndarray) -> np.ndarray:
        """Of each gram's last byte after the bytes before it. Every order gives what it knows; the rest is the lower order's, weighted by the context's mass."""
        out = np.full(len(code), 1 / 256)
        for k in range(1, len(self.gram) + 1):
            part = code & np.uint32((1 << 8 * k) - 1)
            known, at = _find(self.gram[k - 1], part)
            has, where = _find(self.context[k - 1], part >> np.uint32(8))
            out[has] *= self.mass[k - 1][where[has]]
            out[known] = self.p[k - 1][at[known]]
        return out


@dataclass
class Head(Model):
    """The most frequent grams and contexts by order, and whether they are all."""

    all_grams: list[bool]
    all_contexts: list[bool]

    def settles(self, code: np.ndarray) -> np.ndarray:
        """Whether the probability of each gram is the whole model's."""
        out = np.ones(len(code), bool)
        for k in range(1, len(self.gram) + 1):
            part = code & np.uint32((1 << 8 * k) - 1)
            known, _ = _find(self.gram[k - 1], part)
            has, _ = _find(self.context[k - 1], part >> np.uint32(8))
            out = known | (out & self.all_grams[k - 1] & (has | self.all_contexts[k - 1]))
        return out


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x, at


def tables(counts: DataFrame, order: int = ORDER, keep: int | None = None) -> list[tuple[DataFrame, DataFrame]] | None:
    """For each order from 1, (gram, c, p) and (context, total, mass), joined in Spark from (gram, c); None without grams. ``keep``, for tests, cuts off rare grams."""
    level = materialize(counts, "counts")
    levels = [level]
    for k in range(order - 1, 0, -1):  # lower orders count the different bytes before a gram
        level = materialize(level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "counts")
        levels.append(level)
    out, lower = [], None
    for k, level in enumerate(reversed(levels), 1):
        of = {r["c"]: r["n"] for r in level.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        d = discounts(of)
        level = level.withColumn("d", F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).withColumn("context", F.shiftright("gram", 8))
        if k == 1 and level.isEmpty():
            return None
        cut = 0
        while keep is not None and level.filter(F.col("c") > cut).count() > keep:
            cut = max(1, 2 * cut)
        contexts = level.groupBy("context").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("c") > cut, F.col("d")).otherwise(F.col("c").cast("double"))).alias("left"))
        contexts = materialize(contexts.select("context", "total", (F.col("left") / F.col("total")).alias("mass")), "contexts")
        p = level.filter(F.col("c") > cut).join(contexts, "context").withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        below = F.lit(1 / 256)
        if lower is not None:
            p = p.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        lower = materialize(p.select("gram", "c", ((F.col("c") - F.col("d")) / F.col("total") + F.col("mass") * below).alias("p")), "probabilities")
        if cut:
            contexts = contexts.join(lower.select(F.shiftright("gram", 8).alias("context")).distinct(), "context")
        out.append((lower, contexts.select("context", "total", "mass")))
    return out


def collect(parts: list[tuple[DataFrame, DataFrame]]) -> Model:
    """The model of some orders' tables, on the driver."""
    model = Model([], [], [], [])
    for probabilities, contexts in parts:
        found, masses = probabilities.orderBy("gram").toPandas(), contexts.orderBy("context").toPandas()
        model.gram.append(found["gram"].to_numpy().astype(np.uint32))
        model.p.append(found["p"].to_numpy())
        model.context.append(masses["context"].to_numpy().astype(np.uint32))
        model.mass.append(masses["mass"].to_numpy())
    return model


def _frequent(table: DataFrame, count: str, most: int) -> tuple[DataFrame, bool]:
    """The rows with the largest counts, about ``most`` of them at most, and whether that is all."""
    n = table.count()
    if n <= most:
        return table, True
    cut = table.agg(F.percentile_approx(count, 1 - most / n, 10_000)).first()[0]
    return table.filter(F.col(count) > cut), False


def head(parts: list[tuple[DataFrame, DataFrame]], most: int = HEAD) -> Head:
    """Orders up to ``LOW`` whole, and of those above the most frequent grams and contexts, on the driver."""
    out = Head([], [], [], [], [], [])
    for k, (probabilities, contexts) in enumerate(parts, 1):
        some, whole = (probabilities, True) if k <= LOW else _frequent(probabilities, "c", most)
        known, known_whole = (contexts, True) if k <= LOW else _frequent(contexts, "total", most)
        for table, key, value, keys, values in ((some, "gram", "p", out.gram, out.p), (known, "context", "mass", out.context, out.mass)):
            rows = table.select(key, value).toArrow().sort_by(key)
            keys.append(rows[key].to_numpy().astype(np.uint32))
            values.append(rows[value].to_numpy())
        out.all_grams.append(whole)
        out.all_contexts.append(known_whole)
    return out


def kneser_ney(counts: DataFrame, order: int = ORDER, keep: int | None = None) -> Model | None:
    """The whole model of (gram, c) on the driver, for small counts; None without grams."""
    parts = tables(counts, order, keep)
    return None if parts is None else collect(parts)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id may be among ``ids``: all that are, and others whose hash falls on a bit of one that is."""
    if docs.schema["doc_id"].dataType != ids.schema["doc_id"].dataType:
        return docs  # equal ids would have other hashes
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    words = ids.select(word.alias("_word"), F.expr("1L").alias("_one"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_bits"))
    found = docs.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word")
    return found.filter(F.expr("(shiftrightunsigned(_bits, _bit) & 1) = 1")).drop("_word", "_bit", "_bits")


def train(docs: DataFrame, labels: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """The tables of the whole texts of all trusted documents that aren't held out."""
    ours, few = bounded_small(trusted_ids(labels).filter(id_remainder("doc_id", HELD_OUT) != 0), "trusted", FEW_IDS, FEW_IDS_BYTES)
    texts = docs.select("doc_id", "text")
    if few:
        return tables(gram_counts(texts.join(F.broadcast(ours), "doc_id")))
    # (``ours`` has distinct ids; the optimizer would move a semi join below the one with the bitmap, and shuffle all texts)
    return tables(gram_counts(likely(texts, ours).join(ours, "doc_id")))


def shards(code: np.ndarray) -> np.ndarray:
    """Shard of each gram: a hash of the last two bytes of its context."""
    return ((code >> np.uint32(8) & np.uint32(0xFFFF)) * np.uint32(40503) & np.uint32(0xFFFF)) >> np.uint32(16 - SHARD_BITS)


def _shard(context: str) -> Column:
    """The same of a context in SQL."""
    return F.expr(f"cast(shiftright((({context}) & 65535) * 40503 & 65535, {16 - SHARD_BITS}) as int)")


def squeeze(x: np.ndarray) -> bytes:
    """The length in bytes, then the bytes of equal significance together, compressed."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueeze(blob: bytes, dtype: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def encode(gram: np.ndarray, per: np.ndarray, doc: np.ndarray, times: np.ndarray) -> list[bytes]:
    """Blobs of sorted grams, how many entries each has, and the entries' documents (ascending in a gram) and counts."""
    step = np.diff(doc, prepend=doc[:1])
    first = np.cumsum(per) - per
    step[first] = doc[first]
    return [squeeze(np.diff(gram, prepend=np.uint32(0))), squeeze(per.astype(np.uint32)), squeeze(step), squeeze(times)]


def decode(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    gram, per, step, times = (unsqueeze(x, t) for x, t in zip(blobs, (np.uint32, np.uint32, np.uint16, np.uint8), strict=True))
    total = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(per, dtype=np.int64) - per
    doc = total - np.repeat(total[first] - step[first], per)
    return np.cumsum(gram, dtype=np.uint32), per, doc, times


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value and length of each run of equal values."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def _pack(g: W.Texts, common: Head) -> tuple[np.ndarray, dict[int, list[bytes]]]:
    """The texts' losses by the grams that ``common`` settles; by shard, encoded: its other distinct grams, how many entries each has, and the entries' documents and counts
    (of 255 at most; a larger one has several entries)."""
    code, n = grams(g.data, g.bounds), np.diff(g.bounds)
    key = shards(code).astype(np.uint64) << np.uint64(48) | code.astype(np.uint64) << np.uint64(16) | np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key, count = np.unique(key, return_counts=True)
    distinct, per = _runs((key >> np.uint64(16)).astype(np.uint32))
    sure = common.settles(distinct)
    of = np.repeat(sure, per)
    loss = np.repeat(-np.log(common.probabilities(distinct[sure])), per[sure]) * count[of]
    lost = np.bincount((key[of] & np.uint64(0xFFFF)).astype(np.int64), loss, minlength=len(n))
    key, count = key[~of], count[~of]
    times = (count + 254) // 255
    last = np.cumsum(times) - 1
    small = np.full(int(times.sum()), 255, np.uint8)
    small[last] = count - 255 * (times - 1)
    key = np.repeat(key, times)
    doc, shard = (key & np.uint64(0xFFFF)).astype(np.uint16), key >> np.uint64(48)
    edge = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    out = {}
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        gram, per = _runs((key[lo:hi] >> np.uint64(16)).astype(np.uint32))
        out[int(shard[lo])] = encode(gram, per, doc[lo:hi], small[lo:hi])
    return lost, out


_BLOBS = ["grams", "per", "docs", "times"]


def _packed(docs: DataFrame, carry: list[str] | None, copies: int, sent) -> DataFrame:
    """Documents (kind 2: batch, place, row, n, loss by the grams that every task's tables settle) and their other grams, packed (kind 1: batch, blobs), each with the task
    that takes it."""
    row = F.struct("*") if carry is None else F.struct(*(F.col(f"`{c}`") for c in carry))
    source = small_batches(docs).select(row.alias("row"), F.col("text").alias("text"))
    tasks = copies << SHARD_BITS

    def run(batches):
        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            for g in W.groups(batch.column("text"), PACK_BYTES):
                rows = batch.column("row").slice(g.lo, g.hi - g.lo)
                for lo in range(0, len(rows), 1 << 16):  # documents are numbered in 16 bits
                    hi = min(len(rows), lo + (1 << 16))
                    part = W.Texts(lo, hi, g.data[g.bounds[lo] : g.bounds[hi]], g.bounds[lo : hi + 1] - g.bounds[lo])
                    n, place = hi - lo, np.arange(hi - lo)
                    none = [pa.nulls(n, pa.binary())] * len(_BLOBS)
                    lost, found = _pack(part, sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(((uid + place) % tasks).astype(np.int32)), pa.array([2] * n, pa.int32()), pa.array([uid] * n, pa.int64()), pa.array(place.astype(np.int32)), pa.array(np.diff(part.bounds)), pa.array(lost), rows.slice(lo, n), *none], names=names)
                    m = len(found)
                    if m:
                        to = [k * copies + uid % copies for k in found]
                        blobs = [pa.array(list(x), pa.binary()) for x in zip(*found.values(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([1] * m, pa.int32()), pa.array([uid] * m, pa.int64()), pa.array(list(found), pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, rows.type), *blobs], names=names)
                    uid += 1
        pa.default_memory_pool().release_unused()

    fields = T._parse_datatype_string("task int, kind int, batch bigint, place int, n bigint, loss double").fields
    schema = T.StructType([*fields, T.StructField("row", source.schema["row"].dataType), *(T.StructField(x, T.BinaryType()) for x in _BLOBS)])
    names = schema.names
    return source.mapInArrow(run, schema)


def _lose(sent, mid: T.StructType):
    """Function over the rows of a task, by task and kind: the shard's tables (kind 0), then packed grams, then documents."""

    def run(batches):
        task, model, chunks = None, None, []
        for batch in batches:
            owner, kind = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]))), len(owner)) if len(owner) else np.zeros(1, np.int64)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if owner[lo] != task:
                    task, model, chunks = owner[lo], None, []
                rows = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    chunks.append([rows.column(c).to_numpy(zero_copy_only=False) for c in ("level", "gram", "value")])
                    continue
                if kind[lo] == 2:
                    yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("batch", "place", "n", "loss", "row")] + [pa.nulls(len(rows), pa.binary())] * 2, names=mid.names)
                    continue
                if model is None:
                    model = _shard_model(sent.value, chunks)
                places, sums = [], []
                for blobs in zip(*(rows.column(c).to_pylist() for c in _BLOBS), strict=True):
                    gram, per, doc, times = decode(blobs)
                    place, at = np.unique(doc, return_inverse=True)
                    places.append(place.astype(np.uint16).tobytes())
                    sums.append(np.bincount(at, np.repeat(-np.log(model.probabilities(gram)), per) * times).tobytes())
                none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.float64(), rows.column("row").type)]
                yield pa.RecordBatch.from_arrays([rows.column("batch"), rows.column("place"), *none, pa.array(places, pa.binary()), pa.array(sums, pa.binary())], names=mid.names)
        pa.default_memory_pool().release_unused()

    return run


def _shard_model(common: Head, chunks: list) -> Model:
    """Orders up to ``LOW`` from the broadcast, those above from rows (2 * order for grams, 2 * order + 1 for contexts), sorted."""
    level, code, value = (np.concatenate(x) for x in zip(*chunks, strict=True)) if chunks else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    model = Model(common.gram[:LOW], common.p[:LOW], common.context[:LOW], common.mass[:LOW])
    for k in range(LOW + 1, ORDER + 1):
        own, contexts = level == 2 * k, level == 2 * k + 1
        model.gram.append(code[own].astype(np.uint32))
        model.p.append(value[own])
        model.context.append(code[contexts].astype(np.uint32))
        model.mass.append(value[contexts])
    return model


def _add(table: pa.Table) -> pa.Table:
    """Losses of a batch's documents in the shards, summed shard by shard in order, so that equal texts get equal sums."""
    table = table.sort_by("place")
    lost, met = np.zeros(1 << 16), np.zeros(1 << 16, bool)
    for places, sums in zip(table["places"].to_pylist(), table["sums"].to_pylist(), strict=True):
        at = np.frombuffer(places, np.uint16)
        lost[at] += np.frombuffer(sums, np.float64)
        met[at] = True
    place = np.flatnonzero(met)
    return pa.table({"batch": pa.array([table["batch"][0].as_py()] * len(place), pa.int64()), "place": pa.array(place.astype(np.int32)), "more": pa.array(lost[place])})


def score(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]] | None, carry: list[str] | None = None, most: int = HEAD) -> DataFrame:
    """(row, n_bytes, perplexity) of every document; no perplexity for an empty text. ``most``: grams and contexts of an order that every task holds."""
    if model is None:
        row = F.struct("*") if carry is None else F.struct(*(F.col(f"`{c}`") for c in carry))
        n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
        return docs.select(row.alias("row"), n.alias("n_bytes"), F.when(n > 0, F.lit(256.0)).alias("perplexity"))
    spark = docs.sparkSession
    copies = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) >> SHARD_BITS)
    sent = spark.sparkContext.broadcast(head(model, most))  # about HEAD grams and contexts an order at most
    packed = _packed(docs, carry, copies, sent)
    parts = []
    for k, (probabilities, contexts) in enumerate(model[LOW:], LOW + 1):
        parts.append(probabilities.select(_shard("shiftright(gram, 8)").alias("shard"), F.lit(2 * k).alias("level"), "gram", F.col("p").alias("value")))
        parts.append(contexts.select(_shard("context").alias("shard"), F.lit(2 * k + 1).alias("level"), F.col("context").alias("gram"), F.col("mass").alias("value")))
    shared = parts[0]
    for x in parts[1:]:
        shared = shared.unionByName(x)
    shared = shared.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select((F.col("shard") * copies + F.col("copy")).alias("task"), F.lit(0).alias("kind"), "level", "gram", "value")
    dealt = packed.unionByName(shared, allowMissingColumns=True).repartitionById(copies << SHARD_BITS, "task").sortWithinPartitions("task", "kind", "level", "gram")
    mid = T.StructType([*T._parse_datatype_string("batch bigint, place int, n bigint, loss double").fields, T.StructField("row", packed.schema["row"].dataType), T.StructField("places", T.BinaryType()), T.StructField("sums", T.BinaryType())])
    found = materialize(dealt.mapInArrow(_lose(sent, mid), mid), "losses")
    losses = found.filter("sums IS NOT NULL").select("batch", "place", "places", "sums").groupBy("batch").applyInArrow(_add, "batch bigint, place int, more double")
    out = found.filter("sums IS NULL").select("batch", "place", "row", F.col("n").alias("n_bytes"), "loss").join(losses, ["batch", "place"], "left")
    return out.select("row", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp((F.col("loss") + F.coalesce("more", F.lit(0.0))) / F.col("n_bytes"))).alias("perplexity"))


def classify(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) with threshold and keep."""
    scored = materialize(scored, "perplexities")
    trusted = scored.join(trusted_ids(labels), "doc_id", "left_semi").filter("perplexity IS NOT NULL")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    own = trusted.groupBy(F.col("lang").alias("of")).agg(at.alias("own"))
    overall = trusted.agg(at.alias("overall"))
    out = scored.join(own, scored["lang"].eqNullSafe(own["of"]), "left").crossJoin(F.broadcast(overall))  # one row
    out = out.withColumn("threshold", F.coalesce("own", "overall"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", keep.alias("keep"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and keep of each document."""
    scored = score(docs, train(docs, labels), carry=["doc_id", "lang"])
    return classify(scored.select("row.doc_id", "row.lang", "n_bytes", "perplexity"), labels)
