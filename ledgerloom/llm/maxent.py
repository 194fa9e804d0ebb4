"""LM scoring: a hashed maximum-entropy softmax over classes with n-gram and skip features, and count shares within a class.

Tokens are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z folded, then one end a text. A token's class is its own for the ``SINGLES`` most frequent words and the end;
other words share ``ENDINGS`` classes by their last two bytes. The model is

    p(token | before) = p(class | before) * p(token | class)

p(class | before) is a softmax over hashed features of the text so far: the last word, the last but one alone (skip), both
together, and the endings of both. p(token | class) is the token's training count plus 0.1 over the class's. Of all unseen words of a
class together one share of 0.1 is set aside, as in the base score.

Training: documents with crc32(doc_id as text) mod 10 other than 0. Counts are exact sums over all their tokens (a token is known by a 64-bit hash). The
features' weights are trained in ``ROUNDS`` rounds over disjoint parts of all these documents: each task makes gradient updates from the
last round's weights over its part, and the tasks' weights are averaged by their tokens in two grouped steps.

Scoring: weights (of fixed size) and the counts of the ``HEAD`` most frequent tokens, at most, are broadcast and texts are scored in numpy
batches. Tokens outside the head are joined with the count table by hash, pre-summed a document, and added.

Defined results: a null text is empty and has the end alone; without training documents all counts are 0 and classes are uniform; repeated rows get equal
scores; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.arrow import id_remainder, small_batches
from ledgerloom.session import materialize

HELD_OUT = 10
SINGLES, ENDINGS = 39, 24
CLASSES = SINGLES + 1 + ENDINGS
ONE, TWO = 2048, 4096
_KINDS = ENDINGS + 2  # endings, the end and the start
ROWS = 2 * ONE + TWO + _KINDS * _KINDS
HEAD = 300_000
ROUNDS, BATCH, RATE = 2, 4096, 0.15
BLOCK = 256
END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A2757A2757A275)


@dataclass
class Tokens:
    """A group's tokens in order, an end after each text: distinct hashes, their ending kind, which one each token is, and its row."""

    hash: np.ndarray
    kind: np.ndarray
    which: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row


def tokens(texts: W.Texts) -> Tokens:
    w = W.words(texts, W.NOT_SPACE)
    rows = texts.hi - texts.lo
    count = np.bincount(w.row, minlength=rows)
    first = np.cumsum(count + 1) - (count + 1)
    hashes = np.full(len(w.hash) + rows, END, np.uint64)
    hashes[np.arange(len(w.hash)) + w.row] = w.hash
    distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    row = np.repeat(np.arange(rows), count + 1)
    is_end = distinct == END
    word = np.where(is_end, 0, at - row[at])
    kind = np.full(len(distinct), ENDINGS)
    if len(w.hash):
        last = texts.data[w.end[word] - 1]
        before = np.where(w.end[word] - w.start[word] > 1, texts.data[np.maximum(w.end[word] - 2, 0)], 0)
        both = W.FOLD[before].astype(np.uint64) * np.uint64(256) + W.FOLD[last]
        kind = np.where(is_end, ENDINGS, (W.mix(both) % np.uint64(ENDINGS)).astype(np.int64))
    return Tokens(distinct, kind, which, row, first)


def features(t: Tokens) -> np.ndarray:
    """(token, 4) rows of the weight table for what stands before each token."""
    h = np.append(W.mix(t.hash), START)
    kind = np.append(t.kind, ENDINGS + 1)
    start = len(t.hash)
    one, two = np.roll(t.which, 1), np.roll(t.which, 2)
    one[t.first] = two[t.first] = start
    second = t.first + 1
    second = second[second < np.append(t.first[1:], len(t.which))]
    two[second] = start
    a, b = h[one], h[two]
    pair = W.mix(a + b * np.uint64(3))
    return np.stack(
        [
            (a % np.uint64(ONE)).astype(np.int64),
            ONE + (W.mix(b) % np.uint64(ONE)).astype(np.int64),
            2 * ONE + (pair % np.uint64(TWO)).astype(np.int64),
            2 * ONE + TWO + kind[one] * _KINDS + kind[two],
        ],
        1,
    )


def class_of(t: Tokens, singles: np.ndarray) -> np.ndarray:
    """Class of each distinct token; ``singles`` are the sorted hashes of the words with classes of their own."""
    at = np.searchsorted(singles, t.hash) if len(singles) else np.zeros(len(t.hash), np.int64)
    at[at == len(singles)] = 0
    own = singles[at] == t.hash if len(singles) else np.zeros(len(t.hash), bool)
    return np.where(own, at, np.where(t.kind == ENDINGS, SINGLES, SINGLES + 1 + t.kind))


class Classifier:
    """The softmax over classes: a weight row for each hashed feature, and a bias."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = np.zeros((ROWS + 1, CLASSES), np.float32) if weights is None else weights  # the last row is the bias

    def log_p(self, rows: np.ndarray) -> np.ndarray:
        w = self.weights
        z = w[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            z += w[rows[:, k]]
        z += w[-1]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def update(self, rows: np.ndarray, classes: np.ndarray, squares: np.ndarray) -> None:
        """One gradient step on a batch; ``squares`` sums squared gradients."""
        g = np.exp(self.log_p(rows))
        g[np.arange(len(g)), classes] -= 1
        flat = rows.reshape(-1).astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        total = _run_sums(g, order // rows.shape[1], head)
        at = flat[head]
        squares[at] += total * total
        self.weights[at] -= RATE * total / np.sqrt(squares[at])
        total = g.sum(axis=0)
        squares[-1] += total * total
        self.weights[-1] -= RATE * total / np.sqrt(squares[-1])


def _run_sums(g: np.ndarray, which: np.ndarray, head: np.ndarray, short: int = 6) -> np.ndarray:
    """Sums of the rows g[which] from each head to the next: short runs place by place, the few long ones each at once."""
    length = np.diff(np.append(head, len(which)))
    total = g[which[head]]
    for k in range(1, short):
        more = np.flatnonzero(length > k)
        total[more] += g[which[head[more] + k]]
    for i in np.flatnonzero(length > short).tolist():
        total[i] = g[which[head[i] : head[i] + length[i]]].sum(axis=0)
    return total


def token_counts(texts: DataFrame) -> DataFrame:
    """(hash, kind, c) of all tokens of a text column; hashes as signed integers."""

    def run(batches):
        for batch in batches:
            for g in W.groups(batch.column("text"), 2 << 20):
                t = tokens(g)
                c = np.bincount(t.which, minlength=len(t.hash))
                yield pa.RecordBatch.from_arrays([pa.array(t.hash.view(np.int64)), pa.array(t.kind.astype(np.int32)), pa.array(c.astype(np.int64))], names=["hash", "kind", "c"])

    found = small_batches(texts).select("text").mapInArrow(run, "hash bigint, kind int, c bigint")
    return found.groupBy("hash").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


def train_classes(texts: DataFrame, singles: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` rounds over disjoint parts of (text, part)."""
    weights = None
    for k in range(rounds):
        weights = _round(texts.filter(F.col("part") == k).select("text"), singles, weights)
    return weights if weights is not None else Classifier().weights


def _round(texts: DataFrame, singles: np.ndarray, weights: np.ndarray | None) -> np.ndarray | None:
    sent = texts.sparkSession.sparkContext.broadcast((singles, weights))

    def run(batches):
        own, before = sent.value
        model = Classifier(None if before is None else before.copy())
        squares, seen = np.ones_like(model.weights), 0
        for batch in batches:
            for g in W.groups(batch.column("text")):
                t = tokens(g)
                classes, rows = class_of(t, own)[t.which], features(t)
                for i in range(0, len(rows), BATCH):
                    model.update(rows[i : i + BATCH], classes[i : i + BATCH], squares)
                seen += len(rows)
        if seen:
            parts = [model.weights[i : i + BLOCK].astype(np.float64) * seen for i in range(0, ROWS + 1, BLOCK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * n, pa.int32()), pa.array([seen] * n, pa.int64()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())],
                names=["block", "salt", "seen", "total"],
            )

    def add(rows):
        import pandas as pd

        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows["total"])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "salt": [rows["salt"].iloc[0]], "seen": [rows["seen"].sum()], "total": [total.astype(np.float32).tobytes()]})

    schema = "block int, salt int, seen bigint, total binary"
    sums = texts.mapInArrow(run, schema).groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    found = sums.orderBy("block").collect()  # ROWS + 1 weight rows, whatever the input
    if not found:
        return weights
    return np.concatenate([(np.frombuffer(r["total"], np.float32) / r["seen"]).reshape(-1, CLASSES) for r in found]).astype(np.float32)


@dataclass
class Model:
    """What a scoring task needs."""

    weights: np.ndarray
    singles: np.ndarray
    head: np.ndarray  # sorted hashes
    head_counts: np.ndarray
    class_total: np.ndarray  # log10 of the count mass of each class
    n: int
    v: int


def train(docs: DataFrame, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and the count table (hash, kind, c) of all training tokens."""
    ours = docs.filter(id_remainder("doc_id", HELD_OUT) != 0).select("doc_id", "text")
    counts = materialize(token_counts(ours), "counts")
    end = int(END.view(np.int64))
    top = counts.filter(F.col("hash") != end).orderBy(F.col("c").desc(), "hash").limit(SINGLES).collect()
    singles = np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64))
    own = [r["hash"] for r in top] + [end]
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).head()
    mass = np.full(CLASSES, 0.1)
    for r in counts.filter(~F.col("hash").isin(own)).groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        mass[SINGLES + 1 + r["kind"]] = r["c"] + 0.1 * (r["v"] + 1)
    # the head: whole classes of counts, from the most frequent down, as many as fit
    step = F.floor(F.log2(F.col("c").cast("double")) * 8)
    least, size = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["step"]):
        size += r["n"]
        if size > head:
            break
        least = r["c"]
    chosen = counts.filter(F.col("hash").isin(own) | (F.col("c") >= F.lit(least)) if least is not None else F.col("hash").isin(own))
    known = chosen.select("hash", "c").toArrow()
    hashes = known["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    parts = ours.withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("round")), F.lit(ROUNDS)))
    weights = train_classes(parts, singles)
    return Model(weights, singles, hashes[order], known["c"].to_numpy().astype(np.float64)[order], np.log10(mass), totals["n"] or 0, totals["v"]), counts


def _score(g: W.Texts, m: Model) -> tuple:
    """For each text: tokens, known ones of the head, base and model sums without tail tokens' counts; and (row, hash, times) of tail tokens."""
    t = tokens(g)
    rows = g.hi - g.lo
    classes = class_of(t, m.singles)
    alone = classes <= SINGLES
    at = np.searchsorted(m.head, t.hash) if len(m.head) else np.zeros(len(t.hash), np.int64)
    at[at == len(m.head)] = 0
    known = m.head[at] == t.hash if len(m.head) else np.zeros(len(t.hash), bool)
    log_c = np.where(known, np.log10((m.head_counts[at] if len(m.head) else 0) + 0.1), 0.0)
    in_class = np.where(alone, 0.0, log_c - m.class_total[classes])
    model = Classifier(m.weights)
    features_, token_class, log_class = features(t), classes[t.which], np.empty(len(t.which))
    for i in range(0, len(features_), BATCH):
        z = model.log_p(features_[i : i + BATCH])
        log_class[i : i + BATCH] = z[np.arange(len(z)), token_class[i : i + BATCH]]
    n = np.bincount(t.row, minlength=rows)
    base = np.bincount(t.row, log_c[t.which], minlength=rows)
    score = np.bincount(t.row, log_class / np.log(10) + in_class[t.which], minlength=rows)
    tail = np.flatnonzero(~known[t.which])
    key, times = np.unique(t.row[tail] * len(t.hash) + t.which[tail], return_counts=True)
    return n, np.bincount(t.row, known[t.which], minlength=rows).astype(np.int64), base, score, key // max(1, len(t.hash)), t.hash[key % max(1, len(t.hash))], times


_SCORED = "doc_id bigint, uid bigint, n_tokens bigint, head_known bigint, head_base double, head_score double, hashes array<bigint>, times array<bigint>"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size, at most HEAD counts

    def run(batches):
        m, uid = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for g in W.groups(batch.column("text")):
                n, known, base, total, row, hashes, times = _score(g, m)
                to = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(to), pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))) for x in (hashes, times)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(g.lo, g.hi - g.lo), pa.array(np.arange(uid, uid + len(n))), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(total), *lists],
                    names=[f.split()[0] for f in _SCORED.split(", ")],
                )
                uid += len(n)

    scored = materialize(small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SCORED), "scored")
    tail = scored.select("uid", F.explode(F.arrays_zip("hashes", "times")).alias("x")).select("uid", F.col("x.hashes").alias("hash"), F.col("x.times").alias("times"))
    found = tail.join(counts.select("hash", "c"), "hash", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per = found.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("tail_known"))
    out = scored.drop("hashes", "times").join(per, "uid", "left")
    tail_sum = F.coalesce("tail", F.lit(0.0))
    whole = F.log10(F.lit(float(model.n)) + 0.1 * (model.v + 1))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("head_base") + tail_sum - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("head_score") + tail_sum).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    model, counts = train(docs)
    out = score(docs, model, counts)
    return out.select("doc_id", (id_remainder("doc_id", HELD_OUT) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
