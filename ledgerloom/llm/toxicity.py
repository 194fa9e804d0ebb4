"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (folded letters, digits, non-ASCII) between < and > gives its byte 3- to 5-grams, hashed into ``BUCKETS`` embeddings. The
embeddings of ``SPAN`` consecutive words (words averaged, each the average of its subwords) go into a softmax over clean and
toxic. A text is toxic if one of its spans is: its score is the largest p over all runs of ``SPAN`` words (a shorter text is one run), so the small p of many clean
runs don't add up with length, and texts joined score what the largest of them or a run across a seam does. Training goes through 1 - prod(1 - p) over the
``STRONGEST`` spans of a document, so labels of whole documents teach which words they are about. An unseen misspelling shares most subwords with words seen.

Training is on a bounded sample of labelled rows: up to ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean documents (and ``ALL_BYTES`` of text of each kind), chosen
by a hash of their id among those with crc32(doc_id as text) mod 5 other than 0. Texts are whole up to ``MAX_BYTES``; of a longer one a piece of a quarter as many
characters is taken from a place chosen by its id's hash, for toxic ones too. Every whole text is scored. Inside a score only the text counts.

Defined results: null, empty and wordless texts have score 0; a doc_id with several labels takes the largest; without labels of both kinds
every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.arrow import id_remainder, map_texts

BUCKETS = 1 << 17
DIMENSION = 8
SIZES = (3, 4, 5)
SPAN = 4
MAX_TOXIC, MAX_CLEAN, MAX_BYTES, ALL_BYTES = 1500, 4000, 1 << 20, 24 << 20
STRONGEST = 64
TRAIN_GROUP = 256 << 10
HELD_OUT = 5
EPOCHS, UPDATES, BATCH, RATE, START_BIAS, TOXIC_WEIGHT = 8, 300, 128, 0.4, -5.0, 2.0
_UP, _DOWN = np.uint8(ord("<")), np.uint8(ord(">"))


class Subwords:
    """Distinct words of a group and their hashed subwords."""

    def __init__(self, texts: W.Texts) -> None:
        self.words = W.words(texts, W.ALNUM)
        w = self.words
        self.hash, first, self.which = np.unique(w.hash, return_index=True, return_inverse=True)
        self.n = len(first)
        length = w.end[first] - w.start[first]
        wide = length + 2
        to = np.cumsum(wide)
        self.of = np.repeat(np.arange(self.n), wide)  # word of each padded byte
        at = np.arange(len(self.of)) - np.repeat(to - wide, wide)
        source = np.repeat(w.start[first] - 1, wide) + at
        self.data = W.FOLD[texts.data[np.clip(source, 0, max(0, len(texts.data) - 1))]] if self.n else np.zeros(0, np.uint8)
        self.data[to - wide] = _UP
        self.data[to - 1] = _DOWN

    def grams(self, buckets: int = BUCKETS):
        """(word, bucket) of every subword, size by size."""
        values = self.data.astype(np.uint64) + np.uint64(1)
        for n in SIZES:
            if len(values) < n:
                continue
            at = np.flatnonzero(self.of[: len(self.of) - n + 1] == self.of[n - 1 :])
            h = W.run_hashes(values, n)[at]
            yield self.of[at], (h >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


class Model:
    """Embeddings, the softmax's two rows and its bias (of toxic over clean)."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
        self.out = rng.normal(0, 0.5, (2, DIMENSION)).astype(np.float32)
        self.bias = START_BIAS

    def subword_logits(self) -> np.ndarray:
        """What each embedding adds to the logit of toxic over clean."""
        return self.embedding @ (self.out[1] - self.out[0])

    def train(self, texts, labels: np.ndarray, seed: int = 7) -> None:
        """``texts``: strings, or an Arrow array of them."""
        words_of, which, bucket, first, n_sub = _training_words(texts)
        rng = np.random.default_rng(seed)
        g_embedding, g_out, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full(DIMENSION, 1e-6), 1e-6
        for _ in range(max(EPOCHS, -(-UPDATES * BATCH // len(texts)))):  # small samples get more epochs
            shuffled = rng.permutation(len(texts))
            for at in range(0, len(texts), BATCH):
                docs = shuffled[at : at + BATCH]
                y = labels[docs]
                counts = words_of[docs + 1] - words_of[docs]
                if not counts.sum():
                    continue
                here = _ranges(words_of[docs], counts)
                distinct, local = np.unique(which[here], return_inverse=True)
                subs = bucket[_ranges(first[distinct], n_sub[distinct])]
                owner = np.repeat(np.arange(len(distinct)), n_sub[distinct])
                direction = self.out[1] - self.out[0]
                logits = self.embedding @ direction
                per_word = np.bincount(owner, logits[subs]) / n_sub[distinct]
                per = -(-counts // SPAN)
                inside = np.arange(len(here)) - np.repeat(np.cumsum(counts) - counts, counts)
                span = np.repeat(np.cumsum(per) - per, counts) + inside // SPAN
                row = np.repeat(np.arange(len(docs)), per)
                in_span = np.bincount(span)
                z = np.bincount(span, per_word[local]) / in_span + self.bias
                p = 1 / (1 + np.exp(-z))
                strong = strongest(z, row)
                total = np.bincount(row[strong], _softplus(z[strong]), minlength=len(docs))
                pull = np.where(y == 1, -TOXIC_WEIGHT / np.expm1(np.clip(total, 1e-6, 50)), 1.0)  # d loss / d total
                dz = np.zeros(len(z))
                dz[strong] = (p * pull[row])[strong]
                d_word = np.bincount(local, (dz / in_span)[span]) / n_sub[distinct]
                c = np.bincount(subs, d_word[owner], minlength=BUCKETS).astype(np.float32)
                hit = np.flatnonzero(c)
                d_out = c[hit] @ self.embedding[hit]
                g_embedding[hit] += c[hit] ** 2 * float(direction @ direction)
                self.embedding[hit] -= (RATE * c[hit] / np.sqrt(g_embedding[hit]))[:, None] * direction
                g_out += d_out**2
                step = 0.1 * RATE * d_out / np.sqrt(g_out)
                self.out[1] -= step.astype(np.float32)
                self.out[0] += step.astype(np.float32)
                d_bias = dz.sum()
                g_bias += d_bias**2
                self.bias -= 0.3 * RATE * d_bias / np.sqrt(g_bias)


def _training_words(texts) -> tuple[np.ndarray, ...]:
    """(first word of each text, number of the distinct word of each word, subwords of the distinct words, their first and how many each has).

    Words are found in groups of texts, so that of each word only a 32-bit number stays."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, (list, tuple)) else texts
    none = np.zeros(0, np.int64)
    counts, which, sizes, buckets = [none], [none.astype(np.int32)], [none], [none.astype(np.int32)]
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of the words seen, sorted, and the order in which they came
    for group in W.groups(texts, TRAIN_GROUP):
        s = Subwords(group)
        counts.append(np.bincount(s.words.row, minlength=group.hi - group.lo))
        parts = [(word, bucket.astype(np.int32)) for word, bucket in s.grams()]
        new = ~np.isin(s.hash, known, assume_unique=True)
        parts = [(word[new[word]], bucket[new[word]]) for word, bucket in parts]
        n = sum((np.bincount(word, minlength=s.n) for word, _ in parts), np.zeros(s.n, np.int64))
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        while parts:  # subwords by word, sizes one after the other
            word, some = parts.pop()
            k = np.bincount(word, minlength=s.n)
            out[_ranges(at, k)] = some
            at += k
        sizes.append(n[new])
        buckets.append(out)
        known, number = np.concatenate([known, s.hash[new]]), np.concatenate([number, len(number) + np.arange(new.sum(), dtype=np.int32)])
        order = np.argsort(known, kind="stable")
        known, number = known[order], number[order]
        which.append(number[np.searchsorted(known, s.hash)][s.which])
    # words are numbered by their hash
    rank = np.empty(len(number), np.int32)
    rank[number] = np.arange(len(number), dtype=np.int32)
    n_sub, came = np.concatenate(sizes), np.concatenate(buckets)
    del buckets
    first, n_sub = (np.cumsum(n_sub) - n_sub)[number], n_sub[number]
    bucket = np.concatenate([none.astype(np.int32), *(came[_ranges(first[i : i + 4096], n_sub[i : i + 4096])] for i in range(0, len(number), 4096))])
    return np.concatenate([[0], np.cumsum(np.concatenate(counts))]), rank[np.concatenate(which)], bucket, np.cumsum(n_sub) - n_sub, n_sub


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start and count, end to end."""
    to = np.cumsum(count)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - count), count)


def strongest(z: np.ndarray, row: np.ndarray, n: int | None = None) -> np.ndarray:
    """Which spans are among the ``n`` (STRONGEST) of their row with the largest z; rows are in order."""
    order = np.lexsort((-z, row))
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return order[rank < (STRONGEST if n is None else n)]


def text_scores(texts: W.Texts, logits: np.ndarray, bias: float) -> np.ndarray:
    """The largest p over all runs of SPAN words of each text."""
    rows = texts.hi - texts.lo
    s = Subwords(texts)
    if not s.n:
        return np.zeros(rows)
    total, n = np.zeros(s.n), np.zeros(s.n)
    for word, bucket in s.grams(len(logits)):
        total += np.bincount(word, logits[bucket], minlength=s.n)
        n += np.bincount(word, minlength=s.n)
    x, row = (total / n)[s.which], s.words.row
    count = np.bincount(row, minlength=rows)
    wide = np.minimum(count, SPAN)[row]
    at = np.flatnonzero(np.arange(len(x)) + wide <= np.cumsum(count)[row])
    z = np.zeros(len(at))
    for k in range(SPAN):  # place by place, so that equal texts get equal sums
        more = np.flatnonzero(wide[at] > k)
        z[more] += x[at[more] + k]
    best = np.full(rows, -np.inf)
    np.maximum.at(best, row[at], z / wide[at] + bias)
    return 1 / (1 + np.exp(-best))


def training_table(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES, all_bytes: int = ALL_BYTES) -> pa.Table:
    """At most max_toxic + max_clean rows (text, toxic) as an Arrow table, toxic and clean each the first by a hash of the id, of at most all_bytes each."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_remainder("doc_id", HELD_OUT) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.withColumn("order", F.xxhash64(F.col("doc_id"), F.lit("toxicity")))
    # a text beyond max_bytes gives a piece from a place by its id's hash; a character has up to 4 bytes
    size = max_bytes // 4
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("piece")), F.greatest(F.length("text") - size, F.lit(1))).cast("int") + 1
    texts = docs.filter("text IS NOT NULL").select("doc_id", F.when(F.octet_length("text") <= max_bytes, F.col("text")).otherwise(F.col("text").substr(place, F.lit(size))).alias("text"))
    out = [pa.table({"text": pa.array([], pa.large_string()), "toxic": pa.array([], pa.int64())})]
    for kind, n in (("toxic = 1", max_toxic), ("toxic = 0", max_clean)):
        few = marked.filter(kind).orderBy("order").limit(n + n // 2)  # half as many again, as some have no text
        sizes = texts.join(F.broadcast(few), "doc_id").select("order", F.octet_length("text").alias("n")).orderBy("order", "n").limit(n).collect()
        used, last = 0, None
        for r in sizes:
            used += r["n"]
            if last is not None and used > all_bytes:
                break
            last = r["order"]
        if last is not None:
            some = texts.join(F.broadcast(few.filter(F.col("order") <= last)), "doc_id").orderBy("order", "text").limit(n).select("text", "toxic").toArrow()
            out.append(some.cast(out[0].schema))
    return pa.concat_tables(out)


def training_sample(docs: DataFrame, labels: DataFrame, **bounds) -> list:
    """The rows of ``training_table``."""
    return training_table(docs, labels, **bounds).to_pylist()


def train(docs: DataFrame, labels: DataFrame, **bounds) -> tuple[np.ndarray, float] | None:
    """Logits of the subwords and the bias; None without both kinds of labels."""
    sample = training_table(docs, labels, **bounds)
    y = sample.column("toxic").to_numpy()
    if not (len(y) and (y == 1).any() and (y == 0).any()):
        return None
    model = Model()
    model.train(sample.column("text").combine_chunks(), y)
    del sample
    pa.default_memory_pool().release_unused()
    return model.subword_logits(), float(model.bias)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, carry: list[str] | None = None) -> DataFrame:
    """(row, score) of every document; row has all columns, or those of ``carry``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS float32 values

    def start():
        if sent.value is None:
            return lambda texts: [np.zeros(texts.hi - texts.lo)]
        logits, bias = sent.value
        return lambda texts: [text_scores(texts, logits, bias)]

    return map_texts(docs, F.col("text"), "score double", start, carry=carry)


def reject_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' columns of those with a score under 0.5."""
    return score(docs, train(labelled, labels)).filter("score < 0.5").select("row.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = score(docs, train(docs, labels), carry=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", (id_remainder("doc_id", HELD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
