"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes; in each, one network reads forwards and one backwards, and every byte gets a
probability for each language from both states. A document's probabilities are the mean over all its bytes; its language is the
most probable one.

The network is trained on a bounded sample: about ``DOCS`` documents of each language (fewer where there are more than ``SAMPLE`` / ``DOCS`` languages; every
language is one the network has weights for), and of each ``PIECES`` windows at places given by a hash. Rows without id are chosen by their text, rows of
one id together. Documents with crc32(doc_id as text) mod 4 = 2, or without lang, are not learned from.
lang, source and doc_id are never inputs of a prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing can be learned; ties go to the language that
sorts first; repeated rows get equal results; an empty table gives no rows. Other columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.arrow import id_remainder, map_texts

WINDOW = 64
HIDDEN = 8
DOCS, PIECES, SAMPLE = 600, 4, 60_000
HELD_OUT, HELD_OUT_AT = 4, 2
EPOCHS, BATCH, RATE = 6, 256, 0.01
_AT_ONCE = 2048


class Network:
    """Weights of both directions (axis 0): input gates by byte, recurrent gates, and the softmax over languages.

    Gates are update, reset and new, side by side. Byte 256 stands for no byte."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.weights = {
            "byte": rng.normal(0, 0.3, (2, 257, 3 * hidden)),
            "state": rng.normal(0, 0.4, (2, hidden, 3 * hidden)),
            "new": np.zeros((2, 1, hidden)),
            "out": rng.normal(0, 0.3, (2, hidden, classes)),
            "bias": np.zeros(classes),
        }
        self.weights = {k: x.astype(np.float32) for k, x in self.weights.items()}

    def states(self, window: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, direction, window, hidden) of (window, time) bytes, in reading order; what backpropagation needs if ``keep``."""
        w = self.weights
        n, time = window.shape
        hidden = w["state"].shape[1]
        byte = np.stack([window.T, window[:, ::-1].T], 1)  # time, direction, window
        h = np.zeros((2, n, hidden), np.float32)
        out, kept = np.empty((time, 2, n, hidden), np.float32), []
        gates = np.empty((2, n, 3 * hidden), np.float32)
        for t in range(time):
            for d in range(2):
                np.take(w["byte"][d], byte[t, d], axis=0, out=gates[d])
            a = np.matmul(h, w["state"])
            zr = gates[:, :, : 2 * hidden] + a[:, :, : 2 * hidden]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :, :hidden], zr[:, :, hidden:]
            inner = a[:, :, 2 * hidden :] + w["new"]
            new = np.tanh(gates[:, :, 2 * hidden :] + r * inner)
            before = h
            h = new + z * (h - new)
            out[t] = h
            if keep:
                kept.append((byte[t], before, z, r, inner, new))
        return out, kept

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (time, window, language) of each byte; time runs forwards."""
        w = self.weights
        logits = states[:, 0] @ w["out"][0]
        logits += states[::-1, 1] @ w["out"][1]
        logits += w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, window: np.ndarray, language: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all bytes; byte 256 has no part in it."""
        w = self.weights
        states, kept = self.states(window, keep=True)
        time, _, n, hidden = states.shape
        d_logits = self.labels(states)
        d_logits[:, np.arange(n), language] -= 1
        real = (window.T < 256).astype(np.float32)
        d_logits *= (real / max(1.0, float(real.sum())))[:, :, None]
        g = {k: np.zeros_like(x) for k, x in w.items()}
        back = d_logits[::-1]
        g["bias"] = d_logits.sum(axis=(0, 1))
        g["out"][0] = np.einsum("tnh,tnk->hk", states[:, 0], d_logits, optimize=True)
        g["out"][1] = np.einsum("tnh,tnk->hk", states[:, 1], back, optimize=True)
        d_h = np.zeros((2, n, hidden), np.float32)
        state_t = w["state"].transpose(0, 2, 1)
        for t in reversed(range(time)):
            byte, before, z, r, inner, new = kept[t]
            d_h[0] += d_logits[t] @ w["out"][0].T
            d_h[1] += back[t] @ w["out"][1].T
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z = d_h * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_inner = d_new * r
            d_a = np.concatenate([d_z, d_r, d_inner], axis=2)
            d_gates = np.concatenate([d_z, d_r, d_new], axis=2)
            for d in range(2):
                g["state"][d] += before[d].T @ d_a[d]
                one = np.zeros((n, 257), np.float32)
                one[np.arange(n), byte[d]] = 1
                g["byte"][d] += one.T @ d_gates[d]
            g["new"] += d_inner.sum(axis=1, keepdims=True)
            d_h = d_h * z + np.matmul(d_a, state_t)
        return g

    def train(self, window: np.ndarray, language: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam over shuffled batches, the rate falling to nothing."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(x) for k, x in self.weights.items()}
        second = {k: np.zeros_like(x) for k, x in self.weights.items()}
        steps, step = epochs * -(-len(window) // BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(window))
            for i in range(0, len(order), BATCH):
                mine = order[i : i + BATCH]
                rate = RATE * (1 - step / steps)
                step += 1
                for k, g in self.gradients(window[mine], language[mine]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def windows(data: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, time) bytes, the row of each window and its number of bytes; the last window of a row is filled up with 256."""
    length = np.diff(bounds)
    per = -(-length // size)
    row = np.repeat(np.arange(len(length)), per)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = bounds[row] + inside * size
    real = np.minimum(size, bounds[row + 1] - start)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, size)[start].astype(np.int16)
    out[np.arange(size)[None, :] >= real[:, None]] = 256
    return out, row, real


def text_languages(texts: W.Texts, network: Network) -> np.ndarray:
    """(row, language) mean probabilities over all bytes of each text; zeros for an empty one."""
    rows, classes = texts.hi - texts.lo, len(network.weights["bias"])
    window, row, real = windows(texts.data, texts.bounds)
    total = np.zeros((rows, classes))
    full = real == WINDOW
    for part in (np.flatnonzero(full), np.flatnonzero(~full)):
        for i in range(0, len(part), _AT_ONCE):
            mine = part[i : i + _AT_ONCE]
            p = network.labels(network.states(window[mine])[0])
            p = p.sum(axis=0) if full[mine[0]] else (p * (window[mine].T < 256)[:, :, None]).sum(axis=0)
            for k in range(classes):
                total[:, k] += np.bincount(row[mine], p[:, k], minlength=rows)
    return total / np.maximum(1, np.diff(texts.bounds))[:, None]


def training_sample(docs: DataFrame, docs_each: int = DOCS, pieces: int = PIECES, sample: int = SAMPLE, window: int = WINDOW) -> list:
    """(lang, pieces): about ``docs_each`` documents of each language, chosen by a hash; at most twice ``sample`` rows in all."""
    ours = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & (id_remainder("doc_id", HELD_OUT) != HELD_OUT_AT))
    # one row a language, as the network's output has a column for each
    counts = ours.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("each", F.least(F.lit(float(docs_each)), F.lit(float(sample)) / F.count(F.lit(1)).over(Window.partitionBy())))
    drawn = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id"), F.lit("language"))).otherwise(F.xxhash64(F.col("text"), F.lit("language")))
    chance = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda i: F.substr(F.col("text"), (F.lit(1) + F.pmod(F.xxhash64(F.col("doc_id"), i), F.greatest(F.lit(1), F.length("text") - window + 1))).cast("int"), F.lit(window)),
    )
    chosen = ours.join(F.broadcast(counts), "lang").filter(chance * F.col("n") < F.col("each"))
    chosen = chosen.select("lang", place.alias("pieces"), (chance * F.col("n") / F.col("each")).alias("order"))
    return chosen.orderBy("order", "lang", "pieces").limit(2 * sample).select("lang", "pieces").collect()


def train(docs: DataFrame, **bounds) -> tuple[list[str], Network] | None:
    """The languages in order and the network; None if nothing can be learned."""
    import pyarrow as pa

    sample = [(r["lang"], p) for r in training_sample(docs, **bounds) for p in r["pieces"]]
    if not sample:
        return None
    sample.sort()
    names = sorted({lang for lang, _ in sample})
    texts = next(W.groups(pa.array([p for _, p in sample], pa.string()), 1 << 40))
    window, row, _ = windows(texts.data, texts.bounds)
    language = np.array([names.index(lang) for lang, _ in sample])[row]
    network = Network(len(names))
    network.train(window, language)
    return names, network


def predict(docs: DataFrame, model: tuple[list[str], Network] | None, carry: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def start():
        if sent.value is None:
            return lambda texts: [["und"] * (texts.hi - texts.lo), np.zeros(texts.hi - texts.lo)]
        names, network = sent.value

        def work(texts: W.Texts) -> list:
            p = text_languages(texts, network)
            best = p.argmax(axis=1)
            some = np.diff(texts.bounds) > 0
            return [[names[k] if s else "und" for k, s in zip(best, some, strict=True)], np.where(some, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)]

        return work

    # a text without a letter isn't read
    letters = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    return map_texts(docs, letters, "lang_pred string, score double", start, carry=carry)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    out = predict(docs, train(docs), carry=["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", (id_remainder("doc_id", HELD_OUT) == HELD_OUT_AT).alias("held_out"), "lang_pred", "score")
