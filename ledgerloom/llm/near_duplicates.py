"""MinHash near-dedup by BagMinHash over the multiset of five-word shingles; links from weighted Jaccard similarity 0.8.

Words are maximal runs of folded letters, digits and non-ASCII bytes; a text of one to four words is one shingle.

Signature: a shingle's weight is its count, cut into shells [0,1), [1,2), [2,4), [4,8), ... Each shell of a shingle is a Poisson process
over time whose rate is the shell's width; a point falls on a random slot and a random weight of its shell, and counts only below the
shingle's weight. All of it comes from hashes of (shingle, shell, point), so equal weights see equal points. The first
point of each slot over all shingles is the signature: two multisets agree in a slot with probability equal to
their weighted Jaccard similarity. Points are made only up to a time by which nearly every slot is filled; a text with a slot still
open gets twice the time, so a signature is exact and costs about the number of slots, whatever the length.

Copies (equal word sequences, by a 128-bit digest) are one node. Nodes that agree in a band of ``ROWS`` slots share a bucket and are candidates. Each
bucket's centre is its node that shares most buckets with others. First each node is verified against the best centre of its buckets; then, in buckets
that still hold several components, against their own centres; then all pairs across the components that are still left in a bucket:
by a join in buckets of at most ``SMALL`` nodes, and block by block within tasks, which return links alone, in larger ones. So a group of copies costs a
star, and no link between components is lost. Verification is exact: the shingle multisets themselves are compared.

Defined results: null and empty texts are never linked; texts without words are linked if equal; the class of a document is the smallest
doc_id of its component (null ids are largest); repeated rows share a class; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.arrow import map_texts, small_batches
from ledgerloom.llm.components import components
from ledgerloom.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SMALL = 32  # nodes in a bucket whose pairs are made by a join
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 18
SLOTS = BANDS * ROWS
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _step(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)


def shingles(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, W.Words]:
    """(row, hash) of every shingle, rows in order, and the words."""
    w = W.words(texts, W.ALNUM)
    rows = texts.hi - texts.lo
    count = np.bincount(w.row, minlength=rows)
    first = np.cumsum(count) - count
    h = W.run_hashes(w.hash, SHINGLE)
    at = np.flatnonzero(w.row[: len(h)] == w.row[SHINGLE - 1 :]) if len(h) else np.zeros(0, np.int64)
    row, out = [w.row[at]], [h[at]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            row.append(short)
            out.append(W.mix(W.run_hashes(w.hash, n)[first[short]] + np.uint64(n)))
    row, out = np.concatenate(row), np.concatenate(out)
    order = np.lexsort((out, row))
    return row[order], out[order], w


def bags(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of distinct shingles, from sorted (row, hash)."""
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
    return row[new], h[new], np.diff(np.append(new, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(rows: int, row: np.ndarray, h: np.ndarray, count: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(rows, slots) 64-bit signatures of the bags; a row without shingles has zeros."""
    out = np.zeros((rows, slots), dtype=np.uint64)
    weight = np.bincount(row, count, minlength=rows)
    open_, factor = weight > 0, np.log(slots) + 3
    while open_.any():
        horizon = np.where(open_, slots * factor / np.maximum(weight, 1), 0)
        keys, times, ids = [], [], []
        shell, of = 0, np.flatnonzero(open_[row])
        while len(of):
            low = 0 if shell == 0 else 1 << (shell - 1)
            width = max(1, low)
            of = of[count[of] > low]
            alive, point = of, 0
            seed = W.mix(h[alive] + _step(shell + 1))
            t = np.zeros(len(alive))
            while len(alive):
                x = W.mix(seed + _step(2 * point + 1))
                t -= np.log(_uniform(x)) / width
                stay = t <= horizon[row[alive]]
                alive, seed, t, x = alive[stay], seed[stay], t[stay], x[stay]
                if not len(alive):
                    break
                y = W.mix(x + np.uint64(point + 1))  # slot from the high half, weight from the low half
                slot = ((y >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
                counts = low + (((y & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64) < count[alive]
                keys.append((row[alive] * slots + slot.astype(np.int64))[counts])
                times.append(t[counts])
                ids.append(y[counts])
                point += 1
            shell += 1
        key, time, ident = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((time, key))
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        filled = np.bincount(key[head] // slots, minlength=rows)
        done = open_ & (filled == slots)
        mine = head[done[key[head] // slots]]
        out.reshape(-1)[key[mine]] = ident[order[mine]]
        open_ &= ~done
        factor *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) bucket keys."""
    rows, slots = signature.shape
    parts = signature.reshape(rows, bands, slots // bands)
    key = np.zeros((rows, bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[2]):
        key = W.mix(key * _GOLD + parts[:, :, k])
    return key


def digests(texts: W.Texts, w: W.Words) -> list[bytes | None]:
    """128 bits of each text's word sequence, of its bytes if it has no words, None if it is empty."""
    import hashlib

    rows = texts.hi - texts.lo
    count = np.bincount(w.row, minlength=rows)
    first = np.cumsum(count) - count
    out: list[bytes | None] = [None] * rows
    some = np.flatnonzero(count)
    if len(some):
        up = W._POWERS.get(int(count.max()))[0][np.arange(len(w.row)) - first[w.row]]
        a, b = (W.mix(np.add.reduceat(v * up, first[some]) + count[some].astype(np.uint64)) for v in (w.hash, W.mix(w.hash ^ _GOLD)))
        for r, x in zip(some.tolist(), np.stack([a, b], 1), strict=True):
            out[r] = x.tobytes()
    for r in np.flatnonzero((count == 0) & (np.diff(texts.bounds) > 0)).tolist():
        out[r] = hashlib.md5(texts.data[texts.bounds[r] : texts.bounds[r + 1]].tobytes(), usedforsecurity=False).digest()
    return out


def features(docs: DataFrame) -> DataFrame:
    """(row.doc_id, node, weight, keys): digest, number of shingles and bucket keys of every document; node is null for empty texts."""

    def start():
        def work(texts: W.Texts) -> list:
            rows = texts.hi - texts.lo
            row, h, w = shingles(texts)
            weight = np.bincount(row, minlength=rows)
            keys = band_keys(signatures(rows, *bags(row, h))).view(np.int64)
            return [digests(texts, w), weight, [k.tolist() if n else [] for k, n in zip(keys, weight, strict=True)]]

        return work

    return map_texts(docs, F.col("text"), "node binary, weight bigint, keys array<bigint>", start, carry=["doc_id"])


def bag_arrays(docs: DataFrame) -> DataFrame:
    """(node, bag): the sorted shingle hashes of every document as bytes; the k-th repeat of a shingle has a hash of its own."""

    def start():
        def work(texts: W.Texts) -> list:
            rows = texts.hi - texts.lo
            row, h, w = shingles(texts)
            if len(h):
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
                at = np.arange(len(h))
                repeat = at - np.maximum.accumulate(np.where(new, at, 0))
                h = np.where(repeat > 0, W.mix(h + _GOLD * repeat.astype(np.uint64)), h)
            to = np.searchsorted(row, np.arange(rows + 1))
            return [digests(texts, w), [np.sort(h[a:b]).tobytes() for a, b in zip(to[:-1], to[1:], strict=True)]]

        return work

    return map_texts(docs, F.col("text"), "node binary, bag binary", start, carry=[]).select("node", "bag")


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, arrays: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) of nodes whose bags are similar enough."""

    def run(batches):
        for batch in batches:
            keep = [overlap(a, b) >= similarity for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = arrays.select(F.col("node").alias("u"), F.col("bag").alias("a"))
    right = arrays.select(F.col("node").alias("v"), F.col("bag").alias("b"))
    return small_batches(pairs).join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, weight, component) of every document; component is a node, null for a document linked with nothing but its copies."""
    found = materialize(features(docs).select("row.doc_id", "node", "weight", "keys"), "signatures")
    nodes = found.filter("node IS NOT NULL").groupBy("node").agg(F.first("weight").alias("weight"), F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"))
    members = nodes.select("node", "weight", "doc_id", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(members.join(sizes, "key"), "members")  # only nodes that share a bucket
    # the centre of a bucket is the node that shares most buckets with others: of a group of near copies, the one they are copies of
    shared = members.groupBy("node").agg(F.sum("n").alias("shared"), F.first("doc_id").alias("doc_id"))
    ranked = members.select("key", "node", "weight", "n").join(shared.select("node", "shared"), "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("shared", "node", "weight")).alias("centre"))
    buckets = materialize(ranked.drop("shared").join(centres, "key"), "buckets")
    arrays = _arrays(docs, materialize(shared.select("node", "doc_id"), "candidates"))

    def close(a: str, b: str):
        return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)

    def pair(a: str, b: str):
        return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]

    # every node with the best centre of its buckets
    spokes = buckets.filter(F.col("centre.node") != F.col("node")).filter(close("weight", "centre.weight"))
    tried = materialize(spokes.groupBy("node").agg(F.max("centre").alias("centre")).select(*pair("node", "centre.node")).distinct(), "pairs")
    links = materialize(verified(tried, arrays, similarity), "verified")
    parts = components(links)
    # then with the other centres, and then with all others, but only across components of a bucket
    for step in ("centres", "all"):
        mixed = buckets.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = mixed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").select("key")
        mixed = materialize(mixed.join(several, "key", "left_semi"), "mixed")
        if step == "centres":
            part = parts.select(F.col("node").alias("cn"), F.col("component").alias("part"))
            across = mixed.join(part, F.col("centre.node") == F.col("cn"), "left").withColumn("part", F.coalesce("part", "centre.node"))
            across = across.filter((F.col("component") != F.col("part")) & close("weight", "centre.weight")).select(*pair("node", "centre.node"))
        else:
            small = mixed.filter(F.col("n") <= SMALL)
            other = small.select("key", F.col("node").alias("other"), F.col("weight").alias("other_weight"), F.col("component").alias("part"))
            across = small.join(other, "key").filter((F.col("node") < F.col("other")) & (F.col("component") != F.col("part")) & close("weight", "other_weight"))
            across = across.select(*pair("node", "other"))
        across = materialize(across.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        links = verified(across, arrays, similarity)
        if step == "all":
            links = links.union(_large_buckets(mixed, arrays, similarity))
        links = materialize(links, "verified")
        if links.limit(1).count():
            stars = parts.filter("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            parts = components(stars.union(links))
        tried = tried.union(across)
    return found.select("doc_id", "node", "weight").join(parts, "node", "left")


def _large_buckets(mixed: DataFrame, arrays: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) across components within the buckets of more than SMALL nodes, as many as join the components.

    A bucket is dealt to blocks of bounded size, and each pair of blocks is a task's group: all its pairs are compared there, exactly, and only links
    leave it."""
    large = mixed.filter(F.col("n") > SMALL).select("key", "node", "weight", "component")
    sizes = large.groupBy("key").agg(F.greatest(F.ceil(F.sum("weight") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_NODES))).cast("int").alias("blocks"))
    dealt = large.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("key", "block", meets.alias("with"), "node", "component").select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "component")
    return dealt.join(arrays, "node").groupBy("key", "i", "j").applyInPandas(lambda rows: _compare(rows, similarity), "u binary, v binary")


def _compare(rows, similarity: float):
    """All pairs of a group across components (and across its two blocks, if it has two): the links that join components."""
    import pandas as pd

    bags = [np.frombuffer(x, np.uint64) for x in rows["bag"]]
    size = np.array([len(x) for x in bags])
    component = pd.factorize(rows["component"])[0]
    block = rows["block"].to_numpy()
    ids, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)[1:]
    shared = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(bags)), size)
    keep = count[ids] > 1
    owner, column = owner[keep], shared[ids[keep]]
    both = np.zeros((len(bags), len(bags)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(bags), 4096), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        both += has @ has.T
    u, v = np.nonzero(np.triu(both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6, 1))
    apart = (component[u] != component[v]) & ((block[u] != block[v]) | (rows["i"].iloc[0] == rows["j"].iloc[0]))
    u, v = u[apart], v[apart]
    a, b = np.minimum(component[u], component[v]), np.maximum(component[u], component[v])
    first = np.unique(a.astype(np.int64) * len(bags) + b, return_index=True)[1]
    node = rows["node"].to_numpy()
    return pd.DataFrame({"u": [min(node[i], node[j]) for i, j in zip(u[first], v[first], strict=True)], "v": [max(node[i], node[j]) for i, j in zip(u[first], v[first], strict=True)]}, columns=["u", "v"])


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, bag) of the wanted nodes (node, doc_id): one text each, that of a doc_id with the node's digest."""
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    bags = bag_arrays(texts).join(wanted.select("node"), "node", "left_semi")
    return materialize(bags.groupBy("node").agg(F.first("bag").alias("bag")), "bags")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the class) and kept (doc_id = component_id) of each document."""
    out = materialize(near_duplicates(docs).withColumn("class", F.coalesce("component", "node")), "classes")
    least = out.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return out.join(least, "class", "left").select(
        "doc_id",
        F.col("weight").alias("n_shingles"),
        F.coalesce("least", "doc_id").alias("component_id"),
        F.coalesce("least", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents' columns, one document of each class: the one of smallest doc_id; documents linked with nothing all stay."""
    out = materialize(near_duplicates(docs).withColumn("class", F.coalesce("component", "node")), "classes")
    least = out.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("least"))
    keep = least.select("least.doc_id", "least.node")
    # ids that name one text need no digest to be found again; the others (repeated or null ids) are found by digest
    once = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1 AND doc_id IS NOT NULL").select("doc_id")
    plain = keep.select("doc_id").join(once, "doc_id", "left_semi").union(out.filter("node IS NULL").select("doc_id").join(once, "doc_id", "left_semi"))
    kept = docs.join(plain.select(F.col("doc_id").alias("kept_id")), F.col("doc_id") == F.col("kept_id"), "left_semi")
    if not out.join(once, "doc_id", "left_anti").limit(1).count():
        return kept
    rest = docs.join(once.select(F.col("doc_id").alias("kept_id")), F.col("doc_id") == F.col("kept_id"), "left_anti")

    def start():
        return lambda texts: [digests(texts, W.words(texts, W.ALNUM))]

    rest = map_texts(rest, F.col("text"), "node binary", start)
    empty = rest.filter("node IS NULL").select("row.*")
    named = rest.join(keep.withColumnRenamed("node", "kept_node"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("node") == F.col("kept_node")), "left_semi")
    one = named.groupBy("node").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return kept.unionByName(one).unionByName(empty)
