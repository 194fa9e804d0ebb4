"""Embedding near-dedup: a hierarchical navigable small-world graph per shard; every vector queries every shard of its label.

Vectors are compared only with equal, non-null labels and equal lengths, by cosine in double precision; a link needs ``COSINE`` or more. Equal
vectors of a label are one node with a number of copies. A label's nodes are dealt by hash to shards of at most
``SHARD_BYTES`` of double-precision vectors, at least ``MIN_SHARDS``; each shard's graph is built by one task and written. Each unordered pair of shards
is a task of its own, in which the nodes of both query the other's graph (a shard with itself: its own); so no task holds more than two shards, however
large a label is, and a link found from either end counts for both.

In such a task the beam doubles until an audit passes: for one in ``AUDIT`` queries (``AUDITED`` at least) the graph's nearest node and all links are
compared with brute force over the shard, and ``RECALL`` of them must be found. A query whose beam ends in links may have more: it is
answered by an exact scan of the shard, in blocks. What a beam finds is verified in double precision. A task returns counts and a spanning forest
of its links, not the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, link with nothing and are
their own component; rows with equal label and vector link with each other; the component is the smallest vec_id; a null vec_id
is its own component unless it is linked; an empty table gives no rows. Other columns are not read and cannot clash.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.hnsw import Graph
from ledgerloom.session import materialize

COSINE = 0.93
SHARD_BYTES = 16 << 20
MIN_SHARDS = 4
FIRST_BEAM = 16
AUDIT, AUDITED, RECALL = 32, 64, 0.99
SCAN_BYTES = 32 << 20  # similarities of an exact scan at once
_SLACK = 1e-4  # single precision
_KEY = ["label", "width", "shard"]


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, node) of all rows; node is null for vectors that link with nothing."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    node = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))))
    return vectors.select("vec_id", "label", "embedding", F.when(F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False)), node).alias("node"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Double-precision rows of length 1, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build(rows):
    """One shard's rows to one row with its graph, nodes and copies."""
    import pandas as pd

    rows = rows.sort_values("node", ignore_index=True)
    order, sizes = Graph.order(len(rows))
    exact = _unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))[order]
    graph = Graph.build(exact.astype(np.float32), sizes)
    blob = graph.dump(exact=exact, copies=rows["copies"].to_numpy()[order], node=rows["node"].to_numpy().astype("S32")[order])
    return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in (*_KEY, "shards")}, "graph": [blob]})


def _audited(graph: Graph, exact: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Search with the least beam, doubled from FIRST_BEAM, whose audit passes."""
    n, beam = len(exact), FIRST_BEAM
    sample = np.unique(np.linspace(0, len(queries) - 1, min(max(AUDITED, len(queries) // AUDIT), len(queries))).astype(int))
    nearest, links = np.empty(len(sample)), np.empty(len(sample), int)
    for at in _slices(len(sample), n):
        truth = queries[sample[at]] @ exact.T
        nearest[at], links[at] = truth.max(axis=1), (truth >= COSINE).sum(axis=1)
    while beam < n:
        near = graph.search(queries[sample].astype(np.float32), beam)[1]
        hits = (near[:, 0] >= nearest - _SLACK).sum() + np.minimum((near >= COSINE - _SLACK).sum(axis=1), links).sum()
        if hits >= RECALL * (len(sample) + np.minimum(links, beam).sum()):
            ids, near = graph.search(queries.astype(np.float32), beam)
            return ids, near, beam
        beam *= 2
    return np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0)), 0  # the beam would hold the shard: scan it


def _slices(rows: int, width: int) -> list[slice]:
    step = max(1, SCAN_BYTES // (8 * max(1, width)))
    return [slice(i, min(rows, i + step)) for i in range(0, rows, step)]


class _Links:
    """Link counts of two shards' nodes (or of one shard's, with itself), and a spanning forest of the links."""

    def __init__(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> None:
        self.same = a is b
        self.sides = [a] if self.same else [a, b]
        self.first = [0, 0 if self.same else len(a["exact"])]  # number of a side's first node in ``part``
        self.counts = [np.zeros(len(x["exact"]), np.int64) for x in self.sides]
        self.part = np.arange(sum(len(x["exact"]) for x in self.sides))
        self.edges: list[tuple[int, int]] = []

    def join(self, node: int, others: np.ndarray) -> None:
        """Join the parts of ``others`` to that of ``node``, by one link for each part not joined before."""
        parts, at = np.unique(self.part[others], return_index=True)
        new = parts != self.part[node]
        if new.any():
            self.edges += [(node, int(others[i])) for i in at[new]]
            self.part[np.isin(self.part, parts[new])] = self.part[node]

    def scan(self, side: int, rows: np.ndarray, complete: np.ndarray) -> None:
        """All links of ``rows`` of a side; the other side's nodes that are not ``complete`` (scanned themselves) count them too."""
        to = 0 if self.same else 1 - side
        ours, theirs = self.sides[side], self.sides[to]
        for at in _slices(len(rows), len(theirs["exact"])):
            some = rows[at]
            linked = ours["exact"][some] @ theirs["exact"].T >= COSINE
            if self.same:
                linked[np.arange(len(some)), some] = False
            self.counts[side][some] += linked @ theirs["copies"]
            self.counts[to] += np.where(complete, 0, ours["copies"][some] @ linked)
            for i in np.flatnonzero(linked.any(axis=1)):
                self.join(self.first[side] + int(some[i]), self.first[to] + np.flatnonzero(linked[i]))

    def pairs(self, row: np.ndarray, other: np.ndarray) -> None:
        """Links among the candidate pairs (node of the first side, node of the last), each given once."""
        a, b = self.sides[0], self.sides[-1]
        good = np.zeros(len(row), bool)
        for at in _slices(len(row), a["exact"].shape[1]):
            good[at] = np.einsum("ij,ij->i", a["exact"][row[at]], b["exact"][other[at]]) >= COSINE
        row, other = row[good], other[good]
        if not len(row):
            return
        np.add.at(self.counts[0], row, b["copies"][other])
        np.add.at(self.counts[-1], other, a["copies"][row])
        order = np.argsort(row, kind="stable")
        nodes, first = np.unique(row[order], return_index=True)
        for node, others in zip(nodes, np.split(other[order], first[1:]), strict=True):
            self.join(int(node), self.first[1] + others)

    def table(self):
        import pandas as pd

        names = np.char.decode(np.concatenate([x["node"] for x in self.sides]))
        others: list[list[str]] = [[] for _ in names]
        for u, v in self.edges:
            others[u].append(names[v])
        return pd.DataFrame({"node": names, "links": np.concatenate(self.counts), "others": others})


def _query(rows):
    """Links between two shards (or within one): (node, links, others), others making a spanning forest."""
    import pandas as pd

    if len(rows) == 1 and rows["a"].iloc[0] != rows["b"].iloc[0]:  # the other shard has no nodes
        return pd.DataFrame({"node": pd.Series(dtype=str), "links": pd.Series(dtype="int64"), "others": pd.Series(dtype=object)})
    loaded = [Graph.load(blob) for blob in rows.sort_values("shard")["graph"]]
    found = _Links(loaded[0][1], loaded[-1][1])
    row, other, whole = [], [], []
    for side, (_, ours) in enumerate(loaded):
        graph, theirs = loaded[-1 - side]
        ids, near, beam = _audited(graph, theirs["exact"], ours["exact"])
        whole.append(near[:, -1] >= COSINE - _SLACK if beam else np.ones(len(ours["exact"]), bool))
        q, k = np.nonzero((near >= COSINE - _SLACK) & ~whole[-1][:, None])
        row.append(q if side == 0 else ids[q, k])
        other.append(ids[q, k] if side == 0 else q)
    for side in range(len(loaded)):
        found.scan(side, np.flatnonzero(whole[side]), whole[-1 - side])
    row, other = np.concatenate(row), np.concatenate(other)
    if found.same:
        row, other = np.minimum(row, other)[row != other], np.maximum(row, other)[row != other]
    open_ = ~whole[0][row] & ~whole[-1][other]
    width = len(whole[-1])
    pair = np.unique(row[open_] * width + other[open_])
    found.pairs(pair // width, pair % width)
    return found.table()


def _by_pair(built: DataFrame) -> DataFrame:
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    sent = built.select(*_KEY, "graph", other.alias("other"))
    sent = sent.select(*_KEY, F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b"), "graph")
    return sent.groupBy("label", "width", "a", "b").applyInPandas(_query, "node string, links bigint, others array<string>")


def links(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, copies, links to other nodes' copies), all rows with their node, and edges (u, v) that span the components."""
    rows = materialize(classes(vectors), "vectors")
    nodes = rows.filter("node IS NOT NULL").groupBy("label", "node").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumn("width", F.size("embedding")), "nodes")
    shards = nodes.groupBy("label", "width").agg(F.greatest(F.lit(MIN_SHARDS), F.ceil(F.count(F.lit(1)) * F.col("width") * 8 / F.lit(SHARD_BYTES))).cast("int").alias("shards"))
    dealt = nodes.join(shards, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    label = next(f.dataType.simpleString() for f in nodes.schema.fields if f.name == "label")
    built = dealt.groupBy(*_KEY).applyInPandas(_build, f"label {label}, width int, shard int, shards int, graph binary")
    found = materialize(_by_pair(materialize(built, "graphs")), "links")
    per = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("u"), F.explode("others").alias("v"))
    return nodes.select("node", "copies").join(per, "node", "left"), rows, edges


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    nodes, rows, edges = links(vectors)
    parts = components(edges)
    rows = rows.select("vec_id", "node").join(nodes, "node", "left").join(parts, "node", "left").withColumn("class", F.coalesce("component", "node"))
    rows = materialize(rows, "classes")
    least = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("least"))
    out = rows.join(least, "class", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM pair UNION SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x),
deg AS (SELECT x, count(*) AS n FROM pair GROUP BY x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN deg ON vec_id = deg.x LEFT JOIN low ON vec_id = low.x
"""
