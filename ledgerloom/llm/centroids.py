"""Clustering by centroids; the nearest centroid of a vector is found by the threshold algorithm.

Vectors become integers floor(``SCALE`` * x), so that sums, means and ties are exact and every run agrees. The first centroids are the
vectors with the smallest hash of their id. A round assigns each vector to its nearest centroid (squared Euclidean distance, ties to the
smaller number) and moves each centroid that has vectors to the floor of their mean; after ``ROUNDS`` rounds vectors are assigned once more.

Nearest centroid by the threshold algorithm: each dimension has its centroids sorted by value. From the vector's own value all
dimensions walk outward at once, each step taking the nearer of the next centroid below and above. A centroid met for the first time gets
its exact distance. The squared gaps of the walks' last steps add up to a bound that no centroid still unmet can be under; the walk ends when
that sum is strictly larger than the best exact distance, so a centroid at the same distance with a smaller number is still met.
A batch of vectors walks in numpy, and vectors that have ended leave it.

Spark deals out the work: integer vectors are written once, each pass sends the centroids (k times dimensions integers, a bound that doesn't depend
on the data) and gets one partial sum per task, cluster and dimension back, which Spark adds up; k times dimensions sums reach the driver.

Defined results: vectors that are null, of another length or hold null or non-finite components are left out; repeated ids
are vectors of their own, with equal ids in the order of their components; a null id counts as the empty text; with fewer vectors than centroids each
is the start of one; an empty table gives an empty table. Integers beyond 64 bits are an error, none is cut. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

CENTROIDS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SALT = "3"
#: Integers up to this size have squared distances and partial sums within 64 bits; larger ones go by Python's integers.
SMALL = 1 << 26
BATCH = 4096


def integer_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the vectors with all components, as integers."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    whole = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = rows.where(F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_column}`").alias("id"), x.alias("x"))
    beyond = F.raise_error(F.lit("a component is beyond 64 bits")).cast("bigint")
    return some.select("id", F.transform("x", lambda c: F.when(F.abs(c) * SCALE < 2.0**63, F.floor(c * F.lit(float(SCALE)))).otherwise(beyond)).alias("v"))


def start_hash(ident: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The vectors with the smallest hashes of their id, in that order (k rows reach the driver)."""
    return [r["v"] for r in vectors.select("v", start_hash(F.col("id")).alias("h")).orderBy("h", "v").limit(k).collect()]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, depth walked) of each vector, by the threshold algorithm. Integers of any one dtype."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")  # per dimension: centroids by value
    sorted_values = np.take_along_axis(centroids, order, axis=0)
    rows = len(v)
    cluster, best = np.full(rows, -1, np.int64), np.zeros(rows, v.dtype)
    depth = np.zeros(rows, np.int64)
    met = np.zeros((rows, k), bool)
    up = np.empty((rows, dims), np.int64)
    for d in range(dims):
        up[:, d] = np.searchsorted(sorted_values[:, d], v[:, d])
    down = up - 1
    active, dim = np.arange(rows), np.arange(dims)
    for step in range(k):
        at, below, above = v[active], down[active], up[active]
        gap_down = at - sorted_values[np.maximum(below, 0), dim]
        gap_up = sorted_values[np.minimum(above, k - 1), dim] - at
        take_down = (below >= 0) & ((above >= k) | (gap_down <= gap_up))
        place = np.where(take_down, below, above)
        gap = np.where(take_down, gap_down, gap_up)
        down[active] -= take_down
        up[active] += ~take_down
        reached = np.zeros((len(active), k), bool)
        reached[np.arange(len(active))[:, None], order[place, dim]] = True
        for c in np.flatnonzero(reached.any(axis=0)):
            new = active[reached[:, c] & ~met[active, c]]
            met[new, c] = True
            distance = ((v[new] - centroids[c]) ** 2).sum(axis=1)
            better = (cluster[new] < 0) | (distance < best[new]) | ((distance == best[new]) & (c < cluster[new]))
            cluster[new[better]], best[new[better]] = c, distance[better]
        depth[active] = step + 1
        active = active[~((gap**2).sum(axis=1) > best[active])]
        if not len(active):
            break
    return cluster, best, depth


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Integer vectors as rows; as Python's integers where squares could leave 64 bits."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return v if not len(v) or (v.max() <= SMALL and v.min() >= -SMALL) else v.astype(object)


def _fitting(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return centroids.astype(object) if v.dtype == object else centroids


def _sent(vectors: DataFrame, centroids: list[list[int]]):
    """Centroids for the tasks, and whether they are small enough for 64-bit squares."""
    c = np.array(centroids, dtype=np.int64)
    return vectors.sparkSession.sparkContext.broadcast((c, bool((np.abs(c) <= SMALL).all())))


def _walk(batch: pa.RecordBatch, sent) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, vectors, cluster, distance) of a batch, some thousand vectors at a time."""
    centroids, small = sent
    for lo in range(0, batch.num_rows, BATCH):
        v = _matrix(batch.column("v").slice(lo, BATCH), centroids.shape[1])
        v = v if small else v.astype(object)
        cluster, distance, _ = nearest(v, _fitting(v, centroids))
        yield lo, v, cluster, distance


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of each vector."""
    sent = _sent(vectors, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, v, cluster, distance in _walk(batch, sent.value):
                columns = [batch.column("id").slice(lo, len(v)), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance bigint")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    sent = _sent(vectors, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = sent.value[0].shape
        count, total = [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            for _, v, cluster, _ in _walk(batch, sent.value):
                for c in np.unique(cluster).tolist():
                    mine = v[cluster == c]
                    count[c] += len(mine)
                    total[c] = [a + b for a, b in zip(total[c], mine.sum(axis=0).tolist(), strict=True)]  # Python's integers
        rows = [(c, d, count[c], str(total[c][d])) for c in range(k) if count[c] for d in range(dims)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = [pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cluster", "dimension", "n", "total"])

    sums = vectors.mapInArrow(run, "cluster int, dimension int, n bigint, total string")
    sums = sums.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # centroids times dimensions rows
        out[r["cluster"]][r["dimension"]] = int(r["total"]) // r["n"]
    return out


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after all rounds; none for an empty table. ``vectors`` is read rounds + 1 times."""
    centroids = first_centroids(vectors, k)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(vectors, centroids)
        if centroids == before:  # a round that moves nothing would be repeated by all others
            break
    return centroids


def digest(rows: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector kept."""
    spark = rows.sparkSession
    vectors = materialize(integer_vectors(rows), "vectors")
    centroids = fit(vectors)
    if not centroids:
        return vectors.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).limit(0)
    assigned = materialize(assign(vectors, centroids), "assigned")
    table = spark.createDataFrame([(c, ",".join(map(str, v))) for c, v in enumerate(centroids)], "cluster int, text string")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.sum("distance").alias("inertia"))
    per = per.join(table.select("cluster", F.sha2("text", 256).alias("centroid_sha256")), "cluster").join(F.broadcast(whole))  # one row
    per = F.broadcast(per)  # a row a centroid
    return assigned.join(per, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same rounds in SQL, one row a vector and dimension."""
    ctes = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS})",
        "kept AS MATERIALIZED (SELECT r, vec_id, list_transform(x, lambda c: CAST(floor(1024 * c) AS BIGINT)) AS v FROM e WHERE len(list_filter(x, lambda c: c IS NOT NULL AND isfinite(c))) = len(x))",
        f"p AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(1, {DIMENSIONS} + 1)) AS d FROM kept)",
        f"c0 AS MATERIALIZED (SELECT n, unnest(v) AS x, unnest(range(1, {DIMENSIONS} + 1)) AS d FROM (SELECT v, row_number() OVER (ORDER BY sha256('{SALT}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS n FROM kept QUALIFY n < {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT r, min(n) AS n, any_value(best) AS best FROM (SELECT r, n, dist, min(dist) OVER (PARTITION BY r) AS best FROM "
            f"(SELECT p.r, c.n, sum((p.x - c.x) * (p.x - c.x)) AS dist FROM p JOIN c{i} c ON p.d = c.d GROUP BY p.r, c.n)) WHERE dist = best GROUP BY r)"
        )
        if i < ROUNDS:
            ctes.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c.n, c.d, CAST(CASE WHEN m.k IS NULL THEN c.x ELSE (m.s - ((m.s % m.k) + m.k) % m.k) // m.k END AS BIGINT) AS x FROM c{i} c "
                f"LEFT JOIN (SELECT a.n, p.d, sum(p.x) AS s, count(*) AS k FROM a{i} a JOIN p ON p.r = a.r GROUP BY a.n, p.d) m ON m.n = c.n AND m.d = c.d)"
            )
    return "WITH " + ",\n".join(ctes) + f"""
SELECT kept.vec_id, CAST(a.n AS INTEGER) AS cluster, CAST(a.best AS BIGINT) AS distance, CAST(sum(a.best) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(a.best) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM kept JOIN a{ROUNDS} a ON a.r = kept.r JOIN (SELECT n, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY n) h ON h.n = a.n"""


ORACLE = _oracle()
