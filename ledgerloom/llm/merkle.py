"""Merkle manifest of a dataset as a persistent tree: a tampered leaf makes a new version that copies its ancestors and shares all else.

H is the lower-case hex SHA-256 of its inputs, concatenated (digests as hex text). A row's leaf is H of its fields in order, each ``-`` if
null, else its UTF-8 length, ``:`` and its value. Leaves of a source ascend by id; as long as several nodes remain, every ``FAN``
consecutive ones become their H (a last run may be shorter, down to one); what remains is the source's root. The roots of the sources, in order of
source (null first, by bytes), make the root of the dataset in the same way.

How the tree is spread: rows are ranked by one range sort of slim rows (id, digests), and ``FAN`` ** ``LEVELS`` consecutive leaves of a source
are an aligned block, held as one row: the leaves' digests, the inner nodes above them, and, for every tampered leaf, the copies of its ancestors
inside the block (the block's part of that version). The roots of the blocks are leaves of the next tree of blocks, and so on, so no task sees more than a
block and a tree of 10^11 leaves has three such layers. Down the layers every block gets its path: for each level above it, the siblings before
and after. A version goes on from its copied block root along that path, which is the same for all versions of the block; a version is
its copied nodes alone (``versions``), everything else is read from the original.

Defined results: null fields are ``-``; a null id comes first in its source; equal ids are in the order of their leaves, and of equal leaves any is first; repeated
rows are leaves of their own; null source is a source; a row marked as tampered whose text doesn't change makes a version that verifies; an empty table
gives an empty table. Only the named fields are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import id_remainder
from ledgerloom.session import materialize

FAN = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIZE = 32
#: The letters that the digest's tampering changes.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPERED = 5


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The 32 bytes of a row's leaf digest."""
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)), 256))


def height(nodes: int) -> int:
    """Levels above so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def inner_levels(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, the given ones first."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([_h("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """(siblings before, siblings after) of the node above ``at`` on each level but the last."""
    for nodes in levels[:-1]:
        first = at - at % FAN
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])
        at //= FAN


def copied_path(digest: str, path) -> list[str]:
    """The ancestors of a node that has another digest, beside the original siblings."""
    out = []
    for before, after in path:
        digest = _h(before + digest + after)
        out.append(digest)
    return out


def _texts(packed) -> list[str]:
    data = bytes(packed).hex()
    return [data[i : i + 2 * SIZE] for i in range(0, len(data), 2 * SIZE)]


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows, written, with ``pos`` (from 0) within their key in the given order and ``size``, the key's rows.

    One range sort deals rows of one key to many tasks; a row's place in its task and the counts of the tasks before it give its
    position. Rows are spread by their place in the input where all else is equal."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_spread", F.monotonically_increasing_id())
    by = [F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_spread")]
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_spread")
    ranged = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("_task", F.shiftright("_place", 33))
    counts = ranged.groupBy(key, "_task").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first"))  # a row a task and key
    whole = Window.partitionBy(key)
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("_key"), F.col("_task").alias("_t"), "_first", F.sum("n").over(whole).alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    out = ranged.join(counts, ranged[key].eqNullSafe(counts["_key"]) & (ranged["_task"] == counts["_t"]))
    return out.withColumn("pos", F.col("_before") + F.col("_place") - F.col("_first")).drop("_place", "_task", "_key", "_t", "_first", "_before")


def blocks(nodes: DataFrame, key: str, name: str, high: int = LEVELS) -> DataFrame:
    """One written row per aligned block (FAN ** high) of (key, pos, size, digest [, changed, id]): its nodes packed, the copied nodes of its versions, its root."""
    has_versions = "changed" in nodes.columns
    columns = [key, "pos", "size", "digest", *(["id", "changed"] if has_versions else [])]
    nodes = nodes.select(*columns).withColumn("block", F.floor(F.col("pos") / FAN**high).cast("bigint"))
    key_type = nodes.schema[key].dataType.simpleString()
    id_type = nodes.schema["id"].dataType.simpleString() if has_versions else "bigint"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table.column("size")[0].as_py()
        digests = [d.as_py().hex() for d in table.column("digest")]
        levels = inner_levels(digests, min(high, height(size)))
        at, copies = [], []
        for k, d in enumerate(table.column("changed") if has_versions else ()):
            if d.as_py() is not None:
                digest = d.as_py().hex()
                at.append(k)
                copies += [digest, *copied_path(digest, siblings(levels, k))]
        packed = [bytes.fromhex("".join(x)) for x in (digests, (d for level in levels[1:] for d in level), copies)]
        ids = table.column("id").combine_chunks() if has_versions else pa.nulls(len(digests), pa.int64())
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        return pa.table({
            key: table.column(key).slice(0, 1),
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "size": pa.array([size], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "leaves": pa.array([packed[0]], pa.binary()),
            "inner": pa.array([packed[1]], pa.binary()),
            "changed_at": pa.array([at], pa.list_(pa.int32())),
            "copies": pa.array([packed[2]], pa.binary()),
            "top": pa.array([bytes.fromhex(levels[-1][0])], pa.binary()),
        })

    schema = f"`{key}` {key_type}, block bigint, size bigint, ids array<{id_type}>, leaves binary, inner binary, changed_at array<int>, copies binary, top binary"
    return materialize(nodes.groupBy(key, "block").applyInArrow(run, schema), name)


_PATH = "array<struct<before: string, after: string>>"


def paths(table: DataFrame, key: str, name: str, high: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """For a table of blocks: (key, block, path) up to the key's root, and (key, root) of each key.

    The blocks' roots are the nodes of the layer above; ``path`` has the siblings on each level above the block's own root, nearest first."""
    key_type = table.schema[key].dataType.simpleString()
    none = F.array().cast(_PATH)
    if not table.where(F.col("size") > FAN**high).limit(1).count():  # every tree is one block
        return table.select(key, "block", none.alias("path")), table.select(key, F.col("top").alias("root"))
    above = table.select(key, F.col("block").alias("pos"), F.ceil(F.col("size") / FAN**high).cast("bigint").alias("size"), F.col("top").alias("digest"))
    upper = blocks(above, key, f"{name}_above", high)
    upper_paths, roots = paths(upper, key, f"{name}_above", high)
    return expanded(upper, upper_paths, key, high).withColumnRenamed("pos", "block"), roots


def expanded(table: DataFrame, above: DataFrame, key: str, high: int = LEVELS) -> DataFrame:
    """(key, pos, path) of every node that the blocks hold: its siblings in the block, then the block's own path."""
    key_type = table.schema[key].dataType.simpleString()
    rows = table.join(above.select(F.col(key).alias("_k"), F.col("block").alias("_b"), "path"), table[key].eqNullSafe(F.col("_k")) & (table["block"] == F.col("_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for k in range(batch.num_rows):
                digests = _texts(batch.column("leaves")[k].as_py())
                levels = inner_levels(digests, min(high, height(batch.column("size")[k].as_py())))
                rest, first = batch.column("path")[k].as_py(), batch.column("block")[k].as_py() * FAN**high
                for lo in range(0, len(digests), FAN * FAN):
                    here = range(lo, min(lo + FAN * FAN, len(digests)))
                    out = [[{"before": b, "after": a} for b, a in siblings(levels, at)] + rest for at in here]
                    same = batch.column(key).take(pa.array(np.full(len(here), k, np.int32)))
                    yield pa.RecordBatch.from_arrays([same, pa.array([first + i for i in here], pa.int64()), pa.array(out, step)], names=[key, "pos", "path"])

    return rows.select(key, table["block"].alias("block"), "size", "leaves", "path").mapInArrow(run, f"`{key}` {key_type}, pos bigint, path {_PATH}")


@dataclass
class Manifest:
    """``table``: the blocks of all sources with ``path`` (up to the dataset's root), ``subroot`` and ``root``, one row per block."""

    table: DataFrame
    id_type: str
    high: int = LEVELS

    def leaves(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root of every leaf (digests as hex text)."""
        high = self.high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    digests, levels, above, versions = _unpack(row, high)
                    subroot, root = (row.column(c)[0].as_py().hex() for c in ("subroot", "root"))
                    proof_above = "".join(b + a for b, a in above)
                    proofs, folded = [], []
                    for at, digest in enumerate(digests):
                        own = list(siblings(levels, at))
                        proofs.append(_h("".join(b + a for b, a in own) + proof_above))
                        copies = versions[at] if at in versions else [digest, *copied_path(digest, own)]
                        folded.append((copies + copied_path(copies[-1], above))[-1])
                    texts = [digests, [subroot] * len(digests), [root] * len(digests), proofs, folded]
                    yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), *(pa.array(t, pa.string()) for t in texts)], names=names)

        return self.table.mapInArrow(run, f"id {self.id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")

    def versions(self, key: str = "source") -> DataFrame:
        """The copied nodes of every version: key, pos (of the tampered leaf, which names the version), id, level (0: the leaf), digest.

        All other nodes of a version are those of the original tree."""
        high = self.high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    _, _, above, versions = _unpack(row, high)
                    first = row.column("block")[0].as_py() * FAN**high
                    nodes = [(at, level, d) for at, copies in versions.items() for level, d in enumerate(copies + copied_path(copies[-1], above))]
                    if nodes:
                        at = pa.array([n[0] for n in nodes], pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [row.column(key).take(pa.array(np.zeros(len(nodes), np.int32))), pa.array([first + n[0] for n in nodes], pa.int64()), row.column("ids").flatten().take(at), pa.array([n[1] for n in nodes], pa.int32()), pa.array([n[2] for n in nodes], pa.string())],
                            names=[key, "pos", "id", "level", "digest"],
                        )

        return self.table.mapInArrow(run, f"`{key}` {self.table.schema[key].dataType.simpleString()}, pos bigint, id {self.id_type}, level int, digest string")


def _unpack(row: pa.RecordBatch, high: int):
    """(leaves, levels, path above, copied nodes in the block by place of the leaf) of a row of a manifest."""
    digests = _texts(row.column("leaves")[0].as_py())
    inner, levels = _texts(row.column("inner")[0].as_py()), [digests]
    for _ in range(min(high, height(row.column("size")[0].as_py()))):
        n = -(-len(levels[-1]) // FAN)
        levels.append(inner[:n])
        inner = inner[n:]
    above = [(p["before"], p["after"]) for p in row.column("path")[0].as_py()]
    copies, at = _texts(row.column("copies")[0].as_py()), row.column("changed_at")[0].as_py()
    return digests, levels, above, {a: copies[i * len(levels) : (i + 1) * len(levels)] for i, a in enumerate(at)}


def build(docs: DataFrame, tampered: Column, changed_text: Column, fields: Sequence[str] = FIELDS, id_column: str = "doc_id", key: str = "source", text: str = "text", high: int = LEVELS) -> Manifest:
    """The manifest of all rows, with a version for each row of ``tampered``, whose text became ``changed_text``."""
    values = [F.col(f"`{f}`") for f in fields]
    other = [changed_text if f == text else F.col(f"`{f}`") for f in fields]
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{key}`").alias("source"), leaf(values).alias("digest"), F.when(F.coalesce(tampered, F.lit(False)), leaf(other)).alias("changed"))
    rows = numbered(materialize(rows, "leaves"), "source", ["id", "digest"], "ranked_leaves")
    table = blocks(rows, "source", "leaf_blocks", high)
    own, subroots = paths(table, "source", "leaf_blocks", high)
    subroots = materialize(subroots.select("source", F.col("root").alias("subroot")), "subroots")
    # the sources' roots are the leaves of the dataset's tree
    tops = numbered(subroots.withColumn("all", F.lit(0)), "all", ["source"], "ranked_sources").withColumnRenamed("subroot", "digest")
    tops = materialize(tops, "sources")
    dataset = blocks(tops, "all", "source_blocks", high)
    above, root = paths(dataset, "all", "source_blocks", high)
    tops = tops.join(expanded(dataset, above, "all", high).drop("all"), "pos").crossJoin(F.broadcast(root.select("root")))  # one row
    tops = tops.select(F.col("source").alias("s"), F.col("digest").alias("subroot"), "root", F.col("path").alias("source_path"))
    own = own.select(F.col("source").alias("p"), F.col("block").alias("b"), "path")
    own = own.join(tops, own["p"].eqNullSafe(tops["s"])).select("p", "b", "subroot", "root", F.concat("path", "source_path").alias("path"))
    same = table["source"].eqNullSafe(own["p"]) & (table["block"] == own["b"])
    return Manifest(table.join(own, same).drop("p", "b"), docs.schema[id_column].dataType.simpleString(), high)


def digest(docs: DataFrame, high: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document; every fifth (by a hash of its id) has its A-Z lower-cased."""
    tampered = F.col("doc_id").isNotNull() & (id_remainder("doc_id", TAMPERED) == 0)
    out = build(docs, tampered, F.translate("text", CAPITALS, SMALL), high=high).leaves()
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(leaf_levels: int = 6, source_levels: int = 3) -> str:
    """The tree level by level in SQL, for up to FAN ** leaf_levels leaves a source."""

    def value(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def tree(nodes: str, name: str, key: str, levels: int) -> list[str]:
        """Nodes of each level and, from the bottom up, each bottom node's siblings."""
        out = [f"{name}_n0 AS MATERIALIZED (SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {nodes})", f"{name}_p0 AS MATERIALIZED (SELECT {key}, pos AS leaf_pos, pos AS place, '' AS proof, t AS folded FROM {nodes})"]
        for i in range(levels):
            out.append(f"{name}_r{i} AS MATERIALIZED (SELECT {key}, pos // {FAN} AS run, any_value(n) AS n, string_agg(h, '' ORDER BY pos) AS run_text FROM {name}_n{i} GROUP BY ALL)")
            out.append(f"{name}_n{i + 1} AS MATERIALIZED (SELECT {key}, run AS pos, CASE WHEN n = 1 THEN run_text ELSE sha256(run_text) END AS h, count(*) OVER (PARTITION BY {key}) AS n FROM {name}_r{i})")
            before, after = f"substr(run_text, 1, 64 * (place % {FAN}))", f"substr(run_text, 64 * (place % {FAN}) + 65)"
            out.append(
                f"{name}_p{i + 1} AS MATERIALIZED (SELECT p.{key}, leaf_pos, place // {FAN} AS place, proof || CASE WHEN n = 1 THEN '' ELSE {before} || {after} END AS proof, "
                f"CASE WHEN n = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded FROM {name}_p{i} p JOIN {name}_r{i} r ON p.{key} IS NOT DISTINCT FROM r.{key} AND p.place // {FAN} = r.run)"
            )
        return out

    crc = (
        "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), "
        "lambda crc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    )
    changed = f"CASE WHEN doc_id IS NOT NULL AND {crc} % {TAMPERED} = 0 THEN translate(text, '{CAPITALS}', '{SMALL}') ELSE text END"
    fields = [value(c) for c in FIELDS]
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, source, sha256({' || '.join(f'({v})' for v in fields)}) AS h, sha256({' || '.join(f'({v})' for v in [*fields[:-1], value(changed)])}) AS t FROM documents)",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM d)",
        *tree("leaves", "a", "source", leaf_levels),
        f"subroots AS MATERIALIZED (SELECT 0 AS z, source, h, h AS t, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM a_n{leaf_levels})",
        *tree("subroots", "s", "z", source_levels),
    ]
    # a version's own subroot goes on through the sources' levels
    fold, joins, at = "p.folded", "", "s.pos"
    for i in range(source_levels):
        before, after = f"substr(r{i}.run_text, 1, 64 * ({at} % {FAN}))", f"substr(r{i}.run_text, 64 * ({at} % {FAN}) + 65)"
        fold = f"CASE WHEN r{i}.n = 1 THEN {fold} ELSE sha256({before} || {fold} || {after}) END"
        joins += f" JOIN s_r{i} r{i} ON {at} // {FAN} = r{i}.run"
        at = f"({at} // {FAN})"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root.h AS root, sha256(p.proof || q.proof) AS proof_sha256, {fold} AS folded_root, {fold} = root.h AS verified
FROM leaves l JOIN a_p{leaf_levels} p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.leaf_pos JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
JOIN s_p{source_levels} q ON q.leaf_pos = s.pos CROSS JOIN s_n{source_levels} root{joins}"""


ORACLE = _oracle()
