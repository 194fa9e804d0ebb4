"""The Merkle manifest against a plain tree that is built anew for every tampered leaf."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, pos int, path string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 16
        out += nodes[first:at] + nodes[at + 1 : first + 16]
        at //= 16
    return out


def plain(rows):
    """doc_id, leaf, subroot, root, proof, root with the tampered leaf in place: the whole tree is hashed again for each."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    ordered = [sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in names]
    leaves = [[plain_leaf(r) for r in some] for some in ordered]
    trees = [plain_tree(x) for x in leaves]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for s, some in enumerate(ordered):
        for i, r in enumerate(some):
            changed = leaves[s][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            if changed == leaves[s][i]:
                folded = top[-1][0]
            else:
                folded = plain_tree([plain_tree(leaves[s][:i] + [changed] + leaves[s][i + 1 :])[-1][0] if k == s else t[-1][0] for k, t in enumerate(trees)])[-1][0]
            proof = h("".join(plain_siblings(trees[s], i) + plain_siblings(top, s)))
            out.append((r[0], leaves[s][i], trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def corpus():
    rng = random.Random(3)
    sizes = {"hot": 300, "b": 17, "c": 16, "one": 1, "ä": 40, None: 5} | {f"s{i}": 2 for i in range(30)}
    rows, ident = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            ident += rng.randrange(1, 4)
            text = rng.choice([None, "", "Some TEXT É", "all lower", "X" * rng.randrange(1, 3000)]) if rng.random() < 0.5 else f"Text Number {ident}"
            rows.append((ident, source, rng.choice(["en", "de", None]), rng.choice([None, len(text or "")]), text, "clash", 7, "clash"))
    rows += [(None, "hot", "en", 1, "No Id", "x", 1, "y"), (None, None, None, None, None, None, None, None)]
    rows += [rows[3]] * 3 + [(rows[5][0], "hot", "fr", 2, "Same ID, other Text", "x", 1, "y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_against_plain_tree(spark, levels):
    """Blocks of 16, 256 and 4,096 leaves: trees of one, two and more layers of blocks give the same digests."""
    rows = corpus()
    got = merkle.digest(spark.createDataFrame(rows, SCHEMA).repartition(5), levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    order = lambda r: tuple((x is not None, x) for x in r)
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(plain(rows), key=order)
    assert got == want
    assert {r[-1] for r in got} == {True, False}


def test_versions_hold_copied_nodes_only(spark):
    rows = [(i, "a" if i < 40 else "b", "en", 1, f"T {i}", None, None, None) for i in range(60)]
    m = merkle.build(spark.createDataFrame(rows, SCHEMA), F.col("doc_id").isin(3, 45), F.lit("other"), high=1)
    found = {}
    for r in m.versions().collect():
        found.setdefault((r["source"], r["pos"], r["id"]), {})[r["level"]] = r["digest"]
    # 40 and 20 leaves have two levels to their source's root, then one to the dataset's; the leaf itself is level 0
    assert {k: sorted(v) for k, v in found.items()} == {("a", 3, 3): [0, 1, 2, 3], ("b", 5, 45): [0, 1, 2, 3]}
    folded = {r["id"]: r["folded_root"] for r in m.leaves().collect()}
    leaves = {s: [plain_leaf(r) for r in rows if r[1] == s] for s in "ab"}
    leaves["a"][3] = plain_leaf((3, "a", "en", 1, "other"))
    changed = plain_tree(leaves["a"])
    assert [found["a", 3, 3][i] for i in range(3)] == [leaves["a"][3], changed[1][0], changed[2][0]]
    assert found["a", 3, 3][3] == folded[3] == plain_tree([changed[-1][0], plain_tree(leaves["b"])[-1][0]])[-1][0]
    assert found["b", 5, 45][3] == folded[45] != folded[3]


def test_lone_leaf_and_empty(spark):
    one = [(7, "a", "en", 1, "ABC", None, None, None)]
    assert sorted(map(tuple, merkle.digest(spark.createDataFrame(one, SCHEMA)).collect())) == plain(one)
    empty = merkle.digest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_equal_rows_are_spread(spark):
    """Rows that are equal in everything, a third of the table, are ranked in several tasks."""
    rows = [(None, "hot", "en", 1, "same", None, None, None)] * 4000 + [(i, "b", "en", 1, "x", None, None, None) for i in range(100)]
    ranked = merkle.numbered(spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("id"), "source"), "source", ["id"], "ranked")
    assert ranked.groupBy("source").agg(F.countDistinct("pos").alias("n"), F.max("pos").alias("m")).orderBy("source").collect() == [("b", 100, 99), ("hot", 4000, 3999)]
    assert ranked.inputFiles() and len(ranked.inputFiles()) >= 4
