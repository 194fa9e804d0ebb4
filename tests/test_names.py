"""Name resolution by the pruning index against every score, masters of several parts, names of sheets and statements through the master."""

import os
import random

import numpy as np
import pytest

from ledgerloom.operators import names as nm
from ledgerloom.operators.ledger import to_ledger
from ledgerloom.schemas import SHEET_HEADER
from ledgerloom.sources.files import read_files


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_score(a, b):
    if a == b:
        return 100
    return int(np.rint(100.0 * ((2.0 * plain_lcs(a, b)) / float(len(a) + len(b))))) if a and b else 0


def plain_best(name, master):
    score, _, best = max((plain_score(name, m), -p, m) for m, p in master)
    return (score, best) if score else (0, None)


def words(rng, n, longest=14):
    alphabet = "abcdeABC .éß中"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_index_against_every_score():
    rng = random.Random(3)
    master = [(w, i) for i, w in enumerate(words(rng, 300) + ["x" * 90, "ab" * 50, "abc" * 21])]
    rng.shuffle(master)
    index = nm.NameIndex([m for m, _ in master], [p for _, p in master])
    for name in words(rng, 150) + [m for m, _ in master[:40]] + ["", "zzz", "x" * 89 + "y", "ba" * 60, "abc" * 21 + "d"]:
        score, position, found = index.best(name)
        assert (score, found) == plain_best(name, master), name
        if found is not None:
            assert position == min(p for m, p in master if plain_score(name, m) == score)


@pytest.mark.parametrize("part_bytes", [1 << 20, 2000])
def test_resolve_names(spark, part_bytes):
    """One part and several parts of the master give the same; nulls, an empty name, a master name listed twice."""
    rng = random.Random(5)
    listed = [(w, i) for i, w in enumerate(words(rng, 200))] + [(None, 900)]
    listed.append((listed[50][0], 901))
    master = spark.createDataFrame(listed, "party_name string, position int")
    raw = words(rng, 80) + [None, "", "zzz"]
    got = nm.resolve_names(spark.createDataFrame([(r,) for r in raw + raw], "`raw.name` string"), "raw.name", master, part_bytes=part_bytes)
    known = [(m, p) for m, p in listed if m is not None]
    want = {r: plain_best(r, known) for r in raw if r is not None}
    assert {r["raw.name"]: (r["score"], r["party_name"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_empty_master(spark):
    master = spark.createDataFrame([], "party_name string, position int")
    got = nm.resolve_names(spark.createDataFrame([("a",)], "n string"), "n", master).collect()
    assert [(r["n"], r["party_name"], r["score"]) for r in got] == [("a", None, 0)]


def test_large_master_is_pruned(spark):
    """200,000 names: the index computes few subsequences, and the best match is the one that was damaged."""
    rng = random.Random(9)
    parts = ["North", "South", "Blue", "Stone", "River", "Paper", "Rope", "Glass", "Harbour", "Field", "Trading", "Works", "Brothers", "Union", "Supply"]
    master = [f"{rng.choice(parts)} {rng.choice(parts)} {rng.choice(parts)} {i:06d}" for i in range(200_000)]
    index = nm.NameIndex(master, list(range(len(master))))
    computed, lcs = [0], nm.lcs

    def counting(mine, rows):
        computed[0] += len(rows)
        return lcs(mine, rows)

    nm.lcs = counting
    try:
        for i in range(0, 200_000, 20_000):
            score, position, found = index.best(f"temp_{master[i]}.csv")
            assert found == master[i] and position == i
    finally:
        nm.lcs = lcs
    assert computed[0] < 10 * 200_000 / 4
    assert nm.numbered_master(spark.createDataFrame([(m,) for m in ("b", "a", None, "c", "a")], "party_name string")).orderBy("position").collect() == [("a", 1), ("b", 2), ("c", 3)]


def test_sheets_resolve_dirty_file_names_and_make_one_book(spark, tmp_path):
    """Two sheets of one party under misspelt names: one book in the order of their first dates; numbers are unique, dates of each sheet by its own format."""
    def sheet(name, dates, extra):
        lines = [f"Ledger of {name}", ",".join([*SHEET_HEADER, *extra])]
        lines += [",".join([d, d, str(i), *[""] * 11, *["x"] * len(extra)]) for i, d in enumerate(dates)]
        (tmp_path / f"SAP_{name}.csv").write_text("\n".join(lines) + "\n")

    sheet("Bluebird Papr", ["13/04/2024", "02/05/2024"], ["A", "B"])
    sheet("bluebird Paper 2", ["2024-03-01", "2024-03-02", "15.03.2024", "soon"], [])
    sheet("Harbour Rope", ["03/25/2024", "04/01/2024"], ["A"])
    assert len(os.listdir(tmp_path)) == 3
    master = spark.createDataFrame([("Bluebird Paper", 1), ("Harbour Rope Co", 2)], "party_name string, position int")
    rows = to_ledger(read_files(spark, str(tmp_path)), master=master).orderBy("customer_name", "idx").collect()
    assert [(r["customer_name"], r["idx"], str(r["posting_date"])) for r in rows] == [
        ("Bluebird Paper", 1, "2024-03-01"), ("Bluebird Paper", 2, "2024-03-02"), ("Bluebird Paper", 3, "2024-03-15"), ("Bluebird Paper", 4, "None"),
        ("Bluebird Paper", 5, "2024-04-13"), ("Bluebird Paper", 6, "2024-05-02"), ("Harbour Rope Co", 1, "2024-03-25"), ("Harbour Rope Co", 2, "2024-04-01"),
    ]
