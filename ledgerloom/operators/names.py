"""Resolve dirty party names (file names, OCR text) against a party master of any size.

The best master name has the highest similarity (C12); on a tie the earlier master entry wins; a name whose best score is 0 (or below
``min_score``) stays unresolved. Each *distinct* dirty name is looked up in an index of the master that prunes exactly:

* master names lie in blocks of one length. No name of a block can be more similar than 2 * min(la, lb) / (la + lb) allows, since a common subsequence is
  at most as long as the shorter name. Blocks are visited by falling bound, until the bound is under the best score found.
* inside a block, a common subsequence is at most as long as the letters that both names have (counted as often as in both); only names
  whose bound reaches the best score get their subsequence computed, for all of them at once, one machine word a name.

The master travels to the tasks in parts of a checked size (``PART_BYTES``). One part is the usual case; a larger master takes one pass over the distinct names
a part, and the passes' best matches are merged by a grouped maximum. So neither the plan nor the driver grows beyond a part, no (name, master) pair is
ever a row, and nothing is shuffled but the distinct names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import WORD_BITS
from ..session import materialize
from .scan import ordered_scan, quoted

# Bytes of master names that are sent to the tasks at a time.
PART_BYTES = 16 << 20
# Names of a block are computed so many at a time.
BATCH = 4096
# Letters are counted in so many groups; a group's common count is never under that of its letters.
GROUPS = 64


class NameIndex:
    """Master names (with their positions in the list) in blocks of one length."""

    def __init__(self, names: list[str], positions: list[int]) -> None:
        order = sorted(range(len(names)), key=lambda i: (len(names[i]), positions[i]))
        self.names, self.positions = [names[i] for i in order], np.array([positions[i] for i in order], np.int64)
        self.letters = {ch: i for i, ch in enumerate(sorted(set("".join(self.names))))}
        lengths = np.array([len(n) for n in self.names], np.int64)
        starts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1])) if len(lengths) else np.zeros(0, np.int64)
        self.blocks = [(int(lengths[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(lengths)])]
        self._codes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def codes(self, length: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The letters of a block's names as numbers, one row a name, and how many of each group of letters a name has."""
        if length not in self._codes:
            n = hi - lo
            codes = np.fromiter((self.letters[ch] for name in self.names[lo:hi] for ch in name), np.int32, n * length).reshape(n, length)
            group = np.arange(n)[:, None] * GROUPS + codes % GROUPS
            self._codes[length] = codes, np.bincount(group.ravel(), minlength=n * GROUPS).reshape(n, GROUPS).astype(np.uint16)
        return self._codes[length]

    def best(self, name: str) -> tuple[int, int, str | None]:
        """(score, position, master name) of the best match, the first in the list among equals; score 0: none."""
        la, best = len(name), (0, 0, None)
        if not la:  # only an empty name is like it
            return next(((100, int(self.positions[lo]), "") for lb, lo, _ in self.blocks if not lb), best)
        bounds = sorted(((score(min(la, lb), la, lb) if lb else 0, lb, lo, hi) for lb, lo, hi in self.blocks), reverse=True)
        for bound, lb, lo, hi in bounds:
            if bound < max(best[0], 1):
                break
            best = self._in_block(name, lb, lo, hi, best)
        return best

    def _in_block(self, name: str, lb: int, lo: int, hi: int, best: tuple[int, int, str | None]) -> tuple[int, int, str | None]:
        la, (codes, counts) = len(name), self.codes(lb, lo, hi)
        mine = [self.letters.get(ch, -1) for ch in name]
        have = np.bincount([k % GROUPS for k in mine if k >= 0], minlength=GROUPS).astype(np.uint16)
        used = np.flatnonzero(have)
        for a in range(0, hi - lo, BATCH):
            common = np.minimum(counts[a : a + BATCH, used], have[used]).sum(axis=1, dtype=np.int64)
            left = np.flatnonzero(scores(common, la, lb) >= max(best[0], 1))
            if not len(left):
                continue
            found = scores(lcs(mine, codes[a + left]), la, lb)
            top = int(found.max())
            first = left[found == top]
            first = int(a + lo + first[np.argmin(self.positions[lo + a + first])])
            if top > 0 and (top, -int(self.positions[first])) > (best[0], -best[1]):
                best = (top, int(self.positions[first]), self.names[first])
        return best


def score(common: int, la: int, lb: int) -> int:
    """C12 of two names with a common subsequence of this length."""
    return int(scores(np.array([common]), la, lb)[0])


def scores(common: np.ndarray, la: int, lb: int) -> np.ndarray:
    return np.rint(100.0 * ((2.0 * common.astype(np.float64)) / float(la + lb))).astype(np.int64)


def lcs(mine: list[int], rows: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence with each row (rows of one length): one word a row where they fit, else the plain table."""
    n = rows.shape[1]
    if n <= WORD_BITS:
        full = np.uint64((1 << n) - 1)
        bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
        where = {letter: ((rows == letter) * bits).sum(axis=1, dtype=np.uint64) for letter in set(mine) - {-1}}
        v = np.full(len(rows), full)
        for letter in mine:
            if letter >= 0:
                u = v & where[letter]
                v = ((v + u) | (v - u)) & full
        return n - np.bitwise_count(v).astype(np.int64)
    before = np.zeros((len(rows), n + 1), np.int64)
    for letter in mine:
        row = np.zeros_like(before)
        hit = before[:, :-1] + (rows == letter)
        row[:, 1:] = np.maximum(before[:, 1:], np.where(rows == letter, hit, 0))
        before = np.maximum.accumulate(row, axis=1)
    return before[:, -1]


def master_parts(master: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[tuple[list[str], list[int]]]:
    """The master's names and positions in parts of about ``part_bytes``, each small enough to send to every task."""
    master = materialize(master.where(F.col("party_name").isNotNull()).select("party_name", F.col("position").cast("long").alias("position")), "party_master")
    size = master.agg(F.sum(F.octet_length("party_name") + 16).alias("b")).head()["b"] or 0
    parts = int(size // part_bytes) + 1
    for part in range(parts):
        rows = master.where(F.pmod(F.xxhash64("party_name"), F.lit(parts)) == part).toArrow()  # at most about part_bytes
        yield rows.column("party_name").to_pylist(), rows.column("position").to_pylist()


def numbered_master(names: DataFrame) -> DataFrame:
    """A party master in the order of its names: position is the rank of the name. One range sort, ranks from the counts of the sorted parts."""
    names = names.select("party_name").where(F.col("party_name").isNotNull()).distinct().withColumn("_all", F.lit(0))
    return ordered_scan(names, ["_all"], ["party_name"], row_number="position").drop("_all")


def resolve_names(df: DataFrame, name_col: str, master: DataFrame, min_score: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """(name_col, party_name, score) for the distinct names of ``df``; party_name null when no score > min_score.

    ``master``: (party_name, position). Null names are left out; null master names count for nothing; of a master name that is listed twice the first position
    counts; an empty master resolves nothing."""
    names = materialize(df.select(quoted(name_col).alias("name")).where(F.col("name").isNotNull()).distinct(), "names")
    found = None
    for part in master_parts(master, part_bytes):
        more = _best_in_part(names, part)
        found = more if found is None else found.unionByName(more)
    best = found.groupBy("name").agg(F.max(F.struct("score", (-F.col("position")).alias("neg_position"), "party_name")).alias("_m"))
    return best.select(
        F.col("name").alias(name_col),
        F.when(F.col("_m.score") > min_score, F.col("_m.party_name")).alias("party_name"),
        F.col("_m.score").alias("score"),
    )


def _best_in_part(names: DataFrame, part: tuple[list[str], list[int]]) -> DataFrame:
    sent = names.sparkSession.sparkContext.broadcast(part)  # part_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = NameIndex(*sent.value)
        for batch in batches:
            found = [index.best(n) for n in batch.column("name").to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.string()))] if found else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("name"), *columns], names=["name", "score", "position", "party_name"])

    return names.mapInArrow(run, "name string, score int, position bigint, party_name string")
