"""Similarity 0-100 of two strings, 2 * LCS / (len a + len b), rounded half-even.

This is the ratio of an edit distance in which a substitution costs two
(insert + delete). It is computed with nested ``aggregate`` over the
characters (one DP row per character of ``a``), so it stays a JVM expression
and needs no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


# Longest string held in one 64-bit word by the bit-parallel form (room for the carry without overflow).
WORD_BITS = 62


def lcs_bits(a: Column, b: Column) -> Column:
    """LCS length with one machine word per DP row (bit-parallel LCS, Allison-Dix / Hyyro); needs len(b) <= 62.

    ``v`` has a bit per position of ``b``; for each character of ``a`` the positions of that character in
    ``b`` (``u``) update it as v = ((v + u) | (v - u)) masked to len(b) bits; the zero bits are the LCS."""
    n = F.length(b)
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, k)  # noqa: E731  (1 << k for a column k)
    mask = bit(n) - 1

    def step(v, i):
        ch = a.substr(i, F.lit(1))
        match = F.aggregate(
            F.sequence(F.lit(1), n), F.lit(0).cast("long"),
            lambda acc, j: acc.bitwiseOR(F.when(b.substr(j, F.lit(1)) == ch, bit(j - 1)).otherwise(F.lit(0).cast("long"))),
        )
        u = v.bitwiseAND(match)
        return ((v + u).bitwiseOR(v - u)).bitwiseAND(mask)

    v = F.aggregate(F.sequence(F.lit(1), F.length(a)), mask, step)
    return n - F.bit_count(v)


def position_masks(word: str) -> dict[str, int]:
    """For a fixed string (a master name): character -> bit mask of its positions (bit k = position k+1)."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(word):
        masks[ch] = masks.get(ch, 0) | (1 << k)
    return masks


def fixed_entry(word: str, **extra) -> Column:
    """A fixed string as a literal struct: the string, its length and its character position masks."""
    masks = position_masks(word) if len(word) <= WORD_BITS else {}
    pm = F.create_map(*[x for ch, m in masks.items() for x in (F.lit(ch), F.lit(m).cast("long"))]) if masks else \
        F.create_map().cast("map<string,bigint>")
    return F.struct(*[F.lit(v).alias(k) for k, v in extra.items()], F.lit(word).alias("word"),
                    F.lit(len(word)).alias("len"), pm.alias("pm"))


def similarity_to_entry(a: Column, e: Column) -> Column:
    """``similarity(a, e.word)`` for an entry of ``fixed_entry``: bit-parallel LCS with the entry's masks
    (one map lookup per character of ``a``); the DP table when the word is longer than a machine word."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), e["len"]) - 1

    def step(v, i):
        u = v.bitwiseAND(F.coalesce(F.try_element_at(e["pm"], a.substr(i, F.lit(1))), F.lit(0).cast("long")))
        return ((v + u).bitwiseOR(v - u)).bitwiseAND(mask)

    bits = (e["len"] - F.bit_count(F.aggregate(F.sequence(F.lit(1), F.length(a)), mask, step))).cast("int")
    lcs = F.when(e["len"] <= WORD_BITS, bits).otherwise(lcs_table(a, e["word"]))
    total = (F.length(a) + e["len"]).cast("double")
    score = F.bround(F.lit(100.0) * ((F.lit(2.0) * lcs.cast("double")) / total), 0).cast("int")
    return (
        F.when(a.isNull(), F.lit(0))
        .when(a == e["word"], F.lit(100))
        .when((F.length(a) == 0) | (e["len"] == 0), F.lit(0))
        .otherwise(score)
    )


def similarity_to_fixed(a: Column, word: str) -> Column:
    """``similarity(a, lit(word))`` with the fixed string's masks precomputed."""
    return similarity_to_entry(a, fixed_entry(word))


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two strings (0 when either is empty or null)."""
    a, b = col_(a), col_(b)
    la, lb = F.length(a), F.length(b)
    longer, shorter = F.when(la >= lb, a).otherwise(b), F.when(la >= lb, b).otherwise(a)
    return F.when(a.isNull() | b.isNull() | (la == 0) | (lb == 0), F.lit(0)).when(
        F.least(la, lb) <= WORD_BITS, lcs_bits(longer, shorter).cast("int")
    ).otherwise(lcs_table(a, b))


def lcs_table(a, b) -> Column:
    """LCS length by the plain DP table, one row per character of ``a`` (any lengths)."""
    a, b = col_(a), col_(b)
    m, n = F.length(a), F.length(b)

    def row(prev, i):
        ch = a.substr(i, F.lit(1))

        def cell(cur, j):
            hit = F.element_at(prev, j) + 1  # dp[i-1][j-1] + 1
            keep = F.greatest(F.element_at(prev, j + 1), F.element_at(cur, -1))  # max(dp[i-1][j], dp[i][j-1])
            return F.concat(cur, F.array(F.when(ch == b.substr(j, F.lit(1)), hit).otherwise(keep)))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    table = F.aggregate(F.sequence(F.lit(1), m), F.array_repeat(F.lit(0), n + 1), row)
    return F.when(a.isNull() | b.isNull() | (m == 0) | (n == 0), F.lit(0)).otherwise(F.element_at(table, -1))


def similarity(a, b) -> Column:
    """0..100; equal strings 100, an empty or null string 0."""
    a, b = col_(a), col_(b)
    total = (F.length(a) + F.length(b)).cast("double")
    ratio = (F.lit(2.0) * lcs_length(a, b).cast("double")) / total
    score = F.bround(F.lit(100.0) * ratio, 0).cast("int")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(0))
        .when(a == b, F.lit(100))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
        .otherwise(score)
    )
