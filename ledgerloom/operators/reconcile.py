"""Gold: does every party's pair of books agree, and which entries are unmatched.

Book A is the own ledger (balance debit - credit, given by the ERP), book B the
counterparty statement (balance credit - debit); agreeing books therefore have
*equal* balances. The verdict of a party is the first rule that holds:

1. balanced       A's last balance equals B's last balance; no entries.
2. extra in A     B's last balance occurs in A (before A's end); A's rows after
                  the last such occurrence are listed.
3. extra in B     A's last balance occurs in B; B's rows after it are listed.
4. diverged       B's opening balance occurs in A; after the last balance both
                  books share, the rows of each side that no row of the other
                  side matches (voucher contains document no., or equal amount
                  on the opposite side) are listed.
5. opening differs  nothing listed.

Everything is one plan for all parties. Balances are pre-aggregated per
(party, balance) so that the balance join is 1:1, every per-party value is a
grouped aggregate with map-side partial aggregation, and the per-party verdict
is joined back to the entries with a size-checked broadcast. The reference's
full outer join on an OR condition becomes three equi anti joins per side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import GOLD_COLUMNS, MONEY
from ..session import materialize
from .joins import (
    bounded_small,
    contains_anti_haystack,
    contains_anti_needles,
    contains_matches,
    join_per_key,
)
from .silver import is_opening_line

KEYS = ["party", "cparty"]

# Verdict kinds and the message text of each
CASE_BALANCED, CASE_EXTRA_OWN, CASE_EXTRA_OTHER, CASE_DIVERGED, CASE_OPENING = 1, 2, 3, 4, 5
VERDICT_NAMES = {1: "balanced", 2: "extra_in_own", 3: "extra_in_counterparty", 4: "diverged", 5: "opening_differs"}


@dataclass(frozen=True)
class Books:
    """Names of the two books as they appear in flags and messages."""

    own: str = "Own"
    other: str = "Customer"

    # The four flag texts, "{Dr|Cr} by <book>, but not {Cr|Dr} by <other book>"
    @property
    def own_dr(self) -> str:
        return f"Dr by {self.own}, but not Cr by {self.other}"

    @property
    def own_cr(self) -> str:
        return f"Cr by {self.own}, but not Dr by {self.other}"

    @property
    def other_dr(self) -> str:
        return f"Dr by {self.other}, but not Cr by {self.own}"

    @property
    def other_cr(self) -> str:
        return f"Cr by {self.other}, but not Dr by {self.own}"

    def messages(self) -> dict[int, str]:
        return {
            1: "Closing Balance matches. Reconciliation complete.",
            2: f"Additional records in {self.own} ledger.",
            3: f"Additional records in {self.other} ledger.",
            4: "Closing Balance does not match. Unmatched entries listed.",
            5: "Closing Balance does not match and opening balance does not match.",
        }


# ---------------------------------------------------------------- normal forms


def own_book(ledger: DataFrame) -> DataFrame:
    """Own ledger in the engine's normal form: name, idx, date, doc no., debit, credit, bal."""
    return ledger.select(
        F.col("customer_name").alias("name"), "idx", "posting_date",
        F.nullif(F.trim(F.col("origin_no")), F.lit("")).alias("doc_no"),
        F.col("debit_lc").alias("debit"), F.col("credit_lc").alias("credit"),
        F.col("cumulative_balance_lc").alias("bal"),
    )


def other_book(statement: DataFrame) -> DataFrame:
    """Counterparty statement (silver) in normal form."""
    return statement.select(
        F.col("customer_name").alias("name"), "idx", "posting_date", "particulars",
        F.col("voucher_number").alias("voucher"),
        F.col("debit_amount_in_local_currency").alias("debit"),
        F.col("credit_amount_in_local_currency").alias("credit"),
        F.col("cumulative_amount_in_local_currency").alias("bal"),
    )


# ---------------------------------------------------------------- J1: parties of both books


def party_pairs(own_names: DataFrame, other_names: DataFrame) -> DataFrame:
    """(party, cparty): own name contains counterparty name, over distinct names.

    The containment test goes by the index of grams (no nested loop); a pair is a pair of names, so its rows are what is returned."""
    a = own_names.select(F.col("name").alias("party")).where(F.col("party").isNotNull())
    b = other_names.select(F.col("name").alias("cparty")).where(F.col("cparty").isNotNull())
    one = F.lit(1).alias("_all")  # names have no key
    found = contains_matches(b.select("cparty", one), ["_all"], "cparty", a.select("party", one), "party", one_key=True)
    return found.select(F.col("_text").alias("party"), F.col("_needle").alias("cparty"))


@dataclass
class Keyed:
    """Both books keyed by the party pair, ready for the verdict."""

    a: DataFrame
    b: DataFrame
    pairs: DataFrame
    pairs_small: bool = True


def key_books(ledger: DataFrame, statement: DataFrame) -> Keyed:
    a = own_book(ledger)
    b = other_book(statement)
    pairs, small = bounded_small(party_pairs(a, b), "pairs")
    ka = join_per_key(a, pairs, a["name"] == pairs["party"], checked=small).drop("name")
    kb = join_per_key(b, pairs, b["name"] == pairs["cparty"], checked=small).drop("name")
    return Keyed(ka, kb, pairs, small)


# ---------------------------------------------------------------- R5: verdict




def balance_points(keyed: "Keyed", fiscal_start: str) -> DataFrame:
    """Balances present in both books: (party, cparty, bal, i, j), i/j = last position in A/B."""
    shared = F.col("bal").isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull()
    return balance_table(keyed, fiscal_start).where(shared).select(*KEYS, "bal", "i", "j")






def opening_balances(kb: DataFrame, fiscal_start: str) -> DataFrame:
    """B's opening line (dated fiscal start, particulars like op%bal%), first one per party pair."""
    op = kb.where(
        (F.col("posting_date") == F.lit(fiscal_start).cast("date")) & is_opening_line(F.col("particulars"))
    )
    return op.groupBy(*KEYS).agg(F.min_by("bal", "idx").alias("open_b"))


def balance_table(keyed: Keyed, fiscal_start: str) -> DataFrame:
    """One row per (party pair, balance): i / j = last position of that balance in A / B (null when
    absent), o = it is the counterparty's opening balance. The union of both books, aggregated once.

    Rows without a balance form a group of their own: it matches nothing, but it can hold a book's last row."""
    ka, kb = keyed.a, keyed.b
    none = F.lit(None).cast("long")
    a = ka.select(*KEYS, "bal", F.col("idx").alias("i"), none.alias("j"), F.lit(False).alias("o"))
    b = kb.select(*KEYS, "bal", none.alias("i"), F.col("idx").alias("j"), F.lit(False).alias("o"))
    op = opening_balances(kb, fiscal_start).select(*KEYS, F.col("open_b").alias("bal"), none.alias("i"), none.alias("j"), F.lit(True).alias("o"))
    return (
        a.unionByName(b).unionByName(op)
        .groupBy(*KEYS, "bal")
        .agg(F.max("i").alias("i"), F.max("j").alias("j"), F.max("o").alias("o"))
    )


def verdict(keyed: Keyed, fiscal_start: str, books: Books = Books()) -> DataFrame:
    """One row per party pair: party, cparty, kase, anchor_a, anchor_b, message, ...

    Everything comes from one grouped pass over the balance table:
    the group holding a book's last row carries that book's last position, so
    ``max_by(bal, i)`` is A's closing balance and ``max_by(i, j)`` is the last
    position in A of B's closing balance (null when A never had it, or when B's
    last row has no balance)."""
    g = balance_table(keyed, fiscal_start)
    i, j = F.col("i"), F.col("j")
    known = F.col("bal").isNotNull()
    v = g.groupBy(*KEYS).agg(
        F.max(i).alias("mi"), F.max(j).alias("mj"),
        F.max_by("bal", i).alias("end_a"), F.max_by("bal", j).alias("end_b"),
        F.max_by(F.when(known, i), j).alias("a2"), F.max_by(F.when(known, j), i).alias("b3"),
        F.max(F.when(known & j.isNotNull(), i)).alias("sa"), F.max(F.when(known & i.isNotNull(), j)).alias("sb"),
        F.max(F.when(F.col("o"), F.col("bal"))).alias("open_b"),
        F.coalesce(F.max(F.col("o") & known & i.isNotNull()), F.lit(False)).alias("open_ok"),
    ).where(F.col("mi").isNotNull() & F.col("mj").isNotNull())
    kase = (
        F.when(F.col("end_a") == F.col("end_b"), F.lit(CASE_BALANCED))
        .when(F.col("a2").isNotNull(), F.lit(CASE_EXTRA_OWN))
        .when(F.col("b3").isNotNull(), F.lit(CASE_EXTRA_OTHER))
        .when(F.col("open_ok"), F.lit(CASE_DIVERGED))
        .otherwise(F.lit(CASE_OPENING))
    )
    msgs = books.messages()
    message = F.concat(
        F.lit("Customer: "), F.col("party"), F.lit(" - "),
        F.when(F.col("kase") == 1, msgs[1]).when(F.col("kase") == 2, msgs[2]).when(F.col("kase") == 3, msgs[3])
        .when(F.col("kase") == 4, msgs[4]).otherwise(msgs[5]),
    )
    return (
        v.withColumn("kase", kase)
        .select(
            *KEYS, "kase",
            F.when(F.col("kase") == 2, F.col("a2")).when(F.col("kase") == 4, F.col("sa")).alias("anchor_a"),
            F.when(F.col("kase") == 3, F.col("b3")).when(F.col("kase") == 4, F.col("sb")).alias("anchor_b"),
            "mi", "mj", "end_a", "end_b", "open_b", "open_ok",
        )
        .withColumn("message", message)
    )


# ---------------------------------------------------------------- R6: unmatched entries


def after_anchor(book: DataFrame, v: DataFrame, anchor: str, cases: tuple[int, ...], checked: bool) -> DataFrame:
    """Rows after the party's anchor, for parties whose verdict lists that side."""
    va = v.where(F.col("kase").isin(*cases)).select(*KEYS, "kase", F.col(anchor).alias("_anchor"))
    return (
        join_per_key(book, va, KEYS, checked=checked)
        .where(F.col("idx") > F.col("_anchor"))
        .drop("_anchor")
    )


def matched_amounts(a4: DataFrame, b4: DataFrame) -> DataFrame:
    """(keys, own_side, amount): amounts that A books on a side (debit or credit) and B on the opposite one, by one aggregation of both books."""

    def booked(book: DataFrame, debit: str, credit: str, own: bool) -> DataFrame:
        sides = F.array(F.struct(F.lit("debit").alias("side"), F.col(debit).alias("amount")), F.struct(F.lit("credit").alias("side"), F.col(credit).alias("amount")))
        rows = book.select(*KEYS, F.explode(sides).alias("_b")).select(*KEYS, F.col("_b.side").alias("own_side"), F.col("_b.amount").alias("amount"))
        return rows.where(F.col("amount").isNotNull()).withColumn("_own", F.lit(own))

    both = booked(a4, "debit", "credit", True).unionByName(booked(b4, "credit", "debit", False))
    return both.groupBy(*KEYS, "own_side", "amount").agg(F.min("_own").alias("_least"), F.max("_own").alias("_most")).where(F.col("_most") & ~F.col("_least")).drop("_least", "_most")


def _without_amount(rows: DataFrame, matched: DataFrame, column: str, own_side: str) -> DataFrame:
    """Rows whose amount isn't matched. A missing amount matches nothing; its rows are spread by position, not sent to one task."""
    amounts = matched.where(F.col("own_side") == own_side).select(*KEYS, F.col("amount").alias(column), F.lit(0).cast("long").alias("_row"))
    spread = rows.withColumn("_row", F.when(F.col(column).isNull(), F.col("idx")).otherwise(F.lit(0)).cast("long"))
    return spread.join(amounts, [*KEYS, column, "_row"], "left_anti").drop("_row")


def unmatched_by_amount(a4: DataFrame, b4: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of A without an equal amount on the opposite side of B, and rows of B without one in A. The matched amounts are written once and read
    from both sides."""
    amounts = materialize(matched_amounts(a4, b4), "matched_amounts")
    own = _without_amount(_without_amount(a4, amounts, "debit", "debit"), amounts, "credit", "credit")
    other = _without_amount(_without_amount(b4, amounts, "credit", "debit"), amounts, "debit", "credit")
    return own, other


def unmatched(a4: DataFrame, b4: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of A (case 4) that no row of B matches, and rows of B that none of A does: B credit = A debit, B debit = A credit, B voucher contains A
    doc no."""
    # written once: each is read for its rows, its distinct texts and their grams
    own, other = (materialize(rows, f"unmatched_{side}") for rows, side in zip(unmatched_by_amount(a4, b4), ("own", "other")))
    return (
        contains_anti_needles(own, KEYS, ["idx"], "doc_no", b4, "voucher"),
        contains_anti_haystack(other, KEYS, ["idx"], "voucher", a4, "doc_no"),
    )


def own_entries(rows: DataFrame, books: Books) -> DataFrame:
    """Gold rows of A with their pair: invoice = document no., amount on the booked side, flag by side."""
    is_dr = F.col("debit").isNotNull()
    return rows.select(
        "cparty", F.col("party").alias("customer_name"), "posting_date", F.col("doc_no").alias("invoice_number"),
        F.when(is_dr, F.col("debit")).otherwise(F.col("credit")).cast(MONEY).alias("amount_in_local_currency"),
        F.when(is_dr, F.lit(books.own_dr)).otherwise(F.lit(books.own_cr)).alias("flag"),
    )


def other_entries(rows: DataFrame, books: Books) -> DataFrame:
    is_dr = F.col("debit").isNotNull()
    return rows.select(
        "cparty", F.col("party").alias("customer_name"), "posting_date", F.col("voucher").alias("invoice_number"),
        F.coalesce(F.col("debit"), F.col("credit")).cast(MONEY).alias("amount_in_local_currency"),
        F.when(is_dr, F.lit(books.other_dr)).otherwise(F.lit(books.other_cr)).alias("flag"),
    )


@dataclass
class Reconciliation:
    keyed: Keyed
    verdict: DataFrame
    verdict_small: bool
    books: Books

    def __post_init__(self):
        self._cand: dict[str, DataFrame] = {}

    def _candidates(self, side: str) -> DataFrame:
        """Rows after the anchor of each party whose verdict lists that side, written once.

        Usually a small part of a book; every later step (case 2/3 listing,
        the six anti joins of case 4) reads this table instead of the books."""
        if side not in self._cand:
            if side == "own":
                rows = after_anchor(self.keyed.a, self.verdict, "anchor_a", (2, 4), self.verdict_small)
            else:
                rows = after_anchor(self.keyed.b, self.verdict, "anchor_b", (3, 4), self.verdict_small)
            self._cand[side] = materialize(rows, f"candidates_{side}")
        return self._cand[side]

    def after_own(self) -> DataFrame:
        return self._candidates("own")

    def after_other(self) -> DataFrame:
        return self._candidates("other")

    def case2(self) -> DataFrame:
        return own_entries(self.after_own().where(F.col("kase") == 2), self.books)

    def case3(self) -> DataFrame:
        return other_entries(self.after_other().where(F.col("kase") == 3), self.books)

    def case4_sides(self) -> tuple[DataFrame, DataFrame]:
        a4 = self.after_own().where(F.col("kase") == 4)
        b4 = self.after_other().where(F.col("kase") == 4)
        return a4, b4

    def case4(self) -> DataFrame:
        own, other = unmatched(*self.case4_sides())
        return own_entries(own, self.books).unionByName(other_entries(other, self.books))

    def entries(self) -> DataFrame:
        """All unmatched entries of all parties (U2) with the counterparty name of their pair; written once, read by every consumer."""
        if "entries" not in self._cand:
            rows = self.case2().unionByName(self.case3()).unionByName(self.case4())
            self._cand["entries"] = materialize(rows, "entries")
        return self._cand["entries"]

    def gold(self) -> DataFrame:
        """The entries in the gold schema."""
        return self.entries().select(*GOLD_COLUMNS)

    def messages(self) -> DataFrame:
        """One message per party pair with the number of entries listed for that pair (A10)."""
        counts = self.entries().groupBy(F.col("customer_name").alias("party"), "cparty").agg(F.count(F.lit(1)).alias("n_entries"))
        return (
            self.verdict.join(counts, KEYS, "left")
            .select(
                F.col("party").alias("customer_name"), "cparty", F.col("kase").cast("int").alias("kase"),
                F.element_at(
                    F.create_map(*[x for k, n in VERDICT_NAMES.items() for x in (F.lit(k), F.lit(n))]), F.col("kase")
                ).alias("verdict"),
                "message", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
            )
        )


def reconcile(ledger: DataFrame, statement: DataFrame, fiscal_start: str, books: Books = Books()) -> Reconciliation:
    """Key both books by party pair, decide every verdict, and keep it as a written table."""
    keyed = key_books(ledger, statement)
    if not keyed.pairs_small:
        # pairs too large to broadcast: write the keyed books once instead of re-joining them per use
        keyed = Keyed(materialize(keyed.a, "keyed_own"), materialize(keyed.b, "keyed_other"), keyed.pairs, False)
    v, small = bounded_small(verdict(keyed, fiscal_start, books), "verdict")
    return Reconciliation(keyed, v, small, books)
