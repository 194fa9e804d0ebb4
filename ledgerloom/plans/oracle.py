"""Independent SQL (DuckDB dialect) for every query of the catalogue.

The SQL follows the rules in their literal, row-by-row form (many-to-many
balance pairs, NOT EXISTS over the OR condition, plain windows), so it checks
the Spark formulation rather than repeating it. Each query is a final SELECT
over named CTEs; ``sql(final)`` prepends the CTEs it needs.
"""

from __future__ import annotations

import re

from .fixtures import FISCAL_FILTER_START, FISCAL_START

M = "DECIMAL(22,5)"
FS = f"DATE '{FISCAL_START}'"

# Flag texts for the default book names (see operators.reconcile.Books)
OWN_DR = "Dr by Own, but not Cr by Customer"
OWN_CR = "Cr by Own, but not Dr by Customer"
OTHER_DR = "Dr by Customer, but not Cr by Own"
OTHER_CR = "Cr by Customer, but not Dr by Own"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


# ------------------------------------------------------------------ fixture books (FIXTURES §4)
cte("fx_base", f"""
  SELECT c.c_name AS party, c.c_custkey AS k, CAST(o.o_orderdate AS DATE) AS posting_date, o.o_orderkey AS ok,
         CAST(o.o_totalprice AS {M}) AS amt,
         row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS rn,
         count(*) OVER (PARTITION BY c.c_custkey) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate >= TIMESTAMP '{FISCAL_START} 00:00:00'""")
cte("fx_op", f"""
  SELECT c_name AS party, c_custkey AS k, CAST(abs(c_acctbal) AS {M}) AS amt
  FROM customer WHERE c_custkey IN (SELECT k FROM fx_base)""")
cte("fx_a_lines", f"""
  SELECT party || CASE WHEN k % 9 = 4 THEN ' (Head Office)' ELSE '' END AS party, k, 0 AS seq, {FS} AS posting_date, 'OB' AS doc_no, amt AS debit,
         CAST(NULL AS {M}) AS credit, FALSE AS unknown FROM fx_op
  UNION ALL
  SELECT party || CASE WHEN k % 9 = 4 THEN ' (Head Office)' ELSE '' END, k, rn, posting_date, CAST(ok AS VARCHAR),
         CASE WHEN ok % 4 <> 0 THEN amt END, CASE WHEN ok % 4 = 0 THEN amt END, k % 10 = 5 AND (rn = n OR rn = 2)
  FROM fx_base WHERE NOT (k % 5 = 2 AND rn > n - 2)""")
cte("own", f"""
  SELECT party AS customer_name, CAST(row_number() OVER (PARTITION BY party ORDER BY seq) AS BIGINT) AS idx,
         posting_date, doc_no AS origin_no, debit AS debit_lc, credit AS credit_lc,
         CASE WHEN NOT unknown THEN CAST(sum(coalesce(debit, 0) - coalesce(credit, 0)) OVER (PARTITION BY party ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {M}) END AS cumulative_balance_lc
  FROM fx_a_lines""")
cte("fx_b_lines", f"""
  SELECT party, k, 0 AS seq, {FS} AS posting_date, 'Opening Balance' AS particulars,
         CAST(NULL AS VARCHAR) AS voucher_type, CAST(NULL AS VARCHAR) AS voucher_number,
         CAST(NULL AS {M}) AS debit, CAST(CASE WHEN k % 5 = 4 THEN amt + 1 ELSE amt END AS {M}) AS credit
  FROM fx_op
  UNION ALL
  SELECT party, k, rn, posting_date, 'Entry', 'Sale',
         CASE WHEN k % 5 = 3 AND ok % 5 IN (2, 3) THEN 'NOREF' ELSE 'INV/' || CAST(ok AS VARCHAR) || '/24' END,
         CASE WHEN ok % 4 = 0 THEN amt2 END, CASE WHEN ok % 4 <> 0 THEN amt2 END
  FROM (SELECT *, CAST(CASE WHEN k % 5 = 3 AND ok % 5 IN (1, 3) THEN amt + 1 ELSE amt END AS {M}) AS amt2
        FROM fx_base) x
  WHERE NOT (k % 5 = 1 AND rn > n - 2) AND NOT (k % 5 = 3 AND ok % 3 = 0 AND rn > 1)""")
cte("counterparty", f"""
  SELECT party AS customer_name, CAST(row_number() OVER (PARTITION BY party ORDER BY seq) AS BIGINT) AS idx,
         posting_date, particulars, voucher_type, voucher_number,
         debit AS debit_amount_in_local_currency, credit AS credit_amount_in_local_currency,
         CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY party ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {M}) AS cumulative_amount_in_local_currency
  FROM fx_b_lines""")

# ------------------------------------------------------------------ reconciliation, literal form
cte("pairs", """
  SELECT DISTINCT a.customer_name AS party, b.customer_name AS cparty
  FROM (SELECT DISTINCT customer_name FROM own) a
  JOIN (SELECT DISTINCT customer_name FROM counterparty) b ON contains(a.customer_name, b.customer_name)""")
cte("ka", """
  SELECT p.party, p.cparty, o.idx, o.posting_date, nullif(trim(o.origin_no), '') AS doc_no,
         o.debit_lc AS debit, o.credit_lc AS credit, o.cumulative_balance_lc AS bal
  FROM own o JOIN pairs p ON o.customer_name = p.party""")
cte("kb", """
  SELECT p.party, p.cparty, c.idx, c.posting_date, c.particulars, c.voucher_number AS voucher,
         c.debit_amount_in_local_currency AS debit, c.credit_amount_in_local_currency AS credit,
         c.cumulative_amount_in_local_currency AS bal
  FROM counterparty c JOIN pairs p ON c.customer_name = p.cparty""")
cte("ma", "SELECT party, cparty, max(idx) AS mi FROM ka GROUP BY party, cparty")
cte("mb", "SELECT party, cparty, max(idx) AS mj FROM kb GROUP BY party, cparty")
cte("pts", """
  SELECT a.party, a.cparty, a.bal, a.idx AS i, b.idx AS j
  FROM ka a JOIN kb b ON a.party = b.party AND a.cparty = b.cparty AND a.bal = b.bal""")
cte("v0", """
  SELECT ma.party, ma.cparty, ma.mi, mb.mj,
         coalesce(bool_or(p.i = ma.mi AND p.j = mb.mj), false) AS c1,
         max(CASE WHEN p.j = mb.mj AND p.i <> ma.mi THEN p.i END) AS a2,
         max(CASE WHEN p.i = ma.mi AND p.j <> mb.mj THEN p.j END) AS b3,
         max(CASE WHEN p.i <> ma.mi AND p.j <> mb.mj THEN p.i END) AS sa,
         max(CASE WHEN p.i <> ma.mi AND p.j <> mb.mj THEN p.j END) AS sb
  FROM ma JOIN mb ON ma.party = mb.party AND ma.cparty = mb.cparty
  LEFT JOIN pts p ON p.party = ma.party AND p.cparty = ma.cparty
  GROUP BY ma.party, ma.cparty, ma.mi, mb.mj""")
cte("ob", f"""
  SELECT party, cparty, arg_min(bal, idx) AS open_b FROM kb
  WHERE posting_date = {FS} AND lower(particulars) LIKE 'op%bal%' GROUP BY party, cparty""")
cte("ook", """
  SELECT ob.party, ob.cparty, ob.open_b,
         EXISTS (SELECT 1 FROM ka WHERE ka.party = ob.party AND ka.cparty = ob.cparty AND ka.bal = ob.open_b) AS open_ok
  FROM ob""")
cte("verdict", """
  SELECT v0.*, ook.open_b, coalesce(ook.open_ok, false) AS open_ok,
         CASE WHEN c1 THEN 1 WHEN a2 IS NOT NULL THEN 2 WHEN b3 IS NOT NULL THEN 3
              WHEN coalesce(ook.open_ok, false) THEN 4 ELSE 5 END AS kase
  FROM v0 LEFT JOIN ook ON ook.party = v0.party AND ook.cparty = v0.cparty""")
cte("ra", """
  SELECT ka.*, v.kase FROM ka JOIN verdict v ON ka.party = v.party AND ka.cparty = v.cparty
  WHERE (v.kase = 2 AND ka.idx > v.a2) OR (v.kase = 4 AND ka.idx > v.sa)""")
cte("rb", """
  SELECT kb.*, v.kase FROM kb JOIN verdict v ON kb.party = v.party AND kb.cparty = v.cparty
  WHERE (v.kase = 3 AND kb.idx > v.b3) OR (v.kase = 4 AND kb.idx > v.sb)""")
cte("ua", """
  SELECT * FROM ra a WHERE kase = 4 AND NOT EXISTS (
    SELECT 1 FROM rb b WHERE b.kase = 4 AND b.party = a.party AND b.cparty = a.cparty
      AND (contains(b.voucher, a.doc_no) OR b.credit = a.debit OR b.debit = a.credit))""")
cte("ub", """
  SELECT * FROM rb b WHERE kase = 4 AND NOT EXISTS (
    SELECT 1 FROM ra a WHERE a.kase = 4 AND b.party = a.party AND b.cparty = a.cparty
      AND (contains(b.voucher, a.doc_no) OR b.credit = a.debit OR b.debit = a.credit))""")
cte("gold_a", f"""
  SELECT cparty, party AS customer_name, posting_date, doc_no AS invoice_number,
         CAST(CASE WHEN debit IS NOT NULL THEN debit ELSE credit END AS {M}) AS amount_in_local_currency,
         CASE WHEN debit IS NOT NULL THEN '{OWN_DR}' ELSE '{OWN_CR}' END AS flag, kase
  FROM (SELECT * FROM ra WHERE kase = 2 UNION ALL SELECT * FROM ua) x""")
cte("gold_b", f"""
  SELECT cparty, party AS customer_name, posting_date, voucher AS invoice_number,
         CAST(coalesce(debit, credit) AS {M}) AS amount_in_local_currency,
         CASE WHEN debit IS NOT NULL THEN '{OTHER_DR}' ELSE '{OTHER_CR}' END AS flag, kase
  FROM (SELECT * FROM rb WHERE kase = 3 UNION ALL SELECT * FROM ub) x""")
cte("gold", """
  SELECT customer_name, posting_date, invoice_number, amount_in_local_currency, flag FROM gold_a
  UNION ALL
  SELECT customer_name, posting_date, invoice_number, amount_in_local_currency, flag FROM gold_b""")


def sql(final: str) -> str:
    """``final`` with the CTEs it (transitively) needs, in definition order."""
    needed: set[str] = set()
    names = list(CTES)

    def visit(text: str) -> None:
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    parts = [f"{n} AS ({CTES[n]}\n)" for n in names if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


__all__ = ["CTES", "FISCAL_FILTER_START", "FISCAL_START", "cte", "sql"]


# ------------------------------------------------------------------ dirty statement (FIXTURES §5)
def amount_text_sql(x: str) -> str:
    s = f"CAST(CAST({x} AS DECIMAL(20,2)) AS VARCHAR)"
    return f"(CASE WHEN length({s}) >= 7 THEN substr({s}, 1, length({s}) - 6) || ',' || substr({s}, length({s}) - 5) ELSE {s} END)"


cte("fx_dirty_src", f"""
  SELECT party AS statement_id, seq * 10 AS ord,
         CASE WHEN seq % 3 = 2 THEN ''
              WHEN seq % 2 = 0 THEN 'To ' || lpad(CAST(day(posting_date) AS VARCHAR), 2, '0') || '-'
                   || (CASE WHEN seq % 4 = 0 THEN substr(mon, 1, 1) || ' ' || substr(mon, 2, 2) ELSE mon END) || '-'
                   || lpad(CAST(year(posting_date) % 100 AS VARCHAR), 2, '0') || ' Agst '
              ELSE '  ' || CAST(day(posting_date) AS VARCHAR) || '-' || CAST(month(posting_date) AS VARCHAR) || '-'
                   || CAST(year(posting_date) AS VARCHAR) || ' ' END AS date,
         particulars || ' ' AS particulars, voucher_type || ' ' AS vch_type, voucher_number || ' ' AS vch_no,
         {amount_text_sql('debit')} || ' Dr' AS debit, {amount_text_sql('credit')} || ' Cr' AS credit
  FROM (SELECT *, substr('JanFebMarAprMayJunJulAugSepOctNovDec', (month(posting_date) - 1) * 3 + 1, 3) AS mon
        FROM fx_b_lines) x
  UNION ALL
  SELECT party, seq * 10 - 1, 'Date ', 'Particulars ', 'Vch Type ', 'Vch No. ', 'Debit ', 'Credit '
  FROM fx_b_lines WHERE seq > 0 AND seq % 5 = 0
  UNION ALL
  SELECT party, seq * 10 + 1, '', 'Being goods sold ', NULL, NULL, NULL, NULL FROM fx_b_lines WHERE seq % 4 = 1
  UNION ALL
  SELECT customer_name, last * 10 + 2, '', 'Closing Balance ', NULL, NULL,
         CASE WHEN bal >= 0 THEN {amount_text_sql("bal + CASE WHEN CAST(right(customer_name, 9) AS BIGINT) % 10 = 7 THEN 1 ELSE 0 END")} || ' Dr' END,
         CASE WHEN bal < 0 THEN {amount_text_sql('-bal')} || ' Cr' END
  FROM (SELECT customer_name, arg_max(cumulative_amount_in_local_currency, idx) AS bal
        FROM counterparty GROUP BY customer_name) c
  JOIN (SELECT party, max(seq) AS last FROM fx_b_lines GROUP BY party) l ON l.party = c.customer_name""")
cte("fx_dirty", """
  SELECT statement_id, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY ord) AS BIGINT) AS line_no,
         date, particulars, vch_type, vch_no, debit, credit
  FROM fx_dirty_src""")

# ------------------------------------------------------------------ bronze and silver, literal form
REPAIR = ("trim(regexp_replace(regexp_replace(regexp_replace(date, '(Dr|Cr|By|To)', '', 'g'), '\\s+', ' ', 'g'), "
          "'(\\d{1,2})-(\\w)\\s*(\\w+)-(\\d{2})', '\\1-\\2\\3-\\4', 'g'))")
cte("b_text", f"""
  SELECT statement_id, line_no, {REPAIR} AS date_repaired, split_part({REPAIR}, ' ', 1) AS w,
         particulars, vch_type, vch_no, debit, credit FROM fx_dirty""")
cte("bronze", f"""
  SELECT statement_id, line_no,
         coalesce(try_strptime(w, '%d-%b-%y')::DATE,
                  CASE WHEN regexp_matches(w, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') THEN try_strptime(w, '%d-%m-%Y')::DATE END) AS date,
         nullif(trim(particulars), '') AS particulars, nullif(trim(vch_type), '') AS vch_type,
         nullif(trim(vch_no), '') AS vch_no,
         TRY_CAST(nullif(regexp_replace(debit, '[^0-9.\\-]', '', 'g'), '') AS {M}) AS debit,
         TRY_CAST(nullif(regexp_replace(credit, '[^0-9.\\-]', '', 'g'), '') AS {M}) AS credit,
         statement_id AS customer_name
  FROM b_text""")
cte("s_kept", "SELECT * FROM bronze WHERE NOT (date IS NULL AND vch_no IS NULL AND vch_type IS NULL)")
cte("s_filled", """
  SELECT statement_id, line_no, particulars, vch_type, vch_no, debit, credit, customer_name,
         last_value(date IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS date
  FROM s_kept""")
HEADER_SQL = ("(lower(regexp_replace(coalesce(particulars, ''), '[^a-zA-Z]', '', 'g')) = 'particulars' "
              "AND lower(regexp_replace(coalesce(vch_no, ''), '[^a-zA-Z]', '', 'g')) = 'vchno' "
              "AND lower(regexp_replace(coalesce(vch_type, ''), '[^a-zA-Z]', '', 'g')) = 'vchtype')")
cte("s_final", f"SELECT * FROM s_filled WHERE date >= {FS} AND NOT {HEADER_SQL}")
cte("silver", f"""
  SELECT customer_name, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY line_no) AS BIGINT) AS idx,
         date AS posting_date, particulars, vch_type AS voucher_type, vch_no AS voucher_number,
         debit AS debit_amount_in_local_currency, credit AS credit_amount_in_local_currency,
         CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY statement_id ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {M}) AS cumulative_amount_in_local_currency,
         statement_id
  FROM s_final""")
cte("closing", """
  SELECT statement_id, arg_max(coalesce(debit, credit), line_no) AS stated_closing
  FROM bronze WHERE lower(trim(particulars)) = 'closing balance' GROUP BY statement_id""")


# ------------------------------------------------------------------ names (FIXTURES §8)
def lcs_sql(a: str, b: str) -> str:
    return (f"list_reduce(range(1, length({a}) + 1), lambda prev, i: list_reduce(range(1, length({b}) + 1), "
            f"lambda cur, j: list_append(cur, CASE WHEN {a}[i] = {b}[j] THEN prev[j] + 1 "
            f"ELSE greatest(prev[j + 1], cur[-1]) END), [0]), list_transform(range(length({b}) + 1), lambda x: 0))[-1]")


def score_sql(a: str, b: str) -> str:
    ratio = f"(CAST(2 * {lcs_sql(a, b)} AS DOUBLE) / CAST(length({a}) + length({b}) AS DOUBLE))"
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 WHEN {a} = {b} THEN 100 "
            f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
            f"ELSE CAST(round_even(CAST(100 AS DOUBLE) * {ratio}, 0) AS INTEGER) END)")


cte("nm_master", """
  SELECT party_name, row_number() OVER (ORDER BY party_name) AS position
  FROM (SELECT DISTINCT p_name AS party_name FROM part WHERE p_name IS NOT NULL) x""")
cte("nm_raw", """
  SELECT DISTINCT p_name AS source_name,
         unnest(['temp_' || p_name || '.csv', replace(p_name, 'e', ''), upper(p_name), substr(p_name, 1, 5)]) AS raw_name
  FROM part WHERE p_name IS NOT NULL""")
cte("nm_scores", f"""
  SELECT r.raw_name, m.party_name, m.position, {score_sql('r.raw_name', 'm.party_name')} AS score
  FROM (SELECT DISTINCT raw_name FROM nm_raw) r CROSS JOIN nm_master m""")


# ------------------------------------------------------------------ OCR pages (FIXTURES §6): expected from the lines
def _norm(x: str) -> str:
    """Cell text as OCR words give it back: words joined by one blank, trimmed; '' for empty."""
    return f"coalesce(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


cte("ocr_lines", """
  SELECT statement_id, line_no, CAST((line_no - 1) // 10 + 1 AS INTEGER) AS page_no,
         CAST((line_no - 1) % 10 + 2 AS INTEGER) AS row_index, date, particulars, vch_type, vch_no, debit, credit
  FROM fx_dirty""")
cte("ocr_page_list", """
  SELECT DISTINCT statement_id, page_no, 1 AS table_count FROM ocr_lines
  UNION ALL
  SELECT DISTINCT statement_id, 0, 0 FROM ocr_lines WHERE CAST(right(statement_id, 9) AS BIGINT) % 10 = 0""")
cte("ocr_cell_list", f"""
  SELECT statement_id, page_no, row_index, c.col_index, c.text, CAST(90 + line_no % 10 AS DOUBLE) AS confidence
  FROM ocr_lines, LATERAL (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS col_index,
                                  unnest([{_norm('date')}, {_norm('particulars')}, {_norm('vch_type')}, {_norm('vch_no')},
                                          {_norm('debit')}, {_norm('credit')}, 'x']) AS text) c
  UNION ALL
  SELECT DISTINCT statement_id, page_no, 1, c.col_index, c.text, CAST(90 AS DOUBLE)
  FROM ocr_lines, LATERAL (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS col_index,
                                  unnest(['Date', 'Particulars', 'Vch Type',
                                          CASE WHEN page_no >= 2 AND CAST(right(statement_id, 9) AS BIGINT) % 3 = 1 THEN 'Vch No' ELSE 'Vch No.' END,
                                          'Debit', 'Credit', '']) AS text) c
  WHERE NOT (page_no >= 2 AND CAST(right(statement_id, 9) AS BIGINT) % 3 = 0)""")

cte("ocr_lost", """
  SELECT statement_id, page_no FROM (SELECT statement_id, page_no, max(page_no) OVER (PARTITION BY statement_id) AS last_page FROM ocr_lines) x
  WHERE CAST(right(statement_id, 9) AS BIGINT) % 7 = 2 AND page_no = 2 AND last_page > 2 GROUP BY ALL""")


# ------------------------------------------------------------------ the reconciliation again, book B = cleaned statement
_CHAIN = ["pairs", "ka", "kb", "ma", "mb", "pts", "v0", "ob", "ook", "verdict", "ra", "rb", "ua", "ub", "gold_a", "gold_b", "gold"]
cte("silver_b", """
  SELECT customer_name, idx, posting_date, particulars, voucher_type, voucher_number, debit_amount_in_local_currency,
         credit_amount_in_local_currency, cumulative_amount_in_local_currency FROM silver""")
for _name in _CHAIN:
    _body = re.sub(r"\bcounterparty\b", "silver_b", CTES[_name])
    for _other in _CHAIN:
        _body = re.sub(rf"\b{_other}\b", f"{_other}_s", _body)
    cte(f"{_name}_s", _body)
