"""SQL text of the fixture views, for the DuckDB oracle.

Each oracle query is ``WITH <views> <body>`` over the raw tables the checker
registers (lineitem, part, orders, customer, nation, region). The ledger text
is the one in FIXTURES.md §4; the Spark side builds the same view with the
DataFrame API (sources/fixture.py).
"""

from __future__ import annotations

LEDGER = """ledger AS (
SELECT l.l_orderkey AS doc_no, l.l_linenumber AS line_no,
  concat(CAST(year(l.l_shipdate) AS VARCHAR), '-', lpad(CAST(month(l.l_shipdate) AS VARCHAR), 2, '0')) AS period,
  CAST(year(l.l_shipdate) * 100 + month(l.l_shipdate) AS INT) AS period_no,
  concat(CASE WHEN p.p_type IN ('STANDARD','LARGE','PROMO','MEDIUM') THEN '4'
              WHEN p.p_type = 'ECONOMY' THEN '5'
              WHEN p.p_size % 10 = 8 THEN '7' ELSE '6' END,
         CAST(p.p_size % 10 AS VARCHAR),
         CASE p.p_type WHEN 'LARGE' THEN '10' WHEN 'PROMO' THEN '20' WHEN 'MEDIUM' THEN '30' ELSE '00' END) AS account_code,
  CASE p.p_type
    WHEN 'STANDARD' THEN concat('Product revenue ', CAST(p.p_size % 10 AS VARCHAR))
    WHEN 'LARGE'    THEN concat('Subscription revenue ', CAST(p.p_size % 10 AS VARCHAR))
    WHEN 'PROMO'    THEN concat('Service sales ', CAST(p.p_size % 10 AS VARCHAR))
    WHEN 'MEDIUM'   THEN concat('Training turnover ', CAST(p.p_size % 10 AS VARCHAR))
    WHEN 'ECONOMY'  THEN concat(CASE WHEN p.p_size % 10 <= 3 THEN 'Direct materials ' WHEN p.p_size % 10 <= 5 THEN 'Direct labour '
        WHEN p.p_size % 10 <= 7 THEN 'Cloud hosting ' WHEN p.p_size % 10 = 8 THEN 'Third-party licences ' ELSE 'Freight and delivery ' END,
        CAST(p.p_size % 10 AS VARCHAR))
    ELSE CASE p.p_size % 10 WHEN 0 THEN 'Salaries' WHEN 1 THEN 'Payroll taxes' WHEN 2 THEN 'Bonus pool' WHEN 3 THEN 'Contractor support'
        WHEN 4 THEN 'Advertising' WHEN 5 THEN 'Legal fees' WHEN 6 THEN 'Software tools' WHEN 7 THEN 'Office rent'
        WHEN 8 THEN 'Interest expense' ELSE 'Company fleet' END END AS account_name,
  CASE WHEN p.p_type IN ('STANDARD','LARGE','PROMO','MEDIUM') THEN 'Revenue' WHEN p.p_type = 'ECONOMY' THEN 'COGS'
       WHEN p.p_size % 10 = 8 THEN 'Other' ELSE 'OpEx' END AS category,
  CASE WHEN p.p_type = 'ECONOMY' THEN CASE WHEN p.p_size % 10 <= 3 THEN 'Materials & components' WHEN p.p_size % 10 <= 5 THEN 'Direct labour'
        WHEN p.p_size % 10 <= 7 THEN 'Hosting & infrastructure' WHEN p.p_size % 10 = 8 THEN 'Third-party licences' ELSE 'Logistics & fees' END
       WHEN p.p_type = 'SMALL' THEN CASE p.p_size % 10 WHEN 0 THEN 'Salaries & wages' WHEN 1 THEN 'Payroll benefits' WHEN 2 THEN 'Employee incentives'
        WHEN 3 THEN 'External staff / contractors' WHEN 4 THEN 'Marketing & advertising' WHEN 5 THEN 'External professional fees'
        WHEN 6 THEN 'IT & software' WHEN 7 THEN 'Facilities & office' WHEN 8 THEN 'Financing & bank' ELSE 'Company fleet' END
       ELSE '' END AS expense_type,
  r.r_name AS entity, c.c_mktsegment AS department,
  concat(substr(c.c_mktsegment, 1, 2), CAST(n.n_nationkey % 4 + 1 AS VARCHAR), '0100') AS cost_centre,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS actual,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(0.80 + 0.05 * (p.p_size % 10) AS DECIMAL(4,2)) AS budget,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) * (CAST(0.93 AS DECIMAL(4,2)) - CAST(l.l_tax AS DECIMAL(4,2))) AS prior_year
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey)"""

# Fiscal-year frame used by the standard run (fiscal year 2000).
FY = """fy AS (SELECT * FROM ledger WHERE period_no BETWEEN 200001 AND 200012)"""

PLAN = """plan AS (SELECT period, period_no, entity, department, account_code, sum(budget) AS budget
FROM ledger GROUP BY period, period_no, entity, department, account_code)"""

PLAN_GAPPY = """plan_gappy AS (
SELECT p.* FROM plan p JOIN (SELECT period_no, min(account_code) AS drop_code FROM plan
                             WHERE period_no <> 200003 GROUP BY period_no) d
  ON p.period_no = d.period_no
WHERE p.period_no <> 200003 AND p.account_code <> d.drop_code)"""

LEDGER_RAW = """ledger_raw AS (
SELECT doc_no, line_no, conv, cents,
  CASE conv WHEN 0 THEN concat('-', eu) WHEN 1 THEN concat('(', eu, ')') WHEN 2 THEN concat(eu, '-')
            WHEN 3 THEN concat(translate(eu, '.,', ',.'), ' CR') WHEN 4 THEN concat('EUR ', eu)
            WHEN 5 THEN concat(translate(eu, '.,', ',.'), ' DR') ELSE 'n/a' END AS amount_text
FROM (SELECT *, concat(CASE WHEN cents >= 100000 THEN concat(CAST(CAST(floor(cents / 100000) AS BIGINT) AS VARCHAR), '.',
                         lpad(CAST(CAST(floor(cents % 100000 / 100) AS BIGINT) AS VARCHAR), 3, '0'))
                       ELSE CAST(CAST(floor(cents / 100) AS BIGINT) AS VARCHAR) END,
                  ',', lpad(CAST(cents % 100 AS VARCHAR), 2, '0')) AS eu
      FROM (SELECT l_orderkey AS doc_no, l_linenumber AS line_no, CAST((l_orderkey + l_linenumber) % 7 AS INT) AS conv,
                   CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) a) b)"""

LEDGER_PRINTED = """ledger_printed AS (
SELECT doc_no, line_no, period, period_no, account_code, account_name, category, expense_type, entity,
  department, cost_centre, actual, budget, prior_year FROM ledger
UNION ALL SELECT NULL, NULL, '', NULL, '', 'Total', '', '', '', department, '', sum(actual), sum(budget),
  sum(prior_year) FROM ledger GROUP BY department
UNION ALL SELECT NULL, NULL, '', NULL, '9999', 'Suspense', '', '', '', department, '', 0, 0, 0
  FROM (SELECT DISTINCT department FROM ledger) d)"""

LEDGER_CREDIT = """ledger_credit AS (
SELECT * REPLACE (CASE WHEN category = 'Revenue' THEN -actual ELSE actual END AS actual,
                  CASE WHEN category = 'Revenue' THEN -budget ELSE budget END AS budget) FROM ledger)"""

VIEWS = {"ledger": LEDGER, "fy": FY, "plan": PLAN, "plan_gappy": PLAN_GAPPY,
         "ledger_raw": LEDGER_RAW, "ledger_printed": LEDGER_PRINTED,
         "ledger_credit": LEDGER_CREDIT}
# Views each one reads, so a query names only what it uses.
DEPENDS = {"fy": ["ledger"], "plan": ["ledger"], "plan_gappy": ["plan"],
           "ledger_printed": ["ledger"], "ledger_credit": ["ledger"]}


def with_views(body: str, *names: str, extra: list[str] | None = None) -> str:
    """``WITH`` the named fixture views (dependencies first) and ``extra``
    query-specific CTE texts, then ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [VIEWS[n] for n in order] + list(extra or [])
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        # merge the query's own WITH list into the one WITH clause
        return "WITH " + ",\n".join(ctes + [b[5:]]) if ctes else b
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
