"""The same queries as SQL text for DuckDB, used only to check results."""

from __future__ import annotations

FACTS = """
facts AS (
  SELECT *, CAST(revenue - cost - expenses AS DECIMAL(25,2)) AS profit,
         date_diff('day', DATE '1970-01-01', date) * 10 + digit AS id,
         CAST(date AS TIMESTAMP) AS created_at
  FROM (
    SELECT date, department, digit,
           CAST(SUM(ROUND(price * (1 - discount), 2)) AS DECIMAL(25,2)) AS revenue,
           CAST(SUM(ROUND(unit_cost * quantity, 2)) AS DECIMAL(25,2)) AS cost,
           CAST(SUM(ROUND(price * CAST(0.09 AS DECIMAL(4,2)) * digit * digit, 2)) AS DECIMAL(25,2)) AS expenses,
           CAST(SUM(quantity) AS BIGINT) AS sales_volume,
           MIN(l_suppkey) AS created_by
    FROM (
      SELECT CAST(l_shipdate AS DATE) AS date, o_orderpriority AS department,
             CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit,
             CAST(l_extendedprice AS DECIMAL(15,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount,
             CAST(p_retailprice AS DECIMAL(15,2)) AS unit_cost, CAST(l_quantity AS INTEGER) AS quantity,
             l_suppkey
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    )
    GROUP BY date, department, digit
  )
)"""

USERS = """
users AS (
  SELECT s_suppkey AS id, s_name AS name, lower(s_name) || '@example.com' AS email,
         CASE WHEN s_suppkey % 10 = 0 THEN 'Admin' WHEN s_suppkey % 3 = 0 THEN 'Business Manager'
              ELSE 'Analyst' END AS role,
         s_acctbal >= 0 AS is_active, TIMESTAMP '2024-01-01 00:00:00' AS created_at, last_login
  FROM supplier LEFT JOIN (SELECT user_id, MAX(ts) AS last_login FROM events GROUP BY user_id)
       ON s_suppkey = user_id
)"""

HISTORY = """
history AS (
  SELECT event_id AS id, 'file_' || event_id || '.csv' AS filename, CAST(FLOOR(value) AS BIGINT) AS records_count,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'success' END AS status,
         CAST(NULL AS VARCHAR) AS error_message, user_id AS uploaded_by, ts AS created_at
  FROM events
)"""

ALERTS = """
stored AS (
  SELECT event_id AS id, type, type || ' #' || event_id AS message,
         CASE event_type WHEN 'error' THEN 'danger' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'danger'
              ELSE 'info' END AS severity,
         CASE WHEN event_type <> 'error' THEN
           CASE user_id % (CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END)
                WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
                WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END END AS department,
         user_id % 2 = 0 AS is_read, ts AS created_at
  FROM (SELECT *, CASE event_type WHEN 'error' THEN 'revenue_drop' WHEN 'click' THEN 'low_margin'
                       WHEN 'view' THEN 'expense_exceed' WHEN 'signup' THEN 'growth_alert'
                       ELSE 'revenue_milestone' END AS type FROM events)
)"""

RAW = """
raw_uploads AS (
  SELECT 'uploads_' || day || '.csv' AS filename, event_id AS line,
         CASE WHEN m = 0 THEN '2024-13-01' ELSE day END AS date,
         CASE WHEN m = 1 THEN 'x' WHEN m = 2 THEN '1,000' WHEN m = 3 THEN 'inf' WHEN m = 6 THEN ''
              ELSE amount END AS revenue,
         CAST(user_id AS VARCHAR) AS cost, CAST(CASE WHEN event_type = 'error' THEN user_id * 10 ELSE event_id % 7 END AS VARCHAR) AS expenses,
         CASE WHEN event_type = 'view' THEN CAST(CAST(ROUND(CAST(value AS DECIMAL(15,2)) * CAST(0.05 AS DECIMAL(4,2)), 2) AS DECIMAL(15,2)) AS VARCHAR)
              ELSE amount END AS profit,
         CASE WHEN m = 7 THEN '  ' WHEN m = 8 THEN '  ' || event_type || ' ' ELSE event_type END AS department,
         CASE WHEN m = 4 THEN 'abc' WHEN m = 5 THEN '12.7' ELSE CAST(user_id AS VARCHAR) END AS sales_volume
  FROM (SELECT *, event_id % 50 AS m, strftime(ts, '%Y-%m-%d') AS day,
               CAST(CAST(value AS DECIMAL(15,2)) AS VARCHAR) AS amount FROM events)
),
typed AS (
  SELECT filename, line, date AS r_date, revenue AS r_revenue, cost AS r_cost, expenses AS r_expenses,
         profit AS r_profit, department AS r_department, sales_volume AS r_sales_volume,
         TRY_CAST(date AS DATE) AS date, TRY_CAST(revenue AS DECIMAL(15,2)) AS revenue,
         TRY_CAST(cost AS DECIMAL(15,2)) AS cost, TRY_CAST(expenses AS DECIMAL(15,2)) AS expenses,
         TRY_CAST(profit AS DECIMAL(15,2)) AS profit, NULLIF(trim(department), '') AS department,
         CAST(TRUNC(TRY_CAST(sales_volume AS DECIMAL(20,4))) AS BIGINT) AS sales_volume
  FROM raw_uploads
),
judged AS (
  SELECT *, concat_ws('; ',
    CASE WHEN date IS NULL THEN 'invalid date ''' || r_date || '''' END,
    CASE WHEN revenue IS NULL THEN 'invalid revenue ''' || r_revenue || '''' END,
    CASE WHEN cost IS NULL THEN 'invalid cost ''' || r_cost || '''' END,
    CASE WHEN expenses IS NULL THEN 'invalid expenses ''' || r_expenses || '''' END,
    CASE WHEN profit IS NULL THEN 'invalid profit ''' || r_profit || '''' END,
    CASE WHEN department IS NULL THEN 'invalid department ''' || r_department || '''' END,
    CASE WHEN sales_volume IS NULL THEN 'invalid sales volume ''' || r_sales_volume || '''' END) AS problems
  FROM typed
),
good AS (SELECT * FROM judged WHERE problems = ''),
bad AS (
  SELECT filename, line, concat_ws(',', r_date, r_revenue, r_cost, r_expenses, r_profit, r_department, r_sales_volume) AS raw,
         'Row ' || line || ': ' || problems AS error
  FROM judged WHERE problems <> ''
)"""

BATCH = """
batch AS (
  SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(15,2)) AS revenue,
         CAST(ROUND(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(15,2)) AS cost,
         CAST(10 AS DECIMAL(15,2)) AS expenses,
         CAST(ROUND(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(0.25 AS DECIMAL(3,2)), 2) AS DECIMAL(15,2)) AS profit,
         o_orderpriority AS department, o_custkey AS sales_volume
  FROM orders
)"""

CHANGES = """
changes AS (
  SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 10
           + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id,
         o_orderkey AS seq,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 1 END AS date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) END AS revenue,
         CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(15,2)) END AS cost
  FROM orders
),
combined AS (
  SELECT id, arg_max(date, seq) FILTER (WHERE date IS NOT NULL) AS date,
         arg_max(revenue, seq) FILTER (WHERE revenue IS NOT NULL) AS revenue,
         arg_max(cost, seq) FILTER (WHERE cost IS NOT NULL) AS cost
  FROM changes GROUP BY id
),
targets AS (
  SELECT f.id, c.date, f.department FROM facts f JOIN combined c ON f.id = c.id WHERE c.date <> f.date
),
refused AS (
  SELECT t.id, t.date, t.department FROM targets t
  WHERE EXISTS (SELECT 1 FROM facts f WHERE f.date = t.date AND f.department = t.department)
     OR EXISTS (SELECT 1 FROM targets o WHERE o.date = t.date AND o.department = t.department AND o.id < t.id)
),
updated AS (
  SELECT f.id, COALESCE(c.date, f.date) AS date, f.department, COALESCE(c.revenue, f.revenue) AS revenue,
         COALESCE(c.cost, f.cost) AS cost, f.expenses, f.profit, f.sales_volume, f.created_by
  FROM facts f LEFT JOIN (SELECT * FROM combined WHERE id NOT IN (SELECT id FROM refused)) c ON f.id = c.id
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def _pct(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0) * 100"


def _kpis(where: str = "TRUE") -> str:
    return f"""
, months AS (
  SELECT date_trunc('month', date) AS m, SUM(revenue) AS r, SUM(cost) AS c, SUM(expenses) AS e, SUM(profit) AS p,
         SUM(sales_volume) AS s, COUNT(*) AS n
  FROM facts WHERE {where} GROUP BY 1
),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY m DESC) AS back FROM months),
latest AS (
  SELECT MAX(CASE WHEN back = 1 THEN r END) AS cur, MAX(CASE WHEN back = 2 THEN r END) AS prev FROM ranked
)
SELECT CAST(COALESCE(SUM(r), 0) AS DOUBLE) AS total_revenue, CAST(COALESCE(SUM(c), 0) AS DOUBLE) AS total_cost,
       CAST(COALESCE(SUM(e), 0) AS DOUBLE) AS total_expenses, CAST(COALESCE(SUM(p), 0) AS DOUBLE) AS net_profit,
       CASE WHEN SUM(r) > 0 THEN ROUND({_pct('SUM(p)', 'SUM(r)')}, 2) ELSE CAST(0 AS DOUBLE) END AS profit_margin,
       CAST(COALESCE(SUM(s), 0) AS BIGINT) AS total_sales_volume,
       COALESCE((SELECT CASE WHEN prev > 0 THEN ROUND({_pct('(cur - prev)', 'prev')}, 2) END FROM latest), CAST(0 AS DOUBLE)) AS monthly_growth,
       CAST(COALESCE(SUM(n), 0) AS BIGINT) AS record_count
FROM months"""


SCOPE = "date >= DATE '1997-01-15' AND date <= DATE '1999-06-30' AND department = '2-HIGH'"
IN_MONTH = "date >= DATE '1998-03-01' AND date < DATE '1998-04-01'"

KPI = _with(FACTS) + _kpis()
PROC = f"""
SELECT CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(cost) AS DOUBLE) AS total_cost,
       CAST(SUM(expenses) AS DOUBLE) AS total_expenses, CAST(SUM(profit) AS DOUBLE) AS net_profit,
       ROUND({_pct('SUM(profit)', 'SUM(revenue)')}, 2) AS profit_margin, CAST(SUM(sales_volume) AS BIGINT) AS total_sales
FROM facts WHERE year(date) = 1998 AND month(date) = 3"""

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 <> 0 THEN strftime({0}, '.%f') ELSE '' END"


def _iso(column: str) -> str:
    return "(" + _ISO.format(column) + ")"


RECORD = f"""id, strftime(date, '%Y-%m-%d') AS date, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
  CAST(expenses AS DOUBLE) AS expenses, CAST(profit AS DOUBLE) AS profit, department, sales_volume,
  {_iso('created_at')} AS created_at, created_by,
  CASE WHEN revenue > 0 THEN ROUND({_pct('profit', 'revenue')}, 2) ELSE CAST(0 AS DOUBLE) END AS row_margin"""
UPLOAD = f"""id, filename, records_count, status, error_message, uploaded_by, {_iso('created_at')} AS created_at,
  upper(substr(status, 1, 1)) || substr(status, 2) AS status_label,
  CASE status WHEN 'success' THEN 'check' WHEN 'partial' THEN 'exclamation' ELSE 'times' END AS status_icon,
  CASE WHEN filename LIKE '%.csv' THEN 'csv' ELSE 'excel' END AS file_kind"""
ALERT = f"id, type, message, severity, department, is_read, {_iso('created_at')} AS created_at"
USER = f"id, name, email, role, is_active, {_iso('created_at')} AS created_at, {_iso('last_login')} AS last_login"
KEYED = """id, strftime(date, '%Y-%m-%d') AS date, department, CAST(revenue AS DOUBLE) AS revenue,
  CAST(cost AS DOUBLE) AS cost, CAST(expenses AS DOUBLE) AS expenses, CAST(profit AS DOUBLE) AS profit,
  CAST(sales_volume AS BIGINT) AS sales_volume, CAST(created_by AS VARCHAR) AS owner"""

PROFITABILITY = f"""
rated AS (
  SELECT department, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(cost) AS DOUBLE) AS cost,
         CAST(SUM(profit) AS DOUBLE) AS profit, CAST(SUM(expenses) AS DOUBLE) AS expenses,
         ROUND(COALESCE(AVG({_pct('profit', 'revenue')}), 0), 2) AS avg_row_margin
  FROM facts GROUP BY department
)"""

MONTHS = "months AS (SELECT strftime(date, '%Y-%m') AS month, SUM(revenue) AS r, SUM(profit) AS p, SUM(cost) AS c, SUM(sales_volume) AS s FROM facts GROUP BY 1)"

EVALUATED = f"""
totals AS (
  SELECT department, SUM(revenue) AS r, SUM(expenses) AS e,
         CASE WHEN SUM(revenue) > 0 THEN {_pct('SUM(profit)', 'SUM(revenue)')} ELSE CAST(0 AS DOUBLE) END AS margin
  FROM facts GROUP BY department
),
months AS (SELECT date_trunc('month', date) AS m, SUM(revenue) AS r FROM facts GROUP BY 1),
lagged AS (SELECT m, r, LAG(r) OVER (ORDER BY m) AS prev FROM months),
newest AS (SELECT * FROM lagged ORDER BY m DESC LIMIT 1),
dropped AS (SELECT {_pct('(prev - r)', 'prev')} AS d FROM newest WHERE prev > 0),
fired AS (
  SELECT 'low_margin' AS type, 'Low profit margin (' || printf('%.1f', margin) || '%) detected in ' || department AS message,
         'warning' AS severity, department, margin AS value FROM totals WHERE margin < 10
  UNION ALL
  SELECT 'expense_exceed', 'Expenses exceed revenue in ' || department || '!', 'danger', department,
         CAST(e - r AS DOUBLE) FROM totals WHERE e > r
  UNION ALL
  SELECT 'revenue_drop', 'Revenue dropped by ' || printf('%.1f', d) || '% compared to last month', 'danger', NULL, d
  FROM dropped WHERE d > 10
)"""

MERGED = """
last_rows AS (
  SELECT date, department, arg_max(revenue, seq) AS revenue, arg_max(cost, seq) AS cost,
         arg_max(expenses, seq) AS expenses, arg_max(profit, seq) AS profit, arg_max(sales_volume, seq) AS sales_volume,
         MIN(seq) AS first_seq FROM batch GROUP BY 1, 2
),
merged AS (
  SELECT COALESCE(f.id, 1099511627776 + b.first_seq) AS id, COALESCE(f.date, b.date) AS date,
         COALESCE(f.department, b.department) AS department, COALESCE(b.revenue, f.revenue) AS revenue,
         COALESCE(b.cost, f.cost) AS cost, COALESCE(b.expenses, f.expenses) AS expenses,
         COALESCE(b.profit, f.profit) AS profit, COALESCE(b.sales_volume, f.sales_volume) AS sales_volume,
         CASE WHEN f.id IS NULL THEN 7 ELSE f.created_by END AS created_by
  FROM facts f FULL OUTER JOIN last_rows b ON f.date = b.date AND f.department = b.department
)"""

INSERTED = """
first_rows AS (
  SELECT date, department, arg_min(revenue, seq) AS revenue, arg_min(cost, seq) AS cost,
         arg_min(expenses, seq) AS expenses, arg_min(profit, seq) AS profit, arg_min(sales_volume, seq) AS sales_volume,
         MIN(seq) AS first_seq FROM batch GROUP BY 1, 2
),
merged AS (
  SELECT id, date, department, revenue, cost, expenses, profit, sales_volume, created_by FROM facts
  UNION ALL
  SELECT 1099511627776 + first_seq, date, department, revenue, cost, expenses, profit, sales_volume, NULL
  FROM first_rows b WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.date = b.date AND f.department = b.department)
)"""

INGESTED = """
numbered AS (SELECT filename, line, ROW_NUMBER() OVER (ORDER BY filename, line) - 1 AS seq FROM raw_uploads),
uploaded AS (
  SELECT date, department, 1099511627776 + MIN(seq) AS id, MIN(filename) AS filename, arg_max(revenue, line) AS revenue, arg_max(cost, line) AS cost, arg_max(expenses, line) AS expenses,
         arg_max(profit, line) AS profit, arg_max(sales_volume, line) AS sales_volume
  FROM good JOIN numbered USING (filename, line) GROUP BY date, department
)"""
FILE_LINES = """
file_lines AS (SELECT filename, line, ROW_NUMBER() OVER (PARTITION BY filename ORDER BY line) + 1 AS file_line FROM raw_uploads)"""
STORED_ROWS = """
SELECT id, strftime(date, '%Y-%m-%d') AS date, department, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
  CAST(expenses AS DOUBLE) AS expenses, CAST(profit AS DOUBLE) AS profit, sales_volume, '7' AS owner FROM uploaded"""

# What the rules say once two departments' revenues are a cent a record, and of it what was not open yet.
POLLED = (
    "edited AS (SELECT * REPLACE (CASE WHEN department IN ('1-URGENT', '2-HIGH') THEN 0.01 ELSE revenue END AS revenue) FROM facts),\n"
    + EVALUATED.strip()
    .replace("FROM facts", "FROM edited")
    .replace("totals", "totals_2").replace("months", "months_2").replace("lagged", "lagged_2")
    .replace("newest", "newest_2").replace("dropped AS", "dropped_2 AS").replace("FROM dropped WHERE", "FROM dropped_2 WHERE")
    .replace("fired AS", "fired_2 AS")
    + """,
polled AS (
  SELECT FALSE AS second_poll, type, severity, department FROM fired
  UNION ALL
  SELECT TRUE, type, severity, department FROM fired_2 n
  WHERE NOT EXISTS (SELECT 1 FROM fired f WHERE f.type = n.type AND (n.type = 'revenue_drop' OR f.department = n.department))
)"""
)

KPI_LINES = """
SELECT CAST(line AS BIGINT) AS line, metric, value FROM (
  SELECT 1 AS line, 'Total Revenue' AS metric, total_revenue AS value FROM k
  UNION ALL SELECT 2, 'Total Cost', total_cost FROM k
  UNION ALL SELECT 3, 'Total Expenses', total_expenses FROM k
  UNION ALL SELECT 4, 'Net Profit', net_profit FROM k
  UNION ALL SELECT 5, 'Profit Margin (%)', profit_margin FROM k
  UNION ALL SELECT 6, 'Monthly Growth (%)', monthly_growth FROM k
  UNION ALL SELECT 7, 'Total Sales Volume', CAST(total_sales_volume AS DOUBLE) FROM k)"""


def _short(column: str) -> str:
    return (
        f"CASE WHEN {column} >= 1000000 THEN printf('%.2fM', {column} / 1000000) "
        f"WHEN {column} >= 1000 THEN printf('%.2fK', {column} / 1000) ELSE printf('%.2f', {column}) END"
    )


PRINTED_KPIS = f"""
SELECT CAST(line AS BIGINT) AS line, metric, value, short_value, trend FROM (
  SELECT 1 AS line, 'Total Revenue' AS metric, format('${{:,.2f}}', total_revenue) AS value,
         {_short('total_revenue')} AS short_value, CASE WHEN monthly_growth >= 0 THEN 'up' ELSE 'down' END AS trend FROM k
  UNION ALL SELECT 2, 'Total Cost', format('${{:,.2f}}', total_cost), {_short('total_cost')}, NULL FROM k
  UNION ALL SELECT 3, 'Net Profit', format('${{:,.2f}}', net_profit), {_short('net_profit')},
         CASE WHEN monthly_growth >= 0 THEN 'up' ELSE 'down' END FROM k
  UNION ALL SELECT 4, 'Profit Margin', format('{{:.2f}}%', profit_margin), NULL, NULL FROM k
  UNION ALL SELECT 5, 'Monthly Growth', format('{{:.2f}}%', monthly_growth), NULL, NULL FROM k
  UNION ALL SELECT 6, 'Total Sales Volume', format('{{:,}}', total_sales_volume), NULL, NULL FROM k)"""

ORACLE_SQL: dict[str, str] = {
    "kpi_summary": KPI,
    "kpi_summary_filtered": _with(FACTS) + _kpis(SCOPE),
    "kpi_summary_owner": _with(FACTS, USERS)
    + _kpis("(SELECT role FROM users WHERE id = 7) = 'Admin' OR created_by = 7"),
    "kpi_month": _with(FACTS) + _kpis(IN_MONTH),
    "revenue_trend": _with(FACTS, MONTHS)
    + "SELECT month, CAST(r AS DOUBLE) AS revenue, CAST(p AS DOUBLE) AS profit, CAST(c AS DOUBLE) AS cost FROM months ORDER BY month",
    "revenue_trend_filtered": _with(FACTS, MONTHS.replace("FROM facts", f"FROM facts WHERE {SCOPE}"))
    + "SELECT month, CAST(r AS DOUBLE) AS revenue, CAST(p AS DOUBLE) AS profit, CAST(c AS DOUBLE) AS cost FROM months ORDER BY month",
    "sales_trend": _with(FACTS, MONTHS) + "SELECT month, CAST(s AS BIGINT) AS sales FROM months ORDER BY month",
    "margin_trend": _with(FACTS, MONTHS)
    + f"SELECT month, CASE WHEN r > 0 THEN ROUND({_pct('p', 'r')}, 2) ELSE CAST(0 AS DOUBLE) END AS margin FROM months ORDER BY month",
    "monthly_growth": _with(FACTS, MONTHS, "lagged AS (SELECT month, r, LAG(r) OVER (ORDER BY month) AS prev FROM months)")
    + f"SELECT month, ROUND({_pct('(r - prev)', 'prev')}, 2) AS growth_rate FROM lagged WHERE prev > 0 ORDER BY month",
    "monthly_growth_by_department": _with(
        FACTS,
        "cells AS (SELECT department, strftime(date, '%Y-%m') AS month, SUM(revenue) AS r FROM facts GROUP BY 1, 2)",
        "lagged AS (SELECT *, LAG(r) OVER (PARTITION BY department ORDER BY month) AS prev FROM cells)",
    )
    + f"SELECT department, month, ROUND({_pct('(r - prev)', 'prev')}, 2) AS growth_rate FROM lagged WHERE prev > 0",
    "department_distribution": _with(FACTS)
    + """SELECT department, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit,
       CAST(SUM(cost) AS DOUBLE) AS cost, CAST(SUM(sales_volume) AS BIGINT) AS sales FROM facts GROUP BY department""",
    "department_profitability": _with(FACTS, PROFITABILITY) + "SELECT * FROM rated",
    "department_labels": _with(FACTS, PROFITABILITY)
    + """SELECT department, avg_row_margin,
       CASE WHEN avg_row_margin >= 20 THEN 'Excellent' WHEN avg_row_margin >= 10 THEN 'Good' ELSE 'Needs Attention' END AS performance,
       CASE WHEN avg_row_margin >= 20 THEN 'text-success' WHEN avg_row_margin >= 10 THEN 'text-warning' ELSE 'text-danger' END AS css_class
       FROM rated""",
    "top_worst_department": _with(
        FACTS,
        PROFITABILITY,
        "best AS (SELECT 'top' AS performer, * FROM rated ORDER BY profit DESC, department LIMIT 1)",
        "worst AS (SELECT 'worst' AS performer, * FROM rated ORDER BY profit, department DESC LIMIT 1)",
    )
    + "SELECT * FROM best UNION ALL SELECT * FROM worst",
    "month_breakdown": _with(FACTS)
    + f"SELECT department, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit FROM facts WHERE {IN_MONTH} GROUP BY department",
    "monthly_summary_departments": _with(
        FACTS,
        "cells AS (SELECT strftime(date, '%Y-%m') AS month, department, SUM(revenue) AS r, SUM(profit) AS p FROM facts GROUP BY 1, 2)",
        "shared AS (SELECT *, SUM(r) OVER (PARTITION BY month) AS total FROM cells)",
    )
    + f"""SELECT month, department, CAST(r AS DOUBLE) AS revenue, CAST(p AS DOUBLE) AS profit,
       CASE WHEN total > 0 THEN ROUND({_pct('r', 'total')}, 1) ELSE CAST(0 AS DOUBLE) END AS share FROM shared""",
    "departments": _with(FACTS) + "SELECT DISTINCT department FROM facts",
    "proc_monthly_kpis": _with(FACTS) + PROC + " AND department = '2-HIGH'",
    "proc_monthly_kpis_all": _with(FACTS) + PROC,
    "proc_department_performance": _with(FACTS)
    + f"""SELECT department, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(cost) AS DOUBLE) AS total_cost,
       CAST(SUM(profit) AS DOUBLE) AS total_profit, CAST(SUM(sales_volume) AS BIGINT) AS total_sales,
       ROUND({_pct('SUM(profit)', 'SUM(revenue)')}, 2) AS profit_margin, COUNT(*) AS record_count
       FROM facts GROUP BY department ORDER BY total_profit DESC""",
    "view_monthly_summary": _with(FACTS)
    + f"""SELECT strftime(date, '%Y-%m') AS month, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(cost) AS DOUBLE) AS total_cost,
       CAST(SUM(profit) AS DOUBLE) AS total_profit, CAST(SUM(expenses) AS DOUBLE) AS total_expenses,
       CAST(SUM(sales_volume) AS BIGINT) AS total_sales, ROUND({_pct('SUM(profit)', 'SUM(revenue)')}, 2) AS profit_margin
       FROM facts GROUP BY 1 ORDER BY month DESC""",
    "view_department_summary": _with(FACTS)
    + f"""SELECT department, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(cost) AS DOUBLE) AS total_cost,
       CAST(SUM(profit) AS DOUBLE) AS total_profit, CAST(SUM(expenses) AS DOUBLE) AS total_expenses,
       CAST(SUM(sales_volume) AS BIGINT) AS total_sales,
       ROUND({_pct('SUM(profit)', 'SUM(revenue)')}, 2) AS profit_margin, COUNT(*) AS record_count
       FROM facts GROUP BY department""",
    "records_page": _with(FACTS)
    + f"SELECT {RECORD} FROM (SELECT * FROM facts ORDER BY date DESC, department, id LIMIT 50 OFFSET 100)",
    "records_page_deep": _with(FACTS)
    + f"SELECT {RECORD} FROM (SELECT * FROM facts ORDER BY date DESC, department, id LIMIT 70 OFFSET 2730)",
    "records_after": _with(FACTS)
    + f"""SELECT {RECORD} FROM (SELECT * FROM facts WHERE date < DATE '1998-03-15' OR (date = DATE '1998-03-15' AND department > '2-HIGH')
       ORDER BY date DESC, department, id LIMIT 50)""",
    "records_page_info": _with(FACTS)
    + "SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / 50.0) AS BIGINT) AS pages, CAST(3 AS BIGINT) AS current_page FROM facts",
    "record_by_id": _with(FACTS) + f"SELECT {RECORD} FROM facts WHERE id = 103291",
    "users_list": _with(USERS) + f"SELECT {USER} FROM users",
    "users_active": _with(USERS) + f"SELECT {USER} FROM users WHERE is_active",
    "users_recent_logins": _with(USERS) + f"SELECT {USER} FROM users WHERE last_login >= TIMESTAMP '2024-01-30 00:00:00'",
    "user_activity": _with(FACTS, USERS, HISTORY)
    + f"""SELECT u.id AS user_id, name, email, role, {_iso('last_login')} AS last_login,
       COALESCE(uploads, 0) AS upload_count, COALESCE(records, 0) AS data_records
       FROM users u LEFT JOIN (SELECT uploaded_by, COUNT(*) AS uploads FROM history GROUP BY 1) h ON u.id = h.uploaded_by
       LEFT JOIN (SELECT created_by, COUNT(*) AS records FROM facts GROUP BY 1) f ON u.id = f.created_by""",
    "admin_statistics": _with(FACTS, USERS, HISTORY)
    + """SELECT (SELECT COUNT(*) FROM users) AS total_users, (SELECT COUNT(*) FROM users WHERE is_active) AS active_users,
       (SELECT COUNT(*) FROM facts) AS total_data_records, (SELECT COUNT(*) FROM history) AS total_uploads,
       (SELECT COUNT(*) FROM history WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00') AS recent_uploads_7days,
       (SELECT COUNT(*) FROM users WHERE last_login >= TIMESTAMP '2024-01-24 00:00:00') AS recent_logins_7days""",
    "owner_scoped_totals": _with(FACTS, USERS)
    + """SELECT u.id AS viewer, u.role, COUNT(f.id) AS visible_records, CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS visible_revenue,
       CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS visible_profit
       FROM users u LEFT JOIN facts f ON u.role = 'Admin' OR f.created_by = u.id GROUP BY u.id, u.role""",
    "uploads_with_owner": _with(USERS, HISTORY)
    + "SELECT h.id, filename, uploaded_by, u.name AS owner_name, u.role AS owner_role FROM history h LEFT JOIN users u ON h.uploaded_by = u.id",
    "totals_by_role": _with(FACTS, USERS)
    + """SELECT COALESCE(role, 'none') AS role, COUNT(*) AS records, CAST(SUM(revenue) AS DOUBLE) AS revenue
       FROM facts f LEFT JOIN users u ON f.created_by = u.id GROUP BY 1""",
    "user_recent_records": _with(
        FACTS, "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY created_by ORDER BY date DESC, department, id) AS k FROM facts)"
    )
    + f"SELECT {RECORD} FROM r WHERE k <= 100",
    "user_recent_uploads": _with(
        HISTORY, "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY uploaded_by ORDER BY created_at DESC, id) AS k FROM history)"
    )
    + f"SELECT {UPLOAD} FROM r WHERE k <= 20",
    "user_records": _with(FACTS)
    + f"SELECT {RECORD} FROM (SELECT * FROM facts WHERE created_by = 7 ORDER BY date DESC, department, id LIMIT 100)",
    "user_uploads": _with(HISTORY)
    + f"SELECT {UPLOAD} FROM (SELECT * FROM history WHERE uploaded_by = 7 ORDER BY created_at DESC, id LIMIT 20)",
    "upload_history_latest": _with(HISTORY)
    + f"SELECT {UPLOAD} FROM (SELECT * FROM history ORDER BY created_at DESC, id LIMIT 50)",
    "uploads_visible": _with(HISTORY, USERS)
    + f"""SELECT {UPLOAD} FROM (SELECT * FROM history WHERE (SELECT role FROM users WHERE id = 7) = 'Admin' OR uploaded_by = 7
       ORDER BY created_at DESC, id LIMIT 50)""",
    "upload_status_counts": _with(HISTORY)
    + "SELECT status, COUNT(*) AS uploads, CAST(SUM(records_count) AS BIGINT) AS records FROM history GROUP BY status",
    "alerts_generated": _with(FACTS, EVALUATED)
    + "SELECT type, message, severity, department, ROUND(value, 2) AS value FROM fired",
    "alerts_new": _with(FACTS, EVALUATED, ALERTS)
    + """SELECT type, message, severity, department, FALSE AS is_read FROM fired f WHERE NOT EXISTS (
       SELECT 1 FROM stored s WHERE NOT s.is_read AND s.type = f.type
         AND (f.type = 'revenue_drop' OR s.department IS NOT DISTINCT FROM f.department))""",
    "alerts_latest": _with(ALERTS) + f"SELECT {ALERT} FROM (SELECT * FROM stored ORDER BY created_at DESC, id LIMIT 100)",
    "alerts_latest_unread": _with(ALERTS)
    + f"SELECT {ALERT} FROM (SELECT * FROM stored WHERE NOT is_read ORDER BY created_at DESC, id LIMIT 100)",
    "alerts_first_five": _with(ALERTS)
    + f"SELECT {ALERT} FROM (SELECT * FROM stored WHERE NOT is_read ORDER BY created_at DESC, id LIMIT 5)",
    "alerts_unread": _with(ALERTS) + f"SELECT {ALERT} FROM stored WHERE NOT is_read",
    "alerts_unread_count": _with(ALERTS) + "SELECT COUNT(*) AS unread FROM stored WHERE NOT is_read",
    "alerts_mark_read": _with(ALERTS)
    + "SELECT id, type, department, is_read OR created_at >= TIMESTAMP '2024-01-24 00:00:00' AS is_read FROM stored",
    "alerts_mark_all_read": _with(ALERTS) + "SELECT id, type, department, TRUE AS is_read FROM stored",
    "upsert_last_wins": _with(FACTS, BATCH, MERGED) + f"SELECT {KEYED} FROM merged",
    "insert_if_absent": _with(FACTS, BATCH, INSERTED) + f"SELECT {KEYED} FROM merged",
    "ingest_accept": _with(RAW)
    + """SELECT filename, line, strftime(date, '%Y-%m-%d') AS date, department, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
       CAST(expenses AS DOUBLE) AS expenses, CAST(profit AS DOUBLE) AS profit, CAST(sales_volume AS DOUBLE) AS sales_volume FROM good""",
    "ingest_merged": _with(RAW)
    + """SELECT strftime(date, '%Y-%m-%d') AS date, department, CAST(arg_max(revenue, line) AS DOUBLE) AS revenue, CAST(arg_max(cost, line) AS DOUBLE) AS cost,
       CAST(arg_max(expenses, line) AS DOUBLE) AS expenses, CAST(arg_max(profit, line) AS DOUBLE) AS profit,
       CAST(arg_max(sales_volume, line) AS DOUBLE) AS sales_volume, MIN(line) AS first_seq FROM good GROUP BY date, department""",
    "ingest_rejects": _with(RAW) + "SELECT line, raw, error FROM bad",
    "ingest_file_status": _with(
        RAW,
        "firsts AS (SELECT arg_min(filename, line) AS filename FROM good GROUP BY date, department)",
        """counts AS (
          SELECT f.filename, (SELECT COUNT(*) FROM firsts x WHERE x.filename = f.filename) AS added,
                 (SELECT COUNT(*) FROM good g WHERE g.filename = f.filename) AS accepted,
                 (SELECT COUNT(*) FROM bad b WHERE b.filename = f.filename) AS errors
          FROM (SELECT DISTINCT filename FROM raw_uploads) f)""",
    )
    + """SELECT filename, added AS records_added, accepted - added AS records_updated, accepted AS records_count, errors,
       CASE WHEN errors > 0 THEN 'partial' ELSE 'success' END AS status FROM counts""",
    "ingest_error_summary": _with(
        RAW,
        "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY filename ORDER BY line) AS k FROM bad)",
    )
    + """SELECT date_diff('day', DATE '1970-01-01', CAST(substr(filename, 9, 10) AS DATE)) AS file_no,
       string_agg(error, chr(10) ORDER BY line) AS error_message FROM ranked WHERE k <= 10 GROUP BY filename""",
    "updates_applied": _with(FACTS, CHANGES) + f"SELECT {KEYED} FROM updated",
    "updates_rejected": _with(FACTS, CHANGES) + "SELECT id, strftime(date, '%Y-%m-%d') AS date, department FROM refused",
    "deletes_applied": _with(FACTS, CHANGES)
    + f"SELECT {KEYED} FROM facts WHERE id NOT IN (SELECT id FROM changes WHERE date IS NOT NULL)",
    "users_updated": _with(USERS)
    + """SELECT u.id, COALESCE(c.name, u.name) AS name, email, COALESCE(c.role, u.role) AS role, COALESCE(c.is_active, u.is_active) AS is_active
       FROM users u LEFT JOIN (
         SELECT user_id, 'User ' || MAX(CASE WHEN event_type = 'click' THEN event_id END) AS name,
                arg_max(CASE event_type WHEN 'signup' THEN 'Business Manager' ELSE 'Admin' END, event_id)
                  FILTER (WHERE event_type IN ('signup', 'purchase')) AS role,
                arg_max(event_type = 'view', event_id) FILTER (WHERE event_type IN ('error', 'view')) AS is_active
         FROM events GROUP BY user_id) c ON u.id = c.user_id""",
    "users_removed": _with(FACTS, USERS)
    + "SELECT id, CASE WHEN created_by NOT IN (SELECT id FROM users WHERE NOT is_active) THEN CAST(created_by AS VARCHAR) END AS owner FROM facts",
    "users_remaining": _with(USERS) + "SELECT id, name, role FROM users WHERE is_active",
    "quality_checks": _with(FACTS, USERS, HISTORY)
    + """SELECT 'business_data.created_by references users' AS "check", (SELECT COUNT(*) FROM facts WHERE created_by NOT IN (SELECT id FROM users)) AS violations
       UNION ALL SELECT 'upload_history.uploaded_by references users', (SELECT COUNT(*) FROM history WHERE uploaded_by NOT IN (SELECT id FROM users))
       UNION ALL SELECT 'users.email is unique ignoring case', (SELECT COUNT(*) - COUNT(DISTINCT lower(email)) FROM users)
       UNION ALL SELECT 'users.role is known', (SELECT COUNT(*) FROM users WHERE role NOT IN ('Admin', 'Business Manager', 'Analyst'))
       UNION ALL SELECT 'users.name and email are present', (SELECT COUNT(*) FROM users WHERE trim(COALESCE(name, '')) = '' OR trim(COALESCE(email, '')) = '')
       UNION ALL SELECT 'business_data (date, department) is unique', (SELECT COUNT(*) - COUNT(DISTINCT (date, department)) FROM facts)
       UNION ALL SELECT 'profit = revenue - cost - expenses', (SELECT COUNT(*) FROM facts WHERE profit <> revenue - cost - expenses)
       UNION ALL SELECT 'profit = revenue - cost', (SELECT COUNT(*) FROM facts WHERE profit <> revenue - cost)""",
    "report_kpi": f"WITH k AS ({KPI}) {KPI_LINES}",
    "report_display_kpis": f"WITH k AS ({KPI}) {PRINTED_KPIS}",
    "report_records": _with(FACTS)
    + f"""SELECT strftime(date, '%Y-%m-%d') AS date, department, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
       CAST(expenses AS DOUBLE) AS expenses, CAST(profit AS DOUBLE) AS profit, sales_volume,
       CASE WHEN revenue > 0 THEN ROUND({_pct('profit', 'revenue')}, 2) ELSE CAST(0 AS DOUBLE) END AS row_margin FROM facts""",
    "report_departments": _with(FACTS)
    + f"""SELECT department, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(cost) AS DOUBLE) AS cost, CAST(SUM(profit) AS DOUBLE) AS profit,
       CAST(SUM(sales_volume) AS BIGINT) AS sales_volume, ROUND({_pct('SUM(profit)', 'SUM(revenue)')}, 2) AS profit_margin
       FROM facts GROUP BY department""",
    "report_display_rows": _with(FACTS)
    + """SELECT strftime(date, '%Y-%m-%d') AS date, substr(department, 1, 15) AS department,
       format('${:,.2f}', CAST(revenue AS DOUBLE)) AS revenue, format('${:,.2f}', CAST(cost AS DOUBLE)) AS cost,
       format('${:,.2f}', CAST(profit AS DOUBLE)) AS profit, format('{:,}', sales_volume) AS sales
       FROM (SELECT * FROM facts ORDER BY date DESC, department, id LIMIT 50)""",
    "csv_ingest_roundtrip": _with(RAW, INGESTED) + STORED_ROWS,
    "csv_ingest_rejects": _with(RAW, FILE_LINES)
    + """SELECT filename, file_line AS line, raw, 'Row ' || file_line || regexp_replace(error, '^Row [0-9]+', '') AS error
         FROM bad JOIN file_lines USING (filename, line)""",
    "csv_ingest_history": _with(RAW, FILE_LINES)
    + """, listed AS (SELECT filename, 1099511627776 + ROW_NUMBER() OVER (ORDER BY filename) - 1 AS id
                      FROM (SELECT DISTINCT filename FROM raw_uploads)),
       counts AS (SELECT filename, COUNT(*) AS n FROM good GROUP BY 1),
       numbered_bad AS (SELECT filename, file_line, 'Row ' || file_line || regexp_replace(error, '^Row [0-9]+', '') AS error,
                               ROW_NUMBER() OVER (PARTITION BY filename ORDER BY file_line) AS k
                        FROM bad JOIN file_lines USING (filename, line)),
       texts AS (SELECT filename, string_agg(error, chr(10) ORDER BY file_line) AS error_message FROM numbered_bad WHERE k <= 10 GROUP BY 1)
       SELECT id, filename, COALESCE(n, 0) AS records_count, CASE WHEN error_message IS NULL THEN 'success' ELSE 'partial' END AS status,
              error_message, '7' AS owner
       FROM listed LEFT JOIN counts USING (filename) LEFT JOIN texts USING (filename)""",
    "csv_ingest_failed_files": _with(RAW)
    + """, kinds AS (SELECT trim(department) AS kind, filename, line FROM raw_uploads WHERE trim(department) <> ''),
       counts AS (SELECT kind, k.filename, COUNT(g.line) AS n, COUNT(*) AS rows FROM kinds k LEFT JOIN good g USING (filename, line) GROUP BY ALL)
       SELECT kind || '_' || CASE kind WHEN 'error' THEN replace(filename, '.csv', '.txt') WHEN 'signup' THEN replace(filename, '.csv', '.xlsx')
                                       WHEN 'purchase' THEN replace(filename, '.csv', '.CSV') ELSE filename END AS filename,
              CASE WHEN kind <> 'purchase' THEN 'failed' WHEN n < rows THEN 'partial' ELSE 'success' END AS status,
              CASE WHEN kind = 'purchase' THEN n ELSE 0 END AS records_count,
              CASE kind WHEN 'click' THEN 'Missing required columns: Expenses' WHEN 'view' THEN 'Ambiguous columns for Sales Volume'
                        WHEN 'error' THEN 'Invalid file format. Please upload CSV or Excel file.'
                        WHEN 'signup' THEN 'Excel workbooks cannot be read; upload CSV' END AS problem
       FROM counts""",
    "ingest_date_orders": _with(RAW)
    + """, dated AS (
         SELECT 'dated_' || line % 97 || '.csv' AS filename, line, TRY_CAST(date AS DATE) AS day, date AS text, line % 97 % 5 AS form,
                (line // 97) % 2 AS turn FROM raw_uploads),
       texts AS (
         SELECT filename, line, CASE WHEN day IS NULL OR form = 0 THEN text
           WHEN form = 1 OR (form = 3 AND turn = 0) THEN strftime(day, '%d/%m/%Y')
           WHEN form IN (2, 3) OR day(day) <= 12 THEN strftime(day, '%m/%d/%Y') ELSE strftime(day, '%-d %b %Y') END AS text FROM dated),
       readings AS (
         SELECT *, text LIKE '%/%' AS open_order, CAST(try_strptime(text, '%m/%d/%Y') AS DATE) AS by_month,
                CAST(try_strptime(text, '%d/%m/%Y') AS DATE) AS by_day,
                COALESCE(TRY_CAST(text AS DATE), CAST(try_strptime(text, '%d %b %Y') AS DATE)) AS plain FROM texts),
       orders AS (
         SELECT filename, bool_and(by_month IS NOT NULL) AS m, bool_and(by_day IS NOT NULL) AS d FROM readings
         WHERE open_order AND (by_month IS NOT NULL OR by_day IS NOT NULL) GROUP BY 1),
       decided AS (
         SELECT filename, line, text, NOT m AND NOT d AS torn,
                CASE WHEN NOT open_order THEN plain WHEN by_month = by_day OR m THEN by_month WHEN d THEN by_day END AS date
         FROM readings LEFT JOIN orders USING (filename))
       SELECT filename, line, strftime(date, '%Y-%m-%d') AS date,
              CASE WHEN date IS NULL THEN CASE WHEN torn THEN 'ambiguous' ELSE 'invalid' END || ' date \'\'' || text || '\'\'' END AS problem
       FROM decided""".replace("\\'", "'"),
    "seed_defaults": _with(RAW, INGESTED)
    + """, seeded AS (SELECT date, arg_min(revenue, line) AS revenue, MIN(seq) AS seq FROM typed JOIN numbered USING (filename, line)
                      WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY date)
       SELECT 1099511627776 + seq AS id, strftime(date, '%Y-%m-%d') AS date, 'Unknown' AS department, CAST(revenue AS DOUBLE) AS revenue,
              CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS expenses, CAST(0 AS DOUBLE) AS profit, 0 AS sales_volume,
              CAST(NULL AS VARCHAR) AS owner FROM seeded""",
    "stream_ingest": _with(RAW, INGESTED)
    + """, batches AS (SELECT filename, line, CASE WHEN filename < 'uploads_2024-01-16.csv' THEN 1 ELSE 2 END AS batch FROM raw_uploads),
       places AS (SELECT filename, line, batch * 1099511627776
                    + ROW_NUMBER() OVER (PARTITION BY batch ORDER BY filename, line) - 1 AS id FROM batches),
       firsts AS (SELECT date, department, MIN(p.id) AS id FROM good JOIN places p USING (filename, line) GROUP BY 1, 2)
       """
    + STORED_ROWS.replace("FROM uploaded", "FROM (SELECT u.* REPLACE (f.id AS id) FROM uploaded u JOIN firsts f USING (date, department))"),
    "stream_alerts": _with(RAW, INGESTED, EVALUATED.replace("FROM facts", "FROM uploaded"))
    + "SELECT type, message, severity, department, FALSE AS is_read FROM fired",
    "stream_alerts_poll": _with(FACTS, EVALUATED, POLLED)
    + """SELECT second_poll, type, severity, department, FALSE AS is_read FROM polled""",
    "ledger_users_removed": _with(FACTS, USERS, HISTORY, "kept AS (SELECT id FROM users WHERE is_active)")
    + """, known AS (SELECT id FROM users), gone AS (SELECT id FROM users WHERE NOT is_active)
       SELECT 'user' AS kind, id, CAST(id AS VARCHAR) AS owner FROM kept
       UNION ALL SELECT 'record', id, CASE WHEN created_by NOT IN (SELECT id FROM gone) THEN CAST(created_by AS VARCHAR) END FROM facts
       UNION ALL SELECT 'upload', id, CASE WHEN uploaded_by NOT IN (SELECT id FROM gone) THEN CAST(uploaded_by AS VARCHAR) END FROM history""",
    "ledger_kpis_scoped": _with(FACTS) + _kpis(SCOPE),
    "ledger_alerts_marked": _with(FACTS, EVALUATED)
    + """SELECT type, message, severity, department, type = 'low_margin' AS is_read FROM fired
       UNION ALL SELECT type, message, severity, department, FALSE FROM fired WHERE type = 'low_margin'""",
    "sql_monthly_kpis": _with(FACTS) + PROC,
    "growth_directions": _with(FACTS, MONTHS, "lagged AS (SELECT month, r, LAG(r) OVER (ORDER BY month) AS prev FROM months)")
    + f"""SELECT month, CASE WHEN g >= 0 THEN 'up' ELSE 'down' END AS direction, ROUND(ABS(g), 1) AS value
       FROM (SELECT month, ROUND({_pct('(r - prev)', 'prev')}, 2) AS g FROM lagged WHERE prev > 0)""",
    "records_rated": _with(FACTS)
    + f"""SELECT id, row_margin, CASE WHEN row_margin >= 20 THEN 'text-success' WHEN row_margin >= 10 THEN 'text-warning' ELSE 'text-danger' END AS css_class
       FROM (SELECT id, CASE WHEN revenue > 0 THEN ROUND({_pct('profit', 'revenue')}, 1) ELSE CAST(0 AS DOUBLE) END AS row_margin FROM facts)""",
    "user_login_dates": _with(USERS) + "SELECT id, COALESCE(strftime(last_login, '%b %-d, %Y'), '-') AS last_login FROM users",
    "ledger_updates": _with(FACTS, CHANGES) + f"SELECT {KEYED} FROM updated",
    "ledger_deletes": _with(FACTS, CHANGES)
    + f"SELECT {KEYED} FROM facts WHERE id NOT IN (SELECT id FROM changes WHERE date IS NOT NULL)",
}
ORACLE_SQL["seed_load"] = (
    _with(RAW, INGESTED)
    + """SELECT 1099511627776 + MIN(seq) AS id, CAST(NULL AS VARCHAR) AS owner, strftime(date, '%Y-%m-%d') AS date, department, CAST(arg_min(revenue, line) AS DOUBLE) AS revenue, CAST(arg_min(cost, line) AS DOUBLE) AS cost,
       CAST(arg_min(expenses, line) AS DOUBLE) AS expenses, CAST(arg_min(profit, line) AS DOUBLE) AS profit, arg_min(sales_volume, line) AS sales_volume
       FROM good JOIN numbered USING (filename, line) WHERE r_sales_volume NOT LIKE '%.%' GROUP BY date, department"""
)
ORACLE_SQL["kpi_summary_cells"] = ORACLE_SQL["kpi_summary"]
ORACLE_SQL["department_profitability_cells"] = ORACLE_SQL["department_profitability"]
ORACLE_SQL["report_files"] = ORACLE_SQL["report_records"]
ORACLE_SQL["report_files_departments"] = ORACLE_SQL["report_departments"]
ORACLE_SQL["ledger_users_updated"] = ORACLE_SQL["users_updated"]
ORACLE_SQL["ledger_trend_cells"] = ORACLE_SQL["revenue_trend"]
ORACLE_SQL["sql_department_performance"] = ORACLE_SQL["proc_department_performance"]
ORACLE_SQL["report_files_kpi"] = ORACLE_SQL["report_kpi"]
ORACLE_SQL["report_files_printed"] = ORACLE_SQL["report_display_rows"]
