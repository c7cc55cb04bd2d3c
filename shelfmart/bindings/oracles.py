"""SQL each registered query is checked against, over the sample tables only."""

from __future__ import annotations

import re

from shelfmart.seeds import DEFAULT_RULES, MARKETPLACE_STATUSES, WEBSITE_STATUSES

WEB = 1 << 56
MKT = 2 << 56
AS_OF = "TIMESTAMP '2001-07-31 12:00:00'"
CUT = "TIMESTAMP '2000-01-01'"
RUN_AT, SECOND_RUN_AT = "TIMESTAMP '2001-08-02'", "TIMESTAMP '2001-08-03'"
COOLDOWN_AT = "TIMESTAMP '2024-01-31'"
LINE_TOTAL = "CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def _values(rows) -> str:
    def literal(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def _pick(source: str, key: str, frozen: list[str], updated: list[str], order: list[str]) -> str:
    """Keyed upsert of a table of versions: frozen columns of the first one, the others of the last one, both by batch
    and then by `order`."""
    first = ", ".join(f"{c} NULLS FIRST" for c in ["batch", *order])
    last = ", ".join(f"{c} DESC NULLS LAST" for c in ["batch", *order])
    return f"""
      SELECT f.{key}, {", ".join("f." + c for c in frozen)}, u.* EXCLUDE ({key}, rn)
      FROM (SELECT {key}, {", ".join(frozen)}, row_number() OVER (PARTITION BY {key} ORDER BY {first}) AS rn
            FROM {source}) f
      JOIN (SELECT {key}, {", ".join(updated)}, row_number() OVER (PARTITION BY {key} ORDER BY {last}) AS rn
            FROM {source}) u USING ({key})
      WHERE f.rn = 1 AND u.rn = 1"""


def _web_line(source: str) -> str:
    return f"""
      SELECT l_orderkey * 100000 + l_linenumber * 10000 + (CAST(l_shipdate AS DATE) - DATE '1995-01-01')
               AS order_product_id,
             l_orderkey AS order_id, l_partkey AS product_id, 'part ' || l_partkey AS name, 'M' || l_partkey AS model,
             CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(15,4)) AS price,
             CAST({LINE_TOTAL} AS DECIMAL(15,4)) AS total, CAST(l_tax AS DECIMAL(15,4)) AS tax, batch
      FROM {source}"""


def _mkt_line(source: str) -> str:
    return f"""
      SELECT l_orderkey AS marketplace_order_id,
             l_orderkey * 100000 + l_linenumber * 10000 + (CAST(l_shipdate AS DATE) - DATE '1995-01-01') AS purchase_id,
             l_partkey AS item_id,
             CASE WHEN l_partkey % 7 = 0 THEN 'unlisted ' || l_partkey ELSE '  ' || upper(p_name) || ' ' END AS item_name,
             CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
             CAST(l_extendedprice AS DECIMAL(12,2)) AS cost,
             CAST({LINE_TOTAL} AS DECIMAL(12,2)) AS cost_with_discount, batch
      FROM {source} LEFT JOIN part ON p_partkey = l_partkey"""


# All columns of a line but its key, as staged: the order of versions that carry no version.
WEB_LINE_ORDER = ["order_id", "product_id", "name", "model", "quantity", "price", "total", "tax"]
MKT_LINE_ORDER = ["marketplace_order_id", "item_id", "item_name", "quantity", "price", "cost", "cost_with_discount"]
WEB_LINE_FROZEN = ["order_id", "product_id", "name", "model", "tax"]
WEB_LINE_UPDATED = ["quantity", "price", "total"]
MKT_LINE_FROZEN = ["marketplace_order_id", "item_id", "item_name", "price", "cost"]
MKT_LINE_UPDATED = ["quantity", "cost_with_discount"]


def _json(columns: list[str]) -> str:
    """Columns as JSON text; names and titles of the sample hold nothing that has to be escaped."""
    texts = ("name", "model", "item_name")
    value = lambda c: f"""'"' || {c} || '"'""" if c in texts else f"CAST({c} AS VARCHAR)"
    fields = [f"""'"{c}":' || coalesce({value(c)}, 'null')""" for c in columns]
    return "'{' || " + " || ',' || ".join(fields) + " || '}'"


def _line_pick(source: str, key: str, frozen: list[str], updated: list[str], extra: list[str] | None = None) -> str:
    order = WEB_LINE_ORDER if key == "order_product_id" else MKT_LINE_ORDER
    return _pick(source, key, frozen, updated + (extra or []), order)


# Customers as a category tree of any depth: a binary heap of ids with some broken and some circular links.
DEEP_TREE = """WITH RECURSIVE deep AS (
      SELECT c_custkey + 1 AS category_id, c_name AS name,
             CASE WHEN c_custkey = 0 THEN 0 WHEN c_custkey % 97 = 5 THEN c_custkey + 100000000
                  WHEN c_custkey % 89 = 7 THEN c_custkey + 1 ELSE (c_custkey + 1) // 2 END AS parent_id
      FROM customer),
    tree AS (
      SELECT category_id, name, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS VARCHAR) AS parent_name
      FROM deep WHERE parent_id = 0
      UNION ALL
      SELECT d.category_id, d.name, d.parent_id, t.name FROM deep d JOIN tree t ON d.parent_id = t.category_id)"""


def _calendar(first: str, last: str) -> str:
    return f"""
      SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, CAST(d AS DATE) AS full_date,
             day(d) AS day_of_month, rpad(dayname(d), 9, ' ') AS day_name, isodow(d) AS day_of_week,
             weekofyear(d) AS week_of_year, month(d) AS month, rpad(monthname(d), 9, ' ') AS month_name,
             quarter(d) AS quarter, year(d) AS year, isodow(d) IN (6, 7) AS is_weekend,
             CASE WHEN month(d) IN (3, 4, 5) THEN 'Spring' WHEN month(d) IN (6, 7, 8) THEN 'Summer'
                  WHEN month(d) IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END AS season
      FROM (SELECT unnest(generate_series({first}, {last}, INTERVAL 1 DAY)) AS d)"""


RULES = [
    (number, kind, name, int(threshold), None, True, cooldown, None)
    for number, (kind, name, threshold, cooldown) in enumerate(DEFAULT_RULES, start=1)
] + [
    (4, "revenue_spike", "Website revenue", 10, 1, True, 24, None),
    (5, "no_orders", "Marketplace orders", 1, 2, True, 24, "ops@example.org"),
    (6, "low_stock", "Switched off", 50, None, False, 24, None),
    (7, "price_drop", "Unknown", 1, None, True, 24, None),
    (8, "revenue_spike", "All revenue", 10, None, True, 24, None),
]

# Named building blocks; a query takes those its text mentions.
BLOCKS = {
    "statuses": f"""
      SELECT {WEB} + source_id AS status_id, source_id, 'website' AS source_channel, name_en, status_group
      FROM (VALUES {_values(WEBSITE_STATUSES)}) w(source_id, name_en, status_group)
      UNION ALL
      SELECT {MKT} + source_id, source_id, 'marketplace', name_en, status_group
      FROM (VALUES {_values(MARKETPLACE_STATUSES)}) m(source_id, name_en, status_group)""",
    "channels": "SELECT * FROM (VALUES (1, 'Website'), (2, 'Marketplace')) c(channel_id, channel_name)",
    "rules": f"""
      SELECT * FROM (VALUES {_values(RULES)})
        r(rule_id, rule_type, rule_name, threshold, channel_id, is_active, cooldown_hours, notify_email)""",
    "supplier_rules": """
      SELECT CAST(s_suppkey AS INTEGER) AS rule_id, 'low_stock' AS rule_type, 'Stock of ' || s_name AS rule_name,
             CAST(s_nationkey % 6 AS DECIMAL(12,2)) AS threshold, CAST(NULL AS INTEGER) AS channel_id,
             CAST(NULL AS BIGINT) AS category_id, s_acctbal >= 0 AS is_active, 24 AS cooldown_hours,
             CAST(NULL AS VARCHAR) AS notify_email,
             TIMESTAMP '2001-01-01' + to_days(s_nationkey) AS created_at
      FROM supplier""",
    "dim_date": _calendar("DATE '1994-12-01'", "DATE '2001-12-31'"),
    "web_orders": """
      SELECT o_orderkey AS order_id, 0 AS store_id,
             CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_custkey + 1 END AS customer_id, 0 AS customer_group_id,
             'Kyiv' AS payment_city, 'Ukraine' AS payment_country, 'City ' || (o_custkey % 25) AS shipping_city,
             'courier' AS shipping_method, o_orderpriority AS payment_method,
             CAST(o_totalprice AS DECIMAL(15,4)) AS total,
             CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 1 ELSE 7 END AS order_status_id,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 'USD' ELSE 'UAH' END AS currency_code,
             CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 41.5 ELSE 1 END AS DECIMAL(15,8)) AS currency_value,
             o_orderdate - to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS date_added, o_orderdate AS date_modified
      FROM orders WHERE o_orderpriority < '4'""",
    "web_line_rows": _web_line(
        "(SELECT *, 0 AS batch FROM lineitem WHERE l_orderkey IN (SELECT order_id FROM web_orders))"
    ),
    "web_lines": _line_pick("web_line_rows", "order_product_id", WEB_LINE_FROZEN, WEB_LINE_UPDATED),
    "mkt_orders": """
      SELECT o_orderkey AS marketplace_order_id, 1 AS market_id,
             o_orderdate - to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created, o_orderdate AS changed,
             CAST(o_totalprice AS DECIMAL(12,2)) AS amount, CAST(o_totalprice AS DECIMAL(12,2)) AS amount_with_discount,
             CAST(NULL AS DECIMAL(12,2)) AS cost, CAST(o_totalprice AS DECIMAL(12,2)) AS cost_with_discount,
             CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'O' THEN 1 ELSE 45 END AS status,
             CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 3 END AS status_group,
             'City ' || (o_custkey % 25) AS delivery_city, 'post' AS delivery_service,
             repeat('7', CAST(floor(o_totalprice) AS BIGINT) % 80) AS ttn, CAST(NULL AS INTEGER) AS total_quantity
      FROM orders WHERE o_orderpriority >= '4'""",
    "mkt_line_rows": _mkt_line(
        "(SELECT *, 0 AS batch FROM lineitem WHERE l_orderkey IN (SELECT marketplace_order_id FROM mkt_orders))"
    ),
    "mkt_lines": _line_pick("mkt_line_rows", "purchase_id", MKT_LINE_FROZEN, MKT_LINE_UPDATED),
    "products": """
      SELECT p_partkey AS product_id, 'M' || p_partkey AS model, p_type AS sku, p_size AS quantity,
             CASE WHEN p_size > 0 THEN 7 END AS stock_status_id, p_partkey % 10 AS manufacturer_id,
             CAST(p_retailprice AS DECIMAL(15,4)) AS price,
             CASE WHEN p_size < 10 THEN NULL ELSE DATE '1999-05-01' END AS date_available,
             1999 AS publishing_year, p_size AS pages_number, p_brand AS author, 'Paperback' AS binding_type,
             CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS status, TIMESTAMP '1998-01-01' AS date_added,
             TIMESTAMP '2001-01-01' - to_days(p_size * 10) AS date_modified, p_name AS name, p_type AS description,
             CASE WHEN p_partkey % 17 <> 0 THEN CAST(101 + p_partkey % 25 AS INTEGER) END AS main_category_id
      FROM part""",
    "categories": """
      SELECT r_regionkey + 1 AS category_id, 0 AS parent_id, 1 AS status, r_regionkey AS sort_order, r_name AS name
      FROM region
      UNION ALL
      SELECT n_nationkey + 101, n_regionkey + 1, 1, n_nationkey, n_name FROM nation""",
    "customer_groups": """
      SELECT length(c_mktsegment) AS customer_group_id, min(c_mktsegment) AS customer_group_name
      FROM customer GROUP BY length(c_mktsegment)""",
    "customers": """
      SELECT c_custkey + 1 AS customer_id, length(c_mktsegment) AS customer_group_id, 0 AS store_id,
             c_custkey % 2 = 0 AS is_newsletter,
             TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS date_added, customer_group_name
      FROM customer JOIN customer_groups ON customer_group_id = length(c_mktsegment)""",
    "dim_publisher": f"""
      SELECT {WEB} + s_suppkey AS publisher_id, s_suppkey AS source_manufacturer_id, s_name AS name,
             'nation ' || s_nationkey AS description FROM supplier""",
    "dim_category": f"""
      SELECT {WEB} + c.category_id AS category_id, c.category_id AS source_category_id, 'website' AS source_channel,
             c.name, {WEB} + p.category_id AS parent_id, p.name AS parent_name, c.parent_id = 0 AS is_age_group,
             c.sort_order
      FROM categories c LEFT JOIN categories p ON p.category_id = c.parent_id
      WHERE c.parent_id = 0 OR p.category_id IS NOT NULL""",
    "dim_product": f"""
      SELECT {WEB} + p.product_id AS product_id, p.product_id AS source_product_id, 'website' AS source_channel,
             p.name AS title, author, CAST(NULL AS VARCHAR) AS isbn, publisher_id, publishing_year, pages_number,
             binding_type, c.category_id, price, quantity AS quantity_in_stock, 'In stock' AS stock_status,
             CASE WHEN status = 1 THEN 'active' ELSE 'inactive' END AS status, date_available, date_added,
             {RUN_AT} AS last_updated
      FROM products p
      LEFT JOIN dim_publisher u ON u.source_manufacturer_id = p.manufacturer_id
      LEFT JOIN dim_category c ON c.source_category_id = p.main_category_id""",
    "dim_customer": f"""
      SELECT {WEB} + customer_id AS customer_id, customer_id AS source_customer_id, 'website' AS source_channel,
             customer_group_name AS customer_group, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS country,
             CAST(date_added AS DATE) AS date_registered, is_newsletter
      FROM customers""",
    "web_facts": f"""
      SELECT {WEB} + o.order_id AS order_id, o.order_id AS source_order_id, 1 AS channel_id,
             CAST(strftime(o.date_added, '%Y%m%d') AS INTEGER) AS date_id, c.customer_id, s.status_id,
             total AS total_amount, CAST(CAST(total AS DECIMAL(23,4)) * currency_value AS DECIMAL(15,4)) AS total_amount_uah, currency_code,
             currency_value, shipping_city, shipping_method, payment_method, date_added, date_modified
      FROM web_orders o
      LEFT JOIN dim_customer c ON c.source_customer_id = o.customer_id
      LEFT JOIN statuses s ON s.source_id = o.order_status_id AND s.source_channel = 'website'""",
    "mkt_facts": f"""
      SELECT {MKT} + marketplace_order_id AS order_id, marketplace_order_id AS source_order_id, 2 AS channel_id,
             CAST(strftime(created, '%Y%m%d') AS INTEGER) AS date_id, CAST(NULL AS BIGINT) AS customer_id, s.status_id,
             CAST(cost_with_discount AS DECIMAL(15,4)) AS total_amount,
             CAST(cost_with_discount AS DECIMAL(15,4)) AS total_amount_uah, 'UAH' AS currency_code,
             CAST(1 AS DECIMAL(15,8)) AS currency_value, delivery_city AS shipping_city,
             CAST(NULL AS VARCHAR) AS shipping_method, CAST(NULL AS VARCHAR) AS payment_method,
             created AS date_added, changed AS date_modified
      FROM mkt_orders o LEFT JOIN statuses s ON s.source_id = o.status AND s.source_channel = 'marketplace'""",
    "fact_orders": "SELECT * FROM web_facts UNION ALL SELECT * FROM mkt_facts",
    "web_line_facts": f"""
      SELECT {WEB} + order_product_id AS line_id, order_product_id AS source_line_id, f.order_id, p.product_id,
             p.category_id, 1 AS channel_id, f.date_id, quantity AS quantity_sold, l.price AS unit_price,
             l.total AS line_total, CAST(CAST(l.total AS DECIMAL(23,4)) * f.currency_value AS DECIMAL(15,4)) AS line_total_uah, l.tax
      FROM web_lines l JOIN web_facts f ON f.source_order_id = l.order_id
      LEFT JOIN dim_product p ON p.source_product_id = l.product_id""",
    "titles": """
      SELECT lower(trim(title)) AS title_key, min(product_id) AS product_id
      FROM dim_product GROUP BY 1""",
    "mkt_line_facts": f"""
      SELECT {MKT} + purchase_id AS line_id, purchase_id AS source_line_id, f.order_id, t.product_id, p.category_id,
             2 AS channel_id, f.date_id, quantity AS quantity_sold, CAST(l.price AS DECIMAL(15,4)) AS unit_price,
             CAST(cost_with_discount AS DECIMAL(15,4)) AS line_total,
             CAST(cost_with_discount AS DECIMAL(15,4)) AS line_total_uah, CAST(0 AS DECIMAL(15,4)) AS tax
      FROM mkt_lines l JOIN mkt_facts f ON f.source_order_id = l.marketplace_order_id
      LEFT JOIN titles t ON t.title_key = lower(trim(l.item_name))
      LEFT JOIN dim_product p ON p.product_id = t.product_id""",
    "landed_facts": """
      SELECT * FROM web_facts
      UNION ALL SELECT * FROM mkt_facts
      WHERE source_order_id IN (SELECT marketplace_order_id FROM mkt_orders WHERE length(ttn) <= 64)""",
    "late_orders": """
      SELECT *, date_id NOT BETWEEN 19960101 AND 20001231 AS late FROM fact_orders""",
    "late_lines": """
      SELECT l.*, late FROM fact_order_lines l JOIN late_orders o USING (order_id)""",
    "fact_order_lines": "SELECT * FROM web_line_facts UNION ALL SELECT * FROM mkt_line_facts",
    "done": "SELECT status_id FROM statuses WHERE status_group = 2",
    "completed_orders": "SELECT * FROM fact_orders WHERE status_id IN (SELECT status_id FROM done)",
    "sync_log": """
      SELECT event_id AS sync_id, CASE WHEN user_id % 2 = 0 THEN 'website' ELSE 'marketplace' END AS channel,
             'scheduled' AS sync_type, ts AS started_at, ts + INTERVAL 5 MINUTE AS completed_at,
             CAST(floor(value) AS BIGINT) AS records_ingested, CAST(0 AS BIGINT) AS records_failed,
             CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
             CASE WHEN event_type = 'error' THEN props END AS error_detail
      FROM events""",
    "alert_events": f"""
      SELECT event_id, CAST(1 + event_id % 2 AS INTEGER) AS rule_id, {WEB} + event_id % 200 AS product_id,
             ts AS triggered_at, TRUE AS email_sent
      FROM events""",
    "stock_pairs": """
      SELECT r.rule_id, p.product_id, title, author, quantity_in_stock, threshold, cooldown_hours, notify_email
      FROM dim_product p JOIN rules r ON r.rule_type = 'low_stock' AND r.is_active AND quantity_in_stock <= threshold
      WHERE p.status = 'active'""",
    "stock_alerts": f"""
      SELECT s.* FROM stock_pairs s
      LEFT JOIN (SELECT rule_id, product_id, max(triggered_at) AS last FROM alert_events GROUP BY ALL) e
        USING (rule_id, product_id)
      WHERE last IS NULL OR last + to_hours(cooldown_hours) <= {COOLDOWN_AT}""",
    "months": """
      SELECT date_trunc('month', date_added) AS month, channel_id, sum(total_amount_uah) AS revenue
      FROM fact_orders GROUP BY ALL""",
    "ranked_months": """
      SELECT rule_id, threshold, notify_email, month, sum(revenue) AS revenue,
             row_number() OVER (PARTITION BY rule_id ORDER BY month DESC) AS rn
      FROM rules r JOIN months m ON r.channel_id IS NULL OR r.channel_id = m.channel_id
      WHERE rule_type = 'revenue_spike' AND is_active
      GROUP BY rule_id, threshold, notify_email, month""",
    "swings": """
      SELECT rule_id, notify_email, current_rev, prior_rev,
             abs((current_rev - prior_rev) / prior_rev) * 100 AS pct_change,
             CASE WHEN current_rev > prior_rev THEN 'increase' ELSE 'decrease' END AS direction
      FROM (SELECT rule_id, threshold, notify_email, CAST(max(revenue) FILTER (rn = 1) AS DOUBLE) AS current_rev,
                   CAST(max(revenue) FILTER (rn = 2) AS DOUBLE) AS prior_rev
            FROM ranked_months GROUP BY ALL)
      WHERE prior_rev <> 0 AND abs((current_rev - prior_rev) / prior_rev) * 100 >= threshold""",
    "silent": """
      SELECT rule_id, notify_email, hours
      FROM (SELECT rule_id, any_value(notify_email) AS notify_email, CAST(any_value(threshold) AS INTEGER) AS hours,
                   count(*) FILTER (f.date_added >= TIMESTAMP '2001-08-02 12:00:00' - to_hours(r.threshold)) AS recent
            FROM rules r LEFT JOIN fact_orders f ON r.channel_id IS NULL OR r.channel_id = f.channel_id
            WHERE rule_type = 'no_orders' AND is_active GROUP BY rule_id)
      WHERE recent = 0""",
    # Keyed upserts: all versions, numbered by batch.
    "order_versions": f"""
      SELECT *, 0 AS batch FROM web_orders WHERE date_modified < {CUT}
      UNION ALL SELECT *, 1 FROM web_orders WHERE date_modified >= {CUT}
      UNION ALL SELECT * EXCLUDE (days, more, new_status)
                          REPLACE (CAST(total + more AS DECIMAL(15,4)) AS total, new_status AS order_status_id,
                                  CAST(2 AS DECIMAL(15,8)) AS currency_value, 'moved' AS shipping_city,
                                  date_modified + to_days(days) AS date_modified), 1
      FROM web_orders, (VALUES (2, 1, 5), (3, 2, 7)) c(days, more, new_status)
      WHERE date_modified < {CUT} AND order_status_id = 1 AND (days = 2 OR currency_code = 'USD')""",
    "mkt_order_versions": f"""
      SELECT *, 0 AS batch FROM mkt_orders WHERE changed < {CUT}
      UNION ALL SELECT *, 1 FROM mkt_orders WHERE changed >= {CUT}
      UNION ALL SELECT * REPLACE (changed + INTERVAL 2 DAY AS changed, 6 AS status, 2 AS status_group,
                                  CAST(cost_with_discount + 1 AS DECIMAL(12,2)) AS cost_with_discount,
                                  CAST(0 AS DECIMAL(12,2)) AS amount, 'moved' AS delivery_city), 1
      FROM mkt_orders WHERE changed < {CUT} AND status = 1""",
    "line_batches": f"""
      SELECT *, 0 AS batch FROM lineitem WHERE l_shipdate < {CUT}
      UNION ALL SELECT *, 1 FROM lineitem WHERE l_shipdate >= {CUT}
      UNION ALL SELECT * REPLACE (l_quantity + 1 AS l_quantity, 10.0 AS l_extendedprice, 0.5 AS l_tax), 1
      FROM lineitem WHERE l_shipdate < {CUT} AND l_returnflag = 'R'""",
    "line_versions": _web_line("line_batches"),
    "mkt_line_versions": _mkt_line("line_batches"),
    "product_versions": """
      SELECT product_id, author, quantity, price, status, date_modified, name, main_category_id,
             CASE WHEN quantity <= 40 THEN 0 ELSE 1 END AS batch
      FROM products
      UNION ALL
      SELECT product_id, 'changed', quantity + 1, CAST(price + 1 AS DECIMAL(15,4)), 0,
             date_modified + INTERVAL 1 DAY, upper(name), 1, 1
      FROM products WHERE quantity <= 40 AND status = 1""",
    "category_versions": """
      SELECT category_id, parent_id, status, sort_order, name, 0 AS batch FROM categories WHERE parent_id <> 3
      UNION ALL
      SELECT category_id, CASE WHEN parent_id = 0 THEN 0 ELSE parent_id % 5 + 1 END, 0, sort_order + 100, lower(name), 1
      FROM categories""",
}

UPSERTED = f"CASE WHEN batch = 0 THEN {RUN_AT} ELSE {SECOND_RUN_AT} END"


def _present(body: str, doubles: str = "", times: str = "", dates: str = "") -> str:
    """Decimals as doubles, times and dates as ISO text."""
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in doubles.split()]
    casts += [f"strftime({c}, '%Y-%m-%dT%H:%M:%S') AS {c}" for c in times.split()]
    casts += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()]
    replace = f" REPLACE ({', '.join(casts)})" if casts else ""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(BLOCKS[name])
                needed.append(name)

    visit(body)
    with_clause = "WITH " + ",\n".join(f"{name} AS ({BLOCKS[name]})" for name in needed) if needed else ""
    return f"{with_clause}\nSELECT *{replace} FROM ({body}) answer"


def _lines_sold(first: str, last: str, channel: str = "TRUE") -> str:
    return f"""fact_order_lines l JOIN completed_orders o ON o.order_id = l.order_id
               AND o.date_added BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}' AND {channel}"""


def _top_books(first: str, last: str, limit: int, channel: str = "TRUE") -> str:
    return f"""
      SELECT p.product_id, p.title, p.author, sum(l.quantity_sold) AS units_sold, sum(line_total_uah) AS revenue_uah
      FROM {_lines_sold(first, last, channel)} JOIN dim_product p ON p.product_id = l.product_id
      GROUP BY ALL ORDER BY units_sold DESC, p.product_id LIMIT {limit}"""


def _by_category(first: str, last: str, channel: str = "TRUE") -> str:
    return f"""
      SELECT c.name AS category_name, c.parent_name, sum(quantity_sold) AS units_sold,
             sum(line_total_uah) AS revenue_uah,
             round(100 * CAST(sum(line_total_uah) AS DOUBLE) / nullif(any_value(t.grand_total), 0), 2) AS pct_of_total
      FROM {_lines_sold(first, last, channel)}
      JOIN dim_category c ON c.category_id = l.category_id
      CROSS JOIN (SELECT CAST(sum(line_total_uah) AS DOUBLE) AS grand_total FROM {_lines_sold(first, last, channel)}) t
      GROUP BY c.name, c.parent_name"""


def _season(first: str, last: str, channel: str = "TRUE") -> str:
    return f"""
      SELECT d.year, d.month, d.month_name, d.season, coalesce(sum(total_amount_uah), 0) AS total_revenue_uah,
             count(o.order_id) AS order_count
      FROM dim_date d LEFT JOIN (SELECT * FROM completed_orders o WHERE {channel}) o ON o.date_id = d.date_id
      WHERE d.full_date BETWEEN DATE '{first}' AND DATE '{last}'
      GROUP BY d.year, d.month, d.month_name, d.season"""


def _revenue(first: str, last: str) -> str:
    return f"""
      SELECT d.year, d.month, d.month_name, c.channel_name, coalesce(sum(total_amount_uah), 0) AS total_revenue_uah,
             count(o.order_id) AS order_count
      FROM dim_date d CROSS JOIN channels c
      LEFT JOIN completed_orders o ON o.date_id = d.date_id AND o.channel_id = c.channel_id
      WHERE d.full_date BETWEEN DATE '{first}' AND DATE '{last}'
      GROUP BY d.year, d.month, d.month_name, c.channel_name"""


INVENTORY = """
      SELECT p.product_id, title, author, isbn, quantity_in_stock, price, stock_status, p.status,
             c.name AS category_name, c.parent_name AS age_group
      FROM dim_product p LEFT JOIN dim_category c ON c.category_id = p.category_id"""

WEEK = f"date_added >= {AS_OF} - INTERVAL 7 DAY"
WEEKLY = f"""
      SELECT c.channel_name, count(o.order_id) AS order_count, sum(total_amount_uah) AS revenue_uah,
             sum(quantity_sold) AS units_sold,
             CAST(sum(total_amount_uah) AS DOUBLE) / count(total_amount_uah) AS avg_order_value_uah
      FROM completed_orders o JOIN channels c ON c.channel_id = o.channel_id
      JOIN fact_order_lines l ON l.order_id = o.order_id
      WHERE {WEEK} GROUP BY c.channel_name"""
WEEKLY_ORDERS = f"""
      SELECT c.channel_name, count(o.order_id) AS order_count, sum(total_amount_uah) AS revenue_uah,
             sum(units) AS units_sold,
             CAST(sum(total_amount_uah) AS DOUBLE) / count(total_amount_uah) AS avg_order_value_uah
      FROM completed_orders o JOIN channels c ON c.channel_id = o.channel_id
      LEFT JOIN (SELECT order_id, sum(quantity_sold) AS units FROM fact_order_lines GROUP BY order_id) l
        ON l.order_id = o.order_id
      WHERE {WEEK} GROUP BY c.channel_name"""

MTD = f"""
      SELECT coalesce(sum(total_amount_uah), 0) AS total_revenue_mtd, count(*) AS orders_mtd
      FROM completed_orders WHERE date_trunc('month', date_added) = date_trunc('month', {AS_OF})"""
TOP_BOOK = f"""
      SELECT title AS top_book_title, sum(quantity_sold) AS top_book_units
      FROM fact_order_lines l JOIN dim_product p ON p.product_id = l.product_id
      WHERE l.date_id // 100 = CAST(strftime({AS_OF}, '%Y%m') AS INTEGER)
      GROUP BY title ORDER BY top_book_units DESC, title LIMIT 1"""
LOW_STOCK = "SELECT count(*) AS low_stock_count, count(DISTINCT product_id) AS low_stock_products FROM stock_pairs"
LAST_SYNC = """
      SELECT max(CASE WHEN channel = 'website' THEN completed_at END) AS last_sync_website,
             max(CASE WHEN channel = 'marketplace' THEN completed_at END) AS last_sync_marketplace
      FROM sync_log WHERE status = 'success'"""

FROM, TO, YEAR_END = "1995-01-01", "2001-07-31", "2001-12-31"

REPORT_BODIES = {
    "weekly_sales": WEEKLY,
    "monthly_revenue": _revenue(FROM, TO),
    "top_books": _top_books(FROM, TO, 50),
    "sales_by_category": _by_category(FROM, TO),
    "seasonal_trend": _season(FROM, TO),
    "inventory": INVENTORY + " WHERE p.status = 'active'",
}
DISPATCH = " UNION ALL ".join(
    f"SELECT '{name}' AS report_type, count(*) AS row_count FROM ({body})" for name, body in REPORT_BODIES.items()
)

LINE_MONEY = "SELECT l_linenumber, sum(amount) AS amount, count(*) FILTER (amount IS NULL) AS missing, count(*) FILTER (amount = 0) AS zero"

FACT_ORDER_CASTS = dict(doubles="total_amount total_amount_uah currency_value", times="date_added date_modified")
FACT_LINE_CASTS = dict(doubles="unit_price line_total line_total_uah tax")
MKT_ORDER_CASTS = dict(doubles="amount amount_with_discount cost cost_with_discount", times="created changed")

ORACLES = {
    # Sources
    "src_orders_incremental": _present(
        "SELECT * FROM web_orders WHERE date_modified >= TIMESTAMP '2000-06-01'",
        "total currency_value",
        "date_added date_modified",
    ),
    "src_order_lines_semi": _present(
        "SELECT order_product_id, order_id, product_id, name, model, quantity, price, total, tax FROM web_line_rows "
        "WHERE order_id IN (SELECT order_id FROM web_orders WHERE date_modified >= TIMESTAMP '2000-06-01')",
        "price total tax",
    ),
    "src_products_enriched": _present(
        "SELECT * FROM products WHERE date_modified >= TIMESTAMP '2000-06-01'",
        "price",
        "date_added date_modified",
        "date_available",
    ),
    "src_categories_full": _present("SELECT *, CAST(NULL AS VARCHAR) AS description FROM categories"),
    "src_publishers_full": _present(
        "SELECT source_manufacturer_id AS manufacturer_id, name, description FROM dim_publisher"
    ),
    "src_customers_incremental": _present(
        "SELECT * FROM customers WHERE date_added >= TIMESTAMP '1997-01-01'", times="date_added"
    ),
    "src_marketplace_orders": _present(
        "SELECT * FROM mkt_orders WHERE created >= TIMESTAMP '1996-01-01' AND created < TIMESTAMP '2001-01-01'",
        **MKT_ORDER_CASTS,
    ),
    "src_marketplace_lines": _present("SELECT * FROM mkt_lines", "price cost cost_with_discount"),
    "stream_marketplace_ingest": _present(
        f"""
      SELECT o.*, {RUN_AT} AS ingested_at, line_count, line_quantity, line_cost_with_discount
      FROM mkt_orders o LEFT JOIN (
        SELECT marketplace_order_id, count(*) AS line_count, sum(quantity) AS line_quantity,
               sum(cost_with_discount) AS line_cost_with_discount
        FROM mkt_lines GROUP BY marketplace_order_id) l USING (marketplace_order_id)
      WHERE length(ttn) <= 64""",
        MKT_ORDER_CASTS["doubles"] + " line_cost_with_discount",
        "created changed ingested_at",
    ),
    "cycle_incremental": _present(
        """
      SELECT channel_id, order_month, orders, revenue_uah, lines, matched, units, line_total_uah
      FROM (SELECT channel_id, date_id // 100 AS order_month, count(*) AS orders, sum(total_amount_uah) AS revenue_uah
            FROM landed_facts GROUP BY ALL)
      FULL JOIN (SELECT channel_id, date_id // 100 AS order_month, count(*) AS lines, count(product_id) AS matched,
                        sum(quantity_sold) AS units, sum(line_total_uah) AS line_total_uah
                 FROM fact_order_lines WHERE order_id IN (SELECT order_id FROM landed_facts) GROUP BY ALL)
      USING (channel_id, order_month)""",
        "revenue_uah line_total_uah",
    ),
    "src_marketplace_defaults": _present(
        "SELECT purchase_id, CASE WHEN purchase_id % 3 = 0 THEN 1 ELSE quantity END AS quantity FROM mkt_lines"
    ),
    "sync_watermark": _present(
        "SELECT c.channel, coalesce(max(completed_at), TIMESTAMP '2015-01-01') AS since "
        "FROM (VALUES ('website'), ('marketplace'), ('phone')) c(channel) "
        "LEFT JOIN sync_log s ON s.channel = c.channel AND s.status = 'success' GROUP BY c.channel",
        times="since",
    ),
    "dim_date": _present(
        _calendar(
            "(SELECT date_trunc('year', min(o_orderdate)) FROM orders)",
            "(SELECT date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM orders)",
        ),
        dates="full_date",
    ),
    "seed_order_status": _present(
        f"""
      SELECT DISTINCT {WEB} + order_status_id AS status_id, order_status_id AS source_id, 'website' AS source_channel,
             'Status ' || order_status_id AS name_en,
             CASE WHEN order_status_id = 5 THEN 2 WHEN order_status_id IN (7, 13, 16, 17) THEN 3 ELSE 1 END
               AS status_group FROM web_orders
      UNION ALL
      SELECT {MKT} + status, status, 'marketplace', 'Marketplace status ' || status, min(status_group)
      FROM mkt_orders GROUP BY status
      UNION ALL
      SELECT * FROM statuses s
      WHERE NOT EXISTS (SELECT 1 FROM web_orders WHERE s.source_channel = 'website' AND order_status_id = source_id)
        AND NOT EXISTS (SELECT 1 FROM mkt_orders WHERE s.source_channel = 'marketplace' AND status = source_id)"""
    ),
    "source_profile": _present(
        """
      SELECT 'orders' AS table_name, count(*) AS row_count, max(date_added) AS newest FROM web_orders
      UNION ALL SELECT 'order_products', count(*), NULL FROM lineitem
      UNION ALL SELECT 'products', count(*), NULL FROM part
      UNION ALL SELECT 'customers', count(*), NULL FROM customer
      UNION ALL SELECT 'categories', count(*), NULL FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)
      UNION ALL SELECT 'manufacturers', count(*), NULL FROM supplier
      UNION ALL SELECT 'product_descriptions', 2 * count(*), NULL FROM part
      UNION ALL SELECT 'product_to_category', count(*) + count(*) FILTER (p_partkey % 17 <> 0), NULL FROM part
      UNION ALL SELECT 'category_descriptions', 2 * count(*), NULL
                FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)
      UNION ALL SELECT 'manufacturer_descriptions', count(*), NULL FROM supplier
      UNION ALL SELECT 'customer_group_descriptions', count(DISTINCT length(c_mktsegment)), NULL FROM customer
      UNION ALL SELECT 'stock_statuses', NULL, NULL""",
        times="newest",
    ),
    # Coercion
    "coerce_website_money": _present(
        f"{LINE_MONEY} FROM (SELECT l_linenumber, abs(CAST(l_discount AS DECIMAL(4,2))) AS amount FROM lineitem) "
        "GROUP BY l_linenumber",
        "amount",
    ),
    "coerce_marketplace_money": _present(
        f"{LINE_MONEY} FROM (SELECT l_linenumber, nullif(abs(CAST(l_tax AS DECIMAL(12,2))), 0) AS amount FROM lineitem) "
        "GROUP BY l_linenumber",
        "amount",
    ),
    "raw_json_payload": _present(
        """
      SELECT order_id, '{"order_id":' || order_id || ',"customer_id":' || customer_id || ',"total":' || total
             || ',"order_status_id":' || order_status_id || ',"currency_code":"' || currency_code || '"}' AS payload
      FROM web_orders
      UNION ALL
      SELECT marketplace_order_id, '{"marketplace_order_id":' || marketplace_order_id || ',"cost_with_discount":'
             || cost_with_discount || ',"status":' || status || ',"delivery_city":"' || delivery_city || '"}'
      FROM mkt_orders"""
    ),
    "date_key_roundtrip": _present(
        "SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_id, CAST(o_orderdate AS DATE) AS day, "
        "count(*) AS orders FROM orders GROUP BY ALL",
        dates="day",
    ),
    "currency_convert": _present(
        "SELECT order_id, total, currency_value, CAST(CAST(total AS DECIMAL(23,4)) * currency_value AS DECIMAL(15,4)) AS total_uah FROM web_orders "
        "UNION ALL SELECT marketplace_order_id, cost_with_discount, 1, cost_with_discount FROM mkt_orders",
        "total currency_value total_uah",
    ),
    "report_sanitise": _present(
        "SELECT order_id, total, date_added, CAST(date_modified AS DATE) AS day, payment_method FROM web_orders "
        "UNION ALL SELECT marketplace_order_id, cost_with_discount, created, CAST(changed AS DATE), NULL FROM mkt_orders",
        "total",
        "date_added",
        "day",
    ),
    # Staging
    "upsert_orders": _present(
        _pick(
            f"(SELECT *, {UPSERTED} AS ingested_at FROM order_versions)",
            "order_id",
            ["customer_id", "shipping_city", "payment_method", "currency_code", "currency_value", "date_added"],
            ["total", "order_status_id", "date_modified", "ingested_at"],
            ["date_modified", "total"],
        ),
        "total currency_value",
        "date_added date_modified ingested_at",
    ),
    "upsert_order_lines": _present(
        _line_pick(
            f"(SELECT *, {UPSERTED} AS ingested_at, {_json(['order_product_id', *WEB_LINE_ORDER])} AS raw_json FROM line_versions)",
            "order_product_id",
            WEB_LINE_FROZEN,
            WEB_LINE_UPDATED,
            ["ingested_at", "raw_json"],
        ),
        "price total tax",
        "ingested_at",
    ),
    "upsert_products": _present(
        _pick(
            f"(SELECT *, {UPSERTED} AS ingested_at FROM product_versions)",
            "product_id",
            ["author", "main_category_id"],
            ["quantity", "price", "status", "date_modified", "name", "ingested_at"],
            ["date_modified"],
        ),
        "price",
        "date_modified ingested_at",
    ),
    "upsert_categories": _present(
        _pick(
            f"(SELECT *, {UPSERTED} AS ingested_at FROM category_versions)",
            "category_id",
            ["sort_order"],
            ["parent_id", "status", "name", "ingested_at"],
            ["parent_id"],
        ),
        times="ingested_at",
    ),
    "upsert_publishers": _present(
        f"""
      SELECT s_suppkey AS manufacturer_id, upper(s_name) AS name, CAST(NULL AS VARCHAR) AS description,
             {SECOND_RUN_AT} AS ingested_at FROM supplier""",
        times="ingested_at",
    ),
    "upsert_customers": _present(
        f"""
      SELECT customer_id, 99 AS customer_group_id, store_id,
             CASE WHEN customer_group_name = 'BUILDING' THEN NOT is_newsletter ELSE is_newsletter END AS is_newsletter,
             date_added, lower(customer_group_name) AS customer_group_name, {SECOND_RUN_AT} AS ingested_at
      FROM customers""",
        times="date_added ingested_at",
    ),
    "upsert_mkt_orders": _present(
        _pick(
            f"(SELECT *, {UPSERTED} AS ingested_at FROM mkt_order_versions)",
            "marketplace_order_id",
            ["market_id", "created", "amount", "amount_with_discount", "delivery_city", "delivery_service"],
            ["changed", "status", "status_group", "cost_with_discount", "ingested_at"],
            ["changed"],
        ),
        "amount amount_with_discount cost_with_discount",
        "created changed ingested_at",
    ),
    "upsert_mkt_lines": _present(
        _line_pick(
            f"(SELECT *, {UPSERTED} AS ingested_at, {_json(['marketplace_order_id', 'purchase_id', *MKT_LINE_ORDER[1:]])} AS raw_json FROM mkt_line_versions)",
            "purchase_id",
            MKT_LINE_FROZEN,
            MKT_LINE_UPDATED,
            ["ingested_at", "raw_json"],
        ),
        "price cost cost_with_discount",
        "ingested_at",
    ),
    "quarantine_counts": _present(
        "SELECT count(*) FILTER (length(ttn) <= 64) AS records_ingested, "
        "count(*) FILTER (length(ttn) > 64) AS records_failed FROM mkt_orders"
    ),
    "insert_if_absent": _present(
        "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer"
    ),
    "sync_log_append": _present(
        f"""
      SELECT CAST(1 AS BIGINT) AS sync_id, 'marketplace' AS channel, 'manual' AS sync_type, {AS_OF} AS started_at,
             {RUN_AT} AS completed_at, count(*) FILTER (length(ttn) <= 64) AS records_ingested,
             count(*) FILTER (length(ttn) > 64) AS records_failed, 'success' AS status,
             CAST(NULL AS VARCHAR) AS error_detail FROM mkt_orders""",
        times="started_at completed_at",
    ),
    # Dimensions and facts
    "dim_publisher": _present("SELECT * FROM dim_publisher"),
    "dim_category": _present("SELECT * FROM dim_category"),
    "dim_category_deep": _present(f"{DEEP_TREE} SELECT category_id AS source_category_id, name, parent_name, "
                                  "parent_id IS NULL AS is_age_group FROM tree"),
    "category_quarantine": _present(
        f"{DEEP_TREE} SELECT category_id, parent_id, 'no_root' AS violation FROM deep "
        "WHERE category_id NOT IN (SELECT category_id FROM tree)"
    ),
    "dim_product": _present(
        "SELECT * FROM dim_product", "price", "date_added last_updated", "date_available"
    ),
    "dim_customer": _present("SELECT * FROM dim_customer", dates="date_registered"),
    "dim_status_website": _present(
        f"""
      SELECT * FROM statuses WHERE source_channel = 'website' AND source_id <> 5
      UNION ALL SELECT DISTINCT {WEB} + 5, 5, 'website', 'Status 5', 2 FROM web_orders WHERE order_status_id = 5"""
    ),
    "dim_status_marketplace": _present(
        f"""
      SELECT * FROM statuses WHERE source_channel = 'marketplace' AND source_id <> 45
      UNION ALL SELECT DISTINCT {MKT} + 45, 45, 'marketplace', 'Marketplace status 45', 3
      FROM mkt_orders WHERE status = 45"""
    ),
    "fact_orders_website": _present("SELECT * FROM web_facts", **FACT_ORDER_CASTS),
    "fact_orders_marketplace": _present("SELECT * FROM mkt_facts", **FACT_ORDER_CASTS),
    "fact_orders_all": _present("SELECT * FROM fact_orders", **FACT_ORDER_CASTS),
    "fact_lines_website": _present("SELECT * FROM web_line_facts", **FACT_LINE_CASTS),
    "fact_lines_marketplace": _present("SELECT * FROM mkt_line_facts", **FACT_LINE_CASTS),
    "fact_quarantine": _present(
        """
      SELECT channel_id, source_order_id, date_id, 'date_unknown' AS violation
      FROM fact_orders WHERE date_id NOT BETWEEN 19960101 AND 20001231"""
    ),
    "quarantine_redrive": _present(
        """
      SELECT kind, violation, n AS first_run, 0 AS second_run, n AS resolved, n AS loaded FROM (
        SELECT CASE channel_id WHEN 1 THEN 'website_orders' ELSE 'marketplace_orders' END AS kind,
               'date_unknown' AS violation, count(*) AS n
        FROM late_orders WHERE late GROUP BY ALL
        UNION ALL
        SELECT CASE channel_id WHEN 1 THEN 'website_lines' ELSE 'marketplace_lines' END, 'order_missing', count(*)
        FROM late_lines WHERE late GROUP BY ALL)"""
    ),
    "transform_counts": _present(
        f"""
      SELECT run_at, position, step, inserted, CAST(0 AS BIGINT) AS updated, rejected FROM (
        SELECT 1 AS position, 'publishers' AS step, count(*) AS a, 0 AS b, 0 AS r FROM supplier
        UNION ALL SELECT 2, 'categories', count(*), 0, 0 FROM dim_category
        UNION ALL SELECT 3, 'products', count(*), 0, 0 FROM part
        UNION ALL SELECT 4, 'customers', count(*), 0, 0 FROM customer
        UNION ALL SELECT 5, 'order_statuses', count(DISTINCT status), 0, 0 FROM mkt_orders WHERE status = 45
        UNION ALL SELECT 5 + channel_id, CASE channel_id WHEN 1 THEN 'website_orders' ELSE 'marketplace_orders' END,
                         count(*) FILTER (NOT late), count(*) FILTER (late), count(*) FILTER (late)
                  FROM late_orders GROUP BY channel_id
        UNION ALL SELECT 7 + channel_id, CASE channel_id WHEN 1 THEN 'website_lines' ELSE 'marketplace_lines' END,
                         count(*) FILTER (NOT late), count(*) FILTER (late), count(*) FILTER (late)
                  FROM late_lines GROUP BY channel_id)
      CROSS JOIN LATERAL (VALUES ({RUN_AT}, a, r), ({SECOND_RUN_AT}, b, 0)) v(run_at, inserted, rejected)""",
        times="run_at",
    ),
    "seed_load": _present(
        f"""
      SELECT 'rule' AS seed, CAST(rule_id AS BIGINT) AS id, rule_name AS label FROM supplier_rules
      UNION ALL SELECT 'rule', (SELECT max(rule_id) FROM supplier_rules) + n, name
                FROM (VALUES {_values((n, name) for n, (_, name, _, _) in enumerate(DEFAULT_RULES, start=1))}) d(n, name)
      UNION ALL SELECT 'channel', channel_id, channel_name FROM channels
      UNION ALL SELECT 'status', status_id, name_en FROM statuses"""
    ),
    # Reports
    "kpi_summary": _present(
        f"""
      SELECT m.*, b.*, low_stock_count, s.*
      FROM ({MTD}) m CROSS JOIN ({LOW_STOCK}) l CROSS JOIN ({LAST_SYNC}) s LEFT JOIN ({TOP_BOOK}) b ON TRUE""",
        "total_revenue_mtd",
        "last_sync_website last_sync_marketplace",
    ),
    "kpi_mtd": _present(MTD, "total_revenue_mtd"),
    "kpi_top_book": _present(TOP_BOOK),
    "kpi_low_stock": _present(LOW_STOCK),
    "kpi_low_stock_supplier_rules": _present(
        """
      SELECT count(*) AS low_stock_count, count(DISTINCT product_id) AS low_stock_products
      FROM dim_product p JOIN supplier_rules r ON r.is_active AND quantity_in_stock <= threshold
      WHERE p.status = 'active'"""
    ),
    "kpi_last_sync": _present(LAST_SYNC, times="last_sync_website last_sync_marketplace"),
    "revenue_by_channel": _present(_revenue(FROM, YEAR_END), "total_revenue_uah"),
    "top_books": _present(_top_books(FROM, TO, 50), "revenue_uah"),
    "top_books_website": _present(_top_books("1999-01-01", TO, 10, "l.channel_id = 1"), "revenue_uah"),
    "sales_by_category": _present(_by_category(FROM, TO), "revenue_uah pct_of_total"),
    "sales_by_category_marketplace": _present(
        _by_category("1998-03-01", TO, "l.channel_id = 2"), "revenue_uah pct_of_total"
    ),
    "seasonal_trend": _present(_season(FROM, YEAR_END), "total_revenue_uah"),
    "seasonal_trend_website": _present(_season(FROM, TO, "channel_id = 1"), "total_revenue_uah"),
    "inventory_status": _present(INVENTORY, "price"),
    "inventory_status_filtered": _present(
        f"{INVENTORY} WHERE p.status = 'active' AND p.category_id = {WEB} + 105", "price"
    ),
    "weekly_sales": _present(WEEKLY, "revenue_uah"),
    "weekly_sales_order_grain": _present(WEEKLY_ORDERS, "revenue_uah"),
    "report_dispatch": _present(DISPATCH),
    "report_catalogue": _present(
        f"""
      SELECT report_type, 'parquet' AS format,
             '{{"from_date": "1995-01-01", "to_date": "2001-07-31", "channel_id": null, "category_id": null}}'
               AS parameters,
             {AS_OF} AS generated_at, 7 AS generated_by, CAST(NULL AS VARCHAR) AS schedule, row_count
      FROM ({DISPATCH})""",
        times="generated_at",
    ),
    "report_run": _present(f"SELECT report_type, row_count AS counted, row_count, 1 AS entries FROM ({DISPATCH})"),
    "audit_append": _present(
        f"""
      SELECT user_id, event_type AS action, props AS resource, CAST(NULL AS VARCHAR) AS ip_address,
             CAST(NULL AS VARCHAR) AS detail, ts AS created_at FROM events
      UNION ALL
      SELECT 7, 'generate_report', 'report:' || report_type, NULL,
             '{{"format": "parquet", "from": "1995-01-01", "to": "2001-07-31"}}', {AS_OF}
      FROM (VALUES {_values((name,) for name in REPORT_BODIES)}) r(report_type)""",
        times="created_at",
    ),
    "report_headers": _present(
        f"""
      SELECT category_name AS "Category Name", parent_name AS "Parent Name", units_sold AS "Units Sold",
             CAST(revenue_uah AS DOUBLE) AS "Revenue Uah" FROM ({_by_category(FROM, TO)})"""
    ),
    "report_page": _present(
        f"""
      SELECT CAST(product_id AS VARCHAR) AS "Product Id", coalesce(title, '') AS "Title", coalesce(author, '') AS "Author",
             coalesce(isbn, '') AS "Isbn",
             CASE WHEN quantity_in_stock <> 0 THEN CAST(quantity_in_stock AS VARCHAR) ELSE '' END AS "Quantity In Stock",
             CASE WHEN price <> 0 THEN CAST(price AS VARCHAR) ELSE '' END AS "Price",
             coalesce(stock_status, '') AS "Stock Status", coalesce(status, '') AS "Status",
             coalesce(category_name, '') AS "Category Name", coalesce(age_group, '') AS "Age Group" FROM ({INVENTORY})"""
    ),
    "dashboard_bundle": _present(
        f"""
      SELECT 'kpi' AS section, 'all' AS item, unnest(['total_revenue_mtd', 'orders_mtd', 'top_book_units',
               'low_stock_count']) AS measure,
             unnest([CAST(total_revenue_mtd AS DOUBLE), orders_mtd, top_book_units, low_stock_count]) AS value
      FROM ({MTD}) CROSS JOIN ({LOW_STOCK}) LEFT JOIN ({TOP_BOOK}) ON TRUE
      UNION ALL
      SELECT 'revenue_by_channel', (year * 100 + month) || ' ' || channel_name,
             unnest(['total_revenue_uah', 'order_count']),
             unnest([CAST(total_revenue_uah AS DOUBLE), order_count]) FROM ({_revenue(FROM, "2099-12-31")})
      UNION ALL
      SELECT 'top_books', CAST(product_id AS VARCHAR), unnest(['units_sold', 'revenue_uah']),
             unnest([CAST(units_sold AS DOUBLE), CAST(revenue_uah AS DOUBLE)])
      FROM ({_top_books("2001-01-01", "2099-12-31", 10)})
      UNION ALL
      SELECT 'sales_by_category', category_name, unnest(['units_sold', 'revenue_uah']),
             unnest([CAST(units_sold AS DOUBLE), CAST(revenue_uah AS DOUBLE)])
      FROM ({_by_category("2001-01-01", "2099-12-31")})"""
    ),
    # Alerts
    "alert_dispatch": _present(
        """
      SELECT r.rule_id, rule_type,
             CASE WHEN rule_type IN ('low_stock', 'revenue_spike', 'no_orders') THEN 'checked' ELSE 'unknown type' END
               AS outcome,
             count(f.rule_id) AS fired
      FROM rules r LEFT JOIN (SELECT rule_id FROM stock_alerts UNION ALL SELECT rule_id FROM swings
                              UNION ALL SELECT rule_id FROM silent) f ON f.rule_id = r.rule_id
      WHERE is_active GROUP BY r.rule_id, rule_type"""
    ),
    "alert_low_stock": _present(
        "SELECT rule_id, product_id, title, author, quantity_in_stock, threshold FROM stock_pairs", "threshold"
    ),
    "alert_cooldown": _present("SELECT rule_id, product_id, quantity_in_stock FROM stock_alerts"),
    "alert_revenue_swing": _present("SELECT * EXCLUDE (notify_email) FROM swings"),
    "alert_no_orders": _present("SELECT * FROM silent"),
    "alert_events_new": _present(
        f"""
      SELECT rule_id, product_id, {COOLDOWN_AT} AS triggered_at,
             '{{"quantity_in_stock":' || quantity_in_stock || '}}' AS detail, TRUE AS email_sent FROM stock_alerts
      UNION ALL
      SELECT rule_id, NULL, {COOLDOWN_AT},
             '{{"pct_change":' || CAST(pct_change AS DECIMAL(18,2)) || ',"direction":"' || direction || '"}}', TRUE
      FROM swings""",
        times="triggered_at",
    ),
    "alert_notifications": _present(
        f"""
      SELECT rule_id, coalesce(max(notify_email), 'alerts@example.org') AS recipient,
             'Stock running out: ' || count(*) || ' titles' AS subject,
             '{{"books":' || count(*) || '}}' AS fields, {COOLDOWN_AT} AS created_at
      FROM stock_alerts GROUP BY rule_id
      UNION ALL
      SELECT rule_id, coalesce(notify_email, 'alerts@example.org'),
             'Month revenue moved: ' || direction || ' of ' || CAST(pct_change AS DECIMAL(18,1)) || ' percent',
             '{{"current_rev":' || CAST(current_rev AS DECIMAL(18,0)) || ',"prior_rev":'
               || CAST(prior_rev AS DECIMAL(18,0)) || ',"pct_change":' || CAST(pct_change AS DECIMAL(18,1))
               || ',"direction":"' || direction || '"}}', {COOLDOWN_AT}
      FROM swings
      UNION ALL
      SELECT rule_id, coalesce(notify_email, 'alerts@example.org'),
             'Nothing ordered for ' || hours || ' hours', '{{"hours":' || hours || '}}',
             {COOLDOWN_AT}
      FROM silent""",
        times="created_at",
    ),
    "alert_run_twice": _present(
        f"""
      SELECT rule_id, {COOLDOWN_AT} AS triggered_at, count(*) AS events, count(*) AS ids FROM stock_alerts GROUP BY rule_id
      UNION ALL
      SELECT rule_id, unnest([{COOLDOWN_AT}, {COOLDOWN_AT} + INTERVAL 1 HOUR]), 1, 1 FROM swings
      UNION ALL
      SELECT s.rule_id, {COOLDOWN_AT} + INTERVAL 1 HOUR, count(*), count(*)
      FROM stock_pairs s
      JOIN (SELECT rule_id, product_id, max(triggered_at) AS last FROM alert_events GROUP BY ALL) e
        USING (rule_id, product_id)
      WHERE last + to_hours(cooldown_hours) > {COOLDOWN_AT}
        AND last + to_hours(cooldown_hours) <= {COOLDOWN_AT} + INTERVAL 1 HOUR
      GROUP BY s.rule_id""",
        times="triggered_at",
    ),
    "alert_books": _present(
        f"""
      SELECT s.rule_id, rule_name, s.product_id, title, author, quantity_in_stock, CAST(s.threshold AS DECIMAL(12,2)) AS threshold,
             {COOLDOWN_AT} AS created_at
      FROM stock_alerts s JOIN rules r ON r.rule_id = s.rule_id""",
        "threshold",
        "created_at",
    ),
    # History
    "sync_history": _present(
        "SELECT * FROM sync_log ORDER BY started_at DESC, sync_id DESC LIMIT 20", times="started_at completed_at"
    ),
    "alert_event_history": _present(
        """
      SELECT e.event_id, e.rule_id, r.rule_name, e.product_id, p.title AS product_title, e.triggered_at, e.email_sent
      FROM alert_events e JOIN rules r ON r.rule_id = e.rule_id LEFT JOIN dim_product p ON p.product_id = e.product_id
      ORDER BY e.triggered_at DESC, e.event_id DESC LIMIT 50""",
        times="triggered_at",
    ),
    "audit_history": _present(
        """
      SELECT event_id AS log_id, c_name AS username, event_type AS action, props AS resource,
             CAST(NULL AS VARCHAR) AS ip_address, ts AS created_at
      FROM events LEFT JOIN customer ON c_custkey = user_id ORDER BY ts DESC, event_id DESC LIMIT 200""",
        times="created_at",
    ),
    "report_history": _present(
        """
      SELECT event_id AS report_id, event_type AS report_type, 'xlsx' AS format, props AS parameters,
             ts AS generated_at, CAST(user_id AS INTEGER) AS generated_by
      FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""",
        times="generated_at",
    ),
    "alert_rule_list": _present("SELECT * FROM supplier_rules", "threshold", "created_at"),
    "channel_list": _present(
        "SELECT channel_id, channel_name FROM channels WHERE channel_id IN (SELECT channel_id FROM fact_orders)"
    ),
}
