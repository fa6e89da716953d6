"""The fixture derivation of ``fixtures.Domain`` written as DuckDB CTEs.

Used only by ``oracle_sql()``: each oracle query is ``WITH <these CTEs>,
<query CTEs> SELECT ...`` over the driver's pre-registered views.  Domain
tables carry a ``d_`` prefix so they never shadow the driver's views
(``orders`` exists on both sides).
"""

from __future__ import annotations

from .fixtures import AS_OF_TPC, GAP_MICROS, PARTNER_IDS, PARTNER_KINDS, PARTNER_SIZES, PLAN_CYCLE, PLAN_NAMES


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in values) + "]"


def _partner_id(col: str) -> str:
    return f"CAST(CASE WHEN {col} < {len(PARTNER_IDS)} THEN {_list(PARTNER_IDS)}[{col} + 1] ELSE {col} + 500 END AS INTEGER)"


_PLAN_NAME = "CASE " + " ".join(f"WHEN id = {k} THEN '{v}'" for k, v in PLAN_NAMES.items()) + \
    " ELSE 'PLAN_' || CAST(id AS VARCHAR) END"

_CTES = {
    "d_orders": f"""
SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(18,2)) AS preco,
  o_orderkey % 2000 AS produto_id,
  CAST({_list(PLAN_CYCLE)}[o_orderkey % 9 + 1] AS INTEGER) AS plan_id,
  o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) AS created_at,
  CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) END AS subscribed_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT))
       + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS canceled_at,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 7 AS INTEGER) END AS cancellation_reason_id,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS direct_channel,
  o_orderkey % 4 = 0 AS skip_auto_renewal,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 END AS order_parent_id,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 10 AS DECIMAL(18,2)) AS old_price,
  o_orderkey % 7 = 0 AS disable_service_request_fee,
  o_orderpriority AS source,
  ['verified', 'pending', NULL][o_orderkey % 3 + 1] AS app_verification_status,
  o_orderkey % 3 = 0 AS canceled,
  lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS user_cpf,
  o_orderkey % 10 <> 0 AS payment_confirmed,
  CAST(CAST(o_custkey AS DECIMAL(18,2)) + 0.99 AS DECIMAL(18,2)) AS device_price
FROM orders""",
    "d_lines": f"""
SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS id,
  l_orderkey AS order_id,
  CAST(CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN -CAST(l_extendedprice AS DECIMAL(18,2))
       ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS value,
  CASE WHEN l_suppkey % 50 = 0 THEN date_trunc('month', l_shipdate) + to_microseconds(CAST({GAP_MICROS} AS BIGINT))
       ELSE l_shipdate + to_seconds(CAST((l_partkey * 7919 + l_suppkey * 104729) % 86400 AS BIGINT)) END AS created_at,
  CASE WHEN l_partkey % 211 = 0 THEN NULL
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'subscription'
       WHEN l_returnflag = 'N' THEN 'overdue_monthly_fee'
       WHEN l_returnflag = 'A' THEN 'monthly_fee'
       WHEN l_linestatus = 'F' THEN 'repair_fee'
       ELSE 'overdue_repair_fee' END AS reason,
  CASE WHEN l_linenumber <> 5 THEN l_linenumber END AS installments,
  CASE WHEN l_suppkey % 7 = 0 THEN 'boleto-' ELSE 'psp-' END
    || CAST(((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS VARCHAR) AS psp_reference,
  l_partkey AS _pk, l_suppkey AS _sk, l_linenumber AS _ln, l_returnflag AS _flag,
  l_quantity AS _qty, l_extendedprice AS _price
FROM lineitem""",
    "d_payments": "SELECT id, order_id, created_at, reason, value, psp_reference, installments FROM d_lines",
    "d_trackings": """
SELECT psp_reference, CASE WHEN _sk % 6 = 0 THEN 'boletobancario_santander' ELSE 'card' END AS payment_method
FROM d_lines WHERE _sk % 2 = 0""",
    "d_sr_lines": "SELECT * FROM d_lines WHERE _flag = 'R'",
    "d_sr_full": """
SELECT id, order_id, CASE WHEN _ln % 5 <> 0 THEN _ln % 5 END AS issue_id, created_at AS arrived_at,
  CASE WHEN _pk % 4 <> 0 THEN created_at + to_days(CAST(_pk % 45 AS INTEGER)) END AS swapped_at,
  CASE WHEN _pk % 4 <> 0 THEN created_at + to_days(CAST(_pk % 45 AS INTEGER)) END + to_days(2) AS closed_at,
  created_at + to_days(1) AS tracked_at, psp_reference AS payment_reference,
  _ln AS user_service_requests_count, CAST(_pk % 3 AS INTEGER) AS order_service_requests_count, _pk
FROM d_sr_lines
UNION ALL
SELECT -id, order_id, CASE WHEN (_ln + 1) % 5 <> 0 THEN (_ln + 1) % 5 END,
  created_at,
  CASE WHEN _pk % 4 <> 0 THEN created_at + to_days(CAST(_pk % 45 AS INTEGER)) END + to_days(1),
  CASE WHEN _pk % 4 <> 0 THEN created_at + to_days(CAST(_pk % 45 AS INTEGER)) END + to_days(1) + to_days(2),
  created_at + to_days(1), psp_reference, _ln, CAST(_pk % 3 AS INTEGER), _pk
FROM d_sr_lines WHERE _pk % 17 = 0""",
    "d_service_requests": """
SELECT id, order_id, issue_id, arrived_at, swapped_at, closed_at, tracked_at, payment_reference,
  user_service_requests_count, order_service_requests_count FROM d_sr_full""",
    "d_repairs": """
SELECT id AS service_request_id, CASE WHEN _sk % 2 = 0 THEN 28 ELSE 5 END AS repair_shop_id
FROM d_sr_lines WHERE id % 3 = 0
UNION ALL
SELECT id, CASE WHEN _sk % 2 = 0 THEN 28 ELSE 5 END FROM d_sr_lines WHERE id % 3 = 0 AND _pk % 13 = 0""",
    "d_costs": """
SELECT id AS service_request_id,
  CASE WHEN _pk % 23 <> 0 THEN CAST(_qty * 10 AS DECIMAL(18,2)) END AS repair_cost,
  CAST(_price AS DECIMAL(18,2)) AS invoice_in_value,
  CAST(CAST(_price AS DECIMAL(18,2)) - 50 AS DECIMAL(18,2)) AS invoice_out_value
FROM d_sr_lines WHERE _pk % 5 <> 0
UNION ALL
SELECT id, CAST(5 AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))
FROM d_sr_lines WHERE _pk % 19 = 0""",
    "d_postings": """
SELECT id AS service_request_id,
  CASE WHEN _pk % 7 <> 0 THEN CAST(CAST(_ln AS DECIMAL(18,2)) + 20 AS DECIMAL(18,2)) END AS from_customer_value,
  CAST(CAST(_ln AS DECIMAL(18,2)) + 25 AS DECIMAL(18,2)) AS from_house_value
FROM d_sr_lines WHERE _pk % 6 <> 0""",
    "d_device_swaps": """
SELECT id, id AS service_request_id, swapped_at AS created_at, _pk * 2 AS old_device_id, _pk * 2 + 1 AS new_device_id
FROM d_sr_full WHERE swapped_at IS NOT NULL""",
    "d_devices": """
SELECT p_partkey * 2 AS id, p_partkey AS product_id FROM part
UNION ALL SELECT p_partkey * 2 + 1, p_partkey + 1 FROM part""",
    "d_store_orders": """
SELECT o_orderkey * 10 + 1 AS id, o_orderkey AS order_id, CAST(o_orderkey % 12 + 1 AS INTEGER) AS installments,
  CAST(CAST(o_custkey AS DECIMAL(18,2)) + 99.90 AS DECIMAL(18,2)) AS total_price,
  ['credit_card', 'boleto', 'debit'][o_orderkey % 3 + 1] AS payment_method,
  'S' || CAST(o_custkey % 50 AS VARCHAR) AS seller_identifier, o_custkey % 120 AS store_id,
  o_custkey % 50 AS seller_id, CASE WHEN o_orderkey % 2 = 0 THEN 'monthly' ELSE 'annual' END AS plan_type,
  CAST(o_totalprice AS DECIMAL(18,2)) AS device_value_paid,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 100 AS DECIMAL(18,2)) AS device_value_without_discount,
  o_orderpriority AS bought_type, 'P' || CAST(o_orderkey % 5 AS VARCHAR) AS price_label,
  CAST(o_orderkey % 4 AS INTEGER) AS sales_kind_id, lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS imei,
  'INV-' || CAST(o_orderkey AS VARCHAR) AS invoice_number
FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL
SELECT o_orderkey * 10 + 2, o_orderkey, CAST(o_orderkey % 12 + 1 AS INTEGER),
  CAST(CAST(o_custkey AS DECIMAL(18,2)) + 99.90 AS DECIMAL(18,2)),
  ['credit_card', 'boleto', 'debit'][o_orderkey % 3 + 1],
  'S' || CAST(o_custkey % 50 AS VARCHAR), o_custkey % 120 + 1,
  o_custkey % 50, CASE WHEN o_orderkey % 2 = 0 THEN 'monthly' ELSE 'annual' END,
  CAST(o_totalprice AS DECIMAL(18,2)), CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 100 AS DECIMAL(18,2)),
  o_orderpriority, 'P' || CAST(o_orderkey % 5 AS VARCHAR), CAST(o_orderkey % 4 AS INTEGER),
  lpad(CAST(o_orderkey AS VARCHAR), 15, '0'), 'INV-' || CAST(o_orderkey AS VARCHAR)
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 53 = 0""",
    "d_stores": f"""
SELECT s_suppkey AS id, s_name AS name, {_partner_id('s_nationkey')} AS partner_id,
  CASE WHEN s_suppkey % 2 = 1 THEN 'Street ' || CAST(s_suppkey AS VARCHAR) END AS address,
  CASE WHEN s_suppkey % 2 = 1 THEN CAST(s_suppkey % 1000 AS VARCHAR) END AS number,
  CASE WHEN s_suppkey % 2 = 1 THEN 'Bairro ' || CAST(s_suppkey % 7 AS VARCHAR) END AS neighborhood,
  CASE WHEN s_suppkey % 2 = 1 THEN 'City ' || CAST(s_suppkey % 13 AS VARCHAR) END AS city,
  CASE WHEN s_suppkey % 2 = 1 THEN 'ST' || CAST(s_nationkey % 27 AS VARCHAR) END AS state,
  CASE WHEN s_suppkey % 2 = 1 THEN lpad(CAST(s_suppkey * 7 % 100000 AS VARCHAR), 8, '0') END AS zipcode,
  CASE WHEN s_suppkey % 2 = 1 THEN 'R' || CAST(s_nationkey % 5 AS VARCHAR) END AS region,
  s_suppkey % 9 AS regional_manager_id
FROM supplier""",
    "d_partners": f"""
SELECT {_partner_id('n_nationkey')} AS id, n_name AS name, CAST(n_nationkey % 6 AS INTEGER) AS account_manager_id,
  n_nationkey % 2 = 0 AS retail, n_regionkey AS partner_group_id,
  CAST(n_nationkey % 3 AS INTEGER) AS partner_size_id, CAST(n_nationkey % 4 AS INTEGER) AS partner_kind_id
FROM nation""",
    "d_partner_groups": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "d_partner_sizes": f"SELECT r_regionkey AS id, {_list(PARTNER_SIZES)}[r_regionkey + 1] AS size FROM region WHERE r_regionkey < {len(PARTNER_SIZES)}",
    "d_partner_kinds": f"SELECT r_regionkey AS id, {_list(PARTNER_KINDS)}[r_regionkey + 1] AS description FROM region WHERE r_regionkey < {len(PARTNER_KINDS)}",
    "d_revenue_shares": f"""
SELECT {_partner_id('n_nationkey')} AS partner_id, CAST(10.00 AS DECIMAL(5,2)) AS value,
  CAST(NULL AS TIMESTAMP) AS begin_at, TIMESTAMP '1997-12-31' AS finish_at FROM nation
UNION ALL
SELECT {_partner_id('n_nationkey')}, CAST(12.50 AS DECIMAL(5,2)), TIMESTAMP '1998-01-01', TIMESTAMP '1999-12-31' FROM nation
UNION ALL
SELECT {_partner_id('n_nationkey')}, CAST(15.00 AS DECIMAL(5,2)),
  CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '1999-07-01' ELSE TIMESTAMP '2000-01-01' END, CAST(NULL AS TIMESTAMP)
FROM nation""",
    "d_product_prices": """
SELECT p_partkey AS product_id, CAST(p_retailprice AS DECIMAL(18,2)) AS device_price,
  CAST(NULL AS TIMESTAMP) AS created_at, TIMESTAMP '1997-06-30' AS expired_at FROM part
UNION ALL
SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 10 AS DECIMAL(18,2)), TIMESTAMP '1997-07-01',
  CAST(NULL AS TIMESTAMP) FROM part""",
    "d_produtos": "SELECT p_partkey AS id, p_name AS modelo, CAST(substr(p_brand, 7, 10) AS INTEGER) AS marca_id FROM part",
    "d_marcas": "SELECT DISTINCT CAST(substr(p_brand, 7, 10) AS INTEGER) AS id, p_brand AS marca_nome FROM part",
    "d_plans": f"""
SELECT id, {_PLAN_NAME} AS name,
  CASE WHEN id IN (8, 10) THEN 12 ELSE 1 END AS number_of_months,
  CAST(id AS DOUBLE) / 100.0 AS price_factor,
  1.0 - CAST(id AS DOUBLE) / 200.0 AS partner_price_factor,
  CAST(id * 10 AS DECIMAL(8,2)) AS fixed_product_price,
  CAST(id % 7 AS DOUBLE) * 1.5 AS percentage_value,
  id % 2 = 0 AS use_price_table,
  CAST(10 AS DECIMAL(8,2)) AS min_value, CAST(1000 AS DECIMAL(8,2)) AS max_value
FROM (SELECT DISTINCT plan_id AS id FROM d_orders WHERE plan_id IS NOT NULL)""",
    "d_users": """
SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
  '55-' || CAST(c_custkey AS VARCHAR) AS phonenumber, 'Rua ' || CAST(c_nationkey AS VARCHAR) AS address_street,
  lpad(CAST(c_custkey % 100000 AS VARCHAR), 8, '0') AS address_zipcode,
  CAST(c_custkey % 1000 AS VARCHAR) AS address_number, c_mktsegment AS address_neighborhood,
  CASE WHEN c_custkey % 2 = 0 THEN 'apt ' || CAST(c_custkey % 50 AS VARCHAR) END AS address_complement,
  'City ' || CAST(c_nationkey AS VARCHAR) AS address_city, 'ST' || CAST(c_nationkey % 27 AS VARCHAR) AS address_state,
  c_custkey % 10 AS orders_count, c_custkey % 100 AS sign_in_count,
  '55-9' || CAST(c_custkey AS VARCHAR) AS cellphone_number
FROM customer""",
    "d_sellers": "SELECT c_custkey AS id, 'Seller ' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey < 50",
    "d_sales_kinds": "SELECT r_regionkey AS id, 'kind_' || CAST(r_regionkey AS VARCHAR) AS identifier, r_name AS description FROM region",
}

DOMAIN_CTES = ",\n".join(f"{name} AS ({body.strip()})" for name, body in _CTES.items())

# The fixed "now" of the TPC fixtures, as a DuckDB literal.
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TPC}'"


def with_domain(body: str) -> str:
    """Prefix a query with the domain CTEs.

    ``body`` is either a plain SELECT or starts with ``WITH`` — its own CTEs
    are appended after the domain ones.
    """
    text = body.strip()
    if text[:4].upper() == "WITH":
        return f"WITH {DOMAIN_CTES},\n{text[4:].lstrip()}"
    return f"WITH {DOMAIN_CTES}\n{text}"
