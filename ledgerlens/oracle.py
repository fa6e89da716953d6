"""DuckDB SQL for every registered query, written from the query contracts.

Nothing here is imported from ``plans/``: measures, zones and rates are stated again, so that a slip on one side shows
up as a difference.  Forms used throughout: events meet generated periods in a range join, families of measures are
rows that conditional aggregates turn into columns, rate cards are VALUES tables, and first / last rows come from
``arg_min`` / ``arg_max``.
"""

from __future__ import annotations

from .operators.spine import Spine
from .sources.fixtures_sql import with_domain

ZONE = "America/Sao_Paulo"
# Issue codes and their suffixes.
ISSUES = (("screen", 1), ("water", 2), ("slm", 3), ("theft", 4))


def loc(x: str) -> str:
    """Naive UTC -> naive local wall clock."""
    return f"timezone('{ZONE}', timezone('UTC', {x}))"


def periods(spine: Spine) -> str:
    """CTE ``periods`` (p_from, p_to): p_to is one second before the next period."""
    unit = "MONTH" if spine.monthly else "DAY"
    return (f"periods AS (SELECT p_from, p_from + INTERVAL {spine.step} {unit} - INTERVAL 1 SECOND AS p_to FROM generate_series("
            f"TIMESTAMP '{spine.start.isoformat()}', TIMESTAMP '{spine.as_of.date().isoformat()}', INTERVAL {spine.step} {unit}) AS g(p_from))")


DAYS = "CAST(p_from AS DATE) AS start_interval, CAST(p_to AS DATE) AS end_interval"


def now_of(spine: Spine) -> str:
    return f"TIMESTAMP '{spine.as_of.isoformat(sep=' ')}'"


def share_of_sum(x: str, num: int) -> str:
    """sum(x) / num, rounded half away from zero at ten decimals; x has six decimals at most."""
    total = f"sum(CAST(({x}) * 1000000 AS HUGEINT))"
    return (f"CAST(CAST(sign({total}) * ((abs({total}) * 20000 + {num}) // {2 * num}) AS DECIMAL(27,0)) "
            f"* CAST(0.0000000001 AS DECIMAL(11,10)) AS DOUBLE)")


def by_issue(template: str) -> str:
    """``template`` once per issue, with {k} its code and {n} its suffix."""
    return ",\n  ".join(template.format(k=k, n=n) for n, k in ISSUES)


def sr_monthly_count(spine: Spine) -> str:
    return with_domain(f"""
WITH {periods(spine)},
arrivals AS (SELECT order_id, issue_id, {loc('arrived_at')} AS seen FROM d_service_requests)
SELECT {DAYS}, order_id, count(*) AS count,
  {by_issue("count(*) FILTER (issue_id = {k}) AS arrived_count_{n}")}
FROM arrivals JOIN periods ON seen >= p_from AND seen < p_to
GROUP BY p_from, p_to, order_id""")


def severity(spine: Spine) -> str:
    families = (("repair_cost", "-repair_cost"), ("swap_cost", "invoice_in_value - invoice_out_value"),
                ("inbound_logistic_cost", "-ifnull(from_customer_value, 35)"),
                ("outbound_logistic_cost", "-ifnull(from_house_value, 35)"),
                ("severity_tax_credit", "(repair_cost + invoice_out_value - invoice_in_value) * 0.0925"))
    lines = ", ".join(f"('{f}', {e})" for f, e in families)
    columns = []
    for f, _ in families:
        columns.append(f"CAST(sum(amount) FILTER (family = '{f}') AS DOUBLE) AS {f}")
        columns += [f"CAST(sum(if(issue_id = {k}, amount, 0)) FILTER (family = '{f}') AS DOUBLE) AS {f}_{n}" for n, k in ISSUES]
    for name, test in (("swapped_sr", "true"), ("inhouse_sr", "in_house")):
        columns.append(f"count(*) FILTER (family = 'swap_cost' AND {test}) AS {name}")
        columns += [f"count(*) FILTER (family = 'swap_cost' AND {test} AND issue_id = {k}) AS {name}_{n}" for n, k in ISSUES]
    return with_domain(f"""
WITH {periods(spine)},
swaps AS (
  SELECT p_from, p_to, order_id, issue_id, id,
    id IN (SELECT service_request_id FROM d_repairs WHERE repair_shop_id = 28) AS in_house
  FROM (SELECT *, {loc('swapped_at')} AS seen FROM d_service_requests) AS r JOIN periods ON seen >= p_from AND seen < p_to),
lines AS (
  SELECT s.*, v.family, v.amount
  FROM swaps AS s
  LEFT JOIN d_postings AS post ON post.service_request_id = s.id
  LEFT JOIN d_costs AS cost ON cost.service_request_id = s.id,
  LATERAL (VALUES {lines}) AS v(family, amount))
SELECT {DAYS}, order_id, {", ".join(columns)}
FROM lines GROUP BY p_from, p_to, order_id""")


# Plans whose revenue stays with the house, insured plans, and the split of the latter by partner.
PLAN_KINDS = "plan_kinds(plan, kind) AS (VALUES (8, 'house'), (9, 'house'), (10, 'house'), (14, 'house'), (16, 'house'), (40, 'rfq'), (61, 'rfq'))"
RATE_CARD = """rate_card(card_partner, house_part, partner_part, insurer_part) AS (
  SELECT unnest([15, 27, 46, 77, 159, 163, 363]), 0.20, 0.35, 0.45
  UNION ALL SELECT unnest([164, 383, 395]), 0.15, 0.40, 0.45
  UNION ALL SELECT 177, 0.23, 0.35, 0.42)"""


def partner_sales(reasons: tuple[str, ...]) -> str:
    """CTEs up to ``split``: payments with order, partner and the three shares of their order's revenue."""
    wanted = ", ".join(f"'{r}'" for r in reasons)
    share = "DECIMAL(12,6)"
    return f"""{PLAN_KINDS}, {RATE_CARD},
order_partner AS (
  SELECT o.id AS o_id, so.total_price, pa.id AS partner_id, {loc('o.subscribed_at')} AS signed
  FROM d_orders AS o LEFT JOIN d_store_orders AS so ON so.order_id = o.id
  LEFT JOIN d_stores AS st ON st.id = so.store_id LEFT JOIN d_partners AS pa ON pa.id = st.partner_id),
order_share AS (
  SELECT op.*, rs.value AS pct FROM order_partner AS op
  LEFT JOIN d_revenue_shares AS rs ON rs.partner_id = op.partner_id
    AND (rs.begin_at IS NULL OR rs.begin_at <= op.signed)
    AND (rs.finish_at IS NULL OR op.signed < rs.finish_at + INTERVAL 86399 SECOND) AND op.signed IS NOT NULL),
split AS (
  SELECT pay.id, pay.order_id, pay.reason, pay.value AS paid, pay.created_at, o.plan_id, o.direct_channel, o.preco,
    o.subscribed_at, o.canceled_at, os.total_price, os.partner_id, os.signed, os.pct, k.kind,
    CASE WHEN k.kind = 'house' THEN 1 WHEN k.kind IS NULL AND o.plan_id IS NOT NULL THEN 1 - ifnull(os.pct, 0) * 0.01
         ELSE ifnull(c.house_part, 0) * 0.9262 END::{share} AS house_share,
    CASE WHEN k.kind = 'house' THEN 0 WHEN k.kind IS NULL AND o.plan_id IS NOT NULL THEN ifnull(os.pct, 0) * 0.01
         ELSE ifnull(c.partner_part, 0) * 0.9262 END::{share} AS partner_share,
    CASE WHEN k.kind = 'rfq' OR o.plan_id IS NULL THEN ifnull(c.insurer_part, 0) * 0.9262 ELSE 0 END::{share} AS insurer_share
  FROM d_payments AS pay LEFT JOIN d_orders AS o ON o.id = pay.order_id
  LEFT JOIN order_share AS os ON os.o_id = o.id
  LEFT JOIN plan_kinds AS k ON k.plan = o.plan_id
  LEFT JOIN rate_card AS c ON c.card_partner = os.partner_id
  WHERE pay.reason IN ({wanted}))"""


def withdrawn() -> str:
    days = "to_days(if(direct_channel, 15, 8))"
    return f"ifnull(canceled_at >= subscribed_at AND canceled_at < subscribed_at + {days}, false)"


def revenue(spine: Spine, kind: str) -> str:
    if kind == "sales":
        noun, reasons = "sale", ("subscription",)
        amount = "if(plan_id IN (8, 10), total_price, if(direct_channel, preco, total_price) * 12)"
    else:
        noun, reasons = "revenue", ("subscription", "monthly_fee", "overdue_monthly_fee")
        amount = "if(reason = 'subscription', ifnull(total_price, preco * 12), paid * 12)"
    base = {"plan": "plan_total", "rfq": "rfq_total"}
    taxed = {"plan": "- plan_total", "rfq": "- rfq_total"}
    columns = [f"{s}_share" for s in ("house", "partner", "insurer")] if kind == "sales" else []
    columns += [f"n AS {noun}_count", "n_plan AS plan_count", "n_rfq AS rfq_count", f"-n_withdrawn AS withdrawn_{noun}_count",
                f"total AS total_{noun}", f"plan_total AS plan_{noun}", f"rfq_total AS rfq_{noun}",
                f"rfq_total * 0.0738 AS iof_rfq_{noun}",
                f"{taxed['plan']} * 9.25 / 100.0 AS plan_{noun}_pis_cofins",
                f"{taxed['rfq']} * 0.9262 * 9.25 / 100.0 AS rfq_{noun}_pis_cofins",
                f"{taxed['rfq']} * 0.9262 * 5.0 / 100.0 AS rfq_{noun}_iss"]
    for line, owners in (("plan", ("house", "partner")), ("rfq", ("house", "partner", "insurer"))):
        for who in owners:
            columns += [f"{base[line]} * {who}_share AS {who}_{line}_{noun}",
                        f"{taxed[line]} * {who}_share * 9.25 / 100.0 AS {who}_{line}_{noun}_pis_cofins"]
            if line == "rfq":
                columns.append(f"{taxed[line]} * {who}_share * 5.0 / 100.0 AS {who}_{line}_{noun}_iss")
    mean = ", ".join(f"CAST(sum({s}_share) AS DOUBLE) / count({s}_share) AS {s}_share" for s in ("house", "partner", "insurer"))
    return with_domain(f"""
WITH {periods(spine)}, {partner_sales(reasons)},
booked AS (  -- fan-out rows that agree in everything are one
  SELECT DISTINCT p_from, p_to, id, order_id, plan_id, partner_id, house_share, partner_share, insurer_share,
    {withdrawn()} AS gone, CAST({amount} AS DECIMAL(22,2)) AS twelfths, kind
  FROM (SELECT *, {loc('created_at')} AS seen FROM split) AS s JOIN periods ON seen >= p_from AND seen < p_to),
totals AS (
  SELECT p_from, p_to, order_id, count(*) AS n,
    count(*) FILTER (kind IS DISTINCT FROM 'rfq' AND plan_id IS NOT NULL AND twelfths > 0) AS n_plan,
    count(*) FILTER (kind = 'rfq' AND twelfths > 0) AS n_rfq, count(*) FILTER (gone) AS n_withdrawn,
    {share_of_sum("twelfths", 12)} AS total,
    {share_of_sum("if(kind IS DISTINCT FROM 'rfq' AND plan_id IS NOT NULL, twelfths, 0)", 12)} AS plan_total,
    {share_of_sum("if(kind = 'rfq', twelfths, 0)", 12)} AS rfq_total, {mean}
  FROM booked GROUP BY p_from, p_to, order_id)
SELECT {DAYS}, order_id, {", ".join(columns)} FROM totals""")


def fee_revenue(spine: Spine) -> str:
    """Sums in 33rds: a phone's price is its store price / 0.33."""
    rated = "CASE WHEN insured AND value > 0 THEN total_price * 100 * {r} ELSE value * 33 END"
    own = "if(issue_id = 4, 0.70, 0.55)"
    tax = "CASE WHEN insured AND value > 0 THEN total_price * {r} * 12.25 ELSE value * 3.0525 END"
    billed = "CASE WHEN {test} insured AND value > 0 THEN total_price * 100 * {r} - value * 33 ELSE 0 END"
    measures = {"fee_rev": rated.format(r=own), "insurer_fee_cost": billed.format(test="", r=own),
                "q_insurer_fee_cost": billed.format(test="issue_id <> 4 AND", r="0.55"),
                "rf_insurer_fee_cost": billed.format(test="issue_id = 4 AND", r="0.70"), "fee_tax": tax.format(r=own)}
    for n, k in ISSUES:  # an unknown issue counts in every column
        r = "0.70" if k == 4 else "0.55"
        measures |= {f"fee_rev_{n}": f"if(issue_id <> {k}, 0, {rated.format(r=r)})", f"fee_tax_{n}": f"if(issue_id <> {k}, 0, {tax.format(r=r)})"}
    columns = [f"{'-' if m.startswith('fee_tax') else ''}{share_of_sum(x, 33)} AS {m}" for m, x in measures.items()]
    return with_domain(f"""
WITH {periods(spine)},
per_reference AS (
  SELECT payment_reference AS ref, {loc('min(swapped_at)')} AS seen, list(issue_id) AS issues
  FROM d_service_requests WHERE payment_reference IS NOT NULL GROUP BY ALL),
paid AS (
  SELECT p_from, p_to, pay.order_id, pay.value, unnest(r.issues) AS issue_id
  FROM d_payments AS pay JOIN per_reference AS r ON r.ref = pay.psp_reference JOIN periods ON r.seen >= p_from AND r.seen < p_to
  WHERE pay.reason = 'repair_fee'),
priced AS (
  SELECT paid.*, o.plan_id IN (40, 61) AS insured, so.total_price
  FROM paid LEFT JOIN d_orders AS o ON o.id = paid.order_id LEFT JOIN d_store_orders AS so ON so.order_id = o.id)
SELECT {DAYS}, order_id, {", ".join(columns)}
FROM priced GROUP BY p_from, p_to, order_id""")


# Card fee in percent up to a number of installments (0: none given or below 1 counts with 2 and 3).
def card_fee(value: str, installments: str) -> str:
    return (f"{value} * CASE WHEN {installments} = 1 THEN 0.0187 WHEN {installments} < 4 THEN 0.0221 "
            f"WHEN {installments} < 7 THEN 0.0232 ELSE 0.0255 END")


def fee_txn_cost() -> str:
    return with_domain(f"""
WITH charged AS (
  SELECT p.order_id, p.created_at, sr.issue_id,
    if(t.payment_method = 'boletobancario_santander', 2.90, {card_fee('p.value', 'p.installments')} + 0.27) AS charge
  FROM d_service_requests AS sr RIGHT JOIN d_payments AS p ON sr.payment_reference = p.psp_reference
  LEFT JOIN d_trackings AS t USING (psp_reference)
  WHERE regexp_matches(p.reason, 'repair.fee'))
SELECT order_id, CAST(date_trunc('month', {loc('created_at')}) AS DATE) AS creation_month,
  -CAST(sum(charge) AS DOUBLE) AS fee_transaction_cost,
  {by_issue("-CAST(sum(if(issue_id = {k}, charge, 0)) AS DOUBLE) AS fee_transaction_cost_{n}")}
FROM charged GROUP BY 1, 2""")


def plan_txn_cost() -> str:
    card = card_fee("value", "installments")
    return with_domain(f"""
WITH outside AS (
  SELECT st.id AS store FROM d_stores AS st JOIN d_partners AS pa ON pa.id = st.partner_id
  JOIN d_partner_kinds AS k ON k.id = pa.partner_kind_id WHERE k.description = 'Venda externa'),
charged AS (
  SELECT p.order_id, p.created_at, p.reason, p.value, p.installments, so.store_id IN (SELECT store FROM outside) AS outside,
    t.payment_method = 'boletobancario_santander' OR contains(p.psp_reference, 'boleto') AS slip
  FROM d_payments AS p LEFT JOIN d_store_orders AS so USING (order_id) LEFT JOIN d_trackings AS t USING (psp_reference)
  WHERE NOT regexp_matches(p.reason, 'repair.fee'))
SELECT order_id, CAST(date_trunc('month', {loc('created_at')}) AS DATE) AS creation_month,
  -{share_of_sum(f"CASE WHEN outside THEN 0 WHEN slip THEN 2.90 * 12 ELSE 0.27 * 12 + if(reason = 'subscription', {card}, {card} * 12) END", 12)} AS plan_transaction_cost
FROM charged GROUP BY 1, 2""")


def activity(spine: Spine, local: bool) -> str:
    """CTE ``activity`` (o_id, began, ended): from the first of subscription and arrival to the last sign of life."""
    zone = loc if local else (lambda x: x)
    return f"""touched AS (
  SELECT order_id, min(arrived_at) AS first_arrival, max(coalesce(closed_at, tracked_at, arrived_at)) AS last_touch
  FROM d_service_requests GROUP BY order_id),
activity AS (
  SELECT o.id AS o_id, {zone('least(o.subscribed_at, t.first_arrival)')} AS began,
    {zone(f'greatest(ifnull(o.canceled_at, {now_of(spine)}), t.last_touch)')} AS ended
  FROM d_orders AS o LEFT JOIN touched AS t ON t.order_id = o.id)"""


def active_device_product(spine: Spine) -> str:
    return with_domain(f"""
WITH {periods(spine)}, {activity(spine, True)},
device_product AS (SELECT d.id AS device, p.id AS product FROM d_devices AS d LEFT JOIN d_produtos AS p ON p.id = d.product_id),
swap AS (
  SELECT sr.order_id, s.id, {{'at': {loc('s.created_at')}, 'out': a.product, 'in': b.product}} AS what
  FROM d_device_swaps AS s JOIN d_service_requests AS sr ON sr.id = s.service_request_id
  LEFT JOIN device_product AS a ON a.device = s.old_device_id LEFT JOIN device_product AS b ON b.device = s.new_device_id),
swaps AS (
  SELECT order_id, min(what.at) AS first_at, arg_min(what, id) AS lowest, arg_max(what, id) AS highest FROM swap GROUP BY order_id),
held AS (
  SELECT p_from, p_to, act.o_id, o.produto_id, if(s.first_at < p_from, s.highest, s.lowest) AS swap
  FROM activity AS act JOIN periods ON act.began <= p_to AND act.ended >= p_from
  JOIN d_orders AS o ON o.id = act.o_id LEFT JOIN swaps AS s ON s.order_id = act.o_id)
SELECT {DAYS}, o_id,
  CASE sign(epoch_us(swap.at) - epoch_us(p_from)) WHEN 1 THEN swap.out WHEN -1 THEN swap.in ELSE produto_id END AS product_id
FROM held""")


def valid_price() -> str:
    """Price valid at an order's local subscription; ends count as whole days less a second."""
    return """pp.product_id = o.produto_id AND o.signed IS NOT NULL AND (pp.created_at IS NULL OR pp.created_at <= o.signed)
  AND (pp.expired_at IS NULL OR o.signed < pp.expired_at + INTERVAL 86399 SECOND)"""


def dims() -> dict[str, str]:
    blank = ", ".join(f"ifnull({c}, '') AS {c}" for c in ("address", "number", "neighborhood", "city", "state", "zipcode", "region"))
    return {
        "dim_products": with_domain("SELECT id, modelo, marca_id FROM d_produtos"),
        "dim_brands": with_domain("SELECT id, marca_nome FROM d_marcas"),
        "dim_plans": with_domain("SELECT id, name, number_of_months, price_factor, partner_price_factor, "
                                 "fixed_product_price, percentage_value, use_price_table, min_value, max_value FROM d_plans"),
        "dim_stores": with_domain(f"SELECT id, name, partner_id, {blank}, regional_manager_id FROM d_stores"),
        "dim_partners": with_domain("""
SELECT id, name, account_manager_id, retail,
  (SELECT any_value(size) FROM d_partner_sizes AS s WHERE s.id = p.partner_size_id) AS size,
  (SELECT any_value(name) FROM d_partner_groups AS g WHERE g.id = p.partner_group_id) AS group_name
FROM d_partners AS p"""),
        "extract_store_orders": with_domain("""
SELECT so.id, order_id, installments, total_price, payment_method, seller_identifier, store_id, seller_id,
  (SELECT any_value(name) FROM d_sellers AS s WHERE s.id = so.seller_id) AS name, plan_type, device_value_paid,
  device_value_without_discount, bought_type, price_label, sales_kind_id,
  (SELECT any_value(description) FROM d_sales_kinds AS k WHERE k.id = so.sales_kind_id) AS description
FROM d_store_orders AS so"""),
        "extract_orders_priced": with_domain(f"""
WITH o AS (SELECT *, {loc('subscribed_at')} AS signed FROM d_orders)
SELECT o.id, {loc('o.created_at')} AS created_at, user_id, preco, produto_id, {loc('o.canceled_at')} AS canceled_at, plan_id,
  signed AS subscribed_at, cancellation_reason_id, direct_channel, skip_auto_renewal, order_parent_id, old_price,
  disable_service_request_fee, pp.device_price, source, app_verification_status
FROM o LEFT JOIN d_product_prices AS pp ON {valid_price()}"""),
        "lookup_payment_360": with_domain("""
WITH customer_order AS (
  SELECT o.id AS o_id, o.source, o.canceled, o.user_id, o.user_cpf, o.plan_id, u.name AS user_name, u.email, u.phonenumber,
    u.address_street, u.address_zipcode, u.address_number, u.address_neighborhood, u.address_complement, u.address_city,
    u.address_state, u.orders_count, u.sign_in_count, u.cellphone_number, pl.name AS plan_name, device.modelo, device.marca_nome
  FROM d_users AS u RIGHT JOIN d_orders AS o ON u.id = o.user_id
  LEFT JOIN d_plans AS pl ON pl.id = o.plan_id
  LEFT JOIN (SELECT pr.id, pr.modelo, b.marca_nome FROM d_produtos AS pr LEFT JOIN d_marcas AS b ON b.id = pr.marca_id) AS device
    ON device.id = o.produto_id),
store_sale AS (
  SELECT so.order_id AS so_order, so.seller_identifier, so.seller_id, so.imei, so.plan_type, so.bought_type, so.sales_kind_id,
    so.invoice_number, st.state, st.city, se.name AS seller_name, k.identifier
  FROM d_store_orders AS so LEFT JOIN d_stores AS st ON st.id = so.store_id LEFT JOIN d_sellers AS se ON se.id = so.seller_id
  LEFT JOIN d_sales_kinds AS k ON k.id = so.sales_kind_id),
request AS (SELECT order_id AS sr_order, user_service_requests_count, order_service_requests_count FROM d_service_requests)
SELECT pay.order_id, pay.installments, c.* EXCLUDE (o_id), s.* EXCLUDE (so_order), r.* EXCLUDE (sr_order)
FROM d_payments AS pay
LEFT JOIN customer_order AS c ON c.o_id = pay.order_id
LEFT JOIN store_sale AS s ON s.so_order = c.o_id
LEFT JOIN request AS r ON r.sr_order = c.o_id"""),
        "scan_preview": with_domain("SELECT * FROM d_orders ORDER BY id LIMIT 10"),
    }


def spine_counts(spine: Spine, facts_sql: str) -> str:
    return with_domain(f"""
WITH {periods(spine)}, facts AS ({facts_sql})
SELECT p_from AS start_interval, p_to AS end_interval,
  (SELECT count(*) FROM facts WHERE ts >= p_from AND ts < p_to) AS n_items
FROM periods""")


def micro(months: Spine) -> dict[str, str]:
    sold = f"WITH {partner_sales(('subscription',))}"
    pivot = by_issue("count(*) FILTER (issue_id = {k}) AS n_{n}")
    return {
        "op_plan_class": with_domain("""
SELECT id, plan_id, list_contains([8, 9, 10, 14, 16], plan_id) AS is_house_only, list_contains([40, 61], plan_id) AS is_rfq,
  NOT list_contains([40, 61], plan_id) AS is_not_rfq FROM d_orders"""),
        "op_reason_like": with_domain("""
SELECT reason, count(*) AS n_payments, count(*) FILTER (contains(psp_reference, 'boleto')) AS n_boleto_refs,
  regexp_matches(reason, 'repair.fee') AS is_repair_like, NOT regexp_matches(reason, 'repair.fee') AS is_not_repair_like
FROM d_payments GROUP BY reason"""),
        "op_to_local_time": with_domain(f"SELECT id, created_at, {loc('created_at')} AS created_local FROM d_payments"),
        "op_withdrawal_flag": with_domain(f"SELECT id, direct_channel, {withdrawn()} AS withdrawn FROM d_orders"),
        "op_event_month": with_domain(f"""
SELECT id, CAST(date_trunc('month', {loc('created_at')}) AS DATE) AS creation_month,
  CAST(date_trunc('month', created_at) AS DATE) AS creation_month_utc FROM d_payments"""),
        "op_validity_join_share": with_domain(f"""
{sold} SELECT id, partner_id, signed AS subscribed_at, CAST(pct AS DOUBLE) AS share_pct FROM split"""),
        "op_revenue_split": with_domain(f"""
{sold} SELECT id, plan_id, partner_id, CAST(house_share AS DOUBLE) AS house_share, CAST(partner_share AS DOUBLE) AS partner_share,
  CAST(insurer_share AS DOUBLE) AS insurer_share FROM split"""),
        "op_card_fee_brackets": with_domain(f"""
SELECT id, installments, CAST({card_fee('100', 'installments')} AS DOUBLE) AS card_fee_pct,
  CAST({card_fee('value', 'installments')} + 0.27 AS DOUBLE) AS card_cost
FROM d_payments"""),
        "op_bucket_point_in_period": with_domain(f"""
WITH {periods(months)}
SELECT {DAYS}, id, order_id FROM (SELECT *, {loc('created_at')} AS seen FROM d_payments) AS p JOIN periods ON seen >= p_from AND seen < p_to"""),
        "op_in_period_flag": with_domain(f"""
WITH {periods(months)}
SELECT {DAYS}, order_id, id, issue_id
FROM (SELECT *, {loc('swapped_at')} AS seen FROM d_service_requests) AS r JOIN periods ON seen >= p_from AND seen < p_to"""),
        "op_explode_overlap_periods": with_domain(f"""
WITH {periods(months)}, {activity(months, True)}
SELECT {DAYS}, o_id FROM activity JOIN periods ON began <= p_to AND ended >= p_from"""),
        "op_semi_inhouse": with_domain("""
SELECT id, issue_id FROM d_service_requests WHERE id IN (SELECT service_request_id FROM d_repairs WHERE repair_shop_id = 28)"""),
        "op_left_join_chain": with_domain("""
WITH sale AS (SELECT so.order_id, so.store_id, pa.id AS partner_id FROM d_store_orders AS so
  LEFT JOIN d_stores AS st ON st.id = so.store_id LEFT JOIN d_partners AS pa ON pa.id = st.partner_id)
SELECT pay.id, pay.order_id, o.plan_id, sale.store_id, sale.partner_id
FROM d_orders AS o RIGHT JOIN d_payments AS pay ON pay.order_id = o.id LEFT JOIN sale ON sale.order_id = o.id"""),
        "op_device_swap_history": with_domain(f"""
SELECT sr.order_id AS o_id, {loc('s.created_at')} AS c_at, s.id AS dswap_id
FROM d_device_swaps AS s JOIN d_service_requests AS sr ON sr.id = s.service_request_id
WHERE sr.order_id IN (SELECT id FROM d_orders)"""),
        "op_count_nonnull": with_domain("""
SELECT order_id, count(*) AS n_requests, count(*) FILTER (issue_id IS NOT NULL) AS n_with_issue,
  count(*) FILTER (swapped_at IS NOT NULL) AS n_swapped, count(*) FILTER (closed_at IS NOT NULL) AS n_closed
FROM d_service_requests GROUP BY order_id"""),
        "op_issue_pivot": with_domain(f"SELECT order_id, {pivot} FROM d_service_requests GROUP BY order_id"),
        "op_distinct_rows": with_domain("SELECT DISTINCT order_id, issue_id FROM d_service_requests"),
    }


# Plans that the sheet of active orders leaves out.
LEFT_OUT = "('CORPORATIVE_2', 'CORPORATIVE_3', 'QBE_DEFAULT')"
WORKBOOK_ORDER = """o.id, o.created_at, o.user_id, o.preco, o.produto_id, o.canceled_at, o.plan_id, o.subscribed_at,
  o.cancellation_reason_id, o.direct_channel, o.skip_auto_renewal, o.order_parent_id, o.old_price,
  o.disable_service_request_fee, o.device_price"""


def bi(spine: Spine, single_order: int) -> dict[str, str]:
    confirmed = f"""{activity(spine, False)},
confirmed AS (
  SELECT a.o_id AS order_id, a.began AS order_subscribed_at, a.ended AS order_canceled_at
  FROM activity AS a WHERE a.o_id IN (SELECT id FROM d_orders WHERE payment_confirmed))"""
    fees = """fee_months AS (
  SELECT order_id, date_trunc('month', created_at)::TIMESTAMP AS start_month, sum(value)::DECIMAL(28,2) AS paid, min(created_at) AS min
  FROM d_payments WHERE reason = 'repair_fee' GROUP BY ALL),
fees AS (
  SELECT order_id, start_month, paid::DOUBLE AS fee_rev, (paid * -0.0925)::DOUBLE AS fee_rev_taxes,
    (paid * 0.9075)::DOUBLE AS net_fee_rev, min FROM fee_months)"""
    rows = f"""{periods(spine)}, {confirmed}, {fees},
dated_fees AS (SELECT * FROM fees JOIN periods ON min >= p_from AND min < p_to),
grid AS (SELECT p_from, p_to, c.* FROM confirmed AS c, periods)"""
    whole = f"""{rows}, book AS (
  SELECT g.p_from AS start_interval, g.p_to AS end_interval, g.order_id, g.order_subscribed_at, g.order_canceled_at,
    {WORKBOOK_ORDER}, pl.id AS id_plans, pl.name AS plan_name, pl.number_of_months, pl.price_factor, pl.partner_price_factor,
    pl.fixed_product_price, pl.percentage_value, pl.use_price_table, pl.min_value, pl.max_value,
    f.order_id AS fee_order_id, f.start_month, f.fee_rev, f.fee_rev_taxes, f.net_fee_rev, f.min, {now_of(spine)} AS now
  FROM grid AS g LEFT JOIN d_orders AS o ON o.id = g.order_id LEFT JOIN d_plans AS pl ON pl.id = o.plan_id
  LEFT JOIN dated_fees AS f ON f.order_id = g.order_id AND f.p_from = g.p_from)"""
    active = "count(*) FILTER (end_interval >= subscribed_at AND (canceled_at IS NULL OR end_interval <= canceled_at)) AS active_orders"
    month = "CAST(date_trunc('month', start_interval) AS DATE) AS start_month"
    return {
        "bi_selected_orders": with_domain(f"WITH {confirmed} SELECT * FROM confirmed"),
        "bi_fee_rev_draft": with_domain(f"WITH {fees} SELECT * FROM fees"),
        "bi_plans": with_domain("SELECT * EXCLUDE (id, name), id AS id_plans, name AS plan_name FROM (SELECT id, name, number_of_months, "
                                "price_factor, partner_price_factor, fixed_product_price, percentage_value, use_price_table, "
                                "min_value, max_value FROM d_plans)"),
        "bi_orders": with_domain(f"SELECT {WORKBOOK_ORDER} FROM d_orders AS o"),
        "bi_order_months": with_domain(f"WITH {whole} SELECT * FROM book"),
        "bi_fee_rev_in_period": with_domain(f"""WITH {rows}
SELECT g.p_from AS start_interval, g.p_to AS end_interval, g.order_id, f.start_month, f.fee_rev, f.fee_rev_taxes, f.net_fee_rev, f.min
FROM grid AS g LEFT JOIN dated_fees AS f ON f.order_id = g.order_id AND f.p_from = g.p_from"""),
        "bi_active_orders_by_month": with_domain(f"""WITH {whole}
SELECT {month}, {active} FROM book WHERE plan_name IS NULL OR plan_name NOT IN {LEFT_OUT} GROUP BY 1"""),
        "bi_active_orders_single": with_domain(f"""WITH {whole}
SELECT {month}, {active} FROM book WHERE order_id = {single_order} GROUP BY 1"""),
        "bi_record_count": with_domain(f"WITH {whole} SELECT count(*) AS number_of_records FROM book"),
    }


def contribution_margin(spine: Spine) -> str:
    """Gross margin (all revenue of the month) and house margin (the house's share of revenue and taxes)."""
    until = spine.as_of.date().replace(day=1).isoformat()
    months = f"WHERE creation_month BETWEEN DATE '{spine.start.isoformat()}' AND DATE '{until}'"
    z = lambda *cols: " + ".join(f"ifnull(any_value({c}), 0.0)" for c in cols)
    taxes = ("fee_tax", "severity_tax_credit")
    return f"""
WITH marts AS (
  SELECT * EXCLUDE (end_interval) FROM ({revenue(spine, 'revenue')}) AS r
  UNION ALL BY NAME SELECT start_interval, order_id, fee_rev, fee_tax FROM ({fee_revenue(spine)}) AS f
  UNION ALL BY NAME SELECT start_interval, order_id, repair_cost, swap_cost, inbound_logistic_cost, outbound_logistic_cost,
    severity_tax_credit FROM ({severity(spine)}) AS s
  UNION ALL BY NAME SELECT creation_month AS start_interval, order_id, fee_transaction_cost FROM ({fee_txn_cost()}) AS t {months}
  UNION ALL BY NAME SELECT creation_month AS start_interval, order_id, plan_transaction_cost FROM ({plan_txn_cost()}) AS u {months}),
folded AS (
  SELECT start_interval, order_id,
    {z('total_revenue', 'fee_rev')} AS revenue,
    {z('plan_revenue_pis_cofins', 'rfq_revenue_pis_cofins', 'rfq_revenue_iss', *taxes)} AS taxes,
    {z('repair_cost', 'swap_cost', 'inbound_logistic_cost', 'outbound_logistic_cost', 'fee_transaction_cost',
       'plan_transaction_cost')} AS costs,
    {z('house_plan_revenue', 'house_rfq_revenue', 'fee_rev')} AS house_revenue,
    {z('house_plan_revenue_pis_cofins', 'house_rfq_revenue_pis_cofins', 'house_rfq_revenue_iss', *taxes)} AS house_taxes
  FROM marts GROUP BY start_interval, order_id)
SELECT *, (revenue + taxes) + costs AS contribution_margin, (house_revenue + house_taxes) + costs AS house_margin FROM folded"""


def geo_zone_join() -> str:
    """Corners of four fixed zones, one with a hole; a point is inside if a ray to its right crosses an odd number of sides."""
    return """
WITH corners(zone_id, zone_name, ring, corner, cx, cy) AS (VALUES
  (1, 'north_block', 1, 1, 1.0::DOUBLE, 5.0::DOUBLE), (1, 'north_block', 1, 2, 6.0, 5.5), (1, 'north_block', 1, 3, 6.5, 9.0),
  (1, 'north_block', 1, 4, 2.0, 9.5),
  (2, 'river_bend', 1, 1, 5.0, 0.5), (2, 'river_bend', 1, 2, 9.5, 1.0), (2, 'river_bend', 1, 3, 9.0, 4.5), (2, 'river_bend', 1, 4, 7.0, 2.5),
  (2, 'river_bend', 1, 5, 5.5, 4.0),
  (3, 'far_field', 1, 1, 20.0, 20.0), (3, 'far_field', 1, 2, 21.0, 20.0), (3, 'far_field', 1, 3, 21.0, 21.0),
  (4, 'ring_road', 1, 1, 0.5, 0.5), (4, 'ring_road', 1, 2, 9.5, 0.25), (4, 'ring_road', 1, 3, 9.75, 9.5), (4, 'ring_road', 1, 4, 0.25, 9.75),
  (4, 'ring_road', 2, 1, 3.0, 3.0), (4, 'ring_road', 2, 2, 7.0, 3.5), (4, 'ring_road', 2, 3, 6.5, 7.0), (4, 'ring_road', 2, 4, 3.5, 6.5)),
sides AS (
  SELECT zone_id, zone_name, cx, cy,
    ifnull(lead(cx) OVER w, first(cx) OVER w) AS nx, ifnull(lead(cy) OVER w, first(cy) OVER w) AS ny
  FROM corners WINDOW w AS (PARTITION BY zone_id, ring ORDER BY corner ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
points AS (SELECT event_id, (event_id * 7919) % 1000 / 100.0 AS x, (event_id * 104729) % 1000 / 100.0 AS y FROM events),
inside AS (
  SELECT zone_id, event_id FROM points JOIN sides ON (cy > y) <> (ny > y) AND x < (nx - cx) * (y - cy) / (ny - cy) + cx
  GROUP BY zone_id, event_id HAVING count(*) % 2 = 1)
SELECT z.zone_id, z.zone_name, count(i.event_id) AS n_points
FROM (SELECT DISTINCT zone_id, zone_name FROM corners) AS z LEFT JOIN inside AS i USING (zone_id) GROUP BY ALL"""
