"""Rate cards, tax rates and plan classes of the business.

Everything here is an expression over columns (JVM-side, code-generated);
the tables are small enough to be CASE chains, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import dec

# ---- fixed values (must equal the reference) ------------------------------
PLANS_HOUSE_ONLY = (8, 9, 10, 14, 16)   # revenue stays with the house
PLANS_ANNUAL = (8, 10)                  # billed once a year (value / 12)
PLANS_RFQ = (40, 61)                    # insured plans, sold "by admin"
IOF = "0.0738"                          # financial-transaction tax on RFQ plans
PIS_COFINS_PCT = "9.25"
ISS_PCT = "5.00"
ICMS_PROVISION_PCT = "3.00"
# RFQ revenue split (house, partner, insurer) by partner id, before IOF.
RFQ_SPLIT = [
    ((15, 27, 46, 77, 159, 163, 363), ("0.20", "0.35", "0.45")),
    ((164, 383, 395), ("0.15", "0.40", "0.45")),
    ((177,), ("0.23", "0.35", "0.42")),
]
# Card fee in percent by number of installments: 1; 2-3 (and <= 0); 4-6; more or unknown.
CARD_FEE_PCT = [(1, "1.87"), (3, "2.21"), (6, "2.32")]
CARD_FEE_PCT_OTHER = "2.55"
CARD_FIXED_FEE = "0.27"
BOLETO_FEE = "2.90"
BOLETO_METHOD = "boletobancario_santander"
EXTERNAL_SALE_KIND = "Venda externa"
# Issue codes of a service request and the suffix used for pivoted columns.
ISSUES = {"screen": 1, "water": 2, "slm": 3, "theft": 4}
THEFT_ISSUE = 4
IN_HOUSE_REPAIR_SHOP = 28
DEFAULT_LOGISTIC_COST = 35
RFQ_FEE_RATE = "0.55"
RFQ_THEFT_FEE_RATE = "0.70"
PHONE_PRICE_NUM, PHONE_PRICE_DEN = 33, 100  # store total_price is 33 % of the phone price


def one_minus_iof() -> Column:
    return dec(1, 5, 4) - dec(IOF, 5, 4)


def shares(plan_id: Column, partner_id: Column, revenue_share_pct: Column) -> dict[str, Column]:
    """House / partner / insurer share of a sale (DECIMAL, exact).

    plan in house-only set -> (1, 0, 0); other non-RFQ plan -> partner gets
    the valid revenue share percent; RFQ plan (and NULL plan, which fails
    both tests) -> tiered split by partner, net of IOF; unknown partner -> 0.
    """
    rs = F.coalesce(revenue_share_pct * dec("0.01", 3, 2), dec("0.00", 3, 2))
    k = one_minus_iof()

    def tier(i: int) -> Column:
        expr = None
        for partners, split in RFQ_SPLIT:
            cond = partner_id.isin(*partners)
            val = dec(split[i], 3, 2)
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr.otherwise(dec("0", 3, 2)) * k

    house_only = plan_id.isin(*PLANS_HOUSE_ONLY)
    not_rfq = ~plan_id.isin(*PLANS_RFQ)
    return {
        "house_share": F.when(house_only, dec(1, 3, 2)).when(not_rfq, dec(1, 3, 2) - rs).otherwise(tier(0)),
        "partner_share": F.when(house_only, dec(0, 3, 2)).when(not_rfq, rs).otherwise(tier(1)),
        "insurer_share": F.when(not_rfq, dec(0, 3, 2)).otherwise(tier(2)),
    }


def card_fee_pct(installments: Column) -> Column:
    """Percent fee of a card payment by installment bracket (NULL -> top rate)."""
    expr = None
    for upper, pct in CARD_FEE_PCT:
        cond = (installments == upper) if upper == 1 else (installments <= upper)
        expr = F.when(cond, dec(pct, 4, 2)) if expr is None else expr.when(cond, dec(pct, 4, 2))
    return expr.otherwise(dec(CARD_FEE_PCT_OTHER, 4, 2))


def is_rfq(plan_id: Column) -> Column:
    return plan_id.isin(*PLANS_RFQ)
