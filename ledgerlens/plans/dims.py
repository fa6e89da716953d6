"""Dimension extracts, order / store-order extracts and the payment lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import to_local
from ..operators.joins import split_join
from ..operators.validity import indexed_valid_time_join
from ..sources.fixtures import Domain

STORE_TEXT = ("address", "number", "neighborhood", "city", "state", "zipcode", "region")


def dim_products(dom: Domain) -> DataFrame:
    return dom.produtos.select("id", "modelo", "marca_id")


def dim_brands(dom: Domain) -> DataFrame:
    return dom.marcas.select("id", "marca_nome")


def dim_plans(dom: Domain) -> DataFrame:
    return dom.plans.select("id", "name", "number_of_months", "price_factor", "partner_price_factor",
                            "fixed_product_price", "percentage_value", "use_price_table", "min_value", "max_value")


def dim_stores(dom: Domain) -> DataFrame:
    """Stores with missing address parts reported as empty strings."""
    return dom.stores.select("id", "name", "partner_id",
                             *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in STORE_TEXT],
                             "regional_manager_id")


def dim_partners(dom: Domain) -> DataFrame:
    p = dom.partners
    g = dom.partner_groups.select(F.col("id").alias("g_id"), F.col("name").alias("group_name"))
    s = dom.partner_sizes.select(F.col("id").alias("s_id"), "size")
    return (p.join(g, p["partner_group_id"] == g["g_id"], "left")
            .join(s, p["partner_size_id"] == s["s_id"], "left")
            .select("id", "name", "account_manager_id", "retail", "size", "group_name"))


def extract_store_orders(dom: Domain) -> DataFrame:
    so = dom.store_orders
    sk = dom.sales_kinds.select(F.col("id").alias("sk_id"), "description")
    se = dom.sellers.select(F.col("id").alias("se_id"), "name")
    return (so.join(sk, so["sales_kind_id"] == sk["sk_id"], "left")
            .join(se, so["seller_id"] == se["se_id"], "left")
            .select("id", "order_id", "installments", "total_price", "payment_method", "seller_identifier",
                    "store_id", "seller_id", "name", "plan_type", "device_value_paid",
                    "device_value_without_discount", "bought_type", "price_label", "sales_kind_id", "description"))


def extract_orders_priced(dom: Domain) -> DataFrame:
    """Orders in local time with the device price valid at subscription; a product may have any number of price windows."""
    o = dom.orders.withColumn("sub_local", to_local("subscribed_at"))
    pp = dom.product_prices.select(F.col("product_id").alias("pp_product_id"), "device_price",
                                   F.col("created_at").alias("pp_begin"), F.col("expired_at").alias("pp_end"))
    j = indexed_valid_time_join(o.drop("device_price"), pp, "produto_id", "pp_product_id", "sub_local", "pp_begin", "pp_end")
    return j.select(
        "id", to_local("created_at").alias("created_at"), "user_id", "preco", "produto_id",
        to_local("canceled_at").alias("canceled_at"), "plan_id", F.col("sub_local").alias("subscribed_at"),
        "cancellation_reason_id", "direct_channel", "skip_auto_renewal", "order_parent_id", "old_price",
        "disable_service_request_fee", "device_price", "source", "app_verification_status")


LOOKUP_COLUMNS = (
    "user_name", "email", "source", "marca_nome", "modelo", "seller_name", "canceled",
    "user_service_requests_count", "order_service_requests_count", "installments", "user_id", "user_cpf",
    "plan_id", "plan_name", "state", "city", "order_id", "seller_identifier", "seller_id", "imei", "plan_type",
    "bought_type", "sales_kind_id", "identifier", "invoice_number", "phonenumber", "address_street",
    "address_zipcode", "address_number", "address_neighborhood", "address_complement", "address_city",
    "address_state", "orders_count", "sign_in_count", "cellphone_number",
)


#: A list of at most so many keys is written into the scans' filters; a longer one is left to the joins.
MOST_KEYS = 1000


def _few_keys(df: DataFrame, column: str) -> list | None:
    """The distinct non-null values of a column, or None if they are more than :data:`MOST_KEYS`."""
    got = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_KEYS + 1).collect()
    return [r[0] for r in got] if len(got) <= MOST_KEYS else None


def _only(df: DataFrame, column: str, keys: list | None) -> DataFrame:
    """Rows of the given keys; an equality list that reaches the scan."""
    return df if keys is None else df.filter(F.col(column).isin(keys))


def lookup_payment_360(dom: Domain, psp_reference: str | None = None) -> DataFrame:
    """Everything known about a payment: order, customer, store, seller, plan,
    requests and product.

    No filter by default (every payment; requests of the order fan out).
    ``psp_reference`` narrows it to one payment: the orders of its payments, then their customers, are looked up first, and these
    few keys prune the scans of all large tables.
    The partners join of the source contributes no column and partner ids
    are unique, so it is left out.  Dimensions are attached at the grain of the order and of the store order, and all that an order
    has is joined at the order's grain; payments then meet it in one join that adaptive execution may split, so that a hot order is
    dealt to many tasks, each with a copy of what that order has.
    """
    pay = dom.payments.select(F.col("order_id"), "installments", "psp_reference")
    if psp_reference is not None:
        pay = pay.filter(F.col("psp_reference") == psp_reference)
    wanted = _few_keys(pay, "order_id") if psp_reference is not None else None
    orders = _only(dom.orders, "id", wanted)
    customers = _few_keys(orders, "user_id") if wanted is not None else None
    o = orders.select(F.col("id").alias("o_id"), "source", "canceled", "user_id", "user_cpf", "plan_id",
                          "produto_id")
    so = _only(dom.store_orders, "order_id", wanted).select(
        F.col("order_id").alias("so_order_id"), F.col("store_id").alias("so_store_id"), "seller_identifier", F.col("seller_id"), "imei", "plan_type", "bought_type",
                                 "sales_kind_id", "invoice_number")
    sr = _only(dom.service_requests, "order_id", wanted).select(F.col("order_id").alias("sr_order_id"), "user_service_requests_count",
                                                                "order_service_requests_count")
    users = _only(dom.users, "id", customers).select(F.col("id").alias("u_id"), F.col("name").alias("user_name"), "email", "phonenumber",
                             "address_street", "address_zipcode", "address_number", "address_neighborhood",
                             "address_complement", "address_city", "address_state", "orders_count",
                             "sign_in_count", "cellphone_number")
    st = dom.stores.select(F.col("id").alias("st_id"), "state", "city")
    sk = dom.sales_kinds.select(F.col("id").alias("sk_id"), "identifier")
    pl = dom.plans.select(F.col("id").alias("pl_id"), F.col("name").alias("plan_name"))
    pr = dom.produtos.select(F.col("id").alias("pr_id"), "modelo", "marca_id")
    br = dom.marcas.select(F.col("id").alias("br_id"), "marca_nome")
    se = dom.sellers.select(F.col("id").alias("se_id"), F.col("name").alias("seller_name"))
    # customers, plans and products meet orders, stores and sellers meet store orders
    bought = (o.join(users, o["user_id"] == users["u_id"], "left")
              .join(pl, F.col("plan_id") == pl["pl_id"], "left")
              .join(pr.join(br, F.col("marca_id") == br["br_id"], "left"), F.col("produto_id") == pr["pr_id"], "left"))
    sold = (so.join(st, F.col("so_store_id") == st["st_id"], "left")
            .join(sk, F.col("sales_kind_id") == sk["sk_id"], "left")
            .join(se, F.col("seller_id") == se["se_id"], "left"))
    whole = (bought.join(sold, F.col("o_id") == sold["so_order_id"], "left")
             .join(sr, F.col("o_id") == sr["sr_order_id"], "left"))
    j = split_join(pay, whole, "order_id", "o_id")
    return j.select(*LOOKUP_COLUMNS)


def scan_preview(dom: Domain, n: int = 10) -> DataFrame:
    """First ``n`` orders by id (deterministic ``LIMIT``; a per-partition top-k)."""
    return dom.orders.orderBy("id").limit(n)
