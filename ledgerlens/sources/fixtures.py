"""Domain tables derived from the driver's TPC-H-style parquet files.

The marts consume the business schema (orders, payments, store_orders,
service_requests, ...).  The test data ships TPC-H-like tables instead, so
each domain table is a deterministic projection of one of them.  Every
derivation is a narrow DataFrame expression — no joins; the only shuffles
are the two small DISTINCTs for brands and plans — so it adds little beyond
scan cost at any scale.  ``fixtures_sql.DOMAIN_CTES`` is the same derivation in
DuckDB SQL for the oracle side.

In production a :class:`Domain` is built from the real tables instead
(``Domain.from_tables``); the marts never know the difference.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEC = "decimal(18,2)"

# --- fixed values of the fixture rules (FIXTURES.md section 2) -----------
PLAN_CYCLE = [8, 9, 10, 14, 16, 40, 61, 20, None]          # plan_id by o_orderkey % 9
PARTNER_IDS = [15, 27, 46, 77, 159, 163, 363, 164, 383, 395, 177]  # partner id by nation key
PARTNER_SIZES = ["small", "medium", "large"]
PARTNER_KINDS = ["Venda externa", "Loja propria", "Varejo", "Online"]
GAP_MICROS = 10_799_500_000                                # 02:59:59.5 after month start (UTC)
AS_OF_TPC = "2001-12-15 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

TABLES = (
    "orders", "payments", "store_orders", "stores", "partners", "partner_groups",
    "partner_sizes", "partner_kinds", "revenue_shares", "product_prices", "produtos",
    "marcas", "plans", "service_requests", "repairs", "rel_service_request_costs",
    "service_request_postings", "device_swaps", "devices", "trackings", "users",
    "sellers", "sales_kinds",
)


def _pick(values: list, idx0: Column) -> Column:
    """values[idx0] for a 0-based integer column (NULL entries allowed)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx0 + 1).cast("int"))


def _secs(n: Column, ts: Column) -> Column:
    return F.timestamp_add("SECOND", n, ts)


def _days(n: Column, ts: Column) -> Column:
    return F.timestamp_add("DAY", n, ts)


def _month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM").cast("timestamp_ntz")


class Domain:
    """Lazily built domain DataFrames.

    Either derived from an ``sf_dir`` of driver parquet files, or handed in
    directly (``overrides``) — tests pass hand-made rows that way.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None,
                 overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/") if sf_dir else None
        # cached_property values live in the instance dict, so handing a
        # table in simply pre-fills that slot.
        self.__dict__.update(overrides or {})

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> "Domain":
        return cls(spark, None, tables)

    # -- raw driver tables -------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        """A driver table."""
        if self.sf_dir is None:
            raise KeyError(f"no source for raw table {name}")
        return self.memo(("raw", name), lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def memo(self, key, build):
        """Build a derived plan once per domain (a DataFrame is an immutable
        plan, so marts reused by other marts are analysed only once)."""
        cache = self.__dict__.setdefault("_plan_cache", {})
        if key not in cache:
            cache[key] = build()
        return cache[key]

    # -- orders --------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        created = _secs(k * 7919 % 86400, F.col("o_orderdate"))
        preco = F.col("o_totalprice").cast(DEC)
        return o.select(
            k.alias("id"),
            F.col("o_custkey").alias("user_id"),
            preco.alias("preco"),
            (k % 2000).alias("produto_id"),
            _pick(PLAN_CYCLE, k % 9).cast("int").alias("plan_id"),
            created.alias("created_at"),
            F.when(k % 101 != 0, created).alias("subscribed_at"),
            F.when(k % 3 == 0, _days(k % 40, created)).alias("canceled_at"),
            F.when(k % 3 == 0, (k % 7).cast("int")).alias("cancellation_reason_id"),
            F.when(F.col("o_orderstatus") == "F", F.lit(True))
             .when(F.col("o_orderstatus") == "O", F.lit(False)).alias("direct_channel"),
            (k % 4 == 0).alias("skip_auto_renewal"),
            F.when(k % 13 == 0, k - 1).alias("order_parent_id"),
            (preco - 10).cast(DEC).alias("old_price"),
            (k % 7 == 0).alias("disable_service_request_fee"),
            F.col("o_orderpriority").alias("source"),
            _pick(["verified", "pending", None], k % 3).alias("app_verification_status"),
            (k % 3 == 0).alias("canceled"),
            F.lpad(F.col("o_custkey").cast("string"), 11, "0").alias("user_cpf"),
            (k % 10 != 0).alias("payment_confirmed"),
            (F.col("o_custkey").cast(DEC) + F.lit(0.99).cast("decimal(3,2)")).cast(DEC).alias("device_price"),
        )

    # -- payments and the line-level facts derived from lineitem -------------
    @cached_property
    def _lines(self) -> DataFrame:
        l = self.raw("lineitem")
        ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
        pid = ((ok * 100000 + pk) * 10000 + sk) * 10 + ln
        value = F.col("l_extendedprice").cast(DEC)
        value = F.when((ln == 7) & (sk % 5 == 0), -value).otherwise(value)
        created = F.when(
            sk % 50 == 0,
            F.timestamp_add("MICROSECOND", F.lit(GAP_MICROS), _month_start(F.col("l_shipdate"))),
        ).otherwise(_secs((pk * 7919 + sk * 104729) % 86400, F.col("l_shipdate")))
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        reason = (F.when(pk % 211 == 0, F.lit(None).cast("string"))
                  .when((flag == "N") & (status == "O"), "subscription")
                  .when(flag == "N", "overdue_monthly_fee")
                  .when(flag == "A", "monthly_fee")
                  .when(status == "F", "repair_fee")
                  .otherwise("overdue_repair_fee"))
        psp = F.concat(F.when(sk % 7 == 0, F.lit("boleto-")).otherwise(F.lit("psp-")), pid.cast("string"))
        return l.select(
            pid.alias("id"), ok.alias("order_id"), value.cast(DEC).alias("value"),
            created.alias("created_at"), reason.alias("reason"),
            F.when(ln != 5, ln).alias("installments"), psp.alias("psp_reference"),
            pk.alias("_pk"), sk.alias("_sk"), ln.alias("_ln"), flag.alias("_flag"),
            F.col("l_quantity").alias("_qty"), F.col("l_extendedprice").alias("_price"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self._lines.select("id", "order_id", "created_at", "reason", "value",
                                  "psp_reference", "installments")

    @cached_property
    def trackings(self) -> DataFrame:
        sk = F.col("_sk")
        return (self._lines.filter(sk % 2 == 0)
                .select("psp_reference",
                        F.when(sk % 6 == 0, F.lit("boletobancario_santander"))
                         .otherwise(F.lit("card")).alias("payment_method")))

    @cached_property
    def _sr_lines(self) -> DataFrame:
        return self._lines.filter(F.col("_flag") == "R")

    @cached_property
    def service_requests(self) -> DataFrame:
        return self._sr_full.drop("_pk")

    @cached_property
    def _sr_full(self) -> DataFrame:
        """Requests of returned lines; every 17th part key opens a second request
        (negative id) on the same payment reference.  One pass: each line
        explodes into one or two request rows."""
        s = self._sr_lines
        pk, ln = F.col("_pk"), F.col("_ln")
        swapped = F.when(pk % 4 != 0, _days(pk % 45, F.col("created_at")))
        swapped2 = _days(F.lit(1), swapped)

        def req(id_col, issue, sw):
            return F.struct(id_col.alias("id"), issue.alias("issue_id"), sw.alias("swapped_at"),
                            _days(F.lit(2), sw).alias("closed_at"))

        first = req(F.col("id"), F.when(ln % 5 != 0, ln % 5), swapped)
        second = F.when(pk % 17 == 0, req(-F.col("id"), F.when((ln + 1) % 5 != 0, (ln + 1) % 5), swapped2))
        rows = s.select(F.explode(F.array_compact(F.array(first, second))).alias("r"), "order_id", "created_at",
                        "psp_reference", "_ln", "_pk")
        return rows.select(
            "r.id", "order_id", "r.issue_id", F.col("created_at").alias("arrived_at"), "r.swapped_at", "r.closed_at",
            _days(F.lit(1), F.col("created_at")).alias("tracked_at"), F.col("psp_reference").alias("payment_reference"),
            F.col("_ln").alias("user_service_requests_count"), (pk % 3).cast("int").alias("order_service_requests_count"),
            "_pk")

    @cached_property
    def repairs(self) -> DataFrame:
        s = self._sr_lines.filter(F.col("id") % 3 == 0)
        row = F.struct(F.col("id").alias("service_request_id"),
                       F.when(F.col("_sk") % 2 == 0, F.lit(28)).otherwise(F.lit(5)).alias("repair_shop_id"))
        copies = F.when(F.col("_pk") % 13 == 0, F.lit(2)).otherwise(F.lit(1))
        return s.select(F.explode(F.array_repeat(row, copies)).alias("r")).select("r.*")

    @cached_property
    def rel_service_request_costs(self) -> DataFrame:
        s = self._sr_lines
        pk = F.col("_pk")
        inv = F.col("_price").cast(DEC)
        first = F.when(pk % 5 != 0, F.struct(
            F.when(pk % 23 != 0, (F.col("_qty") * 10).cast(DEC)).alias("repair_cost"),
            inv.alias("invoice_in_value"), (inv - 50).cast(DEC).alias("invoice_out_value")))
        second = F.when(pk % 19 == 0, F.struct(
            F.lit(5).cast(DEC).alias("repair_cost"), F.lit(0).cast(DEC).alias("invoice_in_value"),
            F.lit(0).cast(DEC).alias("invoice_out_value")))
        return (s.select(F.col("id").alias("service_request_id"),
                         F.explode(F.array_compact(F.array(first, second))).alias("c"))
                .select("service_request_id", "c.repair_cost", "c.invoice_in_value", "c.invoice_out_value"))

    @cached_property
    def service_request_postings(self) -> DataFrame:
        s = self._sr_lines
        pk, ln = F.col("_pk"), F.col("_ln").cast(DEC)
        return s.filter(pk % 6 != 0).select(
            F.col("id").alias("service_request_id"),
            F.when(pk % 7 != 0, (ln + 20).cast(DEC)).alias("from_customer_value"),
            (ln + 25).cast(DEC).alias("from_house_value"))

    @cached_property
    def device_swaps(self) -> DataFrame:
        sr = self._sr_full.filter(F.col("swapped_at").isNotNull())
        pk = F.col("_pk")
        return sr.select(
            F.col("id"), F.col("id").alias("service_request_id"),
            F.col("swapped_at").alias("created_at"),
            (pk * 2).alias("old_device_id"), (pk * 2 + 1).alias("new_device_id"))

    @cached_property
    def devices(self) -> DataFrame:
        p = self.raw("part").select(F.col("p_partkey"))
        return p.select(F.explode(F.array(
            F.struct((F.col("p_partkey") * 2).alias("id"), F.col("p_partkey").alias("product_id")),
            F.struct((F.col("p_partkey") * 2 + 1).alias("id"), (F.col("p_partkey") + 1).alias("product_id")),
        )).alias("d")).select("d.id", "d.product_id")

    # -- store side ------------------------------------------------------------
    @cached_property
    def store_orders(self) -> DataFrame:
        """Store sales of every order not divisible by 11; every 53rd order also
        has a second sale at the next store.  One pass over orders."""
        o = self.raw("orders").filter(F.col("o_orderkey") % 11 != 0)
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        first = F.struct(F.lit(1).alias("suffix"), F.lit(0).alias("shift"))
        second = F.when(k % 53 == 0, F.struct(F.lit(2).alias("suffix"), F.lit(1).alias("shift")))
        rows = o.select("*", F.explode(F.array_compact(F.array(first, second))).alias("v"))
        paid = F.col("o_totalprice").cast(DEC)
        return rows.select(
            (k * 10 + F.col("v.suffix")).alias("id"), k.alias("order_id"),
            (k % 12 + 1).cast("int").alias("installments"),
            (c.cast(DEC) + F.lit(99.90).cast("decimal(4,2)")).cast(DEC).alias("total_price"),
            _pick(["credit_card", "boleto", "debit"], k % 3).alias("payment_method"),
            F.concat(F.lit("S"), (c % 50).cast("string")).alias("seller_identifier"),
            (c % 120 + F.col("v.shift")).alias("store_id"),
            (c % 50).alias("seller_id"),
            F.when(k % 2 == 0, F.lit("monthly")).otherwise(F.lit("annual")).alias("plan_type"),
            paid.alias("device_value_paid"),
            (paid + 100).cast(DEC).alias("device_value_without_discount"),
            F.col("o_orderpriority").alias("bought_type"),
            F.concat(F.lit("P"), (k % 5).cast("string")).alias("price_label"),
            (k % 4).cast("int").alias("sales_kind_id"),
            F.lpad(k.cast("string"), 15, "0").alias("imei"),
            F.concat(F.lit("INV-"), k.cast("string")).alias("invoice_number"),
        )

    @cached_property
    def stores(self) -> DataFrame:
        s = self.raw("supplier")
        i, n = F.col("s_suppkey"), F.col("s_nationkey")
        odd = i % 2 == 1
        return s.select(
            i.alias("id"), F.col("s_name").alias("name"), self._partner_id(n).alias("partner_id"),
            F.when(odd, F.concat(F.lit("Street "), i.cast("string"))).alias("address"),
            F.when(odd, (i % 1000).cast("string")).alias("number"),
            F.when(odd, F.concat(F.lit("Bairro "), (i % 7).cast("string"))).alias("neighborhood"),
            F.when(odd, F.concat(F.lit("City "), (i % 13).cast("string"))).alias("city"),
            F.when(odd, F.concat(F.lit("ST"), (n % 27).cast("string"))).alias("state"),
            F.when(odd, F.lpad((i * 7 % 100000).cast("string"), 8, "0")).alias("zipcode"),
            F.when(odd, F.concat(F.lit("R"), (n % 5).cast("string"))).alias("region"),
            (i % 9).alias("regional_manager_id"),
        )

    @staticmethod
    def _partner_id(nk: Column) -> Column:
        return F.when(nk < len(PARTNER_IDS), _pick(PARTNER_IDS, nk)).otherwise(nk + 500).cast("int")

    @cached_property
    def partners(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        return n.select(
            self._partner_id(k).alias("id"), F.col("n_name").alias("name"),
            (k % 6).cast("int").alias("account_manager_id"), (k % 2 == 0).alias("retail"),
            F.col("n_regionkey").alias("partner_group_id"),
            (k % 3).cast("int").alias("partner_size_id"), (k % 4).cast("int").alias("partner_kind_id"),
        )

    @cached_property
    def partner_groups(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def partner_sizes(self) -> DataFrame:
        r = self.raw("region").filter(F.col("r_regionkey") < len(PARTNER_SIZES))
        return r.select(F.col("r_regionkey").alias("id"), _pick(PARTNER_SIZES, F.col("r_regionkey")).alias("size"))

    @cached_property
    def partner_kinds(self) -> DataFrame:
        r = self.raw("region").filter(F.col("r_regionkey") < len(PARTNER_KINDS))
        return r.select(F.col("r_regionkey").alias("id"),
                        _pick(PARTNER_KINDS, F.col("r_regionkey")).alias("description"))

    @cached_property
    def revenue_shares(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        ts = lambda s: F.lit(s).cast("timestamp_ntz")
        null_ts = F.lit(None).cast("timestamp_ntz")
        pct = lambda v: F.lit(v).cast("decimal(5,2)")
        windows = F.array(
            F.struct(null_ts.alias("begin_at"), ts("1997-12-31").alias("finish_at"), pct("10.00").alias("value")),
            F.struct(ts("1998-01-01").alias("begin_at"), ts("1999-12-31").alias("finish_at"), pct("12.50").alias("value")),
            F.struct(F.when(k % 2 == 0, ts("1999-07-01")).otherwise(ts("2000-01-01")).alias("begin_at"),
                     null_ts.alias("finish_at"), pct("15.00").alias("value")),
        )
        return (n.select(self._partner_id(k).alias("partner_id"), F.explode(windows).alias("w"))
                .select("partner_id", "w.value", "w.begin_at", "w.finish_at"))

    @cached_property
    def product_prices(self) -> DataFrame:
        p = self.raw("part")
        price = F.col("p_retailprice").cast(DEC)
        null_ts = F.lit(None).cast("timestamp_ntz")
        windows = F.array(
            F.struct(price.alias("device_price"), null_ts.alias("created_at"),
                     F.lit("1997-06-30").cast("timestamp_ntz").alias("expired_at")),
            F.struct((price + 10).cast(DEC).alias("device_price"),
                     F.lit("1997-07-01").cast("timestamp_ntz").alias("created_at"), null_ts.alias("expired_at")),
        )
        return (p.select(F.col("p_partkey").alias("product_id"), F.explode(windows).alias("w"))
                .select("product_id", "w.device_price", "w.created_at", "w.expired_at"))

    @cached_property
    def produtos(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("modelo"),
            F.substring("p_brand", 7, 10).cast("int").alias("marca_id"))

    @cached_property
    def marcas(self) -> DataFrame:
        return (self.raw("part")
                .select(F.substring("p_brand", 7, 10).cast("int").alias("id"), F.col("p_brand").alias("marca_nome"))
                .distinct())

    @cached_property
    def plans(self) -> DataFrame:
        ids = self.orders.select(F.col("plan_id").alias("id")).filter(F.col("id").isNotNull()).distinct()
        i = F.col("id")
        return ids.select(
            i.alias("id"), plan_name(i).alias("name"),
            F.when(i.isin(8, 10), F.lit(12)).otherwise(F.lit(1)).alias("number_of_months"),
            (i.cast("double") / 100.0).alias("price_factor"),
            (1.0 - i.cast("double") / 200.0).alias("partner_price_factor"),
            (i * 10).cast("decimal(8,2)").alias("fixed_product_price"),
            ((i % 7).cast("double") * 1.5).alias("percentage_value"),
            (i % 2 == 0).alias("use_price_table"),
            F.lit(10).cast("decimal(8,2)").alias("min_value"),
            F.lit(1000).cast("decimal(8,2)").alias("max_value"),
        )

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        i, n = F.col("c_custkey"), F.col("c_nationkey")
        return c.select(
            i.alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("55-"), i.cast("string")).alias("phonenumber"),
            F.concat(F.lit("Rua "), n.cast("string")).alias("address_street"),
            F.lpad((i % 100000).cast("string"), 8, "0").alias("address_zipcode"),
            (i % 1000).cast("string").alias("address_number"),
            F.col("c_mktsegment").alias("address_neighborhood"),
            F.when(i % 2 == 0, F.concat(F.lit("apt "), (i % 50).cast("string"))).alias("address_complement"),
            F.concat(F.lit("City "), n.cast("string")).alias("address_city"),
            F.concat(F.lit("ST"), (n % 27).cast("string")).alias("address_state"),
            (i % 10).alias("orders_count"), (i % 100).alias("sign_in_count"),
            F.concat(F.lit("55-9"), i.cast("string")).alias("cellphone_number"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        c = self.raw("customer").filter(F.col("c_custkey") < 50)
        return c.select(F.col("c_custkey").alias("id"),
                        F.concat(F.lit("Seller "), F.col("c_custkey").cast("string")).alias("name"))

    @cached_property
    def sales_kinds(self) -> DataFrame:
        r = self.raw("region")
        return r.select(F.col("r_regionkey").alias("id"),
                        F.concat(F.lit("kind_"), F.col("r_regionkey").cast("string")).alias("identifier"),
                        F.col("r_name").alias("description"))


# Plan names of the fixture (fixed values; three of them form the BI
# worksheet's excluded set).
PLAN_NAMES = {
    8: "ANNUAL_HOUSE", 9: "MONTHLY_HOUSE", 10: "ANNUAL_HOUSE_PLUS", 14: "CORPORATIVE_2",
    16: "CORPORATIVE_3", 20: "PARTNER_MONTHLY", 40: "QBE_DEFAULT", 61: "RFQ_PLUS",
}


def plan_name(i: Column) -> Column:
    expr = None
    for pid, name in PLAN_NAMES.items():
        expr = (F.when(i == pid, F.lit(name)) if expr is None else expr.when(i == pid, F.lit(name)))
    return expr.otherwise(F.concat(F.lit("PLAN_"), i.cast("string")))
