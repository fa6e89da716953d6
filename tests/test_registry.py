"""Registry contract: every query has an oracle, names line up, and every
query matches its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as entry
from ledgerlens import registry


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert len(registry.queries()) >= 51
    assert set(registry.queries()) <= set(entry.queries())


def test_no_forbidden_names():
    for name in registry.queries():
        assert not name.lower().startswith("op") or name.startswith("op_")
        assert "pipeline" not in name


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_oracle_parity_sf0001(spark, name):
    from tools.oracle_check import compare

    res = compare(spark, "/root/testdata/sf0.001", [name], verbose=True)
    assert res[name] == "OK"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "order_id" in df.columns


def test_oracle_column_types_match(spark):
    """Column names and types of every query equal its oracle's (schema part of the driver check)."""
    from tools.oracle_check import type_differences

    assert type_differences(spark, "/root/testdata/sf0.001", list(registry.queries())) == {}


def test_order_months_cover_the_whole_spine(spark):
    """As many rows, orders and periods as the fee join over all periods and the record count."""
    sf, qs = "/root/testdata/sf0.001", registry.queries()
    shape = lambda df: df.selectExpr("count(*)", "count(DISTINCT start_interval)", "count(DISTINCT order_id)").first()
    got = shape(qs["bi_order_months"](spark, sf))
    assert got == shape(qs["bi_fee_rev_in_period"](spark, sf))
    assert got[0] == qs["bi_record_count"](spark, sf).first()[0] and got[1] == registry.WORKBOOK.last_index + 1
