import pytest

from blockloom.plans.queries import oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_round_trip_query(spark):
    rows = QUERIES["encode_decode_roundtrip"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.same and r.valid and r.number_same for r in rows)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_filter_reaches_the_scan(spark):
    plan = QUERIES["block_range_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey," in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
