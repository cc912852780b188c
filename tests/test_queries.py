import pytest
from sql_compare import connect, same

from lineal.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_are_those_of_sql(spark, sf_dir, duck, name):
    same(catalogue.QUERIES[name](spark, sf_dir), duck, catalogue.ORACLES[name])


def test_draws_are_of_the_group(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").toPandas()
    known = set(map(tuple, o.values.tolist()))
    got = catalogue.QUERIES["gumbel_max"](spark, sf_dir).collect()
    assert {(r.custkey, r.orderkey) for r in got} <= known and len(got) == o.o_custkey.nunique()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
