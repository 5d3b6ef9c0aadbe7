import pytest

from poolsmith.plans.queries import QUERIES, SQL

SLOW_WITHOUT_SQL = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", SLOW_WITHOUT_SQL)
def test_runs(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_partitions_change_nothing(spark):
    a = QUERIES["l3_l4_stratified_sample"](spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(QUERIES["l3_l4_stratified_sample"](spark, "/root/testdata/sf0.001").collect()) == sorted(a)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
