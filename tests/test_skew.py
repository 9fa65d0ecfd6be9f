"""The same comparison on tables where one key, and one row, fill a third each."""

import pytest
from compare import LIBRARY, assert_same, connect
from pyspark.sql import functions as F

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for name in ("nation", "customer", "part"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")

    line = spark.read.parquet(f"{SOURCE}/lineitem.parquet")
    copied = line.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(1)
    hot_key = line.where("l_orderkey % 3 = 1").withColumns(
        {"l_orderkey": F.lit(7).cast("long"), "l_partkey": F.lit(11).cast("long")}
    )
    copies = copied.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("n")
    plain = line.where("l_orderkey % 3 = 2")
    plain.union(hot_key).union(copies).write.parquet(f"{folder}/lineitem.parquet")

    # A third of the orders share a customer, so joins on customers are skewed as well.
    order = spark.read.parquet(f"{SOURCE}/orders.parquet")
    hot = F.when(F.col("o_orderkey") % 3 == 0, 5).otherwise(F.col("o_custkey")).cast("long")
    order.withColumn("o_custkey", hot).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def con(skewed_dir):
    return connect(skewed_dir)


@pytest.mark.parametrize("name", LIBRARY)
def test_query_matches_sql_under_skew(spark, con, skewed_dir, name):
    assert_same(spark, con, name, skewed_dir)
