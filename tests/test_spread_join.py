"""Joins on uneven columns: exact for every kind of join, and a value with a third of the rows,
or NULL, is dealt over the partitions at default thresholds."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from parkops.operators import boards as B
from parkops.operators.skew import hot_map, spread_join
from parkops.sources.views import Garage


def left(spark, n=12000):
    i = F.col("id")
    return spark.range(0, n, 1, 5).select(
        i, F.when(i % 3 == 0, 7).when(i % 3 == 1, F.lit(None)).otherwise(i % 900).cast("long").alias("k"))


def right(spark):
    return spark.range(0, 500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_the_plain_join(spark, how):
    a, b = left(spark), right(spark)
    got = spread_join(a, b, "k", how, hot_map(a, "k"), ["id"])
    want = a.join(b, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_value_and_null_are_dealt_over_the_partitions(spark):
    a = left(spark, 32000)
    hot = hot_map(a, "k")
    assert a.limit(1).select(hot.alias("m")).first().m == {7: 3}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled",)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(a, right(spark), "k", "left", hot, ["id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in a.join(right(spark).hint("merge"), "k", "left")
                 .groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v)
    assert sum(sizes) == sum(plain) == 32000
    assert max(sizes) < 2.2 * 32000 / parts < max(plain)


def test_no_hot_value_no_copies(spark):
    a = spark.range(0, 5000).select("id", F.col("id").alias("k"))
    assert a.limit(1).select(hot_map(a, "k").alias("m")).first().m == {}


def test_board_with_a_third_on_one_user_vehicle_spot_and_approver(spark):
    g = Garage(spark, SF_MID)
    third = F.col("request_id") % 3 == 0
    hot = g.service_request.select(*[
        F.when(third, F.lit(5)).otherwise(F.col(c)).cast("long").alias(c)
        if c in ("user_id", "vehicle_id", "spot_id", "approved_by") else F.col(c)
        for c in g.service_request.columns])
    board = B.service_request_board(hot, g.service_type, g.users, g.vehicle, g.parking_spots,
                                    g.parking_garage)
    pdf = board.toPandas()
    base = hot.toPandas()
    users = g.users.toPandas().set_index("user_id")
    spots = g.parking_spots.toPandas().set_index("spot_id")
    base = base[base.user_id.isin(users.index)]
    assert sorted(pdf.request_id) == sorted(base.request_id)
    row = pdf[pdf.request_id % 3 == 0].iloc[0]
    assert row.user_name == users.name[5] and row.approver_name == users.name[5]
    assert row.spot_number == spots.spot_number[5]
    assert (pdf.user_id == 5).sum() >= len(pdf) / 3
