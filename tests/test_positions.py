"""Positions: exact with hot, NULL and tied leading keys, whatever the number of buckets
and the adaptive settings; built without a job; one shuffle of the rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from parkops.operators import ranking as R
from parkops.plans.registry import QUERIES


def rows(n=4000):
    rng = random.Random(3)
    return [(rng.choice(["x", "x", "x", "y", None, "zz"]),
             None if rng.random() < .2 else rng.choice([1.5, -2.0, 7.25]), i) for i in range(n)]


def expected(data):
    """c descending (NULL last), g ascending (NULL first), id descending."""
    key = lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or "", -r[2])
    return {r[2]: i for i, r in enumerate(sorted(data, key=key), 1)}


@pytest.mark.parametrize("buckets,adaptive", [(2, "true"), (37, "false"), (512, "true")])
def test_exact_for_any_number_of_buckets(spark, monkeypatch, buckets, adaptive):
    monkeypatch.setattr(R, "bucket_count", lambda df: buckets)
    data = rows()
    df = spark.createDataFrame(data, "g string, c double, id long").repartition(5)
    order = [R.desc("c"), R.asc("g"), R.desc("id")]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {r.id: r.pos for r in R.with_position(df, order).collect()}
        assert got == expected(data)
        in_group = R.position_in_group(df, ["g"], [R.desc("c"), R.desc("id")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    for g in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == g),
                      key=lambda r: (r[1] is None, -(r[1] or 0), -r[2]))
        assert [r[2] for r in mine] == [r.id for r in sorted(
            (r for r in in_group if r.g == g), key=lambda r: r.pos)]
        assert sorted(r.pos for r in in_group if r.g == g) == list(range(1, len(mine) + 1))


def test_hot_value_is_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "bucket_count", lambda df: 32)
    df = spark.range(0, 9000, 1, 4).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id"))
                                           .alias("g"), "id")
    order = [R.asc("g"), R.asc("id")]
    ks = R._keys(df, order)
    sizes = [r["count"] for r in R.with_bucket(
        ks, R.order_bounds(ks, order, 32), R._of_key(order), 32, "b").groupBy("b").count().collect()]
    assert sum(sizes) == 9000 and len(sizes) > 16 and max(sizes) < 1500


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "id long")
    assert R.with_position(df, [R.asc("id")]).collect() == []
    one = spark.createDataFrame([(5,)], "id long")
    assert [tuple(r) for r in R.with_position(one, [R.asc("id")], start=9).collect()] == [(5, 9)]


@pytest.mark.parametrize("name", ["board_order", "sort_multi", "sort_conditional", "sort_fallback",
                                  "sort_by_aggregate", "my_vehicles", "assign_identity"])
def test_built_without_a_job_or_a_copy(spark, name):
    sc = spark.sparkContext
    df0 = QUERIES[name](spark, SF_MID)
    sc.setJobGroup("build-" + name, "")
    try:
        df = QUERIES[name](spark, SF_MID)
        jobs = sc.statusTracker().getJobIdsForGroup("build-" + name)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # reading a parquet schema is Spark's own job, one per table
    tables = len(set(df0.inputFiles()))
    assert len(jobs) <= tables, jobs
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan
    assert not re.search(r"Subquery subquery#\d+, \[id=#\d+\] AS ", plan)  # no row holds the bounds
