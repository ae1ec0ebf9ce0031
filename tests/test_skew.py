"""A third of all requests on one user: results stay exact (checked against a
pandas brute force) and the skewed join partition is split by AQE."""

from pyspark.sql import functions as F

from parkops.operators import boards as B
from parkops.sources.views import Garage

SF = "/root/testdata/sf0.01"
HOT = 7


def hot_requests(g):
    return g.service_request.withColumn(
        "user_id", F.when(F.col("request_id") % 3 == 0, F.lit(HOT).cast("long"))
        .otherwise(F.col("user_id")))


def test_hot_user_counts_exact(spark):
    g = Garage(spark, SF)
    reqs = hot_requests(g)
    got = {r.user_id: r.request_count for r in
           B.user_activity(g.users, g.vehicle, reqs).select("user_id", "request_count").collect()}
    pdf = reqs.select("user_id").toPandas()
    want = pdf.groupby("user_id").size().to_dict()
    assert got[HOT] == want[HOT] >= reqs.count() // 3
    assert all(got[u] == want.get(u, 0) for u in got)


def test_hot_user_top10_exact(spark):
    g = Garage(spark, SF)
    reqs = hot_requests(g)
    uni = B.user_requests_unified(B.user_requests(reqs, g.service_type, g.vehicle, g.parking_spots),
                                  g.registrations)
    top = B.recent_requests(uni).filter(F.col("user_id") == HOT).orderBy("rn").collect()
    pdf = uni.filter(F.col("user_id") == HOT).select("request_type", "request_id", "created_at") \
        .toPandas()
    pdf["sec"] = pdf["created_at"].dt.floor("s")
    pdf["neg_id"] = -pdf["request_id"]
    want = pdf.sort_values(["sec", "request_type", "neg_id"], ascending=[False, True, True]).head(10)
    assert [(r.request_type, r.request_id) for r in top] == \
        list(zip(want["request_type"], want["request_id"]))


def test_skewed_join_partition_is_split(spark):
    g = Garage(spark, SF)
    reqs = hot_requests(g)
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        # AQE splits a skewed reducer partition along map outputs: spread the
        # single small input file over several map tasks, as a large table is.
        board = reqs.repartition(16).join(g.users.select("user_id", "name"), "user_id")
        n = len(board.collect())  # runs this DataFrame's own (adaptive) execution
        plan = board._jdf.queryExecution().executedPlan().toString()
        assert n == reqs.filter(F.col("user_id").isNotNull()).join(
            g.users.select("user_id"), "user_id", "left_semi").count()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
