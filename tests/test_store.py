"""Tables stored bucketed on their join key join without a shuffle."""

import tempfile

from parkops.operators import reports as R
from parkops.sources import store
from parkops.sources.views import Garage

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_has_no_shuffle(spark):
    g = Garage(spark, SF)
    root = tempfile.mkdtemp(prefix="parkops-store-")
    store.save({"invoice": g.invoice, "payment": g.payment}, root, buckets=8, db="store_t1")
    inv, pay = store.table(spark, "invoice", "store_t1"), store.table(spark, "payment", "store_t1")
    old = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        joined = inv.join(pay, "invoice_id", "left")
        p = plan(joined)
        assert "SortMergeJoin" in p and "Exchange" not in p
        want = g.invoice.join(g.payment, "invoice_id", "left")
        assert sorted(joined.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old)


def test_attach_in_a_new_catalog_keeps_buckets(spark):
    g = Garage(spark, SF)
    root = tempfile.mkdtemp(prefix="parkops-store-")
    store.save({"invoice": g.invoice, "payment": g.payment}, root, buckets=8, db="store_t2")
    store.attach(spark, root, ["invoice", "payment"], buckets=8, db="store_t3")
    inv, pay = store.table(spark, "invoice", "store_t3"), store.table(spark, "payment", "store_t3")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(inv.join(pay, "invoice_id"))
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
    # a report over stored tables gives the same rows as over the views
    led = R.total_revenue(pay)
    assert led.first()[0] == R.total_revenue(g.payment).first()[0]


def test_every_query_runs_on_stored_tables(spark):
    from parkops.plans.registry import QUERIES, RAW
    g = Garage(spark, SF)
    root = tempfile.mkdtemp(prefix="parkops-store-")
    store.save_garage(g, root, buckets=4, db="store_all")
    sg = store.stored_garage(spark, "store_all", SF)
    for name in ["invoice_ledger", "garage_occupancy", "user_kpis", "purge_users__blocked",
                 "apply_payments__payments", "dq_foreign_key"]:
        got = RAW[name](sg)
        want = QUERIES[name](spark, SF)
        assert sorted(got.collect()) == sorted(want.collect()), name
