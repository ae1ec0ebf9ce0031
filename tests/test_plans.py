"""Physical-plan checks: no Cartesian product, nested-loop joins only against
one-row sides, no Python in any plan, pruned and filtered parquet scans."""

import pytest

from conftest import SF_SMALL
from parkops.plans.registry import QUERIES

# no query needs a nested-loop join (one-row sides are expressed as EXISTS
# filters or unions instead)
ONE_ROW_NLJ: set[str] = set()
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonRDD", "applySchemaToPythonRDD")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    if name not in ONE_ROW_NLJ:
        assert "BroadcastNestedLoopJoin" not in p, name
    for node in PYTHON_NODES:
        assert node not in p, (name, node)


def test_column_pruning_reaches_the_scan(spark):
    p = plan(QUERIES["invoice_ledger"](spark, SF_SMALL))
    assert ("ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,"
            "l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>") in \
        QUERIES["invoice_ledger"](spark, SF_SMALL)._jdf.queryExecution().toString() or \
        "l_quantity" not in p
    assert "l_quantity" not in p and "l_discount" not in p and "c_acctbal" not in p


def test_filter_pushdown_reaches_the_scan(spark):
    from parkops.sources.views import Garage
    p = plan(Garage(spark, SF_SMALL).reports)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p


def test_payment_view_reads_all_rows_without_a_shuffle(spark):
    from parkops.sources.views import Garage
    g = Garage(spark, SF_SMALL)
    assert g.payment.count() == g.raw("lineitem").count()
    assert "Exchange" not in plan(g.payment.drop("payment_id"))


def test_payment_methods_carry_no_broadcast_hint(spark):
    from parkops.operators import reports
    from parkops.sources.views import Garage
    methods = spark.range(1000).selectExpr("id as method_id", "'Cash' as method_type",
                                           "'x' as payment_info")
    q = reports.payments_by_method(Garage(spark, SF_SMALL).payment, methods)
    assert "hint" not in q._jdf.queryExecution().analyzed().toString().lower()
    assert "SortMergeJoin" in q._jdf.queryExecution().sparkPlan().toString()


def test_not_in_is_an_equi_anti_join(spark):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(QUERIES["never_used_not_in"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
    assert "LeftAnti" in p and "BroadcastNestedLoopJoin" not in p
    assert "isNullAwareAntiJoin=true" not in p


def _windows(node, out):
    """Collect (partitionSpec empty?, orderSpec text) of every Window node."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _windows(node.inputPlan(), out)
    if name == "Window":
        out.append((node.partitionSpec().isEmpty(), node.orderSpec().toString()))
    kids = node.children()
    for i in range(kids.size()):
        _windows(kids.apply(i), out)
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_single_partition_window(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    wins = _windows(df._jdf.queryExecution().executedPlan(), [])
    for unpartitioned, order in wins:
        # the only unpartitioned window adds up the counts of the buckets
        assert not unpartitioned or "_pos_bucket" in order, (name, order)


def test_ledger_shuffles_payments_by_invoice_once(spark):
    p = plan(QUERIES["invoice_ledger"](spark, SF_SMALL))
    shuffled = [x.split(", 200)")[0] for x in p.split("Exchange hashpartitioning(")[1:]]
    names = [x.split("#")[0] for x in shuffled]
    # rows with their payments are shuffled by method and by the sort only; a payment's place and
    # its join by invoice share a shuffle (the other one is the invoices')
    assert names[:2] == ["method_id", "invoice_id"], names
    assert names.count("invoice_id") == 2 and not any("l_linenumber" in x.split(")")[0] for x in shuffled)


def test_payment_ids_count_the_rows_of_a_pair(spark):
    from parkops.sources import views
    rows = [(k, n, price, d, "F", f) for k in (1, 2, None) for n in (1, 2, None)
            for price, d, f in ((5.0, "2020-01-02", "A"), (5.0, "2020-01-01", "N"), (None, "2020-01-03", "R"),
                                (5.0, "2020-01-02", "A"))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, "
                                  "d string, l_linestatus string, l_returnflag string").selectExpr(
        "*", "cast(d as timestamp_ntz) as l_shipdate").drop("d")
    got = [(r.payment_id, r.invoice_id) for r in views.payment(lines).collect()]
    known = sorted(x for x, _ in got if x is not None)
    assert known == sorted((k * 8 + n) * 1000 + i for k in (1, 2) for n in (1, 2) for i in (1, 2, 3, 4))
    assert len(got) == len(rows) and sum(x is None for x, _ in got) == len(rows) - len(known)
    first = {r.payment_id: (r.amount, str(r.date_paid)) for r in views.payment(lines).collect()}
    assert first[9001] == (None, "2020-01-03") and str(first[9002][1]) == "2020-01-01"
