"""Deletions along references: lazy, equal to deleting row by row, whole rows shuffled once."""

import random

import pytest

from conftest import SF_SMALL
from parkops.operators import purge as P
from parkops.operators.cascade import Deletion
from parkops.plans.registry import QUERIES
from parkops.sources import schema as S
from parkops.sources.views import Garage

OUTPUTS = sorted(k for k in QUERIES if k.startswith(("purge_users__", "delete_vehicle_cascade__")))


@pytest.mark.parametrize("name", OUTPUTS)
def test_building_an_output_starts_no_job(spark, name):
    QUERIES[name](spark, SF_SMALL)  # footers are read once
    g = Garage(spark, SF_SMALL)
    for t in S.TABLES + ("purge_ids", "purge_plates"):
        g.table(t)
    sc = spark.sparkContext
    plan = P.plan_purge(g.purge_ids, 1, g.users, g.vehicle, g.service_request, g.invoice, g.log_record,
                        g.reports, g.requests, g.owns) if name.startswith("purge") else \
        P.plan_cascade(g.purge_plates, g.vehicle, g.service_request, g.invoice, g.log_record, g.owns)
    sc.setJobGroup("lazy-" + name, "")
    try:
        for t in (P.PURGE_TABLES if name.startswith("purge") else P.CASCADE_TABLES):
            plan.plan.table(t, g.table(t))
        jobs = sc.statusTracker().getJobIdsForGroup("lazy-" + name)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def rows_by_row(tables, keys, deletes, nullifies, start):
    """Delete row by row until nothing changes."""
    gone = {t: set() for t in tables}
    gone[start] = set(keys)
    todo = [(start, k) for k in keys]
    while todo:
        parent, key = todo.pop()
        for child, col, of, _ in S.FOREIGN_KEYS:
            if of == parent and (child, col) in deletes and child in tables:
                for r in tables[child]:
                    pk = r[S.PRIMARY_KEYS[child][0]]
                    if r[col] == key and pk not in gone[child]:
                        gone[child].add(pk)
                        todo.append((child, pk))
    out = {}
    for t, rows in tables.items():
        kept = [dict(r) for r in rows if r[S.PRIMARY_KEYS[t][0]] not in gone[t]]
        for child, col, of, _ in S.FOREIGN_KEYS:
            if child == t and (child, col) in nullifies and of in gone:
                for r in kept:
                    if r[col] in gone[of]:
                        r[col] = None
        out[t] = kept
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_deleting_row_by_row(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(n)])
    tables = {
        "users": [{"user_id": i} for i in range(8)],
        "vehicle": [{"vehicle_id": i, "user_id": pick(8), "approved_by": pick(8)} for i in range(12)],
        "service_request": [{"request_id": i, "user_id": pick(8), "vehicle_id": pick(12),
                             "approved_by": pick(8)} for i in range(25)],
        "invoice": [{"invoice_id": i, "request_id": pick(25)} for i in range(25)],
        "payment": [{"payment_id": i, "invoice_id": pick(25)} for i in range(40)],
        "log_record": [{"log_id": i, "request_id": pick(25), "vehicle_id": pick(12), "user_id": pick(8)}
                       for i in range(60)]}
    dfs = {t: spark.createDataFrame([tuple(r.values()) for r in rows],
                                    ", ".join(f"{c} long" for c in rows[0])) for t, rows in tables.items()}
    keys = [1, 4]
    plan = Deletion("users", spark.createDataFrame([(k,) for k in keys], "user_id long"), dfs,
                    P.OF_USERS, P.APPROVALS)
    want = rows_by_row(tables, keys, P.OF_USERS, P.APPROVALS, "users")
    for t in tables:
        got = sorted((r.asDict() for r in plan.table(t).collect()), key=lambda r: r[S.PRIMARY_KEYS[t][0]])
        assert got == want[t], t


def test_only_needed_key_sets_are_built(spark):
    g = Garage(spark, SF_SMALL)
    p = P.plan_purge(g.purge_ids, 1, g.users, g.vehicle, g.service_request, g.invoice, g.log_record,
                     g.reports, g.requests, g.owns)
    P.purge_apply(p, "controls", g.controls)
    assert set(p.plan._keys) == {"users"}
    P.purge_apply(p, "payment", g.payment)
    assert set(p.plan._keys) == {"users", "service_request", "invoice"}


def test_whole_logs_are_shuffled_once(spark):
    g = Garage(spark, SF_SMALL)
    keys = spark.createDataFrame([(3,)], "user_id long")
    plan = Deletion("users", keys, {"users": g.users, "vehicle": g.vehicle,
                                    "service_request": g.service_request, "invoice": g.invoice}, P.OF_USERS)
    text = plan.table("log_record", g.log_record)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") - text.count("events.parquet") <= 2  # orders, part
    assert text.count("events.parquet") == 2  # the references, and the rows
