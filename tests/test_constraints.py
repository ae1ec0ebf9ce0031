"""The constraint compiler: every rule of the schema is broken somewhere in the staged tables
and found, each table is scanned once, and a value on a third of the rows is no hot group."""

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from parkops.operators import constraints as C
from parkops.sources import schema as S
from parkops.sources.staged import SPOILED, StagedGarage
from parkops.sources.views import Garage


def test_schema_has_all_tables_and_references():
    assert len(S.TABLES) == len(S.PRIMARY_KEYS) == 19 and len(S.FOREIGN_KEYS) == 31
    assert set(C.SCHEMA.tables()) == set(S.TABLES)


def test_every_kind_of_rule_is_broken_and_found(spark):
    got = C.violations(StagedGarage(spark, SF_MID).table)
    found = {(r.rule, r.table_name, r.column_name) for r in
             got.select("rule", "table_name", "column_name").distinct().collect()}
    assert {("unique", "users", "uni_id"), ("unique", "vehicle", "license_plate"),
            ("unique", "service_request", "request_id"), ("unique", "gates", "gate_id"),
            ("unique", "requests", "user_id,report_id")} <= found
    assert {("not_null", "users", "uni_id"), ("not_null", "users", "name"),
            ("not_null", "vehicle", "license_plate")} <= found
    assert {("domain", "users", "user_type"), ("domain", "service_request", "payment_method"),
            ("domain", "service_request", "payment_status")} <= found
    assert {("max_length", "users", "phone"), ("max_length", "vehicle", "color")} <= found
    assert {("foreign_key", "vehicle", "user_id"), ("foreign_key", "payment", "method_id"),
            ("foreign_key", "payment", "invoice_id"), ("foreign_key", "gates", "garage_id"),
            ("foreign_key", "log_record", "gate_id"), ("foreign_key", "requests", "report_id"),
            ("foreign_key", "service_request", "spot_id")} <= found


def test_one_scan_per_table_and_one_shuffle(spark):
    reads = []

    def table(name):
        reads.append(name)
        return Garage(spark, SF_SMALL).table(name)

    plan = C.violations(table)._jdf.queryExecution().executedPlan().toString()
    assert sorted(reads) == sorted(S.TABLES)
    literal = 2  # the catalogue and the payment methods are literal rows
    assert plan.count("FileScan parquet") == len(S.TABLES) - literal
    # the payment view numbers its rows by a window of its own
    assert plan.count("Exchange hashpartitioning(domain") == 1 and plan.count("Exchange ") == 2
    assert "Join" not in plan


def test_sound_tables_break_nothing_but_the_status_list(spark):
    rows = C.violations(Garage(spark, SF_SMALL).table).collect()
    assert {(r.rule, r.column_name) for r in rows} == {("domain", "status")}


def test_null_and_empty_keys_are_different_values(spark):
    users = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "a"), (5, "a"), (6, "a")],
                                  "user_id long, uni_id string")
    got = {(r.value, r.n) for r in C.violations(
        lambda t: users, C.Rules(keys=[("users", ("uni_id",))])).collect()}
    assert got == {("", 2), ("a", 3)}


def test_hot_value_is_counted_before_the_shuffle(spark):
    child = spark.range(0, 9000, 1, 6).select(
        F.col("id").alias("vehicle_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("user_id"))
    users = spark.range(0, 100).select(F.col("id").alias("user_id"))
    tables = {"vehicle": child, "users": users}
    got = C.violations(tables.__getitem__, C.Rules(references=[("vehicle", "user_id", "users", "user_id")]))
    rows = got.collect()
    assert len(rows) == 9000 - 3000 - sum(1 for i in range(100) if i % 3)
    assert sum(r.n for r in rows) == len(rows)
    assert "partial_sum" in got._jdf.queryExecution().executedPlan().toString()


def test_spoiled_tables_keep_their_columns(spark):
    g, s = Garage(spark, SF_SMALL), StagedGarage(spark, SF_SMALL)
    for name in SPOILED:
        assert g.table(name).dtypes == s.table(name).dtypes[:len(g.table(name).dtypes)]
        assert g.table(name).count() == s.table(name).count()
