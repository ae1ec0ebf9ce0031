"""The easy-to-get-wrong semantics, on small hand-made tables."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from parkops.functions import text as T
from parkops.operators import billing as BL
from parkops.operators import boards as B
from parkops.operators import decisions as D
from parkops.operators import purge as P
from parkops.operators import reports as R
from parkops.operators import tables as TB
from parkops.operators.ranking import asc, desc, position_in_group, top_k_per_group, with_position

TS = dt.datetime(2024, 1, 1, 8, 0, 0)


def _veh(spark, rows):
    return spark.createDataFrame(rows, "vehicle_id long, license_plate string, user_id long")


def test_not_in_with_null_empties_result(spark):
    v = _veh(spark, [(1, "A", 1), (2, "B", 1), (3, "C", 2)])
    reqs = spark.createDataFrame([(10, 1), (11, None)], "request_id long, vehicle_id long")
    assert R.never_used_not_in(v, reqs).count() == 0
    assert sorted(r[0] for r in R.never_used_anti(v, reqs).collect()) == ["B", "C"]
    reqs2 = spark.createDataFrame([(10, 1)], "request_id long, vehicle_id long")
    assert sorted(r[0] for r in R.never_used_not_in(v, reqs2).collect()) == ["B", "C"]
    # empty subquery: every row, a NULL id included; non-empty: a NULL id never qualifies
    vn = _veh(spark, [(1, "A", 1), (None, "N", 1)])
    assert sorted(r[0] for r in R.never_used_not_in(vn, reqs2.limit(0)).collect()) == ["A", "N"]
    assert sorted(r[0] for r in R.never_used_not_in(vn, reqs2.filter("vehicle_id = 5")
                                                    .union(spark.createDataFrame(
                                                        [(11, 2)], reqs2.schema))).collect()) == ["A"]


def test_count_col_after_left_join_is_zero(spark):
    g = spark.createDataFrame([(1, "G1", True, "Open"), (2, "G2", True, None)],
                              "garage_id long, name string, garage_access boolean, garage_status string")
    s = spark.createDataFrame([(1, "S1", "Available", 1), (2, "S2", "available", 1)],
                              "spot_id long, spot_number string, spot_status string, garage_id long")
    got = {r.garage_id: (r.garage_status, r.total_spots, r.available_spots)
           for r in B.garage_occupancy(g, s).collect()}
    # exact 'Available' only; empty garage keeps 0; NULL status reads 'Open'
    assert got == {1: ("Open", 2, 1), 2: ("Open", 0, 0)}
    # B9 folds case: both spots of the open garage are available
    assert B.available_spots(s, g).count() == 2


def test_group_by_name_merges_equal_names(spark):
    g = spark.createDataFrame([(1, "Same"), (2, "Same")], "garage_id long, name string")
    s = spark.createDataFrame([(1, 1), (2, 2)], "spot_id long, garage_id long")
    r = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "request_id long, spot_id long")
    assert [(x.garage_name, x.total_service_requests)
            for x in R.requests_by_garage(g, s, r).collect()] == [("Same", 3)]


def test_status_domain_drops_unknown_and_null(spark):
    reqs = spark.createDataFrame([("Pending",), ("Cancelled",), (None,), ("Pending",)], "status string")
    regs = spark.createDataFrame([("Approved",)], "status string")
    got = {r.status: r["count"] for r in B.status_counts(reqs, regs).collect()}
    assert got == {"Pending": 2, "Approved": 1, "Rejected": 0}
    m = {r.status: r["count"] for r in B.status_counts_map(B.status_counts(reqs, regs)).collect()}
    assert m == got


def test_positions_are_dense_and_total(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("g"), F.col("id"))
    pos = with_position(df, [asc("g"), desc("id")])
    rows = pos.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 1001))
    assert [(r.g, r.id) for r in rows] == sorted(((r.g, r.id) for r in rows),
                                                 key=lambda t: (t[0], -t[1]))
    pig = position_in_group(df, ["g"], [asc("id")])
    for r in pig.filter("g = 3").collect():
        assert r.pos == (r.id - 3) // 7 + 1


def test_hot_group_positions(spark):
    # one key holds most rows: positions still dense inside the group
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5)
                                     .alias("g"), F.col("id"))
    pig = position_in_group(df, ["g"], [desc("id")])
    hot = pig.filter("g = 0").agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()
    n0 = df.filter("g = 0").count()
    assert tuple(hot) == (1, n0, n0)


def test_top_k_per_group_plan_has_group_limit(spark):
    df = spark.range(0, 100).select((F.col("id") % 3).alias("g"), "id")
    out = top_k_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert out.count() == 6
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_latest_decision_wins_and_approval_side_effects_stay(spark):
    reqs = spark.createDataFrame(
        [(1, 7, 70, "Pending", None, None), (2, 8, None, "Pending", None, None)],
        "request_id long, vehicle_id long, spot_id long, status string, approved_by long, "
        "completed_at timestamp_ntz")
    dec = spark.createDataFrame(
        [(1, "approve", 5, TS), (1, "reject", 6, TS + dt.timedelta(days=1)), (2, "reject", 5, TS)],
        "request_id long, action string, decided_by long, decided_at timestamp_ntz")
    out = {r.request_id: (r.status, r.approved_by) for r in
           D.request_decisions_requests(reqs, dec).collect()}
    assert out == {1: ("Rejected", 6), 2: ("Rejected", 5)}
    veh = spark.createDataFrame([(7, None, None), (8, False, None)],
                                "vehicle_id long, access_status boolean, approved_by long")
    v = {r.vehicle_id: (r.access_status, r.approved_by)
         for r in D.request_decisions_vehicles(veh, reqs, dec).collect()}
    assert v == {7: (True, 5), 8: (False, None)}  # the later reject reverts nothing
    spots = spark.createDataFrame([(70, "Available")], "spot_id long, spot_status string")
    assert D.request_decisions_spots(spots, reqs, dec).first().spot_status == "Reserved"
    # applying the same decisions again changes nothing more
    once = D.request_decisions_requests(reqs, dec)
    twice = D.request_decisions_requests(once, dec)
    assert sorted(once.collect()) == sorted(twice.collect())
    # an empty decision table changes nothing
    assert sorted(D.request_decisions_requests(reqs, dec.limit(0)).collect()) == sorted(reqs.collect())


def test_duplicate_plate_approval_changes_nothing(spark):
    regs = spark.createDataFrame(
        [(1, 1, "TAKEN", "red", "m"), (2, 2, "NEW", "red", "m"), (3, 3, "NEW", "blue", "m")],
        "request_id long, user_id long, license_plate string, color string, model string")
    regs = regs.withColumn("status", F.lit("Pending")).withColumn("approved_by", F.lit(None).cast("long")) \
        .withColumn("created_at", F.lit(TS).cast("timestamp_ntz")) \
        .withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    veh = spark.createDataFrame([(10, "TAKEN", "x", 9, "m", True, 1, TS)],
                                "vehicle_id long, license_plate string, color string, user_id long, "
                                "model string, access_status boolean, approved_by long, "
                                "created_at timestamp_ntz")
    dec = spark.createDataFrame([(1, "approve", 4, TS), (2, "approve", 4, TS),
                                 (3, "approve", 4, TS + dt.timedelta(hours=1))],
                                "request_id long, action string, decided_by long, decided_at timestamp_ntz")
    st = {r.request_id: r.status for r in
          D.registration_decisions_registrations(regs, veh, dec).collect()}
    assert st == {1: "Pending", 2: "Approved", 3: "Pending"}
    new = D.registration_decisions_vehicles(regs, veh, dec).filter("vehicle_id > 10").collect()
    assert [(r.vehicle_id, r.license_plate, r.user_id) for r in new] == [(11, "NEW", 2)]


def test_payment_amount_is_current_price_and_first_payment_wins(spark):
    reqs = spark.createDataFrame(
        [(1, 5, 1, "Approved", "Pending", "1"), (2, 5, 2, "Approved", "Pending", "2"),
         (3, 5, 1, "Pending", "Pending", "3")],
        "request_id long, user_id long, service_id long, status string, payment_status string, "
        "receipt_id string")
    st = spark.createDataFrame([(1, Decimal("99.00")), (2, None)], "service_id long, price decimal(10,2)")
    pin = spark.createDataFrame(
        [(1, 5, "Cash", None, None, None, None, TS),
         (1, 5, "Cash", None, None, None, None, TS + dt.timedelta(days=1)),
         (2, 5, "Credit", "4111111111111111", "123", "12/27", "Ann", TS),
         (3, 5, "Cash", None, None, None, None, TS)],
        "request_id long, user_id long, method string, card_number string, card_cvv string, "
        "card_expiry string, cardholder_name string, paid_at timestamp_ntz")
    inv = spark.createDataFrame([(100, 1, Decimal("50.00"), None, None, "100")],
                                "invoice_id long, request_id long, amount decimal(10,2), "
                                "date_issued date, time_issued string, receipt_id string")
    meth = spark.createDataFrame([(1, "Cash", "x")], "method_id long, method_type string, payment_info string")
    pay = spark.createDataFrame([(7, 100, Decimal("1.00"), None, None, "Paid", 1)],
                                "payment_id long, invoice_id long, amount decimal(10,2), date_paid date, "
                                "time_paid string, status string, method_id long")
    args = (pin, reqs, inv, st, meth, pay)
    new = BL.apply_payments_payments(*args).filter("payment_id > 7").orderBy("payment_id").collect()
    assert [(r.invoice_id, r.amount) for r in new] == [(100, Decimal("99.00")), (101, None)]
    m = BL.apply_payments_methods(*args).filter("method_id > 1").orderBy("method_id").collect()
    assert m[1].payment_info == "Card: ****1111, Exp: 12/27, Holder: Ann"
    r = {x.request_id: (x.payment_status, x.receipt_id) for x in BL.apply_payments_requests(*args).collect()}
    assert r == {1: ("Paid", "100"), 2: ("Paid", "101"), 3: ("Pending", "3")}


def test_card_rules_first_failure_wins(spark):
    df = spark.createDataFrame(
        [("1", "4111111111111111", "123", "12/27", "A"), ("2", "411111111111", "12", "1/25", "A"),
         ("3", "4111111111111111", "12", "1/25", "A"), ("4", "4111111111111111", "123", "99/99", " "),
         ("5", "4111111111111111", "123", "1/25", "A"), ("6", "4111111111111111", "123", "99/99", "A")],
        "id string, n string, v string, e string, h string")
    got = {r.id: r.reason for r in df.select("id", BL.Q.card_reason(
        F.col("n"), F.col("v"), F.col("e"), F.col("h")).alias("reason")).collect()}
    assert got == {"1": None, "2": "card_number_length", "3": "cvv_length", "4": "missing_field",
                   "5": "expiry_format", "6": None}


def test_text_functions(spark):
    df = spark.createDataFrame([(" \tab\n", "é", None, "0")], "a string, b string, c string, d string")
    r = df.select(T.trim_app("a").alias("t"), T.byte_length("b").alias("n"),
                  T.is_blank("c").alias("bc"), T.is_blank("d").alias("bd"),
                  T.ucfirst(F.lit("mIxed")).alias("u"), T.initial(F.lit("zed")).alias("i"),
                  T.valid_phone(F.lit("010-1234 5678")).alias("p"),
                  T.card_number_input(F.lit("4111-1111 1111 1111")).alias("g")).first()
    assert (r.t, r.n, r.bc, r.bd, r.u, r.i, r.p, r.g) == (
        "ab", 2, True, True, "MIxed", "Z", True, "4111 -111 1111 1111 1")  # only white space goes


def test_row_search_is_literal_and_case_insensitive(spark):
    df = spark.createDataFrame([("A_b",), ("axb",), (None,)], "x string")
    assert [r.x for r in B.row_search(df, "a_B", ["x"]).collect()] == ["A_b"]
    assert B.row_search(df, "", ["x"]).count() == 3


def test_ensure_column_and_defaults(spark):
    df = spark.createDataFrame([(1, None)], "id long, s string")
    assert TB.ensure_column(df, "s", "string", "Open").first().s is None
    assert TB.ensure_column(df, "s", "string", "Open", backfill=True).first().s == "Open"
    assert TB.ensure_column(df, "z", "string", "Open", backfill=True).first().z == "Open"
    assert TB.default_fill(df, {"s": F.lit("d")}).first().s == "d"


def test_sort_fallback_without_created_at(spark):
    df = spark.createDataFrame([(1,), (3,), (2,)], "user_id long")
    assert [r.user_id for r in B.sort_fallback(df).orderBy("pos").collect()] == [3, 2, 1]


def test_purge_blocks_managers_self_and_used_vehicles(garage):
    g = garage
    p = P.plan_purge(g.purge_ids, 10, g.users, g.vehicle, g.service_request, g.invoice,
                     g.log_record, g.reports, g.requests, g.owns)
    blocked = {r.user_id: r.reason for r in p.blocked.collect()}
    managers = {r.user_id for r in g.users.filter("user_type = 'Manager' AND user_id % 10 = 0")
                .collect()}
    assert managers and managers <= set(blocked)
    assert blocked.get(10) in ("manager", "self")  # the acting user
    purged = {r.user_id for r in p.users.collect()}
    assert not (purged & set(blocked))
    # no purged user's request survives, and nothing points at a purged user
    after = P.purge_apply(p, "service_request", g.service_request)
    assert after.join(p.users, "user_id", "left_semi").count() == 0
    assert after.join(p.users.withColumnRenamed("user_id", "approved_by"), "approved_by",
                      "left_semi").count() == 0


def test_cascade_is_all_or_nothing(garage):
    g = garage
    c = P.plan_cascade(g.purge_plates, g.vehicle, g.service_request, g.invoice, g.log_record, g.owns)
    blocked = {r.license_plate for r in c.blocked.collect()}
    deleted = {r.vehicle_id for r in c.vehicles.collect()}
    assert blocked and deleted  # both kinds occur at sf0.01
    # nothing of a blocked vehicle is deleted
    bv = g.vehicle.filter(F.col("license_plate").isin(*blocked)).select("vehicle_id")
    breqs = g.service_request.join(bv, "vehicle_id", "left_semi").select("request_id")
    assert c.requests.join(breqs, "request_id", "left_semi").count() == 0
    # no surviving log or ownership row points at a deleted vehicle or request
    for ref in (g.log_record, g.owns):
        assert ref.join(c.vehicles, "vehicle_id", "left_semi").count() == 0
        assert ref.join(c.requests, "request_id", "left_semi").count() == 0


def test_role_scope_admin_sees_all_student_sees_own(garage):
    g = garage
    rows = g.service_request.select("request_id", "user_id")
    types = {r.user_id: r.user_type for r in g.users.filter("user_id IN (0, 4)").collect()}
    assert types == {0: "Admin", 4: "Student"}  # at sf0.01
    assert B.role_scope(rows, g.users, 0).count() == rows.count()
    own = B.role_scope(rows, g.users, 4)
    assert own.count() == rows.filter("user_id = 4").count() > 0
    assert B.role_scope(rows, g.users, 10**9).count() == 0  # unknown viewer sees nothing


def test_purge_only_students_staff_admins(garage):
    g = garage
    users = g.users.withColumn("user_type", F.when(F.col("user_id") == 20, F.lit("Stafff"))
                               .otherwise(F.col("user_type")))
    p = P.plan_purge(g.purge_ids, 1, users, g.vehicle, g.service_request, g.invoice,
                     g.log_record, g.reports, g.requests, g.owns)
    blocked = {r.user_id: r.reason for r in p.blocked.collect()}
    assert blocked[20] == "type_not_allowed"


def test_contact_rules_with_email(spark):
    from parkops.operators import quality as Q
    users = spark.createDataFrame(
        [(1, "Ann", "010-1234-5678", "ann@x.org"), (2, " ", "12", "bad@"), (3, "Bo", None, None)],
        "user_id long, name string, phone string, email string")
    got = sorted((r.user_id, r.rule) for r in Q.dq_contact_fields(users).collect())
    assert got == [(2, "email_invalid"), (2, "name_required"), (2, "phone_invalid"),
                   (3, "email_required"), (3, "phone_required")]


def test_status_labels(spark):
    df = spark.createDataFrame([("Open", True, "Pending", None), (None, None, "Approved", None),
                                ("Closed", False, "Rejected", "Mia")],
                               "g string, a boolean, s string, ap string")
    got = [(r.o, r.act, r.by) for r in df.select(
        T.open_label(F.col("g")).alias("o"), T.active_label(F.col("a")).alias("act"),
        T.decided_by_label(F.col("s"), F.col("ap")).alias("by")).collect()]
    assert got == [("Open", "Active", None), ("Open", "Inactive", "By: System"),
                   ("Closed", "Inactive", "By: Mia")]


def test_deletes_that_a_reference_would_roll_back(spark):
    veh = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "vehicle_id long, user_id long")
    reqs = spark.createDataFrame([(100, 1)], "request_id long, vehicle_id long")
    owns = spark.createDataFrame([(2, 100)], "vehicle_id long, request_id long")
    logs = spark.createDataFrame([(9, 3)], "log_id long, vehicle_id long")
    acts = spark.createDataFrame([(v, "reject", 1) for v in (1, 2, 3)],
                                 "vehicle_id long, action string, acted_by long")
    blocked = {r.vehicle_id: r.reason for r in D.reject_vehicles_blocked(veh, reqs, owns, acts).collect()}
    assert blocked == {1: "has_requests", 2: "referenced_by_owns"}
    assert sorted(r.vehicle_id for r in D.reject_vehicles_vehicles(veh, reqs, owns, acts).collect()) \
        == [1, 2, 4]  # 3 is deleted with its log
    assert D.reject_vehicles_logs(logs, veh, reqs, owns, acts).count() == 0
    dels = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10), (4, 11)],
                                 "vehicle_id long, user_id long")
    out = {(r.vehicle_id, r.user_id): r.outcome
           for r in D.delete_own_outcome(veh, reqs, logs, owns, dels).collect()}
    assert out == {(1, 10): "used", (2, 10): "referenced", (3, 10): "referenced",
                   (4, 10): "deleted", (4, 11): "not_owner"}


def test_submission_with_missing_vehicle_is_rejected(spark):
    from decimal import Decimal as Dec
    subs = spark.createDataFrame([(1, 5, 1, None, TS), (2, 99, 1, None, TS), (3, None, 7, None, TS)],
                                 "user_id long, vehicle_id long, service_id long, spot_id long, "
                                 "submitted_at timestamp_ntz")
    st = spark.createDataFrame([(1, "Wash", None, Dec("5.00"))],
                               "service_id long, service_name string, description string, "
                               "price decimal(10,2)")
    spots = spark.createDataFrame([], "spot_id long, spot_status string, garage_id long")
    garage = spark.createDataFrame([], "garage_id long, garage_status string")
    veh = spark.createDataFrame([(5,)], "vehicle_id long")
    got = {r.user_id: r.reason for r in BL.submit_requests_rejected(subs, st, spots, garage, veh).collect()}
    assert got == {2: "vehicle_missing", 3: "service_missing"}


def test_scale_conf():
    from parkops.session import scale_conf
    c = scale_conf(100 * 10**12)
    assert int(c["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert scale_conf(10**6)["spark.sql.shuffle.partitions"] == "200"


def test_new_files_are_seen(spark):
    import tempfile

    from parkops.sources import views as V
    d = tempfile.mkdtemp(prefix="parkops-new-files-")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{d}/nation.parquet")
    g = V.Garage(spark, d)
    assert g.parking_garage.count() == 25
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").limit(3).write.mode("append") \
        .parquet(f"{d}/nation.parquet")
    assert V.Garage(spark, d).parking_garage.count() == 28


def test_plate_and_contact_matches_without_pairs(spark):
    veh = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B")],
                                "vehicle_id long, license_plate string")
    edits = spark.createDataFrame([(2, "A"), (4, "A"), (4, "B"), (5, "C")],
                                  "vehicle_id long, license_plate string")
    got = sorted((r.vehicle_id, r.license_plate, r.other_vehicles)
                 for r in TB.plate_taken_by_other(edits, veh).collect())
    assert got == [(2, "A", 2), (4, "A", 3)]
    users = spark.createDataFrame([("U1", "p1"), ("U2", "p1"), ("U3", None)], "uni_id string, phone string")
    new = spark.createDataFrame([("U1", "x"), ("N1", "p1"), ("N2", None), ("U3", None)],
                                "uni_id string, phone string")
    got = sorted((r.uni_id, r.id_match, r.phone_matches)
                 for r in TB.id_or_phone_match(new, users).collect())
    assert got == [("N1", False, 2), ("U1", True, 0), ("U3", True, 0)]


def test_decisions_ignore_current_state_and_method_vocabularies(spark):
    reqs = spark.createDataFrame([(1, None, None, "Rejected", 3, TS)],
                                 "request_id long, vehicle_id long, spot_id long, status string, "
                                 "approved_by long, completed_at timestamp_ntz")
    dec = spark.createDataFrame([(1, "approve", 5, TS + dt.timedelta(days=1))],
                                "request_id long, action string, decided_by long, decided_at timestamp_ntz")
    assert D.request_decisions_requests(reqs, dec).first().status == "Approved"  # no status guard
    r2 = spark.createDataFrame([(2, 5, 1, "Approved", "Pending", "2")],
                               "request_id long, user_id long, service_id long, status string, "
                               "payment_status string, receipt_id string")
    st = spark.createDataFrame([(1, Decimal("9.00"))], "service_id long, price decimal(10,2)")
    pin = spark.createDataFrame([(2, 5, "Credit", "4111111111111111", "123", "12/27", "Ann", TS)],
                                "request_id long, user_id long, method string, card_number string, "
                                "card_cvv string, card_expiry string, cardholder_name string, "
                                "paid_at timestamp_ntz")
    inv = spark.createDataFrame([(20, 2, Decimal("9.00"), None, None, None)],
                                "invoice_id long, request_id long, amount decimal(10,2), "
                                "date_issued date, time_issued string, receipt_id string")
    meth = spark.createDataFrame([], "method_id long, method_type string, payment_info string")
    pay = spark.createDataFrame([], "payment_id long, invoice_id long, amount decimal(10,2), "
                                    "date_paid date, time_paid string, status string, method_id long")
    out = BL.apply_payments(pin, r2, inv, st, meth, pay)
    assert out["service_request"].first().payment_method == "Credit"
    assert out["payment_method"].first().method_type == "Credit Card"
    assert [(r.method_id, r.payment_id) for r in out["payment"].collect()] == [(1, 1)]


def test_approval_inserts_even_if_rejected_later(spark):
    regs = spark.createDataFrame([(1, 1, "P1", "red", "m"), (2, 2, "P1", "blue", "m")],
                                 "request_id long, user_id long, license_plate string, color string, "
                                 "model string")
    regs = regs.withColumn("status", F.lit("Pending")).withColumn("approved_by", F.lit(None).cast("long")) \
        .withColumn("created_at", F.lit(TS).cast("timestamp_ntz")) \
        .withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    veh = spark.createDataFrame([], "vehicle_id long, license_plate string, color string, user_id long, "
                                    "model string, access_status boolean, approved_by long, "
                                    "created_at timestamp_ntz")
    hour = dt.timedelta(hours=1)
    dec = spark.createDataFrame([(1, "approve", 4, TS), (1, "approve", 4, TS), (1, "reject", 5, TS + hour),
                                 (2, "approve", 4, TS + 2 * hour), (2, "reject", 4, TS)],
                                "request_id long, action string, decided_by long, decided_at timestamp_ntz")
    new = D.registration_decisions_vehicles(regs, veh, dec).collect()
    assert [(r.license_plate, r.user_id, r.created_at) for r in new] == [("P1", 1, TS)]
    st = {r.request_id: (r.status, r.completed_at) for r in
          D.registration_decisions_registrations(regs, veh, dec).collect()}
    assert st == {1: ("Rejected", TS + hour), 2: ("Rejected", TS)}


def test_two_edits_of_one_free_plate(spark):
    veh = spark.createDataFrame(
        [(i, f"P{i}", "x", i, "m", True, 1, TS) for i in (1, 2, 3)],
        "vehicle_id long, license_plate string, color string, user_id long, model string, "
        "access_status boolean, approved_by long, created_at timestamp_ntz")
    hour = dt.timedelta(hours=1)
    edits = spark.createDataFrame(
        [(1, 1, " FREE ", "c", "m", TS + hour), (2, 2, "FREE", "c", "m", TS), (2, 2, "OTHER", "d", "m", TS + hour),
         (3, 3, "P1", "c", "m", TS), (3, 3, "P3", " ", "m", TS + hour), (3, 3, "P3", "new", "m", TS)],
        "vehicle_id long, user_id long, license_plate string, color string, model string, "
        "edited_at timestamp_ntz")
    got = {r.vehicle_id: (r.license_plate, r.color) for r in D.edit_vehicles(veh, edits).collect()}
    assert got == {1: ("P1", "x"), 2: ("OTHER", "d"), 3: ("P3", "new")}


def test_tied_payments_pay_once(spark):
    reqs = spark.createDataFrame([(1, 5, 1, "Approved", "Pending", "1")],
                                 "request_id long, user_id long, service_id long, status string, "
                                 "payment_status string, receipt_id string")
    st = spark.createDataFrame([(1, Decimal("9.00"))], "service_id long, price decimal(10,2)")
    pin = spark.createDataFrame([(1, 5, "Cash", None, None, None, None, TS)] * 3,
                                "request_id long, user_id long, method string, card_number string, "
                                "card_cvv string, card_expiry string, cardholder_name string, "
                                "paid_at timestamp_ntz")
    inv = spark.createDataFrame([], "invoice_id long, request_id long, amount decimal(10,2), "
                                    "date_issued date, time_issued string, receipt_id string")
    meth = spark.createDataFrame([], "method_id long, method_type string, payment_info string")
    pay = spark.createDataFrame([], "payment_id long, invoice_id long, amount decimal(10,2), "
                                    "date_paid date, time_paid string, status string, method_id long")
    out = BL.apply_payments(pin, reqs, inv, st, meth, pay)
    assert {k: v.count() for k, v in out.items()} == {
        "service_request": 1, "invoice": 1, "payment_method": 1, "payment": 1}


def test_refused_registration_blocks_nobody(spark):
    regs = spark.createDataFrame([], "request_id long, user_id long, license_plate string, color string, "
                                     "model string, status string, approved_by long, "
                                     "created_at timestamp_ntz, completed_at timestamp_ntz")
    veh = spark.createDataFrame([], "license_plate string")
    later = TS + dt.timedelta(hours=1)
    rin = spark.createDataFrame([(1, "A", " ", "m", TS)] + [(2, "A", "red", "m", later)] * 2
                                + [(3, None, "red", "m", TS)],
                                "user_id long, license_plate string, color string, model string, "
                                "submitted_at timestamp_ntz")
    new = BL.submit_registrations_registrations(rin, veh, regs).collect()
    assert [(r.request_id, r.user_id, r.license_plate) for r in new] == [(1, 2, "A")]
    bad = {(r.user_id, r.reason, r.copies) for r in
           BL.submit_registrations_rejected(rin, veh, regs).collect()}
    assert bad == {(1, "missing_field", 1), (2, "already_pending", 1), (3, "missing_field", 1)}


def test_refused_signup_blocks_nobody(spark):
    users = spark.createDataFrame([(7, "u0", "n", "p0", "Student", None, TS)],
                                  "user_id long, uni_id string, name string, phone string, "
                                  "user_type string, access_status boolean, created_at timestamp_ntz")
    at = [TS + dt.timedelta(hours=i) for i in range(8)]
    rows = [("a", "n", "p1", "Stafff", at[0]), ("A", "n", "p1", "Staff", at[1]),
            ("b", "n", "p1", "Staff", at[2]), ("b", "n", "p3", "Staff", at[3]),
            ("a", "n", "p4", "Staff", at[4]), ("c", "n", "p4", None, at[5]),
            ("d", "n", "p4", "Staff", at[6]), ("d", "n", "p4", "Staff", at[6]),
            ("U0", "n", None, "Staff", at[7]), ("e", "n", None, "Staff", at[7]), ("f", "n", None, "Staff", at[7])]
    new = spark.createDataFrame(rows, "uni_id string, name string, phone string, user_type string, "
                                      "submitted_at timestamp_ntz")
    got = sorted((r.user_id, r.uni_id, r.phone) for r in
                 BL.register_users_users(new, users).filter("user_id > 7").collect())
    assert got == [(8, "A", "p1"), (9, "b", "p3"), (10, "d", "p4"), (11, "e", None), (12, "f", None)]
    bad = sorted((r.submitted_at, r.uni_id, r.reason, r.copies) for r in
                 BL.register_users_rejected(new, users).collect())
    assert bad == [(at[0], "a", "invalid_type", 1), (at[2], "b", "phone_taken", 1),
                   (at[4], "a", "uni_id_taken", 1), (at[5], "c", "invalid_type", 1),
                   (at[6], "d", "uni_id_taken", 1), (at[7], "U0", "uni_id_taken", 1)]
