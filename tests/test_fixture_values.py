"""The counts FIXTURES.md records for sf0.01 (measured on the views before any
engine code existed) reproduced by the engine."""

from decimal import Decimal

from pyspark.sql import functions as F

from parkops.operators import boards as B
from parkops.operators import purge as P
from parkops.operators import reports as R


def test_reports(garage):
    g = garage
    led = R.invoice_ledger(g.invoice, g.payment, g.payment_method, g.service_request, g.users,
                           g.vehicle)
    assert led.count() == 60257
    assert led.filter(F.col("payment_id").isNotNull()).count() == 60000
    assert led.filter(F.col("vehicle_license_plate").isNotNull()).count() == 51517
    pm = {r.method_type: r.total_amount for r in R.payments_by_method(g.payment, g.payment_method).collect()}
    assert pm == {"Cash": Decimal("1056013450.83"), "Credit Card": Decimal("2127242820.80")}
    assert R.total_revenue(g.payment).first()[0] == Decimal("1585914290.14")
    byg = R.requests_by_garage(g.parking_garage, g.parking_spots, g.service_request).collect()
    assert (len(byg), sum(r[1] for r in byg), max(r[1] for r in byg)) == (23, 10591, 1146)
    assert R.requests_by_service(g.service_type, g.service_request).count() == 5
    assert R.request_spot_garage(g.service_request, g.users, g.vehicle, g.parking_spots,
                                 g.parking_garage).count() == 9086
    assert R.repeat_requesters(g.users, g.service_request).count() == 1498
    assert R.never_used_not_in(g.vehicle, g.service_request).count() == 0
    assert R.never_used_anti(g.vehicle, g.service_request).count() == 476


def test_boards(garage):
    g = garage
    occ = B.garage_occupancy(g.parking_garage, g.parking_spots).collect()
    assert (len(occ), sum(r.total_spots for r in occ), sum(r.available_spots for r in occ),
            sum(r.reserved_spots for r in occ), sum(r.total_spots == 0 for r in occ)) == (25, 94, 22, 24, 1)
    assert B.available_spots(g.parking_spots, g.parking_garage).count() == 31
    st = {r.status: r["count"] for r in g.service_request.groupBy("status").count().collect()}
    assert st == {"Approved": 4741, "Pending": 4789, "Rejected": 4892, "Cancelled": 294, None: 284}
    assert B.pending_vehicles_direct(g.vehicle, g.users).count() == 791
    ua = B.user_activity(g.users, g.vehicle, g.service_request).collect()
    assert (len(ua), sum(r.vehicle_count for r in ua), sum(r.request_count for r in ua)) == (1500, 1209, 15000)
    assert sum(r.vehicle_count == 0 for r in ua) == 472
    phones = g.users.filter(F.col("phone").isNotNull()).groupBy("phone").count().filter("count > 1")
    assert phones.count() == 507
    assert g.parking_spots.filter(F.col("garage_id").isNull()).count() == 6
    cross = g.service_request.join(g.vehicle.select("vehicle_id", F.col("user_id").alias("owner")),
                                   "vehicle_id").filter(F.col("user_id") != F.col("owner"))
    assert cross.count() == 132


def test_batch_inputs(garage):
    g = garage
    first = g.decisions.groupBy("request_id").agg(
        F.min_by("action", "decided_at").alias("action"), F.max_by("action", "decided_at").alias("last"))
    acts = {r.action: r["count"] for r in first.groupBy("action").count().collect()}
    assert acts == {"approve": 7500, "reject": 7500}
    acts = {r["last"]: r["count"] for r in first.groupBy("last").count().collect()}
    assert acts == {"approve": 3750, "reject": 11250}
    appr = first.filter("action = 'approve'").join(g.service_request, "request_id")
    assert (appr.filter(F.col("vehicle_id").isNotNull()).count(),
            appr.filter(F.col("spot_id").isNotNull()).count()) == (6428, 3750)
    from parkops.operators import quality as Q
    verdict = {r.verdict: r["count"] for r in
               Q.dq_payable(g.payments_in, g.service_request).groupBy("verdict").count().collect()}
    assert (verdict["payable"], verdict["already_paid"], verdict["not_approved"]) == (3177, 1564, 10259)
    rd = g.registration_decisions.join(g.registrations, "request_id")
    by = {r.status: r["count"] for r in rd.groupBy("status").count().collect()}
    assert by == {"Pending": 641, "Approved": 672, "Rejected": 687}
    taken = rd.join(g.vehicle.select("license_plate"), "license_plate", "left_semi").count()
    assert (rd.count() - taken, taken) == (1933, 67)
    rej = g.vehicle_actions.filter("action = 'reject'")
    free = rej.join(g.service_request.select("vehicle_id"), "vehicle_id", "left_anti")
    assert (rej.count(), free.count()) == (409, 199)


def test_purge_plates(garage):
    g = garage
    c = P.plan_cascade(g.purge_plates, g.vehicle, g.service_request, g.invoice, g.log_record, g.owns)
    assert g.purge_plates.count() == 40
    assert c.vehicles.count() == 22


def test_small_scale_values(spark):
    from parkops.sources.views import Garage
    g = Garage(spark, "/root/testdata/sf0.001")
    led = R.invoice_ledger(g.invoice, g.payment, g.payment_method, g.service_request, g.users,
                           g.vehicle)
    assert (led.count(), led.filter(F.col("payment_id").isNotNull()).count(),
            led.filter(F.col("vehicle_license_plate").isNotNull()).count()) == (6027, 6000, 5198)
    pm = {r.method_type: r.total_amount for r in R.payments_by_method(g.payment, g.payment_method).collect()}
    assert pm == {"Cash": Decimal("110429570.98"), "Credit Card": Decimal("206935186.33")}
    assert R.total_revenue(g.payment).first()[0] == Decimal("159193618.75")
    byg = R.requests_by_garage(g.parking_garage, g.parking_spots, g.service_request).collect()
    assert (len(byg), sum(r[1] for r in byg), max(r[1] for r in byg)) == (10, 1125, 123)
    assert R.request_spot_garage(g.service_request, g.users, g.vehicle, g.parking_spots,
                                 g.parking_garage).count() == 964
    assert R.repeat_requesters(g.users, g.service_request).count() == 150
    assert (R.never_used_not_in(g.vehicle, g.service_request).count(),
            R.never_used_anti(g.vehicle, g.service_request).count()) == (0, 46)
    occ = B.garage_occupancy(g.parking_garage, g.parking_spots).collect()
    assert (len(occ), sum(r.total_spots for r in occ), sum(r.available_spots for r in occ),
            sum(r.reserved_spots for r in occ), sum(r.total_spots == 0 for r in occ)) == (25, 10, 2, 3, 15)
    assert B.available_spots(g.parking_spots, g.parking_garage).count() == 4
    assert B.pending_vehicles_direct(g.vehicle, g.users).count() == 87
    ua = B.user_activity(g.users, g.vehicle, g.service_request).collect()
    assert (len(ua), sum(r.vehicle_count for r in ua), sum(r.request_count for r in ua),
            sum(r.vehicle_count == 0 for r in ua)) == (150, 113, 1500, 51)
    c = P.plan_cascade(g.purge_plates, g.vehicle, g.service_request, g.invoice, g.log_record, g.owns)
    assert (g.purge_plates.count(), c.vehicles.count()) == (4, 1)
