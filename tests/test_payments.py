"""Payments judged in one pass: every reason, copies, later payments of a request, and the
counters that reconcile accepted and rejected rows with the input."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from parkops.operators import billing as BL
from parkops.sources.views import Garage

TS = dt.datetime(2024, 1, 1)
CARD = ("4111111111111111", "123", "12/27", "Holder")


@pytest.fixture(scope="module")
def tables(spark):
    requests = spark.createDataFrame(
        [(1, 7, "Approved", "Pending", 1), (2, 7, "Pending", "Pending", 1), (3, 7, "Approved", "Paid", 1),
         (4, 8, "Approved", None, 2)],
        "request_id long, user_id long, status string, payment_status string, service_id long")
    services = spark.createDataFrame([(1, "a", "", Decimal("5.00")), (2, "b", "", None)],
                                     "service_id long, service_name string, description string, "
                                     "price decimal(10,2)")
    at = [TS + dt.timedelta(hours=i) for i in range(6)]
    none = (None,) * 4
    rows = [(1, 7, "Credit", "41", "123", "12/27", "H", at[0]), (1, 7, "Credit", *CARD, at[1]),
            (1, 7, "Credit", *CARD, at[1]), (1, 7, "Cash", *none, at[2]), (1, 8, "Cash", *none, at[0]),
            (2, 7, "Cash", *none, at[0]), (3, 7, "Cash", *none, at[0]), (4, 8, "Cheque", *none, at[0]),
            (4, 8, None, *none, at[0]), (4, 8, "Credit", CARD[0], "12", CARD[2], CARD[3], at[0]),
            (4, 8, "Credit", CARD[0], CARD[1], "1/27", CARD[3], at[0]),
            (4, 8, "Credit", CARD[0], CARD[1], CARD[2], " ", at[0]), (9, 9, "Cash", *none, at[0]),
            (None, None, None, *none, None)]
    pay = spark.createDataFrame(rows, "request_id long, user_id long, method string, card_number string, "
                                "card_cvv string, card_expiry string, cardholder_name string, "
                                "paid_at timestamp_ntz").repartition(3)
    return pay, requests, services, at


def test_reasons_and_copies(tables):
    pay, requests, services, at = tables
    got = sorted(((r.request_id, r.user_id, r.reason, r.copies) for r in
                  BL.apply_payments_rejected(pay, requests, services).collect()), key=str)
    assert got == sorted([
        (1, 7, "card_number_length", 1), (1, 7, "already_paid", 1), (1, 7, "already_paid", 1),
        (1, 8, "request_not_found", 1), (2, 7, "not_approved", 1), (3, 7, "already_paid", 1),
        (4, 8, "no_method", 1), (4, 8, "no_method", 1), (4, 8, "cvv_length", 1),
        (4, 8, "expiry_format", 1), (4, 8, "missing_field", 1), (9, 9, "request_not_found", 1),
        (None, None, "request_not_found", 1)], key=str)


def test_counts_reconcile(tables):
    pay, requests, services, _ = tables
    judged = BL.reconciled(pay, lambda p: BL.judge_payments(p, requests, services))
    assert judged.counts == {"input": 14, "accepted": 1, "rejected": 13}
    won = judged.rows.filter("reason is null").collect()
    assert [(r.request_id, r.amount, r._n) for r in won] == [(1, Decimal("5.00"), 2)]


def test_a_lost_row_is_an_error(tables):
    pay, requests, services, _ = tables
    with pytest.raises(RuntimeError, match="14 rows went in"):
        BL.reconciled(pay, lambda p: BL.judge_payments(p, requests, services).filter("request_id > 1"))


def test_accepted_and_rejected_are_the_whole_batch(spark):
    g = Garage(spark, SF_SMALL)
    judged = BL.reconciled(g.payments_in, lambda p: BL.judge_payments(p, g.service_request, g.service_type))
    rejected = BL.rejected_copies(judged.rows, "already_paid").agg(F.sum("copies")).first()[0]
    assert judged.counts["input"] == g.raw("orders").count()
    assert judged.counts["rejected"] == rejected
