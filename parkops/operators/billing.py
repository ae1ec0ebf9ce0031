"""Submissions, payments and sign-ups as batch transforms (SURVEY §2 I10, I11,
I16, I17, C6).

Conflicts inside one batch, which the application never meets because it
works one row at a time, are settled by a total order: of the otherwise valid
rows the first payment of a request, the first registration of a plate and the
first sign-up of an id or phone win. A refused row blocks nobody.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parkops.functions import text as T
from parkops.operators import quality as Q
from parkops.operators.decisions import apply_updates
from parkops.operators.reports import bounded
from parkops.operators.ranking import asc
from parkops.operators.signups import copies, register_users_rejected, register_users_users  # noqa: F401
from parkops.operators.tables import assign_identities, assign_identity, default_fill
from parkops.session import cut_lineage
from parkops.sources import schema as S


# Request detail for (request, owner) pairs: the owner check is part of
# the key, so other users' requests never match.
def request_detail(board: DataFrame, keys: DataFrame) -> DataFrame:
    return board.join(keys.select("request_id", "user_id").distinct(),
                      ["request_id", "user_id"], "left_semi")


# Submit service requests. Spot validated (J8); each accepted row gives
# a Pending request and an invoice at the current price (NULL -> 0) sharing
# the receipt id = invoice id.
def _submission_check(subs: DataFrame, service_type: DataFrame, spots: DataFrame,
                      garage: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Spot rules first (checked before the insert), then the references the
    insert needs: the service and, when one is chosen, the vehicle."""
    checked = Q.spot_reasons(subs, spots, garage)
    st = bounded(service_type.select("service_id", F.col("price").alias("_price"),
                                     F.lit(True).alias("_svc")))
    known = vehicles.select("vehicle_id").distinct().withColumn("_veh", F.lit(True))
    j = checked.join(st, "service_id", "left").join(known, "vehicle_id", "left")
    return j.withColumn("reason", F.coalesce(
        F.col("reason"), F.when(F.col("_svc").isNull(), F.lit("service_missing")),
        F.when(F.col("vehicle_id").isNotNull() & F.col("_veh").isNull(), F.lit("vehicle_missing"))))


def submit_requests_rejected(subs, service_type, spots, garage, vehicles) -> DataFrame:
    return (_submission_check(subs, service_type, spots, garage, vehicles)
            .filter(F.col("reason").isNotNull()).select("user_id", "spot_id", "reason"))


def _accepted_submissions(subs, requests, invoices, service_type, spots, garage,
                          vehicles) -> DataFrame:
    ok = _submission_check(subs, service_type, spots, garage, vehicles).filter(
        F.col("reason").isNull())
    return assign_identities(ok, {"request_id": requests, "invoice_id": invoices},
                             [asc("submitted_at"), asc("user_id")])


def submit_requests_requests(subs, requests, invoices, service_type, spots, garage,
                             vehicles) -> DataFrame:
    a = _accepted_submissions(subs, requests, invoices, service_type, spots, garage, vehicles)
    return _new_requests(a, requests)


def _new_requests(a: DataFrame, requests: DataFrame) -> DataFrame:
    new = a.select("request_id", "user_id", "vehicle_id", "service_id",
                   F.lit("Pending").alias("status"), F.lit(None).cast("long").alias("approved_by"),
                   F.col("submitted_at").alias("created_at"),
                   F.lit(None).cast("timestamp_ntz").alias("completed_at"), "spot_id",
                   F.col("invoice_id").cast("string").alias("receipt_id"))
    # the declared defaults (A7) of the columns that a submission doesn't give
    new = default_fill(new, {c: F.lit(v) for c, v in S.DEFAULTS["service_request"].items()
                             if c in requests.columns})
    return requests.unionByName(new, allowMissingColumns=True)


def submit_requests_invoices(subs, requests, invoices, service_type, spots, garage,
                             vehicles) -> DataFrame:
    a = _accepted_submissions(subs, requests, invoices, service_type, spots, garage, vehicles)
    return _new_invoices(a, invoices)


def _new_invoices(a: DataFrame, invoices: DataFrame) -> DataFrame:
    new = a.select("invoice_id", "request_id",
                   F.coalesce(F.col("_price"), F.lit(0).cast(S.MONEY)).alias("amount"),
                   T.date_part("submitted_at").alias("date_issued"),
                   T.time_part("submitted_at").alias("time_issued"),
                   F.col("invoice_id").cast("string").alias("receipt_id"))
    return invoices.unionByName(new.select(*invoices.columns))


# Payments. A payment is refused when no request of the payer has its id, the request is
# not approved or already paid, or no method (with valid card fields) is chosen; the first
# valid payment of a request in the batch wins, later ones find it paid. Amount = current price.
CARD = ("card_number", "card_cvv", "card_expiry", "cardholder_name")


def judge_payments(payments_in: DataFrame, requests: DataFrame, service_type: DataFrame) -> DataFrame:
    """Distinct payments with ``_n`` copies, the ``amount`` and the ``reason`` against them (of
    copies of an accepted one, those beyond the first are refused too)."""
    r = requests.select("request_id", F.col("user_id").alias("_owner"), "status", "payment_status",
                        "service_id")
    st = bounded(service_type.select("service_id", F.col("price").alias("amount")))
    p = copies(payments_in.select("request_id", "user_id", "method", *CARD, "paid_at"))
    j = p.join(r, "request_id", "left").join(st, "service_id", "left")
    verdict = Q.payable_verdict(F.col("status"), F.col("payment_status"))
    j = j.withColumn("_own", F.coalesce(
        F.when(~F.coalesce(F.col("user_id") == F.col("_owner"), F.lit(False)), "request_not_found"),
        F.when(verdict != "payable", verdict),
        F.when(F.col("method") == "Credit", Q.card_reason(*map(F.col, CARD))),
        F.when(~F.coalesce(F.col("method").isin("Credit", "Cash"), F.lit(False)), "no_method")))
    # one winner per request by a total order
    j = j.withColumn("_at", F.struct("paid_at", "method", *CARD))
    first = j.filter(F.col("_own").isNull()).groupBy("request_id").agg(F.min("_at").alias("_first"))
    late = F.when(F.col("_own").isNull() & (F.col("_at") > F.col("_first")), "already_paid")
    return (j.join(first, "request_id", "left").withColumn("reason", F.coalesce("_own", late))
            .select(*p.columns, "amount", "reason"))


class Judged(NamedTuple):
    """rows: a batch with reasons, materialised; counts: its input, accepted and rejected rows."""

    rows: DataFrame
    counts: dict[str, int]


def reconciled(batch: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> Judged:
    """Judge a batch in one pass that also counts what goes in and what comes out, and check
    that no row was lost or made: ``judge`` gives distinct rows with ``_n`` copies and
    ``reason`` (null: one copy is accepted, the others are not)."""
    into, out = Observation(), Observation()
    taken = F.col("reason").isNull()
    judged = judge(batch.observe(into, F.count(F.lit(1)).alias("input"))).observe(
        out, F.count(F.when(taken, 1)).alias("accepted"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("judged"))
    rows = cut_lineage(judged)
    n, got = into.get["input"], out.get
    if n != got["judged"]:
        raise RuntimeError(f"{n} rows went in and {got['judged']} were judged")
    return Judged(rows, {"input": n, "accepted": got["accepted"], "rejected": n - got["accepted"]})


def rejected_copies(rows: DataFrame, reason: str) -> DataFrame:
    """The refused rows with the number of ``copies``; further copies of an accepted row are
    refused for ``reason``."""
    n = F.col("_n") - F.when(F.col("reason").isNull(), 1).otherwise(0)
    return (rows.withColumn("copies", n.cast("long")).filter("copies > 0")
            .withColumn("reason", F.coalesce("reason", F.lit(reason))))


def apply_payments_rejected(payments_in: DataFrame, requests: DataFrame,
                            service_type: DataFrame) -> DataFrame:
    judged = reconciled(payments_in, lambda p: judge_payments(p, requests, service_type))
    return rejected_copies(judged.rows, "already_paid").select(
        "request_id", "user_id", "method", "paid_at", "reason", "copies")


def _with_ids(payments_in, requests, invoices, service_type, methods, payments) -> DataFrame:
    """Accepted payments with their invoice (existing or new), method and
    payment ids. Method and payment ids share one numbering pass; only the
    payments without an invoice need a second one."""
    p = reconciled(payments_in, lambda df: judge_payments(df, requests, service_type)).rows
    p = p.filter(F.col("reason").isNull()).select("request_id", "paid_at", "method", *CARD, "amount")
    inv = (invoices.groupBy("request_id").agg(F.min("invoice_id").alias("invoice_id"))
           .join(p.select("request_id"), "request_id", "left_semi"))
    order = [asc("paid_at"), asc("request_id")]
    keys = p.select("paid_at", "request_id")
    p = assign_identities(p, {"method_id": methods, "payment_id": payments}, order, keys)
    p = p.join(inv, "request_id", "left")
    without = keys.join(inv, "request_id", "left_anti")
    have = p.filter(F.col("invoice_id").isNotNull()).withColumn("_created", F.lit(False))
    need = assign_identities(p.filter(F.col("invoice_id").isNull()).drop("invoice_id"),
                             {"invoice_id": invoices}, order, without).withColumn("_created", F.lit(True))
    return have.unionByName(need)


def _paid_requests(p: DataFrame, requests: DataFrame) -> DataFrame:
    req = requests
    for c, t in (("payment_method", "string"), ("payment_amount", "decimal(10,2)")):
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None).cast(t))
    upd = p.select("request_id", F.col("method").alias("_method"), F.col("amount").alias("_amount"),
                   F.col("invoice_id").cast("string").alias("_receipt"))
    return apply_updates(req, "request_id", upd, {
        "payment_method": F.col("_method"), "payment_amount": F.col("_amount"),
        "payment_status": F.lit("Paid"), "receipt_id": F.col("_receipt")})


def _paid_invoices(p: DataFrame, invoices: DataFrame) -> DataFrame:
    new = p.filter("_created").select(
        "invoice_id", "request_id", "amount", T.date_part("paid_at").alias("date_issued"),
        T.time_part("paid_at").alias("time_issued"),
        F.col("invoice_id").cast("string").alias("receipt_id"))
    touched = p.select("invoice_id", F.lit(True).alias("_t"))
    base = apply_updates(invoices, "invoice_id", touched,
                         {"receipt_id": F.col("invoice_id").cast("string")})
    return base.unionByName(new.select(*invoices.columns))


# Texts stored with new payment methods.
CASH_INFO = "Cash payment at service counter"


def _new_methods(p: DataFrame, methods: DataFrame) -> DataFrame:
    new = p.select("method_id",
                   F.when(F.col("method") == "Credit", F.lit("Credit Card")).otherwise(F.lit("Cash"))
                   .alias("method_type"),
                   F.when(F.col("method") == "Credit",
                          T.mask_card(T.trim_app("card_number"), T.trim_app("card_expiry"),
                                      T.trim_app("cardholder_name")))
                   .otherwise(F.lit(CASH_INFO)).alias("payment_info"))
    return methods.unionByName(new)


def _new_payments(p: DataFrame, payments: DataFrame) -> DataFrame:
    new = p.select("payment_id", "invoice_id", "amount", T.date_part("paid_at").alias("date_paid"),
                   T.time_part("paid_at").alias("time_paid"), F.lit("Paid").alias("status"),
                   "method_id")
    return payments.unionByName(new.select(*payments.columns))


# I16: vehicle registrations: required fields; plate not in Vehicle; no
# pending request for the plate; of the batch's otherwise valid ones the first
# of a plate (by time, user, colour, model) wins.
def _registration_check(regs_in: DataFrame, vehicles: DataFrame, registrations: DataFrame) -> DataFrame:
    """Distinct registrations with ``_n`` copies, the reason against them, and the
    winner of their plate (``_w``): exactly one distinct row a plate is the winner."""
    r = copies(regs_in.select("user_id", "submitted_at", *[
        T.trim_app(c).alias(c) for c in ("license_plate", "color", "model")]))
    taken = vehicles.select("license_plate").distinct().withColumn("_taken", F.lit(True))
    pend = (registrations.filter(F.col("status") == "Pending").select("license_plate").distinct()
            .withColumn("_pending", F.lit(True)))
    j = r.join(taken, "license_plate", "left").join(pend, "license_plate", "left")
    missing = T.is_blank("license_plate") | T.is_blank("color") | T.is_blank("model")
    reason = (F.when(missing, "missing_field").when(F.col("_taken").isNotNull(), "plate_registered")
               .when(F.col("_pending").isNotNull(), "already_pending"))
    return j.withColumn("reason", reason).withColumn(
        "_row", F.struct("submitted_at", "user_id", "color", "model"))


def _registration_winners(checked: DataFrame) -> DataFrame:
    return (checked.filter(F.col("reason").isNull()).groupBy("license_plate")
            .agg(F.min("_row").alias("_w")))


def submit_registrations_rejected(regs_in, vehicles, registrations) -> DataFrame:
    """One row per distinct rejected registration, with the number of its copies."""
    c = _registration_check(regs_in, vehicles, registrations)
    j = c.join(_registration_winners(c), "license_plate", "left")
    won = F.col("reason").isNull() & F.col("_row").eqNullSafe(F.col("_w"))
    n = F.col("_n") - F.when(won, 1).otherwise(0)
    return (j.select("user_id", "license_plate", "submitted_at",
                     F.coalesce("reason", F.lit("already_pending")).alias("reason"),
                     n.cast("long").alias("copies")).filter("copies > 0"))


def submit_registrations_registrations(regs_in, vehicles, registrations) -> DataFrame:
    won = _registration_winners(_registration_check(regs_in, vehicles, registrations))
    ok = won.select("license_plate", "_w.*")
    ok = assign_identity(ok, registrations, "request_id",
                         [asc("submitted_at"), asc("user_id"), asc("license_plate")])
    new = ok.select("request_id", "user_id", "license_plate", "color", "model",
                    F.lit("Pending").alias("status"), F.lit(None).cast("long").alias("approved_by"),
                    F.col("submitted_at").alias("created_at"),
                    F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return registrations.unionByName(new.select(*registrations.columns))


def apply_payments(payments_in, requests, invoices, service_type, methods, payments) -> dict:
    """All tables changed by a batch of payments; the accepted payments with
    their new ids are computed once and materialised for the four outputs."""
    p = cut_lineage(_with_ids(payments_in, requests, invoices, service_type, methods, payments))
    return {"service_request": _paid_requests(p, requests), "invoice": _paid_invoices(p, invoices),
            "payment_method": _new_methods(p, methods), "payment": _new_payments(p, payments)}


def apply_payments_requests(*args) -> DataFrame:
    return apply_payments(*args)["service_request"]


def apply_payments_invoices(*args) -> DataFrame:
    return apply_payments(*args)["invoice"]


def apply_payments_methods(*args) -> DataFrame:
    return apply_payments(*args)["payment_method"]


def apply_payments_payments(*args) -> DataFrame:
    return apply_payments(*args)["payment"]


def submit_requests(subs, requests, invoices, service_type, spots, garage, vehicles) -> dict:
    """Tables changed by a batch of service-request submissions."""
    a = cut_lineage(_accepted_submissions(subs, requests, invoices, service_type, spots, garage,
                                          vehicles))
    return {"service_request": _new_requests(a, requests), "invoice": _new_invoices(a, invoices),
            "rejected": submit_requests_rejected(subs, service_type, spots, garage, vehicles)}


def submit_registrations(regs_in, vehicles, registrations) -> dict:
    return {"vehicle_registration_request":
            submit_registrations_registrations(regs_in, vehicles, registrations),
            "rejected": submit_registrations_rejected(regs_in, vehicles, registrations)}


def register_users(users_in, users) -> dict:
    return {"users": register_users_users(users_in, users),
            "rejected": register_users_rejected(users_in, users)}

