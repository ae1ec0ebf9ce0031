"""Registered table operations and batch transforms (SURVEY §2 A3-A7, C6, C11,
C15, I1-I17). Transforms with several output tables get one key per table."""

from __future__ import annotations

from pyspark.sql import functions as F

from parkops.operators import billing as BL
from parkops.operators import boards as B
from parkops.operators import counters as K
from parkops.operators import decisions as D
from parkops.operators import purge as P
from parkops.operators import signups as SU
from parkops.operators import tables as TB
from parkops.operators.ranking import asc
from parkops.plans.registry import query

# The manager running the purge (never purged).
ACTING_ID = 1


@query("exists_gate")
def _(g):
    return D.exists_gate(g.service_request.select("request_id", "status"),
                         g.users.filter(F.col("user_type") == "Manager"))


@query("update_where_exists")
def _(g):
    match = (F.col("model") == "Brand#13") & (F.col("color") == "red")
    return D.update_where_exists(g.vehicle, match, g.users.filter(F.col("user_type") == "Manager"),
                                 {"access_status": F.lit(True), "color": F.lit("crimson")})


@query("join_update")
def _(g):
    return D.join_update(g.vehicle, g.service_request)


for _out in ("requests", "vehicles", "spots"):
    def _mk(out):
        def fn(g):
            if out == "requests":
                return D.request_decisions_requests(g.service_request, g.decisions)
            if out == "vehicles":
                return D.request_decisions_vehicles(g.vehicle, g.service_request, g.decisions)
            return D.request_decisions_spots(g.parking_spots, g.service_request, g.decisions)
        return fn
    query(f"apply_request_decisions__{_out}")(_mk(_out))


@query("apply_registration_decisions__registrations")
def _(g):
    return D.registration_decisions_registrations(g.registrations, g.vehicle,
                                                  g.registration_decisions)


@query("apply_registration_decisions__vehicles")
def _(g):
    return D.registration_decisions_vehicles(g.registrations, g.vehicle, g.registration_decisions)


@query("set_garage_status")
def _(g):
    return D.set_garage_status(g.parking_garage, g.garage_actions)


@query("approve_vehicles")
def _(g):
    return D.approve_vehicles(g.vehicle, g.vehicle_actions)


@query("reject_vehicles__vehicles")
def _(g):
    return D.reject_vehicles_vehicles(g.vehicle, g.service_request, g.owns, g.vehicle_actions)


@query("reject_vehicles__logs")
def _(g):
    return D.reject_vehicles_logs(g.log_record, g.vehicle, g.service_request, g.owns,
                                  g.vehicle_actions)


@query("reject_vehicles__blocked")
def _(g):
    return D.reject_vehicles_blocked(g.vehicle, g.service_request, g.owns, g.vehicle_actions)


@query("delete_own_vehicle__vehicles")
def _(g):
    return D.delete_own_vehicles(g.vehicle, g.service_request, g.log_record, g.owns,
                                 g.vehicle_edits)


@query("delete_own_vehicle__outcome")
def _(g):
    return D.delete_own_outcome(g.vehicle, g.service_request, g.log_record, g.owns,
                                g.vehicle_edits)


@query("edit_vehicles")
def _(g):
    return D.edit_vehicles(g.vehicle, g.vehicle_edits)


# --- deletions ---

def _cascade(g):
    return P.plan_cascade(g.purge_plates, g.vehicle, g.service_request, g.invoice, g.log_record,
                          g.owns)


@query("delete_vehicle_cascade__payments")
def _(g):
    return _cascade(g).plan.table("payment", g.payment)


@query("delete_vehicle_cascade__invoices")
def _(g):
    return _cascade(g).plan.table("invoice", g.invoice)


@query("delete_vehicle_cascade__requests")
def _(g):
    return _cascade(g).plan.table("service_request", g.service_request)


@query("delete_vehicle_cascade__vehicles")
def _(g):
    return _cascade(g).plan.table("vehicle", g.vehicle)


@query("delete_vehicle_cascade__blocked")
def _(g):
    return _cascade(g).blocked


def _purge(g):
    return P.plan_purge(g.purge_ids, ACTING_ID, g.users, g.vehicle, g.service_request, g.invoice,
                        g.log_record, g.reports, g.requests, g.owns)


PURGE_OUTPUTS = {
    "users": "users", "vehicles": "vehicle", "requests": "service_request",
    "invoices": "invoice", "payments": "payment", "logs": "log_record", "owns": "owns",
    "reports": "reports", "mn_requests": "requests", "controls": "controls",
    "registrations": "vehicle_registration_request",
}

for _key, _table in PURGE_OUTPUTS.items():
    def _mkp(table):
        return lambda g: P.purge_apply(_purge(g), table, g.table(table))
    query(f"purge_users__{_key}")(_mkp(_table))


@query("purge_users__blocked")
def _(g):
    return _purge(g).blocked


@query("join_delete")
def _(g):
    return P.join_delete(g.payment, g.invoice, g.service_request, g.purge_ids)


@query("nullify_reference")
def _(g):
    return P.nullify_reference(g.service_request, "approved_by", g.purge_ids, "user_id")


@query("nested_in_join")
def _(g):
    return P.nested_in_join(g.payment, g.invoice, g.service_request, g.vehicle, g.purge_plates)


# --- submissions, payments, sign-ups ---

def _subs_args(g):
    return (g.submissions, g.service_request, g.invoice, g.service_type, g.parking_spots,
            g.parking_garage, g.vehicle)


@query("submit_requests__requests")
def _(g):
    return BL.submit_requests_requests(*_subs_args(g))


@query("submit_requests__invoices")
def _(g):
    return BL.submit_requests_invoices(*_subs_args(g))


@query("submit_requests__rejected")
def _(g):
    return BL.submit_requests_rejected(g.submissions, g.service_type, g.parking_spots,
                                       g.parking_garage, g.vehicle)


def _pay_args(g):
    return (g.payments_in, g.service_request, g.invoice, g.service_type, g.payment_method,
            g.payment)


@query("apply_payments__requests")
def _(g):
    return BL.apply_payments_requests(*_pay_args(g))


@query("apply_payments__invoices")
def _(g):
    return BL.apply_payments_invoices(*_pay_args(g))


@query("apply_payments__methods")
def _(g):
    return BL.apply_payments_methods(*_pay_args(g))


@query("apply_payments__payments")
def _(g):
    return BL.apply_payments_payments(*_pay_args(g))


@query("submit_registrations__registrations")
def _(g):
    return BL.submit_registrations_registrations(g.registrations_in, g.vehicle, g.registrations)


@query("submit_registrations__rejected")
def _(g):
    return BL.submit_registrations_rejected(g.registrations_in, g.vehicle, g.registrations)


@query("register_users__users")
def _(g):
    return BL.register_users_users(g.users_in, g.users)


@query("register_users__rejected")
def _(g):
    return BL.register_users_rejected(g.users_in, g.users)


@query("request_detail")
def _(g):
    board = B.service_request_board(g.service_request, g.service_type, g.users, g.vehicle,
                                    g.parking_spots, g.parking_garage)
    return BL.request_detail(board, g.payments_in)


# --- table operations ---

@query("apply_payments__rejected")
def _(g):
    return BL.apply_payments_rejected(g.payments_in, g.service_request, g.service_type)


@query("register_managers__users")
def _(g):
    return SU.register_managers_users(g.managers_in, g.users)


@query("register_managers__rejected")
def _(g):
    return SU.register_managers_rejected(g.managers_in, g.users)


def _signups_with_ids(g):
    new = g.users_in.select("uni_id", "name", "phone", "user_type", "submitted_at")
    return TB.assign_identity(new, g.users, "user_id",
                              [asc("submitted_at"), asc("uni_id")])


@query("assign_identity")
def _(g):
    return _signups_with_ids(g)


@query("append_rows")
def _(g):
    return TB.append_rows(g.users, _signups_with_ids(g).drop("submitted_at"))


@query("insert_if_absent")
def _(g):
    return TB.insert_if_absent(g.users, _signups_with_ids(g).drop("submitted_at"), ["uni_id"])


@query("ensure_column")
def _(g):
    t = g.service_request.drop("payment_method", "payment_amount")  # as before they were added
    t = TB.ensure_column(t, "payment_method", "string", "Pending", backfill=True)
    t = TB.ensure_column(t, "payment_amount", "decimal(10,2)", None)
    return TB.ensure_column(t, "receipt_id", "string", None)


@query("default_fill")
def _(g):
    new = g.registrations_in.select("user_id", "license_plate", "color", "model", "submitted_at")
    return TB.default_fill(new.withColumnRenamed("submitted_at", "created_at"), {
        "status": F.lit("Pending"), "approved_by": F.lit(None).cast("long"),
        "completed_at": F.lit(None).cast("timestamp_ntz")})


# --- maintained counters ---

def _counted(g, counters):
    stored = counters.of(g.service_request)
    return counters.after_batch(stored, g.service_request, "request_id", g.decisions,
                                lambda rows: D.request_decisions_requests(rows, g.decisions))


@query("status_counts__maintained")
def _(g):
    return _counted(g, K.BY_STATUS)


@query("user_kpis__maintained")
def _(g):
    return _counted(g, K.BY_USER)
