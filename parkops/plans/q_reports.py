"""Registered report queries."""

from __future__ import annotations

from parkops.operators import reports as R
from parkops.plans.registry import query

# Parameter of the scalar-subquery report: a plate present at every scale.
SCALAR_PLATE = "PL-42"


@query("total_revenue")
def _(g):
    return R.total_revenue(g.payment)


@query("payments_by_method")
def _(g):
    return R.payments_by_method(g.payment, g.payment_method)


@query("requests_by_service")
def _(g):
    return R.requests_by_service(g.service_type, g.service_request)


@query("requests_by_garage")
def _(g):
    return R.requests_by_garage(g.parking_garage, g.parking_spots, g.service_request)


@query("sort_by_aggregate")
def _(g):
    return R.sort_by_aggregate(g.parking_garage, g.parking_spots, g.service_request)


def _ledger(g):
    return R.invoice_ledger(g.invoice, g.payment, g.payment_method, g.service_request,
                            g.users, g.vehicle)


@query("invoice_ledger")
def _(g):
    return _ledger(g)


@query("project_alias")
def _(g):
    return R.project_alias(_ledger(g), R.LEDGER_HEADINGS)


@query("request_spot_garage")
def _(g):
    return R.request_spot_garage(g.service_request, g.users, g.vehicle, g.parking_spots,
                                 g.parking_garage)


@query("vehicle_owner")
def _(g):
    return R.vehicle_owner(g.vehicle, g.users)


@query("users_by_name")
def _(g):
    return R.users_by_name(g.users)


@query("sort_multi")
def _(g):
    return R.sort_multi(g.invoice)


@query("having_count")
def _(g):
    return R.having_count(g.service_request)


@query("repeat_requesters")
def _(g):
    return R.repeat_requesters(g.users, g.service_request)


@query("distinct_ids")
def _(g):
    return R.distinct_ids(g.service_request)


@query("never_used_not_in")
def _(g):
    return R.never_used_not_in(g.vehicle, g.service_request)


@query("never_used_anti")
def _(g):
    return R.never_used_anti(g.vehicle, g.service_request)


@query("scalar_eq")
def _(g):
    return R.scalar_eq(g.service_request, g.vehicle, SCALAR_PLATE)
