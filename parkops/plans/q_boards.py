"""Registered board queries (SURVEY §2 B3-B5, B8, B9, B12-B19, C4, C5, C7, C13,
C14, C16, D5-D13, D16, D17, F3-F7, G1-G3, H)."""

from __future__ import annotations

from parkops.operators import boards as B
from parkops.plans.registry import query

# Parameters of the checked runs (a viewer, a day, a search term, filters).
VIEWER_ID = 4
AS_OF_DAY = "1998-09-06"
SEARCH_TERM = "nation_1"
STATUS_FILTER = "Pending"
TYPE_FILTER = "Student"


def _service_board(g):
    return B.service_request_board(g.service_request, g.service_type, g.users, g.vehicle,
                                   g.parking_spots, g.parking_garage)


def _unified(g, status="all"):
    return B.requests_unified(_service_board(g), B.registration_board(g.registrations, g.users),
                              status)


@query("service_request_board")
def _(g):
    return _service_board(g)


@query("registration_board")
def _(g):
    return B.registration_board(g.registrations, g.users)


@query("requests_unified")
def _(g):
    return _unified(g)


@query("filter_status")
def _(g):
    return _unified(g, STATUS_FILTER)


@query("board_order")
def _(g):
    return B.board_order(_unified(g), B.board_keys(g.service_request, g.registrations,
                                                   g.service_type, g.users))


@query("row_search")
def _(g):
    return B.row_search(_unified(g), SEARCH_TERM)


@query("role_scope")
def _(g):
    return B.role_scope(_unified(g), g.users, VIEWER_ID)


@query("pending_vehicles_direct")
def _(g):
    return B.pending_vehicles_direct(g.vehicle, g.users)


@query("pending_registrations_board")
def _(g):
    return B.pending_registrations_board(g.registrations, g.users)


@query("pending_vehicles")
def _(g):
    return B.pending_vehicles(g.vehicle, g.registrations, g.users)


@query("pending_vehicle_count")
def _(g):
    return B.pending_vehicle_count(B.pending_vehicles(g.vehicle, g.registrations, g.users))


@query("available_spots")
def _(g):
    return B.available_spots(g.parking_spots, g.parking_garage)


@query("available_by_garage")
def _(g):
    return B.available_by_garage(B.available_spots(g.parking_spots, g.parking_garage))


@query("all_spots_audit")
def _(g):
    return B.all_spots_audit(g.parking_spots, g.parking_garage)


@query("approved_on_day")
def _(g):
    return B.approved_on_day(g.service_request, AS_OF_DAY)


@query("vehicle_classes")
def _(g):
    return B.vehicle_classes(g.vehicle)


@query("sort_conditional")
def _(g):
    return B.sort_conditional(g.vehicle)


@query("my_vehicles")
def _(g):
    return B.my_vehicles(g.vehicle)


@query("managers")
def _(g):
    return B.managers(g.users)


@query("pending_registrations")
def _(g):
    return B.pending_registrations(g.registrations)


@query("user_requests")
def _(g):
    return B.user_requests(g.service_request, g.service_type, g.vehicle, g.parking_spots)


def _user_unified(g):
    return B.user_requests_unified(
        B.user_requests(g.service_request, g.service_type, g.vehicle, g.parking_spots),
        g.registrations)


@query("user_requests_unified")
def _(g):
    return _user_unified(g)


@query("recent_requests")
def _(g):
    return B.recent_requests(_user_unified(g))


@query("pending_top10")
def _(g):
    return B.pending_top10(g.service_request, g.registrations, g.service_type, g.users,
                           g.vehicle, g.parking_spots)


@query("user_activity")
def _(g):
    return B.user_activity(g.users, g.vehicle, g.service_request)


@query("filter_user_type")
def _(g):
    return B.filter_eq(B.user_activity(g.users, g.vehicle, g.service_request), "user_type",
                       TYPE_FILTER)


@query("sort_fallback")
def _(g):
    return B.sort_fallback(B.user_activity(g.users, g.vehicle, g.service_request))


@query("garage_status_lookup")
def _(g):
    return B.garage_status_lookup(g.parking_garage)


@query("garage_occupancy")
def _(g):
    return B.garage_occupancy(g.parking_garage, g.parking_spots)


@query("status_counts")
def _(g):
    return B.status_counts(g.service_request, g.registrations)


@query("status_counts_map")
def _(g):
    return B.status_counts_map(B.status_counts(g.service_request, g.registrations))


@query("user_type_counts")
def _(g):
    return B.user_type_counts(g.users)


@query("user_total")
def _(g):
    return B.user_total(B.user_type_counts(g.users))


@query("admin_kpis")
def _(g):
    return B.admin_kpis(g.service_request, g.registrations, g.users, g.vehicle, AS_OF_DAY)


@query("user_kpis")
def _(g):
    return B.user_kpis(g.users, g.vehicle, g.service_request, g.registrations)


@query("vehicle_stats")
def _(g):
    return B.vehicle_stats(g.users, g.vehicle, g.registrations)


@query("requests_per_vehicle")
def _(g):
    return B.requests_per_vehicle(g.vehicle, g.service_request)


@query("scalar_text")
def _(g):
    return B.scalar_text(g.users)


@query("scalar_labels")
def _(g):
    return B.scalar_labels(_unified(g))


@query("tag_literal_null")
def _(g):
    return B.tag_literal_null(g.registrations, g.service_request,
                              {"request_type": "vehicle_registration", "receipt_id": "none"})

