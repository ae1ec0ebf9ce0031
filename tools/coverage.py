"""Write COVERAGE.md: SURVEY §2 ids -> registered keys -> implementing function.

Checks that every key named here is registered and that every registered key
is named here.  Usage: python tools/coverage.py > COVERAGE.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parkops.plans.oracle_sql import SQL  # noqa: E402
from parkops.plans.registry import QUERIES  # noqa: E402

# (id, keys, function)
ROWS = [
    ("A1", [], "sources.views.Garage (typed views of every table)"),
    ("A2", [], "operators.tables.rows_literal, sources.views.literal_table (fixed input only: not registered)"),
    ("A3", ["append_rows"], "operators.tables.append_rows"),
    ("A4", ["insert_if_absent"], "operators.tables.insert_if_absent"),
    ("A5", ["ensure_column"], "operators.tables.ensure_column"),
    ("A6", ["assign_identity"], "operators.tables.assign_identity"),
    ("A7", ["default_fill"], "operators.tables.default_fill"),
    ("B1", ["users_by_name"], "operators.reports.users_by_name"),
    ("B2", ["project_alias"], "operators.reports.project_alias"),
    ("B3", ["tag_literal_null"], "operators.boards.tag_literal_null"),
    ("B4", ["filter_status"], "operators.boards.filter_eq / requests_unified"),
    ("B5", ["filter_user_type"], "operators.boards.filter_eq"),
    ("B6", ["plate_taken_by_other"], "operators.tables.plate_taken_by_other"),
    ("B7", ["id_or_phone_match"], "operators.tables.id_or_phone_match"),
    ("B8", ["pending_vehicles_direct"], "operators.boards.pending_vehicles_direct"),
    ("B9", ["available_spots"], "operators.boards.available_spots"),
    ("B10", ["in_domain"], "Column.isin (also quality.dq_domain)"),
    ("B11", ["like_filter"], "functions.text.like_filter"),
    ("B12", ["approved_on_day"], "operators.boards.approved_on_day"),
    ("B13", ["role_scope"], "operators.boards.role_scope"),
    ("B14", ["row_search"], "operators.boards.row_search, functions.text.row_matches"),
    ("B15", ["vehicle_classes"], "operators.boards.vehicle_classes"),
    ("B16", ["all_spots_audit"], "operators.boards.all_spots_audit"),
    ("B17", ["my_vehicles"], "operators.boards.my_vehicles"),
    ("B18", ["managers"], "operators.boards.managers"),
    ("B19", ["pending_registrations"], "operators.boards.pending_registrations"),
    ("B20", [], "operators.boards.service_catalog (fixed input only: not registered; tests/test_seed.py)"),
    ("C1", ["invoice_ledger"], "operators.reports.invoice_ledger"),
    ("C2", ["request_spot_garage"], "operators.reports.request_spot_garage"),
    ("C3", ["vehicle_owner"], "operators.reports.vehicle_owner"),
    ("C4", ["service_request_board"], "operators.boards.service_request_board"),
    ("C5", ["registration_board"], "operators.boards.registration_board"),
    ("C6", ["request_detail"], "operators.billing.request_detail"),
    ("C7", ["user_requests"], "operators.boards.user_requests"),
    ("C8", ["repeat_requesters"], "operators.reports.repeat_requesters"),
    ("C9", ["never_used_not_in"], "operators.reports.never_used_not_in"),
    ("C10", ["never_used_anti"], "operators.reports.never_used_anti"),
    ("C11", ["exists_gate"], "operators.decisions.exists_gate"),
    ("C12", ["scalar_eq"], "operators.reports.scalar_eq"),
    ("C13", ["user_activity"], "operators.boards.user_activity"),
    ("C14", ["garage_status_lookup"], "operators.boards.garage_status_lookup"),
    ("C15", ["nested_in_join"], "operators.purge.nested_in_join"),
    ("C16", ["pending_registrations_board"], "operators.boards.pending_registrations_board"),
    ("D1", ["total_revenue"], "operators.reports.total_revenue"),
    ("D2", ["payments_by_method"], "operators.reports.payments_by_method"),
    ("D3", ["requests_by_service"], "operators.reports.requests_by_service"),
    ("D4", ["requests_by_garage"], "operators.reports.requests_by_garage"),
    ("D5", ["garage_occupancy"], "operators.boards.garage_occupancy"),
    ("D6", ["status_counts", "status_counts__maintained"], "operators.boards.status_counts (streaming: streaming.live_board)"),
    ("D7", ["status_counts_map"], "operators.boards.status_counts_map"),
    ("D8", ["user_type_counts"], "operators.boards.user_type_counts"),
    ("D9", ["user_total"], "operators.boards.user_total"),
    ("D10", ["admin_kpis"], "operators.boards.admin_kpis"),
    ("D11", ["user_kpis", "user_kpis__maintained"], "operators.boards.user_kpis"),
    ("D12", ["vehicle_stats"], "operators.boards.vehicle_stats"),
    ("D13", ["available_by_garage"], "operators.boards.available_by_garage"),
    ("D14", ["distinct_ids"], "operators.reports.distinct_ids"),
    ("D15", ["having_count"], "operators.reports.having_count"),
    ("D16", ["requests_per_vehicle"], "operators.boards.requests_per_vehicle"),
    ("D17", ["pending_vehicle_count"], "operators.boards.pending_vehicle_count"),
    ("F1", ["sort_multi"], "operators.reports.sort_multi, ranking.with_position"),
    ("F2", ["sort_by_aggregate"], "operators.reports.sort_by_aggregate"),
    ("F3", ["board_order"], "operators.boards.board_order"),
    ("F4", ["sort_conditional"], "operators.boards.sort_conditional"),
    ("F5", ["recent_requests"], "operators.boards.recent_requests, ranking.top_k_per_group"),
    ("F6", ["pending_top10"], "operators.boards.pending_top10, ranking.top_k"),
    ("F7", ["sort_fallback"], "operators.boards.sort_fallback"),
    ("G1", ["requests_unified"], "operators.boards.requests_unified"),
    ("G2", ["user_requests_unified"], "operators.boards.user_requests_unified"),
    ("G3", ["pending_vehicles"], "operators.boards.pending_vehicles"),
    ("H1-H17", ["scalar_text", "scalar_labels", "scalar_card", "garage_labels"],
     "functions.text.* (H9 in apply_payments__methods, H17 in my_vehicles)"),
    ("I1", ["apply_request_decisions__requests", "apply_request_decisions__vehicles",
            "apply_request_decisions__spots"], "operators.decisions.apply_request_decisions"),
    ("I2", ["apply_registration_decisions__registrations", "apply_registration_decisions__vehicles"],
     "operators.decisions.apply_registration_decisions"),
    ("I3", ["set_garage_status"], "operators.decisions.set_garage_status"),
    ("I4", ["approve_vehicles"], "operators.decisions.approve_vehicles"),
    ("I5", ["reject_vehicles__vehicles", "reject_vehicles__logs", "reject_vehicles__blocked"],
     "operators.decisions.reject_vehicles"),
    ("I6", ["delete_own_vehicle__vehicles", "delete_own_vehicle__outcome"],
     "operators.decisions.delete_own_vehicles / delete_own_outcome"),
    ("I7", ["edit_vehicles"], "operators.decisions.edit_vehicles"),
    ("I8", ["delete_vehicle_cascade__payments", "delete_vehicle_cascade__invoices",
            "delete_vehicle_cascade__requests", "delete_vehicle_cascade__vehicles",
            "delete_vehicle_cascade__blocked"], "operators.purge.delete_vehicle_cascade"),
    ("I9", [f"purge_users__{k}" for k in ("users", "vehicles", "requests", "invoices", "payments",
                                          "logs", "owns", "reports", "mn_requests", "controls",
                                          "registrations", "blocked")],
     "operators.purge.purge_users"),
    ("I10", ["submit_requests__requests", "submit_requests__invoices", "submit_requests__rejected"],
     "operators.billing.submit_requests"),
    ("I11", ["apply_payments__rejected", "apply_payments__requests", "apply_payments__invoices", "apply_payments__methods",
             "apply_payments__payments"], "operators.billing.apply_payments"),
    ("I12", ["update_where_exists"], "operators.decisions.update_where_exists"),
    ("I13", ["join_update"], "operators.decisions.join_update"),
    ("I14", ["join_delete"], "operators.purge.join_delete"),
    ("I15", ["nullify_reference"], "operators.purge.nullify_reference"),
    ("I16", ["submit_registrations__registrations", "submit_registrations__rejected"],
     "operators.billing.submit_registrations"),
    ("I17", ["register_users__users", "register_users__rejected", "register_managers__users", "register_managers__rejected"], "operators.signups"),
    ("J1", ["dq_unique", "dq_unique__staged", "dq_constraints__staged"], "operators.quality.dq_unique"),
    ("J2", ["dq_unique_ci"], "operators.quality.dq_unique_ci"),
    ("J3", ["dq_domain", "dq_domain__staged"], "operators.quality.dq_domain"),
    ("J4", ["dq_foreign_key", "dq_foreign_key__staged"], "operators.quality.dq_foreign_key"),
    ("J5", ["dq_not_null", "dq_not_null__staged"], "operators.quality.dq_not_null"),
    ("J6", ["dq_max_length", "dq_max_length__staged"], "operators.quality.dq_max_length"),
    ("J7", ["dq_card_fields"], "operators.quality.dq_card_fields"),
    ("J8", ["dq_spot_choice"], "operators.quality.dq_spot_choice"),
    ("J9", ["dq_contact_fields", "dq_signup_fields"], "operators.quality.dq_contact_fields"),
    ("J10", ["dq_payable"], "operators.quality.dq_payable"),
    ("E, K, L", [], "none in the reference (no window functions, streaming or UDFs)"),
]


def main() -> int:
    named = [k for _, keys, _ in ROWS for k in keys]
    missing = [k for k in named if k not in QUERIES]
    unnamed = sorted(set(QUERIES) - set(named))
    if missing or unnamed:
        print("missing:", missing, "unnamed:", unnamed, file=sys.stderr)
        return 1
    print("# Coverage of SURVEY §2\n")
    print(f"{len(QUERIES)} registered keys, {sum(k in SQL for k in QUERIES)} with a DuckDB oracle. "
          "Generated by `tools/coverage.py`, which fails when a key is unregistered or unlisted.\n")
    print("| id | registered keys | implementation (module.function) |")
    print("|---|---|---|")
    for rid, keys, fn in ROWS:
        ks = ", ".join(f"`{k}`" for k in keys) or "-"
        print(f"| {rid} | {ks} | `{fn}` |" if keys else f"| {rid} | - | {fn} |")
    return 0


if __name__ == "__main__":
    sys.exit(main())
