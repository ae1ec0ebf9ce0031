"""Keys stay unique and references stay whole after every transform (sf0.01)."""

import pytest

from parkops.operators import quality as Q
from parkops.plans.registry import QUERIES
from parkops.sources import schema as S

# transform output key -> table it replaces
OUTPUTS = {
    "apply_request_decisions__requests": "service_request",
    "apply_request_decisions__vehicles": "vehicle",
    "apply_request_decisions__spots": "parking_spots",
    "apply_registration_decisions__registrations": "vehicle_registration_request",
    "apply_registration_decisions__vehicles": "vehicle",
    "approve_vehicles": "vehicle",
    "reject_vehicles__vehicles": "vehicle",
    "edit_vehicles": "vehicle",
    "submit_requests__requests": "service_request",
    "submit_requests__invoices": "invoice",
    "apply_payments__invoices": "invoice",
    "apply_payments__payments": "payment",
    "apply_payments__methods": "payment_method",
    "submit_registrations__registrations": "vehicle_registration_request",
    "register_users__users": "users",
    "purge_users__users": "users",
    "purge_users__vehicles": "vehicle",
    "purge_users__requests": "service_request",
}

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(OUTPUTS))
def test_keys_unique_after(spark, key):
    t = OUTPUTS[key]
    out = QUERIES[key](spark, SF)
    pk = list(S.PRIMARY_KEYS[t])
    assert out.groupBy(*pk).count().filter("count > 1").count() == 0
    for uk in S.UNIQUE_KEYS.get(t, ()):
        assert out.groupBy(*uk).count().filter("count > 1").count() == 0


def test_references_whole_after_purge(spark):
    from parkops.sources.views import Garage
    g = Garage(spark, SF)
    names = {"users": "purge_users__users", "vehicle": "purge_users__vehicles",
             "service_request": "purge_users__requests", "invoice": "purge_users__invoices",
             "payment": "purge_users__payments", "log_record": "purge_users__logs",
             "owns": "purge_users__owns", "reports": "purge_users__reports",
             "requests": "purge_users__mn_requests", "controls": "purge_users__controls",
             "vehicle_registration_request": "purge_users__registrations"}
    after = {t: QUERIES[k](spark, SF) for t, k in names.items()}
    table = lambda t: after.get(t, g.table(t))
    before = Q.dq_foreign_key(g.table).count()
    assert Q.dq_foreign_key(table).count() == before  # no new orphan


def test_references_whole_after_cascade(spark):
    from parkops.sources.views import Garage
    g = Garage(spark, SF)
    names = {"vehicle": "delete_vehicle_cascade__vehicles",
             "service_request": "delete_vehicle_cascade__requests",
             "invoice": "delete_vehicle_cascade__invoices",
             "payment": "delete_vehicle_cascade__payments"}
    after = {t: QUERIES[k](spark, SF) for t, k in names.items()}
    table = lambda t: after.get(t, g.table(t))
    assert Q.dq_foreign_key(table).count() == Q.dq_foreign_key(g.table).count()
