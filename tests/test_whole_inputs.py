"""The derived tables and inputs keep every row of the table they come from; only the purge
lists pick rows, since picking is what they are for."""

import re

from conftest import SF_SMALL
from parkops.plans import oracle_sql  # noqa: F401  (registers the input views)
from parkops.plans.oracle_views import VIEWS
from parkops.plans.registry import QUERIES
from parkops.sources.views import Garage

PICKS = {"purge_ids", "purge_plates"}


def test_no_modulo_filter_in_the_views():
    sliced = {n for n, sql in VIEWS.items() if re.search(r"WHERE\s+\w+\s*%\s*\d+\s*=", sql)}
    assert sliced == PICKS


def test_inputs_have_every_row(spark):
    g = Garage(spark, SF_SMALL)
    orders, parts = g.raw("orders").count(), g.raw("part").count()
    assert g.payments_in.count() == QUERIES["dq_payable"](spark, SF_SMALL).count() == orders
    assert g.decisions.select("request_id").distinct().count() == orders
    assert g.registrations.count() == g.registration_decisions.count() == parts
    assert g.requests.count() == g.reports.count()
    assert g.payments_in.groupBy("method").count().count() == 2
