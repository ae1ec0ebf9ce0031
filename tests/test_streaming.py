"""The streaming status board ends at the batch board's counts."""

from conftest import SF_SMALL
from parkops.operators import boards as B
from parkops.sources.views import Garage
from parkops.streaming import live_board


def test_live_board_matches_batch(spark):
    q = live_board.start(spark, SF_SMALL)
    try:
        q.processAllAvailable()
        got = {r.status: r["count"] for r in live_board.snapshot(spark, q).collect()}
    finally:
        q.stop()
    g = Garage(spark, SF_SMALL)
    want = {r.status: r["count"] for r in B.status_counts(g.service_request, g.registrations).collect()}
    assert got == want
