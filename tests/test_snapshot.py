"""Whole transforms write a consistent snapshot: tables first, pointer last."""

import tempfile

from parkops.operators import billing as BL
from parkops.operators import tables as TB
from parkops.sources.views import Garage

SF = "/root/testdata/sf0.001"


def test_payment_batch_snapshot_roundtrip(spark):
    g = Garage(spark, SF)
    out = BL.apply_payments(g.payments_in, g.service_request, g.invoice, g.service_type,
                            g.payment_method, g.payment)
    root = tempfile.mkdtemp(prefix="parkops-snap-")
    TB.write_snapshot(out, root, "s1")
    back = TB.read_snapshot(spark, root, list(out))
    for name, df in out.items():
        assert sorted(back[name].collect()) == sorted(df.collect()), name
    # a second snapshot moves the pointer; the first stays readable by id
    TB.write_snapshot({"payment": out["payment"].limit(0)}, root, "s2")
    assert TB.read_snapshot(spark, root, ["payment"])["payment"].count() == 0
    assert spark.read.parquet(f"{root}/snapshots/s1/payment").count() == out["payment"].count()


def test_whole_transforms_return_every_table(spark):
    from parkops.operators import decisions as D
    from parkops.operators import purge as P
    g = Garage(spark, SF)
    t = {n: g.table(n) for n in P.PURGE_TABLES}
    purged = P.purge_users(g.purge_ids, 1, t)
    assert set(purged) == set(P.PURGE_TABLES) | {"blocked"}
    assert purged["users"].count() + purged["users"].join(
        g.users, "user_id", "left_anti").count() <= g.users.count()
    dec = D.apply_request_decisions(g.service_request, g.vehicle, g.parking_spots, g.decisions)
    assert {k: v.count() for k, v in dec.items()} == {
        "service_request": g.service_request.count(), "vehicle": g.vehicle.count(),
        "parking_spots": g.parking_spots.count()}
