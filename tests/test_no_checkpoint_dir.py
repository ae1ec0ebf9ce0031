"""Without a checkpoint folder: a local session gets a scratch folder and results
stay whole, however adaptive execution coalesces; a cluster session is refused."""

from types import SimpleNamespace

import pytest

from conftest import SF_MID
from parkops import session
from parkops.plans.check import compare
from parkops.plans.oracle_sql import SQL
from parkops.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck_mid():
    from parkops.plans.check import duck
    return duck(SF_MID)


@pytest.mark.parametrize("name", ["sort_multi", "board_order", "my_vehicles", "assign_identity"])
def test_whole_without_checkpoint_dir(spark, duck_mid, monkeypatch, name):
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: None)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        # the folder of the session is replaced by a scratch folder and used
        monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: s.sparkContext
                            .getCheckpointDir())
        r = compare(spark, duck_mid, SF_MID, name, QUERIES[name], SQL[name])
    finally:
        if before is None:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        else:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert r["status"] == "ok", r


def test_cluster_without_checkpoint_dir_is_refused(monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(cluster)


def test_partitions_are_sized_for_the_input_and_bounded():
    parts = lambda n: int(session.scale_conf(n, max_partitions=100_000)["spark.sql.shuffle.partitions"])
    assert (parts(1), parts(1 << 40), parts(100 << 40)) == (200, 4096, 100_000)
