"""Versions: whole for every reader, one of two writers wins, and an update leaves the files
of untouched buckets unread."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from parkops.operators import decisions as D
from parkops.sources.versions import Conflict, Versions
from parkops.sources.views import Garage


@pytest.fixture()
def store(spark):
    return Versions(spark, tempfile.mkdtemp(prefix="parkops-versions-"), buckets=8)


def test_round_trip_and_old_versions(spark, store):
    g = Garage(spark, SF_SMALL)
    assert store.latest() == 0
    assert store.write({"vehicle": g.vehicle, "users": g.users}) == 1
    assert sorted(store.read("vehicle").collect()) == sorted(g.vehicle.collect())
    assert store.read("vehicle").dtypes == g.vehicle.dtypes
    assert store.write({"vehicle": g.vehicle.limit(0)}) == 2
    assert store.read("vehicle").count() == 0 and store.read("users").count() == g.users.count()
    assert store.read("vehicle", version=1).count() == g.vehicle.count()


def test_one_of_two_writers_is_refused(spark, store):
    g = Garage(spark, SF_SMALL)
    store.write({"users": g.users})
    other = Versions(spark, store.root, buckets=8)
    other.latest = lambda: 1  # it looked before the first one wrote
    store.write({"users": g.users.limit(1)})
    with pytest.raises(Conflict):
        other.write({"users": g.users.limit(2)})
    assert store.latest() == 2 and store.read("users").count() == 1


def test_a_reader_between_any_two_writes_finds_a_whole_version(spark, store, monkeypatch):
    g = Garage(spark, SF_SMALL)
    store.write({"users": g.users, "vehicle": g.vehicle})
    seen = []
    plain = Versions._write

    def write(self, table, df):
        out = plain(self, table, df)
        reader = Versions(spark, store.root, buckets=8)
        seen.append((reader.latest(), reader.read("users").count(), reader.read("vehicle").count()))
        return out

    monkeypatch.setattr(Versions, "_write", write)
    store.write({"users": g.users.limit(3), "vehicle": g.vehicle.limit(4)})
    before = (1, g.users.count(), g.vehicle.count())
    assert seen == [before, before]
    assert (store.read("users").count(), store.read("vehicle").count()) == (3, 4)


def test_update_reads_and_writes_only_touched_buckets(spark, store):
    g = Garage(spark, SF_SMALL)
    store.write({"service_request": g.service_request})
    before = store.manifest()["tables"]["service_request"]["buckets"]
    one = store.read("service_request", buckets=[3]).select("request_id").limit(2)
    batch = spark.createDataFrame([(r.request_id, "Rejected") for r in one.collect()],
                                  "request_id long, status string")
    files = []

    def change(rows, changes):
        files.extend(rows.inputFiles())
        return D.apply_updates(rows, "request_id", changes.withColumnRenamed("status", "_status"),
                               {"status": F.col("_status")})

    assert store.update("service_request", batch, change) == 2
    after = store.manifest()["tables"]["service_request"]["buckets"]
    assert {b for b in before if before[b] != after[b]} == {"3"}
    assert files and all("_bucket=3/" in f for f in files)
    changed = {r.request_id for r in batch.collect()}
    want = {r.request_id: ("Rejected" if r.request_id in changed else r.status)
            for r in g.service_request.collect()}
    assert {r.request_id: r.status for r in store.read("service_request").collect()} == want


def test_update_adds_and_deletes(spark, store):
    users = spark.createDataFrame([(i, f"u{i}") for i in range(50)], "user_id long, uni_id string")
    store.write({"users": users})
    batch = spark.createDataFrame([(7, None), (99, "new")], "user_id long, uni_id string")
    store.update("users", batch, lambda rows, b: rows.join(b.select("user_id"), "user_id", "left_anti")
                 .unionByName(b.filter("uni_id is not null")))
    got = {r.user_id for r in store.read("users").collect()}
    assert got == (set(range(50)) - {7}) | {99}


def test_rows_outside_the_batch_are_refused(spark, store):
    users = spark.createDataFrame([(i, "x") for i in range(50)], "user_id long, uni_id string")
    store.write({"users": users})
    batch = users.limit(1)
    with pytest.raises(ValueError, match="outside"):
        store.update("users", batch, lambda rows, b: rows.unionByName(users.withColumn(
            "user_id", F.col("user_id") + 1000)))
    assert store.latest() == 1
