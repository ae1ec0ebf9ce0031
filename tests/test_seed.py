"""Seed rows of the reference's scripts with hand-computed answers."""

from decimal import Decimal

from pyspark.sql import functions as F

from parkops.operators import boards as B
from parkops.operators import quality as Q
from parkops.operators import reports as R
from parkops.sources import schema as S
from parkops.sources.views import literal_table

# Seed garages (id, name, access, status).
SEED_GARAGES = [
    (1, "Main building Garage", True, "Open"),
    (2, "ITI Garage", True, "Open"),
    (3, "NAID Garage", False, "Closed"),
    (4, "Innovation Garage", True, "Open"),
]
# Spot prefix and count per seed garage; garage 5 does not exist.
SPOT_BLOCKS = [(1, "N", 8), (2, "S", 10), (3, "E", 6), (4, "W", 5)]
BAD_BLOCK = (5, "C", 7)
SEED_SERVICES = [(1, "Car Wash", None, Decimal("50.00")),
                 (2, "Oil Change", None, Decimal("150.00")),
                 (3, "Tire Rotation", None, Decimal("75.00"))]


def spot_rows(blocks, first_id=1):
    rows, sid = [], first_id
    for g, prefix, n in blocks:
        for i in range(1, n + 1):
            rows.append((sid, f"{prefix}-{g}{i:02d}", "Available", g))
            sid += 1
    return rows


def seed(spark, with_bad=False):
    garages = literal_table(spark, SEED_GARAGES, S.PARKING_GARAGE)
    rows = spot_rows(SPOT_BLOCKS)
    if with_bad:
        rows += spot_rows([BAD_BLOCK], first_id=len(rows) + 1)
    spots = literal_table(spark, rows, S.PARKING_SPOTS)
    return garages, spots


def test_garage_occupancy_seed(spark):
    garages, spots = seed(spark)
    got = {r.garage_id: (r.total_spots, r.available_spots, r.reserved_spots)
           for r in B.garage_occupancy(garages, spots).collect()}
    assert got == {1: (8, 8, 0), 2: (10, 10, 0), 3: (6, 6, 0), 4: (5, 5, 0)}


def test_available_spots_seed(spark):
    garages, spots = seed(spark)
    assert B.available_spots(spots, garages).count() == 23  # closed garage 3 drops out


def test_foreign_key_catches_garage_5(spark):
    garages, spots = seed(spark, with_bad=True)
    tables = {"parking_spots": spots, "parking_garage": garages}
    fks = [("parking_spots", "garage_id", "parking_garage", "garage_id")]
    rows = Q.dq_foreign_key(tables.__getitem__, fks).collect()
    assert [(r.value, r.n) for r in rows] == [("5", 7)]


def test_domain_catches_stafff(spark):
    users = literal_table(spark, [(1, "T1", "Sample User", None, "Stafff", True, None)],
                          S.USERS)
    rows = Q.dq_domain(lambda t: users, [("users", "user_type", S.USER_TYPES)]).collect()
    assert [(r.key, r.value) for r in rows] == [("1", "Stafff")]


def test_vehicle_of_missing_user(spark):
    users = literal_table(spark, [(1, "U1", "A", None, "Staff", True, None)], S.USERS)
    vehicle = literal_table(spark, [(1, "DEF-9012", "Black", 4, "Ford Mustang", True, 1, None)],
                            S.VEHICLE)
    tables = {"users": users, "vehicle": vehicle}
    fks = [("vehicle", "user_id", "users", "user_id"),
           ("vehicle", "approved_by", "users", "user_id")]
    rows = Q.dq_foreign_key(tables.__getitem__, fks).collect()
    assert [(r.column_name, r.value) for r in rows] == [("user_id", "4")]


def test_service_catalog_and_counts(spark):
    st = literal_table(spark, SEED_SERVICES, S.SERVICE_TYPE)
    reqs = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "request_id long, service_id long")
    got = {r.service_name: r.total_requests for r in R.requests_by_service(st, reqs).collect()}
    assert got == {"Car Wash": 2, "Oil Change": 1}  # unused Tire Rotation drops (inner join)
    cat = B.service_catalog(st).collect()
    assert [r.service_name for r in cat] == ["Car Wash", "Oil Change", "Tire Rotation"]
    assert cat[0].price == Decimal("50.00")


def test_literal_table_is_jvm_only(spark):
    st = literal_table(spark, SEED_SERVICES, S.SERVICE_TYPE)
    assert "ExistingRDD" not in st._jdf.queryExecution().executedPlan().toString()
    assert st.schema["price"].dataType == S.MONEY
    assert st.filter(F.col("price") > 60).count() == 2


def test_unique_not_null_and_length_violations(spark):
    users = literal_table(spark, [
        (1, "U1", "Ann", "0101", "Staff", True, None),
        (1, "u1", "Bob", "0101", "Student", True, None),      # duplicate id, same phone
        (2, "U" + "9" * 20, None, None, "Admin", None, None),  # uni_id too long, name NULL
    ], S.USERS)
    tables = {"users": users}
    t = tables.__getitem__
    uniq = {(r.column_name, r.value, r.n) for r in
            Q.dq_unique(t, [("users", ("user_id",)), ("users", ("uni_id",))]).collect()}
    assert uniq == {("user_id", "1", 2)}  # 'U1' and 'u1' differ exactly; J2 catches them
    ci = {(r.rule, r.value, r.n) for r in Q.dq_unique_ci(users).collect()}
    assert ci == {("uni_id_ci", "u1", 2), ("phone", "0101", 2)}
    nn = [(r.column_name, r.key) for r in Q.dq_not_null(t, [("users", "uni_id"), ("users", "name")])
          .collect()]
    assert nn == [("name", "2")]
    ml = [(r.column_name, r.key, r.value_len) for r in
          Q.dq_max_length(t, [("users", "uni_id", 20), ("users", "name", 100)]).collect()]
    assert ml == [("uni_id", "2", 21)]
