"""Input tables of the batch transforms, derived from the driver tables.

The application applies one decision / payment / submission at a time; the
engine applies whole tables of them. These derivations give such tables at
every scale (they grow with the driver data). Rules in FIXTURES.md; the
oracle CTEs are in parkops/plans/oracle_inputs.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.sources.views import days_after, idiv, plus_days


def plus_minutes(ts: Column, n: Column) -> Column:
    return F.timestamp_add("MINUTE", n.cast("int"), ts)


def base_time(day: str) -> Column:
    return F.lit(day).cast("date").cast("timestamp_ntz")


def decisions(orders: DataFrame) -> DataFrame:
    """Two decisions for every request, the later one a reject (request_id % 4 = 0) or the
    first one again."""
    k = F.col("o_orderkey")
    first = F.when(k % 2 == 0, "approve").otherwise("reject")
    return orders.select(
        k.alias("request_id"), first.alias("action"), (k % 10).alias("decided_by"),
        plus_days(F.col("o_orderdate"), F.lit(1)).alias("decided_at"),
    ).unionByName(orders.select(
        k.alias("request_id"),
        F.when(k % 4 == 0, "reject").otherwise(first).alias("action"),
        ((k + 1) % 10).alias("decided_by"),
        plus_days(F.col("o_orderdate"), F.lit(2)).alias("decided_at")))


def registration_decisions(part: DataFrame) -> DataFrame:
    """A decision for every registration request."""
    p = F.col("p_partkey")
    return part.select(
        p.alias("request_id"),
        F.when(idiv("p_partkey", 6) % 2 == 0, "approve").otherwise("reject").alias("action"),
        (p % 10).alias("decided_by"),
        plus_days(days_after("1995-01-01", p % 2400), F.lit(1)).alias("decided_at"))


def garage_actions(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    return nation.select(
        k.cast("long").alias("garage_id"),
        F.when(k % 2 == 0, "open").otherwise("close").alias("action"))


def vehicle_actions(part: DataFrame) -> DataFrame:
    """Actions on vehicles that are not approved (p_size % 5 in (0, 1))."""
    p = F.col("p_partkey")
    return part.filter(F.col("p_size") % 5 <= 1).select(
        p.alias("vehicle_id"),
        F.when(p % 2 == 0, "approve").otherwise("reject").alias("action"),
        (p % 10).alias("acted_by"))


def vehicle_edits(part: DataFrame) -> DataFrame:
    """One edit per vehicle: own plate + 'X', or (every 80th) the plate of the next
    vehicle, which is taken, or (every 7th) a free plate that two vehicles ask for,
    at the same time in every 98th; every 120th comes from another user."""
    p = F.col("p_partkey")
    owner = idiv("p_partkey * 3", 4)
    return part.select(
        p.alias("vehicle_id"),
        F.when(p % 120 == 0, owner + 1).otherwise(owner).alias("user_id"),
        F.when(p % 80 == 0, F.concat(F.lit("PL-"), (p + 1).cast("string")))
         .when(p % 7 == 0, F.concat(F.lit("DUO-"), idiv("p_partkey", 14).cast("string")))
         .otherwise(F.concat(F.lit("PL-"), p.cast("string"), F.lit("X"))).alias("license_plate"),
        F.lit("Silver").alias("color"),
        F.concat(F.col("p_brand"), F.lit(" S")).alias("model"),
        plus_minutes(base_time("2024-04-01"), F.when(p % 98 < 14, 0).otherwise(1000 - p % 1000))
        .alias("edited_at"))


def submissions(customer: DataFrame) -> DataFrame:
    """One new service request per user; the spot is
    none, the user's usual spot, or a spot that does not exist."""
    c = F.col("c_custkey")
    pick = idiv("c_custkey", 9) % 3
    return customer.select(
        c.alias("user_id"),
        idiv("c_custkey * 4 + 2", 3).alias("vehicle_id"),
        (c % 6 + 1).alias("service_id"),
        F.when(pick == 0, F.lit(None).cast("long")).when(pick == 1, idiv("c_custkey", 15))
         .otherwise(F.lit(999999).cast("long")).alias("spot_id"),
        plus_minutes(base_time("2024-01-01"), c % 1000).alias("submitted_at"))


def payments_in(orders: DataFrame) -> DataFrame:
    """A payment for every request by the owner (another user every 128th); Credit when request_id // 8 is even, else Cash. Card rows cycle
    through one valid card and four invalid shapes."""
    k = F.col("o_orderkey")
    credit = idiv("o_orderkey", 8) % 2 == 0
    shape = idiv("o_orderkey", 16) % 5
    valid_no = F.lit("4111111111111111")
    return orders.select(
        k.alias("request_id"),
        F.when(k % 128 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
         .alias("user_id"),
        F.when(credit, "Credit").otherwise("Cash").alias("method"),
        F.when(credit, F.when(shape == 1, F.lit("411111111111")).otherwise(valid_no))
         .alias("card_number"),
        F.when(credit, F.when(shape == 2, F.lit("12")).otherwise(F.lit("123"))).alias("card_cvv"),
        F.when(credit, F.when(shape == 3, F.lit("1/25")).otherwise(F.lit("12/27")))
         .alias("card_expiry"),
        F.when(credit, F.when(shape == 4, F.lit(" ")).otherwise(
            F.concat(F.lit("Holder "), F.col("o_custkey").cast("string"))))
         .alias("cardholder_name"),
        plus_days(F.col("o_orderdate"), F.lit(30)).alias("paid_at"))


def registrations_in(part: DataFrame) -> DataFrame:
    """A registration per part: taken plates (% 25), plates of
    registration requests (% 15), pairs sharing one plate (% 35),
    new ones; the colour is missing for some firsts of a pair."""
    p = F.col("p_partkey")
    plate = (F.when(p % 25 == 0, F.concat(F.lit("PL-"), p.cast("string")))
              .when(p % 15 == 0, F.concat(F.lit("NEW-"), p.cast("string")))
              .when(p % 35 == 0, F.concat(F.lit("TWIN-"), idiv("p_partkey + 35", 70).cast("string")))
              .otherwise(F.concat(F.lit("REG-"), p.cast("string"))))
    return part.select(
        idiv("p_partkey * 3", 4).alias("user_id"),
        plate.alias("license_plate"),
        F.when(p % 210 == 35, F.lit(" ")).otherwise(F.substring_index("p_name", " ", 1))
        .alias("color"),
        F.col("p_brand").alias("model"),
        plus_minutes(base_time("2024-02-01"), p % 1000).alias("submitted_at"))


def users_in(customer: DataFrame) -> DataFrame:
    """A sign-up per customer: new ids, pairs sharing an id (% 11), a case variant of an existing
    id (% 49), the phone of another user (% 21), a type outside the list (% 35)."""
    c = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    typ = (F.when(seg.isin("AUTOMOBILE", "BUILDING"), "Student").when(seg == "FURNITURE", "Staff")
            .when(seg == "HOUSEHOLD", "Admin").when(seg == "MACHINERY", "Manager"))
    return customer.select(
        F.when(c % 49 == 0, F.concat(F.lit("u"), c.cast("string")))
         .when(c % 11 == 0, F.concat(F.lit("P"), idiv("c_custkey", 22).cast("string")))
         .otherwise(F.concat(F.lit("N"), c.cast("string"))).alias("uni_id"),
        F.concat(F.lit("New "), F.col("c_name")).alias("name"),
        F.when(c % 21 == 0, F.concat(F.lit("010"), F.lpad(((c + 1) % 900).cast("string"), 8, "0")))
         .when(c % 13 == 0, F.concat(F.lit("030"), F.lpad(idiv("c_custkey", 26).cast("string"), 8, "0")))
         .otherwise(F.concat(F.lit("020"), F.lpad(c.cast("string"), 8, "0"))).alias("phone"),
        F.when(c % 35 == 0, F.lit("Stafff")).otherwise(typ).alias("user_type"),
        plus_minutes(base_time("2024-03-01"), c % 1000).alias("submitted_at"))


def managers_in(customer: DataFrame) -> DataFrame:
    """A manager's sign-up per customer: ids of users in another case (% 31), pairs sharing an
    id (% 14), pairs sharing a phone with one of another pair (% 12), some without a password
    or name; the order runs against the ids."""
    c = F.col("c_custkey")
    return customer.select(
        F.when(c % 31 == 0, F.concat(F.lit("u"), c.cast("string")))
         .when(c % 14 < 2, F.concat(F.lit("G"), idiv("c_custkey", 14).cast("string")))
         .otherwise(F.concat(F.lit(" K"), c.cast("string"))).alias("uni_id"),
        F.when(c % 23 == 2, F.lit(" \t")).otherwise(F.concat(F.lit("Manager "), F.col("c_name"))).alias("name"),
        F.when(c % 12 < 2, F.concat(F.lit("041"), F.lpad(idiv("c_custkey", 12).cast("string"), 8, "0")))
         .when(c % 37 == 5, F.concat(F.lit("010"), F.lpad(((c + 1) % 900).cast("string"), 8, "0")))
         .otherwise(F.concat(F.lit("040"), F.lpad(c.cast("string"), 8, "0"))).alias("phone"),
        F.when(c % 19 == 4, F.lit("")).otherwise(F.concat(F.lit("pw"), c.cast("string"))).alias("password"),
        F.when(c % 9 == 1, F.concat(F.lit("m"), c.cast("string"), F.lit("@host")))
         .when(c % 17 == 2, F.lit(None))
         .otherwise(F.concat(F.lit("m"), c.cast("string"), F.lit("@uni.example"))).alias("email"),
        plus_minutes(base_time("2024-05-01"), 1000 - c % 1000).alias("submitted_at"))


def purge_ids(customer: DataFrame) -> DataFrame:
    return customer.filter(F.col("c_custkey") % 10 == 0).select(F.col("c_custkey").alias("user_id"))


def purge_plates(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    return part.filter(p % 50 == 0).select(F.concat(F.lit("PL-"), p.cast("string"))
                                           .alias("license_plate"))
