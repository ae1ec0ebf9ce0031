"""Garage-shaped tables derived from the driver's parquet tables.

Each view is a plain projection (or one aggregation) of one driver table, so
Catalyst prunes columns and pushes filters through it into the parquet scan.
The derivations are fixed by FIXTURES.md; the oracle writes the same rules as
SQL CTEs (parkops/plans/oracle_views.py).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.types import StructType
from pyspark.sql import functions as F

from parkops.sources import schema as S

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one driver table. Nothing is kept between calls, so files added to a
    folder are seen by the next query."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def idiv(expr: str, n: int) -> Column:
    """Exact integer division of a long expression (SQL ``div``)."""
    return F.expr(f"({expr}) div {n}")


def days_after(day: str, n: Column) -> Column:
    return F.date_add(F.lit(day).cast("date"), n.cast("int")).cast("timestamp_ntz")


def plus_days(ts: Column, n: Column) -> Column:
    return F.timestamp_add("DAY", n.cast("int"), ts)


# --- fixed-size dimension tables (literal rows; the bound is their length) ---

# The service catalogue of the fixture views.
SERVICE_TYPE_ROWS = [
    (1, "Valet Drop-off", "An attendant parks the vehicle", Decimal("40.00")),
    (2, "Battery Charging", "Charging point for four hours", Decimal("65.00")),
    (3, "Windscreen Care", "Screen and mirrors cleaned on site", Decimal("18.50")),
    (4, "Covered Bay", "A bay under the roof for a day", None),
    (5, "Night Storage", "Supervised overnight parking", Decimal("25.00")),
    (6, "Visitor Pass", "Entry for a guest vehicle", Decimal("8.00")),
]

# Payment methods of the fixture views (two ids share a type).
PAYMENT_METHOD_ROWS = [
    (1, "Credit Card", "Online terminal"),
    (2, "Cash", "Till at the gate"),
    (3, "Credit Card", "Terminal on the upper deck"),
]


def literal_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A small literal table built on the JVM (inline of an array of typed
    structs): no Python worker is involved in scanning it."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def service_type(spark: SparkSession) -> DataFrame:
    return literal_table(spark, SERVICE_TYPE_ROWS, S.SERVICE_TYPE)


def payment_method(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PAYMENT_METHOD_ROWS, S.PAYMENT_METHOD)


# --- views over driver tables ---

def users(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    return customer.select(
        k.alias("user_id"),
        F.concat(F.lit("U"), k.cast("string")).alias("uni_id"),
        F.col("c_name").alias("name"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("010"), F.lpad((k % 900).cast("string"), 8, "0")))
         .alias("phone"),
        F.when(seg.isin("AUTOMOBILE", "BUILDING"), "Student")
         .when(seg == "FURNITURE", "Staff")
         .when(seg == "HOUSEHOLD", "Admin")
         .when(seg == "MACHINERY", "Manager").alias("user_type"),
        (F.col("c_acctbal") >= 0).alias("access_status"),
        days_after("2020-01-01", k % 1000).alias("created_at"),
    )


def _vehicle_access(size: Column) -> Column:
    return (F.when(size % 5 == 0, F.lit(None).cast("boolean"))
             .when(size % 5 == 1, F.lit(False)).otherwise(F.lit(True)))


def vehicle(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    access = _vehicle_access(F.col("p_size"))
    return part.select(
        p.alias("vehicle_id"),
        F.concat(F.lit("PL-"), p.cast("string")).alias("license_plate"),
        F.substring_index("p_name", " ", 1).alias("color"),
        idiv("p_partkey * 3", 4).alias("user_id"),
        F.col("p_brand").alias("model"),
        access.alias("access_status"),
        F.when(access, p % 10).alias("approved_by"),
        days_after("2020-01-01", p % 1000).alias("created_at"),
    )


def parking_garage(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    r = F.col("n_regionkey")
    return nation.select(
        k.cast("long").alias("garage_id"),
        F.when(k == 24, F.lit("NATION_23")).otherwise(F.col("n_name")).alias("name"),
        (r != 1).alias("garage_access"),
        F.when(r == 0, F.lit(None).cast("string")).when(r == 1, "Closed")
         .otherwise("Open").alias("garage_status"),
    )


def parking_spots(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        s.alias("spot_id"),
        F.col("s_name").alias("spot_number"),
        F.when(s % 4 == 0, "Reserved").when(s % 4 == 1, "available")
         .when(s % 4 == 2, "Available").alias("spot_status"),
        F.when(F.col("s_nationkey") == 7, F.lit(None).cast("long"))
         .otherwise(F.col("s_nationkey").cast("long")).alias("garage_id"),
    )


def service_request(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    st = F.col("o_orderstatus")
    open_ = st == "O"
    return orders.select(
        k.alias("request_id"),
        c.alias("user_id"),
        F.when(k % 7 == 0, F.lit(None).cast("long")).when(k % 97 == 0, k % 100)
         .otherwise(idiv("o_custkey * 4 + 2", 3)).alias("vehicle_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("service_id"),
        F.when(k % 53 == 0, F.lit(None).cast("string")).when(k % 50 == 0, "Cancelled")
         .when(st == "F", "Approved").when(open_, "Pending").when(st == "P", "Rejected")
         .alias("status"),
        F.when(~open_, c % 10).alias("approved_by"),
        F.col("o_orderdate").alias("created_at"),
        F.when(~open_, plus_days(F.col("o_orderdate"), k % 5)).alias("completed_at"),
        F.when(k % 4 == 0, F.lit(None).cast("long")).otherwise(idiv("o_custkey", 15))
         .alias("spot_id"),
        k.cast("string").alias("receipt_id"),
        F.when(k % 3 == 0, "Paid").otherwise("Pending").alias("payment_status"),
        F.when(k % 3 > 0, "Pending").when(k % 2 == 0, "Cash").otherwise("Credit").alias("payment_method"),
        F.when(k % 3 == 0, F.col("o_totalprice").cast(S.MONEY)).alias("payment_amount"),
    )


def vehicle_registration_request(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    size = F.col("p_size")
    status = (F.when(size % 3 == 0, "Pending").when(size % 3 == 1, "Approved")
               .otherwise("Rejected"))
    created = days_after("1995-01-01", p % 2400)
    return part.select(
        p.alias("request_id"),
        idiv("p_partkey * 3", 4).alias("user_id"),
        F.concat(F.when(p % 30 == 0, "PL-").otherwise("NEW-"), p.cast("string"))
         .alias("license_plate"),
        F.substring_index("p_name", " ", 1).alias("color"),
        F.col("p_brand").alias("model"),
        status.alias("status"),
        F.when(status != "Pending", p % 10).alias("approved_by"),
        created.alias("created_at"),
        F.when(status != "Pending", plus_days(created, F.lit(1))).alias("completed_at"),
    )


def invoice(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("invoice_id"),
        k.alias("request_id"),
        F.col("o_totalprice").cast(S.MONEY).alias("amount"),
        F.col("o_orderdate").cast("date").alias("date_issued"),
        F.lit("00:00:00").alias("time_issued"),
        k.cast("string").alias("receipt_id"),
    )


def payment(lineitem: DataFrame) -> DataFrame:
    """One payment per line item. (l_orderkey, l_linenumber) is not unique, so the id
    adds the row's place among the rows of the pair, in the order of the columns read
    here (rows equal in them are interchangeable). The place is counted among the rows of the
    order, so that a join by invoice needs no further shuffle. Orders hold a few rows, and a query
    that doesn't read payment_id drops the windows and their shuffle."""
    order = Window.partitionBy("invoice_id").orderBy("l_linenumber")
    rows = Window.partitionBy("invoice_id").orderBy(
        "l_linenumber", "l_extendedprice", "l_shipdate", "l_linestatus", "l_returnflag")
    ls, rf = F.col("l_linestatus"), F.col("l_returnflag")
    return lineitem.withColumnRenamed("l_orderkey", "invoice_id").select(
        ((F.col("invoice_id") * 8 + F.col("l_linenumber")) * 1000
         + F.row_number().over(rows) - F.rank().over(order) + 1).alias("payment_id"),
        "invoice_id",
        F.col("l_extendedprice").cast(S.MONEY).alias("amount"),
        F.col("l_shipdate").cast("date").alias("date_paid"),
        F.lit("00:00:00").alias("time_paid"),
        F.when(ls == "F", "Paid").when(ls == "O", "Failed").alias("status"),
        F.when(rf == "A", F.lit(1).cast("long")).when(rf == "N", F.lit(2).cast("long"))
         .when(rf == "R", F.lit(3).cast("long")).alias("method_id"),
    )


def log_record(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.alias("log_id"),
        (e % 10).alias("spot_id"),
        (e % 10).alias("gate_id"),
        (e % 100).alias("request_id"),
        F.lit(None).cast("long").alias("report_id"),
        (e % 40).alias("vehicle_id"),
        F.col("user_id"),
        ((e + 1) % 10).alias("sensor_id"),
        F.col("event_type").alias("log_type"),
        F.col("props").alias("details"),
        F.col("ts").alias("timestamp"),
    )


def reports(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("report_id"),
        F.col("event_type").alias("report_type"),
        F.col("user_id"),
        F.col("ts").cast("date").alias("date_generated"),
        F.date_format("ts", "HH:mm:ss").alias("time_generated"),
        F.col("props").alias("details"),
    )


def requests_mn(reports_df: DataFrame) -> DataFrame:
    """A requester for every report; another user than the report's where report_id % 10 > 0."""
    other = idiv("greatest(user_id - 1, 0)", 10) * 10 + 1
    return reports_df.select(F.when(F.col("report_id") % 10 == 0, F.col("user_id"))
                             .otherwise(other).alias("user_id"), "report_id")


def controls(users_df: DataFrame) -> DataFrame:
    return users_df.filter(F.col("user_type") == "Admin").select(
        "user_id", (F.col("user_id") % 25).alias("garage_id"))


def owns(service_request_df: DataFrame) -> DataFrame:
    """The vehicle and request of every approved request for a covered bay (service 4)."""
    return service_request_df.filter(
        F.col("vehicle_id").isNotNull() & (F.col("service_id") == 4) & (F.col("status") == "Approved")
    ).select("vehicle_id", "request_id")


def gates(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(s.alias("gate_id"), F.col("s_nationkey").cast("long").alias("garage_id"),
                           F.concat(F.lit("Gate "), s.cast("string")).alias("name"))


def sensors(supplier: DataFrame) -> DataFrame:
    """A sensor per supplier: at a gate (even keys) or over a spot."""
    s = F.col("s_suppkey")
    return supplier.select(
        s.alias("sensor_id"), F.when(s % 2 == 0, "Gate").otherwise("Occupancy").alias("sensor_type"),
        F.when(s % 2 == 1, s).alias("spot_id"))


def gate_sensors(supplier: DataFrame) -> DataFrame:
    return sensors(supplier).filter("sensor_type = 'Gate'").select(
        "sensor_id", F.col("sensor_id").alias("gate_id"))


def occupancy_sensor(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(s.alias("sensor_id"), s.alias("spot_id"),
                           F.when(F.col("s_acctbal") > 8000, F.lit(None).cast("boolean"))
                           .otherwise(F.col("s_acctbal") > 0).alias("is_occupied"))


def _inputs():
    from parkops.sources import inputs
    return inputs


class Garage:
    """Lazily built garage tables for one driver folder.

    ``Garage(spark, sf_dir).vehicle`` etc. Building a view only analyses the
    parquet schema; nothing runs until an action.
    """

    _BUILDERS = {
        "users": lambda g: users(g.raw("customer")),
        "vehicle": lambda g: vehicle(g.raw("part")),
        "service_type": lambda g: service_type(g.spark),
        "payment_method": lambda g: payment_method(g.spark),
        "parking_garage": lambda g: parking_garage(g.raw("nation")),
        "parking_spots": lambda g: parking_spots(g.raw("supplier")),
        "service_request": lambda g: service_request(g.raw("orders")),
        "vehicle_registration_request": lambda g: vehicle_registration_request(g.raw("part")),
        "invoice": lambda g: invoice(g.raw("orders")),
        "payment": lambda g: payment(g.raw("lineitem")),
        "log_record": lambda g: log_record(g.raw("events")),
        "reports": lambda g: reports(g.raw("events")),
        "requests": lambda g: requests_mn(g.reports),
        "controls": lambda g: controls(g.users),
        "owns": lambda g: owns(g.service_request),
        "gates": lambda g: gates(g.raw("supplier")),
        "sensors": lambda g: sensors(g.raw("supplier")),
        "gate_sensors": lambda g: gate_sensors(g.raw("supplier")),
        "occupancy_sensor": lambda g: occupancy_sensor(g.raw("supplier")),
        # inputs of the batch transforms (parkops/sources/inputs.py)
        "decisions": lambda g: _inputs().decisions(g.raw("orders")),
        "registration_decisions": lambda g: _inputs().registration_decisions(g.raw("part")),
        "garage_actions": lambda g: _inputs().garage_actions(g.raw("nation")),
        "vehicle_actions": lambda g: _inputs().vehicle_actions(g.raw("part")),
        "vehicle_edits": lambda g: _inputs().vehicle_edits(g.raw("part")),
        "submissions": lambda g: _inputs().submissions(g.raw("customer")),
        "payments_in": lambda g: _inputs().payments_in(g.raw("orders")),
        "registrations_in": lambda g: _inputs().registrations_in(g.raw("part")),
        "users_in": lambda g: _inputs().users_in(g.raw("customer")),
        "managers_in": lambda g: _inputs().managers_in(g.raw("customer")),
        "purge_ids": lambda g: _inputs().purge_ids(g.raw("customer")),
        "purge_plates": lambda g: _inputs().purge_plates(g.raw("part")),
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            self._cache[key] = read_driver(self.spark, self.sf_dir, name)
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        builders = type(self)._BUILDERS
        if name.startswith("_") or name not in builders:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = builders[name](self)
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @property
    def registrations(self) -> DataFrame:
        return self.vehicle_registration_request
