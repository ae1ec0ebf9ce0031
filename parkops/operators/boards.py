"""Boards: the lists, counters and rankings the application pages show.

The pages fetch a few queries per user and merge them in memory. Here each
board is one lazy plan; per-user boards are computed for all users at once
(grouping / partitioned ranking), never by looping over users.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.functions import text as T
from parkops.operators.ranking import (Key, asc, desc, position_in_group, top_k, top_k_per_group,
                                       with_position)
from parkops.operators.reports import bounded
from parkops.operators.skew import hot_map, spread_join
from parkops.sources import schema as S

LONG, STR = "long", "string"


def typed_null(t: str) -> Column:
    """NULL of a declared type (never VoidType, which parquet cannot store)."""
    return F.lit(None).cast(t)


# Align a table to another shape: literal tag columns, the target's
# missing columns as typed NULLs (never VoidType), extra columns kept.
def tag_literal_null(df: DataFrame, target: DataFrame, tags: dict[str, object]) -> DataFrame:
    cols = []
    for f in target.schema.fields:
        if f.name in tags:
            cols.append(F.lit(tags[f.name]).cast(f.dataType).alias(f.name))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in target.columns]
    extra += [F.lit(v).alias(k) for k, v in tags.items() if k not in target.columns]
    return df.select(*cols, *extra)


# Equality filter where 'all' means no filter.
def filter_eq(df: DataFrame, column: str, value: str) -> DataFrame:
    return df if value == "all" else df.filter(F.col(column) == value)


# C14: the garage status looked up on its own primary key is the row's own
# status; empty or NULL reads as 'Open'.
def garage_status_lookup(garage: DataFrame) -> DataFrame:
    return garage.select("garage_id", "name", F.coalesce(
        F.nullif(F.col("garage_status"), F.lit("")), F.lit("Open")).alias("garage_status"))


# C4: service requests with catalogue, owner, vehicle, spot, garage and the
# approver (a second, aliased use of users).
def service_request_board(requests: DataFrame, service_type: DataFrame, users: DataFrame,
                          vehicle: DataFrame, spots: DataFrame, garage: DataFrame) -> DataFrame:
    by, hot = ["request_id"], lambda c: hot_map(requests, c)
    st = bounded(service_type).select("service_id", "service_name", F.col("price").alias("service_price"))
    u = users.select("user_id", F.col("name").alias("user_name"), "user_type", "uni_id")
    ap = users.select(F.col("user_id").alias("approved_by"), F.col("name").alias("approver_name"))
    v = vehicle.select("vehicle_id", "license_plate", F.col("model").alias("vehicle_model"))
    # a spot's garage is looked up once per spot, not per request
    ps = spots.select("spot_id", "spot_number", "garage_id").join(
        garage.select("garage_id", F.col("name").alias("garage_name")), "garage_id", "left").drop("garage_id")
    board = spread_join(requests.join(st, "service_id"), u, "user_id", "inner", hot("user_id"), by)
    board = spread_join(board, v, "vehicle_id", "left", hot("vehicle_id"), by)
    board = spread_join(board, ps, "spot_id", "left", hot("spot_id"), by)
    board = spread_join(board, ap, "approved_by", "left", hot("approved_by"), by)
    return board.select(*requests.columns, "service_name", "service_price", "user_name", "user_type",
                        "uni_id", "license_plate", "vehicle_model", "spot_number", "garage_name",
                        "approver_name", F.lit(T.SERVICE_TAG).alias("request_type"))


# Registration requests shaped like C4 (B3: literal tags, typed NULLs).
def registration_board(registrations: DataFrame, users: DataFrame) -> DataFrame:
    by, hot = ["request_id"], lambda c: hot_map(registrations, c)
    u = users.select("user_id", F.col("name").alias("user_name"), "user_type", "uni_id")
    ap = users.select(F.col("user_id").alias("approved_by"), F.col("name").alias("approver_name"))
    board = spread_join(registrations, u, "user_id", "inner", hot("user_id"), by)
    board = spread_join(board, ap, "approved_by", "left", hot("approved_by"), by)
    return board.select("request_id", "user_id", typed_null(LONG).alias("vehicle_id"),
                        typed_null(LONG).alias("service_id"), "status", "approved_by", "created_at",
                        "completed_at", typed_null(LONG).alias("spot_id"),
                        typed_null(STR).alias("receipt_id"),
                        F.lit(T.REGISTRATION_SERVICE).alias("service_name"),
                        F.lit(0).cast(S.MONEY).alias("service_price"), "user_name", "user_type", "uni_id",
                        "license_plate", F.col("model").alias("vehicle_model"),
                        typed_null(STR).alias("spot_number"), typed_null(STR).alias("garage_name"),
                        "approver_name", F.lit(T.REGISTRATION_TAG).alias("request_type"))


# G1: both kinds in one list (UNION ALL by name; missing columns NULL).
def requests_unified(service_board: DataFrame, registration_board_df: DataFrame,
                     status: str = "all") -> DataFrame:
    return filter_eq(service_board, "status", status).unionByName(
        filter_eq(registration_board_df, "status", status), allowMissingColumns=True)


# pending first, then newest (whole seconds); ties: service before
# registration, then the higher id.
def board_order_keys() -> list[Key]:
    return [asc(F.when(F.col("status") == "Pending", 0).otherwise(1)),
            desc(F.date_trunc("second", F.col("created_at"))),
            asc("request_type"), desc("request_id")]


def board_order(board: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return with_position(board, board_order_keys(), keys=keys)


def board_keys(requests: DataFrame, registrations: DataFrame, service_type: DataFrame,
               users: DataFrame) -> DataFrame:
    """What orders the unified board, of the rows it has: the inner joins of the two boards
    as semi joins, without those that only add columns."""
    known = users.select("user_id")
    cols = ("status", "created_at", "request_id")
    svc = (requests.select(*cols, "user_id", "service_id")
           .join(bounded(service_type).select("service_id"), "service_id", "left_semi")
           .join(known, "user_id", "left_semi"))
    reg = registrations.select(*cols, "user_id").join(known, "user_id", "left_semi")
    return svc.select(*cols, F.lit(T.SERVICE_TAG).alias("request_type")).unionByName(
        reg.select(*cols, F.lit(T.REGISTRATION_TAG).alias("request_type")))


# B14
# The cells shown in a request-board row.
BOARD_CELLS = ["request_id", "user_name", "uni_id", "service_name", "license_plate",
               "spot_number", "garage_name", "status"]


def row_search(board: DataFrame, term: str, cells: Sequence[str] = BOARD_CELLS) -> DataFrame:
    return board.filter(T.row_matches(list(cells), term))


# Students and Staff see their own rows, Admins and Managers all rows.
# Own rows are an equi semi join on the viewer id; "all rows" is an
# uncorrelated EXISTS on the viewer's role (a filter, not a join).
def role_scope(rows: DataFrame, users: DataFrame, viewer_id: int) -> DataFrame:
    viewer = users.filter(F.col("user_id") == viewer_id)
    own = rows.join(viewer.filter(F.col("user_type").isin("Student", "Staff")).select("user_id"),
                    "user_id", "left_semi")
    every = rows.filter(viewer.filter(F.col("user_type").isin("Admin", "Manager")).exists())
    return own.unionByName(every)


# Vehicles not approved (false or NULL) with their owner.
def pending_vehicles_direct(vehicle: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select("user_id", F.col("name").alias("user_name"), "uni_id", "user_type")
    return (vehicle.filter(~F.col("access_status") | F.col("access_status").isNull())
            .join(u, "user_id")
            .select(*vehicle.columns, "user_name", "uni_id", "user_type",
                    F.lit(T.DIRECT_SOURCE).alias("source")))


# Pending registration requests with their owner.
def pending_registrations_board(registrations: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select("user_id", F.col("name").alias("user_name"), "uni_id", "user_type")
    return (registrations.filter(F.col("status") == "Pending").join(u, "user_id")
            .select(*registrations.columns, "user_name", "uni_id", "user_type",
                    F.lit(T.REQUEST_SOURCE).alias("source"),
                    typed_null(LONG).alias("vehicle_id"),
                    typed_null(LONG).alias("vehicle_approved_by")))


# G3
def pending_vehicles(vehicle: DataFrame, registrations: DataFrame, users: DataFrame) -> DataFrame:
    return pending_vehicles_direct(vehicle, users).unionByName(
        pending_registrations_board(registrations, users), allowMissingColumns=True)


# D17
def pending_vehicle_count(pending: DataFrame) -> DataFrame:
    return pending.agg(F.count(F.lit(1)).alias("pending_vehicle_count"))


# Case-insensitive status, NULL garage status counts as open.
def available_spots(spots: DataFrame, garage: DataFrame) -> DataFrame:
    g = garage.select("garage_id", F.col("name").alias("garage_name"), "garage_status")
    return (spots.filter(F.upper("spot_status") == "AVAILABLE").join(g, "garage_id")
            .filter(F.coalesce(F.col("garage_status"), F.lit("Open")) == "Open")
            .select(*spots.columns, "garage_name", "garage_status")
            .orderBy("garage_name", "spot_number"))


# D13
def available_by_garage(available: DataFrame) -> DataFrame:
    return available.groupBy("garage_name").agg(F.count(F.lit(1)).alias("available_count"))


# Every spot with its garage, if any.
def all_spots_audit(spots: DataFrame, garage: DataFrame) -> DataFrame:
    g = garage.select("garage_id", F.col("name").alias("garage_name"), "garage_status")
    return (spots.join(g, "garage_id", "left")
            .select("spot_id", "spot_number", "spot_status", "garage_id", "garage_name",
                    "garage_status")
            .orderBy("garage_name", "spot_number"))


# Approved on one day, as a range so parquet statistics can prune.
def approved_on_day(requests: DataFrame, day: str) -> DataFrame:
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")
    return requests.filter((F.col("status") == "Approved") & (F.col("completed_at") >= start)
                           & (F.col("completed_at") < end)).select(
        "request_id", "user_id", "status", "completed_at")


# B15
def vehicle_classes(vehicle: DataFrame) -> DataFrame:
    return vehicle.select("vehicle_id", "user_id", "license_plate", "access_status",
                          F.when(F.col("access_status"), "approved").otherwise("pending")
                          .alias("vehicle_class"))


# Approved first, then newest, then the higher id.
def vehicle_order_keys() -> list[Key]:
    return [asc(F.when(F.col("access_status"), 0).otherwise(1)), desc("created_at"),
            desc("vehicle_id")]


def sort_conditional(vehicle: DataFrame) -> DataFrame:
    return with_position(vehicle, vehicle_order_keys())


# B17 (+H17): every owner's vehicles in display order with the option label.
def my_vehicles(vehicle: DataFrame) -> DataFrame:
    labelled = vehicle.withColumn("label", T.vehicle_label(
        F.col("license_plate"), F.col("model"), F.col("color"), F.col("access_status")))
    return position_in_group(labelled, ["user_id"], vehicle_order_keys())


# B18
def managers(users: DataFrame) -> DataFrame:
    return users.filter(F.col("user_type") == "Manager").orderBy(F.desc("created_at"))


# B19
def pending_registrations(registrations: DataFrame) -> DataFrame:
    return (registrations.filter(F.col("status") == "Pending")
            .withColumn("status_display", F.lit(T.PENDING_REGISTRATION)))


# B20
def service_catalog(service_type: DataFrame) -> DataFrame:
    return (service_type.select("service_id", "service_name", "description",
                                F.coalesce(F.col("price"), F.lit(0).cast(S.MONEY)).alias("price"))
            .orderBy("service_name"))


# A user's service requests (all users at once).
def user_requests(requests: DataFrame, service_type: DataFrame, vehicle: DataFrame,
                  spots: DataFrame) -> DataFrame:
    st = bounded(service_type).select("service_id", "service_name",
                                      F.col("price").alias("service_price"))
    v = vehicle.select("vehicle_id", "license_plate")
    ps = spots.select("spot_id", "spot_number")
    by, hot = ["request_id"], lambda c: hot_map(requests, c)
    rows = spread_join(requests.join(st, "service_id"), v, "vehicle_id", "left", hot("vehicle_id"), by)
    return spread_join(rows, ps, "spot_id", "left", hot("spot_id"), by).select(
        *requests.columns, "service_name", "service_price", "license_plate", "spot_number",
        F.lit(T.SERVICE_TAG).alias("request_type"))


# With the user's registration requests.
def user_requests_unified(user_reqs: DataFrame, registrations: DataFrame) -> DataFrame:
    regs = registrations.select(
        *registrations.columns, F.lit(T.REGISTRATION_SERVICE).alias("service_name"),
        F.lit(0).cast(S.MONEY).alias("service_price"), typed_null(STR).alias("spot_number"),
        F.lit(T.REGISTRATION_TAG).alias("request_type"))
    return user_reqs.unionByName(regs, allowMissingColumns=True)


# newest ten per user over both kinds (whole seconds, then service
# first, then the higher id).
def recent_order_keys() -> list[Column]:
    return [F.date_trunc("second", F.col("created_at")).desc(), F.col("request_type").asc(),
            F.col("request_id").desc()]


def recent_requests(unified: DataFrame, k: int = 10) -> DataFrame:
    slim = unified.select("user_id", "request_type", "request_id", "status", "created_at",
                          "service_name", "license_plate", "spot_number")
    return top_k_per_group(slim, ["user_id"], recent_order_keys(), k)


# ten newest pending of each kind, merged, ten newest overall.
def pending_top10(requests: DataFrame, registrations: DataFrame, service_type: DataFrame,
                  users: DataFrame, vehicle: DataFrame, spots: DataFrame, k: int = 10) -> DataFrame:
    u = users.select("user_id", F.col("name").alias("user_name"), "user_type")
    st = bounded(service_type).select("service_id", "service_name")
    svc = (requests.filter(F.col("status") == "Pending").join(st, "service_id").join(u, "user_id")
           .join(vehicle.select("vehicle_id", "license_plate"), "vehicle_id", "left")
           .join(spots.select("spot_id", "spot_number"), "spot_id", "left")
           .select("request_id", "user_id", "status", "created_at", "service_name", "user_name",
                   "user_type", "license_plate", "spot_number",
                   F.lit(T.SERVICE_TAG).alias("request_type")))
    reg = (registrations.filter(F.col("status") == "Pending").join(u, "user_id")
           .select("request_id", "user_id", "status", "created_at",
                   F.lit(T.REGISTRATION_SERVICE).alias("service_name"), "user_name", "user_type",
                   "license_plate", typed_null(STR).alias("spot_number"),
                   F.lit(T.REGISTRATION_TAG).alias("request_type")))
    branch = [F.col("created_at").desc(), F.col("request_id").desc()]
    merged = top_k(svc, branch, k).unionByName(top_k(reg, branch, k))
    return top_k(merged, [F.col("created_at").desc(), F.col("request_type").asc(),
                          F.col("request_id").desc()], k)


# Correlated counts as pre-aggregations + left joins (0 when none).
def user_activity(users: DataFrame, vehicle: DataFrame, requests: DataFrame) -> DataFrame:
    vc = (vehicle.filter(F.col("access_status")).groupBy("user_id")
          .agg(F.count(F.lit(1)).alias("vehicle_count")))
    rc = requests.groupBy("user_id").agg(F.count(F.lit(1)).alias("request_count"))
    return (users.join(vc, "user_id", "left").join(rc, "user_id", "left")
            .select(*users.columns, F.coalesce("vehicle_count", F.lit(0)).alias("vehicle_count"),
                    F.coalesce("request_count", F.lit(0)).alias("request_count")))


# newest first when created_at exists, else highest id first.
def sort_fallback(df: DataFrame, id_col: str = "user_id") -> DataFrame:
    if "created_at" in df.columns:
        order = [desc("created_at"), desc(id_col)]
    else:
        order = [desc(id_col)]
    return with_position(df, order)


# Per garage (id and name), spots counted with COUNT(col) after a left
# join so that an empty garage gives 0.
def garage_occupancy(garage: DataFrame, spots: DataFrame) -> DataFrame:
    g = garage_status_lookup(garage)
    s = spots.select("garage_id", "spot_id", "spot_status")
    flag = lambda v: F.sum(F.when(F.col("spot_status") == v, 1).otherwise(0)).cast("long")
    return (g.join(s, "garage_id", "left").groupBy("garage_id", "name", "garage_status")
            .agg(F.count("spot_id").alias("total_spots"),
                 flag("Available").alias("available_spots"),
                 flag("Reserved").alias("reserved_spots")))


def status_domain(spark) -> DataFrame:
    from parkops.sources.views import literal_table
    from pyspark.sql.types import StringType, StructField, StructType
    return literal_table(spark, [(s,) for s in S.REQUEST_STATUSES],
                         StructType([StructField("status", StringType())]))


# Counts of both request kinds merged onto the fixed status domain;
# other and NULL statuses are dropped, missing ones are 0.
def status_counts(requests: DataFrame, registrations: DataFrame) -> DataFrame:
    statuses = requests.select("status").unionByName(registrations.select("status"))
    counts = statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    dom = bounded(status_domain(requests.sparkSession))
    return (dom.join(counts, "status", "left")
            .select("status", F.coalesce("n", F.lit(0)).alias("count")))


# The same as one status -> count map, returned as rows again.
def status_counts_map(counts: DataFrame) -> DataFrame:
    # One row whose map has one entry per domain status (bounded).
    m = counts.agg(F.map_from_entries(F.collect_list(F.struct("status", "count"))).alias("m"))
    return m.select(F.explode("m").alias("status", "count"))


# D8 / D9
def user_type_counts(users: DataFrame) -> DataFrame:
    return users.groupBy("user_type").agg(F.count(F.lit(1)).alias("count"))


def user_total(type_counts: DataFrame) -> DataFrame:
    return type_counts.agg(F.sum("count").cast("long").alias("total_users"))


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


# One row of counters over four tables: each table contributes 0/1
# flags to a union, and a single aggregate sums them (no join at all).
def admin_kpis(requests: DataFrame, registrations: DataFrame, users: DataFrame,
               vehicle: DataFrame, day: str) -> DataFrame:
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")
    flag = lambda c: F.when(c, 1).otherwise(0)
    zero = F.lit(0)
    cols = ("pending_count", "approved_today", "total_users", "total_vehicles")
    parts = [
        requests.select(flag(F.col("status") == "Pending"),
                        flag((F.col("status") == "Approved") & (F.col("completed_at") >= start)
                             & (F.col("completed_at") < end)), zero, zero),
        registrations.select(flag(F.col("status") == "Pending"), zero, zero, zero),
        users.select(zero, zero, F.lit(1), zero),
        vehicle.select(zero, zero, zero, flag(F.col("access_status"))),
    ]
    union = reduce(lambda a, b: a.union(b), [p.toDF(*cols) for p in parts])
    return union.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in cols])


# Per Student/Staff user: approved vehicles, requests of both kinds and
# per-status counts of both kinds.
def user_kpis(users: DataFrame, vehicle: DataFrame, requests: DataFrame,
              registrations: DataFrame) -> DataFrame:
    both = requests.select("user_id", "status").unionByName(registrations.select("user_id", "status"))
    per = both.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("request_count"),
        _count_if(F.col("status") == "Pending").alias("pending_count"),
        _count_if(F.col("status") == "Approved").alias("approved_count"),
        _count_if(F.col("status") == "Rejected").alias("rejected_count"))
    veh = (vehicle.groupBy("user_id")
           .agg(_count_if(F.col("access_status")).alias("approved_vehicles")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (users.filter(F.col("user_type").isin("Student", "Staff")).select("user_id", "user_type")
            .join(veh, "user_id", "left").join(per, "user_id", "left")
            .select("user_id", "user_type", zero("approved_vehicles"), zero("request_count"),
                    zero("pending_count"), zero("approved_count"), zero("rejected_count")))


# Per user: approved, pending (vehicles not approved + pending
# registrations), total (vehicles + pending registrations).
def vehicle_stats(users: DataFrame, vehicle: DataFrame, registrations: DataFrame) -> DataFrame:
    veh = vehicle.groupBy("user_id").agg(
        _count_if(F.col("access_status")).alias("approved"),
        _count_if(~F.col("access_status") | F.col("access_status").isNull()).alias("not_approved"),
        F.count(F.lit(1)).alias("vehicles"))
    reg = (registrations.filter(F.col("status") == "Pending").groupBy("user_id")
           .agg(F.count(F.lit(1)).alias("pending_regs")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (users.select("user_id").join(veh, "user_id", "left").join(reg, "user_id", "left")
            .select("user_id", z("approved").alias("approved"),
                    (z("not_approved") + z("pending_regs")).alias("pending"),
                    (z("vehicles") + z("pending_regs")).alias("total")))


# The guard count of requests per vehicle.
def requests_per_vehicle(vehicle: DataFrame, requests: DataFrame) -> DataFrame:
    rc = (requests.filter(F.col("vehicle_id").isNotNull()).groupBy("vehicle_id")
          .agg(F.count(F.lit(1)).alias("request_count")))
    return (vehicle.select("vehicle_id").join(rc, "vehicle_id", "left")
            .select("vehicle_id", F.coalesce("request_count", F.lit(0)).alias("request_count")))


# H: scalar text functions over users.
def scalar_text(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id",
        F.upper("name").alias("name_upper"), F.lower("uni_id").alias("uni_id_lower"),
        F.coalesce(F.col("phone"), F.lit(T.NOT_AVAILABLE)).alias("phone_or_na"),
        F.col("user_id").cast("string").alias("user_id_text"),
        T.trim_app(F.concat(F.lit(" \t"), F.col("name"), F.lit("\n"))).alias("name_trimmed"),
        T.is_blank("phone").alias("phone_blank"),
        T.byte_length("name").alias("name_bytes"),
        T.valid_phone("phone").alias("phone_valid"),
        T.phone_digits("phone").alias("phone_digits"),
        T.initial("name").alias("initial"),
        T.ucfirst(F.lower("user_type")).alias("type_display"),
        T.active_label(F.col("access_status")).alias("access_label"),
    )


def _col_or_null(df: DataFrame, name: str, t: str) -> Column:
    return F.col(name) if name in df.columns else typed_null(t)


# H: labels of the request board.
def scalar_labels(board: DataFrame) -> DataFrame:
    return board.select(
        "request_type", "request_id",
        T.payment_label(F.col("request_type"), F.col("status"), F.col("payment_status"),
                        _col_or_null(board, "payment_method", STR),
                        _col_or_null(board, "payment_amount", "decimal(10,2)"))
         .alias("payment_label"),
        F.when(F.col("request_type") == T.REGISTRATION_TAG, F.lit("-"))
         .otherwise(F.concat(F.lit(T.CURRENCY), T.format_money(F.coalesce(F.col("service_price"),
                                                                      F.lit(0)))))
         .alias("price_label"),
        T.decided_by_label(F.col("status"), F.col("approver_name")).alias("decided_by"),
        T.or_na("license_plate").alias("plate_label"),
        T.or_na("spot_number").alias("spot_label"),
        T.format_day("created_at").alias("created_day"),
        T.format_clock("created_at").alias("created_clock"),
        T.format_stamp("created_at").alias("created_stamp"),
        T.date_part("created_at").alias("created_date"),
        T.time_part("created_at").alias("created_time"),
    )
