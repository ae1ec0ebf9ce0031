"""Reports: the joins, aggregates and subqueries of the SQL scripts.

Every function takes DataFrames and returns a DataFrame; nothing is collected.
Join strategy is left to Catalyst/AQE: tables whose size is bounded by
construction (service catalogue, payment methods, status domains) are
broadcast explicitly; all others are broadcast only when AQE measures them
below the threshold, else they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.operators.ranking import asc, desc, with_position
from parkops.sources import schema as S


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table whose row count is fixed by construction:
    the literal service catalogue and payment methods (``views.literal_table``,
    six and three rows) and the three-status domain. Every other table is
    broadcast only if AQE measures it below the adaptive threshold."""
    return F.broadcast(df)


def money_sum(c: str | Column) -> Column:
    return F.sum(c).cast(S.MONEY_SUM)


# D1
def total_revenue(payment: DataFrame) -> DataFrame:
    return (payment.filter(F.col("status") == "Paid")
            .agg(money_sum("amount").alias("total_revenue")))


# Grouped by method *type*; two method ids share 'Credit Card'.
def payments_by_method(payment: DataFrame, payment_method: DataFrame) -> DataFrame:
    return (payment.join(payment_method, "method_id")
            .groupBy("method_type").agg(money_sum("amount").alias("total_amount")))


# D3: inner join drops services never requested; grouped by name.
def requests_by_service(service_type: DataFrame, service_request: DataFrame) -> DataFrame:
    return (service_request.join(bounded(service_type), "service_id")
            .groupBy("service_name")
            .agg(F.count("request_id").alias("total_requests")))


# Garages with equal names merge; only garages with requests appear.
def requests_by_garage(garage: DataFrame, spots: DataFrame, requests: DataFrame) -> DataFrame:
    gs = spots.join(garage, "garage_id").select("spot_id", F.col("name").alias("garage_name"))
    return (requests.join(gs, "spot_id").groupBy("garage_name")
            .agg(F.count("request_id").alias("total_service_requests")))


# the same, in order of the count (ties by name), with its position.
def sort_by_aggregate(garage: DataFrame, spots: DataFrame, requests: DataFrame) -> DataFrame:
    return with_position(requests_by_garage(garage, spots, requests),
                         [desc("total_service_requests"), asc("garage_name")])


# Six-table left chain.
def invoice_ledger(invoice: DataFrame, payment: DataFrame, payment_method: DataFrame,
                   service_request: DataFrame, users: DataFrame, vehicle: DataFrame) -> DataFrame:
    i = invoice.alias("i")
    p = payment.alias("p")
    pm = payment_method.alias("pm")
    sr = service_request.select("request_id", "user_id", "vehicle_id").alias("sr")
    u = users.select("user_id", "uni_id", "name").alias("u")
    v = vehicle.select("vehicle_id", "license_plate").alias("v")
    # an invoice's request, user and vehicle first: its payments multiply the rows, so they
    # are met last and the widened rows are shuffled by the sort only
    return (i.join(sr, F.col("i.request_id") == F.col("sr.request_id"), "left")
            .join(u, F.col("sr.user_id") == F.col("u.user_id"), "left")
            .join(v, F.col("sr.vehicle_id") == F.col("v.vehicle_id"), "left")
            .join(p, F.col("i.invoice_id") == F.col("p.invoice_id"), "left")
            .join(pm, F.col("p.method_id") == F.col("pm.method_id"), "left")
            .select(F.col("i.invoice_id").alias("invoice_id"),
                    F.col("i.amount").alias("amount"),
                    F.col("i.date_issued").alias("date_issued"),
                    F.col("i.time_issued").alias("time_issued"),
                    F.col("p.payment_id").alias("payment_id"),
                    F.col("p.amount").alias("paid_amount"),
                    F.col("p.date_paid").alias("date_paid"),
                    F.col("p.time_paid").alias("time_paid"),
                    F.col("p.status").alias("payment_status"),
                    F.col("pm.method_type").alias("payment_method_type"),
                    F.col("pm.payment_info").alias("payment_details"),
                    F.col("sr.request_id").alias("related_request_id"),
                    F.col("u.uni_id").alias("user_uni_id"),
                    F.col("u.name").alias("user_name"),
                    F.col("v.license_plate").alias("vehicle_license_plate"))
            .orderBy(F.desc("date_issued"), F.desc("invoice_id")))


# B2: display headers of the ledger report (names with spaces).
# Column headings of the invoice report.
LEDGER_HEADINGS = {
    "invoice_id": "Invoice ID", "amount": "Amount", "date_issued": "Date Issued",
    "time_issued": "Time Issued", "payment_id": "Payment ID", "paid_amount": "Paid Amount",
    "date_paid": "Date Paid", "time_paid": "Time Paid", "payment_status": "Payment Status",
    "payment_method_type": "Payment Method Type",
    "payment_details": "Payment Credentials/Details",
    "related_request_id": "Related Service Request ID",
    "user_uni_id": "User University ID", "user_name": "User Name",
    "vehicle_license_plate": "Vehicle License Plate",
}


def project_alias(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    return df.select([F.col(c).alias(headings.get(c, c)) for c in df.columns])


# Five-table inner chain (requests without vehicle or spot drop out).
def request_spot_garage(requests: DataFrame, users: DataFrame, vehicle: DataFrame,
                        spots: DataFrame, garage: DataFrame) -> DataFrame:
    sr = requests.select("request_id", "user_id", "vehicle_id", "spot_id", "status", "created_at")
    return (sr.join(users.select("user_id", F.col("name").alias("user_name")), "user_id")
            .join(vehicle.select("vehicle_id", "license_plate"), "vehicle_id")
            .join(spots.select("spot_id", "spot_number", "garage_id"), "spot_id")
            .join(garage.select("garage_id", F.col("name").alias("garage_name")), "garage_id")
            .select("request_id", "user_name", "license_plate", "spot_number", "garage_name",
                    "status", "created_at"))


# The second (approver) join of the script is unused and left out; the
# row count is unchanged because it is a left join.
def vehicle_owner(vehicle: DataFrame, users: DataFrame) -> DataFrame:
    owner = users.select("user_id", F.col("name").alias("owner_name"))
    return (vehicle.join(owner, "user_id", "left")
            .select("vehicle_id", "license_plate", "model", "color", "owner_name",
                    "access_status", F.col("created_at").alias("registered_at"))
            .orderBy("license_plate"))


# B1
def users_by_name(users: DataFrame) -> DataFrame:
    return users.select("user_id", "uni_id", "name", "phone", "user_type", "access_status",
                        "created_at").orderBy("name")


# invoices newest first, id descending, with their position.
def sort_multi(invoice: DataFrame) -> DataFrame:
    return with_position(invoice.select("invoice_id", "request_id", "amount", "date_issued"),
                         [desc("date_issued"), desc("invoice_id")])


# D15
def having_count(requests: DataFrame, min_count: int = 1) -> DataFrame:
    return (requests.groupBy("user_id").agg(F.count("request_id").alias("request_count"))
            .filter(F.col("request_count") > min_count))


# IN (subquery with HAVING) as a left semi join.
def repeat_requesters(users: DataFrame, requests: DataFrame) -> DataFrame:
    return users.join(having_count(requests), "user_id", "left_semi").select("name")


# DISTINCT keeps one NULL.
def distinct_ids(requests: DataFrame) -> DataFrame:
    return requests.select("vehicle_id").distinct()


# NOT IN with SQL NULL semantics: one NULL vehicle_id in the subquery
# empties the result; an empty subquery keeps every row (NULL ids included);
# otherwise a NULL id never qualifies. Written as an equi anti join (shuffled
# or broadcast as AQE measures) gated by two uncorrelated EXISTS filters, so
# it never needs the whole subquery broadcast (Spark's null-aware anti join)
# nor a nested-loop join.
def never_used_not_in(vehicle: DataFrame, requests: DataFrame) -> DataFrame:
    ids = requests.select("vehicle_id")
    has_null = ids.filter(F.col("vehicle_id").isNull()).exists()
    nonempty = ids.exists()
    known = ids.filter(F.col("vehicle_id").isNotNull()).distinct()
    found = (vehicle.filter(F.col("vehicle_id").isNotNull()).join(known, "vehicle_id", "left_anti")
             .filter(~has_null))
    null_ids = vehicle.filter(F.col("vehicle_id").isNull() & ~nonempty)
    return found.unionByName(null_ids).select("license_plate")


# The evident intent: vehicles with no request.
def never_used_anti(vehicle: DataFrame, requests: DataFrame) -> DataFrame:
    used = requests.filter(F.col("vehicle_id").isNotNull()).select("vehicle_id").distinct()
    return vehicle.join(used, "vehicle_id", "left_anti").select("license_plate")


# Uncorrelated scalar subquery in '=' (more than one row is an error,
# no row gives NULL and so no match).
def scalar_eq(requests: DataFrame, vehicle: DataFrame, plate: str) -> DataFrame:
    vid = vehicle.filter(F.col("license_plate") == plate).select("vehicle_id").scalar()
    return requests.filter(F.col("vehicle_id") == vid).select(
        "request_id", "user_id", "vehicle_id", "status", "created_at")
