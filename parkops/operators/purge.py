"""Deletions across tables.

Deletes follow references lazily (cascade.py): key sets and tables are plans until they are
written; whole transforms, which write many tables, keep them. All-or-nothing per target: a target that
would leave a dangling reference is reported and left untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.operators.cascade import Deletion
from parkops.operators.skew import hot_map, spread_join
from parkops.session import cut_lineage


def drop_keys(df: DataFrame, keys: DataFrame, col: str, key_col: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``col`` is not among the keys (NULL stays)."""
    k = keys.select(F.col(key_col or col).alias(col)).distinct()
    return df.join(k, col, "left_anti")


# SET col = NULL WHERE col IN keys.
def nullify_reference(df: DataFrame, col: str, keys: DataFrame, key_col: str) -> DataFrame:
    k = keys.select(F.col(key_col).alias(col)).distinct().withColumn("_hit", F.lit(True))
    j = spread_join(df, k, col, "left", hot_map(df, col), [c for c in df.columns if c != col])
    return j.select(*[F.when(F.col("_hit"), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c))
                      .alias(c) if c == col else F.col(c) for c in df.columns])


# Payments whose invoice belongs to a request of one of the plates'
# vehicles (IN over a join, itself keyed by a subquery on the plate).
def nested_in_join(payments: DataFrame, invoices: DataFrame, requests: DataFrame,
                   vehicles: DataFrame, plates: DataFrame) -> DataFrame:
    vids = vehicles.join(plates.select("license_plate").distinct(), "license_plate",
                         "left_semi").select("vehicle_id")
    inv = (invoices.join(requests.join(vids, "vehicle_id", "left_semi").select("request_id"),
                         "request_id", "left_semi").select("invoice_id"))
    return payments.join(inv, "invoice_id", "left_semi")


# The payments of the users' requests' invoices are deleted, nothing else.
def join_delete(payments: DataFrame, invoices: DataFrame, requests: DataFrame,
                users: DataFrame) -> DataFrame:
    gone = Deletion("users", users.select("user_id"), {"service_request": requests, "invoice": invoices},
                    OF_USERS)
    return gone.table("payment", payments)


# References that take their row along when a user or a vehicle goes; approvals become NULL.
OF_REQUESTS = frozenset({("invoice", "request_id"), ("payment", "invoice_id")})
OF_USERS = OF_REQUESTS | {
    (t, "user_id") for t in ("service_request", "vehicle", "reports", "log_record", "requests",
                             "controls", "vehicle_registration_request")} | {
    ("log_record", "request_id"), ("log_record", "vehicle_id"), ("owns", "request_id")}
OF_VEHICLES = OF_REQUESTS | {("service_request", "vehicle_id")}
APPROVALS = frozenset((t, "approved_by") for t in
                      ("service_request", "vehicle", "vehicle_registration_request"))


# I8: delete by plate: payments -> invoices -> requests -> vehicle. A vehicle
# still referenced by a log or an ownership row (directly or through its
# requests) is reported and nothing of it is deleted.
@dataclass
class Cascade:
    plan: Deletion
    blocked: DataFrame    # (license_plate, reason)

    @property
    def vehicles(self) -> DataFrame:
        return self.plan.start_keys

    @property
    def requests(self) -> DataFrame:
        return self.plan.keys("service_request")

    @property
    def invoices(self) -> DataFrame:
        return self.plan.keys("invoice")


def plan_cascade(plates: DataFrame, vehicles: DataFrame, requests: DataFrame,
                 invoices: DataFrame, logs: DataFrame, owns: DataFrame, keep: bool = False) -> Cascade:
    target = vehicles.join(plates.select("license_plate").distinct(), "license_plate",
                           "left_semi").select("vehicle_id", "license_plate")
    reqs = requests.select("request_id", "vehicle_id").join(target.select("vehicle_id"),
                                                            "vehicle_id", "left_semi")

    def hits(ref: DataFrame, reason: str) -> DataFrame:
        by_vehicle = ref.select("vehicle_id").filter(F.col("vehicle_id").isNotNull())
        by_request = (ref.select("request_id").filter(F.col("request_id").isNotNull())
                      .join(reqs, "request_id").select("vehicle_id"))
        return by_vehicle.unionByName(by_request).distinct().withColumn("reason", F.lit(reason))

    blockers = first_reason(hits(logs, "referenced_by_log").unionByName(
        hits(owns, "referenced_by_owns")), "vehicle_id", ("referenced_by_log", "referenced_by_owns"))
    flagged = target.join(blockers, "vehicle_id", "left")
    if keep:
        flagged = cut_lineage(flagged)
    ok = flagged.filter(F.col("reason").isNull()).select("vehicle_id")
    plan = Deletion("vehicle", ok, {"vehicle": vehicles, "service_request": requests, "invoice": invoices},
                    OF_VEHICLES, keep=keep)
    return Cascade(plan, flagged.filter(F.col("reason").isNotNull()).select("license_plate", "reason"))


# Purge users and what depends on them, in the application's order.
# Only Students, Staff and Admins are purged, never the acting user. A user is blocked (left
# untouched and reported) when the deletion would leave a reference behind:
# another user's request or an ownership row uses one of their vehicles, a
# Requests row names one of their reports (reports go before Requests), or a
# surviving log names one of their reports.
@dataclass
class Purge:
    plan: Deletion
    blocked: DataFrame    # (user_id, reason)

    @property
    def users(self) -> DataFrame:
        return self.plan.start_keys


def plan_purge(candidates: DataFrame, acting_id: int, users: DataFrame, vehicles: DataFrame,
               requests: DataFrame, invoices: DataFrame, logs: DataFrame, reports: DataFrame,
               mn_requests: DataFrame, owns: DataFrame, keep: bool = False) -> Purge:
    cand = (candidates.select("user_id").distinct()
            .join(users.select("user_id", "user_type"), "user_id"))
    veh = vehicles.select("vehicle_id", F.col("user_id").alias("owner"))
    cand_veh = veh.join(cand.select(F.col("user_id").alias("owner")), "owner", "left_semi")
    # another user's request on one of the candidate's vehicles
    used = (requests.select("vehicle_id", "user_id").join(cand_veh, "vehicle_id")
            .filter(F.col("user_id") != F.col("owner"))
            .select(F.col("owner").alias("user_id")).distinct()
            .withColumn("reason", F.lit("vehicle_used_by_other")))
    # an ownership row on one of their vehicles whose request is not theirs
    req_owner = requests.select("request_id", F.col("user_id").alias("req_user"))
    owned = (owns.join(cand_veh, "vehicle_id").join(req_owner, "request_id", "left")
             .filter(F.col("req_user").isNull() | (F.col("req_user") != F.col("owner")))
             .select(F.col("owner").alias("user_id")).distinct()
             .withColumn("reason", F.lit("vehicle_in_owns")))
    cand_rep = reports.select("report_id", F.col("user_id").alias("author")).join(
        cand.select(F.col("user_id").alias("author")), "author", "left_semi")
    requested = (mn_requests.select("report_id").join(cand_rep, "report_id")
                 .select(F.col("author").alias("user_id")).distinct()
                 .withColumn("reason", F.lit("report_requested")))
    # logs naming one of their reports that no earlier step deletes
    cand_req = requests.select("request_id", F.col("user_id").alias("req_user"))
    lg = (logs.filter(F.col("report_id").isNotNull())
          .join(cand_rep, "report_id")
          .join(cand_req, "request_id", "left")
          .join(veh.withColumnRenamed("owner", "veh_user"), "vehicle_id", "left")
          .filter(~(F.coalesce(F.col("req_user") == F.col("author"), F.lit(False))
                    | F.coalesce(F.col("veh_user") == F.col("author"), F.lit(False))
                    | F.coalesce(F.col("user_id") == F.col("author"), F.lit(False))))
          .select(F.col("author").alias("user_id")).distinct()
          .withColumn("reason", F.lit("report_logged")))
    purgeable = F.col("user_type").isin("Student", "Staff", "Admin")
    rules = (cand.filter(F.col("user_type") == "Manager").select("user_id")
             .withColumn("reason", F.lit("manager"))
             .unionByName(cand.filter(~F.coalesce(purgeable | (F.col("user_type") == "Manager"),
                                                   F.lit(False)))
                          .select("user_id").withColumn("reason", F.lit("type_not_allowed")))
             .unionByName(cand.filter(F.col("user_id") == acting_id).select("user_id")
                          .withColumn("reason", F.lit("self"))))
    allr = rules.unionByName(used).unionByName(owned).unionByName(requested).unionByName(lg)
    blocked = first_reason(allr, "user_id", PURGE_REASONS)
    if keep:
        blocked = cut_lineage(blocked)
    ok = cand.select("user_id").join(blocked, "user_id", "left_anti")
    plan = Deletion("users", cut_lineage(ok) if keep else ok,
                    {"users": users, "vehicle": vehicles, "service_request": requests,
                     "invoice": invoices, "reports": reports}, OF_USERS, APPROVALS, keep)
    return Purge(plan, blocked)


def first_reason(flags: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """One reason per key: the earliest in ``order`` (ranked as an int so the
    aggregate stays a hash aggregate)."""
    rank = F.lit(len(order))
    for i, r in reversed(list(enumerate(order))):
        rank = F.when(F.col("reason") == r, F.lit(i)).otherwise(rank)
    best = flags.groupBy(key).agg(F.min(rank).alias("_r"))
    pick = F.lit(None).cast("string")
    for i, r in reversed(list(enumerate(order))):
        pick = F.when(F.col("_r") == i, F.lit(r)).otherwise(pick)
    return best.select(key, pick.alias("reason"))


# Fixed order in which purge blockers are reported.
PURGE_REASONS = ("manager", "type_not_allowed", "self", "vehicle_used_by_other",
                 "vehicle_in_owns", "report_requested", "report_logged")


def purge_apply(p: Purge, name: str, t: DataFrame) -> DataFrame:
    """The table ``name`` after the purge."""
    if name not in PURGE_TABLES:
        raise KeyError(name)
    return p.plan.table(name, t)


# Whole transforms over a dict of tables (names as in schema.TABLES).
PURGE_TABLES = ("users", "vehicle", "service_request", "invoice", "payment", "log_record", "owns",
                "reports", "requests", "controls", "vehicle_registration_request")


def purge_users(candidates: DataFrame, acting_id: int, t: dict) -> dict:
    p = plan_purge(candidates, acting_id, t["users"], t["vehicle"], t["service_request"],
                   t["invoice"], t["log_record"], t["reports"], t["requests"], t["owns"], keep=True)
    return {name: purge_apply(p, name, t[name]) for name in PURGE_TABLES} | {"blocked": p.blocked}


CASCADE_TABLES = ("payment", "invoice", "service_request", "vehicle")


def delete_vehicle_cascade(plates: DataFrame, t: dict) -> dict:
    c = plan_cascade(plates, t["vehicle"], t["service_request"], t["invoice"], t["log_record"],
                     t["owns"], keep=True)
    return {name: c.plan.table(name, t[name]) for name in CASCADE_TABLES} | {"blocked": c.blocked}
