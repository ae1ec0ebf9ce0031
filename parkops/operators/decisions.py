"""Workflow changes applied as set-based transforms (SURVEY §2 I1-I7, I12,
I13, C11).

Each takes base tables and a table of inputs and returns new tables. Inputs
are reduced to one row per target key with an aggregate (partial aggregation
first, so a key with very many inputs stays cheap), then joined to the base
table and applied with ``when``; no row multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.functions import text as T
from parkops.operators.ranking import asc
from parkops.operators.skew import hot_map, spread_join
from parkops.operators.tables import assign_identity

_NEW = "_new"


def latest(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the input with the greatest (order..., fields...)
    tuple; a struct max is a plain aggregate (map-side partial)."""
    m = df.groupBy(key).agg(F.max(F.struct(*order, *fields)).alias("_m"))
    return m.select(key, *[F.col("_m." + c).alias(c) for c in order + fields])


def apply_updates(base: DataFrame, key: str, updates: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """Left-join one update row per key and replace the given columns where
    matched. ``sets`` expressions may use the update's columns."""
    u = updates.withColumn(_NEW, F.lit(True))
    j = base.join(u, key, "left")
    hit = F.col(_NEW).isNotNull()
    return j.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
                      for c in base.columns])


# C11: an uncorrelated EXISTS: every row passes or none does.
def exists_gate(rows: DataFrame, sub: DataFrame) -> DataFrame:
    return rows.filter(sub.exists())


# Request decisions. The request takes its latest decision; every
# approve decision in the batch also approves the linked vehicle and
# reserves the linked spot (a later reject reverts neither).
def _decided(decisions: DataFrame) -> DataFrame:
    return latest(decisions, "request_id", ["decided_at", "decided_by"], ["action"])


def request_decisions_requests(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    d = _decided(decisions)
    approve = F.col("action") == "approve"
    return apply_updates(requests, "request_id", d, {
        "status": F.when(approve, F.lit("Approved")).otherwise(F.lit("Rejected")),
        "approved_by": F.col("decided_by"),
        "completed_at": F.col("decided_at"),
    })


def _approvals(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    a = decisions.filter(F.col("action") == "approve")
    return a.join(requests.select("request_id", "vehicle_id", "spot_id"), "request_id")


def request_decisions_vehicles(vehicles: DataFrame, requests: DataFrame,
                               decisions: DataFrame) -> DataFrame:
    a = _approvals(requests, decisions).filter(F.col("vehicle_id").isNotNull())
    last = latest(a, "vehicle_id", ["decided_at", "decided_by"], [])
    return apply_updates(vehicles, "vehicle_id", last, {
        "access_status": F.lit(True), "approved_by": F.col("decided_by")})


def request_decisions_spots(spots: DataFrame, requests: DataFrame, decisions: DataFrame) -> DataFrame:
    keys = (_approvals(requests, decisions).filter(F.col("spot_id").isNotNull())
            .select("spot_id").distinct())
    return apply_updates(spots, "spot_id", keys, {"spot_status": F.lit("Reserved")})


# Registration decisions, as if taken one after the other (by time, manager,
# request). An approval inserts an approved vehicle and closes the request, unless
# a vehicle has the plate by then; a reject closes the request and removes no
# vehicle. So of a free plate the first approval counts, and a request ends with
# the latest of its rejects and that approval.
def _registration_approvals(registrations: DataFrame, vehicles: DataFrame,
                            decisions: DataFrame) -> DataFrame:
    a = decisions.filter(F.col("action") == "approve").select("request_id", "decided_at", "decided_by")
    r = registrations.select("request_id", "user_id", "license_plate", "color", "model")
    free = a.join(r, "request_id").join(vehicles.select("license_plate"), "license_plate", "left_anti")
    first = free.groupBy("license_plate").agg(F.min(F.struct(
        "decided_at", "decided_by", "request_id", "user_id", "color", "model")).alias("_f"))
    return first.select("license_plate", "_f.*")


def registration_decisions_registrations(registrations: DataFrame, vehicles: DataFrame,
                                         decisions: DataFrame) -> DataFrame:
    cols = ["request_id", "action", "decided_by", "decided_at"]
    won = _registration_approvals(registrations, vehicles, decisions)
    effective = (decisions.filter(F.col("action") == "reject").select(*cols)
                 .unionByName(won.withColumn("action", F.lit("approve")).select(*cols)))
    last = latest(effective, "request_id", ["decided_at", "decided_by"], ["action"])
    return apply_updates(registrations, "request_id", last, {
        "status": F.when(F.col("action") == "approve", F.lit("Approved")).otherwise(F.lit("Rejected")),
        "approved_by": F.col("decided_by"),
        "completed_at": F.col("decided_at"),
    })


def registration_decisions_vehicles(registrations: DataFrame, vehicles: DataFrame,
                                    decisions: DataFrame) -> DataFrame:
    won = _registration_approvals(registrations, vehicles, decisions)
    new = won.select("license_plate", "color", "user_id", "model",
                     F.lit(True).alias("access_status"), F.col("decided_by").alias("approved_by"),
                     F.col("decided_at").alias("created_at"), "request_id")
    new = assign_identity(new, vehicles, "vehicle_id",
                          [asc("created_at"), asc("request_id")])
    return vehicles.unionByName(new.select(*vehicles.columns))


# open/close garages (when one garage gets both, 'open' wins).
def set_garage_status(garage: DataFrame, actions: DataFrame) -> DataFrame:
    a = actions.groupBy("garage_id").agg(F.max("action").alias("action"))
    return apply_updates(garage, "garage_id", a, {
        "garage_status": F.when(F.col("action") == "open", F.lit("Open")).otherwise(F.lit("Closed"))})


# I4
def approve_vehicles(vehicles: DataFrame, actions: DataFrame) -> DataFrame:
    a = (actions.filter(F.col("action") == "approve").groupBy("vehicle_id")
         .agg(F.max("acted_by").alias("acted_by")))
    return apply_updates(vehicles, "vehicle_id", a, {
        "access_status": F.lit(True), "approved_by": F.col("acted_by")})


# reject = delete the vehicle and its logs, unless requests use it (the
# page refuses, reporting the count) or an ownership row names it (the
# delete fails and rolls back). Blocked vehicles are reported with the reason.
def _reject_split(vehicles: DataFrame, requests: DataFrame, owns: DataFrame, actions: DataFrame):
    ids = actions.filter(F.col("action") == "reject").select("vehicle_id").distinct()
    ids = ids.join(vehicles.select("vehicle_id"), "vehicle_id", "left_semi")
    used = (requests.filter(F.col("vehicle_id").isNotNull()).groupBy("vehicle_id")
            .agg(F.count(F.lit(1)).alias("request_count")))
    owned = owns.select("vehicle_id").distinct().withColumn("_owned", F.lit(True))
    j = ids.join(used, "vehicle_id", "left").join(owned, "vehicle_id", "left")
    reason = (F.when(F.col("request_count").isNotNull(), F.lit("has_requests"))
               .when(F.col("_owned").isNotNull(), F.lit("referenced_by_owns")))
    j = j.select("vehicle_id", F.coalesce("request_count", F.lit(0)).alias("request_count"),
                 reason.alias("reason"))
    return j.filter(F.col("reason").isNull()).select("vehicle_id"), j.filter(F.col("reason").isNotNull())


def reject_vehicles_vehicles(vehicles, requests, owns, actions):
    gone, _ = _reject_split(vehicles, requests, owns, actions)
    return vehicles.join(gone, "vehicle_id", "left_anti")


def reject_vehicles_logs(logs, vehicles, requests, owns, actions):
    gone, _ = _reject_split(vehicles, requests, owns, actions)
    return spread_join(logs, gone, "vehicle_id", "left_anti", hot_map(logs, "vehicle_id"), ["log_id"])


def reject_vehicles_blocked(vehicles, requests, owns, actions):
    _, blocked = _reject_split(vehicles, requests, owns, actions)
    return blocked


# An owner deletes a vehicle: refused when requests use it; nothing
# happens when no vehicle has that id and owner; the delete fails when a log
# or an ownership row still names the vehicle (they are not removed first).
def delete_own_outcome(vehicles: DataFrame, requests: DataFrame, logs: DataFrame,
                       owns: DataFrame, deletions: DataFrame) -> DataFrame:
    used = (requests.filter(F.col("vehicle_id").isNotNull()).groupBy("vehicle_id")
            .agg(F.count(F.lit(1)).alias("request_count")))
    refs = (logs.select("vehicle_id").unionByName(owns.select("vehicle_id"))
            .filter(F.col("vehicle_id").isNotNull()).distinct().withColumn("_ref", F.lit(True)))
    owned = vehicles.select("vehicle_id", "user_id").withColumn("_own", F.lit(True))
    d = deletions.select("vehicle_id", "user_id").distinct()
    j = (d.join(used, "vehicle_id", "left").join(owned, ["vehicle_id", "user_id"], "left")
         .join(refs, "vehicle_id", "left"))
    return j.select("vehicle_id", "user_id",
                    F.when(F.col("request_count").isNotNull(), "used")
                     .when(F.col("_own").isNull(), "not_owner")
                     .when(F.col("_ref").isNotNull(), "referenced")
                     .otherwise("deleted").alias("outcome"))


def delete_own_vehicles(vehicles, requests, logs, owns, deletions):
    done = (delete_own_outcome(vehicles, requests, logs, owns, deletions)
            .filter(F.col("outcome") == "deleted"))
    return vehicles.join(done.select("vehicle_id", "user_id"), ["vehicle_id", "user_id"], "left_anti")


# Edit plate, colour, model (all required, trimmed) when the plate is free
# (B6) and the editor owns the vehicle. Plates held at the start of the batch stay
# taken; a free plate goes to the vehicle whose edit names it first. Of a vehicle's
# remaining edits the latest counts.
def edit_vehicles(vehicles: DataFrame, edits: DataFrame) -> DataFrame:
    from parkops.operators.tables import plate_taken_by_other
    e = edits.select("vehicle_id", "user_id", "edited_at",
                     *[T.trim_app(c).alias(c) for c in ("license_plate", "color", "model")])
    e = e.filter(~(T.is_blank("license_plate") | T.is_blank("color") | T.is_blank("model")))
    taken = plate_taken_by_other(e, vehicles).select("vehicle_id", "license_plate")
    owners = vehicles.select("vehicle_id", F.col("user_id").alias("_owner"))
    ok = (e.join(taken, ["vehicle_id", "license_plate"], "left_anti").join(owners, "vehicle_id")
          .filter(F.col("user_id") == F.col("_owner")))
    claim = (ok.groupBy("license_plate").agg(F.min(F.struct("edited_at", "vehicle_id")).alias("_c"))
             .select("license_plate", F.col("_c.vehicle_id").alias("vehicle_id")))
    ok = (ok.join(claim, ["license_plate", "vehicle_id"], "left_semi")
          .select("vehicle_id", "edited_at", F.col("license_plate").alias("_plate"),
                  F.col("color").alias("_color"), F.col("model").alias("_model")))
    one = latest(ok, "vehicle_id", ["edited_at", "_plate", "_color", "_model"], []).drop("edited_at")
    return apply_updates(vehicles, "vehicle_id", one, {
        "license_plate": F.col("_plate"), "color": F.col("_color"), "model": F.col("_model")})


# Set several columns under an AND predicate gated by an EXISTS.
def update_where_exists(vehicles: DataFrame, match: Column, gate: DataFrame,
                        sets: dict[str, Column]) -> DataFrame:
    cond = match & gate.exists()
    return vehicles.select(*[F.when(cond, sets[c]).otherwise(F.col(c)).alias(c) if c in sets
                             else F.col(c) for c in vehicles.columns])


# UPDATE v ... FROM v JOIN sr: vehicles of approved requests become
# approved by the request's approver (the latest completed request wins).
def join_update(vehicles: DataFrame, requests: DataFrame) -> DataFrame:
    a = requests.filter((F.col("status") == "Approved") & F.col("vehicle_id").isNotNull())
    last = latest(a.select("vehicle_id", "completed_at", "request_id",
                           F.col("approved_by").alias("_approver")),
                  "vehicle_id", ["completed_at", "request_id"], ["_approver"])
    return apply_updates(vehicles, "vehicle_id", last.drop("completed_at", "request_id"), {
        "access_status": F.lit(True), "approved_by": F.col("_approver")})


# Whole transforms: every changed table from one call.
def apply_request_decisions(requests: DataFrame, vehicles: DataFrame, spots: DataFrame,
                            decisions: DataFrame) -> dict:
    return {"service_request": request_decisions_requests(requests, decisions),
            "vehicle": request_decisions_vehicles(vehicles, requests, decisions),
            "parking_spots": request_decisions_spots(spots, requests, decisions)}


def apply_registration_decisions(registrations: DataFrame, vehicles: DataFrame,
                                 decisions: DataFrame) -> dict:
    return {"vehicle_registration_request":
            registration_decisions_registrations(registrations, vehicles, decisions),
            "vehicle": registration_decisions_vehicles(registrations, vehicles, decisions)}


def reject_vehicles(vehicles: DataFrame, logs: DataFrame, requests: DataFrame, owns: DataFrame,
                    actions: DataFrame) -> dict:
    return {"vehicle": reject_vehicles_vehicles(vehicles, requests, owns, actions),
            "log_record": reject_vehicles_logs(logs, vehicles, requests, owns, actions),
            "blocked": reject_vehicles_blocked(vehicles, requests, owns, actions)}

