"""Table-level operations and the snapshot sink.

Tables are immutable: every change returns a new DataFrame; ``write_snapshot``
writes a set of tables to a new folder and a numbered version that names it last.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parkops.operators.ranking import Key, with_position
from parkops.sources.versions import Versions


# A2
def rows_literal(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# A3: omitted columns become NULL (defaults are A7's job).
def append_rows(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.unionByName(new.select([c for c in new.columns if c in base.columns]),
                            allowMissingColumns=True)


# Surrogate ids continuing after the current maximum, in a total order. Several id
# columns that number the same rows in the same order share one pass.
def assign_identities(new: DataFrame, bases: dict[str, DataFrame], order: Sequence[Key],
                      keys: DataFrame | None = None) -> DataFrame:
    ids = [(base.select(F.coalesce(F.max(c), F.lit(0)).cast("long")).scalar() + F.col("_pos")).alias(c)
           for c, base in bases.items()]
    return with_position(new, order, "_pos", keys=keys).select(
        *[c for c in new.columns if c not in bases], *ids)


def assign_identity(new: DataFrame, base: DataFrame, id_col: str, order: Sequence[Key]) -> DataFrame:
    return assign_identities(new, {id_col: base}, order)


# A4: insert only rows whose key is absent from the base.
def insert_if_absent(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return append_rows(base, new.join(base.select(*key).distinct(), list(key), "left_anti"))


# A5: add a column with a default when missing. Existing rows keep NULL
# unless ``backfill`` (the scripts that add a column and then update NULLs).
def ensure_column(df: DataFrame, name: str, dtype: str, default, backfill: bool = False) -> DataFrame:
    if name not in df.columns:
        df = df.withColumn(name, F.lit(None).cast(dtype))
    if backfill:
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default).cast(dtype)))
    return df


# Declared defaults for new rows.
def default_fill(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v) if c in out.columns else v)
    return out


# The plate is already used by another vehicle (equality + inequality).
# Vehicles are reduced to one row per plate (how many hold it) and the edited
# vehicle's own current plate is looked up by id, so an edit meets one row
# per key even when many vehicles share a plate. Output: edits whose plate is
# taken, with the number of other vehicles holding it.
def plate_taken_by_other(edits: DataFrame, vehicle: DataFrame) -> DataFrame:
    per_plate = vehicle.groupBy("license_plate").agg(F.count(F.lit(1)).alias("_n"))
    current = vehicle.select("vehicle_id", F.col("license_plate").alias("_current"))
    j = edits.join(per_plate, "license_plate").join(current, "vehicle_id", "left")
    holds = F.coalesce(F.col("_current") == F.col("license_plate"), F.lit(False))
    others = F.col("_n") - F.when(holds, 1).otherwise(0)
    return (j.select("vehicle_id", "license_plate", others.cast("long").alias("other_vehicles"))
            .filter(F.col("other_vehicles") > 0))


# `id = ? OR phone = ?`: an OR in a join condition would force a
# nested-loop join, and joining on a shared phone would pair a sign-up with
# every user holding it. Instead each new row is matched against the distinct
# ids and the per-phone counts (one row per key): two equi-joins, no pairs.
def id_or_phone_match(new: DataFrame, users: DataFrame) -> DataFrame:
    ids = users.select("uni_id").distinct().withColumn("_by_id", F.lit(True))
    phones = (users.filter(F.col("phone").isNotNull()).groupBy("phone")
              .agg(F.count(F.lit(1)).alias("phone_matches")))
    j = new.join(ids, "uni_id", "left").join(phones, "phone", "left")
    return (j.select("uni_id", F.coalesce(F.col("_by_id"), F.lit(False)).alias("id_match"),
                     F.coalesce(F.col("phone_matches"), F.lit(0)).alias("phone_matches"))
            .filter(F.col("id_match") | (F.col("phone_matches") > 0)))


# Sink: a new snapshot folder per run; a numbered version that names it is made last, so a
# reader never sees a half-written snapshot, whenever it looks.
def write_snapshot(tables: dict[str, DataFrame], root: str, snapshot_id: str | None = None) -> str:
    sid = snapshot_id or uuid.uuid4().hex
    base = f"{root.rstrip('/')}/snapshots/{sid}"
    spark = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
        spark = df.sparkSession
    if spark is not None:
        versions = Versions(spark, root)
        versions.commit({"snapshot": sid}, versions.latest())
    return base


def read_snapshot(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    sid = Versions(spark, root).manifest()["tables"]["snapshot"]
    return {n: spark.read.parquet(f"{root.rstrip('/')}/snapshots/{sid}/{n}") for n in names}
