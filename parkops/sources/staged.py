"""Tables as an import might deliver them: every row of the garage tables, some of them broken
in one way or another, so that each constraint of the schema is violated somewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.sources.views import Garage

#: Wider than any VARCHAR of the tables here.
LONG_TEXT = "x" * 300


def _broken(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.select(*[changes[c].cast(df.schema[c].dataType).alias(c) if c in changes else F.col(c)
                       for c in df.columns],
                     *[v.alias(c) for c, v in changes.items() if c not in df.columns])


def users(df: DataFrame) -> DataFrame:
    k = F.col("user_id")
    return _broken(df, {
        "uni_id": F.when(k % 17 == 3, F.concat(F.lit("U"), (k - 1).cast("string")))
        .when(k % 29 == 4, F.lit(None)).otherwise(F.col("uni_id")),
        "name": F.when(k % 19 == 5, F.lit(None)).when(k % 37 == 6, F.lit(LONG_TEXT)).otherwise(F.col("name")),
        "phone": F.when(k % 23 == 7, F.repeat(F.col("phone"), F.lit(3))).otherwise(F.col("phone")),
        "user_type": F.when(k % 13 == 8, F.lit("Stafff")).otherwise(F.col("user_type"))})


def vehicle(df: DataFrame) -> DataFrame:
    k = F.col("vehicle_id")
    return _broken(df, {
        "license_plate": F.when(k % 31 == 1, F.concat(F.lit("PL-"), (k + 1).cast("string")))
        .when(k % 41 == 2, F.lit(None)).otherwise(F.col("license_plate")),
        "color": F.when(k % 43 == 3, F.lit(LONG_TEXT)).otherwise(F.col("color")),
        "user_id": F.when(k % 11 == 4, -k).otherwise(F.col("user_id"))})


def service_request(df: DataFrame) -> DataFrame:
    k = F.col("request_id")
    return _broken(df, {
        "request_id": F.when(k % 47 == 1, k + 1).otherwise(k),
        "spot_id": F.when(k % 53 == 2, F.lit(999_999)).otherwise(F.col("spot_id")),
        "payment_method": F.when(k % 59 == 3, "Cheque").when(k % 2 == 0, "Cash").otherwise("Credit"),
        "payment_status": F.when(k % 61 == 4, F.lit("Refunded")).otherwise(F.col("payment_status"))})


def payment(df: DataFrame) -> DataFrame:
    k = F.col("payment_id")
    return _broken(df, {"method_id": F.when(k % 67 == 1, F.lit(9)).otherwise(F.col("method_id")),
                        "invoice_id": F.when(k % 71 == 2, -F.col("invoice_id")).otherwise(F.col("invoice_id"))})


def requests(df: DataFrame) -> DataFrame:
    k = F.col("report_id")
    return _broken(df, {"report_id": F.when(k % 3 == 1, F.lit(-1)).otherwise(k)})


def gates(df: DataFrame) -> DataFrame:
    k = F.col("gate_id")
    return _broken(df, {"garage_id": F.when(k % 4 == 1, F.lit(77)).otherwise(F.col("garage_id")),
                        "gate_id": F.when(k % 5 == 3, k + 1).otherwise(k)})


SPOILED = {"users": users, "vehicle": vehicle, "service_request": service_request,
           "payment": payment, "requests": requests, "gates": gates}


class StagedGarage(Garage):
    """The tables of ``Garage``, those of ``SPOILED`` with broken rows. Tables derived from
    others come from the sound ones."""

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in type(self)._BUILDERS:
            raise AttributeError(name)
        if name not in self._cache:
            sound = Garage(self.spark, self.sf_dir).table(name)
            self._cache[name] = SPOILED[name](sound) if name in SPOILED else sound
        return self._cache[name]
