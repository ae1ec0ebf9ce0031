"""Data-quality jobs: the schema's constraints and the pages' validation
rules, checked over whole tables. Each returns violation rows.

Uniqueness and reference checks aggregate the key column first (partial
aggregation collapses a hot key map-side) and then join the distinct values,
so one value held by a third of the rows costs one row per map task, not a
skewed join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.functions import text as T
from parkops.operators import constraints as C
from parkops.operators.constraints import TableFn
from parkops.sources import schema as S


# Primary keys, composite keys and UNIQUE columns (constraints.py: one scan per table).
def dq_unique(table: TableFn, checks: Sequence[C.Pair] = C.ALL_KEYS) -> DataFrame:
    return C.violations(table, C.Rules(keys=checks)).select(
        "rule", "table_name", "column_name", "value", "n")


# Ids equal up to case; phone numbers used twice (NULL never equals NULL).
def dq_unique_ci(users: DataFrame) -> DataFrame:
    ids = (users.filter(F.col("uni_id").isNotNull())
           .groupBy(F.lower("uni_id").alias("value")).agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > 1).select(F.lit("uni_id_ci").alias("rule"), "value", "n"))
    phones = (users.filter(F.col("phone").isNotNull())
              .groupBy(F.col("phone").alias("value")).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1).select(F.lit("phone").alias("rule"), "value", "n"))
    return ids.unionByName(phones)


# Allowed lists; NULL passes.
def dq_domain(table: TableFn, checks=S.DOMAINS) -> DataFrame:
    return C.row_violations(table, C.Rules(domains=checks)).select(
        "rule", "table_name", "column_name", "key", "value")


# Orphan references per foreign key, one row per missing value with the number of child
# rows holding it. NULL passes.
def dq_foreign_key(table: TableFn, fks=S.FOREIGN_KEYS) -> DataFrame:
    return C.violations(table, C.Rules(references=fks)).select(
        "rule", "table_name", "column_name", "parent_table", "value", "n")


# J5
def dq_not_null(table: TableFn, checks=S.NOT_NULL) -> DataFrame:
    return C.row_violations(table, C.Rules(not_null=checks)).select(
        "rule", "table_name", "column_name", "key")


# VARCHAR(n) counts bytes.
def dq_max_length(table: TableFn, checks=S.MAX_LENGTHS) -> DataFrame:
    return C.row_violations(table, C.Rules(max_lengths=checks)).select(
        "rule", "table_name", "column_name", "key", "value_len", "max_len")


# J1, J3-J6 of all tables at once.
def dq_constraints(table: TableFn) -> DataFrame:
    return C.violations(table)


# Card fields of credit payments; the first failing rule wins. No digit
# or Luhn check and no month range, as in the application.
def card_reason(number: Column, cvv: Column, expiry: Column, holder: Column) -> Column:
    n, v, e, h = (T.trim_app(x) for x in (number, cvv, expiry, holder))
    blank = T.is_blank(n) | T.is_blank(v) | T.is_blank(e) | T.is_blank(h)
    nlen, vlen = T.byte_length(n), T.byte_length(v)
    return (F.when(blank, "missing_field")
             .when((nlen < 13) | (nlen > 19), "card_number_length")
             .when(~vlen.isin(3, 4), "cvv_length")
             .when(~T.valid_expiry(e), "expiry_format"))


def dq_card_fields(payments_in: DataFrame) -> DataFrame:
    reason = card_reason(F.col("card_number"), F.col("card_cvv"), F.col("card_expiry"),
                         F.col("cardholder_name"))
    return (payments_in.filter(F.col("method") == "Credit")
            .select("request_id", reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


# Chosen spot missing / not available / in a closed garage, in this
# order. A spot whose garage is missing counts as missing (inner join).
def spot_reason(found: Column, spot_status: Column, garage_status: Column) -> Column:
    return (F.when(~found, "spot_missing")
             .when(F.upper(F.coalesce(spot_status, F.lit(""))) != "AVAILABLE", "spot_not_available")
             .when(F.coalesce(garage_status, F.lit("Open")) == "Closed", "garage_closed"))


def spot_reasons(choices: DataFrame, spots: DataFrame, garage: DataFrame) -> DataFrame:
    """Adds ``reason`` (NULL when valid or no spot chosen) to every choice row."""
    valid = (spots.join(garage.select("garage_id", "garage_status"), "garage_id")
             .select(F.col("spot_id").alias("_sid"), "spot_status", "garage_status",
                     F.lit(True).alias("_found")))
    j = choices.join(valid, choices["spot_id"] == valid["_sid"], "left")
    reason = F.when(F.col("spot_id").isNull(), F.lit(None).cast("string")).otherwise(
        spot_reason(F.coalesce(F.col("_found"), F.lit(False)), F.col("spot_status"),
                    F.col("garage_status")))
    return j.select(*choices.columns, reason.alias("reason"))


def dq_spot_choice(submissions: DataFrame, spots: DataFrame, garage: DataFrame) -> DataFrame:
    return (spot_reasons(submissions, spots, garage).filter(F.col("reason").isNotNull())
            .select("user_id", "spot_id", "reason"))


# Contact fields (required, phone 10-15 digits after removing spaces and dashes, e-mail
# shape and a password of six characters when there are such columns).
def dq_contact_fields(users: DataFrame, key: str = "user_id") -> DataFrame:
    name = T.trim_app("name")
    phone = T.trim_app("phone")
    name_rule = F.when(name.isNull() | (name == ""), "name_required")
    phone_rule = (F.when(phone.isNull() | (phone == ""), "phone_required")
                   .when(~T.valid_phone(phone), "phone_invalid"))
    rules = [name_rule, phone_rule]
    if "email" in users.columns:
        e = T.trim_app("email")
        rules.append(F.when(e.isNull() | (e == ""), "email_required")
                     .when(~T.valid_email(e), "email_invalid"))
    if "password" in users.columns:
        rules.append(F.when(T.is_empty("password"), "password_required")
                     .when(F.length("password") < 6, "password_short"))
    # every rule of a row from one scan
    return users.select(key, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


# Can this payment go ahead?
def payable_verdict(status: Column, payment_status: Column) -> Column:
    return (F.when(F.coalesce(status, F.lit("")) != "Approved", "not_approved")
             .when(F.coalesce(payment_status, F.lit("Pending")) == "Paid", "already_paid")
             .otherwise("payable"))


def dq_payable(payments_in: DataFrame, requests: DataFrame) -> DataFrame:
    r = requests.select("request_id", "status", "payment_status")
    return (payments_in.select("request_id").join(r, "request_id", "left")
            .select("request_id", payable_verdict(F.col("status"), F.col("payment_status"))
                    .alias("verdict")))
