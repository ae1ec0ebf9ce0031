"""Scalar column functions.

All are compositions of built-in Spark functions, so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by the application's trim.
TRIM_CHARS = " \t\n\r\0\x0b"

# Display texts of the application (labels, mask format, tags).
CARD_MASK = ("Card: ****", ", Exp: ", ", Holder: ")
PENDING_PAYMENT = "Pending Payment"
NOT_AVAILABLE = "N/A"
CURRENCY = "EGP "
ACTIVE, INACTIVE = "Active", "Inactive"
DECIDED_BY, NO_APPROVER = "By: ", "System"
APPROVED_MARK, PENDING_MARK = " ✓ Approved", " (Pending)"
REGISTRATION_SERVICE = "Vehicle Registration"
PENDING_REGISTRATION = "Pending Registration"
SERVICE_TAG, REGISTRATION_TAG = "service", "vehicle_registration"
DIRECT_SOURCE, REQUEST_SOURCE = "direct_insert", "registration_request"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# H6: trim of space, tab, LF, CR, NUL and vertical tab (plain trim only strips spaces).
def trim_app(c: str | Column) -> Column:
    return F.btrim(_c(c), F.lit(TRIM_CHARS))


# H7: "empty": NULL, '' and also '0'.
def is_empty(c: str | Column) -> Column:
    """NULL or nothing but white space at the ends."""
    v = trim_app(c)
    return v.isNull() | (v == "")


def is_blank(c: str | Column) -> Column:
    c = _c(c)
    return c.isNull() | c.isin("", "0")


# H8: length in bytes.
def byte_length(c: str | Column) -> Column:
    return F.octet_length(_c(c))


# First letter upper-cased; ucfirst leaves the rest unchanged.
def initial(c: str | Column) -> Column:
    return F.upper(F.substring(_c(c), 1, 1))


def ucfirst(c: str | Column) -> Column:
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


# H9: masked card text stored instead of the card number.
def mask_card(number: str | Column, expiry: str | Column, holder: str | Column) -> Column:
    return F.concat(F.lit(CARD_MASK[0]), F.substring(_c(number), -4, 4), F.lit(CARD_MASK[1]),
                    _c(expiry), F.lit(CARD_MASK[2]), _c(holder))


# Validation patterns.
# The application's validation patterns.
EXPIRY_PATTERN = r"^\d{2}/\d{2}$"
PHONE_PATTERN = r"^[0-9]{10,15}$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def phone_digits(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"[\s-]", "")


def valid_phone(c: str | Column) -> Column:
    return phone_digits(c).rlike(PHONE_PATTERN)


def valid_email(c: str | Column) -> Column:
    return _c(c).rlike(EMAIL_PATTERN)


def valid_expiry(c: str | Column) -> Column:
    return _c(c).rlike(EXPIRY_PATTERN)


def card_number_input(c: str | Column) -> Column:
    """The card field as typed: white space out, then a space after every four characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"\s", ""), "(.{4})", "$1 "))


def expiry_input(c: str | Column) -> Column:
    """The expiry field as typed: digits only, a slash after two if a third follows, five
    characters at most."""
    digits = F.regexp_replace(_c(c), r"\D", "")
    return F.substring(F.regexp_replace(digits, r"^(\d{2})(\d)", "$1/$2"), 1, 5)


def cvv_input(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"\D", "")


# Display formats.
def format_money(c: str | Column) -> Column:
    return F.format_number(_c(c), 2)


def format_day(c: str | Column) -> Column:
    return F.date_format(_c(c), "MMM dd, yyyy")


def format_clock(c: str | Column) -> Column:
    return F.date_format(_c(c), "HH:mm")


def format_stamp(c: str | Column) -> Column:
    return F.date_format(_c(c), "MMM dd, yyyy - HH:mm")


# H4: DATE and TIME parts of a timestamp (TIME kept as text).
def date_part(c: str | Column) -> Column:
    return F.to_date(_c(c))


def time_part(c: str | Column) -> Column:
    return F.date_format(_c(c), "HH:mm:ss")


# Payment cell of the request board.
def payment_label(request_type: Column, status: Column, payment_status: Column,
                  method: Column, amount: Column) -> Column:
    return (F.when(request_type == REGISTRATION_TAG, F.lit("-"))
             .when(status == "Approved",
                   F.when(F.coalesce(payment_status, F.lit("Pending")) == "Paid",
                          F.concat(F.coalesce(method, F.lit(NOT_AVAILABLE)), F.lit(" " + CURRENCY),
                                   F.format_number(F.coalesce(amount, F.lit(0)), 2)))
                    .otherwise(F.lit(PENDING_PAYMENT)))
             .otherwise(F.lit("-")))


# Status labels.
def active_label(access: Column) -> Column:
    return F.when(access, ACTIVE).otherwise(INACTIVE)


def open_label(garage_status: Column) -> Column:
    return F.when(F.coalesce(garage_status, F.lit("Open")) == "Open", "Open").otherwise("Closed")


def decided_by_label(status: Column, approver_name: Column) -> Column:
    return F.when(status == "Pending", F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(DECIDED_BY), F.coalesce(approver_name, F.lit(NO_APPROVER))))


def or_na(c: str | Column) -> Column:
    return F.coalesce(_c(c), F.lit(NOT_AVAILABLE))


# Vehicle option text.
def vehicle_label(plate: Column, model: Column, color: Column, access: Column) -> Column:
    color_part = F.when(F.coalesce(color, F.lit("")) != "", F.concat(F.lit(" ("), color, F.lit(")"))
                        ).otherwise(F.lit(""))
    return F.concat(plate, F.lit(" - "), F.coalesce(model, F.lit(NOT_AVAILABLE)), color_part,
                    F.when(access, F.lit(APPROVED_MARK)).otherwise(F.lit(PENDING_MARK)))


# Case-insensitive literal substring over the displayed cells; an empty
# term keeps every row.
def row_matches(cells: list[str | Column], term: str) -> Column:
    if term == "":
        return F.lit(True)
    text = F.lower(F.concat_ws(" ", *[_c(c).cast("string") for c in cells]))
    return F.contains(text, F.lit(term.lower()))


# B11
def like_filter(c: str | Column, fragment: str) -> Column:
    return _c(c).like(f"%{fragment}%")
