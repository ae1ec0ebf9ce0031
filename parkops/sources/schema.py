"""Declared schema of the garage database: keys, references, domains, lengths.

These lists drive the data-quality jobs (operators/quality.py) and the batch
transforms. Table and column names are lower-case snake case.
"""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, DateType, DecimalType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)

MONEY = DecimalType(10, 2)
# Sums of money are reported as decimal(18,2) on every engine.
MONEY_SUM = DecimalType(18, 2)

TABLES = (
    "users", "vehicle", "service_type", "parking_garage", "parking_spots",
    "service_request", "invoice", "payment_method", "payment", "reports",
    "log_record", "requests", "controls", "owns", "vehicle_registration_request",
    "gates", "sensors", "gate_sensors", "occupancy_sensor",
)

# Primary keys (single or composite) and UNIQUE columns.
PRIMARY_KEYS = {
    "users": ("user_id",),
    "vehicle": ("vehicle_id",),
    "service_type": ("service_id",),
    "parking_garage": ("garage_id",),
    "parking_spots": ("spot_id",),
    "service_request": ("request_id",),
    "invoice": ("invoice_id",),
    "payment_method": ("method_id",),
    "payment": ("payment_id",),
    "reports": ("report_id",),
    "log_record": ("log_id",),
    "requests": ("user_id", "report_id"),
    "controls": ("user_id", "garage_id"),
    "owns": ("vehicle_id", "request_id"),
    "vehicle_registration_request": ("request_id",),
    "gates": ("gate_id",),
    "sensors": ("sensor_id",),
    "gate_sensors": ("sensor_id",),
    "occupancy_sensor": ("sensor_id",),
}
UNIQUE_KEYS = {
    "users": (("uni_id",),),
    "vehicle": (("license_plate",),),
}

# (child table, child column, parent table, parent column). NULL passes.
FOREIGN_KEYS = (
    ("vehicle", "user_id", "users", "user_id"),
    ("vehicle", "approved_by", "users", "user_id"),
    ("parking_spots", "garage_id", "parking_garage", "garage_id"),
    ("service_request", "user_id", "users", "user_id"),
    ("service_request", "vehicle_id", "vehicle", "vehicle_id"),
    ("service_request", "service_id", "service_type", "service_id"),
    ("service_request", "approved_by", "users", "user_id"),
    ("service_request", "spot_id", "parking_spots", "spot_id"),
    ("invoice", "request_id", "service_request", "request_id"),
    ("payment", "invoice_id", "invoice", "invoice_id"),
    ("payment", "method_id", "payment_method", "method_id"),
    ("reports", "user_id", "users", "user_id"),
    ("log_record", "spot_id", "parking_spots", "spot_id"),
    ("log_record", "request_id", "service_request", "request_id"),
    ("log_record", "report_id", "reports", "report_id"),
    ("log_record", "vehicle_id", "vehicle", "vehicle_id"),
    ("log_record", "user_id", "users", "user_id"),
    ("requests", "user_id", "users", "user_id"),
    ("requests", "report_id", "reports", "report_id"),
    ("controls", "user_id", "users", "user_id"),
    ("controls", "garage_id", "parking_garage", "garage_id"),
    ("owns", "vehicle_id", "vehicle", "vehicle_id"),
    ("owns", "request_id", "service_request", "request_id"),
    ("vehicle_registration_request", "user_id", "users", "user_id"),
    ("vehicle_registration_request", "approved_by", "users", "user_id"),
    ("gates", "garage_id", "parking_garage", "garage_id"),
    ("sensors", "spot_id", "parking_spots", "spot_id"),
    ("gate_sensors", "gate_id", "gates", "gate_id"),
    ("occupancy_sensor", "spot_id", "parking_spots", "spot_id"),
    ("log_record", "gate_id", "gates", "gate_id"),
    ("log_record", "sensor_id", "sensors", "sensor_id"),
)

NOT_NULL = (
    ("users", "uni_id"),
    ("users", "name"),
    ("vehicle", "license_plate"),
    ("vehicle_registration_request", "user_id"),
    ("vehicle_registration_request", "license_plate"),
)

# Allowed lists of the application.
USER_TYPES = ("Student", "Staff", "Admin", "Manager")
REQUEST_STATUSES = ("Pending", "Approved", "Rejected")
GARAGE_STATUSES = ("Open", "Closed")
PAYMENT_STATUSES = ("Pending", "Paid", "Failed")
PAYMENT_METHODS = ("Credit", "Cash", "Pending")

DOMAINS = (
    ("users", "user_type", USER_TYPES),
    ("parking_garage", "garage_status", GARAGE_STATUSES),
    ("service_request", "payment_status", PAYMENT_STATUSES),
    ("service_request", "payment_method", PAYMENT_METHODS),
    ("service_request", "status", REQUEST_STATUSES),
)

# VARCHAR(n) limits (bytes).
MAX_LENGTHS = (
    ("users", "uni_id", 20), ("users", "name", 100), ("users", "phone", 20),
    ("users", "user_type", 50),
    ("vehicle", "license_plate", 20), ("vehicle", "color", 30), ("vehicle", "model", 50),
    ("service_type", "service_name", 100), ("service_type", "description", 255),
    ("parking_garage", "name", 100), ("parking_garage", "garage_status", 10),
    ("parking_spots", "spot_number", 20), ("parking_spots", "spot_status", 30),
    ("service_request", "status", 30), ("service_request", "receipt_id", 50),
    ("payment", "status", 30),
    ("payment_method", "method_type", 50), ("payment_method", "payment_info", 255),
    ("reports", "report_type", 50), ("reports", "details", 255),
    ("log_record", "log_type", 50), ("log_record", "details", 255),
    ("vehicle_registration_request", "license_plate", 20),
    ("vehicle_registration_request", "color", 30),
    ("vehicle_registration_request", "model", 50),
    ("vehicle_registration_request", "status", 30),
    ("gates", "name", 50), ("sensors", "sensor_type", 50),
)

# Column defaults declared by the schema (applied to new rows only).
DEFAULTS = {
    "parking_garage": {"garage_status": "Open"},
    "service_type": {"price": "0.00"},
    "vehicle_registration_request": {"status": "Pending"},
    "service_request": {"payment_status": "Pending", "payment_method": "Pending"},
}

USERS = StructType([
    StructField("user_id", LongType(), False),
    StructField("uni_id", StringType()),
    StructField("name", StringType()),
    StructField("phone", StringType()),
    StructField("user_type", StringType()),
    StructField("access_status", BooleanType()),
    StructField("created_at", TimestampNTZType()),
])

SERVICE_TYPE = StructType([
    StructField("service_id", LongType(), False),
    StructField("service_name", StringType()),
    StructField("description", StringType()),
    StructField("price", MONEY),
])

PAYMENT_METHOD = StructType([
    StructField("method_id", LongType(), False),
    StructField("method_type", StringType()),
    StructField("payment_info", StringType()),
])

PARKING_GARAGE = StructType([
    StructField("garage_id", LongType(), False),
    StructField("name", StringType()),
    StructField("garage_access", BooleanType()),
    StructField("garage_status", StringType()),
])

PARKING_SPOTS = StructType([
    StructField("spot_id", LongType(), False),
    StructField("spot_number", StringType()),
    StructField("spot_status", StringType()),
    StructField("garage_id", LongType()),
])

VEHICLE = StructType([
    StructField("vehicle_id", LongType(), False),
    StructField("license_plate", StringType()),
    StructField("color", StringType()),
    StructField("user_id", LongType()),
    StructField("model", StringType()),
    StructField("access_status", BooleanType()),
    StructField("approved_by", LongType()),
    StructField("created_at", TimestampNTZType()),
])

INVOICE_TIME = StringType()  # TIME is kept as 'HH:mm:ss' text
DATE = DateType()
