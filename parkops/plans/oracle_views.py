"""The garage-shaped views written as DuckDB SQL CTEs (oracle side).

Written independently of the DataFrame derivations in sources/views.py from
the rules in FIXTURES.md. ``with_views(sql)`` prefixes a query with the CTEs
it mentions (and their dependencies).
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}


def view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = sql.strip()
    DEPS[name] = deps


view("users", """
SELECT c_custkey AS user_id,
       'U' || CAST(c_custkey AS VARCHAR) AS uni_id,
       c_name AS name,
       CASE WHEN c_custkey % 13 = 0 THEN NULL
            ELSE '010' || lpad(CAST(c_custkey % 900 AS VARCHAR), 8, '0') END AS phone,
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Student'
            WHEN c_mktsegment = 'FURNITURE' THEN 'Staff'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Admin'
            WHEN c_mktsegment = 'MACHINERY' THEN 'Manager' END AS user_type,
       c_acctbal >= 0 AS access_status,
       CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS TIMESTAMP) AS created_at
FROM customer""")

view("vehicle", """
SELECT p_partkey AS vehicle_id,
       'PL-' || CAST(p_partkey AS VARCHAR) AS license_plate,
       split_part(p_name, ' ', 1) AS color,
       (p_partkey * 3) // 4 AS user_id,
       p_brand AS model,
       CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS access_status,
       CASE WHEN p_size % 5 NOT IN (0, 1) THEN p_partkey % 10 END AS approved_by,
       CAST(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS TIMESTAMP) AS created_at
FROM part""")

view("service_type", """
SELECT CAST(service_id AS BIGINT) AS service_id, service_name, description,
       CAST(price AS DECIMAL(10,2)) AS price
FROM (VALUES (1, 'Valet Drop-off', 'An attendant parks the vehicle', 40.00),
             (2, 'Battery Charging', 'Charging point for four hours', 65.00),
             (3, 'Windscreen Care', 'Screen and mirrors cleaned on site', 18.50),
             (4, 'Covered Bay', 'A bay under the roof for a day', NULL),
             (5, 'Night Storage', 'Supervised overnight parking', 25.00),
             (6, 'Visitor Pass', 'Entry for a guest vehicle', 8.00))
     AS t(service_id, service_name, description, price)""")

view("payment_method", """
SELECT CAST(method_id AS BIGINT) AS method_id, method_type, payment_info
FROM (VALUES (1, 'Credit Card', 'Online terminal'), (2, 'Cash', 'Till at the gate'),
             (3, 'Credit Card', 'Terminal on the upper deck')) AS t(method_id, method_type, payment_info)""")

view("parking_garage", """
SELECT CAST(n_nationkey AS BIGINT) AS garage_id,
       CASE WHEN n_nationkey = 24 THEN 'NATION_23' ELSE n_name END AS name,
       n_regionkey <> 1 AS garage_access,
       CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN 'Closed' ELSE 'Open' END AS garage_status
FROM nation""")

view("parking_spots", """
SELECT s_suppkey AS spot_id,
       s_name AS spot_number,
       CASE s_suppkey % 4 WHEN 0 THEN 'Reserved' WHEN 1 THEN 'available'
                          WHEN 2 THEN 'Available' END AS spot_status,
       CASE WHEN s_nationkey = 7 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS garage_id
FROM supplier""")

view("service_request", """
SELECT o_orderkey AS request_id,
       o_custkey AS user_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL
            WHEN o_orderkey % 97 = 0 THEN o_orderkey % 100
            ELSE (o_custkey * 4 + 2) // 3 END AS vehicle_id,
       CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS service_id,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL
            WHEN o_orderkey % 50 = 0 THEN 'Cancelled'
            WHEN o_orderstatus = 'F' THEN 'Approved'
            WHEN o_orderstatus = 'O' THEN 'Pending'
            WHEN o_orderstatus = 'P' THEN 'Rejected' END AS status,
       CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 10 END AS approved_by,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus <> 'O'
            THEN o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) END AS completed_at,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey // 15 END AS spot_id,
       CAST(o_orderkey AS VARCHAR) AS receipt_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Paid' ELSE 'Pending' END AS payment_status,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'Pending' WHEN o_orderkey % 2 = 0 THEN 'Cash' ELSE 'Credit' END
         AS payment_method,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(10,2)) END AS payment_amount
FROM orders""")

view("vehicle_registration_request", """
SELECT request_id, user_id, license_plate, color, model, status,
       CASE WHEN status <> 'Pending' THEN request_id % 10 END AS approved_by,
       created_at,
       CASE WHEN status <> 'Pending' THEN created_at + INTERVAL 1 DAY END AS completed_at
FROM (
  SELECT p_partkey AS request_id,
         (p_partkey * 3) // 4 AS user_id,
         CASE WHEN p_partkey % 30 = 0 THEN 'PL-' ELSE 'NEW-' END || CAST(p_partkey AS VARCHAR)
           AS license_plate,
         split_part(p_name, ' ', 1) AS color,
         p_brand AS model,
         CASE p_size % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Approved' ELSE 'Rejected' END
           AS status,
         CAST(DATE '1995-01-01' + CAST(p_partkey % 2400 AS INTEGER) AS TIMESTAMP) AS created_at
  FROM part) r""")

view("invoice", """
SELECT o_orderkey AS invoice_id, o_orderkey AS request_id,
       CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
       CAST(o_orderdate AS DATE) AS date_issued,
       '00:00:00' AS time_issued,
       CAST(o_orderkey AS VARCHAR) AS receipt_id
FROM orders""")

view("payment", """
SELECT (l_orderkey * 8 + l_linenumber) * 1000 + row_number() OVER (
         PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_extendedprice, l_shipdate, l_linestatus, l_returnflag) AS payment_id,
       l_orderkey AS invoice_id,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS amount,
       CAST(l_shipdate AS DATE) AS date_paid,
       '00:00:00' AS time_paid,
       CASE l_linestatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Failed' END AS status,
       CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS BIGINT)
         AS method_id
FROM lineitem""")

view("log_record", """
SELECT event_id AS log_id, event_id % 10 AS spot_id, event_id % 10 AS gate_id,
       event_id % 100 AS request_id,
       CAST(NULL AS BIGINT) AS report_id, event_id % 40 AS vehicle_id, user_id,
       (event_id + 1) % 10 AS sensor_id, event_type AS log_type, props AS details, ts AS "timestamp"
FROM events""")

view("reports", """
SELECT event_id AS report_id, event_type AS report_type, user_id,
       CAST(ts AS DATE) AS date_generated, strftime(ts, '%H:%M:%S') AS time_generated,
       props AS details
FROM events WHERE event_type = 'error'""")

view("requests", """
SELECT CASE WHEN report_id % 10 = 0 THEN user_id
            ELSE (greatest(user_id - 1, 0) // 10) * 10 + 1 END AS user_id, report_id
FROM reports""", ("reports",))
view("controls", "SELECT user_id, user_id % 25 AS garage_id FROM users WHERE user_type = 'Admin'",
     ("users",))
view("owns", """
SELECT vehicle_id, request_id FROM service_request
WHERE vehicle_id IS NOT NULL AND service_id = 4 AND status = 'Approved'""", ("service_request",))

view("gates", """
SELECT s_suppkey AS gate_id, CAST(s_nationkey AS BIGINT) AS garage_id,
       'Gate ' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier""")
view("sensors", """
SELECT s_suppkey AS sensor_id, CASE s_suppkey % 2 WHEN 0 THEN 'Gate' ELSE 'Occupancy' END AS sensor_type,
       CASE s_suppkey % 2 WHEN 1 THEN s_suppkey END AS spot_id FROM supplier""")
view("gate_sensors", "SELECT sensor_id, sensor_id AS gate_id FROM sensors WHERE sensor_type = 'Gate'",
     ("sensors",))
view("occupancy_sensor", """
SELECT s_suppkey AS sensor_id, s_suppkey AS spot_id,
       CASE WHEN s_acctbal <= 8000 THEN s_acctbal > 0 END AS is_occupied FROM supplier""")


def _mentioned(sql: str) -> list[str]:
    found = []
    for name in VIEWS:
        if re.search(r"\b" + re.escape(name) + r"\b", sql):
            found.append(name)
    return found


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in DEPS.get(n, ()):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it references. ``extra`` adds more named
    CTEs (written after the views, so they may use them)."""
    extra = extra or {}
    body = sql + " " + " ".join(extra.values())
    names = _order(_mentioned(body))
    ctes = [f"{n} AS (\n{VIEWS[n]}\n)" for n in names]
    ctes += [f"{k} AS (\n{v.strip()}\n)" for k, v in extra.items()]
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql
