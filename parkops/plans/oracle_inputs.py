"""Input tables of the batch transforms as DuckDB CTEs (oracle side)."""

from parkops.plans.oracle_views import view

view("decisions", """
SELECT o_orderkey AS request_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'approve' ELSE 'reject' END AS action,
       o_orderkey % 10 AS decided_by, o_orderdate + INTERVAL 1 DAY AS decided_at
FROM orders
UNION ALL
SELECT o_orderkey,
       CASE WHEN o_orderkey % 4 = 0 THEN 'reject' WHEN o_orderkey % 2 = 0 THEN 'approve'
            ELSE 'reject' END, (o_orderkey + 1) % 10, o_orderdate + INTERVAL 2 DAY
FROM orders""")

view("registration_decisions", """
SELECT p_partkey AS request_id,
       CASE WHEN (p_partkey // 6) % 2 = 0 THEN 'approve' ELSE 'reject' END AS action,
       p_partkey % 10 AS decided_by,
       CAST(DATE '1995-01-01' + CAST(p_partkey % 2400 AS INTEGER) AS TIMESTAMP) + INTERVAL 1 DAY
         AS decided_at
FROM part""")

view("garage_actions", """
SELECT CAST(n_nationkey AS BIGINT) AS garage_id,
       CASE WHEN n_nationkey % 2 = 0 THEN 'open' ELSE 'close' END AS action
FROM nation""")

view("vehicle_actions", """
SELECT p_partkey AS vehicle_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'approve' ELSE 'reject' END AS action,
       p_partkey % 10 AS acted_by
FROM part WHERE p_size % 5 IN (0, 1)""")

view("vehicle_edits", """
SELECT p_partkey AS vehicle_id,
       CASE WHEN p_partkey % 120 = 0 THEN (p_partkey * 3) // 4 + 1 ELSE (p_partkey * 3) // 4 END
         AS user_id,
       CASE WHEN p_partkey % 80 = 0 THEN 'PL-' || CAST(p_partkey + 1 AS VARCHAR)
            WHEN p_partkey % 7 = 0 THEN 'DUO-' || CAST(p_partkey // 14 AS VARCHAR)
            ELSE 'PL-' || CAST(p_partkey AS VARCHAR) || 'X' END AS license_plate,
       'Silver' AS color, p_brand || ' S' AS model,
       TIMESTAMP '2024-04-01 00:00:00' + to_minutes(CAST(
         CASE WHEN p_partkey % 98 < 14 THEN 0 ELSE 1000 - p_partkey % 1000 END AS INTEGER)) AS edited_at
FROM part""")

view("submissions", """
SELECT c_custkey AS user_id, (c_custkey * 4 + 2) // 3 AS vehicle_id,
       c_custkey % 6 + 1 AS service_id,
       CASE (c_custkey // 9) % 3 WHEN 0 THEN NULL WHEN 1 THEN c_custkey // 15
            ELSE CAST(999999 AS BIGINT) END AS spot_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey % 1000 AS INTEGER))
         AS submitted_at
FROM customer""")

view("payments_in", """
SELECT request_id, user_id, method,
       CASE WHEN method = 'Credit' THEN
         CASE WHEN shape = 1 THEN '411111111111' ELSE '4111111111111111' END END AS card_number,
       CASE WHEN method = 'Credit' THEN
         CASE WHEN shape = 2 THEN '12' ELSE '123' END END AS card_cvv,
       CASE WHEN method = 'Credit' THEN
         CASE WHEN shape = 3 THEN '1/25' ELSE '12/27' END END AS card_expiry,
       CASE WHEN method = 'Credit' THEN
         CASE WHEN shape = 4 THEN ' ' ELSE 'Holder ' || CAST(owner AS VARCHAR) END END
         AS cardholder_name,
       paid_at
FROM (SELECT o_orderkey AS request_id, o_custkey AS owner,
             CASE WHEN o_orderkey % 128 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id,
             CASE WHEN (o_orderkey // 8) % 2 = 0 THEN 'Credit' ELSE 'Cash' END AS method,
             (o_orderkey // 16) % 5 AS shape, o_orderdate + INTERVAL 30 DAY AS paid_at
      FROM orders) o""")

view("registrations_in", """
SELECT (p_partkey * 3) // 4 AS user_id,
       CASE WHEN p_partkey % 25 = 0 THEN 'PL-' || CAST(p_partkey AS VARCHAR)
            WHEN p_partkey % 15 = 0 THEN 'NEW-' || CAST(p_partkey AS VARCHAR)
            WHEN p_partkey % 35 = 0 THEN 'TWIN-' || CAST((p_partkey + 35) // 70 AS VARCHAR)
            ELSE 'REG-' || CAST(p_partkey AS VARCHAR) END AS license_plate,
       CASE WHEN p_partkey % 210 = 35 THEN ' ' ELSE split_part(p_name, ' ', 1) END AS color,
       p_brand AS model,
       TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(p_partkey % 1000 AS INTEGER))
         AS submitted_at
FROM part""")

view("users_in", """
SELECT CASE WHEN c_custkey % 49 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR)
            WHEN c_custkey % 11 = 0 THEN 'P' || CAST(c_custkey // 22 AS VARCHAR)
            ELSE 'N' || CAST(c_custkey AS VARCHAR) END AS uni_id,
       'New ' || c_name AS name,
       CASE WHEN c_custkey % 21 = 0 THEN '010' || lpad(CAST((c_custkey + 1) % 900 AS VARCHAR), 8, '0')
            WHEN c_custkey % 13 = 0 THEN '030' || lpad(CAST(c_custkey // 26 AS VARCHAR), 8, '0')
            ELSE '020' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
       CASE WHEN c_custkey % 35 = 0 THEN 'Stafff'
            WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Student'
            WHEN c_mktsegment = 'FURNITURE' THEN 'Staff'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Admin'
            WHEN c_mktsegment = 'MACHINERY' THEN 'Manager' END AS user_type,
       TIMESTAMP '2024-03-01 00:00:00' + to_minutes(CAST(c_custkey % 1000 AS INTEGER))
         AS submitted_at
FROM customer""")

view("managers_in", """
SELECT CASE WHEN c_custkey % 31 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR)
            WHEN c_custkey % 14 < 2 THEN 'G' || CAST(c_custkey // 14 AS VARCHAR)
            ELSE ' K' || CAST(c_custkey AS VARCHAR) END AS uni_id,
       CASE WHEN c_custkey % 23 = 2 THEN ' ' || chr(9) ELSE 'Manager ' || c_name END AS name,
       CASE WHEN c_custkey % 12 < 2 THEN '041' || lpad(CAST(c_custkey // 12 AS VARCHAR), 8, '0')
            WHEN c_custkey % 37 = 5 THEN '010' || lpad(CAST((c_custkey + 1) % 900 AS VARCHAR), 8, '0')
            ELSE '040' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
       CASE WHEN c_custkey % 19 = 4 THEN '' ELSE 'pw' || CAST(c_custkey AS VARCHAR) END AS password,
       CASE WHEN c_custkey % 9 = 1 THEN 'm' || CAST(c_custkey AS VARCHAR) || '@host'
            WHEN c_custkey % 17 <> 2 THEN 'm' || CAST(c_custkey AS VARCHAR) || '@uni.example' END AS email,
       TIMESTAMP '2024-05-01 00:00:00' + to_minutes(CAST(1000 - c_custkey % 1000 AS INTEGER))
         AS submitted_at
FROM customer""")
view("purge_ids", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 10 = 0")
view("purge_plates", """
SELECT 'PL-' || CAST(p_partkey AS VARCHAR) AS license_plate FROM part WHERE p_partkey % 50 = 0""")

# the tables of an import, some rows of them broken
view("staged_users", """
SELECT user_id, CASE WHEN user_id % 17 = 3 THEN 'U' || CAST(user_id - 1 AS VARCHAR)
                     WHEN user_id % 29 <> 4 THEN uni_id END AS uni_id,
       CASE WHEN user_id % 19 = 5 THEN NULL WHEN user_id % 37 = 6 THEN repeat('x', 300) ELSE name END AS name,
       CASE WHEN user_id % 23 = 7 THEN phone || phone || phone ELSE phone END AS phone,
       CASE WHEN user_id % 13 = 8 THEN 'Stafff' ELSE user_type END AS user_type
FROM users""", ("users",))
view("staged_vehicle", """
SELECT vehicle_id, CASE WHEN vehicle_id % 31 = 1 THEN 'PL-' || CAST(vehicle_id + 1 AS VARCHAR)
                        WHEN vehicle_id % 41 <> 2 THEN license_plate END AS license_plate,
       CASE WHEN vehicle_id % 43 = 3 THEN repeat('x', 300) ELSE color END AS color,
       CASE WHEN vehicle_id % 11 = 4 THEN -vehicle_id ELSE user_id END AS user_id, model, approved_by
FROM vehicle""", ("vehicle",))
view("staged_service_request", """
SELECT request_id + CASE WHEN request_id % 47 = 1 THEN 1 ELSE 0 END AS request_id, user_id, vehicle_id,
       service_id, status, approved_by, receipt_id,
       CASE WHEN request_id % 53 = 2 THEN 999999 ELSE spot_id END AS spot_id,
       CASE WHEN request_id % 59 = 3 THEN 'Cheque' WHEN request_id % 2 = 0 THEN 'Cash' ELSE 'Credit' END
         AS payment_method,
       CASE WHEN request_id % 61 = 4 THEN 'Refunded' ELSE payment_status END AS payment_status
FROM service_request""", ("service_request",))
view("staged_payment", """
SELECT payment_id, status, CASE WHEN payment_id % 67 = 1 THEN 9 ELSE method_id END AS method_id,
       CASE WHEN payment_id % 71 = 2 THEN -invoice_id ELSE invoice_id END AS invoice_id
FROM payment""", ("payment",))
view("staged_requests", """
SELECT user_id, CASE WHEN report_id % 3 = 1 THEN -1 ELSE report_id END AS report_id FROM requests""",
     ("requests",))
view("staged_gates", """
SELECT gate_id + CASE WHEN gate_id % 5 = 3 THEN 1 ELSE 0 END AS gate_id, name,
       CASE WHEN gate_id % 4 = 1 THEN 77 ELSE garage_id END AS garage_id FROM gates""", ("gates",))
