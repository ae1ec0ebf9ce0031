"""Oracles of the board queries.

Stated from what a board shows: a row per request, each of its keys resolved to the
record it names (``record``), so no join can add or lose rows unseen. Registrations take
their columns from the empty shape of the service board.
"""

from parkops.plans.oracle_sql import oracle


def record(table: str, key: str, value: str, *fields: str) -> str:
    """The fields of the one row of ``table`` whose key is ``value``, or NULL."""
    packed = ", ".join(f"'{f}': {f}" for f in fields)
    return f"(SELECT {{{packed}}} FROM {table} WHERE {key} = {value})"


SERVICE_BOARD = f"""
WITH resolved AS (
  SELECT r AS request,
         {record("service_type", "service_id", "r.service_id", "service_name", "price")} AS wanted,
         {record("users", "user_id", "r.user_id", "name", "user_type", "uni_id")} AS who,
         {record("vehicle", "vehicle_id", "r.vehicle_id", "license_plate", "model")} AS car,
         {record("parking_spots", "spot_id", "r.spot_id", "spot_number", "garage_id")} AS spot,
         {record("users", "user_id", "r.approved_by", "name")} AS decider
  FROM service_request r
  WHERE r.service_id IN (SELECT service_id FROM service_type)
    AND r.user_id IN (SELECT user_id FROM users))
SELECT unnest(request), wanted.service_name, wanted.price AS service_price,
       who.name AS user_name, who.user_type, who.uni_id, car.license_plate,
       car.model AS vehicle_model, spot.spot_number,
       (SELECT name FROM parking_garage WHERE garage_id = spot.garage_id) AS garage_name,
       decider.name AS approver_name, 'service' AS request_type
FROM resolved"""

REG_BOARD = f"""
SELECT * EXCLUDE (payment_status, payment_method, payment_amount)
FROM (SELECT * FROM svc_board WHERE FALSE
      UNION ALL BY NAME
      SELECT request_id, user_id, status, approved_by, created_at, completed_at, license_plate,
             model AS vehicle_model, who.name AS user_name, who.user_type, who.uni_id,
             decider.name AS approver_name, 'Vehicle Registration' AS service_name,
             CAST(0 AS DECIMAL(10,2)) AS service_price, 'vehicle_registration' AS request_type
      FROM (SELECT *, {record("users", "user_id", "r.user_id", "name", "user_type", "uni_id")} AS who,
                   {record("users", "user_id", "r.approved_by", "name")} AS decider
            FROM vehicle_registration_request r)
      WHERE who IS NOT NULL) shaped"""

BOARD = {"svc_board": SERVICE_BOARD, "reg_board": REG_BOARD,
         "board": "SELECT * FROM svc_board UNION ALL BY NAME SELECT * FROM reg_board"}

oracle("service_request_board", "SELECT * FROM svc_board", {"svc_board": SERVICE_BOARD})
oracle("registration_board", REG_BOARD, {"svc_board": SERVICE_BOARD})
oracle("requests_unified", "SELECT * FROM board", BOARD)
oracle("filter_status", """
SELECT * FROM svc_board WHERE status = 'Pending'
UNION ALL BY NAME
SELECT * FROM reg_board WHERE status = 'Pending'""", BOARD)

oracle("board_order", """
SELECT *, row_number() OVER (ORDER BY CASE WHEN status = 'Pending' THEN 0 ELSE 1 END,
                                      date_trunc('second', created_at) DESC,
                                      request_type ASC, request_id DESC) AS pos
FROM board""", BOARD)

oracle("row_search", """
SELECT * FROM board
WHERE contains(lower(concat_ws(' ', CAST(request_id AS VARCHAR), user_name, uni_id, service_name,
                               license_plate, spot_number, garage_name, status)), 'nation_1')""",
       BOARD)

oracle("role_scope", """
SELECT b.* FROM board b
WHERE EXISTS (SELECT 1 FROM users viewer
              WHERE viewer.user_id = 4
                AND (viewer.user_type IN ('Admin', 'Manager')
                     OR (viewer.user_type IN ('Student', 'Staff') AND b.user_id = viewer.user_id)))""",
       BOARD)

_OWNER = record("users", "user_id", "x.user_id", "name", "uni_id", "user_type")

DIRECT = f"""
SELECT * EXCLUDE (who), who.name AS user_name, who.uni_id, who.user_type,
       'direct_insert' AS source
FROM (SELECT *, {_OWNER} AS who FROM vehicle x)
WHERE access_status IS DISTINCT FROM TRUE AND who IS NOT NULL"""

PENDING_REGS = f"""
SELECT * EXCLUDE (who), who.name AS user_name, who.uni_id, who.user_type,
       'registration_request' AS source, CAST(NULL AS BIGINT) AS vehicle_id,
       CAST(NULL AS BIGINT) AS vehicle_approved_by
FROM (SELECT *, {_OWNER} AS who FROM vehicle_registration_request x)
WHERE status = 'Pending' AND who IS NOT NULL"""

PENDING = {"direct": DIRECT, "pregs": PENDING_REGS}

oracle("pending_vehicles_direct", DIRECT)
oracle("pending_registrations_board", PENDING_REGS)
oracle("pending_vehicles", "SELECT * FROM direct UNION ALL BY NAME SELECT * FROM pregs", PENDING)
oracle("pending_vehicle_count", """
SELECT COUNT(*) AS pending_vehicle_count
FROM (SELECT * FROM direct UNION ALL BY NAME SELECT * FROM pregs) t""", PENDING)

# free spots: those of garages that aren't known to be shut
FREE = """
WITH usable AS (SELECT garage_id, name AS garage_name, garage_status FROM parking_garage
                WHERE garage_status IS NULL OR garage_status = 'Open')
SELECT spot.spot_id, spot.spot_number, spot.spot_status, garage_id, garage_name, garage_status
FROM usable INNER JOIN parking_spots AS spot USING (garage_id)
WHERE spot.spot_status ILIKE 'available'"""

oracle("available_spots", "SELECT * FROM free", {"free": FREE})
oracle("available_by_garage", """
SELECT garage_name, COUNT(*) AS available_count FROM free GROUP BY garage_name""", {"free": FREE})

oracle("all_spots_audit", """
SELECT spot_id, spot_number, spot_status, garage_id, garage_name, garage_status
FROM parking_spots LEFT OUTER JOIN placed USING (spot_id)""", {"placed": """
SELECT spot_id, any_value(name) AS garage_name, any_value(garage_status) AS garage_status
FROM parking_spots JOIN parking_garage USING (garage_id) GROUP BY spot_id"""})

oracle("approved_on_day", """
SELECT request_id, user_id, status, completed_at FROM service_request
WHERE status = 'Approved' AND CAST(completed_at AS DATE) = DATE '1998-09-06'""")

oracle("vehicle_classes", """
SELECT vehicle_id, user_id, license_plate, access_status,
       CASE WHEN access_status = TRUE THEN 'approved' ELSE 'pending' END AS vehicle_class
FROM vehicle""")

oracle("sort_conditional", """
SELECT v.*, row_number() OVER (ORDER BY CASE WHEN access_status = TRUE THEN 0 ELSE 1 END,
                                        created_at DESC, vehicle_id DESC) AS pos
FROM vehicle v""")

oracle("my_vehicles", """
SELECT v.*,
       license_plate || ' - ' || COALESCE(model, 'N/A')
         || CASE WHEN COALESCE(color, '') <> '' THEN ' (' || color || ')' ELSE '' END
         || CASE WHEN access_status = TRUE THEN ' ✓ Approved' ELSE ' (Pending)' END AS label,
       row_number() OVER (PARTITION BY user_id
                          ORDER BY CASE WHEN access_status = TRUE THEN 0 ELSE 1 END,
                                   created_at DESC, vehicle_id DESC) AS pos
FROM vehicle v""")

oracle("managers", "SELECT * FROM users WHERE user_type = 'Manager' ORDER BY created_at DESC")

oracle("pending_registrations", """
SELECT vrr.*, 'Pending Registration' AS status_display
FROM vehicle_registration_request vrr WHERE vrr.status = 'Pending'""")

USER_REQS = f"""
SELECT * EXCLUDE (wanted), wanted.service_name, wanted.price AS service_price,
       (SELECT license_plate FROM vehicle v WHERE v.vehicle_id = found.vehicle_id) AS license_plate,
       (SELECT spot_number FROM parking_spots s WHERE s.spot_id = found.spot_id) AS spot_number,
       'service' AS request_type
FROM (SELECT *, {record("service_type", "service_id", "r.service_id", "service_name", "price")}
                  AS wanted
      FROM service_request r) found
WHERE wanted IS NOT NULL"""

USER_UNIFIED = {"ureqs": USER_REQS, "uu": """
SELECT * FROM ureqs
UNION ALL BY NAME
SELECT vrr.*, 'Vehicle Registration' AS service_name, CAST(0.00 AS DECIMAL(10,2)) AS service_price,
       CAST(NULL AS VARCHAR) AS spot_number, 'vehicle_registration' AS request_type
FROM vehicle_registration_request vrr"""}

oracle("user_requests", USER_REQS)
oracle("user_requests_unified", "SELECT * FROM uu", USER_UNIFIED)
oracle("recent_requests", """
SELECT * FROM (
  SELECT user_id, request_type, request_id, status, created_at, service_name, license_plate,
         spot_number,
         row_number() OVER (PARTITION BY user_id
                            ORDER BY date_trunc('second', created_at) DESC, request_type ASC,
                                     request_id DESC) AS rn
  FROM uu) t
WHERE rn <= 10""", USER_UNIFIED)

oracle("pending_top10", """
SELECT request_id, user_id, status, created_at, service_name, user_name, user_type,
       license_plate, spot_number, request_type
FROM board WHERE status = 'Pending'
QUALIFY row_number() OVER (ORDER BY created_at DESC, request_type, request_id DESC) <= 10""", BOARD)

ACTIVITY = """
SELECT * REPLACE (COALESCE(vehicle_count, 0) AS vehicle_count,
                  COALESCE(request_count, 0) AS request_count)
FROM users LEFT JOIN (
  SELECT user_id, COUNT(vehicle) AS vehicle_count, COUNT(request) AS request_count
  FROM (SELECT user_id, vehicle_id AS vehicle FROM vehicle WHERE access_status
        UNION ALL BY NAME
        SELECT user_id, request_id AS request FROM service_request)
  GROUP BY user_id) USING (user_id)"""

oracle("user_activity", ACTIVITY)
oracle("filter_user_type", ACTIVITY + " WHERE user_type = 'Student'")
oracle("sort_fallback", """
SELECT *, row_number() OVER (ORDER BY created_at DESC, user_id DESC) AS pos FROM activity""",
       {"activity": ACTIVITY})

oracle("garage_status_lookup", """
SELECT pg.garage_id, pg.name,
       COALESCE(NULLIF((SELECT g2.garage_status FROM parking_garage g2
                        WHERE g2.garage_id = pg.garage_id LIMIT 1), ''), 'Open') AS garage_status
FROM parking_garage pg""")

oracle("garage_occupancy", """
SELECT garage_id, name,
       CASE WHEN garage_status > '' THEN garage_status ELSE 'Open' END AS garage_status,
       COALESCE(len(spots), 0) AS total_spots,
       COALESCE(len(list_filter(spots, lambda s: s = 'Available')), 0) AS available_spots,
       COALESCE(len(list_filter(spots, lambda s: s = 'Reserved')), 0) AS reserved_spots
FROM parking_garage LEFT JOIN states USING (garage_id)""", {"states": """
SELECT garage_id, list(spot_status) AS spots FROM parking_spots GROUP BY garage_id"""})

STATUS_COUNTS = """
SELECT d.status, COALESCE(c.n, 0) AS count
FROM (VALUES ('Pending'), ('Approved'), ('Rejected')) d(status)
LEFT JOIN (SELECT status, COUNT(*) AS n
           FROM (SELECT status FROM service_request
                 UNION ALL SELECT status FROM vehicle_registration_request) s
           GROUP BY status) c ON d.status = c.status"""

oracle("status_counts", STATUS_COUNTS)
oracle("status_counts_map", STATUS_COUNTS)

oracle("user_type_counts", "SELECT user_type, COUNT(*) AS count FROM users GROUP BY user_type")
oracle("user_total", """
SELECT CAST(SUM(count) AS BIGINT) AS total_users
FROM (SELECT user_type, COUNT(*) AS count FROM users GROUP BY user_type) t""")

oracle("admin_kpis", """
SELECT (SELECT COUNT(*) FROM service_request WHERE status = 'Pending')
       + (SELECT COUNT(*) FROM vehicle_registration_request WHERE status = 'Pending')
         AS pending_count,
       (SELECT COUNT(*) FROM service_request
        WHERE status = 'Approved' AND CAST(completed_at AS DATE) = DATE '1998-09-06')
         AS approved_today,
       (SELECT COUNT(*) FROM users) AS total_users,
       (SELECT COUNT(*) FROM vehicle WHERE access_status = TRUE) AS total_vehicles""")


def _both(cond: str) -> str:
    return (f"(SELECT COUNT(*) FROM service_request s WHERE s.user_id = u.user_id{cond}) + "
            f"(SELECT COUNT(*) FROM vehicle_registration_request r WHERE r.user_id = u.user_id"
            f"{cond.replace('s.', 'r.')})")


oracle("user_kpis", f"""
SELECT u.user_id, u.user_type,
       (SELECT COUNT(*) FROM vehicle v WHERE v.user_id = u.user_id AND v.access_status = TRUE)
         AS approved_vehicles,
       {_both('')} AS request_count,
       {_both(" AND s.status = 'Pending'")} AS pending_count,
       {_both(" AND s.status = 'Approved'")} AS approved_count,
       {_both(" AND s.status = 'Rejected'")} AS rejected_count
FROM users u WHERE u.user_type IN ('Student', 'Staff')""")

oracle("vehicle_stats", """
SELECT u.user_id,
       (SELECT COUNT(*) FROM vehicle v WHERE v.user_id = u.user_id AND v.access_status = TRUE)
         AS approved,
       (SELECT COUNT(*) FROM vehicle v WHERE v.user_id = u.user_id
          AND (v.access_status = FALSE OR v.access_status IS NULL))
       + (SELECT COUNT(*) FROM vehicle_registration_request r
          WHERE r.user_id = u.user_id AND r.status = 'Pending') AS pending,
       (SELECT COUNT(*) FROM vehicle v WHERE v.user_id = u.user_id)
       + (SELECT COUNT(*) FROM vehicle_registration_request r
          WHERE r.user_id = u.user_id AND r.status = 'Pending') AS total
FROM users u""")

oracle("requests_per_vehicle", """
SELECT v.vehicle_id,
       (SELECT COUNT(*) FROM service_request sr WHERE sr.vehicle_id = v.vehicle_id) AS request_count
FROM vehicle v""")

oracle("scalar_text", r"""
SELECT user_id, upper(name) AS name_upper, lower(uni_id) AS uni_id_lower,
       COALESCE(phone, 'N/A') AS phone_or_na, CAST(user_id AS VARCHAR) AS user_id_text,
       trim(' ' || chr(9) || name || chr(10), ' ' || chr(9) || chr(10) || chr(13) || chr(11))
         AS name_trimmed,
       (phone IS NULL OR phone IN ('', '0')) AS phone_blank,
       CAST(strlen(name) AS INTEGER) AS name_bytes,
       regexp_matches(regexp_replace(phone, '[\s-]', '', 'g'), '^[0-9]{10,15}$') AS phone_valid,
       regexp_replace(phone, '[\s-]', '', 'g') AS phone_digits,
       upper(substr(name, 1, 1)) AS initial,
       upper(substr(lower(user_type), 1, 1)) || substr(lower(user_type), 2) AS type_display,
       CASE WHEN access_status THEN 'Active' ELSE 'Inactive' END AS access_label
FROM users""")

oracle("scalar_labels", """
SELECT request_type, request_id,
       CASE WHEN request_type = 'vehicle_registration' THEN '-'
            WHEN status = 'Approved' THEN
              CASE WHEN COALESCE(payment_status, 'Pending') = 'Paid'
                   THEN payment_method || ' EGP ' || printf('%,.2f', CAST(payment_amount AS DOUBLE))
                   ELSE 'Pending Payment' END
            ELSE '-' END AS payment_label,
       CASE WHEN request_type = 'vehicle_registration' THEN '-'
            ELSE 'EGP ' || printf('%,.2f', CAST(COALESCE(service_price, 0) AS DOUBLE)) END
         AS price_label,
       CASE WHEN status = 'Pending' THEN NULL
            ELSE 'By: ' || COALESCE(approver_name, 'System') END AS decided_by,
       COALESCE(license_plate, 'N/A') AS plate_label,
       COALESCE(spot_number, 'N/A') AS spot_label,
       strftime(created_at, '%b %d, %Y') AS created_day,
       strftime(created_at, '%H:%M') AS created_clock,
       strftime(created_at, '%b %d, %Y - %H:%M') AS created_stamp,
       CAST(created_at AS DATE) AS created_date,
       strftime(created_at, '%H:%M:%S') AS created_time
FROM board""", BOARD)

oracle("tag_literal_null", """
SELECT request_id, user_id, CAST(NULL AS BIGINT) AS vehicle_id, CAST(NULL AS BIGINT) AS service_id,
       status, approved_by, created_at, completed_at, CAST(NULL AS BIGINT) AS spot_id,
       'none' AS receipt_id, CAST(NULL AS VARCHAR) AS payment_status, CAST(NULL AS VARCHAR) AS payment_method,
       CAST(NULL AS DECIMAL(10,2)) AS payment_amount,
       license_plate, color, model, 'vehicle_registration' AS request_type
FROM vehicle_registration_request""")

