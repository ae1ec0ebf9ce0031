"""Oracles of the table operations and batch transforms (DuckDB SQL).

Each states the transform in plain SQL over the input state: window
functions pick the latest / first input per key, NOT EXISTS expresses
deletes, CASE expresses updates, UNION ALL BY NAME appends.
"""

from parkops.plans.o_boards import SERVICE_BOARD
from parkops.plans.oracle_sql import SQL, oracle

TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def t(c):
    return f"trim({c}, {TRIM})"


def blank(c):
    return f"({c} IS NULL OR {c} IN ('', '0'))"


def card_reason(n, v, e, h):
    n, v, e, h = t(n), t(v), t(e), t(h)
    return (f"CASE WHEN {blank(n)} OR {blank(v)} OR {blank(e)} OR {blank(h)} THEN 'missing_field' "
            f"WHEN strlen({n}) < 13 OR strlen({n}) > 19 THEN 'card_number_length' "
            f"WHEN strlen({v}) NOT IN (3, 4) THEN 'cvv_length' "
            f"WHEN NOT regexp_matches({e}, '^\\d{{2}}/\\d{{2}}$') THEN 'expiry_format' END")


VEH_COLS = "vehicle_id, license_plate, color, user_id, model, access_status, approved_by, created_at"

oracle("exists_gate", """
SELECT request_id, status FROM service_request
WHERE EXISTS (SELECT 1 FROM users WHERE user_type = 'Manager')""")

oracle("update_where_exists", """
SELECT vehicle_id, license_plate, CASE WHEN m THEN 'crimson' ELSE color END AS color, user_id, model,
       CASE WHEN m THEN TRUE ELSE access_status END AS access_status, approved_by, created_at
FROM (SELECT *, (model = 'Brand#13' AND color = 'red'
                 AND EXISTS (SELECT 1 FROM users WHERE user_type = 'Manager')) AS m
      FROM vehicle) x""")

oracle("join_update", """
SELECT v.vehicle_id, v.license_plate, v.color, v.user_id, v.model,
       CASE WHEN a.vehicle_id IS NOT NULL THEN TRUE ELSE v.access_status END AS access_status,
       CASE WHEN a.vehicle_id IS NOT NULL THEN a.approved_by ELSE v.approved_by END AS approved_by,
       v.created_at
FROM vehicle v LEFT JOIN (
  SELECT vehicle_id, approved_by FROM service_request
  WHERE status = 'Approved' AND vehicle_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY vehicle_id
                             ORDER BY completed_at DESC NULLS LAST, request_id DESC) = 1) a
  ON v.vehicle_id = a.vehicle_id""")

# --- I1 ---
DEC = {"d_last": """
SELECT * FROM decisions
QUALIFY row_number() OVER (PARTITION BY request_id
                           ORDER BY decided_at DESC, decided_by DESC, action DESC) = 1""",
       "appr": """
SELECT sr.vehicle_id, sr.spot_id, d.decided_at, d.decided_by
FROM decisions d JOIN service_request sr ON d.request_id = sr.request_id
WHERE d.action = 'approve'"""}

oracle("apply_request_decisions__requests", """
SELECT sr.request_id, sr.user_id, sr.vehicle_id, sr.service_id,
       CASE WHEN d.request_id IS NULL THEN sr.status
            WHEN d.action = 'approve' THEN 'Approved' ELSE 'Rejected' END AS status,
       CASE WHEN d.request_id IS NULL THEN sr.approved_by ELSE d.decided_by END AS approved_by,
       sr.created_at,
       CASE WHEN d.request_id IS NULL THEN sr.completed_at ELSE d.decided_at END AS completed_at,
       sr.spot_id, sr.receipt_id, sr.payment_status,
       sr.payment_method, sr.payment_amount
FROM service_request sr LEFT JOIN d_last d ON sr.request_id = d.request_id""", DEC)

oracle("apply_request_decisions__vehicles", """
SELECT v.vehicle_id, v.license_plate, v.color, v.user_id, v.model,
       CASE WHEN l.vehicle_id IS NOT NULL THEN TRUE ELSE v.access_status END AS access_status,
       CASE WHEN l.vehicle_id IS NOT NULL THEN l.decided_by ELSE v.approved_by END AS approved_by,
       v.created_at
FROM vehicle v LEFT JOIN (
  SELECT * FROM appr WHERE vehicle_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY decided_at DESC, decided_by DESC) = 1
) l ON v.vehicle_id = l.vehicle_id""", DEC)

oracle("apply_request_decisions__spots", """
SELECT ps.spot_id, ps.spot_number,
       CASE WHEN EXISTS (SELECT 1 FROM appr a WHERE a.spot_id = ps.spot_id) THEN 'Reserved'
            ELSE ps.spot_status END AS spot_status,
       ps.garage_id
FROM parking_spots ps""", DEC)

# --- I2 ---
# row at a time: an approval counts unless a vehicle or an approval before it has the plate
REG = {
    "rapp": """
SELECT DISTINCT d.decided_at, d.decided_by, d.request_id, r.user_id, r.license_plate, r.color, r.model
FROM registration_decisions d JOIN vehicle_registration_request r ON d.request_id = r.request_id
WHERE d.action = 'approve'
  AND NOT EXISTS (SELECT 1 FROM vehicle v WHERE v.license_plate = r.license_plate)""",
    "rwon": """
SELECT * FROM rapp a
WHERE NOT EXISTS (SELECT 1 FROM rapp b WHERE b.license_plate = a.license_plate
                  AND (b.decided_at, b.decided_by, b.request_id)
                      < (a.decided_at, a.decided_by, a.request_id))""",
    "reff": """
SELECT request_id, action, decided_by, decided_at FROM registration_decisions WHERE action = 'reject'
UNION SELECT request_id, 'approve', decided_by, decided_at FROM rwon""",
    "rend": """
SELECT * FROM reff e
WHERE NOT EXISTS (SELECT 1 FROM reff f WHERE f.request_id = e.request_id
                  AND (f.decided_at, f.decided_by, f.action) > (e.decided_at, e.decided_by, e.action))"""}

oracle("apply_registration_decisions__registrations", """
SELECT r.request_id, r.user_id, r.license_plate, r.color, r.model,
       CASE WHEN o.request_id IS NULL THEN r.status
            WHEN o.action = 'approve' THEN 'Approved' ELSE 'Rejected' END AS status,
       CASE WHEN o.request_id IS NULL THEN r.approved_by ELSE o.decided_by END AS approved_by,
       r.created_at,
       CASE WHEN o.request_id IS NULL THEN r.completed_at ELSE o.decided_at END AS completed_at
FROM vehicle_registration_request r LEFT JOIN rend o ON r.request_id = o.request_id""", REG)

oracle("apply_registration_decisions__vehicles", f"""
SELECT {VEH_COLS} FROM vehicle
UNION ALL BY NAME
SELECT (SELECT COALESCE(MAX(vehicle_id), 0) FROM vehicle)
         + row_number() OVER (ORDER BY decided_at, request_id) AS vehicle_id,
       license_plate, color, user_id, model, TRUE AS access_status, decided_by AS approved_by,
       decided_at AS created_at
FROM rwon""", REG)

oracle("set_garage_status", """
SELECT g.garage_id, g.name, g.garage_access,
       CASE WHEN a.garage_id IS NULL THEN g.garage_status
            WHEN a.action = 'open' THEN 'Open' ELSE 'Closed' END AS garage_status
FROM parking_garage g
LEFT JOIN (SELECT garage_id, max(action) AS action FROM garage_actions GROUP BY garage_id) a
  ON g.garage_id = a.garage_id""")

oracle("approve_vehicles", """
SELECT v.vehicle_id, v.license_plate, v.color, v.user_id, v.model,
       CASE WHEN a.vehicle_id IS NOT NULL THEN TRUE ELSE v.access_status END AS access_status,
       CASE WHEN a.vehicle_id IS NOT NULL THEN a.acted_by ELSE v.approved_by END AS approved_by,
       v.created_at
FROM vehicle v
LEFT JOIN (SELECT vehicle_id, max(acted_by) AS acted_by FROM vehicle_actions
           WHERE action = 'approve' GROUP BY vehicle_id) a ON v.vehicle_id = a.vehicle_id""")

REJ = {"rcnt": """
SELECT vehicle_id, request_count,
       CASE WHEN request_count > 0 THEN 'has_requests'
            WHEN EXISTS (SELECT 1 FROM owns o WHERE o.vehicle_id = y.vehicle_id)
              THEN 'referenced_by_owns' END AS reason
FROM (SELECT x.vehicle_id,
             (SELECT COUNT(*) FROM service_request sr WHERE sr.vehicle_id = x.vehicle_id)
               AS request_count
      FROM (SELECT DISTINCT vehicle_id FROM vehicle_actions
            WHERE action = 'reject' AND vehicle_id IN (SELECT vehicle_id FROM vehicle)) x) y"""}

oracle("reject_vehicles__vehicles", """
SELECT * FROM vehicle v
WHERE NOT EXISTS (SELECT 1 FROM rcnt c WHERE c.reason IS NULL AND c.vehicle_id = v.vehicle_id)""",
       REJ)
oracle("reject_vehicles__logs", """
SELECT * FROM log_record l
WHERE NOT EXISTS (SELECT 1 FROM rcnt c WHERE c.reason IS NULL AND c.vehicle_id = l.vehicle_id)""",
       REJ)
oracle("reject_vehicles__blocked",
       "SELECT vehicle_id, request_count, reason FROM rcnt WHERE reason IS NOT NULL", REJ)

OWN = {"own_oc": """
SELECT dd.vehicle_id, dd.user_id,
       CASE WHEN (SELECT COUNT(*) FROM service_request sr WHERE sr.vehicle_id = dd.vehicle_id) > 0
              THEN 'used'
            WHEN NOT EXISTS (SELECT 1 FROM vehicle v
                             WHERE v.vehicle_id = dd.vehicle_id AND v.user_id = dd.user_id)
              THEN 'not_owner'
            WHEN EXISTS (SELECT 1 FROM log_record l WHERE l.vehicle_id = dd.vehicle_id)
                 OR EXISTS (SELECT 1 FROM owns o WHERE o.vehicle_id = dd.vehicle_id)
              THEN 'referenced'
            ELSE 'deleted' END AS outcome
FROM (SELECT DISTINCT vehicle_id, user_id FROM vehicle_edits) dd"""}

oracle("delete_own_vehicle__outcome", "SELECT * FROM own_oc", OWN)
oracle("delete_own_vehicle__vehicles", """
SELECT * FROM vehicle v
WHERE NOT EXISTS (SELECT 1 FROM own_oc o WHERE o.outcome = 'deleted'
                  AND o.vehicle_id = v.vehicle_id AND o.user_id = v.user_id)""", OWN)

EDIT = {
    "ein": f"""
SELECT vehicle_id, user_id, {t('license_plate')} AS license_plate, {t('color')} AS color,
       {t('model')} AS model, edited_at
FROM vehicle_edits""",
    "eok": f"""
SELECT e.* FROM ein e JOIN vehicle v ON e.vehicle_id = v.vehicle_id AND e.user_id = v.user_id
WHERE NOT ({blank('e.license_plate')} OR {blank('e.color')} OR {blank('e.model')})
  AND NOT EXISTS (SELECT 1 FROM vehicle o WHERE o.license_plate = e.license_plate
                  AND o.vehicle_id <> e.vehicle_id)""",
    "eclaim": """
SELECT license_plate, vehicle_id FROM eok
QUALIFY row_number() OVER (PARTITION BY license_plate ORDER BY edited_at, vehicle_id) = 1""",
    "eend": """
SELECT e.* FROM eok e JOIN eclaim c USING (license_plate, vehicle_id)
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY edited_at DESC, license_plate DESC,
                           color DESC, model DESC) = 1"""}

oracle("edit_vehicles", """
SELECT v.vehicle_id,
       CASE WHEN ok.vehicle_id IS NOT NULL THEN ok.license_plate ELSE v.license_plate END
         AS license_plate,
       CASE WHEN ok.vehicle_id IS NOT NULL THEN ok.color ELSE v.color END AS color,
       v.user_id,
       CASE WHEN ok.vehicle_id IS NOT NULL THEN ok.model ELSE v.model END AS model,
       v.access_status, v.approved_by, v.created_at
FROM vehicle v LEFT JOIN eend ok ON v.vehicle_id = ok.vehicle_id""", EDIT)

# --- I8 ---
CAS = {
    "ctarget": """
SELECT vehicle_id, license_plate FROM vehicle
WHERE license_plate IN (SELECT license_plate FROM purge_plates)""",
    "ctreq": """
SELECT request_id, vehicle_id FROM service_request
WHERE vehicle_id IN (SELECT vehicle_id FROM ctarget)""",
    "cblk": """
SELECT vehicle_id, min(reason) AS reason FROM (
  SELECT vehicle_id, 'referenced_by_log' AS reason FROM log_record
  UNION ALL SELECT t.vehicle_id, 'referenced_by_log' FROM log_record l
            JOIN ctreq t ON l.request_id = t.request_id
  UNION ALL SELECT vehicle_id, 'referenced_by_owns' FROM owns
  UNION ALL SELECT t.vehicle_id, 'referenced_by_owns' FROM owns o
            JOIN ctreq t ON o.request_id = t.request_id) x
WHERE vehicle_id IN (SELECT vehicle_id FROM ctarget)
GROUP BY vehicle_id""",
    "cokv": "SELECT vehicle_id FROM ctarget WHERE vehicle_id NOT IN (SELECT vehicle_id FROM cblk)",
    "cokr": "SELECT request_id FROM ctreq WHERE vehicle_id IN (SELECT vehicle_id FROM cokv)",
    "coki": "SELECT invoice_id FROM invoice WHERE request_id IN (SELECT request_id FROM cokr)",
}

oracle("delete_vehicle_cascade__payments", """
SELECT * FROM payment p WHERE NOT EXISTS (SELECT 1 FROM coki k WHERE k.invoice_id = p.invoice_id)""",
       CAS)
oracle("delete_vehicle_cascade__invoices", """
SELECT * FROM invoice i WHERE NOT EXISTS (SELECT 1 FROM cokr k WHERE k.request_id = i.request_id)""",
       CAS)
oracle("delete_vehicle_cascade__requests", """
SELECT * FROM service_request s
WHERE NOT EXISTS (SELECT 1 FROM cokr k WHERE k.request_id = s.request_id)""", CAS)
oracle("delete_vehicle_cascade__vehicles", """
SELECT * FROM vehicle v WHERE NOT EXISTS (SELECT 1 FROM cokv k WHERE k.vehicle_id = v.vehicle_id)""",
       CAS)
oracle("delete_vehicle_cascade__blocked", """
SELECT t.license_plate, b.reason FROM ctarget t JOIN cblk b ON t.vehicle_id = b.vehicle_id""", CAS)

# --- I9 ---
PUR = {
    "pcand": """
SELECT DISTINCT p.user_id, u.user_type FROM purge_ids p JOIN users u ON p.user_id = u.user_id""",
    "pcveh": """
SELECT vehicle_id, user_id AS owner FROM vehicle WHERE user_id IN (SELECT user_id FROM pcand)""",
    "pcrep": """
SELECT report_id, user_id AS author FROM reports WHERE user_id IN (SELECT user_id FROM pcand)""",
    "pblk": """
SELECT user_id, arg_min(reason, CASE reason WHEN 'manager' THEN 0 WHEN 'type_not_allowed' THEN 1
                                 WHEN 'self' THEN 2 WHEN 'vehicle_used_by_other' THEN 3
                                 WHEN 'vehicle_in_owns' THEN 4 WHEN 'report_requested' THEN 5
                                 ELSE 6 END) AS reason FROM (
  SELECT user_id, 'manager' AS reason FROM pcand WHERE user_type = 'Manager'
  UNION ALL SELECT user_id, 'type_not_allowed' FROM pcand
            WHERE user_type IS NULL OR user_type NOT IN ('Student', 'Staff', 'Admin', 'Manager')
  UNION ALL SELECT user_id, 'self' FROM pcand WHERE user_id = 1
  UNION ALL SELECT cv.owner, 'vehicle_used_by_other' FROM service_request sr
            JOIN pcveh cv ON sr.vehicle_id = cv.vehicle_id WHERE sr.user_id <> cv.owner
  UNION ALL SELECT cv.owner, 'vehicle_in_owns' FROM owns o
            JOIN pcveh cv ON o.vehicle_id = cv.vehicle_id
            LEFT JOIN service_request sr ON o.request_id = sr.request_id
            WHERE sr.user_id IS NULL OR sr.user_id <> cv.owner
  UNION ALL SELECT cr.author, 'report_requested' FROM requests m
            JOIN pcrep cr ON m.report_id = cr.report_id
  UNION ALL SELECT cr.author, 'report_logged' FROM log_record l
            JOIN pcrep cr ON l.report_id = cr.report_id
            LEFT JOIN service_request sr ON l.request_id = sr.request_id
            LEFT JOIN vehicle v ON l.vehicle_id = v.vehicle_id
            WHERE NOT (COALESCE(sr.user_id = cr.author, FALSE)
                       OR COALESCE(v.user_id = cr.author, FALSE)
                       OR COALESCE(l.user_id = cr.author, FALSE))) x
GROUP BY user_id""",
    "pok": "SELECT user_id FROM pcand WHERE user_id NOT IN (SELECT user_id FROM pblk)",
    "preq": "SELECT request_id FROM service_request WHERE user_id IN (SELECT user_id FROM pok)",
    "pveh": "SELECT vehicle_id FROM vehicle WHERE user_id IN (SELECT user_id FROM pok)",
    "pinv": "SELECT invoice_id FROM invoice WHERE request_id IN (SELECT request_id FROM preq)",
}


def _no_user(alias):
    return f"NOT EXISTS (SELECT 1 FROM pok k WHERE k.user_id = {alias}.user_id)"


def _null_approver(alias):
    return (f"CASE WHEN EXISTS (SELECT 1 FROM pok k WHERE k.user_id = {alias}.approved_by) "
            f"THEN NULL ELSE {alias}.approved_by END AS approved_by")


oracle("purge_users__users", f"SELECT * FROM users u WHERE {_no_user('u')}", PUR)
oracle("purge_users__vehicles", f"""
SELECT v.vehicle_id, v.license_plate, v.color, v.user_id, v.model, v.access_status,
       {_null_approver('v')}, v.created_at
FROM vehicle v WHERE {_no_user('v')}""", PUR)
oracle("purge_users__requests", f"""
SELECT s.request_id, s.user_id, s.vehicle_id, s.service_id, s.status, {_null_approver('s')},
       s.created_at, s.completed_at, s.spot_id, s.receipt_id, s.payment_status,
       s.payment_method, s.payment_amount
FROM service_request s WHERE {_no_user('s')}""", PUR)
oracle("purge_users__registrations", f"""
SELECT r.request_id, r.user_id, r.license_plate, r.color, r.model, r.status,
       {_null_approver('r')}, r.created_at, r.completed_at
FROM vehicle_registration_request r WHERE {_no_user('r')}""", PUR)
oracle("purge_users__invoices", """
SELECT * FROM invoice i WHERE NOT EXISTS (SELECT 1 FROM preq k WHERE k.request_id = i.request_id)""",
       PUR)
oracle("purge_users__payments", """
SELECT * FROM payment p WHERE NOT EXISTS (SELECT 1 FROM pinv k WHERE k.invoice_id = p.invoice_id)""",
       PUR)
oracle("purge_users__logs", f"""
SELECT * FROM log_record l
WHERE NOT EXISTS (SELECT 1 FROM preq k WHERE k.request_id = l.request_id)
  AND NOT EXISTS (SELECT 1 FROM pveh k WHERE k.vehicle_id = l.vehicle_id)
  AND {_no_user('l')}""", PUR)
oracle("purge_users__owns", """
SELECT * FROM owns o WHERE NOT EXISTS (SELECT 1 FROM preq k WHERE k.request_id = o.request_id)""",
       PUR)
oracle("purge_users__reports", f"SELECT * FROM reports r WHERE {_no_user('r')}", PUR)
oracle("purge_users__mn_requests", f"SELECT * FROM requests m WHERE {_no_user('m')}", PUR)
oracle("purge_users__controls", f"SELECT * FROM controls c WHERE {_no_user('c')}", PUR)
oracle("purge_users__blocked", "SELECT user_id, reason FROM pblk", PUR)

oracle("join_delete", """
SELECT * FROM payment p
WHERE NOT EXISTS (SELECT 1 FROM invoice i JOIN service_request sr ON i.request_id = sr.request_id
                  WHERE i.invoice_id = p.invoice_id
                    AND sr.user_id IN (SELECT user_id FROM purge_ids))""")

oracle("nullify_reference", """
SELECT request_id, user_id, vehicle_id, service_id, status,
       CASE WHEN approved_by IN (SELECT user_id FROM purge_ids) THEN NULL ELSE approved_by END
         AS approved_by,
       created_at, completed_at, spot_id, receipt_id, payment_status, payment_method, payment_amount
FROM service_request""")

oracle("nested_in_join", """
SELECT * FROM payment
WHERE invoice_id IN (
  SELECT i.invoice_id FROM invoice i JOIN service_request sr ON i.request_id = sr.request_id
  WHERE sr.vehicle_id IN (SELECT vehicle_id FROM vehicle
                          WHERE license_plate IN (SELECT license_plate FROM purge_plates)))""")

# --- I10 ---
SUB = {
    "schk": """
SELECT s.*, st.price AS _price,
       COALESCE(CASE WHEN s.spot_id IS NULL THEN NULL
                     WHEN v.spot_id IS NULL THEN 'spot_missing'
                     WHEN upper(COALESCE(v.spot_status, '')) <> 'AVAILABLE' THEN 'spot_not_available'
                     WHEN COALESCE(v.garage_status, 'Open') = 'Closed' THEN 'garage_closed' END,
                CASE WHEN st.service_id IS NULL THEN 'service_missing' END,
                CASE WHEN s.vehicle_id IS NOT NULL
                      AND NOT EXISTS (SELECT 1 FROM vehicle x WHERE x.vehicle_id = s.vehicle_id)
                     THEN 'vehicle_missing' END) AS reason
FROM submissions s
LEFT JOIN (SELECT ps.spot_id, ps.spot_status, pg.garage_status
           FROM parking_spots ps JOIN parking_garage pg ON ps.garage_id = pg.garage_id) v
  ON s.spot_id = v.spot_id
LEFT JOIN service_type st ON s.service_id = st.service_id""",
    "sacc": """
SELECT *,
       (SELECT COALESCE(MAX(request_id), 0) FROM service_request)
         + row_number() OVER (ORDER BY submitted_at, user_id) AS request_id,
       (SELECT COALESCE(MAX(invoice_id), 0) FROM invoice)
         + row_number() OVER (ORDER BY submitted_at, user_id) AS invoice_id
FROM schk WHERE reason IS NULL"""}

oracle("submit_requests__rejected",
       "SELECT user_id, spot_id, reason FROM schk WHERE reason IS NOT NULL", SUB)
oracle("submit_requests__requests", """
SELECT * FROM service_request
UNION ALL BY NAME
SELECT request_id, user_id, vehicle_id, service_id, 'Pending' AS status,
       CAST(NULL AS BIGINT) AS approved_by, submitted_at AS created_at,
       CAST(NULL AS TIMESTAMP) AS completed_at, spot_id, CAST(invoice_id AS VARCHAR) AS receipt_id,
       'Pending' AS payment_status, 'Pending' AS payment_method
FROM sacc""", SUB)
oracle("submit_requests__invoices", """
SELECT * FROM invoice
UNION ALL BY NAME
SELECT invoice_id, request_id, CAST(COALESCE(_price, 0) AS DECIMAL(10,2)) AS amount,
       CAST(submitted_at AS DATE) AS date_issued, strftime(submitted_at, '%H:%M:%S') AS time_issued,
       CAST(invoice_id AS VARCHAR) AS receipt_id
FROM sacc""", SUB)

# --- I11 ---
PAY = {
    "pj": f"""
SELECT p.*, sr.user_id AS _owner, sr.status, sr.payment_status, st.price AS amount,
       {card_reason('p.card_number', 'p.card_cvv', 'p.card_expiry', 'p.cardholder_name')} AS card
FROM payments_in p JOIN service_request sr ON p.request_id = sr.request_id
LEFT JOIN service_type st ON sr.service_id = st.service_id""",
    "pgood": """
SELECT * FROM pj
WHERE user_id = _owner
  AND COALESCE(status, '') = 'Approved' AND COALESCE(payment_status, 'Pending') <> 'Paid'
  AND (method = 'Cash' OR (method = 'Credit' AND card IS NULL))
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY paid_at, method, card_number NULLS FIRST,
  card_cvv NULLS FIRST, card_expiry NULLS FIRST, cardholder_name NULLS FIRST) = 1""",
    "pwi": """
SELECT g.*, (SELECT min(i.invoice_id) FROM invoice i WHERE i.request_id = g.request_id) AS inv0
FROM pgood g""",
    "pids": """
SELECT *,
       COALESCE(inv0, (SELECT COALESCE(MAX(invoice_id), 0) FROM invoice)
                      + row_number() OVER (PARTITION BY inv0 IS NULL ORDER BY paid_at, request_id))
         AS invoice_id,
       inv0 IS NULL AS _created,
       (SELECT COALESCE(MAX(method_id), 0) FROM payment_method)
         + row_number() OVER (ORDER BY paid_at, request_id) AS method_id,
       (SELECT COALESCE(MAX(payment_id), 0) FROM payment)
         + row_number() OVER (ORDER BY paid_at, request_id) AS payment_id
FROM pwi"""}

oracle("apply_payments__requests", """
SELECT sr.request_id, sr.user_id, sr.vehicle_id, sr.service_id, sr.status, sr.approved_by,
       sr.created_at, sr.completed_at, sr.spot_id,
       CASE WHEN k.request_id IS NOT NULL THEN CAST(k.invoice_id AS VARCHAR) ELSE sr.receipt_id END
         AS receipt_id,
       CASE WHEN k.request_id IS NOT NULL THEN 'Paid' ELSE sr.payment_status END AS payment_status,
       CASE WHEN k.request_id IS NOT NULL THEN k.method ELSE sr.payment_method END AS payment_method,
       CASE WHEN k.request_id IS NOT NULL THEN k.amount ELSE sr.payment_amount END AS payment_amount
FROM service_request sr LEFT JOIN pids k ON sr.request_id = k.request_id""", PAY)

oracle("apply_payments__rejected", """
SELECT request_id, user_id, method, paid_at, COALESCE(why, 'already_paid') AS reason,
       n - CASE WHEN why IS NULL AND rn = 1 THEN 1 ELSE 0 END AS copies
FROM (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (
               PARTITION BY request_id, why IS NULL ORDER BY paid_at, method, card_number NULLS FIRST,
               card_cvv NULLS FIRST, card_expiry NULLS FIRST, cardholder_name NULLS FIRST) END AS rn
      FROM pwhy) x
WHERE why IS NOT NULL OR rn > 1 OR n > 1""", {"pwhy": f"""
SELECT p.*, CASE
    WHEN NOT EXISTS (SELECT 1 FROM service_request s
                     WHERE s.request_id = p.request_id AND s.user_id = p.user_id) THEN 'request_not_found'
    WHEN p.request_id NOT IN (SELECT request_id FROM service_request WHERE status = 'Approved')
      THEN 'not_approved'
    WHEN p.request_id IN (SELECT request_id FROM service_request WHERE payment_status = 'Paid')
      THEN 'already_paid'
    WHEN method = 'Credit' THEN {card_reason('card_number', 'card_cvv', 'card_expiry', 'cardholder_name')}
    WHEN method IS DISTINCT FROM 'Cash' THEN 'no_method' END AS why
FROM (SELECT *, COUNT(*) AS n FROM payments_in GROUP BY ALL) p"""})

oracle("apply_payments__invoices", """
SELECT i.invoice_id, i.request_id, i.amount, i.date_issued, i.time_issued,
       CASE WHEN EXISTS (SELECT 1 FROM pids k WHERE k.invoice_id = i.invoice_id)
            THEN CAST(i.invoice_id AS VARCHAR) ELSE i.receipt_id END AS receipt_id
FROM invoice i
UNION ALL BY NAME
SELECT invoice_id, request_id, amount, CAST(paid_at AS DATE) AS date_issued,
       strftime(paid_at, '%H:%M:%S') AS time_issued, CAST(invoice_id AS VARCHAR) AS receipt_id
FROM pids WHERE _created""", PAY)

oracle("apply_payments__methods", f"""
SELECT * FROM payment_method
UNION ALL BY NAME
SELECT method_id, CASE WHEN method = 'Credit' THEN 'Credit Card' ELSE 'Cash' END AS method_type,
       CASE WHEN method = 'Credit'
            THEN 'Card: ****' || right({t('card_number')}, 4) || ', Exp: ' || {t('card_expiry')}
                 || ', Holder: ' || {t('cardholder_name')}
            ELSE 'Cash payment at service counter' END AS payment_info
FROM pids""", PAY)

oracle("apply_payments__payments", """
SELECT * FROM payment
UNION ALL BY NAME
SELECT payment_id, invoice_id, amount, CAST(paid_at AS DATE) AS date_paid,
       strftime(paid_at, '%H:%M:%S') AS time_paid, 'Paid' AS status, method_id
FROM pids""", PAY)

# --- I16 ---
RIN = {
    "rin": f"""
SELECT user_id, {t('license_plate')} AS license_plate, {t('color')} AS color,
       {t('model')} AS model, submitted_at, count(*) AS n
FROM registrations_in GROUP BY ALL""",
    "rbase": f"""
SELECT *, CASE WHEN {blank('license_plate')} OR {blank('color')} OR {blank('model')} THEN 'missing_field'
               WHEN EXISTS (SELECT 1 FROM vehicle v WHERE v.license_plate = r.license_plate)
                 THEN 'plate_registered'
               WHEN EXISTS (SELECT 1 FROM vehicle_registration_request q
                            WHERE q.status = 'Pending' AND q.license_plate = r.license_plate)
                 THEN 'already_pending' END AS refused
FROM rin r""",
    # row at a time: pending by then if a valid one for the plate came before
    "rchk": """
SELECT *, EXISTS (SELECT 1 FROM rbase a WHERE a.refused IS NULL AND b.refused IS NULL
                  AND a.license_plate = b.license_plate
                  AND (a.submitted_at, a.user_id, a.color, a.model)
                      < (b.submitted_at, b.user_id, b.color, b.model)) AS late
FROM rbase b"""}

oracle("submit_registrations__rejected", """
SELECT user_id, license_plate, submitted_at, COALESCE(refused, 'already_pending') AS reason,
       n - CASE WHEN refused IS NULL AND NOT late THEN 1 ELSE 0 END AS copies
FROM rchk WHERE n > 1 OR refused IS NOT NULL OR late""", RIN)
oracle("submit_registrations__registrations", """
SELECT * FROM vehicle_registration_request
UNION ALL BY NAME
SELECT (SELECT COALESCE(MAX(request_id), 0) FROM vehicle_registration_request)
         + row_number() OVER (ORDER BY submitted_at, user_id, license_plate) AS request_id,
       user_id, license_plate, color, model, 'Pending' AS status,
       CAST(NULL AS BIGINT) AS approved_by, submitted_at AS created_at,
       CAST(NULL AS TIMESTAMP) AS completed_at
FROM rchk WHERE refused IS NULL AND NOT late""", RIN)

# --- I17 ---
# row at a time: a recursive walk over the sign-ups that share an id or a phone
SIGN = {
    "sin": f"""
SELECT {t('uni_id')} AS uni_id, {t('name')} AS name, {t('phone')} AS phone,
       {t('user_type')} AS user_type, submitted_at, count(*) AS n
FROM users_in GROUP BY ALL""",
    "sbase": """
SELECT *, lower(uni_id) AS lid,
       row_number() OVER (ORDER BY submitted_at, uni_id, name, phone NULLS FIRST, user_type NULLS FIRST)
         AS rn,
       EXISTS (SELECT 1 FROM users u WHERE lower(u.uni_id) = lower(s.uni_id)) AS id_taken,
       COALESCE(user_type IN ('Student', 'Staff', 'Admin', 'Manager'), FALSE) AS known,
       EXISTS (SELECT 1 FROM users u WHERE u.phone = s.phone) AS ph_taken
FROM sin s""",
    "scand": """
SELECT rn, lid, phone, count(*) OVER (PARTITION BY lid) > 1
       OR (phone IS NOT NULL AND count(*) OVER (PARTITION BY phone) > 1) AS shared
FROM sbase WHERE NOT id_taken AND known AND NOT ph_taken""",
    "swalk": """
WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY rn) AS i, * FROM scand WHERE shared),
w AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS rn, FALSE AS ok,
         CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS phones
  UNION ALL
  SELECT i, rn, ok, CASE WHEN ok THEN list_append(ids, lid) ELSE ids END,
         CASE WHEN ok THEN list_append(phones, phone) ELSE phones END
  FROM (SELECT c.i, c.rn, c.lid, c.phone, w.ids, w.phones,
               NOT (list_contains(w.ids, c.lid)
                    OR COALESCE(list_contains(w.phones, c.phone), FALSE)) AS ok
        FROM w JOIN c ON c.i = w.i + 1) x)
SELECT rn FROM w WHERE ok""",
    "sacc": "SELECT * FROM scand WHERE NOT shared OR rn IN (SELECT rn FROM swalk)",
    "schk2": """
SELECT *,
       CASE WHEN id_taken OR EXISTS (SELECT 1 FROM sacc a WHERE a.lid = b.lid AND a.rn < b.rn)
              THEN 'uni_id_taken'
            WHEN NOT known THEN 'invalid_type'
            WHEN ph_taken OR EXISTS (SELECT 1 FROM sacc a WHERE a.phone = b.phone AND a.rn < b.rn)
              THEN 'phone_taken' END AS reason
FROM sbase b"""}

oracle("register_users__rejected", """
SELECT uni_id, submitted_at, COALESCE(reason, 'uni_id_taken') AS reason,
       n - CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS copies
FROM schk2 WHERE n > 1 OR reason IS NOT NULL""", SIGN)
oracle("register_users__users", """
SELECT * FROM users
UNION ALL BY NAME
SELECT (SELECT COALESCE(MAX(user_id), 0) FROM users)
         + row_number() OVER (ORDER BY submitted_at, uni_id) AS user_id,
       uni_id, name, phone, user_type, CAST(NULL AS BOOLEAN) AS access_status,
       submitted_at AS created_at
FROM schk2 WHERE reason IS NULL""", SIGN)

def _empty(c):
    return f"({t(c)} IS NULL OR {t(c)} IN ('', '0'))"


MANAGE = SIGN | {
    "sin": f"""
SELECT {t('uni_id')} AS uni_id, {t('name')} AS name, {t('phone')} AS phone, NULL::VARCHAR AS user_type,
       submitted_at, COALESCE(password NOT IN ('', '0'), FALSE) AS has_password, count(*) AS n
FROM managers_in GROUP BY ALL""",
    "sbase": f"""
SELECT *, lower(uni_id) AS lid,
       row_number() OVER (ORDER BY submitted_at, uni_id, name, phone NULLS FIRST, has_password) AS rn,
       EXISTS (SELECT 1 FROM users u WHERE lower(u.uni_id) = lower(s.uni_id)) AS id_taken,
       has_password AND NOT {_empty('uni_id')} AND NOT {_empty('name')} AND NOT {_empty('phone')} AS known,
       EXISTS (SELECT 1 FROM users u WHERE u.phone = s.phone) AS ph_taken
FROM sin s""",
    "schk2": SIGN["schk2"].replace("invalid_type", "missing_field")}

oracle("register_managers__rejected", """
SELECT uni_id, submitted_at, COALESCE(reason, 'uni_id_taken') AS reason,
       n - CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS copies
FROM schk2 WHERE n > 1 OR reason IS NOT NULL""", MANAGE)
oracle("register_managers__users", """
SELECT * FROM users
UNION ALL BY NAME
SELECT (SELECT COALESCE(MAX(user_id), 0) FROM users)
         + row_number() OVER (ORDER BY submitted_at, uni_id) AS user_id,
       uni_id, name, phone, 'Manager' AS user_type, CAST(NULL AS BOOLEAN) AS access_status,
       submitted_at AS created_at
FROM schk2 WHERE reason IS NULL""", MANAGE)

oracle("request_detail", """
SELECT b.* FROM svc_board b
WHERE EXISTS (SELECT 1 FROM payments_in p WHERE p.request_id = b.request_id
              AND p.user_id = b.user_id)""", {"svc_board": SERVICE_BOARD})

# --- A ---
AI = {"ai": """
SELECT uni_id, name, phone, user_type, submitted_at,
       (SELECT COALESCE(MAX(user_id), 0) FROM users)
         + row_number() OVER (ORDER BY submitted_at, uni_id) AS user_id
FROM users_in"""}

oracle("assign_identity", "SELECT * FROM ai", AI)
oracle("append_rows", """
SELECT * FROM users
UNION ALL BY NAME
SELECT user_id, uni_id, name, phone, user_type FROM ai""", AI)
oracle("insert_if_absent", """
SELECT * FROM users
UNION ALL BY NAME
SELECT user_id, uni_id, name, phone, user_type FROM ai
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.uni_id = ai.uni_id)""", AI)
oracle("ensure_column", """
SELECT * EXCLUDE (payment_method, payment_amount), 'Pending' AS payment_method,
       CAST(NULL AS DECIMAL(10,2)) AS payment_amount
FROM service_request""")
oracle("default_fill", """
SELECT user_id, license_plate, color, model, submitted_at AS created_at, 'Pending' AS status,
       CAST(NULL AS BIGINT) AS approved_by, CAST(NULL AS TIMESTAMP) AS completed_at
FROM registrations_in""")

# --- maintained counters: counted anew after the batch ---
_DECIDED = SQL["apply_request_decisions__requests"]
oracle("status_counts__maintained", "SELECT status, COUNT(*) AS n FROM decided GROUP BY status",
       {"decided": _DECIDED})
oracle("user_kpis__maintained", """
SELECT user_id, COUNT(*) AS request_count, COUNT(*) FILTER (WHERE status = 'Pending') AS pending_count,
       COUNT(*) FILTER (WHERE status = 'Approved') AS approved_count,
       COUNT(*) FILTER (WHERE status = 'Rejected') AS rejected_count
FROM decided GROUP BY user_id""", {"decided": _DECIDED})
