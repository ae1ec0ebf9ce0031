"""Oracles of the data-quality queries."""

from parkops.plans.oracle_sql import oracle
from parkops.sources import schema as S


def _keytext(cols):
    return "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def _unique(of):
    keys = list(S.PRIMARY_KEYS.items()) + [(t, k) for t, ks in S.UNIQUE_KEYS.items() for k in ks]
    return "\nUNION ALL\n".join(
        f"SELECT 'unique' AS rule, '{t}' AS table_name, '{','.join(cols)}' AS column_name, "
        f"{_keytext(cols)} AS value, COUNT(*) AS n FROM {of(t)} "
        f"GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1" for t, cols in keys)


def _domain(of):
    return "\nUNION ALL\n".join(
        f"SELECT 'domain' AS rule, '{t}' AS table_name, '{c}' AS column_name, "
        f"{_keytext(S.PRIMARY_KEYS[t])} AS key, CAST({c} AS VARCHAR) AS value FROM {of(t)} "
        f"WHERE {c} NOT IN ({', '.join(repr(a) for a in allowed)})"
        for t, c, allowed in S.DOMAINS if c in of(t, c))


def _foreign(of):
    return "\nUNION ALL\n".join(
        f"SELECT 'foreign_key' AS rule, '{child}' AS table_name, '{col}' AS column_name, "
        f"'{parent}' AS parent_table, CAST(c.{col} AS VARCHAR) AS value, COUNT(*) AS n "
        f"FROM {of(child)} c WHERE c.{col} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {of(parent)} p WHERE p.{pcol} = c.{col}) GROUP BY c.{col}"
        for child, col, parent, pcol in S.FOREIGN_KEYS)


def _not_null(of):
    return "\nUNION ALL\n".join(
        f"SELECT 'not_null' AS rule, '{t}' AS table_name, '{c}' AS column_name, "
        f"{_keytext(S.PRIMARY_KEYS[t])} AS key FROM {of(t)} WHERE {c} IS NULL" for t, c in S.NOT_NULL)


def _max_length(of, more=""):
    return "\nUNION ALL\n".join(
        f"SELECT 'max_length' AS rule, '{t}' AS table_name, '{c}' AS column_name, "
        f"{_keytext(S.PRIMARY_KEYS[t])} AS key, CAST(strlen({c}) AS INTEGER) AS value_len, "
        f"{n} AS max_len{more.format(c)} FROM {of(t)} WHERE strlen({c}) > {n}" for t, c, n in S.MAX_LENGTHS)


class _Staged:
    """Name of a table's staged form."""

    SPOILED = ("users", "vehicle", "service_request", "payment", "requests", "gates")

    def __call__(self, t, column=None):
        if column is not None:
            return (column,)
        return f"staged_{t}" if t in self.SPOILED else t


def _plain(t, column=None):
    return t if column is None else (column,)


STAGED = _Staged()
oracle("dq_unique", _unique(_plain))
oracle("dq_domain", _domain(_plain))
oracle("dq_foreign_key", _foreign(_plain))
oracle("dq_not_null", _not_null(_plain))
oracle("dq_max_length", _max_length(_plain))
oracle("dq_unique__staged", _unique(STAGED))
oracle("dq_domain__staged", _domain(STAGED))
oracle("dq_foreign_key__staged", _foreign(STAGED))
oracle("dq_not_null__staged", _not_null(STAGED))
oracle("dq_max_length__staged", _max_length(STAGED))
oracle("dq_constraints__staged", f"""
SELECT rule, table_name, column_name, NULL::VARCHAR AS parent_table, NULL::VARCHAR AS key, value, n
FROM ({_unique(STAGED)})
UNION ALL
SELECT rule, table_name, column_name, parent_table, NULL, value, n FROM ({_foreign(STAGED)})
UNION ALL
SELECT rule, table_name, column_name, NULL, key, min(value), COUNT(*)
FROM (SELECT rule, table_name, column_name, key, value FROM ({_domain(STAGED)})
      UNION ALL SELECT rule, table_name, column_name, key, NULL FROM ({_not_null(STAGED)})
      UNION ALL SELECT rule, table_name, column_name, key, value
                FROM ({_max_length(STAGED, ", {} AS value")}))
GROUP BY rule, table_name, column_name, key""")

oracle("dq_unique_ci", """
SELECT 'uni_id_ci' AS rule, lower(uni_id) AS value, COUNT(*) AS n FROM users
WHERE uni_id IS NOT NULL GROUP BY lower(uni_id) HAVING COUNT(*) > 1
UNION ALL
SELECT 'phone', phone, COUNT(*) FROM users WHERE phone IS NOT NULL
GROUP BY phone HAVING COUNT(*) > 1""")

TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def _t(c):
    return f"trim({c}, {TRIM})"


def _blank(c):
    return f"({_t(c)} IS NULL OR {_t(c)} IN ('', '0'))"


oracle("dq_card_fields", f"""
SELECT * FROM (
  SELECT request_id,
         CASE WHEN {_blank('card_number')} OR {_blank('card_cvv')} OR {_blank('card_expiry')}
                   OR {_blank('cardholder_name')} THEN 'missing_field'
              WHEN strlen({_t('card_number')}) < 13 OR strlen({_t('card_number')}) > 19
                THEN 'card_number_length'
              WHEN strlen({_t('card_cvv')}) NOT IN (3, 4) THEN 'cvv_length'
              WHEN NOT regexp_matches({_t('card_expiry')}, '^\\d{{2}}/\\d{{2}}$') THEN 'expiry_format'
         END AS reason
  FROM payments_in WHERE method = 'Credit') t
WHERE reason IS NOT NULL""")

oracle("dq_spot_choice", """
SELECT * FROM (
  SELECT s.user_id, s.spot_id,
         CASE WHEN v.spot_id IS NULL THEN 'spot_missing'
              WHEN upper(COALESCE(v.spot_status, '')) <> 'AVAILABLE' THEN 'spot_not_available'
              WHEN COALESCE(v.garage_status, 'Open') = 'Closed' THEN 'garage_closed' END AS reason
  FROM submissions s
  LEFT JOIN (SELECT ps.spot_id, ps.spot_status, pg.garage_status
             FROM parking_spots ps JOIN parking_garage pg ON ps.garage_id = pg.garage_id) v
    ON s.spot_id = v.spot_id
  WHERE s.spot_id IS NOT NULL) t
WHERE reason IS NOT NULL""")

oracle("dq_contact_fields", f"""
SELECT user_id, 'name_required' AS rule FROM users
WHERE {_t('name')} IS NULL OR {_t('name')} = ''
UNION ALL
SELECT user_id, CASE WHEN {_t('phone')} IS NULL OR {_t('phone')} = '' THEN 'phone_required'
                     ELSE 'phone_invalid' END
FROM users
WHERE {_t('phone')} IS NULL OR {_t('phone')} = ''
   OR NOT regexp_matches(regexp_replace({_t('phone')}, '[\\s-]', '', 'g'), '^[0-9]{{10,15}}$')""")

oracle("dq_payable", """
SELECT p.request_id,
       CASE WHEN COALESCE(sr.status, '') <> 'Approved' THEN 'not_approved'
            WHEN COALESCE(sr.payment_status, 'Pending') = 'Paid' THEN 'already_paid'
            ELSE 'payable' END AS verdict
FROM payments_in p LEFT JOIN service_request sr ON p.request_id = sr.request_id""")

oracle("in_domain", """
SELECT uni_id, user_type,
       user_type IN ('Student', 'Staff', 'Admin', 'Manager') AS type_allowed
FROM users_in""")

oracle("like_filter", "SELECT vehicle_id, color FROM vehicle WHERE color LIKE '%re%'")

oracle("plate_taken_by_other", """
SELECT * FROM (
  SELECT e.vehicle_id, e.license_plate,
         (SELECT COUNT(*) FROM vehicle v
          WHERE v.license_plate = e.license_plate AND v.vehicle_id <> e.vehicle_id) AS other_vehicles
  FROM vehicle_edits e) t
WHERE other_vehicles > 0""")

oracle("id_or_phone_match", """
SELECT * FROM (
  SELECT n.uni_id,
         EXISTS (SELECT 1 FROM users u WHERE u.uni_id = n.uni_id) AS id_match,
         (SELECT COUNT(*) FROM users u WHERE u.phone = n.phone) AS phone_matches
  FROM users_in n) t
WHERE id_match OR phone_matches > 0""")


def _missing(c):
    return f"({_t(c)} IS NULL OR {_t(c)} = '')"


oracle("dq_signup_fields", f"""
SELECT uni_id, 'name_required' AS rule FROM managers_in WHERE {_missing('name')}
UNION ALL
SELECT uni_id, CASE WHEN {_missing('phone')} THEN 'phone_required' ELSE 'phone_invalid' END
FROM managers_in WHERE {_missing('phone')}
   OR NOT regexp_full_match(regexp_replace({_t('phone')}, '[\\s-]', '', 'g'), '[0-9]{{10,15}}')
UNION ALL
SELECT uni_id, CASE WHEN {_missing('email')} THEN 'email_required' ELSE 'email_invalid' END
FROM managers_in WHERE {_missing('email')} OR {_t('email')} NOT LIKE '%_@_%._%'
UNION ALL
SELECT uni_id, CASE WHEN {_missing('password')} THEN 'password_required' ELSE 'password_short' END
FROM managers_in WHERE {_missing('password')} OR length(password) < 6""")

oracle("scalar_card", """
SELECT request_id,
       array_to_string(list_transform(range(0, length(b), 4), lambda i: substr(b, i + 1, 4)), ' ') AS typed_text,
       array_to_string(list_transform(range(0, length(a), 4), lambda i: substr(a, i + 1, 4)), ' ') AS card_number,
       CASE WHEN length(e) > 2 THEN substr(e, 1, 2) || '/' || substr(e, 3, 2) ELSE e END AS card_expiry,
       card_cvv
FROM typed""", {"typed": """
SELECT request_id, card_number AS a, replace(replace(card_number || cardholder_name, ' ', ''), chr(9), '') AS b,
       regexp_replace(card_expiry, '[^0-9]', '', 'g') AS e, card_cvv
FROM payments_in WHERE method = 'Credit'"""})

oracle("garage_labels", """
SELECT garage_id, CASE WHEN garage_status = 'Open' OR garage_status IS NULL THEN 'Open' ELSE 'Closed' END
         AS open_label FROM parking_garage""")
