"""The derived tables of ``sources/binding.py`` as SQL text for the checking engine.

Each entry is one table over the driver's parquet tables. ``compose`` puts the
entries that a statement mentions in front of it as common table expressions.
"""

from __future__ import annotations

import re

EVENT_METHOD = (
    "CASE event_type WHEN 'click' THEN 'CASH' WHEN 'error' THEN 'CARD' WHEN 'purchase' THEN 'BANK' "
    "WHEN 'signup' THEN 'DD' ELSE '{other}' END"
)
PAYMENT_TIME = "ts + (event_id % 12) * INTERVAL '30' DAY"

BINDINGS: dict[str, str] = {
    "d_customer_status": """
SELECT * FROM (VALUES ('ACT','Active'),('INA','Inactive'),('SUS','Suspended for non-payment'),
  ('PASS','Passed test - archived'),('LEAD','Prospective lead, not yet enrolled'))
  AS t(customer_status_code, customer_status_description)""",
    "d_lesson_status": """
SELECT * FROM (VALUES ('BOOK','Booked'),('CONF','Confirmed'),('COMP','Completed'),('CANC','Cancelled by customer'),
  ('NOSH','No show'),('RESC','Rescheduled')) AS t(lesson_status_code, lesson_status_description)""",
    "d_payment_methods": """
SELECT * FROM (VALUES ('CASH','Cash'),('CARD','Debit / Credit card'),('BANK','Bank transfer / Interac e-Transfer'),
  ('DD','Pre-authorized debit')) AS t(payment_method_code, payment_method_description)""",
    "d_app_roles": """
SELECT * FROM (VALUES ('ADMIN','Administrator'),('STAFF','Front-desk staff'),('REPORT','Reporting analyst'))
  AS t(role_code, role_name)""",
    "d_addresses": """
SELECT CAST(n_nationkey AS BIGINT) AS address_id, CONCAT('', n_nationkey) AS line_1_number_building,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS line_2_number_street,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CONCAT('Area ', n_regionkey) END AS line_3_area_locality,
  r_name AS city, CONCAT('Z', n_nationkey) AS zip_postcode,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE r_name END AS state_province_county, 'Canada' AS country,
  CAST(NULL AS VARCHAR) AS other_address_details
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "d_vehicles": """
SELECT p_partkey AS vehicle_id, CONCAT(p_name, ' - ', p_type, ' - Plate ', p_partkey) AS vehicle_details FROM part""",
    "d_staff": """
SELECT s_suppkey AS staff_id, CAST(s_nationkey AS BIGINT) AS staff_address_id,
  CASE WHEN s_suppkey % 5 = 0 THEN 'INA' ELSE 'ACT' END AS customer_status_code,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CONCAT('Nick', s_suppkey) END AS nickname,
  'Staff' AS first_name, CAST(NULL AS VARCHAR) AS middle_name, s_name AS last_name,
  CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE DATE '1960-01-01' + CAST((s_suppkey * 101) % 12000 AS INT) END AS date_of_birth,
  CAST(DATE '1994-01-01' + CAST((s_suppkey * 11) % 1000 AS INT) AS TIMESTAMP) AS date_joined_staff,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(DATE '2000-01-01' + CAST(s_suppkey % 300 AS INT) AS TIMESTAMP) END AS date_left_staff,
  CASE WHEN s_suppkey % 7 = 2 THEN 'Office administrator - not an instructor' WHEN s_suppkey % 7 = 3 THEN NULL
       WHEN s_suppkey % 7 = 4 THEN 'Administrator' ELSE 'Licensed instructor' END AS other_staff_details
FROM supplier""",
    "d_customers": """
SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS customer_address_id,
  CASE c_custkey % 10 WHEN 6 THEN 'LEAD' WHEN 7 THEN 'INA' WHEN 8 THEN 'SUS' WHEN 9 THEN 'PASS' ELSE 'ACT' END AS customer_status_code,
  DATE '2022-01-01' + CAST((c_custkey * 7) % 730 AS INT) AS date_became_customer,
  DATE '1980-01-01' + CAST((c_custkey * 37) % 7000 AS INT) AS date_of_birth,
  c_mktsegment AS first_name, c_name AS last_name,
  CAST(GREATEST(c_acctbal, 0) AS DECIMAL(10,2)) AS amount_outstanding,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CONCAT(LOWER(c_mktsegment), '.', c_custkey, '@example.ca') END AS email_address,
  CAST(NULL AS VARCHAR) AS phone_number,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN 'ext. none' ELSE CONCAT('(587) 555-', 1000 + c_custkey % 9000) END AS cell_mobile_phone_number,
  CAST(NULL AS VARCHAR) AS other_customer_details
FROM customer""",
    "d_lessons": """
SELECT o_orderkey AS lesson_id, o_custkey AS customer_id,
  CASE o_orderkey % 10 WHEN 0 THEN 'BOOK' WHEN 1 THEN 'CONF' WHEN 2 THEN 'CANC' WHEN 3 THEN 'NOSH' WHEN 4 THEN 'RESC' ELSE 'COMP' END AS lesson_status_code,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey * 7 + o_custkey) % (SELECT COUNT(*) FROM supplier) END AS staff_id,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey + 3 * o_custkey) % (SELECT COUNT(*) FROM part) END AS vehicle_id,
  CAST(o_orderdate AS DATE) AS lesson_date, CAST((9 + o_custkey % 3) * 3600 AS BIGINT) AS lesson_time_sec,
  CAST(o_totalprice AS DECIMAL(10,2)) AS price, o_orderpriority AS other_lesson_details
FROM orders""",
    "d_payments": f"""
SELECT user_id AS customer_id, {PAYMENT_TIME} AS datetime_payment,
  {EVENT_METHOD.format(other='VOUCH')} AS payment_method_code,
  CAST(value AS DECIMAL(10,2)) AS amount_payment, props AS other_payment_details
FROM events""",
    "d_app_users": """
SELECT s_suppkey AS user_id, CONCAT('user', s_suppkey, '@example.ca') AS email, s_name AS full_name, s_suppkey % 8 <> 3 AS is_active,
  CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS staff_id, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey END AS customer_id,
  CAST(DATE '2023-01-01' + CAST(s_suppkey % 365 AS INT) AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS last_login_at
FROM supplier""",
    "d_app_user_roles": """
SELECT s_suppkey AS user_id, r.role_code, CAST(DATE '2023-06-01' + CAST(s_suppkey % 100 AS INT) AS TIMESTAMP) AS assigned_at
FROM supplier CROSS JOIN (VALUES (0,'ADMIN'),(1,'STAFF'),(2,'REPORT')) AS r(i, role_code)
WHERE (s_suppkey + r.i) % 4 = 0 OR (s_suppkey % 6 = 0 AND r.i = 1)""",
    "d_login_attempts": """
SELECT event_id AS attempt_id, CONCAT('user', user_id, '@example.ca') AS email, ts AS attempted_at,
  event_type IN ('purchase','view') AS password_ok FROM events""",
    "d_lesson_versions": """
SELECT o_orderkey AS lesson_id, CAST(v.version AS BIGINT) AS version,
  CASE (o_orderkey + v.version * (o_orderkey % 3)) % 6 WHEN 0 THEN 'BOOK' WHEN 1 THEN 'CONF' WHEN 2 THEN 'COMP' WHEN 3 THEN 'CANC' WHEN 4 THEN 'NOSH' ELSE 'RESC' END AS lesson_status_code
FROM orders CROSS JOIN (VALUES (1),(2),(3)) AS v(version)""",
    "d_app_login_audit": """
SELECT event_id AS audit_id, CONCAT('user', user_id, '@example.ca') AS email, user_id, event_type IN ('purchase','view') AS success,
  CASE WHEN event_type IN ('purchase','view') THEN 'ok' ELSE 'bad password' END AS detail, ts AS attempted_at FROM events""",
    "d_lesson_audit_log": """
SELECT o_orderkey AS audit_id, CASE WHEN o_orderkey % 1000 = 999 THEN o_orderkey + 100000000 ELSE o_orderkey END AS lesson_id,
  'BOOK' AS old_status, CASE WHEN o_orderstatus = 'F' THEN 'COMP' ELSE 'CONF' END AS new_status, o_orderdate AS changed_at, 'system' AS changed_by
FROM orders""",
    "d_booking_requests": """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS customer_id,
  CASE WHEN o_orderkey % 35 = 0 THEN NULL WHEN o_orderkey % 55 = 0 THEN -1 ELSE (o_orderkey * 3 + o_custkey) % (SELECT COUNT(*) FROM supplier) END AS staff_id,
  CASE WHEN o_orderkey % 65 = 0 THEN NULL ELSE (o_orderkey + o_custkey) % 60 END AS vehicle_id,
  DATE '2001-05-30' + CAST((o_orderkey // 5) % 30 AS INT) AS lesson_date,
  CAST((9 + o_custkey % 7) * 3600 AS BIGINT) AS lesson_time_sec,
  CASE WHEN o_orderkey % 29 = 0 THEN CAST(-1 AS DECIMAL(10,2)) ELSE CAST(o_totalprice AS DECIMAL(10,2)) END AS price
FROM orders""",
    "d_payment_requests": f"""
SELECT event_id AS request_id, CASE WHEN event_id % 11 = 0 THEN user_id + 10000000 ELSE user_id END AS customer_id,
  ts AS datetime_payment, {EVENT_METHOD.format(other='XXX')} AS payment_method_code,
  CASE WHEN event_id % 13 = 0 THEN CAST(0 AS DECIMAL(10,2)) WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS DECIMAL(10,2)) END AS amount,
  CASE WHEN event_id % 4 <> 0 THEN props END AS details
FROM events""",
    "d_payment_corrections": f"""
SELECT event_id + n.i * 10000000000 AS request_id, user_id AS customer_id,
  {PAYMENT_TIME} + CASE WHEN event_id % 10 = 7 THEN INTERVAL '1' SECOND ELSE INTERVAL '0' SECOND END
    + to_minutes(CAST(CASE WHEN event_id % 4 = 1 THEN 5 * n.i ELSE 0 END AS INT)) AS original_datetime,
  {PAYMENT_TIME} + to_minutes(CAST(CASE event_id % 4 WHEN 1 THEN 5 * (n.i + 1) WHEN 2 THEN -5 * n.i ELSE 0 END AS INT)) AS new_datetime,
  {EVENT_METHOD.format(other='CASH')} AS payment_method_code,
  CASE WHEN (event_id + n.i) % 13 = 0 THEN CAST(0 AS DECIMAL(10,2)) WHEN (event_id + n.i) % 19 = 0 THEN NULL
       ELSE CAST(value + (event_id % 5 - 2 + n.i) * 10 AS DECIMAL(10,2)) END AS amount,
  CASE WHEN event_id % 3 <> 0 THEN CONCAT('corrected ', event_id, ' ', n.i) END AS details
FROM events JOIN (VALUES (0), (1), (2)) AS n(i) ON n.i <= event_id % 3 // 2 + event_id % 5 // 4""",
    "d_cancel_requests": """
SELECT o_orderkey * 2 + k.i AS request_id, CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS lesson_id
FROM orders CROSS JOIN (VALUES (0),(1)) AS k(i) WHERE k.i = 0 OR o_orderkey % 4 = 0""",
    "d_lesson_changes": """
SELECT lesson_id + n.i * 10000000000 AS request_id, CASE WHEN (lesson_id + n.i) % 37 = 0 THEN lesson_id + 100000000 ELSE lesson_id END AS lesson_id,
  customer_id, staff_id - CASE WHEN n.i = 1 THEN staff_id % 3 ELSE 0 END AS staff_id,
  CASE WHEN n.i = 2 THEN vehicle_id - vehicle_id % 2 ELSE vehicle_id END AS vehicle_id,
  lesson_date + CAST((lesson_id + n.i) % 3 * CASE WHEN lesson_id % 2 = 0 THEN 1 ELSE -1 END AS INT) AS lesson_date,
  lesson_time_sec, CAST(CASE WHEN (lesson_id + n.i) % 41 = 0 THEN -1 ELSE price + lesson_id % 3 + n.i END AS DECIMAL(10,2)) AS price,
  CONCAT('change ', n.i) AS other_lesson_details,
  CASE (lesson_id + n.i) % 6 WHEN 1 THEN 'CANC' WHEN 2 THEN 'COMP' WHEN 4 THEN 'BOOK' END AS lesson_status_code
FROM d_lessons JOIN (VALUES (0), (1), (2), (3)) AS n(i) ON n.i <= CASE WHEN lesson_id % 4 = 0 THEN lesson_id // 4 % 4 ELSE 0 END""",
    "d_address_requests": """
SELECT c_custkey AS request_id, r_name AS city, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Canada' END AS country,
  CONCAT('', n_nationkey) AS line_1_number_building, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS line_2_number_street,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CONCAT('Area ', n_regionkey) END AS line_3_area_locality,
  CASE WHEN c_custkey % 5 = 0 THEN CONCAT('N', c_custkey % 40) ELSE CONCAT('Z', n_nationkey) END AS zip_postcode,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE r_name END AS state_province_county
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "d_address_needles": """
SELECT c_custkey AS search_id, CASE WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 2 = 0 THEN CONCAT(' z', c_nationkey)
  WHEN c_custkey % 3 = 0 THEN CONCAT('ation_', c_nationkey % 10) ELSE SUBSTR(c_mktsegment, 1, 2) END AS needle
FROM customer""",
    "d_customer_changes": """
SELECT c_custkey + n.i * 10000000000 AS request_id,
  CASE (c_custkey + n.i * (c_custkey % 5)) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS op,
  CASE WHEN (c_custkey + n.i * (c_custkey % 5)) % 3 <> 0 THEN c_custkey END AS customer_id,
  CASE WHEN c_custkey % 21 <> 0 THEN CONCAT('New', c_custkey) END AS first_name, c_name AS last_name,
  CASE WHEN c_custkey % 25 <> 0 THEN DATE '1985-01-01' + CAST(c_custkey % 5000 AS INT) END AS date_of_birth,
  DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS date_became_customer,
  CASE WHEN c_custkey % 26 = 0 THEN 'NOPE' ELSE 'ACT' END AS customer_status_code,
  CASE WHEN (c_custkey + n.i) % 12 = 0 THEN 'not-an-address' WHEN (c_custkey + n.i) % 10 = 1 THEN NULL
       WHEN (c_custkey + n.i) % 9 = 2 THEN CONCAT('shared', c_custkey // 50, '@example.ca')
       WHEN (c_custkey + n.i) % 8 = 3 THEN CONCAT(LOWER(c_mktsegment), '.', c_custkey + CASE WHEN n.i = 2 THEN 3 ELSE 0 END, '@example.ca')
       ELSE CONCAT('new', c_custkey, '@example.ca') END AS email_address,
  CASE c_custkey % 14 WHEN 3 THEN 'call me' WHEN 4 THEN '12345' WHEN 5 THEN NULL ELSE '+1 587 555 0100' END AS cell_mobile_phone_number,
  CASE WHEN c_custkey % 16 <> 0 THEN CONCAT('B', c_custkey % 90) END AS line_1_number_building,
  CASE WHEN c_custkey % 4 <> 0 THEN 'Calgary' END AS city,
  CASE WHEN c_custkey % 4 <> 0 THEN CONCAT('T', c_custkey % 90) END AS zip_postcode
FROM customer JOIN (VALUES (0), (1), (2)) AS n(i) ON n.i <= CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 2 % 3 ELSE 0 END""",
    "d_staff_changes": """
SELECT s_suppkey * 4 + i AS request_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'add' WHEN s_suppkey % 4 = 3 AND i = s_suppkey % 3 THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS staff_id,
  CASE WHEN (s_suppkey + i) % 18 = 0 THEN 'NOPE' ELSE 'ACT' END AS customer_status_code,
  CASE WHEN (s_suppkey + i) % 5 <> 0 THEN CONCAT('First', s_suppkey, '-', i) END AS first_name, s_name AS last_name,
  CASE WHEN s_suppkey % 22 <> 0 THEN CAST(DATE '2010-01-01' + CAST(s_suppkey % 900 AS INT) AS TIMESTAMP) END AS date_joined_staff,
  CASE WHEN s_suppkey % 6 = 1 THEN TIMESTAMP '2011-01-01 00:00:00' END AS date_left_staff
FROM supplier JOIN (VALUES (0), (1), (2), (3)) AS n(i) ON i <= s_suppkey // 2 % 4""",
    "d_role_requests": """
SELECT event_id AS request_id, user_id,
  CASE event_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'Staff' WHEN 2 THEN 'REPORT' WHEN 3 THEN 'report' ELSE 'owner' END AS role_code,
  CASE WHEN event_type = 'error' THEN 'revoke' ELSE 'assign' END AS action, ts AS requested_at
FROM events""",
    "d_registration_requests": """
SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 17 = 0 THEN '@nobody.ca' WHEN c_custkey % 19 = 0 THEN NULL
       WHEN c_custkey % 5 = 0 THEN CONCAT(' USER', c_custkey, '@Example.ca ')
       WHEN c_custkey % 7 = 0 THEN CONCAT('group', c_custkey // 40, '@example.ca')
       ELSE CONCAT('Person', c_custkey, '@example.ca') END AS email,
  CASE WHEN c_custkey % 23 <> 0 THEN c_name END AS full_name,
  CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 30 + 4 END AS password_length,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'admin' WHEN 2 THEN 'Report' WHEN 3 THEN 'guest' ELSE 'STAFF' END AS role_code
FROM customer""",
    "d_user_delete_requests": "SELECT event_id AS request_id, user_id FROM events",
}


def compose(ctes: str, select: str) -> str:
    """A full statement: the bindings it needs, its own expressions, and the final select."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bd_[a-z_]+\b", text):
            if name in BINDINGS and name not in needed:
                visit(BINDINGS[name])
                needed.append(name)

    visit(ctes + " " + select)
    parts = [f"{name} AS ({BINDINGS[name].strip()})" for name in needed]
    if ctes.strip():
        parts.append(ctes.strip())
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + select.strip()
