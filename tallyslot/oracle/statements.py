"""One checking statement per registered query.

The statements are written independently of the Spark plans: means and
percentages use whole-number arithmetic, order-dependent rules use recursion.
"""

from __future__ import annotations

from tallyslot.oracle.bindings import compose


# --- text macros -------------------------------------------------------------
def name_of(alias: str) -> str:
    return f"COALESCE({alias}.first_name, '') || ' ' || COALESCE({alias}.last_name, '')"


def years(born: str) -> str:
    return (
        f"CAST(2001 - date_part('year', {born}) - "
        f"CASE WHEN strftime({born}, '%m%d') > '0601' THEN 1 ELSE 0 END AS BIGINT)"
    )


def pct(part: str, whole: str, digits: int) -> str:
    scale = 10**digits
    return (
        f"CASE WHEN ({whole}) > 0 THEN CAST((200 * {scale} * ({part}) + ({whole})) // (2 * ({whole})) AS DOUBLE) "
        f"/ {scale}.0 END"
    )


def cents(c: str) -> str:
    return f"CAST(({c}) * 100 AS HUGEINT)"


def mean(c: str, digits: int = 2) -> str:
    """Mean of non-negative money, rounded half up."""
    extra = 10 ** (digits - 2)
    return f"CAST((2 * {extra} * SUM({cents(c)}) + COUNT({c})) // (2 * COUNT({c})) AS DOUBLE) / {10**digits}.0"


def money(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def clock(sec: str) -> str:
    return f"lpad(CAST({sec} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({sec} % 3600 // 60 AS VARCHAR), 2, '0')"


def starts(date: str, sec: str) -> str:
    return f"CAST({date} AS TIMESTAMP) + to_seconds({sec})"


def ca(c: str) -> str:
    return f"'CA$' || CAST(CAST(COALESCE({c}, 0) AS DECIMAL(18,2)) AS VARCHAR)"


CUSTOMER_COLOUR = (
    "CASE {c} WHEN 'ACT' THEN 'green' WHEN 'PASS' THEN 'blue' WHEN 'SUS' THEN 'red' WHEN 'LEAD' THEN 'amber' ELSE 'grey' END"
)
LESSON_COLOUR = (
    "CASE {c} WHEN 'Completed' THEN 'green' WHEN 'Confirmed' THEN 'blue' WHEN 'Booked' THEN 'amber' "
    "WHEN 'No show' THEN 'red' ELSE 'grey' END"
)
BAND = "CASE WHEN {b} <= 0 THEN 'Paid up' WHEN {b} < 40 THEN 'Minor balance' ELSE 'Chase for payment' END"
TODAY, NOW = "DATE '2001-06-01'", "TIMESTAMP '2001-06-01 12:00:00'"

# --- shared expressions ------------------------------------------------------
PAID = "paid AS (SELECT customer_id, SUM(amount_payment) AS total, MAX(datetime_payment) AS latest FROM d_payments GROUP BY 1)"
BALANCE = f"""
{PAID},
billed AS (SELECT customer_id, SUM(price) AS total FROM d_lessons WHERE lesson_status_code IN ('COMP','NOSH') GROUP BY 1),
balance AS (
  SELECT c.customer_id, {name_of('c')} AS customer_name, COALESCE(b.total, 0) AS charged, COALESCE(p.total, 0) AS paid,
    COALESCE(b.total, 0) - COALESCE(p.total, 0) AS calculated, c.amount_outstanding AS stored
  FROM d_customers c LEFT JOIN billed b USING (customer_id) LEFT JOIN paid p USING (customer_id))"""
WORKLOAD = f"""
workload AS (
  SELECT s.staff_id, {name_of('s')} AS instructor_name, COUNT(l.lesson_id) AS total,
    SUM(CASE WHEN l.lesson_status_code = 'COMP' THEN 1 ELSE 0 END) AS completed,
    SUM(CASE WHEN l.lesson_status_code = 'CANC' THEN 1 ELSE 0 END) AS cancelled,
    SUM(CASE WHEN l.lesson_status_code IN ('COMP','NOSH') THEN l.price ELSE 0 END) AS revenue
  FROM d_staff s LEFT JOIN d_lessons l ON l.staff_id = s.staff_id GROUP BY ALL)"""
DETAILS = f"""
details AS (
  SELECT l.lesson_id, l.lesson_date, l.lesson_time_sec, l.price, t.lesson_status_description AS status,
    {name_of('c')} AS customer_name, {name_of('s')} AS instructor_name, v.vehicle_details, l.other_lesson_details
  FROM d_lessons l JOIN d_customers c ON c.customer_id = l.customer_id
  JOIN d_lesson_status t ON t.lesson_status_code = l.lesson_status_code
  LEFT JOIN d_staff s ON s.staff_id = l.staff_id LEFT JOIN d_vehicles v ON v.vehicle_id = l.vehicle_id)"""
DETAIL_COLUMNS = (
    "lesson_id, lesson_date, lesson_time_sec, CAST(price AS DOUBLE) AS price, status, customer_name, instructor_name, "
    "vehicle_details, other_lesson_details"
)
MONTHLY = """
monthly AS (
  SELECT strftime(p.datetime_payment, '%Y-%m') AS pay_month, m.payment_method_description AS method,
    COUNT(*) AS n, SUM(p.amount_payment) AS total
  FROM d_payments p JOIN d_payment_methods m ON m.payment_method_code = p.payment_method_code GROUP BY 1, 2)"""
FLEET = """
fleet AS (
  SELECT v.vehicle_id, v.vehicle_details, COUNT(l.lesson_id) AS assigned,
    COUNT(*) FILTER (WHERE l.lesson_status_code = 'COMP') AS completed,
    COALESCE(SUM(l.price) FILTER (WHERE l.lesson_status_code = 'COMP'), 0) AS revenue
  FROM d_vehicles v LEFT JOIN d_lessons l ON l.vehicle_id = v.vehicle_id GROUP BY 1, 2)"""
ROLE_TEXT = "role_text AS (SELECT user_id, string_agg(role_code, ',' ORDER BY role_code) AS roles FROM d_app_user_roles GROUP BY 1)"


def health(excluded: str) -> tuple[str, str]:
    return (
        f"""
totals AS (SELECT COUNT(*) AS n, COALESCE(SUM(amount_outstanding), 0) AS owed,
    COUNT(*) FILTER (WHERE amount_outstanding > 0) AS owing FROM d_customers WHERE customer_status_code NOT IN ({excluded})),
taken AS (SELECT COALESCE(SUM(amount_payment), 0) AS money FROM d_payments)""",
        f"""
SELECT n AS total_active_customers, {money('owed')} AS total_outstanding, {money('money')} AS lifetime_collections,
  {pct(cents('money'), cents('owed + money'), 2)} AS collection_rate_percent, owing AS customers_with_balance,
  {pct('owing', 'n', 2)} AS percent_customers_owing
FROM totals, taken""",
    )


def lifecycle(active: str, inactive: str) -> tuple[str, str]:
    return (
        PAID,
        f"""
SELECT CAST(date_trunc('month', c.date_became_customer) AS DATE) AS acquisition_month, COUNT(*) AS new_customers_acquired,
  {money('SUM(COALESCE(p.total, 0))')} AS cohort_lifetime_revenue, {mean('COALESCE(p.total, 0)')} AS avg_customer_lifetime_value,
  COUNT(*) FILTER (WHERE c.customer_status_code = '{active}') AS still_active,
  COUNT(*) FILTER (WHERE c.customer_status_code = '{inactive}') AS became_inactive,
  COUNT(*) FILTER (WHERE c.amount_outstanding > 0) AS currently_owe_balance,
  COUNT(*) FILTER (WHERE c.customer_id IN (SELECT customer_id FROM d_lessons)) AS customers_with_lessons
FROM d_customers c LEFT JOIN paid p USING (customer_id) GROUP BY 1""",
    )


def segments(active: str, repeated: bool) -> tuple[str, str]:
    if repeated:
        value = """
metric AS (
  SELECT c.customer_id, c.amount_outstanding AS owes, COALESCE(SUM(p.amount_payment), 0) AS value
  FROM d_customers c LEFT JOIN d_payments p ON p.customer_id = c.customer_id
  LEFT JOIN d_lessons l ON l.customer_id = c.customer_id AND l.lesson_status_code IN ('COMP','CONF')
  WHERE c.customer_status_code = '{a}' GROUP BY 1, 2)"""
    else:
        value = "metric AS (SELECT customer_id, owes, plain AS value FROM worth)"
    return (
        f"""
{PAID},
worth AS (SELECT c.customer_id, c.amount_outstanding AS owes, COALESCE(p.total, 0) AS plain
  FROM d_customers c LEFT JOIN paid p USING (customer_id) WHERE c.customer_status_code = '{active}'),
marks AS (SELECT quantile_cont(CAST(plain AS DOUBLE), 0.75) AS upper, quantile_cont(CAST(plain AS DOUBLE), 0.5) AS middle FROM worth),
{value.format(a=active).strip()},
picked AS (
  SELECT 'High Value' AS segment, value, owes FROM metric, marks WHERE CAST(value AS DOUBLE) >= upper
  UNION ALL
  SELECT 'At Risk', value, owes FROM metric, marks WHERE owes > 500 AND CAST(value AS DOUBLE) < middle)""",
        f"""
SELECT s.segment, COUNT(p.value) AS customer_count,
  CASE WHEN COUNT(p.value) > 0 THEN {mean('p.value')} END AS avg_lifetime_value,
  {money('SUM(p.value)')} AS segment_total_value,
  CASE WHEN COUNT(p.value) > 0 THEN {mean('p.owes')} END AS avg_outstanding,
  COUNT(*) FILTER (WHERE p.owes > 0) AS customers_owing
FROM (VALUES ('High Value'), ('At Risk')) AS s(segment) LEFT JOIN picked p USING (segment) GROUP BY 1""",
    )


def completion(pending: str) -> tuple[str, str]:
    done = "lesson_status_code IN ('COMP','CONF')"
    return (
        f"recent AS (SELECT * FROM d_lessons WHERE lesson_date >= {TODAY} - INTERVAL '90' DAY)",
        f"""
SELECT COUNT(*) AS total_lessons, COUNT(*) FILTER (WHERE {done}) AS completed,
  COUNT(*) FILTER (WHERE lesson_status_code = 'CANC') AS cancelled,
  COUNT(*) FILTER (WHERE lesson_status_code = 'RESC') AS rescheduled,
  COUNT(*) FILTER (WHERE lesson_status_code = '{pending}') AS pending,
  {pct(f"COUNT(*) FILTER (WHERE {done})", 'COUNT(*)', 1)} AS completion_rate_percent,
  {pct("COUNT(*) FILTER (WHERE lesson_status_code = 'CANC')", 'COUNT(*)', 1)} AS cancellation_rate_percent,
  {money('SUM(price)')} AS total_lesson_revenue, {money(f'SUM(CASE WHEN {done} THEN price ELSE 0 END)')} AS completed_revenue,
  {money("SUM(CASE WHEN lesson_status_code = 'CANC' THEN price ELSE 0 END)")} AS lost_revenue_cancelled
FROM recent""",
    )


# --- order-dependent rules ---------------------------------------------------
BOOKED = f"""
held_staff AS (SELECT DISTINCT staff_id, lesson_date, lesson_time_sec FROM d_lessons WHERE lesson_status_code <> 'CANC' AND staff_id IS NOT NULL),
held_vehicle AS (SELECT DISTINCT vehicle_id, lesson_date, lesson_time_sec FROM d_lessons WHERE lesson_status_code <> 'CANC' AND vehicle_id IS NOT NULL),
judged AS (
  SELECT r.*, hs.staff_id IS NOT NULL AS s_held, hv.vehicle_id IS NOT NULL AS v_held,
    CASE WHEN NOT EXISTS (SELECT 1 FROM d_customers c WHERE c.customer_id = r.customer_id AND c.customer_status_code = 'ACT') THEN 'customer_not_active'
      WHEN r.staff_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_staff s WHERE s.staff_id = r.staff_id) THEN 'staff_missing'
      WHEN r.vehicle_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_vehicles v WHERE v.vehicle_id = r.vehicle_id) THEN 'vehicle_missing'
      WHEN {starts('r.lesson_date', 'r.lesson_time_sec')} <= {NOW} THEN 'in_past' END AS early
  FROM d_booking_requests r
  LEFT JOIN held_staff hs ON hs.staff_id = r.staff_id AND hs.lesson_date = r.lesson_date AND hs.lesson_time_sec = r.lesson_time_sec
  LEFT JOIN held_vehicle hv ON hv.vehicle_id = r.vehicle_id AND hv.lesson_date = r.lesson_date AND hv.lesson_time_sec = r.lesson_time_sec),
queue AS (SELECT *, row_number() OVER (PARTITION BY lesson_date, lesson_time_sec ORDER BY request_id) AS turn FROM judged WHERE early IS NULL),
walk AS (
  SELECT DISTINCT lesson_date, lesson_time_sec, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS staff, CAST([] AS BIGINT[]) AS cars,
    CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reason FROM queue
  UNION ALL
  SELECT lesson_date, lesson_time_sec, turn,
    CASE WHEN reason IS NULL AND staff_id IS NOT NULL THEN list_append(staff, staff_id) ELSE staff END,
    CASE WHEN reason IS NULL AND vehicle_id IS NOT NULL THEN list_append(cars, vehicle_id) ELSE cars END, request_id, reason
  FROM (
    SELECT q.lesson_date, q.lesson_time_sec, q.turn, q.request_id, q.staff_id, q.vehicle_id, w.staff, w.cars,
      CASE WHEN q.s_held OR (q.staff_id IS NOT NULL AND list_contains(w.staff, q.staff_id)) THEN 'staff_conflict'
        WHEN q.v_held OR (q.vehicle_id IS NOT NULL AND list_contains(w.cars, q.vehicle_id)) THEN 'vehicle_conflict'
        WHEN q.price < 0 THEN 'price_invalid' END AS reason
    FROM walk w JOIN queue q ON q.lesson_date = w.lesson_date AND q.lesson_time_sec = w.lesson_time_sec AND q.turn = w.turn + 1) AS step),
answer AS (
  SELECT request_id, reason FROM walk WHERE turn > 0 UNION ALL SELECT request_id, early FROM judged WHERE early IS NOT NULL)"""

CANCELLED = f"""
staff_load AS (SELECT staff_id, lesson_date, lesson_time_sec, COUNT(*) AS n FROM d_lessons WHERE lesson_status_code <> 'CANC' GROUP BY 1, 2, 3),
vehicle_load AS (SELECT vehicle_id, lesson_date, lesson_time_sec, COUNT(*) AS n FROM d_lessons WHERE lesson_status_code <> 'CANC' GROUP BY 1, 2, 3),
seen AS (
  SELECT r.request_id, r.lesson_id, l.customer_id, l.price, {starts('l.lesson_date', 'l.lesson_time_sec')} AS begins,
    CASE WHEN l.lesson_id IS NULL OR NOT EXISTS (SELECT 1 FROM d_customers c WHERE c.customer_id = l.customer_id) THEN 'lesson_missing'
      WHEN l.lesson_status_code = 'CANC' THEN 'already_cancelled'
      WHEN l.lesson_status_code = 'COMP' THEN 'already_completed'
      WHEN s.n > 1 THEN 'staff_conflict' WHEN v.n > 1 THEN 'vehicle_conflict' END AS fail
  FROM d_cancel_requests r LEFT JOIN d_lessons l ON l.lesson_id = r.lesson_id
  LEFT JOIN staff_load s ON s.staff_id = l.staff_id AND s.lesson_date = l.lesson_date AND s.lesson_time_sec = l.lesson_time_sec
  LEFT JOIN vehicle_load v ON v.vehicle_id = l.vehicle_id AND v.lesson_date = l.lesson_date AND v.lesson_time_sec = l.lesson_time_sec),
answer AS (
  SELECT request_id, lesson_id, customer_id, price,
    COALESCE(fail, CASE WHEN row_number() OVER (PARTITION BY lesson_id ORDER BY request_id) > 1 THEN 'already_cancelled' END) AS reason,
    CASE WHEN begins > {NOW} + INTERVAL '24' HOUR THEN 0 ELSE ({cents('price')} + 1) // 2 / 100.0 END AS fee
  FROM seen)"""

def linked(touched: str) -> str:
    """``queue``: the rows of ``touched`` (``request_id, keys``) with the component that shared keys put them in, and their turn there."""
    return f"""
spots AS (SELECT request_id, unnest(keys) AS key FROM {touched}),
firsts AS (SELECT key, MIN(request_id) AS first FROM spots GROUP BY key),
ties AS (SELECT DISTINCT s.request_id AS a, f.first AS b FROM spots s JOIN firsts f USING (key) WHERE s.request_id <> f.first),
ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach(a, b) AS (SELECT request_id, request_id FROM {touched} UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
tied AS (SELECT a AS request_id, MIN(b) AS component FROM reach GROUP BY a),
queue AS (SELECT t.*, p.component, row_number() OVER (PARTITION BY p.component ORDER BY request_id) AS turn FROM {touched} t JOIN tied p USING (request_id))"""


def named(kind: str, resource: str, date: str = "lesson_date", time: str = "lesson_time_sec") -> str:
    return f"CONCAT('{kind}', {resource}, '@', {date}, ' ', {time})"


# Requests of a component are walked one by one with a map of what the tables hold under their keys.
UPDATED = f"""
busy AS (SELECT * FROM d_lessons WHERE lesson_status_code <> 'CANC'),
slot_load AS (
  SELECT {named('S', 'staff_id')} AS key, COUNT(*) AS n FROM busy WHERE staff_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT {named('V', 'vehicle_id')}, COUNT(*) FROM busy WHERE vehicle_id IS NOT NULL GROUP BY 1),
judged AS (
  SELECT r.*, CASE WHEN l.lesson_id IS NULL THEN 'lesson_missing' END AS early,
    CASE WHEN r.price < 0 THEN 'price_invalid' WHEN r.customer_id NOT IN (SELECT customer_id FROM d_customers)
      OR COALESCE(r.staff_id NOT IN (SELECT staff_id FROM d_staff), false)
      OR COALESCE(r.vehicle_id NOT IN (SELECT vehicle_id FROM d_vehicles), false) THEN 'unknown_reference' END AS late,
    CASE WHEN r.staff_id IS NOT NULL THEN {named('S', 'r.staff_id', 'r.lesson_date', 'r.lesson_time_sec')} ELSE 'S' END AS s,
    CASE WHEN r.vehicle_id IS NOT NULL THEN {named('V', 'r.vehicle_id', 'r.lesson_date', 'r.lesson_time_sec')} ELSE 'V' END AS v,
    CASE WHEN l.staff_id IS NOT NULL THEN {named('S', 'l.staff_id', 'l.lesson_date', 'l.lesson_time_sec')} ELSE 'S' END AS own_s,
    CASE WHEN l.vehicle_id IS NOT NULL THEN {named('V', 'l.vehicle_id', 'l.lesson_date', 'l.lesson_time_sec')} ELSE 'V' END AS own_v,
    l.lesson_status_code AS was
  FROM d_lesson_changes r LEFT JOIN d_lessons l ON l.lesson_id = r.lesson_id),
touched AS (
  SELECT *, list_filter(list_distinct([CONCAT('L', lesson_id), s, v, own_s, own_v]), lambda k: k NOT IN ('S', 'V')) AS keys FROM judged WHERE early IS NULL),
{linked('touched').strip()},
held AS (
  SELECT component, map_from_entries(list((key, n))) AS load FROM (
    SELECT DISTINCT q.component, x.key, COALESCE(x.n, 0) AS n
    FROM queue q JOIN spots USING (request_id) JOIN (SELECT DISTINCT p.key, n FROM spots p LEFT JOIN slot_load USING (key)) x ON x.key = spots.key) GROUP BY component),
owned AS (
  SELECT component, map_from_entries(list((lesson_id, row(own_s, own_v, was)))) AS own FROM (
    SELECT DISTINCT component, lesson_id, own_s, own_v, was FROM queue) GROUP BY component),
walk AS (
  SELECT component, CAST(0 AS BIGINT) AS turn, load, own, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS found
  FROM held JOIN owned USING (component)
  UNION ALL
  SELECT component, turn,
    CASE WHEN reason IS NULL THEN map_concat(freed, CASE WHEN status <> 'CANC' THEN map_from_entries([(s, COALESCE(freed[s], 0) + 1), (v, COALESCE(freed[v], 0) + 1)]) ELSE map_from_entries([(s, COALESCE(freed[s], 0))]) END) ELSE load END,
    CASE WHEN reason IS NULL THEN map_concat(own, map_from_entries([(lesson_id, row(s, v, status))])) ELSE own END, request_id, reason, found
  FROM (
    SELECT component, turn, load, own, request_id, lesson_id, s, v, COALESCE(lesson_status_code, now[3]) AS status, now[3] AS found, freed,
      CASE WHEN s <> 'S' AND COALESCE(freed[s], 0) > 0 AND NOT (s = now[1] AND COALESCE(load[s], 0) = 1 AND now[3] <> 'CANC') THEN 'staff_conflict'
        WHEN v <> 'V' AND COALESCE(freed[v], 0) > 0 AND NOT (v = now[2] AND COALESCE(load[v], 0) = 1 AND now[3] <> 'CANC') THEN 'vehicle_conflict' ELSE late END AS reason
    FROM (
      SELECT w.component, q.turn, w.load, w.own, q.request_id, q.lesson_id, q.s, q.v, q.lesson_status_code, q.late, w.own[q.lesson_id] AS now,
        CASE WHEN w.own[q.lesson_id][3] <> 'CANC' THEN map_concat(w.load, map_from_entries([
          (w.own[q.lesson_id][1], COALESCE(w.load[w.own[q.lesson_id][1]], 0) - 1), (w.own[q.lesson_id][2], COALESCE(w.load[w.own[q.lesson_id][2]], 0) - 1)])) ELSE w.load END AS freed
      FROM walk w JOIN queue q ON q.component = w.component AND q.turn = w.turn + 1) AS step) AS ruled),
verdict AS (
  SELECT request_id, reason, found FROM walk WHERE turn > 0 UNION ALL SELECT request_id, early, NULL FROM judged WHERE early IS NOT NULL)"""

AUDIT = """
steps AS (SELECT lesson_id, version, lesson_status_code AS now, lag(lesson_status_code) OVER (PARTITION BY lesson_id ORDER BY version) AS was FROM d_lesson_versions),
audit AS (SELECT lesson_id, version, was AS old_status, now AS new_status, 'system' AS changed_by FROM steps WHERE was <> now)"""

RECORDED = """
checked AS (
  SELECT r.*,
    CASE WHEN r.customer_id NOT IN (SELECT customer_id FROM d_customers) THEN 'customer_missing'
      WHEN r.payment_method_code NOT IN (SELECT payment_method_code FROM d_payment_methods) THEN 'method_unknown'
      WHEN r.amount <= 0 THEN 'amount_not_positive' WHEN r.amount IS NULL THEN 'amount_null'
      WHEN EXISTS (SELECT 1 FROM d_payments p WHERE p.customer_id = r.customer_id AND p.datetime_payment = r.datetime_payment) THEN 'duplicate_key' END AS fail
  FROM d_payment_requests r),
answer AS (
  SELECT *, COALESCE(fail, CASE WHEN row_number() OVER (PARTITION BY customer_id, datetime_payment, fail IS NULL ORDER BY request_id) > 1 THEN 'duplicate_key' END) AS reason
  FROM checked)"""


def payment_balances(times: int) -> tuple[str, str]:
    return (
        RECORDED,
        f"""
SELECT a.customer_id, {money('MAX(c.amount_outstanding)')} AS opening,
  {money(f'GREATEST(0, MAX(c.amount_outstanding) - {times} * SUM(a.amount))')} AS balance
FROM answer a JOIN d_customers c ON c.customer_id = a.customer_id WHERE a.reason IS NULL GROUP BY 1""",
    )


CORRECTED = f"""
checked AS (
  SELECT r.*, CONCAT(customer_id, '@', original_datetime) AS here, CONCAT(customer_id, '@', new_datetime) AS there,
    CASE WHEN r.amount <= 0 THEN 'amount_not_positive'
      WHEN r.payment_method_code NOT IN (SELECT payment_method_code FROM d_payment_methods) THEN 'method_unknown' END AS early
  FROM d_payment_corrections r),
touched AS (SELECT *, list_distinct([here, there]) AS keys FROM checked WHERE early IS NULL),
{linked('touched').strip()},
paid AS (SELECT CONCAT(customer_id, '@', datetime_payment) AS key, struct_pack(a := CAST(amount_payment AS DECIMAL(10,2)), b := CAST(datetime_payment AS TIMESTAMP)) AS held FROM d_payments),
books AS (
  SELECT component, map_from_entries(list((key, held)) FILTER (held IS NOT NULL)) AS book FROM (
    SELECT DISTINCT q.component, s.key, p.held FROM queue q JOIN spots s USING (request_id) LEFT JOIN paid p USING (key)) GROUP BY component),
book_walk AS (
  SELECT component, CAST(0 AS BIGINT) AS turn, COALESCE(book, map_from_entries([]::STRUCT(k VARCHAR, v STRUCT(a DECIMAL(10,2), b TIMESTAMP))[])) AS book, CAST(NULL AS BIGINT) AS request_id,
    CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DECIMAL(10,2)) AS old_amount, CAST(NULL AS TIMESTAMP) AS stored_datetime FROM books
  UNION ALL
  SELECT component, turn, CASE WHEN reason IS NULL THEN map_concat(map_concat(book, map_from_entries([(here, CAST(NULL AS STRUCT(a DECIMAL(10,2), b TIMESTAMP)))])), map_from_entries([(there, struct_pack(a := amount, b := now.b))])) ELSE book END,
    request_id, reason, now.a, now.b
  FROM (
    SELECT w.component, q.turn, w.book, q.request_id, q.here, q.there, q.amount, w.book[q.here] AS now,
      CASE WHEN w.book[q.here] IS NULL THEN 'payment_not_found' WHEN q.amount IS NULL THEN 'amount_null'
        WHEN q.here <> q.there AND w.book[q.there] IS NOT NULL THEN 'duplicate_key' END AS reason
    FROM book_walk w JOIN queue q ON q.component = w.component AND q.turn = w.turn + 1) AS step),
answer AS (
  SELECT c.*, w.old_amount, w.stored_datetime, COALESCE(c.early, w.reason) AS reason
  FROM checked c LEFT JOIN book_walk w ON w.request_id = c.request_id)"""


def clamped(source: str) -> str:
    """Walk each customer's steps (``customer_id, turn, opening, change``) one by one."""
    return f"""
walk AS (
  SELECT customer_id, turn, CAST(GREATEST(0, opening + change) AS DECIMAL(28,2)) AS balance FROM {source} WHERE turn = 1
  UNION ALL
  SELECT s.customer_id, s.turn, CAST(GREATEST(0, w.balance + s.change) AS DECIMAL(28,2))
  FROM walk w JOIN {source} s ON s.customer_id = w.customer_id AND s.turn = w.turn + 1)"""


STEPS = f"""
history AS (
  SELECT customer_id, {starts('lesson_date', 'lesson_time_sec')} AS step_at, 'lesson' AS kind, lesson_id AS ref, price AS change FROM d_lessons
  UNION ALL
  SELECT customer_id, datetime_payment, 'payment', CAST(epoch_us(datetime_payment) AS BIGINT), -amount_payment FROM d_payments),
steps AS (
  SELECT *, 0 AS opening, row_number() OVER (PARTITION BY customer_id ORDER BY step_at, kind, ref) AS turn
  FROM history)"""

ADDRESS_MATCH = """
groups AS (
  SELECT city, COALESCE(country, 'Canada') AS land, line_1_number_building AS l1, line_2_number_street AS l2, line_3_area_locality AS l3,
    zip_postcode AS zip, state_province_county AS prov, MIN(request_id) AS opener
  FROM {requests} GROUP BY ALL),
known AS (
  SELECT g.*, (SELECT MIN(a.address_id) FROM d_addresses a WHERE a.city = g.city AND a.country = g.land AND a.line_1_number_building = g.l1
      AND a.line_2_number_street IS NOT DISTINCT FROM g.l2 AND a.line_3_area_locality IS NOT DISTINCT FROM g.l3
      AND a.zip_postcode = g.zip AND a.state_province_county IS NOT DISTINCT FROM g.prov) AS found
  FROM groups g),
placed AS (
  SELECT *, COALESCE(found, (SELECT MAX(address_id) FROM d_addresses)
      + row_number() OVER (PARTITION BY found IS NULL ORDER BY opener)) AS address_id FROM known),
located AS (
  SELECT r.request_id, p.address_id, p.found IS NULL AND p.opener = r.request_id AS created
  FROM {requests} r JOIN placed p ON r.city = p.city AND COALESCE(r.country, 'Canada') = p.land AND r.line_1_number_building = p.l1
    AND r.line_2_number_street IS NOT DISTINCT FROM p.l2 AND r.line_3_area_locality IS NOT DISTINCT FROM p.l3
    AND r.zip_postcode = p.zip AND r.state_province_county IS NOT DISTINCT FROM p.prov)"""


def customer_changes(op: str, key: str) -> str:
    """Answers to customer change requests, with ``op`` and the customer id as given."""
    return f"""
asked AS (
  SELECT request_id, {op} AS op, {key} AS given, first_name, last_name, date_of_birth, date_became_customer, customer_status_code,
    email_address AS email, cell_mobile_phone_number AS cell, line_1_number_building, city, zip_postcode,
    CAST(NULL AS VARCHAR) AS line_2_number_street, CAST(NULL AS VARCHAR) AS line_3_area_locality,
    CAST(NULL AS VARCHAR) AS state_province_county, CAST(NULL AS VARCHAR) AS country
  FROM d_customer_changes),
form AS (
  SELECT *, CASE WHEN op = 'delete' THEN NULL
      WHEN first_name IS NULL OR last_name IS NULL OR date_of_birth IS NULL OR date_became_customer IS NULL THEN 'required_missing'
      WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email_invalid'
      WHEN cell IS NOT NULL AND (NOT regexp_matches(cell, '^[0-9 ()+.-]+$') OR length(regexp_replace(cell, '[^0-9]', '', 'g')) NOT BETWEEN 10 AND 15) THEN 'phone_invalid'
      WHEN COALESCE(line_1_number_building, city, zip_postcode) IS NOT NULL
        AND (line_1_number_building IS NULL OR city IS NULL OR zip_postcode IS NULL) THEN 'address_incomplete' END AS fault
  FROM asked),
wanted AS (SELECT * FROM form WHERE op <> 'delete' AND fault IS NULL AND line_1_number_building IS NOT NULL),
{ADDRESS_MATCH.format(requests='wanted').strip()},
stored AS (
  SELECT f.*, CASE WHEN op = 'delete' AND given IN (SELECT customer_id FROM d_lessons) THEN 'has_lessons' ELSE fault END AS refused,
    CASE WHEN f.customer_status_code NOT IN (SELECT customer_status_code FROM d_customer_status) THEN 'status_unknown' END AS late,
    CASE WHEN op <> 'add' AND given IS NOT NULL THEN CONCAT('C', given) END AS ckey, CASE WHEN op <> 'delete' THEN email END AS wanted,
    c.customer_id IS NOT NULL AS known, COALESCE(c.email_address, '') AS own
  FROM form f LEFT JOIN d_customers c ON c.customer_id = f.given AND f.op <> 'add'),
touched AS (
  SELECT *, list_filter(list_distinct([ckey, CONCAT('E', wanted), CONCAT('E', own)]), lambda k: k IS NOT NULL AND k <> 'E') AS keys
  FROM stored WHERE refused IS NULL),
{linked('touched').strip()},
people AS (
  SELECT component, map_from_entries(list((ckey, own)) FILTER (known)) AS own FROM (SELECT DISTINCT component, ckey, known, own FROM queue) GROUP BY component),
mail AS (
  SELECT component, map_from_entries(list((key, n))) AS held FROM (
    SELECT DISTINCT q.component, s.key, COALESCE(o.n, 0) AS n FROM queue q JOIN spots s USING (request_id)
    LEFT JOIN (SELECT CONCAT('E', email_address) AS key, COUNT(*) AS n FROM d_customers WHERE email_address IS NOT NULL GROUP BY 1) o ON o.key = s.key
    UNION SELECT component, 'E', 0 FROM queue) GROUP BY component),
walk AS (
  SELECT component, CAST(0 AS BIGINT) AS turn, COALESCE(own, map_from_entries([]::STRUCT(k VARCHAR, v VARCHAR)[])) AS own, held,
    CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reason FROM people JOIN mail USING (component)
  UNION ALL
  SELECT component, turn, CASE WHEN acts AND op <> 'add' THEN map_concat(own, map_from_entries([(ckey, CASE WHEN op = 'update' THEN COALESCE(wanted, '') END)])) ELSE own END,
    CASE WHEN acts AND op = 'delete' THEN freed WHEN acts AND wanted IS NOT NULL THEN map_concat(freed, map_from_entries([(CONCAT('E', wanted), freed[CONCAT('E', wanted)] + 1)])) ELSE held END,
    request_id, reason
  FROM (
    SELECT *, reason IS NULL AND (op = 'add' OR before IS NOT NULL) AS acts FROM (
      SELECT *, CASE WHEN op = 'delete' OR (op = 'update' AND before IS NULL) THEN NULL WHEN late IS NOT NULL THEN late
          WHEN wanted IS NOT NULL AND wanted <> COALESCE(before, '') AND held[CONCAT('E', wanted)] > 0 THEN 'email_taken' END AS reason
      FROM (
        SELECT w.component, q.turn, w.own, w.held, q.request_id, q.op, q.ckey, q.wanted, q.late, w.own[q.ckey] AS before,
          CASE WHEN COALESCE(w.own[q.ckey], '') <> '' THEN map_concat(w.held, map_from_entries([(CONCAT('E', w.own[q.ckey]), w.held[CONCAT('E', w.own[q.ckey])] - 1)])) ELSE w.held END AS freed
        FROM walk w JOIN queue q ON q.component = w.component AND q.turn = w.turn + 1) AS step) AS ruled) AS done),
final AS (
  SELECT s.*, COALESCE(s.refused, w.reason) AS reason FROM stored s LEFT JOIN walk w ON w.request_id = s.request_id),
answer AS (
  SELECT f.*, x.address_id, COALESCE(CASE WHEN f.op <> 'add' THEN f.given END, CASE WHEN f.reason IS NULL AND f.op = 'add' THEN (SELECT MAX(customer_id) FROM d_customers)
      + row_number() OVER (PARTITION BY f.reason IS NULL AND f.op = 'add' ORDER BY f.request_id) END) AS customer_id
  FROM final f LEFT JOIN located x USING (request_id))"""


BOUND = """
bound AS (
  SELECT DISTINCT l.staff_id FROM d_lessons l JOIN d_lessons o ON o.vehicle_id = l.vehicle_id AND o.lesson_date = l.lesson_date
    AND o.lesson_time_sec = l.lesson_time_sec AND o.lesson_id <> l.lesson_id AND o.lesson_status_code <> 'CANC' WHERE l.staff_id IS NOT NULL)"""

STAFF_ANSWER = BOUND + """,
final AS (
  SELECT *, CASE WHEN op = 'delete' AND staff_id IN (SELECT staff_id FROM bound) THEN 'vehicle_conflict'
      WHEN op <> 'delete' AND (first_name IS NULL OR last_name IS NULL OR date_joined_staff IS NULL) THEN 'required_missing'
      WHEN op <> 'delete' AND date_left_staff < date_joined_staff THEN 'left_before_joined'
      WHEN op <> 'delete' AND customer_status_code NOT IN (SELECT customer_status_code FROM d_customer_status) THEN 'status_unknown' END AS reason
  FROM d_staff_changes),
answer AS (
  SELECT * REPLACE (COALESCE(staff_id, CASE WHEN reason IS NULL THEN (SELECT MAX(staff_id) FROM d_staff)
      + row_number() OVER (PARTITION BY staff_id IS NULL AND reason IS NULL ORDER BY request_id) END) AS staff_id)
  FROM final)"""

def sign_in(reset: str) -> str:
    """``ruled``: what became of each attempt; rows that meet the condition ``reset`` set a new password."""
    return f"""
tries AS (
  SELECT a.*, {reset} AS reset, u.user_id, CASE WHEN u.user_id IS NULL THEN 'no such user' WHEN NOT u.is_active THEN 'inactive' END AS shut
  FROM d_login_attempts a LEFT JOIN d_app_users u ON u.email = a.email),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY email ORDER BY attempted_at, attempt_id) AS turn FROM tries
  WHERE shut IS NULL OR (shut = 'inactive' AND reset)),
walk AS (
  SELECT DISTINCT email, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS attempt_id, CAST(0 AS BIGINT) AS failures,
    CAST(NULL AS TIMESTAMP) AS until, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS TIMESTAMP) AS moment FROM queue
  UNION ALL
  SELECT email, turn, attempt_id,
    CASE WHEN detail IN ('ok', 'reset') THEN 0 WHEN detail = 'locked' THEN failures ELSE failures + 1 END,
    CASE WHEN detail IN ('ok', 'reset') THEN NULL WHEN detail = 'bad password' AND failures + 1 >= 5 THEN moment + INTERVAL '720' MINUTE ELSE until END,
    detail, moment
  FROM (
    SELECT q.email, q.turn, q.attempt_id, w.failures, w.until, q.attempted_at AS moment,
      CASE WHEN q.reset THEN 'reset' WHEN w.until > q.attempted_at THEN 'locked' WHEN q.password_ok THEN 'ok' ELSE 'bad password' END AS detail
    FROM walk w JOIN queue q ON q.email = w.email AND q.turn = w.turn + 1) AS step),
ruled AS (
  SELECT t.attempt_id, t.email, t.user_id, COALESCE(t.shut, w.detail) AS detail, t.attempted_at
  FROM tries t LEFT JOIN walk w ON w.attempt_id = t.attempt_id WHERE NOT t.reset)"""


SIGN_IN = sign_in("false")

ROLE_ANSWER = """
answer AS (
  SELECT request_id, user_id, upper(role_code) AS role_code, action, requested_at,
    CASE WHEN action = 'assign' AND user_id NOT IN (SELECT user_id FROM d_app_users) THEN 'user_missing'
      WHEN action = 'assign' AND upper(role_code) NOT IN (SELECT role_code FROM d_app_roles) THEN 'role_missing' END AS reason
  FROM d_role_requests)"""

REGISTERED = """
cleaned AS (SELECT request_id, lower(trim(email)) AS email, full_name, password_length, upper(COALESCE(role_code, 'STAFF')) AS role_code FROM d_registration_requests),
checked AS (
  SELECT *, CASE WHEN full_name IS NULL OR email IS NULL OR COALESCE(password_length, 0) = 0 THEN 'required_missing'
      WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email_invalid'
      WHEN password_length < 8 THEN 'password_short'
      WHEN role_code NOT IN (SELECT role_code FROM d_app_roles) THEN 'role_unknown'
      WHEN email IN (SELECT email FROM d_app_users) THEN 'already_registered' END AS fail
  FROM cleaned),
final AS (SELECT *, COALESCE(fail, CASE WHEN row_number() OVER (PARTITION BY email, fail IS NULL ORDER BY request_id) > 1 THEN 'already_registered' END) AS reason FROM checked)"""

REMOVED = """
admins AS (SELECT DISTINCT user_id FROM d_app_user_roles WHERE role_code = 'ADMIN'),
numbered AS (SELECT r.*, u.email, row_number() OVER (PARTITION BY r.user_id ORDER BY r.request_id) AS nth, r.user_id IN (SELECT user_id FROM admins) AS is_admin
  FROM d_user_delete_requests r LEFT JOIN d_app_users u ON u.user_id = r.user_id),
admin_turn AS (SELECT user_id, row_number() OVER (ORDER BY request_id) AS turn FROM numbered WHERE nth = 1 AND is_admin AND email IS NOT NULL),
answer AS (
  SELECT n.request_id, n.user_id, n.email,
    CASE WHEN n.email IS NULL THEN 'user_not_found' WHEN t.turn >= (SELECT COUNT(*) FROM admins) THEN 'last_admin' WHEN n.nth > 1 THEN 'user_not_found' END AS reason
  FROM numbered n LEFT JOIN admin_turn t ON t.user_id = n.user_id)"""


# --- data quality ------------------------------------------------------------
def duplicate_keys() -> str:
    keys = [
        ("customer_status", ["customer_status_code"]), ("lesson_status", ["lesson_status_code"]),
        ("payment_methods", ["payment_method_code"]), ("addresses", ["address_id"]), ("vehicles", ["vehicle_id"]),
        ("staff", ["staff_id"]), ("customers", ["customer_id"]), ("customers", ["email_address"]),
        ("payments", ["customer_id", "datetime_payment"]), ("lessons", ["lesson_id"]), ("app_roles", ["role_code"]),
        ("app_users", ["user_id"]), ("app_users", ["email"]), ("app_user_roles", ["user_id", "role_code"]),
        ("app_login_audit", ["audit_id"]), ("lesson_audit_log", ["audit_id"]),
    ]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{', '.join(k)}' AS key_columns, COUNT(*) AS repeated_keys, "
        f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS rows_involved FROM (SELECT COUNT(*) AS n FROM d_{t} "
        f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} GROUP BY {', '.join(k)} HAVING COUNT(*) > 1) AS x"
        for t, k in keys
    )


def orphans() -> str:
    refs = [
        ("staff", "staff_address_id", "addresses", "address_id", "set_null"),
        ("staff", "customer_status_code", "customer_status", "customer_status_code", "restrict"),
        ("customers", "customer_address_id", "addresses", "address_id", "set_null"),
        ("customers", "customer_status_code", "customer_status", "customer_status_code", "restrict"),
        ("payments", "customer_id", "customers", "customer_id", "cascade"),
        ("payments", "payment_method_code", "payment_methods", "payment_method_code", "restrict"),
        ("lessons", "customer_id", "customers", "customer_id", "restrict"),
        ("lessons", "lesson_status_code", "lesson_status", "lesson_status_code", "restrict"),
        ("lessons", "staff_id", "staff", "staff_id", "set_null"),
        ("lessons", "vehicle_id", "vehicles", "vehicle_id", "set_null"),
        ("app_users", "staff_id", "staff", "staff_id", "set_null"),
        ("app_users", "customer_id", "customers", "customer_id", "set_null"),
        ("app_user_roles", "user_id", "app_users", "user_id", "cascade"),
        ("app_user_roles", "role_code", "app_roles", "role_code", "restrict"),
        ("lesson_audit_log", "lesson_id", "lessons", "lesson_id", "cascade"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{p}' AS parent_table, '{action}' AS on_delete, "
        f"COUNT(DISTINCT x.{c}) AS orphan_values, COUNT(*) AS orphan_rows FROM d_{t} x "
        f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_{p} y WHERE y.{k} = x.{c})"
        for t, c, p, k, action in refs
    )


# Required columns; those that the derived tables do not carry are filled by a default when loaded.
REQUIRED = {
    "customer_status": ["customer_status_code", "customer_status_description"],
    "lesson_status": ["lesson_status_code", "lesson_status_description"],
    "payment_methods": ["payment_method_code", "payment_method_description"],
    "addresses": ["address_id", "line_1_number_building", "city", "zip_postcode", "country"],
    "vehicles": ["vehicle_id", "vehicle_details"],
    "staff": ["staff_id", "customer_status_code", "first_name", "last_name", "date_joined_staff"],
    "customers": [
        "customer_id", "customer_status_code", "date_became_customer", "date_of_birth", "first_name", "last_name",
        "amount_outstanding",
    ],
    "payments": ["customer_id", "datetime_payment", "payment_method_code", "amount_payment"],
    "lessons": ["lesson_id", "customer_id", "lesson_status_code", "lesson_date", "lesson_time_sec", "price"],
    "app_roles": ["role_code", "role_name"],
    "app_users": ["user_id", "email", "is_active", "created_at"],
    "app_user_roles": ["user_id", "role_code", "assigned_at"],
    "app_login_audit": ["audit_id", "success", "attempted_at"],
    "lesson_audit_log": ["audit_id", "lesson_id", "changed_at"],
}
LIMITS = {
    "customer_status": {"customer_status_code": 10, "customer_status_description": 100},
    "lesson_status": {"lesson_status_code": 10, "lesson_status_description": 100},
    "payment_methods": {"payment_method_code": 10, "payment_method_description": 100},
    "addresses": {
        "line_1_number_building": 100, "line_2_number_street": 100, "line_3_area_locality": 100, "city": 100,
        "zip_postcode": 20, "state_province_county": 100, "country": 100,
    },
    "vehicles": {"vehicle_details": 100},
    "staff": {"customer_status_code": 10, "nickname": 50, "first_name": 50, "middle_name": 50, "last_name": 50},
    "customers": {
        "customer_status_code": 10, "first_name": 50, "last_name": 50, "email_address": 150, "phone_number": 30,
        "cell_mobile_phone_number": 30,
    },
    "payments": {"payment_method_code": 10},
    "lessons": {"lesson_status_code": 10},
    "app_roles": {"role_code": 50, "role_name": 100},
    "app_users": {"email": 255, "full_name": 200},
    "app_user_roles": {"role_code": 50},
    "app_login_audit": {"email": 255, "detail": 200},
    "lesson_audit_log": {"old_status": 10, "new_status": 10, "changed_by": 100},
}
MONEY_COLUMNS = [("customers", "amount_outstanding"), ("payments", "amount_payment"), ("lessons", "price")]


def nulls() -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS rows_broken FROM d_{t}"
        for t, cols in REQUIRED.items()
        for c in cols
    ]
    parts.append("SELECT 'app_users', 'failed_attempts', 0 * COUNT(*) FROM d_app_users")
    return " UNION ALL ".join(parts)


def checks() -> str:
    rules = [
        ("staff", "left_after_join", "date_left_staff < date_joined_staff"),
        ("customers", "outstanding_not_negative", "amount_outstanding < 0"),
        ("payments", "payment_positive", "amount_payment <= 0"),
        ("lessons", "price_not_negative", "price < 0"),
        ("app_users", "email_has_at_sign", "strpos(email, '@') < 2"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{n}' AS check_name, COUNT(*) FILTER (WHERE {bad}) AS rows_broken FROM d_{t}"
        for t, n, bad in rules
    )


def lengths() -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{c} <= {n}' AS limit_rule, COUNT(*) FILTER (WHERE length({c}) > {n}) AS rows_broken FROM d_{t}"
        for t, cols in LIMITS.items()
        for c, n in cols.items()
    ]
    parts += [
        f"SELECT '{t}', '{c} < 10^8', COUNT(*) FILTER (WHERE abs({c}) >= 100000000) FROM d_{t}" for t, c in MONEY_COLUMNS
    ]
    return " UNION ALL ".join(parts)


CUSTOMER_COLUMNS = (
    "c.customer_id, c.first_name, c.last_name, c.date_became_customer, c.date_of_birth, c.email_address, c.phone_number, "
    "c.cell_mobile_phone_number, CAST(c.amount_outstanding AS DOUBLE) AS amount_outstanding, c.other_customer_details, "
    "c.customer_status_code, s.customer_status_description"
)
ADDRESS_SELECT = "SELECT request_id, address_id, created, CAST(NULL AS VARCHAR) AS reason FROM located"
FULL_ADDRESS = "concat_ws(', ', a.line_1_number_building, a.line_2_number_street, a.line_3_area_locality, a.city, a.zip_postcode)"

BODIES: dict[str, tuple[str, str]] = {
    "scan_project": ("", f"SELECT c.customer_id, {name_of('c')} AS name, c.customer_status_code FROM d_customers c"),
    "lookup_reference": (
        "",
        f"""
SELECT 'customer_status' AS lookup, s.customer_status_code AS code, s.customer_status_description AS description,
  {CUSTOMER_COLOUR.format(c='s.customer_status_code')} AS colour,
  (SELECT COUNT(*) FROM d_customers c WHERE c.customer_status_code = s.customer_status_code) AS rows_using FROM d_customer_status s
UNION ALL
SELECT 'lesson_status', s.lesson_status_code, s.lesson_status_description, {LESSON_COLOUR.format(c='s.lesson_status_description')},
  (SELECT COUNT(*) FROM d_lessons l WHERE l.lesson_status_code = s.lesson_status_code) FROM d_lesson_status s
UNION ALL
SELECT 'payment_methods', m.payment_method_code, m.payment_method_description, NULL,
  (SELECT COUNT(*) FROM d_payments p WHERE p.payment_method_code = m.payment_method_code) FROM d_payment_methods m""",
    ),
    "list_addresses": (
        "",
        """
SELECT address_id, line_1_number_building, line_2_number_street, line_3_area_locality, city, zip_postcode, state_province_county,
  country, other_address_details, (SELECT COUNT(*) FROM d_customers c WHERE c.customer_address_id = a.address_id) AS customers_there
FROM d_addresses a""",
    ),
    "list_staff": (
        "",
        f"""
SELECT staff_id, COALESCE(nickname, first_name || ' ' || last_name) AS instructor, customer_status_code,
  {CUSTOMER_COLOUR.format(c='customer_status_code')} AS colour, strftime(date_joined_staff, '%Y-%m-%d') AS joined,
  COALESCE(strftime(date_left_staff, '%Y-%m-%d'), '—') AS left_on, COALESCE(other_staff_details, '') AS notes
FROM d_staff""",
    ),
    "lookup_address": (
        "",
        """
SELECT c.customer_id, c.customer_address_id AS address_id, a.line_1_number_building, a.line_2_number_street, a.line_3_area_locality,
  a.city, a.zip_postcode, a.state_province_county, a.country
FROM d_customers c LEFT JOIN d_addresses a ON a.address_id = c.customer_address_id""",
    ),
    "lookup_lesson": (
        "",
        f"""
SELECT lesson_id, customer_id AS cust, staff_id AS staff, vehicle_id AS veh, lesson_date AS date, {clock('lesson_time_sec')} AS time,
  {money('price')} AS price, COALESCE(other_lesson_details, '') AS notes, lesson_status_code AS status_code FROM d_lessons""",
    ),
    "payment_history": (
        "",
        f"""
SELECT p.customer_id, trim(COALESCE(c.first_name, '') || ' ' || COALESCE(c.last_name, '')) AS customer_name, p.datetime_payment,
  p.payment_method_code, COALESCE(m.payment_method_description, p.payment_method_code) AS method_shown,
  {money('p.amount_payment')} AS amount_payment, COALESCE(p.other_payment_details, '') AS note,
  COUNT(*) OVER (PARTITION BY p.customer_id) AS payments_of_customer,
  {money('SUM(p.amount_payment) OVER (PARTITION BY p.customer_id)')} AS total_of_customer
FROM d_payments p LEFT JOIN d_customers c ON c.customer_id = p.customer_id
LEFT JOIN d_payment_methods m ON m.payment_method_code = p.payment_method_code""",
    ),
    "address_search": (
        """
texts AS (SELECT search_id, lower(trim(needle)) AS q FROM d_address_needles WHERE trim(needle) <> ''),
found AS (
  SELECT t.search_id, a.address_id,
    concat_ws(', ', nullif(a.line_1_number_building, ''), nullif(a.line_2_number_street, ''), nullif(a.line_3_area_locality, ''), nullif(a.city, ''), nullif(a.zip_postcode, '')) AS label,
    row_number() OVER (PARTITION BY t.search_id ORDER BY a.address_id) AS rank
  FROM texts t JOIN d_addresses a ON contains(lower(COALESCE(a.line_1_number_building, '')), t.q) OR contains(lower(COALESCE(a.line_2_number_street, '')), t.q)
    OR contains(lower(COALESCE(a.line_3_area_locality, '')), t.q) OR contains(lower(COALESCE(a.city, '')), t.q)
    OR contains(lower(COALESCE(a.zip_postcode, '')), t.q) OR contains(lower(COALESCE(a.state_province_county, '')), t.q))""",
        "SELECT search_id, address_id, label, rank FROM found WHERE rank <= 8",
    ),
    "contact_quality": (
        "",
        """
SELECT customer_id, email_address,
  COALESCE(trim(email_address) = '' OR regexp_matches(trim(email_address), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'), true) AS email_ok,
  cell_mobile_phone_number,
  CASE WHEN COALESCE(trim(cell_mobile_phone_number), '') = '' THEN true
    ELSE regexp_matches(trim(cell_mobile_phone_number), '^[0-9 ()+.-]+$')
      AND length(regexp_replace(cell_mobile_phone_number, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 END AS phone_ok
FROM d_customers""",
    ),
    "bookable_instructors": (
        "",
        f"""
SELECT s.staff_id, {name_of('s')} AS instructor_name FROM d_staff s
WHERE s.date_left_staff IS NULL AND lower(COALESCE(s.other_staff_details, '')) NOT LIKE '%administrator%'""",
    ),
    "cancellable_lessons": (
        DETAILS,
        "SELECT lesson_id, lesson_date, status, customer_name FROM details WHERE status IN ('Booked', 'Confirmed')",
    ),
    "customer_directory": (
        "",
        f"""
SELECT c.customer_id, {name_of('c')} AS customer_name, {years('c.date_of_birth')} AS age, c.email_address, c.cell_mobile_phone_number,
  {FULL_ADDRESS} AS full_address, s.customer_status_description AS status, {money('c.amount_outstanding')} AS balance,
  c.customer_status_code AS status_code, {CUSTOMER_COLOUR.format(c='c.customer_status_code')} AS status_colour,
  c.first_name AS first, c.last_name AS last, c.date_of_birth AS dob, c.date_became_customer AS since,
  c.customer_address_id AS addr, {BAND.format(b='c.amount_outstanding')} AS balance_band
FROM d_customers c JOIN d_customer_status s ON s.customer_status_code = c.customer_status_code
LEFT JOIN d_addresses a ON a.address_id = c.customer_address_id""",
    ),
    "list_lessons": (
        DETAILS,
        f"""
SELECT lesson_id, lesson_date AS date, {clock('lesson_time_sec')} AS time, customer_name AS customer, instructor_name AS instructor,
  COALESCE(vehicle_details, '—') AS vehicle, split_part(COALESCE(vehicle_details, '—'), ' - Plate', 1) AS vehicle_label,
  {money('price')} AS price, status, {LESSON_COLOUR.format(c='status')} AS status_colour, other_lesson_details AS notes FROM details""",
    ),
    "roles_panel": (
        ROLE_TEXT,
        """
SELECT u.user_id, u.full_name AS shown_as, u.email, '[' || COALESCE(t.roles, '') || ']' AS roles
FROM d_app_users u LEFT JOIN role_text t USING (user_id)""",
    ),
    "view_customers": (
        "",
        f"""
SELECT {CUSTOMER_COLUMNS}, a.address_id, a.line_1_number_building, a.line_2_number_street, a.line_3_area_locality, a.city,
  a.zip_postcode, a.state_province_county, a.country, a.other_address_details
FROM d_customers c LEFT JOIN d_customer_status s USING (customer_status_code) LEFT JOIN d_addresses a ON a.address_id = c.customer_address_id""",
    ),
    "view_staff": (
        "",
        """
SELECT t.staff_id, t.nickname, t.first_name, t.middle_name, t.last_name, t.date_of_birth, t.date_joined_staff, t.date_left_staff,
  t.other_staff_details, t.customer_status_code, s.customer_status_description, a.address_id, a.line_1_number_building,
  a.line_2_number_street, a.city, a.zip_postcode, a.state_province_county, a.country
FROM d_staff t LEFT JOIN d_customer_status s USING (customer_status_code) LEFT JOIN d_addresses a ON a.address_id = t.staff_address_id""",
    ),
    "view_lessons": (
        "",
        f"""
SELECT l.lesson_id, l.customer_id, c.first_name AS customer_first_name, c.last_name AS customer_last_name, l.staff_id,
  t.first_name AS staff_first_name, t.last_name AS staff_last_name, l.vehicle_id, v.vehicle_details, l.lesson_date, l.lesson_time_sec,
  {starts('l.lesson_date', 'l.lesson_time_sec')} AS lesson_datetime, {money('l.price')} AS price, l.other_lesson_details,
  l.lesson_status_code, s.lesson_status_description
FROM d_lessons l LEFT JOIN d_customers c ON c.customer_id = l.customer_id LEFT JOIN d_staff t ON t.staff_id = l.staff_id
LEFT JOIN d_vehicles v ON v.vehicle_id = l.vehicle_id LEFT JOIN d_lesson_status s ON s.lesson_status_code = l.lesson_status_code""",
    ),
    "view_customer_payments": (
        "",
        f"""
SELECT p.customer_id, c.first_name, c.last_name, p.datetime_payment, p.payment_method_code, m.payment_method_description,
  {money('p.amount_payment')} AS amount_payment, p.other_payment_details
FROM d_payments p LEFT JOIN d_customers c ON c.customer_id = p.customer_id
LEFT JOIN d_payment_methods m ON m.payment_method_code = p.payment_method_code""",
    ),
    "view_user_roles": (
        "",
        """
SELECT u.user_id, u.email, u.full_name, u.is_active, u.staff_id, t.first_name AS staff_first_name, t.last_name AS staff_last_name,
  u.customer_id, c.first_name AS customer_first_name, c.last_name AS customer_last_name, g.role_code, r.role_name, g.assigned_at
FROM d_app_users u LEFT JOIN d_app_user_roles g ON g.user_id = u.user_id LEFT JOIN d_app_roles r ON r.role_code = g.role_code
LEFT JOIN d_staff t ON t.staff_id = u.staff_id LEFT JOIN d_customers c ON c.customer_id = u.customer_id""",
    ),
    "customer_financials": (
        PAID,
        f"""
SELECT c.customer_id, c.first_name, c.last_name, {money('c.amount_outstanding')} AS amount_outstanding,
  {money('COALESCE(p.total, 0)')} AS total_paid, p.latest AS last_payment
FROM d_customers c LEFT JOIN paid p USING (customer_id)""",
    ),
    "lessons_schedule": (
        "",
        f"""
SELECT l.lesson_id, {starts('l.lesson_date', 'l.lesson_time_sec')} AS lesson_datetime, l.lesson_date, l.lesson_time_sec,
  s.lesson_status_description, {money('l.price')} AS price, l.customer_id, c.first_name AS customer_first_name,
  c.last_name AS customer_last_name, c.email_address AS customer_email, l.staff_id, t.first_name AS staff_first_name,
  t.last_name AS staff_last_name, v.vehicle_details
FROM d_lessons l LEFT JOIN d_lesson_status s ON s.lesson_status_code = l.lesson_status_code
LEFT JOIN d_customers c ON c.customer_id = l.customer_id LEFT JOIN d_staff t ON t.staff_id = l.staff_id
LEFT JOIN d_vehicles v ON v.vehicle_id = l.vehicle_id""",
    ),
    "active_instructors": (
        "",
        f"""
SELECT s.staff_id, {name_of('s')} AS instructor_name, s.nickname, {years('s.date_of_birth')} AS age, s.date_joined_staff, s.other_staff_details
FROM d_staff s WHERE s.date_left_staff IS NULL AND s.other_staff_details IS NOT NULL AND strpos(s.other_staff_details, 'administrator') = 0""",
    ),
    "lesson_details": (DETAILS, f"SELECT {DETAIL_COLUMNS} FROM details"),
    "monthly_revenue": (
        MONTHLY,
        f"SELECT pay_month, method, n AS num_payments, {money('total')} AS total_collected FROM monthly",
    ),
    "vehicle_utilisation": (
        FLEET,
        f"""SELECT vehicle_id, vehicle_details, assigned AS lessons_assigned, completed AS lessons_completed,
  {money('revenue')} AS revenue_from_vehicle FROM fleet""",
    ),
    "upcoming_lessons": (
        DETAILS,
        f"SELECT {DETAIL_COLUMNS} FROM details WHERE lesson_date >= {TODAY} AND status <> 'Cancelled by customer' AND status <> 'No show'",
    ),
    "today_lessons": (DETAILS, f"SELECT {DETAIL_COLUMNS} FROM details WHERE lesson_date = {TODAY}"),
    "customer_full_address": (
        "",
        f"""
SELECT c.customer_id, {name_of('c')} AS customer_name, {years('c.date_of_birth')} AS age, c.email_address, c.cell_mobile_phone_number,
  {FULL_ADDRESS} AS full_address, s.customer_status_description AS status
FROM d_customers c JOIN d_customer_status s ON s.customer_status_code = c.customer_status_code
LEFT JOIN d_addresses a ON a.address_id = c.customer_address_id""",
    ),
    "customer_balance": (
        BALANCE,
        f"""
SELECT customer_id, customer_name, {money('charged')} AS total_charged, {money('paid')} AS total_paid,
  {money('calculated')} AS calculated_outstanding, {money('stored')} AS stored_outstanding FROM balance""",
    ),
    "instructor_workload": (
        WORKLOAD,
        f"""
SELECT staff_id, instructor_name, total AS total_lessons, CAST(completed AS BIGINT) AS completed_lessons,
  CAST(cancelled AS BIGINT) AS cancelled_lessons, {money('revenue')} AS revenue_generated FROM workload""",
    ),
    "app_users": (
        ROLE_TEXT,
        """
SELECT u.user_id, u.email, u.full_name, u.is_active, u.staff_id, u.customer_id, u.created_at, u.last_login_at, COALESCE(t.roles, '') AS roles
FROM d_app_users u LEFT JOIN role_text t USING (user_id)""",
    ),
    "user_roles": (
        "",
        """
SELECT g.user_id, u.email, g.role_code, r.role_name, g.assigned_at FROM d_app_user_roles g
JOIN d_app_users u ON u.user_id = g.user_id JOIN d_app_roles r ON r.role_code = g.role_code""",
    ),
    "user_role_arrays": (
        ROLE_TEXT,
        "SELECT u.user_id, u.email, u.full_name, '[' || COALESCE(t.roles, '') || ']' AS roles FROM d_app_users u LEFT JOIN role_text t USING (user_id)",
    ),
    "revenue_analysis": (
        "",
        f"""
SELECT CAST(date_trunc('month', p.datetime_payment) AS DATE) AS month, m.payment_method_description AS payment_method,
  COUNT(DISTINCT p.customer_id) AS unique_payers, COUNT(*) AS payment_count, {money('SUM(p.amount_payment)')} AS total_revenue,
  {mean('p.amount_payment', 6)} AS avg_payment_amount, {money('MIN(p.amount_payment)')} AS min_payment_amount,
  {money('MAX(p.amount_payment)')} AS max_payment_amount
FROM d_payments p LEFT JOIN d_payment_methods m ON m.payment_method_code = p.payment_method_code GROUP BY 1, 2""",
    ),
    "financial_health": health("'INACTIVE','SUSPENDED'"),
    "financial_health_fixed": health("'INA','SUS'"),
    "instructor_performance": (
        "",
        f"""
SELECT s.staff_id, {name_of('s')} AS instructor_name, COUNT(DISTINCT l.lesson_id) AS total_lessons_taught,
  COUNT(*) FILTER (WHERE l.lesson_status_code IN ('COMP','CONF')) AS completed_lessons,
  COUNT(*) FILTER (WHERE l.lesson_status_code = 'CANC') AS cancelled_lessons,
  {pct("COUNT(*) FILTER (WHERE l.lesson_status_code = 'CANC')", 'COUNT(l.lesson_id)', 1)} AS cancellation_rate_percent,
  {money('SUM(l.price)')} AS total_lesson_revenue, CASE WHEN COUNT(l.price) > 0 THEN {mean('l.price')} END AS avg_lesson_price,
  COUNT(DISTINCT l.customer_id) AS unique_students, date_diff('day', MIN(l.lesson_date), {TODAY}) AS days_since_first_lesson,
  date_diff('day', MAX(l.lesson_date), {TODAY}) AS days_since_last_lesson, s.date_joined_staff,
  CASE WHEN s.date_left_staff IS NULL THEN 'Active' ELSE 'Inactive' END AS employment_status
FROM d_staff s LEFT JOIN d_lessons l ON l.staff_id = s.staff_id
GROUP BY s.staff_id, s.first_name, s.last_name, s.date_joined_staff, s.date_left_staff""",
    ),
    "customer_lifecycle": lifecycle("ACTIVE", "INACTIVE"),
    "customer_lifecycle_fixed": lifecycle("ACT", "INA"),
    "customer_value_segments": segments("ACTIVE", True),
    "customer_value_segments_fixed": segments("ACT", False),
    "customer_value_segments_repeated": segments("ACT", True),
    "scheduling_efficiency": (
        "",
        f"""
SELECT CAST(date_trunc('week', lesson_date) AS DATE) AS week_starting, CAST(date_part('dow', lesson_date) AS BIGINT) AS day_of_week,
  CAST(lesson_time_sec // 3600 AS BIGINT) AS lesson_hour, lesson_status_code, COUNT(DISTINCT lesson_id) AS lessons_booked,
  COUNT(DISTINCT vehicle_id) AS vehicles_used, COUNT(DISTINCT staff_id) AS instructors_assigned, {mean('price')} AS avg_lesson_price,
  {money('SUM(price)')} AS weekly_revenue
FROM d_lessons GROUP BY 1, 2, 3, 4""",
    ),
    "lesson_completion_metrics": completion("PENDING"),
    "lesson_completion_metrics_fixed": completion("BOOK"),
    "report_instructor_reliability": (
        WORKLOAD
        + f""",
rated AS (SELECT *, {pct('completed', 'total', 1)} AS share FROM workload WHERE total > 0)""",
        f"""
SELECT staff_id, instructor_name, total AS total_lessons, CAST(completed AS BIGINT) AS completed_lessons,
  CAST(cancelled AS BIGINT) AS cancelled_lessons, {money('revenue')} AS revenue_generated, share AS completion_percent,
  CASE WHEN share >= 60 THEN 'green' WHEN share >= 40 THEN 'amber' ELSE 'red' END AS band FROM rated""",
    ),
    "report_debtors": (
        BALANCE,
        f"""
SELECT customer_id, customer_name, {money('charged')} AS total_charged, {money('paid')} AS total_paid,
  {money('calculated')} AS calculated_outstanding, {money('stored')} AS stored_outstanding, {BAND.format(b='calculated')} AS action
FROM balance WHERE charged > 0""",
    ),
    "report_fleet": (
        FLEET,
        f"""
SELECT vehicle_id, vehicle_details, assigned AS lessons_assigned, completed AS lessons_completed,
  {money('revenue')} AS revenue_from_vehicle, split_part(vehicle_details, ' - Plate', 1) AS vehicle_label FROM fleet""",
    ),
    "report_headline": (
        f"{BALANCE}, {WORKLOAD.strip()}, {MONTHLY.strip()}, "
        "best AS (SELECT * FROM workload WHERE total > 0 ORDER BY revenue DESC, staff_id LIMIT 1)",
        f"""
SELECT COALESCE((SELECT split_part(instructor_name, ' ', 1) FROM best), '—') AS top_earner, {ca('(SELECT revenue FROM best)')} AS top_revenue,
  CAST(COALESCE((SELECT completed FROM best), 0) AS BIGINT) AS top_completed, {ca('(SELECT SUM(total) FROM monthly)')} AS collected,
  CAST((SELECT SUM(n) FROM monthly) AS BIGINT) AS payments,
  {ca('(SELECT SUM(GREATEST(calculated, 0)) FROM balance WHERE charged > 0)')} AS outstanding,
  (SELECT COUNT(*) FROM balance WHERE charged > 0 AND calculated >= 40) AS customers_to_chase""",
    ),
    "balance_drift": (
        BALANCE,
        f"""
SELECT customer_id, customer_name, {money('charged')} AS total_charged, {money('paid')} AS total_paid,
  {money('calculated')} AS calculated_outstanding, {money('stored')} AS stored_outstanding, {money('calculated - stored')} AS drift
FROM balance WHERE calculated <> stored""",
    ),
    "booking_batch": (
        BOOKED,
        """
SELECT request_id, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN (SELECT MAX(lesson_id) FROM d_lessons) + row_number() OVER (PARTITION BY reason IS NULL ORDER BY request_id) END AS lesson_id
FROM answer""",
    ),
    "booked_lessons": (
        BOOKED,
        f"""
SELECT (SELECT MAX(lesson_id) FROM d_lessons) + row_number() OVER (ORDER BY r.request_id) AS lesson_id, r.customer_id,
  'BOOK' AS lesson_status_code, r.staff_id, r.vehicle_id, r.lesson_date, r.lesson_time_sec, {money('r.price')} AS price,
  CAST(NULL AS VARCHAR) AS other_lesson_details
FROM answer a JOIN d_booking_requests r USING (request_id) WHERE a.reason IS NULL""",
    ),
    "booking_balances": (
        BOOKED,
        f"""
SELECT r.customer_id, {money('MAX(c.amount_outstanding)')} AS opening, {money('MAX(c.amount_outstanding) + SUM(r.price)')} AS balance
FROM answer a JOIN d_booking_requests r USING (request_id) JOIN d_customers c ON c.customer_id = r.customer_id
WHERE a.reason IS NULL GROUP BY 1""",
    ),
    "cancellation_batch": (
        CANCELLED,
        f"""
SELECT request_id, lesson_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN {money('fee')} END AS fee FROM answer""",
    ),
    "cancellation_balances": (
        CANCELLED,
        f"""
SELECT a.customer_id, {money('MAX(c.amount_outstanding)')} AS opening,
  {money('GREATEST(0, MAX(c.amount_outstanding) - SUM(a.price - CAST(a.fee AS DECIMAL(10,2))))')} AS balance
FROM answer a JOIN d_customers c ON c.customer_id = a.customer_id WHERE a.reason IS NULL GROUP BY 1""",
    ),
    "lesson_update_batch": (
        UPDATED,
        "SELECT j.request_id, j.lesson_id, v.reason IS NULL AS ok, v.reason FROM judged j JOIN verdict v USING (request_id)",
    ),
    "apply_lesson_changes": (
        UPDATED
        + """, done AS (
  SELECT j.* REPLACE (COALESCE(j.lesson_status_code, v.found) AS lesson_status_code) FROM judged j JOIN verdict v USING (request_id)
  WHERE v.reason IS NULL QUALIFY row_number() OVER (PARTITION BY j.lesson_id ORDER BY j.request_id DESC) = 1)""",
        f"""
SELECT l.lesson_id, CASE WHEN d.lesson_id IS NULL THEN l.customer_id ELSE d.customer_id END AS customer_id,
  COALESCE(d.lesson_status_code, l.lesson_status_code) AS lesson_status_code,
  CASE WHEN d.lesson_id IS NULL THEN l.staff_id ELSE d.staff_id END AS staff_id,
  CASE WHEN d.lesson_id IS NULL THEN l.vehicle_id ELSE d.vehicle_id END AS vehicle_id,
  COALESCE(d.lesson_date, l.lesson_date) AS lesson_date, COALESCE(d.lesson_time_sec, l.lesson_time_sec) AS lesson_time_sec,
  {money('COALESCE(d.price, l.price)')} AS price, CASE WHEN d.lesson_id IS NULL THEN l.other_lesson_details ELSE d.other_lesson_details END AS other_lesson_details
FROM d_lessons l LEFT JOIN done d ON d.lesson_id = l.lesson_id""",
    ),
    "lesson_audit": (AUDIT, "SELECT * FROM audit"),
    "lesson_delete": (
        AUDIT,
        """
SELECT l.lesson_id, l.lesson_status_code, (SELECT COUNT(*) FROM audit a WHERE a.lesson_id = l.lesson_id) AS audit_rows
FROM d_lessons l WHERE l.lesson_status_code <> 'CANC'""",
    ),
    "slot_conflicts": (
        "",
        """
SELECT 'staff' AS conflict, l.lesson_id, l.staff_id AS resource_id, l.lesson_date, l.lesson_time_sec, l.lesson_status_code, COUNT(*) AS other_lessons
FROM d_lessons l JOIN d_lessons o ON o.staff_id = l.staff_id AND o.lesson_date = l.lesson_date AND o.lesson_time_sec = l.lesson_time_sec
  AND o.lesson_id <> l.lesson_id AND o.lesson_status_code <> 'CANC' GROUP BY ALL
UNION ALL
SELECT 'vehicle', l.lesson_id, l.vehicle_id, l.lesson_date, l.lesson_time_sec, l.lesson_status_code, COUNT(*)
FROM d_lessons l JOIN d_lessons o ON o.vehicle_id = l.vehicle_id AND o.lesson_date = l.lesson_date AND o.lesson_time_sec = l.lesson_time_sec
  AND o.lesson_id <> l.lesson_id AND o.lesson_status_code <> 'CANC' GROUP BY ALL""",
    ),
    "payment_batch": (RECORDED, "SELECT request_id, reason IS NULL AS ok, reason FROM answer"),
    "recorded_payments": (
        RECORDED,
        f"""
SELECT customer_id, datetime_payment, payment_method_code, {money('amount')} AS amount_payment, details AS other_payment_details
FROM answer WHERE reason IS NULL""",
    ),
    "payment_balances": payment_balances(2),
    "payment_balances_once": payment_balances(1),
    "payment_correction": (
        CORRECTED,
        f"SELECT request_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN {money('old_amount')} END AS old_amount FROM answer",
    ),
    "payment_correction_balances": (
        CORRECTED
        + """,
steps AS (
  SELECT a.customer_id, c.amount_outstanding AS opening, a.old_amount - a.amount AS change,
    row_number() OVER (PARTITION BY a.customer_id ORDER BY a.request_id) AS turn
  FROM answer a JOIN d_customers c ON c.customer_id = a.customer_id WHERE a.reason IS NULL),"""
        + clamped("steps"),
        f"""
SELECT s.customer_id, {money('s.opening')} AS opening, {money('w.balance')} AS balance
FROM (SELECT customer_id, opening, MAX(turn) AS turn FROM steps GROUP BY 1, 2) s JOIN walk w USING (customer_id, turn)""",
    ),
    "apply_payment_corrections": (
        CORRECTED,
        f"""
SELECT p.customer_id, COALESCE(a.new_datetime, p.datetime_payment) AS datetime_payment,
  COALESCE(a.payment_method_code, p.payment_method_code) AS payment_method_code, {money('COALESCE(a.amount, p.amount_payment)')} AS amount_payment,
  CASE WHEN a.request_id IS NULL THEN p.other_payment_details ELSE a.details END AS other_payment_details
FROM d_payments p LEFT JOIN (
  SELECT * FROM answer WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY customer_id, stored_datetime ORDER BY request_id DESC) = 1) a
  ON a.customer_id = p.customer_id AND a.stored_datetime = p.datetime_payment""",
    ),
    "running_balance": (
        STEPS + "," + clamped("steps"),
        f"""
SELECT s.customer_id, s.step_at, s.kind, s.ref, {money('s.change')} AS change, {money('w.balance')} AS balance
FROM steps s JOIN walk w USING (customer_id, turn)""",
    ),
    "address_resolve": (ADDRESS_MATCH.format(requests="d_address_requests"), ADDRESS_SELECT),
    "customer_onboarding": (
        customer_changes("'add'", "CAST(NULL AS BIGINT)"),
        "SELECT request_id, reason IS NULL AS ok, reason, customer_id, address_id, email AS email_address FROM answer",
    ),
    "customer_change_batch": (
        customer_changes("op", "customer_id"),
        "SELECT request_id, op, reason IS NULL AS ok, reason, customer_id, address_id FROM answer",
    ),
    "apply_customer_changes": (
        customer_changes("op", "customer_id")
        + """,
gone AS (SELECT customer_id FROM answer WHERE reason IS NULL AND op = 'delete'),
put AS (
  SELECT * FROM answer WHERE reason IS NULL AND op <> 'delete' AND customer_id NOT IN (SELECT customer_id FROM gone WHERE customer_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY request_id DESC) = 1)""",
        f"""
SELECT c.customer_id, c.customer_address_id, c.customer_status_code, c.date_became_customer, c.date_of_birth, c.first_name, c.last_name,
  {money('c.amount_outstanding')} AS amount_outstanding, c.email_address, c.phone_number, c.cell_mobile_phone_number, c.other_customer_details
FROM d_customers c WHERE c.customer_id NOT IN (SELECT customer_id FROM gone) AND c.customer_id NOT IN (SELECT customer_id FROM put)
UNION ALL
SELECT p.customer_id, p.address_id, p.customer_status_code, p.date_became_customer, p.date_of_birth, p.first_name, p.last_name,
  {money('COALESCE(c.amount_outstanding, 0)')}, p.email, c.phone_number, p.cell, c.other_customer_details
FROM put p LEFT JOIN d_customers c ON c.customer_id = p.customer_id WHERE p.op = 'add' OR c.customer_id IS NOT NULL""",
    ),
    "created_addresses": (
        customer_changes("op", "customer_id"),
        """
SELECT address_id, l1 AS line_1_number_building, l2 AS line_2_number_street, l3 AS line_3_area_locality, city, zip AS zip_postcode,
  prov AS state_province_county, land AS country, CAST(NULL AS VARCHAR) AS other_address_details
FROM placed WHERE found IS NULL""",
    ),
    "customer_delete": (
        "",
        """
SELECT r.request_id, r.customer_id, l.customer_id IS NULL AS ok, CASE WHEN l.customer_id IS NOT NULL THEN 'has_lessons' END AS reason,
  CASE WHEN l.customer_id IS NULL AND r.turn = 1 THEN (SELECT COUNT(*) FROM d_payments p WHERE p.customer_id = r.customer_id) ELSE 0 END AS payments_removed,
  CASE WHEN l.customer_id IS NULL AND r.turn = 1 THEN (SELECT COUNT(*) FROM d_app_users u WHERE u.customer_id = r.customer_id) ELSE 0 END AS users_unlinked
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY request_id) AS turn FROM d_payment_requests) r LEFT JOIN (SELECT DISTINCT customer_id FROM d_lessons) l ON l.customer_id = r.customer_id""",
    ),
    "staff_change_batch": (STAFF_ANSWER, "SELECT request_id, op, reason IS NULL AS ok, reason, staff_id FROM answer"),
    "apply_staff_changes": (
        STAFF_ANSWER,
        """
SELECT * FROM d_staff s WHERE s.staff_id NOT IN (SELECT staff_id FROM answer WHERE reason IS NULL)
UNION ALL
SELECT a.staff_id, NULL, a.customer_status_code, NULL, a.first_name, NULL, a.last_name, NULL, a.date_joined_staff, a.date_left_staff, 'changed'
FROM answer a WHERE a.reason IS NULL AND a.op <> 'delete'
  AND NOT EXISTS (SELECT 1 FROM answer b WHERE b.staff_id = a.staff_id AND b.reason IS NULL AND (b.op = 'delete' OR b.request_id > a.request_id))""",
    ),
    "staff_delete": (
        BOUND,
        """
SELECT l.lesson_id, CASE WHEN l.staff_id IN (SELECT staff_id FROM d_staff WHERE date_left_staff IS NOT NULL AND staff_id NOT IN (SELECT staff_id FROM bound)) THEN NULL ELSE l.staff_id END AS staff_id
FROM d_lessons l""",
    ),
    "login_lockout": (SIGN_IN, "SELECT attempt_id, email, user_id, detail = 'ok' AS success, detail, attempted_at FROM ruled"),
    "login_lockout_resets": (
        sign_in("a.attempt_id % 40 = 7"), "SELECT attempt_id, email, user_id, detail = 'ok' AS success, detail, attempted_at FROM ruled"
    ),
    "account_states": (
        SIGN_IN
        + """,
ended AS (SELECT email, MAX(turn) AS turn, MAX(moment) FILTER (WHERE detail = 'ok') AS good FROM walk WHERE turn > 0 GROUP BY 1)""",
        """
SELECT u.user_id, e.email, w.failures AS failed_attempts, w.until AS locked_until, e.good AS last_login_at
FROM ended e JOIN walk w USING (email, turn) JOIN d_app_users u ON u.email = e.email""",
    ),
    "role_assign_batch": (
        ROLE_ANSWER,
        """
SELECT request_id, user_id, role_code, reason IS NULL AS ok, reason,
  CASE WHEN reason = 'user_missing' THEN '{"ok":false,"message":"No such user."}' WHEN reason = 'role_missing' THEN '{"ok":false,"message":"No such role."}'
    WHEN action = 'assign' THEN '{"ok":true,"message":"Role assigned."}' ELSE '{"ok":true,"message":"Role revoked."}' END AS result
FROM answer""",
    ),
    "role_holdings": (
        ROLE_ANSWER
        + """,
cut AS (SELECT user_id, role_code, MAX(request_id) AS last_cut FROM answer WHERE reason IS NULL AND action = 'revoke' GROUP BY 1, 2),
given AS (
  SELECT a.user_id, a.role_code, arg_min(a.requested_at, a.request_id) AS assigned_at
  FROM answer a LEFT JOIN cut c ON c.user_id = a.user_id AND c.role_code = a.role_code
  WHERE a.reason IS NULL AND a.action = 'assign' AND a.request_id > COALESCE(c.last_cut, -1) GROUP BY 1, 2),
kept AS (SELECT g.* FROM d_app_user_roles g WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.user_id = g.user_id AND c.role_code = g.role_code))""",
        """
SELECT user_id, role_code, assigned_at FROM kept
UNION ALL
SELECT g.user_id, g.role_code, g.assigned_at FROM given g
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.user_id = g.user_id AND k.role_code = g.role_code)""",
    ),
    "account_onboarding": (
        REGISTERED,
        """
SELECT request_id, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN (SELECT MAX(user_id) FROM d_app_users) + row_number() OVER (PARTITION BY reason IS NULL ORDER BY request_id) END AS user_id,
  email, full_name, role_code FROM final""",
    ),
    "registered_users": (
        REGISTERED,
        f"""
SELECT (SELECT MAX(user_id) FROM d_app_users) + row_number() OVER (ORDER BY request_id) AS user_id, email, full_name, true AS is_active,
  CAST(0 AS BIGINT) AS failed_attempts, {NOW} AS created_at FROM final WHERE reason IS NULL""",
    ),
    "registered_roles": (
        REGISTERED,
        f"""
SELECT (SELECT MAX(user_id) FROM d_app_users) + row_number() OVER (ORDER BY request_id) AS user_id, role_code, {NOW} AS assigned_at
FROM final WHERE reason IS NULL""",
    ),
    "user_delete": (
        REMOVED,
        "SELECT request_id, user_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN email END AS email FROM answer",
    ),
    "user_delete_remaining": (
        REMOVED + ", " + ROLE_TEXT,
        """
SELECT u.user_id, u.email, COALESCE(t.roles, '') AS roles FROM d_app_users u LEFT JOIN role_text t USING (user_id)
WHERE u.user_id NOT IN (SELECT user_id FROM answer WHERE reason IS NULL)""",
    ),
    "dq_duplicate_keys": ("", duplicate_keys()),
    "dq_orphans": ("", orphans()),
    "dq_nulls": ("", nulls()),
    "dq_checks": ("", checks()),
    "dq_lengths": ("", lengths()),
    "stream_balance": (
        PAID,
        f"""
SELECT c.customer_id, {money('c.amount_outstanding')} AS opening, {money('GREATEST(0, c.amount_outstanding - p.total)')} AS balance
FROM d_customers c JOIN paid p USING (customer_id)""",
    ),
    "stream_monthly_revenue": (
        MONTHLY,
        f"SELECT pay_month, method, n AS num_payments, {money('total')} AS total_collected FROM monthly",
    ),
    "stream_lesson_audit": (AUDIT, "SELECT * FROM audit"),
    "stream_login_lockout": (SIGN_IN, "SELECT attempt_id, email, detail FROM ruled"),
    "stream_booking": (BOOKED, "SELECT request_id, reason IS NULL AS ok, reason FROM answer"),
}


def oracle_sql() -> dict[str, str]:
    return {name: compose(ctes, select) for name, (ctes, select) in BODIES.items()}
