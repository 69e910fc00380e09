"""Batches in which requests depend on each other, against handling the requests one by one."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyslot.operators import replay as replaying
from tallyslot.operators.components import components
from tallyslot.operators.keyed import HotKeys, flag_known, look_up
from tallyslot.operators.replay import sharing
from tallyslot.operators.slices import cut_by_rank
from tallyslot.plans import lessons as L
from tallyslot.plans import payments as P
from tallyslot.plans import people as PE
from tallyslot.settings import Scale
from tallyslot.sources.dataset import conform
from tests.seed import seed_dataset

#: One ordered pass; rounds and components, with hot keys split.
SCALES = [Scale(), Scale(ordered_rows=20, hot_rows=15)]
DAY = dt.date(2026, 7, 1)


@pytest.fixture(scope="module")
def ds(spark):
    return seed_dataset(spark)


# --- lesson updates -------------------------------------------------------------
LESSON = "lesson_id long, customer_id long, lesson_status_code string, staff_id long, vehicle_id long, lesson_date date, lesson_time_sec int, price decimal(10,2), other_lesson_details string"
UPDATE = "request_id long, lesson_id long, customer_id long, staff_id long, vehicle_id long, lesson_date date, lesson_time_sec int, price decimal(10,2), other_lesson_details string, lesson_status_code string"


def lesson_rows(spark, rows):
    return conform(spark.createDataFrame(rows, LESSON), "lessons")


def update_loop(lessons, requests):
    """One update after the other on a plain dict."""
    state, out = {r[0]: list(r) for r in lessons}, {}
    for r in sorted(requests, key=lambda r: r[0]):
        rid, lid, customer, staff, vehicle, day, second, price, note, status = r
        mine = state.get(lid)
        others = [o for o in state.values() if o[0] != lid and o[2] != "CANC" and (o[5], o[6]) == (day, second)]
        if day is None or second is None:
            reason = "date_time_required"
        elif mine is None:
            reason = "lesson_missing"
        elif staff is not None and any(o[3] == staff for o in others):
            reason = "staff_conflict"
        elif vehicle is not None and any(o[4] == vehicle for o in others):
            reason = "vehicle_conflict"
        elif price is None or price < 0:
            reason = "price_invalid"
        elif customer > 8 or (staff or 0) > 6 or (vehicle or 0) > 6 or status == "NOPE":
            reason = "unknown_reference"
        else:
            reason = None
        out[rid] = (reason, None if reason == "date_time_required" and mine is None else mine and mine[2])
        if reason is None:
            state[lid] = [lid, customer, status or mine[2], staff, vehicle, day, second, price, note]
    return out, state


def check_updates(spark, ds, lessons, requests, scale):
    d = ds.replace(lessons=lesson_rows(spark, lessons))
    done = L.update_lessons(d, spark.createDataFrame(requests, UPDATE), scale)
    want, state = update_loop(lessons, requests)
    rows = done.collect()
    assert len(rows) == len(requests)
    assert {r.request_id: r.reason for r in rows} == {k: v[0] for k, v in want.items()}
    assert {r.request_id: r.old_status for r in rows if r.ok} == {k: v[1] for k, v in want.items() if v[0] is None}
    after = {r.lesson_id: [r[c.split()[0]] for c in LESSON.split(", ")] for r in L.updated_lessons(d, done).collect()}
    assert after == {k: [float(x) if hasattr(x, "quantize") else x for x in v] for k, v in state.items()} or {
        k: list(map(str, v)) for k, v in after.items()
    } == {k: list(map(str, v)) for k, v in state.items()}
    return Counter(v[0] for v in want.values())


@pytest.mark.parametrize("scale", SCALES)
def test_updates_equal_loop(spark, ds, scale):
    """Several updates per lesson, swaps, freed slots, cancelled and re-opened lessons, stored double bookings, faults first."""
    from decimal import Decimal

    rng = random.Random(11)

    def place():
        return rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3, 4]), DAY + dt.timedelta(rng.randrange(4)), rng.choice([32400, 36000])

    lessons = [(i, 1 + i % 8, rng.choice(["BOOK", "CONF", "CANC"]), *place(), Decimal("50.00"), "n") for i in range(1, 26)]
    requests = []
    for i in range(1, 121):
        staff, vehicle, day, second = place()
        requests.append((
            i, rng.choice([*range(1, 26), *range(1, 6), 99]), rng.choice([1, 2, 3, 4, 5, 6, 7, 77]) if rng.random() < 0.2 else 1, rng.choice([staff, staff, staff, 60]),
            vehicle, None if rng.random() < 0.03 else day, second, rng.choice([Decimal("60.00")] * 9 + [Decimal("-1.00"), None]),
            f"c{i}", rng.choice([None, None, "CANC", "CONF", "BOOK", "NOPE"]),
        ))
    found = check_updates(spark, ds, lessons, requests, scale)
    assert min(found[None], found["staff_conflict"], found["vehicle_conflict"]) > 5


def test_a_slot_is_handed_along_a_chain(spark, ds):
    """Every lesson takes the slot that the one before it has just left; one broken link stops all behind it."""
    from decimal import Decimal

    n, scale = 60, Scale(ordered_rows=20)
    lessons = [(i, 1, "BOOK", 1, None, DAY + dt.timedelta(i), 32400, Decimal("50.00"), None) for i in range(n)]
    requests = [
        (i, n - i, 1, 1, None, DAY + dt.timedelta(n - i + 1), 32400, Decimal("-1.00" if i == 40 else "55.00"), None, None) for i in range(1, n)
    ]
    found = check_updates(spark, ds, lessons, requests, scale)
    assert found == {None: 39, "price_invalid": 1, "staff_conflict": n - 41}


# --- payment corrections --------------------------------------------------------
CORRECTION = "request_id long, customer_id long, original_datetime timestamp_ntz, new_datetime timestamp_ntz, payment_method_code string, amount decimal(10,2), details string"
START = dt.datetime(2025, 1, 1)


def at(i):
    return START + dt.timedelta(minutes=i, microseconds=i % 7)


def correction_loop(stored, requests):
    book, out = {(c, w): [w, a, m, n] for c, w, m, a, n in stored}, {}
    for rid, c, here, there, method, amount, note in sorted(requests, key=lambda r: r[0]):
        row = book.get((c, here))
        if amount is not None and amount <= 0:
            reason = "amount_not_positive"
        elif method != "CARD" and method != "CASH":
            reason = "method_unknown"
        elif row is None:
            reason = "payment_not_found"
        elif amount is None:
            reason = "amount_null"
        elif here != there and (c, there) in book:
            reason = "duplicate_key"
        else:
            reason = None
        out[rid] = (reason, row[1] if reason is None else None)
        if reason is None:
            book[c, there] = [book.pop((c, here))[0], amount, method, note]
    return out, {(c, w, v[2], v[1], v[3]) for (c, w), v in book.items()}


def check_corrections(spark, ds, stored, requests, scale):
    table = spark.createDataFrame(
        stored, "customer_id long, datetime_payment timestamp_ntz, payment_method_code string, amount_payment decimal(10,2), other_payment_details string"
    )
    d = ds.replace(payments=conform(table, "customer_payments") if "customer_payments" in ds.names() else table)
    done = P.correct(d, spark.createDataFrame(requests, CORRECTION), scale)
    want, after = correction_loop(stored, requests)
    assert {r.request_id: (r.reason, r.old_amount) for r in done.collect()} == want
    assert {tuple(r) for r in P.corrected_payments(d, done).collect()} == after
    owed = {}
    for rid, c, _, _, _, amount, _ in sorted(requests):
        if want[rid][0] is None:
            owed[c] = max(0, owed.get(c, 0) + want[rid][1] - amount)
    zero = d.replace(customers=d.customers.withColumn("amount_outstanding", F.lit(0).cast("decimal(10,2)")))
    assert {r.customer_id: r.balance for r in P.correction_balances(zero, done, scale).collect()} == owed
    return Counter(v[0] for v in want.values())


@pytest.mark.parametrize("scale", SCALES)
def test_corrections_equal_loop(spark, ds, scale):
    from decimal import Decimal

    rng = random.Random(12)
    stored = [(c, at(i), "CARD", Decimal(10 + i), f"s{i}") for c in (1, 2, 3) for i in range(0, 12, 2)]
    requests = [
        (i, rng.choice([1, 1, 2, 3]), at(rng.randrange(14)), at(rng.randrange(14)), rng.choice(["CARD"] * 8 + ["CASH", "NO"]),
         rng.choice([Decimal(5), Decimal(70), Decimal(0), None, Decimal(30)]), rng.choice([None, f"n{i}"]))
        for i in range(1, 180)
    ]
    requests = [r if rng.random() < 0.7 else (*r[:3], r[2], *r[4:]) for r in requests]
    found = check_corrections(spark, ds, stored, requests, scale)
    assert min(found[None], found["duplicate_key"], found["payment_not_found"]) > 5


@pytest.mark.parametrize("scale,n", [(Scale(), 1000), (Scale(ordered_rows=50), 100)])
def test_an_instant_is_handed_along_a_chain(spark, ds, scale, n):
    """Hand-overs from the last payment back, one refused in the middle; a cycle of three cannot turn."""
    from decimal import Decimal

    stored = [(1, at(i), "CARD", Decimal(20), None) for i in range(n)] + [(2, at(i), "CARD", Decimal(20), None) for i in range(3)]
    requests = [(i, 1, at(n - i), at(n - i + 1), "CARD", Decimal(0 if i == n // 2 else 21), None) for i in range(1, n + 1)]
    requests += [(n + 1 + i, 2, at(i), at((i + 1) % 3), "CARD", Decimal(21), None) for i in range(3)]
    found = check_corrections(spark, ds, stored, requests, scale)
    assert found == {None: n // 2 - 1, "amount_not_positive": 1, "duplicate_key": n - n // 2 + 3}


def test_customers_are_replayed_without_linking(spark, monkeypatch):
    """Customers that never share an instant need no links, however many requests there are in all."""
    found = []
    monkeypatch.setattr(replaying, "components", lambda *a: found.append(a) or components(*a))
    rows = [(i, f"c{i % 7}", "a", "a", "1.00", "5.00", "5.00") for i in range(40)]
    ddl = "request_id long, ask struct<customer:string,here:string,there:string,amount:string,here_paid:string,there_paid:string>"
    df = spark.createDataFrame([(r[0], r[1:]) for r in rows], ddl)
    got = {r.request_id: r.old_amount for r in replaying.replay(df, P._Corrections(), Scale(ordered_rows=10), within="customer").collect()}
    assert got == {i: "5.00" if i < 7 else "1.00" for i in range(40)} and not found
    # a customer of more requests than that is taken apart as before
    got = {r.request_id: r.old_amount for r in replaying.replay(df, P._Corrections(), Scale(ordered_rows=5), within="customer").collect()}
    assert got == {i: "5.00" if i < 7 else "1.00" for i in range(40)} and found


# --- customer changes -----------------------------------------------------------
CHANGE = "request_id long, op string, customer_id long, first_name string, last_name string, date_of_birth date, date_became_customer date, customer_status_code string, email_address string"


def change_loop(customers, with_lessons, requests):
    mail, out = dict(customers), {}
    fresh = max(mail)
    for rid, op, cid, first, _, _, _, status, email in sorted(requests, key=lambda r: r[0]):
        held = [c for c, e in mail.items() if e == email and email is not None and c != cid]
        if op == "delete" and cid in with_lessons:
            reason = "has_lessons"
        elif op != "delete" and not first:
            reason = "required_missing"
        elif op == "delete" or (op == "update" and cid not in mail):
            reason = None
        elif status == "NOPE":
            reason = "status_unknown"
        else:
            reason = "email_taken" if held else None
        if reason is None and op == "add":
            fresh += 1
            cid = fresh
        out[rid] = (reason, cid if op != "add" or reason is None else None)
        if reason is None:
            if op == "delete":
                mail.pop(cid, None)
            elif op == "add" or cid in mail:
                mail[cid] = email
    return out, mail


def check_changes(spark, ds, customers, requests, scale):
    seen = ds.customers.limit(1).drop("customer_id", "email_address")
    table = seen.crossJoin(spark.createDataFrame(customers, "customer_id long, email_address string"))
    lessons = ds.lessons.where("lesson_id = 1").withColumn("customer_id", F.lit(1).cast("long"))
    d = ds.replace(customers=conform(table, "customers"), lessons=lessons)
    asked = spark.createDataFrame(requests, CHANGE)
    for c in ["cell_mobile_phone_number", *PE.ADDRESS]:
        asked = asked.withColumn(c, F.lit(None).cast("string"))
    done = PE.change_customers(d, asked, scale)
    want, mail = change_loop(customers, {1}, requests)
    assert {r.request_id: (r.reason, r.customer_id) for r in done.collect()} == want
    assert {r.customer_id: r.email_address for r in PE.changed_customers(d, done).collect()} == mail
    return Counter(v[0] for v in want.values())


@pytest.mark.parametrize("scale", SCALES)
def test_changes_equal_loop(spark, ds, scale):
    rng = random.Random(13)
    day = dt.date(2000, 1, 1)
    customers = [(i, f"m{i}@x.ca" if i % 4 else None) for i in range(1, 15)]
    requests = []
    for i in range(1, 170):
        op = rng.choice(["add", "update", "update", "delete"])
        requests.append((
            i, op, None if op == "add" else rng.choice([*range(1, 15), 99]), rng.choice(["A"] * 9 + [None]), "B", day, day,
            rng.choice(["ACT"] * 9 + ["NOPE"]), rng.choice([None, *[f"m{k}@x.ca" for k in range(1, 18)]]),
        ))
    found = check_changes(spark, ds, customers, requests, scale)
    assert min(found[None], found["email_taken"], found["has_lessons"]) > 2


def test_an_address_is_handed_along_a_chain(spark, ds):
    n, day = 100, dt.date(2000, 1, 1)
    customers = [(i, f"m{i}@x.ca") for i in range(1, n + 1)]
    requests = [(n + 1 - i, "update", i, None if i == 77 else "A", "B", day, day, "ACT", f"m{i + 1}@x.ca") for i in range(1, n + 1)]
    found = check_changes(spark, ds, customers, requests, Scale(ordered_rows=20))
    assert found == {None: n - 77, "required_missing": 1, "email_taken": 76}


# --- operators ------------------------------------------------------------------
def test_components_equal_union(spark):
    rng = random.Random(14)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 4000 + i) for i in range(50)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_sharing(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["c"]), (4, [])], "request_id long, keys array<string>")
    assert {r.request_id for r in sharing(df).collect()} == {1, 2}


def test_hot_keys_are_dealt_out(spark):
    """Two thirds of the rows share one key, a sixth has none: no task of the join gets more than a small share."""
    rows = [(i, 7 if i % 3 else None if i % 2 else i) for i in range(6000)]
    df = spark.createDataFrame(rows, "request_id long, k long").repartition(8)
    known = spark.range(0, 6000, 7).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("v")).groupBy("id").agg(F.sum("v").alias("v"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(kept, ("-1", "40", "false"), strict=True):
            spark.conf.set(c, v)
        hot = HotKeys(df, [["k"]], 50)
        met = look_up(df, ["k"], known, ["id"], hot, "request_id").withColumn("task", F.spark_partition_id())
        per_task = met.groupBy("task").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        got = {r.request_id: (r.k, r.v) for r in met.drop("task").collect()}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert per_task < 0.06 * len(rows)
    assert got == {i: (k, 1 if k is not None and k % 7 == 0 else None) for i, k in rows}


def test_doubled_known_rows_give_one_answer(spark, ds):
    """Duplicate customers, staff, vehicles, users, payments and codes: the fault that the quality job looks for."""
    from decimal import Decimal

    d = ds.replace(**{t: ds[t].unionByName(ds[t]) for t in ("customers", "staff", "vehicles", "payments", "payment_methods", "lesson_status", "customer_status")})
    asked = spark.createDataFrame([(1, 3, 1, 1, 1, DAY, 32400, Decimal(90), None, "CONF"), (2, 4, 1, 1, 1, DAY, 36000, Decimal(90), None, None)], UPDATE)
    assert {r.request_id: r.reason for r in L.update_lessons(d, asked).collect()} == {1: None, 2: None} and L.update_lessons(d, asked).count() == 2
    pays = spark.createDataFrame([(1, 1, at(1), "CARD", Decimal(5)), (2, 99, at(1), "CARD", Decimal(5))], "request_id long, customer_id long, datetime_payment timestamp_ntz, payment_method_code string, amount decimal(10,2)")
    assert [(r.request_id, r.reason) for r in P.record(d, pays).orderBy("request_id").collect()] == [(1, None), (2, "customer_missing")]
    paid = ds.payments.where("customer_id = 1").first()
    fix = spark.createDataFrame([(1, 1, paid.datetime_payment, paid.datetime_payment, "CARD", Decimal(5), None)], CORRECTION)
    assert [(r.reason, r.old_amount) for r in P.correct(d, fix).collect()] == [(None, paid.amount_payment)]
    df = spark.sql("SELECT * FROM VALUES (3, 'a'), (4, NULL) AS t(id, k)")
    known = spark.sql("SELECT * FROM VALUES ('a'), ('a') AS t(k2)")
    assert {(r.id, r.hit) for r in flag_known(df, "k", known, "k2", "hit").collect()} == {(3, True), (4, False)}


def test_slices_are_bounded_by_rows(spark):
    """Ten thousand steps of one instant are cut like any others."""
    rows = spark.range(10_000).select(F.lit(1).alias("k"), F.lit(5).alias("at"), "id")
    cut = cut_by_rank(rows, "k", ["at", "id"], 500, "test-slices")
    sizes = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_slice").collect()
    assert sum(r.n for r in sizes) == 10_000 and max(r.n for r in sizes) <= 500
    assert all(x.b < y.a for x, y in zip(sizes, sizes[1:], strict=False))
