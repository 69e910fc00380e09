"""Operators against plain loops, with limits set so low that the hot-key forms are used."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyslot.operators.balance import charge_only, final_balance, running_balance
from tallyslot.operators.keyed import apply_changes, flag_first, flag_known, insert_absent
from tallyslot.operators import slots
from tallyslot.operators.lockout import lockout
from tallyslot.operators.previous import with_previous
from tallyslot.operators.sequence import exact_percentiles, numbered, running_sum
from tallyslot.operators.slots import settle
from tallyslot.settings import Scale

PLAIN = Scale()
TINY = Scale(hot_rows=3, hot_slot_pairs=2, slice_bits=3)


# --- numbering and running sums ----------------------------------------------
@pytest.mark.parametrize("bits", [2, 5, 20])
def test_numbered_is_dense_and_ordered(spark, bits):
    ids = random.Random(1).sample(range(5000), 300)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.n for r in numbered(df, "id", "n", F.lit(40), bits).collect()}
    assert got == {i: 41 + k for k, i in enumerate(sorted(ids))}


def test_numbered_from_empty_start(spark):
    df = spark.createDataFrame([(5,), (9,)], "id long")
    start = spark.createDataFrame([], "id long").agg(F.max("id")).scalar()
    assert {r.id: r.n for r in numbered(df, "id", "n", start).collect()} == {5: 1, 9: 2}


def test_running_sum_by_key(spark):
    rng = random.Random(2)
    rows = [(k, o, rng.randint(-9, 9)) for k in range(3) for o in rng.sample(range(400), 60)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = {(r.k, r.o): r.s for r in running_sum(df, F.col("v"), "o", "s", ("k",), bits=3).collect()}
    for k in range(3):
        total = 0
        for _, o, v in sorted(r for r in rows if r[0] == k):
            total += v
            assert got[k, o] == total


@pytest.mark.parametrize("n", [1, 2, 7, 200])
def test_exact_percentiles(spark, n):
    rng = random.Random(n)
    cents = [rng.choice([0, 0, rng.randint(0, 90_000)]) for _ in range(n)]
    df = spark.createDataFrame([(c,) for c in cents], "c long").select(
        (F.col("c") / 100).cast("decimal(28,2)").alias("v")
    )
    got = exact_percentiles(df, "v", [0.75, 0.5, 0.0, 1.0], bits=4).collect()[0]
    want = np.percentile(np.array(cents) / 100, [75, 50, 0, 100])
    assert list(got) == pytest.approx(list(want), abs=1e-9)


def test_percentiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([], "v decimal(28,2)")
    assert list(exact_percentiles(df, "v", [0.5]).collect()[0]) == [None]


# --- clamped balances ---------------------------------------------------------
@pytest.mark.parametrize("scale", [PLAIN, TINY, Scale(hot_rows=25)])
def test_running_balance_equals_loop(spark, scale):
    rng = random.Random(3)
    rows = []
    for key in range(5):
        for i in range(2 if key == 0 else 80):
            at = rng.randint(0, 2000) if key % 2 else rng.randint(0, 40)
            rows.append((key, at, len(rows), rng.choice([10, 250]), rng.randint(-90, 60)))
    df = spark.createDataFrame(rows, "k long, us long, ref long, o long, c long").select(
        "k", "ref",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("us") / 1e6).cast("decimal(18,6)"))).alias("at"),
        F.col("c").cast("decimal(12,2)").alias("change"),
    )
    openings = spark.sql("SELECT id AS k, CAST(IF(id = 4, 0, 25) AS DECIMAL(10,2)) AS opening FROM range(9)")
    got = {r.ref: float(r.balance) for r in running_balance(df, "k", ["at", "ref"], openings, scale).collect()}
    assert len(got) == len(rows)
    ends = {}
    for key in range(5):
        b = 0 if key == 4 else 25
        for _, _, ref, _, c in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            b = max(0, b + c)
            assert got[ref] == b
        ends[key] = b
    assert {r.k: float(r.balance) for r in final_balance(df, "k", ["at", "ref"], openings, scale).collect()} == ends


def test_charge_only_clamps_once(spark):
    df = spark.sql("SELECT * FROM VALUES (1, -4.00), (1, -9.00), (2, -3.00) AS t(k, change)")
    openings = spark.sql("SELECT * FROM VALUES (1, 10.00), (2, 10.00), (3, 5.00) AS t(k, opening)")
    assert {r.k: float(r.balance) for r in charge_only(df, "k", openings).collect()} == {1: 0.0, 2: 7.0}


# --- previous version ---------------------------------------------------------
@pytest.mark.parametrize("scale", [PLAIN, TINY])
def test_with_previous(spark, scale):
    rng = random.Random(4)
    rows = [(k, v, rng.choice("abc")) for k in range(4) for v in rng.sample(range(90), 1 if k == 0 else 40)]
    df = spark.createDataFrame(rows, "k long, v long, s string")
    got = {(r.k, r.v): r.before for r in with_previous(df, "k", "v", "s", "before", scale).collect()}
    for k in range(4):
        before = None
        for _, v, s in sorted(r for r in rows if r[0] == k):
            assert got[k, v] == before
            before = s


# --- slots --------------------------------------------------------------------
def _settle_loop(rows):
    taken, out = {}, {}
    for rid, slot, s, v, takes in sorted(rows):
        staff, cars = taken.setdefault(slot, (set(), set()))
        if s is not None and s in staff:
            out[rid] = "staff_conflict"
        elif v is not None and v in cars:
            out[rid] = "vehicle_conflict"
        else:
            out[rid] = None
            if takes:
                staff.add(s)
                cars.add(v)
    return out


@pytest.mark.parametrize("scale", [PLAIN, Scale(hot_slot_pairs=1), Scale(hot_slot_pairs=15)])
def test_settle_equals_loop(spark, scale):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        slot = rng.choice([1, 1, 1, 2, 3])
        staff = rng.choice([None, *range(8)])
        car = rng.choice([None, *range(9)]) if slot < 3 else None
        rows.append((i, slot, staff, car, rng.random() < 0.85))
    df = spark.createDataFrame(rows, "request_id long, _slot long, staff_id long, vehicle_id long, takes_slot boolean")
    got = {r.request_id: r.slot_conflict for r in settle(df, scale).collect()}
    assert got == _settle_loop(rows)


def test_a_chain_shaped_slot_ends_in_few_rounds(spark, monkeypatch):
    """Each candidate waits for the one before it: the rounds give up and hand over to the ordered pass."""
    rows, labels = [], []
    real = slots.materialise
    monkeypatch.setattr(slots, "materialise", lambda df, label: labels.append(label) or real(df, label))
    for i in range(3000):
        rows.append((i, 1, (i + 1) // 2, i // 2, True))
    df = spark.createDataFrame(rows, "request_id long, _slot long, staff_id long, vehicle_id long, takes_slot boolean")
    got = {r.request_id: r.slot_conflict for r in settle(df, Scale(hot_slot_pairs=50)).collect()}
    assert got == _settle_loop(rows)
    assert labels.count("slot-won") <= 3


def test_settle_example_frees_staff_of_refused_vehicle(spark):
    rows = [(1, 7, 1, 5, True), (2, 7, 1, 6, True), (3, 7, 2, 6, True), (4, 7, 2, 7, True), (5, 7, None, 7, True)]
    df = spark.createDataFrame(rows, "request_id long, _slot long, staff_id long, vehicle_id long, takes_slot boolean")
    got = {r.request_id: r.slot_conflict for r in settle(df, PLAIN).collect()}
    assert [i for i, c in got.items() if c is None] == [1, 3, 5] or {i for i, c in got.items() if c is None} == {1, 3, 5}


# --- lockout ------------------------------------------------------------------
LOCK = 15 * 60 * 1_000_000


def _lockout_loop(rows):
    state, out = {}, {}
    for aid, email, at, good, f0, l0, reset in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        f, until = state.get(email, (f0, l0))
        if reset:
            f, until = 0, -1
            out[aid] = ("reset", f, until)
        elif until > at:
            out[aid] = ("locked", f, until)
        elif good:
            f, until = 0, -1
            out[aid] = ("ok", f, until)
        else:
            f += 1
            until = at + LOCK if f >= 5 else until
            out[aid] = ("bad password", f, until)
        state[email] = (f, until)
    return out


def _check_lockout(spark, rows, scale):
    df = spark.createDataFrame(
        rows, "attempt_id long, email string, at long, good boolean, failures_in long, locked_in long, reset boolean"
    ).withColumn("user_id", F.lit(1).cast("long"))
    done = lockout(df, 5, 15, scale).collect()
    want = _lockout_loop(rows)
    assert len(done) == len(rows)
    for r in done:
        status, failures, until = want[r.attempt_id]
        assert (r.status, r.failures) == (status, failures), r
        if status == "locked" or until > r.at:
            assert r.locked_until == until
    return want


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("scale", [PLAIN, TINY, Scale(hot_rows=40)])
def test_lockout_equals_loop(spark, seed, scale):
    """Dense and sparse attempts, ties, stored failures, stored locks and new passwords."""
    rng = random.Random(seed)
    rows = []
    for e in range(6):
        good_share = [0.0, 0.02, 0.1, 0.3, 0.6, 0.0][e]
        reset_share = [0.0, 0.01, 0.05, 0.1, 0.0, 0.004][e] if seed % 3 else 0.0
        step = [LOCK // 40, LOCK // 7, LOCK // 3, LOCK * 2, LOCK // 11, LOCK // 200][e]
        f0, l0 = rng.choice([0, 0, 3, 7]), rng.choice([-1, -1, LOCK * 3])
        at = 0
        for _ in range(2 if e == 3 and seed == 0 else 250):
            at += 0 if rng.random() < 0.1 else rng.randint(1, 2 * step)
            rows.append((len(rows), f"u{e}", at, rng.random() < good_share, f0, l0, rng.random() < reset_share))
    _check_lockout(spark, rows, scale)


def test_attack_inside_one_lock_period(spark):
    """Twenty thousand attempts in one lock period are many blocks; a new password inside it opens the account again."""
    n = 20_000
    rows = [(i, "u", 100 + i // 3, False, 0, -1, i == 15_001) for i in range(n)]
    rows.append((n, "u", 100 + LOCK + 10 + n, True, 0, -1, False))
    want = _check_lockout(spark, rows, Scale(hot_rows=1500))
    assert [want[i][0] for i in (4, 5, 15_000, 15_001, 15_002, 15_007, n)] == ["bad password", "locked", "locked", "reset", "bad password", "locked", "ok"]


# --- keyed operators ----------------------------------------------------------
def test_apply_changes_can_set_null(spark):
    base = spark.sql("SELECT * FROM VALUES (1, 'a', 'x'), (2, 'b', 'y'), (3, 'c', 'z') AS t(id, name, kept)")
    chg = spark.sql(
        "SELECT * FROM VALUES (1, 'update', CAST(NULL AS STRING)), (2, 'delete', NULL), (4, 'add', 'd'), (9, 'update', 'q') AS t(id, op, name)"
    )
    got = {tuple(r) for r in apply_changes(base, chg, "id").collect()}
    assert got == {(1, None, "x"), (3, "c", "z"), (4, "d", None)}


def test_flags_and_insert_absent(spark):
    df = spark.sql("SELECT * FROM VALUES (3, 'a'), (1, 'a'), (2, 'b'), (4, NULL) AS t(id, k)")
    assert {r.id for r in flag_first(df, ["k"], "id", "f").where("f").collect()} == {1, 2, 4}
    known = spark.sql("SELECT * FROM VALUES ('a'), ('a'), ('z') AS t(k2)")
    got = {r.id: r.hit for r in flag_known(df, "k", known, "k2", "hit").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    base = spark.sql("SELECT * FROM VALUES ('a', 1) AS t(k, n)")
    new = spark.sql("SELECT * FROM VALUES ('a', 2), ('b', 3) AS t(k, n)")
    assert {tuple(r) for r in insert_absent(base, new, ["k"]).collect()} == {("a", 1), ("b", 3)}
