"""A stream fed in several files gives what the batch job gives."""

import pytest
from pyspark.sql import functions as F

from tallyslot.catalog import CLOCK, TEST_LOCK_MINUTES
from tallyslot.plans import accounts as A
from tallyslot.plans import lessons as L
from tallyslot.plans import views as V
from tallyslot.sources.binding import bind_star_schema
from tallyslot.streaming import jobs as J
from tests.compare import DATA

ROOT = f"{DATA}/sf0.001"


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(tuple, a.select(columns).collect()), key=repr) == sorted(map(tuple, b.select(columns).collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark):
    return bind_star_schema(spark, ROOT)


@pytest.fixture(scope="module")
def live_events(spark, tmp_path_factory):
    return _live(spark, tmp_path_factory, "events", "ts")


@pytest.fixture(scope="module")
def live_orders(spark, tmp_path_factory):
    return _live(spark, tmp_path_factory, "orders", "o_orderkey")


def _live(spark, tmp_path_factory, table, order):
    """A folder of part files, one admitted per trigger, oldest first, beside a table whose name begins alike."""
    import os
    import time

    folder = str(tmp_path_factory.mktemp(table))
    rows = spark.read.parquet(f"{ROOT}/{table}.parquet").toPandas().sort_values(order)
    for other in ("supplier", "part"):
        os.symlink(f"{ROOT}/{other}.parquet", f"{folder}/{other}.parquet")
    os.symlink(f"{ROOT}/{table}.parquet", f"{folder}/{table}_archive.parquet")
    os.mkdir(f"{folder}/{table}.parquet")
    step = len(rows) // 4 + 1
    now = time.time()
    for i in range(4):
        name = f"{folder}/{table}.parquet/part-{i}.parquet"
        rows.iloc[i * step : (i + 1) * step].to_parquet(name, coerce_timestamps="us", index=False)
        os.utime(name, (now - 100 + i, now - 100 + i))
    return bind_star_schema(spark, folder, streamed=(table,), files_per_trigger=1)


def test_stream_balance(stored, live_events):
    got = J.stream_balance(stored.replace(payments=live_events.payments))
    paid = stored.payments.groupBy("customer_id").agg(F.sum("amount_payment").alias("paid"))
    want = stored.customers.join(paid, "customer_id").select(
        "customer_id", F.col("amount_outstanding").alias("opening"),
        F.greatest(F.lit(0), F.col("amount_outstanding") - F.col("paid")).cast("decimal(28,2)").alias("balance"),
    )
    same(got, want)


def test_stream_monthly_revenue(stored, live_events):
    same(J.stream_monthly_revenue(stored.replace(payments=live_events.payments)), V.monthly_revenue(stored))


def test_stream_lockout(stored, live_events):
    got = J.stream_login_lockout(stored, live_events.login_attempts, TEST_LOCK_MINUTES)
    same(got, A.sign_in(stored, stored.login_attempts, TEST_LOCK_MINUTES).select("attempt_id", "email", "detail"))


def test_stream_lockout_with_new_passwords(stored, live_events):
    def marked(df):
        return df.withColumn("reset", F.col("attempt_id") % 40 == 7)

    got = J.stream_login_lockout(stored, marked(live_events.login_attempts), TEST_LOCK_MINUTES)
    same(got, A.sign_in(stored, marked(stored.login_attempts), TEST_LOCK_MINUTES).select("attempt_id", "email", "detail"))


def test_stream_audit(stored, live_orders):
    same(J.stream_lesson_audit(live_orders.lesson_versions), L.status_audit(stored.lesson_versions))


def test_stream_booking(stored, live_orders):
    got = J.stream_booking(stored, live_orders.booking_requests, CLOCK)
    same(got, L.book(stored, stored.booking_requests, CLOCK).select("request_id", "ok", "reason"))


def test_a_stream_to_which_nothing_came(spark, stored, tmp_path):
    for name in ("supplier", "part", "events"):
        spark.read.parquet(f"{ROOT}/{name}.parquet").limit(0 if name == "events" else 5).write.parquet(f"{tmp_path}/{name}.parquet")
    live = bind_star_schema(spark, str(tmp_path), streamed=("events",))
    assert J.stream_monthly_revenue(stored.replace(payments=live.payments)).count() == 0


def test_expiring_slots_answer_the_same(spark, stored, live_orders):
    """A stream that runs on, with slot timeouts set; stopped once every answer is there."""
    import time

    want = L.book(stored, stored.booking_requests, CLOCK).select("request_id", "reason")
    n = want.count()
    query = (
        J.booking_answers(stored, live_orders.booking_requests, CLOCK, expire=True)
        .writeStream.outputMode("append").format("memory").queryName("expiring").start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and query.isActive and spark.table("expiring").count() < n:
            time.sleep(1)
    finally:
        query.stop()
    same(spark.table("expiring"), want)


def test_a_kept_result_stays_small_and_replays_change_nothing(spark, tmp_path):
    """Forty triggers leave a bounded number of folders; a replayed trigger, merged or not, changes nothing."""
    from tallyslot.streaming.sink import KeyedSink

    shape = spark.createDataFrame([], "k long, v long, w string")
    sink, want = KeyedSink(spark, str(tmp_path / "out"), shape.schema, ["k"], every=4), {}
    assert sink.read().count() == 0

    def batch(n):
        return spark.range(n % 5, n % 5 + 3, 1, 1).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("v"), F.lit(None).cast("string").alias("w"))

    for n in range(40):
        sink.write(batch(n), n)
        want |= {k: n for k in range(n % 5, n % 5 + 3)}
        if n in (2, 13, 38):
            for again in (n, max(0, n - 4)):  # the last one, and one that is merged or older
                sink.write(batch(again), again) if again == n or n > 4 else None
            assert {r.k: r.v for r in sink.read().collect()} == want
    assert {r.k: r.v for r in sink.read().collect()} == want
    folders = {kind: len(list((tmp_path / "out" / kind).iterdir())) for kind in ("base", "changes")}
    assert folders["base"] <= 2 and folders["changes"] <= 8
