"""Account jobs: sign-in lockout, roles, registration and removal. No password is ever read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot import settings as S
from tallyslot.functions import exprs as X
from tallyslot.operators.keyed import flag_first, flag_known, insert_absent
from tallyslot.operators.lockout import lockout
from tallyslot.operators.references import delete_rows
from tallyslot.operators.sequence import numbered
from tallyslot.settings import Clock, Scale
from tallyslot.sources.dataset import Dataset, conform
from tallyslot.sources.workdir import materialise

DEFAULT_ROLE, ADMIN = "STAFF", "ADMIN"
# --- fixed values: answer messages --------------------------------------------
NO_USER, NO_ROLE = "No such user.", "No such role."
ASSIGNED, REVOKED = "Role assigned.", "Role revoked."


# --- sign-in -----------------------------------------------------------------
def with_account(ds: Dataset, attempts: DataFrame) -> DataFrame:
    """Attempts with their account, its stored failure count and its stored lock (-1 for none)."""
    users = ds.app_users.select(
        F.col("email").alias("_email"), "user_id", "is_active",
        F.col("failed_attempts").cast("long").alias("failures_in"),
        F.coalesce(X.micros("locked_until"), F.lit(-1).cast("long")).alias("locked_in"),
    )
    email = X.normal_email("email")
    return attempts.withColumn("email", email).join(users, F.col("email") == F.col("_email"), "left").drop("_email")


def is_reset(rows: DataFrame) -> Column:
    """Rows that set a new password instead of trying one: those with a true ``reset``, where there is such a column."""
    return F.coalesce("reset", F.lit(False)) if "reset" in rows.columns else F.lit(False)


def _ruled(rows: DataFrame, lock_minutes: int, scale: Scale) -> DataFrame:
    live = rows.where(F.col("user_id").isNotNull() & (F.col("is_active") | is_reset(rows))).select(
        "attempt_id", "email", "user_id", X.micros("attempted_at").alias("at"), F.col("password_ok").alias("good"),
        is_reset(rows).alias("reset"), "failures_in", "locked_in",
    )
    return lockout(live, S.LOCK_AFTER_FAILURES, lock_minutes, scale)


def sign_in(
    ds: Dataset, attempts: DataFrame, lock_minutes: int = S.LOCK_MINUTES, scale: Scale = Scale()
) -> DataFrame:
    """Audit row of every attempt: ``attempt_id, email, user_id, success, detail, attempted_at``.

    Unknown and inactive accounts are told apart by the join; only attempts on
    live accounts go through the ordered lockout rule. Rows with a true ``reset``
    set a new password: they clear the account's count and lock and leave no
    audit row.
    """
    rows = with_account(ds, attempts)
    ruled = _ruled(rows, lock_minutes, scale).where("status <> 'reset'").select(
        "attempt_id", "email", "user_id", F.col("status").alias("detail"), X.from_micros("at").alias("attempted_at")
    )
    shut = F.when(F.col("user_id").isNull(), "no such user").when(~F.col("is_active"), "inactive")
    others = rows.withColumn("detail", shut).where(F.col("detail").isNotNull() & ~is_reset(rows))
    columns = ["attempt_id", "email", "user_id", (F.col("detail") == "ok").alias("success"), "detail", "attempted_at"]
    return ruled.select(*columns).unionByName(others.select(*columns))


def account_states(
    ds: Dataset, attempts: DataFrame, lock_minutes: int = S.LOCK_MINUTES, scale: Scale = Scale()
) -> DataFrame:
    """Failure count, lock and last good sign-in of accounts after the attempts."""
    ruled = _ruled(with_account(ds, attempts), lock_minutes, scale)
    last = F.struct("at", "attempt_id")
    ended = ruled.groupBy("user_id", "email").agg(
        F.max_by("failures", last).alias("failed_attempts"),
        F.max_by("locked_until", last).alias("_until"),
        F.max(F.when(F.col("status") == "ok", F.col("at"))).alias("_good"),
    )
    until = F.when(F.col("_until") >= 0, F.col("_until"))
    return ended.select(
        "user_id", "email", "failed_attempts", X.from_micros(until).alias("locked_until"),
        X.from_micros("_good").alias("last_login_at"),
    )


# --- roles -------------------------------------------------------------------
def change_roles(ds: Dataset, requests: DataFrame) -> DataFrame:
    """Answer role assignments and revocations: ``request_id, user_id, role_code, action, ok, reason, result``.

    Revoking always succeeds; assigning needs a known user and role. ``result``
    is the answer as JSON.
    """
    rows = requests.withColumn("role_code", F.upper("role_code"))
    rows = flag_known(rows, "user_id", ds.app_users, "user_id", "_user", row_id="request_id")
    rows = flag_known(rows, "role_code", ds.app_roles, "role_code", "_role", row_id="request_id")
    assigns = F.col("action") == "assign"
    reason = X.first_failure([("user_missing", assigns & ~F.col("_user")), ("role_missing", assigns & ~F.col("_role"))])
    ok = F.col("reason").isNull()
    message = (
        F.when(F.col("reason") == "user_missing", NO_USER)
        .when(F.col("reason") == "role_missing", NO_ROLE)
        .when(assigns, ASSIGNED)
        .otherwise(REVOKED)
    )
    return (
        rows.withColumn("reason", reason)
        .withColumn("ok", ok)
        .withColumn("result", F.to_json(F.struct("ok", message.alias("message"))))
        .select(*requests.columns, "ok", "reason", "result")
    )


def changed_roles(ds: Dataset, requests: DataFrame) -> DataFrame:
    """Role holdings after the batch.

    A role held all along keeps its date; one assigned after its last revocation
    gets the date of the first assignment since. Whether an assignment counts
    depends on user and role only, so that is checked after the requests have
    been reduced to one row per user and role.
    """
    key = ["user_id", "role_code"]
    acts = requests.withColumn("role_code", F.upper("role_code"))
    revoked = acts.where(F.col("action") == "revoke").groupBy(*key).agg(F.max("request_id").alias("_revoked"))
    given = (
        acts.where(F.col("action") == "assign")
        .join(revoked, key, "left")
        .where(F.col("_revoked").isNull() | (F.col("request_id") > F.col("_revoked")))
        .groupBy(*key)
        .agg(F.min_by("requested_at", "request_id").alias("assigned_at"))
        .join(ds.app_users, "user_id", "left_semi")
        .join(ds.app_roles, "role_code", "left_semi")
    )
    kept = ds.app_user_roles.join(revoked, key, "left_anti")
    return insert_absent(kept, given, key).select(*ds.app_user_roles.columns)


# --- registration ------------------------------------------------------------
def register(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer registrations: ``request_id, ok, reason, user_id, email, full_name, role_code``.

    A missing role means the default one. Of the valid requests for one e-mail
    the first wins.
    """
    rows = requests.withColumn("email", X.normal_email("email")).withColumn(
        "role_code", F.upper(F.coalesce("role_code", F.lit(DEFAULT_ROLE)))
    )
    rows = flag_known(rows, "role_code", ds.app_roles, "role_code", "_role", row_id="request_id")
    length = F.coalesce("password_length", F.lit(0))
    missing = X.is_blank("full_name") | X.is_blank("email") | (length == 0)
    rows = rows.withColumn(
        "_fail",
        X.first_failure(
            [
                ("required_missing", missing),
                ("email_invalid", ~X.valid_email("email") | (F.locate("@", "email") < 2)),
                ("password_short", length < S.MIN_PASSWORD_LENGTH),
                ("role_unknown", ~F.col("_role")),
            ]
        ),
    )
    # Either all requests for an e-mail meet a registered account or none does, so the first
    # valid one can be found before the accounts are joined.
    rows = flag_first(rows, ["email"], "request_id", "_first", where=F.col("_fail").isNull())
    rows = flag_known(rows, "email", ds.app_users, "email", "_registered", row_id="request_id")
    reason = F.coalesce("_fail", F.when(F.col("_registered") | ~F.col("_first"), "already_registered"))
    rows = materialise(rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()), "registrations")
    last_id = ds.app_users.agg(F.max("user_id")).scalar()
    ids = numbered(rows.where("ok").select("request_id"), "request_id", "user_id", last_id, scale.slice_bits)
    return rows.join(ids, "request_id", "left").select(
        "request_id", "ok", "reason", "user_id", "email", "full_name", "role_code"
    )


def registered_users(answered: DataFrame, clock: Clock) -> DataFrame:
    """The user rows that accepted registrations create."""
    made = answered.where("ok").select("user_id", "email", "full_name", X.stamp(clock.as_of).alias("created_at"))
    return conform(made, "app_users")


def registered_roles(answered: DataFrame, clock: Clock) -> DataFrame:
    """The role each new user starts with."""
    made = answered.where("ok").select("user_id", "role_code", X.stamp(clock.as_of).alias("assigned_at"))
    return conform(made, "app_user_roles")


# --- removal -----------------------------------------------------------------
def delete_users(ds: Dataset, requests: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Answer removals in request order: ``request_id, user_id, ok, reason, email``.

    With ``a`` administrators on file, the first ``a - 1`` distinct ones asked for
    can go; the last one stays. A user who is already gone is not found.
    """
    admins = ds.app_user_roles.where(F.col("role_code") == ADMIN).select("user_id").distinct()
    # One row per user that is asked for; everything about a user is decided there.
    first = requests.groupBy("user_id").agg(F.min("request_id").alias("_first"))
    first = flag_known(first.join(ds.app_users.select("user_id", "email"), "user_id"), "user_id", admins, "user_id", "_admin")
    first = materialise(first, "removals")
    turn = numbered(first.where("_admin").select("_first"), "_first", "_turn", F.lit(0), scale.slice_bits)
    spare = admins.agg(F.count(F.lit(1))).scalar() - 1
    fate = first.join(turn, "_first", "left").select(
        "user_id", "email", "_first", (F.col("_admin") & (F.col("_turn") > spare)).alias("_last_admin")
    )
    judged = requests.join(fate, "user_id", "left")
    reason = (
        F.when(F.col("email").isNull(), "user_not_found")
        .when(F.coalesce("_last_admin", F.lit(False)), "last_admin")
        .when(F.col("request_id") != F.col("_first"), "user_not_found")
    )
    return judged.withColumn("reason", reason).select(
        "request_id", "user_id", F.col("reason").isNull().alias("ok"), "reason",
        F.when(F.col("reason").isNull(), F.col("email")).alias("email"),
    )


def removal_audit(answered: DataFrame) -> DataFrame:
    return answered.where("ok").select(
        "email", "user_id", F.lit(True).alias("success"), F.lit("account deleted").alias("detail")
    )


def without_users(ds: Dataset, answered: DataFrame) -> Dataset:
    """The dataset after the accepted removals; role holdings go with the user."""
    return delete_rows(ds, "app_users", "user_id", answered.where("ok"))
