"""Sign-in lockout: an ordered rule per e-mail, cut into blocks of attempts for hot e-mails.

The rule, attempt by attempt: while the lock time lies ahead the attempt is
``locked`` and changes nothing; a right password clears the failure count; a
wrong one raises it and, from the fifth on, locks for a fixed time. The count
outlives the lock, so the next failure locks again at once. A new password
(``reset``) clears the count and the lock at any time.

For an e-mail with very many attempts the history is cut into blocks of a bounded
number of attempts, however close together they lie. A block's effect depends on
its entry state only, and an entry state is either "unlocked with 0 to 5 failures"
or "locked until some moment up to one lock period after the block's start, or
past its end". Each block is summarised as a table from entry to exit state, the
tables are chained in block order, and then every block is replayed on its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyslot.operators.keyed import split_hot
from tallyslot.operators.slices import cut_by_rank
from tallyslot.settings import Scale

NEVER = -1
#: The exit lock of a block whose attempts all lie before the end of the entry's lock.
KEEPS = -2
NO_LIMIT = 2**62
WRONG, RIGHT, RESET = 0, 1, 2
REPLAYED = (
    "attempt_id long, email string, user_id long, at long, status string, failures long, locked_until long"
)
TABLE = "email string, block long, rank long, upto long, failures_from long, failures_add long, lock_out long"
ENTRY = "email string, block long, failures_in long, locked_in long"


def _replay(after: int, lock: int):
    """Apply the rule to rows sorted by e-mail, block and time, carrying state across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, failures, until = None, 0, NEVER
        for pdf in batches:
            status, fails, locks = [], [], []
            for email, block, at, letter, f_in, l_in in zip(
                pdf["email"], pdf["block"].tolist(), pdf["at"].tolist(), pdf["letter"].tolist(),
                pdf["failures_in"].tolist(), pdf["locked_in"].tolist(),
            ):
                if (email, block) != here:
                    here, failures, until = (email, block), f_in, l_in
                if letter == RESET:
                    failures, until = 0, NEVER
                    status.append("reset")
                elif until > at:
                    status.append("locked")
                elif letter == RIGHT:
                    failures, until = 0, NEVER
                    status.append("ok")
                else:
                    failures += 1
                    if failures >= after:
                        until = at + lock
                    status.append("bad password")
                fails.append(failures)
                locks.append(until)
            yield pd.DataFrame(
                {
                    "attempt_id": pdf["attempt_id"], "email": pdf["email"], "user_id": pdf["user_id"], "at": pdf["at"],
                    "status": status, "failures": fails, "locked_until": locks,
                }
            )

    return run


def _summarise(after: int, lock: int):
    """Exit tables of blocks whose rows arrive latest first, each with its block's first time in ``start``.

    ``ahead`` holds, for rows up to one lock period after the current one, what
    happens when the e-mail is unlocked there with ``after`` or more failures; a
    reset unlocks for every lock that ends later. An outcome is ``(count restarts
    from 0?, failures added, lock time)``.
    """

    def table(email, block, by_count, early, rest):
        rows = [
            (email, block, count, NEVER, *outcome) for count, outcome in enumerate(by_count)
        ]
        # early: (time, outcome), ascending. A lock that ends at or before that time, and after the
        # row before it, leads to that outcome. Of rows at one instant the first counts, and equal
        # neighbours are merged.
        pieces = [p for i, p in enumerate(early) if i == 0 or early[i - 1][0] != p[0]]
        pieces.append((NO_LIMIT, rest))
        for i, (at, outcome) in enumerate(pieces):
            if i + 1 == len(pieces) or pieces[i + 1][1] != outcome:
                rows.append((email, block, after + 1, at, *outcome))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in TABLE.split(", ")]
        nothing, kept = (0, 0, NEVER), (0, 0, KEEPS)
        here, by_count, ahead, early, rest = None, [], deque(), deque(), kept
        for pdf in batches:
            rows = []
            for email, block, at, letter, start in zip(
                pdf["email"], pdf["block"].tolist(), pdf["at"].tolist(), pdf["letter"].tolist(), pdf["start"].tolist()
            ):
                if (email, block) != here:
                    if here is not None:
                        rows += table(*here, by_count, list(early), rest)
                    here, ahead, early, rest = (email, block), deque(), deque(), kept
                    by_count = [nothing] * (after + 1)
                # Drop what lies further ahead than needed; keep the first row at or after the lock's end.
                while len(ahead) >= 2 and ahead[-2][0] >= at + lock:
                    ahead.pop()
                later = ahead[-1][1] if ahead and ahead[-1][0] >= at + lock else None
                restart, added, out = by_count[0]
                if letter != WRONG:
                    now = [(1, added, out)] * (after + 1)
                else:
                    now = []
                    for count in range(after + 1):
                        if count + 1 < after:
                            restart, added, out = by_count[count + 1]
                        elif later is None:
                            restart, added, out = 0, 0, at + lock
                        else:
                            restart, added, out = later
                        now.append((restart, added if restart else added + 1, out))
                by_count = now
                if letter == RESET:
                    # Whatever lock comes here ends here.
                    ahead, early, rest = deque([(NO_LIMIT, now[after])]), deque(), now[after]
                else:
                    ahead.appendleft((at, now[after]))
                    if at < start + lock:
                        early.appendleft((at, now[after]))
                    else:
                        rest = now[after]
            yield pd.DataFrame(rows, columns=columns)
        if here is not None:
            yield pd.DataFrame(table(*here, by_count, list(early), rest), columns=columns)

    return run


def _chain(after: int):
    """Entry state of every block; table rows arrive by e-mail, block, rank and time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        email_now, here, state, leaving = None, None, (0, NEVER), None
        for pdf in batches:
            rows = []
            for email, block, rank, upto, restart, added, out, f_start, start in zip(
                pdf["email"], pdf["block"].tolist(), pdf["rank"].tolist(), pdf["upto"].tolist(),
                pdf["failures_from"].tolist(), pdf["failures_add"].tolist(), pdf["lock_out"].tolist(),
                pdf["failures_start"].tolist(), pdf["start"].tolist(),
            ):
                if email != email_now:
                    email_now, here, leaving = email, None, (f_start, NEVER)
                if block != here:
                    here, state, leaving = block, leaving, None
                    rows.append((email, block, *state))
                if leaving is not None:
                    continue
                locked = state[1] > start
                fits = (rank == after + 1 and state[1] <= upto) if locked else rank == min(state[0], after)
                if fits:
                    leaving = (added if restart else state[0] + added, state[1] if out == KEEPS else out)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return run


def lockout(attempts: DataFrame, after: int, lock_minutes: int, scale: Scale = Scale()) -> DataFrame:
    """Classify attempts of known, active users.

    ``attempts``: ``attempt_id, email, user_id, at`` (microseconds), ``good``,
    ``failures_in, locked_in`` (the stored state of the e-mail, ``locked_in`` -1
    for none) and, if there are password changes among the rows, ``reset``.
    Result: ``attempt_id, email, user_id, at, status, failures, locked_until``. An
    e-mail with more than ``scale.hot_rows`` rows is cut into blocks of at most so
    many rows.
    """
    lock = lock_minutes * 60 * 1_000_000
    keys = ["email", "block"]
    replay = _replay(after, lock)
    letter = F.when(F.col("good"), F.lit(RIGHT)).otherwise(F.lit(WRONG))
    if "reset" in attempts.columns:
        letter = F.when(F.coalesce("reset", F.lit(False)), F.lit(RESET)).otherwise(letter)
    attempts = attempts.select("attempt_id", "email", "user_id", "at", letter.alias("letter"), "failures_in", "locked_in")

    def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
        return df.repartition("email").sortWithinPartitions(*order)

    cold, hot = split_hot(attempts, ["email"], scale.hot_rows)
    cold = cold.withColumn("block", F.lit(0).cast("long"))
    done = in_order(cold, *keys, "at", "attempt_id").mapInPandas(replay, REPLAYED)
    if hot is None:
        return done

    # Attempts under a lock that was stored before the batch change nothing until a reset; settle them here.
    place = F.struct("at", "attempt_id")
    resets = hot.where(F.col("letter") == RESET).groupBy("email").agg(F.min(place).alias("_reset"))
    hot = hot.join(resets, "email", "left")
    stored_lock = (F.col("locked_in") > F.col("at")) & (F.col("_reset").isNull() | (place < F.col("_reset")))
    under = hot.where(stored_lock).select(
        "attempt_id", "email", "user_id", "at", F.lit("locked").alias("status"),
        F.col("failures_in").cast("long").alias("failures"), F.col("locked_in").cast("long").alias("locked_until"),
    )
    open_rows = cut_by_rank(hot.where(~stored_lock).drop("_reset"), "email", ["at", "attempt_id"], scale.hot_rows, "lockout-blocks")
    open_rows = open_rows.withColumnRenamed("_slice", "block").withColumn("block", F.col("block").cast("long"))
    firsts = open_rows.groupBy(*keys).agg(F.min("at").alias("start"), F.max("failures_in").alias("failures_start"))
    latest_first = open_rows.select(*keys, "at", "attempt_id", "letter").join(firsts, keys).repartition(*keys).sortWithinPartitions(
        *keys, F.desc("at"), F.desc("attempt_id")
    )
    tables = latest_first.select(*keys, "at", "letter", "start").mapInPandas(_summarise(after, lock), TABLE)
    entries = in_order(tables.join(firsts, keys), *keys, "rank", "upto").mapInPandas(_chain(after), ENTRY)
    replayed = (
        open_rows.drop("failures_in", "locked_in")
        .join(entries, keys)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "at", "attempt_id")
        .mapInPandas(replay, REPLAYED)
    )
    return done.unionByName(under).unionByName(replayed)
