"""Business rules that jobs take as parameters, with their default values."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class StatusSets:
    """Status codes that the reports filter on.

    The published reports filter on long codes that no row carries, so their
    segment and cohort counts come out as zero. ``StatusSets()`` keeps that
    behaviour; ``StatusSets.working()`` uses the codes that rows really have.
    """

    active: tuple[str, ...] = ("ACTIVE",)
    inactive: tuple[str, ...] = ("INACTIVE",)
    excluded: tuple[str, ...] = ("INACTIVE", "SUSPENDED")
    pending: tuple[str, ...] = ("PENDING",)
    fan_out: bool = True

    @staticmethod
    def working() -> "StatusSets":
        return StatusSets(("ACT",), ("INA",), ("INA", "SUS"), ("BOOK",), fan_out=False)


# --- fixed values: lesson status groups --------------------------------------
BILLABLE = ("COMP", "NOSH")
DONE_OR_CONFIRMED = ("COMP", "CONF")
COMPLETED, CANCELLED, RESCHEDULED = "COMP", "CANC", "RESC"
NOT_UPCOMING = ("Cancelled by customer", "No show")
CANCELLABLE = ("Booked", "Confirmed")

# --- fixed values: thresholds ------------------------------------------------
MINOR_BALANCE_BELOW = 40
COMPLETION_GREEN, COMPLETION_AMBER = 60, 40
AT_RISK_OWES_OVER = 500
METRICS_WINDOW_DAYS = 90
FREE_CANCEL_HOURS = 24
LATE_CANCEL_SHARE = "0.5"
LOCK_AFTER_FAILURES = 5
LOCK_MINUTES = 15
MIN_PASSWORD_LENGTH = 8
SEARCH_LIMIT = 8


@dataclass(frozen=True)
class Scale:
    """Where a job switches from the plain plan to the one for hot groups."""

    # A key with more rows than this is cut into slices and stitched together.
    hot_rows: int = 1_000_000
    # A booking slot with more distinct candidate pairs than this is settled in
    # distributed rounds instead of one ordered pass.
    hot_slot_pairs: int = 200_000
    # Requests that depend on each other are replayed by one ordered pass up to
    # this number, per batch and then per component; above it rounds come first.
    ordered_rows: int = 500_000
    # log2 of the widest slice a single window partition may cover.
    slice_bits: int = 20


@dataclass(frozen=True)
class Clock:
    """The moment a job is evaluated at; nothing reads the wall clock."""

    as_of: dt.datetime = field(default_factory=lambda: dt.datetime(2001, 6, 1, 12, 0, 0))

    @property
    def date(self) -> dt.date:
        return self.as_of.date()

    @property
    def second_of_day(self) -> int:
        return self.as_of.hour * 3600 + self.as_of.minute * 60 + self.as_of.second
