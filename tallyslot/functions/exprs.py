"""Scalar and aggregate expressions with the source system's null and rounding rules."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: text rules ------------------------------------------------
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_PATTERN = r"^[\d\s()+.\-]+$"
PHONE_DIGITS = (10, 15)
PLATE_MARK = " - Plate"
CURRENCY = "CA$"
DASH = "—"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text --------------------------------------------------------------------
def full_name(first: Column | str, last: Column | str) -> Column:
    """``first last`` where a missing part counts as empty, so two nulls give one space."""
    return F.concat(F.coalesce(as_col(first), F.lit("")), F.lit(" "), F.coalesce(as_col(last), F.lit("")))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True for NULL and for text that is empty after trimming."""
    return F.coalesce(F.length(F.trim(as_col(c))), F.lit(0)) == 0


def joined_parts(cols: list[Column | str], sep: str = ", ", keep_empty: bool = True) -> Column:
    """Join parts, always skipping NULL and, unless ``keep_empty``, skipping '' too."""
    return F.concat_ws(sep, *[as_col(c) if keep_empty else blank_to_null(c) for c in cols])


def staff_label(nickname: Column | str, first: Column | str, last: Column | str) -> Column:
    """Nickname, else the name, else a dash."""
    return F.coalesce(
        blank_to_null(nickname),
        blank_to_null(joined_parts([first, last], " ", keep_empty=False)),
        F.lit(DASH),
    )


def or_dash(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(DASH))


def before_plate(c: Column | str) -> Column:
    return F.substring_index(F.coalesce(as_col(c), F.lit("")), PLATE_MARK, 1)


def valid_email(c: Column | str) -> Column:
    return F.trim(F.coalesce(as_col(c), F.lit(""))).rlike(EMAIL_PATTERN)


def valid_phone(c: Column | str) -> Column:
    """Blank is fine; otherwise only phone characters and 10 to 15 digits."""
    value = F.trim(F.coalesce(as_col(c), F.lit("")))
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (value == "") | (value.rlike(PHONE_PATTERN) & digits.between(*PHONE_DIGITS))


def normal_email(c: Column | str) -> Column:
    return F.lower(F.trim(as_col(c)))


def contains_any(cols: list[Column | str], needle: Column) -> Column:
    """Case-insensitive containment in any column; an empty needle matches nothing."""
    q = F.lower(F.trim(needle))
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(as_col(c), F.lit(""))).contains(q) for c in cols])
    return (F.length(q) > 0) & hit


# --- dates and times ---------------------------------------------------------
def stamp(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def age_years(born: Column | str, on: dt.date) -> Column:
    """Completed years; a 29 February birthday counts from 1 March in common years."""
    born = as_col(born)
    month_day = F.month(born) * 100 + F.dayofmonth(born)
    return F.lit(on.year) - F.year(born) - F.when(month_day > on.month * 100 + on.day, 1).otherwise(0)


def lesson_stamp(date: Column | str = "lesson_date", sec: Column | str = "lesson_time_sec") -> Column:
    """Date plus second of day."""
    return F.timestamp_add("SECOND", as_col(sec), as_col(date).cast("timestamp_ntz"))


def clock_text(sec: Column | str = "lesson_time_sec") -> Column:
    """Second of day as HH:MM; a missing time is empty text."""
    s = as_col(sec)
    hours, minutes = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.coalesce(F.concat(F.lpad(hours, 2, "0"), F.lit(":"), F.lpad(minutes, 2, "0")), F.lit(""))


def hour_of(sec: Column | str = "lesson_time_sec") -> Column:
    return F.floor(as_col(sec) / 3600)


def weekday_from_sunday(d: Column | str) -> Column:
    """0 for Sunday up to 6 for Saturday."""
    return F.dayofweek(as_col(d)) - 1


def week_start(d: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(as_col(d), "week")


def month_start(d: Column | str) -> Column:
    return F.trunc(as_col(d).cast("date"), "month")


def month_text(ts: Column | str) -> Column:
    d = as_col(ts).cast("date")
    return F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month(d).cast("string"), 2, "0"))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, independent of the session zone."""
    ts = as_col(ts)
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60) * 1_000_000 + second


def from_micros(c: Column | str) -> Column:
    """The zone-free timestamp that lies this many microseconds after 1970."""
    c, day = as_col(c), F.lit(86_400_000_000)
    rest = F.pmod(c, day)
    days = ((c - rest) / day).cast("int")
    seconds = (rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days, zero, zero, seconds)


# --- numbers -----------------------------------------------------------------
def percent(part: Column, whole: Column, scale: int) -> Column:
    """``100 * part / whole`` rounded half up; NULL when ``whole`` is 0."""
    whole = F.nullif(whole.cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    return F.round(part.cast("decimal(20,2)") * F.lit(100).cast("decimal(3,0)") / whole, scale)


def money_avg(c: Column | str, scale: int = 2) -> Column:
    """Mean of a money column, rounded once from ten extra digits."""
    return F.round(F.avg(as_col(c).cast("decimal(28,10)")), scale)


def money_text(c: Column | str) -> Column:
    return F.concat(F.lit(CURRENCY), F.coalesce(as_col(c), F.lit(0)).cast("decimal(18,2)").cast("string"))


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0).cast("decimal(10,2)"))


# --- fixed values: words and colours of bands ---------------------------------
PAID_UP, MINOR, CHASE = "Paid up", "Minor balance", "Chase for payment"
GOOD, MIDDLING, BAD = "green", "amber", "red"


# --- bands -------------------------------------------------------------------
def balance_band(balance: Column, minor_below: int) -> Column:
    return F.when(balance <= 0, PAID_UP).when(balance < minor_below, MINOR).otherwise(CHASE)


def completion_band(pct: Column, green: int, amber: int) -> Column:
    return F.when(pct >= green, GOOD).when(pct >= amber, MIDDLING).otherwise(BAD)


def _colour(c: Column, colours: dict[str, str]) -> Column:
    out = None
    for value, colour in colours.items():
        out = F.when(c == value, colour) if out is None else out.when(c == value, colour)
    return out.otherwise("grey")


# --- fixed values: status colours --------------------------------------------
def customer_colour(code: Column | str) -> Column:
    return _colour(
        as_col(code), {"ACT": "green", "PASS": "blue", "SUS": "red", "INA": "grey", "LEAD": "amber"}
    )


def lesson_colour(status: Column | str) -> Column:
    return _colour(
        as_col(status),
        {
            "Completed": "green",
            "Confirmed": "blue",
            "Booked": "amber",
            "Cancelled by customer": "grey",
            "No show": "red",
            "Rescheduled": "grey",
        },
    )


# --- request checks ----------------------------------------------------------
def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that is true, in the given order; NULL if none is."""
    out = None
    for reason, failed in checks:
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out
