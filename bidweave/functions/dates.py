"""Dates and times as texts write them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions.text import empty

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: All notations, those that win where several begin at one place first.
ANY_DATE = "(?iU)" + "|".join([K.DATE_REVISED, K.DATE_NAMED, K.DATE_DAY_FIRST, K.DATE_NUMERIC, K.DATE_ISO])


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(c, "(?iU)^(?:" + pattern + ")$", k)


def _month(name: Column) -> Column:
    return ((F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int")


def _digits(c: Column) -> Column:
    """Wide digits as plain ones; the patterns read both."""
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where there is none; two-digit years are of this century."""
    y = F.when(year.try_cast("int") < 100, year.try_cast("int") + 2000).otherwise(year.try_cast("int"))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, month.try_cast("int"), day.try_cast("int")), "yyyy-MM-dd")


def _dates_of(m: Column) -> Column:
    """The dates of one match: two for a struck-through revision."""
    def is_(p: str) -> Column:
        return m.rlike("(?iU)^(?:" + p + ")$")

    g = lambda p, k: _group(m, p, k)
    r, n, d, u, i = K.DATE_REVISED, K.DATE_NAMED, K.DATE_DAY_FIRST, K.DATE_NUMERIC, K.DATE_ISO
    return (
        F.when(is_(r), F.array(make_date(g(r, 4), _month(g(r, 1)), g(r, 2)), make_date(g(r, 4), _month(g(r, 1)), g(r, 3))))
        .when(is_(n), F.array(make_date(g(n, 3), _month(g(n, 1)), g(n, 2))))
        .when(is_(d), F.array(make_date(g(d, 3), _month(g(d, 2)), g(d, 1))))
        .when(is_(u), F.array(make_date(g(u, 3), g(u, 1), g(u, 2))))
        .otherwise(F.array(make_date(g(i, 1), g(i, 2), g(i, 3))))
    )


def find_dates(c: Column) -> Column:
    """The dates of a text as ISO strings, in reading order, none twice.

    One alternation reads all notations in one pass. It differs from trying one notation after another only where an
    invalid date hides a valid one of another notation inside its own text.
    """
    found = F.flatten(F.transform(F.regexp_extract_all(_digits(empty(c)), F.lit(ANY_DATE), 0), _dates_of))
    return F.transform(F.array_distinct(F.filter(found, lambda d: d.isNotNull())), lambda d: F.date_format(d, "yyyy-MM-dd"))


def find_times(c: Column) -> Column:
    """Clock times as ``HH:MM``: 12-hour ones, then 24-hour ones, then military ones, then noon; none twice."""
    text = _digits(empty(c))

    def twelve(m: Column) -> Column:
        p = r"(?iU)^(\d{1,2})(?::(\d{2}))?\s*([ap])"
        hour = F.regexp_extract(m, p, 1).try_cast("int")
        minute = F.coalesce(F.nullif(F.regexp_extract(m, p, 2), F.lit("")), F.lit("0")).try_cast("int")
        late = F.lower(F.regexp_extract(m, p, 3)) == "p"
        return F.when(hour.between(1, 12), F.format_string("%02d:%02d", F.pmod(hour, F.lit(12)) + F.when(late, 12).otherwise(0), minute))

    def plain(m: Column) -> Column:
        p = r"^(\d{1,2}):?(\d{2})"
        return F.concat(F.lpad(F.regexp_extract(m, p, 1), 2, "0"), F.lit(":"), F.regexp_extract(m, p, 2))

    every = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + K.TIME_12), 0), twelve),
        F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + K.TIME_24), 0), plain),
        F.transform(F.regexp_extract_all(text, F.lit("(?U)" + K.TIME_MILITARY), 0), plain),
        F.when(text.rlike("(?iU)" + K.NOON), F.array(F.lit("12:00"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull()))


def parse_iso(c: Column) -> Column:
    """The date of a text that is an ISO date and nothing else, or NULL."""
    s = F.trim(empty(c))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def long_form(date: Column, time: Column, otherwise: Column) -> Column:
    """``October 16, 2026, 12:00 PM``; without a date ``otherwise``."""
    d = parse_iso(date)
    hour = F.try_element_at(F.split(empty(time), ":"), F.lit(1)).try_cast("int")
    minute = F.try_element_at(F.split(empty(time), ":"), F.lit(2)).try_cast("int")
    twelve = F.when(F.pmod(hour, F.lit(12)) == 0, 12).otherwise(F.pmod(hour, F.lit(12)))
    clock = F.when(hour.isNotNull() & minute.isNotNull(), F.format_string(", %d:%02d %s", twelve, minute, F.when(hour >= 12, "PM").otherwise("AM"))).otherwise("")
    return F.when(d.isNotNull(), F.concat(F.date_format(d, "MMMM d, yyyy"), clock)).otherwise(otherwise)


def short_form(date: Column) -> Column:
    """``Oct 16, 2026`` or ``Not stated``."""
    return F.coalesce(F.date_format(parse_iso(date), "MMM d, yyyy"), F.lit("Not stated"))


def adjacent_revision(c: Column) -> Column:
    """Whether two dates stand side by side, as a struck-through one and its successor do."""
    return F.coalesce(c.rlike("(?iU)" + K.DATE_REVISED) | c.rlike(K.NUMERIC_REVISION), F.lit(False))
