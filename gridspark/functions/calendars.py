"""Columns for the calendars of climate models: instants are milliseconds since 1970-01-01 of their calendar.

A fixed calendar is a list of month lengths that every year has.  The Julian and the Gregorian (proleptic) calendars
share their days, counted from the Gregorian 1970-01-01, and follow from day numbers.  No instant is ever cast to a timestamp, so 30 February stays what it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.columns import let

#: Days of the months.
FIXED = {
    "360_day": (30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30),
    "noleap": (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31),
    "all_leap": (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31),
}
#: Other names of the calendars.
ALIASES = {"365_day": "noleap", "366_day": "all_leap", "standard": "gregorian", "proleptic_gregorian": "gregorian"}
#: Milliseconds of the units, by all their names.
UNITS = {
    **dict.fromkeys(("seconds", "second", "secs", "sec", "s"), 1000),
    **dict.fromkeys(("minutes", "minute", "mins", "min"), 60_000),
    **dict.fromkeys(("hours", "hour", "hrs", "hr", "h"), 3_600_000),
    **dict.fromkeys(("days", "day", "d"), 86_400_000),
}
DAY = 86_400_000


def calendar_of(c: Column) -> Column:
    """The calendar's own name: null is the Gregorian one."""
    low = F.lower(F.coalesce(c, F.lit("gregorian")))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, low), low)


def calendar_name(c: Column) -> Column:
    """The units label of a time axis."""
    own = calendar_of(c)
    return F.when(own == "gregorian", "ISO8601").when(own == "noleap", "noleap").when(own.isin("360_day", "all_leap", "julian"), own).otherwise("unknown")


def unit_length_ms(c: Column) -> Column:
    """Milliseconds of a unit; null for units that have no fixed length or aren't known."""
    name, out = F.trim(c), F.lit(None).cast("long")
    for ms in sorted(set(UNITS.values())):
        out = F.when(name.isin(*[u for u, n in UNITS.items() if n == ms]), F.lit(ms).cast("long")).otherwise(out)
    return out


def _floor_div(a: Column, b: Column | int) -> Column:
    """Floor of a quotient of longs; exact below 2**53, which is 285 thousand years in milliseconds."""
    return F.floor(a / b)


def _starts(months: tuple[int, ...]) -> list[int]:
    return [sum(months[:k]) for k in range(13)]


def _by_calendar(calendar: Column, of: dict[str, Column]) -> Column:
    own, out = calendar_of(calendar), F
    for name, c in of.items():
        out = out.when(own == name, c)
    return out


def month_lengths(calendar: Column, year: Column) -> Column:
    """array<int> of the days of a year's months."""
    leap = {"gregorian": (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0)), "julian": F.pmod(year, F.lit(4)) == 0}
    fixed = {k: F.array(*map(F.lit, v)) for k, v in FIXED.items()}
    return _by_calendar(calendar, fixed | {k: F.when(v, fixed["all_leap"]).otherwise(fixed["noleap"]) for k, v in leap.items()})


def days_of(calendar: Column, year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01 of the calendar to a date; null for dates that the calendar doesn't have."""
    lengths = month_lengths(calendar, year)
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (day <= F.try_element_at(lengths, month.cast("int")))
    at = F.greatest(F.lit(1), F.least(F.lit(12), month)).cast("int")
    fixed = {k: (year - 1970) * sum(v) + F.element_at(F.array(*map(F.lit, _starts(v))), at) + day - 1 for k, v in FIXED.items()}
    # years begin in March, so that the leap day is a year's last
    in_year = _floor_div(153 * F.pmod(month + 9, F.lit(12)) + 2, 5) + day - 1
    march = year - F.when(month <= 2, 1).otherwise(0)
    julian = let(march, lambda y: 365 * y + _floor_div(y, 4) + in_year - 719470)
    gregorian = let(march, lambda y: 365 * y + _floor_div(y, 4) - _floor_div(y, 100) + _floor_div(y, 400) + in_year - 719468)
    return F.when(ok, _by_calendar(calendar, fixed | {"julian": julian, "gregorian": gregorian}).cast("long"))


def calendar_ms(calendar: Column, year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, ms: Column) -> Column:
    """The instant of fields; null for dates or times of day that don't exist."""
    ok = (hour >= 0) & (hour < 24) & (minute >= 0) & (minute < 60) & (second >= 0) & (second < 60) & (ms >= 0) & (ms < 1000)
    return F.when(ok, days_of(calendar, year.cast("long"), month, day) * DAY + (hour * 3600 + minute * 60 + second).cast("long") * 1000 + ms)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))


def _fixed_date(days: Column, months: tuple[int, ...]) -> Column:
    size, starts = sum(months), _starts(months)

    def place(of_year: Column) -> Column:
        month = F.size(F.filter(F.array(*map(F.lit, starts[:12])), lambda s: s <= of_year))
        return let(month, lambda m: _date(_floor_div(days, size) + 1970, m, of_year - F.element_at(F.array(*map(F.lit, starts)), m) + 1))

    return let(F.pmod(days, F.lit(size)), place)


def _march_date(year: Column, of_year: Column) -> Column:
    """The date of a day of a year that begins in March."""
    def place(march: Column) -> Column:
        late = march >= 10
        return _date(year + F.when(late, 1).otherwise(0), march + F.when(late, -9).otherwise(3), of_year - _floor_div(153 * march + 2, 5) + 1)

    return let(_floor_div(5 * of_year + 2, 153), place)


def _julian_date(days: Column) -> Column:
    z = days + 719470
    return let(_floor_div(4 * z + 3, 1461), lambda y: let(z - _floor_div(1461 * y, 4), lambda d: _march_date(y, d)))


def _gregorian_date(days: Column) -> Column:
    def in_era(era: Column) -> Column:
        def in_year(of_era: Column) -> Column:
            y = _floor_div(of_era - _floor_div(of_era, 1460) + _floor_div(of_era, 36524) - _floor_div(of_era, 146096), 365)
            return let(y, lambda n: let(of_era - (365 * n + _floor_div(n, 4) - _floor_div(n, 100)), lambda d: _march_date(n + era * 400, d)))

        return let(days + 719468 - era * 146097, in_year)

    return let(_floor_div(days + 719468, 146097), in_era)


def calendar_date(days: Column, calendar: Column) -> Column:
    """struct(year, month, day) of a number of days; null for unknown calendars."""
    of = {name: _fixed_date(days, months) for name, months in FIXED.items()}
    return _by_calendar(calendar, of | {"julian": _julian_date(days), "gregorian": _gregorian_date(days)})


def calendar_fields(instant: Column, calendar: Column) -> Column:
    """struct(year, month, day, hour, minute, second, ms) of an instant; floors before the epoch."""
    def fields(date: Column, rest: Column) -> Column:
        clock = {"hour": _floor_div(rest, 3_600_000), "minute": _floor_div(rest, 60_000) % 60, "second": _floor_div(rest, 1000) % 60, "ms": rest % 1000}
        return F.struct(*[date[k].alias(k) for k in ("year", "month", "day")], *[c.cast("int").alias(k) for k, c in clock.items()])

    date = lambda rest: let(calendar_date(_floor_div(instant, DAY), calendar), lambda d: fields(d, rest))
    return let(F.pmod(instant, F.lit(DAY).cast("long")), date)


def julian_fields(instant: Column) -> Column:
    return calendar_fields(instant, F.lit("julian"))


def calendar_add_months(instant: Column, months: Column, calendar: Column) -> Column:
    """The instant moved by whole years and then by the lengths of the months passed, the current one first.

    For calendars whose years are all alike; null for others.
    """
    years, left = (months / 12).cast("long"), (months % 12).cast("int")  # towards zero

    def moved(lengths: tuple[int, ...]) -> Column:
        # days from the year's start to the start of any month of three years around it
        starts = F.array(*[F.lit(sum(lengths) * y + s) for y in (-1, 0, 1) for s in _starts(lengths)[:12]])
        start = lambda k: F.element_at(starts, (k + 12).cast("int"))
        day = _floor_div(instant, DAY)
        return let(_fixed_date(day, lengths)["month"], lambda at: instant + (years * sum(lengths) + start(at + left) - start(at)) * DAY)

    return _by_calendar(calendar, {name: moved(lengths) for name, lengths in FIXED.items()}).cast("long")


def parse_time_base(text: Column, calendar: Column) -> Column:
    """The instant of "y-m-d h:m:s.s +hh:mm"; whatever is missing has its default, year 0, month 1, day 1, 0:0:0.

    Null for text that isn't one, and for dates that the calendar doesn't have.
    """
    words = F.split(F.trim(text), " +")
    form = text.rlike(r"^\s*-?\d+(-\d+){0,2}(\s+\d+(:\d+(:\d+(\.\d*)?)?)?(\s+[+-]?\d+(:\d+)?)?)?\s*$")
    word = lambda k: F.try_element_at(words, F.lit(k))
    part = lambda w, sep, k: F.try_element_at(F.split(word(w), sep), F.lit(k))
    whole = lambda c, default: F.coalesce(c.try_cast("int"), F.lit(default))
    year, month, day = whole(part(1, "-", 1), 0), whole(part(1, "-", 2), 1), whole(part(1, "-", 3), 1)
    hour, minute = whole(part(2, ":", 1), 0), whole(part(2, ":", 2), 0)
    second = (F.coalesce(part(2, ":", 3).try_cast("double"), F.lit(0.0)) * 1000).cast("long")
    zero = F.lit(0)
    at = calendar_ms(calendar, year, month, day, hour, minute, zero, zero) + second
    sign = F.when(word(3).startswith("-"), -1).otherwise(1)
    offset = F.coalesce((sign * (F.abs(whole(part(3, ":", 1), 0)) * 60 + whole(part(3, ":", 2), 0))).cast("long") * 60_000, F.lit(0))
    return F.when(form, at - offset)


def decode_cf_time(value: Column, units: Column, calendar: Column) -> tuple[Column, Column]:
    """(instant, error) of a value in "<unit> since <base>"; fractions of a millisecond are cut off towards zero."""
    unit, base = F.regexp_extract(units, r"^(.*?)\s+since\s+(.*)$", 1), F.regexp_extract(units, r"^(.*?)\s+since\s+(.*)$", 2)
    length, start = unit_length_ms(unit), parse_time_base(base, calendar)
    known = calendar_of(calendar).isin(*FIXED, "gregorian", "julian")
    error = F.when(~known, "unknown calendar").when(length.isNull(), "unknown unit").when(start.isNull(), "bad base time")
    return F.when(error.isNull(), start + (length * value).cast("long")), error


def format_iso(c: Column) -> Column:
    """ISO 8601 with milliseconds, in the session's time zone, which is UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_time_only(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss.SSS'Z'")


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]"))


def format_period(ms: Column) -> Column:
    """P[nD][T[nH][nM][n[.fff]S]] of a length in milliseconds."""
    days, rest = _floor_div(ms, DAY), F.pmod(ms, F.lit(DAY).cast("long"))
    hours, minutes, left = _floor_div(rest, 3_600_000), _floor_div(rest, 60_000) % 60, rest % 60_000
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad((left % 1000).cast("string"), 3, "0")), r"\.?0+$", "")
    part = lambda n, s: F.when(n > 0, F.concat(n.cast("string"), F.lit(s))).otherwise("")
    seconds = F.when(left > 0, F.concat(_floor_div(left, 1000).cast("string"), fraction, F.lit("S"))).otherwise("")
    return F.concat(F.lit("P"), part(days, "D"), F.when(rest > 0, "T").otherwise(""), part(hours, "H"), part(minutes, "M"), seconds)
