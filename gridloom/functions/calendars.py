"""Calendars: elapsed time to date parts and back, as column expressions or on plain numbers, and time durations.

Every formula is integer arithmetic on floor divisions, written once for both columns and numbers.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that stand for one calendar.
ALIASES = {"gregorian": "standard", "noleap": "365_day", "all_leap": "366_day", "": "standard", None: "standard"}
CALENDARS = ("standard", "proleptic_gregorian", "julian", "365_day", "366_day", "360_day")


def canonical(calendar: str | None) -> str:
    found = ALIASES.get(calendar, calendar)
    if found not in CALENDARS:
        raise ValueError(f"unknown calendar {calendar!r}")
    return found


def _div(a, b: int):
    return F.floor(a / b).cast("long") if isinstance(a, Column) else a // b


def _pick(cond, a, b):
    return F.when(cond, a).otherwise(b) if isinstance(cond, Column) else (a if cond else b)


#: Julian day number of 1970-01-01, and the day on which the standard calendar leaves the Julian one (1582-10-15), from that.
_UNIX_JDN, _REFORM = 2440588, -141427


def _from_civil(y, m, d, gregorian: bool):
    """Days from 1970-01-01, by a year that begins in March."""
    y = _pick(m <= 2, y - 1, y)
    shifted = _pick(m > 2, m - 3, m + 9)
    day = _div(153 * shifted + 2, 5) + d - 1
    days = 365 * y + _div(y, 4) + day
    return days - _div(y, 100) + _div(y, 400) - 719468 if gregorian else days - 719470


def _to_civil(days, gregorian: bool):
    if isinstance(days, Column):
        if gregorian:  # Spark's own dates
            date = F.date_from_unix_date(days.cast("int"))
            return F.year(date), F.month(date), F.dayofmonth(date)
        # Each step's result is bound to a variable, so that it isn't written out again wherever it is used.
        step = lambda value, f: F.transform(F.array(value), f)[0]
        z = (days + 719470).cast("long")
        out = step(z, lambda z: step(z - _div(z, 1461) * 1461, lambda doe: step(_div(doe - _div(doe, 1460), 365), lambda yoe: step(doe - 365 * yoe, lambda doy: step(_div(5 * doy + 2, 153), lambda mp: F.struct((yoe + _div(z, 1461) * 4 + F.when(mp < 10, 0).otherwise(1)).alias("y"), F.when(mp < 10, mp + 3).otherwise(mp - 9).alias("m"), (doy - _div(153 * mp + 2, 5) + 1).alias("d")))))))
        return out["y"], out["m"], out["d"]
    if gregorian:
        z = days + 719468
        era = _div(z, 146097)
        doe = z - era * 146097
        yoe = _div(doe - _div(doe, 1460) + _div(doe, 36524) - _div(doe, 146096), 365)
        doy = doe - (365 * yoe + _div(yoe, 4) - _div(yoe, 100))
        y = yoe + era * 400
    else:
        z = days + 719470
        era = _div(z, 1461)
        doe = z - era * 1461
        yoe = _div(doe - _div(doe, 1460), 365)
        doy = doe - 365 * yoe
        y = yoe + era * 4
    mp = _div(5 * doy + 2, 153)
    d = doy - _div(153 * mp + 2, 5) + 1
    m = _pick(mp < 10, mp + 3, mp - 9)
    return _pick(m <= 2, y + 1, y), m, d


_STARTS = {"365_day": (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334), "366_day": (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)}


def days_from_date(y, m, d, calendar: str):
    """Days from 1970-01-01 of the same calendar."""
    calendar = canonical(calendar)
    if calendar == "360_day":
        return (y - 1970) * 360 + (m - 1) * 30 + d - 1
    if calendar in _STARTS:
        starts = _STARTS[calendar]
        before = F.element_at(F.array(*[F.lit(s) for s in starts]), m.cast("int")) if isinstance(m, Column) else starts[m - 1]
        return (y - 1970) * (365 if calendar == "365_day" else 366) + before + d - 1
    if calendar == "julian":
        return _from_civil(y, m, d, False)
    new = _from_civil(y, m, d, True)
    if calendar == "proleptic_gregorian":
        return new
    return _pick(new >= _REFORM, new, _from_civil(y, m, d, False))


def date_from_days(days, calendar: str):
    """(year, month, day)."""
    calendar = canonical(calendar)
    if calendar == "360_day":
        y = _div(days, 360)
        rest = days - y * 360
        m = _div(rest, 30)
        return y + 1970, m + 1, rest - m * 30 + 1
    if calendar in _STARTS:
        n, starts = (365 if calendar == "365_day" else 366), _STARTS[calendar]
        y = _div(days, n)
        rest = days - y * n
        if isinstance(days, Column):
            m = sum((F.when(rest >= s, 1).otherwise(0) for s in starts[1:]), F.lit(1))
            before = F.element_at(F.array(*[F.lit(s) for s in starts]), m)
        else:
            m = sum(rest >= s for s in starts)
            before = starts[m - 1]
        return y + 1970, m, rest - before + 1
    new, old = _to_civil(days, True), _to_civil(days, False)
    if calendar == "proleptic_gregorian":
        return new
    if calendar == "julian":
        return old
    return tuple(_pick(days >= _REFORM, a, b) for a, b in zip(new, old))


def days_in_month(year, month, calendar: str):
    after = days_from_date(_pick(month == 12, year + 1, year), _pick(month == 12, month * 0 + 1, month + 1), 1, calendar)
    return after - days_from_date(year, month, 1, calendar)


def parse_date(text: str) -> tuple[int, int, int, int, int, float]:
    """An ISO-like date-time: year, month, day, hour, minute, second; later parts may be missing."""
    m = re.match(r"\s*(-?\d{1,6})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T\s]+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?)?)?)?\s*(?:Z|UTC|[+]0{1,2}:?0{0,2})?\s*$", text)
    if not m:
        raise ValueError(f"can't read the date {text!r}")
    return int(m[1]), int(m[2] or 1), int(m[3] or 1), int(m[4] or 0), int(m[5] or 0), float(m[6] or 0)


def epoch_seconds(text: str, calendar: str) -> float:
    y, m, d, h, mi, s = parse_date(text)
    return days_from_date(y, m, d, calendar) * 86400.0 + h * 3600 + mi * 60 + s


def decode(elapsed: Column, units) -> dict[str, Column]:
    """Date parts of a column of reference times."""
    total = elapsed * units.scale + epoch_seconds(units.epoch, units.calendar)
    total = F.round(total, 6)
    days = F.floor(total / 86400).cast("long")
    rest = total - days * 86400
    y, m, d = date_from_days(days, units.calendar)
    hour = F.floor(rest / 3600).cast("long")
    minute = F.floor((rest - hour * 3600) / 60).cast("long")
    return {"year": y, "month": m, "day": d, "hour": hour, "minute": minute, "second": rest - hour * 3600 - minute * 60}


def encode(parts: dict[str, Column], units) -> Column:
    """Elapsed time in reference-time units of date parts."""
    zero = F.lit(0)
    seconds = days_from_date(parts["year"], parts.get("month", F.lit(1)), parts.get("day", F.lit(1)), units.calendar) * 86400.0
    seconds = seconds + parts.get("hour", zero) * 3600 + parts.get("minute", zero) * 60 + parts.get("second", zero)
    return (seconds - epoch_seconds(units.epoch, units.calendar)) / units.scale


def timestamp_parts(t: Column) -> dict[str, Column]:
    """Date parts of a timestamp column (proleptic Gregorian)."""
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t)}


def change_calendar(elapsed: Column, units, calendar: str):
    """(elapsed times of the same dates in another calendar, their units)."""
    from gridloom.functions.units import Units

    new = Units.of(units.text, calendar)
    # The parts are bound once: put into one another, the two formulas are too long to be compiled in reasonable time.
    parts = F.transform(F.array(elapsed), lambda t: F.struct(*[x.alias(k) for k, x in decode(t, units).items()]))
    return F.transform(parts, lambda p: encode({k: p[k] for k in ("year", "month", "day", "hour", "minute", "second")}, new))[0], new


def override_calendar(units, calendar: str):
    """The same elapsed times, taken to be of another calendar: their new units."""
    from gridloom.functions.units import Units

    return Units.of(units.text, calendar)


def unique_calendars(units) -> set[str]:
    """The different calendars of many units of reference time."""
    return {canonical(u.calendar) for u in units if u.is_reference_time}


def as_string(parts: dict[str, Column]) -> Column:
    return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *[parts[k].cast("int") for k in ("year", "month", "day", "hour", "minute", "second")])


_FIXED = {"day": 86400.0, "hour": 3600.0, "minute": 60.0, "second": 1.0}


@dataclass(frozen=True)
class TimeDuration:
    """A length of time in calendar years or months or in fixed units, with the place at which its periods start.

    month, day, hour, minute and second tell where a period starts: a year at that month, day and time, a month at
    that day and time, a day at that time, and so on.
    """

    length: float
    unit: str
    month: int = 1
    day: int = 1
    hour: int = 0
    minute: int = 0
    second: int = 0

    @property
    def months(self) -> int | None:
        """Whole calendar months, or None for a fixed length."""
        if self.unit not in ("year", "month"):
            return None
        n = self.length * (12 if self.unit == "year" else 1)
        if n != int(n):
            raise ValueError(f"{self.length} {self.unit}s are no whole number of months")
        return int(n)

    @property
    def seconds(self) -> float | None:
        return None if self.unit not in _FIXED else self.length * _FIXED[self.unit]

    @property
    def iso(self) -> str:
        n = f"{self.length:g}"
        return f"P{n}{'Y' if self.unit == 'year' else 'M' if self.unit == 'month' else 'D'}" if self.unit in ("year", "month", "day") else f"PT{n}{self.unit[0].upper()}"

    @property
    def is_day_factor(self) -> bool:
        return self.seconds is not None and 0 < self.seconds <= 86400 and 86400 % self.seconds == 0

    def __mul__(self, k: float) -> TimeDuration:
        return TimeDuration(self.length * k, self.unit, self.month, self.day, self.hour, self.minute, self.second)

    __rmul__ = __mul__

    def __neg__(self) -> TimeDuration:
        return self * -1

    def _comparable(self, other: TimeDuration) -> tuple[float, float]:
        if (self.months is None) != (other.months is None):
            raise ValueError("calendar and fixed durations can't be compared")
        return (self.months, other.months) if self.months is not None else (self.seconds, other.seconds)

    def __lt__(self, other: TimeDuration) -> bool:
        a, b = self._comparable(other)
        return a < b

    def __le__(self, other: TimeDuration) -> bool:
        a, b = self._comparable(other)
        return a <= b

    def same_length(self, other: TimeDuration) -> bool:
        a, b = self._comparable(other)
        return a == b

    def add_to(self, t: Column, sign: int = 1) -> Column:
        """A timestamp column plus the duration; a day after the month's end becomes its last day."""
        if self.months is not None:
            return t + F.make_interval(months=F.lit(sign * self.months))
        return t + F.make_dt_interval(secs=F.lit(float(sign * self.seconds)))

    def add_to_date(self, date: tuple, calendar: str = "standard", sign: int = 1) -> tuple:
        """A date tuple (year, month, day, hour, minute, second) plus the duration."""
        y, m, d, h, mi, s = date
        if self.months is not None:
            n = y * 12 + m - 1 + sign * self.months
            y, m = n // 12, n % 12 + 1
            return y, m, min(d, days_in_month(y, m, calendar)), h, mi, s
        total = days_from_date(y, m, d, calendar) * 86400.0 + h * 3600 + mi * 60 + s + sign * self.seconds
        days = math.floor(total / 86400)
        rest = total - days * 86400
        return (*date_from_days(days, calendar), int(rest // 3600), int(rest % 3600 // 60), rest % 60)

    def interval(self, date: tuple, calendar: str = "standard", end: bool = False) -> tuple[tuple, tuple]:
        """The period of this length that starts, or with end ends, at a date."""
        return (self.add_to_date(date, calendar, -1), date) if end else (date, self.add_to_date(date, calendar))

    def bucket(self, t: Column) -> Column:
        """A number for the period of this length that a timestamp lies in, counting from the period's start."""
        shift = F.make_dt_interval(hours=F.lit(self.hour), mins=F.lit(self.minute), secs=F.lit(float(self.second)))
        if self.months is not None:
            at = t - F.make_dt_interval(days=F.lit(self.day - 1)) - shift
            n = F.year(at) * 12 + F.month(at) - 1 - (self.month - 1 if self.unit == "year" else 0)
            return F.floor(n / self.months).cast("long")
        micros = F.unix_micros((t - shift if self.unit != "second" else t).cast("timestamp"))
        return F.floor(micros / (self.seconds * 1e6)).cast("long")

    def bounds(self, t: Column) -> tuple[Column, Column]:
        """Start and end of the period that a timestamp lies in."""
        b = self.bucket(t)
        shift = F.make_dt_interval(days=F.lit(self.day - 1 if self.months is not None else 0), hours=F.lit(self.hour), mins=F.lit(self.minute), secs=F.lit(float(self.second)))
        if self.months is not None:
            def start(k: Column) -> Column:
                n = k * self.months + (self.month - 1 if self.unit == "year" else 0)
                return F.to_timestamp_ntz(F.make_date(F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"), F.lit(1))) + shift

            return start(b), start(b + 1)
        at = lambda k: F.timestamp_micros((k * self.seconds * 1e6).cast("long")).cast("timestamp_ntz") + shift
        return at(b), at(b + 1)


def Y(n: float = 1, month: int = 1, day: int = 1, hour: int = 0, minute: int = 0, second: int = 0) -> TimeDuration:
    return TimeDuration(n, "year", month, day, hour, minute, second)


def M(n: float = 1, day: int = 1, hour: int = 0, minute: int = 0, second: int = 0) -> TimeDuration:
    return TimeDuration(n, "month", 1, day, hour, minute, second)


def D(n: float = 1, hour: int = 0, minute: int = 0, second: int = 0) -> TimeDuration:
    return TimeDuration(n, "day", 1, 1, hour, minute, second)


def h(n: float = 1, minute: int = 0, second: int = 0) -> TimeDuration:
    return TimeDuration(n, "hour", 1, 1, 0, minute, second)


def m(n: float = 1, second: int = 0) -> TimeDuration:
    return TimeDuration(n, "minute", 1, 1, 0, 0, second)


def s(n: float = 1) -> TimeDuration:
    return TimeDuration(n, "second")
