"""Units of measure: parsing, algebra and conversion of columns.

A unit is a product of powers of base dimensions with a scale and, for temperatures, an offset. A reference-time
unit ("days since 2000-01-01") is a time unit with an epoch and a calendar.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column

#: Base dimensions, in the order of a unit's exponents.
BASE = ("m", "kg", "s", "K", "A", "mol", "cd", "rad")

_PREFIX = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "n": -9, "p": -12, "f": -15}
_LONG_PREFIX = {"tera": 12, "giga": 9, "mega": 6, "kilo": 3, "hecto": 2, "deca": 1, "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9}


def _dims(**powers: int) -> tuple[Fraction, ...]:
    return tuple(Fraction(powers.get(b, 0)) for b in BASE)


#: name: (scale to base units, dimensions, offset to base units)
_NAMED: dict[str, tuple[float, tuple[Fraction, ...], float]] = {}


def _name(names: str, scale: float, offset: float = 0.0, **powers: int) -> None:
    for n in names.split():
        _NAMED[n] = (scale, _dims(**powers), offset)


_name("m meter metre meters metres", 1, m=1)
_name("g gram grams", 1e-3, kg=1)
_name("s sec second seconds", 1, s=1)
_name("min minute minutes", 60, s=1)
_name("h hr hour hours", 3600, s=1)
_name("d day days", 86400, s=1)
_name("week weeks", 7 * 86400, s=1)
_name("year years yr calendar_years", 365.242198781 * 86400, s=1)
_name("month months calendar_months", 365.242198781 * 86400 / 12, s=1)
_name("K kelvin degK degree_K degrees_K", 1, K=1)
_name("Celsius celsius degC degree_C degrees_C degree_Celsius degrees_Celsius", 1, 273.15, K=1)
_name("Fahrenheit degF degree_F degrees_F", 5 / 9, 459.67 * 5 / 9, K=1)
_name("A ampere amperes", 1, A=1)
_name("mol mole moles", 1, mol=1)
_name("cd candela", 1, cd=1)
_name("rad radian radians", 1, rad=1)
_name("sr steradian", 1, rad=2)
_name("degree degrees degrees_north degree_north degree_N degrees_N degreeN degreesN degrees_east degree_east degree_E degrees_E degreeE degreesE deg", math.pi / 180, rad=1)
_name("N newton newtons", 1, kg=1, m=1, s=-2)
_name("Pa pascal pascals", 1, kg=1, m=-1, s=-2)
_name("bar bars", 1e5, kg=1, m=-1, s=-2)
_name("atm atmosphere", 101325, kg=1, m=-1, s=-2)
_name("J joule joules", 1, kg=1, m=2, s=-2)
_name("W watt watts", 1, kg=1, m=2, s=-3)
_name("Hz hertz", 1, s=-1)
_name("L l liter litre liters litres", 1e-3, m=3)
_name("V volt volts", 1, kg=1, m=2, s=-3, A=-1)
_name("C coulomb", 1, A=1, s=1)
_name("knot knots kt", 1852 / 3600, m=1, s=-1)
_name("nautical_mile", 1852, m=1)
_name("mile miles", 1609.344, m=1)
_name("ft foot feet", 0.3048, m=1)
_name("1 count", 1)
_name("% percent", 0.01)
_name("ppm", 1e-6)
_name("psu", 1e-3)
_name("level layer sigma_level", 1)


def _lookup(name: str) -> tuple[float, tuple[Fraction, ...], float]:
    if name in _NAMED:
        return _NAMED[name]
    for prefix, power in sorted(_LONG_PREFIX.items(), key=lambda x: -len(x[0])):
        if name.startswith(prefix) and name[len(prefix) :] in _NAMED:
            scale, dims, offset = _NAMED[name[len(prefix) :]]
            return scale * 10.0**power, dims, offset
    for prefix, power in sorted(_PREFIX.items(), key=lambda x: -len(x[0])):
        if name.startswith(prefix) and name[len(prefix) :] in _NAMED and len(name) > len(prefix):
            scale, dims, offset = _NAMED[name[len(prefix) :]]
            return scale * 10.0**power, dims, offset
    raise ValueError(f"unknown unit {name!r}")


_FACTOR = re.compile(r"([A-Za-z_%]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:(?:\^|\*\*)?([-+]?\d+))?$")


@dataclass(frozen=True)
class Units:
    """A unit; text None stands for undefined units, which match anything."""

    text: str | None
    scale: float = 1.0
    dims: tuple[Fraction, ...] = (Fraction(0),) * len(BASE)
    offset: float = 0.0
    epoch: str | None = None
    calendar: str | None = None

    @staticmethod
    def of(text: str | Units | None, calendar: str | None = None) -> Units:
        if isinstance(text, Units):
            return text
        if text is None:
            return Units(None)
        since = re.match(r"\s*(\w+)\s+(?:since|from|after)\s+(.+?)\s*$", text)
        if since:
            scale, dims, _ = _lookup(since[1])
            if dims != _dims(s=1):
                raise ValueError(f"{since[1]!r} is no unit of time")
            return Units(text, scale, dims, 0.0, since[2], calendar or "standard")
        scale, dims, offset, sign = 1.0, (Fraction(0),) * len(BASE), 0.0, 1
        for part in re.findall(r"/|[^\s/.·](?:[^\s/·.]|\.(?=\d))*", text.strip()):
            if part == "/":
                sign = -1
                continue
            m = _FACTOR.match(part)
            if not m:
                raise ValueError(f"can't read the unit {text!r}")
            power = sign * int(m[2] or 1)
            if m[1][0].isdigit() and m[1] != "1":
                s, d, o = float(m[1]), (Fraction(0),) * len(BASE), 0.0
            else:
                s, d, o = _lookup(m[1])
            scale *= s**power
            dims = tuple(a + b * power for a, b in zip(dims, d))
            offset = o if text.strip() == part else 0.0
            sign = 1
        return Units(text, scale, dims, offset)

    @property
    def defined(self) -> bool:
        return self.text is not None

    @property
    def is_reference_time(self) -> bool:
        return self.epoch is not None

    @property
    def dimensionless(self) -> bool:
        return not any(self.dims)

    def equivalent(self, other: Units) -> bool:
        if not self.defined or not other.defined:
            return True
        if self.is_reference_time != other.is_reference_time:
            return False
        return self.dims == other.dims and (not self.is_reference_time or self.calendar == other.calendar)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Units):
            return NotImplemented
        if self.defined != other.defined:
            return False
        return (self.dims, self.offset, self.epoch, self.calendar) == (other.dims, other.offset, other.epoch, other.calendar) and math.isclose(self.scale, other.scale, rel_tol=1e-12)

    def __hash__(self) -> int:
        return hash((self.dims, self.epoch, self.calendar))

    def _made(self, text: str, scale: float, dims: tuple[Fraction, ...]) -> Units:
        return Units(text, scale, dims)

    def __mul__(self, other: Units) -> Units:
        if not self.defined or not other.defined:
            return other if not self.defined else self
        self._plain(), other._plain()
        return self._made(f"{self.text} {other.text}".replace("1 ", "", 1) if self.text == "1" else f"{self.text} {other.text}", self.scale * other.scale, tuple(a + b for a, b in zip(self.dims, other.dims)))

    def __truediv__(self, other: Units) -> Units:
        if not other.defined:
            return self
        return (self if self.defined else Units.of("1")) * other**-1

    def __pow__(self, power: int | float | Fraction) -> Units:
        if not self.defined:
            return self
        self._plain()
        p = Fraction(power).limit_denominator(1000)
        return self._made(f"({self.text})^{p}", self.scale ** float(p), tuple(d * p for d in self.dims))

    def _plain(self) -> None:
        if self.offset or self.is_reference_time:
            raise ValueError(f"{self.text!r} has an origin of its own; it can't be multiplied")

    def conversion(self, other: Units) -> tuple[float, float]:
        """(a, b) with value in other = a * value in self + b."""
        if not self.defined or not other.defined or self == other:
            return 1.0, 0.0
        if not self.equivalent(other):
            raise ValueError(f"units {self.text!r} and {other.text!r} are not equivalent")
        a = self.scale / other.scale
        if self.is_reference_time:
            from gridloom.functions.calendars import epoch_seconds

            return a, (epoch_seconds(self.epoch, self.calendar) - epoch_seconds(other.epoch, other.calendar)) / other.scale
        return a, (self.offset - other.offset) / other.scale

    def convert(self, column: Column, other: Units) -> Column:
        """column, in these units, in other units; no arithmetic if they are equal."""
        a, b = self.conversion(other)
        out = column if a == 1.0 else column * a
        return out if b == 0.0 else out + b

    def convert_number(self, x: float, other: Units) -> float:
        a, b = self.conversion(other)
        return x if (a, b) == (1.0, 0.0) else a * x + b


NONE, ONE, RADIANS, METRES = Units(None), Units.of("1"), Units.of("radian"), Units.of("m")


def added(left: Units, right: Units, minus: bool = False) -> tuple[Units, Units]:
    """(units of left + right, units to convert right to). One side without units takes the other's."""
    if left.is_reference_time and right.is_reference_time:
        if not minus:
            raise ValueError("two reference times can't be added")
        return Units.of(left.text.split(" since ")[0]), left
    if left.is_reference_time and right.defined:
        step = Units.of(left.text.split(" since ")[0])
        if not right.equivalent(step):
            raise ValueError(f"{right.text!r} can't be added to a reference time")
        return left, step
    if not left.equivalent(right):
        raise ValueError(f"units {left.text!r} and {right.text!r} are not equivalent")
    return (left, left) if left.defined else (right, right)
