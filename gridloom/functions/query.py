"""Stored conditions that compile to Boolean columns.

A condition is compiled against a set of named columns: `coord` (the values), `lower` and `upper` (cell bounds), and
the date parts. Units of a condition's values are converted to the column's, never the column itself, so that a
condition on a stored column still reaches the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions.units import NONE, Units


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


@dataclass(frozen=True)
class Query:
    op: str
    value: object = None
    units: Units = NONE
    attr: tuple[str, ...] = ()
    options: Mapping = field(default_factory=dict)
    left: Query | None = None
    right: Query | None = None

    def __and__(self, other: Query) -> Query:
        return Query("and", left=self, right=other)

    def __or__(self, other: Query) -> Query:
        return Query("or", left=self, right=other)

    def addattr(self, attr: str) -> Query:
        """The condition on a part of what it was on, such as a date part or a bound."""
        if self.left is not None:
            return replace(self, left=self.left.addattr(attr), right=self.right.addattr(attr))
        return replace(self, attr=(attr, *self.attr))

    def set_condition_units(self, units: str | Units) -> Query:
        """The condition with its values converted to other units, or given them if it has none."""
        new = Units.of(units)
        if self.left is not None:
            return replace(self, left=self.left.set_condition_units(new), right=self.right.set_condition_units(new))
        return replace(self, value=self._in(new), units=new)

    def setdefault(self, rtol: float | None = None, atol: float | None = None) -> Query:
        if self.left is not None:
            return replace(self, left=self.left.setdefault(rtol, atol), right=self.right.setdefault(rtol, atol))
        return replace(self, options={"rtol": rtol, "atol": atol} | {k: v for k, v in self.options.items() if v is not None})

    def iscontains(self) -> bool:
        return self.op == "contains" or (self.left is not None and (self.left.iscontains() or self.right.iscontains()))

    def equals(self, other: object) -> bool:
        return isinstance(other, Query) and self == other

    def _in(self, units: Units):
        if not self.units.defined or not units.defined or self.value is None or isinstance(self.value, (str, re.Pattern)):
            return self.value
        change = lambda v: self.units.convert(v, units) if isinstance(v, Column) else self.units.convert_number(v, units)
        return tuple(map(change, self.value)) if isinstance(self.value, (tuple, list, set, frozenset)) else change(self.value)

    def column(self, columns: Mapping[str, Column], units: Units = NONE) -> Column:
        """The condition as a Boolean column. Null wherever what it looks at is null."""
        if self.op == "and":
            return self.left.column(columns, units) & self.right.column(columns, units)
        if self.op == "or":
            return self.left.column(columns, units) | self.right.column(columns, units)
        x = columns[self.attr[-1] if self.attr else "coord"]
        return self._compiled(x, columns, units if not self.attr else NONE)

    def __call__(self, x: Column, units: Units = NONE) -> Column:
        return self.column({"coord": x}, units)

    evaluate = __call__

    def _compiled(self, x: Column, columns: Mapping[str, Column], units: Units) -> Column:
        v, o = self._in(units), self.options
        if self.op in ("lt", "le", "gt", "ge"):
            return {"lt": x.__lt__, "le": x.__le__, "gt": x.__gt__, "ge": x.__ge__}[self.op](_lit(v))
        if self.op in ("eq", "ne"):
            same = x.rlike(v.pattern) if isinstance(v, re.Pattern) else x == _lit(v)
            return same if self.op == "eq" else ~same
        if self.op == "isclose":
            rtol, atol = (config.get("rtol") if o.get("rtol") is None else o["rtol"]), (config.get("atol") if o.get("atol") is None else o["atol"])
            return F.abs(x - _lit(v)) <= atol + rtol * F.abs(_lit(v))
        if self.op == "wi":
            low = x > _lit(v[0]) if o.get("open_lower") else x >= _lit(v[0])
            return low & (x < _lit(v[1]) if o.get("open_upper") else x <= _lit(v[1]))
        if self.op == "wo":
            return (x < _lit(v[0])) | (x > _lit(v[1]))
        if self.op == "set":
            plain, found = [i for i in v if not isinstance(i, re.Pattern)], F.lit(False)
            if plain:
                found = x.isin(*plain)
            for p in v:
                if isinstance(p, re.Pattern):
                    found = found | x.rlike(p.pattern)
            return found
        low, high = F.least(columns["lower"], columns["upper"]), F.greatest(columns["lower"], columns["upper"])
        if self.op == "contains":
            return (low <= _lit(v)) & (high >= _lit(v))
        if self.op == "cellsize":
            return v.column({"coord": high - low}, units) if isinstance(v, Query) else (high - low) == _lit(v)
        compiled: dict[str, Callable[[], Column]] = {
            "cellwi": lambda: (low >= _lit(v[0])) & (high <= _lit(v[1])), "cellwo": lambda: (low < _lit(v[0])) & (high > _lit(v[1])),
            "cellgt": lambda: low > _lit(v), "cellge": lambda: low >= _lit(v), "celllt": lambda: high < _lit(v), "cellle": lambda: high <= _lit(v),
        }
        return compiled[self.op]()


def _plain(op: str):
    def make(value, units: str | None = None, attr: str | None = None, **options) -> Query:
        if value is None:
            raise ValueError("a condition needs a value")
        return Query(op, value, Units.of(units), (attr,) if attr else (), options)

    make.__name__ = op
    return make


def _pair(op: str):
    def make(value0, value1, units: str | None = None, attr: str | None = None, **options) -> Query:
        return Query(op, (value0, value1), Units.of(units), (attr,) if attr else (), options)

    make.__name__ = op
    return make


lt, le, gt, ge, eq, ne, isclose = map(_plain, ("lt", "le", "gt", "ge", "eq", "ne", "isclose"))
contains, cellsize, cellgt, cellge, celllt, cellle = map(_plain, ("contains", "cellsize", "cellgt", "cellge", "celllt", "cellle"))
wi, wo, cellwi, cellwo = map(_pair, ("wi", "wo", "cellwi", "cellwo"))


def set_(values, units: str | None = None, attr: str | None = None) -> Query:
    return Query("set", tuple(values), Units.of(units), (attr,) if attr else ())


def _dated(op: str):
    def make(date: str, calendar: str | None = None) -> Query:
        """A condition on times by a date: years, months and days are decoded, so that any units and calendar of time do."""
        from gridloom.functions.calendars import parse_date

        parts = dict(zip(("year", "month", "day", "hour", "minute", "second"), parse_date(date)))
        strict, out = Query("gt" if op in ("gt", "ge") else "lt", None), None
        for name, v in reversed(parts.items()):
            last = Query(op, v, NONE, (name,)) if out is None else Query(strict.op, v, NONE, (name,)) | (Query("eq", v, NONE, (name,)) & out)
            out = last
        return out

    make.__name__ = f"dt{op}"
    return make


dtgt, dtge, dtlt, dtle = map(_dated, ("gt", "ge", "lt", "le"))


def _part(name: str):
    def make(value) -> Query:
        return (value if isinstance(value, Query) else eq(value)).addattr(name)

    make.__name__ = name
    return make


year, month, day, hour, minute, second = map(_part, ("year", "month", "day", "hour", "minute", "second"))


def mam() -> Query:
    return month(wi(3, 5))


def jja() -> Query:
    return month(wi(6, 8))


def son() -> Query:
    return month(wi(9, 11))


def djf() -> Query:
    return month(ge(12) | le(2))


def seasons(n: int = 4, start: int = 12) -> list[Query]:
    """n seasons of equal length that cover the year, the first from the month start."""
    if n < 1 or 12 % n or not 1 <= start <= 12:
        raise ValueError("n must divide 12, and start be a month")
    out, width = [], 12 // n
    for k in range(n):
        a = (start - 1 + k * width) % 12 + 1
        b = (a - 1 + width - 1) % 12 + 1
        out.append(month(wi(a, b) if a <= b else ge(a) | le(b)))
    return out
