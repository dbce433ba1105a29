"""Lists of cubes: selection by name, properties, units and shape. Only metadata is looked at, on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from gridloom.functions.query import Query
from gridloom.functions.units import Units
from gridloom.operators.cube import Cube


def _matches(wanted, found) -> bool:
    if isinstance(wanted, re.Pattern):
        return found is not None and wanted.search(str(found)) is not None
    if isinstance(wanted, Query):
        return found is not None and _plain(wanted, found)
    return wanted == found


def _plain(q: Query, x) -> bool:
    """A condition on a plain value."""
    if q.op in ("and", "or"):
        a, b = _plain(q.left, x), _plain(q.right, x)
        return (a and b) if q.op == "and" else (a or b)
    v = q.value
    tests: dict[str, Callable[[], bool]] = {
        "lt": lambda: x < v, "le": lambda: x <= v, "gt": lambda: x > v, "ge": lambda: x >= v, "eq": lambda: _matches(v, x), "ne": lambda: not _matches(v, x),
        "wi": lambda: v[0] <= x <= v[1], "wo": lambda: x < v[0] or x > v[1], "set": lambda: any(_matches(i, x) for i in v),
    }
    if q.op not in tests:
        raise ValueError(f"{q.op!r} is no condition on a plain value")
    return tests[q.op]()


class CubeList(list):
    def _picked(self, keep: Callable[[Cube], bool]) -> CubeList:
        return CubeList(c for c in self if keep(c))

    def select_by_identity(self, *identities) -> CubeList:
        return self._picked(lambda c: match_by_identity(c, *identities))

    select = __call__ = select_by_identity

    def select_by_property(self, mode: str = "and", **properties) -> CubeList:
        return self._picked(lambda c: match_by_property(c, mode, **properties))

    def select_by_units(self, *units: str, exact: bool = True) -> CubeList:
        return self._picked(lambda c: match_by_units(c, *units, exact=exact))

    def select_by_rank(self, *ranks) -> CubeList:
        return self._picked(lambda c: match_by_rank(c, *ranks))

    select_by_naxes = select_by_rank

    def select_by_ncvar(self, *names) -> CubeList:
        return self._picked(lambda c: not names or any(_matches(n, c.ncvar) for n in names))

    def select_by_construct(self, *axes: str, OR: bool = False) -> CubeList:
        """By axes, each named by its name, standard name or kind."""
        def has(c: Cube, identity: str) -> bool:
            return any(_matches(identity, x) for a in c.axes.values() for x in (a.name, a.standard_name, a.kind))

        return self._picked(lambda c: (any if OR else all)(has(c, a) for a in axes))

    def select_field(self, *identities, default=None) -> Cube:
        found = self.select_by_identity(*identities)
        if len(found) == 1:
            return found[0]
        if default is not None:
            return default
        raise ValueError(f"{len(found)} fields match")

    def sort(self, key: Callable[[Cube], object] | None = None, reverse: bool = False) -> None:
        super().sort(key=key or (lambda c: str(c.name)), reverse=reverse)

    def concatenate(self, axis: str) -> Cube:
        return Cube.concatenate(self, axis)


def match_by_identity(c: Cube, *identities) -> bool:
    return not identities or any(_matches(i, x) for i in identities for x in c.identities())


def match_by_property(c: Cube, mode: str = "and", **properties) -> bool:
    known = {**c.properties, "standard_name": c.name}
    return not properties or (any if mode == "or" else all)(_matches(v, known.get(k)) for k, v in properties.items())


def match_by_units(c: Cube, *units: str, exact: bool = True) -> bool:
    return not units or any(c.units == Units.of(u) if exact else c.units.equivalent(Units.of(u)) for u in units)


def match_by_ncvar(c: Cube, *ncvars) -> bool:
    return c.ncvar is not None and (not ncvars or any(_matches(n, c.ncvar) for n in ncvars))


def match_by_rank(c: Cube, *ranks: int | Query) -> bool:
    return not ranks or any(_matches(r, len(c.axes)) for r in ranks)


def unique(cubes: Sequence[Cube]) -> CubeList:
    """Without repetitions of the same metadata."""
    seen, out = set(), CubeList()
    for c in cubes:
        key = (c.name, c.units, tuple(c.shape.items()), tuple(map(str, c.cell_methods)), tuple(sorted(map(str, c.properties.items()))))
        if key not in seen:
            seen.add(key)
            out.append(c)
    return out
