"""Vertical coordinates computed from parametric ones. All terms are columns in the same units of length or pressure."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Terms = Mapping[str, Column]


def _hybrid_pressure(t: Terms) -> Column:
    a = t["ap"] if "ap" in t else t["a"] * t["p0"]
    return a + t["b"] * t["ps"]


def _stretching(t: Terms) -> Column:
    """C of the first s-coordinate."""
    a, b, s = t["a"], t["b"], t["s"]
    return (1 - b) * F.sinh(a * s) / F.sinh(a) + b * (F.tanh(a * (s + 0.5)) / (2 * F.tanh(a / 2)) - 0.5)


def _s(t: Terms) -> Column:
    return t["eta"] * (1 + t["s"]) + t["depth_c"] * t["s"] + (t["depth"] - t["depth_c"]) * _stretching(t)


def _s_g1(t: Terms) -> Column:
    s = t["depth_c"] * t["s"] + (t["depth"] - t["depth_c"]) * t["C"]
    return s + t["eta"] * (1 + s / t["depth"])


def _s_g2(t: Terms) -> Column:
    s = (t["depth_c"] * t["s"] + t["depth"] * t["C"]) / (t["depth"] + t["depth_c"])
    return t["eta"] + (t["eta"] + t["depth"]) * s


def _sigma_z(t: Terms) -> Column:
    shallow = t["eta"] + t["sigma"] * (F.least(t["depth_c"], t["depth"]) + t["eta"])
    return F.when(t["k"] < t["nsigma"], shallow).otherwise(t["zlev"])


def _double_sigma(t: Terms) -> Column:
    f = (t["z1"] + t["z2"]) / 2 + (t["z1"] - t["z2"]) / 2 * F.tanh(2 * t["a"] / (t["z1"] - t["z2"]) * (t["depth"] - t["href"]))
    return F.when(t["k"] <= t["k_c"], t["sigma"] * f).otherwise(f + (t["sigma"] - 1) * (t["depth"] - f))


#: parametric coordinate: (name of the computed one, its formula)
FORMULAS: dict[str, tuple[str, Callable[[Terms], Column]]] = {
    "atmosphere_ln_pressure_coordinate": ("air_pressure", lambda t: t["p0"] * F.exp(-t["lev"])),
    "atmosphere_sigma_coordinate": ("air_pressure", lambda t: t["ptop"] + t["sigma"] * (t["ps"] - t["ptop"])),
    "atmosphere_hybrid_sigma_pressure_coordinate": ("air_pressure", _hybrid_pressure),
    "atmosphere_hybrid_height_coordinate": ("altitude", lambda t: t["a"] + t["b"] * t["orog"]),
    "atmosphere_sleve_coordinate": ("altitude", lambda t: t["a"] * t["ztop"] + t["b1"] * t["zsurf1"] + t["b2"] * t["zsurf2"]),
    "ocean_sigma_coordinate": ("altitude", lambda t: t["eta"] + t["sigma"] * (t["depth"] + t["eta"])),
    "ocean_s_coordinate": ("altitude", _s),
    "ocean_s_coordinate_g1": ("altitude", _s_g1),
    "ocean_s_coordinate_g2": ("altitude", _s_g2),
    "ocean_sigma_z_coordinate": ("altitude", _sigma_z),
    "ocean_double_sigma_coordinate": ("altitude", _double_sigma),
}
#: Terms that may be left out and then count as 0.
OPTIONAL = ("eta", "ptop", "orog", "zsurf1", "zsurf2", "b1", "b2")


def compute(name: str, terms: Terms, default_to_zero: bool = True) -> tuple[str, Column]:
    """(computed standard name, column)."""
    if name not in FORMULAS:
        raise ValueError(f"no formula for {name!r}")
    out, formula = FORMULAS[name]
    known = dict(terms)
    if default_to_zero:
        known = {k: F.lit(0.0) for k in OPTIONAL} | known
    try:
        return out, formula(known)
    except KeyError as e:
        raise ValueError(f"{name} needs the term {e.args[0]!r}") from None
