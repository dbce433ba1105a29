"""Reading files of any supported format into cubes, and writing cubes."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.functions import cellmethods
from gridloom.functions.units import Units
from gridloom.operators import reshape
from gridloom.operators.catalog import CubeList
from gridloom.operators.combine import aggregate as join_fields
from gridloom.operators.cube import Axis, Cube
from gridloom.sources import netcdf3, zarr

_KINDS = {"longitude": "X", "grid_longitude": "X", "projection_x_coordinate": "X", "latitude": "Y", "grid_latitude": "Y", "projection_y_coordinate": "Y", "time": "T", "air_pressure": "Z", "altitude": "Z", "height": "Z", "depth": "Z"}
#: Attributes that say how data are stored and not what they are.
_STORAGE = ("_FillValue", "missing_value", "scale_factor", "add_offset", "units", "calendar", "standard_name", "cell_methods", "bounds", "coordinates", "valid_min", "valid_max", "valid_range")


def format_of(path: str) -> str:
    """netcdf3, zarr, um or parquet, by what is there."""
    if os.path.isdir(path):
        return "zarr" if any(os.path.exists(os.path.join(path, n)) for n in ("zarr.json", ".zarray")) else "parquet"
    with open(path, "rb") as f:
        head = f.read(4)
    return "netcdf3" if head[:3] == b"CDF" else "parquet" if head == b"PAR1" else "um"


def read(spark: SparkSession, datasets: str | Sequence[str], select: Sequence[str] = (), aggregate: bool = True, dataset_type: Sequence[str] = ()) -> CubeList:
    """All data variables of files on a file system that driver and executors see; fields of several files that differ in one axis
    are joined. select: identities; dataset_type: formats to take, others are passed over."""
    paths, out = [datasets] if isinstance(datasets, str) else list(datasets), []
    for p in paths:
        kind = format_of(p)
        if dataset_type and kind not in dataset_type:
            continue
        if kind == "netcdf3":
            out += _netcdf(spark, p)
        elif kind == "zarr":
            out.append(_zarr(spark, p))
        else:
            raise ValueError(f"{p}: {kind} files have tables of their own; see gridloom.sources")
    found = CubeList(out).select_by_identity(*select)
    return _aggregated(found) if aggregate and len(found) > 1 else found


def _netcdf(spark: SparkSession, path: str) -> list[Cube]:
    found = netcdf3.variables(path)
    bounds = {v.attributes[k] for v in found.values() for k in ("bounds", "climatology") if k in v.attributes}
    aux = {n for v in found.values() for n in str(v.attributes.get("coordinates", "")).split()}
    out = []
    for v in found.values():
        if v.name in v.dims or v.name in bounds or v.name in aux or v.kind == "S1":
            continue
        axes = {d: _axis(spark, path, found, d, n) for d, n in zip(v.dims, v.shape)}
        own = v.attributes
        methods = tuple(cellmethods.parse(own["cell_methods"])) if own.get("cell_methods") else ()
        properties = {k: x for k, x in own.items() if k not in _STORAGE}
        out.append(Cube(netcdf3.read(spark, path, v.name), axes, v.name, Units.of(own.get("units"), own.get("calendar")), own.get("standard_name"), properties, methods, ncvar=v.name))
    return out


def _axis(spark: SparkSession, path: str, found: dict[str, netcdf3.Variable], dim: str, size: int) -> Axis:
    if dim not in found or found[dim].kind == "S1":
        return Axis(dim, size)
    v = found[dim]
    index = F.col(f"i_{dim}").alias("i")
    table = netcdf3.read(spark, path, dim).select(index, F.col(dim).cast("double").alias("coord"))
    b = found.get(v.attributes.get("bounds"))
    if b is not None and b.shape == (size, 2):
        side = F.col(f"i_{b.dims[1]}")
        pairs = netcdf3.read(spark, path, b.name).groupBy(index).agg(F.max(F.when(side == 0, F.col(b.name))).cast("double").alias("lower"), F.max(F.when(side == 1, F.col(b.name))).cast("double").alias("upper"))
        table = table.join(pairs, "i")
    units, name = Units.of(v.attributes.get("units"), v.attributes.get("calendar")), v.attributes.get("standard_name")
    kind = v.attributes.get("axis") or _KINDS.get(name) or ("T" if units.is_reference_time else None)
    period = 360.0 if kind == "X" and units.defined and units.equivalent(Units.of("degrees")) and _goes_round(table, b is not None) else None
    return Axis(dim, size, table, units, period, name, kind)


def _goes_round(table, bounded: bool) -> bool:
    """Whether a longitude axis' cells cover the circle: one row of extremes comes to the driver."""
    if bounded:
        low, high = table.agg(F.min(F.least("lower", "upper")), F.max(F.greatest("lower", "upper"))).first()
        return abs(high - low - 360) < 1e-6
    r = table.agg(F.min("coord"), F.max("coord"), F.count("*")).first()
    return r[2] > 1 and abs((r[1] - r[0]) * r[2] / (r[2] - 1) - 360) < 1e-6


def _zarr(spark: SparkSession, path: str) -> Cube:
    m = zarr.metadata(path)
    dims = [str(d) for d in (m["dims"] or range(len(m["shape"])))]
    own = m["attributes"]
    return Cube(zarr.read(spark, path), {d: Axis(d, n) for d, n in zip(dims, m["shape"])}, "value", Units.of(own.get("units"), own.get("calendar")), own.get("standard_name"), {k: v for k, v in own.items() if k not in _STORAGE}, ncvar=os.path.basename(os.path.normpath(path)))


def _aggregated(cubes: CubeList) -> CubeList:
    """Join cubes whose axes all have coordinates; the others stay as they are."""
    ready = [c for c in cubes if c.axes and all(a.table is not None for a in c.axes.values())]
    rest = [c for c in cubes if c not in ready]
    fields = []
    for c in ready:
        axes = {n: a.table.select("i", "coord", *(["lower", "upper"] if a.has_bounds else [])) for n, a in c.axes.items()}
        fields.append({"name": (c.name or c.ncvar, tuple(map(str, c.cell_methods))), "units": c.units, "df": c.df, "value": c.value, "axes": axes, "cube": c})
    out = []
    for f in join_fields(fields):
        c = f["cube"]
        axes = {n: Axis(n, a.size if f["axes"][n] is None else f["axes"][n].count(), f["axes"][n], a.units, a.period, a.standard_name, a.kind) for n, a in c.axes.items()}
        out.append(Cube(f["df"], axes, c.value, c.units, c.name, c.properties, c.cell_methods, ncvar=c.ncvar))
    return CubeList([*out, *rest])


def write(cubes: Cube | Sequence[Cube], path: str, fmt: str = "netcdf3", chunks: dict[str, int] | None = None, mode: str = "error") -> None:
    """Write cubes to one classic netCDF file (coordinates and bounds with them), a cube as Zarr, or cells and axes as Parquet tables."""
    cubes = [cubes] if isinstance(cubes, Cube) else list(cubes)
    if fmt == "parquet":
        for c in cubes:
            place = os.path.join(path, c.ncvar or c.name or "data")
            c.df.write.mode(mode).parquet(os.path.join(place, "cells"))
            for a in c.axes.values():
                if a.table is not None:
                    a.table.write.mode(mode).parquet(os.path.join(place, f"axis_{a.name}"))
        return
    if fmt == "zarr":
        (c,) = cubes
        shape = {a.name: a.size for a in c.axes.values()}
        attributes = {k: v for k, v in (("units", c.units.text), ("standard_name", c.name)) if v}
        zarr.write(c.df.withColumnRenamed(c.value, "value"), path, shape, chunks or shape, attributes=attributes | dict(c.properties))
        return
    if fmt != "netcdf3":
        raise ValueError(f"can't write {fmt!r}")
    dims: dict[str, int] = {}
    fields: dict = {}
    for c in cubes:
        for a in c.axes.values():
            if dims.setdefault(a.name, a.size) != a.size:
                raise ValueError(f"two axes {a.name!r} differ in size")
            if a.table is None or a.name in fields:
                continue
            attrs = {k: v for k, v in (("units", a.units.text), ("calendar", a.units.calendar), ("standard_name", a.standard_name), ("axis", a.kind)) if v}
            if a.has_bounds:
                dims["bounds2"] = 2
                name = f"{a.name}_bounds"
                both = a.table.select(F.col("i").alias(f"i_{a.name}"), F.posexplode(F.array("lower", "upper")).alias("i_bounds2", name))
                fields[name] = (both, [a.name, "bounds2"], "f8", {})
                attrs["bounds"] = name
            fields[a.name] = (a.table.select(F.col("i").alias(f"i_{a.name}"), F.col("coord").cast("double").alias(a.name)), [a.name], "f8", attrs)
        name = c.ncvar or c.name or "data"
        attrs = {k: v for k, v in (("units", c.units.text), ("calendar", c.units.calendar), ("standard_name", c.name), ("cell_methods", " ".join(map(str, c.cell_methods)))) if v}
        attrs |= {k: v for k, v in c.properties.items() if isinstance(v, (str, int, float))}
        fields[name] = (c.df.withColumnRenamed(c.value, name), [a.name for a in c.axes.values()], "f8", attrs)
    netcdf3.write(path, dims, fields, None)


def to_pandas(cube: Cube):
    """The cells with their coordinates as a pandas frame: for cubes that fit on the driver."""
    return cube.with_coords().toPandas()


def to_numpy(cube: Cube):
    """A masked array of the cube's shape: for cubes that fit on the driver."""
    import numpy as np

    sizes = list(cube.shape.values())
    out = np.ma.masked_all(sizes, float)
    rows = cube.df.select(reshape.flat_index(cube.shape).alias("at"), F.col(cube.value).cast("double").alias("v")).where("v IS NOT NULL").toPandas()
    out.reshape(-1)[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out
