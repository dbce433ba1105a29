"""Combining data: binary operations along shared axes, outer products, concatenation and aggregation of many fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions.elementwise import binary
from gridloom.functions.units import NONE, Units


def binary_operation(left: DataFrame, right: DataFrame, axes: Sequence[str], op: str, value: str = "value", units: Units = NONE, right_units: Units = NONE) -> tuple[DataFrame, Units]:
    """left op right, cell by cell on the shared axes; axes of one side only broadcast. Both have every cell of their axes (missing
    ones null), so an inner join loses none."""
    shared = [a for a in axes if a in left.columns and a in right.columns]
    other = right.withColumnRenamed(value, "__right")
    both = left.join(other, shared) if shared else left.crossJoin(other)
    out, result = binary(op, F.col(value), units, F.col("__right"), right_units)
    return both.withColumn(value, out).drop("__right"), result


def misaligned(left: DataFrame, right: DataFrame, index: str, coord: str = "coord", rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
    """Axis rows whose coordinates differ between two axes, or that one of them lacks. Empty for axes that match."""
    both = left.select(index, F.col(coord).alias("__a")).join(right.select(index, F.col(coord).alias("__b")), index, "full_outer")
    same = F.abs(F.col("__a") - F.col("__b")) <= atol + rtol * F.abs(F.col("__b")) if rtol or atol else F.col("__a") == F.col("__b")
    return both.where(~F.coalesce(same, F.lit(False))).select(index, F.col("__a").alias("left"), F.col("__b").alias("right"))


def outerproduct(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """Every value times every other: as large as it says, by definition of the operator."""
    return left.crossJoin(right.withColumnRenamed(value, "__right")).withColumn(value, F.col(value) * F.col("__right")).drop("__right")


def combined_bounds(op: str, x: Sequence, y: Sequence, mode: str | None = None):
    """Bounds (lower, upper) of a binary result, each side's a pair of columns or None, by the mode for which sides must have them."""
    has = (x[1] is not None, y[1] is not None)
    keep = {"and": all(has), "or": any(has), "xor": has[0] != has[1], "none": False}[(mode or config.get("bounds_combination_mode")).lower()]
    if not keep:
        return None
    (a, ab), (b, bb) = x, y
    ab, bb = ab or (a, a), bb or (b, b)
    return tuple(binary(op, p, NONE, q, NONE)[0] for p, q in zip(ab, bb))


def concatenate(parts: Sequence[tuple[DataFrame, int]], index: str, units: Sequence[Units] | None = None, value: str = "value") -> tuple[DataFrame, int]:
    """Parts (rows, size along the axis) one after another, values converted to the first part's units; and the size of the whole."""
    if not parts:
        raise ValueError("nothing to concatenate")
    units = list(units or [NONE] * len(parts))
    out, offset = None, 0
    for (df, size), u in zip(parts, units):
        moved = df.withColumn(index, (F.col(index) + offset).cast("int")).withColumn(value, u.convert(F.col(value), units[0]))
        out = moved if out is None else out.unionByName(moved)
        offset += size
    return out, offset


def aggregate(fields: Sequence[Mapping], contiguous: bool = False, overlap: bool = True, relaxed_units: bool = False) -> list[Mapping]:
    """Join fields that differ in one axis only into as few as possible.

    A field is a mapping with name, units, axes ({name: axis table (i, coord[, lower, upper])}), df and value. Fields group by name,
    equivalent units and axis names. Within a group, axes are compared by a hash of their coordinates, with only the hash,
    size, first and last coordinate of each axis on the driver. Fields that differ in exactly one axis are sorted along it and
    concatenated if their coordinates don't meet or overlap (and, as asked, their bounds don't overlap or leave no gap).
    """
    groups: dict[tuple, list[dict]] = {}
    signed = _signatures([t for f in fields for t in f["axes"].values()])
    for f in fields:
        u = Units.of(f.get("units"))
        key = (f["name"], (u.dims, u.epoch) if u.defined else (None if relaxed_units else "undefined"), tuple(sorted(f["axes"])))
        groups.setdefault(key, []).append(dict(f) | {"signature": {a: signed[id(t)] for a, t in f["axes"].items()}})
    out: list[Mapping] = []
    for key, members in groups.items():
        for axis in key[2]:
            lines: dict[tuple, list[dict]] = {}
            for f in members:
                lines.setdefault(tuple(f["signature"][a]["hash"] for a in key[2] if a != axis), []).append(f)
            members = [m for line in lines.values() for m in _along(line, axis, contiguous, overlap)]
        out += [{k: v for k, v in f.items() if k != "signature"} for f in members]
    return out


def _signatures(tables: Sequence[DataFrame], at_once: int = 256) -> dict[int, dict]:
    """By identity of an axis table: a hash of its rows, its size, first and last coordinate and outer bounds. One job for many tables."""
    out: dict[int, dict] = {}
    kinds: dict[str, list[DataFrame]] = {}
    for t in {id(t): t for t in tables}.values():
        kinds.setdefault(t.schema["coord"].dataType.simpleString(), []).append(t)
    for some in [ts[k : k + at_once] for ts in kinds.values() for k in range(0, len(ts), at_once)]:
        rows = [_row_digests(t).withColumn("k", F.lit(k)) for k, t in enumerate(some)]
        while len(rows) > 1:  # a balanced union
            rows = [a.unionByName(b) for a, b in zip(rows[::2], rows[1::2])] + rows[len(rows) // 2 * 2 :]
        grouped = rows[0].groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("h"), *[f(c).alias(n) for f, c, n in ((F.min, "coord", "first"), (F.max, "coord", "last"), (F.min, "low", "lo"), (F.max, "high", "hi"))])
        found = {r["k"]: r for r in grouped.collect()}
        for k, t in enumerate(some):
            r = found.get(k)
            out[id(t)] = {"hash": (r["n"], str(r["h"])), "size": r["n"], "first": r["first"], "last": r["last"], "lo": r["lo"], "hi": r["hi"]} if r else {"hash": (0, "None"), "size": 0, "first": None, "last": None, "lo": None, "hi": None}
    return out


def _row_digests(axis: DataFrame) -> DataFrame:
    bounds = "lower" in axis.columns
    digest = F.xxhash64("i", F.xxhash64("coord", *(["lower", "upper"] if bounds else [])))
    low, high = (F.least("lower", "upper"), F.greatest("lower", "upper")) if bounds else (F.lit(None), F.lit(None))
    return axis.select(digest.alias("digest"), "coord", low.cast("double").alias("low"), high.cast("double").alias("high"))


def _along(line: list[dict], axis: str, contiguous: bool, overlap: bool) -> list[dict]:
    """One line of fields that differ along an axis at most -> the same joined, or as they were if the rules forbid it."""
    if len(line) < 2:
        return line
    line = sorted(line, key=lambda f: f["signature"][axis]["first"])
    for a, b in zip(line, line[1:]):
        x, y = a["signature"][axis], b["signature"][axis]
        if x["last"] >= y["first"]:
            return line
        if x["hi"] is not None and y["lo"] is not None and ((x["hi"] > y["lo"] and not overlap) or (contiguous and x["hi"] < y["lo"])):
            return line
    first, value = line[0], line[0].get("value", "value")
    index = f"i_{axis}"
    df, _ = concatenate([(f["df"], f["signature"][axis]["size"]) for f in line], index, [Units.of(f.get("units")) for f in line], value)
    table, _ = concatenate([(f["axes"][axis], f["signature"][axis]["size"]) for f in line], "i", None, "coord")
    s = [f["signature"][axis] for f in line]
    joined = {"hash": tuple(x["hash"] for x in s), "size": sum(x["size"] for x in s), "first": s[0]["first"], "last": s[-1]["last"], "lo": s[0]["lo"], "hi": s[-1]["hi"]}
    return [first | {"df": df, "axes": first["axes"] | {axis: table}, "signature": first["signature"] | {axis: joined}}]


def allclose(left: DataFrame, right: DataFrame, axes: Sequence[str], value: str = "value", rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    """Whether two fields have the same cells with values equal within tolerances; missing equals missing."""
    both = left.join(right.withColumnRenamed(value, "__right"), list(axes), "full_outer")
    same = (F.abs(F.col(value) - F.col("__right")) <= atol + rtol * F.abs(F.col("__right"))) | (F.col(value) == F.col("__right")) | (F.col(value).isNull() & F.col("__right").isNull())
    return both.where(~F.coalesce(same, F.lit(False))).isEmpty() and left.count() == right.count()
