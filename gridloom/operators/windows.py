"""Operators along one axis: running sums, differences, filters, moving windows, derivatives and cyclic shifts.

Rows are cells; `index` is the dense zero-based position along the axis and `by` the other axes, which keep the work
apart. A long line is cut into blocks of BLOCK positions: frames see the cells of their neighbours' ends as copies, running sums carry
the sums of the blocks before. So a field of one axis is no single window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a line that one window partition holds.
BLOCK = 1 << 16


def _line(by: Sequence[str], index: str):
    return Window.partitionBy(*by).orderBy(index)


def _blocks(df: DataFrame, index: str, before: int = 0, after: int = 0) -> DataFrame:
    """Add __blk, the block of a position, and __here: false for copies of cells that frames of `before` and `after` positions in other blocks
    reach. Blocks are longer where frames are, so that copies stay few."""
    length, at = max(BLOCK, 8 * (before + after)), F.col(index)
    own = F.floor(at / length)
    if not before and not after:
        return df.withColumns({"__blk": own, "__here": F.lit(True)})
    return df.withColumn("__blk", F.explode(F.sequence(F.floor((at - after) / length), F.floor((at + before) / length)))).withColumn("__here", F.col("__blk") == own)


def _joined(df: DataFrame, by: Sequence[str], table: DataFrame) -> DataFrame:
    """df with the columns of a table that has one row for each line, or one row in all; null keys meet."""
    if not by:
        return df.crossJoin(F.broadcast(table))  # one row
    own = table.withColumnsRenamed({k: f"__by_{n}" for n, k in enumerate(by)})
    on = [F.col(k).eqNullSafe(F.col(f"__by_{n}")) for n, k in enumerate(by)]
    return df.join(own, on).drop(*[f"__by_{n}" for n in range(len(by))])


def cumsum(df: DataFrame, by: Sequence[str], index: str, value: str, masked_as_zero: bool = False) -> DataFrame:
    """Running sum; a missing cell is skipped and stays missing, or counts as 0 with masked_as_zero. The positions needn't be dense."""
    rows = _blocks(df, index).drop("__here")
    sums = rows.groupBy(*by, "__blk").agg(F.sum(value).alias("__sum"))
    # One row for each block of a line.
    before = F.sum("__sum").over(_line(by, "__blk").rowsBetween(Window.unboundedPreceding, -1))
    rows = _joined(rows, [*by, "__blk"], sums.select(*by, "__blk", F.coalesce(before, F.lit(0)).alias("__before")))
    inside = F.coalesce(F.sum(value).over(_line([*by, "__blk"], index).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    total = inside + F.col("__before")
    return rows.withColumn(value, total if masked_as_zero else F.when(F.col(value).isNotNull(), total)).select(*df.columns)


def diff(df: DataFrame, by: Sequence[str], index: str, value: str, n: int = 1) -> DataFrame:
    """n-th forward difference; the axis is n cells shorter."""
    if n < 0:
        raise ValueError("n is not negative")
    if n == 0:
        return df
    w = _line([*by, "__blk"], index)
    terms = F.lit(0.0)
    for k in range(n + 1):
        terms = terms + (-1) ** (n - k) * math.comb(n, k) * F.lead(value, k).over(w)
    rows = _blocks(df, index, after=n).withColumns({value: terms, "__last": F.lead(index, n).over(w)})
    return rows.where(F.col("__here") & F.col("__last").isNotNull()).select(*df.columns)


def _extended(df: DataFrame, by: Sequence[str], index: str, depth: int, mode: str) -> DataFrame:
    """df and copies of its cells at up to `depth` positions beyond either end of the line, as mode has them; __own is false for these."""
    rows, i, n = size_of(df, by, index), F.col(index), F.col("__n")

    def every(base: Column, period: Column) -> Column:
        """base + k x period, from -depth to n - 1 + depth."""
        low, high = F.ceil((-depth - base) / period), F.floor((n - 1 + depth - base) / period)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda k: base + k * period)).otherwise(F.array().cast("array<bigint>"))

    i = i.cast("long")
    if mode == "wrap":
        at = every(i, n)
    elif mode == "reflect":
        at = F.concat(every(i, 2 * n), every(-1 - i, 2 * n))
    elif mode == "mirror":  # about the end cells, which aren't repeated
        turned = F.when((i > 0) & (i < n - 1), every(-i, 2 * (n - 1))).otherwise(F.array().cast("array<bigint>"))
        at = F.when(n > 1, F.concat(every(i, 2 * (n - 1)), turned)).otherwise(F.sequence(i - depth, i + depth))
    elif mode == "nearest":
        at = F.sequence(F.when(i == 0, -depth).otherwise(i), F.when(i == n - 1, i + depth).otherwise(i))
    else:
        raise ValueError(f"mode {mode!r} is not one of constant, mirror, nearest, reflect, wrap")
    out = rows.withColumn("__at", F.explode(at))
    return out.withColumns({"__own": F.col("__at") == F.col(index), index: F.col("__at")}).drop("__at", "__n")


def convolution_filter(df: DataFrame, by: Sequence[str], index: str, value: str, window: Sequence[float], mode: str = "wrap", cval: float | None = None, origin: int = 0) -> DataFrame:
    """Convolution with the window's weights (the window is flipped). A missing cell in the window, or a constant edge without
    cval, makes the result missing."""
    offsets = [j - len(window) // 2 + origin for j in range(len(window))]
    before, after = max(0, -min(offsets, default=0)), max(0, *offsets, 0)
    rows = df.withColumn("__own", F.lit(True)) if mode == "constant" else _extended(df, by, index, max(before, after), mode)
    rows = _blocks(rows, index, before, after)
    w, total = _line([*by, "__blk"], index), F.lit(0.0)
    outside = F.lit(None if cval is None else float(cval)).cast("double")
    for offset, weight in zip(offsets, reversed(list(window))):
        x = F.lead(value, offset).over(w)
        if mode == "constant":
            x = F.when(F.lead(index, offset).over(w).isNull(), outside).otherwise(x)
        total = total + float(weight) * x
    kind = df.schema[index].dataType
    return rows.withColumn("__out", total).where("__here AND __own").withColumns({value: F.col("__out"), index: F.col(index).cast(kind)}).select(*df.columns)


def moving_window(df: DataFrame, by: Sequence[str], index: str, value: str, method: str, size: int, weights: str | None = None, mode: str = "constant", origin: int = 0) -> DataFrame:
    """mean, sum or integral over `size` cells around each. In constant mode only cells that exist take part, and a missing one makes
    the result missing; with mode wrap the line is cyclic, with reflect (about the edge), mirror (about the edge's cell) and nearest it
    goes on with copies of its own cells. sum ignores weights, integral needs them."""
    if method not in ("mean", "sum", "integral"):
        raise ValueError(f"moving_window has no method {method!r}")
    if method == "integral" and weights is None:
        raise ValueError("an integral needs weights")
    left = size // 2
    lo, hi = -left + origin, size - 1 - left + origin
    rows = df.withColumn("__own", F.lit(True)) if mode == "constant" else halo(df, by, index, max(-lo, hi, 0), mode=mode)
    rows = _blocks(rows, index, max(-lo, 0), max(hi, 0))
    frame = _line([*by, "__blk"], index).rowsBetween(lo, hi)
    w = F.lit(1.0) if weights is None or method == "sum" else F.col(weights)
    top = F.sum(F.col(value) * w).over(frame)
    out = top if method != "mean" else F.try_divide(top, F.sum(F.when(F.col(value).isNotNull(), w)).over(frame))
    none_missing = F.count(value).over(frame) == F.count(F.lit(1)).over(frame)
    rows = rows.withColumn("__out", F.when(none_missing, out)).where("__here AND __own")
    return rows.drop(value).withColumnRenamed("__out", value).select(*df.columns)


def derivative(df: DataFrame, by: Sequence[str], index: str, value: str, coord: str, wrap: bool = False, period: float | None = None, one_sided_at_boundary: bool = False, out: str | None = None) -> DataFrame:
    """Centred difference quotient; at the ends missing, one-sided, or across the seam of a cyclic axis (whose line is one window)."""
    w, out = _line(by, index), out or value
    if wrap:
        if period is None:
            raise ValueError("a cyclic axis needs its period")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = lambda c, shift: F.coalesce(F.lag(c).over(w), F.when(F.lag(index).over(w).isNull(), F.last(c).over(whole) - shift))
        after = lambda c, shift: F.coalesce(F.lead(c).over(w), F.when(F.lead(index).over(w).isNull(), F.first(c).over(whole) + shift))
        return df.withColumn(out, F.try_divide(after(value, 0) - before(value, 0), after(coord, period) - before(coord, period)))
    rows, w = _blocks(df, index, 1, 1), _line([*by, "__blk"], index)
    x0, x1, c0, c1 = F.lag(value).over(w), F.lead(value).over(w), F.lag(coord).over(w), F.lead(coord).over(w)
    quotient = F.try_divide(x1 - x0, c1 - c0)
    if one_sided_at_boundary:
        here, at = F.col(value), F.col(coord)
        quotient = F.when(c0.isNull(), F.try_divide(x1 - here, c1 - at)).when(c1.isNull(), F.try_divide(here - x0, at - c0)).otherwise(quotient)
    return rows.withColumn("__out", quotient).where("__here").withColumn(out, F.col("__out")).drop("__out", "__blk", "__here")


EARTH = 6371229.0


def grad_xy(df: DataFrame, by: Sequence[str], ix: str, iy: str, x: str, y: str, value: str, spherical: bool = True, radius: float = EARTH, x_wrap: bool = False, one_sided_at_boundary: bool = False) -> DataFrame:
    """Adds grad_x and grad_y. Spherical: x and y are longitude and latitude in degrees, and the parts (1/(r cos lat)) d/dlon and (1/r) d/dlat."""
    lon, lat, period = (F.radians(x), F.radians(y), 2 * math.pi) if spherical else (F.col(x), F.col(y), None)
    rows = df.withColumns({"__x": lon.cast("double"), "__y": lat.cast("double")})
    rows = derivative(rows, [*by, iy], ix, value, "__x", x_wrap, period, one_sided_at_boundary, "grad_x")
    rows = derivative(rows, [*by, ix], iy, value, "__y", False, None, one_sided_at_boundary, "grad_y")
    if spherical:
        rows = rows.withColumns({"grad_x": F.col("grad_x") / (radius * F.cos("__y")), "grad_y": F.col("grad_y") / radius})
    return rows.drop("__x", "__y")


def div_xy(df: DataFrame, by: Sequence[str], ix: str, iy: str, x: str, y: str, fx: str, fy: str, spherical: bool = True, radius: float = EARTH, x_wrap: bool = False, one_sided_at_boundary: bool = False, out: str = "divergence") -> DataFrame:
    """Adds the horizontal divergence of (fx, fy)."""
    return _combined(df, by, ix, iy, x, y, fx, fy, 1, spherical, radius, x_wrap, one_sided_at_boundary, out)


def curl_xy(df: DataFrame, by: Sequence[str], ix: str, iy: str, x: str, y: str, fx: str, fy: str, spherical: bool = True, radius: float = EARTH, x_wrap: bool = False, one_sided_at_boundary: bool = False, out: str = "curl") -> DataFrame:
    """Adds the vertical part of the curl of (fx, fy)."""
    return _combined(df, by, ix, iy, x, y, fy, fx, -1, spherical, radius, x_wrap, one_sided_at_boundary, out)


def _combined(df, by, ix, iy, x, y, along, across, sign, spherical, radius, x_wrap, one_sided, out) -> DataFrame:
    """d(along)/dx + sign * d(across)/dy, with the factors of the sphere."""
    lon, lat, period = (F.radians(x), F.radians(y), 2 * math.pi) if spherical else (F.col(x), F.col(y), None)
    shrink = F.cos(lat) if spherical else F.lit(1.0)
    rows = df.withColumns({"__x": lon.cast("double"), "__y": lat.cast("double"), "__c": F.col(across) * shrink})
    rows = derivative(rows, [*by, iy], ix, along, "__x", x_wrap, period, one_sided, "__dx")
    rows = derivative(rows, [*by, ix], iy, "__c", "__y", False, None, one_sided, "__dy")
    total = F.col("__dx") + sign * F.col("__dy")
    return rows.withColumn(out, total / (radius * F.cos("__y")) if spherical else total).drop("__x", "__y", "__c", "__dx", "__dy")


def laplacian_xy(df: DataFrame, by: Sequence[str], ix: str, iy: str, x: str, y: str, value: str, out: str = "laplacian", **options) -> DataFrame:
    """Divergence of the gradient."""
    rows = grad_xy(df, by, ix, iy, x, y, value, **options)
    return div_xy(rows, by, ix, iy, x, y, "grad_x", "grad_y", out=out, **options).drop("grad_x", "grad_y")


def relative_vorticity(df: DataFrame, by: Sequence[str], ix: str, iy: str, x: str, y: str, u: str, v: str, **options) -> DataFrame:
    return curl_xy(df, by, ix, iy, x, y, u, v, out=options.pop("out", "relative_vorticity"), **options)


def size_of(df: DataFrame, by: Sequence[str], index: str) -> DataFrame:
    """Add __n, the cells of each line."""
    return _joined(df, by, df.groupBy(*by).agg((F.max(index) + 1).alias("__n")))


def roll(df: DataFrame, index: str, shift: int, size: int) -> DataFrame:
    return df.withColumn(index, F.pmod(F.col(index) + shift, F.lit(size)).cast("int"))


def roll_coords(axis: DataFrame, index: str, shift: int, size: int, period: float, coords: Sequence[str]) -> DataFrame:
    """Roll a cyclic axis' table; coordinates that pass the seam are re-based so that they stay in order."""
    at = F.col(index) + shift % size
    out = axis
    for c in coords:
        out = out.withColumn(c, F.when(at >= size, F.col(c) - period).otherwise(F.col(c)))
    return out.withColumn(index, F.pmod(at, F.lit(size)).cast("int"))


def anchor(axis: DataFrame, index: str, size: int, value: float, period: float, coord: str, coords: Sequence[str] = ()) -> DataFrame:
    """Roll a cyclic axis so that its first coordinate is the first at or after value, all within one period from there."""
    base = F.floor((F.col(coord) - value) / period) * period
    shifted = axis.withColumns({c: F.col(c) - base for c in dict.fromkeys([coord, *coords])})
    return shifted.withColumn(index, (F.row_number().over(Window.orderBy(coord)) - 1).cast("int"))


def flip(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn(index, (size - 1 - F.col(index)).cast("int"))


def halo(df: DataFrame, by: Sequence[str], index: str, depth: int, cyclic: bool = False, size: int | None = None, mode: str | None = None) -> DataFrame:
    """Copies `depth` cells of either edge (of the other edge if cyclic) beyond it. Adds __own: false for the copies; the index then
    runs from -depth. mode: wrap (cyclic), reflect, mirror or nearest; the line must be as long as the halo is deep (mirror: longer)."""
    rows = df.withColumn("__n", F.lit(size)) if size is not None else size_of(df, by, index)
    i, n = F.col(index), F.col("__n")
    beyond = lambda at: F.struct(at.cast("int").alias("at"), F.lit(False).alias("own"))
    kinds = {
        "wrap": [(i >= n - depth, i - n), (i < depth, i + n)], "reflect": [(i < depth, -1 - i), (i >= n - depth, 2 * n - 1 - i)],
        "mirror": [((i >= 1) & (i <= depth), -i), ((i <= n - 2) & (i >= n - 1 - depth), 2 * (n - 1) - i)], None: [(i < depth, i - depth), (i >= n - depth, i + depth)],
    }
    mode = "wrap" if cyclic else mode
    if mode not in kinds and mode != "nearest":
        raise ValueError(f"mode {mode!r} is not one of wrap, reflect, mirror, nearest")
    own = F.array(F.struct(i.cast("int").alias("at"), F.lit(True).alias("own")))
    if mode == "nearest":
        more = F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>")
        none = F.array().cast("array<struct<at:int,own:boolean>>")
        copies = F.concat(own, F.when(i == 0, F.transform(more, lambda k: beyond(-k))).otherwise(none), F.when(i == n - 1, F.transform(F.transform(more, lambda k: k), lambda k: beyond(k))).otherwise(none))
        copies = F.transform(copies, lambda c: F.when(~c["own"] & (c["at"] > 0), F.struct((c["at"] + n - 1).cast("int").alias("at"), F.lit(False).alias("own"))).otherwise(c))
    else:
        copies = F.array_compact(F.concat(own, F.array(*[F.when(c, beyond(at)) for c, at in kinds[mode]])))
    out = rows.withColumn("__copy", F.explode(copies))
    return out.withColumns({index: F.col("__copy.at"), "__own": F.col("__copy.own")}).drop("__copy", "__n")


def tripolar_halo(df: DataFrame, ix: str, iy: str, depth: int, nx: int, ny: int, fold_last: bool = True) -> DataFrame:
    """The halo beyond the fold of a tripolar grid: rows next to the fold, mirrored in x."""
    i, j = F.col(iy), F.col(ix)
    near = i >= ny - depth if fold_last else i < depth
    mirrored = df.where(near).withColumns({iy: ((2 * ny - 1 - i) if fold_last else (-1 - i)).cast("int"), ix: (nx - 1 - j).cast("int")})
    return df.unionByName(mirrored)
