"""HEALPix: cell indices, coordinates and refinement levels as integer and trigonometric column expressions.

A cell is the face (0 to 11) of the sphere's base tessellation and its x and y in it. The nested index interleaves
the bits of x and y; the ring index counts along rings of latitude; nuniq and zuniq indices hold the level as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.collapse import canonical, statistic

MAX_LEVEL = 29
SCHEMES = ("nested", "ring", "nuniq", "zuniq")
_MASKS = ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF))


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _or(x: Column, y: Column) -> Column:
    return x.bitwiseOR(y)


def _long_div(q: Column, b: Column) -> Column:
    """q / b in whole numbers, so that no digit is lost."""
    return F.call_function("div", q.cast("long"), b.cast("long"))


def _even_bits(v: Column) -> Column:
    """Bits 0, 2, 4, … of v, moved together."""
    v = _and(v, 0x5555555555555555)
    for shift, mask in _MASKS:
        v = _and(_or(v, F.shiftright(v, shift)), mask)
    return v


def _spread_bits(v: Column) -> Column:
    for shift, mask in zip((16, 8, 4, 2, 1), (0x0000FFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555)):
        v = _and(_or(v, F.shiftleft(v, shift)), mask)
    return v


def _once(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def _xyf(x: Column, y: Column, face: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), face.cast("long").alias("f"))


def nested_to_xyf(p: Column, level: int) -> Column:
    rest = _and(p, (1 << (2 * level)) - 1)
    return _xyf(_even_bits(rest), _even_bits(F.shiftright(rest, 1)), F.shiftright(p, 2 * level))


def xyf_to_nested(c: Column, level: int) -> Column:
    return F.shiftleft(c["f"], 2 * level) + _spread_bits(c["x"]) + F.shiftleft(_spread_bits(c["y"]), 1)


def _face_ring(f: Column) -> Column:
    """Ring number of a face's southernmost corner, in units of nside."""
    return F.when(f < 4, 2).when(f < 8, 3).otherwise(4).cast("long")


def _face_turn(f: Column) -> Column:
    """Longitude of a face's centre in eighths of a turn."""
    return 2 * F.pmod(f, F.lit(4)) + F.when((f >= 4) & (f < 8), 0).otherwise(1)


def xyf_to_ring(c: Column, level: int) -> Column:
    n = 1 << level

    def at(jr: Column) -> Column:
        north, south = jr < n, jr > 3 * n
        nr = F.when(north, jr).when(south, 4 * n - jr).otherwise(n)
        before = F.when(north, 2 * nr * (nr - 1)).when(south, 12 * n * n - 2 * (nr + 1) * nr).otherwise(2 * n * (n - 1) + (jr - n) * 4 * n)
        odd = F.when(north | south, 0).otherwise(_and(jr - n, 1))
        jp = F.shiftright(_face_turn(c["f"]) * nr + c["x"] - c["y"] + 1 + odd, 1)
        jp = F.when(jp > 4 * n, jp - 4 * n).when(jp < 1, jp + 4 * n).otherwise(jp)
        return (before + jp - 1).cast("long")

    return _once(_face_ring(c["f"]) * n - c["x"] - c["y"] - 1, at)


def _isqrt(v: Column) -> Column:
    """Integer square root, put right for rounding."""
    def fixed(r: Column) -> Column:
        return F.when(r * r > v, r - 1).when((r + 1) * (r + 1) <= v, r + 1).otherwise(r)

    return _once(F.floor(F.sqrt(v.cast("double"))).cast("long"), fixed)


def ring_to_xyf(p: Column, level: int) -> Column:
    n = 1 << level
    cap, total = 2 * n * (n - 1), 12 * n * n

    def parts(ring, phi, nr, odd, face) -> Column:
        return F.struct(ring.cast("long").alias("ring"), phi.cast("long").alias("phi"), nr.cast("long").alias("nr"), odd.cast("long").alias("odd"), face.cast("long").alias("f"))

    def north(r: Column) -> Column:
        phi = p + 1 - 2 * r * (r - 1)
        return parts(r, phi, r, F.lit(0), _long_div(phi - 1 - F.pmod(phi - 1, r), r))

    def belt(k: Column) -> Column:
        phi = p - cap - k * 4 * n + 1
        turn = lambda e: F.shiftright(phi - F.shiftright(e, 1) + n - 1, level)
        down, up = turn(k + 1), turn(2 * n + 1 - k)
        face = F.when(up == down, _or(up, F.lit(4).cast("long"))).when(up < down, up).otherwise(down + 8)
        return parts(k + n, phi, F.lit(n), _and(k, 1), face)

    def south(r: Column) -> Column:
        phi = 4 * r + 1 - (total - p - 2 * r * (r - 1))
        return parts(4 * n - r, phi, r, F.lit(0), 8 + _long_div(phi - 1 - F.pmod(phi - 1, r), r))

    k = F.shiftright(p - cap, level + 2)
    at = F.when(p < cap, _once(F.shiftright(1 + _isqrt(1 + 2 * p), 1), north)).when(p < total - cap, _once(k, belt)).otherwise(_once(F.shiftright(1 + _isqrt(2 * (total - p) - 1), 1), south))

    def cell(c: Column) -> Column:
        irt = c["ring"] - _face_ring(c["f"]) * n + 1
        ipt = 2 * c["phi"] - _face_turn(c["f"]) * c["nr"] - c["odd"] - 1
        ipt = F.when(ipt >= 2 * n, ipt - 8 * n).otherwise(ipt)
        return _xyf(F.shiftright(ipt - irt, 1), F.shiftright(-ipt - irt, 1), c["f"])

    return _once(at, cell)


def nested_to_ring(p: Column, level: int) -> Column:
    return _once(p, lambda v: _once(nested_to_xyf(v, level), lambda c: xyf_to_ring(c, level)))


def ring_to_nested(p: Column, level: int) -> Column:
    # The index is computed once, however often the steps use it: it may be an expression as long as this one.
    return _once(p, lambda v: _once(ring_to_xyf(v, level), lambda c: xyf_to_nested(c, level)))


def to_nuniq(p: Column, level: int) -> Column:
    """Of a nested index."""
    return p + (4 ** (level + 1))


def to_zuniq(p: Column, level: int) -> Column:
    """Of a nested index."""
    return F.shiftleft(2 * p + 1, 2 * (MAX_LEVEL - level))


def _trailing_zeros(v: Column) -> Column:
    return F.bit_count(v.bitwiseAND(-v) - 1)


def zuniq_level(z: Column) -> Column:
    return (MAX_LEVEL - F.shiftright(_trailing_zeros(z).cast("long"), 1)).cast("int")


def _shift(v: Column, by: Column, left: bool) -> Column:
    return F.call_function("shiftleft" if left else "shiftright", v, by.cast("int"))


def zuniq_to_nested(z: Column) -> Column:
    return F.shiftright(_shift(z, 2 * (MAX_LEVEL - zuniq_level(z)), False), 1)


def nuniq_level(u: Column) -> Column:
    """Bits of u less one, halved, less one."""
    bits = F.length(F.bin(u))
    return (F.shiftright((bits - 1).cast("long"), 1) - 1).cast("int")


def nuniq_to_nested(u: Column) -> Column:
    level = nuniq_level(u)
    return u - _shift(F.lit(4).cast("long"), 2 * level, True)


def change_scheme(p: Column, scheme: str, new: str, level: int | None = None) -> Column:
    """An index of one scheme in another. nested and ring indices need their level."""
    for s in (scheme, new):
        if s not in SCHEMES:
            raise ValueError(f"unknown indexing scheme {s!r}")
    if scheme == new:
        return p
    if scheme == "zuniq" and new == "nuniq":
        return zuniq_to_nested(p) + _shift(F.lit(4).cast("long"), 2 * zuniq_level(p), True)
    if scheme == "nuniq" and new == "zuniq":
        return _shift(2 * nuniq_to_nested(p) + 1, 2 * (MAX_LEVEL - nuniq_level(p)), True)
    if level is None and not (scheme in ("nuniq", "zuniq") and new == "nested"):
        raise ValueError("the refinement level is needed")
    nested = {"nested": lambda: p, "ring": lambda: ring_to_nested(p, level), "nuniq": lambda: nuniq_to_nested(p), "zuniq": lambda: zuniq_to_nested(p)}[scheme]()
    return {"nested": lambda: nested, "ring": lambda: nested_to_ring(nested, level), "nuniq": lambda: to_nuniq(nested, level), "zuniq": lambda: to_zuniq(nested, level)}[new]()


def _position(x: Column, y: Column, f: Column, n: float) -> Column:
    """Struct (lon, lat) in degrees of a point of a face; x and y run from 0 to n."""
    jr = _face_ring(f) * n - x - y
    polar = (jr < n) | (jr > 3 * n)
    nr = F.when(jr < n, jr).when(jr > 3 * n, 4 * n - jr).otherwise(F.lit(float(n)))
    z = F.when(jr < n, 1 - nr * nr / (3.0 * n * n)).when(jr > 3 * n, nr * nr / (3.0 * n * n) - 1).otherwise((2 * n - jr) * 2 / (3.0 * n))
    turn = _face_turn(f) * nr + x - y
    turn = F.when(turn < 0, turn + 8 * nr).when(turn >= 8 * nr, turn - 8 * nr).otherwise(turn)
    lon = F.when(nr > 0, 45.0 * turn / nr).otherwise(F.lit(0.0))
    small = F.when(polar, nr * nr / (3.0 * n * n))
    lat = F.when(polar, F.signum(z) * (90.0 - F.degrees(2 * F.asin(F.sqrt(small / 2))))).otherwise(F.degrees(F.asin(z)))
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def centre(nested: Column, level: int) -> Column:
    """Struct (lon, lat) in degrees of a nested cell's centre."""
    n = 1 << level
    return _once(nested_to_xyf(nested, level), lambda c: _position(c["x"] + 0.5, c["y"] + 0.5, c["f"], float(n)))


def corners(nested: Column, level: int) -> Column:
    """Array of the four corners (lon, lat): north, west, south, east."""
    n = 1 << level

    def four(c: Column) -> Column:
        return F.array(*[_position(c["x"] + float(a), c["y"] + float(b), c["f"], float(n)) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0))])

    return _once(nested_to_xyf(nested, level), four)


def locate(lon: Column, lat: Column, level: int) -> Column:
    """Nested index of the cell that holds a point in degrees."""
    n = 1 << level
    z = F.sin(F.radians(lat))
    tt = F.pmod(lon, F.lit(360.0)) / 90.0
    long = lambda c: F.floor(c).cast("long")

    def belt(_: Column) -> Column:
        jp, jm = long(n * (0.5 + tt) - n * z * 0.75), long(n * (0.5 + tt) + n * z * 0.75)
        p, m = F.shiftright(jp, level), F.shiftright(jm, level)
        face = F.when(p == m, _or(p, F.lit(4).cast("long"))).when(p < m, p).otherwise(m + 8)
        return _xyf(_and(jm, n - 1), n - 1 - _and(jp, n - 1), face)

    def cap(_: Column) -> Column:
        ntt = F.least(F.lit(3).cast("long"), long(tt))
        # 1 - |z| from the half distance to the pole, which loses no digits there.
        away = n * F.sqrt(F.lit(6.0)) * F.sin(F.radians((90.0 - F.abs(lat)) / 2))
        jp = F.least(long((tt - ntt) * away), F.lit(n - 1).cast("long"))
        jm = F.least(long((1 - (tt - ntt)) * away), F.lit(n - 1).cast("long"))
        return F.when(z >= 0, _xyf(n - 1 - jm, n - 1 - jp, ntt)).otherwise(_xyf(jp, jm, ntt + 8))

    cell = F.when(F.abs(z) <= 2 / 3, belt(z)).otherwise(cap(z))
    return _once(cell, lambda c: xyf_to_nested(c, level))


def cells(spark: SparkSession, level: int) -> DataFrame:
    """All cells of a level by nested index."""
    return spark.range(12 * 4**level).withColumnRenamed("id", "healpix_index")


def decrease_level(df: DataFrame, index: str, level: int, new: int, by: Sequence[str], value: str, method: str = "mean", ddof: int = 1) -> DataFrame:
    """Collapse nested cells into those of a coarser level. A coarse cell that isn't wholly covered fails when it is read."""
    if not 0 <= new <= level:
        raise ValueError("the new level is not between 0 and the old one")
    if canonical(method) not in ("maximum", "minimum", "mean", "median", "standard_deviation", "variance", "sum", "range", "mid_range", "root_mean_square", "maximum_absolute_value", "minimum_absolute_value", "mean_absolute_value", "sum_of_squares"):
        raise ValueError(f"{method!r} can't decrease a refinement level")
    many = 4 ** (level - new)
    got = df.groupBy(*by, F.shiftright(index, 2 * (level - new)).alias(index)).agg(statistic(method, F.col(value), None, ddof).alias(value), F.count(F.lit(1)).alias("__n"))
    whole = F.when(F.col("__n") == many, F.col(value)).otherwise(F.raise_error(F.lit("a coarser cell is only partly covered")).cast("double"))
    return got.withColumn(value, whole).drop("__n")


def increase_level(df: DataFrame, index: str, level: int, new: int, value: str, quantity: str = "intensive") -> DataFrame:
    """Split cells into those of a finer level: intensive values are copied, extensive ones divided."""
    if not level <= new <= MAX_LEVEL:
        raise ValueError("the new level is not between the old one and the finest")
    many = 4 ** (new - level)
    v = F.col(value) / many if quantity == "extensive" else F.col(value)
    return df.withColumn(value, v).withColumn(index, F.explode(F.sequence(F.col(index) * many, F.col(index) * many + many - 1)))


def corner_node(c: Column, dx: int, dy: int, level: int) -> Column:
    """The id of a cell's corner (x + dx, y + dy) of its face: the ring that it lies on times 8 x 2^level, plus its place on the ring in
    half steps. Faces that meet in a corner give it the same integer, so that no rounded coordinate decides."""
    n = F.lit(1 << level).cast("long")
    x, y = c["x"] + dx, c["y"] + dy
    ring = _face_ring(c["f"]) * n - x - y
    length = F.when(ring < n, ring).when(ring > 3 * n, 4 * n - ring).otherwise(n)
    # At a pole all corners are one.
    place = F.when(length > 0, F.pmod(_face_turn(c["f"]) * length + x - y, F.greatest(8 * length, F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    return ring.cast("long") * 8 * n + place.cast("long")


def node_position(node: Column, level: int) -> Column:
    """Struct (lon, lat) in degrees of a corner's id: the same for all cells that share it."""
    n = 1 << level
    ring, place = F.floor(node / (8 * n)), F.pmod(node, F.lit(8 * n))
    length = F.when(ring < n, ring).when(ring > 3 * n, 4 * n - ring).otherwise(F.lit(n)).cast("double")
    small = length * length / (3.0 * n * n)
    cap = F.signum(2 * n - ring) * (90.0 - F.degrees(2 * F.asin(F.sqrt(small / 2))))
    lat = F.when((ring < n) | (ring > 3 * n), cap).otherwise(F.degrees(F.asin((2 * n - ring) * 2 / (3.0 * n))))
    return F.struct(F.when(length > 0, 45.0 * place / length).otherwise(F.lit(0.0)).alias("lon"), lat.alias("lat"))


def to_faces(df: DataFrame, index: str, level: int) -> tuple[DataFrame, DataFrame]:
    """(cell to node edges, nodes) of a mesh with HEALPix cells as faces: (index, corner, node) and (node, lon, lat). Nodes are whole numbers
    from the faces' arithmetic; corners go north, west, south, east."""
    four = lambda c: F.array(*[corner_node(c, a, b, level) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0))])
    edges = df.select(index, F.posexplode(_once(nested_to_xyf(F.col(index), level), four)).alias("corner", "node"))
    nodes = edges.select("node").distinct().select("node", node_position(F.col("node"), level).alias("p")).select("node", "p.lon", "p.lat")
    return edges, nodes
