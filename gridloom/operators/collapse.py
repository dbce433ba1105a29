"""Collapses: weighted statistics with a rule for missing data, over any keys.

All are plain aggregations, so that partial results are combined before the shuffle. A null value is missing: it
takes no part, nor does its weight. A result is missing if fewer than (1 - mtol) of the group's cells, missing ones
included, have a value (mtol 1: only if none has). NaN is a value, and makes a statistic NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.units import NONE, ONE, Units

Stat = Callable[[Column, Column | None, int], Column]


def _w(x: Column, w: Column | None) -> Column:
    """The weight of a value that is there."""
    return F.when(x.isNotNull(), F.lit(1.0) if w is None else w.cast("double"))


def _x(x: Column) -> Column:
    return x.cast("double")


def _max(x: Column) -> Column:
    return F.max(x)  # NaN is the greatest


def _min(x: Column) -> Column:
    return F.when(F.bool_or(F.isnan(_x(x))), float("nan")).otherwise(F.min(_x(x)))


def _sum(x: Column, w: Column | None, ddof: int = 0) -> Column:
    return F.sum(x if w is None else _x(x) * w)


def _mean(x: Column, w: Column | None, ddof: int = 0) -> Column:
    return F.avg(x) if w is None else F.try_divide(F.sum(_x(x) * w), F.sum(_w(x, w)))


def _var(x: Column, w: Column | None, ddof: int) -> Column:
    """Unweighted: by one-pass merging moments. Weighted: from weighted sums about the group's share of a common origin."""
    if w is None:
        if ddof == 0:
            return F.var_pop(x)
        if ddof == 1:
            return F.var_samp(x)
        n = F.count(x)
        return F.try_divide(F.var_pop(x) * n, n - ddof)
    if ddof not in (0, 1):
        raise ValueError("a weighted variance needs ddof 0 or 1")
    v1, v2 = F.sum(_w(x, w)), F.sum(_w(x, w) * w)
    s1, s2 = F.sum(_x(x) * w), F.sum(_x(x) * _x(x) * w)
    spread = F.greatest(s2 - F.try_divide(s1 * s1, v1), F.lit(0.0))
    return F.try_divide(spread, v1) if ddof == 0 else F.try_divide(spread * v1, v1 * v1 - v2)


#: name: (statistic of value, weight and ddof; whether weights count; units of the result from value's and weights')
_STATS: dict[str, tuple[Stat, bool, Callable[[Units, Units], Units]]] = {
    "maximum": (lambda x, w, d: _max(x), False, lambda u, w: u),
    "minimum": (lambda x, w, d: _min(x), False, lambda u, w: u),
    "maximum_absolute_value": (lambda x, w, d: _max(F.abs(x)), False, lambda u, w: u),
    "minimum_absolute_value": (lambda x, w, d: _min(F.abs(x)), False, lambda u, w: u),
    "mid_range": (lambda x, w, d: (_max(x) + _min(x)) / 2.0, False, lambda u, w: u),
    "range": (lambda x, w, d: _max(x) - _min(x), False, lambda u, w: u),
    "mean": (_mean, True, lambda u, w: u),
    "mean_absolute_value": (lambda x, w, d: _mean(F.abs(x), w), True, lambda u, w: u),
    "sum": (_sum, True, lambda u, w: u),
    "integral": (_sum, True, lambda u, w: u * w if w.defined else u),
    "sum_of_squares": (lambda x, w, d: _sum(_x(x) * _x(x), w), True, lambda u, w: u**2),
    "sample_size": (lambda x, w, d: F.count(x), False, lambda u, w: ONE),
    "sum_of_weights": (lambda x, w, d: F.sum(_w(x, w)), True, lambda u, w: w if w.defined else ONE),
    "sum_of_weights2": (lambda x, w, d: F.sum(_w(x, w) * _w(x, w)), True, lambda u, w: w**2 if w.defined else ONE),
    "root_mean_square": (lambda x, w, d: F.sqrt(_mean(_x(x) * _x(x), w)), True, lambda u, w: u),
    "variance": (_var, True, lambda u, w: u**2),
    "standard_deviation": (lambda x, w, d: F.sqrt(_var(x, w, d)), True, lambda u, w: u),
    "median": (lambda x, w, d: F.percentile(_x(x), F.lit(0.5)), False, lambda u, w: u),
    "count_masked": (lambda x, w, d: F.count(F.lit(1)) - F.count(x), False, lambda u, w: ONE),
    "any": (lambda x, w, d: F.bool_or(x.cast("boolean")), False, lambda u, w: NONE),
    "all": (lambda x, w, d: F.bool_and(x.cast("boolean")), False, lambda u, w: NONE),
}
ALIASES = {"max": "maximum", "min": "minimum", "var": "variance", "sd": "standard_deviation", "std": "standard_deviation", "rms": "root_mean_square", "count": "sample_size", "average": "mean", "max_abs": "maximum_absolute_value", "min_abs": "minimum_absolute_value", "mean_abs": "mean_absolute_value"}
METHODS = (*_STATS, "mean_of_upper_decile")
#: What stats() gives unless told otherwise.
DEFAULT_STATS = ("minimum", "mean", "median", "maximum", "range", "mid_range", "standard_deviation", "root_mean_square", "sample_size")


def canonical(method: str) -> str:
    found = ALIASES.get(method, method)
    if found not in METHODS:
        raise ValueError(f"unknown collapse method {method!r}")
    return found


def result_units(method: str, units: Units, weights: Units = NONE) -> Units:
    method = canonical(method)
    return units if method == "mean_of_upper_decile" else _STATS[method][2](units, weights)


def masked(stat: Column, x: Column, mtol: float) -> Column:
    """The statistic, or null where too few of the group's cells have a value."""
    enough = F.count(x) > 0 if mtol >= 1 else (F.count(x) > 0) & (F.count(x) >= (1 - mtol) * F.count(F.lit(1)))
    return F.when(enough, stat)


def statistic(method: str, x: Column, weights: Column | None = None, ddof: int = 0, mtol: float = 1.0) -> Column:
    """The aggregate column of a method. Counts are never missing."""
    method = canonical(method)
    stat, weighted, _ = _STATS[method]
    out = stat(x, weights if weighted else None, ddof)
    return out if method in ("sample_size", "count_masked") else masked(out, x, mtol)


def collapse(df: DataFrame, by: Sequence[str | Column], value: str | Column, methods: Mapping[str, str] | Sequence[str] | str, weights: str | Column | None = None, ddof: int = 0, mtol: float = 1.0) -> DataFrame:
    """One row per group of `by` with the statistics: {output column: method}, or method names.

    Weights must be positive where a value is; this isn't checked here (see weights.positive).
    """
    if isinstance(methods, str):
        methods = [methods]
    if not isinstance(methods, Mapping):
        methods = {m: m for m in methods}
    x = F.col(value) if isinstance(value, str) else value
    w = F.col(weights) if isinstance(weights, str) else weights
    plain = {n: m for n, m in methods.items() if canonical(m) != "mean_of_upper_decile"}
    out = df.groupBy(*by).agg(*[statistic(m, x, w, ddof, mtol).alias(n) for n, m in plain.items()]) if plain else None
    for n, m in methods.items():
        if n not in plain:
            part = mean_of_upper_decile(df, by, x, w, mtol=mtol, name=n)
            if out is None:
                out = part
            elif by:
                keys = [f"__k{i}" for i in range(len(by))]
                names = [b if isinstance(b, str) else out.columns[i] for i, b in enumerate(by)]
                part = part.select(*[F.col(part.columns[i]).alias(k) for i, k in enumerate(keys)], n)
                on = [out[a].eqNullSafe(part[k]) for a, k in zip(names, keys)]
                for c in on[1:]:
                    on[0] = on[0] & c
                out = out.join(part, on[0]).drop(*keys)
            else:
                out = out.crossJoin(part)  # one row each
    return out


def mean_of_upper_decile(df: DataFrame, by: Sequence[str | Column], x: Column, weights: Column | None = None, include_decile: bool = True, mtol: float = 1.0, name: str = "mean_of_upper_decile") -> DataFrame:
    """Mean of the values from the 90th percentile up, or above it without include_decile."""
    rows = df.withColumns({"__x": x.cast("double"), "__w": F.lit(1.0) if weights is None else weights.cast("double")})
    keys = [b if isinstance(b, str) else None for b in by]
    for i, b in enumerate(by):
        if keys[i] is None:
            keys[i] = f"__by{i}"
            rows = rows.withColumn(keys[i], b)
    level = rows.groupBy(*keys).agg(F.percentile("__x", F.lit(0.9)).alias("__p"))
    if keys:
        level = level.select(*[F.col(k).alias(f"__l{i}") for i, k in enumerate(keys)], "__p")
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & rows[k].eqNullSafe(level[f"__l{i}"])
        rows = rows.join(level, on)
    else:
        rows = rows.crossJoin(F.broadcast(level))  # one row
    top = F.col("__x") >= F.col("__p") if include_decile else F.col("__x") > F.col("__p")
    stat = F.try_divide(F.sum(F.when(top, F.col("__x") * F.col("__w"))), F.sum(F.when(top, F.col("__w"))))
    return rows.groupBy(*keys).agg(masked(stat, F.col("__x"), mtol).alias(name))


def _near(x: Column) -> Column:
    """Free of the noise of a product: a share of a count is whole if it is so to nine digits."""
    return F.round(x, 9)


def _whole(x: Column) -> Column:
    return _near(x) == F.floor(_near(x))


#: Percentile methods that are a mix of two neighbours in order: q, n -> zero-based virtual index.
_VIRTUAL: dict[str, Callable[[Column, Column], Column]] = {
    "linear": lambda q, n: q * (n - 1), "lower": lambda q, n: F.floor(q * (n - 1)), "higher": lambda q, n: F.ceil(q * (n - 1)),
    "nearest": lambda q, n: F.rint(q * (n - 1)), "midpoint": lambda q, n: (F.floor(q * (n - 1)) + F.ceil(q * (n - 1))) / 2,
    "weibull": lambda q, n: q * (n + 1) - 1, "hazen": lambda q, n: q * n - 0.5,
    "median_unbiased": lambda q, n: q * (n + 1 / 3) + 1 / 3 - 1, "normal_unbiased": lambda q, n: q * (n + 0.25) + 0.375 - 1,
    "interpolated_inverted_cdf": lambda q, n: q * n - 1, "inverted_cdf": lambda q, n: F.ceil(_near(q * n)) - 1,
    "averaged_inverted_cdf": lambda q, n: F.when(_whole(q * n), _near(q * n) - 0.5).otherwise(F.ceil(q * n) - 1),
    "closest_observation": lambda q, n: F.when(_whole(q * n - 0.5) & (F.floor(_near(q * n - 0.5)) % 2 == 0), _near(q * n - 0.5) - 1).otherwise(F.floor(_near(q * n - 0.5))),
}
PERCENTILE_METHODS = tuple(_VIRTUAL)


def percentile(df: DataFrame, by: Sequence[str], value: str, ranks: Sequence[float], method: str = "linear", mtol: float = 1.0) -> DataFrame:
    """One row per group and rank (0 to 100): by…, rank, value.

    linear is the built-in exact percentile, which merges counts per distinct value. The other methods take the
    values at their places in order, from the counts of distinct values by running sums.
    """
    if any(not 0 <= r <= 100 for r in ranks):
        raise ValueError("ranks lie between 0 and 100")
    x = F.col(value).cast("double")
    if method == "linear":
        got = df.groupBy(*by).agg(masked(F.percentile(x, F.array(*[F.lit(r / 100.0) for r in ranks])), x, mtol).alias("__p"))
        pairs = F.arrays_zip(F.array(*[F.lit(float(r)) for r in ranks]).alias("rank"), F.coalesce("__p", F.array_repeat(F.lit(None).cast("double"), len(ranks))).alias(value))
        return got.select(*by, F.explode(pairs).alias("__x")).select(*by, "__x.rank", F.col(f"__x.{value}").alias(value))
    if method not in _VIRTUAL:
        raise ValueError(f"unknown percentile method {method!r}")
    from pyspark.sql import Window

    counts = df.groupBy(*by, x.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by)
    counts = counts.withColumns({"__all": F.sum("__n").over(group), "__has": F.sum(F.when(F.col("__v").isNotNull(), F.col("__n")).otherwise(0)).over(group)})
    there = counts.where("__v IS NOT NULL").withColumn("__end", F.sum("__n").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    n = F.col("__has")
    spread = there.withColumn("rank", F.explode(F.array(*[F.lit(float(r)) for r in ranks])))
    at = F.least(F.greatest(_VIRTUAL[method](F.col("rank") / 100.0, n), F.lit(0.0)), n - 1.0)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda k: (F.col("__end") - F.col("__n") <= k) & (k < F.col("__end"))
    out = spread.groupBy(*by, "rank").agg(F.max(F.when(holds(low), F.col("__v"))).alias("__lo"), F.max(F.when(holds(high), F.col("__v"))).alias("__hi"), F.max(at - low).alias("__f"), F.max("__all").alias("__all"), F.max("__has").alias("__has"))
    enough = F.lit(True) if mtol >= 1 else F.col("__has") >= (1 - mtol) * F.col("__all")
    return out.select(*by, "rank", F.when(enough, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias(value))


def arg_extreme(df: DataFrame, by: Sequence[str], value: str, index: Sequence[str], largest: bool = True) -> DataFrame:
    """For each group the index columns of its largest (or smallest) value, the first in index order if there are several."""
    key = F.struct(*[F.col(c) for c in index])
    sign = -F.col(value).cast("double") if largest else F.col(value).cast("double")
    order = F.when(F.col(value).isNotNull(), F.struct(sign.alias("s"), key.alias("k")))
    return df.groupBy(*by).agg(F.min(order).alias("__m")).select(*by, *[F.col(f"__m.k.{c}").alias(c) for c in index])


def unique(df: DataFrame, value: str, counts: bool = False) -> DataFrame:
    """Distinct values; a missing value is one of them."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("count")) if counts else df.select(value).distinct()


def stats(df: DataFrame, value: str, methods: Sequence[str] = DEFAULT_STATS, weights: str | None = None) -> DataFrame:
    return collapse(df, [], value, list(methods), weights)


def coarsen(df: DataFrame, index: Mapping[str, int], by: Sequence[str], value: str, method: str | Callable[[Column], Column] = "mean", sizes: Mapping[str, int] | None = None, trim_excess: bool = False) -> DataFrame:
    """Collapse blocks of k cells along each index column: {index: k}. sizes: of the axes; needed to trim or to refuse a remainder."""
    rows = df
    for c, k in index.items():
        n = (sizes or {}).get(c)
        if n is not None and n % k:
            if not trim_excess:
                raise ValueError(f"{n} cells of {c} are no multiple of {k}")
            rows = rows.where(F.col(c) < n - n % k)
    keys = [F.floor(F.col(c) / k).cast("int").alias(c) for c, k in index.items()]
    x = F.col(value)
    return rows.groupBy(*by, *keys).agg((method(x) if callable(method) else statistic(method, x)).alias(value))
