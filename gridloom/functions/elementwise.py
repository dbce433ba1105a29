"""Element-wise functions on columns, with their rules for units. A null (missing) element stays null."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.units import NONE, ONE, RADIANS, Units, added


def _float(x: Column) -> Column:
    return x.cast("double")


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def round_even(x: Column, decimals: int = 0) -> Column:
    """Half to even, and to tens and hundreds for negative decimals; NaN and infinities stay."""
    scale = 10.0 ** decimals
    return F.rint(x * scale) / scale if decimals else F.rint(x)


def clip(x: Column, low=None, high=None) -> Column:
    """Null stays null (greatest and least would skip it)."""
    out = x if high is None else F.when(x > high, F.lit(high)).otherwise(x)
    return out if low is None else F.when(out < low, F.lit(low)).otherwise(out)


def masked_invalid(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def masked_where(x: Column, condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(None)).otherwise(x)


def masked_values(x: Column, value: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return masked_where(x, F.abs(x - value) <= atol + rtol * abs(value))


def apply_masking(x: Column, fill_values=(), valid_min=None, valid_max=None, valid_range=None) -> Column:
    if valid_range is not None:
        valid_min, valid_max = valid_range
    bad = F.lit(False)
    if fill_values:
        bad = bad | x.isin(*fill_values)
    if valid_min is not None:
        bad = bad | (x < valid_min)
    if valid_max is not None:
        bad = bad | (x > valid_max)
    return masked_where(x, bad)


def where(x: Column, condition: Column, a, b=None, hardmask: bool = True) -> Column:
    """a where the condition holds, b (or x) elsewhere. A missing condition leaves x; with a hard mask, missing x stays missing."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(condition, lit(a)).when(condition.isNull(), x).otherwise(x if b is None else lit(b))
    return F.when(x.isNotNull(), out) if hardmask else out


def filled(x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def binary_mask(x: Column) -> Column:
    return x.isNull().cast("int")


def isclose(x: Column, y, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    y = y if isinstance(y, Column) else F.lit(y)
    return F.abs(x - y) <= atol + rtol * F.abs(y)


def floordiv(a: Column, b: Column) -> Column:
    """Towards minus infinity; null for a zero divisor."""
    return F.floor(F.try_divide(_float(a), _float(b)))


def mod(a: Column, b: Column) -> Column:
    """With the divisor's sign; null for a zero divisor."""
    return a - b * floordiv(a, b)


def divide(a: Column, b: Column) -> Column:
    """Of doubles, as IEEE 754 has it: x/0 is an infinity, 0/0 is NaN."""
    a, b = _float(a), _float(b)
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(F.try_divide(a, b))


def log(x: Column, base: float | None = None) -> Column:
    """NaN below zero, minus infinity at zero."""
    x = _float(x)
    raw = F.ln(x) if base is None else F.log10(x) if base == 10 else F.log2(x) if base == 2 else F.ln(x) / math.log(base)
    return F.when(x < 0, float("nan")).when(x == 0, float("-inf")).otherwise(raw)


def _trig(f: Callable[[Column], Column]):
    def apply(x: Column, units: Units) -> tuple[Column, Units]:
        if units.defined and not units.dimensionless and not units.equivalent(RADIANS):
            raise ValueError(f"{units.text!r} is no angle")
        return f(units.convert(_float(x), RADIANS) if units.defined and units.equivalent(RADIANS) else _float(x)), ONE

    return apply


def _inverse(f: Callable[[Column], Column], out: Units):
    def apply(x: Column, units: Units) -> tuple[Column, Units]:
        if units.defined and not units.dimensionless:
            raise ValueError(f"{units.text!r} is not dimensionless")
        return f(_float(x)), out

    return apply


def _same(f: Callable[[Column], Column]):
    return lambda x, units: (f(x), units)


def _exp(x: Column, units: Units) -> tuple[Column, Units]:
    if units.defined and not units.dimensionless:
        raise ValueError(f"{units.text!r} is not dimensionless")
    return F.exp(units.convert(_float(x), ONE) if units.defined else _float(x)), ONE


def _sqrt(x: Column, units: Units) -> tuple[Column, Units]:
    half = units ** Fraction(1, 2) if units.defined else units
    if any(d.denominator != 1 for d in half.dims):
        raise ValueError(f"{units.text!r} has no square root")
    return F.sqrt(_float(x)), half


#: name: (column, units) -> (column, units)
UNARY: dict[str, Callable[[Column, Units], tuple[Column, Units]]] = {
    "sin": _trig(F.sin), "cos": _trig(F.cos), "tan": _trig(F.tan), "sinh": _trig(F.sinh), "cosh": _trig(F.cosh), "tanh": _trig(F.tanh),
    "arcsin": _inverse(F.asin, RADIANS), "arccos": _inverse(F.acos, RADIANS), "arctan": _inverse(F.atan, RADIANS),
    "arcsinh": _inverse(F.asinh, RADIANS), "arccosh": _inverse(F.acosh, RADIANS), "arctanh": _inverse(F.atanh, RADIANS),
    "ceil": _same(F.ceil), "floor": _same(F.floor), "trunc": _same(trunc), "rint": _same(F.rint), "round": _same(round_even),
    "abs": _same(F.abs), "neg": _same(lambda x: -x), "pos": _same(lambda x: x), "invert": _same(F.bitwise_not),
    "exp": _exp, "log": lambda x, u: (log(x), ONE), "log10": lambda x, u: (log(x, 10), ONE), "log2": lambda x, u: (log(x, 2), ONE),
    "sqrt": _sqrt, "square": lambda x, u: (x * x, u**2), "masked_invalid": _same(masked_invalid),
}


def arctan2(y: Column, x: Column) -> Column:
    return F.atan2(_float(y), _float(x))


def binary(op: str, a: Column, ua: Units, b: Column, ub: Units) -> tuple[Column, Units]:
    """a op b with units conformed: sums take the left's units, products multiply them, comparisons and bits drop them."""
    if op in ("add", "sub", "mod"):
        units, to = added(ua, ub, minus=op == "sub")
        b = ub.convert(b, to) if to.defined and ub.defined else b
        return {"add": lambda: a + b, "sub": lambda: a - b, "mod": lambda: mod(a, b)}[op](), units
    if op in ("mul", "truediv", "floordiv"):
        units = ua * ub if op == "mul" else ua / ub
        return {"mul": lambda: a * b, "truediv": lambda: divide(a, b), "floordiv": lambda: floordiv(a, b)}[op](), units
    if op in ("lt", "le", "gt", "ge", "eq", "ne"):
        if not ua.equivalent(ub):
            raise ValueError(f"units {ua.text!r} and {ub.text!r} are not equivalent")
        b = ub.convert(b, ua)
        equal = (a == b) & ~_nan(a)
        return {"lt": lambda: (a < b) & ~_nan(b), "le": lambda: (a <= b) & ~_nan(b), "gt": lambda: (a > b) & ~_nan(a), "ge": lambda: (a >= b) & ~_nan(a), "eq": lambda: equal, "ne": lambda: ~equal}[op](), NONE
    if op in ("and", "or", "xor", "lshift", "rshift"):
        if not ua.equivalent(ub):
            raise ValueError(f"units {ua.text!r} and {ub.text!r} are not equivalent")
        return {"and": lambda: a.bitwiseAND(b), "or": lambda: a.bitwiseOR(b), "xor": lambda: a.bitwiseXOR(b), "lshift": lambda: F.call_function("shiftleft", a, b.cast("int")), "rshift": lambda: F.call_function("shiftright", a, b.cast("int"))}[op](), ua
    raise ValueError(f"unknown operation {op!r}")


def _nan(x: Column) -> Column:
    """Whether a value is NaN: comparisons with it are false, unlike Spark's, which hold NaN for the greatest."""
    return F.isnan(_float(x))


def power(x: Column, exponent: float, units: Units = NONE) -> tuple[Column, Units]:
    return F.pow(x, F.lit(exponent)), (units**exponent if units.defined and not units.dimensionless else units)


def func(f: Callable[[pd.Series], pd.Series], returns: str = "double", preserve_invalid: bool = False):
    """A vectorised function of a column by Arrow batches: null in, null out; with preserve_invalid, nulls that f makes become NaN."""
    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        out = pd.Series(f(x), index=x.index)
        if preserve_invalid:
            out = out.fillna(float("nan"))
        return out.where(x.notna(), None)

    return run
