"""Ranges of positions and values that are given to a read, so that what can't hold a row of them isn't opened.

They are options of the read and not filters that Spark pushes down: Spark 4.1 keeps the filters that it has pushed to a source in Python
for later plans of the same DataFrame, and would leave out rows there.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Range = tuple[float | None, float | None]


def option(within: Mapping[str, Range] | None, values: Range | None) -> str:
    """The ranges, both ends included, as the text of an option; None: no bound."""
    return json.dumps({"within": {d: list(r) for d, r in (within or {}).items()}, "values": list(values or (None, None))})


def positions(text: str | None, dims: Sequence[str], shape: Sequence[int]) -> list[range]:
    """For each axis the positions inside its range."""
    given = json.loads(text)["within"] if text else {}
    unknown = set(given) - set(dims)
    if unknown:
        raise ValueError(f"no axis {', '.join(sorted(unknown))}; there are {', '.join(dims)}")
    out = []
    for d, n in zip(dims, shape):
        low, high = given.get(d, (None, None))
        out.append(range(max(0, 0 if low is None else int(low)), min(n, n if high is None else int(high) + 1)))
    return out


def values(text: str | None) -> tuple[float, float]:
    low, high = json.loads(text)["values"] if text else (None, None)
    return float("-inf") if low is None else low, float("inf") if high is None else high


def kept(df: DataFrame, value: str, within: Mapping[str, Range] | None, values_: Range | None) -> DataFrame:
    """The rows inside the ranges, of what was opened."""
    for column, (low, high) in [*((f"i_{d}", r) for d, r in (within or {}).items()), *([(value, values_)] if values_ else [])]:
        if low is not None:
            df = df.where(F.col(f"`{column}`") >= low)
        if high is not None:
            df = df.where(F.col(f"`{column}`") <= high)
    return df
