"""A user's own aggregate in three steps over Arrow batches: partial states of the cells a task has, their combination, and the final value.

The partial step runs in the tasks that read the cells, so that only states, a few numbers for each group and task, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A task sends its states on when it has so many groups, and combines a group's when there are so many of them.
GROUPS, STATES = 1 << 16, 64

State = Mapping[str, float]


@dataclass(frozen=True)
class Aggregate:
    """partial(values, weights) -> state: of the values that are there (never none) and their weights (ones without any).
    combine({name: array of a number from each state}) -> state; it may be called on combined states again, in any order.
    final(state) -> the value, None for missing. names: of the numbers that make a state.
    """

    names: Sequence[str]
    partial: Callable[[np.ndarray, np.ndarray], State]
    combine: Callable[[Mapping[str, np.ndarray]], State]
    final: Callable[[State], float | None]


def collapse_with(df: DataFrame, by: Sequence[str], value: str, aggregate: Aggregate, weights: str | None = None, mtol: float = 1.0, name: str | None = None) -> DataFrame:
    """One row per group of `by` with the aggregate's value, missing where a group has no value or, by mtol, too few.

    A missing value takes no part, nor does one with a missing weight; NaN is a value. Groups of any size are bounded work for each task: it
    holds one batch and the states of GROUPS groups. An empty table gives an empty result (also without `by`).
    """
    name, names = name or value, list(aggregate.names)
    keys = [f"k{i}" for i in range(len(by))]
    w = F.lit(1.0) if weights is None else F.col(f"`{weights}`").cast("double")
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{value}`").cast("double").alias("x"), w.alias("w"))
    key_fields = [rows.schema[k] for k in keys]
    numbers = [T.StructField(f"s{i}", T.DoubleType()) for i in range(len(names))]
    state_type = T.StructType([*key_fields, T.StructField("cells", T.LongType()), T.StructField("there", T.LongType()), *numbers])

    def merged(states: list[State]) -> State:
        if len(states) == 1:
            return states[0]
        return aggregate.combine({n: np.array([s[n] for s in states], float) for n in names})

    def partials(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def sent() -> pa.RecordBatch:
            found = [(k, c, t, merged(s) if s else None) for k, (c, t, s) in held.items()]
            held.clear()
            cols = [pa.array([k[i] for k, *_ in found], kinds[i]) for i in range(len(keys))]
            cols += [pa.array([c for _, c, _, _ in found], pa.int64()), pa.array([t for _, _, t, _ in found], pa.int64())]
            cols += [pa.array([None if s is None else float(s[n]) for *_, s in found], pa.float64()) for n in names]
            return pa.RecordBatch.from_arrays(cols, names=state_type.fieldNames())

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            if not batch.num_rows:
                continue
            codes, found = _codes(batch, len(keys))
            x, w = batch.column(len(keys)), batch.column(len(keys) + 1)
            there = np.asarray(pc.and_(pc.is_valid(x), pc.is_valid(w)).to_numpy(zero_copy_only=False), bool)
            order = np.argsort(codes, kind="stable")
            xs, ws = (c.to_numpy(zero_copy_only=False)[order] for c in (x, w))
            there, ends = there[order], np.cumsum(np.bincount(codes, minlength=len(found)))
            for key, a, b in zip(found, [0, *ends[:-1]], ends):
                own = held.setdefault(key, [0, 0, []])
                some = there[a:b]
                own[0] += int(b - a)
                if some.any():
                    own[1] += int(some.sum())
                    own[2].append(aggregate.partial(xs[a:b][some], ws[a:b][some]))
                    if len(own[2]) >= STATES:
                        own[2] = [merged(own[2])]
            if len(held) > GROUPS:
                yield sent()
        if held:
            yield sent()

    def finished(key: tuple, table: pa.Table) -> pa.Table:
        cells, there = pc.sum(table.column("cells")).as_py(), pc.sum(table.column("there")).as_py()
        known = table.filter(pc.greater(table.column("there"), 0))
        out = None
        if there and (mtol >= 1 or there >= (1 - mtol) * cells):
            out = aggregate.final(merged([dict(zip(names, r)) for r in zip(*(known.column(f"s{i}").to_pylist() for i in range(len(names))))]))
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), pa.array([None if out is None else float(out)], pa.float64())], names=[*keys, "out"])

    states = rows.mapInArrow(partials, state_type)
    if not keys:
        states, key_fields = states.withColumn("k0", F.lit(0)), [T.StructField("k0", T.IntegerType())]
        keys = ["k0"]
    got = states.groupBy(*keys).applyInArrow(finished, T.StructType([*key_fields, T.StructField("out", T.DoubleType())]))
    return got.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("out").alias(name))


def _codes(batch: pa.RecordBatch, many: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's key, from 0 without gaps, and the keys in that order."""
    codes, keys = np.zeros(batch.num_rows, np.int64), [()]
    for i in range(many):
        column = pc.dictionary_encode(batch.column(i), null_encoding="encode")
        own = np.asarray(column.indices)
        both, codes = np.unique(codes * len(column.dictionary) + own, return_inverse=True)
        values = column.dictionary.to_pylist()
        keys = [(*keys[b // len(values)], values[b % len(values)]) for b in both.tolist()]
    return codes, keys
