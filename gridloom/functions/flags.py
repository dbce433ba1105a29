"""Flags: values and bit masks with meanings, as conditions on a column and as a lookup table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Flags:
    meanings: tuple[str, ...]
    values: tuple[int, ...] = ()
    masks: tuple[int, ...] = ()

    def __post_init__(self):
        for x in (self.values, self.masks):
            if x and len(x) != len(self.meanings):
                raise ValueError("flag values, masks and meanings differ in number")
        if not self.values and not self.masks:
            raise ValueError("flags need values or masks")

    def sorted(self) -> Flags:
        order = sorted(range(len(self.meanings)), key=lambda i: tuple(x[i] for x in (self.values, self.masks) if x))
        pick = lambda x: tuple(x[i] for i in order) if x else ()
        return Flags(pick(self.meanings), pick(self.values), pick(self.masks))

    def is_set(self, x: Column, meaning: str) -> Column:
        i = self.meanings.index(meaning)
        if self.masks and self.values:
            return x.bitwiseAND(F.lit(self.masks[i])) == self.values[i]
        return x.bitwiseAND(F.lit(self.masks[i])) != 0 if self.masks else x == self.values[i]

    def meanings_of(self, x: Column) -> Column:
        """The array of all meanings that a value has."""
        return F.array_compact(F.array(*[F.when(self.is_set(x, m), F.lit(m)) for m in self.meanings]))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(m, self.values[i] if self.values else None, self.masks[i] if self.masks else None) for i, m in enumerate(self.meanings)]
        return spark.createDataFrame(rows, "meaning string, value long, mask long")
