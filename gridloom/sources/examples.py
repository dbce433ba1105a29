"""Small sample cubes for trying things out and for tests."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.functions.units import Units
from gridloom.operators import reshape, weights
from gridloom.operators.cube import Axis, Cube


def example(spark: SparkSession, n: int = 0) -> Cube:
    """0: humidity (latitude 5, longitude 8). 1: temperature (monthly time 120, latitude 5, longitude 8). 2: a daily series of 365 days."""
    if n not in (0, 1, 2):
        raise ValueError(f"there is no example {n}")
    if n == 2:
        time = weights.regular_axis(spark, 0.0, 365.0, 1.0)
        rows = time.select(F.col("i").alias("i_time"), (10 + 8 * F.sin((F.col("i") - 100) * (2 * math.pi / 365))).alias("value"))
        return Cube(rows, {"time": Axis("time", 365, time, Units.of("days since 2001-01-01"), None, "time", "T")}, units=Units.of("Celsius"), name="air_temperature")
    axes = Cube.regular_lonlat(spark, (0.0, 360.0, 45.0), (-90.0, 90.0, 36.0))
    shape = {a.index: a.size for a in axes.values()}
    if n == 0:
        rows = reshape.grid(spark, shape).withColumn("value", 0.01 * (1 + F.col("i_lon") + 8 * F.col("i_lat")) / 5)
        return Cube(rows, axes, units=Units.of("1"), name="specific_humidity")
    months = spark.range(120).select(F.col("id").cast("int").alias("i"), F.make_date(F.floor(1959 + (F.col("id") + 11) / 12).cast("int"), ((F.col("id") + 11) % 12 + 1).cast("int"), F.lit(1)).alias("first"))
    start = F.to_date(F.lit("1959-12-01"))
    time = months.select("i", (F.datediff("first", start) + F.datediff(F.add_months("first", 1), "first") / 2).alias("coord"), F.datediff("first", start).cast("double").alias("lower"), F.datediff(F.add_months("first", 1), start).cast("double").alias("upper"))
    wave = 280 + 15 * F.cos(F.col("i_time") * (math.pi / 6)) - 10 * F.abs(F.col("i_lat") - 2) + F.col("i_lon")
    rows = reshape.grid(spark, {"i_time": 120, **shape}).withColumn("value", wave)
    axes = {"time": Axis("time", 120, time, Units.of("days since 1959-12-01"), None, "time", "T"), **axes}
    return Cube(rows, axes, units=Units.of("K"), name="air_potential_temperature")
