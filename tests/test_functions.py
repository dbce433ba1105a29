import datetime
import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendars as cal
from gridloom.functions import cellmethods, elementwise, query as q
from gridloom.functions.flags import Flags
from gridloom.functions.units import Units, added


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, x, y", [("km", "m", 2, 2000), ("m s-1", "km h-1", 10, 36), ("Celsius", "K", 0, 273.15), ("Fahrenheit", "Celsius", 212, 100), ("hPa", "Pa", 1013, 101300), ("degrees_north", "radian", 180, math.pi), ("kg m^2 s**-2", "J", 3, 3), ("mm/day", "m s-1", 86400000, 1), ("%", "1", 50, 0.5)])
def test_conversion(a, b, x, y):
    assert Units.of(a).convert_number(x, Units.of(b)) == pytest.approx(y)
    assert Units.of(b).convert_number(y, Units.of(a)) == pytest.approx(x)


def test_unit_algebra():
    m, s = Units.of("m"), Units.of("s")
    assert m / s == Units.of("m s-1") and m * m == Units.of("m2") and (m**2) ** 0.5 == m
    assert added(m, Units.of("km")) == (m, m) and added(Units.of(None), m) == (m, m)
    with pytest.raises(ValueError):
        added(m, s)
    with pytest.raises(ValueError):
        Units.of("Celsius") ** 2
    with pytest.raises(ValueError):
        Units.of("furlongs")
    t = Units.of("days since 2000-01-01")
    assert added(t, t, minus=True)[0] == Units.of("days") and added(t, Units.of("hours"))[0] == t
    assert t.convert_number(1, Units.of("hours since 2000-01-02")) == 0
    assert not t.equivalent(Units.of("days since 2000-01-01", "360_day"))


def test_calendars_against_dates():
    for d in (datetime.date(1, 1, 1), datetime.date(1582, 10, 15), datetime.date(1900, 3, 1), datetime.date(2000, 2, 29), datetime.date(2399, 12, 31)):
        n = (d - datetime.date(1970, 1, 1)).days
        assert cal.days_from_date(d.year, d.month, d.day, "proleptic_gregorian") == n
        assert cal.date_from_days(n, "proleptic_gregorian") == (d.year, d.month, d.day)
    assert cal.days_from_date(1582, 10, 15, "standard") - cal.days_from_date(1582, 10, 4, "standard") == 1
    assert cal.date_from_days(cal.days_from_date(1582, 10, 15, "standard") - 1, "standard") == (1582, 10, 4)
    for c in cal.CALENDARS:
        for n in (-800000, -719500, -1, 0, 59, 60, 365, 146097, 800001):
            assert cal.days_from_date(*cal.date_from_days(n, c), c) == n
    assert [cal.days_in_month(2000, 2, c) for c in ("standard", "365_day", "366_day", "360_day")] == [29, 28, 29, 30]
    assert cal.days_in_month(1900, 2, "julian") == 29


def test_calendar_columns_equal_numbers(spark):
    days = [-800000, -141428, -141427, -1, 0, 59, 11016, 800001]
    df = spark.createDataFrame([(d,) for d in days], "d long")
    for c in cal.CALENDARS:
        got = df.select("d", *[x.alias(n) for n, x in zip("ymk", cal.date_from_days(F.col("d"), c))], cal.days_from_date(*cal.date_from_days(F.col("d"), c), c).alias("back")).collect()
        assert all((r.y, r.m, r.k) == cal.date_from_days(r.d, c) and r.back == r.d for r in got), c
    u = Units.of("hours since 2000-02-28 06:00", "365_day")
    p = spark.createDataFrame([(20.5,)], "h double").select(*[x.alias(k) for k, x in cal.decode(F.col("h"), u).items()]).first()
    assert (p.year, p.month, p.day, p.hour, p.minute) == (2000, 3, 1, 2, 30)
    back = spark.createDataFrame([(20.5,)], "h double").select(cal.encode(cal.decode(F.col("h"), u), u).alias("h")).first().h
    assert back == pytest.approx(20.5)


def test_time_durations(spark):
    assert cal.M().interval((2000, 1, 31, 0, 0, 0)) == ((2000, 1, 31, 0, 0, 0), (2000, 2, 29, 0, 0, 0))
    assert cal.Y(2).interval((2000, 2, 29, 0, 0, 0), "365_day", end=True)[0] == (1998, 2, 28, 0, 0, 0)
    assert cal.D(1.5).interval((2000, 2, 29, 0, 0, 0), "360_day")[1] == (2000, 2, 30, 12, 0, 0)
    assert cal.h(6).is_day_factor and not cal.D(2).is_day_factor and cal.M(3).iso == "P3M" and cal.h(6).iso == "PT6H"
    assert cal.D(1).same_length(cal.h(24)) and cal.M() < cal.Y()
    with pytest.raises(ValueError):
        cal.M(1.5).months
    t = F.lit("2001-11-15 05:00:00").cast("timestamp_ntz")
    for duration, lo, hi in ((cal.Y(1, month=12), "2000-12-01 00:00:00", "2001-12-01 00:00:00"), (cal.M(1, day=16), "2001-10-16 00:00:00", "2001-11-16 00:00:00"), (cal.D(1, hour=6), "2001-11-14 06:00:00", "2001-11-15 06:00:00"), (cal.h(6), "2001-11-15 00:00:00", "2001-11-15 06:00:00")):
        a, b = duration.bounds(t)
        r = spark.range(1).select(a.cast("string").alias("a"), b.cast("string").alias("b")).first()
        assert (r.a, r.b) == (lo, hi)


def test_conditions(spark):
    df = spark.createDataFrame([(float(i), i * 1.0, i + 1.0) for i in range(10)], "coord double, lower double, upper double")
    cols = {c: F.col(c) for c in df.columns}
    pick = lambda query, units=None: [int(r.coord) for r in df.where(query.column(cols, Units.of(units))).orderBy("coord").collect()]
    assert pick(q.wi(2, 4)) == [2, 3, 4] and pick(q.wi(2, 4, open_lower=True, open_upper=True)) == [3] and pick(q.wo(2, 7)) == [0, 1, 8, 9]
    assert pick(q.contains(3)) == [2, 3] and pick(q.cellwi(2, 5)) == [2, 3, 4] and pick(q.cellgt(7)) == [8, 9] and pick(q.cellle(2)) == [0, 1]
    assert pick(q.lt(2) | q.ge(9)) == [0, 1, 9] and pick(q.set_([1, 5])) == [1, 5]
    assert pick(q.ge(0.008, units="km"), "m") == [8, 9]
    assert pick(q.isclose(3.2, atol=0.5)) == [3]
    assert pick(q.cellsize(q.lt(2))) == list(range(10))
    months = spark.range(1, 13).select(F.col("id").alias("month"))
    got = [[r.month for r in months.where(s.column({"month": F.col("month")})).orderBy("month").collect()] for s in q.seasons()]
    assert got == [[1, 2, 12], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    assert q.wi(1, 2).addattr("year").attr == ("year",) and (q.contains(1) & q.lt(3)).iscontains()
    with pytest.raises(ValueError):
        q.seasons(5)


def test_elementwise(spark):
    lit, nan = F.lit, float("nan")
    assert [value(spark, elementwise.floordiv(lit(-7), lit(b))) for b in (3, -3)] == [-3, 2] and value(spark, elementwise.mod(lit(-7), lit(3))) == 2
    assert value(spark, elementwise.divide(lit(1), lit(0))) == float("inf") and math.isnan(value(spark, elementwise.divide(lit(0), lit(0))))
    assert value(spark, elementwise.clip(lit(None).cast("double"), 1, 2)) is None and value(spark, elementwise.clip(lit(5.0), 1.0, 2.0)) == 2
    assert value(spark, elementwise.masked_invalid(lit(nan))) is None
    assert [value(spark, elementwise.round_even(lit(x))) for x in (0.5, 1.5, -2.5)] == [0, 2, -2]
    assert value(spark, elementwise.trunc(lit(-1.7))) == -1
    assert value(spark, elementwise.where(lit(1.0), lit(None).cast("boolean"), 9.0)) == 1 and value(spark, elementwise.where(lit(None).cast("double"), lit(True), 9.0)) is None
    out, units = elementwise.binary("sub", lit(1.0), Units.of("km"), lit(1.0), Units.of("m"))
    assert value(spark, out) == 0.999 and units == Units.of("km")
    out, units = elementwise.UNARY["cos"](lit(60.0), Units.of("degrees"))
    assert value(spark, out) == pytest.approx(0.5) and units == Units.of("1")
    assert elementwise.UNARY["sqrt"](lit(4.0), Units.of("m2"))[1] == Units.of("m")
    with pytest.raises(ValueError):
        elementwise.UNARY["exp"](lit(1.0), Units.of("m"))
    assert value(spark, elementwise.apply_masking(lit(-999.0), fill_values=[-999.0])) is None
    got = spark.createDataFrame([(1.0,), (None,)], "x double").select(elementwise.func(lambda s: s + 1)(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [2.0, None]
    assert value(spark, elementwise.binary("eq", lit(nan), Units.of(None), lit(nan), Units.of(None))[0]) is False


def test_cell_methods():
    text = "time: mean (interval: 1 day comment: daily) area: maximum where land t: lat: variance over years"
    made = cellmethods.parse(text)
    assert [m.method for m in made] == ["mean", "maximum", "variance"] and made[1].qualifiers == {"where": "land"} and made[2].axes == ("t", "lat")
    assert cellmethods.parse(" ".join(map(str, made))) == made and made[0].interval == ("1 day",) and made[0].comment == "daily"
    assert cellmethods.parse("lat: lon: mean")[0].equivalent(cellmethods.parse("lon: lat: mean")[0])
    with pytest.raises(ValueError):
        cellmethods.parse("time: ")


def test_flags(spark):
    f = Flags(("low", "high", "land"), values=(1, 2, 4), masks=(3, 3, 4))
    assert value(spark, f.meanings_of(F.lit(6))) == ["high", "land"]
    assert Flags(("b", "a"), values=(2, 1)).sorted().meanings == ("a", "b") and f.table(spark).count() == 3
