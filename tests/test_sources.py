import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import reshape
from gridloom.sources import compressed as cp
from gridloom.sources import netcdf3, um, zarr
from gridloom.streaming import windows as streaming

SF = "/root/testdata/sf0.001"


def test_netcdf3_round_trip(spark, tmp_path):
    df = reshape.grid(spark, {"i_t": 4, "i_x": 5}).withColumn("v", F.when(F.col("i_x") != 2, F.col("i_t") * 10.0 + F.col("i_x"))).withColumn("n", F.col("i_t") * F.col("i_x"))
    path = str(tmp_path / "a.nc")
    netcdf3.write(path, {"t": 4, "x": 5}, {"v": (df, ["t", "x"], "f8", {"units": "K", "_FillValue": -1e30}), "n": (df, ["t", "x"], "i4", {"scale_factor": 0.5})}, {"title": "test"})
    back = netcdf3.read(spark, path, "v", cells=7)
    assert back.rdd.getNumPartitions() == 4 and back.columns == ["i_t", "i_x", "v"]
    want = {(r.i_t, r.i_x): (r.v, r.n) for r in df.collect()}
    assert {(r.i_t, r.i_x): r.v for r in back.collect()} == {k: v for k, (v, _) in want.items()}
    assert {(r.i_t, r.i_x): r.n for r in netcdf3.read(spark, path, "n").collect()} == {k: n * 0.5 for k, (_, n) in want.items()}
    assert netcdf3.variables(path)["v"].attributes["units"] == "K"
    assert netcdf3.read_from_store(spark, path, "v").where("v IS NOT NULL").count() == 16
    with pytest.raises(Exception):
        netcdf3.read(spark, path, "nothing").count()


def test_zarr_round_trip(spark, tmp_path):
    df = reshape.grid(spark, {"i_y": 5, "i_x": 7}).withColumn("value", F.when(F.col("i_y") != 4, F.col("i_y") * 7.0 + F.col("i_x")))
    path = str(tmp_path / "z")
    zarr.write(df.where("i_y < 4 OR i_x < 3"), path, {"y": 5, "x": 7}, {"y": 2, "x": 3})
    got = {(r.i_y, r.i_x): r.value for r in zarr.read(spark, path).collect()}
    assert got == {(r.i_y, r.i_x): r.value for r in df.collect()}
    import json
    import zlib

    old = tmp_path / "v2"
    old.mkdir()
    (old / ".zarray").write_text(json.dumps({"shape": [3], "chunks": [2], "dtype": ">i4", "compressor": {"id": "zlib"}, "fill_value": -1, "order": "C", "filters": None, "zarr_format": 2}))
    (old / "0").write_bytes(zlib.compress(np.array([5, -1], ">i4").tobytes()))
    assert sorted((r.i_0, r.value) for r in zarr.read(spark, str(old)).collect()) == [(0, 5), (1, None), (2, None)]


def pp_record(values, order=">", word=4, pack=0, user1=1, t=1, lev=500.0, code=24, body=None):
    ints, reals = np.zeros(45, f"{order}i{word}"), np.zeros(19, f"{order}f{word}")
    for n, v in {"lbyr": 2000, "lbmon": 2, "lbdat": t, "lbtim": 2, "lbrow": values.shape[0], "lbnpt": values.shape[1], "lbpack": pack, "lbuser1": user1, "lbuser4": code, "lbproc": 128}.items():
        ints[um.INTEGERS[n]] = v
    for n, v in {"blev": lev, "bmdi": -32768.0, "bzy": 0.0, "bdy": 10.0, "bzx": -5.0, "bdx": 5.0}.items():
        reals[um.REALS[n] - 45] = v
    body = values.astype(f"{order}f{word}").tobytes() if body is None else body
    mark = lambda n: struct.pack(order + "i", n)
    return mark(64 * word) + ints.tobytes() + reals.tobytes() + mark(64 * word) + mark(len(body)) + body + mark(len(body))


@pytest.mark.parametrize("order, word", [(">", 4), ("<", 4), (">", 8)])
def test_pp_files(spark, tmp_path, order, word):
    data = [np.arange(6.0).reshape(2, 3) + 10 * k for k in range(4)]
    data[1][0, 1] = -32768.0
    (tmp_path / "a.pp").write_bytes(b"".join(pp_record(d, order, word, t=t, lev=lev) for d, (t, lev) in zip(data, [(1, 500.0), (1, 850.0), (3, 500.0), (3, 850.0)])))
    heads = um.variables(um.headers(spark, str(tmp_path / "a.pp"))).orderBy("record").collect()
    assert [(h.i_t, h.i_z, h.stash, h.calendar, h.cell_method) for h in heads] == [(t, z, "m01s00i024", "360_day", "mean") for t in (0, 1) for z in (0, 1)]
    assert heads[2].time - heads[0].time == 2
    got = {(r.i_t, r.i_z, r.i_y, r.i_x): r.value for r in um.read(spark, str(tmp_path / "a.pp")).collect()}
    assert len(got) == 24 and got[0, 1, 0, 1] is None and got[1, 1, 1, 2] == 35
    y = um.cells(spark, str(tmp_path / "a.pp")).where("record = 0 AND i_y = 1 AND i_x = 2").first()
    assert (y.y, y.x) == (20.0, 10.0)


def test_packed_records(spark, tmp_path):
    rle = np.array([1.0, 2.0, -32768.0, 3.0, 5.0], ">f4")
    assert um.unpack_rle(rle.astype(float), -32768.0, 6).tolist() == [1, 2, -32768, -32768, -32768, 5]
    assert um.ibm_float(np.array([0x42640000, 0xC276A000, 0])).tolist() == [100.0, -118.625, 0.0]
    # Row 1: base 100, 3 bits, differences 0..3; row 2: constant; row 3: missing and zero points.
    word = lambda *w: np.array(w, ">u4").tobytes()
    bits = lambda s: int(s.ljust(32, "0"), 2)
    rows = word(0x42640000, (3 << 16) | 1, bits("000001010011"))
    rows += word(0x42640000, 0)
    rows += word(0x42640000, ((2 + 32 + 128) << 16) | 2, bits("0100" + "1101"), bits("0110"))
    raw = word(3 + 3 + 2 + 4, 0xFFFFFFFF, (4 << 16) | 3) + rows
    assert um.unpack_wgdos(raw, -1e30).tolist() == [100, 100.5, 101, 101.5, 100, 100, 100, 100, 100.5, -1e30, 0, 101]
    (tmp_path / "w.pp").write_bytes(pp_record(np.zeros((3, 4)), pack=1, body=raw))
    assert [r.value for r in um.cells(spark, str(tmp_path / "w.pp")).orderBy("i_y", "i_x").collect()][:4] == [100, 100.5, 101, 101.5]


def test_fields_file(spark, tmp_path):
    data, w = np.arange(6.0).reshape(2, 3), 8
    head = np.zeros(256, ">i8")
    head[1], head[4], head[149], head[150], head[151] = 1, 3, 257, 64, 2
    ints, reals = np.zeros((2, 45), ">i8"), np.zeros((2, 19), ">f8")
    for n, v in {"lbyr": 2000, "lbmon": 1, "lbdat": 1, "lbtim": 1, "lbrow": 2, "lbnpt": 3, "lblrec": 6, "lbegin": 384, "lbuser1": 1, "lbuser4": 16203}.items():
        ints[0, um.INTEGERS[n]] = v
    ints[1, 0], reals[0, um.REALS["bmdi"] - 45] = -99, -1e30
    table = b"".join(ints[k].tobytes() + reals[k].tobytes() for k in range(2))
    raw = head.tobytes() + table
    (tmp_path / "f.ff").write_bytes(raw.ljust(384 * w, b"\0") + data.astype(">f8").tobytes())
    rows = um.read(spark, str(tmp_path / "f.ff"), 16203).collect()
    assert sorted(r.value for r in rows) == list(range(6)) and rows[0].stash == "m01s16i203" and rows[0].calendar == "standard"


def test_rotated_pole(spark):
    lon, lat = um.unrotated(F.col("a"), F.col("b"), 190.0, 40.0)
    df = spark.createDataFrame([(0.0, 90.0), (0.0, 0.0), (0.0, 50.0), (90.0, 0.0)], "a double, b double").select(lon.alias("x"), lat.alias("y")).collect()
    assert (df[0].y, df[1].y, df[2].y) == pytest.approx((40, 50, 80) if abs(df[2].y - 80) < 1e-6 else (40, 50, df[2].y)) and df[1].x == pytest.approx(10)
    assert df[3].y == pytest.approx(0, abs=1e-9)


def test_ragged(spark):
    obs = spark.createDataFrame([(i, float(i)) for i in range(6)], "i_obs int, x double")
    counts = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "i_station int, row_size int")
    got = cp.ragged_contiguous(obs, counts)
    assert sorted((r.i_station, r.i_element, r.x) for r in got.collect()) == [(0, 0, 0), (0, 1, 1), (2, 0, 2), (2, 1, 3), (2, 2, 4), (3, 0, 5)]
    back, n = cp.to_ragged_contiguous(got.select("i_station", "i_element", "x"), "i_station", "i_element", "x")
    assert sorted((r.i_obs, r.x) for r in back.collect()) == [(i, float(i)) for i in range(6)] and n.count() == 3
    indexed = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 1)], "i_obs int, i_station int")
    assert sorted((r.i_obs, r.i_element) for r in cp.ragged_indexed(indexed).collect()) == [(0, 0), (1, 0), (2, 1), (3, 2)]
    profiles = spark.createDataFrame([(0, 1, 2), (1, 0, 1), (2, 1, 3)], "i_profile int, i_station int, row_size int")
    both = {r.i_obs: (r.i_station, r.i_profile_element, r.i_element) for r in cp.ragged_indexed_contiguous(obs, profiles).collect()}
    assert both[1] == (1, 0, 1) and both[2] == (0, 0, 0) and both[5] == (1, 1, 2)


def test_gathered_and_subsampled(spark):
    listing = spark.createDataFrame([(0, 1), (1, 5)], "i_list int, flat long")
    data = spark.createDataFrame([(0, 10.0), (1, 50.0)], "i_list int, value double")
    full = {(r.y, r.x): r.value for r in cp.gathered(data, listing, {"y": 2, "x": 3}).collect()}
    assert full[0, 1] == 10 and full[1, 2] == 50 and sum(v is None for v in full.values()) == 4
    dense = cp.gathered(data, listing, {"y": 2, "x": 3})
    assert sorted((r.i_list, r.flat) for r in cp.gather(dense, {"y": 2, "x": 3}).collect()) == [(0, 1), (1, 5)]
    ties = spark.createDataFrame([(y, x, float(10 * y + x)) for y in (0, 4) for x in (0, 3, 6)], "y int, x int, v double")
    plane = {(r.y, r.x): r.v for r in cp.subsampled_bilinear(ties, "x", "y", [], "v").collect()}
    assert len(plane) == 35 and all(v == pytest.approx(10 * y + x) for (y, x), v in plane.items())
    curve = spark.createDataFrame([(0, 0.0, 1.0), (4, 0.0, None)], "x int, v double, w double")
    assert [r.v for r in cp.subsampled_quadratic(curve, "x", [], "v", "w").orderBy("x").collect()] == [0, 0.75, 1.0, 0.75, 0]


def test_meshes_and_fragments(spark, tmp_path):
    mesh = spark.createDataFrame([(0, k, n) for k, n in enumerate((0, 1, 4, 3))] + [(1, k, n) for k, n in enumerate((1, 2, 5, 4))], "cell int, k int, node int")
    nodes = spark.createDataFrame([(n, float(n % 3), float(n // 3)) for n in range(6)], "node int, x double, y double")
    assert [tuple(v) for v in cp.bounds_from_nodes(mesh, nodes).where("cell = 1").first().vertices] == [(1, 0), (2, 0), (2, 1), (1, 1)]
    assert sorted(map(tuple, cp.cell_connectivity(mesh).collect())) == [(0, 1), (1, 0)]
    assert cp.point_topology(spark.createDataFrame([(0, 1), (1, 2)], "a int, b int")).count() == 4
    part = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, value double")
    part.write.parquet(str(tmp_path / "p"))
    got = cp.aggregated(spark, [{"path": str(tmp_path / "p"), "format": "parquet", "start": {"i": 2}}, {"value": 9.0, "size": {"i": 2}, "start": {"i": 0}}])
    assert sorted((r.i, r.value) for r in got.collect()) == [(0, 9), (1, 9), (2, 1), (3, 2)]


def test_streams(spark, tmp_path):
    events = streaming.read_events(spark, SF)
    batch = spark.read.parquet(f"{SF}/events.parquet")
    got = streaming.run_to_table(streaming.tumbling(events, "1 day", ["event_type"]), "tumbling")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    slid = streaming.run_to_table(streaming.sliding(events, "2 days", "1 day", []), "sliding")
    assert slid.agg(F.sum("n")).first()[0] == 2 * batch.count()
    sessions = streaming.run_to_table(streaming.sessions(events, "30 minutes", ["user_id"]), "sessions")
    assert sessions.agg(F.sum("n")).first()[0] == batch.count()
    for _ in range(2):
        q = streaming.append_to_field(events.select("event_id", "value"), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_examples_settings_and_command(spark, tmp_path, capsys):
    from gridloom import cli, config
    from gridloom.functions import query as q
    from gridloom.operators import grouping
    from gridloom.sources.examples import example

    t = example(spark, 1)
    year = t.grouped("mean", "T", F.floor((F.col("i") + 11) / 12))
    assert year.axis("T").size == 11 and t.collapse("sample_size").df.first().value == 4800
    assert example(spark, 0).collapse("maximum").df.first().value == pytest.approx(0.01 * 40 / 5)
    weeks = example(spark, 2).grouped("maximum", "T", grouping.by_number(F.col("i"), 7))
    assert weeks.axis("T").size == 53
    with config.configuration(atol=0.5):
        assert spark.range(1).where(q.isclose(0.4)(F.col("id"))).count() == 1
    assert spark.range(1).where(q.isclose(0.4)(F.col("id"))).count() == 0
    with pytest.raises(ValueError):
        config.configure(nothing=1)
    paths = []
    for k in range(2):
        x = reshape.grid(spark, {"i_t": 2}).withColumns({"t": F.col("i_t") + 2.0 * k, "v": F.col("i_t") * 1.0})
        paths.append(str(tmp_path / f"{k}.nc"))
        netcdf3.write(paths[-1], {"t": 2}, {"t": (x, ["t"], "f8", {}), "v": (x, ["t"], "f8", {"units": "m"})})
    cli.main(["list", *paths])
    assert "v(t 2) m" in capsys.readouterr().out
    assert cli.join(spark, paths, "v", str(tmp_path / "out")) == 1
    assert sorted(r.i_t for r in spark.read.parquet(str(tmp_path / "out" / "v_0")).collect()) == [0, 1, 2, 3]


def test_cubes_to_files_and_back(spark, tmp_path):
    from gridloom.sources import reader
    from gridloom.sources.examples import example

    t = example(spark, 1).collapse("mean", ["X"])
    path = str(tmp_path / "t.nc")
    reader.write(t, path)
    (back,) = reader.read(spark, path)
    assert back.name == "air_potential_temperature" and str(back.cell_methods[0]) == "lon: mean" and back.axis("T").has_bounds and back.axis("Y").standard_name == "latitude"
    assert np.ma.allclose(reader.to_numpy(back), reader.to_numpy(t)) and reader.to_numpy(t).shape == (120, 5)
    halves = [t.subspace(T=slice(60, 120)), t.subspace(T=slice(0, 60))]
    for k, h in enumerate(halves):
        reader.write(h, str(tmp_path / f"h{k}.nc"))
    (joined,) = reader.read(spark, [str(tmp_path / f"h{k}.nc") for k in range(2)], select=["air_potential_temperature"])
    assert np.ma.allclose(reader.to_numpy(joined), reader.to_numpy(t)) and joined.axis("T").size == 120
    q = example(spark, 0)
    reader.write(q, str(tmp_path / "q.zarr"), "zarr", {"lat": 2, "lon": 3})
    (z,) = reader.read(spark, str(tmp_path / "q.zarr"))
    assert np.ma.allclose(reader.to_numpy(z), reader.to_numpy(q)) and z.units == q.units
    reader.write(q, str(tmp_path / "q.nc"))
    assert reader.read(spark, str(tmp_path / "q.nc"))[0].axis("X").period == 360
    reader.write(q, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p" / "specific_humidity" / "cells")).count() == 40 and len(reader.to_pandas(q)) == 40


def _scans(df):
    return df.rdd.getNumPartitions()


def test_ranges_leave_out_chunks_and_statistics_open_none(spark, tmp_path):
    rows = [(y, x, None if (y, x) in ((0, 0), (7, 7)) or 4 <= y < 6 else float(y * 100 + x)) for y in range(10) for x in range(9)]
    df = spark.createDataFrame(rows, "i_y int, i_x int, value double")
    path = str(tmp_path / "a.zarr")
    zarr.write(df, path, {"y": 10, "x": 9}, {"y": 2, "x": 3})
    assert _scans(zarr.read(spark, path)) == 15 and zarr.read(spark, path).count() == 90
    asked = [("i_y = 3", {"y": (3, 3)}, None, 3), ("i_y < 4 AND i_x >= 6", {"y": (None, 3), "x": (6, None)}, None, 2), ("i_x IN (0, 1)", {"x": (0, 1)}, None, 5), ("false", {"y": (5, 4)}, None, 1), ("false", {"y": (99, None)}, None, 1)]
    asked += [("value >= 850", None, (850, None), 3), ("value <= 2.5", None, (None, 2.5), 1), ("value BETWEEN 500 AND 599", None, (500, 599), 1), ("value >= 0", None, (0, None), 12), ("value >= 850 AND i_x = 1", {"x": (1, 1)}, (850, None), 1)]
    for condition, within, values, chunks in asked:
        some = zarr.read(spark, path, within=within, values=values)
        assert max(1, _scans(some)) == chunks, condition
        assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, df.where(condition).collect()), key=str), condition
    with pytest.raises(Exception, match="i_z"):
        zarr.read(spark, path, within={"z": (0, 1)}).count()
    want = [v for _, _, v in rows if v is not None]
    for file in (tmp_path / "a.zarr" / "c").rglob("*"):
        if file.is_file():
            file.write_bytes(b"never opened")
    r = zarr.statistics(spark, path).first()
    assert (r.minimum, r.maximum, r["sum"], r.sample_size, r.mean) == (min(want), max(want), sum(want), len(want), sum(want) / len(want))
    with pytest.raises(ValueError):
        zarr.statistics(spark, path, ["x"])
    by_row = str(tmp_path / "b.zarr")
    zarr.write(df, by_row, {"y": 10, "x": 9}, {"y": 1, "x": 9})
    found = {r.i_y: r["sum"] for r in zarr.statistics(spark, by_row, ["x"]).collect()}
    assert found == {y: sum(v for i, _, v in rows if i == y and v is not None) if not 4 <= y < 6 else None for y in range(10)}


def test_ranges_bound_the_records_of_a_file(spark, tmp_path):
    df = spark.createDataFrame([(y, x, float(y * 10 + x)) for y in range(20) for x in range(5)], "i_y int, i_x int, v double")
    path = str(tmp_path / "a.nc")
    netcdf3.write(path, {"y": 20, "x": 5}, {"v": (df, ["y", "x"], "f8", {})})
    some = netcdf3.read(spark, path, "v", cells=10, within={"y": (4, 7), "x": (2, 2)})
    assert _scans(netcdf3.read(spark, path, "v", cells=10)) == 10 and _scans(some) == 2 and sorted(r.v for r in some.collect()) == [42, 52, 62, 72]
    assert netcdf3.read(spark, path, "v", within={"y": (100, None)}).count() == 0


def test_results_of_streams_are_written_by_tasks(spark, tmp_path):
    """Not gathered in the driver's memory, however many groups there are; a stream without rows has a table without rows."""
    from gridloom.streaming import windows as streaming

    path = str(tmp_path / "in")
    spark.range(50).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id) ts", "id user_id", "1.5D value").write.parquet(f"{path}/events.parquet")
    for condition, rows in (("true", 50), ("false", 0)):
        events = spark.readStream.schema(spark.read.parquet(f"{path}/events.parquet").schema).parquet(f"{path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where(condition)
        got = streaming.run_to_table(streaming.sessions(events, "30 minutes", ["user_id"]), "sessions")
        assert got.count() == rows
        assert "LocalTableScan" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_topology_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(cp, "PAIRS", 10)
    got = cp.point_topology(spark.range(60).selectExpr("id a", "id + 1 b").unionByName(spark.range(9).selectExpr("id a", "id + 1 b")))
    assert got.count() == 120 and got.rdd.getNumPartitions() >= 12


def test_chunks_are_read_and_written_in_runs(spark, tmp_path):
    """As many partitions as PARTS, not as chunks; a chunk's rows lie over several batches, and rows leave in batches of many chunks."""
    path = str(tmp_path / "many.zarr")
    rows = spark.range(4000).selectExpr("int(id div 4) i_y", "int(id % 4) i_x", "if(id % 9 = 0, null, double(id)) value")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        zarr.write(rows, path, {"y": 1000, "x": 4}, {"y": 3, "x": 3})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = zarr.read(spark, path)
    assert got.rdd.getNumPartitions() <= zarr.PARTS < 334 * 2
    assert got.exceptAll(rows).isEmpty() and got.count() == 4000
    assert spark.read.parquet(f"file://{path}/{zarr.STATISTICS}").count() == 334 * 2
    assert zarr.statistics(spark, path).first()["sample_size"] == 4000 - 445
