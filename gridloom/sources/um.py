"""Met Office PP files and fields files: header records and unpacked data, decoded by Arrow batches from binary files.

A file is a row of Spark's binaryFile source, so any store that Spark reads will do (a file of at most 2 GB). The first
pass lists the headers; variables are groups of records with the same quantity and grid, in order of time and level;
the second pass decodes the records that are asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.calendars import days_from_date

# Fixed positions (from 0) of the format's header words: integers 0 to 44, then reals 45 to 63.
INTEGERS = {"lbyr": 0, "lbmon": 1, "lbdat": 2, "lbhr": 3, "lbmin": 4, "lbyrd": 6, "lbmond": 7, "lbdatd": 8, "lbhrd": 9, "lbmind": 10, "lbtim": 12, "lbft": 13, "lblrec": 14, "lbcode": 15, "lbhem": 16, "lbrow": 17, "lbnpt": 18, "lbext": 19, "lbpack": 20, "lbfc": 22, "lbproc": 24, "lbvc": 25, "lbegin": 28, "lbnrec": 29, "lblev": 32, "lbsrce": 37, "lbuser1": 38, "lbuser4": 41, "lbuser5": 42, "lbuser7": 44}
REALS = {"bulev": 45, "bhulev": 46, "blev": 51, "brlev": 52, "bhlev": 53, "bhrlev": 54, "bplat": 55, "bplon": 56, "bzy": 58, "bdy": 59, "bzx": 60, "bdx": 61, "bmdi": 62, "bmks": 63}
HEADER, N_INTEGERS = 64, 45
#: Calendars by the last digit of LBTIM, and statistics by bits of LBPROC.
CALENDARS = {1: "standard", 2: "360_day", 4: "365_day"}
PROCESSES = ((128, "mean"), (4096, "minimum"), (8192, "maximum"))


@dataclass
class Layout:
    fields_file: bool
    word: int  # bytes
    order: str  # > or <


def layout(raw: bytes) -> Layout:
    """Word size, byte order and kind, from the first words: a PP file starts with the length of a 64-word record, a fields file with
    its version and a fixed pattern of small numbers."""
    for word in (8, 4):
        for order in (">", "<"):
            kind = f"{order}i{word}"
            if len(raw) >= 4 and struct.unpack(order + "i", raw[:4])[0] == HEADER * word:
                return Layout(False, word, order)
            head = np.frombuffer(raw[: word * 256], kind)
            if len(head) == 256 and head[1] in (1, 2, 3, 4) and head[4] in (1, 2, 3, 4, 5, 6) and head[150] == HEADER and head[149] > 256:
                return Layout(True, word, order)
    raise ValueError("neither a PP nor a fields file")


def records(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(integer words, real words, offset of the data, bytes of the data) of every record."""
    at = layout(raw)
    w, o = at.word, at.order

    def split(block: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(block[: N_INTEGERS * w], f"{o}i{w}"), np.frombuffer(block[N_INTEGERS * w :], f"{o}f{w}")

    if not at.fields_file:
        pos = 0
        while pos + 4 <= len(raw):
            n = struct.unpack(o + "i", raw[pos : pos + 4])[0]
            ints, reals = split(raw[pos + 4 : pos + 4 + n])
            pos += n + 8
            size = struct.unpack(o + "i", raw[pos : pos + 4])[0]
            yield ints, reals, pos + 4, size
            pos += size + 8
        return
    head = np.frombuffer(raw[: w * 256], f"{o}i{w}")
    start, width, many = int(head[149]) - 1, int(head[150]), int(head[151])
    for k in range(many):
        ints, reals = split(raw[(start + k * width) * w : (start + (k + 1) * width) * w])
        if ints[INTEGERS["lbyr"]] == -99:  # an unused entry
            continue
        packed = ints[INTEGERS["lbpack"]] % 10
        size = int(ints[INTEGERS["lblrec"]]) * (4 if packed == 2 else w)
        yield ints, reals, int(ints[INTEGERS["lbegin"]]) * w, size


def unpack_rle(values: np.ndarray, missing: float, size: int) -> np.ndarray:
    """Run-length code: a missing value is followed by how often it stands."""
    out, k = [], 0
    while k < len(values) and sum(map(len, out)) < size:
        if values[k] == missing:
            out.append(np.full(int(values[k + 1]), missing))
            k += 2
        else:
            end = k
            while end < len(values) and values[end] != missing:
                end += 1
            out.append(values[k:end])
            k = end
    return np.concatenate(out)[:size] if out else np.zeros(0)


def ibm_float(words: np.ndarray) -> np.ndarray:
    """IBM 32-bit floating point: sign, base-16 exponent less 64, 24-bit fraction."""
    words = words.astype(np.uint32)
    sign = np.where(words >> 31, -1.0, 1.0)
    return sign * (words & 0xFFFFFF).astype(float) / 2**24 * 16.0 ** (((words >> 24) & 0x7F).astype(int) - 64)


def unpack_wgdos(raw: bytes, missing: float) -> np.ndarray:
    """WGDOS code: per row a base value, the bits of each scaled difference, and bit maps of missing, least and zero points."""
    words = np.frombuffer(raw[: len(raw) // 4 * 4], ">u4")
    scale = 2.0 ** int(words[1].astype(">i4"))
    columns, rows = int(words[2] >> 16), int(words[2] & 0xFFFF)
    out, at = np.empty((rows, columns)), 3
    for r in range(rows):
        base = float(ibm_float(words[at : at + 1])[0])
        flags, length = int(words[at + 1] >> 16), int(words[at + 1] & 0xFFFF)
        bits = np.unpackbits(words[at + 2 : at + 2 + length].astype(">u4").view(np.uint8))
        at += 2 + length
        width, pos = flags & 31, 0
        masks = {}
        for flag, name in ((32, "missing"), (64, "least"), (128, "filled")):
            if flags & flag:
                masks[name] = bits[pos : pos + columns].astype(bool)
                pos += columns
        pos += -pos % 32
        none = np.zeros(columns, bool)
        gone, least, zero = masks.get("missing", none), masks.get("least", none), ~masks["filled"] if "filled" in masks else none
        row = np.full(columns, base)
        stored = ~(gone | least | zero)
        if width:
            n = int(stored.sum())
            digits = bits[pos : pos + n * width].reshape(n, width)
            row[stored] = base + digits @ (1 << np.arange(width - 1, -1, -1)) * scale
        row[zero], row[gone] = 0.0, missing
        out[r] = row
    return out.reshape(-1)


def field_data(raw: bytes, at: Layout, ints: np.ndarray, reals: np.ndarray, offset: int, size: int) -> np.ma.MaskedArray:
    """A record's values, missing ones masked."""
    get = lambda n: int(ints[INTEGERS[n]])
    n, missing, pack = max(0, get("lbrow")) * max(0, get("lbnpt")), float(reals[REALS["bmdi"] - N_INTEGERS]), get("lbpack") % 10
    body = raw[offset : offset + size - max(0, get("lbext")) * at.word]
    kind = "i" if get("lbuser1") in (2, -2, 3, -3) else "f"
    if pack == 1:
        values = unpack_wgdos(body, missing)
    elif pack == 4:
        values = unpack_rle(np.frombuffer(body[: len(body) // at.word * at.word], f"{at.order}f{at.word}").astype(float), missing, n)
    else:
        width = 4 if pack == 2 else at.word
        values = np.frombuffer(body[: len(body) // width * width], f"{at.order}{kind}{width}").astype(float)
    values = values[:n] if n else values
    return np.ma.masked_equal(values, missing)


_HEADERS = ", ".join(["path string", "record int", *(f"{n} long" for n in INTEGERS), *(f"{n} double" for n in REALS)])


def headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per record: its file, number and header words."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [{"path": path, "record": k, **{n: int(ints[i]) for n, i in INTEGERS.items()}, **{n: float(reals[i - N_INTEGERS]) for n, i in REALS.items()}} for k, (ints, reals, _, _) in enumerate(records(content.as_py()))]
                if rows:
                    table = pa.Table.from_pylist(rows)
                    yield from table.set_column(1, "record", table.column("record").cast(pa.int32())).to_batches()

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(scan, _HEADERS)


def stash(found: Column) -> Column:
    """Section and item of LBUSER4 as text, such as m01s00i024 (model 1)."""
    return F.format_string("m01s%02di%03d", F.floor(found / 1000).cast("int"), (found % 1000).cast("int"))


def valid_days(rows: DataFrame, prefix: str = "") -> Column:
    """A record's time in days from 1970-01-01 of its own calendar; prefix d: of its second time."""
    y, m, d, h, mi = (F.col(f"{n}{prefix}") for n in ("lbyr", "lbmon", "lbdat", "lbhr", "lbmin"))
    out = F.lit(None).cast("double")
    for digit, calendar in CALENDARS.items():
        out = F.when(F.col("lbtim") % 10 == digit, days_from_date(y, m, d, calendar) + h / 24 + mi / 1440).otherwise(out)
    return out


def variables(found: DataFrame) -> DataFrame:
    """Headers with variable (a hash of quantity, process, grid and calendar), time, level and dense positions i_t and i_z in it."""
    from pyspark.sql import Window

    key = F.xxhash64("lbuser4", "lbproc", "lbcode", "lbvc", "lbrow", "lbnpt", "bzy", "bdy", "bzx", "bdx", "bplat", "bplon", F.col("lbtim") % 10)
    rows = found.withColumns({"variable": key, "stash": stash(F.col("lbuser4")), "time": valid_days(found)})
    rank = lambda c: (F.dense_rank().over(Window.partitionBy("variable").orderBy(c)) - 1).cast("int")
    process = F.lit(None).cast("string")
    for bit, name in PROCESSES:
        process = F.when(F.col("lbproc").bitwiseAND(F.lit(bit)) != 0, name).otherwise(process)
    return rows.withColumns({"i_t": rank("time"), "i_z": rank("blev"), "cell_method": process, "calendar": F.element_at(F.create_map(*[F.lit(x) for k, v in CALENDARS.items() for x in (k, v)]), (F.col("lbtim") % 10).cast("int"))})


def cells(spark: SparkSession, paths: str | Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """One row per cell: path, record, i_y, i_x, y, x (coordinates of the grid) and value. wanted: headers to keep (path, record)."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                at = layout(raw)
                for k, (ints, reals, offset, size) in enumerate(records(raw)):
                    data = field_data(raw, at, ints, reals, offset, size)
                    nx = max(1, int(ints[INTEGERS["lbnpt"]]))
                    i = np.arange(len(data))
                    iy, ix = i // nx, i % nx
                    word = lambda n: float(reals[REALS[n] - N_INTEGERS])
                    y, x = word("bzy") + word("bdy") * (iy + 1), word("bzx") + word("bdx") * (ix + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(data)), pa.array([k] * len(data), pa.int32()), pa.array(iy.astype(np.int32)), pa.array(ix.astype(np.int32)), pa.array(y), pa.array(x), pa.array(np.ma.getdata(data), mask=np.ma.getmaskarray(data))], names=["path", "record", "i_y", "i_x", "y", "x", "value"])

    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(decode, "path string, record int, i_y int, i_x int, y double, x double, value double")
    return rows if wanted is None else rows.join(wanted.select("path", "record"), ["path", "record"], "left_semi")


def read(spark: SparkSession, paths: str | Sequence[str], code: int | None = None) -> DataFrame:
    """Cells of all variables, or of one quantity (LBUSER4), with variable, stash, i_t, i_z, time and level."""
    found = variables(headers(spark, paths))
    if code is not None:
        found = found.where(F.col("lbuser4") == code)
    keep = found.select("path", "record", "variable", "stash", "calendar", "cell_method", "time", F.col("blev").alias("level"), "i_t", "i_z")
    return cells(spark, paths).join(keep, ["path", "record"]).drop("path", "record")


def unrotated(lon: Column, lat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """True longitude and latitude in degrees of rotated ones, for a pole at (pole_lon, pole_lat)."""
    t, a, b = F.radians(F.lit(float(pole_lat))), F.radians(lon), F.radians(lat)
    x, y, z = F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)
    up, along = F.cos(t) * x + F.sin(t) * z, F.cos(t) * z - F.sin(t) * x
    return F.pmod(F.degrees(F.atan2(-y, along)) + pole_lon + 180.0, F.lit(360.0)) - 180.0, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))


def read_stash_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of quantities, fields separated by `!`: model, stash code, name, units, valid from, valid to, standard name, …"""
    return spark.read.option("sep", "!").option("comment", "#").schema("model int, code int, name string, units string, valid_from string, valid_to string, standard_name string, extra string, pp_extra string").csv(path)
