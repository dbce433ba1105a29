"""Classic netCDF files (versions 1, 2 and 5) in pure Python: a Spark data source with a partition per hyperslab, and a writer.

A variable reads as one row per cell: an integer position per dimension and the value, missing where it is the fill value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.sources import within as ranges

#: Fixed values of the format: external types by tag (numpy kind), and their default fill values.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILLS = {"i1": -127, "S1": b"\x00", ">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, "u1": 255, ">u2": 65535, ">u4": 4294967295, ">i8": -9223372036854775806, ">u8": 18446744073709551614}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    record: bool
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    version: int
    records: int
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    record_size: int


class _Cursor:
    def __init__(self, f):
        self.f = f

    def unpack(self, fmt: str):
        return struct.unpack(">" + fmt, self.f.read(struct.calcsize(">" + fmt)))[0]

    def name(self, count: str) -> str:
        n = self.unpack(count)
        raw = self.f.read(n + (-n) % 4)
        return raw[:n].decode()


def read_header(f) -> Header:
    """The header of an open file."""
    c = _Cursor(f)
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic netCDF file")
    version = magic[3]
    count, offset = ("q", "q") if version == 5 else ("i", "q" if version == 2 else "i")
    records = c.unpack(count)

    def entries(tag: int) -> int:
        found, n = c.unpack("i"), c.unpack(count)
        if found not in (0, tag):
            raise ValueError("broken netCDF header")
        return n

    def attributes() -> dict:
        out = {}
        for _ in range(entries(ATTRIBUTE)):
            name, kind, n = c.name(count), TYPES[c.unpack("i")], c.unpack(count)
            size = n * np.dtype(kind).itemsize
            raw = f.read(size + (-size) % 4)[:size]
            out[name] = raw.decode(errors="replace") if kind == "S1" else (lambda v: v[0].item() if n == 1 else v.tolist())(np.frombuffer(raw, kind))
        return out

    names, sizes = [], []
    for _ in range(entries(DIMENSION)):
        names.append(c.name(count))
        sizes.append(c.unpack(count))
    general, variables, record_size = attributes(), {}, 0
    for _ in range(entries(VARIABLE)):
        name = c.name(count)
        ids = [c.unpack(count) for _ in range(c.unpack(count))]
        own, kind, vsize, begin = attributes(), TYPES[c.unpack("i")], c.unpack(count), c.unpack(offset)
        record = bool(ids) and sizes[ids[0]] == 0
        shape = tuple(records if sizes[i] == 0 else sizes[i] for i in ids)
        variables[name] = Variable(name, tuple(names[i] for i in ids), shape, kind, begin, record, own)
        record_size += vsize if record else 0
    only = [v for v in variables.values() if v.record]
    if len(only) == 1:  # a single record variable isn't padded
        record_size = int(np.prod(only[0].shape[1:], dtype=np.int64)) * np.dtype(only[0].kind).itemsize
    return Header(version, records, {n: records if s == 0 else s for n, s in zip(names, sizes)}, general, variables, record_size)


def read_slab(f, header: Header, v: Variable, start: int, stop: int) -> np.ndarray:
    """The part of a variable from start to stop along its first dimension (scalars: 0 to 1)."""
    item, rest = np.dtype(v.kind).itemsize, int(np.prod(v.shape[1:], dtype=np.int64)) if v.shape else 1
    if v.record:
        parts = []
        for r in range(start, stop):
            f.seek(v.begin + r * header.record_size)
            parts.append(f.read(rest * item))
        raw = b"".join(parts)
    else:
        f.seek(v.begin + start * rest * item)
        raw = f.read((stop - start) * rest * item)
    return np.frombuffer(raw, v.kind).reshape(stop - start, *v.shape[1:])


def masked(v: Variable, data: np.ndarray) -> np.ndarray:
    """Where a variable's data are missing: its fill and missing values, or else the type's default, and what valid_* rules out."""
    own = [v.attributes[k] for k in ("_FillValue", "missing_value") if k in v.attributes]
    bad = np.zeros(data.shape, bool)
    for x in own or ([FILLS[v.kind]] if v.kind not in ("i1", "u1", "S1") else []):
        bad |= np.isin(data, np.array(x, data.dtype))
    low, high = v.attributes.get("valid_range", [v.attributes.get("valid_min"), v.attributes.get("valid_max")])
    if low is not None:
        bad |= data < low
    if high is not None:
        bad |= data > high
    return bad


def unpacked(v: Variable, data: np.ndarray) -> np.ndarray:
    if "scale_factor" in v.attributes or "add_offset" in v.attributes:
        return data.astype(np.float64) * v.attributes.get("scale_factor", 1.0) + v.attributes.get("add_offset", 0.0)
    return data


def _sql_type(v: Variable) -> str:
    if "scale_factor" in v.attributes or "add_offset" in v.attributes:
        return "double"
    return {"S1": "string", "i1": "int", "u1": "int", ">i2": "int", ">u2": "int", ">i4": "int", ">u4": "long", ">i8": "long", ">u8": "decimal(20,0)", ">f4": "float", ">f8": "double"}[v.kind]


class Slab(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class NetCDF3DataSource(DataSource):
    """spark.read.format("netcdf3").option("path", …).option("variable", …).load(); option cells: cells per partition."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _variable(self) -> tuple[Header, Variable]:
        with open(self.options["path"].removeprefix("file://"), "rb") as f:
            header = read_header(f)
        name = self.options.get("variable")
        if name not in header.variables:
            raise ValueError(f"no variable {name!r}; there are {', '.join(header.variables)}")
        return header, header.variables[name]

    def schema(self) -> str:
        _, v = self._variable()
        return ", ".join([*(f"`i_{d}` int" for d in v.dims), f"`{v.name}` {_sql_type(v)}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        header, v = self._variable()
        return _Reader(self.options["path"].removeprefix("file://"), header, v, int(self.options.get("cells", 1 << 22)), schema, self.options.get("ranges"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, header: Header, v: Variable, cells: int, schema: StructType, within: str | None = None):
        self.path, self.header, self.v, self.cells, self.schema, self.within = path, header, v, cells, schema, within

    def partitions(self) -> Sequence[InputPartition]:
        asked = ranges.positions(self.within, self.v.dims, self.v.shape)
        within = asked[0] if asked else range(1)
        rest = max(1, int(np.prod(self.v.shape[1:], dtype=np.int64)))
        step = max(1, self.cells // rest)
        return [Slab(self.path, a, min(a + step, within.stop)) for a in range(within.start, within.stop, step)] or [Slab(self.path, 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        with open(partition.path, "rb") as f:
            for start in range(partition.start, partition.stop):  # one record at a time bounds the memory
                data = read_slab(f, self.header, self.v, start, start + 1)
                yield _cells(self.v, data, start, schema)


def _cells(v: Variable, data: np.ndarray, start: int, schema: pa.Schema) -> pa.RecordBatch:
    bad, values = masked(v, data).reshape(-1), unpacked(v, data).reshape(-1)
    at = np.unravel_index(np.arange(values.size), data.shape)
    columns = [pa.array((a + (start if k == 0 else 0)).astype(np.int32)) for k, a in enumerate(at[: len(v.shape)])]
    if v.kind == "S1":
        found = pa.array([None if b else x.decode(errors="replace") for x, b in zip(values.tolist(), bad.tolist())], pa.string())
    else:
        found = pa.array(values.astype(values.dtype.newbyteorder("=")), mask=bad).cast(schema.field(len(columns)).type)
    return pa.RecordBatch.from_arrays([*columns, found], schema=schema)


def read(spark: SparkSession, path: str, variable: str, cells: int = 1 << 22, within: Mapping[str, ranges.Range] | None = None) -> DataFrame:
    """A variable of a file on a file system that every executor sees; within: {dim: (first, last position)}, None for no bound. Records outside
    the first dimension's range aren't read."""
    spark.dataSource.register(NetCDF3DataSource)
    df = spark.read.format("netcdf3").option("path", path).option("variable", variable).option("cells", str(cells)).option("ranges", ranges.option(within, None)).load()
    return ranges.kept(df, variable, within, None)


def read_from_store(spark: SparkSession, paths: str | Sequence[str], variable: str) -> DataFrame:
    """A variable of files in any store that Spark reads, a file (of at most 2 GB) a row; with `path`."""
    import io

    first = spark.read.format("binaryFile").load(paths).select("content").limit(1).first()
    v = read_header(io.BytesIO(bytes(first[0]))).variables[variable]
    fields = ", ".join(["path string", *(f"`i_{d}` int" for d in v.dims), f"`{variable}` {_sql_type(v)}"])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(fields))
    inner = pa.schema(list(schema)[1:])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = io.BytesIO(content.as_py())
                header = read_header(f)
                own = header.variables[variable]
                for start in range(own.shape[0] if own.shape else 1):
                    made = _cells(own, read_slab(f, header, own, start, start + 1), start, inner)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * made.num_rows), *made.columns], schema=schema)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(cells, fields)


def variables(path: str) -> dict[str, Variable]:
    with open(path.removeprefix("file://"), "rb") as f:
        return read_header(f).variables


def write(path: str, dims: Mapping[str, int], fields: Mapping[str, tuple[DataFrame, Sequence[str], str, Mapping]], attributes: Mapping | None = None) -> None:
    """Write variables {name: (rows with i_<dim> and value columns named as the variable, dims, type tag's name f8/f4/i4/i8/i2, attributes)}.

    Cells come to the writer in order of position, range after range, and go straight to the file: memory stays bounded.
    """
    tags = {"i2": 3, "i4": 4, "f4": 5, "f8": 6, "i8": 10}
    version = 5 if any(t == "i8" for _, _, t, _ in fields.values()) else 2
    count = ">q" if version == 5 else ">i"
    names = list(dims)

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(count, len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attribute(name: str, value) -> bytes:
        if isinstance(value, str):
            raw = value.encode()
            return text(name) + struct.pack(">i", 2) + struct.pack(count, len(raw)) + raw + b"\0" * (-len(raw) % 4)
        values = value if isinstance(value, (list, tuple)) else [value]
        kind, tag = (">i4", 4) if all(isinstance(x, int) for x in values) else (">f8", 6)
        raw = np.array(values, kind).tobytes()
        return text(name) + struct.pack(">i", tag) + struct.pack(count, len(values)) + raw

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">i", tag if items else 0) + struct.pack(count, len(items)) + b"".join(items)

    def header(begins: dict[str, int]) -> bytes:
        out = b"CDF" + bytes([version]) + struct.pack(count, 0)
        out += listed(DIMENSION, [text(n) + struct.pack(count, dims[n]) for n in names])
        out += listed(ATTRIBUTE, [attribute(k, v) for k, v in (attributes or {}).items()])
        made = []
        for name, (_, own, kind, attrs) in fields.items():
            size = int(np.prod([dims[d] for d in own], dtype=np.int64)) * int(kind[1])
            made.append(text(name) + struct.pack(count, len(own)) + b"".join(struct.pack(count, names.index(d)) for d in own) + listed(ATTRIBUTE, [attribute(k, v) for k, v in attrs.items()]) + struct.pack(">i", tags[kind]) + struct.pack(count, min(size + -size % 4, 2**31 - 4) if version != 5 else size + -size % 4) + struct.pack(">q", begins.get(name, 0)))
        return out + listed(VARIABLE, made)

    at, begins = len(header({})), {}
    for name, (_, own, kind, _) in fields.items():
        begins[name] = at
        size = int(np.prod([dims[d] for d in own], dtype=np.int64)) * int(kind[1])
        at += size + -size % 4
    with open(path, "wb") as f:
        f.write(header(begins))
        for name, (df, own, kind, attrs) in fields.items():
            flat = F.lit(0).cast("long")
            for d in own:
                flat = flat * dims[d] + F.col(f"i_{d}")
            fill = attrs.get("_FillValue", FILLS[">" + kind])
            total, size = int(np.prod([dims[d] for d in own], dtype=np.int64)), int(kind[1])
            f.seek(begins[name])
            block = np.full(min(total, 1 << 20), fill, ">" + kind).tobytes()
            left = total * size
            while left > 0:
                left -= f.write(block[:left])
            f.write(b"\0" * (-total * size % 4))
            for r in df.select(flat.alias("at"), F.col(name).alias("v")).where("v IS NOT NULL").repartitionByRange("at").sortWithinPartitions("at").toLocalIterator():
                f.seek(begins[name] + r[0] * size)
                f.write(np.array(r[1], ">" + kind).tobytes())
