"""Zarr arrays (formats 2 and 3; raw, zlib, gzip or zstd chunks): a Spark data source whose partitions read runs of chunks, and a writer.

Ranges of positions leave out chunks. Beside an array that is written here lies a table with each chunk's count, least and greatest value and
sum: a range of values leaves out chunks by it, and collapses over the whole array or over whole chunks don't open any.
"""

from __future__ import annotations

import gzip
import itertools
import json
import os
import shutil
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.sources import within as ranges

#: The folder of the table of statistics, beside an array's metadata.
STATISTICS = "_chunk_statistics"
#: A read has up to PARTS partitions, and more only so that none holds over CELLS cells (or one chunk); rows leave it in batches of BATCH or so.
PARTS, CELLS, BATCH = 96, 1 << 22, 1 << 15

_V3 = {"float64": "f8", "float32": "f4", "int64": "i8", "int32": "i4", "int16": "i2", "int8": "i1", "uint8": "u1", "uint16": "u2", "uint32": "u4", "bool": "b1"}
_SQL = {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "int", "i1": "int", "u1": "int", "u2": "int", "u4": "long", "b1": "boolean"}


def metadata(path: str) -> dict:
    """Shape, chunks, kind (with byte order), fill, codec, separator, prefix and attributes of an array in either format."""
    v3 = os.path.join(path, "zarr.json")
    if os.path.exists(v3):
        m = json.load(open(v3))
        codecs = {c["name"]: c.get("configuration", {}) for c in m["codecs"]}
        unknown = set(codecs) - {"bytes", "gzip", "zstd", "crc32c"}
        if unknown:
            raise ValueError(f"codecs {sorted(unknown)} are not supported")
        order = ">" if codecs.get("bytes", {}).get("endian") == "big" else "<"
        encoding = m.get("chunk_key_encoding", {"name": "default"})
        return {"shape": m["shape"], "chunks": m["chunk_grid"]["configuration"]["chunk_shape"], "kind": order + _V3[m["data_type"]], "fill": m.get("fill_value"), "codec": next((c for c in ("gzip", "zstd") if c in codecs), None), "crc": "crc32c" in codecs, "separator": encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else "."), "prefix": "c" if encoding["name"] == "default" else "", "dims": m.get("dimension_names"), "attributes": m.get("attributes", {})}
    m = json.load(open(os.path.join(path, ".zarray")))
    if m.get("filters") or m.get("order", "C") != "C":
        raise ValueError("filters and Fortran order are not supported")
    codec = (m.get("compressor") or {}).get("id")
    if codec not in (None, "zlib", "gzip", "zstd"):
        raise ValueError(f"codec {codec!r} is not supported")
    attrs = os.path.join(path, ".zattrs")
    attributes = json.load(open(attrs)) if os.path.exists(attrs) else {}
    return {"shape": m["shape"], "chunks": m["chunks"], "kind": m["dtype"].replace("|", "<"), "fill": m.get("fill_value"), "codec": codec, "crc": False, "separator": m.get("dimension_separator", "."), "prefix": "", "dims": attributes.get("_ARRAY_DIMENSIONS"), "attributes": attributes}


def _decode(raw: bytes, codec: str | None) -> bytes:
    if codec == "zlib":
        return zlib.decompress(raw)
    if codec == "gzip":
        return gzip.decompress(raw)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw


def _fill(m: dict):
    special = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}
    return special.get(m["fill"], m["fill"]) if isinstance(m["fill"], str) else m["fill"]


class Chunks(InputPartition):
    def __init__(self, many: list[tuple[int, ...]]):
        self.many = many


def _runs(chunks: list[tuple[int, ...]], cells: int) -> list[Chunks]:
    """Chunks of so many cells each, in order, as partitions."""
    many = max(1, min(-(-len(chunks) // PARTS), CELLS // max(cells, 1)))
    return [Chunks(chunks[k : k + many]) for k in range(0, len(chunks), many)]


class ZarrDataSource(DataSource):
    """spark.read.format("zarr").option("path", …).load(): i_<dim>… and value (option name); a chunk that isn't there is missing."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> str:
        m = metadata(self.options["path"])
        dims = m["dims"] or range(len(m["shape"]))
        return ", ".join([*(f"`i_{d}` int" for d in dims), f"`{self.options.get('name', 'value')}` {_SQL[m['kind'][1:]]}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, self.options.get("ranges"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, within: str | None = None):
        self.path, self.schema, self.m, self.within = path, schema, metadata(path), within

    def partitions(self) -> Sequence[InputPartition]:
        dims = [c.removeprefix("i_") for c in self.schema.names[:-1]]
        asked = ranges.positions(self.within, dims, self.m["shape"])
        chunks = itertools.product(*(range(r.start // c, -(-r.stop // c)) if len(r) else range(0) for r, c in zip(asked, self.m["chunks"])))
        low, high = ranges.values(self.within)
        if low == -np.inf and high == np.inf:
            return _runs(list(chunks), int(np.prod(self.m["chunks"])))
        known = _statistics(self.path)
        # Long integers are rounded in the table; NaN, which isn't less than anything, is greater than all for Spark.
        passes = lambda s: s is None or (s[0] > 0 and not s[2] + abs(s[2]) * 1e-15 < low and not s[1] - abs(s[1]) * 1e-15 > high)
        return _runs([at for at in chunks if passes(known.get(at))], int(np.prod(self.m["chunks"])))

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no chunk can hold a row of the ranges
            return
        schema, held, many = to_arrow_schema(self.schema), [], 0
        joined = lambda: pa.Table.from_batches(held, schema).combine_chunks().to_batches()
        for at in partition.many:
            held.append(self._chunk(at, schema))
            many += held[-1].num_rows
            if many >= BATCH:
                yield from joined()
                held, many = [], 0
        if held:
            yield from joined()

    def _chunk(self, place: tuple[int, ...], schema: pa.Schema) -> pa.RecordBatch:
        m = self.m
        key = m["separator"].join([*([m["prefix"]] if m["prefix"] else []), *map(str, place)]) or "0"
        own = [min(c, n - a * c) for a, c, n in zip(place, m["chunks"], m["shape"])]
        file, fill = os.path.join(self.path, key), _fill(m)
        if os.path.exists(file):
            raw = open(file, "rb").read()
            data = np.frombuffer(_decode(raw[:-4] if m["crc"] else raw, m["codec"]), m["kind"]).reshape(m["chunks"])[tuple(map(slice, own))].reshape(-1)
            missing = np.isnan(data) if isinstance(fill, float) and np.isnan(fill) else data == fill if fill is not None else np.zeros(data.shape, bool)
        else:
            data, missing = np.zeros(int(np.prod(own)), m["kind"]), np.ones(int(np.prod(own)), bool)
        at = np.unravel_index(np.arange(data.size), own) if own else ()
        columns = [pa.array((x + a * c).astype(np.int32)) for x, a, c in zip(at, place, m["chunks"])]
        columns.append(pa.array(data.astype(data.dtype.newbyteorder("=")), mask=missing).cast(schema.field(len(columns)).type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _statistics(path: str) -> dict[tuple[int, ...], tuple]:
    """Chunk -> (count, least, greatest, sum), a row for each chunk that was written; empty without a table."""
    import pyarrow.parquet as pq

    folder = os.path.join(path, STATISTICS)
    files = sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")) if os.path.isdir(folder) else []
    return {tuple(r["chunk"]): (r["n"], r["low"], r["high"], r["total"]) for f in files for r in pq.read_table(f).to_pylist()}


def statistics(spark: SparkSession, path: str, axes: Sequence[str] | None = None) -> DataFrame:
    """minimum, maximum, sum, sample_size and mean of an array's values from its chunks' statistics: no chunk is opened.

    axes: those that are collapsed (default: all). Others have to have chunks of one position, as in a series of fields that are a chunk each;
    the result has a row for each of their positions with a chunk (i_<dim>).
    """
    m, folder = metadata(path), os.path.join(path, STATISTICS)
    if not os.path.isdir(folder):
        raise ValueError(f"{path} has no statistics of its chunks")
    dims = [str(d) for d in (m["dims"] or range(len(m["shape"])))]
    kept = [d for d in dims if axes is not None and d not in axes]
    wide = [d for d in kept if m["chunks"][dims.index(d)] != 1]
    if wide:
        raise ValueError(f"chunks hold several positions of {', '.join(wide)}")
    rows = spark.read.parquet(f"file://{os.path.abspath(folder)}").select(*[F.col("chunk")[dims.index(d)].alias(f"i_{d}") for d in kept], "n", "low", "high", "total")
    n, total = F.sum("n"), F.sum("total")
    return rows.groupBy(*[f"i_{d}" for d in kept]).agg(F.min("low").alias("minimum"), F.max("high").alias("maximum"), F.when(n > 0, total).alias("sum"), F.coalesce(n, F.lit(0)).alias("sample_size"), F.try_divide(total, n).alias("mean"))


def read(spark: SparkSession, path: str, name: str = "value", within: Mapping[str, ranges.Range] | None = None, values: ranges.Range | None = None) -> DataFrame:
    """An array's cells; within: {dim: (first, last position)}, values: (least, greatest), None for no bound. Missing values are in no range of values.

    Chunks outside the ranges aren't opened: by their place, and by the table of statistics where there is one.
    """
    spark.dataSource.register(ZarrDataSource)
    df = spark.read.format("zarr").option("path", path).option("name", name).option("ranges", ranges.option(within, values)).load()
    return ranges.kept(df, name, within, values)


def write(df: DataFrame, path: str, shape: Mapping[str, int], chunks: Mapping[str, int], value: str = "value", kind: str = "f8", fill: float | int | None = None, attributes: Mapping | None = None) -> None:
    """Write rows (i_<dim>…, value) as a format 3 array with zstd chunks: rows are dealt out and sorted by chunk, the task that has a
    chunk writes it, and its statistics after all chunks are there."""
    shutil.rmtree(os.path.join(path, STATISTICS), ignore_errors=True)
    fill = ("NaN" if kind[0] == "f" else 0) if fill is None else fill
    os.makedirs(path, exist_ok=True)
    long = {v: k for k, v in _V3.items()}[kind]
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(shape.values()), "data_type": long, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [chunks[d] for d in shape]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 1, "checksum": False}}], "dimension_names": list(shape), "attributes": dict(attributes or {})}
    with open(os.path.join(path, "zarr.json"), "w") as f:
        json.dump(meta, f)
    dims, sizes = list(shape), [chunks[d] for d in shape]
    hole = np.nan if fill == "NaN" else fill

    def store(at: tuple[int, ...], table: pa.Table) -> tuple:
        block = np.full(sizes, hole, "<" + kind)
        inside = tuple(table.column(f"i_{d}").to_numpy() % s for d, s in zip(dims, sizes))
        values = table.column(value)
        block[inside] = values.to_numpy() if values.null_count == 0 else np.array([hole if v is None else v for v in values.to_pylist()])
        file = os.path.join(path, "c", *map(str, at))
        os.makedirs(os.path.dirname(file), exist_ok=True)
        with open(file + ".part", "wb") as f:
            f.write(zstandard.ZstdCompressor(level=1).compress(block.tobytes()))
        os.replace(file + ".part", file)  # a task that runs twice writes the same chunk
        there = block[~np.isnan(block)] if fill == "NaN" else block[block != fill]
        ends = (float(np.fmin.reduce(there)), float(there.max()), float(there.sum(dtype=np.float64))) if len(there) else (None, None, None)
        return (list(at), len(there), *ends)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk; those of a chunk may go on in the next batch."""
        out, held, last = [], [], None
        schema = pa.schema([("chunk", pa.list_(pa.int32())), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("total", pa.float64())])
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([np.asarray(batch.column(f"__c{k}")) for k in range(len(dims))], axis=1) if dims else np.zeros((batch.num_rows, 0), int)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                at = tuple(place[a].tolist())
                if held and at != last:
                    out.append(store(last, pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(a, b - a))
                last = at
            if len(out) >= BATCH:
                yield made()
                out = []
        if held:
            out.append(store(last, pa.Table.from_batches(held)))
        if out:
            yield made()

    keys = [F.floor(F.col(f"i_{d}") / s).cast("int").alias(f"__c{k}") for k, (d, s) in enumerate(zip(dims, sizes))]
    rows, named = df.select(*[F.col(f"i_{d}") for d in dims], value, *keys), [f"__c{k}" for k in range(len(dims))]
    dealt = rows.repartition(*named).sortWithinPartitions(*named) if dims else rows.coalesce(1)  # without axes there is one cell
    done = dealt.mapInArrow(run, "chunk array<int>, n long, low double, high double, total double")
    done.write.parquet(f"file://{os.path.abspath(os.path.join(path, STATISTICS))}")
