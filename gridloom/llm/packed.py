"""Packed exchanges between chunks of documents and buckets of words.

A chunk is a bounded run of one task's documents. It holds its distinct words once, in order of frequency, and for
each document the positions as indices into them. Its words go out in one compressed blob per hash bucket, so that a bucket sees
every word of the corpus that falls into it, and answers return to the chunk in the same order. A word so crosses
the network once per chunk instead of once per occurrence.
"""

from __future__ import annotations

import ctypes
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A chunk is closed after the document that brings it to so many positions.
CHUNK_POSITIONS = 1 << 23
#: The row with a chunk's positions sorts after the rows of its buckets.
LAST = (1 << 31) - 1

CHUNK_SCHEMA = "chunk long, bucket int, words binary, extra binary, positions binary, buckets binary, ids array<long>, lens array<long>, flags array<boolean>"
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("extra", pa.binary()), ("positions", pa.binary()), ("buckets", pa.binary()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_()))])


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch in this session, unless it is bounded closer: rows here are blobs or whole texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if found > size:
        spark.conf.set(key, f"{size}b")


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task doesn't hold what its last one took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def squeeze(raw: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    a = np.ascontiguousarray(a, dtype="<u8")
    width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    return struct.pack("<QB", len(a), width) + squeeze(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack(raw: bytes, dtype=np.uint64) -> np.ndarray:
    n, width = struct.unpack_from("<QB", raw)
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(expand(raw[9:]), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(dtype)


def pack_ranks(a: np.ndarray) -> bytes:
    """Indices of words in order of frequency: a byte for each of the first 192, else the upper part in a byte and two more."""
    if len(a) and int(a.max()) >= 192 + (64 << 16):
        return b"\0" + pack(a)
    far, lead = a >= 192, a.astype(np.uint8)
    rest = a[far] - 192
    lead[far] = (192 + (rest >> 16)).astype(np.uint8)
    parts = [squeeze(x) for x in (lead, (rest >> 8).astype(np.uint8), rest.astype(np.uint8))]
    return b"\1" + struct.pack("<II", len(parts[0]), len(parts[1])) + b"".join(parts)


def unpack_ranks(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\0":
        return unpack(raw[1:], np.uint32)
    m, n = struct.unpack_from("<II", raw, 1)
    lead, upper, lower = (np.frombuffer(expand(x), np.uint8).astype(np.uint32) for x in (raw[9 : 9 + m], raw[9 + m : 9 + m + n], raw[9 + m + n :]))
    far = lead >= 192
    lead[far] = 192 + ((lead[far] - 192) << 16) + (upper << 8) + lower
    return lead


def pack_words(words: list[bytes]) -> bytes:
    lens = pack(np.fromiter(map(len, words), np.uint64, len(words)))
    return struct.pack("<I", len(lens)) + lens + squeeze(b"".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    (k,) = struct.unpack_from("<I", raw)
    ends = np.cumsum(unpack(raw[4 : 4 + k])).tolist()
    text = expand(raw[4 + k :])
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def chunker(tokens_of: Callable[[], Callable[[str], list]], buckets: int, counted: bool, size: int = CHUNK_POSITIONS) -> Callable:
    """For mapInArrow over (id long, text string[, flag boolean]): the rows of CHUNK_SCHEMA.

    tokens_of() makes, once per task, the function from a text to its list of tokens (str or bytes).
    counted: extra holds, for each word, its occurrences in flagged documents. size: positions that close a chunk.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, task, seq = tokens_of(), TaskContext.get().partitionId(), 0
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        docs, held = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            ids, lens, flags = ([f(d) for d in docs] for f in (lambda d: d[0], lambda d: len(d[1]), lambda d: d[2]))
            flat = np.concatenate([d[1] for d in docs])
            docs.clear()
            # In slices: numpy widens indices to 8 bytes.
            slices = [slice(a, a + (1 << 19)) for a in range(0, len(flat), 1 << 19)]
            total = np.zeros(len(index), np.int64)
            for s in slices:
                total += np.bincount(flat[s], minlength=len(index))
            by_count = np.argsort(-total, kind="stable")
            rank = np.empty(len(by_count), np.uint32)
            rank[by_count] = np.arange(len(by_count))
            for s in slices:
                flat[s] = rank[flat[s]]
            words = [w if isinstance(w, bytes) else w.encode() for w in index]
            words = [words[i] for i in by_count.tolist()]
            index.clear()
            bucket_of = np.fromiter((h % buckets for h in map(xxhash.xxh3_64_intdigest, words)), np.int64, len(words))
            order, chunk = np.argsort(bucket_of, kind="stable"), (task << 24) + seq
            bucket = bucket_of[order]
            count = None
            if counted:
                flagged, count = np.repeat(np.array(flags, bool), lens), np.zeros(len(words), np.int64)
                for s in slices:
                    count += np.bincount(flat[s][flagged[s]], minlength=len(words))
                count = count[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(words)]):
                rows.append({"chunk": chunk, "bucket": int(bucket[a]), "words": pack_words([words[i] for i in order[a:b].tolist()]), "extra": pack(count[a:b]) if counted else None})
            rows.append({"chunk": chunk, "bucket": LAST, "positions": pack_ranks(flat), "buckets": pack(bucket_of), "ids": ids, "lens": lens, "flags": flags})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist() if batch.num_columns > 2 else [False] * batch.num_rows
            for i, text, flag in zip(ids, batch.column(1), flags):
                found = tokens(text.as_py())
                docs.append((i, np.fromiter(map(index.__getitem__, found), np.uint32, len(found)), flag))
                held += len(found) + 1
                if held >= size:
                    yield from close()
                    give_back()
                    seq, held = seq + 1, 0
        if docs:
            yield from close()
        give_back()

    return run


def by_chunk(*tables: DataFrame) -> DataFrame:
    """Rows of all tables (columns chunk, bucket, …; missing ones null) chunk by chunk, each chunk's in order of bucket."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.repartition("chunk").sortWithinPartitions("chunk", "bucket")


def positions_of(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("bucket") == LAST).select("chunk", "bucket", "positions", "buckets", "ids", "lens", "flags")


def words_of(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.where(F.col("bucket") < LAST).select("chunk", "bucket", "words", *more).repartition("bucket")


def runs(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive runs."""
    ends = np.cumsum(lens, dtype=np.int64)
    return ends - lens.astype(np.int64), ends


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[start : start + len] of every pair, one after another."""
    lens = lens.astype(np.int64)
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(int(lens.sum()))]
