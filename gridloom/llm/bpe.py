"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Documents are cut into pre-tokens, whose positions stay in their chunk as indices of the chunk's distinct words.
The distinct words of all chunks meet by hash bucket, where each is encoded once; ids return to the chunks and are
put together by position. Decoding joins the table of the tokens' bytes, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import partitions, written
from gridloom.llm.packed import CHUNK_POSITIONS, CHUNK_SCHEMA, LAST, bounded_batches, by_chunk, chunker, gather, give_back, pack, positions_of, runs, unpack, unpack_ranks, unpack_words, words_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ranges(chars: set[int]) -> str:
    out, codes = [], sorted(chars)
    start = last = codes[0]
    for c in [*codes[1:], None]:
        if c is None or c != last + 1:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = c
        last = c
    return "".join(out)


@functools.lru_cache(maxsize=4)
def classed(pattern: str) -> tuple[str, str, str]:
    """(pattern, a class of characters, a pattern for texts with any of these) for the classes of letters, numbers and spaces that tiktoken has.

    Both libraries carry a Unicode version of their own. Texts with a character that they class differently are
    split by a pattern with tiktoken's classes spelled out; tiktoken itself tells them, as it skips what doesn't match.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    single = {bytes([b]): b for b in range(256)}
    classes, odd = {}, set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = set(map(ord, bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()))
        odd |= theirs ^ set(map(ord, regex.findall(name, every)))
        classes[name] = _ranges(theirs)
    letters, numbers, spaces = classes[r"\p{L}"], classes[r"\p{N}"], classes[r"\s"]
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
    return pattern, f"[{_ranges(odd)}]" if odd else "", spelled


def splitter(pattern: str, odd: str, spelled: str):
    """A function from a text to its pre-tokens; arguments from classed(), which is for the driver."""
    import regex

    usual, has_odd, slow = regex.compile(pattern).findall, regex.compile(odd).search if odd else None, []

    def split(text: str) -> list[str]:
        if has_odd is None or text.isascii() or not has_odd(text):
            return usual(text)
        if not slow:
            slow.append(regex.compile(spelled).findall)
        return slow[0](text)

    return split


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("bpe", pat_str=r"\s", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' bytes one after another, and each id's start and length."""
    lens = np.zeros(max(ranks.values()) + 1, np.int64)
    parts = [b""] * len(lens)
    for token, i in ranks.items():
        lens[i], parts[i] = len(token), token
    return np.frombuffer(b"".join(parts), np.uint8), runs(lens)[0], lens


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = True, chunk: int = CHUNK_POSITIONS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if with_ids.

    ids: those of tiktoken's encode_ordinary for the rank file and pattern. ids_sha256: lowercase hex digest of
    the ids as little-endian unsigned 32-bit integers; decoded_sha256: of the bytes decoded from the ids. A null
    or empty text has no tokens. Rows that repeat an id, and null ids, have rows of their own. Other columns of
    docs are not used, whatever their names. A very long text is one chunk by itself, of any number of pre-tokens that a task holds.
    Of equal ranks there are none in a vocabulary. An empty table gives an empty result. chunk: pre-tokens that close a chunk;
    smaller chunks take less memory and more disk.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 1 << 20)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    patterns = classed(pattern)
    # The vocabulary is of a fixed size (about 1 MB).
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary or vocabulary_path()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = written(rows.mapInArrow(chunker(lambda: splitter(*patterns), partitions(spark), counted=False, size=chunk), CHUNK_SCHEMA), "pretokens")
    reply_schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("lens", pa.binary()), ("tokens", pa.binary())])

    def encode_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, known = _encoder(shared.value), {}
        for batch in batches:
            for chunk, bucket, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = unpack_words(words.as_py())
                for w in words:
                    if w not in known:
                        known[w] = np.array(piece(w), np.uint32)
                found = [known[w] for w in words]
                lens = pack(np.fromiter(map(len, found), np.uint64, len(found)))
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bucket": bucket, "lens": lens, "tokens": pack(np.concatenate(found))}], schema=reply_schema)

    replies = words_of(chunks).mapInArrow(encode_words, "chunk long, bucket int, lens binary, tokens binary").withColumnRenamed("lens", "token_lens")
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, token_start, token_len = token_table(shared.value)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in map(batch.slice, range(batch.num_rows), [1] * batch.num_rows):
                row = row.to_pylist()[0]
                if row["bucket"] < LAST:
                    parts.append((unpack(row["token_lens"], np.uint32), unpack(row["tokens"], np.uint32)))
                    continue
                perm = np.argsort(unpack(row["buckets"]), kind="stable")
                flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
                sorted_lens = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
                parts = []
                starts, lens = np.empty(len(perm), np.int64), np.empty(len(perm), np.int64)
                starts[perm], lens[perm] = runs(sorted_lens)[0], sorted_lens
                at = unpack_ranks(row["positions"])
                out, a, held = [], 0, 0
                for doc, n in zip(row["ids"], row["lens"]):
                    here, a = at[a : a + n], a + n
                    ids = gather(flat, starts[here], lens[here])
                    text = gather(table, token_start[ids], token_len[ids])
                    out.append({"doc_id": doc, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(text.tobytes()).hexdigest()} | ({"ids": ids.astype(np.int32)} if with_ids else {}))
                    held += len(ids)
                    if held > 1 << 20 or len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=out_schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=out_schema)
                del at, flat, sorted_lens, starts, lens, out, row
                give_back()

    return by_chunk(replies, positions_of(chunks).drop("flags")).select("chunk", "bucket", "token_lens", "tokens", "positions", "buckets", "ids", "lens").mapInArrow(
        assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    )


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add the column decoded (string; bytes that are no UTF-8 become U+FFFD) to rows with an array of ids; null ids decode to null.

    An id that isn't in the vocabulary fails. The column decoded is replaced if there is one.
    """
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary or vocabulary_path()))

    rows = encoded.drop("decoded")
    at = rows.columns.index(ids_col)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in shared.value.items()}
        for batch in batches:
            found = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(joined, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


ORACLE: dict[str, str] = {}
