"""Language-model scoring by a Katz back-off model over words, of order 2 (pairs) or 3 (triples).

Counts r up to K are discounted by Good-Turing, and what that frees goes to the next lower level: after a word v,
    P(w|v) = d(c(vw)) c(vw) / c(v)   if the pair was seen,   else   alpha(v) P(w),
    alpha(v) = (1 - sum over seen w of P(w|v)) / (1 - sum over seen w of P(w)),
so that the probabilities after every v sum to 1 over the vocabulary and one class for all unseen words. The same
discounts give P(w), whose freed mass is the probability of that class. Where the counts of counts don't allow
Good-Turing discounts up to K, a smaller K is taken, and without any the absolute discount n1 / (n1 + 2 n2). A level
on which nothing is discounted counts one more unseen event, so that some mass is always left. The first word of
a text follows the end token. An unseen history backs off with alpha 1.

With order 3, after words u and v with a seen pair uv,
    P(w|uv) = d3(c(uvw)) c(uvw) / c(uv)   if the triple was seen,   else   alpha(uv) P(w|v),
with discounts of its own and alpha(uv) made like alpha(v) from P(w|v). An unseen pair leaves P(w|v). The first word of
a text has the end token alone before it, and so P(w|v).

Word, pair and triple counts are gathered for all training documents in tables by hash bucket (see packed.py); a chunk
asks only for its distinct words, then for its distinct pairs, then for its distinct triples. A seen triple's P(w|v) is
a discounted c(vw) over what c(v) is divided by, so that a bucket of triples needs c(vw) only. Histories with so many pairs
that a bucket would be hot are spread over several buckets, and their sums are added up; there are at most 4 x buckets of these.
Requests name words by codes that are the lower the more frequent a word is, in ascending order, as differences. A reply
leaves out what the chunk knows: most histories were seen once, and tell no more than the count of their one event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop_shuffles, partitions, release, written
from gridloom.llm.packed import CHUNK_SCHEMA, LAST, bounded_batches, by_chunk, chunker, give_back, pack, positions_of, runs, unpack, unpack_ranks, unpack_words, words_of

K = 5
#: A word's id holds its count in the upper bits, so that an id tells P(w); larger counts are kept apart. Below come the word's
#: place among the words of its bucket whose counts are of one class, and the bucket.
COUNT_BITS = 26
TIE_BITS = 64 - COUNT_BITS
FULL = (1 << COUNT_BITS) - 1
END = b""
#: Positions that close a chunk: sorting its pairs takes about 200 bytes for each.
CHUNK = 3 << 19


def tokens_of():
    """Lower-case A-Z, split at space and tab to carriage return, add the end token."""
    def split(text: str) -> list[bytes]:
        words = text.encode().lower().split()
        words.append(END)
        return words

    return split


def discounts(n: list[int]) -> np.ndarray:
    """Factors d[0..K] for counts of counts n[1..K+1] (n[0] is unused); d[0] is 0."""
    for k in range(K, 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            a = (k + 1) * n[k + 1] / n[1]
            if a < 1:
                d = [((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a) for r in range(1, k + 1)]
                if all(0 < x <= 1 for x in d) and d[0] < 1:
                    return np.array([0.0, *d, *[1.0] * (K - k)])
    off = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    off = min(off, 0.9)
    return np.array([0.0, *[(r - off) / r for r in range(1, K + 1)]])


def cut_sum(sums: np.ndarray, low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sums of discounted counts, given the sums of the counts and how many of these are 1 to K."""
    return sums - low @ ((1 - d[1:]) * np.arange(1, K + 1))


class Unigrams:
    """P(w) by count: a discounted share of all training tokens; the rest is that of an unseen word."""

    def __init__(self, tokens: int, n: list[int]):
        self.d, self.tokens = discounts(n), tokens
        freed = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))
        self.total = tokens if freed > 0 else tokens + 1
        self.unseen = freed / self.total if freed > 0 else 1 / self.total

    def share(self, sums: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Sums of P(w), given sums of counts as for cut_sum."""
        return cut_sum(sums, low, self.d) / self.total

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, K)] * (count <= K) * count + (count > K) * count, self.unseen * self.total) / self.total


def counts_of(ids: np.ndarray, full: dict[int, int]) -> np.ndarray:
    """The counts that ids tell; full: those of the ids whose count doesn't fit."""
    count = (ids >> np.uint64(TIE_BITS)).astype(np.int64)
    for i in np.flatnonzero(count == FULL) if full else ():
        count[i] = full[int(ids[i])]
    return count


def class_of(count: np.ndarray) -> np.ndarray:
    """Classes of like counts, the greater the more frequent: one for each count up to 16, then 8 for each doubling."""
    extra = np.maximum(np.frexp(count.astype(float))[1] - 4, 0)
    return 8 * extra + (count >> extra)


CLASSES = int(class_of(np.array([FULL]))[0]) + 1


def first_codes(ties: dict[int, int], buckets: int) -> np.ndarray:
    """The first code of each class; ties: the most words of a class in one bucket. Frequent words have low codes, 0 is no word."""
    size = np.array([ties.get(c, 0) * buckets for c in range(CLASSES)], np.int64)
    return (1 + np.cumsum(size[::-1]) - size[::-1])[::-1]


class Local:
    """A chunk's known words in order of their codes, with index 0 for all unseen words; at: the index of each position."""

    def __init__(self, ids: np.ndarray, bucket_of: np.ndarray, at: np.ndarray, first: np.ndarray, full: dict[int, int]):
        count = (ids >> np.uint64(TIE_BITS)).astype(np.int64)
        code = np.where(count > 0, first[class_of(count)] + (ids & np.uint64((1 << TIE_BITS) - 1)).astype(np.int64), 0)
        order = np.argsort(code, kind="stable")
        order = order[np.searchsorted(code[order], 1) :]
        index = np.zeros(len(ids), np.int32)
        index[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        self.at, self.code, self.ids = index[at], np.append(0, code[order]), np.append(np.uint64(0), ids[order])
        self.bucket = np.append(0, bucket_of[order].astype(np.int64))
        self.count = np.append(0, counts_of(self.ids[1:], full))
        self.mixed = ((self.code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def spread_of(count: np.ndarray, buckets: int, tokens: int) -> np.ndarray:
    """Over how many buckets the words after a history are spread; over more than one if it is hot."""
    return np.maximum(1, np.ceil(count * 4 * buckets / max(tokens, 1))).astype(np.int64)


class Pairs:
    """A chunk's distinct pairs with a known history v, by bucket, code of v and code of w.

    half is twice the bucket plus a bit of v's hash: the bucket of the triples that go on from a pair follows it.
    place: each position's pair (-1: unknown history). edges: where a history begins in its bucket.
    """

    def __init__(self, words: Local, lens: list[int], buckets: int, tokens: int):
        w, n = words.at, np.int64(len(words))
        v = np.empty(len(w), np.int64)
        v[:1], v[1:] = w[lens[0] - 1], w[:-1]
        known = v > 0
        v, w = v[known], w[known]
        spread, bucket = spread_of(words.count, buckets, tokens), words.bucket[v]
        hot = np.flatnonzero(spread[v] > 1)
        bucket[hot] = (bucket[hot] + words.mixed[w[hot]] % spread[v[hot]]) % buckets
        bucket <<= 1
        bucket += words.mixed[v] >> 7 & 1
        bucket *= n
        bucket += v
        bucket *= n
        bucket += w
        del v, w
        key, inverse = np.unique(bucket, return_inverse=True)
        self.place = np.full(len(known), -1, np.int32)
        self.place[known] = inverse
        group, self.w = np.divmod(key, n)
        self.half, self.v = np.divmod(group, n)
        self.edges = np.diff(group, prepend=-1) != 0

    def __len__(self) -> int:
        return len(self.w)


class Triples:
    """A chunk's distinct triples whose first two words are a seen pair, by bucket, place of that pair and code of the last word.

    c: the counts of the pairs. A last word that was never seen after the second is taken for an unseen word, as such a
    triple's count is 0. lower: the count of the last two words. place, edges: as for pairs.
    """

    def __init__(self, words: Local, pairs: Pairs, c: np.ndarray, lens: list[int], buckets: int, tokens: int):
        n = len(pairs.place)
        history = np.empty(n, np.int64)
        history[:1], history[1:] = -1, pairs.place[:-1]
        history[runs(np.array(lens))[0]] = -1
        known = history >= 0
        known[known] = c[history[known]] > 0
        history = history[known]
        lower = c[pairs.place[known]]
        w = np.where(lower > 0, words.at[known], 0)
        spread, bucket = spread_of(c, buckets, tokens), pairs.half[history]
        hot = np.flatnonzero(spread[history] > 1)
        bucket[hot] = (bucket[hot] + words.mixed[w[hot]] % spread[history[hot]]) % buckets
        bucket *= np.int64(len(pairs))
        bucket += history
        bucket *= np.int64(len(words))
        bucket += w
        del w, history
        key, inverse = np.unique(bucket, return_inverse=True)
        del bucket
        self.place = np.full(n, -1, np.int32)
        self.place[known] = inverse
        self.lower = np.zeros(len(key), np.int64)
        self.lower[inverse] = lower
        group, self.w = np.divmod(key, np.int64(len(words)))
        self.bucket, self.history = np.divmod(group, np.int64(max(1, len(pairs))))
        self.edges = np.diff(group, prepend=-1) != 0

    def __len__(self) -> int:
        return len(self.w)


def trained(place: np.ndarray, row: dict, n: int) -> np.ndarray:
    """How often each of n events occurs in the chunk's training documents."""
    return np.bincount(place[np.repeat(np.array(row["flags"], bool), row["lens"]) & (place >= 0)], minlength=n)


def cuts_of(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of every bucket of a sorted array."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), a, b


def steps(a: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of numbers that ascend within the runs that begin where new is true; a run's first number stays."""
    return np.where(new, a, a - np.append(0, a[:-1]))


def unstep(a: np.ndarray, new: np.ndarray) -> np.ndarray:
    total, at = np.cumsum(a), np.flatnonzero(new)
    return total - np.repeat((total - a)[at], np.diff(np.append(at, len(a))))


def zigzag(a: np.ndarray) -> np.ndarray:
    d = np.diff(a, prepend=0)
    return np.where(d < 0, -2 * d - 1, 2 * d)


def unzigzag(a: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(a & 1, -(a + 1) // 2, a // 2))


def joint(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, Callable]:
    """One number for each pair of non-negative numbers, and the function back to the pairs."""
    names = None
    if len(a) and (int(a.max()) + 1) * (int(b.max()) + 1) >= 1 << 63:
        (name_a, a), (name_b, b) = (np.unique(x, return_inverse=True) for x in (a, b))
        names = name_a, name_b
    by = np.int64(int(b.max()) + 1 if len(b) else 1)
    return a * by + b, lambda k: (names[0][k // by], names[1][k % by]) if names else (k // by, k % by)


def cut(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(c > K, c, d[np.minimum(c, K)] * c)


class _Chunk:
    """Gathers a chunk's rows in order of bucket, up to the row with its positions."""

    def __init__(self):
        self.words: list[tuple[int, np.ndarray]] = []
        self.pairs: list[dict] = []
        self.triples: list[dict] = []

    def take(self, row: dict):
        """Null, or with a chunk's last row its words' ids and buckets, and its positions."""
        if row["bucket"] < LAST:
            if row.get("word_ids") is not None:
                self.words.append((row["bucket"], unpack(row["word_ids"])))
            else:
                (self.triples if row.get("level") == 3 else self.pairs).append(row)
            return None
        bucket = unpack(row["buckets"], np.int64)
        ids = np.empty(len(bucket), np.uint64)
        ids[np.argsort(bucket, kind="stable")] = np.concatenate([w for _, w in self.words])
        return ids, bucket, unpack_ranks(row["positions"])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_WORD_REPLY = "chunk long, bucket int, word_ids binary, tokens long, types long, n array<long>, ties array<long>, full_ids array<long>, full_counts array<long>"
_PAIR_REQUEST = "chunk long, bucket int, v binary, hot binary, run binary, w binary, k binary"
_REPLY = "chunk long, bucket int, counts binary, sums binary, low binary, seen binary, n array<long>, hot_v array<long>, hot_seen array<long>"
_TRIPLE_REQUEST = "chunk long, bucket int, u binary, v binary, hot binary, run binary, w binary, lower binary, k binary"
_TRIPLE_REPLY = _REPLY + ", hot_u array<long>"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _count_words(buckets: int):
    """One bucket's words of all chunks -> each chunk's word ids, in the order asked, and one row of sums with chunk -1."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, total, asked = rows[0]["bucket"], {}, []
        for r in rows:
            words = unpack_words(r["words"])
            asked.append(words)
            for w, c in zip(words, unpack(r["extra"]).tolist()):
                total[w] = total.get(w, 0) + c
        ranked = sorted(((c, w) for w, c in total.items() if c))
        exact = np.fromiter((c for c, _ in ranked), np.int64, len(ranked))
        count = np.minimum(exact, FULL)
        kind = class_of(count)
        tie = np.arange(len(kind)) - np.searchsorted(kind, kind)
        made = (count << TIE_BITS | tie * buckets + bucket).view(np.uint64) if len(kind) else np.zeros(0, np.uint64)
        ids = {w: i for (_, w), i in zip(ranked, made.tolist())}
        much = np.flatnonzero(count == FULL)
        n = np.bincount(np.minimum(exact, K + 2), minlength=K + 3).tolist()
        out = [{"chunk": r["chunk"], "bucket": bucket, "word_ids": pack(np.fromiter((ids.get(w, 0) for w in words), np.uint64, len(words)))} for r, words in zip(rows, asked)]
        out.append({"chunk": -1, "bucket": bucket, "tokens": int(exact.sum()), "types": len(ids), "n": n[: K + 2], "ties": np.bincount(kind, minlength=CLASSES).tolist(), "full_ids": made[much].view(np.int64).tolist(), "full_counts": exact[much].tolist()})
        return pa.Table.from_pylist(out, schema=_arrow(_WORD_REPLY))

    return run


class Model:
    """What every chunk and bucket has to know: buckets of pairs and (many) of triples, training tokens, types, P(w), and codes."""

    def __init__(self, buckets: int, tokens: int, types: int, n: list[int], first: np.ndarray, full: dict[int, int]):
        self.buckets, self.many, self.tokens, self.types, self.first, self.full = buckets, 2 * buckets, tokens, types, first, full
        self.unigrams = Unigrams(tokens, n)
        self.d2 = self.d3 = None
        self.hot2: dict = {}
        self.hot3: dict = {}

    def words(self, ids: np.ndarray, bucket_of: np.ndarray, at: np.ndarray) -> Local:
        return Local(ids, bucket_of, at, self.first, self.full)


def _ask_pairs(m: Model):
    schema = _arrow(_PAIR_REQUEST)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for row in _rows(batches):
            got = chunk.take(row)
            if got is None:
                continue
            chunk = _Chunk()
            words = m.words(*got)
            del got
            p = Pairs(words, row["lens"], m.buckets, m.tokens)
            k, hot = trained(p.place, row, len(p)), spread_of(words.count, m.buckets, m.tokens) > 1
            for bucket, a, b in cuts_of(p.half >> 1):
                first = np.flatnonzero(p.edges[a:b])
                v = p.v[a:b][first]
                yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "bucket": bucket, "v": pack(zigzag(words.code[v])), "hot": pack(hot[v]), "run": pack(np.diff(np.append(first, b - a))), "w": pack(words.ids[p.w[a:b]]), "k": pack(k[a:b])}], schema=schema)
            del words, p, k
            give_back()

    return run


def _seen(history: np.ndarray, total: np.ndarray, m: int) -> np.ndarray:
    """Of each of m histories, the numbers of events that were seen 1 to K times."""
    few = (total > 0) & (total <= K)
    return np.bincount(history[few] * K + total[few] - 1, minlength=m * K).reshape(m, K)


class _Bucket:
    """The distinct events of one bucket: counts, and of each history the sum of the lower level's counts of the words seen after
    it, how many of these words were seen 1 to K times there, and how many were seen 1 to K times after the history.

    asked: of the events asked for, their places; history, lower: of each event; own: the histories asked for, hot: of each history.
    """

    def __init__(self, asked: np.ndarray, k: np.ndarray, history: np.ndarray, lower: np.ndarray, own: np.ndarray, hot: np.ndarray):
        m, self.asked, self.own, self.hot = len(hot), asked, own, hot
        self.total = total = np.bincount(asked, weights=k.astype(float), minlength=len(history)).astype(np.int64)
        seen = total > 0
        self.sums = np.bincount(history[seen], weights=lower[seen].astype(float), minlength=m).astype(np.int64)
        self.low, self.n = _seen(history[seen], lower[seen], m), _seen(history, total, m)
        self.single = (np.bincount(history, weights=total.astype(float), minlength=m) == 1) & ~hot

    def answers(self, rows: list[dict], bucket: int, lengths: list[np.ndarray]) -> list[dict]:
        """Each chunk's answers; lengths: how many events it asked for after each of its histories.

        A history seen once tells nothing but the lower count of its one word, and not even that where the chunk has that event.
        """
        out, a, h = [], 0, 0
        for r, length in zip(rows, lengths):
            counts, mine = self.total[self.asked[a : a + int(length.sum())]], self.own[h : h + len(length)]
            a, h = a + len(counts), h + len(length)
            single, at = self.single[mine], runs(length)[0]
            has = np.maximum.reduceat(counts, at) > 0
            most = mine[~single]
            out.append({"chunk": r["chunk"], "bucket": bucket, "counts": pack(counts), "sums": pack(self.sums[mine[~(single & has)]]), "low": pack(self.low[most].T.reshape(-1)), "seen": pack(self.n[most].T.reshape(-1))})
        return out

    def statistics(self, bucket: int, **names: np.ndarray) -> dict:
        n = np.bincount(np.minimum(self.total, K + 2), minlength=K + 3)[: K + 2].tolist()
        hot = self.hot
        return {"chunk": -1, "bucket": bucket, "n": n, "hot_seen": np.concatenate([self.n[hot], self.low[hot], self.sums[hot][:, None]], axis=1).reshape(-1).tolist(), **{k: x[hot].tolist() for k, x in names.items()}}


def histories_of(replies: list[dict], heads: np.ndarray, hot: np.ndarray, edges: np.ndarray, c: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one level's replies in order of bucket, what _Bucket.answers left out put in again: of each history the sum of lower counts,
    how many of these and how many of its events are 1 to K.

    heads, hot: of each history, its count and whether it is spread; edges, c, lower: of each event, whether a history begins, its count, and
    the count of it that the lower level has.
    """
    m, starts = len(heads), np.flatnonzero(edges)
    single = (heads == 1) & ~hot
    has = np.maximum.reduceat(c, starts) > 0 if m else np.zeros(0, bool)
    sums, low, seen = np.zeros(m, np.int64), np.zeros((m, K), np.int64), np.zeros((m, K), np.int64)
    local = single & has
    sums[local] = np.maximum.reduceat(np.where(c > 0, lower, 0), starts)[local] if m else 0
    told = lambda name: np.concatenate([unpack(r[name], np.int64) for r in replies]) if replies else np.zeros(0, np.int64)
    sums[~local] = told("sums")
    for name, out in (("low", low), ("seen", seen)):
        if replies:
            out[~single] = np.concatenate([unpack(r[name], np.int64).reshape(K, -1).T for r in replies])
    at = np.flatnonzero(single)
    seen[at, 0] = 1
    few = at[sums[at] <= K]
    low[few, sums[few] - 1] = 1
    return sums, low, seen


def _count_pairs(m: Model):
    """One bucket's pairs of all chunks -> each chunk's pair counts in the order asked, and what it needs of each of its histories;
    rows with chunk -1: counts of counts, hot histories."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        vs, own = np.unique(np.concatenate([unzigzag(unpack(r.pop("v"), np.int64)) for r in rows]), return_inverse=True)
        hot = np.zeros(len(vs), bool)
        hot[own] = np.concatenate([unpack(r.pop("hot"), np.int64) for r in rows]) > 0
        lengths = [unpack(r.pop("run"), np.int64) for r in rows]
        ws, w = np.unique(np.concatenate([unpack(r.pop("w")) for r in rows]), return_inverse=True)
        w += np.repeat(own, np.concatenate(lengths)) * len(ws)
        found, asked = np.unique(w, return_inverse=True)
        del w
        history, last = np.divmod(found, max(len(ws), 1))
        del found
        found = _Bucket(asked, np.concatenate([unpack(r.pop("k"), np.int64) for r in rows]), history, counts_of(ws, m.full)[last], own, hot)
        del history, last
        return pa.Table.from_pylist([*found.answers(rows, bucket, lengths), found.statistics(bucket, hot_v=vs)], schema=_arrow(_REPLY))

    return run


def backoff(count_v: np.ndarray, n: np.ndarray, sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, alpha) of histories: what seen counts are divided by, and the weight of the lower level."""
    freed = n @ ((1 - d[1:]) * np.arange(1, K + 1))
    total = np.where(freed > 0, count_v, count_v + 1)
    return total, np.where(freed > 0, freed, 1) / total / np.maximum(1 - sums, 1e-300)


def _counts(replies: list[dict]) -> np.ndarray:
    return np.concatenate([unpack(r["counts"], np.int64) for r in replies]) if replies else np.zeros(0, np.int64)


def _ask_triples(m: Model):
    schema = _arrow(_TRIPLE_REQUEST)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for row in _rows(batches):
            got = chunk.take(row)
            if got is None:
                continue
            c, chunk = _counts(chunk.pairs), _Chunk()
            words = m.words(*got)
            del got
            p = Pairs(words, row["lens"], m.buckets, m.tokens)
            t = Triples(words, p, c, row["lens"], m.many, m.tokens)
            k, hot, code = trained(t.place, row, len(t)), spread_of(c, m.many, m.tokens) > 1, words.code
            t.place = p.place = p.half = p.edges = None
            for bucket, a, b in cuts_of(t.bucket):
                first = np.flatnonzero(t.edges[a:b])
                h = t.history[a:b][first]
                u, v = code[p.v[h]], code[p.w[h]]
                yield pa.RecordBatch.from_pylist([{
                    "chunk": row["chunk"], "bucket": bucket, "u": pack(zigzag(u)), "v": pack(steps(v, np.diff(u, prepend=-1) != 0)), "hot": pack(hot[h]),
                    "run": pack(np.diff(np.append(first, b - a))), "w": pack(steps(code[t.w[a:b]], t.edges[a:b])), "lower": pack(t.lower[a:b]), "k": pack(k[a:b]),
                }], schema=schema)
            del words, p, t, c, k, hot
            give_back()

    return run


def _count_triples():
    """One bucket's triples of all chunks -> rows like those for pairs; the lower count of a triple uvw is c(vw)."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, us, vs, ws, lengths = rows[0]["bucket"], [], [], [], []
        for r in rows:
            u = unzigzag(unpack(r.pop("u"), np.int64))
            us.append(u)
            vs.append(unstep(unpack(r.pop("v"), np.int64), np.diff(u, prepend=-1) != 0))
            length = unpack(r.pop("run"), np.int64)
            w = unpack(r.pop("w"), np.int64)
            new = np.zeros(len(w), bool)
            new[runs(length)[0]] = True
            ws.append(unstep(w, new))
            lengths.append(length)
        keys, apart = joint(np.concatenate(us), np.concatenate(vs))
        del us, vs
        keys, own = np.unique(keys, return_inverse=True)
        hot = np.zeros(len(keys), bool)
        hot[own] = np.concatenate([unpack(r.pop("hot"), np.int64) for r in rows]) > 0
        w, apart_w = joint(np.repeat(own, np.concatenate(lengths)), np.concatenate(ws))
        del ws
        found, asked = np.unique(w, return_inverse=True)
        del w
        history, lower = apart_w(found)[0], np.zeros(len(found), np.int64)
        del found
        lower[asked] = np.concatenate([unpack(r.pop("lower"), np.int64) for r in rows])
        found = _Bucket(asked, np.concatenate([unpack(r.pop("k"), np.int64) for r in rows]), history, lower, own, hot)
        del history, lower
        hot_u, hot_v = apart(keys)
        return pa.Table.from_pylist([*found.answers(rows, bucket, lengths), found.statistics(bucket, hot_u=hot_u, hot_v=hot_v)], schema=_arrow(_TRIPLE_REPLY))

    return run


def _score(m: Model, order: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for row in _rows(batches):
            got = chunk.take(row)
            if got is None:
                continue
            asked2, asked3, chunk = chunk.pairs, chunk.triples, _Chunk()
            words = m.words(*got)
            del got
            pairs = Pairs(words, row["lens"], m.buckets, m.tokens)
            c = _counts(asked2)
            v, spread = pairs.v[pairs.edges], spread_of(words.count, m.buckets, m.tokens) > 1
            sums, low, seen = histories_of(asked2, words.count[v], spread[v], pairs.edges, c, words.count[pairs.w])
            del asked2
            for i in np.flatnonzero(spread[v]):  # a hot history takes the sums over all its buckets
                sums[i], low[i], seen[i] = m.hot2[int(words.code[v[i]])]
            total, alpha = backoff(words.count[v].astype(float), seen, m.unigrams.share(sums, low), m.d2)
            of_word = np.zeros(len(words))
            of_word[v] = total
            p = m.unigrams(words.count)[words.at]
            at = np.flatnonzero(pairs.place >= 0)
            j = pairs.place[at]
            g, cj = (np.cumsum(pairs.edges) - 1)[j], c[j]
            p[at] = np.where(cj > 0, cut(cj, m.d2) / total[g], alpha[g] * p[at])
            del at, j, g, cj, sums, low, seen, total, alpha
            if order == 3:
                t = Triples(words, pairs, c, row["lens"], m.many, m.tokens)
                h = t.history[t.edges]
                u, v, heads, spread = pairs.v[h], pairs.w[h], c[h], (spread_of(c, m.many, m.tokens) > 1)[h]
                del pairs, h
                c = _counts(asked3)
                sums, low, seen = histories_of(asked3, heads, spread, t.edges, c, t.lower)
                del asked3
                for i in np.flatnonzero(spread):
                    sums[i], low[i], seen[i] = m.hot3[int(words.code[u[i]]), int(words.code[v[i]])]
                total, alpha = backoff(heads.astype(float), seen, cut_sum(sums, low, m.d2) / of_word[v], m.d3)
                at = np.flatnonzero(t.place >= 0)
                j = t.place[at]
                g, cj = (np.cumsum(t.edges) - 1)[j], c[j]
                del t
                p[at] = np.where(cj > 0, cut(cj, m.d3) / total[g], alpha[g] * p[at])
                del at, j, g, cj, sums, low, seen, total, alpha
            start = runs(np.array(row["lens"]))[0]
            base = np.log10(words.count + 1.0)[words.at] - np.log10(m.tokens + m.types + 1.0)
            add = lambda x: np.add.reduceat(x, start)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array([not f for f in row["flags"]]), pa.array(row["lens"], pa.int64()), pa.array(add((words.at > 0).astype(np.int64))), pa.array([m.tokens] * len(start), pa.int64()), pa.array(add(base)), pa.array(add(np.log10(p)))], schema=schema)
            del words, p, base, c
            give_back()

    return run


def _statistics(table: DataFrame, *ids: str) -> tuple[list[int], dict]:
    """Counts of counts, and the sums of hot histories by code or codes: at most 4 x buckets of these."""
    stats = table.where("chunk = -1")
    n = [r[1] for r in stats.select(F.posexplode("n").alias("r", "n")).groupBy("r").agg(F.sum("n")).orderBy("r").collect()] or [0] * (K + 2)
    hot: dict = {}
    for r in stats.where("size(hot_v) > 0").select("hot_seen", *ids).orderBy("bucket").toLocalIterator():
        for x, *i in zip(np.array(r[0], np.int64).reshape(-1, 2 * K + 1), *r[1:]):
            i = i[0] if len(i) == 1 else tuple(i)
            hot[i] = hot.get(i, 0) + x
    hot = {i: (x[2 * K], x[K : 2 * K], x[:K]) for i, x in hot.items()}
    return n, hot


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", order: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out (not train), n_tokens, n_known, train_tokens, base_score, score.

    order: words of an event of the longest kind, 2 or 3. The model learns from the rows whose boolean train_col is true (null: false). A null text is empty: one end
    token; a very long one is one chunk by itself, scored whole. Rows that repeat an id, or a text, are texts of their own and each counts. Without training rows every token has
    probability 1 for the one unseen class. Other columns aren't used, whatever their names. An empty table
    gives an empty result.
    """
    if order not in (2, 3):
        raise ValueError(f"no model of order {order}")
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    chunks = written(rows.mapInArrow(chunker(tokens_of, buckets, counted=True, size=CHUNK), CHUNK_SCHEMA), "tokens")
    words = written(words_of(chunks, "extra").groupBy("bucket").applyInArrow(_count_words(buckets), _WORD_REPLY), "words")
    sums = words.where("chunk = -1")
    tokens, types = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n = [r[1] for r in sums.select(F.posexplode("n").alias("r", "n")).groupBy("r").agg(F.sum("n")).orderBy("r").collect()] or [0] * (K + 2)
    ties = {r[0]: r[1] for r in sums.select(F.posexplode("ties").alias("c", "n")).groupBy("c").agg(F.max("n")).collect()}
    # Words with 2^26 occurrences or more: tokens / 2^26 of them at most.
    full = {int(np.int64(r[0]).view(np.uint64)): r[1] for r in sums.select(F.explode(F.arrays_zip("full_ids", "full_counts")).alias("x")).select("x.*").collect()}
    m = Model(buckets, tokens, types, n, first_codes(ties, buckets), full)

    known = words.where("chunk >= 0").select("chunk", "bucket", "word_ids")
    lines = written(positions_of(chunks), "positions")  # the words themselves aren't needed any more
    release(chunks)
    asked = by_chunk(known, lines).mapInArrow(_ask_pairs(m), _PAIR_REQUEST)
    pairs = written(asked.repartition("bucket").groupBy("bucket").applyInArrow(_count_pairs(m), _REPLY), "pairs")
    del asked
    n2, m.hot2 = _statistics(pairs, "hot_v")
    drop_shuffles(spark)
    m.d2 = discounts(n2)
    replies = pairs.where("chunk >= 0").select("chunk", "bucket", "counts", "sums", "low", "seen")
    tables = [known, replies, lines]
    if order == 3:
        asked = by_chunk(known, replies.select("chunk", "bucket", "counts"), lines).mapInArrow(_ask_triples(m), _TRIPLE_REQUEST)
        threes = written(asked.repartition(m.many, "bucket").groupBy("bucket").applyInArrow(_count_triples(), _TRIPLE_REPLY), "triples")
        del asked
        n3, m.hot3 = _statistics(threes, "hot_u", "hot_v")
        drop_shuffles(spark)
        m.d3 = discounts(n3)
        tables.insert(2, threes.where("chunk >= 0").select("chunk", "bucket", "counts", "sums", "low", "seen", F.lit(3).alias("level")))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk(*tables).mapInArrow(_score(m, order, _arrow(out)), out)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return score(docs.withColumn("train", rest != 2), order=3)


ORACLE: dict[str, str] = {}
