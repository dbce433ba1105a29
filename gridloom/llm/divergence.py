"""Source divergence audit: how far the sources of a language differ, by an exact vocabulary automaton in two passes.

The first pass counts the documents of each term, exactly, and keeps the terms of each language that enough of its
documents have, numbered in order of language and bytes. The second counts occurrences by language and source: tasks list the different terms
of many documents and deal these lists to buckets by hash, where an Aho-Corasick automaton of the bucket's kept terms, each between two delimiters, runs
over them, so that from there on a term is its number. Automata are bounded by the number of buckets; documents are read once, however
large the vocabulary is. Counts above zero are the postings. Sums over all kept terms of a pair of sources start from
what the pair would have if no term occurred in either; counts of one source are added by the number of its terms with each
probability, and terms that occur in both by correcting these, so that only postings are ever visited.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, release, written
from gridloom.llm.packed import bounded_batches, give_back

MIN_DOCS, TOP, SCALE = 3, 200, 10**9
#: Code points of the terms of a bucket, twice as many at most (about 20 bytes of memory each), and of a term that goes into an automaton; longer ones are looked up.
AUTOMATON, LONGEST = 1 << 23, 256
#: Most buckets that a number of shuffle partitions asks for.
BUCKETS = 512
#: Counts of a task are merged when they have so many entries, or so many bytes of terms, and sent on if that leaves more than half.
ENTRIES, ENTRY_BYTES = 1 << 20, 1 << 25
#: Bytes of a text that are split at a time, sources in a block of pairs, and postings whose pairs are summed at a time.
PIECE, BLOCK, POSTINGS = 1 << 20, 256, 1 << 17

#: A byte -> itself if it belongs to a term (A-Z lower-cased, the others from 0x80 on), else a space.
DELIMITED = bytes((b | 32 if chr(b).isupper() else b) if b >= 0x80 or chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))


def delimited(text: bytes | None) -> Iterator[bytes]:
    """The terms of a text in UTF-8 between single delimiters or more, one before the first and one after the last, in pieces that part between terms."""
    raw = b" " + (text or b"").translate(DELIMITED) + b" "
    at = 0
    while at < len(raw) - 1:
        end = raw.find(b" ", min(at + PIECE, len(raw) - 1))
        yield raw[at : end + 1]
        at = end


def _once(text: bytes | None) -> bytes:
    """The terms of a text between delimiters, as one piece; those of a long one once each."""
    if len(text or b"") < PIECE:
        return b"".join(delimited(text))
    own: set[bytes] = set()
    for piece in delimited(text):
        own.update(piece.split())
    return b" " + b" ".join(own) + b" "


def _shares(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(number, piece) -> numbers and pieces of 4 PIECE bytes or so at a time."""
    numbers, pieces, held = [], [], 0
    for number, piece in rows:
        numbers.append(number)
        pieces.append(piece)
        held += len(piece)
        if held >= 4 * PIECE:
            yield np.array(numbers, np.int64), pieces
            numbers, pieces, held = [], [], 0
    if pieces:
        yield np.array(numbers, np.int64), pieces


def _coded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pieces between delimiters -> of each occurrence of a term its piece and its place in the list of different terms; that list."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    bounds = np.cumsum([0, *map(len, pieces)])
    return np.repeat(np.arange(len(pieces)), np.diff(np.searchsorted(starts, bounds))), terms.indices.to_numpy(), terms.dictionary


class _Counts:
    """Counts of terms by numbers of languages or sources: (number, place of the term, count) and the list of terms, share by share."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, number: np.ndarray, code: np.ndarray, names: pa.Array) -> None:
        """Occurrences, one by one."""
        key, n = np.unique(number * max(1, len(names)) + code, return_counts=True)
        self.held.append((*np.divmod(key, max(1, len(names))), n, names))

    def _many(self, share: int) -> bool:
        return sum(len(x[0]) for x in self.held) > ENTRIES // share or sum(x[3].nbytes for x in self.held) > ENTRY_BYTES // share

    def full(self) -> bool:
        if self._many(1):
            self.held = [self._merged()]
            return self._many(2)
        return False

    def _merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        terms = pa.concat_arrays([x[3] for x in self.held]).dictionary_encode()
        code, names = terms.indices.to_numpy(), terms.dictionary
        first = np.cumsum([0, *(len(x[3]) for x in self.held)])
        keys = np.concatenate([x[0] * max(1, len(names)) + code[first[k] + x[1]] for k, x in enumerate(self.held)])
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        key, n = keys[starts], np.add.reduceat(np.concatenate([x[2] for x in self.held])[order], starts) if len(starts) else np.zeros(0, np.int64)
        return (*np.divmod(key, max(1, len(names))), n, names)

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(numbers, places, counts, list of terms) in order of numbers and places, which are held no more; nothing if there are none."""
        if sum(len(x[0]) for x in self.held):
            yield self._merged()
        self.held.clear()


def _numbers() -> defaultdict:
    """Key -> its number, in order of first use."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (lang, text) -> (lang, term, n_docs, id), the terms that are in at least min_docs rows of a language, written; ids are in order of (lang, term).

    Tasks combine counts before the shuffle and send them on when a bounded table is full.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, numbers = _Counts(), _numbers()

        def dealt() -> Iterator[pa.RecordBatch]:
            langs = list(numbers)
            for lang, code, n, names in counts.taken():
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang)), names.take(pa.array(code)).cast(pa.string()), pa.array(n)], schema=schema)

        for batch in batches:
            langs, texts = (batch.column(k).to_pylist() for k in ("lang", "text"))
            for lang, pieces in _shares((numbers[k], _once(t)) for k, t in zip(langs, texts)):
                piece, code, names = _coded(pieces)
                each, _ = np.unique(piece * max(1, len(names)) + code, return_counts=True)  # with counts it sorts, which is faster than its hash table
                row, code = np.divmod(each, max(1, len(names)))
                counts.add(lang[row], code, names)
            if counts.full():
                yield from dealt()
        yield from dealt()
        give_back()

    bounded_batches(docs.sparkSession)
    seen = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, term string, n long")
    found = written(seen.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs), "terms")
    kept = written(found.orderBy("lang", "term").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    release(found)
    return kept


#: Rows that meet in a bucket: a language's kept terms (known) with their ids in n, or lists of terms, with each count's term and source by their places.
LISTED = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("lang", pa.string()), ("terms", pa.binary()), ("sources", pa.list_(pa.string())), ("term", pa.binary()), ("source", pa.binary()), ("n", pa.binary())])
LISTED_SQL = "bucket int, known boolean, lang string, terms binary, sources array<string>, term binary, source binary, n binary"


def _buckets_of(names: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each term, from its length, its first 24 bytes and its last 8."""
    bounds = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    data, starts, lens = np.frombuffer(names.buffers()[2] or b"", np.uint8), bounds[:-1], np.diff(bounds)
    found = lens.astype(np.uint64)
    for k in range(24):
        more = np.flatnonzero(lens > k)
        found[more] = found[more] * np.uint64(0x100000001B3) + data[starts[more] + k]
    longer = np.flatnonzero(lens > 24)
    for k in range(1, 9):
        found[longer] = found[longer] * np.uint64(0x100000001B3) + data[bounds[1:][longer] - k]
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((found >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _cuts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.diff(a, prepend=-1))


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values from each cut to the next as bytes."""
    bounds = (np.append(cuts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values))])


def _lines(names: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The terms from each cut to the next with a delimiter between two."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cuts, len(names)), pa.int32()), names), b" ")


def _listed(keys: list[tuple[str, str]], number: np.ndarray, code: np.ndarray, n: np.ndarray, names: pa.Array, buckets: int) -> pa.RecordBatch:
    """Counts of terms by (lang, source) -> a row for each language and bucket."""
    langs = _numbers()
    lang_of = np.array([langs[lang] for lang, _ in keys], np.int64)
    row = lang_of[number] * buckets + _buckets_of(names, buckets)[code]
    order = np.argsort(row, kind="stable")  # counts of a row stay in order of their sources
    row, number, code, n = row[order], number[order], code[order], n[order]
    cuts = _cuts(row)
    pair, term = np.unique(row * len(names) + code, return_inverse=True)
    term_cuts = _cuts(pair // len(names))
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    source = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(row))))
    source_cuts = source[cuts]
    lens = np.diff(np.append(cuts, len(row)))
    sources = pa.array([source for _, source in keys], pa.string()).take(pa.array(number[new]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row[cuts] % buckets, pa.int32()),
            pa.repeat(pa.scalar(False), len(cuts)),
            pa.array(list(langs), pa.string()).take(pa.array(row[cuts] // buckets)),
            _lines(names.take(pa.array(pair % len(names))), term_cuts),
            pa.ListArray.from_arrays(pa.array(np.append(source_cuts, len(new)), pa.int32()), sources),
            _lists((term - np.repeat(term_cuts, lens)).astype(np.int32), cuts),
            _lists((source - np.repeat(source_cuts, lens)).astype(np.int32), cuts),
            _lists(n, cuts),
        ],
        schema=LISTED,
    )


class _Known:
    """A language's kept terms of a bucket: places in the bucket's list by an automaton of the terms between delimiters; long ones by themselves."""

    def __init__(self, terms: list[bytes], first: int) -> None:
        import ahocorasick

        self.automaton, self.long = ahocorasick.Automaton(), {}
        for k, term in enumerate(terms, first):
            text = term.decode()
            if len(text) > LONGEST:
                self.long[term] = k
            else:
                self.automaton.add_word(f" {text} ", k)
        if len(self.automaton):
            self.automaton.make_automaton()

    def places(self, line: bytes) -> np.ndarray:
        """The place of each of these different terms, -1 for those that aren't kept."""
        raw = np.frombuffer(line, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        ends = np.append(np.cumsum((raw & 0xC0) != 0x80)[gaps], len(text := line.decode()) + 1)
        places = np.full(len(ends), -1, np.int64)
        if len(self.automaton):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(f" {text} ")), np.int64).reshape(-1, 2)
            places[np.searchsorted(ends, hits[:, 0])] = hits[:, 1]
        if self.long:
            starts, stops = np.append(0, gaps + 1), np.append(gaps, len(raw))
            for k in np.flatnonzero(stops - starts > LONGEST).tolist():
                places[k] = self.long.get(line[starts[k] : stops[k]], places[k])  # more bytes than LONGEST needn't be more code points
        return places


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LISTED bucket by bucket, kept terms first -> (lang, source, found: ids and counts), merged as far as ENTRIES allows."""
    kept, known, ids, held, numbers, now = defaultdict(list), {}, [], [], _numbers(), None
    found_type = pa.struct([("id", pa.int64()), ("n", pa.int64())])

    def sent() -> Iterator[pa.RecordBatch]:
        if held:
            place, number, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            all_ids = np.concatenate(ids)
            order = np.argsort(key := number * len(all_ids) + place)
            starts = _cuts(key := key[order])
            number, place = np.divmod(key[starts], len(all_ids))
            cuts = _cuts(number)
            rows = pa.StructArray.from_arrays([pa.array(all_ids[place]), pa.array(np.add.reduceat(n[order], starts))], fields=list(found_type))
            keys = list(numbers)
            langs, sources = (pa.array([keys[k][i] for k in number[cuts].tolist()], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([langs, sources, pa.ListArray.from_arrays(pa.array(np.append(cuts, len(rows)), pa.int32()), rows)], names=["lang", "source", "found"])

    for batch in batches:
        for bucket, is_kept, lang, terms, sources, term, source, n in zip(*(batch.column(k).to_pylist() for k in LISTED.names)):
            if bucket != now:
                yield from sent()
                kept, known, ids, numbers, now = defaultdict(list), {}, [], _numbers(), bucket
            if is_kept:
                kept[lang].append((terms, np.frombuffer(n, np.int64)))
                continue
            if lang not in known:
                own = kept.pop(lang, [])
                known[lang] = _Known([t for line, _ in own for t in line.split()], sum(map(len, ids))) if own else None
                ids += [x for _, x in own]
            if known[lang]:
                place = known[lang].places(terms)[np.frombuffer(term, np.int32)]
                hit = np.flatnonzero(place >= 0)
                of = np.array([numbers[lang, x] for x in sources], np.int64)[np.frombuffer(source, np.int32)[hit]]
                if len(hit):
                    held.append((place[hit], of, np.frombuffer(n, np.int64)[hit]))
                if sum(len(x[0]) for x in held) > ENTRIES:
                    yield from sent()
    yield from sent()
    give_back()


def postings(docs: DataFrame, kept: DataFrame, named: DataFrame) -> DataFrame:
    """docs (lang, source, text), kept (lang, term, id), named (lang, source, grp) -> (id, grp, n, in_lang): n > 0 occurrences in the source,
    in_lang in all sources of the language; written.

    Tasks send each different term of a language once to its bucket, with its counts by source, and kept terms go to the same bucket: documents are read once. There are as
    many buckets as shuffle partitions, BUCKETS at most (each list of terms makes a row for each of them), or more if kept terms have more than AUTOMATON / 2 code points
    for each. Sums that are larger than ENTRIES leave a bucket in parts, so that Spark adds them up at the end.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = kept.agg(F.coalesce(F.sum(F.length("term") + 2), F.lit(0))).first()[0]
    buckets = max(min(partitions(spark), BUCKETS), -(-2 * size // AUTOMATON))

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, numbers = _Counts(), _numbers()

        def dealt() -> Iterator[pa.RecordBatch]:
            for merged in counts.taken():
                yield _listed(list(numbers), *merged, buckets)

        for batch in batches:
            langs, sources, texts = (batch.column(k).to_pylist() for k in ("lang", "source", "text"))
            for number, pieces in _shares((numbers[lang, source], piece) for lang, source, t in zip(langs, sources, texts) for piece in delimited(t)):
                piece, code, names = _coded(pieces)
                counts.add(number[piece], code, names)
            if counts.full():
                yield from dealt()
        yield from dealt()
        give_back()

    def vocabulary_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names = batch.column("term").cast(pa.binary())
            row = langs.indices.to_numpy().astype(np.int64) * buckets + _buckets_of(names, buckets)
            order = np.argsort(row, kind="stable")
            cuts = _cuts(row := row[order])
            empty = pa.repeat(pa.scalar(b""), len(cuts))
            lines, ids = _lines(names.take(pa.array(order)), cuts), _lists(batch.column("id").to_numpy()[order], cuts)
            yield pa.RecordBatch.from_arrays([pa.array(row[cuts] % buckets, pa.int32()), pa.repeat(pa.scalar(True), len(cuts)), langs.dictionary.take(pa.array(row[cuts] // buckets)), lines, pa.array([[]] * len(cuts), pa.list_(pa.string())), empty, empty, ids], schema=LISTED)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(seen, LISTED_SQL)
    rows = rows.unionByName(kept.select("lang", "term", "id").mapInArrow(vocabulary_rows, LISTED_SQL))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("known"))
    found = rows.mapInArrow(_counted, "lang string, source string, found array<struct<id: bigint, n: bigint>>").join(named.select("lang", "source", "grp"), ["lang", "source"])
    each = found.select("grp", F.inline("found")).repartition("id").groupBy("id", "grp").agg(F.sum("n").alias("n"))
    return written(each.withColumn("in_lang", F.sum("n").over(Window.partitionBy("id"))), "postings")


def _p(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE x (count + 1) / (total + terms)), exactly: in long, or in decimals for counts whose product doesn't fit."""
    return F.expr(
        f"CASE WHEN {count} < {(2**63 - 1) // SCALE - 1} THEN 1 + ({SCALE}L * ({count} + 1)) div ({total} + {terms})"
        f" ELSE CAST(1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} + {terms} AS DECIMAL(20,0)) AS BIGINT) END"
    )


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared_terms(size: int):
    """Postings (l, bi, bj, id, s, p, p0), a term's in a pair of blocks of sources one after the other -> for each pair of sources of language l, in
    how many terms they meet and what these change in the pair's sum. Holds one matrix for each pair of blocks of `size` sources, of 64 at most."""

    def emptied(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, bi, bj), (value, both) in sums.items():
            g, h = np.nonzero(both)
            first, last = bi * size, (bj - 1) * size
            cols = [pa.repeat(pa.scalar(lang, pa.int64()), len(g)), pa.array(g + np.where(g < size, first, last)), pa.array(h + np.where(h < size, first, last)), pa.array(value[g, h]), pa.array(both[g, h])]
            yield pa.RecordBatch.from_arrays(cols, names=["l", "g", "h", "v", "i"])
        sums.clear()

    def add(sums: dict, rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        lens = np.diff(starts, append=rows.shape[1])
        several = lens > 1
        starts, lens = starts[several], lens[several]
        groups = defaultdict(list)
        for start, *key in zip(starts.tolist(), *rows[:3, starts].tolist(), lens.tolist()):
            groups[tuple(key)].append(start)
        _, _, _, _, s, p, p0 = rows
        for (lang, bi, bj, k), own_starts in groups.items():
            key, side = (lang, bi, bj), size if bi == bj else 2 * size
            if key not in sums:
                if len(sums) >= 64:
                    yield from emptied(sums)
                sums[key] = np.zeros((side, side), np.int64), np.zeros((side, side), np.int64)
            value, both = (x.reshape(-1) for x in sums[key])
            step = max(1, (1 << 20) // (k * k))
            for a in range(0, len(own_starts), step):
                at = np.array(own_starts[a : a + step])[:, None] + np.arange(k)
                own = s[at] - np.where(s[at] // size == bi, bi * size, (bj - 1) * size)
                x, y, x0, y0 = p[at][:, :, None], p[at][:, None, :], p0[at][:, :, None], p0[at][:, None, :]
                more = _differences(x, y) - _differences(x, y0) - _differences(x0, y)
                place = own[:, :, None] * side + own[:, None, :]
                if bi != bj:  # two sources of one block meet in the rows of that block with itself
                    meet = (own[:, :, None] < size) != (own[:, None, :] < size)
                    place, more = place[meet], more[meet]
                np.add.at(value, place.reshape(-1), more.reshape(-1))
                np.add.at(both, place.reshape(-1), 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        held, n = [], 0

        def counted(last: bool) -> Iterator[pa.RecordBatch]:
            """All that is held but the last term, which may go on."""
            nonlocal held, n
            rows = np.concatenate(held, axis=1)
            starts = np.flatnonzero(np.concatenate([[True], np.any(rows[:4, 1:] != rows[:4, :-1], axis=0)]))
            end = rows.shape[1] if last else starts[-1]
            yield from add(sums, rows[:, :end], starts[starts < end])
            held, n = [rows[:, end:]], rows.shape[1] - end

        for batch in batches:
            held.append(np.array([batch.column(k).to_numpy() for k in ("l", "bi", "bj", "id", "s", "p", "p0")], np.int64))
            n += batch.num_rows
            if n >= POSTINGS:
                yield from counted(False)
        if n:
            yield from counted(True)
        yield from emptied(sums)

    return run


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance from each other one (`pair`), and the terms
    that it uses more than its language does, the `top` first of them (`term`).

    Null text, lang and source count as empty. A document is a row, whatever its id; equal rows count as often as they occur. Texts of any length
    are counted whole; ties rank by the item's UTF-8 bytes. An empty table gives an empty result. No other column is read.

    What grows with the input is shuffled by (lang, term) once and by the term's id from then on, after counts were combined in the tasks. Rows of pairs are as
    many as the result has, and number of sources x different probabilities of a source. The terms' window is limited to `top` rows in each task before it is shuffled.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    kept = vocabulary(docs, min_docs)
    # grp: a source's number, l: its language's, s: its place within the language.
    named = docs.select("lang", "source").distinct().withColumn("grp", F.monotonically_increasing_id())
    of_lang = Window.partitionBy("lang")
    named = named.withColumns({"s": F.row_number().over(of_lang.orderBy("source")).cast("long") - 1, "l": F.min("grp").over(of_lang), "sources": F.count("*").over(of_lang)})
    named = written(named, "sources")
    found = postings(docs, kept, named)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = found.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    groups = named.join(totals, "grp", "left").join(sizes, "lang", "left").na.fill(0, ["total", "k", "v"])
    groups = groups.withColumns({"lang_total": F.sum("total").over(of_lang), "p0": F.when(F.col("v") > 0, _p("0L", "total", "v"))})
    groups = written(groups, "groups")
    scored = found.join(groups.drop("lang", "source", "k"), "grp").withColumns({"p": _p("n", "total", "v"), "q": _p("in_lang", "lang_total", "v")})

    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    terms = scored.where("p > q").select("grp", F.col("id").alias("item"), _f("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order("grp"))).where(F.col("rank") <= top)  # ids are in order of the terms' bytes
    terms = terms.join(groups.select("grp", "lang", "source"), "grp").join(kept.select(F.col("id").alias("item"), "term"), "item")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # A term's postings go to each pair of blocks that its source is in: one pair up to BLOCK sources.
    blocks = f"transform(sequence(0L, (sources - 1) div {BLOCK}), b -> struct(least(s div {BLOCK}, b) AS bi, greatest(s div {BLOCK}, b) AS bj))"
    blocks = F.expr(f"CASE WHEN sources <= {BLOCK} THEN array(struct(0L AS bi, 0L AS bj)) ELSE {blocks} END")
    dealt = scored.select("l", F.inline(blocks).alias("bi", "bj"), "id", "s", "p", "p0")
    both = dealt.repartition("id", "bi", "bj").sortWithinPartitions("id", "bi", "bj").mapInArrow(_shared_terms(BLOCK), "l long, g long, h long, v long, i long")
    # One source's terms by their probability, against each other source of the language without the term.
    other = groups.select("l", F.col("s").alias("o"), F.col("p0").alias("o_p0"))
    steps = scored.groupBy("l", "s", "p", "p0").agg(F.count("*").alias("m")).join(other, "l").where("s <> o")
    ends = F.array(F.struct(F.col("s").alias("g"), F.col("o").alias("h"), (F.col("m") * _f("p", "o_p0")).alias("v")), F.struct(F.col("o").alias("g"), F.col("s").alias("h"), (F.col("m") * _f("o_p0", "p")).alias("v")))
    single = steps.select("l", F.explode(ends).alias("e")).select("l", "e.*", F.lit(0).cast("long").alias("i"))
    sums = both.where("g <> h").unionByName(single).groupBy("l", "g", "h").agg(F.sum("v").alias("sum"), F.sum("i").alias("i"))
    right = groups.select("l", F.col("source").alias("item"), F.col("s").alias("h"), F.col("p0").alias("h_p0"), F.col("k").alias("h_k"))
    pairs = groups.withColumnRenamed("s", "g").join(right, "l").where("g <> h").join(sums, ["l", "g", "h"], "left")
    neither = F.col("v") - F.col("k") - F.col("h_k") + F.coalesce("i", F.lit(0))
    value = F.coalesce(F.col("sum"), F.lit(0)) + F.coalesce(neither * _f("p0", "h_p0"), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(order("lang", "source")))
    return terms.unionByName(pairs)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = {
    "op12_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
    SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce(s.lang_total, 0) AS lang_total, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s USING (lang)),
probabilities AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (k.in_lang + 1)) // (g.lang_total + g.v)::HUGEINT AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM probabilities a JOIN probabilities b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM probabilities WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
