"""Language ID by a byte convolutional network, trained in numpy on labelled text.

A text is cut into windows of WINDOW bytes that cover all of it. In a window, bytes are embedded, filters of
several widths slide over them, each filter's greatest value over the window goes through a rectifier, and a
softmax layer gives the probabilities of the languages. A text's probabilities are the mean over its windows,
weighted by the bytes in them. For prediction, embedding and filters are folded into tables by byte class and
by pair of byte classes, which give the same sums with two look-ups per filter at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.packed import bounded_batches

WINDOW, WIDTHS, FILTERS, DIM, SEED = 192, (2, 3, 4), 16, 8, 11
#: Bounds of the sample that the network is fitted on: documents in all, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS, STEPS, BATCH = 3000, 4, 1100, 64
UNDETERMINED = "und"


def _classes() -> np.ndarray:
    """Byte -> class: a letter with its other case, white space and control, digits, other ASCII, and each byte from 0x80 on."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b).lower()
        if b >= 0x80:
            out[b] = 29 + b - 0x80
        elif "a" <= c <= "z":
            out[b] = 3 + ord(c) - ord("a")
        else:
            out[b] = 0 if b <= 32 or b == 127 else 1 if c.isdigit() else 2
    return out


CLASSES, N_CLASSES = _classes(), 29 + 128


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes (n, WINDOW) of all windows of all texts, the bytes in each, and each text's number of windows."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    many = np.maximum(1, -(-lens // WINDOW))
    ends = np.cumsum(many)
    flat = np.zeros(int(ends[-1]) * WINDOW if len(texts) else 0, np.uint8)
    fill = np.zeros(len(flat) // WINDOW, np.int64)
    for text, n, start, k in zip(texts, lens.tolist(), (ends - many).tolist(), many.tolist()):
        flat[start * WINDOW : start * WINDOW + n] = CLASSES[np.frombuffer(text, np.uint8)]
        fill[start : start + k] = WINDOW
        fill[start + k - 1] = n - (k - 1) * WINDOW
    return flat.reshape(-1, WINDOW), fill, many


class Network:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng, n = np.random.default_rng(seed), len(languages)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (N_CLASSES, DIM)), "v": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)), "c": np.zeros(n)}
        for k in WIDTHS:
            self.p[f"w{k}"], self.p[f"b{k}"] = rng.normal(0, 1 / np.sqrt(k * DIM), (k * DIM, FILTERS)), np.zeros(FILTERS)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of a batch."""
        p, rows = self.p, np.arange(len(codes))[:, None]
        emb, at, top = p["e"][codes], {}, []
        for k in WIDTHS:
            x = np.concatenate([emb[:, j : WINDOW - k + 1 + j] for j in range(k)], axis=2)
            z = x @ p[f"w{k}"]
            best = z.argmax(axis=1)
            at[k] = (best, x[rows, best])
            top.append(np.take_along_axis(z, best[:, None], 1)[:, 0] + p[f"b{k}"])
        h = np.maximum(np.concatenate(top, axis=1), 0)
        logits = h @ p["v"] + p["c"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        d = prob * (weight / weight.sum())[:, None]
        g = {"v": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = (d @ p["v"].T) * (h > 0)
        for i, k in enumerate(WIDTHS):
            best, x = at[k]
            own = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"w{k}"], g[f"b{k}"] = np.einsum("bf,bfd->df", own, x), own.sum(axis=0)
            dx = (own[:, :, None] * p[f"w{k}"].T[None]).reshape(len(codes), FILTERS, k, DIM)
            for j in range(k):
                np.add.at(g["e"], codes[rows, best + j], dx[:, :, j])
        return g

    def fit(self, codes: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
        """STEPS steps of Adam, whatever the sample's size; every language has the same total weight."""
        rng, n, order = np.random.default_rng(seed), len(self.languages), np.zeros(0, np.int64)
        weight = (1 / np.maximum(1, np.bincount(y, minlength=n)))[y]
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for t in range(1, STEPS + 1):
            while len(order) < BATCH:
                order = np.append(order, rng.permutation(len(y)))
            b, order = order[:BATCH], order[BATCH:]
            for k, g in self.gradients(codes[b], y[b], weight[b]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                step = 0.004 * 0.05 ** (t / STEPS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                self.p[k] = (self.p[k] - step).astype(np.float32)
        return self

    def folded(self) -> Folded:
        return Folded(self)


class Folded:
    """The network with embedding and filters folded into tables."""

    def __init__(self, net: Network):
        self.languages, self.v, self.c = net.languages, net.p["v"], net.p["c"]
        self.bias = np.concatenate([net.p[f"b{k}"] for k in WIDTHS])
        single = {(k, j): net.p["e"] @ net.p[f"w{k}"][j * DIM : (j + 1) * DIM] for k in WIDTHS for j in range(k)}
        pair = lambda k, j: (single[k, j][:, None] + single[k, j + 1][None]).reshape(-1, FILTERS)
        #: For each width, (table, offset, whether by pair).
        self.parts = {k: [(pair(k, j), j, True) if j + 1 < k else (single[k, j], j, False) for j in range(0, k, 2)] for k in WIDTHS}

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        pairs = codes[:, :-1].astype(np.int32) * N_CLASSES + codes[:, 1:]
        top = []
        for k in WIDTHS:
            n, z = WINDOW - k + 1, None
            for table, j, paired in self.parts[k]:
                got = table.take((pairs if paired else codes)[:, j : j + n], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            top.append(z.max(axis=1))
        logits = np.maximum(np.concatenate(top, axis=1) + self.bias, 0) @ self.v + self.c
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes], block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Each text's language index and probability."""
        codes, fill, many = windows_of(texts)
        p = np.concatenate([self.probabilities(codes[i : i + block]) for i in range(0, len(codes), block)])
        weight = np.maximum(fill, 1)[:, None]
        start = np.cumsum(many) - many
        mean = np.add.reduceat(p * weight, start) / np.add.reduceat(weight, start)
        return mean.argmax(axis=1), mean.max(axis=1).clip(0, 1)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> Folded | None:
    """Fit a network on a bounded sample of labelled rows (null or empty text, null lang: skipped); None without any.

    Each language gives the same number of different texts, sample / languages, or all it has; which ones is decided by a
    hash of the text, so that a text that is repeated, under one id or many, is drawn once. With more than `sample` languages, the
    `sample` with the most texts are learned. The driver gets sample x SAMPLE_WINDOWS x WINDOW characters at most, whatever the rows
    are; very long texts give windows from all over them, and ties of the hash are one text.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("text")), 11).cast("double") / F.lit(float(1 << 53))
    # Texts are counted to within a few hundredths; twice the share goes on, of which the least draws are taken.
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return None
    share = sample // len(counts)
    wanted = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (2.0 * share + 50) / max(n, 1))]), F.col("lang"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring("text", (F.floor(F.length("text") * i / SAMPLE_WINDOWS) + 1).cast("int"), F.lit(WINDOW)))
    drawn = rows.where(draw < wanted).groupBy("lang", draw.alias("draw")).agg(F.min(F.array_distinct(starts)).alias("windows"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    taken = drawn.withColumn("place", place).where(F.col("place") <= share)
    found = sorted((r[0], w) for r in taken.select("lang", "windows").collect() for w in r[1] if w)
    languages = sorted({lang for lang, _ in found})
    if not languages:
        return None
    codes, _, _ = windows_of([w.encode()[:WINDOW] for _, w in found])
    return Network(languages).fit(codes, np.array([languages.index(lang) for lang, _ in found])).folded()


def predict(docs: DataFrame, model: Folded | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred (a learned language; `und` for a text that is null or has no letter) and score (0 to 1; 0 for `und`).

    Every window of the whole text counts, long texts in parts. Without a model all is `und`. Of languages with the same probability the
    first by name is taken. Rows are judged one by one, repeated ones alike; columns of the added names are replaced, others may have any name;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # Every column of docs is in one struct, so that no name can clash.
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*own).alias("row"))
    at = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")].index(text_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(0).field(at).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if net is not None:
                own = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                # In parts, so that the windows of many long texts are never held together.
                part, held = [], 0
                for i in [*own, None]:
                    if i is not None:
                        part.append(i)
                        held += len(texts[i])
                    if part and (i is None or held > 1 << 20):
                        best, p = net.predict([texts[j].encode() for j in part])
                        score[part] = p
                        for j, k in zip(part, best):
                            lang[j] = net.languages[k]
                        part, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    kinds = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kinds).select("row.*", "lang_pred", "score")


def crc_rest(id_col: str, modulus: int):
    """crc32 of the id as text modulo a number; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(crc_rest("doc_id", 5) != 0).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_rest("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
