"""A corpus from documents to token ids, in five stages; each calls one operator of gridloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import encode
from gridloom.llm.common import partitions, written
from gridloom.llm.exact_dedup import one_of_each
from gridloom.llm.language_id import UNDETERMINED, crc_rest, predict, train
from gridloom.llm.mixing import OUT_SHARDS, mix
from gridloom.llm.ngram_join import near_duplicate_components

#: A language with less than this probability is no better than a guess among the languages learned here.
MIN_SCORE = 0.35


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _shielded(docs: DataFrame, added: list[str], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """apply(docs) with the columns of docs only, those that are named as an added column included."""
    own = {c: _unused(docs, f"own_{k}") for k, c in enumerate(docs.columns) if c.lower() in added}
    out = apply(docs.withColumnsRenamed(own))
    return out.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is a guess, go."""
    model = train(docs.where(crc_rest("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return _shielded(docs, ["lang_pred", "score"], lambda d: predict(d, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, a document with the largest id."""
    return one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles the one with the least id stays."""
    found, gone = near_duplicate_components(docs.select("doc_id", "text")), _unused(docs, "dropped")
    dropped = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"] == dropped[gone], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes as often as the mix takes it. Each written file holds documents of one
    output shard in the order of that shard's shuffle; a shard lies in as many files as its key's range is cut into."""
    def apply(d: DataFrame) -> DataFrame:
        copy = _unused(d, "copy")
        rows = mix(d).withColumn(copy, F.explode("copies"))
        ranges = -(-partitions(spark) // OUT_SHARDS)
        place = F.floor((F.col(f"{copy}.key").cast("double") / 2.0**64 + 0.5) * ranges)
        part = F.col(f"{copy}.shard") * ranges + F.least(place, F.lit(ranges - 1))
        return rows.repartitionById(OUT_SHARDS * ranges, part.cast("int")).sortWithinPartitions(f"{copy}.shard", f"{copy}.key")

    return _shielded(docs, ["size", "source_size", "target", "copies"], apply)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the text decoded from them."""
    return encode(docs, chunk=1 << 19)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Language ID and the n-gram join can't be expressed in SQL; the stages are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
