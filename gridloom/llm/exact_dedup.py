"""Exact dedup by skew-safe combining, in DataFrame functions only.

Rows are combined in three steps, each of which groups by the whole text beside its digest, so that two
texts with one digest could never be taken for equal: first inside each map task (the partial half of the
aggregation), then among the rows of a salted digest group, then among the salt winners of all salts.
A text held by a third of all rows so arrives as one row for each map task and salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows (id long, sha string, text string not null) -> one row per distinct text: sha, text, keep_id (largest id), group_size."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    merged = salted.groupBy("sha", "text", "salt").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return merged.groupBy("sha", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row of docs; of equal texts the largest id stays.

    A null text counts as empty. Rows that repeat an id are rows of their own for group_size, and each row
    whose id equals keep_id is kept. A null id never wins against another; equal texts that all have null ids
    have a null keep_id, and are kept only if there is one of them. Very long texts are compared whole like others. Added columns
    replace columns of the same names, others may have any name. An empty table gives an empty result.
    """
    out, keep = _marked(docs, id_col, text_col, salts)
    return out.select("row.*", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("id") == keep, F.col("size").isNull()).alias("kept"), F.col("sha").alias("text_sha256"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Exactly one row of docs for each distinct text, with the columns of docs: one with the largest id.

    Rows that repeat both the text and that id, or equal texts that all have null ids, are decided by a hash of the other
    columns; rows that are equal in these too are the same row. They share a salt, and so are together after the join.
    """
    out, keep = _marked(docs, id_col, text_col, salts, added=())
    others = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy("sha", "n", "h", "salt").orderBy(F.xxhash64(*others))
    return out.where(F.col("id").eqNullSafe(keep)).withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")


def _marked(docs: DataFrame, id_col: str, text_col: str, salts: int, added: tuple[str, ...] = ADDED):
    """The columns of docs but those added in one struct `row`, so that no name can clash, with what the join gives each row; and
    the id that stays."""
    named = lambda c: F.col(f"`{c}`")
    text = F.coalesce(named(text_col), F.lit(""))
    classes = exact_classes(docs.select(named(id_col).cast("long").alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text")), salts)
    # Should two texts ever share a digest, length and second hash tell their classes apart.
    many = classes.where("group_size > 1").select(F.col("sha").alias("c_sha"), F.length("text").alias("c_n"), F.xxhash64("text").alias("c_h"), "keep_id", F.col("group_size").alias("size"))
    spread = many.withColumn("c_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = [named(c) for c in docs.columns if c.lower() not in added]
    key = named(id_col).cast("long")
    rows = docs.select(F.struct(*own).alias("row"), key.alias("id"), F.sha2(text, 256).alias("sha"), F.length(text).alias("n"), F.xxhash64(text).alias("h"), F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"))
    on = (F.col("sha") == F.col("c_sha")) & (F.col("n") == F.col("c_n")) & (F.col("h") == F.col("c_h")) & (F.col("salt") == F.col("c_salt"))
    out = rows.join(spread.hint("merge"), on, "left")
    return out, F.coalesce("keep_id", "id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
