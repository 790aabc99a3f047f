"""Exact deduplication: group by a 128-bit content hash and compare the bytes inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import ascii_lower, boxed, id_text


def exact_groups(docs: DataFrame, keep: str = "smallest", fold_case: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z if fold_case. Grouping is by the MD5 hash and the
    bytes themselves, so texts that merely share a hash stay apart; each task sums up its own rows first, so a group
    that holds a third of all rows sends one row from each task. keep: "smallest" or "largest" doc_id stays.
    The join back to documents carries digests only, never texts.

    A null text counts as empty. Rows that repeat a doc_id and its text are the same document and share its verdict.
    A null doc_id never stays unless its group has no other, and then keep_id is null. Empty tables give no rows.
    """
    text = ascii_lower(F.col("text")) if fold_case else F.col("text")
    rows = id_text(docs).select("doc_id", text.alias("norm")).withColumn("h", F.md5("norm"))
    stays = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    classes = (
        rows.groupBy("h", "norm")
        .agg(stays.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    mine = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    return mine.join(classes, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


@boxed
def drop_exact(docs: DataFrame, keep: str = "smallest", fold_case: bool = True) -> DataFrame:
    """docs with exactly one row of each class of equal texts, the one that exact_groups keeps; all columns stay.

    The row itself is the state of the aggregation, so nothing is joined back and ids may be null or repeated: a null
    id stays if its class has no other, and of rows that share the id the one with the first or last by hash of the text stays.
    """
    text = F.coalesce("text", F.lit(""))
    norm = ascii_lower(text) if fold_case else text
    order = (F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.md5(text).alias("c"))
    one = F.max_by if keep == "largest" else F.min_by
    order = F.struct(*order) if keep == "largest" else F.struct((~F.col("doc_id").isNotNull()).alias("a"), *order[1:])
    kept = docs.groupBy(F.md5(norm).alias("_h"), F.sha2(norm, 256).alias("_s")).agg(one(F.struct(*docs.columns), order).alias("_row"))
    return kept.select("_row.*")
