"""Pages of words: how a document is read, and its text and anchors from the places of its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def choose_read_mode(pages: DataFrame, least_chars: int = 50, blank_ink: float = 0.0001, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """doc_id, read_mode; and rule, key of documents without content.

    pages(doc_id, page, native_chars, ink_share). A page bears text if it has least_chars; another is blank if its ink
    share is at most blank_ink. A document is native if text-bearing pages make up `share` of those not blank, else ocr.
    """
    bears = F.col("native_chars") >= least_chars
    per = pages.groupBy("doc_id").agg(F.count_if(bears).alias("bearing"), F.count_if(bears | (F.col("ink_share") > blank_ink)).alias("covered"))
    mode = F.when(F.col("bearing") / F.col("covered") >= share, "native").otherwise("ocr")
    empty = per.where("covered = 0").select(F.lit("empty_input").alias("rule"), F.col("doc_id").cast("string").alias("key"))
    return per.where("covered > 0").select("doc_id", mode.alias("read_mode")), empty


def assemble_words(words: DataFrame, tolerance: float = 3.0, native: bool = True) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, text) and anchors(doc_id, anchor_id, page, start_offset, end_offset) of words in order.

    words(doc_id, page, seq, text, top, block, par, line); a null text stands for a page without words. Words are parted
    by a line feed on a new page, and on the same page where the top moves by more than the tolerance (native) or the
    block, paragraph or line changes, else by a space. A blank page is an anchor of no length, blank_page_<n>, where the
    text before it ends. A document is one group: its words are bounded by its pages.
    """
    doc = Window.partitionBy("doc_id").orderBy("page", "seq")
    full = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != ""
    rows = words.withColumn("full", full)
    has = F.max(F.col("full").cast("int")).over(Window.partitionBy("doc_id", "page"))
    rows = rows.withColumn("blank", has == 0).where(F.col("full") | F.col("blank"))
    first_of_blank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")) == 1
    rows = rows.withColumn("keep", F.col("full") | first_of_blank).where("keep").withColumn("word", F.when(F.col("full"), F.col("text")).otherwise(""))
    before = lambda c: F.last(F.when(F.col("full"), F.col(c)), ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("p", before("page"))
    if native:
        moved = F.abs(F.col("top") - before("top")) > tolerance
    else:
        moved = (F.col("block") != before("block")) | (F.col("par") != before("par")) | (F.col("line") != before("line"))
    separator = F.when(~F.col("full") | F.col("p").isNull(), "").when((F.col("p") != F.col("page")) | F.coalesce(moved, F.lit(False)), "\n").otherwise(" ")
    rows = rows.withColumn("separator", separator)
    rows = rows.withColumn("end", F.sum(F.length("separator") + F.length("word")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.col("full").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0))
    name = F.when(F.col("full"), F.concat(F.lit("word_"), nth.cast("string"))).otherwise(F.concat(F.lit("blank_page_"), F.col("page").cast("string")))
    anchors = rows.select("doc_id", name.alias("anchor_id"), "page", (F.col("end") - F.length("word")).alias("start_offset"), F.col("end").alias("end_offset"))
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "seq", F.concat("separator", "word").alias("part")))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.col("parts.part"), "").alias("text")), anchors
