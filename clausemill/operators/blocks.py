"""Blocks of text that make up a document, headings with quotations, and article slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, text) and anchors(doc_id, block_id, start_offset, end_offset) of blocks(doc_id, block_id, pos, text).

    Blank and null blocks are skipped; the rest is joined by one line feed in order of pos, ties by block_id.
    """
    held = blocks.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    upto = Window.partitionBy("doc_id").orderBy("pos", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(upto) - 1
    anchors = held.select("doc_id", "block_id", end.alias("end_offset"), (end - F.length("text")).alias("start_offset"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "block_id", "text")))
    documents = held.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", F.array_join(F.col("p.text"), "\n").alias("text"))
    return documents, anchors.select("doc_id", "block_id", "start_offset", "end_offset")


def nested_block_ids(elements: DataFrame) -> DataFrame:
    """doc_id, block_id, pos, text of the paragraphs of elements(doc_id, pos, kind, cells, text), in the order of the page.

    kind is paragraph or table; cells, an array of structs of table, row and col, tells the cells that an element lies in,
    the outermost first, table counting the tables of its cell from 0. A paragraph of its own is p<n>, one in a cell
    t<n>_r<row>_c<col> and _t<table>_r<row>_c<col> for each cell further in; n is the number of paragraphs anywhere and of
    tables that lie in no cell before it, or before its outermost table. Blank paragraphs count; assemble_blocks skips them.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    inside = F.size(F.coalesce("cells", F.array().cast("array<struct<table:int,row:int,col:int>>"))) > 0
    paragraph, top_table = F.col("kind") == "paragraph", (F.col("kind") == "table") & ~inside
    before = F.coalesce(F.sum(F.when(paragraph | top_table, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = elements.withColumns({"n": before, "inside": inside})
    table = F.last(F.when(top_table, F.col("n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = lambda c: F.concat(F.lit("_r"), c["row"].cast("string"), F.lit("_c"), c["col"].cast("string"))
    chain = F.array_join(F.transform("cells", lambda c, i: F.concat(F.when(i > 0, F.concat(F.lit("_t"), c["table"].cast("string"))).otherwise(""), part(c))), "")
    name = F.when(F.col("inside"), F.concat(F.lit("t"), table.cast("string"), chain)).otherwise(F.concat(F.lit("p"), F.col("n").cast("string")))
    return rows.withColumn("block_id", name).where(paragraph).select("doc_id", "block_id", "pos", "text")


def blocks_view(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, block_id, text: the slice of each anchor."""
    joined = anchors.join(documents.select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "block_id", F.expr("substring(text, start_offset + 1, end_offset - start_offset)").alias("text"))


def headings(lines: DataFrame, pattern: str, opens: str = "„", closes: str = "”") -> DataFrame:
    """doc_id, line, number of the lines that match a heading pattern outside of any quotation.

    lines(doc_id, line, text). The depth is the count of opened less closed quotations before the line.
    """
    count = lambda mark: F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(count(opens) - count(closes)).over(before), F.lit(0))
    number = F.regexp_extract("text", pattern, 1)
    return lines.withColumn("depth", depth).where((F.col("depth") == 0) & (number != "")).select("doc_id", "line", number.alias("number"))


def article_slices(found: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, number, first_line, last_line: from a heading to the line before the next one, or to the document's end."""
    last = lines.groupBy("doc_id").agg(F.max("line").alias("end_line"))
    following = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line"))
    return found.withColumn("following", following).join(last, "doc_id").select("doc_id", "number", F.col("line").alias("first_line"), F.coalesce(F.col("following") - 1, F.col("end_line")).alias("last_line"))
