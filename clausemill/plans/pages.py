"""Queries on pages of words; turns of conversations stand for words, events for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import pages
from clausemill.plans.registry import query, table
from clausemill.streaming import events as streams

_WORDS = r"""w AS (SELECT conv_id AS doc_id, turn // 3 AS page, turn AS seq, CASE WHEN turn // 3 <> 1 THEN role || conv_id % 7 END AS text, (turn * conv_id) % 11 AS top FROM conversations),
    f AS (SELECT *, text IS NOT NULL AS is_word FROM w WHERE text IS NOT NULL OR seq % 3 = 0), l AS (SELECT *, lag(CASE WHEN is_word THEN page END IGNORE NULLS) OVER o AS p, lag(CASE WHEN is_word THEN top END IGNORE NULLS) OVER o AS t FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY page, seq)),
    s AS (SELECT *, coalesce(text, '') AS word, CASE WHEN NOT is_word OR p IS NULL THEN '' WHEN p <> page OR abs(top - t) > 3 THEN chr(10) ELSE ' ' END AS sep FROM l)"""


def _words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, t = F.col("conv_id"), F.col("turn")
    page = F.floor(t / 3)
    return pages.assemble_words(table(spark, sf, "conversations").select(c.alias("doc_id"), page.alias("page"), t.alias("seq"), F.when(page != 1, F.concat("role", (c % 7).cast("string"))).alias("text"), ((t * c) % 11).alias("top")))


@query("pages_assembled_text", f"WITH {_WORDS} SELECT doc_id, string_agg(sep || word, '' ORDER BY page, seq) AS text FROM s GROUP BY 1")
def assembled_text(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf)[0]


@query("pages_word_anchors", f"""WITH {_WORDS}, e AS (SELECT *, sum(length(sep) + length(word)) OVER o AS e, sum(is_word::INT) OVER o AS n FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY page, seq))
    SELECT doc_id, CASE WHEN is_word THEN 'word_' || n::BIGINT ELSE 'blank_page_' || page END AS anchor_id, page, (e - length(word))::BIGINT AS start_offset, e::BIGINT AS end_offset FROM e""")
def word_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf)[1]


_PAGES = "p AS (SELECT user_id AS doc_id, event_id AS page, CASE WHEN user_id % 3 = 0 THEN 60 WHEN user_id % 4 = 0 THEN 0 ELSE event_id % 90 END AS n, CASE WHEN user_id % 4 = 0 AND user_id % 3 <> 0 THEN 0 ELSE value / 1000 END AS ink FROM events), g AS (SELECT doc_id, count(*) FILTER (WHERE n >= 50) AS b, count(*) FILTER (WHERE n >= 50 OR ink > 0.0001) AS c FROM p WHERE page % 5 = 0 GROUP BY 1)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    chars, ink = F.when(u % 3 == 0, 60).when(u % 4 == 0, 0).otherwise(F.col("event_id") % 90), F.when((u % 4 == 0) & (u % 3 != 0), 0.0).otherwise(F.col("value") / 1000)
    return table(spark, sf, "events").where("event_id % 5 = 0").select(u.alias("doc_id"), F.col("event_id").alias("page"), chars.alias("native_chars"), ink.alias("ink_share"))


@query("pages_read_mode", f"WITH {_PAGES} SELECT doc_id, CASE WHEN b = c THEN 'native' ELSE 'ocr' END AS read_mode FROM g WHERE c > 0")
def read_mode(spark: SparkSession, sf: str) -> DataFrame:
    return pages.choose_read_mode(_pages(spark, sf))[0]


@query("pages_empty", f"WITH {_PAGES} SELECT 'empty_input' AS rule, doc_id::VARCHAR AS key FROM g WHERE c = 0")
def empty(spark: SparkSession, sf: str) -> DataFrame:
    return pages.choose_read_mode(_pages(spark, sf))[1]


@query("stream_cascade", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("document_id"))
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("run_id"))
    kept, lines = streams.cascade(gone, runs, table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "run_id"))
    return kept.join(lines, "run_id").select(F.col("run_id").alias("o_orderkey"), "l_linenumber")
