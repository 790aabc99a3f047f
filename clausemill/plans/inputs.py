"""Queries on blocks, responses, records, headings and caller-given functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import pluggable
from clausemill.operators import blocks, scoring, structure
from clausemill.plans.core import _LINES
from clausemill.plans.registry import query, table
from clausemill.sources import files


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_id"), F.col("turn").alias("pos"), "text")


@query("blocks_documents", r"SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE regexp_matches(text, '\S') GROUP BY 1")
def block_documents(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.assemble_blocks(_blocks(spark, sf))[0]


@query("blocks_view", r"SELECT conv_id AS doc_id, turn AS block_id, text FROM conversations WHERE regexp_matches(text, '\S')")
def blocks_view(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.blocks_view(*blocks.assemble_blocks(_blocks(spark, sf)))


_NESTED = """e AS (SELECT conv_id AS doc_id, turn AS pos, turn % 5 AS k, text, CASE WHEN turn % 5 = 1 THEN 'table' ELSE 'paragraph' END AS kind FROM conversations),
    n AS (SELECT *, (SELECT count(*) FROM e b WHERE b.doc_id = e.doc_id AND b.pos < e.pos) AS n, (SELECT max(pos) FROM e b WHERE b.doc_id = e.doc_id AND b.pos < e.pos AND b.kind = 'table') AS t FROM e),
    i AS (SELECT n.*, o.n AS tn FROM n LEFT JOIN n o ON o.doc_id = n.doc_id AND o.pos = n.t)"""


@query("blocks_nested_ids", f"""WITH {_NESTED} SELECT doc_id, pos, CASE k WHEN 2 THEN 't' || tn || '_r' || pos || '_c0' WHEN 3 THEN 't' || tn || '_r0_c1_t' || pos % 2 || '_r1_c' || pos WHEN 4 THEN 't' || tn || '_r0_c1_t0_r0_c0_t1_r2_c2' ELSE 'p' || n END AS block_id FROM i WHERE kind = 'paragraph'""")
def nested_ids(spark: SparkSession, sf: str) -> DataFrame:
    k, turn = F.col("turn") % 5, F.col("turn").cast("int")
    at = lambda t, r, c: F.struct(t.alias("table"), r.alias("row"), c.alias("col"))
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    cells = F.when(k == 2, F.array(at(zero, turn, zero))).when(k == 3, F.array(at(zero, zero, one), at(turn % 2, one, turn))).when(k == 4, F.array(at(zero, zero, one), at(zero, zero, zero), at(one, two, two)))
    elements = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(k == 1, "table").otherwise("paragraph").alias("kind"), cells.alias("cells"), "text")
    return blocks.nested_block_ids(elements).select("doc_id", "pos", "block_id")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    got = structure.pieces(table(spark, sf, "documents"), F.split("text", "(?<=\n)", -1)).where("piece <> ''")
    return got.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.col("piece").alias("text"))


_HEADS = rf"""{_LINES}, d AS (SELECT *, coalesce(sum(length(piece) - length(replace(piece, '(', '')) - length(piece) + length(replace(piece, ')', ''))) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM lines),
    h AS (SELECT doc_id, line, regexp_extract(piece, '^([A-Z][a-z]+)', 1) AS number FROM d WHERE depth = 0 AND regexp_matches(piece, '^[A-Z][a-z]+'))"""


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.headings(_lines(spark, sf), "^([A-Z][a-z]+)", "(", ")")


@query("blocks_headings", f"WITH {_HEADS} SELECT doc_id, line, number FROM h")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf)


@query("blocks_article_slices", f"""WITH {_HEADS}, e AS (SELECT doc_id, max(line) AS e FROM lines GROUP BY 1)
    SELECT doc_id, number, line AS first_line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, e) AS last_line FROM h JOIN e USING (doc_id)""")
def article_slices(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.article_slices(_heads(spark, sf), _lines(spark, sf))


@query("sources_valid_responses", "SELECT sha256(url || '|text/html') AS key, min(page_id) AS seq, sha256(arg_min(html, page_id)) AS body_sha256 FROM pages WHERE length(html) >= 10 GROUP BY url")
def valid_responses(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("url", F.lit("text/html").alias("media_type"), F.col("page_id").alias("seq"), F.col("html").alias("body"))
    return files.valid_responses(pages).select("key", "seq", F.sha2("body", 256).alias("body_sha256"))


@query("sources_canonical_json", """SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS record FROM orders""")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", files.canonical_json(["o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"]).alias("record"))


@query("sources_hash_prose", "SELECT conv_id, turn, role, sha256(text) AS text FROM conversations")
def hash_prose(spark: SparkSession, sf: str) -> DataFrame:
    return files.hash_prose(table(spark, sf, "conversations"), ["text"])


@query("scoring_attempt_resources", "SELECT event_type AS \"group\", count(*) AS attempts, round(sum((props->>'$.k')::DOUBLE), 4) AS total, count(*) FILTER (WHERE props->>'$.k' IS NULL) AS missing FROM events GROUP BY 1")
def attempt_resources(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.attempt_resources(table(spark, sf, "events").withColumn("group", F.col("event_type")), "props", "$.usage.k", "$.k")


@query("functions_token_count", "SELECT doc_id, len(string_split(text, ' ')) AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return pluggable.with_token_count(table(spark, sf, "documents").select("doc_id", "text"), lambda t: len(t.split(" "))).select("doc_id", "n_tokens")


@query("functions_vectors", "SELECT doc_id, length(text)::DOUBLE AS first, 2 AS width FROM documents")
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    got = pluggable.with_vectors(table(spark, sf, "documents").select("doc_id", "text"), lambda texts: [[len(t), 1.0] for t in texts])
    return got.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.size("embedding").alias("width"))


@query("functions_exact_fold", r"SELECT doc_id, sha256(replace(strip_accents(replace(lower(text), 'ß', 'ss')), 'ł', 'l')) AS folded_sha256 FROM documents")
def exact_fold(spark: SparkSession, sf: str) -> DataFrame:
    return pluggable.with_exact_fold(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.sha2("folded", 256).alias("folded_sha256"))
