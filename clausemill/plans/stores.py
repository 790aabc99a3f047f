"""Queries that write to a store in the shared folder and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.plans.registry import query, table
from clausemill.sources import files
from clausemill.sources.staging import shared_folder


def _fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _store(spark: SparkSession, sf: str) -> str:
    """Orders as runs and line items as their attempts, some of no run; then every tenth run anew, without attempts."""
    at, k = _fresh(spark), F.col("o_orderkey")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    runs = table(spark, sf, "orders").select(
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"), F.col("o_custkey").cast("string").alias("document_id"), F.lit("off").alias("arm"), F.col("o_orderstatus").alias("status"), none("failure", "string"), none("model", "string"), k.alias("tokens"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    l = F.col("l_orderkey")
    attempts = table(spark, sf, "lineitem").select(F.concat(F.when(l % 7 == 0, "lost").otherwise("r"), l.cast("string")).alias("run_id"), F.col("l_linenumber").cast("int").alias("seq"), F.lit(True).alias("success"), none("model", "string"), F.col("l_quantity").cast("long").alias("tokens"), F.lit(1).cast("long").alias("elapsed_ms"))
    for _ in range(2):  # the second finds it done
        files.write_run_tables({"runs": runs, "attempts": attempts}, at, batch="first")
    files.write_run_tables({"runs": runs.where("tokens % 10 = 0").withColumn("tokens", F.lit(-1).cast("long"))}, at, batch="again")
    return at


_STORE = """r AS (SELECT 'r' || o_orderkey AS run_id, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_orderkey END AS tokens, o_orderstatus AS status FROM orders),
    a AS (SELECT 'r' || l_orderkey AS run_id, count(*) AS n, sum(l_quantity)::BIGINT AS spent FROM lineitem WHERE l_orderkey % 7 > 0 AND l_orderkey % 10 > 0 GROUP BY 1)"""


@query("sources_run_tables", f"WITH {_STORE} SELECT run_id, status, tokens, coalesce(n, 0) AS attempts, coalesce(spent, 0) AS spent FROM r LEFT JOIN a USING (run_id)")
def run_tables(spark: SparkSession, sf: str) -> DataFrame:
    at = _store(spark, sf)
    tries = files.read_run_table(spark, at, "attempts").groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum("tokens").alias("spent"))
    return files.read_run_table(spark, at, "runs").select("run_id", "status", "tokens").join(tries, "run_id", "left").na.fill(0, ["attempts", "spent"])


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Turns as JSON lines, one in five an array, one in seven cut off."""
    at, t = _fresh(spark), F.col("conv_id") + F.col("turn")
    record = files.canonical_json(["conv_id", "turn", "role", "text"])
    line = F.when(t % 5 == 0, F.concat(F.lit("["), record, F.lit("]"))).when(t % 7 == 0, F.substring(record, F.lit(1), F.length(record) - 1)).otherwise(record)
    table(spark, sf, "conversations").select(line.alias("value")).write.text(at)
    return files.read_json_lines(spark, at)


@query("sources_json_lines", "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations WHERE (conv_id + turn) % 5 > 0 AND (conv_id + turn) % 7 > 0")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    row = F.from_json("value", "conv_id long, turn long, role string, text string")
    return _lines(spark, sf)[0].select(row.alias("r")).select("r.conv_id", "r.turn", "r.role", F.sha2("r.text", 256).alias("text_sha256"))


@query("sources_json_line_violations", "SELECT 'not_an_object' AS rule, count(*) AS n FROM conversations WHERE (conv_id + turn) % 5 = 0 OR (conv_id + turn) % 7 = 0")
def json_line_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf)[1].groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
