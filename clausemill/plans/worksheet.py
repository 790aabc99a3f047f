"""Queries on the worksheet log; order lines stand for its entries and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import worksheet
from clausemill.plans.registry import query, table

_KINDS = ("candidate", "character", "verdict", "verdict", "note")
_ENTRIES = """entries AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, ['candidate', 'character', 'verdict', 'verdict', 'note'][l_partkey % 5 + 1] AS kind,
    CASE l_partkey % 5 WHEN 2 THEN 'relevance' WHEN 3 THEN 'relation' END AS stage, l_suppkey % 2 AS candidate_id,
    CASE WHEN l_partkey % 5 = 2 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'irrelevant' ELSE 'relevant' END ELSE l_returnflag END AS value FROM lineitem)"""
_STATE = f"""{_ENTRIES}, state AS (SELECT run_id, candidate_id, min(seq) FILTER (WHERE kind = 'candidate') AS posted_at, arg_min(value, seq) FILTER (WHERE kind = 'character') AS character,
    arg_min(value, seq) FILTER (WHERE stage = 'relevance') AS relevance, arg_min(value, seq) FILTER (WHERE stage = 'relation') AS relation FROM entries GROUP BY 1, 2)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_partkey") % 5
    verdict = F.when(F.col("l_suppkey") % 3 == 0, "irrelevant").otherwise("relevant")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("seq"),
        F.element_at(F.array(*map(F.lit, _KINDS)), (p + 1).cast("int")).alias("kind"),
        F.when(p == 2, "relevance").when(p == 3, "relation").alias("stage"),
        (F.col("l_suppkey") % 2).alias("candidate_id"),
        F.when(p == 2, verdict).otherwise(F.col("l_returnflag")).alias("value"),
    )


@query("worksheet_candidate_state", f"WITH {_STATE} SELECT * FROM state")
def candidate_state(spark: SparkSession, sf: str) -> DataFrame:
    return worksheet.candidate_state(_entries(spark, sf), ["run_id"])


@query("worksheet_pending_step", f"""WITH {_STATE}, s AS (SELECT run_id, posted_at, CASE WHEN relevance IS NULL THEN 'relevance' WHEN relevance <> 'relevant' THEN NULL WHEN character IS NULL THEN 'characterise' WHEN relation IS NULL THEN 'relation' END AS step
      FROM state WHERE posted_at IS NOT NULL), o AS (SELECT run_id, arg_min(step, posted_at) FILTER (WHERE step IS NOT NULL) AS step FROM s GROUP BY 1)
    SELECT o_orderkey AS run_id, CASE WHEN o.run_id IS NULL THEN 'search' ELSE coalesce(step, 'done') END AS step FROM orders LEFT JOIN o ON o_orderkey = o.run_id""")
def pending_step(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    return worksheet.pending_step(units, worksheet.candidate_state(_entries(spark, sf), ["run_id"]), ["run_id"])


@query("worksheet_audit_steps", f"""WITH {_ENTRIES}, g AS (SELECT run_id, count(*) FILTER (WHERE kind <> 'candidate') AS s, count(DISTINCT candidate_id) FILTER (WHERE kind = 'candidate') AS c FROM entries GROUP BY 1)
    SELECT 'too_many_steps' AS rule, run_id::VARCHAR AS key, s || '/' || c AS detail FROM g WHERE s > 1 + 3 * c""")
def audit_steps(spark: SparkSession, sf: str) -> DataFrame:
    return worksheet.audit_steps(_entries(spark, sf), ["run_id"])


_LOCATORS = """claims AS (SELECT l_orderkey AS run_id, 'p' || (l_partkey % 20) AS locator FROM lineitem WHERE l_linestatus = 'F'),
    known AS (SELECT DISTINCT l_orderkey AS run_id, 'p' || (unnest([l_partkey, l_suppkey]) % 20) AS locator FROM lineitem WHERE l_returnflag <> 'R')"""


def _known(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_returnflag <> 'R'")
    name = lambda c: F.concat(F.lit("p"), (F.col(c) % 20).cast("string"))
    return worksheet.known_locators(rows.select(F.col("l_orderkey").alias("run_id"), F.array(name("l_partkey"), name("l_suppkey")).alias("locators")), ["run_id"])


@query("worksheet_known_locators", f"WITH {_LOCATORS} SELECT run_id, locator FROM known")
def known_locators(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf)


@query("worksheet_unknown_citations", f"""WITH {_LOCATORS} SELECT DISTINCT 'not_in_ledger' AS rule, run_id::VARCHAR AS key, locator AS detail FROM claims ANTI JOIN known USING (run_id, locator)
    UNION ALL SELECT 'duplicate_locator', run_id::VARCHAR, locator FROM claims GROUP BY run_id, locator HAVING count(*) > 1""")
def unknown_citations(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("locator"))
    return worksheet.unknown_citations(claims, _known(spark, sf), ["run_id"])


@query("worksheet_read_rules", "SELECT 'read_limit' AS rule, user_id::VARCHAR AS key, n::VARCHAR AS detail FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view') WHERE n > 3")
def read_rules(spark: SparkSession, sf: str) -> DataFrame:
    return worksheet.read_rules(table(spark, sf, "events").where("event_type = 'view'").withColumnRenamed("event_id", "seq"), ["user_id"])


@query("worksheet_finalise_units", """WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O')
    SELECT o_orderkey AS run_id, CASE WHEN o_orderkey IN (SELECT k FROM c) THEN 'no_relation' ELSE 'no_basis_found' END AS code FROM orders WHERE o_orderkey NOT IN (SELECT k FROM f)""")
def finalise_units(spark: SparkSession, sf: str) -> DataFrame:
    units, line = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id")), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    return worksheet.finalise_units(units, line.where("l_linestatus = 'O'"), line.where("l_returnflag = 'A'"), ["run_id"])


_CODED = "coded AS (SELECT l_orderkey AS run_id, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 5 END AS block, ['contradictory', 'uncertain', 'consistent', 'not_processed', 'basis_not_in_force', 'no_relation'][l_partkey % 6 + 1] AS code FROM lineitem)"


@query("worksheet_block_prominence", f"""WITH {_CODED}, r AS (SELECT *, CASE WHEN code IN ('contradictory', 'basis_not_in_force') THEN 0 WHEN code IN ('uncertain', 'not_processed') THEN 1 ELSE 2 END AS rank FROM coded)
    SELECT run_id, block, ['critical', 'warning', 'neutral'][min(rank) + 1] AS prominence, count(*) AS findings FROM r GROUP BY 1, 2""")
def block_prominence(spark: SparkSession, sf: str) -> DataFrame:
    codes = ("contradictory", "uncertain", "consistent", "not_processed", "basis_not_in_force", "no_relation")
    found = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 5).alias("block"), F.element_at(F.array(*map(F.lit, codes)), (F.col("l_partkey") % 6 + 1).cast("int")).alias("code")
    )
    return worksheet.block_prominence(found, ["run_id", "block"])


_FOUND = "found AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS finding_id FROM lineitem)"


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("finding_id"))


@query("worksheet_resolve_groups", f"""WITH {_FOUND}, n AS (SELECT run_id, finding_id, row_number() OVER (PARTITION BY run_id ORDER BY finding_id) AS number FROM found),
    g AS (SELECT o_orderkey AS run_id, o_custkey AS group_id, unnest([1, o_custkey % 6 + 1]) AS number FROM orders)
    SELECT g.run_id, group_id, g.number, finding_id, CASE WHEN finding_id IS NULL THEN 'unknown_number' END AS violation FROM g LEFT JOIN n ON g.run_id = n.run_id AND g.number = n.number""")
def resolve_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("group_id"), F.array(F.lit(1).cast("long"), F.col("o_custkey") % 6 + 1).alias("numbers"))
    return worksheet.resolve_groups(groups, _found(spark, sf))


@query("worksheet_select_scope", f"""WITH {_FOUND}, w AS (SELECT DISTINCT run_id, finding_id + CASE WHEN finding_id % 2 = 0 THEN 1 ELSE 0 END AS finding_id FROM found WHERE run_id % 3 = 0)
    SELECT w.run_id, w.finding_id, CASE WHEN f.finding_id IS NULL THEN 'foreign_finding' END AS violation FROM w LEFT JOIN (SELECT DISTINCT * FROM found) f ON f.run_id = w.run_id AND f.finding_id = w.finding_id
    UNION ALL SELECT run_id, finding_id, NULL FROM found WHERE run_id NOT IN (SELECT run_id FROM w)""")
def select_scope(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf)
    wanted = found.where("run_id % 3 = 0").select("run_id", (F.col("finding_id") + F.when(F.col("finding_id") % 2 == 0, 1).otherwise(0)).alias("finding_id"))
    return worksheet.select_scope(found, wanted)
