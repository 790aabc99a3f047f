"""Queries on what judging rests on: documents stand for recorded files and prepared texts, customers for cells and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import evidence
from clausemill.plans.dataset import _pick, _union
from clausemill.plans.registry import query, table


@query("evidence_file_rules", """WITH p AS (SELECT doc_id % 4 AS series, doc_id AS k, CASE doc_id % 6 WHEN 0 THEN '/abs/' || doc_id WHEN 1 THEN 'a/../../' || doc_id WHEN 2 THEN 'a/b/../' || doc_id ELSE 'd/./' || doc_id END AS path, sha256(text) AS h FROM documents), q AS (SELECT *, series || '/' || path AS key FROM p),
    d AS (SELECT * FROM q WHERE k % 7 <> 0) """ + _union("d", "key", {"path_outside": "k % 6 < 2", "file_missing": "k % 5 = 0", "sha256_mismatch": ("k % 5 <> 0 AND k % 9 = 0", "h")}) + " UNION ALL SELECT 'hash_undeclared', key, '' FROM q WHERE k % 7 = 0 AND k % 2 = 0")
def file_rules(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    path = F.when(k % 6 == 0, F.concat(F.lit("/abs/"), s)).when(k % 6 == 1, F.concat(F.lit("a/../../"), s)).when(k % 6 == 2, F.concat(F.lit("a/b/../"), s)).otherwise(F.concat(F.lit("d/./"), s))
    files = table(spark, sf, "documents").select((k % 4).alias("series"), k.alias("k"), path.alias("path"), F.sha2("text", 256).alias("sha256"))
    declared = files.where("k % 7 <> 0").withColumn("sha256", F.when(F.col("k") % 9 == 0, "x").otherwise(F.col("sha256")))
    return evidence.file_rules(declared, files.where("k % 5 <> 0"), files.where("k % 2 = 0"))


_GRID = """s AS (SELECT n_nationkey AS series, ['recorded', 'recorded', 'planned', 'odd'][n_nationkey % 4 + 1] AS state FROM nation), c AS (SELECT c_nationkey AS series, c_custkey AS k, unnest(['off', 'mid', 'on']) AS arm, unnest([0, 1, 2]) AS a FROM customer),
    g AS (SELECT c.*, c.series || '/' || k || '/' || arm AS key, (k + a) % 5 > 0 AS held FROM c JOIN s USING (series) WHERE state = 'recorded'), h AS (SELECT * FROM g WHERE held), t AS (SELECT series, sum(CASE WHEN k % 8 > 0 THEN k % 4 END) AS total FROM h GROUP BY 1)"""


@query("evidence_grid_rules", f"WITH {_GRID} " + " UNION ALL ".join([
    "SELECT 'state_undefined' AS rule, series::VARCHAR AS key, state AS detail FROM s WHERE state = 'odd'", "SELECT 'run_missing', key, '' FROM g WHERE NOT held",
    _union("h", "key", {"document_hash_differs": "k % 11 = 0", "arm_mismatch": "k % 13 = a", "not_measured": "k % 3 = 0 OR k % 10 = 1", "snapshot_missing": "k % 9 < 2", "findings_missing": "k % 8 = 0"}),
    "SELECT 'findings_recorded', s.series::VARCHAR, coalesce(total, 0)::VARCHAR FROM s LEFT JOIN t USING (series) WHERE state = 'recorded' AND s.series % 3 > 0 AND coalesce(total, 0) <> 5",
]))
def grid_rules(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    series = table(spark, sf, "nation").select(n.alias("series"), _pick(n, "recorded", "recorded", "planned", "odd").alias("state"), F.when(n % 3 > 0, 5).alias("findings_recorded"))
    customers = table(spark, sf, "customer")
    cohort = customers.select(F.col("c_nationkey").alias("series"), k.alias("document_key"), F.sha2("c_name", 256).alias("content_sha256"))
    cells = customers.select(F.col("c_nationkey").alias("series"), k.alias("document_key"), "c_name", F.posexplode(F.array(*map(F.lit, evidence.ARMS))).alias("a", "arm")).where("(document_key + a) % 5 > 0")
    d = F.col("document_key")
    runs = cells.select(
        "series", "document_key", "arm", F.when(d % 13 == F.col("a"), "other").otherwise(F.col("arm")).alias("recorded_arm"), F.when(d % 3 == 0, "failed").otherwise("completed").alias("status"), (d % 10 != 1).alias("measurement_valid"),
        F.when(d % 11 == 0, "x").otherwise(F.sha2("c_name", 256)).alias("document_sha256"), F.when(d % 9 == 0, "").when(d % 9 > 1, "s").alias("snapshot_id"), F.when(d % 8 > 0, d % 4).alias("findings"),
    )
    return evidence.grid_rules(series, ["recorded", "planned"], cohort, runs)


_BUNDLE = "d AS (SELECT doc_id AS k, doc_id::VARCHAR AS key FROM documents), p AS (SELECT page_id AS k, 'a' || page_id % 9 || '/' || page_id AS key FROM pages)"


@query("evidence_bundle_rules", f"WITH {_BUNDLE} " + _union("d", "key", {"document_text_missing": "k % 5 = 0 OR k % 5 = 1", "document_hash_differs": "k % 5 > 1 AND k % 3 = 0"}) + " UNION ALL " + _union("p", "key", {
    "provision_text_missing": "k % 7 = 0", "provision_hash_differs": "k % 7 > 0 AND k % 4 = 0", "provision_key_differs": ("k % 6 < 3 AND k > 0", "CASE WHEN k % 6 = 0 THEN 'a' || k % 9 || '/0' ELSE 'null' END"),
}) + " UNION ALL SELECT 'act_undeclared', act, '' FROM (SELECT DISTINCT 'a' || page_id % 9 AS act FROM pages) WHERE act > 'a5'")
def bundle_rules(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("doc_id"), F.col("page_id")
    documents = table(spark, sf, "documents").select(k.cast("string").alias("key"), F.when(k % 5 == 0, "").when(k % 5 > 1, F.col("text")).alias("text"), F.when(k % 3 == 0, "x").otherwise(F.sha2("text", 256)).alias("content_sha256"))
    act = F.concat(F.lit("a"), (p % 9).cast("string"))
    key = F.concat(act, F.lit("/"), p.cast("string"))
    locator = F.when(p % 6 == 0, F.concat(F.lit("law:"), act, F.lit("/0"))).when(p % 6 == 1, key).when(p % 6 > 2, F.concat(F.lit("law:"), key))
    provisions = table(spark, sf, "pages").select(key.alias("key"), locator.alias("locator"), F.when(p % 7 > 0, F.col("html")).alias("text"), F.when(p % 4 == 0, "x").otherwise(F.sha2("html", 256)).alias("content_sha256"))
    return evidence.bundle_rules(documents, provisions, "law:(a[0-9]+/[0-9]+)", table(spark, sf, "pages").select(act.alias("act")), spark.range(6).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("act")))


@query("evidence_binding_rules", """WITH r AS (SELECT o_custkey AS key, list(DISTINCT 's' || CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 2 ELSE o_custkey % 4 END) AS seen FROM orders GROUP BY 1),
    b AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 6 <> 5 THEN 's' || c_custkey % 4 END AS id, coalesce(seen, []) AS seen FROM customer LEFT JOIN r ON r.key = c_custkey WHERE c_custkey % 7 > 0)
    SELECT 'snapshot_not_searched' AS rule, key::VARCHAR AS key, array_to_string(list_sort(seen), ',') AS detail FROM b WHERE list_sort(seen) <> [coalesce(id, '')]""")
def binding_rules(spark: SparkSession, sf: str) -> DataFrame:
    c, o = F.col("c_custkey"), F.col("o_custkey")
    runs = table(spark, sf, "orders").select(o.alias("key"), F.concat(F.lit("s"), F.when(o % 3 == 0, F.col("o_orderkey") % 2).otherwise(o % 4).cast("string")).alias("snapshot_id"))
    bundles = table(spark, sf, "customer").select(c.alias("key"), F.when(c % 6 != 5, F.concat(F.lit("s"), (c % 4).cast("string"))).alias("snapshot_id"), F.when(c % 14 != 0, c % 7 > 0).alias("snapshot_verified"))
    return evidence.binding_rules(bundles, runs)


_KEYS = """k AS (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS key FROM nation), i AS (SELECT p_size % 25 AS key, p_partkey AS k, CASE WHEN p_partkey % 17 > 0 THEN p_partkey // 3 END AS item_id, p_partkey % 30 AS document_key FROM part WHERE p_size % 25 < 24),
    n AS (SELECT *, key || '/' || coalesce(item_id::VARCHAR, 'null') AS named FROM i), c AS (SELECT n_nationkey AS key, unnest(range(0, 20)) AS document_key FROM nation)"""


@query("evidence_key_rules", f"WITH {_KEYS} " + " UNION ALL ".join([
    _union("k", "key", {"key_hash_differs": ("k % 3 = 0 AND k % 6 > 0", "'h' || k"), "no_items": "k = 24"}),
    _union("n", "named", {"item_id_missing": "item_id IS NULL", "item_unsettled": "k % 5 < 2", "item_document_unknown": "document_key >= 20"}),
    "SELECT 'duplicate_item', named, count(*)::VARCHAR FROM n WHERE item_id IS NOT NULL GROUP BY named HAVING count(*) > 1",
    "SELECT 'document_hash_differs', key || '/' || document_key, CASE WHEN document_key % 4 = 0 THEN 'null' ELSE 'x' END FROM c WHERE document_key % 4 = 0 OR (key + document_key) % 7 = 0",
]))
def key_rules(spark: SparkSession, sf: str) -> DataFrame:
    n, p = F.col("n_nationkey"), F.col("p_partkey")
    hashed = lambda c: F.sha2(c.cast("string"), 256)
    nation = table(spark, sf, "nation")
    keys = nation.select(n.alias("key"), F.concat(F.lit("h"), n.cast("string")).alias("sha256"), F.when(n % 3 == 0, F.when(n % 6 == 0, F.concat(F.lit("h"), n.cast("string"))).otherwise("p")).alias("pinned_sha256"))
    items = table(spark, sf, "part").where("p_size % 25 < 24").select((F.col("p_size") % 25).alias("key"), F.when(p % 17 > 0, F.expr("p_partkey div 3")).alias("item_id"), F.when(p % 5 == 0, "open").otherwise("scored").alias("status"), F.when(p % 5 == 1, 0).otherwise(2).alias("n_answers"), (p % 30).alias("document_key"))
    cohort = nation.select(n.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("document_key")).withColumn("content_sha256", hashed(F.col("document_key")))
    d = F.col("document_key")
    documents = cohort.where("document_key % 4 > 0").select("key", "document_key", F.when((F.col("key") + d) % 7 == 0, "x").otherwise(hashed(d)).alias("content_hash"))
    return evidence.key_rules(keys, items, documents, cohort)
