"""Queries on attempts, batches, replies, dataset rules and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import quality, retrieval, runs, scoring
from clausemill.plans.core import _RUNS_SQL, _runs
from clausemill.plans.registry import query, table

# ---------------------------------------------------------------- runs

_ATTEMPTS = """attempts AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, CASE WHEN l_suppkey % 9 <> 0 THEN l_quantity::BIGINT - 3 END AS tokens,
    CASE WHEN l_partkey % 8 = 0 THEN 'Bad-' ELSE 'ok_' END || lower(l_returnflag) AS code, CASE WHEN l_partkey % 3 = 0 THEN l_tax END AS cost, l_partkey % 6 = 0 AS cost_known, 'm' || (l_suppkey % 2) AS model,
    CASE l_partkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 400 END AS status FROM lineitem)"""


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber").cast("long") * 1000000000 + p * 10000 + s).alias("seq"),
        F.when(s % 9 != 0, F.col("l_quantity").cast("long") - 3).alias("tokens"),
        F.concat(F.when(p % 8 == 0, "Bad-").otherwise("ok_"), F.lower("l_returnflag")).alias("code"),
        F.when(p % 3 == 0, F.col("l_tax")).alias("cost"),
        (p % 6 == 0).alias("cost_known"),
        F.concat(F.lit("m"), (s % 2).cast("string")).alias("model"),
        F.when(p % 5 == 0, 200).when(p % 5 == 1, 429).when(p % 5 == 2, 503).when(p % 5 == 3, 400).alias("status"),
    )


@query("runs_rules", f"""WITH {_ATTEMPTS} SELECT 'negative_counter' AS rule, run_id::VARCHAR AS key, seq::VARCHAR AS detail FROM attempts WHERE tokens < 0 UNION ALL SELECT 'bad_code', run_id::VARCHAR, seq::VARCHAR FROM attempts WHERE code LIKE 'Bad%'
    UNION ALL SELECT 'cost_known_mismatch', run_id::VARCHAR, seq::VARCHAR FROM attempts WHERE (cost IS NOT NULL) <> cost_known""")
def run_rules(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_rules(_attempts(spark, sf))


@query("runs_flags", f"WITH {_RUNS_SQL}, {_ATTEMPTS}, a AS (SELECT run_id, bool_and(tokens IS NOT NULL) AS r FROM attempts GROUP BY 1) SELECT run_id, runs.status = 'running' AS interrupted, coalesce(r, false) AS metrics_available FROM runs LEFT JOIN a USING (run_id)")
def run_flags(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_flags(_runs(spark, sf), _attempts(spark, sf))


@query("runs_attempt_outcomes", f"""WITH {_ATTEMPTS}, t AS (SELECT *, status IS NULL OR status IN (429, 503) AS retry, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS nth FROM attempts),
    e AS (SELECT run_id, least(coalesce(min(nth) FILTER (WHERE NOT retry), 4), 4) AS stop FROM t GROUP BY 1), k AS (SELECT t.* FROM t JOIN e USING (run_id) WHERE nth <= stop)
    SELECT run_id AS request_id, count(*) AS n_attempts, arg_max(CASE WHEN status IS NULL THEN 'transport' WHEN status = 200 THEN 'success' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server_error' ELSE 'rejected' END, nth) AS outcome,
    arg_max(retry, nth) AS retryable, sum(tokens)::BIGINT AS tokens FROM k GROUP BY 1""")
def attempt_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return runs.attempt_outcomes(_attempts(spark, sf).withColumnRenamed("run_id", "request_id"), 4)


@query("runs_identity_drift", f"""WITH {_ATTEMPTS}, g AS (SELECT run_id, count(DISTINCT model) AS m, count(*) FILTER (WHERE tokens IS NULL) AS u FROM attempts GROUP BY 1)
    SELECT 'model_drift' AS rule, run_id::VARCHAR AS key, m::VARCHAR AS detail FROM g WHERE m > 1 UNION ALL SELECT 'usage_missing', run_id::VARCHAR, u::VARCHAR FROM g WHERE u > 0""")
def identity_drift(spark: SparkSession, sf: str) -> DataFrame:
    return runs.identity_drift(_attempts(spark, sf))


@query("runs_unprocessed", f"""WITH {_RUNS_SQL}, u AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS unit_id FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS unit_id FROM lineitem WHERE l_tax > 0.03),
    r AS (SELECT run_id, count(*) AS n FROM u ANTI JOIN f USING (run_id, unit_id) GROUP BY 1) SELECT run_id, coalesce(n, 0) AS unprocessed FROM runs LEFT JOIN r USING (run_id) WHERE status = 'failed'""")
def unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("unit_id"), "l_tax")
    return runs.unprocessed(_runs(spark, sf), line, line.where("l_tax > 0.03"))


@query("runs_spend", "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user' AND turn % 3 <> 0) AS searches, count(*) FILTER (WHERE role = 'user' AND turn % 3 = 0) AS cache_hits, count(*) FILTER (WHERE role = 'assistant' AND turn % 5 <> 0) AS reads, count(*) FILTER (WHERE role = 'assistant' AND turn % 5 = 0) AS defaulted, sum(length(text))::BIGINT AS characters FROM conversations GROUP BY 1")
def spend(spark: SparkSession, sf: str) -> DataFrame:
    user, turn = F.col("role") == "user", F.col("turn")
    kind = F.when(user & (turn % 3 == 0), "cache_hit").when(user, "search").when((F.col("role") == "assistant") & (turn % 5 == 0), "default").when(F.col("role") == "assistant", "read")
    return runs.spend(table(spark, sf, "conversations").withColumn("kind", kind), ["conv_id"])


@query("runs_merge_summaries", f"""WITH {_RUNS_SQL}, c AS (SELECT document_id, arm, series % 2 AS batch, count(*) AS n FROM runs GROUP BY 1, 2, 3), a AS (SELECT document_id, arm, n FROM c WHERE batch = 0), b AS (SELECT document_id, arm, n FROM c WHERE batch = 1)
    SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (document_id, arm)""")
def merge_summaries(spark: SparkSession, sf: str) -> DataFrame:
    each = _runs(spark, sf).groupBy("document_id", "arm", (F.col("series") % 2).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return runs.merge_summaries(each.where("batch = 0").drop("batch"), each.where("batch = 1").drop("batch"), ["document_id", "arm"])


@query("runs_batch_members", """WITH b AS (SELECT o_custkey AS batch_id, o_orderkey AS run_id FROM orders), j AS (SELECT batch_id, run_id, run_id % 9 <> 0 AND run_id % 4 <> 0 AND run_id IN (SELECT l_orderkey FROM lineitem) AS held FROM b)
    SELECT 'missing_in_store' AS rule, run_id::VARCHAR AS key FROM j WHERE NOT held AND run_id % 9 <> 0 UNION ALL SELECT DISTINCT 'unreadable', batch_id::VARCHAR FROM j WHERE run_id % 9 = 0 UNION ALL SELECT 'empty_batch', batch_id::VARCHAR FROM j GROUP BY batch_id HAVING NOT bool_or(held)""")
def batch_members(spark: SparkSession, sf: str) -> DataFrame:
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("run_id"))
    return runs.batch_members(batch, table(spark, sf, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("run_id")))


@query("runs_pair_check", f"""WITH {_RUNS_SQL}, c AS (SELECT document_id, count(*) FILTER (WHERE arm = 'off') AS a, count(*) FILTER (WHERE arm = 'mid') AS b, count(DISTINCT stratum) FILTER (WHERE arm IN ('off', 'mid')) AS n FROM runs GROUP BY 1)
    SELECT document_id AS input_hash, CASE WHEN a = 0 OR b = 0 THEN 'skipped' WHEN n = 1 THEN 'ok' ELSE 'mismatch' END AS state FROM c""")
def pair_check(spark: SparkSession, sf: str) -> DataFrame:
    return runs.pair_check(_runs(spark, sf).withColumnRenamed("document_id", "input_hash"), "off", "mid", ["stratum"])


@query("runs_clean_cohort", "SELECT DISTINCT sha256(text) AS case_id FROM documents EXCEPT SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0")
def clean_cohort(spark: SparkSession, sf: str) -> DataFrame:
    artifacts = table(spark, sf, "documents").select(F.sha2("text", 256).alias("case_id"), F.col("doc_id").alias("artifact_id"))
    return runs.clean_cohort(artifacts, table(spark, sf, "labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("artifact_id")))


# ---------------------------------------------------------------- scoring

_PACKETS = """x AS (SELECT l_orderkey AS packet_id, l_suppkey AS finding_id FROM lineitem WHERE l_returnflag <> 'R'), y AS (SELECT l_orderkey AS packet_id, l_suppkey AS finding_id FROM lineitem WHERE l_linestatus = 'F')"""


def _packets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet_id"), F.col("l_suppkey").alias("finding_id"), "l_returnflag", "l_linestatus")
    return rows.where("l_returnflag <> 'R'"), rows.where("l_linestatus = 'F'")


@query("scoring_reply_membership", f"""WITH {_PACKETS}, a AS (SELECT packet_id, finding_id, count(*) AS n FROM y GROUP BY 1, 2), e AS (SELECT DISTINCT *, 1 AS asked FROM x),
    j AS (SELECT packet_id, finding_id, CASE WHEN asked IS NULL THEN 'not_asked' WHEN n IS NULL THEN 'not_answered' WHEN n > 1 THEN 'answered_twice' END AS rule FROM e FULL JOIN a USING (packet_id, finding_id)) SELECT rule, packet_id, finding_id FROM j WHERE rule IS NOT NULL""")
def reply_membership(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.reply_membership(*_packets(spark, sf))


@query("scoring_completeness", f"""WITH {_PACKETS}, e AS (SELECT DISTINCT * FROM x), h AS (SELECT DISTINCT *, 1 AS h FROM y)
    SELECT packet_id, count(*) AS expected, count(*) - count(h) AS missing, count(*) = count(h) AS complete FROM e LEFT JOIN h USING (packet_id, finding_id) GROUP BY 1""")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.completeness(*_packets(spark, sf))


@query("scoring_mixed_instrument", "SELECT user_id, count(DISTINCT event_type) AS adapters FROM events WHERE value > 10 GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def mixed_instrument(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.mixed_instrument(table(spark, sf, "events").select("user_id", F.col("event_type").alias("adapter"), (F.col("value") > 10).alias("valid")), ["user_id"])


@query("scoring_key_gaps", "SELECT l_orderkey AS run_id, l_suppkey AS finding_id FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 4 <> 0")
def key_gaps(spark: SparkSession, sf: str) -> DataFrame:
    matches = F.when(F.col("l_partkey") % 4 == 0, F.array("l_partkey")).when(F.col("l_partkey") % 4 == 1, F.array().cast("array<bigint>"))
    status = F.when(F.col("l_returnflag") == "A", "correct").otherwise("incorrect")
    return scoring.key_gaps(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("finding_id"), status.alias("status"), matches.alias("matches")))


@query("scoring_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT l_returnflag AS tag FROM lineitem WHERE l_partkey % 3 = 0 UNION ALL SELECT l_linestatus FROM lineitem UNION ALL SELECT 'late' FROM lineitem WHERE l_partkey % 3 = 0) GROUP BY 1")
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    judge = F.when(F.col("l_partkey") % 3 == 0, F.array(F.col("l_returnflag"), F.lit("late")))
    return scoring.tag_counts(table(spark, sf, "lineitem").select(judge.alias("judge_tags"), F.array("l_linestatus").alias("rule_tags")))


@query("scoring_pending", "SELECT o_orderkey AS packet_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    attempts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet_id"), (F.col("l_returnflag") == "A").alias("valid"))
    return scoring.pending(table(spark, sf, "orders").select(F.col("o_orderkey").alias("packet_id")), attempts)


# ---------------------------------------------------------------- retrieval and data quality


@query("retrieval_phrase_rules", r"SELECT CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'phrase_empty' ELSE 'phrase_too_long' END AS rule, item_id::VARCHAR AS key FROM benchmark WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR length(text) > 500")
def phrase_rules(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.phrase_rules(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("retrieval_spaces_agree", """SELECT a.vec_id AS key, coalesce(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) >= 0.5, false) AS agree
    FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def spaces_agree(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("key"), F.col("embedding").alias("a")).join(vectors.select((F.col("vec_id") - 1).alias("key"), F.col("embedding").alias("b")), "key")
    return retrieval.spaces_agree(pairs, 0.5)


@query("retrieval_lookup", "WITH k AS (SELECT DISTINCT doc_id * 2 AS unit_id FROM documents) SELECT unit_id, substr(text, 1, 300) AS snippet, CASE WHEN doc_id IS NULL THEN 'unit_not_found' END AS error FROM k LEFT JOIN documents ON doc_id = unit_id")
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return retrieval.lookup(docs.select((F.col("doc_id") * 2).alias("unit_id")), docs.select(F.col("doc_id").alias("unit_id"), "text"))


@query("retrieval_place_responses", """WITH r AS (SELECT l_orderkey AS request_id, count(*) AS got, count(DISTINCT l_linenumber - 1) AS d, max(l_linenumber - 1) AS hi FROM lineitem GROUP BY 1), q AS (SELECT o_orderkey AS request_id, o_custkey % 6 + 1 AS n FROM orders)
    SELECT request_id, n, CASE WHEN hi >= n THEN 'index_out_of_range' WHEN d < got THEN 'index_repeated' WHEN coalesce(got, 0) < n THEN 'index_missing' END AS error FROM q LEFT JOIN r USING (request_id)""")
def place_responses(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 6 + 1).alias("n"))
    return retrieval.place_responses(requests, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") - 1).alias("idx")))


@query("quality_entry_rules", """SELECT 'stratum_unknown' AS rule, doc_id::VARCHAR AS key FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src1', 'src2') UNION ALL SELECT 'language_unknown', doc_id::VARCHAR FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')
    UNION ALL SELECT 'not_measured', doc_id::VARCHAR FROM documents WHERE n_chars IS NULL UNION ALL SELECT 'duplicate_id', doc_id::VARCHAR FROM documents GROUP BY doc_id HAVING count(*) > 1""")
def entry_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.entry_rules(table(spark, sf, "documents").withColumnRenamed("source", "stratum"), ["src0", "src1", "src2"], ["en", "de"])


@query("quality_provenance_rules", """SELECT CASE WHEN doc_id % 5 = 0 THEN 'no_record' WHEN doc_id % 7 = 0 THEN 'hash_differs' ELSE 'size_differs' END AS rule, doc_id::VARCHAR AS key FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0""")
def provenance_rules(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").alias("n_bytes"))
    stored = entries.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("content_hash")).alias("content_hash"), (F.col("n_bytes") + (F.col("doc_id") % 11 == 0).cast("int")).alias("n_bytes"))
    return quality.provenance_rules(entries, stored)


@query("quality_path_diff", "WITH a AS (SELECT DISTINCT url AS path FROM pages WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT url AS path FROM pages WHERE page_id % 4 <> 0) SELECT 'not_stored' AS rule, path FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'not_listed', path FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def path_diff(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id")
    return quality.path_diff(pages.where("page_id % 3 <> 0"), pages.where("page_id % 4 <> 0"))


@query("quality_split_rules", """WITH a AS (SELECT o_custkey AS case_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY 1), f AS (SELECT c_custkey AS case_id, 1 AS f FROM customer WHERE c_custkey % 9 <> 0), j AS (SELECT * FROM a FULL JOIN f USING (case_id))
    SELECT 'not_frozen' AS rule, case_id FROM j WHERE f IS NULL UNION ALL SELECT 'case_missing', case_id FROM j WHERE n IS NULL UNION ALL SELECT 'canonical_count', case_id FROM j WHERE n <> 1""")
def split_rules(spark: SparkSession, sf: str) -> DataFrame:
    artifacts = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("canonical"))
    return quality.split_rules(artifacts, table(spark, sf, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("case_id")))
