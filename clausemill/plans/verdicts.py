"""Queries on verdicts, anchors, grounding, controls and batches; order lines stand for candidates and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import decision, retrieval, runs, structure, verdicts
from clausemill.plans.core import _LINES, _SPARSE
from clausemill.plans.registry import query, table
from clausemill.sources.staging import dealt


def _of(names: list[str | None], n):
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def _ids() -> list:
    return [F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")]


_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_CANDIDATES = f"""c AS (SELECT {_KEY} AS key, ['in_force', 'not_in_force', 'undetermined'][l_partkey % 3 + 1] AS act, CASE WHEN l_suppkey % 4 = 0 THEN 'not_in_force' ELSE 'undetermined' END AS prov,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 3 = 1 END AS relevant, l_partkey % 5 AS cleared, CASE WHEN l_suppkey % 3 <> 0 THEN 0.5 END AS conf FROM lineitem), cf AS (SELECT *, CASE WHEN prov = 'not_in_force' THEN prov ELSE act END AS force FROM c)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        *_ids(), _of(["in_force", "not_in_force", "undetermined"], p % 3).alias("act_force"), F.when(s % 4 == 0, "not_in_force").otherwise("undetermined").alias("provision_force"),
        F.when(n % 3 != 0, n % 3 == 1).alias("relevant"), (p % 5).alias("candidates_cleared"), F.when(s % 3 != 0, 0.5).alias("raw_confidence"),
    )


@query("verdicts_candidate_findings", f"""WITH {_CANDIDATES} SELECT key, force, CASE WHEN cleared = 0 THEN 'no_basis_found' WHEN NOT relevant THEN 'no_relation' WHEN relevant IS NULL OR force = 'undetermined' THEN CASE WHEN conf IS NOT NULL THEN 'uncertain' END WHEN force = 'not_in_force' THEN 'basis_not_in_force' END AS code,
    CASE WHEN cleared = 0 OR NOT relevant THEN NULL WHEN relevant IS NULL OR force = 'undetermined' THEN CASE WHEN conf IS NULL THEN 'confidence_missing' END WHEN force = 'in_force' THEN 'character_missing' END AS violation FROM cf""")
def candidate_findings(spark: SparkSession, sf: str) -> DataFrame:
    return decision.resolve_finding(verdicts.candidate_facts(_candidates(spark, sf))).select("key", "force", "code", "violation")


_BASES = f"""b AS (SELECT {_KEY} AS key, ['imperative', 'semi_imperative', 'dispositive', 'undetermined'][l_partkey % 4 + 1] AS character, CASE WHEN l_suppkey % 2 = 0 THEN 'tenant' END AS d, ['none', 'present', 'undetermined'][l_linenumber % 3 + 1] AS departure,
    ['with_permitted_direction', 'against_permitted_direction', 'undetermined', NULL][l_orderkey % 4 + 1] AS direction, CASE WHEN l_suppkey % 3 <> 0 THEN 0.5 END AS conf FROM lineitem)"""


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(
        *_ids(), F.lit("in_force").alias("force"), _of(["imperative", "semi_imperative", "dispositive", "undetermined"], p % 4).alias("character"), F.when(s % 2 == 0, "tenant").alias("semi_imperative_direction"),
        _of(["none", "present", "undetermined"], n % 3).alias("departure"), _of(["with_permitted_direction", "against_permitted_direction", "undetermined", None], F.col("l_orderkey") % 4).alias("direction"), F.lit(1).alias("candidates_cleared"), F.when(s % 3 != 0, 0.5).alias("raw_confidence"),
    )
    return verdicts.basis_facts(rows)


@query("verdicts_basis_findings", f"""WITH {_BASES}, u AS (SELECT *, CASE WHEN departure = 'undetermined' THEN 'u' WHEN character = 'undetermined' THEN 'u' WHEN character = 'semi_imperative' AND d IS NULL THEN 'u' WHEN departure = 'none' THEN 'consistent' WHEN character = 'imperative' THEN 'contradictory'
      WHEN character = 'dispositive' THEN 'permissible_departure' WHEN direction IS NULL THEN 'm' WHEN direction = 'undetermined' THEN 'u' WHEN direction = 'with_permitted_direction' THEN 'permissible_departure' ELSE 'contradictory' END AS x FROM b)
    SELECT key, CASE WHEN x = 'u' THEN CASE WHEN conf IS NOT NULL THEN 'uncertain' END WHEN x <> 'm' THEN x END AS code, CASE WHEN x = 'u' AND conf IS NULL THEN 'confidence_missing' WHEN x = 'm' THEN 'direction_missing' END AS violation FROM u""")
def basis_findings(spark: SparkSession, sf: str) -> DataFrame:
    return decision.resolve_finding(_bases(spark, sf)).select("key", "code", "violation")


@query("verdicts_guards", f"""WITH {_BASES} SELECT 'confidence_missing' AS rule, key FROM b WHERE conf IS NULL AND (departure = 'undetermined' OR character = 'undetermined' OR (character = 'semi_imperative' AND (d IS NULL OR (departure = 'present' AND direction = 'undetermined'))))
    UNION ALL SELECT 'direction_missing', key FROM b WHERE departure = 'present' AND character = 'semi_imperative' AND d IS NOT NULL AND direction IS NULL""")
def guards(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.verdict_guards(_bases(spark, sf))


@query("verdicts_settle", f"""WITH {_CANDIDATES} SELECT key, CASE WHEN relevant IS NULL OR (relevant AND force <> 'in_force') THEN CASE WHEN conf IS NULL AND cleared > 0 AND (relevant IS NULL OR force = 'undetermined') THEN 'refused' ELSE 'finding' END WHEN NOT relevant THEN 'none' ELSE 'continue' END AS outcome FROM cf""")
def settle(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.settle(verdicts.candidate_facts(_candidates(spark, sf))).select("key", "outcome")


@query("verdicts_record_rules", f"""WITH r AS (SELECT {_KEY} AS key, ['imperative', 'semi_imperative', 'dispositive', 'undetermined'][l_partkey % 4 + 1] AS kind, l_suppkey % 3 AS n, l_suppkey % 10 = 0 AS blank, CASE WHEN l_linenumber % 2 = 0 THEN 'x' END AS d, CASE l_orderkey % 3 WHEN 0 THEN 'why' WHEN 1 THEN ' ' END AS why,
      ['uncertain', 'consistent'][l_partkey % 2 + 1] AS code, CASE WHEN l_suppkey % 2 = 0 THEN 'c' END AS cause, CASE WHEN l_orderkey % 2 = 0 THEN 0.5 END AS conf, ['in_force', 'undetermined'][l_linenumber % 2 + 1] AS a, ['not_in_force', 'undetermined'][l_partkey % 2 + 1] AS p FROM lineitem), s AS (SELECT *, coalesce(trim(why), '') <> '' AS w FROM r)
    SELECT unnest(list_filter([CASE WHEN kind = 'undetermined' AND n > 0 THEN 'undetermined_with_evidence' END, CASE WHEN kind = 'undetermined' AND NOT w THEN 'undetermined_without_reason' END, CASE WHEN kind <> 'semi_imperative' AND d IS NOT NULL THEN 'direction_not_applicable' END,
      CASE WHEN kind <> 'undetermined' AND n = 0 THEN 'evidence_missing' END, CASE WHEN blank THEN 'evidence_blank' END, CASE WHEN kind = 'semi_imperative' AND (d IS NOT NULL) = w THEN 'semi_imperative_needs_one' END, CASE WHEN kind IN ('imperative', 'dispositive') AND w THEN 'reason_not_applicable' END,
      CASE WHEN code = 'uncertain' AND cause IS NULL THEN 'uncertain_without_cause' END, CASE WHEN code = 'uncertain' AND conf IS NULL THEN 'uncertain_without_confidence' END, CASE WHEN code <> 'uncertain' AND cause IS NOT NULL THEN 'cause_not_applicable' END, CASE WHEN code <> 'uncertain' AND conf IS NOT NULL THEN 'confidence_not_applicable' END,
      CASE WHEN a <> 'in_force' THEN 'basis_not_admitted' END, CASE WHEN p = 'not_in_force' THEN 'basis_vetoed' END], lambda x: x IS NOT NULL)) AS rule, key FROM s""")
def record_rules(spark: SparkSession, sf: str) -> DataFrame:
    p, s, n, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_orderkey")
    rows = table(spark, sf, "lineitem").select(
        *_ids(), _of(["imperative", "semi_imperative", "dispositive", "undetermined"], p % 4).alias("kind"), (s % 3).alias("n_evidence"), (s % 10 == 0).alias("evidence_blank"), F.when(n % 2 == 0, "x").alias("direction"), F.when(o % 3 == 0, "why").when(o % 3 == 1, " ").alias("reason"),
        _of(["uncertain", "consistent"], p % 2).alias("code"), F.when(s % 2 == 0, "c").alias("cause"), F.when(o % 2 == 0, 0.5).alias("raw_confidence"), _of(["in_force", "undetermined"], n % 2).alias("act_force"), _of(["not_in_force", "undetermined"], p % 2).alias("provision_force"),
    )
    return verdicts.record_rules(rows)


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    lines = structure.line_anchors(table(spark, sf, "documents"))
    return lines.select("doc_id", F.col("line").alias("idx"), F.floor((F.col("line") - 1) / 3).alias("page"), "start_offset", "end_offset")


@query("verdicts_anchor_findings", f"""WITH {_LINES}, a AS (SELECT doc_id, line, (line - 1) // 3 AS page, sum(length(piece)) OVER w - length(piece) AS s, sum(length(piece)) OVER w AS e FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    f AS (SELECT {_KEY} AS key, l_orderkey % 200 AS doc_id, l_linenumber % 3 AS unit, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 90 END AS q FROM lineitem),
    p AS (SELECT key, doc_id, CASE WHEN q IS NOT NULL THEN q WHEN unit <> 0 THEN unit * 40 END AS start_offset, CASE WHEN q IS NOT NULL THEN q + 5 WHEN unit <> 0 THEN unit * 40 + 40 END AS end_offset, CASE WHEN q IS NOT NULL THEN 'quote' WHEN unit <> 0 THEN 'unit' END AS source FROM f JOIN documents USING (doc_id))
    SELECT key, p.doc_id, start_offset, end_offset, source, min(page) AS page FROM p LEFT JOIN a ON a.doc_id = p.doc_id AND start_offset >= s AND start_offset < e GROUP BY ALL""")
def anchor_findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    units = docs.select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("unit_id")).select("doc_id", "unit_id", (F.col("unit_id") * 40).alias("start"), (F.col("unit_id") * 40 + 40).alias("end"), (F.col("unit_id") == 0).alias("whole"))
    quote = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 90)
    found = table(spark, sf, "lineitem").select(*_ids(), (F.col("l_orderkey") % 200).alias("doc_id"), (F.col("l_linenumber") % 3).alias("unit_id"), quote.alias("quote_start"), (quote + 5).alias("quote_end"))
    return verdicts.anchor_findings(dealt(found.where("doc_id is not null"), "key").distinct(), units, _anchors(spark, sf), docs)


_SELECTED = f"""s AS (SELECT DISTINCT {_KEY} AS finding_id, l_orderkey % 250 AS doc_id, l_linenumber AS unit_id, ['p' || l_partkey % 60, 'p' || l_suppkey % 7] AS locs FROM lineitem WHERE l_returnflag = 'R'), law AS (SELECT DISTINCT 'p' || p_partkey % 45 AS locator FROM part)"""


@query("verdicts_ground", f"""WITH {_SELECTED} SELECT finding_id, 'unit' AS kind, s.unit_id::VARCHAR AS ref, sha256(text) AS text_sha256, CASE WHEN text IS NULL THEN 'unknown_unit' END AS error FROM s LEFT JOIN documents d ON d.doc_id = s.doc_id AND s.unit_id < 5
    UNION ALL SELECT finding_id, 'provision', r, CASE WHEN locator IS NOT NULL THEN sha256('text of ' || r) END, CASE WHEN locator IS NULL THEN 'provision_missing' END FROM (SELECT DISTINCT finding_id, unnest(locs) AS r FROM s) LEFT JOIN law ON locator = r""")
def ground(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c, n: F.concat(F.lit("p"), (F.col(c) % n).cast("string"))
    line = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    selected = line.select(*_ids(), (F.col("l_orderkey") % 250).alias("doc_id"), F.col("l_linenumber").alias("unit_id"), F.array(name("l_partkey", 60), name("l_suppkey", 7)).alias("locators")).distinct().withColumnRenamed("key", "finding_id")
    units = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("unit_id"), "text")
    law = table(spark, sf, "part").select(name("p_partkey", 45).alias("locator")).distinct().withColumn("text", F.concat(F.lit("text of "), F.col("locator")))
    got = verdicts.ground(selected, units, law)
    return got.select("finding_id", "kind", "ref", F.sha2("text", 256).alias("text_sha256"), "error")


_CONTROL = """r AS (SELECT user_id % 40 AS case_id, user_id % 40 <> 7 AS known, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'validated' END AS status, CASE WHEN user_id % 40 < 30 THEN 'same' ELSE event_type END AS answer, CASE WHEN user_id % 40 = 3 AND event_id % 50 = 0 THEN 'other' ELSE 'c1' END AS configuration,
    CASE WHEN user_id % 40 = 5 AND event_id % 2 = 0 THEN 'b' ELSE 'a' END AS adapter FROM events), g AS (SELECT case_id, min(attempt) FILTER (WHERE status = 'validated') AS attempt, arg_min(answer, attempt) FILTER (WHERE status = 'validated') AS answer, count(*) FILTER (WHERE status <> 'validated') AS failures,
    CASE WHEN bool_or(configuration <> 'c1') THEN 'other_configuration' WHEN count(DISTINCT adapter) FILTER (WHERE status = 'validated') > 1 THEN 'second_adapter' WHEN count(DISTINCT answer) FILTER (WHERE status = 'validated') > 1 THEN 'conflicting_verdicts' END AS rule FROM r WHERE known GROUP BY 1)"""


def _control(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    case = F.col("user_id") % 40
    rows = table(spark, sf, "events").select(
        case.alias("case_id"), (case != 7).alias("known"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "error", "failed").otherwise("validated").alias("status"), F.when(case < 30, "same").otherwise(F.col("event_type")).alias("answer"),
        F.when((case == 3) & (F.col("event_id") % 50 == 0), "other").otherwise("c1").alias("configuration"), F.when((case == 5) & (F.col("event_id") % 2 == 0), "b").otherwise("a").alias("adapter"),
    )
    return verdicts.control_selected(rows, "c1")


@query("verdicts_control_selected", f"WITH {_CONTROL} SELECT case_id, attempt, answer, failures FROM g WHERE rule IS NULL")
def control_selected(spark: SparkSession, sf: str) -> DataFrame:
    return _control(spark, sf)[0]


@query("verdicts_control_refused", f"WITH {_CONTROL} SELECT rule, case_id::VARCHAR AS key FROM g WHERE rule IS NOT NULL")
def control_refused(spark: SparkSession, sf: str) -> DataFrame:
    return _control(spark, sf)[1]


@query("verdicts_batch_integrity", f"""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS doc_id, ['off', 'mid', 'on', 'odd'][o_orderkey % 4 + 1] AS arm, o_orderstatus, o_orderkey % 9 <> 0 AS valid, CASE WHEN o_orderkey % 13 <> 0 THEN 's' END AS snap, CASE WHEN o_custkey % 3 = 0 THEN 'x' ELSE sha256(text) END AS h, sha256(text) AS real, coalesce(o_custkey % 6, 0) AS declared FROM orders LEFT JOIN documents ON doc_id = o_custkey),
    n AS (SELECT l_orderkey AS run_id, count(*) AS found FROM lineitem GROUP BY 1), j AS (SELECT r.*, coalesce(found, 0) AS found FROM r LEFT JOIN n USING (run_id))
    SELECT unnest(list_filter([CASE WHEN real IS NULL THEN 'document_unknown' END, CASE WHEN real IS NOT NULL AND h <> real THEN 'document_hash_differs' END, CASE WHEN arm = 'odd' THEN 'arm_unknown' END, CASE WHEN o_orderstatus <> 'F' THEN 'not_completed' END, CASE WHEN NOT valid THEN 'measurement_invalid' END, CASE WHEN snap IS NULL THEN 'snapshot_missing' END,
      CASE WHEN declared <> found THEN 'finding_count_differs' END], lambda x: x IS NOT NULL)) AS rule, run_id::VARCHAR AS key FROM j
    UNION ALL SELECT 'duplicate_run', o_orderkey::VARCHAR FROM orders GROUP BY o_orderkey HAVING count(*) > 1 UNION ALL SELECT 'duplicate_finding', {_KEY} FROM lineitem GROUP BY 2 HAVING count(*) > 1""")
def batch_integrity(spark: SparkSession, sf: str) -> DataFrame:
    docs, o = table(spark, sf, "documents"), F.col("o_orderkey")
    all_runs = table(spark, sf, "orders").join(docs.select(F.col("doc_id").alias("o_custkey"), F.sha2("text", 256).alias("real")), "o_custkey", "left").select(
        o.alias("run_id"), F.col("o_custkey").alias("doc_id"), _of(["off", "mid", "on", "odd"], o % 4).alias("arm"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), (o % 9 != 0).alias("measurement_valid"),
        F.when(o % 13 != 0, "s").alias("snapshot_id"), F.when(F.col("o_custkey") % 3 == 0, "x").otherwise(F.col("real")).alias("document_hash"), (F.col("o_custkey") % 6).alias("declared_findings"),
    )
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), _ids()[0].alias("finding_id"))
    return verdicts.batch_integrity(all_runs, found, docs)


@query("verdicts_key_rules", """WITH i AS (SELECT p_size AS item_id, p_partkey AS document_key, ['p' || p_partkey % 20, CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE 'q' || p_size % 5 END] AS bases FROM part), b AS (SELECT DISTINCT item_id || '/' || b AS key, b FROM (SELECT item_id, unnest(bases) AS b FROM i))
    SELECT 'duplicate_item' AS rule, item_id::VARCHAR AS key, 1 AS n FROM i GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT 'document_unknown', item_id::VARCHAR, count(*) FROM i WHERE document_key NOT IN (SELECT doc_id FROM documents) GROUP BY 2
    UNION ALL SELECT 'basis_malformed', key, 1 FROM b WHERE b = 'none' UNION ALL SELECT 'act_undeclared', key, 1 FROM b WHERE b LIKE 'q%'""")
def key_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    items = table(spark, sf, "part").select(F.col("p_size").alias("item_id"), p.alias("document_key"), F.array(F.concat(F.lit("p"), (p % 20).cast("string")), F.when(p % 9 == 0, "none").otherwise(F.concat(F.lit("q"), (F.col("p_size") % 5).cast("string")))).alias("accepted_bases"))
    got = verdicts.key_rules(items, table(spark, sf, "documents"), "([pq])[0-9]+", spark.createDataFrame([("p",)], "act string"))
    return got.groupBy("rule", "key").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("runs_detail", """WITH n AS (SELECT l_orderkey, count(*) AS f, count(*) FILTER (WHERE l_returnflag = 'N') AS np FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS run_id, 'a' || o_custkey AS artifact_id, ['off', 'mid', 'on'][o_orderkey % 3 + 1] AS arm, CASE WHEN o_orderkey % 5 <> 0 THEN format('{:.1f}', (o_orderkey * 100) / 1000.0) ELSE '—' END AS elapsed_s, CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 4)::VARCHAR ELSE '—' END AS input_tokens, '—' AS output_tokens,
    coalesce(f, 0) AS findings, coalesce(np, 0) AS not_processed, o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN ' (invalid)' ELSE '' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'unknown, because price table unavailable' END AS cost FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def run_detail(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    all_runs = table(spark, sf, "orders").select(
        o.alias("run_id"), F.concat(F.lit("a"), c.cast("string")).alias("artifact_id"), _of(["off", "mid", "on"], o % 3).alias("arm"), F.when(o % 5 != 0, o * 100).alias("elapsed_ms"), (c % 4).cast("int").alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"),
        F.col("o_orderstatus").alias("status"), (o % 7 != 0).alias("measurement_valid"), F.when(o % 2 != 0, "no_price").alias("cost_unknown_reason"), c.alias("cost_microunits"),
    )
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "N", "not_processed").otherwise("consistent").alias("code"))
    return runs.run_detail(all_runs, found)


@query("runs_config_parity", """WITH c AS (SELECT c_custkey AS key, unnest(['model', 'corpus', 'prompt']) AS field, unnest(['m' || c_nationkey % 3, CASE WHEN c_custkey % 5 <> 0 THEN 'k' END, c_mktsegment]) AS value FROM customer)
    SELECT 'uncovered_field' AS rule, '' AS key, 'provider' AS detail UNION ALL SELECT 'differs_from_series_1', key::VARCHAR, field FROM c WHERE (field = 'model' AND value IS DISTINCT FROM 'm1') OR (field = 'corpus' AND value IS DISTINCT FROM 'k')
    UNION ALL SELECT 'required_value_missing', key::VARCHAR, field FROM c WHERE field = 'prompt' AND value <> 'BUILDING'""")
def config_parity(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    values = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("model", F.concat(F.lit("m"), (F.col("c_nationkey") % 3).cast("string"))), ("corpus", F.when(F.col("c_custkey") % 5 != 0, "k")), ("prompt", F.col("c_mktsegment")))])
    configs = c.select(F.col("c_custkey").alias("key"), F.inline(values))
    pairs = lambda rows: spark.createDataFrame(rows, "field string, value string")
    return runs.config_parity(configs, pairs([("model", "m1"), ("corpus", "k")]), pairs([("prompt", "BUILDING")]), ["model", "corpus", "prompt", "provider"])


_HYBRID = f"""{_SPARSE}, v AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN embedding::DOUBLE[]])) FOR x IN embedding::DOUBLE[]] AS u FROM embeddings), dq AS (SELECT vec_id AS query_id, u AS w FROM v WHERE vec_id IN (SELECT item_id FROM benchmark)),
    d0 AS (SELECT query_id, vec_id AS unit_id, round(list_dot_product(u, w), 6) AS score FROM v, dq), d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM d0 QUALIFY rank <= 5),
    f AS (SELECT query_id, unit_id, round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 9) AS score, coalesce(s.score, 0) AS sparse_score, coalesce(d.score, 0) AS dense_score FROM sparse s FULL JOIN d USING (query_id, unit_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sha256(unit_id::VARCHAR)) AS rank FROM f)"""


@query("retrieval_hybrid_search", f"WITH {_HYBRID} SELECT query_id, rank, unit_id, r.score, sparse_score, dense_score, lang FROM r JOIN documents ON doc_id = unit_id WHERE rank <= 5")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts against documents: BM25 of the texts, and the vectors of the same numbers."""
    docs, asks = table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    texts = docs.select(F.col("doc_id").alias("unit_id"), "text")
    sparse = retrieval.pruned_topk(retrieval.build_index(texts), retrieval.query_terms(asks), 5, texts.agg(F.count(F.lit(1)).alias("n")))
    units = retrieval.unit_vectors(table(spark, sf, "embeddings"), 64)
    queries = units.join(asks.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "unit")
    return retrieval.hybrid_search(sparse, retrieval.dense_topk(units, queries, 5), docs.select(F.col("doc_id").alias("unit_id"), "lang"), 5)


@query("retrieval_bad_vectors", "SELECT CASE WHEN vec_id % 6 = 0 THEN 'missing' WHEN vec_id % 6 = 1 THEN 'wrong_width' ELSE 'zero_length' END AS rule, vec_id::VARCHAR AS key FROM embeddings WHERE vec_id % 6 < 3")
def bad_vectors(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("vec_id") % 6, F.col("embedding")
    changed = F.when(k == 1, F.slice(e, 1, 10)).when(k == 2, F.transform(e, lambda x: x * 0)).when(k > 2, e)
    return retrieval.bad_vectors(table(spark, sf, "embeddings").select("vec_id", changed.alias("embedding")), 64)
