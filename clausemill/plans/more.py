"""Queries on summaries, repeats, locators, reuse, views and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import corpus, retrieval, runs, scoring, structure, worksheet
from clausemill.plans import core
from clausemill.plans.registry import query, table
from clausemill.streaming import events as streams

_S = core._RUNS_SQL


@query("runs_pair_counts", f"""WITH {_S}, c AS (SELECT document_id, count(*) FILTER (WHERE arm = 'off') AS a, count(*) FILTER (WHERE arm = 'mid') AS b, count(DISTINCT stratum) FILTER (WHERE arm IN ('off', 'mid')) AS n FROM runs GROUP BY 1),
    s AS (SELECT count(*) FILTER (WHERE a > 0 AND b > 0 AND n = 1) AS ok, count(*) FILTER (WHERE a > 0 AND b > 0 AND n > 1) AS mismatch, count(*) FILTER (WHERE a = 0 OR b = 0) AS skipped FROM c) SELECT *, ok > 0 AND mismatch = 0 AS passed FROM s""")
def pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return runs.pair_counts(runs.pair_check(core._runs(spark, sf).withColumnRenamed("document_id", "input_hash"), "off", "mid", ["stratum"]))


_SUMMARY = f"""{_S}, {core._FIND_SQL}, n AS (SELECT run_id, string_agg(code || ':' || n, ',' ORDER BY code || ':' || n) AS codes FROM (SELECT run_id, code, count(*) AS n FROM findings GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT r.run_id, r.arm, r.status, o_orderdate - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS finished_at, coalesce(codes, '') AS codes FROM runs r JOIN orders ON run_id = o_orderkey LEFT JOIN n ON n.run_id = r.run_id)"""


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    finished = F.when(F.col("o_orderkey") % 2 == 0, F.concat(at, F.lit("+02:00"))).otherwise(F.concat(at, F.lit("Z")))
    times = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), finished.alias("finished"))
    return runs.arm_summary(core._runs(spark, sf).join(times, "run_id"), core._findings(spark, sf, raw=False))


@query("runs_arm_summary", f"WITH {_SUMMARY} SELECT * FROM s")
def arm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf)


@query("runs_latest_finish", f"WITH {_SUMMARY} SELECT arm, max(finished_at) AS finished_at FROM s GROUP BY 1")
def latest_finish(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest_finish(_summary(spark, sf), ["arm"])


@query("structure_segment_violations", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END AS text FROM documents) SELECT CASE WHEN NOT regexp_matches(text, '\S') THEN 'empty_document' ELSE 'no_units' END AS rule, doc_id::VARCHAR AS key FROM d WHERE NOT regexp_matches(text, '\S') OR doc_id % 7 = 3""")
def segment_violations(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text")).alias("text"))
    return structure.segment_violations(docs, structure.window_units(structure.sentences(docs)).where("doc_id % 7 <> 3"))


_REPEATS = "r AS (SELECT o_custkey AS act_id, year(o_orderdate)::VARCHAR AS article, count(*) AS printings FROM orders GROUP BY 1, 2 HAVING count(*) > 1)"


def _repeats(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "orders").select(F.col("o_custkey").alias("act_id"), F.col("o_orderkey").alias("pos"), F.year("o_orderdate").cast("string").alias("article"))
    return corpus.repeats(corpus.printings(units))


@query("corpus_repeats", f"WITH {_REPEATS} SELECT * FROM r")
def repeats(spark: SparkSession, sf: str) -> DataFrame:
    return _repeats(spark, sf)


@query("corpus_repeat_drift", f"""WITH {_REPEATS}, p AS (SELECT c_custkey AS act_id, '1995' AS article, 1 + c_custkey % 3 AS pinned FROM customer WHERE c_custkey % 2 = 0)
    SELECT CASE WHEN pinned IS NULL THEN 'repeat_not_pinned' WHEN printings IS NULL THEN 'pin_not_repeated' ELSE 'printings_differ' END AS rule, act_id || '/' || article AS key, concat_ws(':', printings, pinned) AS detail FROM r FULL JOIN p USING (act_id, article) WHERE pinned IS NULL OR printings IS NULL OR pinned <> printings""")
def repeat_drift(spark: SparkSession, sf: str) -> DataFrame:
    pinned = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("act_id"), F.lit("1995").alias("article"), (1 + F.col("c_custkey") % 3).alias("printings"))
    return corpus.repeat_drift(_repeats(spark, sf), pinned)


@query("corpus_locators", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE 'eli/' || replace(p_brand, '#', '-') || '#article=' || p_size || CASE WHEN p_partkey % 3 = 1 THEN '&printing=' || p_partkey % 4 ELSE '' END END AS locator,
    CASE WHEN p_partkey % 6 <> 0 THEN replace(p_brand, '#', '-') END AS act, CASE WHEN p_partkey % 6 <> 0 THEN p_size::VARCHAR END AS article, CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 3 = 1 THEN (p_partkey % 4)::INT END AS printing FROM part""")
def locators(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.translate("p_brand", "#", "-").alias("act"), F.col("p_size").cast("string").alias("article"), F.when(k % 3 == 1, k % 4).alias("printing"))
    built = rows.select("p_partkey", F.when(k % 6 == 0, F.col("p_name")).otherwise(corpus.build_locator("eli/")).alias("locator"))
    return built.withColumn("p", corpus.parse_locator("locator", "eli/")).select("p_partkey", "locator", "p.act", "p.article", "p.printing")


@query("retrieval_query_reuse", """SELECT event_id, row_number() OVER w > 1 AS hit, CASE WHEN row_number() OVER w > 1 THEN first(event_id) OVER w END AS source FROM events WINDOW w AS (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id)""")
def query_reuse(spark: SparkSession, sf: str) -> DataFrame:
    asks = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 2).alias("snapshot_id"))
    return retrieval.query_reuse(asks, "user_id", ["event_type", "snapshot_id"], "event_id").select("event_id", "hit", "source")


@query("retrieval_token_bill", "SELECT o_orderpriority AS space, count(*) AS requests, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END)::BIGINT AS tokens FROM orders GROUP BY 1")
def token_bill(spark: SparkSession, sf: str) -> DataFrame:
    batches = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("space"), F.when(~F.col("o_orderpriority").startswith("1") & (F.col("o_orderkey") % 3 != 0), F.col("o_custkey")).alias("tokens"))
    return retrieval.token_bill(batches, ["space"])


_CODES = ("contradictory", "uncertain", "consistent", "not_processed", "basis_not_in_force", "no_relation")
_CODED = f"c AS (SELECT l_orderkey AS run_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS finding_id, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 5 END AS block, {list(_CODES)}[l_partkey % 6 + 1] AS code FROM lineitem)"


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 5).alias("block"), F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_partkey") % 6 + 1).cast("int")).alias("code")
    )


@query("worksheet_prominence_counts", f"WITH {_CODED} SELECT run_id, CASE WHEN code IN ('contradictory', 'basis_not_in_force') THEN 'critical' WHEN code IN ('uncertain', 'not_processed') THEN 'warning' ELSE 'neutral' END AS prominence, count(*) AS n FROM c GROUP BY 1, 2")
def prominence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return worksheet.prominence_counts(_coded(spark, sf), ["run_id"])


@query("worksheet_unplaced", f"WITH {_CODED} SELECT run_id, string_agg(finding_id, ',' ORDER BY finding_id) AS finding_ids FROM c WHERE block IS NULL GROUP BY 1")
def unplaced(spark: SparkSession, sf: str) -> DataFrame:
    return worksheet.unplaced(_coded(spark, sf), ["run_id"]).withColumn("finding_ids", F.array_join("finding_ids", ","))


@query("worksheet_role_view", "SELECT conv_id, conv_id % 3 AS for_candidate, turn AS seq, CASE WHEN role = 'user' THEN 'note' ELSE 'verdict' END AS kind, length(text)::INT AS value FROM conversations WHERE role = 'user' OR turn % 3 = conv_id % 3")
def role_view(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "conversations").select(
        "conv_id", (F.col("conv_id") % 3).alias("for_candidate"), (F.col("turn") % 3).alias("candidate_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "note").otherwise("verdict").alias("kind"), F.length("text").alias("value"), F.col("role").alias("author")
    )
    return worksheet.role_view(log, ["conv_id"], "verifier")


@query("stream_counters", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def counters(spark: SparkSession, sf: str) -> DataFrame:
    return streams.counters(table(spark, sf, "events"))


_FIELDS = {"view": ["k"], "click": ["k", "more"], "purchase": ["k"], "signup": ["k"]}


@query("stream_dead_letters", """WITH e AS (SELECT event_id, event_type, json_keys(props) AS k, ts IS NULL OR user_id IS NULL AS gone, value < 0 AS neg FROM events), w AS (SELECT *, CASE event_type WHEN 'click' THEN ['k', 'more'] WHEN 'view' THEN ['k'] WHEN 'purchase' THEN ['k'] WHEN 'signup' THEN ['k'] ELSE [] END AS want FROM e)
    SELECT event_id, CASE WHEN gone THEN 'missing_field' WHEN neg THEN 'negative_value' WHEN len(list_filter(want, lambda x: NOT list_contains(k, x))) > 0 THEN 'field_missing' ELSE 'field_unknown' END AS violation FROM w WHERE gone OR neg OR list_sort(k) <> list_sort(want)""")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return streams.split_valid(table(spark, sf, "events"), _FIELDS)[1].select("event_id", "violation")


_DISPOSED = """f AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'consistent' WHEN 'R' THEN 'contradictory' ELSE 'uncertain' END AS code FROM lineitem WHERE l_linenumber < 4),
    d AS (SELECT *, CASE WHEN code = 'uncertain' THEN 'non_substantive' WHEN row_number() OVER w > 1 THEN 'exact_duplicate' ELSE 'judged' END AS disposition, CASE WHEN code <> 'uncertain' AND row_number() OVER w > 1 THEN first(l_linenumber) OVER w END AS original FROM f WINDOW w AS (PARTITION BY l_orderkey, code ORDER BY l_linenumber))"""


def _disposed(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", "consistent").when(F.col("l_returnflag") == "R", "contradictory").otherwise("uncertain")
    rows = table(spark, sf, "lineitem").where("l_linenumber < 4").select("l_orderkey", "l_linenumber", code.alias("code")).distinct()
    return scoring.dispositions(rows, ["l_orderkey", "code"], "l_linenumber")


@query("scoring_accounting", f"WITH {_DISPOSED} SELECT code, count(*) AS recorded, count(*) FILTER (WHERE disposition = 'judged') AS judged, count(*) FILTER (WHERE disposition = 'exact_duplicate') AS exact_duplicate, count(*) FILTER (WHERE disposition = 'non_substantive') AS non_substantive FROM d GROUP BY 1")
def accounting(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.accounting(_disposed(spark, sf), ["code"])


@query("scoring_outcomes", f"WITH {_DISPOSED} SELECT l_orderkey, l_linenumber, code, disposition, original, CASE WHEN disposition <> 'judged' THEN disposition WHEN l_orderkey % 3 = 0 THEN 'correct' ELSE 'pending' END AS status FROM d")
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    key, rows = ["l_orderkey", "l_linenumber", "code"], _disposed(spark, sf)
    return scoring.outcomes(rows, rows.where("disposition = 'judged' and l_orderkey % 3 = 0").select(*key, F.lit("correct").alias("status")), key)


_CASES = """c AS (SELECT l.doc_id AS case_id, quality = 0 AS breach, ['consistent', 'contradictory', 'permissible_departure'][l.doc_id % 3 + 1] AS code, CASE WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS reference, CASE WHEN l.doc_id % 11 <> 0 THEN CASE WHEN length(text) > 300 THEN 'correct' ELSE 'incorrect' END END AS judge,
    l.doc_id % 4 AS rm, CASE WHEN l.doc_id % 6 = 0 THEN 9 ELSE l.doc_id % 4 END AS jm, l.doc_id % 2 AS failures FROM labels l JOIN documents USING (doc_id)), t AS (SELECT count(*) AS cases, count(judge) AS validated, count(*) FILTER (WHERE judge = reference) AS overall_agreements,
    count(*) FILTER (WHERE judge IS NULL OR rm <> jm) AS key_match_disagreements, count(*) FILTER (WHERE breach AND code <> 'contradictory' AND judge = 'correct') AS false_reassurances, sum(failures)::BIGINT AS technical_failures FROM c)"""


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        d.alias("case_id"), (F.col("quality") == 0).alias("clear_breach"), F.element_at(F.array(*map(F.lit, ("consistent", "contradictory", "permissible_departure"))), (d % 3 + 1).cast("int")).alias("code"),
        F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("reference_status"), F.when(d % 11 != 0, F.when(F.length("text") > 300, "correct").otherwise("incorrect")).alias("judge_status"),
        F.array(d % 4).alias("reference_matches"), F.array(F.when(d % 6 == 0, 9).otherwise(d % 4)).alias("judge_matches"), (d % 2).alias("failures"),
    )
    return scoring.control_totals(rows)


@query("scoring_control_totals", f"WITH {_CASES} SELECT * FROM t")
def control_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf)


@query("scoring_acceptance", f"""WITH {_CASES} SELECT 'case_count' AS name, 100 AS threshold, cases AS observed, cases = 100 AS passed FROM t UNION ALL SELECT 'cases_validated', cases, validated, validated = cases FROM t UNION ALL SELECT 'overall_agreements', 10, overall_agreements, overall_agreements >= 10 FROM t
    UNION ALL SELECT 'key_match_disagreements', 1, key_match_disagreements, key_match_disagreements <= 1 FROM t UNION ALL SELECT 'false_reassurances', 50000, false_reassurances, false_reassurances <= 50000 FROM t""")
def acceptance(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.acceptance(_totals(spark, sf), {"case_count": 100, "minimum_overall_agreements": 10, "maximum_key_match_disagreements": 1, "maximum_false_reassurances": 50000})
