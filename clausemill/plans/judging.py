"""Queries on what is judged; order lines stand for recorded findings, parts for key items, documents for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import judging
from clausemill.plans import core
from clausemill.plans.registry import query, table
from clausemill.sources.staging import staged

_CODES = (*judging.SUBSTANTIVE, *judging.NON_SUBSTANTIVE, "strange")
_RAW = f"""raw AS (SELECT 1 + l_orderkey % 2 AS series, l_orderkey % 150 AS document_key, ['off', 'mid', 'on'][l_orderkey % 3 + 1] AS arm,
      CASE WHEN l_partkey % 50 <> 0 THEN l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS finding_id, {list(_CODES)}[l_partkey % 10 + 1] AS code,
      CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey % 40 END AS start, l_suppkey % 40 + l_linenumber * 3 - 4 AS "end", CASE WHEN l_suppkey % 9 = 0 THEN 'quote_fabricated' ELSE 'resolved' END AS quote_resolution,
      list_filter(['p' || l_partkey % 20, '', 'p' || l_suppkey % 20, CASE WHEN l_linenumber % 2 = 0 THEN 'q' || l_partkey % 20 WHEN l_linenumber % 5 = 0 THEN 'section 4' END], lambda x: x <> '') AS every FROM lineitem),
    findings AS (SELECT DISTINCT series, document_key, arm, finding_id, code, start, "end", quote_resolution, list_sort(list_distinct(every)) AS locators FROM raw WHERE finding_id IS NOT NULL AND code <> 'strange')"""
_KEY = """items AS (SELECT p_partkey AS item_id, p_partkey % 150 AS document_key, p_size % 7 = 0 AS outside, ['p' || p_partkey % 20, 'q' || p_size % 9] AS bases FROM part),
    accepted AS (SELECT DISTINCT item_id, unnest(bases) AS locator FROM items WHERE NOT outside)"""
_PROBLEMS = f"""{_RAW}, {_KEY}, provisions AS (SELECT DISTINCT 'p' || p_partkey % 13 AS locator FROM part), claims AS (SELECT DISTINCT finding_id, unnest(locators) AS locator FROM findings),
    problems AS (SELECT finding_id, locator, CASE WHEN NOT regexp_matches(locator, '^[pq][0-9]+$') OR (locator NOT IN (SELECT locator FROM accepted WHERE item_id % 150 < 30) AND locator[1] = 'p') THEN 'uncitable' ELSE 'unprepared' END AS problem
      FROM claims WHERE locator NOT IN (SELECT locator FROM provisions))"""


def _pick(names: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    name = lambda letter, c: F.concat(F.lit(letter), (c % 20).cast("string"))
    return table(spark, sf, "lineitem").select(
        (1 + F.col("l_orderkey") % 2).alias("series"),
        (F.col("l_orderkey") % 150).alias("document_key"),
        _pick(("off", "mid", "on"), F.col("l_orderkey") % 3).alias("arm"),
        F.when(p % 50 != 0, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("finding_id"),
        _pick(_CODES, p % 10).alias("code"),
        F.when(s % 4 != 0, s % 40).cast("int").alias("start"),
        (s % 40 + n * 3 - 4).cast("int").alias("end"),
        F.when(s % 9 == 0, "quote_fabricated").otherwise("resolved").alias("quote_resolution"),
        F.array(name("p", p), F.lit(""), name("p", s)).alias("legal_locators"),
        F.when(n % 2 == 0, name("q", p)).when(n % 5 == 0, "section 4").alias("basis_locator"),
    )


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings, dealt by id, which what follows groups and joins by."""
    return judging.scored_findings(_raw(spark, sf))[0].repartition("finding_id").distinct()


def _items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    bases = F.array(F.concat(F.lit("p"), (F.col("p_partkey") % 20).cast("string")), F.concat(F.lit("q"), (F.col("p_size") % 9).cast("string")))
    return p.select(
        F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 150).alias("document_key"), (F.col("p_size") % 7 == 0).alias("outside_snapshot"),
        F.array(F.struct(F.lit("consistent").alias("code"), bases.alias("accepted_bases"))).alias("answers"), F.array_sort(bases).alias("accepted_bases"),
    )


def _problems(spark: SparkSession, sf: str, findings: DataFrame | None = None) -> DataFrame:
    provisions = table(spark, sf, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 13).cast("string")).alias("locator"))
    acts = spark.createDataFrame([("p", True), ("q", False)], "act string, prepared boolean")
    accepted = judging.accepted_bases(_items(spark, sf)).where("item_id % 150 < 30")
    return judging.basis_problems(_findings(spark, sf) if findings is None else findings, provisions, acts, accepted, "([pq])[0-9]+")


@query("judging_scored_findings", f"""WITH {_RAW} SELECT series, document_key, arm, finding_id, code, start, "end", quote_resolution, array_to_string(locators, ',') AS locators FROM findings""")
def scored_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).withColumn("locators", F.array_join("locators", ","))


@query("judging_finding_violations", f"""WITH {_RAW}, d AS (SELECT DISTINCT * FROM raw) SELECT CASE WHEN finding_id IS NULL THEN 'id_missing' ELSE 'code_unknown' END AS rule, concat_ws('/', series, document_key, arm, finding_id) AS key, count(*) AS n
    FROM (SELECT * FROM d WHERE finding_id IS NULL OR code = 'strange') GROUP BY 1, 2""")
def finding_violations(spark: SparkSession, sf: str) -> DataFrame:
    return judging.scored_findings(_raw(spark, sf).distinct())[1].groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))


@query("judging_accepted_bases", f"WITH {_KEY} SELECT item_id, locator FROM accepted")
def accepted_bases(spark: SparkSession, sf: str) -> DataFrame:
    return judging.accepted_bases(_items(spark, sf))


@query("judging_basis_problems", f"WITH {_PROBLEMS} SELECT * FROM problems")
def basis_problems(spark: SparkSession, sf: str) -> DataFrame:
    return _problems(spark, sf)


_VIEWS = f"""{_PROBLEMS}, views AS (SELECT f.*, CASE WHEN start >= 0 AND start < "end" AND "end" <= length(text) THEN substr(text, start + 1, "end" - start) END AS quoted_text, coalesce(absent, []) AS absent FROM findings f JOIN documents ON doc_id = document_key
    LEFT JOIN (SELECT finding_id, list(locator ORDER BY locator) AS absent FROM problems WHERE problem = 'uncitable' GROUP BY 1) USING (finding_id))"""


def _views(spark: SparkSession, sf: str) -> DataFrame:
    return judging.finding_views(_findings(spark, sf), table(spark, sf, "documents"), _problems(spark, sf))


@query("judging_finding_views", f"""WITH {_VIEWS} SELECT series, document_key, arm, finding_id, code, start, "end", quoted_text, array_to_string(locators, ',') AS claimed_bases, array_to_string(absent, ',') AS absent_bases,
    'required' AS legal_basis, 'not_applicable' AS explanation FROM views""")
def finding_views(spark: SparkSession, sf: str) -> DataFrame:
    got = _views(spark, sf)
    return got.withColumns({c: F.array_join(c, ",") for c in ("claimed_bases", "absent_bases")})


_LIMIT = 60_000
_PACKETS = f"""{_VIEWS}, held AS (SELECT 'p' || p_partkey % 13 AS locator, min(p_name) AS text FROM part GROUP BY 1), run AS (SELECT DISTINCT series, document_key, arm FROM views WHERE code IN {judging.SUBSTANTIVE}),
    f AS (SELECT series, document_key, arm, list({{'finding_id': finding_id, 'code': code, 'start': start, 'end': "end", 'quoted_text': quoted_text, 'claimed_bases': locators, 'absent_bases': absent}} ORDER BY finding_id) AS findings FROM views WHERE code IN {judging.SUBSTANTIVE} GROUP BY ALL),
    k AS (SELECT document_key, list({{'item_id': item_id, 'accepted_bases': list_sort(bases)}} ORDER BY item_id) AS key_items FROM items GROUP BY 1),
    w AS (SELECT DISTINCT series, document_key, arm, unnest(locators) AS locator FROM views WHERE code IN {judging.SUBSTANTIVE} UNION SELECT series, document_key, arm, unnest(bases) FROM run JOIN items USING (document_key)),
    h AS (SELECT series, document_key, arm, list({{'locator': locator, 'text': text}} ORDER BY locator) AS provisions FROM w JOIN held USING (locator) GROUP BY ALL),
    m AS (SELECT series, document_key, arm, string_agg(DISTINCT locator, ',' ORDER BY locator) AS missing FROM views JOIN problems USING (finding_id) WHERE problem = 'unprepared' AND code IN {judging.SUBSTANTIVE} GROUP BY ALL),
    body AS (SELECT f.series, f.document_key, f.arm, missing, to_json({{'document': {{'document_key': f.document_key, 'text': text}}, 'findings': findings, 'key_items': coalesce(key_items, []), 'provisions': coalesce(provisions, [])}})::VARCHAR AS payload
      FROM f JOIN documents ON doc_id = f.document_key LEFT JOIN k USING (document_key) LEFT JOIN h ON f.series = h.series AND f.document_key = h.document_key AND f.arm = h.arm LEFT JOIN m ON f.series = m.series AND f.document_key = m.document_key AND f.arm = m.arm)"""


def _packets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    provisions = part.groupBy(F.concat(F.lit("p"), (F.col("p_partkey") % 13).cast("string")).alias("locator")).agg(F.min("p_name").alias("text"))
    findings = staged(_findings(spark, sf))
    problems, docs = staged(_problems(spark, sf, findings)), table(spark, sf, "documents")
    return judging.packets(judging.finding_views(findings, docs, problems), docs, _items(spark, sf), provisions, problems, _LIMIT)


@query("judging_packets", f"WITH {_PACKETS} SELECT series, document_key, arm, substr(sha256(payload), 1, 16) AS packet_id, length(payload) AS n_chars FROM body WHERE missing IS NULL AND length(payload) <= {_LIMIT}")
def packets(spark: SparkSession, sf: str) -> DataFrame:
    return _packets(spark, sf)[0].select("series", "document_key", "arm", "packet_id", F.length("payload").alias("n_chars"))


@query("judging_refused_packets", f"WITH {_PACKETS} SELECT CASE WHEN missing IS NOT NULL THEN 'source_missing' ELSE 'packet_too_large' END AS rule, concat_ws('/', series, document_key, arm) AS key, coalesce(missing, length(payload)::VARCHAR) AS detail FROM body WHERE missing IS NOT NULL OR length(payload) > {_LIMIT}")
def refused_packets(spark: SparkSession, sf: str) -> DataFrame:
    return _packets(spark, sf)[1]


_VERDICTS = r"""v AS (SELECT doc_id AS packet_id, doc_id AS finding_id, ['correct', 'incorrect', 'unresolved'][doc_id % 3 + 1] AS classification, ['supported', 'unresolved', 'not_applicable', 'unsupported'][doc_id % 4 + 1] AS legal_basis,
      CASE WHEN doc_id % 11 = 0 THEN 'supported' ELSE 'not_applicable' END AS explanation FROM documents),
    m AS (SELECT doc_id AS packet_id, doc_id AS finding_id, unnest([doc_id % 5, doc_id % 3]) AS item_id FROM documents), i AS (SELECT doc_id AS packet_id, unnest([0, 1, 2, doc_id % 5]) AS item_id FROM documents WHERE doc_id % 6 <> 0),
    e AS (SELECT doc_id AS packet_id, doc_id AS finding_id, CASE doc_id % 7 WHEN 0 THEN 'law' WHEN 1 THEN 'elsewhere' ELSE 'document' END AS source,
      CASE WHEN doc_id % 5 = 0 THEN 'not in any source' ELSE '  ' || replace(coalesce(substr(text, 5, 30), ''), ' ', chr(10) || ' ') END AS quote FROM documents WHERE doc_id % 4 <> 1),
    s AS (SELECT doc_id AS packet_id, 'document' AS source, text FROM documents UNION ALL SELECT doc_id, 'law', 'x' || text || 'y' FROM documents WHERE doc_id % 2 = 0),
    fold AS (SELECT e.*, s.text IS NULL AS absent, trim(regexp_replace(s.text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS a, trim(regexp_replace(quote, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS b FROM e LEFT JOIN s USING (packet_id, source)),
    c AS (SELECT v.*, e.source AS cited, v.packet_id % 2 = 0 AS offers FROM v LEFT JOIN e USING (packet_id)), out AS (
    SELECT 'item_not_in_packet' AS rule, packet_id, item_id::VARCHAR AS detail FROM m WHERE (packet_id, item_id) NOT IN (SELECT packet_id, item_id FROM i) UNION ALL SELECT 'item_named_twice', packet_id, item_id::VARCHAR FROM m GROUP BY packet_id, item_id HAVING count(*) > 1
    UNION ALL SELECT 'source_not_in_packet', packet_id, source FROM fold WHERE absent UNION ALL SELECT 'quote_not_in_source', packet_id, source FROM fold WHERE NOT absent AND NOT contains(a, b)
    UNION ALL SELECT 'decided_without_evidence', packet_id, '' FROM c WHERE cited IS NULL AND (classification <> 'unresolved' OR legal_basis IN ('supported', 'unsupported') OR explanation = 'supported')
    UNION ALL SELECT 'basis_without_provision', packet_id, '' FROM c WHERE legal_basis IN ('supported', 'unsupported') AND offers AND cited = 'document'
    UNION ALL SELECT 'criterion_required', packet_id, 'legal_basis' FROM c WHERE legal_basis = 'not_applicable' UNION ALL SELECT 'criterion_not_applicable', packet_id, 'explanation' FROM c WHERE explanation <> 'not_applicable')"""


@query("judging_verdict_rules", f"WITH {_VERDICTS} SELECT rule, packet_id || '/' || packet_id AS key, detail FROM out")
def verdict_rules(spark: SparkSession, sf: str) -> DataFrame:
    d, i = table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    ids = (i.alias("packet_id"), i.alias("finding_id"))
    verdicts = d.select(
        *ids, _pick(("correct", "incorrect", "unresolved"), i % 3).alias("classification"), _pick(("supported", "unresolved", "not_applicable", "unsupported"), i % 4).alias("legal_basis"),
        F.when(i % 11 == 0, "supported").otherwise("not_applicable").alias("explanation"),
    )
    matches = d.select(*ids, F.explode(F.array(i % 5, i % 3)).alias("item_id"))
    items = d.where("doc_id % 6 <> 0").select(ids[0], F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long"), i % 5)).alias("item_id"))
    quote = F.when(i % 5 == 0, "not in any source").otherwise(F.concat(F.lit("  "), F.replace(F.coalesce(F.substring("text", 5, 30), F.lit("")), F.lit(" "), F.lit("\n "))))
    evidence = d.where("doc_id % 4 <> 1").select(*ids, F.when(i % 7 == 0, "law").when(i % 7 == 1, "elsewhere").otherwise("document").alias("source"), quote.alias("quote"))
    sources = d.select(ids[0], F.lit("document").alias("source"), "text").unionByName(d.where("doc_id % 2 = 0").select(ids[0], F.lit("law").alias("source"), F.concat(F.lit("x"), "text", F.lit("y")).alias("text")))
    views = d.select(ids[1], F.lit("required").alias("legal_basis"), F.lit("not_applicable").alias("explanation"))
    return judging.verdict_rules(verdicts, matches, evidence, items, sources, views)


@query("judging_deterministic_errors", f"""WITH {_PROBLEMS} SELECT finding_id, 'quote_not_in_document' AS error FROM findings WHERE quote_resolution = 'quote_fabricated'
    UNION ALL SELECT DISTINCT finding_id, 'basis_not_in_corpus' FROM problems WHERE problem = 'uncitable'""")
def deterministic_errors(spark: SparkSession, sf: str) -> DataFrame:
    return judging.deterministic_errors(_findings(spark, sf), _problems(spark, sf))


_LIMITS = {"completeness_gain": 0.0005, "basis_gain": -0.02, "completeness_loss": 0.005, "basis_loss": 0.05, "precision_loss": 0.05, "decided": 40}


@query("judging_comparisons", f"""WITH {core._CELLS_SQL}, zsc AS (SELECT *, unnest(['cohort', stratum]) AS scope FROM cells WHERE dimension IN ('precision', 'completeness', 'legal_basis_accuracy')),
    zg AS (SELECT series, scope, arm, sum(numerator) FILTER (WHERE dimension = 'precision')::DOUBLE / nullif(sum(denominator) FILTER (WHERE dimension = 'precision'), 0) AS p,
      least(sum(denominator) FILTER (WHERE dimension = 'precision'), sum(denominator) FILTER (WHERE dimension = 'legal_basis_accuracy'))::BIGINT AS n FROM zsc GROUP BY 1, 2, 3),
    zd AS (SELECT series, scope, document_id, arm, max(rate) FILTER (WHERE dimension = 'completeness') AS c, max(rate) FILTER (WHERE dimension = 'legal_basis_accuracy') AS b FROM zsc GROUP BY 1, 2, 3, 4),
    zp AS (SELECT * FROM (VALUES ('mid_off', 'mid', 'off'), ('on_mid', 'on', 'mid')) t(pair, later, earlier)),
    ze AS (SELECT x.series, x.scope, pair, CASE WHEN count(x.c - y.c) = count(*) THEN avg(x.c - y.c) END AS dc, CASE WHEN count(x.b - y.b) = count(*) THEN avg(x.b - y.b) END AS db FROM zp p JOIN zd x ON x.arm = later
      LEFT JOIN zd y ON y.arm = earlier AND x.series = y.series AND x.scope = y.scope AND x.document_id = y.document_id GROUP BY 1, 2, 3),
    zo AS (SELECT q.series, q.scope, p.pair, dc, a.p - b.p AS dp, db, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM (SELECT * FROM (SELECT DISTINCT series FROM cells), (SELECT DISTINCT scope FROM zsc)) q CROSS JOIN zp p
      LEFT JOIN ze e ON e.series = q.series AND e.scope = q.scope AND e.pair = p.pair LEFT JOIN zg a ON a.arm = later AND a.series = q.series AND a.scope = q.scope LEFT JOIN zg b ON b.arm = earlier AND b.series = q.series AND b.scope = q.scope)
    SELECT series, scope, pair, round(dc, 9) AS completeness_delta, round(dp, 9) AS precision_delta, round(db, 9) AS basis_delta, n AS decided, CASE WHEN dc IS NULL OR dp IS NULL OR db IS NULL OR n < 40 THEN 'undecided'
      WHEN dc < -0.005 - 1e-12 OR db < -0.05 - 1e-12 OR dp < -0.05 - 1e-12 THEN 'loss' WHEN dc + 1e-12 >= 0.0005 AND db + 1e-12 >= -0.02 THEN 'criterion_met' ELSE 'below_threshold' END AS decision FROM zo""")
def comparisons(spark: SparkSession, sf: str) -> DataFrame:
    got = judging.comparisons(core._cells(spark, sf), _LIMITS)
    return got.withColumns({c: F.round(c, 9) for c in ("completeness_delta", "precision_delta", "basis_delta")})
