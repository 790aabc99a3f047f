"""Queries on ledgers: events stand for the calls of a unit's roles, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import ledger
from clausemill.plans.registry import query, table

_KEYS = ["unit"]
# Six kinds of calls by event; locators p0 to p12, of which the corpus holds the first ten.
_SQL = """e AS (SELECT user_id AS unit, event_id AS seq, event_id % 6 AS kind, event_id // 6 AS k, 'c' || event_id // 6 % 2 AS candidate_id FROM events),
    search AS (SELECT unit, seq, ['p' || k % 11, 'p' || (k + 3) % 13] AS results FROM e WHERE kind = 0),
    rd AS (SELECT unit, seq, CASE kind WHEN 1 THEN 'researcher' WHEN 3 THEN 'analyst' ELSE 'verifier' END AS role, candidate_id, 'p' || k % 13 AS locator FROM e WHERE kind IN (1, 3, 5)),
    post AS (SELECT unit, seq, candidate_id, ['p' || k % 13, 'p' || (k + k % 5) % 13][1 : k % 3] AS own, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN ['p' || (k + 5) % 13] ELSE [] END AS also FROM e WHERE kind = 2),
    chr AS (SELECT unit, seq, candidate_id, ['p' || k % 12, 'p' || (k + 1) % 13] AS evidence FROM e WHERE kind = 4), corpus AS (SELECT 'p' || i AS locator FROM range(0, 10) t(i)),
    led AS (SELECT unit, seq, unnest(results) AS locator FROM search UNION ALL SELECT unit, seq, locator FROM rd WHERE role = 'researcher' AND locator IN (SELECT locator FROM corpus)),
    sheet AS (SELECT unit, candidate_id, seq, unnest(list_concat(own, also)) AS locator FROM post)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.expr("event_id div 6")
    return table(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("seq"), (F.col("event_id") % 6).alias("kind"), k.alias("k"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("candidate_id"))


def _p(n):
    return F.concat(F.lit("p"), n.cast("string"))


def _parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    e, k = _events(spark, sf), F.col("k")
    searches = e.where("kind = 0").select("unit", "seq", F.array(_p(k % 11), _p((k + 3) % 13)).alias("results"))
    role = F.when(F.col("kind") == 1, "researcher").when(F.col("kind") == 3, "analyst").otherwise("verifier")
    reads = e.where("kind in (1, 3, 5)").select("unit", "seq", role.alias("role"), "candidate_id", _p(k % 13).alias("locator"))
    none = F.array().cast("array<string>")
    also = F.when((k % 3 > 0) & (k % 2 == 0), F.array(_p((k + 5) % 13))).otherwise(none)
    posts = e.where("kind = 2").select("unit", "seq", "candidate_id", F.slice(F.array(_p(k % 13), _p((k + k % 5) % 13)), F.lit(1), (k % 3).cast("int")).alias("own"), also.alias("also"))
    characters = e.where("kind = 4").select("unit", "seq", F.array(_p(k % 12), _p((k + 1) % 13)).alias("evidence"))
    corpus = spark.range(10).select(_p(F.col("id")).alias("locator"))
    held = ledger.ledger(searches, reads, corpus, _KEYS)
    return {"searches": searches, "reads": reads, "posts": posts, "characters": characters, "corpus": corpus, "held": held}


@query("ledger_since", f"WITH {_SQL} SELECT unit, locator, min(seq) AS since FROM led GROUP BY 1, 2")
def since(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf)["held"]


@query("ledger_refused_posts", f"""WITH {_SQL}, c AS (SELECT unit, seq, unnest(own) AS locator, true AS mine FROM post UNION ALL SELECT unit, seq, unnest(also), false FROM post),
    f AS (SELECT unit, seq, min(locator) FILTER (NOT EXISTS (SELECT 1 FROM led WHERE led.unit = c.unit AND led.locator = c.locator AND led.seq < c.seq)) AS foreign_, min(locator) FILTER (mine AND locator NOT IN (SELECT locator FROM corpus)) AS unknown_ FROM c GROUP BY 1, 2),
    r AS (SELECT post.unit, post.seq, foreign_, unknown_, CASE WHEN len(own) = 0 AND NOT EXISTS (SELECT 1 FROM search s WHERE s.unit = post.unit AND s.seq < post.seq) THEN 'no_search_before_empty_commit' WHEN len(own) > len(list_distinct(own)) THEN 'duplicate_candidate'
        WHEN foreign_ IS NOT NULL THEN 'locator_not_in_provenance_ledger' WHEN unknown_ IS NOT NULL THEN 'unknown_locator' END AS rule FROM post LEFT JOIN f ON f.unit = post.unit AND f.seq = post.seq)
    SELECT rule, unit || '/' || seq AS key, CASE rule WHEN 'locator_not_in_provenance_ledger' THEN foreign_ WHEN 'unknown_locator' THEN unknown_ ELSE '' END AS detail FROM r WHERE rule IS NOT NULL""")
def refused_posts(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    first = F.col("own")[0]
    candidates = F.transform("own", lambda x, i: F.struct(x.alias("locator"), F.when((i == 0) & first.isNotNull(), F.col("also")).alias("supporting")))
    posts = p["posts"].select("unit", "seq", candidates.alias("candidates"))
    return ledger.refused_posts(posts, p["searches"], p["held"], p["corpus"], _KEYS)


@query("ledger_refused_evidence", f"""WITH {_SQL}, i AS (SELECT unit, seq, unnest(evidence) AS locator, unnest([1, 2]) AS nth FROM chr),
    b AS (SELECT unit, seq, nth, locator, CASE WHEN locator NOT IN (SELECT locator FROM corpus) THEN 'evidence_locator_unknown' WHEN NOT EXISTS (SELECT 1 FROM led WHERE led.unit = i.unit AND led.locator = i.locator AND led.seq < i.seq) THEN 'locator_not_in_provenance_ledger' END AS rule FROM i)
    SELECT arg_min(rule, nth) AS rule, unit || '/' || seq AS key, arg_min(locator, nth) AS detail FROM b WHERE rule IS NOT NULL GROUP BY unit, seq""")
def refused_evidence(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return ledger.refused_evidence(p["characters"], p["held"], p["corpus"], _KEYS)


@query("ledger_refused_reads", f"""WITH {_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY unit, role, candidate_id ORDER BY seq) AS nth FROM rd),
    r AS (SELECT *, CASE WHEN role = 'verifier' AND nth > 3 THEN 'read_limit_reached' WHEN role = 'verifier' AND NOT EXISTS (SELECT 1 FROM sheet s WHERE s.unit = n.unit AND s.candidate_id = n.candidate_id AND s.locator = n.locator AND s.seq < n.seq) THEN 'locator_not_on_worksheet'
        WHEN role = 'analyst' AND NOT EXISTS (SELECT 1 FROM led WHERE led.unit = n.unit AND led.locator = n.locator AND led.seq < n.seq) THEN 'locator_not_in_provenance_ledger' WHEN locator NOT IN (SELECT locator FROM corpus) THEN 'unknown_locator' END AS rule FROM n)
    SELECT rule, unit || '/' || seq AS key, locator AS detail FROM r WHERE rule IS NOT NULL""")
def refused_reads(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    sheet = p["posts"].select("unit", "candidate_id", "seq", F.concat("own", "also").alias("locators"))
    return ledger.refused_reads(p["reads"], p["held"], sheet, p["corpus"], _KEYS)


@query("ledger_refused_verdicts", """WITH e AS (SELECT user_id AS unit, event_id AS seq, event_id AS entry_id, CASE WHEN event_type = 'click' THEN 'note' ELSE 'entry' END AS kind, 'c' || event_id % 3 AS candidate_id FROM events),
    v AS (SELECT unit, seq, candidate_id, unnest([seq - 3, seq - 7, seq + seq % 2]) AS entry_id FROM e WHERE seq % 4 = 0)
    SELECT 'verdict_dependency_not_visible' AS rule, v.unit || '/' || v.seq AS key, min(v.entry_id::VARCHAR) AS detail FROM v LEFT JOIN e ON e.unit = v.unit AND e.entry_id = v.entry_id
    WHERE NOT coalesce(e.seq < v.seq AND (e.candidate_id = v.candidate_id OR e.kind = 'note'), false) GROUP BY v.unit, v.seq""")
def refused_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("seq"), F.col("event_id").alias("entry_id"), F.when(F.col("event_type") == "click", "note").otherwise("entry").alias("kind"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("candidate_id"))
    s = F.col("seq")
    return ledger.refused_verdicts(e.where("seq % 4 = 0").select("unit", "seq", "candidate_id", F.array(s - 3, s - 7, s + s % 2).alias("based_on")), e, _KEYS)
