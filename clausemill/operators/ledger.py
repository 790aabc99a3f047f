"""What a call of a role may name: only what its unit's ledger, its candidate's sheet or its log held before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reads that a verifier has for a candidate. Fixed value.
READS = 3


def _told(rows: DataFrame, keys: list[str], rule: Column, detail: Column) -> DataFrame:
    """rule, key, detail of the calls with a rule; key is the unit and the call's place."""
    got = rows.select(rule.alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in [*keys, "seq"]]).alias("key"), F.coalesce(detail, F.lit("")).alias("detail"))
    return got.where("rule is not null")


def ledger(searches: DataFrame, reads: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """keys, locator, since: the first call that brought a locator to a unit.

    searches(keys, seq, results) bring all they found; reads(keys, seq, role, locator) those of the researcher whose
    locator the corpus(locator) holds. Null results and locators bring nothing.
    """
    found = searches.select(*keys, "seq", F.explode("results").alias("locator"))
    read = reads.where("role = 'researcher'").select(*keys, "seq", "locator").join(corpus.select("locator").distinct(), "locator", "left_semi")
    return found.unionByName(read).where("locator is not null").groupBy(*keys, "locator").agg(F.min("seq").alias("since"))


def _held(claims: DataFrame, held: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """claims(keys, seq, locator, ..) with known, whether the corpus holds the locator, and brought, whether held(keys,
    locator, since) had it before the call."""
    known = corpus.select("locator").distinct().withColumn("known", F.lit(True))
    both = claims.join(known, "locator", "left").join(held.select(*keys, "locator", "since"), [*keys, "locator"], "left")
    return both.withColumns({"known": F.coalesce("known", F.lit(False)), "brought": F.coalesce(F.col("since") < F.col("seq"), F.lit(False))}).drop("since")


def refused_posts(posts: DataFrame, searches: DataFrame, held: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """rule, key, detail of the posts of candidates that are refused; posts(keys, seq, candidates), an array of structs of
    locator and supporting.

    The first that holds: no_search_before_empty_commit, nothing is posted and nothing was searched before;
    duplicate_candidate; locator_not_in_provenance_ledger, a locator or a supporting one that no earlier call brought;
    unknown_locator, a candidate that the corpus does not hold. A search that was refused is none of searches. A null list
    is empty, a null locator is in no ledger.
    """
    own = F.transform("candidates", lambda c: c["locator"])
    first = searches.groupBy(*keys).agg(F.min("seq").alias("searched"))
    rows = posts.select(*keys, "seq", F.coalesce(own, F.array().cast("array<string>")).alias("own"), F.coalesce(F.flatten(F.transform("candidates", lambda c: F.coalesce(c["supporting"], F.array().cast("array<string>")))), F.array().cast("array<string>")).alias("also"))
    claims = rows.select(*keys, "seq", F.explode(F.array_distinct(F.concat(F.transform("own", lambda x: F.struct(x.alias("locator"), F.lit(True).alias("own"))), F.transform("also", lambda x: F.struct(x.alias("locator"), F.lit(False).alias("own")))))).alias("c"))
    judged = _held(claims.select(*keys, "seq", F.col("c.locator").alias("locator"), F.col("c.own").alias("own")), held, corpus, keys)
    name = F.coalesce("locator", F.lit("null"))
    per = judged.groupBy(*keys, "seq").agg(F.min(F.when(~F.col("brought"), name)).alias("foreign"), F.min(F.when(F.col("own") & ~F.col("known"), name)).alias("unknown"))
    both = rows.join(first, keys, "left").join(per, [*keys, "seq"], "left")
    twice = F.size("own") > F.size(F.array_distinct("own"))
    rule = (
        F.when((F.size("own") == 0) & ~F.coalesce(F.col("searched") < F.col("seq"), F.lit(False)), "no_search_before_empty_commit")
        .when(twice, "duplicate_candidate")
        .when(F.col("foreign").isNotNull(), "locator_not_in_provenance_ledger")
        .when(F.col("unknown").isNotNull(), "unknown_locator")
    )
    detail = F.when(rule == "locator_not_in_provenance_ledger", F.col("foreign")).when(rule == "unknown_locator", F.col("unknown"))
    return _told(both, keys, rule, detail)


def refused_evidence(characters: DataFrame, held: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """rule, key, detail of characters(keys, seq, evidence), whose first bad locator is evidence_locator_unknown, which the
    corpus does not hold, or locator_not_in_provenance_ledger, which no earlier call brought to the unit."""
    claims = characters.select(*keys, "seq", F.posexplode("evidence").alias("nth", "locator"))
    judged = _held(claims, held, corpus, keys).where("not known or not brought")
    one = judged.groupBy(*keys, "seq").agg(F.min_by(F.struct("known", F.coalesce("locator", F.lit("null")).alias("locator")), "nth").alias("bad"))
    return _told(one, keys, F.when(F.col("bad.known"), "locator_not_in_provenance_ledger").otherwise("evidence_locator_unknown"), F.col("bad.locator"))


def refused_reads(reads: DataFrame, held: DataFrame, sheet: DataFrame, corpus: DataFrame, keys: list[str], limit: int = READS) -> DataFrame:
    """rule, key, detail of reads(keys, seq, role, candidate_id, locator) that are refused.

    A verifier's read beyond `limit` for its candidate, refused ones counted, is read_limit_reached; one of a locator that
    sheet(keys, candidate_id, seq, locators) did not hold before is locator_not_on_worksheet. An analyst's read of what no
    earlier call brought to the unit is locator_not_in_provenance_ledger. What is left must be in the corpus, else it is
    unknown_locator.
    """
    nth = F.row_number().over(Window.partitionBy(*keys, "role", "candidate_id").orderBy("seq"))
    judged = _held(reads.withColumn("nth", nth), held, corpus, keys)
    named = sheet.select(*keys, "candidate_id", "seq", F.explode("locators").alias("locator")).where("locator is not null").groupBy(*keys, "candidate_id", "locator").agg(F.min("seq").alias("named"))
    judged = judged.join(named, [*keys, "candidate_id", "locator"], "left")
    verifier = F.col("role") == "verifier"
    rule = (
        F.when(verifier & (F.col("nth") > limit), "read_limit_reached")
        .when(verifier & ~F.coalesce(F.col("named") < F.col("seq"), F.lit(False)), "locator_not_on_worksheet")
        .when((F.col("role") == "analyst") & ~F.col("brought"), "locator_not_in_provenance_ledger")
        .when(~F.col("known"), "unknown_locator")
    )
    return _told(judged, keys, rule, F.col("locator"))


def refused_verdicts(verdicts: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """rule, key, detail of verdicts(keys, seq, candidate_id, based_on) that rest on an entry their verifier does not see:
    entries(keys, seq, entry_id, kind, candidate_id) of the same candidate and notes, made before the verdict."""
    claims = verdicts.select(*keys, "seq", "candidate_id", F.explode("based_on").alias("entry_id"))
    made = entries.select(*keys, "entry_id", F.col("seq").alias("made"), F.col("kind").alias("entry_kind"), F.col("candidate_id").alias("of"))
    both = claims.join(made, [*keys, "entry_id"], "left")
    seen = (F.col("made") < F.col("seq")) & ((F.col("of") == F.col("candidate_id")) | (F.col("entry_kind") == "note"))
    bad = both.where(~F.coalesce(seen, F.lit(False))).groupBy(*keys, "seq").agg(F.min(F.coalesce(F.col("entry_id").cast("string"), F.lit("null"))).alias("first"))
    return _told(bad, keys, F.lit("verdict_dependency_not_visible"), F.col("first"))
