"""The worksheet log of a run: state of candidates, outstanding steps, audits, and what findings come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prominence of each finding code. Fixed values.
PROMINENCE = {
    "contradictory": "critical",
    "basis_not_in_force": "critical",
    "permissible_departure": "warning",
    "uncertain": "warning",
    "unit_not_adjudicable": "warning",
    "not_processed": "warning",
    "consistent": "neutral",
    "no_relation": "neutral",
    "no_basis_found": "neutral",
}
LEVELS = ("critical", "warning", "neutral")


def candidate_state(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidate_id, posted_at, character, relevance, relation: the first entry of each kind counts.

    entries(keys, seq, kind, stage, candidate_id, value); a verdict's stage is relevance or relation. A candidate that
    was never posted has a null posted_at.
    """
    first = lambda when: F.min_by(F.when(when, F.col("value")), F.when(when, F.col("seq")))
    verdict = F.col("kind") == "verdict"
    return entries.where("candidate_id is not null").groupBy(*keys, "candidate_id").agg(
        F.min(F.when(F.col("kind") == "candidate", F.col("seq"))).alias("posted_at"),
        first(F.col("kind") == "character").alias("character"),
        first(verdict & (F.col("stage") == "relevance")).alias("relevance"),
        first(verdict & (F.col("stage") == "relation")).alias("relation"),
    )


def pending_step(units: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step: what a unit waits for. Without candidates it is a search; else the first candidate in posting order
    that is neither irrelevant nor settled tells; when none is left the unit is done."""
    step = (
        F.when(F.col("relevance").isNull(), "relevance")
        .when(F.col("relevance") != "relevant", F.lit(None))
        .when(F.col("character").isNull(), "characterise")
        .when(F.col("relation").isNull(), "relation")
    )
    posted = state.where("posted_at is not null").withColumn("step", step)
    each = posted.groupBy(*keys).agg(F.min_by(F.col("step"), F.when(F.col("step").isNotNull(), F.col("posted_at"))).alias("open"))
    joined = units.select(*keys).distinct().join(each.withColumn("any", F.lit(True)), keys, "left")
    return joined.select(*keys, F.when(F.col("any").isNull(), "search").otherwise(F.coalesce("open", F.lit("done"))).alias("step"))


def audit_steps(entries: DataFrame, keys: list[str]) -> DataFrame:
    """rule, key, detail: units with more recorded steps than 1 + 3 times their candidates."""
    got = entries.groupBy(*keys).agg(F.count_if(F.col("kind") != "candidate").alias("steps"), F.count_distinct(F.when(F.col("kind") == "candidate", F.col("candidate_id"))).alias("candidates"))
    bad = got.where("steps > 1 + 3 * candidates")
    return bad.select(F.lit("too_many_steps").alias("rule"), F.concat_ws("/", *keys).alias("key"), F.concat_ws("/", "steps", "candidates").alias("detail"))


def known_locators(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, locator: the distinct locators that the entries of a candidate hold; null lists and locators are left out."""
    return entries.select(*keys, F.explode("locators").alias("locator")).where("locator is not null").distinct()


def unknown_citations(claims: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rule, key, detail: claimed locators that their ledger does not hold, and those claimed twice."""
    key = F.concat_ws("/", *keys)
    missing = claims.join(known.select(*keys, "locator").distinct(), [*keys, "locator"], "left_anti").select(F.lit("not_in_ledger").alias("rule"), key.alias("key"), F.col("locator").alias("detail")).distinct()
    twice = claims.groupBy(*keys, "locator").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_locator").alias("rule"), key.alias("key"), F.col("locator").alias("detail"))
    return missing.unionByName(twice)


def read_rules(reads: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """rule, key, detail: reads beyond the limit of a candidate, by their number."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    over = reads.withColumn("nth", nth).where(F.col("nth") > limit)
    return over.select(F.lit("read_limit").alias("rule"), F.concat_ws("/", *keys).alias("key"), F.col("nth").cast("string").alias("detail"))


def finalise_units(units: DataFrame, candidates: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code: units without a finding come to no_basis_found, or no_relation where they had candidates."""
    rest = units.select(*keys).distinct().join(findings.select(*keys).distinct(), keys, "left_anti")
    had = candidates.select(*keys).distinct().withColumn("had", F.lit(True))
    return rest.join(had, keys, "left").select(*keys, F.when(F.col("had"), "no_relation").otherwise("no_basis_found").alias("code"))


def with_prominence(findings: DataFrame) -> DataFrame:
    """findings with prominence and its rank, 0 the strongest; an unknown code has none."""
    names = F.create_map(*[F.lit(x) for kv in PROMINENCE.items() for x in kv])
    rank = F.create_map(*[F.lit(x) for i, level in enumerate(LEVELS) for x in (level, i)])
    got = findings.withColumn("prominence", F.element_at(names, F.col("code")))
    return got.withColumn("prominence_rank", F.element_at(rank, F.col("prominence")))


def block_prominence(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prominence, findings: the strongest level of each block; findings without a block are one group of null."""
    got = with_prominence(findings).groupBy(*keys).agg(F.min_by("prominence", "prominence_rank").alias("prominence"), F.count(F.lit(1)).alias("findings"))
    return got


def resolve_groups(groups: DataFrame, findings: DataFrame, run: str = "run_id") -> DataFrame:
    """run, group_id, number, finding_id, violation: groups name findings by their number in the run, from 1."""
    numbered = findings.select(run, "finding_id", F.row_number().over(Window.partitionBy(run).orderBy("finding_id")).alias("number"))
    named = groups.select(run, "group_id", F.explode("numbers").alias("number"))
    return named.join(numbered, [run, "number"], "left").select(run, "group_id", "number", "finding_id", F.when(F.col("finding_id").isNull(), "unknown_number").alias("violation"))


def select_scope(findings: DataFrame, wanted: DataFrame, run: str = "run_id") -> DataFrame:
    """run, finding_id, violation: the named findings of a run, or all of a run that names none; foreign ids are refused."""
    named = wanted.select(run, "finding_id").distinct()
    own = findings.select(run, "finding_id").withColumn("own", F.lit(True))
    chosen = named.join(own, [run, "finding_id"], "left").select(run, "finding_id", F.when(F.col("own").isNull(), "foreign_finding").alias("violation"))
    whole = findings.select(run, "finding_id").join(named.select(run).distinct(), run, "left_anti").withColumn("violation", F.lit(None).cast("string"))
    return chosen.unionByName(whole)


def prominence_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prominence, n: findings of each level."""
    names = F.create_map(*[F.lit(x) for kv in PROMINENCE.items() for x in kv])
    return findings.groupBy(*keys, names[F.col("code")].alias("prominence")).agg(F.count(F.lit(1)).alias("n"))


def unplaced(findings: DataFrame, keys: list[str], block: str = "block") -> DataFrame:
    """keys, finding_ids of the findings that no block holds."""
    return findings.where(F.col(block).isNull()).groupBy(*keys).agg(F.array_sort(F.collect_list("finding_id")).alias("finding_ids"))


def role_view(entries: DataFrame, keys: list[str], role: str) -> DataFrame:
    """What a role sees of the log: a verifier its candidate's entries and the notes, without who wrote them; others all."""
    if role != "verifier":
        return entries
    seen = (F.col("candidate_id") == F.col("for_candidate")) | (F.col("kind") == "note")
    return entries.where(seen).select(*keys, "for_candidate", "seq", "kind", "value")
