"""Scoring of recorded findings against an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.sources.staging import dealt

SUBSTANTIVE = ("consistent", "contradictory", "permissible_departure")


def dispositions(findings: DataFrame, key: list[str], order: str) -> DataFrame:
    """findings with disposition and original: non_substantive, judged, or an exact duplicate of the first of its key."""
    by = Window.partitionBy(*key).orderBy(order)
    substantive = F.col("code").isin(*SUBSTANTIVE)
    nth = F.row_number().over(by)
    kind = F.when(~substantive, "non_substantive").when(nth > 1, "exact_duplicate").otherwise("judged")
    return findings.withColumn("disposition", kind).withColumn("original", F.when(substantive & (nth > 1), F.first(order).over(by)))


def finding_status(classification: Column, legal_basis: Column, explanation: Column, errors: Column) -> Column:
    """incorrect if any criterion failed or there are errors, else unresolved if any is, else correct."""
    each = (classification, legal_basis, explanation)
    bad, open_ = errors > 0, F.lit(False)
    for c in each:
        bad, open_ = bad | c.isin("incorrect", "unsupported"), open_ | (c == "unresolved")
    return F.when(bad, "incorrect").when(open_, "unresolved").otherwise("correct")


def ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient, null where nothing was counted."""
    return F.try_divide(numerator.cast("double"), denominator)


#: What a finding is judged on besides its status.
CRITERIA = ("classification", "legal_basis", "explanation")


def cells(runs: DataFrame, judged: DataFrame, key: DataFrame) -> DataFrame:
    """series, document_id, arm, stratum with counts and the dimensions' numerators and denominators, one row each.

    judged(series, document_id, arm, status, anchored, item_id, covers, classification, legal_basis, explanation);
    key(document_id, items). Cells come from the runs, so a cell without findings is there with zeros. The accuracy of
    a criterion is over the findings where it was decided.
    """
    by = ["series", "document_id", "arm"]
    is_ = lambda s: F.col("status") == s
    told = {"correct": is_("correct"), "incorrect": is_("incorrect"), "unresolved": is_("unresolved")}
    told |= {f"{c}_good": F.col(c).isin("correct", "supported") for c in CRITERIA} | {f"{c}_bad": F.col(c).isin("incorrect", "unsupported") for c in CRITERIA}
    covered = F.when(is_("correct") & F.col("anchored") & F.col("covers"), F.col("item_id"))
    # items first, so that a distinct count copies no rows; both sums find their rows where they were dealt
    rows = dealt(judged.select(*by, covered.alias("covered"), *[c.alias(name) for name, c in told.items()]), *by)
    items = rows.groupBy(*by, "covered").agg(*[F.count_if(name).alias(name) for name in told])
    got = items.groupBy(*by).agg(*[F.sum(name).alias(name) for name in told], F.count("covered").alias("covered"))
    base = dealt(dealt(runs.select(*by, "stratum"), *by).distinct().join(got, by, "left"), "document_id").join(key, "document_id", "left")
    base = base.na.fill(0, ["covered", "items", *told])
    c, i, u = F.col("correct"), F.col("incorrect"), F.col("unresolved")
    dims = {"precision": (c, c + i), "completeness": (F.col("covered"), F.col("items")), "unresolved_share": (u, c + i + u), "confirmed_share": (c, c + i + u)}
    dims |= {f"{x}_accuracy": (F.col(f"{x}_good"), F.col(f"{x}_good") + F.col(f"{x}_bad")) for x in CRITERIA}
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), n.alias("numerator"), d.alias("denominator")) for k, (n, d) in dims.items()])
    return base.select(*by, "stratum", F.inline(rows)).withColumn("rate", ratio(F.col("numerator"), F.col("denominator")))


def per_arm(cell_rows: DataFrame) -> DataFrame:
    """series, arm, stratum (null: all), dimension, macro, micro.

    macro is the mean over documents, undefined if any document is; micro is over the summed counts.
    """
    macro = F.when(F.count("rate") == F.count(F.lit(1)), F.round(F.avg("rate"), 9))
    micro = F.round(ratio(F.sum("numerator"), F.sum("denominator")), 9)
    sets = cell_rows.groupingSets([["series", "arm", "dimension"], ["series", "arm", "stratum", "dimension"]], "series", "arm", "stratum", "dimension")
    return sets.agg(macro.alias("macro"), micro.alias("micro"))


def paired_differences(cell_rows: DataFrame) -> DataFrame:
    """series, document_id, dimension, pair, difference of the rates of mid and off, and of on and mid.

    The cells of a document and dimension are brought together once; each later cell meets each earlier one, or none.
    """
    by = ["series", "document_id", "dimension"]
    met = cell_rows.where(F.col("arm").isin("off", "mid", "on")).groupBy(*by).agg(F.collect_list(F.struct("arm", "rate")).alias("cells"))
    known = F.col("series").isNotNull() & F.col("document_id").isNotNull() & F.col("dimension").isNotNull()
    rates = lambda arm: F.transform(F.filter("cells", lambda x: x["arm"] == arm), lambda x: x["rate"])

    def pairs(name: str, later: str, earlier: str) -> Column:
        others = F.when(known & (F.size(rates(earlier)) > 0), rates(earlier)).otherwise(F.array(F.lit(None).cast("double")))
        pair = lambda a, b: F.struct(F.lit(name).alias("pair"), F.round(a - b, 9).alias("difference"))
        return F.flatten(F.transform(rates(later), lambda a: F.transform(others, lambda b: pair(a, b))))

    return met.select(*by, F.inline(F.concat(pairs("mid_off", "mid", "off"), pairs("on_mid", "on", "mid"))))


def reduce_attempts(attempts: DataFrame) -> DataFrame:
    """packet_id, answered, superseded, conflicts, failed, stale, invalid, blocking: the first valid reply of a packet wins.

    attempts(packet_id, attempt, status, valid, current, reply): a technical failure (status not `answered`) is failed, a
    reply to another state of the packet stale, and one that breaks the rules invalid. Later replies equal to the first
    valid one are superseded, others conflict. What went wrong blocks only a packet without an answer.
    """
    failed, stale = F.col("status") != "answered", ~F.col("current")
    kind = F.when(failed, "failed").when(stale, "stale").when(~F.col("valid"), "invalid").otherwise("good")
    rows = attempts.withColumn("kind", kind)
    order = Window.partitionBy("packet_id", "kind").orderBy("attempt")
    good = F.col("kind") == "good"
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("same", F.col("reply").eqNullSafe(F.first("reply").over(order)))
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    got = rows.groupBy("packet_id").agg(
        F.bool_or(good).alias("answered"), F.count_if(good & (F.col("nth") > 1) & F.col("same")).alias("superseded"), F.count_if(good & ~F.col("same")).alias("conflicts"), of("failed"), of("stale"), of("invalid")
    )
    return got.withColumn("blocking", ~F.col("answered") & (F.col("failed") + F.col("stale") + F.col("invalid") > 0))


def agreement(verdicts: DataFrame, ratings: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, n, agree, rate of verdicts with reference ratings."""
    joined = verdicts.join(ratings.select("case_id", *[F.col(d).alias(f"r_{d}") for d in dimensions]), "case_id")
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(d).eqNullSafe(F.col(f"r_{d}"))).alias("same")) for d in dimensions])
    got = joined.select(F.inline(rows)).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("agree"))
    return got.withColumn("rate", F.round(ratio(F.col("agree"), F.col("n")), 9))


def reply_membership(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """rule, packet_id, finding_id: findings of a packet not answered, answered twice, or answered and never asked."""
    keys = ["packet_id", "finding_id"]
    a = answered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = expected.select(*keys).distinct().withColumn("asked", F.lit(1)).join(a, keys, "full_outer")
    rule = F.when(F.col("asked").isNull(), "not_asked").when(F.col("n").isNull(), "not_answered").when(F.col("n") > 1, "answered_twice")
    return joined.select(rule.alias("rule"), *keys).where("rule is not null")


def mixed_instrument(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, adapters: groups whose valid attempts came from more than one adapter; an unnamed adapter is one."""
    got = attempts.where("valid").groupBy(*keys).agg(F.count_distinct(F.coalesce("adapter", F.lit("unknown"))).alias("adapters"))
    return got.where("adapters > 1")


def completeness(expected: DataFrame, judged: DataFrame) -> DataFrame:
    """packet_id, expected, missing, complete. expected and judged hold packet_id and finding_id."""
    keys = ["packet_id", "finding_id"]
    have = judged.select(*keys).distinct().withColumn("have", F.lit(1))
    got = expected.select(*keys).distinct().join(have, keys, "left").groupBy("packet_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("have").isNull()).alias("missing"))
    return got.withColumn("complete", F.col("missing") == 0)


def key_gaps(judged: DataFrame) -> DataFrame:
    """run_id, finding_id of correct findings that match no item of the key."""
    return judged.where((F.col("status") == "correct") & (F.coalesce(F.size("matches"), F.lit(0)) <= 0)).select("run_id", "finding_id")


def tag_counts(judged: DataFrame) -> DataFrame:
    """tag, n over the tags of the judge and those found by rule; a null list holds none."""
    none = F.array().cast("array<string>")
    return judged.select(F.explode(F.concat(F.coalesce("judge_tags", none), F.coalesce("rule_tags", none))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def pending(packets: DataFrame, attempts: DataFrame) -> DataFrame:
    """packet_id of the packets without a valid attempt."""
    return packets.select("packet_id").distinct().join(attempts.where("valid").select("packet_id").distinct(), "packet_id", "left_anti")


def attempt_resources(attempts: DataFrame, column: str, path: str, fallback: str) -> DataFrame:
    """group, attempts, total, missing: a figure from nested JSON, the nested fallback where it is absent."""
    value = F.coalesce(F.get_json_object(column, path).cast("double"), F.get_json_object(column, fallback).cast("double"))
    return attempts.withColumn("value", value).groupBy("group").agg(F.count(F.lit(1)).alias("attempts"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("value").isNull()).alias("missing"))


def accounting(disposed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, recorded, judged, exact_duplicate, non_substantive: findings by disposition."""
    of = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    return disposed.groupBy(*keys).agg(F.count(F.lit(1)).alias("recorded"), of("judged"), of("exact_duplicate"), of("non_substantive"))


def outcomes(disposed: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """key, disposition, original, status of every finding: its judgement, pending if it is still to be judged, else its
    disposition."""
    status = F.coalesce("status", F.when(F.col("disposition") == "judged", "pending").otherwise(F.col("disposition")))
    return disposed.join(judged.select(*key, "status"), key, "left").select(*key, "disposition", "original", status.alias("status"))


#: Codes that tell a reader that nothing is wrong. Fixed values.
REASSURING = ("consistent", "permissible_departure")


def control_totals(rows: DataFrame) -> DataFrame:
    """cases, validated, overall_agreements, key_match_disagreements, false_reassurances, technical_failures in one row.

    rows(case_id, code, clear_breach, reference_status, judge_status, reference_matches, judge_matches, failures) with
    sorted matches; a case without a verdict has a null judge_status, agrees in nothing and reassures nobody. A false
    reassurance is a reassuring code over a clear breach that the judge calls correct.
    """
    validated = F.col("judge_status").isNotNull()
    reassured = F.col("clear_breach") & F.col("code").isin(*REASSURING) & (F.col("judge_status") == "correct")
    return rows.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(validated).alias("validated"),
        F.count_if(F.col("judge_status") == F.col("reference_status")).alias("overall_agreements"),
        F.count_if(~(validated & F.col("judge_matches").eqNullSafe(F.col("reference_matches")))).alias("key_match_disagreements"),
        F.count_if(reassured).alias("false_reassurances"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("technical_failures"),
    )


def acceptance(totals: DataFrame, criteria: dict[str, int]) -> DataFrame:
    """name, threshold, observed, passed of the five checks. criteria: case_count, minimum_overall_agreements,
    maximum_key_match_disagreements, maximum_false_reassurances; every case must have a verdict."""
    c = F.col
    lit = lambda k: F.lit(criteria[k]).cast("long")
    checks = [
        ("case_count", lit("case_count"), c("cases"), c("cases") == lit("case_count")),
        ("cases_validated", c("cases"), c("validated"), c("validated") == c("cases")),
        ("overall_agreements", lit("minimum_overall_agreements"), c("overall_agreements"), c("overall_agreements") >= lit("minimum_overall_agreements")),
        ("key_match_disagreements", lit("maximum_key_match_disagreements"), c("key_match_disagreements"), c("key_match_disagreements") <= lit("maximum_key_match_disagreements")),
        ("false_reassurances", lit("maximum_false_reassurances"), c("false_reassurances"), c("false_reassurances") <= lit("maximum_false_reassurances")),
    ]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), t.alias("threshold"), o.alias("observed"), p.alias("passed")) for n, t, o, p in checks])))
