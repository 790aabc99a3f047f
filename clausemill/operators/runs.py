"""Runs, attempts and findings: metrics, summaries, merges, parity and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.operators.corpus import digest_in_parts

ARMS = ("off", "mid", "on")


def returned_model(attempts: DataFrame) -> DataFrame:
    """run_id, model of the first successful attempt."""
    return attempts.groupBy("run_id").agg(F.min_by(F.when(F.col("success"), F.col("model")), F.when(F.col("success"), F.col("seq"))).alias("model"))


def merge_totals(runs: DataFrame, totals: DataFrame, columns: list[str]) -> DataFrame:
    """runs with new totals; a null total keeps the stored value."""
    new = totals.select("run_id", *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = runs.join(new, "run_id", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in runs.columns])


def reconcile(runs: DataFrame) -> DataFrame:
    """runs with those still running failed, as the process restarted."""
    cut = F.col("status") == "running"
    return runs.withColumn("failure", F.when(cut, F.lit("process_restarted")).otherwise(F.col("failure") if "failure" in runs.columns else F.lit(None))).withColumn("status", F.when(cut, "failed").otherwise(F.col("status")))


def erase(document_ids: DataFrame, runs: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """runs and their children without the runs of these documents."""
    kept = runs.join(document_ids, "document_id", "left_anti")
    gone = runs.join(document_ids, "document_id", "left_semi").select("run_id")
    return [kept, *[c.join(gone, "run_id", "left_anti") for c in children]]


def run_metrics(runs: DataFrame, attempts: DataFrame, findings: DataFrame) -> DataFrame:
    """run_id, tokens, units_total, units_with_finding, not_processed; children are summed before they join.

    units_total is the run's recorded count where runs has one, else the number of distinct units of its findings.
    """
    a = attempts.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("attempts"))
    done = F.col("code") != "not_processed"
    f = findings.groupBy("run_id").agg(
        F.count_distinct("unit_id").alias("units_total"),
        F.count_distinct(F.when(done, F.col("unit_id"))).alias("units_with_finding"),
        F.count_if(~done).alias("not_processed"),
    )
    recorded = F.col("units_recorded") if "units_recorded" in runs.columns else F.lit(None).cast("long")
    joined = runs.select("run_id", recorded.alias("recorded")).join(a, "run_id", "left").join(f, "run_id", "left")
    joined = joined.withColumn("units_total", F.coalesce("recorded", "units_total"))
    return joined.select("run_id", "tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("attempts", "units_total", "units_with_finding", "not_processed")])


def histogram(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, n of the findings."""
    return findings.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))


def arm_stratum(summary: DataFrame) -> DataFrame:
    """arm, stratum and their runs; quantities are over valid completed runs alone, null without any.

    summary(arm, stratum, status, measurement_valid, seconds, tokens, attempts, not_processed).
    """
    done = F.col("status") == "completed"
    valid = done & F.col("measurement_valid")
    over = lambda c: F.when(valid, F.col(c))
    return summary.groupBy("arm", F.coalesce("stratum", F.lit("unknown")).alias("stratum")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(~F.col("measurement_valid")).alias("invalid"),
        F.round(F.avg(over("seconds")), 4).alias("mean_seconds"),
        F.round(F.median(over("seconds")), 4).alias("median_seconds"),
        F.sum(over("tokens")).alias("total_tokens"),
        F.round(F.avg(over("tokens")), 4).alias("mean_tokens"),
        F.sum(over("attempts")).alias("attempts"),
        F.sum(over("not_processed")).alias("not_processed"),
    )


def coverage(required: DataFrame, held: DataFrame) -> DataFrame:
    """comparison, cells, held, missing, missing_cells, complete, any_failed of required(comparison, document_id, arm).

    held(document_id, arm, status): a cell is held by a completed run; any_failed tells whether one of its runs failed.
    """
    have = held.groupBy("document_id", "arm").agg(F.max(F.when(F.col("status") == "completed", True)).alias("have"), F.bool_or(F.col("status") == "failed").alias("failed"))
    cell = F.concat_ws("/", "document_id", "arm")
    got = required.join(have, ["document_id", "arm"], "left").groupBy("comparison").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("have").alias("held"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("have").isNull(), cell))), ",").alias("missing_cells"),
        F.coalesce(F.bool_or("failed"), F.lit(False)).alias("any_failed"),
    )
    return got.select("comparison", "cells", "held", (F.col("cells") - F.col("held")).alias("missing"), "missing_cells", (F.col("cells") == F.col("held")).alias("complete"), "any_failed")


def roots(runs: DataFrame) -> DataFrame:
    """runs without those that another run started."""
    return runs.where("parent_run_id is null") if "parent_run_id" in runs.columns else runs


def parity(runs: DataFrame, group: list[str], dimensions: list[str]) -> DataFrame:
    """group, valid, mismatched: dimensions that differ within a set of root runs; a null is a value like any other.

    A set with an invalid run is not valid, and neither is one that has no root run.
    """
    seen = [F.count_distinct(F.coalesce(F.to_json(F.struct(d)), F.lit(""))).alias(f"n_{d}") for d in dimensions]
    got = roots(runs).groupBy(*group).agg(*seen, F.bool_and("measurement_valid").alias("measured"))
    got = runs.select(*group).distinct().join(got, group, "left")
    wrong = F.filter(F.array(*[F.when(F.col(f"n_{d}") > 1, F.lit(d)) for d in dimensions]), lambda x: x.isNotNull())
    return got.select(*group, ((F.size(wrong) == 0) & F.coalesce("measured", F.lit(False))).alias("valid"), F.array_join(wrong, ",").alias("mismatched"))


def ambiguous(runs: DataFrame) -> DataFrame:
    """document_id, arm, n, run_ids: cells with more than one completed root run."""
    done = roots(runs).where("status = 'completed'").groupBy("document_id", "arm").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("run_id")), ",").alias("run_ids"))
    return done.where("n > 1")


def cross_batch(left: DataFrame, right: DataFrame) -> DataFrame:
    """document_id, arm, state: matched, same_run (both batches hold the same run), uncovered (left alone) or unmatched
    (right alone)."""
    by = ["document_id", "arm"]
    side = lambda df, c: df.groupBy(*by).agg(F.array_sort(F.collect_set("run_id")).alias(c))
    both = side(left, "l").join(side(right, "r"), by, "full_outer")
    state = F.when(F.col("l").isNull(), "unmatched").when(F.col("r").isNull(), "uncovered").when(F.arrays_overlap("l", "r"), "same_run").otherwise("matched")
    return both.select(*by, state.alias("state"))


def fingerprint(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, fingerprint of the rows of each group, each with its place; hashed in parts, so that no row holds a group."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (order, *columns)])
    return digest_in_parts(df, keys, row).withColumnRenamed("digest", "fingerprint")


def run_rules(attempts: DataFrame) -> DataFrame:
    """rule, key, detail: every rule that an attempt breaks, one row each.

    attempts(run_id, seq, tokens, code, cost, cost_known): counters are not negative, codes are snake case, and a cost
    is there exactly when it is known. A null counter or code breaks no rule.
    """
    rules = F.array(
        F.when(F.col("tokens") < 0, "negative_counter"),
        F.when(~F.col("code").rlike("^[a-z][a-z0-9_]*$"), "bad_code"),
        F.when(F.col("cost").isNotNull() != F.col("cost_known"), "cost_known_mismatch"),
    )
    broken = F.explode(F.filter(rules, lambda x: x.isNotNull()))
    return attempts.select(broken.alias("rule"), F.col("run_id").cast("string").alias("key"), F.col("seq").cast("string").alias("detail"))


def run_flags(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """run_id, interrupted, metrics_available: whether a run was cut off, and whether every attempt reported tokens."""
    a = attempts.groupBy("run_id").agg(F.bool_and(F.col("tokens").isNotNull()).alias("reported"))
    joined = runs.join(a, "run_id", "left")
    return joined.select("run_id", F.col("status").isin("running", "cancelled").alias("interrupted"), F.coalesce("reported", F.lit(False)).alias("metrics_available"))


def attempt_outcomes(attempts: DataFrame, limit: int) -> DataFrame:
    """request_id, n_attempts, outcome, retryable, tokens: a chain ends at its first success, its first fault that no
    retry mends, or at the limit; later rows do not count.

    attempts(request_id, seq, status, tokens); status 200 is a success and a null status a transport fault.
    """
    status = F.col("status")
    retry = status.isNull() | status.isin(429, 500, 502, 503, 504)
    by = Window.partitionBy("request_id").orderBy("seq")
    ended = F.coalesce(F.max((~retry).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = attempts.withColumn("nth", F.row_number().over(by)).withColumn("ended", ended).where((F.col("ended") == 0) & (F.col("nth") <= limit))
    kind = F.when(status.isNull(), "transport").when(status == 200, "success").when(status == 429, "rate_limited").when(status >= 500, "server_error").otherwise("rejected")
    rows = rows.withColumn("kind", kind).withColumn("retry", retry)
    return rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_attempts"), F.max_by("kind", "nth").alias("outcome"), F.max_by("retry", "nth").alias("retryable"), F.sum("tokens").alias("tokens"))


def identity_drift(attempts: DataFrame) -> DataFrame:
    """rule, key, detail: runs that more than one model answered, and runs with attempts that report no tokens."""
    got = attempts.groupBy("run_id").agg(F.count_distinct("model").alias("models"), F.count_if(F.col("tokens").isNull()).alias("unreported"))
    rows = F.array(F.when(F.col("models") > 1, F.struct(F.lit("model_drift").alias("rule"), F.col("models").alias("n"))), F.when(F.col("unreported") > 0, F.struct(F.lit("usage_missing").alias("rule"), F.col("unreported").alias("n"))))
    return got.select("run_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select(F.col("r.rule").alias("rule"), F.col("run_id").cast("string").alias("key"), F.col("r.n").cast("string").alias("detail"))


def unprocessed(runs: DataFrame, units: DataFrame, findings: DataFrame) -> DataFrame:
    """run_id, unprocessed: units without a finding in each failed run."""
    failed = runs.where("status = 'failed'").select("run_id")
    rest = units.select("run_id", "unit_id").distinct().join(failed, "run_id", "left_semi").join(findings.select("run_id", "unit_id").distinct(), ["run_id", "unit_id"], "left_anti")
    return failed.join(rest.groupBy("run_id").agg(F.count(F.lit(1)).alias("unprocessed")), "run_id", "left").select("run_id", F.coalesce("unprocessed", F.lit(0)).alias("unprocessed"))


def spend(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, turns, searches, cache_hits, reads, defaulted, characters from the log; entries(keys, kind, text).

    A search answered from before counts as a cache hit alone, and defaulted counts values that were filled in.
    """
    of = lambda k: F.count_if(F.col("kind") == k)
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("turns"), of("search").alias("searches"), of("cache_hit").alias("cache_hits"), of("read").alias("reads"), of("default").alias("defaulted"), F.sum(F.length("text")).cast("long").alias("characters"))


def merge_summaries(fresh: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """fresh rows and those stored ones whose keys are not among them."""
    return fresh.unionByName(stored.join(fresh.select(*keys).distinct(), keys, "left_anti"))


def batch_members(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """rule, key: run ids of a batch that the store lacks, batches whose runs are all missing, and batches with entries
    whose run id could not be read (null). batch(batch_id, run_id)."""
    unread = batch.where("run_id is null").select(F.lit("unreadable").alias("rule"), F.col("batch_id").cast("string").alias("key")).distinct()
    joined = batch.join(stored.select("run_id").distinct().withColumn("held", F.lit(1)), "run_id", "left")
    missing = joined.where("held is null and run_id is not null").select(F.lit("missing_in_store").alias("rule"), F.col("run_id").cast("string").alias("key"))
    empty = joined.groupBy("batch_id").agg(F.count("held").alias("n")).where("n = 0").select(F.lit("empty_batch").alias("rule"), F.col("batch_id").cast("string").alias("key"))
    return missing.unionByName(empty).unionByName(unread)


def pair_check(runs: DataFrame, first: str, second: str, dimensions: list[str]) -> DataFrame:
    """input_hash, state: ok or mismatch where the input has a run in both arms, else skipped."""
    side = lambda arm, p: runs.where(F.col("arm") == arm).groupBy("input_hash").agg(F.sort_array(F.collect_set(F.to_json(F.struct(*dimensions)))).alias(p))
    joined = runs.select("input_hash").distinct().join(side(first, "a"), "input_hash", "left").join(side(second, "b"), "input_hash", "left")
    same = (F.size("a") == 1) & (F.col("a") == F.col("b"))
    return joined.select("input_hash", F.when(F.col("a").isNull() | F.col("b").isNull(), "skipped").when(same, "ok").otherwise("mismatch").alias("state"))


def pair_counts(checked: DataFrame) -> DataFrame:
    """ok, mismatch, skipped, passed of pair_check's rows: a check without any pair, or with a mismatch, is not passed."""
    n = [F.count_if(F.col("state") == x).alias(x) for x in ("ok", "mismatch", "skipped")]
    return checked.agg(*n).withColumn("passed", (F.col("ok") > 0) & (F.col("mismatch") == 0))


def arm_summary(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """run_id, arm, status, finished_at, codes: one row a run, with its findings counted by code, and the finish as an
    instant, whether it was written with Z or with an offset."""
    each = findings.groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"))
    codes = each.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", F.col("n").cast("string")))), ",").alias("codes"))
    return runs.select("run_id", "arm", "status", F.to_timestamp("finished").alias("finished_at")).join(codes, "run_id", "left").na.fill("", ["codes"])


def latest_finish(summary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, finished_at: the last finish of each group."""
    return summary.groupBy(*keys).agg(F.max("finished_at").alias("finished_at"))


def clean_cohort(artifacts: DataFrame, exposed: DataFrame) -> DataFrame:
    """case_id of the cases none of whose artifacts was exposed. artifacts(case_id, artifact_id), exposed(artifact_id)."""
    seen = artifacts.join(exposed.select("artifact_id").distinct(), "artifact_id", "left_semi").select("case_id").distinct()
    return artifacts.select("case_id").distinct().join(seen, "case_id", "left_anti")


def run_detail(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """artifact_id, arm, elapsed_s, input_tokens, output_tokens, findings, not_processed, status, cost as a table shows them.

    What was not recorded is a dash, a cost without a price is unknown, and an invalid measurement is marked.
    """
    n = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("code") == "not_processed").alias("not_processed"))
    rows = runs.join(n, "run_id", "left")
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("—"))
    status = F.coalesce("status", F.lit("—"))
    unknown = F.col("cost_unknown_reason").isNotNull() | F.col("cost_microunits").isNull()
    return rows.select(
        "run_id",
        "artifact_id",
        "arm",
        F.when(F.col("elapsed_ms").isNull(), "—").otherwise(F.format_string("%.1f", F.col("elapsed_ms") / 1000)).alias("elapsed_s"),
        text("input_tokens").alias("input_tokens"),
        text("output_tokens").alias("output_tokens"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("not_processed", F.lit(0)).alias("not_processed"),
        F.when(F.coalesce("measurement_valid", F.lit(True)), status).otherwise(F.concat(status, F.lit(" (invalid)"))).alias("status"),
        F.when(unknown, "unknown, because price table unavailable").otherwise(F.col("cost_microunits").cast("string")).alias("cost"),
    )


def config_parity(configs: DataFrame, expected: DataFrame, required: DataFrame, fields: list[str]) -> DataFrame:
    """rule, key, detail: fields of served configurations that are not what the first series had, or what a repeat needs.

    configs(key, field, value); expected(field, value); required(field, value). A field that neither covers is
    uncovered. Missing values differ from any but missing ones.
    """
    spark = configs.sparkSession
    names = spark.createDataFrame([(f,) for f in fields], "field string")
    covered = expected.select("field").unionByName(required.select("field")).distinct()
    uncovered = names.join(covered, "field", "left_anti").select(F.lit("uncovered_field").alias("rule"), F.lit("").alias("key"), F.col("field").alias("detail"))
    keys = configs.select("key").distinct()
    out = uncovered
    for rule, wanted in (("differs_from_series_1", expected.join(names, "field", "left_semi")), ("required_value_missing", required)):
        asked = keys.crossJoin(F.broadcast(wanted.select("field", F.col("value").alias("wanted"))))
        got = asked.join(configs, ["key", "field"], "left").where(~F.col("value").eqNullSafe(F.col("wanted")))
        out = out.unionByName(got.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"), F.col("field").alias("detail")))
    return out
