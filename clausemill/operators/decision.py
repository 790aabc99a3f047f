"""Decision facts to findings, and the bookkeeping of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_finding(facts: DataFrame) -> DataFrame:
    """facts with code, cause and violation: the closed decision table, in fixed precedence.

    Facts: processed, adjudicable, candidates_cleared, relevant, force, character, departure, permitted, direction,
    raw_confidence. Facts that the table does not cover give no code and a violation.
    """
    c = F.col
    uncertain = lambda cause: F.struct(F.lit("uncertain").alias("code"), F.lit(cause).alias("cause"))
    code = lambda name: F.struct(F.lit(name).alias("code"), F.lit(None).cast("string").alias("cause"))
    bad = lambda why: F.struct(F.lit(None).cast("string").alias("code"), F.lit(f"!{why}").alias("cause"))
    direction = (
        F.when(c("direction").isNull(), bad("direction_missing"))
        .when(c("direction") == "undetermined", uncertain("departure_direction_undetermined"))
        .when(c("direction") == "with_permitted_direction", code("permissible_departure"))
        .when(c("direction") == "against_permitted_direction", code("contradictory"))
        .otherwise(bad("unmapped"))
    )
    found = (
        F.when(~c("processed"), code("not_processed"))
        .when(~c("adjudicable"), code("unit_not_adjudicable"))
        .when(c("candidates_cleared") == 0, code("no_basis_found"))
        .when(c("relevant") == F.lit(False), code("no_relation"))
        .when(c("relevant").isNull(), uncertain("relation_below_threshold"))
        .when(c("force").isNull(), bad("force_missing"))
        .when(c("force") == "undetermined", uncertain("force_state_undetermined"))
        .when(c("force") == "not_in_force", code("basis_not_in_force"))
        .when(c("departure") == "undetermined", uncertain("relation_below_threshold"))
        .when(c("character") == "undetermined", uncertain("provision_character_undetermined"))
        .when(c("character").isNull(), bad("character_missing"))
        .when((c("character") == "semi_imperative") & c("permitted").isNull(), uncertain("permitted_direction_undetermined"))
        .when(c("departure").isNull(), bad("departure_missing"))
        .when(c("departure") == "none", code("consistent"))
        .when((c("departure") == "present") & (c("character") == "imperative"), code("contradictory"))
        .when((c("departure") == "present") & (c("character") == "dispositive"), code("permissible_departure"))
        .when((c("departure") == "present") & (c("character") == "semi_imperative"), direction)
        .otherwise(bad("unmapped"))
    )
    lacking = (c("found.code") == "uncertain") & c("raw_confidence").isNull()
    out = facts.withColumn("found", found)
    return out.select(
        *facts.columns,
        F.when(~F.coalesce(lacking, F.lit(False)), c("found.code")).alias("code"),
        F.when(c("found.code").isNotNull() & ~lacking, c("found.cause")).alias("cause"),
        F.when(lacking, F.lit("confidence_missing")).otherwise(F.when(c("found.code").isNull(), F.substring("found.cause", 2, 100))).alias("violation"),
    )


def number_entries(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """entries with seq from 1 and entry_id e<seq> within keys."""
    return entries.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).withColumn("entry_id", F.concat(F.lit("e"), F.col("seq").cast("string")))


def fill_not_processed(units: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code: units without a finding get not_processed."""
    rest = units.select(*keys).distinct().join(findings.select(*keys).distinct(), keys, "left_anti")
    return findings.select(*keys, "code").unionByName(rest.withColumn("code", F.lit("not_processed")))


def resolve_quotes(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """key, doc_id, resolution, start_offset, end_offset of a quote in its document: words exact, white space loose.

    No occurrence is fabricated, more than one ambiguous, a blank quote empty, one is resolved to its span.
    """
    words = F.regexp_extract_all("quote", F.lit(r"(\S+)"))
    pattern = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1")), "\\s+")
    joined = findings.withColumn("pattern", pattern).join(texts, "doc_id")
    n = F.regexp_count("text", F.col("pattern"))
    kind = F.when(F.col("pattern") == "", "empty").when(n == 0, "fabricated").when(n > 1, "ambiguous").otherwise("resolved")
    start = F.regexp_instr("text", F.col("pattern")) - 1
    rows = joined.withColumn("resolution", kind)
    one = F.col("resolution") == "resolved"
    return rows.select("key", "doc_id", "resolution", F.when(one, start).alias("start_offset"), F.when(one, start + F.length(F.regexp_substr("text", F.col("pattern")))).alias("end_offset"))


def place_findings(findings: DataFrame, anchors: DataFrame) -> DataFrame:
    """key, doc_id, line of the anchor that holds the start of a finding; none where the offset is null.

    The range condition is a residual of the join on doc_id.
    """
    a = anchors.select("doc_id", "line", "start_offset", "end_offset")
    f = findings.select("key", "doc_id", "offset")
    on = (f["doc_id"] == a["doc_id"]) & (f["offset"] >= a["start_offset"]) & (f["offset"] < a["end_offset"])
    return f.join(a, on, "left").groupBy("key", f["doc_id"]).agg(F.min("line").alias("line"))
