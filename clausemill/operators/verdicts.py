"""Verdicts on candidates: the facts they give, what they must carry, what they settle, and where findings are anchored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.sources.staging import dealt


def candidate_facts(candidates: DataFrame) -> DataFrame:
    """Decision facts of candidates(key, act_force, provision_force, relevant, candidates_cleared, raw_confidence) that
    have not become a basis: force comes from the two records and is never given."""
    force = F.when(F.col("provision_force") == "not_in_force", "not_in_force").otherwise(F.col("act_force"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return candidates.select(
        "key", F.lit(True).alias("processed"), F.lit(True).alias("adjudicable"), "candidates_cleared", "relevant", force.alias("force"), none("character"), none("departure"), none("permitted"), none("direction"), "raw_confidence"
    )


def basis_facts(bases: DataFrame) -> DataFrame:
    """Decision facts of bases(key, force, character, semi_imperative_direction, departure, direction, candidates_cleared,
    raw_confidence) in force: what is permitted is known exactly if the record names a direction."""
    permitted = F.when(F.col("semi_imperative_direction").isNotNull(), "known")
    return bases.select(
        "key", F.lit(True).alias("processed"), F.lit(True).alias("adjudicable"), "candidates_cleared", F.lit(True).alias("relevant"), "force", "character", "departure", permitted.alias("permitted"), "direction", "raw_confidence"
    )


def needs_confidence() -> Column:
    """Whether decision facts can only lead to an uncertain finding."""
    c = F.col
    semi = F.coalesce(c("character") == "semi_imperative", F.lit(False))
    open_ = (
        F.coalesce(c("departure") == "undetermined", F.lit(False))
        | F.coalesce(c("character") == "undetermined", F.lit(False))
        | (semi & c("permitted").isNull())
        | (semi & F.coalesce((c("departure") == "present") & (c("direction") == "undetermined"), F.lit(False)))
    )
    return (
        F.when(~c("processed") | ~c("adjudicable") | (c("candidates_cleared") == 0), False)
        .when(c("relevant") == F.lit(False), False)
        .when(c("relevant").isNull() | (c("force") == "undetermined"), True)
        .when(~F.coalesce(c("force") == "in_force", F.lit(False)), False)
        .otherwise(open_)
    )


def needs_direction() -> Column:
    """Whether a departure from a semi-imperative provision with a known direction has to name its own."""
    return F.coalesce((F.col("departure") == "present") & (F.col("character") == "semi_imperative"), F.lit(False)) & F.col("permitted").isNotNull()


def verdict_guards(facts: DataFrame) -> DataFrame:
    """rule, key: facts of verdicts that lack a confidence or a direction they must carry."""
    rules = F.array(F.when(needs_confidence() & F.col("raw_confidence").isNull(), "confidence_missing"), F.when(needs_direction() & F.col("direction").isNull(), "direction_missing"))
    return facts.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"), F.col("key").cast("string").alias("key"))


def settle(facts: DataFrame) -> DataFrame:
    """facts with outcome: refused (a confidence is missing), finding (relevance uncertain, or a relevant candidate whose
    force does not admit it), none (irrelevant) or continue."""
    admits = F.coalesce(F.col("force") == "in_force", F.lit(False))
    ends = F.col("relevant").isNull() | (F.col("relevant") & ~admits)
    outcome = F.when(ends & needs_confidence() & F.col("raw_confidence").isNull(), "refused").when(ends, "finding").when(~F.col("relevant"), "none").otherwise("continue")
    return facts.withColumn("outcome", outcome)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def record_rules(records: DataFrame) -> DataFrame:
    """rule, key: records of a provision's character and of a finding that are not closed.

    records(key, kind, n_evidence, evidence_blank, direction, reason, code, cause, raw_confidence, act_force,
    provision_force). An undetermined character has a reason and nothing else; a determined one has evidence without
    blanks; a semi-imperative one has exactly one of direction and reason, others neither. An uncertain finding has a
    cause and a confidence, others neither. An emitted basis is in force by its act and not vetoed.
    """
    c = F.col
    undetermined, semi = c("kind") == "undetermined", c("kind") == "semi_imperative"
    has_direction, has_reason = c("direction").isNotNull(), ~_blank("reason")
    uncertain = c("code") == "uncertain"
    rules = {
        "undetermined_with_evidence": undetermined & (c("n_evidence") > 0),
        "undetermined_without_reason": undetermined & ~has_reason,
        "direction_not_applicable": ~semi & has_direction,
        "evidence_missing": ~undetermined & (c("n_evidence") == 0),
        "evidence_blank": c("evidence_blank"),
        "semi_imperative_needs_one": semi & (has_direction == has_reason),
        "reason_not_applicable": ~semi & ~undetermined & has_reason,
        "uncertain_without_cause": uncertain & c("cause").isNull(),
        "uncertain_without_confidence": uncertain & c("raw_confidence").isNull(),
        "cause_not_applicable": ~uncertain & c("cause").isNotNull(),
        "confidence_not_applicable": ~uncertain & c("raw_confidence").isNotNull(),
        "basis_not_admitted": c("act_force") != "in_force",
        "basis_vetoed": c("provision_force") == "not_in_force",
    }
    every = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return records.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("rule"), F.col("key").cast("string").alias("key"))


def page_of(offsets: DataFrame, anchors: DataFrame) -> DataFrame:
    """key, doc_id, page of the first anchor that holds an offset; null where none does."""
    a = dealt(anchors.select(F.col("doc_id").alias("d"), "page", "idx", F.col("start_offset").alias("s"), F.col("end_offset").alias("e")), "d")
    on = (F.col("doc_id") == F.col("d")) & (F.col("offset") >= F.col("s")) & (F.col("offset") < F.col("e"))
    return offsets.select("key", "doc_id", "offset").join(a, on, "left").groupBy("key", "doc_id").agg(F.min_by("page", "idx").alias("page"))


def anchor_findings(findings: DataFrame, units: DataFrame, anchors: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """key, doc_id, start_offset, end_offset, source, page: the quote's span, else the unit's, else none for a unit that
    is the whole document.

    findings(key, doc_id, unit_id, quote_start, quote_end); units(doc_id, unit_id, start, end, whole). If documents(doc_id)
    are given, findings of others are left out.

    Each place, a unit and a span, is anchored once, however many findings share it; findings are dealt by place, not by
    document, and meet it in one join.
    """
    found = findings.select("key", F.struct("doc_id", "unit_id", "quote_start", "quote_end").alias("place"))
    places = found.select("place").distinct().select("place", "place.*")
    if documents is not None:
        places = places.join(documents.select("doc_id"), "doc_id", "left_semi")
    u = units.select("doc_id", "unit_id", F.col("start").alias("u_start"), F.col("end").alias("u_end"), "whole")
    rows = places.join(u, ["doc_id", "unit_id"], "left")
    by_unit = ~F.coalesce("whole", F.lit(False))
    at = lambda q, v: F.when(F.col("quote_start").isNotNull(), F.col(q)).when(by_unit, F.col(v))
    source = F.when(F.col("quote_start").isNotNull(), "quote").when(by_unit & F.col("u_start").isNotNull(), "unit")
    placed = rows.select("place", "doc_id", at("quote_start", "u_start").alias("start_offset"), at("quote_end", "u_end").alias("end_offset"), source.alias("source"))
    pages = page_of(placed.select(F.struct("place", "start_offset", "end_offset", "source").alias("key"), "doc_id", F.col("start_offset").alias("offset")), anchors)
    pages = pages.select("key.place", "doc_id", "key.start_offset", "key.end_offset", "key.source", "page")
    return dealt(found, "place").join(pages, "place").select("key", "doc_id", "start_offset", "end_offset", "source", "page")


def ground(selected: DataFrame, units: DataFrame, legal_units: DataFrame) -> DataFrame:
    """finding_id, kind, ref, text, error: what a reader may be told of the selected findings, one row a source.

    The text of each finding's unit, and of each provision it cites; a unit or a provision that is not held is an
    error. selected(finding_id, doc_id, unit_id, locators).
    """
    unit = selected.select("finding_id", "doc_id", "unit_id").join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"], "left")
    unit = unit.select("finding_id", F.lit("unit").alias("kind"), F.col("unit_id").cast("string").alias("ref"), "text", F.when(F.col("text").isNull(), "unknown_unit").alias("error"))
    cited = selected.select("finding_id", F.explode("locators").alias("ref")).distinct()
    wanted = cited.select("ref").distinct().join(legal_units.select(F.col("locator").alias("ref"), "text"), "ref", "left")
    law = cited.join(wanted, "ref").select("finding_id", F.lit("provision").alias("kind"), "ref", "text", F.when(F.col("text").isNull(), "provision_missing").alias("error"))
    return unit.unionByName(law)


def control_selected(records: DataFrame, configuration: str) -> tuple[DataFrame, DataFrame]:
    """One row a case: case_id, attempt, answer, failures, ignored; and rule, key of refused cases.

    records(case_id, known, attempt, status, answer, configuration, adapter). The first validated verdict counts; a
    later one that says something else refuses the case, and so do another configuration and a second adapter. Failed
    attempts are counted, and records of no known case are ignored.
    """
    held = records.where("known")
    good = F.col("status") == "validated"
    first = F.min_by(F.when(good, F.struct("attempt", "answer", "adapter")), F.when(good, F.col("attempt")))
    per = held.groupBy("case_id").agg(
        first.alias("f"),
        F.count_if(~good).alias("failures"),
        F.count_distinct(F.when(good, F.col("answer"))).alias("answers"),
        F.count_distinct(F.when(good, F.col("adapter"))).alias("adapters"),
        F.bool_or(~F.coalesce(F.col("configuration") == configuration, F.lit(False))).alias("other"),
    )
    rule = F.when(F.col("other"), "other_configuration").when(F.col("adapters") > 1, "second_adapter").when(F.col("answers") > 1, "conflicting_verdicts")
    ruled = per.withColumn("rule", rule)
    rows = ruled.where("rule is null").select("case_id", "f.attempt", "f.answer", "failures")
    return rows, ruled.where("rule is not null").select("rule", F.col("case_id").cast("string").alias("key"))


def batch_integrity(runs: DataFrame, findings: DataFrame, documents: DataFrame) -> DataFrame:
    """rule, key: recorded runs that cannot be scored.

    runs(run_id, doc_id, arm, status, measurement_valid, snapshot_id, document_hash, declared_findings). The document
    must be known and have the recorded hash, the arm be one of the three, the run completed and valid, the snapshot
    named, the number of findings as declared, and run and finding ids unique.
    """
    n = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("found"))
    d = documents.select("doc_id", F.sha2("text", 256).alias("h"))
    rows = runs.join(n, "run_id", "left").join(d, "doc_id", "left")
    rules = {
        "document_unknown": F.col("h").isNull(),
        "document_hash_differs": F.col("h").isNotNull() & ~F.col("h").eqNullSafe(F.col("document_hash")),
        "arm_unknown": ~F.coalesce(F.col("arm").isin("off", "mid", "on"), F.lit(False)),
        "not_completed": ~F.coalesce(F.col("status") == "completed", F.lit(False)),
        "measurement_invalid": ~F.coalesce("measurement_valid", F.lit(False)),
        "snapshot_missing": F.col("snapshot_id").isNull(),
        "finding_count_differs": ~F.col("declared_findings").eqNullSafe(F.coalesce("found", F.lit(0))),
    }
    every = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    out = rows.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("rule"), F.col("run_id").cast("string").alias("key"))
    for df, c, name in ((runs, "run_id", "duplicate_run"), (findings, "finding_id", "duplicate_finding")):
        twice = df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.lit(name).alias("rule"), F.col(c).cast("string").alias("key")))
    return out


def key_rules(items: DataFrame, documents: DataFrame, pattern: str, acts: DataFrame) -> DataFrame:
    """rule, key: items of an answer key given twice, of unknown documents, with malformed bases or undeclared acts.

    items(item_id, document_key, accepted_bases); the anchored pattern gives a basis' act as its first group.
    """
    twice = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_item").alias("rule"), F.col("item_id").cast("string").alias("key"))
    unknown = items.join(documents.select(F.col("doc_id").alias("document_key")), "document_key", "left_anti").select(F.lit("document_unknown").alias("rule"), F.col("item_id").cast("string").alias("key"))
    bases = items.select("item_id", F.explode("accepted_bases").alias("b")).withColumn("act", F.regexp_extract("b", f"^{pattern}$", 1))
    malformed = bases.where("act = ''").select(F.lit("basis_malformed").alias("rule"), F.concat_ws("/", "item_id", "b").alias("key"))
    foreign = bases.where("act <> ''").join(acts.select("act").distinct(), "act", "left_anti").select(F.lit("act_undeclared").alias("rule"), F.concat_ws("/", "item_id", "b").alias("key"))
    return twice.unionByName(unknown).unionByName(malformed.distinct()).unionByName(foreign.distinct())
