"""What is judged: recorded findings, their bases, packets for the judge, its replies and the comparison of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.sources.staging import staged

#: Codes of findings that assert a relation to the law, and of those that do not. Fixed values.
SUBSTANTIVE = ("consistent", "contradictory", "permissible_departure")
NON_SUBSTANTIVE = ("no_relation", "no_basis_found", "basis_not_in_force", "unit_not_adjudicable", "not_processed", "uncertain")


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def scored_findings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw findings with sorted distinct locators, the basis among them; and rule, key of those without an id or with a
    code outside the vocabulary, which are left out."""
    known = F.coalesce(F.col("code").isin(*SUBSTANTIVE, *NON_SUBSTANTIVE), F.lit(False))
    rule = F.when(~F.coalesce(_filled(F.col("finding_id")), F.lit(False)), "id_missing").when(~known, "code_unknown")
    ruled = raw.withColumn("rule", rule)
    every = F.filter(F.concat(F.coalesce("legal_locators", F.array().cast("array<string>")), F.array("basis_locator")), _filled)
    rows = ruled.where("rule is null").select("series", "document_key", "arm", "finding_id", "code", "start", "end", "quote_resolution", F.array_sort(F.array_distinct(every)).alias("locators"))
    return rows, ruled.where("rule is not null").select("rule", F.concat_ws("/", "series", "document_key", "arm", "finding_id").alias("key"))


def accepted_bases(items: DataFrame) -> DataFrame:
    """item_id, locator that an answer of the item accepts; items outside the snapshot accept none."""
    inside = items.where(~F.coalesce("outside_snapshot", F.lit(False))).select("item_id", F.explode("answers").alias("a"))
    return inside.select("item_id", F.explode("a.accepted_bases").alias("locator")).distinct()


def basis_problems(findings: DataFrame, provisions: DataFrame, acts: DataFrame, accepted: DataFrame, pattern: str, verified: bool = True) -> DataFrame:
    """finding_id, locator, problem of each claimed locator whose provision is not held.

    uncitable: no locator at all (the anchored pattern gives its act as the first group), or proved absent: a verified
    corpus, not accepted by the key, and an act that is not declared or was prepared in full. unprepared: the rest.
    acts(act, prepared) are the declared ones. Locators are judged once each, whatever claims them, and written to the
    shared folder, so that a vocabulary of known size meets the claims and only claims with a problem are told apart.
    """
    claims = findings.select("finding_id", F.explode("locators").alias("locator"))
    absent = claims.select("locator").distinct().join(provisions.select("locator").distinct(), "locator", "left_anti")
    act = F.regexp_extract("locator", f"^{pattern}$", 1)
    judged = absent.withColumn("act", act).join(acts.select("act", "prepared"), "act", "left")
    judged = judged.join(accepted.select("locator", F.lit(True).alias("accepted")).distinct(), "locator", "left")
    proved = F.lit(verified) & F.col("accepted").isNull() & F.coalesce("prepared", F.lit(True))
    problem = F.when((F.col("act") == "") | proved, "uncitable").otherwise("unprepared")
    judged = staged(judged.select("locator", problem.alias("problem")))
    return claims.join(judged, "locator").select("finding_id", "locator", "problem").distinct()


def guarded_quote(text: Column, start: Column, end: Column) -> Column:
    """The slice of a text, null unless 0 <= start < end <= length."""
    return F.when((start >= 0) & (start < end) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def finding_views(findings: DataFrame, texts: DataFrame, problems: DataFrame) -> DataFrame:
    """Findings as the judge sees them: finding_id, code, span, quoted_text, claimed bases, those absent from the corpus,
    and which criteria apply.

    A text meets each span that is asked of it once; spans and quotes are written to the shared folder, so that no text
    travels with a finding.
    """
    span = ["document_key", "start", "end"]
    spans = staged(findings.select(*span).distinct())
    quote = guarded_quote(F.col("text"), F.col("start"), F.col("end"))
    quotes = staged(spans.join(texts.select(F.col("doc_id").alias("document_key"), "text"), "document_key").select(*(F.col(c).alias(f"its_{c}") for c in span), quote.alias("quoted_text")))
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in span]
    absent = problems.where("problem = 'uncitable'").groupBy("finding_id").agg(F.array_sort(F.collect_list("locator")).alias("absent"))
    rows = findings.join(quotes, same).join(absent, "finding_id", "left")
    return rows.select(
        "series",
        "document_key",
        "arm",
        "finding_id",
        "code",
        "start",
        "end",
        "quoted_text",
        F.col("locators").alias("claimed_bases"),
        F.coalesce("absent", F.array().cast("array<string>")).alias("absent_bases"),
        F.lit("required").alias("legal_basis"),
        F.lit("not_applicable").alias("explanation"),
    )


def packets(views: DataFrame, texts: DataFrame, items: DataFrame, provisions: DataFrame, problems: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """One packet for each run (series, document_key, arm): packet_id, payload; and rule, key, detail of refused ones.

    The payload is JSON of the document, the run's substantive findings, the document's key items and the provisions
    claimed or accepted, all in order of their ids. A claimed provision that is merely unprepared refuses the packet,
    and so does a payload over `limit` characters. The id is 16 hex digits of the payload's hash.
    """
    run = ["series", "document_key", "arm"]
    rows = views.where(F.col("code").isin(*SUBSTANTIVE))
    seen = rows.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("finding_id", "code", "start", "end", "quoted_text", "claimed_bases", "absent_bases"))).alias("findings"))
    key = items.groupBy("document_key").agg(F.array_sort(F.collect_list(F.struct("item_id", "accepted_bases"))).alias("key_items"))
    wanted = rows.select(*run, F.explode("claimed_bases").alias("locator"))
    wanted = wanted.unionByName(seen.select(*run).join(items.select("document_key", F.explode("accepted_bases").alias("locator")), "document_key").select(*run, "locator")).distinct()
    held = wanted.join(provisions.select("locator", F.col("text").alias("provision_text")), "locator").groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("locator", F.col("provision_text").alias("text")))).alias("provisions"))
    missing = rows.select(*run, "finding_id").join(problems.where("problem = 'unprepared'"), "finding_id").groupBy(*run).agg(F.array_join(F.array_sort(F.collect_set("locator")), ",").alias("missing"))
    whole = seen.join(texts.select(F.col("doc_id").alias("document_key"), "text"), "document_key").join(key, "document_key", "left").join(held, run, "left").join(missing, run, "left")
    none = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), whole.schema[c].dataType))
    body = F.to_json(F.struct(F.struct("document_key", "text").alias("document"), "findings", none("key_items").alias("key_items"), none("provisions").alias("provisions")), {"ignoreNullFields": "false"})
    whole = whole.select(*run, "missing", body.alias("payload"))
    rule = F.when(F.col("missing").isNotNull(), "source_missing").when(F.length("payload") > limit, "packet_too_large")
    whole = whole.withColumn("rule", rule)
    good = whole.where("rule is null").select(*run, F.substring(F.sha2("payload", 256), 1, 16).alias("packet_id"), "payload")
    detail = F.coalesce("missing", F.length("payload").cast("string"))
    return good, whole.where("rule is not null").select("rule", F.concat_ws("/", *run).alias("key"), detail.alias("detail"))


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def verdict_rules(verdicts: DataFrame, matches: DataFrame, evidence: DataFrame, items: DataFrame, sources: DataFrame, views: DataFrame) -> DataFrame:
    """rule, key, detail: replies of the judge that do not keep to their packet.

    Key items must be in the packet and named once; cited sources must be in it, and quotes in their source after
    folding white space; a decided criterion needs evidence, and a decided basis cites a provision where there is one;
    a required criterion is answered and one that does not apply is not. verdicts, matches and evidence have
    packet_id, finding_id; items and sources have packet_id; views have finding_id.
    """
    one = ["packet_id", "finding_id"]
    key = F.concat_ws("/", *one)
    out = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), key.alias("key"), detail.cast("string").alias("detail"))
    unknown = matches.join(items.select("packet_id", "item_id").distinct(), ["packet_id", "item_id"], "left_anti")
    twice = matches.groupBy(*one, "item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cited = evidence.join(sources.withColumnRenamed("text", "source_text"), ["packet_id", "source"], "left")
    absent = cited.where("source_text is null")
    ungrounded = cited.where(~F.contains(_folded(F.col("source_text")), _folded(F.col("quote"))))
    has = evidence.groupBy(*one).agg(F.bool_or(F.col("source") != "document").alias("cites_provision"))
    offers = sources.groupBy("packet_id").agg(F.bool_or(F.col("source") != "document").alias("offers_provision"))
    full = verdicts.join(has, one, "left").join(offers, "packet_id", "left").join(views.select("finding_id", F.col("legal_basis").alias("basis_applies"), F.col("explanation").alias("explanation_applies")), "finding_id", "left")
    decided = lambda c: F.col(c).isin("correct", "incorrect", "supported", "unsupported")
    any_decided = decided("classification") | decided("legal_basis") | decided("explanation")
    bare = full.where(any_decided & F.col("cites_provision").isNull())
    basis = full.where(decided("legal_basis") & F.col("offers_provision") & ~F.coalesce("cites_provision", F.lit(True)))
    rows = [
        out(unknown, "item_not_in_packet", F.col("item_id")),
        out(twice, "item_named_twice", F.col("item_id")),
        out(absent, "source_not_in_packet", F.col("source")),
        out(ungrounded, "quote_not_in_source", F.col("source")),
        out(bare, "decided_without_evidence", F.lit("")),
        out(basis, "basis_without_provision", F.lit("")),
    ]
    for c, applies in (("legal_basis", "basis_applies"), ("explanation", "explanation_applies")):
        excused = (F.col(applies) == "required") & (F.col(c) == "not_applicable")
        judged = (F.col(applies) == "not_applicable") & (F.col(c) != "not_applicable")
        rows += [out(full.where(excused), "criterion_required", F.lit(c)), out(full.where(judged), "criterion_not_applicable", F.lit(c))]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole


def deterministic_errors(findings: DataFrame, problems: DataFrame) -> DataFrame:
    """finding_id, error: quotes recorded as fabricated, and findings that claim an uncitable basis."""
    quotes = findings.where("quote_resolution = 'quote_fabricated'").select("finding_id", F.lit("quote_not_in_document").alias("error"))
    bases = problems.where("problem = 'uncitable'").select("finding_id").distinct().withColumn("error", F.lit("basis_not_in_corpus"))
    return quotes.unionByName(bases.join(findings.select("finding_id").distinct(), "finding_id", "left_semi"))


def comparisons(cells: DataFrame, limits: dict[str, float], complete: bool = True) -> DataFrame:
    """series, scope, pair, completeness_delta, precision_delta, basis_delta, decided, decision.

    For the cohort and each stratum, mid against off and on against mid: the mean difference of completeness and of
    basis accuracy over documents (undefined if a document of the later arm is), the difference of precision over
    summed counts, and the smaller number of decided findings. Evidence is weighed before direction: undefined or too
    few is undecided, then a loss, then a gain. limits: completeness_gain, basis_gain, completeness_loss, basis_loss,
    precision_loss, decided. cells(series, document_id, arm, stratum, dimension, numerator, denominator, rate).
    """
    scoped = cells.withColumn("scope", F.explode(F.array(F.lit("cohort"), F.col("stratum").cast("string"))))
    names = ("precision", "completeness", "legal_basis_accuracy")
    scoped = scoped.where(F.col("dimension").isin(*names))
    by = ["series", "scope", "arm", "dimension"]
    sums = scoped.groupBy(*by).agg(F.sum("numerator").alias("n"), F.sum("denominator").alias("d"))
    micro = F.try_divide(F.col("n").cast("double"), F.col("d"))
    wide = sums.groupBy("series", "scope", "arm").agg(
        F.max(F.when(F.col("dimension") == "precision", micro)).alias("precision"),
        F.min(F.when(F.col("dimension") != "completeness", F.col("d"))).alias("decided"),
    )
    doc = scoped.groupBy("series", "scope", "document_id", "arm").agg(
        F.max(F.when(F.col("dimension") == "completeness", F.col("rate"))).alias("c"), F.max(F.when(F.col("dimension") == "legal_basis_accuracy", F.col("rate"))).alias("b")
    )
    result = None
    for pair, later, earlier in (("mid_off", "mid", "off"), ("on_mid", "on", "mid")):
        a, b = (doc.where(F.col("arm") == x).drop("arm") for x in (later, earlier))
        both = a.join(b.withColumnsRenamed({"c": "c0", "b": "b0"}), ["series", "scope", "document_id"], "left").withColumn("dc", F.col("c") - F.col("c0")).withColumn("db", F.col("b") - F.col("b0"))
        mean = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
        macro = both.groupBy("series", "scope").agg(mean("dc").alias("completeness_delta"), mean("db").alias("basis_delta"))
        x, y = (wide.where(F.col("arm") == z).select("series", "scope", F.col("precision").alias(f"p{i}"), F.col("decided").alias(f"n{i}")) for i, z in enumerate((later, earlier)))
        got = cells.select("series").distinct().join(scoped.select("scope").distinct().hint("broadcast"), how="cross").join(macro, ["series", "scope"], "left").join(x, ["series", "scope"], "left").join(y, ["series", "scope"], "left")
        got = got.select(
            "series", "scope", F.lit(pair).alias("pair"), "completeness_delta", (F.col("p0") - F.col("p1")).alias("precision_delta"), "basis_delta", F.least(F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))).alias("decided")
        )
        result = got if result is None else result.unionByName(got)
    c, p, b, slack = F.col("completeness_delta"), F.col("precision_delta"), F.col("basis_delta"), 1e-12
    decision = (
        F.when(~F.lit(complete), "incomplete")
        .when(c.isNull() | p.isNull() | b.isNull() | (F.col("decided") < limits["decided"]), "undecided")
        .when((c < -limits["completeness_loss"] - slack) | (b < -limits["basis_loss"] - slack) | (p < -limits["precision_loss"] - slack), "loss")
        .when((c + slack >= limits["completeness_gain"]) & (b + slack >= limits["basis_gain"]), "criterion_met")
        .otherwise("below_threshold")
    )
    return result.withColumn("decision", decision)
