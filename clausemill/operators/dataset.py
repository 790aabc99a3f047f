"""Rules of an evaluation dataset: its manifest, entries, texts and where they come from; rules of run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.operators import quality, references, structure
from clausemill.sources.staging import staged

#: Values that fields may have, and the patterns of words, references and codes. Fixed values.
STRATA = ("synthetic_fixture", "real_source")
PROVENANCE_KINDS = ("publisher_retrieved", "author_scan")
RIGHTS_STATUS = ("verified_reusable", "reuse_conditions_recorded", "unsettled", "url_only", "excluded")
PII_STATUS = ("not_screened", "pattern_screened_and_reviewed", "requires_derivative_redaction", "excluded_personal_data")
MEASURED = ("read_mode", "chars", "words", "tokens", "segmentation_mode", "pipeline_treats_as_fallback", "unit_count", "reference_count", "resolved_reference_count", "on_context_edges")
MARKER = "MATERIAŁ SYNTETYCZNY DO EWALUACJI — NIE JEST WZOREM"
WORD = r"(?U)\b[\w-]+\b"
REFERENCE = r"(?iU)(?:§\s*\d+|punkt(?:u|em|cie)?\s+\d+|ust\.\s*\d+|załącznik(?:a|u|iem)?\s+(?:nr\s+)?[A-Z0-9–-]+)"
CODE = "^[a-z][a-z0-9_]*$"
SCHEMA_VERSION, FROZEN = 2, "split_frozen"


def broken(df: DataFrame, key: Column, rules: dict[str, Column], detail: dict[str, Column] | None = None) -> DataFrame:
    """rule, key, detail: a row for each rule whose condition holds; a condition that is null does not hold."""
    told = F.array(*[F.when(when, F.struct(F.lit(name).alias("rule"), F.coalesce((detail or {}).get(name, F.lit("")).cast("string"), F.lit("null")).alias("detail"))) for name, when in rules.items()])
    rows = df.select(F.coalesce(key.cast("string"), F.lit("null")).alias("key"), F.explode(F.filter(told, lambda x: x.isNotNull())).alias("v"))
    return rows.select(F.col("v.rule").alias("rule"), "key", F.col("v.detail").alias("detail"))


def _not(column: Column, *allowed: object) -> Column:
    return ~F.coalesce(column.isin(*allowed), F.lit(False))


def entry_rules(entries: DataFrame, sources: DataFrame, frozen: DataFrame) -> DataFrame:
    """rule, key, detail of entries(id, stratum, source, pii_status, logical_case, split, adjudication_status, language,
    measured map<string,string>) against sources(source) and the frozen split(logical_case, split).

    id_missing, duplicate_id, stratum_unknown, source_undeclared, pii_status_unknown, case_not_frozen, split_differs,
    assessment_started, language_not_pl, and measured_missing and measured_null for each field that ingestion measures.
    """
    known = sources.select("source").distinct().withColumn("declared", F.lit(True))
    split = frozen.select("logical_case", F.col("split").alias("frozen_split"))
    rows = entries.join(known, "source", "left").join(split, "logical_case", "left")
    key = F.nullif(F.col("id"), F.lit(""))
    c = F.col
    got = broken(
        rows,
        key,
        {
            "id_missing": key.isNull(),
            "stratum_unknown": _not(c("stratum"), *STRATA),
            "source_undeclared": c("declared").isNull(),
            "pii_status_unknown": _not(c("pii_status"), *PII_STATUS),
            "case_not_frozen": c("frozen_split").isNull(),
            "split_differs": c("frozen_split").isNotNull() & ~c("split").eqNullSafe(c("frozen_split")),
            "assessment_started": _not(c("adjudication_status"), "not_started"),
            "language_not_pl": _not(c("language"), "pl"),
        },
        {"split_differs": c("frozen_split"), "case_not_frozen": c("logical_case"), "source_undeclared": c("source")},
    )
    measured = F.coalesce("measured", F.create_map().cast("map<string,string>"))
    field = entries.select(key.alias("key"), measured.alias("m"), F.explode(F.array(*map(F.lit, MEASURED))).alias("field"))
    state = F.when(~F.map_contains_key("m", F.col("field")), "measured_missing").when(F.try_element_at("m", F.col("field")).isNull(), "measured_null")
    unmeasured = field.select(state.alias("rule"), F.coalesce("key", F.lit("null")).alias("key"), F.col("field").alias("detail")).where("rule is not null")
    twice = entries.where(key.isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").alias("key"), F.col("n").cast("string").alias("detail"))
    return got.unionByName(unmeasured).unionByName(twice)


def text_counts(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sha256, word_count, byte_count, internal_reference_count, marked of documents(key, text): marked, whether the first
    line begins with the marker of synthetic material."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    return documents.select(key, F.sha2("text", 256).alias("sha256"), n(WORD).alias("word_count"), F.octet_length("text").alias("byte_count"), n(REFERENCE).alias("internal_reference_count"), F.col("text").startswith(MARKER).alias("marked"))


def text_rules(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """rule, key, detail of synthetic entries(id, path, sha256, word_count, byte_count, internal_reference_count, synthetic,
    text_contains_personal_data, file_metadata_contains_personal_data, rights_basis, license) against documents(id, text).

    The path must name a .txt file that is there; counts and hash must be the text's; the first line must bear the marker;
    the flags, rights and license must be those of material made here; and no prohibited pattern may occur.
    """
    counts = ("sha256", "word_count", "byte_count", "internal_reference_count")
    of_text = text_counts(documents, "id").select("id", "marked", *[F.col(c).alias(f"text_{c}") for c in counts], F.lit(True).alias("held"))
    c = F.col
    held = c("held").isNotNull()
    rules = {"path_not_txt": ~F.coalesce(c("path").endswith(".txt"), F.lit(False)), "file_missing": ~held}
    rules |= {f"{x}_mismatch": held & ~c(x).cast("string").eqNullSafe(c(f"text_{x}").cast("string")) for x in counts}
    rules |= {
        "marker_missing": held & ~F.coalesce("marked", F.lit(False)),
        "not_synthetic": _not(c("synthetic"), True),
        "text_personal_data": _not(c("text_contains_personal_data"), False),
        "metadata_personal_data": _not(c("file_metadata_contains_personal_data"), False),
        "rights_basis": _not(c("rights_basis"), "clean_room_project_original"),
        "license": _not(c("license"), "CC0-1.0"),
    }
    got = broken(entries.join(of_text, "id", "left"), c("id"), rules, {f"{x}_mismatch": c(f"text_{x}") for x in counts[1:]})
    ids = entries.select(F.col("id").alias("doc_id")).distinct()
    found = quality.prohibited(documents.select(F.col("id").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"))
    return got.unionByName(found.select(F.lit("prohibited").alias("rule"), F.col("doc_id").cast("string").alias("key"), F.col("label").alias("detail")))


def provenance_rules(entries: DataFrame, acquired: DataFrame, stored: DataFrame) -> DataFrame:
    """rule, key, detail of real entries(id, path, synthetic, provenance_record, text_contains_personal_data,
    file_metadata_contains_personal_data) against the acquisition record(name, provenance_kind, scan_of, acquired_sha256,
    acquired_byte_count, derivative_fields_blanked, stored_sha256, stored_byte_count) and the files stored(path, sha256, byte_count).

    A scan must name what it was made from, and that must be in the record; what a publisher served must have its hash and
    size. Blanked fields must be listed, if only by an empty list. The stored file's size and hash are those recorded.
    """
    c = F.col
    name = F.regexp_extract("path", "([^/]+)$", 1)
    record = acquired.select(*[F.col(x).alias(f"r_{x}") for x in acquired.columns])
    files = stored.select("path", F.col("sha256").alias("f_sha256"), F.col("byte_count").alias("f_bytes"))
    origin = acquired.select(F.col("name").alias("r_scan_of"), F.lit(True).alias("origin")).distinct()
    rows = entries.withColumn("r_name", name).join(record, "r_name", "left").join(files, "path", "left").join(origin, "r_scan_of", "left")
    rows = rows.withColumn("recorded", c("r_provenance_kind").isNotNull() | c("r_stored_sha256").isNotNull() | c("r_derivative_fields_blanked").isNotNull())
    here, filed = c("recorded"), c("f_sha256").isNotNull()
    empty = lambda x: F.coalesce(x.cast("string").isin("", "0"), F.lit(True))
    scan, served = c("r_provenance_kind") == "author_scan", c("r_provenance_kind") == "publisher_retrieved"
    rules = {
        "path_outside": ~F.coalesce(c("path").startswith("source-files/"), F.lit(False)),
        "file_missing": ~filed,
        "synthetic": _not(c("synthetic"), False),
        "provenance_record": _not(c("provenance_record"), "source-files/acquisition.json"),
        "metadata_personal_data": _not(c("file_metadata_contains_personal_data"), False),
        "text_personal_data": _not(c("text_contains_personal_data"), False),
        "no_record": ~here,
        "kind_unknown": here & _not(c("r_provenance_kind"), *PROVENANCE_KINDS),
        "scan_without_origin": here & scan & empty(c("r_scan_of")),
        "scan_origin_unknown": here & scan & ~empty(c("r_scan_of")) & c("origin").isNull(),
        "acquired_sha256_missing": here & served & empty(c("r_acquired_sha256")),
        "acquired_byte_count_missing": here & served & empty(c("r_acquired_byte_count")),
        "blanked_fields_missing": here & c("r_derivative_fields_blanked").isNull(),
        "byte_count_differs": here & filed & ~c("f_bytes").eqNullSafe(c("r_stored_byte_count")),
        "sha256_differs": here & filed & ~c("f_sha256").eqNullSafe(c("r_stored_sha256")),
    }
    return broken(rows, c("id"), rules)


def manifest_rules(manifests: DataFrame) -> DataFrame:
    """rule, key, detail of dataset manifests(key, body), JSON objects: their version and status, the policy of the split, the
    rights of each source, and what is said of lengths.

    A source with rights other than verified_reusable needs a next_closing_action; a reference that does not transfer needs
    its limitation. Values must be of their type: a true is not "true". What is no JSON object breaks not_an_object alone.
    """
    v = manifests.select("key", F.try_parse_json("body").alias("v"))
    at = lambda path, kind="string": F.try_variant_get("v", path, kind)
    type_of = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    v = v.withColumn("fields", fields)
    whole = v.where("fields is not null")
    said = lambda path: F.coalesce(at(path), F.lit("")) != ""
    policy, length = type_of("$.split_policy").startswith("OBJECT"), type_of("$.length_description").startswith("OBJECT")
    transfers = "$.length_description.external_reference_transferable_to_this_evaluation"
    sources = F.coalesce(F.try_variant_get("v", "$.sources", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    got = broken(
        whole,
        F.col("key"),
        {
            "schema_version": (type_of("$.schema_version") != "BIGINT") | _not(at("$.schema_version", "long"), SCHEMA_VERSION),
            "status": _not(at("$.status"), FROZEN),
            "split_policy_missing": ~policy,
            "split_policy_state": policy & _not(at("$.split_policy.current_state"), FROZEN),
            "split_policy_unit": policy & _not(at("$.split_policy.unit"), "logical_case"),
            "split_policy_protocol": policy & ~said("$.split_policy.protocol_document"),
            "holdout_not_protected": policy & ((type_of("$.split_policy.holdout_must_remain_untouched") != "BOOLEAN") | _not(at("$.split_policy.holdout_must_remain_untouched", "boolean"), True)),
            "no_sources": F.size(sources) == 0,
            "length_description_missing": ~length,
            "reference_tokens": length & (type_of("$.length_description.external_reference_tokens") != "BIGINT"),
            "reference_transfer": length & (type_of(transfers) != "BOOLEAN"),
            "reference_limitation": length & (type_of(transfers) == "BOOLEAN") & ~at(transfers, "boolean") & ~said("$.length_description.external_reference_limitation"),
        },
    )
    each = whole.select("key", F.explode(sources).alias("name", "v"))
    rights = broken(
        each,
        F.col("key"),
        {
            "rights_status": _not(at("$.rights_status"), *RIGHTS_STATUS),
            "rights_evidence": ~said("$.rights_evidence"),
            "closing_action": _not(at("$.rights_status"), "verified_reusable") & ~said("$.next_closing_action"),
        },
        {x: F.col("name") for x in ("rights_status", "rights_evidence", "closing_action")},
    )
    odd = v.where("fields is null").select(F.lit("not_an_object").alias("rule"), F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("key"), F.lit("").alias("detail"))
    return got.unionByName(rights).unionByName(odd)


def profile(documents: DataFrame) -> DataFrame:
    """doc_id, chars, words, segmentation_mode, pipeline_treats_as_fallback, unit_count, reference_count,
    resolved_reference_count, on_context_edges of documents(doc_id, text).

    The mode is structural where some level is structural enough, else window_fallback; whether the pipeline treats a
    document as fallback is told by its units, which overlap or not. Texts of white space alone have no units.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = staged(structure.segment(docs))
    resolved = staged(references.references(docs, spans.drop("mode")))
    units = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unit_count"), F.first("mode").alias("mode"))
    refs = resolved.groupBy("doc_id").agg(F.count(F.lit(1)).alias("reference_count"), F.count_if(F.col("status") == "resolved").alias("resolved_reference_count"))
    edges = references.context_edges(resolved).groupBy("doc_id").agg(F.count(F.lit(1)).alias("on_context_edges"))
    sized = docs.select("doc_id", F.length("text").alias("chars"), F.regexp_count("text", F.lit(r"(?U)[^\s\x1c-\x1f]+")).alias("words"))
    joined = sized.join(units, "doc_id", "left").join(structure.is_fallback(spans), "doc_id", "left").join(refs, "doc_id", "left").join(edges, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    mode = F.when(F.col("mode") == "structural", "structural").otherwise("window_fallback")
    return joined.select("doc_id", n("chars"), n("words"), mode.alias("segmentation_mode"), F.coalesce("fallback", F.lit(False)).alias("pipeline_treats_as_fallback"), *map(n, ("unit_count", "reference_count", "resolved_reference_count", "on_context_edges")))


def segmentation_modes(documents: DataFrame) -> DataFrame:
    """doc_id, chars, segmentation_mode of documents(doc_id, text), as profile tells them; neither units nor references are made."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = structure.choose_level(structure.level_stats(structure.markers(docs)))
    rows = docs.select("doc_id", F.length("text").cast("long").alias("chars")).join(chosen, "doc_id", "left")
    return rows.select("doc_id", "chars", F.when(F.col("level").isNotNull(), "structural").otherwise("window_fallback").alias("segmentation_mode"))


def coverage(profiles: DataFrame, entries: DataFrame) -> DataFrame:
    """stratum (null: all), entries, shortest, longest, units, references, resolved, edges of profiles(doc_id, ..) of
    entries(doc_id, stratum)."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    rows = entries.select("doc_id", "stratum").join(profiles, "doc_id")
    return rows.rollup("stratum").agg(F.count(F.lit(1)).alias("entries"), F.min("chars").alias("shortest"), F.max("chars").alias("longest"), total("unit_count", "units"), total("reference_count", "references"), total("resolved_reference_count", "resolved"), total("on_context_edges", "edges"))


def run_record_rules(runs: DataFrame) -> DataFrame:
    """rule, key, detail of runs(run_id, concurrency, wall_budget_seconds, parameters map<string,string>, error_code,
    interruption_reason, parent_run_id, interaction, measurement_valid, cost, cost_unknown_reason, price_table_date,
    price_table_hash).

    Bounds; names of parameters and codes in lower snake case; wall_time as the only reason of an interruption; a parent
    exactly where there is an interaction, which is never a valid measurement; and a cost either known, not negative and
    with a dated price table, or unknown, with a reason and no table.
    """
    c = F.col
    code = lambda x: x.isNotNull() & ~x.rlike(CODE)
    said = lambda x: F.coalesce(x != "", F.lit(False))
    known, table = c("cost").isNotNull(), c("price_table_date").isNotNull()
    odd = F.array_join(F.array_sort(F.filter(F.map_keys(F.coalesce("parameters", F.create_map().cast("map<string,string>"))), lambda k: ~k.rlike(CODE))), ",")
    return broken(
        runs,
        c("run_id"),
        {
            "invalid_bounds": (c("concurrency") < 1) | (c("wall_budget_seconds") <= 0),
            "parameter_name": odd != "",
            "error_code": code(c("error_code")),
            "interruption_reason": c("interruption_reason").isNotNull() & (c("interruption_reason") != "wall_time"),
            "parent_without_interaction": c("parent_run_id").isNull() != c("interaction").isNull(),
            "interactive_valid": c("interaction").isNotNull() & F.coalesce("measurement_valid", F.lit(False)),
            "unknown_cost_without_reason": ~known & ~said(c("cost_unknown_reason")),
            "unknown_cost_reason": ~known & said(c("cost_unknown_reason")) & code(c("cost_unknown_reason")),
            "unknown_cost_with_table": ~known & (table | c("price_table_hash").isNotNull()),
            "negative_cost": c("cost") < 0,
            "known_cost_without_table": known & ~(table & said(c("price_table_hash"))),
            "known_cost_with_reason": known & c("cost_unknown_reason").isNotNull(),
        },
        {"parameter_name": odd, "error_code": c("error_code"), "unknown_cost_reason": c("cost_unknown_reason")},
    )


def attempt_record_rules(attempts: DataFrame) -> DataFrame:
    """rule, key, detail of attempts(run_id, seq, input_tokens, output_tokens, latency_ms, retry_number, parameters
    map<string,string>, error_code): counters are not negative, names and codes are lower snake case."""
    odd = F.array_join(F.array_sort(F.filter(F.map_keys(F.coalesce("parameters", F.create_map().cast("map<string,string>"))), lambda k: ~k.rlike(CODE))), ",")
    counters = ("input_tokens", "output_tokens", "latency_ms", "retry_number")
    rules = {f"negative_{x}": F.col(x) < 0 for x in counters} | {"parameter_name": odd != "", "error_code": F.col("error_code").isNotNull() & ~F.col("error_code").rlike(CODE)}
    return broken(attempts, F.concat_ws("/", F.col("run_id").cast("string"), F.col("seq").cast("string")), rules, {"parameter_name": odd, "error_code": F.col("error_code")})
