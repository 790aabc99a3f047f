"""Acts: their manifest, their metadata, their articles and the table that is published of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.sources.staging import dealt, staged

#: The relation that names an act's base act, and the one that lists what changed it. Fixed values.
CONSOLIDATION, AMENDING = "Tekst jednolity dla aktu", "Akty zmieniające"
#: Keys that a manifest and its acts may have. Fixed values.
MANIFEST_KEYS = ("version", "corpus_target_date", "acts")
MANIFEST_VERSION = 2
#: Elements of an act's structure that make up an article's path. Fixed values.
SEGMENTS = ("book", "titl", "bran", "chpt", "schp", "arti", "pass", "para", "pint", "lett")


def _rules(df: DataFrame, key: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """rule, key, detail: a row for each rule that a row breaks."""
    every = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    rows = df.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail).alias("detail"))
    return rows


def act_id(publisher: str = "publisher", year: str = "year", position: str = "position") -> Column:
    return F.concat_ws("/", publisher, year, position)


def manifest_rules(acts: DataFrame, target: Column) -> DataFrame:
    """rule, key, detail: claims of a manifest that cannot hold together.

    acts(publisher, year, position, source_format, legal_status_date, expected_hash, repeated_articles, amendments). A
    target date before the act's text; repeated articles or a hash pinned on an HTML act; an act or an amendment listed
    twice; repeated articles out of order.
    """
    html = F.col("source_format") == "html"
    per_act = _rules(
        acts,
        act_id(),
        {
            "target_date_before_text": target < F.col("legal_status_date"),
            "repeated_articles_not_applicable": html & (F.size("repeated_articles") > 0),
            "expected_hash_not_applicable": html & F.col("expected_hash").isNotNull(),
            "duplicate_amendment_entry": F.size("amendments") > F.size(F.array_distinct("amendments")),
            "repeated_articles_not_sorted": F.to_json("repeated_articles") != F.to_json(F.array_sort("repeated_articles")),
        },
    )
    twice = acts.groupBy(act_id().alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_act.unionByName(twice.select(F.lit("duplicate_act_entry").alias("rule"), "key", F.col("n").cast("string").alias("detail")))


def read_manifest(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acts of manifests given as JSON in bodies(key, body), and rule, key, detail of those refused: not an object,
    another version, keys that are not known, no acts."""
    keys = F.json_object_keys("body")
    version = F.get_json_object("body", "$.version")
    unknown = F.array_except(keys, F.array(*map(F.lit, MANIFEST_KEYS)))
    acts = F.from_json(F.get_json_object("body", "$.acts"), "array<map<string,string>>")
    rule = (
        F.when(keys.isNull(), "invalid_manifest")
        .when(~F.coalesce(version == str(MANIFEST_VERSION), F.lit(False)), "unsupported_manifest_version")
        .when(F.size(unknown) > 0, "unknown_key")
        .when(F.coalesce(F.size(acts), F.lit(0)) < 1, "no_acts")
    )
    ruled = bodies.select("key", acts.alias("acts"), rule.alias("rule"), F.array_join(F.array_sort(unknown), ",").alias("unknown"))
    good = ruled.where("rule is null").select("key", F.posexplode("acts").alias("pos", "act"))
    return good, ruled.where("rule is not null").select("rule", F.col("key").cast("string").alias("key"), F.when(F.col("rule") == "unknown_key", F.col("unknown")).otherwise("").alias("detail"))


def decode_json(raw: DataFrame, shape: str) -> DataFrame:
    """raw(key, body) with error: invalid_json, or wrong_shape where the value is not an `object` or `list` as asked."""
    body = F.trim("body")
    kind = F.when(F.try_parse_json("body").isNull(), "invalid_json").when(~body.startswith("{" if shape == "object" else "["), "wrong_shape")
    return raw.select("key", "body", kind.alias("error"))


def base_act(body: str = "body") -> Column:
    """The id of the first base act that an act's metadata names; null where there is none."""
    got = F.get_json_object(body, f"$['references']['{CONSOLIDATION}'][0].id")
    return F.when(got != "", got)


def amendments(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """act_id, amendment_id, amended_on from metadata(act_id, body); and rule, key, detail of malformed relations."""
    listed = F.from_json(F.get_json_object("body", f"$['references']['{AMENDING}']"), "array<struct<id: string, date: string>>")
    held = metadata.select("act_id", listed.alias("entries"))
    rows = held.select("act_id", F.posexplode("entries").alias("pos", "e")).withColumn("amended_on", F.try_to_date(F.col("e.date"), "yyyy-MM-dd"))
    ok = F.coalesce((F.col("e.id") != "") & F.col("amended_on").isNotNull(), F.lit(False))
    bad = rows.where(~ok).select(F.col("act_id").cast("string").alias("key"), F.col("pos").cast("string").alias("detail"))
    none = held.where("entries is null").select(F.col("act_id").cast("string").alias("key"), F.lit("missing").alias("detail"))
    return rows.where(ok).select("act_id", F.col("e.id").alias("amendment_id"), "amended_on"), bad.unionByName(none).select(F.lit("malformed_amendment_relation").alias("rule"), "key", "detail")


def metadata_drift(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """rule, key, detail: acts whose status date, base act or declared format is not what their metadata says.

    manifest(act_id, source_format, legal_status_date, base_act); metadata(act_id, legal_status_date, base_act,
    has_html, has_pdf). Nulls are values. An act without metadata breaks all three.
    """
    m = metadata.select("act_id", F.col("legal_status_date").alias("d"), F.col("base_act").alias("b"), "has_html", "has_pdf")
    both = manifest.join(m, "act_id", "left")
    offered = F.coalesce(F.when(F.col("source_format") == "html", F.col("has_html")).otherwise(F.col("has_pdf")), F.lit(False))
    return _rules(
        both,
        F.col("act_id"),
        {"unexpected_source_format": ~offered, "legal_status_date_drift": ~F.col("legal_status_date").eqNullSafe(F.col("d")), "base_act_mismatch": ~F.col("base_act").eqNullSafe(F.col("b"))},
    )


#: What a repealed article is left with. The number of an article, the note of a repeal after an optional
#: sub-unit, and the lines that may follow it (page furniture, footnotes, editorial notes, headings).
_SUP = "⁰¹²³⁴⁵⁶⁷⁸⁹"
_INDEX = rf"(?:\(\d+\)|\[\d+\]|\^\d+|[{_SUP}]+)"
_NUMBER = rf"(?:Art\.|§)\s*\d+(?:[-–]\d+)?{_INDEX}?[a-z]?\.?"
_NOTE = rf"\(\s*(?:uchylon[aye]|skreślon[aye]|utraci[łl][aye]?\s+moc)\s*\)(?:\s*(?:\d+\)|\[\d+\]|\^\d+|[{_SUP}]+))?"
_SUBUNIT = rf"(?:(?:§\s*\d+(?:[-–]\d+)?{_INDEX}?[a-z]?\.?|\d+[a-z]?\.|\d+[a-z]?\)|[a-z]\))\s*)?{_NOTE}\s*\.?"
_TITLES = r"(?:Rozdzia[łl]|Tytu[łl]|Dzia[łl]|Oddzia[łl]|Ksi[ęe]ga|Cz[ęe][śs][ćc])"
_FURNITURE = r"Dziennik\s+Ustaw\s*[-–—]\s*\d+\s*[-–—]\s*Poz\.\s*\d+"
_EDITORIAL = r"(?:Utraci[łl]\s+moc|Uznan[ya]|Z\s+dniem|W\s+tym\s+brzmieniu|W\s+brzmieniu|Przez\s+art\.)"
_OTHER_ARTICLE = r"(?u)(?<!\w)Art\.\s*\d+"
#: A repealed provision: its number, notes of repeal, and whatever else there is as the one group.
_REPEALED = rf"(?iu)^\s*(?:{_NUMBER})?(?:\s*{_SUBUNIT})+\s*((?s:.*))$"
#: What a line is that follows the notes: print apparatus, or law that is still there. Any other line is a heading.
_LINE_KINDS = {
    "apparatus": rf"(?iu)^(?:{_FURNITURE}|\d+\)\s.*|{_EDITORIAL}.*|{_TITLES}(?!\w).*)$",
    "clause": r"^(?:(?:§|\d+[.)]|[a-z]\)).*|.*;|.{100,}\.)$",
}


def is_repealed(text: Column) -> Column:
    """Whether a provision's text is only the editorial note of its repeal.

    One pattern parts the number and the notes from what follows. Its lines are told apart, and the provision is repealed
    if none of them is a clause and no other article is named: apparatus and headings are no law.
    """
    kind = lambda line: reduce(lambda other, named: F.when(line.rlike(named[1]), named[0]).otherwise(other), reversed(_LINE_KINDS.items()), F.lit("heading"))
    rest = F.regexp_extract(text, _REPEALED, 1)
    kinds = F.transform(F.split(rest, "\n"), lambda line: kind(F.regexp_replace(line, r"^\s+|\s+$", "")))
    return F.coalesce(text.rlike(_REPEALED) & ~F.array_contains(kinds, "clause") & ~rest.rlike(_OTHER_ARTICLE), F.lit(False))


def provision_force(units: DataFrame) -> DataFrame:
    """units with provision_force: not_in_force where only the note of a repeal is left, else undetermined."""
    return units.withColumn("provision_force", F.when(is_repealed(F.col("text")), "not_in_force").otherwise("undetermined"))


def decision_force(candidates: DataFrame) -> DataFrame:
    """candidates(act_force, provision_force) with force and admits: the act's record admits, the provision's vetoes."""
    force = F.when(F.col("provision_force") == "not_in_force", "not_in_force").otherwise(F.col("act_force"))
    return candidates.withColumn("force", force).withColumn("admits", F.coalesce(F.col("force") == "in_force", F.lit(False)))


def force_pair_rules(pairs: DataFrame, key: str) -> DataFrame:
    """rule, key, detail: pairs of force records whose scopes are not act and provision, or whose provision is in force."""
    return _rules(
        pairs,
        F.col(key),
        {
            "admitting_record_not_act": ~F.coalesce(F.col("act_scope") == "act", F.lit(False)),
            "vetoing_record_not_provision": ~F.coalesce(F.col("provision_scope") == "provision", F.lit(False)),
            "provision_in_force": F.coalesce(F.col("provision_force") == "in_force", F.lit(False)),
        },
    )


def _quoted(name: Column) -> Column:
    """A name as part of a path: all but letters, digits and _.-~() percent-encoded."""
    out = F.url_encode(name)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def _text_at(field: str) -> Column:
    """A field of the variant `node`, where it is a string."""
    kind = F.schema_of_variant(F.try_variant_get("node", f"$.{field}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get("node", f"$.{field}", "string"))


def struct_articles(acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """act_id, path, pos, node of every article in acts(act_id, body), a JSON list of nodes with children; and rule, key,
    detail of bodies that are no such list and of nodes that are no objects.

    Containers add their type and name to the path, other nodes are passed through, nodes without a type, and containers
    without a name, go with all they hold, and an article comes whole, as JSON with sorted keys. pos are the places on the
    way down, so its order is the page's.

    Acts are dealt by id and a body is parsed once. Levels are unfolded one by one, as deep as they go: each is written to the shared folder and
    holds only what is still to be unfolded, so none is computed again.
    """
    items = lambda c: F.try_variant_get(c, "$", "array<variant>")
    parsed = staged(dealt(acts.select("act_id", "body"), "act_id").select("act_id", F.try_parse_json("body").alias("body")))
    bad = parsed.where(items("body").isNull()).select("act_id", F.lit("malformed_structure").alias("rule"), F.when(F.col("body").isNull(), "no JSON").otherwise("no list").alias("detail"))
    level = parsed.select("act_id", F.lit("").alias("path"), F.array().cast("array<int>").alias("pos"), "body")
    articles = []
    while True:
        nodes = level.select("act_id", "path", "pos", F.posexplode(items("body")).alias("at", "node"))
        at = F.concat("pos", F.array("at"))
        kind, name = _text_at("type"), _text_at("name")
        step = F.concat(F.when(F.col("path") == "", "").otherwise("/"), kind, F.lit("="), _quoted(name))
        part = kind.isin(*SEGMENTS)
        rows = nodes.where(kind.isNotNull() & (~part | name.isNotNull()))
        rows = staged(rows.select("act_id", F.concat("path", F.when(part, step).otherwise("")).alias("path"), at.alias("pos"), kind.alias("type"), F.when(kind == "arti", F.col("node")).otherwise(F.try_variant_get("node", "$.children", "variant")).alias("body")))
        odd = nodes.where(F.try_variant_get("node", "$", "map<string,variant>").isNull())
        bad = bad.unionByName(odd.select("act_id", F.lit("malformed_node").alias("rule"), F.array_join(at.cast("array<string>"), ",").alias("detail")))
        articles.append(rows.where("type = 'arti'").select("act_id", "path", "pos", F.to_json("body").alias("node")))
        level = rows.where(F.col("type") != "arti").where(F.size(items("body")) > 0).select("act_id", "path", "pos", "body")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, articles), bad.select("rule", F.col("act_id").cast("string").alias("key"), "detail")


def dedupe_struct(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a path, at its first place: act_id, path, pos, node; and rule, key, detail of ambiguous paths.

    Equal nodes collapse, whatever the order of their keys, and one without children yields to one that differs in nothing
    else; of such without children the first stays. Paths are dealt once; equal nodes become one before they are compared.
    """
    whole = F.try_parse_json("node")
    rows = articles.select("act_id", "path", "pos", F.to_json(whole).alias("node"), F.try_variant_get(whole, "$", "map<string,variant>").alias("fields"))
    below = F.to_json(F.col("fields")["children"])
    rows = rows.withColumns({"bare": F.to_json(F.map_filter("fields", lambda k, _: k != "children")), "stub": below.isNull() | below.isin("null", "[]", "{}", '""', "0", "false")})
    rows = rows.select("act_id", "path", "pos", "node", F.sha2("node", 256).alias("hash"), "stub", F.sha2("bare", 256).alias("bare")).repartition("act_id", "path")
    unlike = rows.groupBy("act_id", "path", "hash").agg(F.min("pos").alias("pos"), *[F.first(c).alias(c) for c in ("node", "stub", "bare")])
    per = unlike.groupBy("act_id", "path").agg(
        F.min("pos").alias("pos"),
        F.min_by("node", F.struct("stub", "pos")).alias("node"),
        F.count_if(~F.col("stub")).alias("full"),
        F.count_distinct("bare").alias("heads"),
    )
    clear = (F.col("full") <= 1) & (F.col("heads") == 1)
    refused = per.where(~clear).select(F.lit("ambiguous_struct_path").alias("rule"), F.concat_ws(" ", "act_id", "path").alias("key"), F.greatest("full", "heads").cast("string").alias("detail"))
    return per.where(clear).select("act_id", "path", "pos", "node"), refused


def canonical_number(number: Column) -> Column:
    """An article's number with any way to write its index as N(i); what is no such number as it is."""
    pattern = rf"^(\d+[a-z]*)(?:\((\d+)\)|\[(\d+)\]|\^(\d+)|([{_SUP}]+))?$"
    part = lambda i: F.regexp_extract(number, pattern, i)
    index = F.concat(part(2), part(3), part(4), F.translate(part(5), _SUP, "0123456789"))
    return F.when(~number.rlike(pattern), number).when(index == "", part(1)).otherwise(F.concat(part(1), F.lit("("), index, F.lit(")")))


def article_numbers(headings: DataFrame) -> DataFrame:
    """number, spellings: the sorted spellings of each canonical article number in headings(number)."""
    rows = headings.select(canonical_number(F.col("number")).alias("number"), F.col("number").alias("spelling")).distinct()
    return rows.groupBy("number").agg(F.array_sort(F.collect_list("spelling")).alias("spellings"))


def legal_units(articles: DataFrame, acts: DataFrame, locator: str) -> DataFrame:
    """Unit rows: unit_id, act_id, article, text, content_hash, act_force, provision_force.

    articles(act_id, article, text); acts(act_id, force); locator is a format of act and article.
    """
    rows = provision_force(articles.join(acts.select("act_id", F.col("force").alias("act_force")), "act_id"))
    return rows.select(F.format_string(locator, "act_id", "article").alias("unit_id"), "act_id", "article", "text", F.sha2("text", 256).alias("content_hash"), "act_force", "provision_force")


def format_used(acts: DataFrame) -> DataFrame:
    """acts(act_id, declared, html_ok) with used: html falls back to pdf where it cannot be reached; null if unknown."""
    return acts.withColumn("used", F.when(F.col("declared") != "html", F.col("declared")).when(F.col("html_ok"), "html").when(~F.col("html_ok"), "pdf"))


def snapshot_format(acts: DataFrame, snapshot: str) -> DataFrame:
    """snapshot, source_format, fallback_acts: as_declared, fallback, or unrecorded where any act's format is unknown."""
    unknown = F.col("declared").isNull() | F.col("used").isNull()
    other = ~unknown & (F.col("declared") != F.col("used"))
    status = F.when(F.bool_or(unknown), "unrecorded").when(F.bool_or(other), "fallback").otherwise("as_declared")
    return acts.groupBy(snapshot).agg(status.alias("source_format"), F.array_sort(F.collect_set(F.when(other, F.col("act_id")))).alias("fallback_acts"))


def publish_gate(snapshots: DataFrame) -> DataFrame:
    """snapshots with violation and publish: what keeps a built table from being published.

    snapshots(key, complete, n_units, n_stored, space, other_space, model, probe, pinned_id, snapshot_id). A complete
    one needs nothing; an empty corpus, a stored count that differs, another embedding space under the same name, a
    missing model or probe, and an id other than the pinned one refuse it, in this order.
    """
    c = F.col
    violation = (
        F.when(c("n_units") == 0, "empty_corpus")
        .when(~c("n_units").eqNullSafe(c("n_stored")), "stored_count_differs")
        .when(c("other_space").isNotNull() & (c("space") != c("other_space")), "space_collision")
        .when(c("model").isNull(), "model_missing")
        .when(c("probe").isNull(), "probe_missing")
        .when(c("pinned_id").isNotNull() & (c("pinned_id") != c("snapshot_id")), "snapshot_not_pinned")
    )
    return snapshots.withColumn("violation", F.when(~c("complete"), violation)).withColumn("publish", ~c("complete") & violation.isNull())


def act_currency(acts: DataFrame) -> DataFrame:
    """act_id, legal_status_date, source_format_declared, source_format_used, not_carried: amendments not yet in the text."""
    return acts.select("act_id", "legal_status_date", F.col("declared").alias("source_format_declared"), F.col("used").alias("source_format_used"), F.size("amendments").alias("not_carried"))


_FORCES = ("act_force", "provision_force")
_FORCE_FIELDS = ("value", "scope", "snapshot_date", "source_locator")


def to_payload(units: DataFrame) -> DataFrame:
    """units with the two force structs as eight flat columns."""
    flat = [F.col(f"{f}.{x}").alias(f"{f}_{x}") for f in _FORCES for x in _FORCE_FIELDS]
    return units.select(*[c for c in units.columns if c not in _FORCES], *flat)


def from_payload(rows: DataFrame) -> DataFrame:
    """The reverse of to_payload."""
    flat = {f"{f}_{x}" for f in _FORCES for x in _FORCE_FIELDS}
    return rows.select(*[c for c in rows.columns if c not in flat], *[F.struct(*[F.col(f"{f}_{x}").alias(x) for x in _FORCE_FIELDS]).alias(f) for f in _FORCES])


def provision_map(rows: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """act, article, printing, locator, text keyed by the parsed locator; and rule, key, detail of malformed and repeated
    keys. The anchored pattern has act, article and an optional printing as groups."""
    part = lambda i: F.regexp_extract("locator", f"^{pattern}$", i)
    parsed = rows.select(part(1).alias("act"), part(2).alias("article"), F.nullif(part(3), F.lit("")).alias("printing"), "locator", "text")
    malformed = parsed.where("act = ''").select(F.lit("malformed_locator").alias("rule"), F.col("locator").alias("key"), F.lit("").alias("detail"))
    good = parsed.where("act <> ''")
    n = good.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("act", "article", "printing")))
    twice = n.where("n > 1").select(F.lit("duplicate_key").alias("rule"), "locator", F.col("n").cast("string").alias("detail")).distinct().withColumnRenamed("locator", "key")
    return n.where("n = 1").drop("n"), malformed.unionByName(twice.select("rule", "key", "detail"))
