"""What judging rests on: recorded files and their hashes, the grid of runs, prepared texts, the key, and what binds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.operators.dataset import broken

#: Fixed values.
ARMS = ("off", "mid", "on")


def file_rules(declared: DataFrame, stored: DataFrame, needed: DataFrame) -> DataFrame:
    """rule, key, detail of recorded files by series: declared(series, path, sha256), stored(series, path, sha256) and
    needed(series, path), those that scoring reads.

    path_outside: an absolute path, or one that climbs out of its batch; file_missing: declared and not stored;
    sha256_mismatch; hash_undeclared: needed without a declared hash. Hashes compare as they are written.
    """
    at = ["series", "path"]
    held = stored.select(*at, F.col("sha256").alias("found"), F.lit(True).alias("stored"))
    rows = declared.select(*at, "sha256").join(held, at, "left")
    # climbing out: more steps up than down anywhere on the way
    steps = F.transform(F.filter(F.split("path", "/"), lambda x: ~x.isin("", ".")), lambda x: F.when(x == "..", -1).otherwise(1))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda a, x: F.struct((a["now"] + x).alias("now"), F.least(a["low"], a["now"] + x).alias("low")))
    key = F.concat_ws("/", F.col("series").cast("string"), "path")
    outside = F.col("path").startswith("/") | (depth["low"] < 0)
    got = broken(rows, key, {"path_outside": outside, "file_missing": F.col("stored").isNull(), "sha256_mismatch": F.col("stored").isNotNull() & ~F.col("found").eqNullSafe(F.col("sha256"))}, {"sha256_mismatch": F.col("found")})
    bare = needed.select(*at).distinct().join(declared.select(*at).distinct(), at, "left_anti")
    return got.unionByName(broken(bare, key, {"hash_undeclared": F.lit(True)}))


def grid_rules(series: DataFrame, states: list[str], cohort: DataFrame, runs: DataFrame) -> DataFrame:
    """rule, key, detail of series(series, state, findings_recorded) against the cohort(series, document_key, content_sha256) and
    runs(series, document_key, arm, recorded_arm, status, measurement_valid, document_sha256, snapshot_id, findings).

    state_undefined: a state that is none of `states`, which would drop a series unsaid. Of series that are recorded:
    run_missing for each cell of the cohort and the arms; document_hash_differs, arm_mismatch, not_measured,
    snapshot_missing and findings_missing of its runs; findings_recorded, their number, where the series declares one.
    """
    odd = broken(series, F.col("series"), {"state_undefined": ~F.coalesce(F.col("state").isin(*states), F.lit(False))}, {"state_undefined": F.col("state")})
    on = series.where("state = 'recorded'")
    owed = cohort.select("series", "document_key", "content_sha256", F.explode(F.array(*map(F.lit, ARMS))).alias("arm"))
    cells = owed.join(on.select("series"), "series", "left_semi")
    rows = cells.join(runs.withColumn("held", F.lit(True)), ["series", "document_key", "arm"], "left")
    held = F.col("held").isNotNull()
    rules = {
        "run_missing": ~held,
        "document_hash_differs": held & ~F.col("document_sha256").eqNullSafe(F.col("content_sha256")),
        "arm_mismatch": held & ~F.col("recorded_arm").eqNullSafe(F.col("arm")),
        "not_measured": held & ~F.coalesce((F.col("status") == "completed") & F.col("measurement_valid"), F.lit(False)),
        "snapshot_missing": held & (F.coalesce("snapshot_id", F.lit("")) == ""),
        "findings_missing": held & F.col("findings").isNull(),
    }
    per_cell = broken(rows, F.concat_ws("/", F.col("series").cast("string"), F.col("document_key").cast("string"), "arm"), rules)
    total = rows.groupBy("series").agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("total"))
    counted = on.where("findings_recorded is not null").join(total, "series", "left")
    return odd.unionByName(per_cell).unionByName(broken(counted, F.col("series"), {"findings_recorded": F.coalesce("total", F.lit(0)) != F.col("findings_recorded")}, {"findings_recorded": F.coalesce("total", F.lit(0))}))


def bundle_rules(documents: DataFrame, provisions: DataFrame, pattern: str, prepared: DataFrame, corpus: DataFrame) -> DataFrame:
    """rule, key, detail of prepared documents(key, text, content_sha256) and provisions(key, locator, text,
    content_sha256), the acts prepared(act) and those of the corpus(act).

    text_missing, hash_differs of either; key_differs: stored under a key that the locator does not give (the anchored
    pattern gives it as its first group); act_undeclared: prepared and not of the corpus.
    """
    text = lambda what: {f"{what}_text_missing": F.coalesce("text", F.lit("")) == "", f"{what}_hash_differs": (F.coalesce("text", F.lit("")) != "") & ~F.sha2("text", 256).eqNullSafe(F.col("content_sha256"))}
    key = F.nullif(F.regexp_extract(F.coalesce("locator", F.lit("")), f"^{pattern}$", 1), F.lit(""))
    of_documents = broken(documents, F.col("key"), text("document"))
    of_provisions = broken(provisions, F.col("key"), text("provision") | {"provision_key_differs": ~key.eqNullSafe(F.col("key"))}, {"provision_key_differs": key})
    foreign = prepared.select("act").distinct().join(corpus.select("act").distinct(), "act", "left_anti")
    return of_documents.unionByName(of_provisions).unionByName(broken(foreign, F.col("act"), {"act_undeclared": F.lit(True)}))


def binding_rules(bundles: DataFrame, runs: DataFrame) -> DataFrame:
    """rule, key, detail of bundles(key, snapshot_id, snapshot_verified) that claim a body of law which their runs(key,
    snapshot_id) did not search: of a verified bundle every run carries its snapshot, and some run does."""
    seen = runs.groupBy("key").agg(F.array_sort(F.collect_set("snapshot_id")).alias("seen"))
    rows = bundles.where("snapshot_verified").join(seen, "key", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return broken(rows, F.col("key"), {"snapshot_not_searched": F.col("seen") != F.array(F.coalesce("snapshot_id", F.lit("")))}, {"snapshot_not_searched": F.array_join("seen", ",")})


def key_rules(keys: DataFrame, items: DataFrame, documents: DataFrame, cohort: DataFrame) -> DataFrame:
    """rule, key, detail of answer keys(key, sha256, pinned_sha256), their items(key, item_id, status, n_answers,
    document_key) and documents(key, document_key, content_hash), against the cohort(key, document_key, content_sha256).

    key_hash_differs from a pinned one; no_items; item_id_missing, duplicate_item; item_unsettled: not scored, or without an
    accepted answer; item_document_unknown: not of the cohort; document_hash_differs: a document of the cohort that the key
    does not have, or has with another hash.
    """
    some = items.select("key").distinct().withColumn("some", F.lit(True))
    of_keys = broken(keys.join(some, "key", "left"), F.col("key"), {"key_hash_differs": F.col("pinned_sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("pinned_sha256")), "no_items": F.col("some").isNull()}, {"key_hash_differs": F.col("sha256")})
    named = F.concat_ws("/", F.col("key").cast("string"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    known = cohort.select("key", "document_key", F.lit(True).alias("known"))
    of_items = broken(
        items.join(known, ["key", "document_key"], "left"),
        named,
        {
            "item_id_missing": F.col("item_id").isNull(),
            "item_unsettled": ~F.coalesce((F.col("status") == "scored") & (F.col("n_answers") > 0), F.lit(False)),
            "item_document_unknown": F.col("known").isNull(),
        },
    )
    twice = broken(items.where("item_id is not null").groupBy("key", "item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), named, {"duplicate_item": F.lit(True)}, {"duplicate_item": F.col("n")})
    wanted = cohort.select("key", "document_key", "content_sha256").join(keys.select("key"), "key", "left_semi").join(documents.select("key", "document_key", "content_hash"), ["key", "document_key"], "left")
    of_documents = broken(wanted, F.concat_ws("/", F.col("key").cast("string"), F.col("document_key").cast("string")), {"document_hash_differs": ~F.col("content_hash").eqNullSafe(F.col("content_sha256"))}, {"document_hash_differs": F.col("content_hash")})
    return of_keys.unionByName(of_items).unionByName(twice).unionByName(of_documents)
