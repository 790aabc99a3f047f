"""Recorded files, cells, bundles and keys on nulls, repeats and paths that climb."""

import hashlib

from clausemill.operators import evidence

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def told(df):
    return sorted((r["rule"], r["key"], r["detail"]) for r in df.collect())


def test_paths_and_hashes(spark):
    declared = spark.createDataFrame([(1, p, "h") for p in ("a/b", "/a", "../a", "a/../..", "a/../b", "./a/.././../x", "a//b/../../c")] + [(1, "same", None)], "series int, path string, sha256 string")
    stored = spark.createDataFrame([(1, "a/b", "h"), (1, "a/../b", None), (1, "same", None), (2, "/a", "h")], "series int, path string, sha256 string")
    needed = spark.createDataFrame([(1, "a/b"), (1, "none"), (1, "none"), (2, "a/b")], "series int, path string")
    assert told(evidence.file_rules(declared, stored, needed)) == sorted(
        [("path_outside", f"1/{p}", "") for p in ("/a", "../a", "a/../..", "./a/.././../x")]
        + [("file_missing", f"1/{p}", "") for p in ("/a", "../a", "a/../..", "./a/.././../x", "a//b/../../c")]
        + [("sha256_mismatch", "1/a/../b", "null"), ("hash_undeclared", "1/none", ""), ("hash_undeclared", "2/a/b", "")]
    )


def test_grid_of_a_series(spark):
    series = spark.createDataFrame([(1, "recorded", 3), (2, "planned", 9), (3, None, None), (4, "recorded", 1)], "series int, state string, findings_recorded int")
    cohort = spark.createDataFrame([(1, "d", "h"), (2, "d", "h"), (4, "e", "h")], "series int, document_key string, content_sha256 string")
    runs = spark.createDataFrame([(1, "d", "off", "off", "completed", True, "h", "s", 3), (1, "d", "mid", None, "completed", None, None, None, None), (1, "x", "on", "on", "completed", True, "h", "s", 8)], "series int, document_key string, arm string, recorded_arm string, status string, measurement_valid boolean, document_sha256 string, snapshot_id string, findings int")
    assert told(evidence.grid_rules(series, ["recorded", "planned"], cohort, runs)) == sorted(
        [("state_undefined", "3", "null"), ("run_missing", "1/d/on", ""), ("findings_recorded", "4", "0"), *(("run_missing", f"4/e/{a}", "") for a in evidence.ARMS)]
        + [(r, "1/d/mid", "") for r in ("document_hash_differs", "arm_mismatch", "not_measured", "snapshot_missing", "findings_missing")]
    )


def test_bundles_bind_to_their_runs(spark):
    documents = spark.createDataFrame([("a", "x", sha("x")), ("b", None, None), ("c", "", sha("")), ("d", "x", None)], "key string, text string, content_sha256 string")
    provisions = spark.createDataFrame([("p1", "law:p1", "x", sha("x")), ("p2", None, "x", sha("x")), (None, "none", "x", "y")], "key string, locator string, text string, content_sha256 string")
    acts = lambda *xs: spark.createDataFrame([(x,) for x in xs], "act string")
    assert told(evidence.bundle_rules(documents, provisions, "law:(.+)", acts("k", "k", "l"), acts("k"))) == sorted(
        [("document_text_missing", "b", ""), ("document_text_missing", "c", ""), ("document_hash_differs", "d", ""), ("provision_key_differs", "p2", "null"), ("provision_hash_differs", "null", ""), ("act_undeclared", "l", "")]
    )
    bundles = spark.createDataFrame([(1, "s", True), (2, "s", True), (3, "s", False), (4, "s", True), (5, None, True)], "key int, snapshot_id string, snapshot_verified boolean")
    runs = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s"), (2, "t"), (3, "t"), (5, "s")], "key int, snapshot_id string")
    assert told(evidence.binding_rules(bundles, runs)) == [("snapshot_not_searched", "2", "s,t"), ("snapshot_not_searched", "4", ""), ("snapshot_not_searched", "5", "s")]


def test_keys(spark):
    keys = spark.createDataFrame([("k", "h", None), ("l", "h", "h"), ("m", None, "h")], "key string, sha256 string, pinned_sha256 string")
    items = spark.createDataFrame([("k", "i", "scored", 1, "d"), ("k", "i", "scored", 1, "d"), ("l", None, None, None, None), ("l", "j", "scored", 0, "d")], "key string, item_id string, status string, n_answers int, document_key string")
    cohort = spark.createDataFrame([("k", "d", "c"), ("l", "d", "c")], "key string, document_key string, content_sha256 string")
    documents = spark.createDataFrame([("k", "d", "c")], "key string, document_key string, content_hash string")
    assert told(evidence.key_rules(keys, items, documents, cohort)) == sorted(
        [("key_hash_differs", "m", "null"), ("no_items", "m", ""), ("duplicate_item", "k/i", "2"), ("document_hash_differs", "l/d", "null"), ("item_unsettled", "l/j", "")] + [(r, "l/null", "") for r in ("item_id_missing", "item_unsettled", "item_document_unknown")]
    )
