"""Dataset and record rules on nulls, empties and odd values."""

import json

from clausemill.operators import dataset


def told(df):
    return sorted((r["rule"], r["key"], r["detail"]) for r in df.collect())


def test_entries_of_nulls_break_their_rules(spark):
    schema = "id string, stratum string, source string, pii_status string, logical_case string, split string, adjudication_status string, language string, measured map<string,string>"
    good = ("a", "real_source", "s", "not_screened", "c", "holdout", "not_started", "pl", {f: "1" for f in dataset.MEASURED})
    rows = spark.createDataFrame([good, (None,) * 9], schema)
    got = dataset.entry_rules(rows, spark.createDataFrame([("s",), ("s",)], "source string"), spark.createDataFrame([("c", "holdout")], "logical_case string, split string"))
    assert {k for _, k, _ in told(got)} == {"null"}
    assert sorted({r for r, _, _ in told(got)}) == ["assessment_started", "case_not_frozen", "id_missing", "language_not_pl", "measured_missing", "pii_status_unknown", "source_undeclared", "stratum_unknown"]
    assert sum(r == "measured_missing" for r, _, _ in told(got)) == len(dataset.MEASURED)


def test_words_and_references(spark):
    texts = [f"{dataset.MARKER}\nŁódź-Widzew, ul. a_b -x- 7-", "§5 i § 12, pkt 3, punktu 4, ust.7, Załącznikiem Nr A-1, załącznik", "", None]
    got = dataset.text_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r["word_count"], r["internal_reference_count"], r["marked"]) for r in got] == [(7 + 5, 0, True), (13, 5, False), (0, 0, False), (None, None, None)]


def test_manifests(spark):
    good = {
        "schema_version": 2, "status": "split_frozen", "sources": {"a": {"rights_status": "verified_reusable", "rights_evidence": "x"}},
        "split_policy": {"current_state": "split_frozen", "unit": "logical_case", "protocol_document": "p", "holdout_must_remain_untouched": True},
        "length_description": {"external_reference_tokens": 1, "external_reference_transferable_to_this_evaluation": True},
    }
    bodies = [json.dumps(good), "{", None, "[]", json.dumps(good | {"schema_version": 2.5}), json.dumps(good | {"sources": [1]}), json.dumps(good | {"sources": {"a": {}, "b": 7}})]
    got = dataset.manifest_rules(spark.createDataFrame(list(enumerate(bodies)), "key int, body string"))
    bad = ("closing_action", "rights_evidence", "rights_status")
    assert told(got) == sorted([("not_an_object", str(i), "") for i in (1, 2, 3)] + [("schema_version", "4", ""), ("no_sources", "5", "")] + [(r, "6", n) for r in bad for n in ("a", "b")])


def test_profile_of_blank_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n\t"), (4, "One. Two.")], "doc_id int, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in dataset.profile(docs).collect()}
    assert got == {1: (0, 0, "window_fallback", False, 0, 0, 0, 0), 2: (0, 0, "window_fallback", False, 0, 0, 0, 0), 3: (3, 0, "window_fallback", False, 0, 0, 0, 0), 4: (9, 2, "window_fallback", False, 1, 0, 0, 0)}
    assert dataset.profile(docs.where("false")).count() == 0


def test_modes_alone_are_those_of_the_profile(spark, monkeypatch):
    texts = ["", None, " \n\t", "One. Two.", "§ 1. a\n§ 2. b\n§ 3. c\n", "§ 1. a\n§ 2. b\n§ 3. " + "c" * 99, "Art. 1 a\nArt. 2 b\nArt. 9 c\nArt. 10 d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = sorted((r["doc_id"], r["chars"], r["segmentation_mode"]) for r in dataset.profile(docs).collect())
    monkeypatch.delattr(dataset, "references")  # nothing but markers is asked for
    assert sorted(tuple(r) for r in dataset.segmentation_modes(docs).collect()) == want
    assert {m for _, _, m in want} == {"structural", "window_fallback"}
