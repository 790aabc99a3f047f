"""Where findings are anchored, and how their rows are dealt."""

from clausemill.operators import verdicts


def test_findings_meet_their_place_and_not_their_document(spark):
    findings = spark.createDataFrame(
        [("a", 1, 0, None, None), ("b", 1, 1, None, None), ("c", 1, 1, None, None), ("d", 1, 0, 12, 15), ("e", 1, 9, None, None), ("f", 2, 1, 99, 104), ("g", 7, 1, 3, 4), ("h", None, 1, 3, 4), ("i", 1, 1, 12, 19)],
        "key string, doc_id long, unit_id int, quote_start long, quote_end long",
    )
    units = spark.createDataFrame([(d, u, u * 10, u * 10 + 10, u == 0) for d in (1, 2) for u in (0, 1)], "doc_id long, unit_id int, start int, end int, whole boolean")
    anchors = spark.createDataFrame([(1, 0, 0, 0, 11), (1, 1, 1, 11, 30), (1, 2, 2, 10, 30)], "doc_id long, idx long, page long, start_offset long, end_offset long")
    got = verdicts.anchor_findings(findings, units, anchors, spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Sort [key" not in plan
    want = [("a", 1, None, None, None, None), ("b", 1, 10, 20, "unit", 0), ("c", 1, 10, 20, "unit", 0), ("d", 1, 12, 15, "quote", 1), ("e", 1, None, None, None, None), ("f", 2, 99, 104, "quote", None), ("i", 1, 12, 19, "quote", 1)]
    assert sorted(tuple(r) for r in got.collect()) == want
    every = verdicts.anchor_findings(findings, units, anchors)
    assert sorted((tuple(r) for r in every.collect()), key=lambda r: r[0]) == sorted([*want, ("g", 7, 3, 4, "quote", None), ("h", None, 3, 4, "quote", None)])
