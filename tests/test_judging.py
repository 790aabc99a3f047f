"""What is judged."""

from clausemill.operators import judging


def test_no_text_travels_with_a_finding(spark):
    findings = spark.createDataFrame(
        [(1, 7, "on", "a", "consistent", 0, 2, ["p1", "x"]), (1, 7, "on", "b", "consistent", None, 2, []), (1, 7, "on", "c", "consistent", 3, 9, ["p2"]), (1, 8, "on", "d", "consistent", 0, 1, ["p1"])],
        "series int, document_key long, arm string, finding_id string, code string, start int, end int, locators array<string>",
    ).repartition("finding_id").distinct()
    none = "locator string"
    problems = judging.basis_problems(findings, spark.createDataFrame([("p1",)], none), spark.createDataFrame([("p", True)], "act string, prepared boolean"), spark.createDataFrame([], none), "(p)[0-9]+")
    views = judging.finding_views(findings, spark.createDataFrame([(7, "words")], "doc_id long, text string"), problems)
    plan = views._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(document_key") == 0 and "text" not in plan.replace("quoted_text", "")
    got = sorted((r["finding_id"], r["quoted_text"], r["claimed_bases"], r["absent_bases"]) for r in views.collect())
    assert got == [("a", "wo", ["p1", "x"], ["x"]), ("b", None, [], []), ("c", None, ["p2"], ["p2"])]
