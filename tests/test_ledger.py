"""Calls that name what their ledger did not hold yet."""

from clausemill.operators import ledger

KEYS = ["unit"]


def told(df):
    return sorted((r["key"], r["rule"], r["detail"]) for r in df.collect())


def setup(spark):
    searches = spark.createDataFrame([(1, 2, ["a", "b", None]), (1, 9, ["z"]), (2, 5, None)], "unit int, seq int, results array<string>")
    reads = spark.createDataFrame(
        [(1, 3, "researcher", None, "c"), (1, 4, "researcher", None, "nowhere"), (1, 5, "analyst", "x", "d"), (1, 6, "analyst", "x", "z"), (1, 7, "analyst", "x", "a"), (1, 10, "verifier", "x", "q"), (1, 11, "verifier", "x", "a"), (1, 12, "verifier", "x", "c"), (1, 13, "verifier", "x", "a"), (1, 14, "verifier", "y", "nowhere"), (1, 15, "verifier", None, None)],
        "unit int, seq int, role string, candidate_id string, locator string",
    )
    corpus = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("z",), ("z",)], "locator string")
    return searches, reads, corpus, ledger.ledger(searches, reads, corpus, KEYS)


def test_ledger_holds_the_first_bringing(spark):
    assert sorted(tuple(r) for r in setup(spark)[3].collect()) == [(1, "a", 2), (1, "b", 2), (1, "c", 3), (1, "z", 9)]


def test_posts(spark):
    searches, _, corpus, held = setup(spark)
    one = lambda *xs: [(x, also) for x, also in xs]
    posts = spark.createDataFrame(
        [(1, 1, []), (1, 3, []), (1, 4, one(("a", ["b"]), ("b", None))), (1, 5, one(("a", []), ("a", []))), (1, 6, one(("a", ["z"]))), (1, 10, one(("z", ["a"]))), (1, 11, one(("d", []))), (2, 5, None), (2, 6, None), (3, 1, one(("a", []))), (1, 12, one((None, [])))],
        "unit int, seq int, candidates array<struct<locator: string, supporting: array<string>>>",
    )
    assert told(ledger.refused_posts(posts, searches, held, corpus, KEYS)) == [
        ("1/1", "no_search_before_empty_commit", ""),
        ("1/11", "locator_not_in_provenance_ledger", "d"),
        ("1/12", "locator_not_in_provenance_ledger", "null"),
        ("1/5", "duplicate_candidate", ""),
        ("1/6", "locator_not_in_provenance_ledger", "z"),
        ("2/5", "no_search_before_empty_commit", ""),
        ("3/1", "locator_not_in_provenance_ledger", "a"),
    ]
    gone = corpus.where("locator <> 'a'")
    assert told(ledger.refused_posts(posts.where("seq = 4"), searches, held, gone, KEYS)) == [("1/4", "unknown_locator", "a")]


def test_evidence_reads_and_verdicts(spark):
    _, reads, corpus, held = setup(spark)
    evidence = spark.createDataFrame([(1, 4, ["a", "c"]), (1, 5, ["a", "nope", "d"]), (1, 6, ["d", "nope"]), (1, 7, []), (1, 8, None), (1, 3, ["c"])], "unit int, seq int, evidence array<string>")
    assert told(ledger.refused_evidence(evidence, held, corpus, KEYS)) == [
        ("1/3", "locator_not_in_provenance_ledger", "c"),
        ("1/5", "evidence_locator_unknown", "nope"),
        ("1/6", "locator_not_in_provenance_ledger", "d"),
    ]
    sheet = spark.createDataFrame([(1, "x", 8, ["a", "c"]), (1, "x", 12, ["c"]), (1, "y", 1, ["nowhere"]), (1, "y", 1, None)], "unit int, candidate_id string, seq int, locators array<string>")
    assert told(ledger.refused_reads(reads, held, sheet, corpus, KEYS)) == [
        ("1/10", "locator_not_on_worksheet", "q"),
        ("1/13", "read_limit_reached", "a"),
        ("1/14", "unknown_locator", "nowhere"),
        ("1/15", "locator_not_on_worksheet", ""),
        ("1/4", "unknown_locator", "nowhere"),
        ("1/5", "locator_not_in_provenance_ledger", "d"),
        ("1/6", "locator_not_in_provenance_ledger", "z"),
    ]
    entries = spark.createDataFrame([(1, 1, 10, "note", None), (1, 2, 11, "character", "x"), (1, 3, 12, "character", "y"), (1, 9, 13, "note", None)], "unit int, seq int, entry_id int, kind string, candidate_id string")
    verdicts = spark.createDataFrame([(1, 4, "x", [10, 11]), (1, 5, "x", [12]), (1, 6, "x", [13]), (1, 7, "x", [99]), (1, 8, "y", []), (2, 4, "x", [10])], "unit int, seq int, candidate_id string, based_on array<int>")
    assert told(ledger.refused_verdicts(verdicts, entries, KEYS)) == [(k, "verdict_dependency_not_visible", d) for k, d in (("1/5", "12"), ("1/6", "13"), ("1/7", "99"), ("2/4", "10"))]
