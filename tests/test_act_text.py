"""Raised indexes, headings and articles of acts, case by case."""

import pytest

from clausemill.operators import act_text

CHARS = "doc_id int, page int, seq int, text string, size double, x0 double, x1 double, y0 double, head string, run int"


def page(doc, parts, page=1):
    """Characters of (text, size, y0) parts, and columns whose names the operator uses inside."""
    flat = [(c, s, y) for text, s, y in parts for c in (text if isinstance(text, str) else [*text])]
    return [(doc, page, i, c, s, 5.0 * i, 5.0 * i + 5, y, "h", 3) for i, (c, s, y) in enumerate(flat)]


B, S = (10.0, 100.0), (6.5, 103.0)
CASES = [
    ([("Art. 1", *B)], "Art. 1"),
    ([("Art. 67", *B), ("18", 6.0, 103.0), (".", *B)], "Art. 67[18]."),
    ([("Art. 112a", *B), ("1", *S), (".", *B)], "Art. 112a[1]."),
    ([("ustawa", *B), ("1", *S)], "ustawa1"),
    ([("z 2024r", *B), ("1", *S)], "z 2024r1"),
    ([("Art. 5 w", *B), ("1", *S)], "Art. 5 w1"),
    ([("Art. 112aa", *B), ("1", *S)], "Art. 112aa[1]"),
    ([("art. 112ab", *B), ("1", *S)], "art. 112ab[1]"),
    ([("21", *B), ("00", *S)], "2100"),
    ([("Art. 184.", *B), ("1", *S), ("7)", *B)], "Art. 184.17)"),
    ([("A r t .  \t12" + "b" * 40, *B), ("34", *S)], "A r t .  \t12" + "b" * 40 + "[34]"),
    ([("Art.\n" + "9" * 50, *B), (" ", *B), ("2", *S)], "Art.\n" + "9" * 50 + " [2]"),
    ([("Art. 7b", *B), (" ", *B), ("2", *S)], "Art. 7b 2"),
    ([("7", *B), ("2", 6.5, 100.0)], "72"),  # small, not raised
    ([("Abcde7", *B), ("2", *S), ("3", 6.5, 90.0), ("4", *B), ("5", *S)], "Abcde7[23]4[5]"),
    ([("7 Abcd", *B), ("8", 8.7, 100.0), ("2", *S)], "7 Abcd82"),  # what it follows is not of the page's size
    ([("7", *B), ("2", 8.5, 103.0), ("x", *B)], "72x"),
    ([(["fi", "7"], *B), ("2", *S)], "fi7[2]"),
    ([("Art. 5", *B), (["ab"], *B), ("2", *S), ("xyz", *B)], "Art. 5ab2xyz"),  # a ligature is no small letter
    ([("Art. 5", *B), ([None], *B), ("2", *S)], "Art. 5[2]"),
    ([("Art. 5", *B), ("b", *B), ([""], *B), ("2", *S)], "Art. 5b2"),
    ([("start. 5b", *B), ("2", *S)], "start. 5b[2]"),
    ([("Ort. 5b", *B), ("2", *S)], "Ort. 5b2"),
    ([("5b", *B), ("2", *S)], "5b2"),
    ([("1", None, 100.0), ("Ab7", *B), ("2", *S)], "1Ab7[2]"),
]


def test_superscripts(spark):
    rows = [r for i, (parts, _) in enumerate(CASES) for r in page(i, parts)]
    marked, broken = act_text.mark_superscripts(spark.createDataFrame(rows, CHARS).repartition(5))
    got = {}
    for r in marked.orderBy("doc_id", "seq").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], "") + r["text"]
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert broken.count() == 0
    two = {r["seq"]: r for r in marked.where("doc_id = 1").collect()}[7]
    assert (two["x0"], two["x1"], two["y0"], two["size"]) == (35.0, 45.0, 103.0, 6.0)


def test_size_is_the_commonest_of_a_page_and_the_first_of_ties(spark):
    tie = page(1, [("7", 10.0, 0.0), ("2", 6.0, 3.0)]) + page(2, [("2", 6.0, 3.0), ("7", 10.0, 0.0), ("2", 6.02, 3.0), ("x", 9.98, 0.0), ("", 6.0, 0.0)]) + page(3, [([None, ""], 10.0, 0.0)]) + page(4, [("x", None, 0.0)])
    marked, broken = act_text.mark_superscripts(spark.createDataFrame(tie, CHARS))
    text = {}
    for r in marked.orderBy("doc_id", "seq").collect():
        text[r["doc_id"]] = text.get(r["doc_id"], "") + r["text"]
    assert (text[1], text[2]) == ("7[2]", "272x")
    assert sorted((r["rule"], r["key"]) for r in broken.collect()) == [("malformed_structure", "3/1"), ("malformed_structure", "4/1")]


def lines_of(spark, texts):
    rows = [(d, i + 1, x, 0) for d, text in texts.items() for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "doc_id int, line int, text string, depth int").repartition(3)


@pytest.mark.parametrize(
    ("line", "number"),
    [("Art. 112.", "112"), ("Art. 112a.", "112a"), ("Art. 112aa. Tekst", "112aa"), ("Art. 112a1.", "112a1"), ("\t Art. 385¹.", "385¹"), ("Art. 385(1)  ", "385(1)"), ("Art. 7", "7"), ("Art. 5 ustawy stanowi inaczej", None), ("Art. 112 1.", None), ("x Art. 1.", None)],
)
def test_heading_lines(spark, line, number):
    found, broken = act_text.scan_headings(lines_of(spark, {1: line}))
    assert [r["number"] for r in found.collect()] == ([number] if number else [])
    assert [r["rule"] for r in broken.collect()] == (["ambiguous_article_number"] if line == "Art. 112 1." else [])


def test_quotations_hide_headings(spark):
    long = ["„Art. 10. Start cytatu.", *(f"Wiersz {i}." for i in range(205)), "Art. 11. Po granicy.", "Koniec.”", "Art. 12. Dalej."]
    texts = {
        1: "1) art. 13 ustawy:\n„Art. 13. Przepis.\nArt. 1. Kodeks.",
        2: "Art. 1. Nadmiar”.\nArt. 2. Kolejny.",
        3: "\n".join(long),
        4: "„Art. 1.\n„Art. 2.”\nArt. 3.”\nArt. 4. Koniec",
        5: "a”\nb”\n„Art. 1.\nArt. 2.”\nArt. 3.",
        6: "\n".join(["„x", *["y"] * 199, "”", "Art. 1."]),
        7: "„Art. 5 1.\n”\nArt. 6 1.",
    }
    found, broken = act_text.scan_headings(lines_of(spark, texts))
    got = {}
    for r in found.orderBy("line").collect():
        got.setdefault(r["doc_id"], []).append((r["number"], r["line"]))
        assert texts[r["doc_id"]][r["start_offset"] :].startswith(f"Art. {r['number']}")
    assert got == {2: [("1", 1), ("2", 2)], 3: [("11", 207), ("12", 209)], 4: [("4", 4)], 5: [("3", 5)], 6: [("1", 202)]}
    assert sorted((r["key"], r["rule"], r["detail"]) for r in broken.collect()) == [
        ("1", "unbalanced_quotes", "unclosed at line 3"),
        ("2", "unbalanced_quotes", "surplus at line 1"),
        ("3", "unbalanced_quotes", "open for 201 at line 201"),
        ("5", "unbalanced_quotes", "surplus at line 1"),
        ("5", "unbalanced_quotes", "surplus at line 2"),
        ("7", "ambiguous_article_number", "Art. 6 1. at line 3"),
    ]


def test_articles_end_before_the_next_and_before_annexes(spark):
    texts = {1: "Wstęp\nArt. 1. Raz\ndwa\n\nArt. 2. Trzy\nZałącznik do art. 2\nArt. 3. Cztery  \n\n  Załączniki\nArt. 9", 2: "Bez artykułów", 3: "Art. 7.\nZałącznikowy\nkoniec"}
    lines = lines_of(spark, texts)
    heads = act_text.scan_headings(lines)[0].where("number <> '9'")
    found, broken = act_text.article_texts(heads, lines)
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "1", 2, 4, "Art. 1. Raz\ndwa"),
        (1, "2", 5, 6, "Art. 2. Trzy\nZałącznik do art. 2"),
        (1, "3", 7, 8, "Art. 3. Cztery"),
        (3, "7", 1, 3, "Art. 7.\nZałącznikowy\nkoniec"),
    ]
    assert [tuple(r) for r in broken.collect()] == [("malformed_structure", "2", "no articles")]
    twice = spark.createDataFrame([(3, 1, "7"), (3, 1, "8")], "doc_id int, line int, number string")
    assert [r["detail"] for r in act_text.article_texts(twice, lines.where("doc_id = 3"))[1].collect()] == ["empty article text for 7"]
    assert act_text.scan_headings(lines.where("false"))[0].count() == 0 == act_text.article_texts(heads.where("false"), lines.where("false"))[0].count()


def test_pages_are_read_once_and_in_any_batches(spark):
    long = "Art. 7b" + "2" + "x" * 12_000 + "7"
    pages = [page(1, [("7", *B), ("2", *S)]), page(2, [(long[:-1], *B), ("7", *B), ("23", *S), ("z", *B), ("1", *S)]), page(2, [("2", *S)] + [("x", *B)], page=2), page(3, [("999", *B), ("1", *S), ("0", *S)], page=2), page(None, [("4", *B), ("5", *S)])]
    chars = spark.createDataFrame([r for p in pages for r in p], CHARS).coalesce(1)
    marked, sizeless = act_text.mark_superscripts(chars.repartition(3))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1
    texts = act_text.superscript_texts(chars)
    plan = texts.drop("text")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan and "Exchange" not in plan
    want = {(1, 1): ("7[2]", 1), (2, 1): (long + "[23]z1", 1), (2, 2): ("2x", 0), (3, 2): ("999[10]", 1), (None, 1): ("4[5]", 1)}
    assert {(r["doc_id"], r["page"]): (r["text"], r["n_marked"]) for r in texts.collect()} == want
    got = {}
    for r in marked.orderBy("doc_id", "page", "seq").collect():
        got[r["doc_id"], r["page"]] = got.get((r["doc_id"], r["page"]), "") + r["text"]
    assert got == {k: v[0] for k, v in want.items()} and sizeless.count() == 0
