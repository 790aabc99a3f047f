"""Rules that a query and its SQL state alike, on tables made for them."""

import duckdb
from test_queries import ORACLES, QUERIES, rows


def both(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = rows(QUERIES[name](spark, str(folder)).toPandas())
    assert got == rows(con.execute(ORACLES[name]).df())
    return got[1]


_PAGES = [(2, "<title>a &amp; b&&amp</title><p>x &quot;y&quot"), (6, "<title>a &quot</title>"), (10, "<title>a &am</title><p>&lt;"), (4, "<title>a</title>")]


def test_identifiers_with_references_cut_short(spark, tmp_path):
    got = both(spark, tmp_path, "acts_article_identifiers", pages=spark.createDataFrame(_PAGES, "page_id long, html string"))
    assert sorted(x for x, _ in got) == ["Art. 4¹", "Rozdział 10 a &am", "Rozdział 2 a & b&&", 'Rozdział 6 a "']


def test_html_text_with_references_cut_short(spark, tmp_path):
    both(spark, tmp_path, "acts_html_text", pages=spark.createDataFrame(_PAGES, "page_id long, html string"))


def test_references_of_the_texts_themselves(spark, tmp_path):
    texts = [
        "see par. 2 and Par.02 ust. 7\nx par. 77 zgodnie z § 3\nart. 5 of all ustawy\nust. 4 niżej\npar. 9 ust. 1 załącznik nr 6\npkt 1.2 niniejszej umowy par. 4",
        "a\nb\nc", "par. 1\n\npar. 2\n\nend", "one line par. 3",
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {name: both(spark, tmp_path / name, name, documents=docs) for name in ("structure_references", "structure_reference_kinds", "structure_context_edges", "dataset_profile", "dataset_coverage")}
    own = {r[4:6] for r in found["structure_references"] if "ar." in r[4]}
    assert ("par. 2", "resolved") in own and ("Par.02 ust. 7", "resolved") in own


def test_references_beside_letters_past_ascii(spark, tmp_path):
    texts = [
        "éust. 4 a\nust. 5é b\nópkt 1.3, pkt 2.2é\nżniżej ust. 7\x85par.\x0b03 zgodnie z § 2\nart. 5 kodeksué ustawy",
        "par. ٣ a\x1cb\u2003c\nust.\u00a07ust. 8 par.2zgodnie z § 1\nUſT. 3 niżejé poniżej\n\x01par. 1\x02\nniniejszejé umowyé",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    found = {name: both(spark, tmp_path / name, name, documents=docs) for name in ("structure_reference_kinds", "structure_context_edges", "dataset_profile")}
    assert not any("4 a" in r or "2.2" in str(r[4]) for r in found["structure_reference_kinds"])
