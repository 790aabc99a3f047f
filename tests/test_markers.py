"""Markers that reach over blank lines, and numbers of any length."""

import pytest
from pyspark.sql import functions as F

from clausemill.operators import structure


def of(spark, texts):
    got = structure.markers(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    out = {i: [] for i in range(len(texts))}
    for r in got.orderBy("doc_id", "offset", "rank").collect():
        out[r["doc_id"]].append((r["level"], r["offset"], r["path"]))
    return out


def test_markers_reach_over_any_gap(spark):
    long = "9" * 60
    got = of(
        spark,
        [
            "§\n" + "\n" * 25 + "1. Raz",
            "x\nArt.\n" + " \t\n" * 10_000 + "   12 dwa\n§ 3",
            f"§ {long}\n§ 1{'0' * 60}",
            "§  5 twarde spacje",
            "§",
            "§\nx 5",
            "lit.\n\n b) x\nlit. Ż",
            "1.02.3 zarys\n1.2.3koniec",
            "ust. 007\n\n\n",
        ],
    )
    assert got[0] == [("paragraph", 0, ["1"]), ("outline", 27, ["1"])]
    assert got[1] == [("article", 2, ["12"]), ("paragraph", len("x\nArt.\n" + " \t\n" * 10_000 + "   12 dwa\n"), ["3"])]
    assert got[2] == [("paragraph", 0, [long]), ("paragraph", 63, ["1" + "0" * 60])]
    assert got[3] == [("paragraph", 0, ["5"])]
    assert got[4] == got[5] == []
    assert got[6] == [("letter", 0, ["98"]), ("letter", 12, [str(ord("ż"))])]
    assert got[7] == [("outline", 0, ["1", "2", "3"])]
    assert got[8] == [("section", 0, ["7"])]


@pytest.mark.parametrize(("number", "after"), [("0", "1"), ("8", "9"), ("9", "10"), ("1299", "1300"), ("9" * 50, "1" + "0" * 50), ("1234567890123", "1234567890124")])
def test_next_number(spark, number, after):
    assert spark.range(1).select(structure.next_number(F.lit(number)).alias("x")).first()["x"] == after


def test_units_of_long_numbers(spark):
    first = 10**12
    text = "".join(f"§\n\n\n{first + i}. Treść paragrafu.\n" for i in range(5))
    got = structure.structural_units(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r["start_offset"], r["end_offset"]) for r in got] == [(i * (len(text) // 5), (i + 1) * (len(text) // 5)) for i in range(5)]
