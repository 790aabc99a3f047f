"""References against a plain search with Python's own patterns, and their handling of odd rows."""

import re

from clausemill.operators import references as R
from clausemill.operators import structure
from clausemill.plans import context

TEXTS = [
    "§ 1. Strony\n§ 2. Jak w § 1 ust. 3 oraz ust. 4 i pkt 2.1.",
    "§ 02. Zgodnie z § 1, o którym mowa w par. 2 powyżej, załącznik nr 7",
    "2.1 Art. 5 ustawy o § 3 i art. 9 bez aktu; niniejszej umowy ust. 2, § 3  ust. 2",
    "pkt. 2.1 pkt 2.01 § 9 jak wskazano wyżej ust. 5 ust. 6 par. 4 ust. 7",
    "",
    "  § 4 treść § 4",
]


def plain(texts):
    """The greedy search, unit by unit: all spans claimed so far are compared."""
    out = []
    for pos, text in enumerate(texts):
        taken, n = [], 0
        opening = re.match(R.OPENING, text, re.I)
        for kind, pattern, target in R.PATTERNS:
            for m in re.finditer(pattern, text, re.I):
                if opening and m.start() == 0 and m.end() <= opening.end():
                    continue
                if any(m.start() < b and m.end() > a for a, b in taken):
                    continue
                taken.append(m.span())
                if kind == "relative_internal" and re.search(R.RELATIVE_LEAD, text[: m.start()], re.I):
                    continue
                n += 1
                path = ".".join(str(int(x)) for x in m.group(1).split(".")) if target else None
                out.append((pos, n, kind, m.group(0), *m.span(), path))
    return sorted(out)


def test_find_equals_plain_search(spark):
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS)] + [(2, 0, None)], "doc_id long, pos long, text string")
    got = sorted(tuple(r)[1:] for r in R.find(units).collect())
    assert got == plain(TEXTS) and len(got) > 12


def test_first_unit_of_a_number_is_the_target_and_overlapping_units_never_resolve(spark):
    texts = {1: ["§ 1. a\n", "§ 2. jak § 1 i § 2 i § 1\n", "§ 1. b § 9\n"], 2: ["§ 1. a\n", "§ 2. jak § 1\n"]}
    docs = spark.createDataFrame([(d, "".join(t)) for d, t in texts.items()], "doc_id long, text string")
    spans, at = [], 0
    for d, t in texts.items():
        at = 0
        for i, x in enumerate(t):
            spans.append((d, i, max(0, at - (d == 2)), at + len(x)))
            at += len(x)
    units = spark.createDataFrame(spans, "doc_id long, pos long, start_offset long, end_offset long")
    got = R.references(docs, units)
    status = sorted((r.doc_id, r.pos, r.raw, r.status, r.target_pos) for r in got.collect())
    assert (1, 1, "§ 1", "resolved", 0) in status and (1, 2, "§ 9", "target_does_not_exist", None) in status
    assert {s[3] for s in status if s[0] == 2} == {"target_does_not_exist"}
    assert [tuple(r) for r in R.context_edges(got).collect()] == [(1, 1, 0, 1)]
    calls = {(r.doc_id, r.arm, r.unit_id): r.context for r in R.call_units(docs, units, R.context_edges(got)).collect()}
    assert calls[(1, "on", "1")] == ["0"] and calls[(1, "mid", "1")] == [] and len(calls) == 2 + 5 + 5


def test_empty_tables(spark):
    units = spark.createDataFrame([], "doc_id long, pos long, text string")
    assert R.find(units).count() == 0


def test_units_of_calls_are_made_once(spark):
    units = context._input(spark, "/root/testdata/sf0.001")[1]
    assert units.inputFiles() and all("staged-" in f for f in units.inputFiles())


def test_segment_makes_structural_units_once(spark, monkeypatch):
    made, staged = [], structure.staged
    monkeypatch.setattr(structure, "staged", lambda df: made.append(df.columns) or staged(df))
    docs = spark.createDataFrame([(1, "§ 1. a\n§ 2. b\n§ 3. c\n"), (2, "One. Two."), (3, " ")], "doc_id long, text string")
    assert sorted({(r["doc_id"], r["mode"]) for r in structure.segment(docs).collect()}) == [(1, "structural"), (2, "window")]
    assert made == [["doc_id", "pos", "start_offset", "end_offset"]]
