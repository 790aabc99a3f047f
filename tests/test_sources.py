"""Files and bodies that can and cannot be read, blocks, worksheet rules and odd rows."""

from pyspark.sql import functions as F

from clausemill.functions import pluggable
from clausemill.operators import blocks, retrieval, runs, worksheet
from clausemill.sources import files


def test_read_text(spark, tmp_path):
    held = {
        "a.txt": "﻿Zażółć\n".encode(),
        "b.TXT": "Zażółć gęślą".encode("cp1250"),
        "blank.txt": b" \n\t ",
        "none.txt": b"",
        "no ne+ż%20.txt": b"",
        "full ne+ż%20.txt": b"x",
        "bad.txt": b"\x81\x83 abc",
        "big.txt": b"x" * 200,
        "scan.pdf": b"%PDF",
    }
    for name, body in held.items():
        (tmp_path / name).write_bytes(body)
    documents, violations = files.read_text(spark, str(tmp_path), max_bytes=100)
    assert {r.path.rsplit("/", 1)[1]: r.text for r in documents.collect()} == {"a.txt": "Zażółć\n", "b.TXT": "Zażółć gęślą", "full ne+ż%20.txt": "x"}
    assert {r.key.rsplit("/", 1)[1]: r.rule for r in violations.collect()} == {
        "blank.txt": "empty_input",
        "none.txt": "empty_input",
        "no ne+ż%20.txt": "empty_input",
        "bad.txt": "corrupt_input",
        "big.txt": "limit_exceeded",
        "scan.pdf": "unsupported_input",
    }


def test_read_json_lines(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"a": 1}\n\n[1]\nnot json\n{"b": "ż"}\r\n')
    rows, violations = files.read_json_lines(spark, str(tmp_path))
    assert sorted((r.line, r.value) for r in rows.collect()) == [(1, '{"a": 1}'), (5, '{"b": "ż"}')]
    assert sorted(r.detail for r in violations.collect()) == ["3", "4"]


def test_responses_and_json(spark):
    rows = [("u", "application/json", 1, "oops"), ("u", "application/json", 2, "[1]"), ("u", "application/json", 3, "{}"), ("u", "text/html", 1, "<p>"), ("v", "application/pdf", 1, "%PDF-1"), ("w", "image/png", 1, "x" * 20), ("w", "text/html", 1, None)]
    got = files.valid_responses(spark.createDataFrame(rows, "url string, media_type string, seq int, body string"))
    assert sorted(r.body for r in got.collect()) == ["%PDF-1", "[1]"]
    record = spark.createDataFrame([(1, None, "ż")], "b int, a string, c string").select(files.canonical_json(["c", "b", "a"]).alias("j")).first().j
    assert record == '{"a":null,"b":1,"c":"ż"}'


def test_blocks_skip_blank_ones_and_tile_the_text(spark):
    rows = [(1, "b", 2, "two"), (1, "a", 1, "one"), (1, "c", 3, "  "), (1, "d", 4, None), (1, "e", 2, "tie"), (2, "x", 1, "")]
    documents, anchors = blocks.assemble_blocks(spark.createDataFrame(rows, "doc_id long, block_id string, pos int, text string"))
    assert [tuple(r) for r in documents.collect()] == [(1, "one\ntwo\ntie")]
    assert sorted((r.block_id, r.text) for r in blocks.blocks_view(documents, anchors).collect()) == [("a", "one"), ("b", "two"), ("e", "tie")]


def test_headings_inside_quotations_do_not_count(spark):
    rows = [(1, 1, "Art. 1 a"), (1, 2, "„Art. 2 b"), (1, 3, "Art. 3 c”"), (1, 4, "Art. 4 d"), (1, 5, None)]
    lines = spark.createDataFrame(rows, "doc_id long, line long, text string")
    found = blocks.headings(lines, r"^Art\. (\d+)")
    assert sorted((r.number, r.first_line, r.last_line) for r in blocks.article_slices(found, lines).collect()) == [("1", 1, 3), ("4", 4, 5)]


def test_pending_step_follows_the_first_open_candidate(spark):
    rows = [
        (1, 1, "candidate", None, "a", None), (1, 2, "verdict", "relevance", "a", "irrelevant"), (1, 3, "candidate", None, "b", None),
        (2, 1, "candidate", None, "a", None), (2, 2, "verdict", "relevance", "a", "relevant"), (2, 3, "character", None, "a", "imperative"), (2, 4, "verdict", "relevance", "a", "irrelevant"),
        (3, 1, "candidate", None, "a", None), (3, 2, "verdict", "relevance", "a", "irrelevant"), (4, 1, "note", None, None, None),
    ]
    entries = spark.createDataFrame(rows, "unit int, seq int, kind string, stage string, candidate_id string, value string")
    steps = worksheet.pending_step(entries, worksheet.candidate_state(entries, ["unit"]), ["unit"])
    assert {r.unit: r.step for r in steps.collect()} == {1: "relevance", 2: "relation", 3: "done", 4: "search"}


def test_attempt_chain_ends_at_what_no_retry_mends(spark):
    rows = [(1, 1, 503, 5), (1, 2, 200, 7), (1, 3, 200, 9), (2, 1, 400, 1), (2, 2, 200, 1), (3, 1, None, None), (3, 2, 429, None), (3, 3, 429, None)]
    got = runs.attempt_outcomes(spark.createDataFrame(rows, "request_id int, seq int, status int, tokens long"), 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "success", False, 12), (2, 1, "rejected", False, 1), (3, 2, "rate_limited", True, None)]


def test_pair_check_and_placed_responses(spark):
    rows = [("h", "off", "s"), ("h", "mid", "s"), ("i", "off", "s"), ("i", "mid", "t"), ("j", "mid", "s"), ("k", "off", None), ("k", "mid", None)]
    got = runs.pair_check(spark.createDataFrame(rows, "input_hash string, arm string, stratum string"), "off", "mid", ["stratum"])
    assert {r.input_hash: r.state for r in got.collect()} == {"h": "ok", "i": "mismatch", "j": "skipped", "k": "ok"}
    requests = spark.createDataFrame([(r, 2) for r in range(5)], "request_id int, n int")
    responses = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 0), (2, 0), (3, 0), (3, 2)], "request_id int, idx int")
    placed = {r.request_id: r.error for r in retrieval.place_responses(requests, responses).collect()}
    assert placed == {0: None, 1: "index_missing", 2: "index_repeated", 3: "index_out_of_range", 4: "index_missing"}


def test_functions_take_nulls(spark):
    rows = spark.createDataFrame([("Łódź İ",), (None,), ("",)], "text string")
    assert [r.folded for r in pluggable.with_exact_fold(rows).collect()] == ["lodz i", None, ""]
    assert [r.n_tokens for r in pluggable.with_token_count(rows, len).collect()] == [6, 0, 0]
    assert [r.embedding for r in pluggable.with_vectors(rows, lambda ts: [[len(t)] for t in ts]).collect()] == [[6.0], [0.0], [0.0]]


def test_prominence_of_unknown_codes(spark):
    found = spark.createDataFrame([("consistent",), ("new_code",), (None,)], "code string")
    assert [r.prominence for r in worksheet.with_prominence(found.where(F.col("code").isNotNull())).collect()] == ["neutral", None]


def test_a_batch_is_written_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "store")
    run = lambda i, tokens: spark.createDataFrame([(i, "d", "off", "completed", None, "m", tokens, None)], files.RUN_TABLES["runs"])
    tries = lambda *rows: spark.createDataFrame([(r, s, True, "m", 1, 1) for r, s in rows], files.RUN_TABLES["attempts"])
    held = lambda: ([(r.run_id, r.tokens) for r in files.read_run_table(spark, at, "runs").collect()], [(r.run_id, r.seq) for r in files.read_run_table(spark, at, "attempts").collect()])
    assert files.read_run_table(spark, at, "runs").count() == 0
    files.write_run_tables({"runs": run("r1", 1), "attempts": tries(("r1", 1))}, at, batch="b1")

    def broken(*_):
        raise RuntimeError("lost between the tables")

    monkeypatch.setattr(files, "staged", broken)  # after the tables, before the commit
    for _ in range(2):
        try:
            files.write_run_tables({"runs": run("r2", 2), "attempts": tries(("r2", 1), ("r2", 2))}, at, batch="b2")
        except RuntimeError:
            pass
    monkeypatch.undo()
    assert held() == ([("r1", 1)], [("r1", 1)])
    for _ in range(3):  # the first mends it, the others find it done
        lost = files.write_run_tables({"runs": run("r2", 2), "attempts": tries(("r2", 1), ("r2", 2), ("zz", 1))}, at, batch="b2")
        assert [tuple(r) for r in lost.collect()] == [("unknown_run_of_attempts", "zz")]
    assert held() == ([("r1", 1), ("r2", 2)], [("r1", 1), ("r2", 1), ("r2", 2)])
    files.write_run_tables({"runs": run("r1", 7), "attempts": tries(("r1", 5))}, at, batch="b3")  # the run anew
    files.write_run_tables({"runs": run("r1", 7).limit(0), "attempts": tries(("r1", 6), ("r2", 3))}, at, batch="b4")  # more of both
    assert held() == ([("r1", 7), ("r2", 2)], [("r1", 5), ("r1", 6), ("r2", 1), ("r2", 2), ("r2", 3)])
    files.write_run_tables({"runs": run("r9", 9)}, at, mode="overwrite", batch="b5")
    assert held() == ([("r9", 9)], [])


def test_paragraphs_of_nested_cells(spark):
    cell = lambda *xs: [dict(zip(("table", "row", "col"), x, strict=True)) for x in xs]
    rows = [(1, 1, "paragraph", None, "a"), (1, 2, "table", [], None), (1, 3, "paragraph", cell((0, 0, 0)), "b"), (1, 4, "paragraph", cell((0, 0, 0)), " "), (1, 5, "table", cell((0, 0, 1)), None), (1, 6, "paragraph", cell((0, 0, 1), (0, 2, 3)), "c"), (1, 7, "paragraph", [], "d"), (1, 8, "table", None, None), (1, 9, "paragraph", cell((0, 1, 1)), "e")]
    elements = spark.createDataFrame(rows, "doc_id int, pos int, kind string, cells array<struct<table: int, row: int, col: int>>, text string")
    named = blocks.nested_block_ids(elements)
    assert [r.block_id for r in named.orderBy("pos").collect()] == ["p0", "t1_r0_c0", "t1_r0_c0", "t1_r0_c1_t0_r2_c3", "p5", "t6_r1_c1"]
    documents, anchors = blocks.assemble_blocks(named)
    assert documents.first().text == "a\nb\nc\nd\ne" and anchors.count() == 5
