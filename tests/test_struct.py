"""Structures of acts: any depth, malformed parts and repeats."""

import json

from clausemill.operators import acts


def trees(spark, bodies):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v), "x", 1) for k, v in bodies.items()], "act_id int, body string, path string, type int")


def art(name, **more):
    return {"type": "arti", "name": name, **more}


def test_articles_at_any_depth(spark):
    deep = [art("last", note="z")]
    for i in range(40):
        deep = [{"type": "chpt", "name": str(i), "children": [*deep, art(f"a{i}")]}]
    found, broken = acts.struct_articles(trees(spark, {1: deep}))
    got = {r["path"].split("/")[-1]: r for r in found.collect()}
    assert len(got) == 41 and broken.count() == 0
    assert got["arti=last"]["path"] == "/".join([f"chpt={i}" for i in range(39, -1, -1)] + ["arti=last"])
    assert got["arti=last"]["pos"] == [0] * 41 and got["arti=a0"]["pos"] == [0] * 40 + [1]
    assert json.loads(got["arti=last"]["node"]) == art("last", note="z")


def test_what_is_no_structure(spark):
    bodies = {
        1: "[", 2: {"type": "arti"}, 3: None, 4: [], 5: "7",
        6: [None, 5, "arti", [art("1")], {"type": 1, "name": "x", "children": [art("lost")]}, {"name": "x"}, {"type": "chpt", "children": [art("lost")]}, art(5), {"type": "arti"}],
        7: [{"type": "note", "children": [{"type": "titl", "name": "(a)_~*/ ż", "children": [art("1", children=[art("inner")])]}]}, {"type": "book", "name": "b", "children": {"x": 1}}, {"type": "book", "name": "c", "children": []}],
    }
    found, broken = acts.struct_articles(trees(spark, bodies))
    assert [(r["act_id"], r["path"], r["pos"]) for r in found.collect()] == [(7, "titl=(a)_~%2A%2F%20%C5%BC/arti=1", [0, 0, 0])]
    assert sorted((r["key"], r["rule"], r["detail"]) for r in broken.collect()) == [
        ("1", "malformed_structure", "no JSON"), ("2", "malformed_structure", "no list"), ("3", "malformed_structure", "no JSON"), ("5", "malformed_structure", "no list"),
        *(("6", "malformed_node", str(i)) for i in range(4)),
    ]


def test_repeats_of_a_path(spark):
    full = art("1", title="t", children=[{"type": "para", "name": "1"}])
    other = art("1", title="t", children=[{"type": "para", "name": "2"}])
    stub, empty = art("1", title="t"), art("1", title="t", children=[])
    bodies = {
        1: [full, {"children": full["children"], **{k: full[k] for k in ("title", "name", "type")}}],  # another order of keys
        2: [stub, full], 3: [full, stub], 4: [stub, empty], 5: [full, other], 6: [full, art("1", title="u")], 7: [stub, art("1", title="u")], 8: [stub, full, stub, full],
        9: [art("1", title="t", children=[{"a": '"children": [x]'}], extra={"children": [1]})],
    }
    kept, refused = acts.dedupe_struct(acts.struct_articles(trees(spark, bodies))[0])
    got = {r["act_id"]: (r["pos"], json.loads(r["node"])) for r in kept.collect()}
    assert got == {1: ([0], full), 2: ([0], full), 3: ([0], full), 4: ([0], stub), 8: ([0], full), 9: ([0], bodies[9][0])}
    assert sorted((r["key"], r["detail"]) for r in refused.collect()) == [("5 arti=1", "2"), ("6 arti=1", "2"), ("7 arti=1", "2")]


def test_acts_of_one_file_are_unfolded_by_many_tasks(spark, monkeypatch):
    tasks, staged = [], acts.staged
    monkeypatch.setattr(acts, "staged", lambda df: tasks.append(df.rdd.getNumPartitions()) or staged(df))
    found, _ = acts.struct_articles(trees(spark, {i: [art(str(i))] for i in range(40)}).coalesce(1))
    assert tasks[0] > 1 and found.count() == 40
    kept, refused = acts.dedupe_struct(found)
    assert all("Expand" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (kept, refused))  # rows are not copied to count two things
