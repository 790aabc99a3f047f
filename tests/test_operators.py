"""Truth tables of single operators."""

import pytest
from pyspark.sql import functions as F

from clausemill.operators import acts, decision, retrieval, runs, structure, verdicts
from clausemill.streaming import events


@pytest.mark.parametrize(
    ("previous", "following", "expected"),
    [([1], [2], True), ([1], [3], False), ([1], [1, 1], True), ([1, 2], [2, 1], True), ([1, 2], [2], True), ([1, 2], [1, 3], True), ([5], [1], True), ([1, 2], [3, 1], False), ([2], [3, 2], False), ([1, 1], [2, 1, 1], True)],
)
def test_successor(spark, previous, following, expected):
    got = spark.range(1).select(structure.is_successor(F.array(*map(F.lit, previous)), F.array(*map(F.lit, following))).alias("x")).first()["x"]
    assert got is expected


@pytest.mark.parametrize(
    ("facts", "expected"),
    [
        ({"processed": False}, ("not_processed", None, None)),
        ({"adjudicable": False}, ("unit_not_adjudicable", None, None)),
        ({"candidates_cleared": 0}, ("no_basis_found", None, None)),
        ({"relevant": False}, ("no_relation", None, None)),
        ({"relevant": None}, ("uncertain", "relation_below_threshold", None)),
        ({"relevant": None, "raw_confidence": None}, (None, None, "confidence_missing")),
        ({"force": None}, (None, None, "force_missing")),
        ({"force": "undetermined"}, ("uncertain", "force_state_undetermined", None)),
        ({"force": "not_in_force"}, ("basis_not_in_force", None, None)),
        ({"departure": "undetermined"}, ("uncertain", "relation_below_threshold", None)),
        ({"character": "undetermined"}, ("uncertain", "provision_character_undetermined", None)),
        ({"character": "semi_imperative", "permitted": None}, ("uncertain", "permitted_direction_undetermined", None)),
        ({"departure": "none"}, ("consistent", None, None)),
        ({}, ("contradictory", None, None)),
        ({"character": "dispositive"}, ("permissible_departure", None, None)),
        ({"character": "semi_imperative", "direction": None}, (None, None, "direction_missing")),
        ({"character": "semi_imperative", "direction": "undetermined"}, ("uncertain", "departure_direction_undetermined", None)),
        ({"character": "semi_imperative"}, ("permissible_departure", None, None)),
        ({"character": "semi_imperative", "direction": "against_permitted_direction"}, ("contradictory", None, None)),
    ],
)
def test_decision_table(spark, facts, expected):
    base = {"processed": True, "adjudicable": True, "candidates_cleared": 1, "relevant": True, "force": "in_force", "character": "imperative", "departure": "present", "permitted": "known", "direction": "with_permitted_direction", "raw_confidence": 0.5}
    schema = "processed boolean, adjudicable boolean, candidates_cleared int, relevant boolean, force string, character string, departure string, permitted string, direction string, raw_confidence double"
    row = decision.resolve_finding(spark.createDataFrame([tuple((base | facts).values())], schema)).first()
    assert (row["code"], row["cause"], row["violation"]) == expected


def test_quotes(spark):
    found = spark.createDataFrame([(1, 1, "b  c"), (2, 1, "a"), (3, 1, " "), (4, 1, "x.y")], "key int, doc_id int, quote string")
    texts = spark.createDataFrame([(1, "a b\nc a xzy")], "doc_id int, text string")
    got = {r["key"]: (r["resolution"], r["start_offset"], r["end_offset"]) for r in decision.resolve_quotes(found, texts).collect()}
    assert got == {1: ("resolved", 2, 5), 2: ("ambiguous", None, None), 3: ("empty", None, None), 4: ("fabricated", None, None)}


def test_sentences_and_windows(spark):
    docs = spark.createDataFrame([(1, "One. Two!  Three? Four. five. Six.\n")], "doc_id int, text string")
    spans = structure.sentences(docs)
    assert [(r[2], r[3]) for r in spans.orderBy("pos").collect()] == [(0, 4), (5, 9), (11, 17), (18, 29), (30, 34)]
    assert [(r[2], r[3]) for r in structure.window_units(spans).orderBy("pos").collect()] == [(0, 17), (11, 34)]
    with pytest.raises(ValueError, match="invalid_window"):
        structure.window_units(spans, 2, 2)


def test_rank_fusion_ties_by_hash(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, unit_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "query_id int, unit_id int, rank int")
    import hashlib

    want = sorted([10, 11], key=lambda x: hashlib.sha256(str(x).encode()).hexdigest())
    assert [r["unit_id"] for r in retrieval.rrf(a, b, 5).orderBy("rank").collect()] == want


def test_parity_counts_null_as_a_value(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, None, True), (2, "a", True)], "g int, model string, measurement_valid boolean")
    got = {r["g"]: (r["valid"], r["mismatched"]) for r in runs.parity(rows, ["g"], ["model"]).collect()}
    assert got == {1: (False, "model"), 2: (True, "")}


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = events.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    assert sorted(spark.table("latest").collect()) == sorted(events.latest_status(table).collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Art. 5. (uchylony)", True),
        ("§ 12a. (skreślony).", True),
        ("3) (uchylona)", True),
        ("Art. 20-22. (uchylone)", True),
        ("Art. 7. (utraciły moc)", True),
        ("Art. 18[3] (uchylony)", True),
        ("Art. 18³. (uchylony)", True),
        ("Art. 9. § 1. (uchylony) § 2. (uchylony)", True),
        ("Art. 9. § 1. (uchylony)\n§ 2. Najemca odpowiada.", False),
        ("Art. 4. (uchylony)2)", True),
        ("Art. 4. (uchylony)\nDziennik Ustaw – 12 – Poz. 1360", True),
        ("Art. 4. (uchylony)\n2) Uchylony przez art. 3 ustawy.", True),
        ("Art. 4. (uchylony)\nUtracił moc z dniem 1 stycznia.", True),
        ("Art. 4. (uchylony)\nROZDZIAŁ III\nPrzepisy końcowe", True),
        ("Art. 4. (uchylony) Rozdział III Przepisy", True),
        ("Art. 4. (uchylony) Art. 5. Strony", False),
        ("Art. 4. (uchylony)\nkażda ze stron może odstąpić;", False),
        ("Art. 4. Przepis (uchylony) w części", False),
        ("(uchylony)", True),
        ("  ", False),
        (None, False),
    ],
)
def test_repealed_provisions(spark, text, expected):
    got = spark.createDataFrame([(text,)], "text string").select(acts.is_repealed(F.col("text")).alias("x")).first()["x"]
    assert got is expected


def test_guards_agree_with_the_decision_table(spark):
    """A confidence is needed exactly where the table gives an uncertain finding."""
    import itertools

    rows = [
        (str(i), True, True, 1, *x, None)
        for i, x in enumerate(
            itertools.product((None, False, True), ("in_force", "not_in_force", "undetermined"), ("imperative", "semi_imperative", "dispositive", "undetermined"), ("none", "present", "undetermined"), (None, "known"), (None, "undetermined", "with_permitted_direction"))
        )
    ]
    facts = spark.createDataFrame(rows, "key string, processed boolean, adjudicable boolean, candidates_cleared int, relevant boolean, force string, character string, departure string, permitted string, direction string, raw_confidence double")
    got = {r["key"]: r["violation"] for r in decision.resolve_finding(facts).collect()}
    ruled = {(r["rule"], r["key"]) for r in verdicts.verdict_guards(facts).collect()}
    assert {k for k, v in got.items() if v == "confidence_missing"} == {k for r, k in ruled if r == "confidence_missing"}
    assert {k for k, v in got.items() if v == "direction_missing"} <= {k for r, k in ruled if r == "direction_missing"}


def _events(spark, tmp_path, n=4):
    rows = [(i, f"2024-01-01 0{i % 7}:10:00", i % 3, ["view", "click", "purchase"][i % 3 if i % 5 else 0], float(i % 4), "{}") for i in range(40)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    table.repartition(n).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    return table, spark.readStream.option("maxFilesPerTrigger", 1).schema(table.schema).parquet(str(tmp_path / "in"))


def _run(stream, name, tmp_path, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams_of_state_equal_batches(spark, tmp_path):
    table, stream = _events(spark, tmp_path)
    for name, f in (("expired", lambda x: events.expired(x, 3600, "2024-01-01 07:00:00")), ("stalled", lambda x: events.stalled(x, 7200, "purchase", "2024-01-01 09:00:00"))):
        assert sorted(_run(f(stream), name, tmp_path, "complete").collect()) == sorted(f(table).collect())
    last = {}
    for r in _run(events.last_n_stream(stream, 5), "last_n", tmp_path, "update").collect():
        last[r["user_id"]] = r["event_ids"]  # the sink holds every change, in order
    want = {}
    for r in events.last_n(table, 5).orderBy(F.desc("ts"), F.desc("event_id")).collect():
        want.setdefault(r["user_id"], []).append(r["event_id"])
    assert last == want


def test_windowed_stream_and_dedupe(spark, tmp_path):
    table, stream = _events(spark, tmp_path, 1)
    assert sorted(_run(events.kind_counts(stream), "counts", tmp_path, "update").collect()) == sorted(events.kind_counts(table).collect())
    keys = ["user_id", "event_type", "value"]
    assert sorted(_run(events.dedupe(stream, "1 day"), "deduped", tmp_path, "append").select(*keys).collect()) == sorted(events.dedupe(table).select(*keys).collect())


def test_deletions_cascade(spark, tmp_path):
    runs_ = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "document_id long, run_id long")
    lines = spark.createDataFrame([(10, "a"), (12, "b")], "run_id long, x string")
    spark.createDataFrame([(1,)], "document_id long").write.parquet(str(tmp_path / "gone"))
    out = []
    query = events.cascade_stream(spark.readStream.schema("document_id long").parquet(str(tmp_path / "gone")), lambda ids, _: out.append([x.collect() for x in events.cascade(ids, runs_, lines)]), str(tmp_path / "ck"))
    query.awaitTermination()
    assert [[tuple(r) for r in rows] for rows in out[-1]] == [[(12, 2)], [(12, "b")]]


def test_run_tables_and_recorded_runs(spark, tmp_path):
    from clausemill.sources import files

    at = str(tmp_path / "store")
    runs_ = spark.createDataFrame([("r2", "d", "2024-01-02"), ("r1", "d", "2024-01-03")], "run_id string, document_id string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    runs_ = runs_.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("arm", "string"), ("status", "string"), ("failure", "string"), ("model", "string"), ("tokens", "long"))])
    attempts = spark.createDataFrame([("r1", 2, True, "m", 5, 7), ("r1", 1, False, "m", 5, 7), ("zz", 1, True, "m", 1, 1)], files.RUN_TABLES["attempts"])
    lost = files.write_run_tables({"runs": runs_, "attempts": attempts}, at).collect()
    assert [tuple(r) for r in lost] == [("unknown_run_of_attempts", "zz")]
    assert [r["run_id"] for r in files.read_run_table(spark, at, "runs").collect()] == ["r2", "r1"]
    assert [r["seq"] for r in files.read_run_table(spark, at, "attempts").collect()] == [1, 2]
    assert files.write_run_tables({"runs": runs_.limit(0), "attempts": attempts.where("run_id = 'r1'")}, at).count() == 0
    (tmp_path / "res" / "ED-1").mkdir(parents=True)
    (tmp_path / "res" / "ED-1" / "mid.json").write_text('{\n"id": "x", "tokens": 4}')
    got = files.read_runs(spark, str(tmp_path / "res" / "*"), "id string, tokens long").collect()
    assert [(r["id"], r["tokens"], r["artifact_id"], r["arm"]) for r in got] == [("x", 4, "ED-1", "mid")]
