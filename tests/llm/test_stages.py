"""The pipeline's stages and their thresholds against brute force, on sf0.1 and on null and repeated doc_ids."""

import os
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausemill.llm import common, exact_dedup, mixing, quality, simhash

SF = os.environ.get("TEST_LARGE_SF_DIR", "/root/testdata/sf0.1")


@pytest.mark.skipif(not Path(SF).exists(), reason="needs sf0.1")
def test_default_risk_filters_every_language(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    label, lang = dict(labels.select("doc_id", "quality").collect()), dict(docs.select("doc_id", "lang").collect())
    n = Counter()
    for r in quality.judge(docs, labels).where("not base_failed").collect():
        if label.get(r["doc_id"]) is not None:
            n[lang[r["doc_id"]], label[r["doc_id"]], r["kept"]] += 1
    print(sorted(n.items()))
    assert {k[0] for k in n} == {"de", "en", "es", "fr"}
    for x in ("de", "en", "es", "fr"):
        good, gone, bad = n[x, 1, True] + n[x, 1, False], n[x, 1, False], n[x, 0, True] + n[x, 0, False]
        assert n[x, 0, False] >= 0.9 * bad > 0
        assert quality.binomial_tail(gone, good, 0.02) <= 0.05 / 4


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8 if a and b else a == b


@pytest.mark.parametrize("group_bytes", [16 << 20, 20_000])
def test_one_row_of_each_similar_group_stays(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(simhash, "GROUP_BYTES", group_bytes)
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(5000)
    rows, base = [], [[word() for _ in range(rng.choice([60, 150, 400]))] for _ in range(60)]
    for w in base:
        rows.append(" ".join(w))
        for n in (1, 2, 3, 6):  # words replaced: similarities of about 0.5 to 0.97
            x = list(w)
            for at in rng.sample(range(len(x)), n):
                x[at] = word()
            rows.append(" ".join(x))
    for n in range(120):  # a large group of near copies
        x = list(base[0])
        x[rng.randrange(len(x))] = word()
        rows.append(" ".join(x))
    rows += [None, "", " \t", "one two", "One  TWO", "one two three", rows[0].upper(), rows[7]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, _x string").repartition(4)
    out = simhash.drop_near(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    sets, group = list(map(shingle_set, rows)), list(range(len(rows)))
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if alike(sets[i], sets[j])]
    for _ in range(8):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    assert len(pairs) > 1000 and kept == {group[i] for i in range(len(rows))}


@pytest.mark.skipif(not Path(SF).exists(), reason="needs sf0.1")
def test_near_stage_on_whole_documents(spark):
    docs = exact_dedup.drop_exact(spark.read.parquet(f"{SF}/documents.parquet"), "largest").where(F.size(F.split("text", " ")) >= 50).select("doc_id", "text")
    rows = sorted((r["doc_id"], shingle_set(r["text"])) for r in docs.collect())
    holders = defaultdict(list)
    for at, (_, x) in enumerate(rows):
        for g in x:
            holders[g].append(at)
    shared = Counter((a, b) for at in holders.values() if len(at) < 200 for n, b in enumerate(at) for a in at[:n])
    pairs = [p for p, n in shared.items() if n > 20 and alike(rows[p[0]][1], rows[p[1]][1])]
    kept = {r["doc_id"] for r in simhash.drop_near(docs).select("doc_id").collect()}
    both = [(a, b) for a, b in pairs if rows[a][0] in kept and rows[b][0] in kept]
    print(len(pairs), "similar pairs, of", len(both), "both stay;", len(rows) - len(kept), "rows gone")
    touched = {x for p in pairs for x in p}
    assert len(pairs) > 40 and len(both) <= 0.02 * len(pairs)
    assert {i for i, _ in rows} - kept <= {rows[x][0] for x in touched}


def test_near_classes_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a), (None, b), (3, b), (3, c), (3, c), (4, c + " end"), (None, "short text")]
    got = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(got.collect(), key=str) == sorted(spark.createDataFrame([(None, a), (3, b), (3, c), (None, "short text")], got.schema).collect(), key=str)


def messy(spark):
    rng = random.Random(9)
    clean = [" ".join("w%d" % rng.randrange(900) for _ in range(70)) for _ in range(12)]
    rows = [(None, t, "en", "a") for t in clean[:3]] + [(None, "too short", "en", "a"), (5, clean[3], "en", "b"), (5, "also too short", "en", "b")]
    rows += [(7, clean[4], "en", "b")] * 3 + [(8, clean[4].upper(), "en", "b"), (None, clean[4], None, None), (9, clean[5], "en", None), (9, clean[6] + " " + clean[7], "en", None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_quality_stage_judges_rows(spark):
    docs, labels = messy(spark), spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, quality int")
    got = quality.keep_good(docs, labels)
    want = [r for r in docs.collect() if len((r["text"] or "").split()) >= 50]
    assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(want, key=str) and len(want) == 11


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_stage_keeps_one_row_of_each_text(spark, keep):
    docs = messy(spark)
    got = exact_dedup.drop_exact(docs, keep).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r["text"] or "").lower()].append(r)
    assert len(got) == len(groups) and set(got) <= set(docs.collect())
    for r in got:
        ids = [x["doc_id"] for x in groups[(r["text"] or "").lower()] if x["doc_id"] is not None]
        assert r["doc_id"] == ((max if keep == "largest" else min)(ids) if ids else None)


def test_mixing_stage_counts_each_row(spark):
    docs = common.materialise(messy(spark))  # read in the same order each time
    taken = mixing.mix(docs.withColumn("k", F.monotonically_increasing_id()), key="k").collect()
    assert len(taken) == 14 and len({r["k"] for r in taken}) == 14
    got, n = Counter(mixing.repeat(docs).collect()), Counter(docs.collect())
    assert set(got) <= set(n)
    low, high = Counter(), Counter()
    rows = {r["k"]: r for r in docs.withColumn("k", F.monotonically_increasing_id()).collect()}
    for r in taken:
        if r["size"]:
            x = rows[r["k"]]
            at = type(next(iter(n)))(x["doc_id"], x["text"], x["lang"], x["source"])
            low[at] += r["taken"] // r["size"]
            high[at] += -(-r["taken"] // r["size"])
    assert not [(r[0], low[r], got[r], high[r]) for r in n if not low[r] <= got[r] <= high[r]]
    assert any(got[r] for r in n if r["doc_id"] is None)


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use inside, dotted ones and ones with backticks come back with their values."""
    odd = ["_row", "_size", "_set", "_order", "_copy", "_h", "boxed", "c0", "a.b", "x`y", "rep", "component", "name", "index", "taken", "size"]
    words = [" ".join(f"w{i}_{j}" for j in range(60)) for i in range(30)]
    rows = [(i, words[i % 30], "en", "s", *(f"{c}{i}" for c in odd)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in odd))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    near, exact, mixed, good = simhash.drop_near(docs), exact_dedup.drop_exact(docs), mixing.repeat(docs), quality.keep_good(docs, labels)
    for got, ids in ((near, set(range(30))), (exact, set(range(30))), (mixed, None), (good, set(range(40)))):
        assert got.columns == docs.columns
        held = got.collect()
        assert held and all(tuple(r) == rows[r["doc_id"]] for r in held)
        assert ids is None or {r["doc_id"] for r in held} == ids
