"""Chat formatting, clustering and the prefix trie against brute force and SQL."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from clausemill.llm import chat, clustering, prefix_trie, queries

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
SF = "/root/testdata/sf0.001"
CHATS = "conv_id long, turn long, role string, text string, key binary, pos int, piece string, digest string"
TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>\n", "<", "|", "", None, "a<|", "é𝄞 <|<|\\", "<|im_end|>\n<|im_start|>user\nx"]


def chats(spark, rows):
    """Conversations with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, b"k", 7, "p", "d") for r in rows], CHATS).repartition(3)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tricky_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None, "a\\n|\n<|im_end|>", "assistant"]), rng.choice(TRICKY)) for c in [None, -1, 5, 10**12, *range(20)] for t in range(rng.randrange(1, 9))]
    return [*rows, (5, None, "assistant", "first"), (5, None, None, None), rows[0], rows[0], (77, 0, "assistant", "<|" * 50_000)]


@pytest.mark.parametrize("window", [2, 3, 256])
def test_chats_read_back(spark, window):
    rows = tricky_rows()
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    spans = chat.format_chats(chats(spark, rows), window=window)
    got = {r["conv_id"]: r for r in chat.read_back(spans).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        said = [x for r, x in turns if r == "assistant"]
        want = (len(turns), digest(f"{r}\n{x}\n" for r, x in turns), sum(map(len, said)), digest(said), len(chat.render_marked(turns)))
        assert tuple(got[c])[1:] == want
    text, places = defaultdict(str), defaultdict(list)
    for r in spans.orderBy("pos").collect():
        assert r["start_offset"] == len(text[r["conv_id"]])
        text[r["conv_id"]] += r["piece"]
        places[r["conv_id"]].append((r["loss_start"], r["loss_end"]))
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        assert chat.parse_marked(text[c]) == turns
        assert [chat.unescape(text[c][a:b]) for a, b in places[c] if a is not None] == [x for r, x in turns if r == "assistant"]
    assert chat.rewriting(spans).count() == 0


@pytest.mark.parametrize("text", [*filter(None, TRICKY), "<" * 5 + "|" * 3])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def _forgets(turns):
    """Thoughts of all but the last turn go."""
    last = len(turns) - 1
    return "".join(f"[{r}] {x if i == last else re.sub('{.*}', '', x)}\n" for i, (r, x) in enumerate(turns))


def _counts(turns):
    return "".join(f"{i} {r}: {x}\n" for i, (r, x) in enumerate(turns))


def _trims(turns):
    return "".join(f"{r}: {x.strip()}{'!' * len(x)}\n" for r, x in turns)


@pytest.mark.parametrize(("render", "window", "bad"), [(_forgets, 256, {1: (2, 2)}), (_counts, 256, {}), (_counts, 4, {1: (5, 2)}), (_trims, 256, {1: (1, 2), 2: (1, 1)})])
def test_templates_that_rewrite_are_told(spark, render, window, bad):
    rows = [(1, i, ["user", "assistant"][i % 2], ["a", "{b} c", "d", "{e} f", "g", "h", "i"][i]) for i in range(7)] + [(2, 0, "user", "x"), (2, 1, "assistant", "ab")]
    if render is _trims:
        rows = [r for r in rows if r[1] < 4]
    spans = chat.format_chats(chats(spark, rows), chat.Template(render=render), window=window)
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.rewriting(spans).collect()} == bad
    back = {r["conv_id"]: r["turns_sha256"] is None for r in chat.read_back(spans, chat.Template(render=render, parse=lambda x: [])).collect()}
    assert back == {c: c in bad for c in (1, 2)}


def test_spans_of_a_template_that_repeats_its_marks(spark):
    template = chat.Template(render=lambda turns: "<s>" + "".join(f"aa{x}aa" for _, x in turns))
    got = chat.format_chats(chats(spark, [(1, 0, "assistant", "aaa"), (1, 1, "assistant", "")]), template).orderBy("pos").collect()
    assert [(r["start_offset"], r["end_offset"], r["loss_start"], r["loss_end"], r["rewritten"]) for r in got] == [(3, 10, 5, 8, False), (10, 14, 12, 12, False)]


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(float(x) * 64)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**21 for x in e)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        cents = [[sum(x) // len(x) for x in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]) else c for j, c in enumerate(cents)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    of = defaultdict(int)
    for _, c, d in last:
        of[c] += d
    return sorted(((i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in last), key=repr)


@pytest.mark.parametrize("spread", [0.02, 1.0, 30000.0])
def test_clusters_equal_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    homes = rng.normal(size=(6, 64)) * spread
    rows = [(i, (homes[i % 6] + rng.normal(size=64) * spread / 4).astype(np.float32).tolist()) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]  # copies, and ties between centroids that start equal
    rows += [(7, rows[8][1]), (None, rows[9][1]), (300, None), (301, [0.0] * 63), (302, [None, *[0.0] * 63]), (303, [float("nan")] * 64), (304, [float("-inf")] * 64), (305, [3e38] * 64), (306, [])]
    table = spark.createDataFrame([(*r, 1, [1], 2.0) for r in rows], "vec_id long, embedding array<float>, cluster int, p array<int>, r double").repartition(3)
    got = clustering.cluster(table, 16, 3)
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == brute_clusters(rows, 16, 3)
    few = clustering.cluster(table.where("vec_id < 4"), 16, 1).collect()
    assert len(few) == 4 and {r["distance"] for r in few} == {0}
    assert clustering.cluster(table.where("vec_id = 300")).count() == 0


def test_bounds_leave_few_centroids(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = clustering.cluster(table)
    assert got.agg({"n_verified": "avg"}).first()[0] < 3  # of 16


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {c: convs.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[h:] for c, own in convs.items()}
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    done = {}
    for n in sorted(nodes, key=len, reverse=True):
        below = [done[k] for k in kids[n]]
        saved = (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
        done[n] = (sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below))
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), *done[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_trie_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = random.Random(11)
    rows = []
    for c in [*range(60), 10**12, 1003, 1004]:
        same = rng.random() < 0.5
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if not same else "user", "x" if same else rng.choice(["é", "", None, "x", "y" * 9])) for t in range(rng.randrange(1, 12))]
    rows += [(None, 0, "user", "x"), (2000, 0, "user", "long " * 20_000), rows[0], rows[0], *((3000, t, "user", "x") for t in range(300))]
    got = prefix_trie.prefix_trie(chats(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_empty_tables(spark):
    none = chats(spark, []).where("false")
    assert chat.read_back(chat.format_chats(none)).count() == 0
    assert prefix_trie.prefix_trie(none).count() == 0
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op12_centroid_clustering", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda df: sorted((tuple(None if pd.isna(v) else str(v) if isinstance(v, str) else int(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)
