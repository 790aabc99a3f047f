"""Identities, canonical JSON and markup against Python's own."""

import hashlib
import html
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from clausemill.functions import markup
from clausemill.operators import identity


def apply(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_references_decode_like_html(spark):
    names = [f"&{k}" for k in html.entities.html5]
    odd = ["&#0;", "&#x80;", "&#129;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#xFFFFFFFFFFFF;", "&#11;", "&#x1F;", "&#xfdd0;", "&#x1ffff;", "&#65", "&#x41g", "&#xZ;", "&#;", "&;", "&", "&&amp;&", "&notit;", "&notin;", "&ampamp;", "&copy2", "&unknown; x", "&AMP", "&#x1F600;!", "&lt;&gt", "&#0000065;", "a&b c & d", "&" + "x" * 40 + ";", "&sup2sup", ""]
    texts = [*names, *(f"x{n}y" for n in names[::7]), *odd]
    assert apply(spark, markup.unescape, texts) == [html.unescape(t) for t in texts]


def test_markup_and_titles(spark):
    pages = ["<p>Art. 18<SUP>3</SUP>. &sect;&nbsp;1</p>\n\t<b>x</b>&lt;b&gt; <sup>a</sup><sup>12</sup>", "", "<p></p>&nbsp;", "a<b", "1 < 2 > 3"]
    assert apply(spark, markup.markup_text, pages) == ["Art. 18³. § 1 x <b> a ¹²", "", "", "a<b", "1 3"]
    titles = ["<b>Art. 41<sup>1</sup></b>. Najem", "ART. 5", "Rozdział&nbsp;1", "x Art. 7a b. c", "Art.  12 "]
    assert apply(spark, markup.article_identifier, titles) == ["Art. 41¹", "ART. 5", "Rozdział 1", "Art. 7a b", "Art. 12"]


def test_canonical_json_equals_python(spark):
    values = [{"b": 1, "a": {"d": [1, {"z": None, "y": True}], "c": "x, y: \"q\" \\ / \n\t\x01"}, "ż": "łódź 😀", "A": 1.5, "e": [], "f": {}, "a1": "\x7f"}, [], {}, "a:b,c", 7, None, [[1, 2], {"k": ["v"]}]]
    texts = [json.dumps(v) for v in values]
    assert apply(spark, identity.canonical_json, [*texts, "{"]) == [*(json.dumps(v, sort_keys=True, ensure_ascii=False) for v in values), None]
    wide = lambda x: identity.canonical_json(x, ascii_only=True)
    plain = [json.dumps(v, sort_keys=True).replace("\x7f", "\\u007f") for v in values]
    assert apply(spark, wide, texts) == plain
    assert apply(spark, identity.config_fingerprint, texts[1:2]) == [hashlib.sha256(b"[]").hexdigest()]


def test_names(spark):
    names = ["", "corpus-snapshot:legal_units_1", "łódź", "x" * 500, *map(str, range(40))]
    assert apply(spark, identity.uuid5, names) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    sha = lambda *xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    spec = identity.space(F.lit("m"), F.lit(1024), F.lit("p"))
    got = spark.range(1).select(identity.space_fingerprint(spec), identity.collection_name("units", F.lit("h"), spec, F.lit("v1")), identity.snapshot_id(F.lit("h"), F.lit("d"), spec, F.lit("v1"))).first()
    assert tuple(got) == (sha("m", "1024", "p")[:16], "units_" + sha("h", "m", "1024", "p", "v1")[:16], sha("h", "d", "m", "1024", "p", "v1")[:24])


@pytest.mark.parametrize("piece", [8, 1 << 20])
def test_digest_is_that_of_one_hash(spark, monkeypatch, piece):
    monkeypatch.setattr(identity, "PIECE", piece)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "b", "b", None]), f"loc{rng.randrange(50)}", f"h{rng.randrange(4)}", "k", 1) for _ in range(400)]
    got = {r["act"]: r["digest"] for r in identity.unit_digest(spark.createDataFrame(rows, "act string, locator string, content_hash string, key string, part int").repartition(5), "act").collect()}
    want = {a: hashlib.sha256("".join(f"{x}\n{h}\n" for x, h in sorted((r[1], r[2]) for r in rows if r[0] == a)).encode()).hexdigest() for a in ("a", "b", None)}
    assert got == want
