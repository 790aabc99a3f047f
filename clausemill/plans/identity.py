"""Queries on markup, digests and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import markup
from clausemill.operators import identity
from clausemill.plans.registry import query, table

# References of every kind, with and without stops, and raised digits, put before each paragraph; and what they stand for.
_GIVEN = "Art. 5<sup>12</sup>. &sect;&nbsp;5&#8211;&#x17C;&#128;&amp;lt;&copy 2&notit;&nosuch;&#xD800;&#11;&hearts; "
_MEANT = "Art. 5¹². § 5–ż€&lt;© 2¬it;&nosuch;�♥ "
# Names that the tables hold; where a title is cut short they stand without a stop.
_KNOWN = (("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&middot;?", "·"), ("&copy;?", "©"), ("&amp;?", "&"))


def _decoded(text: str) -> str:
    """SQL of a text with the known references decoded, & last."""
    return "regexp_replace(" * len(_KNOWN) + text + "".join(f", '{a}', '{b}', 'g')" for a, b in _KNOWN)


_HTML = f"""h AS (SELECT page_id, '<p>' || html AS html FROM pages), m AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t, len(string_split(html, '<p>')) - 1 AS n, regexp_replace(replace(html, '<p>', '<p>' || chr(1)), '<[^>]+>', ' ', 'g') AS marked FROM h),
    d AS (SELECT page_id, {_decoded("marked")} AS t FROM m), e AS (SELECT page_id, replace(t, chr(1), '{_MEANT}') AS t FROM d)"""


@query("acts_html_text", f"WITH {_HTML} SELECT page_id, sha256(trim(regexp_replace(t, '[\\s\\x{{a0}}]+', ' ', 'g'))) AS text_sha256 FROM e")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    html = F.replace(F.concat(F.lit("<p>"), F.col("html")), F.lit("<p>"), F.lit("<p>" + _GIVEN))
    return table(spark, sf, "pages").select("page_id", F.sha2(markup.markup_text(html), 256).alias("text_sha256"))


@query("acts_article_identifiers", rf"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Art. ' || page_id || '¹' WHEN 1 THEN 'art. ' || page_id || 'a' WHEN 2 THEN trim('Rozdział ' || page_id || ' ' || regexp_replace({_decoded("title")}, '\s+', ' ', 'g')) ELSE 'ART. ' || page_id END AS article FROM t""")
def article_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    k, title = F.col("page_id").cast("string"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    kind = F.col("page_id") % 4
    given = F.when(kind == 0, F.concat(F.lit("<b>Art.&nbsp;"), k, F.lit("<sup>1</sup></b>. "), title)).when(kind == 1, F.concat(F.lit("x art. "), k, F.lit("a. y"))).when(kind == 2, F.concat(F.lit("Rozdział "), k, F.lit("\n"), title)).otherwise(F.concat(F.lit("ART.\t"), k))
    return table(spark, sf, "pages").select("page_id", markup.article_identifier(given).alias("article"))


@query("acts_empty_sources", "SELECT 'empty_source_response' AS rule, page_id::VARCHAR AS key FROM pages WHERE page_id % 10 = 0")
def empty_sources(spark: SparkSession, sf: str) -> DataFrame:
    html = F.when(F.col("page_id") % 10 == 0, F.regexp_replace("html", "[^<>]+", "x")).otherwise(F.col("html"))
    text = markup.markup_text(F.replace(html, F.lit(">x<"), F.lit("> &nbsp; <")))
    return table(spark, sf, "pages").where(text == "").select(F.lit("empty_source_response").alias("rule"), F.col("page_id").cast("string").alias("key"))


_UNITS = "u AS (SELECT source, 'units/' || doc_id AS locator, sha256(text) AS h FROM documents), d AS (SELECT source, sha256(string_agg(locator || chr(10) || h || chr(10), '' ORDER BY locator, h)) AS digest FROM u GROUP BY source)"


@query("corpus_unit_digest_whole", f"WITH {_UNITS} SELECT source, digest FROM d")
def unit_digest_whole(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "documents").select("source", F.concat(F.lit("units/"), F.col("doc_id").cast("string")).alias("locator"), F.sha2("text", 256).alias("content_hash"))
    return identity.unit_digest(units, "source")


@query("corpus_identities", f"""WITH {_UNITS}, s AS (SELECT *, 'model-' || length(source) || chr(10) || 64 || chr(10) || 'here' AS spec FROM d), n AS (SELECT source, left(sha256('m' || chr(10) || digest || chr(10) || spec || chr(10) || 'v1'), 24) AS snapshot_id, 'units_' || left(sha256('m' || chr(10) || spec || chr(10) || 'v1'), 16) AS collection,
        left(sha256(spec), 16) AS space FROM s), h AS (SELECT *, sha1(from_hex('{identity.DNS}') || encode('corpus-snapshot:' || collection)) AS h FROM n)
    SELECT source, snapshot_id, collection, space, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS record_id FROM h""")
def identities(spark: SparkSession, sf: str) -> DataFrame:
    spec = identity.space(F.concat(F.lit("model-"), F.length("source").cast("string")), F.lit(64), F.lit("here"))
    name = identity.collection_name("units", F.lit("m"), spec, F.lit("v1"))
    return unit_digest_whole(spark, sf).select(
        "source", identity.snapshot_id(F.lit("m"), F.col("digest"), spec, F.lit("v1")).alias("snapshot_id"), name.alias("collection"), identity.space_fingerprint(spec).alias("space"), identity.uuid5(F.concat(F.lit("corpus-snapshot:"), name)).alias("record_id")
    )


@query("runs_config_fingerprint", """SELECT o_orderkey AS run_id, sha256('{"bounds": {"a": [' || o_custkey || ', {"y": null, "z": "' || o_orderstatus || ', x: 1"}], "b": ' || (o_orderkey % 7) || '.5}, "model": "' || o_orderpriority || '", "name": "\\u017bo\\u0142\\u0105d\\u017a \\ud83d\\ude00", "ok": true}') AS fingerprint FROM orders""")
def config_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"ok":true,"name":"Żołądź 😀","model" : "'), F.col("o_orderpriority"), F.lit('","bounds":{"b":'), (F.col("o_orderkey") % 7).cast("string"), F.lit('.5,"a":['), F.col("o_custkey").cast("string"), F.lit(',{"z":"'), F.col("o_orderstatus"), F.lit(', x: 1","y":null}]}}'))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), identity.config_fingerprint(body).alias("fingerprint"))
