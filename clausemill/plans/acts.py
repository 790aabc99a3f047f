"""Queries on acts; orders stand for manifest entries and metadata, documents and pages for provisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import acts
from clausemill.plans.registry import query, table

_MANIFEST = """m AS (SELECT 'DU' AS publisher, year(o_orderdate) AS year, o_custkey AS position, CASE WHEN o_orderkey % 2 = 0 THEN 'html' ELSE 'pdf' END AS source_format, o_orderdate AS d, CASE WHEN o_orderkey % 5 = 0 THEN 'h' END AS h,
    CASE o_orderkey % 7 WHEN 0 THEN ['3', '1'] WHEN 1 THEN ['1', '3'] ELSE [] END AS r, [o_custkey % 3, o_orderkey % 3] AS a FROM orders), k AS (SELECT *, concat_ws('/', publisher, year, position) AS key FROM m)"""


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.array().cast("array<string>")
    return table(spark, sf, "orders").select(
        F.lit("DU").alias("publisher"), F.year("o_orderdate").alias("year"), c.alias("position"), F.when(k % 2 == 0, "html").otherwise("pdf").alias("source_format"), F.col("o_orderdate").cast("date").alias("legal_status_date"),
        F.when(k % 5 == 0, "h").alias("expected_hash"), F.when(k % 7 == 0, F.array(F.lit("3"), F.lit("1"))).when(k % 7 == 1, F.array(F.lit("1"), F.lit("3"))).otherwise(none).alias("repeated_articles"), F.array(c % 3, k % 3).alias("amendments"),
    )


@query("acts_manifest_rules", f"""WITH {_MANIFEST} SELECT rule, key, detail, count(*) AS n FROM (SELECT 'target_date_before_text' AS rule, key, '' AS detail FROM k WHERE d > DATE '1996-01-01' UNION ALL SELECT 'repeated_articles_not_applicable', key, '' FROM k WHERE source_format = 'html' AND len(r) > 0
    UNION ALL SELECT 'expected_hash_not_applicable', key, '' FROM k WHERE source_format = 'html' AND h IS NOT NULL UNION ALL SELECT 'duplicate_amendment_entry', key, '' FROM k WHERE a[1] = a[2] UNION ALL SELECT 'repeated_articles_not_sorted', key, '' FROM k WHERE r = ['3', '1']
    UNION ALL SELECT 'duplicate_act_entry', key, count(*)::VARCHAR FROM k GROUP BY key HAVING count(*) > 1) GROUP BY ALL""")
def manifest_rules(spark: SparkSession, sf: str) -> DataFrame:
    got = acts.manifest_rules(_manifest(spark, sf), F.lit("1996-01-01").cast("date"))
    return got.groupBy("rule", "key", "detail").agg(F.count(F.lit(1)).alias("n"))


_BODIES = """b AS (SELECT c_custkey AS key, CASE c_custkey % 6 WHEN 0 THEN 'no json' WHEN 1 THEN '{"version": 1, "acts": [{"year": 1}]}' WHEN 2 THEN '{"version": 2, "more": 1, "acts": [{"year": 1}], "other": 2}' WHEN 3 THEN '{"version": 2, "acts": []}' WHEN 4 THEN '[1]'
    ELSE '{"version": 2, "corpus_target_date": "2026-01-01", "acts": [{"publisher": "DU", "year": ' || c_custkey || '}, {"publisher": "MP", "year": 7}]}' END AS body FROM customer)"""


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    whole = F.concat(F.lit('{"version": 2, "corpus_target_date": "2026-01-01", "acts": [{"publisher": "DU", "year": '), F.col("c_custkey").cast("string"), F.lit('}, {"publisher": "MP", "year": 7}]}'))
    body = F.when(k == 0, "no json").when(k == 1, '{"version": 1, "acts": [{"year": 1}]}').when(k == 2, '{"version": 2, "more": 1, "acts": [{"year": 1}], "other": 2}').when(k == 3, '{"version": 2, "acts": []}').when(k == 4, "[1]").otherwise(whole)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), body.alias("body"))


@query("acts_read_manifest", f"WITH {_BODIES} SELECT key, unnest([0, 1]) AS pos, unnest(['DU', 'MP']) AS publisher, unnest([key::VARCHAR, '7']) AS year FROM b WHERE key % 6 = 5")
def read_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return acts.read_manifest(_bodies(spark, sf))[0].select("key", "pos", F.col("act")["publisher"].alias("publisher"), F.col("act")["year"].alias("year"))


@query("acts_refused_manifests", f"WITH {_BODIES} SELECT CASE WHEN NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'invalid_manifest' WHEN body->>'version' <> '2' THEN 'unsupported_manifest_version' WHEN body->>'more' IS NOT NULL THEN 'unknown_key' ELSE 'no_acts' END AS rule, key::VARCHAR AS key, CASE WHEN key % 6 = 2 THEN 'more,other' ELSE '' END AS detail FROM b WHERE key % 6 <> 5")
def refused_manifests(spark: SparkSession, sf: str) -> DataFrame:
    return acts.read_manifest(_bodies(spark, sf))[1]


@query("acts_decode_json", f"WITH {_BODIES} SELECT key, CASE WHEN NOT json_valid(body) THEN 'invalid_json' WHEN json_type(body) <> 'OBJECT' THEN 'wrong_shape' END AS error FROM b")
def decode_json(spark: SparkSession, sf: str) -> DataFrame:
    return acts.decode_json(_bodies(spark, sf), "object").select("key", "error")


_META = """meta AS (SELECT o_orderkey AS act_id, CASE o_orderkey % 4 WHEN 0 THEN '{"references": {"Tekst jednolity dla aktu": [{"id": "DU/' || o_custkey || '"}], "Akty zmieniające": [{"id": "A' || o_custkey || '", "date": "1996-02-0' || (o_custkey % 9 + 1) || '"}, {"id": "", "date": "1996-01-01"}]}}'
    WHEN 1 THEN '{"references": {"Akty zmieniające": [{"id": "B", "date": "soon"}, {"id": "C", "date": "1997-01-31"}]}}' WHEN 2 THEN '{"references": {"Tekst jednolity dla aktu": []}}' ELSE '{}' END AS body FROM orders)"""


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    first = F.concat(
        F.lit('{"references": {"Tekst jednolity dla aktu": [{"id": "DU/'), c.cast("string"), F.lit('"}], "Akty zmieniające": [{"id": "A'), c.cast("string"), F.lit('", "date": "1996-02-0'), (c % 9 + 1).cast("string"), F.lit('"}, {"id": "", "date": "1996-01-01"}]}}')
    )
    body = F.when(k == 0, first).when(k == 1, '{"references": {"Akty zmieniające": [{"id": "B", "date": "soon"}, {"id": "C", "date": "1997-01-31"}]}}').when(k == 2, '{"references": {"Tekst jednolity dla aktu": []}}').otherwise("{}")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("act_id"), body.alias("body"))


@query("acts_base_act", f"""WITH {_META} SELECT act_id, body->>'$.references."Tekst jednolity dla aktu"[0].id' AS base_act FROM meta""")
def base_act(spark: SparkSession, sf: str) -> DataFrame:
    return _meta(spark, sf).select("act_id", acts.base_act().alias("base_act"))


_LISTED = f"""{_META}, listed AS (SELECT act_id, generate_subscripts(from_json(body->'$.references."Akty zmieniające"', '["JSON"]'), 1) - 1 AS pos, unnest(from_json(body->'$.references."Akty zmieniające"', '["JSON"]')) AS e FROM meta)"""


@query("acts_amendments", f"""WITH {_LISTED} SELECT act_id, e->>'id' AS amendment_id, try_cast(e->>'date' AS DATE) AS amended_on FROM listed WHERE e->>'id' <> '' AND try_cast(e->>'date' AS DATE) IS NOT NULL""")
def amendments(spark: SparkSession, sf: str) -> DataFrame:
    return acts.amendments(_meta(spark, sf))[0].withColumn("amended_on", F.col("amended_on").cast("timestamp"))


@query("acts_malformed_amendments", f"""WITH {_LISTED} SELECT 'malformed_amendment_relation' AS rule, act_id::VARCHAR AS key, pos::VARCHAR AS detail FROM listed WHERE e->>'id' = '' OR try_cast(e->>'date' AS DATE) IS NULL
    UNION ALL SELECT 'malformed_amendment_relation', act_id::VARCHAR, 'missing' FROM meta WHERE (body->'$.references."Akty zmieniające"') IS NULL""")
def malformed_amendments(spark: SparkSession, sf: str) -> DataFrame:
    return acts.amendments(_meta(spark, sf))[1]


@query("acts_metadata_drift", """WITH j AS (SELECT o_orderkey AS k, o_orderkey % 6 = 5 AS gone, o_orderkey % 4 = 0 AS d, CASE WHEN o_custkey % 3 <> 0 THEN 'b' || o_custkey % 5 END AS b, CASE WHEN o_custkey % 7 <> 0 THEN 'b' || o_custkey % 5 END AS g,
      CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 4 <> 0 ELSE o_custkey % 5 <> 0 END AS offered FROM orders)
    SELECT 'unexpected_source_format' AS rule, k::VARCHAR AS key, '' AS detail FROM j WHERE gone OR NOT offered UNION ALL SELECT 'legal_status_date_drift', k::VARCHAR, '' FROM j WHERE gone OR d UNION ALL SELECT 'base_act_mismatch', k::VARCHAR, '' FROM j WHERE CASE WHEN gone THEN NULL ELSE g END IS DISTINCT FROM b""")
def metadata_drift(spark: SparkSession, sf: str) -> DataFrame:
    o, k, c, d = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    name = F.concat(F.lit("b"), (c % 5).cast("string"))
    manifest = o.select(k.alias("act_id"), F.when(k % 2 == 0, "html").otherwise("pdf").alias("source_format"), d.alias("legal_status_date"), F.when(c % 3 != 0, name).alias("base_act"))
    metadata = o.where("o_orderkey % 6 <> 5").select(k.alias("act_id"), F.date_add(d, F.when(k % 4 == 0, 1).otherwise(0)).alias("legal_status_date"), F.when(c % 7 != 0, name).alias("base_act"), (c % 4 != 0).alias("has_html"), (c % 5 != 0).alias("has_pdf"))
    return acts.metadata_drift(manifest, metadata)


_PROVISIONS = """p AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Art. ' || doc_id || '. (uchylony)' WHEN 1 THEN '§ 3. (skreślony).' WHEN 3 THEN 'Art. 7. (uchylony)' || chr(10) || 'Dziennik Ustaw – 5 – Poz. 77' || chr(10) WHEN 4 THEN '1. (uchylony)' || chr(10) || '2. Strona odpowiada.'
    WHEN 5 THEN 'Art. 9. (uchylony)' || chr(10) || 'Rozdział II' || chr(10) || 'O zamiarze' WHEN 6 THEN 'Art. 2. (uchylony) Art. 3. Strony' WHEN 7 THEN ' ' ELSE text END AS text FROM documents)"""


def _provisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 8
    text = (
        F.when(k == 0, F.concat(F.lit("Art. "), F.col("doc_id").cast("string"), F.lit(". (uchylony)"))).when(k == 1, "§ 3. (skreślony).").when(k == 3, "Art. 7. (uchylony)\nDziennik Ustaw – 5 – Poz. 77\n").when(k == 4, "1. (uchylony)\n2. Strona odpowiada.")
        .when(k == 5, "Art. 9. (uchylony)\nRozdział II\nO zamiarze").when(k == 6, "Art. 2. (uchylony) Art. 3. Strony").when(k == 7, " ").otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query("acts_provision_force", rf"""WITH {_PROVISIONS}, s AS (SELECT doc_id, regexp_replace(trim(text, E' \n\t'), '^(?:Art\.|§)\s*\d+\.?\s*', '') AS body FROM p),
    r AS (SELECT doc_id, regexp_matches(body, '^(?:\d+\.\s*)?\((?:uchylony|skreślony)\)') AS lead, trim(regexp_replace(body, '^(?:\d+\.\s*)?\((?:uchylony|skreślony)\)\s*\.?\s*', ''), E' \n\t') AS rest FROM s)
    SELECT doc_id, CASE WHEN lead AND NOT regexp_matches(rest, '(?:^|\n)\s*(?:§|\d+[.)]|[a-z]\))') AND NOT regexp_matches(rest, '\bArt\.\s*\d+') THEN 'not_in_force' ELSE 'undetermined' END AS provision_force FROM r""")
def provision_force(spark: SparkSession, sf: str) -> DataFrame:
    return acts.provision_force(_provisions(spark, sf)).select("doc_id", "provision_force")


_FORCE = "f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'in_force' WHEN 'F' THEN 'not_in_force' ELSE 'undetermined' END AS a, ['not_in_force', 'undetermined', 'in_force'][o_custkey % 3 + 1] AS p, ['act', 'provision', NULL][o_orderkey % 3 + 1] AS s, CASE WHEN o_orderkey % 5 <> 0 THEN 'provision' END AS t FROM orders)"


def _force(spark: SparkSession, sf: str) -> DataFrame:
    force = F.when(F.col("o_orderstatus") == "O", "in_force").when(F.col("o_orderstatus") == "F", "not_in_force").otherwise("undetermined")
    k = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select(
        "o_orderkey", force.alias("act_force"), F.element_at(F.array(*map(F.lit, ("not_in_force", "undetermined", "in_force"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("provision_force"),
        F.when(k == 0, "act").when(k == 1, "provision").alias("act_scope"), F.when(F.col("o_orderkey") % 5 != 0, "provision").alias("provision_scope"),
    )


@query("acts_decision_force", f"WITH {_FORCE}, g AS (SELECT o_orderkey, CASE WHEN p = 'not_in_force' THEN p ELSE a END AS force FROM f) SELECT o_orderkey, force, force = 'in_force' AS admits FROM g")
def decision_force(spark: SparkSession, sf: str) -> DataFrame:
    return acts.decision_force(_force(spark, sf)).select("o_orderkey", "force", "admits")


@query("acts_force_pair_rules", f"WITH {_FORCE} SELECT 'admitting_record_not_act' AS rule, o_orderkey::VARCHAR AS key, '' AS detail FROM f WHERE s IS DISTINCT FROM 'act' UNION ALL SELECT 'vetoing_record_not_provision', o_orderkey::VARCHAR, '' FROM f WHERE t IS NULL UNION ALL SELECT 'provision_in_force', o_orderkey::VARCHAR, '' FROM f WHERE p = 'in_force'")
def force_pair_rules(spark: SparkSession, sf: str) -> DataFrame:
    return acts.force_pair_rules(_force(spark, sf), "o_orderkey")


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    article = '{"type": "arti", "name": "1", "title": "Art. 1", "children": [{"type": "para", "name": "1"}]}'
    stub, other = '{"type": "arti", "name": "1", "title": "Art. 1"}', '{"type": "arti", "name": "1", "title": "Art. one"}'
    second = F.when(k % 3 == 0, article).when(k % 3 == 1, stub).otherwise(other)
    body = F.concat(F.lit('[{"type": "book", "name": "I", "children": [' + article + ", "), second, F.lit(']}, {"type": "note", "children": [{"type": "arti", "name": "2 a'), k.cast("string"), F.lit('"}]}, {"name": "none"}]'))
    return table(spark, sf, "customer").select(k.alias("act_id"), body.alias("body"))


@query("acts_struct_articles", "SELECT c_custkey AS act_id, unnest(['book=I/arti=1', 'book=I/arti=1', 'arti=2%20a' || c_custkey]) AS path, unnest(['0,0', '0,1', '1,0']) AS pos FROM customer")
def struct_articles(spark: SparkSession, sf: str) -> DataFrame:
    return acts.struct_articles(_trees(spark, sf))[0].select("act_id", "path", F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"))


@query("acts_dedupe_struct", "SELECT c_custkey AS act_id, 'arti=2%20a' || c_custkey AS path, '1,0' AS pos, false AS whole FROM customer UNION ALL SELECT c_custkey, 'book=I/arti=1', '0,0', true FROM customer WHERE c_custkey % 3 <> 2")
def dedupe_struct(spark: SparkSession, sf: str) -> DataFrame:
    return acts.dedupe_struct(acts.struct_articles(_trees(spark, sf))[0])[0].select("act_id", "path", F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"), F.col("node").contains("para").alias("whole"))


@query("acts_ambiguous_struct", "SELECT 'ambiguous_struct_path' AS rule, c_custkey || ' book=I/arti=1' AS key, '2' AS detail FROM customer WHERE c_custkey % 3 = 2")
def ambiguous_struct(spark: SparkSession, sf: str) -> DataFrame:
    return acts.dedupe_struct(acts.struct_articles(_trees(spark, sf))[0])[1]


_DEEP = r"""t AS (SELECT c_custkey AS act_id, c_custkey % 11 AS n, '"x": {"b": 1, "a": [null, 2]}' AS more FROM customer),
    b AS (SELECT act_id, CASE WHEN act_id % 9 = 7 THEN '{"type": "arti", "name": "1"}' WHEN act_id % 9 = 8 THEN '[{"type": "arti"' ELSE
        '[' || repeat('{"type": "chpt", "name": "a (1)~*/ż", "children": [{"type": "note", "children": [', n) || '{"type": "arti", "name": "' || act_id || '", ' || more || '}, 7, {"type": 5, "name": "x", "children": [{"type": "arti", "name": "lost"}]}, {"type": "chpt", "children": [{"type": "arti", "name": "lost"}]}, "arti"'
        || repeat(']}, {"type": "arti", "name": "2", "title": "t", "children": []}]}', n) || ']' END AS body FROM t)"""
_WALK = rf"""{_DEEP}, w AS (SELECT act_id, '' AS path, '' AS pos, 'root' AS type, body::JSON AS node, CASE WHEN json_type(body) = 'ARRAY' THEN body::JSON END AS below FROM b WHERE json_valid(body)
    UNION ALL SELECT act_id, path || CASE WHEN type IN ('chpt', 'arti') THEN CASE WHEN path = '' THEN '' ELSE '/' END || type || '=' || replace(replace(url_encode(name), '%28', '('), '%29', ')') ELSE '' END, pos || CASE WHEN pos = '' THEN '' ELSE ',' END || nth, type, node,
        CASE WHEN type <> 'arti' AND json_type(node, '$.children') = 'ARRAY' THEN node->'$.children' END
    FROM (SELECT act_id, path, pos, nth, x AS node, CASE WHEN json_type(x, '$.type') = 'VARCHAR' THEN x->>'$.type' END AS type, CASE WHEN json_type(x, '$.name') = 'VARCHAR' THEN x->>'$.name' END AS name
        FROM (SELECT act_id, path, pos, unnest(from_json(below, '["JSON"]')) AS x, unnest(range(0, json_array_length(below)::BIGINT)) AS nth FROM w WHERE below IS NOT NULL))
    WHERE type IS NOT NULL AND (type NOT IN ('chpt', 'arti') OR name IS NOT NULL) OR json_type(node) <> 'OBJECT')"""


def _deep(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    n = (k % 11).cast("int")
    opened, closed = '{"type": "chpt", "name": "a (1)~*/ż", "children": [{"type": "note", "children": [', ']}, {"type": "arti", "name": "2", "title": "t", "children": []}]}'
    core = F.concat(F.lit('{"type": "arti", "name": "'), k.cast("string"), F.lit('", "x": {"b": 1, "a": [null, 2]}}, 7, {"type": 5, "name": "x", "children": [{"type": "arti", "name": "lost"}]}, {"type": "chpt", "children": [{"type": "arti", "name": "lost"}]}, "arti"'))
    tree = F.concat(F.lit("["), F.repeat(F.lit(opened), n), core, F.repeat(F.lit(closed), n), F.lit("]"))
    return table(spark, sf, "customer").select(k.alias("act_id"), F.when(k % 9 == 7, '{"type": "arti", "name": "1"}').when(k % 9 == 8, '[{"type": "arti"').otherwise(tree).alias("body"))


@query("acts_struct_deep", f"""WITH RECURSIVE {_WALK} SELECT act_id, sha256(path) AS path_sha256, pos, CASE WHEN json_type(node, '$.x') IS NULL THEN '{{"children":[],"name":"2","title":"t","type":"arti"}}'
    ELSE '{{"name":"' || act_id || '","type":"arti","x":{{"a":[null,2],"b":1}}}}' END AS node FROM w WHERE type = 'arti'""")
def struct_deep(spark: SparkSession, sf: str) -> DataFrame:
    return acts.struct_articles(_deep(spark, sf))[0].select("act_id", F.sha2("path", 256).alias("path_sha256"), F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"), "node")


@query("acts_struct_violations", rf"WITH RECURSIVE {_WALK} SELECT 'malformed_node' AS rule, act_id::VARCHAR AS key, pos AS detail FROM w WHERE json_type(node) <> 'OBJECT' AND pos <> '' UNION ALL SELECT 'malformed_structure', act_id::VARCHAR, CASE WHEN json_valid(body) THEN 'no list' ELSE 'no JSON' END FROM b WHERE NOT json_valid(body) OR json_type(body) <> 'ARRAY'")
def struct_violations(spark: SparkSession, sf: str) -> DataFrame:
    return acts.struct_articles(_deep(spark, sf))[1]


@query("acts_article_numbers", r"""WITH n AS (SELECT CASE p_partkey % 7 WHEN 0 THEN p_size || '(' || p_partkey % 4 || ')' WHEN 1 THEN p_size || '[' || p_partkey % 4 || ']' WHEN 2 THEN p_size || '^' || p_partkey % 4 WHEN 3 THEN p_size || ['⁰', '¹', '²', '³'][p_partkey % 4 + 1] WHEN 4 THEN p_size || 'a' WHEN 5 THEN 'Art ' || p_size ELSE p_size::VARCHAR END AS s FROM part),
    c AS (SELECT DISTINCT s, translate(s, '⁰¹²³', '0123') AS t, s <> translate(s, '⁰¹²³', '0123') AS up FROM n),
    d AS (SELECT s, CASE WHEN up THEN left(t, length(t) - 1) || '(' || right(t, 1) || ')' WHEN regexp_matches(s, '^\d+\[\d+\]$') THEN replace(replace(s, '[', '('), ']', ')') WHEN regexp_matches(s, '^\d+\^\d+$') THEN replace(s, '^', '(') || ')' ELSE s END AS number FROM c)
    SELECT number, string_agg(s, ' ' ORDER BY s) AS spellings FROM d GROUP BY 1""")
def article_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k, n, i = F.col("p_partkey") % 7, F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string")
    up = F.translate(i, "0123", "⁰¹²³")
    number = F.when(k == 0, F.concat(n, F.lit("("), i, F.lit(")"))).when(k == 1, F.concat(n, F.lit("["), i, F.lit("]"))).when(k == 2, F.concat(n, F.lit("^"), i)).when(k == 3, F.concat(n, up)).when(k == 4, F.concat(n, F.lit("a"))).when(k == 5, F.concat(F.lit("Art "), n)).otherwise(n)
    return acts.article_numbers(table(spark, sf, "part").select(number.alias("number"))).withColumn("spellings", F.array_join("spellings", " "))


@query("acts_legal_units", f"""WITH {_PROVISIONS}, a AS (SELECT n_nationkey AS act_id, ['in_force', 'undetermined'][n_nationkey % 2 + 1] AS force FROM nation) SELECT 'acts/' || act_id || '#article=' || doc_id AS unit_id, act_id, doc_id AS article, sha256(text) AS content_hash, force AS act_force FROM p JOIN a ON act_id = doc_id % 30""")
def legal_units(spark: SparkSession, sf: str) -> DataFrame:
    of = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("act_id"), F.when(F.col("n_nationkey") % 2 == 0, "in_force").otherwise("undetermined").alias("force"))
    rows = _provisions(spark, sf).select((F.col("doc_id") % 30).alias("act_id"), F.col("doc_id").alias("article"), "text")
    return acts.legal_units(rows, of, "acts/%d#article=%d").select("unit_id", "act_id", "article", "content_hash", "act_force")


_USED = "u AS (SELECT o_custkey AS snapshot, o_orderkey AS act_id, CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'html' ELSE 'pdf' END END AS declared, CASE o_orderkey % 8 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS ok FROM orders), v AS (SELECT *, CASE WHEN declared = 'pdf' THEN 'pdf' WHEN ok AND declared = 'html' THEN 'html' WHEN NOT ok AND declared = 'html' THEN 'pdf' END AS used FROM u)"


def _used(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("snapshot"), k.alias("act_id"), F.when(k % 9 != 0, F.when(k % 2 == 0, "html").otherwise("pdf")).alias("declared"), F.when(k % 8 == 0, False).when(k % 8 != 1, True).alias("html_ok"),
        F.col("o_orderdate").alias("legal_status_date"), F.sequence(F.lit(0), (k % 3).cast("int")).alias("amendments"),
    )
    return acts.format_used(rows.withColumn("html_ok", F.when(F.col("declared").isNotNull(), F.col("html_ok"))))


@query("acts_snapshot_format", f"WITH {_USED} SELECT snapshot, CASE WHEN bool_or(declared IS NULL OR used IS NULL) THEN 'unrecorded' WHEN bool_or(declared <> used) THEN 'fallback' ELSE 'as_declared' END AS source_format, coalesce(string_agg(act_id, ',' ORDER BY act_id) FILTER (WHERE declared <> used), '') AS fallback_acts FROM v GROUP BY 1")
def snapshot_format(spark: SparkSession, sf: str) -> DataFrame:
    return acts.snapshot_format(_used(spark, sf), "snapshot").withColumn("fallback_acts", F.array_join(F.col("fallback_acts").cast("array<string>"), ","))


@query("acts_currency", f"WITH {_USED} SELECT act_id, declared AS source_format_declared, used AS source_format_used, act_id % 3 + 1 AS not_carried FROM v")
def act_currency(spark: SparkSession, sf: str) -> DataFrame:
    return acts.act_currency(_used(spark, sf)).drop("legal_status_date")


@query("acts_publish_gate", """WITH s AS (SELECT o_orderkey AS key, o_orderkey % 11 = 0 AS complete, o_custkey % 4 AS n_units, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_custkey % 4 END AS n_stored, o_orderkey % 3 AS space, CASE WHEN o_custkey % 2 = 0 THEN 1 END AS other,
      CASE WHEN o_orderkey % 7 <> 0 THEN 'm' END AS model, CASE WHEN o_orderkey % 13 <> 0 THEN 'p' END AS probe, CASE WHEN o_custkey % 5 = 0 THEN 's1' END AS pinned, 's' || o_orderkey % 2 AS id FROM orders),
    v AS (SELECT key, complete, CASE WHEN n_units = 0 THEN 'empty_corpus' WHEN n_units <> n_stored THEN 'stored_count_differs' WHEN other <> space THEN 'space_collision' WHEN model IS NULL THEN 'model_missing' WHEN probe IS NULL THEN 'probe_missing' WHEN pinned <> id THEN 'snapshot_not_pinned' END AS x FROM s)
    SELECT key, CASE WHEN NOT complete THEN x END AS violation, NOT complete AND x IS NULL AS publish FROM v""")
def publish_gate(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        k.alias("key"), (k % 11 == 0).alias("complete"), (c % 4).alias("n_units"), F.when(k % 5 == 0, 1).otherwise(c % 4).alias("n_stored"), (k % 3).alias("space"), F.when(c % 2 == 0, 1).alias("other_space"), F.when(k % 7 != 0, "m").alias("model"),
        F.when(k % 13 != 0, "p").alias("probe"), F.when(c % 5 == 0, "s1").alias("pinned_id"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("snapshot_id"),
    )
    return acts.publish_gate(rows).select("key", "violation", "publish")


@query("acts_payload", "SELECT o_orderkey, o_orderstatus AS act_force_value, 'act' AS act_force_scope, o_orderpriority AS provision_force_value, 'provision' AS provision_force_scope, o_orderstatus || o_orderpriority AS again FROM orders")
def payload(spark: SparkSession, sf: str) -> DataFrame:
    record = lambda value, scope: F.struct(F.col(value).alias("value"), F.lit(scope).alias("scope"), F.col("o_orderdate").alias("snapshot_date"), F.col("o_orderkey").cast("string").alias("source_locator"))
    rows = table(spark, sf, "orders").select("o_orderkey", record("o_orderstatus", "act").alias("act_force"), record("o_orderpriority", "provision").alias("provision_force"))
    flat = acts.to_payload(rows)
    again = acts.from_payload(flat).select("o_orderkey", F.concat("act_force.value", "provision_force.value").alias("again"))
    return flat.join(again, "o_orderkey").select("o_orderkey", "act_force_value", "act_force_scope", "provision_force_value", "provision_force_scope", "again")


_LOCATED = "l AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'none' ELSE 'eli/' || doc_id % 40 || '#article=' || doc_id % 11 || CASE WHEN doc_id % 4 = 0 THEN '&printing=' || doc_id % 3 ELSE '' END END AS locator FROM documents)"


def _located(spark: SparkSession, sf: str) -> DataFrame:
    d, s = F.col("doc_id"), lambda x: x.cast("string")
    locator = F.when(d % 9 == 0, "none").otherwise(F.concat(F.lit("eli/"), s(d % 40), F.lit("#article="), s(d % 11), F.when(d % 4 == 0, F.concat(F.lit("&printing="), s(d % 3))).otherwise("")))
    return table(spark, sf, "documents").select(locator.alias("locator"), "text")


_LOCATOR = r"eli/(\d+)#article=(\d+)(?:&printing=(\d+))?"


@query("acts_provision_map", f"WITH {_LOCATED}, n AS (SELECT locator, count(*) AS n FROM l WHERE locator <> 'none' GROUP BY 1) SELECT regexp_extract(locator, '{_LOCATOR}', 1) AS act, regexp_extract(locator, '{_LOCATOR}', 2) AS article, nullif(regexp_extract(locator, '{_LOCATOR}', 3), '') AS printing FROM n WHERE n = 1")
def provision_map(spark: SparkSession, sf: str) -> DataFrame:
    return acts.provision_map(_located(spark, sf), _LOCATOR)[0].select("act", "article", "printing")


@query("acts_provision_map_refused", f"WITH {_LOCATED} SELECT 'malformed_locator' AS rule, locator AS key, '' AS detail, count(*) AS n FROM l WHERE locator = 'none' GROUP BY 2 UNION ALL SELECT 'duplicate_key', locator, count(*)::VARCHAR, 1 FROM l WHERE locator <> 'none' GROUP BY 2 HAVING count(*) > 1")
def provision_map_refused(spark: SparkSession, sf: str) -> DataFrame:
    return acts.provision_map(_located(spark, sf), _LOCATOR)[1].groupBy("rule", "key", "detail").agg(F.count(F.lit(1)).alias("n"))
