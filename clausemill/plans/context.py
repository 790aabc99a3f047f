"""Queries on references and context over the structural units of the derived clause table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import references, structure
from clausemill.plans.core import _DERIVED
from clausemill.plans.registry import query, table
from clausemill.sources.staging import staged

_UNITS = f"""{_DERIVED}, u AS (SELECT doc_id, i, i - 1 AS pos, off, coalesce(lead(off) OVER (PARTITION BY doc_id ORDER BY i), n) AS e FROM dl JOIN st USING (doc_id, n) WHERE n_markers >= 3 AND tail <= 0.5),
    edges AS (SELECT doc_id, pos, pos - 1 AS target_pos FROM u WHERE i % 3 = 0)"""

# The rules of references in RE2, whose own classes are ASCII; a word's edge is one of ASCII letters. Kind, pattern, its target.
_S, _D, _W = r"[\s\v\x{85}\p{Z}]", r"\p{Nd}", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_RULES = (
    ("external_act", rf"\bart\.{_S}*{_D}+[^.;\n]{{0,120}}?(?:kodeks(?:u)?|ustaw(?:y|ie)?)\b", 0),
    ("full_internal", rf"(?:\b(?:zgodnie{_S}+z|mowa{_S}+w|o{_S}+którym{_S}+mowa{_S}+w){_S}+)?(?:§|par\.){_S}*({_D}+)(?:{_S}+ust\.{_S}*{_D}+)?", 1),
    ("full_internal", rf"\bpkt\.?{_S}*({_D}+(?:\.{_D}+)+)\b", 1),
    ("relative_internal", rf"\bust\.{_S}*{_D}+\b", 0),
    ("directional", rf"\b(?:jak{_S}+wskazano{_S}+)?(?:powyżej|poniżej|wyżej|niżej)\b", 0),
    ("annex", rf"\bzałącznik{_S}+nr{_S}*{_D}+\b", 0),
    ("whole_document", rf"\bniniejsz{_W}*{_S}+umow{_W}*\b", 0),
)
_CLAIMED = [
    "fk0 AS MATERIALIZED (SELECT * FROM fs WHERE rank = 0 AND NOT (s = 0 AND e <= opening))",
    *[f"fk{r} AS MATERIALIZED (SELECT * FROM fk{r - 1} UNION ALL SELECT * FROM fs WHERE rank = {r} AND NOT (s = 0 AND e <= opening) AND NOT EXISTS (SELECT 1 FROM fk{r - 1} k WHERE k.doc_id = fs.doc_id AND k.pos = fs.pos AND k.s < fs.e AND k.e > fs.s))" for r in range(1, len(_RULES))],
    f"fn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY rank, i) AS n FROM fk{len(_RULES) - 1} WHERE NOT led)",
    """refs AS MATERIALIZED (SELECT fn.doc_id, fn.pos, n, kind, raw, CASE kind WHEN 'full_internal' THEN CASE WHEN t.pos IS NULL THEN 'target_does_not_exist' ELSE 'resolved' END WHEN 'external_act' THEN 'external_act' WHEN 'directional' THEN 'ambiguous_directional'
        WHEN 'annex' THEN 'outside_input' WHEN 'whole_document' THEN 'whole_document' ELSE 'within_unit' END AS status, t.pos AS target_pos FROM fn LEFT JOIN (SELECT doc_id, pos, (pos + 1)::VARCHAR AS number FROM ut) t ON t.doc_id = fn.doc_id AND t.number = ltrim(fn.target, '0'))""",
    "context_edges AS (SELECT doc_id, pos, target_pos, min(n) AS n FROM refs WHERE status = 'resolved' AND target_pos <> pos GROUP BY 1, 2, 3)",
]
# References in all of ut(doc_id, pos, text), whatever put them there: spans of each rule, the unit's own number left out, those that
# meet an earlier rule's span dropped. A unit begins with its number, which is its place, so only whole numbers have a target.
FOUND = ", ".join(
    [
        "fm AS (" + " UNION ALL ".join(f"""SELECT doc_id, pos, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, '(?i){p}') AS raws, string_split_regex(text, '(?i){p}') AS gaps,
        {f"regexp_extract_all(text, '(?i){p}', 1)" if target else "NULL::VARCHAR[]"} AS targets, length(regexp_extract(text, '(?i)^{_S}*(?:§|par[.]){_S}*{_D}+')) AS opening FROM ut WHERE regexp_matches(text, '(?i){p}')""" for rank, (kind, p, target) in enumerate(_RULES)) + ")",
        "fp AS (SELECT *, unnest(range(1, len(raws) + 1)) AS i FROM fm)",
        f"""fs AS MATERIALIZED (SELECT doc_id, pos, rank, kind, i, raws[i] AS raw, targets[i] AS target, opening, kind = 'relative_internal' AND regexp_matches(gaps[i], '(?i)(?:§|par[.]){_S}*{_D}+{_S}*$') AS led,
        list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(raws[:i], lambda x: length(x))) AS e, e - length(raws[i]) AS s FROM fp)""",
        *_CLAIMED,
    ]
)
FOUND_UNITS = f"{_UNITS}, ut AS (SELECT doc_id, pos, substr(text, off + 1, e - off) AS text FROM u JOIN derived USING (doc_id)), {FOUND}"

# The same rules with Unicode's edges of words, which RE2 does not know. They are looked for in a shadow of the text that has a character
# for each of its own: small ASCII letters and digits, capitals for the four letters past ASCII that rules name, _ for other characters of words, 0
# for other digits, white space and .;§ as they are, ! for the rest. So chr(1) and chr(2) are free to mark what is found.
_PAST = lambda c: rf"[^\x{{0}}-\x{{7f}}\P{{{c}}}]"
_SHADOW = rf"""regexp_replace(regexp_replace(regexp_replace(translate(lower(text), 'ıſóżłą', 'isOZLA'), '{_PAST("Nd")}', '0', 'g'),
        '{"|".join(map(_PAST, ("L", "M", "Nl", "Pc")))}|[\x{{200c}}\x{{200d}}\x{{24b6}}-\x{{24e9}}\x{{1f130}}-\x{{1f149}}\x{{1f150}}-\x{{1f169}}\x{{1f170}}-\x{{1f189}}]', '_', 'g'), '[^0-9A-Za-z_.;§\s\v\x{{85}}\p{{Z}}]', '!', 'g')"""
_SHADOWED = [(kind, p.replace(_W, "[0-9A-Za-z_]").replace(_D, "[0-9]").replace("którym", "ktOrym").replace("yżej", "yZej").replace("niżej", "niZej").replace("załącznik", "zaLAcznik")) for kind, p, _ in _RULES]
_TARGETS = {1: rf"(?i)(?:§|par[.]){_S}*({_D}+)", 2: rf"({_D}+(?:\.{_D}+)+)"}
FOUND_IN_WORDS = ", ".join(
    [
        f"uw AS MATERIALIZED (SELECT doc_id, pos, text, {_SHADOW} AS shadow FROM ut)",
        "fm AS (" + " UNION ALL ".join(f"""SELECT doc_id, pos, text, {rank} AS rank, '{kind}' AS kind, string_split(regexp_replace(shadow, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts,
        length(regexp_extract(shadow, '^{_S}*(?:§|par[.]){_S}*[0-9]+')) AS opening FROM uw WHERE regexp_matches(shadow, '{p}')""" for rank, (kind, p) in enumerate(_SHADOWED)) + ")",
        "fp AS (SELECT *, unnest(range(1, len(parts))) AS i FROM fm)",
        "fq AS (SELECT *, string_split(parts[i], chr(2))[-1] AS gap, list_sum(list_transform(parts[:i], lambda x: length(x))) - i + 1 AS s, length(string_split(parts[i + 1], chr(2))[1]) AS size FROM fp)",
        "fr AS (SELECT *, s + size AS e, substr(text, s::BIGINT + 1, size) AS raw FROM fq)",
        f"""fs AS MATERIALIZED (SELECT doc_id, pos, rank, kind, i, raw, CASE rank {" ".join(f"WHEN {r} THEN regexp_extract(raw, '{p}', 1)" for r, p in _TARGETS.items())} END AS target, opening,
        kind = 'relative_internal' AND regexp_matches(gap, '(?:§|par[.]){_S}*[0-9]+{_S}*$') AS led, e, s FROM fr)""",
        *_CLAIMED,
    ]
)
IN_WORDS_UNITS = f"{_UNITS}, ut AS (SELECT doc_id, pos, substr(text, off + 1, e - off) AS text FROM u JOIN derived USING (doc_id)), {FOUND_IN_WORDS}"


def _input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = structure.derived_clauses(table(spark, sf, "documents"))
    return docs, staged(structure.structural_units(docs).withColumn("pos", F.col("pos").cast("long")))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return references.context_edges(references.references(*_input(spark, sf)))


@query("structure_references", f"WITH {FOUND_UNITS} SELECT * FROM refs")
def all_references(spark: SparkSession, sf: str) -> DataFrame:
    return references.references(*_input(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query("structure_context_edges", f"WITH {IN_WORDS_UNITS} SELECT * FROM context_edges")
def context_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).withColumn("n", F.col("n").cast("long"))


@query("structure_call_units", f"""WITH {_UNITS} SELECT doc_id, 'off' AS arm, 'whole:' || sha256(text) AS unit_id, '' AS context FROM derived UNION ALL SELECT doc_id, 'mid', pos::VARCHAR, '' FROM u
    UNION ALL SELECT doc_id, 'on', pos::VARCHAR, CASE WHEN i % 3 = 0 THEN (pos - 1)::VARCHAR ELSE '' END FROM u""")
def call_units(spark: SparkSession, sf: str) -> DataFrame:
    docs, units = _input(spark, sf)
    edges = references.context_edges(references.references(docs, units))
    return references.call_units(docs, units, edges).withColumn("context", F.array_join("context", ","))


@query("structure_call_payloads", f"""WITH {_UNITS}, t AS (SELECT doc_id, i, pos, substr(text, off + 1, e - off) AS text FROM u JOIN derived USING (doc_id))
    SELECT t.doc_id, t.pos, sha256(t.text) AS text_sha256, CASE WHEN c.text IS NULL THEN 0 ELSE 1 END::BIGINT AS n_context, sha256(coalesce(c.text, '')) AS context_sha256
    FROM t LEFT JOIN t c ON t.doc_id = c.doc_id AND t.i % 3 = 0 AND c.pos = t.pos - 1""")
def call_payloads(spark: SparkSession, sf: str) -> DataFrame:
    docs, units = _input(spark, sf)
    texts = references.unit_texts(docs, units)
    got = references.call_payloads(texts, references.context_edges(references.resolve(references.find(texts), texts, units)))
    return got.select("doc_id", "pos", F.sha2("text", 256).alias("text_sha256"), F.size("context").cast("long").alias("n_context"), F.sha2(F.array_join("context", "\n"), 256).alias("context_sha256"))


@query("structure_context_ids", f"WITH {_UNITS} SELECT doc_id, target_pos AS context_pos, min(pos) AS first_pos, count(*) AS n_edges FROM edges GROUP BY 1, 2")
def context_ids(spark: SparkSession, sf: str) -> DataFrame:
    return references.context_ids(_edges(spark, sf))


# Numbered lines of which each refers to something in one of seven ways: another law, a paragraph that may not be there, a point,
# a passage of its own unit, one above, an annex and the whole document.
_KINDS = r"""kl AS (SELECT doc_id, list_transform(l, lambda x, i: '§ ' || i || '. ' || x || CASE (doc_id + i) % 7 WHEN 0 THEN ' art. 9 ustawy' WHEN 1 THEN ' por. par. 0' || (i + 2) || ' ust. 2' WHEN 2 THEN ' pkt 1.0' || i WHEN 3 THEN ' ust. 7' WHEN 4 THEN ' Jak wskazano powyżej' WHEN 5 THEN ' załącznik nr 3' ELSE ' niniejszej umowy' END) AS l
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    ko AS (SELECT doc_id, i, len(l) AS n, (sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l[i]) - 1)::BIGINT AS off, length(array_to_string(l, chr(10))) AS size FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM kl)),
    ks AS (SELECT doc_id FROM ko GROUP BY doc_id, n, size HAVING n >= 3 AND (size - max(off))::DOUBLE / size <= 0.5), ut AS (SELECT doc_id, i - 1 AS pos, l[i] || CASE WHEN i < n THEN chr(10) ELSE '' END AS text FROM ko JOIN ks USING (doc_id) JOIN kl USING (doc_id))"""


@query("structure_reference_kinds", f"WITH {_KINDS}, {FOUND_IN_WORDS} SELECT * FROM refs")
def reference_kinds(spark: SparkSession, sf: str) -> DataFrame:
    def line(doc, x, at):
        i, k = (at + 1).cast("string"), (doc + at + 1) % 7
        said = (
            F.when(k == 0, " art. 9 ustawy").when(k == 1, F.concat(F.lit(" por. par. 0"), (at + 3).cast("string"), F.lit(" ust. 2"))).when(k == 2, F.concat(F.lit(" pkt 1.0"), i)).when(k == 3, " ust. 7")
            .when(k == 4, " Jak wskazano powyżej").when(k == 5, " załącznik nr 3").otherwise(" niniejszej umowy")
        )
        return F.concat(F.lit("§ "), i, F.lit(". "), x, said)

    docs = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), lambda x, at: line(F.col("doc_id"), x, at)), "\n").alias("text"))
    units = structure.structural_units(docs).withColumn("pos", F.col("pos").cast("long"))
    return references.references(docs, units).select("doc_id", "pos", F.col("n").cast("long").alias("n"), "kind", "raw", "status", "target_pos")
