"""Queries of the engine over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import corpus, decision, quality, retrieval, runs, scoring, structure
from clausemill.plans.registry import query, table
from clausemill.sources.staging import dealt
from clausemill.streaming import events as streams

# ---------------------------------------------------------------- document structure

_LINES = r"""lines AS (SELECT doc_id, i AS line, l[i] AS piece FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM
    (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM documents)))"""


@query("structure_line_anchors", f"""WITH {_LINES}
    SELECT doc_id, line, (sum(length(piece)) OVER w - length(piece))::BIGINT AS start_offset, (sum(length(piece)) OVER w)::BIGINT AS end_offset
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)""")
def line_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return structure.line_anchors(table(spark, sf, "documents"))


@query("structure_content_groups", "SELECT sha256(text) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_groups(spark: SparkSession, sf: str) -> DataFrame:
    return structure.content_groups(table(spark, sf, "documents"))


_SENTENCES = r"""cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\n$', '\1'), '([.!?])(\s+)([A-ZĄĆĘŁŃÓŚŹŻ])', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS l FROM documents),
    piece AS (SELECT doc_id, i - 1 AS p, l[i] AS piece FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM cut)),
    placed AS (SELECT doc_id, p, piece, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY p))::BIGINT AS e FROM piece),
    sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos,
        e - length(piece) + CASE WHEN p = 0 THEN 0 ELSE length(piece) - length(regexp_replace(piece, '^\s+', '')) END AS start_offset, e AS end_offset
        FROM placed WHERE regexp_replace(piece, '\s+', '', 'g') <> '')"""
_WINDOWS = """win AS (SELECT doc_id, pos // 2 AS pos, start_offset, end_offset FROM (SELECT doc_id, pos, start_offset,
        coalesce(lead(end_offset, 2) OVER w, lead(end_offset, 1) OVER w, end_offset) AS end_offset, count(*) OVER (PARTITION BY doc_id) AS n FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        WHERE pos % 2 = 0 AND pos <= CASE WHEN n <= 3 THEN 0 ELSE ceil((n - 3) / 2.0) * 2 END)"""


@query("structure_sentences", f"WITH {_SENTENCES} SELECT doc_id, pos, start_offset::BIGINT AS start_offset, end_offset FROM sent")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return structure.sentences(table(spark, sf, "documents")).withColumn("pos", F.col("pos").cast("long"))


@query("structure_window_units", f"WITH {_SENTENCES}, {_WINDOWS} SELECT doc_id, pos, start_offset::BIGINT AS start_offset, end_offset FROM win")
def window_units(spark: SparkSession, sf: str) -> DataFrame:
    return structure.window_units(structure.sentences(table(spark, sf, "documents"))).withColumn("pos", F.col("pos").cast("long"))


@query("structure_fallback", f"""WITH {_SENTENCES}, {_WINDOWS} SELECT doc_id, bool_or(over) AS fallback FROM
    (SELECT doc_id, coalesce(lag(end_offset) OVER (PARTITION BY doc_id ORDER BY pos) > start_offset, false) AS over FROM win) GROUP BY doc_id""")
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    return structure.is_fallback(structure.window_units(structure.sentences(table(spark, sf, "documents"))))


@query("structure_input_hash", f"""WITH {_SENTENCES}, {_WINDOWS}, s AS (SELECT doc_id, string_agg(start_offset || ':' || end_offset, ',' ORDER BY pos) AS spans FROM win GROUP BY doc_id)
    SELECT doc_id, sha256(sha256(text) || '|None|' || spans) AS input_hash FROM documents JOIN s USING (doc_id)""")
def input_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return structure.input_hash(docs, structure.window_units(structure.sentences(docs)))


@query("structure_doc_profile", rf"""WITH {_SENTENCES}, {_WINDOWS}, u AS (SELECT doc_id, count(*) AS n FROM win GROUP BY doc_id),
    f AS (SELECT doc_id, bool_or(over) AS fallback FROM (SELECT doc_id, coalesce(lag(end_offset) OVER (PARTITION BY doc_id ORDER BY pos) > start_offset, false) AS over FROM win) GROUP BY doc_id)
    SELECT d.doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '\S+')) AS n_words, coalesce(n, 0) AS n_units, coalesce(fallback, false) AS fallback
    FROM documents d LEFT JOIN u USING (doc_id) LEFT JOIN f USING (doc_id)""")
def doc_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    got = structure.doc_profile(docs, structure.window_units(structure.sentences(docs)))
    return got.withColumn("n_chars", F.col("n_chars").cast("long")).withColumn("n_words", F.col("n_words").cast("long"))


_DERIVED = r"""derived AS (SELECT doc_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: '§ ' || i || '. ' || l[i]
    || CASE WHEN i % 3 = 0 THEN ' zgodnie z § ' || (i - 1) ELSE '' END || CASE WHEN i % 5 = 0 THEN ' oraz załącznik nr ' || i ELSE '' END), chr(10)) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    dl AS (SELECT doc_id, length(text) AS n, i, (sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l[i]) - 1)::BIGINT AS off
    FROM (SELECT doc_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM derived))),
    st AS (SELECT doc_id, n, count(*) AS n_markers, (n - max(off))::DOUBLE / n AS tail FROM dl GROUP BY doc_id, n)"""


@query("structure_level_stats", f"WITH {_DERIVED} SELECT doc_id, 'paragraph' AS level, n_markers, 1.0::DOUBLE AS monotonicity, 1.0::DOUBLE AS coverage, tail FROM st")
def level_stats(spark: SparkSession, sf: str) -> DataFrame:
    got = structure.level_stats(structure.markers(structure.derived_clauses(table(spark, sf, "documents"))))
    return got.select("doc_id", "level", "n_markers", "monotonicity", "coverage", "tail")


# Lines that begin with markers of every level, some parted from their numbers by blank lines; numbers go up, skip and fall back.
_MARKED = r"""mk AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE (doc_id + i) % 8 WHEN 0 THEN '§' || repeat(chr(10), (i % 40)::INT) || ' ' || n[i] || '. ' WHEN 1 THEN 'Art. ' || n[i] || ' ' WHEN 2 THEN (i % 4) || '.' || n[i] || '. '
        WHEN 3 THEN 'ust. 0' || n[i] || '000000000000' WHEN 4 THEN 'PKT.' || chr(10) || n[i] WHEN 5 THEN 'lit. ' || chr((97 + i % 6)::INT) || ') ' WHEN 6 THEN '§ ' || n[i] || ' ' ELSE '' END || x), chr(10)) AS text
        FROM (SELECT doc_id, l, list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i % 9 < 6 THEN i // 8 + 1 ELSE i % 3 END) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    ml AS (SELECT doc_id, text, (sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l[i]) - 1)::BIGINT AS off FROM (SELECT doc_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM mk))),
    mv AS (SELECT doc_id, length(text) AS n, off, text[off + 1 :] AS v FROM ml),
    mm AS (SELECT doc_id, n, off, unnest(['paragraph', 'article', 'outline', 'section', 'point', 'letter']) AS level, unnest([regexp_extract(v, '(?i)^(?:§|[S5$8])\s*(\d+)', 1), regexp_extract(v, '(?i)^Art\.\s*(\d+)', 1), regexp_extract(v, '^(\d+(?:\.\d+)*)\.?\s', 1),
        regexp_extract(v, '(?i)^ust\.\s*(\d+)', 1), regexp_extract(v, '(?i)^pkt\.\s*(\d+)', 1), regexp_extract(v, '(?i)^lit\.\s*([a-ząćęłńóśźż])', 1)]) AS raw FROM mv),
    mp AS (SELECT doc_id, n, off, level, CASE WHEN level = 'letter' THEN [ascii(lower(raw))::HUGEINT] ELSE list_transform(string_split(raw, '.'), lambda x: x::HUGEINT) END AS f FROM mm WHERE raw <> ''),
    mf AS (SELECT *, lag(f) OVER (PARTITION BY doc_id, level ORDER BY off) AS p FROM mp),
    ms AS (SELECT doc_id, n, off, level, CASE WHEN p IS NULL THEN NULL ELSE (f = [1] OR f = list_append(p, 1) OR len(list_filter(range(1, len(p) + 1), lambda k: f[1:k] = list_append(p[1 : k - 1], p[k] + 1) AND len(list_filter(f[k + 1 :], lambda x: x <> 1)) = 0)) > 0)::INT END AS ok FROM mf)"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    i = lambda at: (at + 1).cast("int")
    n = lambda at: F.when(i(at) % 9 < 6, F.floor(i(at) / 8) + 1).otherwise(i(at) % 3).cast("string")

    def line(doc: Column, x: Column, at: Column) -> Column:
        k = (doc + i(at)) % 8
        lead = (
            F.when(k == 0, F.concat(F.lit("§"), F.repeat(F.lit("\n"), i(at) % 40), F.lit(" "), n(at), F.lit(". "))).when(k == 1, F.concat(F.lit("Art. "), n(at), F.lit(" "))).when(k == 2, F.concat((i(at) % 4).cast("string"), F.lit("."), n(at), F.lit(". ")))
            .when(k == 3, F.concat(F.lit("ust. 0"), n(at), F.lit("000000000000"))).when(k == 4, F.concat(F.lit("PKT.\n"), n(at))).when(k == 5, F.concat(F.lit("lit. "), F.chr(i(at) % 6 + 97), F.lit(") "))).when(k == 6, F.concat(F.lit("§ "), n(at), F.lit(" "))).otherwise("")
        )
        return F.concat(lead, x)

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), lambda x, at: line(F.col("doc_id"), x, at)), "\n").alias("text"))


@query("structure_marker_stats", f"WITH {_MARKED} SELECT doc_id, level, count(*) AS n_markers, coalesce(avg(ok), 1.0)::DOUBLE AS monotonicity, (n - min(off))::DOUBLE / n AS coverage, (n - max(off))::DOUBLE / n AS tail FROM ms GROUP BY doc_id, n, level")
def marker_stats(spark: SparkSession, sf: str) -> DataFrame:
    return structure.level_stats(structure.markers(_marked(spark, sf))).select("doc_id", "level", "n_markers", "monotonicity", "coverage", "tail")


@query("structure_marked_units", f"""WITH {_MARKED}, stats AS (SELECT doc_id, level, count(*) AS c, coalesce(avg(ok), 1.0) AS m, (n - min(off))::DOUBLE / n AS cov, (n - max(off))::DOUBLE / n AS tail FROM ms GROUP BY doc_id, n, level),
    best AS (SELECT doc_id, arg_min(level, list_position(['paragraph', 'article', 'outline', 'section', 'point', 'letter'], level)) AS level FROM stats WHERE c >= 3 AND m >= 0.8 AND cov >= 0.6 AND tail <= 0.5 GROUP BY doc_id)
    SELECT doc_id, level, row_number() OVER w - 1 AS pos, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE off END AS start_offset, coalesce(lead(off) OVER w, n)::BIGINT AS end_offset FROM ms JOIN best USING (doc_id, level) WINDOW w AS (PARTITION BY doc_id ORDER BY off)""")
def marked_units(spark: SparkSession, sf: str) -> DataFrame:
    docs = _marked(spark, sf)
    chosen = structure.choose_level(structure.level_stats(structure.markers(docs)))
    return structure.structural_units(docs).join(chosen, "doc_id").select("doc_id", "level", F.col("pos").cast("long").alias("pos"), "start_offset", "end_offset")


@query("structure_structural_units", f"""WITH {_DERIVED} SELECT doc_id, i - 1 AS pos, off AS start_offset, coalesce(lead(off) OVER (PARTITION BY doc_id ORDER BY i), n)::BIGINT AS end_offset
    FROM dl JOIN st USING (doc_id, n) WHERE n_markers >= 3 AND tail <= 0.5""")
def structural_units(spark: SparkSession, sf: str) -> DataFrame:
    got = structure.structural_units(structure.derived_clauses(table(spark, sf, "documents")))
    return got.withColumn("pos", F.col("pos").cast("long"))


@query("structure_segment_modes", f"WITH {_DERIVED} SELECT CASE WHEN n_markers >= 3 AND tail <= 0.5 THEN 'structural' ELSE 'window' END AS mode, count(*) AS documents FROM st GROUP BY 1")
def segment_modes(spark: SparkSession, sf: str) -> DataFrame:
    got = structure.segment(structure.derived_clauses(table(spark, sf, "documents")))
    return got.groupBy("mode").agg(F.count_distinct("doc_id").alias("documents"))


# ---------------------------------------------------------------- retrieval

_FOLD = "regexp_extract_all(replace(strip_accents(replace(lower(text), 'ß', 'ss')), 'ł', 'l'), '[0-9a-z]+')"
_TERMS = f"terms AS (SELECT doc_id AS unit_id, unnest({_FOLD}) AS term FROM documents)"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), "text")


@query("retrieval_corpus_terms", f"WITH {_TERMS} SELECT term, count(*) AS n, count(DISTINCT unit_id) AS units FROM terms GROUP BY term")
def corpus_terms(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.corpus_terms(_units(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_id").alias("units"))


@query("retrieval_vocabulary", f"""WITH {_TERMS}, v AS (SELECT term, count(DISTINCT unit_id) AS df FROM terms GROUP BY term)
    SELECT ('0x' || substr(sha256(term), 1, 8))::BIGINT AS term_id, count(*) AS n_terms, sum(df)::BIGINT AS df FROM v GROUP BY 1""")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vocabulary(retrieval.corpus_terms(_units(spark, sf)))


_POST = f"""{_TERMS}, tf AS (SELECT unit_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), ln AS (SELECT unit_id, count(*) AS n FROM terms GROUP BY 1),
    post AS (SELECT unit_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 256)) AS weight FROM tf JOIN ln USING (unit_id))"""


@query("retrieval_postings", f"WITH {_POST} SELECT unit_id, count(*) AS terms, round(sum(weight), 6) AS weight FROM post GROUP BY unit_id")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieval.postings(retrieval.corpus_terms(_units(spark, sf)))
    return got.groupBy("unit_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight"))


_SPARSE = f"""{_POST}, q AS (SELECT DISTINCT item_id AS query_id, unnest({_FOLD}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM
      (SELECT query_id, unit_id, round(sum(weight * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS score
       FROM q JOIN df USING (term) JOIN post USING (term) GROUP BY 1, 2)) WHERE rank <= 5)"""


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    units = _units(spark, sf)
    wanted = retrieval.query_terms(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return retrieval.sparse_topk(retrieval.build_index(units), wanted, 5, units.agg(F.count(F.lit(1)).alias("n")))


@query("retrieval_bm25_pruned", f"WITH {_SPARSE} SELECT query_id, unit_id, score, rank FROM sparse")
def bm25_pruned(spark: SparkSession, sf: str) -> DataFrame:
    units = _units(spark, sf)
    wanted = retrieval.query_terms(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    got = retrieval.pruned_topk(retrieval.build_index(units), wanted, 5, units.agg(F.count(F.lit(1)).alias("n")))
    return got.select("query_id", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


@query("retrieval_bm25_topk", f"WITH {_SPARSE} SELECT query_id, unit_id, score, rank FROM sparse")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(spark, sf).select("query_id", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


_DENSE = """u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings WHERE len(embedding) = 64),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM
      (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, round(list_dot_product(u.v, q.v), 6) AS score FROM u, u q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5)"""


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    unit = retrieval.unit_vectors(table(spark, sf, "embeddings"), 64)
    return retrieval.dense_topk(unit, unit.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "unit"), 5)


@query("retrieval_dense_topk", f"WITH {_DENSE} SELECT query_id, unit_id, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).select("query_id", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


@query("retrieval_dense_all_pairs", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings WHERE len(embedding) = 64)
    SELECT * FROM (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, round(list_dot_product(u.v, q.v), 6) AS score FROM u, u q)) WHERE rank <= 3""")
def dense_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a query, by the grid of blocks."""
    unit = retrieval.unit_vectors(table(spark, sf, "embeddings"), 64)
    got = retrieval.dense_topk(unit, unit.select(F.col("vec_id").alias("query_id"), "unit"), 3, most=256)
    return got.select("query_id", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


@query("retrieval_rank_fusion", f"""WITH {_SPARSE}, {_DENSE}, f AS (SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.unit_id, d.unit_id) AS unit_id,
    round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 9) AS score FROM sparse s FULL JOIN dense d ON s.query_id = d.query_id AND s.unit_id = d.unit_id)
    SELECT * FROM (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sha256(unit_id::VARCHAR)) AS rank FROM f) WHERE rank <= 5""")
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieval.rrf(_sparse(spark, sf), _dense(spark, sf), 5)
    return got.select("query_id", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


@query("retrieval_sanitize", r"""SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[\pL\pN_]+'), ' ') AS sparse_text,
    'query: ' || array_to_string(regexp_extract_all(text, '[\pL\pN_]+'), ' ') AS dense_text, CASE WHEN NOT regexp_matches(text, '[\pL\pN_]') THEN 'retrieval_query_empty' END AS error FROM benchmark""")
def sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sanitize(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("retrieval_repeated_queries", "SELECT conv_id, count(DISTINCT sha256(text)) AS searches, count(*) - count(DISTINCT sha256(text)) AS cache_hits FROM conversations GROUP BY conv_id")
def repeated_queries(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.repeated_queries(table(spark, sf, "conversations"))


@query("retrieval_batches", """SELECT source, batch, count(*) AS inputs, min(doc_id) AS first_doc FROM
    (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 128 AS batch FROM documents) GROUP BY 1, 2""")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieval.assign_batches(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 128, "source")
    return got.groupBy("source", F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("inputs"), F.min("doc_id").alias("first_doc"))


# ---------------------------------------------------------------- decision and findings

_FACTS_SQL = """facts AS (SELECT o_orderkey AS key, o_orderkey % 11 <> 0 AS processed, o_orderkey % 13 <> 0 AS adjudicable, o_custkey % 4 AS cleared,
    CASE o_orderkey % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS relevant,
    CASE o_orderstatus WHEN 'F' THEN 'in_force' WHEN 'O' THEN 'in_force' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'undetermined' ELSE 'not_in_force' END END AS force,
    CASE o_custkey % 5 WHEN 0 THEN 'imperative' WHEN 1 THEN 'dispositive' WHEN 2 THEN 'semi_imperative' WHEN 3 THEN 'undetermined' ELSE 'semi_imperative' END AS ch,
    CASE (o_orderkey // 3) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'present' ELSE 'undetermined' END AS dep,
    CASE WHEN o_custkey % 7 <> 0 THEN 'known' END AS permitted,
    CASE o_custkey % 3 WHEN 0 THEN 'with_permitted_direction' WHEN 1 THEN 'against_permitted_direction' ELSE 'undetermined' END AS dir FROM orders)"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("key"),
        (k % 11 != 0).alias("processed"),
        (k % 13 != 0).alias("adjudicable"),
        (c % 4).alias("candidates_cleared"),
        F.when(k % 5 == 0, False).when(k % 5 != 1, True).alias("relevant"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "in_force").when(k % 2 == 0, "undetermined").otherwise("not_in_force").alias("force"),
        F.when(c % 5 == 0, "imperative").when(c % 5 == 1, "dispositive").when(c % 5 == 3, "undetermined").otherwise("semi_imperative").alias("character"),
        F.when(F.floor(k / 3) % 3 == 0, "none").when(F.floor(k / 3) % 3 == 1, "present").otherwise("undetermined").alias("departure"),
        F.when(c % 7 != 0, "known").alias("permitted"),
        F.when(c % 3 == 0, "with_permitted_direction").when(c % 3 == 1, "against_permitted_direction").otherwise("undetermined").alias("direction"),
        F.lit(0.5).alias("raw_confidence"),
    )


@query("decision_resolve_finding", f"""WITH {_FACTS_SQL}, r AS (SELECT key, CASE WHEN NOT processed THEN 'not_processed' WHEN NOT adjudicable THEN 'unit_not_adjudicable' WHEN cleared = 0 THEN 'no_basis_found'
    WHEN relevant = false THEN 'no_relation' WHEN relevant IS NULL THEN 'uncertain/relation_below_threshold' WHEN force = 'undetermined' THEN 'uncertain/force_state_undetermined'
    WHEN force = 'not_in_force' THEN 'basis_not_in_force' WHEN dep = 'undetermined' THEN 'uncertain/relation_below_threshold' WHEN ch = 'undetermined' THEN 'uncertain/provision_character_undetermined'
    WHEN ch = 'semi_imperative' AND permitted IS NULL THEN 'uncertain/permitted_direction_undetermined' WHEN dep = 'none' THEN 'consistent' WHEN ch = 'imperative' THEN 'contradictory'
    WHEN ch = 'dispositive' THEN 'permissible_departure' WHEN dir = 'undetermined' THEN 'uncertain/departure_direction_undetermined' WHEN dir = 'with_permitted_direction' THEN 'permissible_departure' ELSE 'contradictory' END AS x FROM facts)
    SELECT key, split_part(x, '/', 1) AS code, nullif(split_part(x, '/', 2), '') AS cause, NULL::VARCHAR AS violation FROM r""")
def resolve_finding(spark: SparkSession, sf: str) -> DataFrame:
    return decision.resolve_finding(_facts(spark, sf)).select("key", "code", "cause", "violation")


_GAPS = """g AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 > 0 THEN true END AS relevant, CASE WHEN o_orderkey % 3 > 0 THEN 'in_force' END AS force, [NULL, 'present', 'odd', 'present'][o_custkey % 4 + 1] AS dep, [NULL, 'imperative', 'dispositive', 'semi_imperative', 'undetermined', 'odd'][o_custkey % 6 + 1] AS ch,
    [NULL, 'odd', 'undetermined', 'with_permitted_direction'][o_orderkey % 4 + 1] AS dir, o_custkey % 5 > 0 AS permitted, o_orderkey % 2 = 0 AS sure FROM orders),
    x AS (SELECT *, CASE WHEN relevant IS NULL THEN 'uncertain/relation_below_threshold' WHEN force IS NULL THEN '!force_missing' WHEN ch = 'undetermined' THEN 'uncertain/provision_character_undetermined' WHEN ch IS NULL THEN '!character_missing' WHEN ch = 'semi_imperative' AND NOT permitted THEN 'uncertain/permitted_direction_undetermined'
        WHEN dep IS NULL THEN '!departure_missing' WHEN dep = 'odd' OR ch = 'odd' THEN '!unmapped' WHEN ch = 'imperative' THEN 'contradictory' WHEN ch = 'dispositive' THEN 'permissible_departure' WHEN dir IS NULL THEN '!direction_missing' WHEN dir = 'odd' THEN '!unmapped'
        WHEN dir = 'undetermined' THEN 'uncertain/departure_direction_undetermined' ELSE 'permissible_departure' END AS x FROM g),
    y AS (SELECT key, CASE WHEN x LIKE 'uncertain%' AND NOT sure THEN '!confidence_missing' ELSE x END AS x FROM x)"""


@query("decision_violations", f"WITH {_GAPS} SELECT key, CASE WHEN x NOT LIKE '!%' THEN split_part(x, '/', 1) END AS code, CASE WHEN x NOT LIKE '!%' THEN nullif(split_part(x, '/', 2), '') END AS cause, CASE WHEN x LIKE '!%' THEN x[2:] END AS violation FROM y")
def decision_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with gaps and with values that the table does not have."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    facts = table(spark, sf, "orders").select(
        k.alias("key"), F.lit(True).alias("processed"), F.lit(True).alias("adjudicable"), F.lit(1).alias("candidates_cleared"), F.when(k % 5 > 0, True).alias("relevant"), F.when(k % 3 > 0, "in_force").alias("force"), pick(c, None, "imperative", "dispositive", "semi_imperative", "undetermined", "odd").alias("character"),
        pick(c, None, "present", "odd", "present").alias("departure"), F.when(c % 5 > 0, "known").alias("permitted"), pick(k, None, "odd", "undetermined", "with_permitted_direction").alias("direction"), F.when(k % 2 == 0, 0.5).alias("raw_confidence"),
    )
    return decision.resolve_finding(facts).select("key", "code", "cause", "violation")


@query("decision_number_entries", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, 'e' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry_id FROM conversations")
def number_entries(spark: SparkSession, sf: str) -> DataFrame:
    got = decision.number_entries(table(spark, sf, "conversations"), ["conv_id"], "turn")
    return got.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "entry_id")


@query("decision_fill_not_processed", """WITH f AS (SELECT l_orderkey AS run_id, l_suppkey AS unit_id, l_returnflag || l_linestatus AS code FROM lineitem), u AS (SELECT DISTINCT o_orderkey AS run_id FROM orders)
    SELECT run_id, code, count(*) AS n FROM (SELECT run_id, code FROM f UNION ALL SELECT run_id, 'not_processed' FROM u WHERE run_id NOT IN (SELECT run_id FROM f)) GROUP BY 1, 2""")
def fill_not_processed(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    return runs.histogram(decision.fill_not_processed(units, _findings(spark, sf), ["run_id"]), ["run_id"])


@query("decision_resolve_quotes", r"""WITH q AS (SELECT doc_id, text, CASE doc_id % 9 WHEN 0 THEN ['not', 'in(', 'here'] WHEN 1 THEN [] ELSE regexp_extract_all(text, '\S+')[2:4] END AS w FROM documents),
    p AS (SELECT *, array_to_string(list_transform(w, lambda x: regexp_replace(x, '([\\.+*?()|\[\]{}^$])', '\\\1', 'g')), '\s+') AS pattern FROM q), n AS (SELECT *, CASE WHEN pattern <> '' THEN len(regexp_extract_all(text, pattern)) END AS n, CASE WHEN pattern <> '' THEN regexp_extract(text, pattern) END AS hit FROM p)
    SELECT doc_id AS key, doc_id, CASE WHEN pattern = '' THEN 'empty' WHEN n = 0 THEN 'fabricated' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution, CASE WHEN n = 1 THEN strpos(text, hit) - 1 END AS start_offset, CASE WHEN n = 1 THEN strpos(text, hit) - 1 + length(hit) END AS end_offset FROM n""")
def resolve_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The second to fourth word of each document as a quote in it; some quotes are blank, and some are in no document."""
    own = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(\S+)")), 2, 3), "\n ")
    quote = F.when(F.col("doc_id") % 9 == 0, "not in( here").when(F.col("doc_id") % 9 == 1, " ").otherwise(own)
    quotes = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "doc_id", quote.alias("quote"))
    return decision.resolve_quotes(quotes, table(spark, sf, "documents").select("doc_id", "text"))


@query("decision_place_findings", f"""WITH {_LINES}, a AS (SELECT doc_id, line, (sum(length(piece)) OVER w - length(piece))::BIGINT AS s, (sum(length(piece)) OVER w)::BIGINT AS e FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    f AS (SELECT doc_id AS key, doc_id, n_chars // 2 AS off FROM documents) SELECT key, f.doc_id, min(line)::BIGINT AS line FROM f LEFT JOIN a ON f.doc_id = a.doc_id AND off >= s AND off < e GROUP BY 1, 2""")
def place_findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = docs.select(F.col("doc_id").alias("key"), "doc_id", F.expr("n_chars div 2").alias("offset"))
    return decision.place_findings(found, structure.line_anchors(docs)).withColumn("line", F.col("line").cast("long"))


# ---------------------------------------------------------------- runs

_RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS document_id, ['off', 'mid', 'on'][o_orderkey % 3 + 1] AS arm, year(o_orderdate) AS series,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_totalprice AS seconds, o_orderpriority AS stratum FROM orders)"""
_FIND_SQL = "findings AS (SELECT l_orderkey AS run_id, l_linenumber AS seq, l_suppkey AS unit_id, l_partkey AS item_id, l_quantity::BIGINT AS tokens, CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'not_processed' ELSE l_returnflag || l_linestatus END AS code FROM lineitem)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    arm = F.element_at(F.array(*map(F.lit, runs.ARMS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), arm.alias("arm"), F.year("o_orderdate").cast("long").alias("series"), status.alias("status"), F.col("o_totalprice").alias("seconds"), F.col("o_orderpriority").alias("stratum")
    )


def _findings(spark: SparkSession, sf: str, raw: bool = True) -> DataFrame:
    code = F.concat("l_returnflag", "l_linestatus")
    if not raw:
        code = F.when(code == "NO", "not_processed").otherwise(code)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("unit_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("long").alias("tokens"), code.alias("code")
    )


@query("runs_returned_model", "SELECT l_orderkey AS run_id, arg_min('m' || (l_suppkey % 5), l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS model FROM lineitem GROUP BY 1")
def returned_model(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    attempts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), seq.alias("seq"), (F.col("l_returnflag") != "R").alias("success"), F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model"))
    return runs.returned_model(attempts)


@query("runs_reconcile", f"""WITH {_RUNS_SQL} SELECT CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN 'process_restarted' END AS failure, count(*) AS n FROM runs GROUP BY 1, 2""")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return runs.reconcile(_runs(spark, sf)).groupBy("status", "failure").agg(F.count(F.lit(1)).alias("n"))


@query("runs_merge_totals", f"WITH {_RUNS_SQL} SELECT run_id, CASE WHEN run_id % 2 = 0 AND run_id % 3 <> 0 THEN seconds * 2 ELSE seconds END AS seconds FROM runs")
def merge_totals(spark: SparkSession, sf: str) -> DataFrame:
    stored = _runs(spark, sf).select("run_id", "seconds")
    new = stored.where("run_id % 2 = 0").select("run_id", F.when(F.col("run_id") % 3 != 0, F.col("seconds") * 2).alias("seconds"))
    return runs.merge_totals(stored, new, ["seconds"])


@query("runs_erase", f"""WITH {_RUNS_SQL}, {_FIND_SQL}, gone AS (SELECT run_id FROM runs WHERE document_id % 10 = 0)
    SELECT run_id, count(*) AS findings FROM findings WHERE run_id NOT IN (SELECT run_id FROM gone) GROUP BY run_id""")
def erase(spark: SparkSession, sf: str) -> DataFrame:
    all_runs = _runs(spark, sf)
    _, left = runs.erase(all_runs.where("document_id % 10 = 0").select("document_id").distinct(), all_runs, _findings(spark, sf))
    return left.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"))


@query("runs_metrics", f"""WITH {_RUNS_SQL}, {_FIND_SQL}, a AS (SELECT run_id, sum(tokens)::BIGINT AS tokens, count(*) AS attempts, count(DISTINCT unit_id) AS units_total,
    count(DISTINCT unit_id) FILTER (WHERE code <> 'not_processed') AS units_with_finding, count(*) FILTER (WHERE code = 'not_processed') AS not_processed FROM findings GROUP BY run_id)
    SELECT run_id, tokens, coalesce(attempts, 0) AS attempts, coalesce(units_total, 0) AS units_total, coalesce(units_with_finding, 0) AS units_with_finding, coalesce(not_processed, 0) AS not_processed FROM runs LEFT JOIN a USING (run_id)""")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = _findings(spark, sf, raw=False)
    return runs.run_metrics(_runs(spark, sf), found, found)


@query("runs_arm_stratum", f"""WITH {_RUNS_SQL}, {_FIND_SQL}, t AS (SELECT run_id, sum(tokens)::BIGINT AS tokens, count(*) AS attempts, count(*) FILTER (WHERE code = 'not_processed') AS np FROM findings GROUP BY run_id), j AS (SELECT *, run_id % 6 <> 0 AS ok, status = 'completed' AND run_id % 6 <> 0 AS v FROM runs LEFT JOIN t USING (run_id))
    SELECT arm, stratum, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE NOT ok) AS invalid, round(avg(seconds) FILTER (WHERE v), 4) AS mean_seconds, round(median(seconds) FILTER (WHERE v), 4) AS median_seconds,
    (sum(tokens) FILTER (WHERE v))::BIGINT AS total_tokens, round(avg(tokens) FILTER (WHERE v), 4) AS mean_tokens, (sum(attempts) FILTER (WHERE v))::BIGINT AS attempts, (sum(np) FILTER (WHERE v))::BIGINT AS not_processed FROM j GROUP BY arm, stratum""")
def arm_stratum(spark: SparkSession, sf: str) -> DataFrame:
    each = _findings(spark, sf, raw=False).groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("code") == "not_processed").alias("not_processed"))
    return runs.arm_stratum(_runs(spark, sf).withColumn("measurement_valid", F.col("run_id") % 6 != 0).join(each, "run_id", "left"))


@query("runs_parity", f"""WITH {_RUNS_SQL}, g AS (SELECT document_id, count(*) FILTER (WHERE run_id % 5 <> 0) AS n, count(DISTINCT arm) FILTER (WHERE run_id % 5 <> 0) AS a, count(DISTINCT stratum) FILTER (WHERE run_id % 5 <> 0) AS s, bool_and(status <> 'failed') FILTER (WHERE run_id % 5 <> 0) AS ok FROM runs GROUP BY 1)
    SELECT document_id, n > 0 AND a <= 1 AND s <= 1 AND ok AS valid, concat_ws(',', CASE WHEN a > 1 THEN 'arm' END, CASE WHEN s > 1 THEN 'stratum' END) AS mismatched FROM g""")
def parity(spark: SparkSession, sf: str) -> DataFrame:
    every = _runs(spark, sf).withColumn("parent_run_id", F.when(F.col("run_id") % 5 == 0, F.col("run_id") + 1))
    return runs.parity(every.withColumn("measurement_valid", F.col("status") != "failed"), ["document_id"], ["arm", "stratum"])


@query("runs_ambiguous", f"""WITH {_RUNS_SQL} SELECT document_id, arm, count(*) AS n, string_agg(run_id::VARCHAR, ',' ORDER BY run_id) AS run_ids FROM runs WHERE status = 'completed' AND run_id % 7 <> 0 GROUP BY 1, 2 HAVING count(*) > 1""")
def ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return runs.ambiguous(_runs(spark, sf).withColumn("parent_run_id", F.when(F.col("run_id") % 7 == 0, 1)))


@query("runs_cross_batch", f"""WITH {_RUNS_SQL}, a AS (SELECT document_id, arm, list(run_id) AS x FROM runs WHERE series % 2 = 0 OR run_id % 10 = 0 GROUP BY 1, 2), b AS (SELECT document_id, arm, list(run_id) AS y FROM runs WHERE series % 2 = 1 GROUP BY 1, 2)
    SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.arm, b.arm) AS arm, CASE WHEN a.arm IS NULL THEN 'unmatched' WHEN b.arm IS NULL THEN 'uncovered' WHEN list_has_any(x, y) THEN 'same_run' ELSE 'matched' END AS state
    FROM a FULL JOIN b ON a.document_id = b.document_id AND a.arm = b.arm""")
def cross_batch(spark: SparkSession, sf: str) -> DataFrame:
    all_runs = _runs(spark, sf)
    return runs.cross_batch(all_runs.where("series % 2 = 0 or run_id % 10 = 0"), all_runs.where("series % 2 = 1"))


@query("runs_coverage", f"""WITH {_RUNS_SQL}, need AS (SELECT DISTINCT c_nationkey::VARCHAR AS comparison, c_custkey AS document_id, unnest(['off', 'mid', 'on']) AS arm FROM customer), have AS (SELECT document_id, arm, bool_or(status = 'completed') AS have, bool_or(status = 'failed') AS failed FROM runs GROUP BY 1, 2)
    SELECT comparison, count(*) AS cells, count(*) FILTER (WHERE have) AS held, count(*) - count(*) FILTER (WHERE have) AS missing, coalesce(string_agg(need.document_id || '/' || need.arm, ',' ORDER BY need.document_id || '/' || need.arm) FILTER (WHERE have IS NOT TRUE), '') AS missing_cells,
    count(*) = count(*) FILTER (WHERE have) AS complete, coalesce(bool_or(failed), false) AS any_failed FROM need LEFT JOIN have ON need.document_id = have.document_id AND need.arm = have.arm GROUP BY comparison""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    need = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("comparison"), F.col("c_custkey").alias("document_id"), F.explode(F.array(*map(F.lit, runs.ARMS))).alias("arm"))
    return runs.coverage(need, _runs(spark, sf))


def _in_parts(key: str, lines: str, name: str) -> str:
    return f"""WITH l AS ({lines}), p AS (SELECT {key}, line, ('0x' || substr(sha256(line), 1, 2))::INT AS part FROM l), h AS (SELECT {key}, part, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM p GROUP BY ALL)
        SELECT {key}, sha256(string_agg(part || ':' || h, chr(10) ORDER BY part)) AS {name} FROM h GROUP BY 1"""


@query("runs_fingerprint", _in_parts("nation", "SELECT c_nationkey AS nation, c_custkey || '|' || c_custkey || '|' || c_name AS line FROM customer", "fingerprint"))
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return runs.fingerprint(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation"), ["nation"], "c_custkey", ["c_custkey", "c_name"])


# ---------------------------------------------------------------- scoring

_CELLS_SQL = f"""{_RUNS_SQL}, j AS (SELECT series, document_id, arm, CASE l_linenumber % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' ELSE 'unresolved' END AS status, l_tax > 0.02 AS anchored, l_partkey AS item_id, l_discount > 0.02 AS covers, ['correct', 'incorrect', 'unresolved'][l_partkey % 3 + 1] AS jc, ['supported', 'unsupported', 'not_applicable'][l_suppkey % 3 + 1] AS jb, CASE WHEN l_partkey % 4 = 0 THEN 'supported' ELSE 'not_applicable' END AS je
      FROM lineitem JOIN runs ON l_orderkey = run_id), k AS (SELECT p_partkey % 1500 AS document_id, count(*) AS items FROM part GROUP BY 1),
    g AS (SELECT series, document_id, arm, count(*) FILTER (WHERE status = 'correct') AS c, count(*) FILTER (WHERE status = 'incorrect') AS i, count(*) FILTER (WHERE status = 'unresolved') AS u,
      count(DISTINCT item_id) FILTER (WHERE status = 'correct' AND anchored AND covers) AS v, count(*) FILTER (WHERE jc = 'correct') AS cg, count(*) FILTER (WHERE jc = 'incorrect') AS cb,
      count(*) FILTER (WHERE jb = 'supported') AS bg, count(*) FILTER (WHERE jb = 'unsupported') AS bb, count(*) FILTER (WHERE je = 'supported') AS eg FROM j GROUP BY 1, 2, 3),
    b AS (SELECT r.series, r.document_id, r.arm, r.stratum, coalesce(c, 0) AS c, coalesce(i, 0) AS i, coalesce(u, 0) AS u, coalesce(v, 0) AS v, coalesce(items, 0) AS items, coalesce(cg, 0) AS cg, coalesce(cb, 0) AS cb, coalesce(bg, 0) AS bg, coalesce(bb, 0) AS bb, coalesce(eg, 0) AS eg
      FROM (SELECT DISTINCT series, document_id, arm, 's' || (document_id % 5) AS stratum FROM runs) r LEFT JOIN g USING (series, document_id, arm) LEFT JOIN k USING (document_id)),
    n AS (SELECT series, document_id, arm, stratum, unnest([{{'d': 'precision', 'x': c, 'y': c + i}}, {{'d': 'completeness', 'x': v, 'y': items}}, {{'d': 'unresolved_share', 'x': u, 'y': c + i + u}}, {{'d': 'confirmed_share', 'x': c, 'y': c + i + u}}, {{'d': 'classification_accuracy', 'x': cg, 'y': cg + cb}}, {{'d': 'legal_basis_accuracy', 'x': bg, 'y': bg + bb}}, {{'d': 'explanation_accuracy', 'x': eg, 'y': eg}}]) AS q FROM b),
    cells AS (SELECT series, document_id, arm, stratum, q.d AS dimension, q.x AS numerator, q.y AS denominator, CASE WHEN q.y > 0 THEN q.x::DOUBLE / q.y END AS rate FROM n)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    all_runs = _runs(spark, sf).withColumn("stratum", F.concat(F.lit("s"), (F.col("document_id") % 5).cast("string")))
    line = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_discount"), "l_orderkey")
    n = F.col("l_linenumber") % 3
    judged = line.join(all_runs, line["l_orderkey"] == all_runs["run_id"]).select(
        "series", "document_id", "arm", F.when(n == 0, "correct").when(n == 1, "incorrect").otherwise("unresolved").alias("status"), (F.col("l_tax") > 0.02).alias("anchored"), F.col("l_partkey").alias("item_id"), (F.col("l_discount") > 0.02).alias("covers"),
        F.element_at(F.array(*map(F.lit, ("correct", "incorrect", "unresolved"))), (F.col("l_partkey") % 3 + 1).cast("int")).alias("classification"),
        F.element_at(F.array(*map(F.lit, ("supported", "unsupported", "not_applicable"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("legal_basis"),
        F.when(F.col("l_partkey") % 4 == 0, "supported").otherwise("not_applicable").alias("explanation"),
    )
    key = table(spark, sf, "part").groupBy((F.col("p_partkey") % 1500).alias("document_id")).agg(F.count(F.lit(1)).alias("items"))
    return scoring.cells(all_runs, judged, key)


@query("scoring_cells", f"WITH {_CELLS_SQL} SELECT * FROM cells")
def scoring_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf)


@query("scoring_per_arm", f"""WITH {_CELLS_SQL} SELECT series, arm, stratum, dimension, CASE WHEN count(rate) = count(*) THEN round(avg(rate), 9) END AS macro,
    CASE WHEN sum(denominator) > 0 THEN round(sum(numerator)::DOUBLE / sum(denominator), 9) END AS micro FROM cells GROUP BY GROUPING SETS ((series, arm, dimension), (series, arm, stratum, dimension))""")
def scoring_per_arm(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.per_arm(_cells(spark, sf))


@query("scoring_paired_differences", f"""WITH {_CELLS_SQL}, p AS (SELECT * FROM (VALUES ('mid_off', 'mid', 'off'), ('on_mid', 'on', 'mid')) t(pair, later, earlier))
    SELECT a.series, a.document_id, a.dimension, pair, round(a.rate - b.rate, 9) AS difference FROM p JOIN cells a ON a.arm = later
    LEFT JOIN cells b ON b.arm = earlier AND a.series = b.series AND a.document_id = b.document_id AND a.dimension = b.dimension""")
def scoring_paired(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.paired_differences(_cells(spark, sf))


@query("scoring_dispositions", """WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'consistent' WHEN 'R' THEN 'contradictory' ELSE 'uncertain' END AS code FROM lineitem),
    r AS (SELECT *, row_number() OVER w AS nth, first(l_linenumber) OVER w AS head FROM f WINDOW w AS (PARTITION BY l_orderkey, code ORDER BY l_linenumber))
    SELECT l_orderkey, l_linenumber, CASE WHEN code = 'uncertain' THEN 'non_substantive' WHEN nth > 1 THEN 'exact_duplicate' ELSE 'judged' END AS disposition, CASE WHEN code <> 'uncertain' AND nth > 1 THEN head END AS original FROM r""")
def dispositions(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", "consistent").when(F.col("l_returnflag") == "R", "contradictory").otherwise("uncertain")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))
    return scoring.dispositions(rows, ["l_orderkey", "code"], "l_linenumber").drop("code")


@query("scoring_finding_status", """WITH c AS (SELECT ['correct', 'incorrect', 'unresolved'][l_linenumber % 3 + 1] AS a, ['supported', 'unsupported', 'unresolved', 'supported'][l_suppkey % 4 + 1] AS b, ['supported', 'not_applicable', 'unresolved'][l_partkey % 3 + 1] AS e, CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS errors FROM lineitem)
    SELECT CASE WHEN errors > 0 OR a = 'incorrect' OR b = 'unsupported' THEN 'incorrect' WHEN a = 'unresolved' OR b = 'unresolved' OR e = 'unresolved' THEN 'unresolved' ELSE 'correct' END AS status, count(*) AS n FROM c GROUP BY 1""")
def finding_status(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    line = table(spark, sf, "lineitem")
    status = scoring.finding_status(
        at(["correct", "incorrect", "unresolved"], F.col("l_linenumber") % 3), at(["supported", "unsupported", "unresolved", "supported"], F.col("l_suppkey") % 4), at(["supported", "not_applicable", "unresolved"], F.col("l_partkey") % 3), F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)
    )
    return line.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("scoring_reduce_attempts", """WITH a AS (SELECT user_id AS packet_id, event_id AS attempt, event_type AS reply, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 10 = 0 THEN 'stale' WHEN event_type = 'signup' OR user_id % 9 = 0 THEN 'invalid' ELSE 'good' END AS kind FROM events),
    v AS (SELECT *, row_number() OVER w AS nth, reply = first(reply) OVER w AS same FROM a WHERE kind = 'good' WINDOW w AS (PARTITION BY packet_id ORDER BY attempt)), g AS (SELECT packet_id, count(*) FILTER (WHERE nth > 1 AND same) AS superseded, count(*) FILTER (WHERE NOT same) AS conflicts FROM v GROUP BY 1),
    f AS (SELECT packet_id, count(*) FILTER (WHERE kind = 'failed') AS failed, count(*) FILTER (WHERE kind = 'stale') AS stale, count(*) FILTER (WHERE kind = 'invalid') AS invalid FROM a GROUP BY 1)
    SELECT packet_id, superseded IS NOT NULL AS answered, coalesce(superseded, 0) AS superseded, coalesce(conflicts, 0) AS conflicts, failed, stale, invalid, superseded IS NULL AND failed + stale + invalid > 0 AS blocking FROM f LEFT JOIN g USING (packet_id)""")
def reduce_attempts(spark: SparkSession, sf: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    return scoring.reduce_attempts(
        table(spark, sf, "events").select(
            user.alias("packet_id"), F.col("event_id").alias("attempt"), kind.alias("reply"), F.when(kind == "error", "crashed").otherwise("answered").alias("status"), (F.col("event_id") % 10 != 0).alias("current"), ((kind != "signup") & (user % 9 != 0)).alias("valid")
        )
    )


@query("scoring_agreement", """WITH v AS (SELECT doc_id, (length(text) > 200)::INT AS quality, (text LIKE '%!%')::INT AS toxic FROM documents), j AS (SELECT v.quality = l.quality AS q, v.toxic = l.toxic AS t FROM v JOIN labels l USING (doc_id))
    SELECT dimension, count(*) AS n, count(*) FILTER (WHERE same) AS agree, round(count(*) FILTER (WHERE same)::DOUBLE / count(*), 9) AS rate FROM (SELECT 'quality' AS dimension, q AS same FROM j UNION ALL SELECT 'toxic', t FROM j) GROUP BY 1""")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), (F.length("text") > 200).cast("int").alias("quality"), F.col("text").contains("!").cast("int").alias("toxic"))
    return scoring.agreement(verdicts, table(spark, sf, "labels").withColumnRenamed("doc_id", "case_id"), ["quality", "toxic"])


# ---------------------------------------------------------------- corpus

_ACTS = "acts AS (SELECT o_custkey AS act_id, min(o_orderdate) AS s, min(o_orderdate) + INTERVAL 365 DAY AS t FROM orders GROUP BY 1)"


@query("corpus_amendments_in_window", f"WITH {_ACTS} SELECT DISTINCT act_id, o_orderkey AS amendment_id FROM orders JOIN acts ON o_custkey = act_id WHERE o_orderdate > s AND o_orderdate <= t")
def amendments_in_window(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    acts = orders.groupBy(F.col("o_custkey").alias("act_id")).agg(F.min("o_orderdate").alias("status_date")).withColumn("target_date", F.col("status_date") + F.expr("interval 365 days"))
    return corpus.amendments_in_window(orders.select(F.col("o_custkey").alias("act_id"), F.col("o_orderkey").alias("amendment_id"), F.col("o_orderdate").alias("amended_on")), acts)


@query("corpus_amendment_drift", """WITH a AS (SELECT o_custkey AS act_id, o_orderkey AS amendment_id FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_custkey AS act_id, o_orderkey AS amendment_id FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT 'not_reported' AS rule, act_id::VARCHAR AS key, amendment_id::VARCHAR AS detail FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'not_recorded', act_id::VARCHAR, amendment_id::VARCHAR FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def amendment_drift(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "orders").select(F.col("o_custkey").alias("act_id"), F.col("o_orderkey").alias("amendment_id"))
    return corpus.drift(pairs.where("amendment_id % 7 <> 0"), pairs.where("amendment_id % 5 <> 0"))


@query("corpus_printings", f"""WITH {_LINES} SELECT doc_id AS act_id, line AS pos, piece AS article, CASE WHEN count(*) OVER (PARTITION BY doc_id, piece) > 1 THEN row_number() OVER (PARTITION BY doc_id, piece ORDER BY line) END AS printing FROM lines""")
def printings(spark: SparkSession, sf: str) -> DataFrame:
    lines = structure.pieces(table(spark, sf, "documents"), F.split("text", "(?<=\n)", -1)).where("piece <> ''")
    got = corpus.printings(lines.select(F.col("doc_id").alias("act_id"), (F.col("pos") + 1).cast("long").alias("pos"), F.col("piece").alias("article")))
    return got.withColumn("printing", F.col("printing").cast("long"))


@query("corpus_duplicate_ids", "SELECT 'duplicate_id' AS rule, sha256(text) AS key, count(*)::VARCHAR AS detail FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_ids(table(spark, sf, "documents").select(F.sha2("text", 256).alias("id")), "id")


_DELTA = """a AS (SELECT doc_id AS unit_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id + 10 AS unit_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'x' END AS h FROM documents),
    d AS (SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, CASE WHEN a.h IS NULL THEN 'purge' WHEN a.h = b.h THEN 'skip' ELSE 'embed' END AS action FROM a FULL JOIN b ON a.unit_id = b.unit_id)"""


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.sha2("text", 256).alias("content_hash"))
    stored = docs.select((F.col("unit_id") + 10).alias("unit_id"), F.when(F.col("unit_id") % 2 == 0, F.col("content_hash")).otherwise("x").alias("content_hash"))
    return corpus.delta_plan(docs, stored)


@query("corpus_delta_plan", f"WITH {_DELTA} SELECT unit_id, action FROM d")
def delta_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf)


@query("corpus_build_report", f"""WITH {_DELTA} SELECT unit_id % 10 AS act, count(*) FILTER (WHERE action <> 'purge') AS total, count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE action = 'embed') AS embedded,
    count(*) FILTER (WHERE action = 'purge') AS purged FROM d GROUP BY ROLLUP (unit_id % 10)""")
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.build_report(_delta(spark, sf).withColumn("act", F.col("unit_id") % 10))


@query("corpus_unit_digest", _in_parts("act", "SELECT source AS act, doc_id || ' ' || sha256(text) AS line FROM documents", "digest"))
def unit_digest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unit_digest(table(spark, sf, "documents").select(F.col("source").alias("act"), F.col("doc_id").cast("string").alias("locator"), F.sha2("text", 256).alias("content_hash")))


@query("corpus_pages_to_text", r"""WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(?:script|style)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS x FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text,
    regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM t""")
def pages_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pages_to_text(table(spark, sf, "pages"))


@query("corpus_locator_catalogue", r"""SELECT nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/([0-9]+)/?$', 1), '') AS act, count(*) AS n_rows,
    count(*) FILTER (WHERE NOT regexp_matches(url, '^https?://([^/]+)/([a-z]{2})/([0-9]+)/?$')) AS n_malformed FROM pages GROUP BY 1""")
def locator_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.locator_catalogue(table(spark, sf, "pages"), "url", "https?://([^/]+)/([a-z]{2})/([0-9]+)/?")


@query("corpus_act_force", "SELECT CASE o_orderstatus WHEN 'F' THEN 'in_force' WHEN 'O' THEN 'not_in_force' ELSE 'undetermined' END AS force, o_orderstatus = 'F' AS admitted, count(*) AS acts FROM orders GROUP BY 1, 2")
def act_force(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "IN_FORCE").when(F.col("o_orderstatus") == "O", "NOT_IN_FORCE").otherwise("UNKNOWN")
    return corpus.act_force(table(spark, sf, "orders").select(status.alias("in_force"))).groupBy("force", "admitted").agg(F.count(F.lit(1)).alias("acts"))


# ---------------------------------------------------------------- data quality


@query("quality_prohibited", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\d+') AS runs, regexp_replace(text, '(\d+)', chr(1) || '\1' || chr(2), 'g') AS g FROM documents),
    p AS (SELECT doc_id, unnest([{'label': 'email', 'hits': len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'))}, {'label': 'url', 'hits': len(regexp_extract_all(text, '(?i)https?://|www\.'))},
    {'label': 'digits_11', 'hits': len(list_filter(runs, lambda x: length(x) = 11))}, {'label': 'digits_10', 'hits': len(list_filter(runs, lambda x: length(x) = 10))},
    {'label': 'phone', 'hits': len(regexp_extract_all(g, '\+\x0148(?:\x02[\s-]\x01)?(?:\d(?:\x02[\s-]\x01)?){8}\d\x02|\x01(?:\d(?:\x02[\s-]\x01)?){8}\d\x02'))},
    {'label': 'article', 'hits': len(regexp_extract_all(text, '(?i)\bart\.?\s*\d+'))}, {'label': 'act_name', 'hits': len(regexp_extract_all(text, '(?i)\b(?:kodeks(?:u|ie)?|ustaw(?:a|y|ie|ę)|rozporządzen(?:ie|ia))\b'))}]) AS x FROM t)
    SELECT doc_id, x.label AS label, x.hits AS hits FROM p WHERE x.hits > 0""")
def prohibited(spark: SparkSession, sf: str) -> DataFrame:
    return quality.prohibited(table(spark, sf, "documents")).withColumn("hits", F.col("hits").cast("long"))


@query("quality_text_rules", r"SELECT doc_id, sha256(text) AS content_hash, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS n_words, strlen(text) AS n_bytes, length(text) = n_chars AS length_ok FROM documents")
def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    got = quality.text_rules(table(spark, sf, "documents"))
    return got.withColumn("n_words", F.col("n_words").cast("long")).withColumn("n_bytes", F.col("n_bytes").cast("long"))


@query("quality_corrupt_text", r"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')) AS n, length(text) - length(replace(text, chr(65533), '')) AS lost FROM documents)
    SELECT CASE WHEN n > 0 THEN 'control_characters' ELSE 'replacement_characters' END AS rule, doc_id::VARCHAR AS key, n::VARCHAR AS detail FROM c WHERE n > 0 OR lost > 0.1 * length(text)""")
def corrupt_text(spark: SparkSession, sf: str) -> DataFrame:
    return quality.reject_corrupt_text(table(spark, sf, "documents"))


@query("quality_dataset_summary", "SELECT source AS stratum, count(*) AS documents, min(length(text)) AS shortest, max(length(text)) AS longest, sum(length(text))::BIGINT AS characters FROM documents GROUP BY source")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    got = quality.dataset_summary(table(spark, sf, "documents"))
    return got.withColumn("shortest", F.col("shortest").cast("long")).withColumn("longest", F.col("longest").cast("long"))


@query("quality_measured_drift", "SELECT doc_id, 'n_chars' AS field, n_chars::VARCHAR AS recorded, (length(text) + doc_id % 2)::VARCHAR AS measured FROM documents WHERE n_chars <> length(text) + doc_id % 2")
def measured_drift(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.measured_drift(docs.select("doc_id", "n_chars"), docs.select("doc_id", (F.length("text") + F.col("doc_id") % 2).alias("n_chars")), "doc_id", ["n_chars"])


# ---------------------------------------------------------------- streams (batch forms)


@query("stream_latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return streams.latest_status(table(spark, sf, "events"))


@query("stream_kind_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return streams.kind_counts(table(spark, sf, "events"))


@query("stream_last_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def last_n(spark: SparkSession, sf: str) -> DataFrame:
    return streams.last_n(table(spark, sf, "events"), 20).select("user_id", "event_id")


@query("stream_expired", "SELECT user_id, max(ts) AS written_at, max(ts) + INTERVAL 3600 SECOND <= TIMESTAMP '2024-01-30 12:00:00' AS expired FROM events GROUP BY user_id")
def expired(spark: SparkSession, sf: str) -> DataFrame:
    return streams.expired(table(spark, sf, "events"), 3600, "2024-01-30 12:00:00")


@query("stream_stalled", """WITH f AS (SELECT user_id, min(ts) AS first_at FROM events GROUP BY 1) SELECT user_id, first_at FROM f WHERE first_at + INTERVAL 86400 SECOND <= TIMESTAMP '2024-01-30 12:00:00'
    AND user_id NOT IN (SELECT e.user_id FROM events e JOIN f USING (user_id) WHERE event_type = 'purchase' AND ts <= first_at + INTERVAL 86400 SECOND)""")
def stalled(spark: SparkSession, sf: str) -> DataFrame:
    return streams.stalled(table(spark, sf, "events"), 86400, "purchase", "2024-01-30 12:00:00")


@query("stream_valid_events", "SELECT CASE WHEN ts IS NULL OR user_id IS NULL THEN 'missing_field' WHEN NOT regexp_matches(event_type, '^[a-z][a-z0-9_]*$') THEN 'bad_name' WHEN value < 0 THEN 'negative_value' END AS violation, count(*) AS n FROM events GROUP BY 1")
def valid_events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.valid_events(table(spark, sf, "events")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("stream_dedupe", "SELECT user_id, event_type, count(DISTINCT value) AS n FROM events GROUP BY 1, 2")
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return streams.dedupe(table(spark, sf, "events")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
