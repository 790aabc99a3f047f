"""References between units, the context that they give a unit, and the calls of each arm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.operators import structure

_FLAGS = "(?iuU)"
#: Kind, pattern and whether group 1 is a target, in the order in which they claim text. Fixed values.
PATTERNS = (
    ("external_act", r"\bart\.\s*\d+[^.;\n]{0,120}?(?:kodeks(?:u)?|ustaw(?:y|ie)?)\b", False),
    ("full_internal", r"(?:\b(?:zgodnie\s+z|mowa\s+w|o\s+którym\s+mowa\s+w)\s+)?(?:(?:§|par\.)\s*(\d+))(?:\s+ust\.\s*\d+)?", True),
    ("full_internal", r"\bpkt\.?\s*(\d+(?:\.\d+)+)\b", True),
    ("relative_internal", r"\bust\.\s*\d+\b", False),
    ("directional", r"\b(?:jak\s+wskazano\s+)?(?:powyżej|poniżej|wyżej|niżej)\b", False),
    ("annex", r"\bzałącznik\s+nr\s*\d+\b", False),
    ("whole_document", r"\bniniejsz\w*\s+umow\w*\b", False),
)
OPENING = r"^\s*(?:(?:§|par\.|[S5$8])\s*\d+|Art\.\s*\d+|\d+(?:\.\d+)*\.?(?=\s)|ust\.\s*\d+|pkt\.\s*\d+|lit\.\s*\w+)"
PARAGRAPH_LEAD = r"(?iuUmd)^\s*(?:§|par\.)\s*(\d+)"
OUTLINE_LEAD = r"(?Umd)^\s*(\d+(?:\.\d+)*)\.?(?=\s)"
RELATIVE_LEAD = r"(?:§|par\.)\s*\d+\s*$"
#: Kinds whose status needs no target. Fixed values.
STATIC = {"external_act": "external_act", "directional": "ambiguous_directional", "annex": "outside_input", "whole_document": "whole_document", "relative_internal": "within_unit"}


def unit_texts(documents: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, pos, text of each unit, cut from its document by its span."""
    text = F.expr("substring(text, start_offset + 1, end_offset - start_offset)")
    return units.select("doc_id", "pos", "start_offset", "end_offset").join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "pos", text.alias("text"))


def _path(number: Column) -> Column:
    """A dotted number without leading zeros."""
    return F.regexp_replace(number, r"(^|\.)0+(?=\d)", "$1")


_MATCHES = "array<struct<rank: int, kind: string, gap: int, raw: string, target: string, led: boolean>>"


def _match(rank: int, kind: str, target: bool) -> Callable[[Column], Column]:
    """What is kept of a match and of the gap before it."""
    return lambda z: F.struct(
        F.lit(rank).alias("rank"),
        F.lit(kind).alias("kind"),
        F.length(z["gap"]).alias("gap"),
        z["raw"].alias("raw"),
        (z["target"] if target else F.lit(None).cast("string")).alias("target"),
        (z["gap"].rlike(_FLAGS + RELATIVE_LEAD) if kind == "relative_internal" else F.lit(False)).alias("led"),
    )


def find(units: DataFrame) -> DataFrame:
    """doc_id, pos, n, kind, raw, start, end, target of the references in units(doc_id, pos, text); n is their order.

    A pattern's matches and the gaps between them give its spans. A unit's own opening marker is left out before spans
    are claimed. A match that overlaps one claimed by an earlier pattern goes: claimed spans are disjoint, so it is
    enough to look at the last of them that starts before the match ends. A unit's texts may be null or empty.
    """
    found = []
    for rank, (kind, pattern, target) in enumerate(PATTERNS):
        p = F.lit(_FLAGS + pattern)
        zipped = F.arrays_zip(
            F.split("text", _FLAGS + pattern, -1).alias("gap"), F.regexp_extract_all("text", p, F.lit(0)).alias("raw"), F.regexp_extract_all("text", p, F.lit(int(target))).alias("target")
        )
        got = F.transform(F.filter(zipped, lambda z: z["raw"].isNotNull()), _match(rank, kind, target))
        found.append(F.when(F.col("text").rlike(_FLAGS + pattern), got).otherwise(F.array().cast(_MATCHES)))  # most units hold few kinds: one search instead of three
    rows = units.select("doc_id", "pos", F.length(F.regexp_extract("text", _FLAGS + OPENING, 0)).alias("opening"), F.posexplode(F.concat(*found)).alias("i", "m")).select("doc_id", "pos", "opening", "i", "m.*")
    upto = Window.partitionBy("doc_id", "pos", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("raw")).over(upto)).withColumn("start", F.col("end") - F.length("raw"))
    rows = rows.where(~((F.col("start") == 0) & (F.col("end") <= F.col("opening")))).withColumn("kept", F.col("rank") == 0)
    for rank in range(1, len(PATTERNS)):
        mine = F.col("rank") == rank
        place = F.when(F.col("kept"), F.col("start")).when(mine, F.col("end"))
        before = Window.partitionBy("doc_id", "pos").orderBy(place, "kept").rowsBetween(Window.unboundedPreceding, 0)
        claimed = F.last(F.when(F.col("kept"), F.col("end")), ignorenulls=True).over(before)
        rows = rows.withColumn("kept", F.col("kept") | (mine & (F.coalesce(claimed, F.lit(0)) <= F.col("start"))))
    n = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy("i"))
    return rows.where("kept and not led").select("doc_id", "pos", n.alias("n"), "kind", "raw", "start", "end", _path(F.col("target")).alias("target"))


def identities(units: DataFrame) -> DataFrame:
    """doc_id, scheme, target, target_pos: the number that leads a unit's first numbered line, paragraphs before
    outlines; of units with one number the first is the target."""
    paragraph, outline = F.regexp_extract("text", PARAGRAPH_LEAD, 1), F.regexp_extract("text", OUTLINE_LEAD, 1)
    scheme = F.when(paragraph != "", "paragraph").when(outline != "", "outline")
    rows = units.select("doc_id", "pos", scheme.alias("scheme"), _path(F.when(paragraph != "", paragraph).otherwise(outline)).alias("target")).where("scheme is not null")
    return rows.groupBy("doc_id", "scheme", "target").agg(F.min("pos").alias("target_pos"))


def resolve(found: DataFrame, units: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, pos, n, kind, raw, status, target_pos; documents whose units overlap never resolve."""
    scheme = F.when(F.col("target").contains("."), "outline").when(F.col("target").isNotNull(), "paragraph")
    joined = found.withColumn("scheme", scheme).join(identities(units), ["doc_id", "scheme", "target"], "left").join(structure.is_fallback(spans), "doc_id", "left")
    static = F.element_at(F.create_map(*[F.lit(x) for kv in STATIC.items() for x in kv]), F.col("kind"))
    hit = F.col("target_pos").isNotNull() & ~F.coalesce("fallback", F.lit(False))
    status = F.coalesce(static, F.when(hit, F.lit("resolved")).otherwise("target_does_not_exist"))
    return joined.select("doc_id", "pos", "n", "kind", "raw", status.alias("status"), F.when(status == "resolved", F.col("target_pos")).alias("target_pos"))


def references(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, pos, n, kind, raw, status, target_pos of the references in the units of documents."""
    units = unit_texts(documents, spans)
    return resolve(find(units), units, spans)


def context_edges(resolved: DataFrame) -> DataFrame:
    """doc_id, pos, target_pos, n: each unit that a unit refers to, once, at its first reference; never itself."""
    rows = resolved.where("status = 'resolved' and target_pos <> pos")
    return rows.groupBy("doc_id", "pos", "target_pos").agg(F.min("n").alias("n"))


def call_units(documents: DataFrame, spans: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, arm, unit_id, context: off calls a whole document, mid each unit, on each unit with its context in order."""
    off = documents.select("doc_id", F.lit("off").alias("arm"), F.concat(F.lit("whole:"), F.sha2("text", 256)).alias("unit_id"), F.array().cast("array<string>").alias("context"))
    each = spans.select("doc_id", "pos")
    mid = each.select("doc_id", F.lit("mid").alias("arm"), F.col("pos").cast("string").alias("unit_id"), F.array().cast("array<string>").alias("context"))
    ordered = edges.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("n", F.col("target_pos").cast("string").alias("id")))).alias("c"))
    on = each.join(ordered, ["doc_id", "pos"], "left").select("doc_id", F.lit("on").alias("arm"), F.col("pos").cast("string").alias("unit_id"), F.coalesce(F.col("c.id"), F.array().cast("array<string>")).alias("context"))
    return off.unionByName(mid).unionByName(on)


def call_payloads(units: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, pos, text, context: the texts of a unit and of the units that it refers to, in order."""
    target = units.select("doc_id", F.col("pos").alias("target_pos"), F.col("text").alias("target_text"))
    got = edges.join(target, ["doc_id", "target_pos"]).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("n", "target_text"))).alias("c"))
    return units.join(got, ["doc_id", "pos"], "left").select("doc_id", "pos", "text", F.coalesce(F.col("c.target_text"), F.array().cast("array<string>")).alias("context"))


def context_ids(edges: DataFrame) -> DataFrame:
    """doc_id, context_pos, first_pos, n_edges: distinct context units with where each is first asked for."""
    return edges.groupBy("doc_id", F.col("target_pos").alias("context_pos")).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_edges"))
