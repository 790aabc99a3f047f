"""Data-quality rules on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label and pattern of what must not occur in a text. Fixed values.
PROHIBITED = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "digits_11": r"(?<!\d)\d{11}(?!\d)",
    "digits_10": r"(?<!\d)\d{10}(?!\d)",
    "phone": r"(?<!\d)(?:\+48[\s-]?)?(?:\d[\s-]?){9}(?!\d)",
    "url": r"(?i)https?://|www\.",
    "article": r"(?iU)\bart\.?\s*\d+",
    "act_name": r"(?iU)\b(?:kodeks(?:u|ie)?|ustaw(?:a|y|ie|ę)|rozporządzen(?:ie|ia))\b",
}
#: One of these is in every text that a pattern can match, so that most texts are read once.
_HINT = r"(?iu)@|\d{2}|\d[\s-]\d|https?://|www\.|art|kodeks|ustaw|rozporz"


def prohibited(documents: DataFrame) -> DataFrame:
    """doc_id, label, hits of each pattern that occurs."""
    found = F.array(*[F.struct(F.lit(k).alias("label"), F.regexp_count("text", F.lit(p)).alias("hits")) for k, p in PROHIBITED.items()])
    return documents.where(F.col("text").rlike(_HINT)).select("doc_id", F.inline(found)).where("hits > 0")


def text_rules(documents: DataFrame) -> DataFrame:
    """doc_id, content_hash, n_words, n_bytes, length_ok: counts of a text against the recorded n_chars."""
    return documents.select(
        "doc_id",
        F.sha2("text", 256).alias("content_hash"),
        F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+")).alias("n_words"),
        F.octet_length("text").alias("n_bytes"),
        (F.length("text") == F.col("n_chars")).alias("length_ok"),
    )


def reject_corrupt_text(documents: DataFrame, share: float = 0.1) -> DataFrame:
    """rule, key, detail: control characters other than tab, LF and CR, or too many replacement characters."""
    control = F.regexp_count("text", F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))
    lost = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    rule = F.when(control > 0, "control_characters").when(lost > share * F.length("text"), "replacement_characters")
    return documents.select(rule.alias("rule"), F.col("doc_id").cast("string").alias("key"), control.cast("string").alias("detail")).where("rule is not null")


def dataset_summary(documents: DataFrame) -> DataFrame:
    """stratum, documents, shortest, longest, characters."""
    n = F.length("text")
    return documents.groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("documents"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("characters"))


def measured_drift(recorded: DataFrame, measured: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, recorded, measured where they differ, field by field; nulls are values."""
    rows = lambda df, name: df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])))
    return rows(recorded, "recorded").join(rows(measured, "measured"), [key, "field"], "full_outer").where(~F.col("recorded").eqNullSafe(F.col("measured")))


def entry_rules(entries: DataFrame, strata: list[str], languages: list[str]) -> DataFrame:
    """rule, key: ids given twice, strata and languages that are not allowed, and sizes not measured; nulls break a rule."""
    rules = F.array(
        F.when(~F.coalesce(F.col("stratum").isin(strata), F.lit(False)), "stratum_unknown"),
        F.when(~F.coalesce(F.col("lang").isin(languages), F.lit(False)), "language_unknown"),
        F.when(F.col("n_chars").isNull(), "not_measured"),
    )
    key = F.col("doc_id").cast("string")
    broken = entries.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"), key.alias("key"))
    twice = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), key.alias("key"))
    return broken.unionByName(twice)


def provenance_rules(entries: DataFrame, acquired: DataFrame) -> DataFrame:
    """rule, key: entries without an acquisition record, or whose stored hash or size differs from it; nulls are values."""
    got = acquired.select("doc_id", F.col("content_hash").alias("h"), F.col("n_bytes").alias("b"), F.lit(True).alias("held"))
    joined = entries.join(got, "doc_id", "left")
    rule = F.when(F.col("held").isNull(), "no_record").when(~F.col("content_hash").eqNullSafe(F.col("h")), "hash_differs").when(~F.col("n_bytes").eqNullSafe(F.col("b")), "size_differs")
    return joined.select(rule.alias("rule"), F.col("doc_id").cast("string").alias("key")).where("rule is not null")


def path_diff(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """rule, path: paths listed and not stored, and stored and not listed."""
    a, b = listed.select("path").distinct(), stored.select("path").distinct()
    return a.join(b, "path", "left_anti").select(F.lit("not_stored").alias("rule"), "path").unionByName(b.join(a, "path", "left_anti").select(F.lit("not_listed").alias("rule"), "path"))


def split_rules(artifacts: DataFrame, frozen: DataFrame) -> DataFrame:
    """rule, case_id: cases outside the frozen set or absent, and cases without exactly one canonical artifact."""
    n = artifacts.groupBy("case_id").agg(F.count_if("canonical").alias("n"))
    joined = n.join(frozen.select("case_id").distinct().withColumn("f", F.lit(1)), "case_id", "full_outer")
    rules = F.array(F.when(F.col("f").isNull(), "not_frozen"), F.when(F.col("n").isNull(), "case_missing"), F.when(F.col("n") != 1, "canonical_count"))
    return joined.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"), "case_id")
