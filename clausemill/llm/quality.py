"""A quality score of several rules, whose cutoff comes from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import boxed, materialise, small, texts

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_top_word")
#: Rule: value of a document from its counts; larger is worse.
RULES: dict[str, str] = {
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "capitals": "n_upper / n_letters",
    "marks": "n_marks / n_words",
    "long_words": "word_chars / n_words / 20",
    "top_word": "n_top_word / n_words",
}
#: What each value is measured in; fixed before any label is seen. The score of a document is its largest measure.
SCALES: dict[str, float] = {"symbols": 0.1, "dup_lines": 0.3, "repeats": 0.2, "capitals": 0.3, "marks": 0.1, "long_words": 0.5, "top_word": 0.2}
#: Cutoffs of the score tried, from the most lenient on; fixed before any label is seen.
CUTOFFS = tuple(round(8 * 0.9**i, 4) for i in range(48))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    v = len(ids)
    if v < 2_000_000:
        _, inverse, n = np.unique((x[:-2] * v + x[1:-1]) * v + x[2:], return_inverse=True, return_counts=True)
    else:
        _, inverse, n = np.unique(np.stack([x[:-2], x[1:-1], x[2:]]), axis=1, return_inverse=True, return_counts=True)
    twice = (n > 1)[inverse.ravel()]
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def count_text(text: bytes) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = text.split()
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    n_lines = sum(lines.values())
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    lower = text.lower()
    letters = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    top = Counter(lower.split()).most_common(1)
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - spaces,
        len(text) - len(text.translate(None, SYMBOLS)),
        n_lines - len(lines),
        repeat_words(words),
        n_lines,
        upper,
        letters,
        text.count(b"!"),
        top[0][1] if top else 0,
    )


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, stratum (lang, null as empty) and the COUNTS of each row of docs; the row itself in place of doc_id if whole."""
    head = F.struct(*docs.columns).alias("row") if whole else F.col("doc_id")
    rows = docs.select(head, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), *([] if whole else ["text"]))
    name = "row" if whole else "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            bare = pa.RecordBatch.from_arrays([pc.struct_field(batch.column("row"), "text")], ["text"]) if whole else batch
            got = np.array([count_text(x) for x in texts(bare)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(name), batch.column("stratum"), *map(pa.array, got.T)], [name, "stratum", *COUNTS])

    head_type = rows.schema[name].dataType.simpleString()
    return rows.mapInArrow(run, f"{name} {head_type}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def value(rule: str) -> Column:
    return F.coalesce(F.try_divide(*_sides(RULES[rule])), F.lit(0.0))


def score() -> Column:
    return F.greatest(*[value(r) / F.lit(scale) for r, scale in SCALES.items()])


def _sides(ratio: str) -> tuple[Column, Column]:
    top, _, rest = ratio.partition(" / ")
    low, _, scale = rest.partition(" / ")
    return F.col(top).cast("double"), F.col(low) * (float(scale) if scale else 1.0)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), by its terms."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0  # never small enough to matter
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(min(0.0, log + math.log(total))))


def calibrate(counted: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """stratum, cutoff, n_good, good_rejected, bad_rejected: score cutoffs that, with confidence 1 - error for all
    strata at once, reject at most `risk` of the good documents of their stratum.

    All labelled documents that pass the base rules are the holdout. The rules act through one score, so a stratum has
    one sequence of cutoffs and the whole risk. A cutoff passes if the exact binomial probability of as few rejected
    good documents, were its false rejection rate the allowed one, is at most error / strata: cutoffs are tested from
    lenient to strict and the tail grows with strictness, so the sequence needs no further correction. Of the cutoffs
    that pass, the one that rejects most bad documents is chosen, the most lenient if several do; a stratum where none
    rejects any is left out. At the default risk and four strata a stratum needs 217 good labelled documents, without
    which nothing can be certified. Counts are summed by bucket of the score; no documents are gathered.
    """
    held = counted.where(~base_failed()).join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    # bucket b: the score passes the first b cutoffs, so cutoff number b and all stricter ones reject it
    held = held.withColumn("score", score()).withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: F.col("score") <= c)))
    got = held.groupBy("stratum", "bucket").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    upto = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    tests = got.select(
        "stratum", "bucket", F.sum("good").over(upto).alias("k"), F.sum("bad").over(upto).alias("bad"), F.sum("good").over(Window.partitionBy("stratum")).alias("n")
    ).where(F.col("bucket") < len(CUTOFFS))

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), risk) if b else 1.0 for a, b in zip(k, n)], dtype=float)

    strata = got.select(F.count_distinct("stratum").alias("strata"))
    tested = tests.crossJoin(F.broadcast(strata)).where(tail("k", "n") <= F.lit(error) / F.col("strata")).where("bad > 0")
    best = tested.groupBy("stratum").agg(F.max(F.struct("bad", (-F.col("bucket")).alias("lenient"), "k", "n")).alias("b"))
    cutoff = F.element_at(F.array(*map(F.lit, CUTOFFS)), (1 - F.col("b.lenient")).cast("int"))
    return best.select("stratum", cutoff.alias("cutoff"), F.col("b.n").alias("n_good"), F.col("b.k").alias("good_rejected"), F.col("b.bad").alias("bad_rejected"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, the COUNTS, base_failed, kept.

    kept is false if the base rules fail (under 50 words, or over half of the words in repeated 3-word windows), else
    whether the score is at most the cutoff chosen for the document's stratum (lang; null is a stratum). Null and
    empty texts have zero counts and fail. Repeated doc_ids are judged each; several labels for one document count
    each. Without labels only the base rules reject.
    """
    counted = materialise(features(docs))
    cut = calibrate(counted, labels, risk, error).select("stratum", "cutoff")
    return counted.join(cut, "stratum", "left").select("doc_id", *COUNTS, base_failed().alias("base_failed"), kept().alias("kept"))


def kept() -> Column:
    return ~base_failed() & ~F.coalesce(score() > F.col("cutoff"), F.lit(False))


@boxed
def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """docs without the rows that are rejected; all columns stay.

    Every row is judged by itself, as judge does, and carried through: ids may be null or repeated. The cutoffs are
    found in a pass of its own, so that counts meet labels and no text is shuffled.
    """
    cut = materialise(calibrate(materialise(features(docs)), labels, risk, error).select("stratum", "cutoff"))
    return features(docs, whole=True).join(F.broadcast(cut), "stratum", "left").where(kept()).select("row.*")
