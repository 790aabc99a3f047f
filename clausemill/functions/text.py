"""Column expressions on text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the plain letters they decompose to; ł and đ have no decomposition.
_FOLDS = {chr(c): d[0] for c in range(0xE0, 0x180) if (d := unicodedata.normalize("NFKD", chr(c)))[0] in "abcdefghijklmnopqrstuvwxyz" and len(d) > 1 and unicodedata.combining(d[1])} | {"ł": "l"}
_MARKED, _PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics, ß as ss."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _MARKED, _PLAIN)


def terms(text: Column) -> Column:
    """Terms of a text in order: runs of 0-9 and a-z after folding."""
    return F.regexp_extract_all(fold(text), F.lit("[0-9a-z]+"), F.lit(0))


def term_id(term: Column) -> Column:
    """The first four bytes of the term's SHA-256 as an unsigned integer."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.regexp_count(text, F.lit("\\S+"))
