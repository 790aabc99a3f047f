"""Encoders and tokenizers given by the caller, run in batches of texts on the tasks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_vectors(df: DataFrame, encode: Callable[[Sequence[str]], Sequence[Sequence[float]]], text: str = "text", name: str = "embedding") -> DataFrame:
    """df with the vector of each text; a null text counts as empty. The number of vectors must be that of texts."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        got = list(encode(texts.fillna("").tolist()))
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return pd.Series([[float(x) for x in v] for v in got])

    return df.withColumn(name, run(F.col(text)))


def with_token_count(df: DataFrame, count: Callable[[str], int], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each text; a null text has none."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else count(t))

    return df.withColumn(name, run(F.col(text)))


def with_exact_fold(df: DataFrame, text: str = "text", name: str = "folded") -> DataFrame:
    """df with its text case-folded, ł as l and without combining marks, for any script."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.casefold().replace("ł", "l")) if not unicodedata.combining(c))
        return texts.map(lambda t: None if t is None else plain(t))

    return df.withColumn(name, run(F.col(text)))
