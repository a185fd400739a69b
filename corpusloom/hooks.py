"""Where models are plugged in: embedder, annotator and tokenizer, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import tokens

Embedder = Callable[[list[str]], np.ndarray]
Annotator = Callable[[pd.Series], pd.Series]
BATCH = 32


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Signed counts of hashed words: for tests, and where no model is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = crc32(word.encode())
                out[i, h % dimensions] += 1 if h >> 31 else -1
        return out

    return embed


def with_embeddings(chunks: DataFrame, embed: Embedder, text_col: str = "content", batch: int = BATCH) -> DataFrame:
    """``chunks`` with ``embedding``; the embedder gets at most ``batch`` texts at once. A null text has a null embedding."""

    @F.pandas_udf("array<float>")
    def embedded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out: list = [None] * len(series)
            there = [i for i, t in enumerate(series) if t is not None]
            for at in range(0, len(there), batch):
                part = there[at : at + batch]
                for i, v in zip(part, embed([series.iloc[i] for i in part]), strict=True):
                    out[i] = np.asarray(v, np.float32)
            yield pd.Series(out)

    embedded.func.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return chunks.withColumn("embedding", embedded(F.col(text_col)))


def annotate(text: Column, annotator: Annotator) -> Column:
    @F.pandas_udf("string")
    def annotated(texts: pd.Series) -> pd.Series:
        return annotator(texts)

    return annotated(text)


def word_tokenizer(text: Column) -> Column:
    return tokens(text)
