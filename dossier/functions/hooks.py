"""Places for a caller's models: vectors for texts, and answers for rows. The library calls them; it holds none.

A hook is set up once a Python worker (``setup`` loads the model and gives back a function) and then gets Arrow batches, so a model is
neither sent with each batch nor called row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOGETHER = 256  # rows that a model sees at a time

Embedder = Callable[[list[str]], np.ndarray]
Answerer = Callable[[pd.DataFrame], pd.DataFrame]


def embed(setup: Callable[[], Embedder]) -> Callable[[Column | str], Column]:
    """A function of a text column that gives a vector column; null texts have null vectors.

    ``setup`` gives a function from some texts to as many rows of numbers.
    """

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = setup()
        for texts in batches:
            out = np.empty(len(texts), dtype=object)
            there = np.flatnonzero(texts.notna().to_numpy())
            for at in range(0, len(there), TOGETHER):
                rows = there[at : at + TOGETHER]
                got = np.asarray(model(texts.iloc[rows].tolist()), dtype=float)
                if len(got) != len(rows):
                    raise ValueError(f"{len(rows)} texts have {len(got)} vectors")
                for i, vector in zip(rows, got, strict=True):
                    out[i] = vector
            yield pd.Series(out, index=texts.index)

    vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    hooked = F.pandas_udf(vectors, T.ArrayType(T.DoubleType()))
    return lambda text: hooked(F.col(text) if isinstance(text, str) else text)


def answer(rows: DataFrame, setup: Callable[[], Answerer], schema: str) -> DataFrame:
    """What a model answers to ``rows``, some at a time: as many rows as it likes, of ``schema``."""

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = setup()
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                yield model(batch.iloc[at : at + TOGETHER])

    return rows.mapInPandas(answers, schema)
