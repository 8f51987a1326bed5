"""Where models of vectors and of text scores plug in. None comes with the package; a stand-in takes its place."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")


def orthogonal(a: Column, b: Column) -> Column:
    """Cosine under an encoder that gives each distinct text an axis of its own; null with a null text."""
    return (a == b).cast("double")


def pick(asked: str, makers: dict[str, Callable[[], T]], real: str, fallback: str) -> T:
    """What the asked maker gives. "auto" tries the real one and falls back with a warning if its parts are missing; one
    asked for by name, missing or unknown, is an error."""
    if asked != "auto":
        if asked not in makers:
            raise ValueError(f"unknown: {asked}; known: {', '.join(sorted(makers))}")
        return makers[asked]()
    try:
        return makers[real]()
    except (KeyError, ImportError, OSError) as e:
        warnings.warn(f"{real} is not available ({e}); {fallback} takes its place", stacklevel=2)
        return makers[fallback]()


def vectors(model: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A Column function of texts to vectors; the model is made once in each worker and sees Arrow batches of texts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()), index=batch.index, dtype=object)

    return run


def scores(model: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A Column function of two texts to a model's score; equal texts score 1 and don't reach the model."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = model()
        for a, b in batches:
            a, b = a.fillna(""), b.fillna("")
            out = pd.Series(1.0, index=a.index)
            if (other := a != b).any():
                out[other] = score(a[other].tolist(), b[other].tolist())
            yield out

    return run
