"""Registries of outside models: embedders and pair scorers, loaded once in a Python worker, and a cache of query vectors.

A scorer gives the logit of a (query, text) pair. It is a builder of a Column, or a Python function over lists that
runs in Arrow batches; where such a function fails, its logits are null and the rerank leaves the list as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

CACHED = 128

_embedders: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]] = {}
_scorers: dict[str, Callable[[str, Column], Column]] = {}


def register_embedder(name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> None:
    """``load`` gives a function from texts to vectors; it runs once a worker, and once on the driver for queries."""
    _embedders[name] = load
    query_vector.cache_clear()


def embed(name: str, text: Column) -> Column:
    """The vectors of a text column by a registered model, with the prefix that its family asks for."""
    load = _embedders[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model([t or "" for t in texts])), index=texts.index)

    return run(X.model_input(name, text, False))


@lru_cache(CACHED)
def _loaded(name: str):
    return _embedders[name]()


@lru_cache(CACHED)
def query_vector(name: str, query: str) -> tuple[float, ...]:
    """The vector of one query, on the driver; the last CACHED ones are kept."""
    prefixed = {"nomic-embed-text": "search_query: ", "e5": "query: "}
    lead = next((p for family, p in prefixed.items() if family in name.lower()), "")
    return tuple(float(x) for x in _loaded(name)([lead + query.strip()])[0])


def register_scorer(name: str, build: Callable[[str, Column], Column]) -> None:
    """``build`` (query, text column) -> logit column; the query is a string, or a column where lists have queries of their own."""
    _scorers[name] = build


def register_pair_scorer(name: str, load: Callable[[], Callable[[str, list[str]], list[float]]]) -> None:
    """A scorer in Python; a batch for which it fails, or gives another number of scores, has null logits."""

    def build(query: str | Column, text: Column) -> Column:
        if isinstance(query, Column):
            return pairs(query, text)

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            try:
                model = load()
            except Exception:
                model = None
            for texts in batches:
                try:
                    scores = [float(x) for x in model(query, [t or "" for t in texts])]
                except Exception:
                    scores = []
                yield pd.Series(scores if len(scores) == len(texts) else [None] * len(texts), index=texts.index, dtype="float64")

        return run(text)

    @F.pandas_udf("double")
    def pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            model = None
        for queries, texts in batches:
            out = pd.Series(None, index=texts.index, dtype="float64")
            for query, some in texts.fillna("").groupby(queries.fillna("")):
                try:
                    scores = [float(x) for x in model(query, list(some))]
                except Exception:
                    continue
                if len(scores) == len(some):
                    out[some.index] = scores
            yield out

    register_scorer(name, build)


def logit(name: str, query: str | Column, text: Column) -> Column:
    return _scorers[name](query, text)


def overlap(query: str | Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: from -2 to 2 by the share of the query's words that the text holds."""
    words = F.array_distinct(X.ascii_tokens(F.lit(query)))
    return 4.0 * F.size(F.array_intersect(words, X.ascii_tokens(text))) / F.greatest(F.size(words), F.lit(1)) - 2.0


register_scorer("overlap", overlap)
