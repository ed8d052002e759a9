"""Plug-in scorers, encoders and lemmatisers: models stay outside the engine and fill columns in batches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize

_SCORERS: dict[str, Callable[[], Callable[[list[str], list[str]], list[float]]]] = {}
_ENCODERS: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]] = {}
_LEMMATISERS: dict[str, Callable[[], Callable[[list[str]], list[list[tuple[str, str, str]]]]]] = {}


def _registrar(into: dict, name: str):
    def add(factory):
        if name in into:
            raise KeyError(f"{name} is registered already")
        into[name] = factory
        return factory

    return add


def register(name: str):
    """Registers a factory; it is called once in each task and returns score(queries, sections) -> scores."""
    return _registrar(_SCORERS, name)


def register_encoder(name: str):
    """Registers a factory; it is called once in each task and returns encode(texts) -> vectors."""
    return _registrar(_ENCODERS, name)


def register_lemmatiser(name: str):
    """Registers a factory; it is called once in each task and returns parse(texts) -> for each text its (word, lemma, part of speech)."""
    return _registrar(_LEMMATISERS, name)


def text_encoder(name: str, unit: bool = False) -> Callable[[Column], Column]:
    """A column function from texts to vectors by a registered encoder, in Arrow batches; with unit, of length one. A null text is an empty one."""
    factory = _ENCODERS[name]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())], dtype=object)

    return (lambda c: l2_normalize(encode(c))) if unit else encode


def lemmatised(name: str) -> Callable[[Column], Column]:
    """A column function that puts lemmas for nouns and verbs and joins all words by spaces."""
    factory = _LEMMATISERS[name]

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parse = factory()
        for texts in batches:
            yield pd.Series([" ".join(lemma if kind in ("NOUN", "VERB") else word for word, lemma, kind in own) for own in parse(texts.fillna("").tolist())], dtype=object)

    return run


def pair_scorer(name: str) -> Callable[[Column, Column], Column]:
    """A column function of (query, section) by a registered scorer, in Arrow batches."""
    factory = _SCORERS[name]

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()  # once for each task, not for each row
        for query, section in batches:
            yield pd.Series(model(query.tolist(), section.tolist()), dtype="float64")

    return score


def with_scores(rows: DataFrame, query: str, section: str, names: list[str], out: str = "rerank_score") -> DataFrame:
    """rows with one column for each scorer and `out`, the score of the last of them that gave one."""
    for n in names:
        rows = rows.withColumn(f"score_{n}", pair_scorer(n)(F.col(query), F.col(section)))
    return rows.withColumn(out, F.coalesce(*[F.col(f"score_{n}") for n in reversed(names)]))


@contextmanager
def stage_meter(name: str, rows: list[dict], sample_id: int = -1, is_warmup: bool = False, watts: Callable[[], float] | None = None, peak_gb: Callable[[], float] | None = None, poll_s: float = 0.05):
    """Appends the time that the actions inside took to rows, and their energy and peak memory where there is a meter.

    watts is asked every poll_s seconds in a thread; energy is the integral by
    trapezoids, the first reading standing for the time before it. peak_gb is asked at
    the end. A meter that fails gives no readings. Without meters both are 0.
    """
    readings, stop, began = [], threading.Event(), time.perf_counter()

    def poll():
        while not stop.is_set():
            try:
                readings.append((time.perf_counter(), float(watts())))
            except Exception:  # noqa: BLE001 a meter must not end the stage
                pass
            stop.wait(poll_s)

    thread = threading.Thread(target=poll, daemon=True) if watts else None
    if thread:
        thread.start()
    try:
        yield
    finally:
        took = time.perf_counter() - began
        if thread:
            stop.set()
            thread.join(timeout=1.0)
        series = [(began, readings[0][1]), *readings] if readings else []
        energy = sum((a[1] + b[1]) / 2 * max(0.0, b[0] - a[0]) for a, b in zip(series, series[1:]))
        rows.append({"sample_id": sample_id, "stage": name, "latency_s": took, "peak_vram_gb": float(peak_gb()) if peak_gb else 0.0, "energy_j": energy, "is_warmup": is_warmup})
