"""Spans from an external scorer.

A predictor is any callable from a list of texts to a list of raw record lists.
It is built once per Python worker by a factory, because a scorer usually holds
a large model.  Only the text column goes through Arrow; every other column
stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions.redact import cut_spans
from inkbar.functions.spans import no_spans, span

Predictor = Callable[[list[str]], list[list[dict]]]


def normalize_raw_spans(text: Column, raw: Column, min_score: Column) -> Column:
    """Raw scorer records to spans.

    The category is the first non-empty of ``entity_group`` and ``entity``.
    Records below the threshold, with a score that is not a number, or that do not lie
    inside the text, go (``misplaced_raw_spans`` returns the last).  The
    span's text is cut from the source, never taken from the record.
    """
    length = F.length(text)
    kept = F.filter(
        raw,
        lambda r: r.score.isNotNull() & ~F.isnan(r.score) & ~(r.score < min_score) & _lies_inside(r, length),
    )

    def one(r: Column) -> Column:
        entity = F.coalesce(
            F.nullif(r.entity_group, F.lit("")),
            F.nullif(r.entity, F.lit("")),
            F.lit(S.UNKNOWN_ENTITY),
        )
        return span(entity, F.lit(None), r.start, r.end, r.score)

    return F.when(text.isNull() | raw.isNull(), no_spans()).otherwise(
        cut_spans(text, F.transform(kept, one))
    )


def _lies_inside(r: Column, length: Column) -> Column:
    return F.coalesce((r.start >= 0) & (r.start <= r.end) & (r.end <= length), F.lit(False))


def misplaced_raw_spans(text: Column, raw: Column) -> Column:
    """The scorer's records whose offsets do not lie inside the text."""
    length = F.length(text)
    return F.filter(raw, lambda r: ~_lies_inside(r, length))


def raw_spans_udf(make_predictor: Callable[[], Predictor], batch_size: int = 8):
    """Arrow UDF ``text -> array<raw record>``, scored in slices of ``batch_size``."""

    fields = [(f.name, f.dataType.simpleString()) for f in S.RAW_SPAN]

    @F.pandas_udf(S.RAW_SPANS)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predictor()
        cast = {"int": int, "double": float}

        def record(r: dict) -> dict:
            return {
                name: cast.get(kind, str)(r[name]) if r.get(name) is not None else None
                for name, kind in fields
            }

        for texts in batches:
            known = texts[texts.notna()]
            found = []
            for at in range(0, len(known), batch_size):
                found.extend(predict(known.iloc[at : at + batch_size].tolist()))
            out = pd.Series([[]] * len(texts), index=texts.index, dtype=object)
            out.loc[known.index] = pd.Series(
                [[record(r) for r in raws] for raws in found],
                index=known.index,
                dtype=object,
            )
            yield out

    return score


def detect_batch(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    min_score: Column | float = 0.0,
    batch_size: int = 8,
    out: str = "spans",
) -> DataFrame:
    """Add scorer spans for every text, empty ones included."""
    threshold = min_score if isinstance(min_score, Column) else F.lit(float(min_score))
    raw = raw_spans_udf(make_predictor, batch_size)(F.col("text"))
    return (
        df.withColumn("_raw", raw)
        .withColumn(out, normalize_raw_spans(F.col("text"), F.col("_raw"), threshold))
        .drop("_raw")
    )


def detect_one(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    min_score: Column | float = 0.0,
    out: str = "spans",
) -> DataFrame:
    """As ``detect_batch``, but an empty text is not given to the scorer."""
    threshold = min_score if isinstance(min_score, Column) else F.lit(float(min_score))
    text = F.when(F.length("text") > 0, F.col("text"))
    raw = raw_spans_udf(make_predictor, 1)(text)
    return (
        df.withColumn("_raw", raw)
        .withColumn(out, normalize_raw_spans(F.col("text"), F.col("_raw"), threshold))
        .drop("_raw")
    )
