"""Scorers that read a limited number of characters, on texts of any length.

A text is cut in windows of ``limit`` characters that overlap by ``overlap``.  Windows are rows, so a
long text is scored by many tasks, and a batch for the scorer holds windows of about one
length.  Spans are put together where windows meet, the seam in the middle of the overlap:

* A span counts if it begins in its window's own part, from seam to seam: there the scorer has seen
  half an overlap on its left at least.
* A span that begins elsewhere only prolongs one of its category that it overlaps, as where a
  span is cut by the end of a window, or by the ends of several.

A scorer that judges a span by what stands within ``overlap`` / 2 characters of it gives the spans that it
would give on the whole text, of any length.  Defined cases: null texts have no spans, empty ones are given to the scorer
if ``empty``; of pieces of one span the highest score counts; repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions.spans import no_spans
from inkbar.operators.model import Predictor, normalize_raw_spans
from inkbar.plans.scratch import written

_SPAN = "struct<entity:string,start:int,end:int,score:double>"


def packed_udf(make_predictor: Callable[[], Predictor], batch_chars: int):
    """Arrow UDF ``text -> array<raw record>``; a batch has about ``batch_chars`` characters, padding included."""
    fields = [(f.name, f.dataType.simpleString()) for f in S.RAW_SPAN]
    cast = {"int": int, "double": float}

    def record(r: dict) -> dict:
        return {n: cast.get(k, str)(r[n]) if r.get(n) is not None else None for n, k in fields}

    def batches_of(lengths: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            size = max(1, batch_chars // max(1, int(lengths[order[at]])))
            yield order[at : at + size]
            at += size

    @F.pandas_udf(S.RAW_SPANS)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predictor()
        for texts in batches:
            known = texts[texts.notna()].tolist()
            found: list = [None] * len(known)
            for part in batches_of(np.array([len(t) for t in known], dtype=np.int64)):
                for i, raws in zip(part.tolist(), predict([known[i] for i in part])):
                    found[i] = [record(r) for r in raws]
            told = iter(found)
            yield pd.Series([next(told) if t is not None else [] for t in texts], index=texts.index, dtype=object)

    return score


def windows(df: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``_id, _base, _last, _part`` for each window of each row's text; a null text has none."""
    step = limit - overlap
    n = F.greatest(F.ceil((F.length("text") - overlap) / step).cast("int"), F.lit(1))
    return (
        df.filter("text is not null")
        .select("_id", "text", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
        .select(
            "_id", (F.col("_k") * step).alias("_base"), (F.col("_k") == F.col("_n") - 1).alias("_last"),
            F.substring("text", F.col("_k") * step + 1, F.lit(limit)).alias("_part"),
        )
    )


def stitched(found: list[tuple], limit: int, overlap: int) -> list[tuple]:
    """Spans of a text from (base, last, entity, start, end, score), positions in the text."""
    step, half = limit - overlap, overlap // 2
    merged: list[list] = []
    # the pieces of a category that overlap lie side by side in this order
    for base, last, entity, start, end, score in sorted(found, key=lambda x: (x[2], x[3], x[4])):
        counts = (base == 0 or start >= base + half) and (last or start < base + step + half)
        before = merged[-1] if merged else None
        if before and before[2] == entity and (start < before[1] or (start, end) == (before[0], before[1])):
            before[1], before[3], before[4] = max(before[1], end), max(before[3], score), before[4] or counts
        else:
            merged.append([start, end, entity, score, counts])
    return sorted((s, e, entity, score) for s, e, entity, score, counts in merged if counts)


def detect_long(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    limit: int,
    overlap: int,
    min_score: float = 0.0,
    batch_chars: int = 1 << 16,
    empty: bool = True,
    out: str = "spans",
) -> DataFrame:
    """Add scorer spans for every text; the scorer is given ``limit`` characters at most."""
    if not 0 < overlap < limit:
        raise ValueError("the overlap must be positive and less than the limit")
    held = written(df.withColumn("_id", F.monotonically_increasing_id()), "long-texts")
    text: Column = F.col("_part") if empty else F.when(F.length("_part") > 0, F.col("_part"))
    scored = windows(held, limit, overlap).withColumn("_raw", packed_udf(make_predictor, batch_chars)(text))
    local = normalize_raw_spans(F.col("_part"), F.col("_raw"), F.lit(float(min_score)))
    spans = scored.select("_id", "_base", "_last", F.explode(local).alias("s")).select(
        "_id",
        F.struct(
            "_base", "_last", "s.entity", (F.col("s.start") + F.col("_base")).alias("start"),
            (F.col("s.end") + F.col("_base")).alias("end"), "s.score",
        ).alias("x"),
    )

    @F.udf(f"array<{_SPAN}>")
    def put_together(rows):
        found = sorted(tuple(r) for r in rows)
        return [(e, s, t, c) for s, t, e, c in stitched(found, limit, overlap)]

    # the spans of a text, as an array: what is asked for
    joined = spans.groupBy("_id").agg(F.collect_list("x").alias("_all")).select("_id", put_together("_all").alias("_spans"))
    shown = F.transform(
        "_spans",
        lambda s: F.struct(
            s.entity.alias("entity"), F.col("text").substr(s.start + 1, s.end - s.start).alias("text"),
            s.start.alias("start"), s.end.alias("end"), s.score.alias("score"),
        ),
    )
    return (
        held.join(joined, "_id", "left")
        .withColumn(out, F.coalesce(shown, no_spans()))
        .select(*(c for c in df.columns if c != out), out)
    )
