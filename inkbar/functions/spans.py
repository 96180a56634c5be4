"""Span algebra on array columns: overlap, resolution, merge, sweep.

Everything here is one row in, one row out: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions import sqltext as Q


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_spans() -> Column:
    return F.array().cast(S.SPANS)


def span(entity, text, start, end, score) -> Column:
    """Struct column of type ``schema.SPAN``."""
    return F.struct(
        entity.cast("string").alias("entity"),
        text.cast("string").alias("text"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        score.cast("double").alias("score"),
    )


def overlaps(a: Column, b: Column) -> Column:
    """Half-open interval test; touching is not overlapping."""
    return (a.end > b.start) & (b.end > a.start)


def overlaps_any(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: overlaps(o, s))


def drop_overlapping_existing(candidates: Column, existing: Column) -> Column:
    """Candidates that overlap none of the existing spans."""
    return F.filter(candidates, lambda c: ~overlaps_any(c, existing))


def resolve_overlaps(candidates: Column) -> Column:
    """Greedy choice over one ordered list of arbitrary spans.

    A candidate is dropped if it overlaps one accepted before it.  Put in order of
    start, the list falls into islands that no span crosses; candidates are compared
    inside their island only.
    """
    return Q.apply(Q.resolve("v.spans"), spans=candidates)


def sort_spans(spans: Column) -> Column:
    """Stable sort by start."""
    return Q.apply(Q.sort_spans("v.spans"), spans=spans)


def merge_spans(existing: Column, additions: Column) -> Column:
    """Existing spans first, then additions, stably sorted by start."""
    return sort_spans(F.concat(existing, additions))


def sweep_non_overlapping(spans: Column) -> Column:
    """Sort by start and skip a span that begins before the last kept one ends."""
    return Q.apply(Q.sweep("v.spans"), spans=spans)


def filter_min_score(spans: Column, min_score: Column) -> Column:
    """Gate on scorer output: drop what is below the threshold, keep the rest."""
    return F.filter(spans, lambda s: ~(s.score < min_score))


def filter_min_score_final(spans: Column, min_score: Column) -> Column:
    """Gate after the rules; a threshold of zero lets everything through."""
    return F.when(
        min_score > 0, F.filter(spans, lambda s: s.score >= min_score)
    ).otherwise(spans)


def entities_present(spans: Column) -> Column:
    """Sorted distinct categories of a row."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.entity)))


def spans_by_entity(spans: Column, entity: str) -> Column:
    """Texts of one category, in span order."""
    return F.transform(
        F.filter(spans, lambda s: s.entity == F.lit(entity)), lambda s: s.text
    )


def computed_once(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a costly column that later filters do not compute again.

    A filter on a computed column is otherwise moved below it, expression and
    all.  It cannot be moved below the generator this puts in between.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(column)).alias(column))


def explode_spans(df: DataFrame, key: str = "doc_id", spans: str | Column = "spans") -> DataFrame:
    """One row per span with its place in the document's list.

    The outer form is used because for the plain one Spark adds a test for empty
    arrays in front, which would run the detection that makes them twice more.
    """
    return (
        df.select(key, F.posexplode_outer(spans).alias("pos", "span"))
        .filter("pos is not null")
        .select(key, "pos", "span.*")
    )
