"""Redaction of documents that no row should hold with all their spans.

A text is cut in stretches of ``size`` characters, each a row, and so are its spans: those to be replaced
are chosen by sweeping the span table, which gathers no document, and dealt to the stretch where they
begin.  A span that reaches on hands what it covers to the stretches behind.  Every stretch is
redacted in a task of its own, with at most as many non-empty spans as it has characters.
``strung`` puts texts together again, for sinks that want them whole.

Defined cases are those of ``redact_with_external_spans``: spans outside their text, or whose score is not a
number, go; of spans that overlap the first by start and order counts; a null text gives one part
that is null.  The key must be unique in ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbar.functions.redact import redact
from inkbar.functions.spans import span
from inkbar.operators.span_rows import sweep_rows
from inkbar.plans.scratch import written
from inkbar.sources.text import with_text_length

SIZE = 4096


def text_stretches(docs: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``key, pos, part``: each text as rows of ``size`` characters; an empty or null one is a row."""
    pieces = F.when(F.length("text") > 0, F.expr(f"regexp_extract_all(text, '(?s).{{1,{size}}}', 0)")).otherwise(
        F.array("text")
    )
    return docs.select(key, F.posexplode(pieces).alias("pos", "part"))


def redact_in_stretches(
    docs: DataFrame,
    spans: DataFrame,
    key: str = "doc_id",
    order: str = "ord",
    placeholder: str | None = None,
    mask_char: str | None = None,
    size: int = SIZE,
) -> DataFrame:
    """``key, pos, redacted``: the redacted parts of each text, in order of ``pos``."""
    inside = with_text_length(docs, spans, key, order).filter(
        "start >= 0 and start <= end and end <= _n and not isnan(score)"
    )
    kept = written(sweep_rows(written(inside, "spans-inside"), key, order), "spans-kept")
    # an empty span behind the last character belongs to the last stretch
    last = F.greatest(F.floor((F.col("_n") - 1) / size), F.lit(0))
    first = F.least(F.floor(F.col("start") / size), last).cast("int")
    own = kept.select(
        F.col(key).alias("_key"), first.alias("_pos"), F.col("start").alias("_start"), F.col(order).alias("_ord"),
        F.col("entity").alias("_entity"), F.col("start") - first * size, F.least(F.col("end") - first * size, F.lit(size)),
        F.lit(0),
    ).toDF("_key", "_pos", "_start", "_ord", "_entity", "_from", "_to", "_covered")
    behind = (
        kept.withColumn("_first", first).filter(F.col("end") > (F.col("_first") + 1) * size)
        .select(
            F.col(key).alias("_key"), "end",
            F.explode(F.sequence(F.col("_first") + 1, F.floor((F.col("end") - 1) / size).cast("int"))).alias("_pos"),
        )
        .select("_key", "_pos", F.least(F.col("end") - F.col("_pos") * size, F.lit(size)).alias("_covered"))
    )
    drawn = F.struct("_start", "_ord", "_entity", "_from", "_to")
    dealt = (
        own.unionByName(behind, allowMissingColumns=True)
        .groupBy("_key", "_pos")
        .agg(F.array_sort(F.collect_list(F.when(F.col("_entity").isNotNull(), drawn))).alias("_all"), F.max("_covered").alias("_covered"))
    )
    rows = text_stretches(docs, key, size).join(
        dealt, (F.col(key) == F.col("_key")) & (F.col("pos") == F.col("_pos")), "left"
    )
    covered = F.coalesce("_covered", F.lit(0))
    here = F.transform(
        F.coalesce("_all", F.array().cast(dealt.schema["_all"].dataType)),
        lambda s: span(s["_entity"], F.lit(None), s["_from"] - covered, s["_to"] - covered, F.lit(1.0)),
    )
    rest = F.expr("substring(part, coalesce(_covered, 0) + 1)")
    done = redact(rest, here, placeholder, mask_char)
    if mask_char is not None:
        done = F.concat(F.repeat(F.lit(mask_char), covered), done)
    return rows.select(key, "pos", done.alias("redacted"))


def strung(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, redacted``: whole texts, for a sink."""
    held = F.array_sort(F.collect_list(F.struct("pos", "redacted")))
    whole = F.array_join(F.transform(held, lambda x: x.redacted), "")
    return parts.groupBy(key).agg(F.when(F.count("redacted") > 0, whole).alias("redacted"))
