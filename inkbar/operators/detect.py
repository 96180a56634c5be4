"""Detection over a table of texts.  None of these operators shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.functions.rules import PART_RULES, Rule, rules_for
from inkbar.functions.scan import ru_postpass, scan_rules
from inkbar.functions.spans import (
    filter_min_score,
    filter_min_score_final,
    let,
    no_spans,
)
from inkbar.operators.model import Predictor, detect_one


def pii_spans(
    text: Column,
    existing: Column | None = None,
    strict: bool | Column = False,
    extra_rules: tuple[Rule, ...] = (),
) -> Column:
    """Rule spans merged into ``existing``, sorted by start."""
    if isinstance(strict, Column):
        return ru_postpass(text, existing, rules_for(None, extra_rules), strict)
    return ru_postpass(text, existing, rules_for(strict, extra_rules))


def detect_part(text: Column, name: str) -> Column:
    """Spans of one shape alone, left to right."""
    return scan_rules(text, (PART_RULES[name],))


def detect_regex_only(
    df: DataFrame,
    min_score: float = 0.0,
    strict: bool = False,
    extra_rules: tuple[Rule, ...] = (),
    out: str = "spans",
) -> DataFrame:
    """Spans from the rules alone."""
    spans = pii_spans(F.col("text"), None, strict, extra_rules)
    if min_score > 0:
        spans = let(
            spans, lambda s: filter_min_score_final(s, F.lit(float(min_score)))
        )
    return df.withColumn(out, spans)


def gate_and_merge(
    text: Column,
    model_spans: Column,
    min_score: Column,
    rules_on: Column,
    strict: Column,
    extra_rules: tuple[Rule, ...] = (),
) -> Column:
    """What a request returns, with its options taken from columns.

    Scorer spans are gated first, so a rule may take the place of a weak one;
    the second gate follows overlap resolution, so a rule hit that is gated away
    has still blocked later ones.  ``strict`` only counts if the rules are on.
    """

    def merged(existing: Column) -> Column:
        more = pii_spans(text, existing, strict, extra_rules)
        return F.when(
            rules_on, let(more, lambda s: filter_min_score_final(s, min_score))
        ).otherwise(existing)

    gated = filter_min_score(F.coalesce(model_spans, no_spans()), min_score)
    return let(gated, merged)


def request_options(df: DataFrame) -> dict[str, Column]:
    """Option columns with the service's defaults for what is absent or null."""

    def option(name: str, default) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None)
        return F.coalesce(value, F.lit(default))

    return {
        "min_score": option("min_score", 0.0),
        "ru_postpass": option("ru_postpass", False),
        "ru_postpass_strict": option("ru_postpass_strict", False),
    }


def detect_pii(
    df: DataFrame,
    make_predictor: Callable[[], Predictor] | None = None,
    model_spans: str | None = None,
    extra_rules: tuple[Rule, ...] = (),
    out: str = "spans",
) -> DataFrame:
    """Scorer spans, rules and gates, options per row.

    The scorer is a predictor factory or a ready column of spans; without
    either the rules alone run.
    """
    options = request_options(df)
    if make_predictor is not None:
        df = detect_one(df, make_predictor, out="_model_spans")
        model_spans = "_model_spans"
    existing = F.col(model_spans) if model_spans else no_spans()
    spans = gate_and_merge(
        F.col("text"),
        existing,
        options["min_score"],
        options["ru_postpass"],
        options["ru_postpass_strict"],
        extra_rules,
    )
    return df.withColumn(out, spans).drop("_model_spans")
