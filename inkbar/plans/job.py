"""Whole jobs: from a table of texts or requests to redacted results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions.redact import redact
from inkbar.functions.rules import Rule
from inkbar.functions.spans import no_spans
from inkbar.operators.dedup import detect_distinct_once
from inkbar.operators.detect import detect_pii, pii_spans
from inkbar.operators.model import Predictor
from inkbar.operators.span_rows import essential_spans
from inkbar.operators.validate import Options, validate_requests
from inkbar.plans.scratch import written
from inkbar.sources.text import attach_external_spans, ingest_binary_files, with_text_length


def _option(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def redact_per_row_options(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Add ``redacted`` with the placeholder and mask of each request row."""
    return df.withColumn(
        "redacted",
        redact(
            F.col("text"), F.col(spans), _option(df, "placeholder"), _option(df, "mask_char")
        ),
    )


def serve_requests(
    requests: DataFrame,
    make_predictor: Callable[[], Predictor] | None = None,
    model_spans: str | None = None,
    extra_rules: tuple[Rule, ...] = (),
    max_bytes: int = S.MAX_TEXT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Validate, detect and redact; options come from each row.

    Returns results and rejects.  The checks are filters in front of detection,
    so an oversized text is never scanned.  Requests with a ``req_id`` (unique, in order
    of arrival) are detected once for each distinct text and options, and ``cached`` marks
    the repeats; a ready column of spans stands for its own row and is not shared.
    """
    accepted, rejects = validate_requests(requests, max_bytes)

    def detect(df: DataFrame) -> DataFrame:
        return detect_pii(df, make_predictor, model_spans, extra_rules)

    if "req_id" not in requests.columns or model_spans is not None:
        return redact_per_row_options(detect(accepted)), rejects
    found = detect_distinct_once(accepted, detect).select("req_id", "spans", "cached")
    return redact_per_row_options(accepted.join(found, "req_id")), rejects


def redact_uploads(
    files: DataFrame,
    make_predictor: Callable[[], Predictor] | None = None,
    extra_rules: tuple[Rule, ...] = (),
    max_bytes: int = S.MAX_TEXT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Uploaded files to redacted texts, with the options beside each file; and rejects.

    Files are requests in order of their path: a repeated text is marked ``cached``.
    """
    accepted, rejects = ingest_binary_files(files, max_bytes)
    asked = accepted.withColumn("req_id", F.col("path"))
    found = detect_distinct_once(
        asked, lambda df: detect_pii(df, make_predictor, None, extra_rules)
    ).select("req_id", "spans", "cached")
    return redact_per_row_options(asked.join(found, "req_id")).drop("req_id"), rejects


def run(
    docs: DataFrame,
    options: Options,
    make_predictor: Callable[[], Predictor] | None = None,
    extra_rules: tuple[Rule, ...] = (),
) -> DataFrame:
    """One set of options for every text; adds ``spans`` and ``redacted``."""
    if make_predictor is None and not options.no_model:
        raise ValueError("give a predictor or set no_model")
    typed = docs.withColumns(
        {
            "min_score": F.lit(float(options.min_score)),
            "ru_postpass": F.lit(options.ru_postpass or options.no_model),
            "ru_postpass_strict": F.lit(options.ru_postpass_strict),
        }
    )
    found = detect_pii(
        typed, None if options.no_model else make_predictor, None, extra_rules
    ).drop("min_score", "ru_postpass", "ru_postpass_strict")
    return found.withColumn(
        "redacted",
        redact(F.col("text"), F.col("spans"), options.placeholder, options.mask_char),
    )


def redact_with_external_spans(
    docs: DataFrame,
    spans: DataFrame,
    key: str = "doc_id",
    order: str = "ord",
    ru_postpass: bool = False,
    strict: bool = False,
    placeholder: str | None = None,
    mask_char: str | None = None,
) -> DataFrame:
    """``key, redacted`` from a supplied span table of any size.

    Spans that cannot change the result are dropped before the spans of a
    document are gathered, so one document may hold most of the table.
    """
    inside = (
        with_text_length(docs, spans, key, order)
        .filter("start >= 0 and start <= end and end <= _n and not isnan(score)")
        .drop("_n")
    )
    inside = written(inside, "spans-inside")  # read in several branches
    with_spans = attach_external_spans(docs, essential_spans(inside, key, order), key)
    found = F.col("spans")
    if ru_postpass:
        found = pii_spans(F.col("text"), found, strict)
    return with_spans.select(
        key,
        redact(
            F.col("text"), F.coalesce(found, no_spans()), placeholder, mask_char
        ).alias("redacted"),
    )
