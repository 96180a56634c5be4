"""Functions for SQL users: ``pii_spans``, ``pii_redact``, ``pii_span_rows`` and ``pii_verdict``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkbar.functions import sqltext as Q
from inkbar.functions.redact import redact_body
from inkbar.functions.rules import Rule, rules_for
from inkbar.functions.scan import scan_body
from inkbar.schema import SPANS_DDL


def register_sql_functions(
    spark: SparkSession, extra_rules: tuple[Rule, ...] = ()
) -> None:
    """Define for this session

    * ``pii_spans(text, strict)``: the rules' spans, sorted by start;
    * ``pii_redact(text, spans, placeholder, mask_char)``: the redacted text;
    * ``pii_span_rows(spans)``: a table of ``pos, entity, text, start, end, score``, for ``LATERAL``;
    * ``pii_verdict(text, min_score, mask_char, max_bytes)``: status and reason of a request,
      null where it is accepted.

    All are SQL functions, so their bodies become part of the calling plan.
    """
    scan = scan_body(rules_for(None, extra_rules), False, True, False)
    spans = Q.let("named_struct('text', text, 'strict', strict)", "v", scan)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION pii_spans(text STRING, strict BOOLEAN) "
        f"RETURNS {SPANS_DDL} RETURN {spans}"
    )
    row = "named_struct('text', text, 'spans', spans, 'mask', mask_char, 'fixed', placeholder)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION pii_redact("
        f"text STRING, spans {SPANS_DDL}, placeholder STRING, mask_char STRING) "
        f"RETURNS STRING RETURN {Q.let(row, 'v', redact_body())}"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION pii_span_rows(spans {SPANS_DDL}) "
        "RETURNS TABLE(pos INT, entity STRING, text STRING, start INT, end INT, score DOUBLE) "
        "RETURN SELECT pos, s.entity, s.text, s.start, s.end, s.score FROM (SELECT posexplode(spans) AS (pos, s))"
    )
    reason = (
        "case when text is null then 'text missing' "
        "when octet_length(text) > max_bytes then concat('text exceeds ', max_bytes, ' bytes') "
        "when isnan(min_score) or min_score < 0 or min_score > 1 then 'min_score must be between 0 and 1' "
        "when length(mask_char) <> 1 then 'mask_char must be a single character' end"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION pii_verdict("
        "text STRING, min_score DOUBLE, mask_char STRING, max_bytes INT) RETURNS STRUCT<status: INT, reason: STRING> "
        f"RETURN {Q.let(reason, 'r', "if(r is null, null, named_struct('status', 422, 'reason', r))")}"
    )
