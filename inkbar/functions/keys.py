"""Fingerprints of detection requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbar.schema import UNIT_SEPARATOR


def _key(text: Column, min_score: Column, rules_on: Column, strict: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            UNIT_SEPARATOR,
            text,
            min_score,
            F.coalesce(rules_on, F.lit(False)).cast("int").cast("string"),
            F.coalesce(strict, F.lit(False)).cast("int").cast("string"),
        ),
        256,
    )


def detect_fingerprint(
    text: Column, min_score: Column, rules_on: Column, strict: Column
) -> Column:
    """Key of a request; thresholds that agree to four decimals share it."""
    rounded = F.format_string(
        "%.4f", F.bround(F.coalesce(min_score, F.lit(0.0)).cast("double"), 4)
    )
    return _key(text, rounded, rules_on, strict)


def exact_fingerprint(
    text: Column, min_score: Column, rules_on: Column, strict: Column
) -> Column:
    """Key under which results are shared: the threshold counts in full."""
    exact = F.coalesce(min_score, F.lit(0.0)).cast("double").cast("string")
    return _key(text, exact, rules_on, strict)
