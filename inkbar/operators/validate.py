"""Request checks.  A bad row becomes a reject with a status and a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.functions.rules import PAGE_BLANK
from inkbar.schema import MAX_TEXT_BYTES


MALFORMED = "malformed"


def oversized_text(text: Column, max_bytes: int = MAX_TEXT_BYTES) -> Column:
    """UTF-8 bytes above the limit."""
    return F.octet_length(text) > max_bytes


def oversized_file(length: Column, max_bytes: int = MAX_TEXT_BYTES) -> Column:
    return length > max_bytes


def invalid_utf8(content: Column) -> Column:
    return ~F.is_valid_utf8(content)


def bad_mask_char(mask_char: Column) -> Column:
    return mask_char.isNotNull() & (F.length(mask_char) != 1)


def bad_min_score(min_score: Column) -> Column:
    return min_score.isNotNull() & ~min_score.between(0.0, 1.0)


def blank_text(text: Column) -> Column:
    """Nothing but blanks (or byte order marks)."""
    return ~F.rlike(text, F.lit(f"[^{PAGE_BLANK}]"))


@dataclass(frozen=True)
class Check:
    failed: Column
    status: int
    reason: str


def first_failure(checks: list[Check]) -> tuple[Column, Column]:
    """Status and reason of the first failed check, null if all pass."""
    status = reason = None
    for c in checks:
        failed = F.coalesce(c.failed, F.lit(False))
        if status is None:
            status, reason = F.when(failed, c.status), F.when(failed, c.reason)
        else:
            status = status.when(failed, c.status)
            reason = reason.when(failed, c.reason)
    return status.cast("int"), reason


def text_checks(df: DataFrame, max_bytes: int = MAX_TEXT_BYTES) -> list[Check]:
    checks = []
    if MALFORMED in df.columns:
        checks.append(Check(F.col(MALFORMED).isNotNull(), 422, "malformed request"))
    checks += [
        Check(F.col("text").isNull(), 422, "text missing"),
        Check(oversized_text(F.col("text"), max_bytes), 422, f"text exceeds {max_bytes} bytes"),
    ]
    if "min_score" in df.columns:
        checks.append(
            Check(bad_min_score(F.col("min_score")), 422, "min_score must be between 0 and 1")
        )
    if "mask_char" in df.columns:
        checks.append(
            Check(bad_mask_char(F.col("mask_char")), 422, "mask_char must be a single character")
        )
    return checks


def file_checks(df: DataFrame, max_bytes: int = MAX_TEXT_BYTES) -> list[Check]:
    """Size first, then encoding, then the mask; the range of the threshold is
    part of the request's form and so comes before all of them."""
    checks = []
    if "min_score" in df.columns:
        checks.append(
            Check(bad_min_score(F.col("min_score")), 422, "min_score must be between 0 and 1")
        )
    checks += [
        Check(oversized_file(F.col("length"), max_bytes), 413, f"file exceeds {max_bytes} bytes"),
        Check(invalid_utf8(F.col("content")), 400, "not UTF-8"),
    ]
    if "mask_char" in df.columns:
        checks.append(
            Check(bad_mask_char(F.col("mask_char")), 422, "mask_char must be a single character")
        )
    return checks


def with_verdict(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Add ``status`` and ``reason``; both are null for accepted rows."""
    status, reason = first_failure(checks)
    return df.withColumns({"status": status, "reason": reason})


def validate_requests(
    df: DataFrame, max_bytes: int = MAX_TEXT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and rejects with ``status`` and ``reason``."""
    judged = with_verdict(df, text_checks(df, max_bytes))
    return (
        judged.filter("status is null").drop("status", "reason"),
        judged.filter("status is not null"),
    )


@dataclass(frozen=True)
class Options:
    """Options of one run.  Contradictions are refused on construction."""

    min_score: float = 0.0
    ru_postpass: bool = False
    ru_postpass_strict: bool = False
    no_model: bool = False
    placeholder: str | None = None
    mask_char: str | None = None
    stars: bool = False

    def __post_init__(self) -> None:
        if self.stars:
            if self.mask_char and self.mask_char != "*":
                raise ValueError("stars conflicts with mask_char")
            object.__setattr__(self, "mask_char", "*")
        if self.ru_postpass_strict and not (self.ru_postpass or self.no_model):
            raise ValueError("ru_postpass_strict requires ru_postpass or no_model")
        if self.no_model and not self.ru_postpass:
            raise ValueError("no_model requires ru_postpass, or nothing is detected")
        if self.mask_char is not None and len(self.mask_char) != 1:
            raise ValueError("mask_char must be a single character")


validate_options = Options
