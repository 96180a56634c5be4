"""Requests split by verdict in one pass, with the counts that the pass gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from inkbar.operators.validate import MAX_TEXT_BYTES, text_checks, with_verdict
from inkbar.plans.scratch import scratch_path


@dataclass(frozen=True)
class Split:
    """``accepted`` rows, ``rejects`` with status and reason, and rows by reason (None: accepted)."""

    accepted: DataFrame
    rejects: DataFrame
    counts: dict[str | None, int]


def split_requests(df: DataFrame, max_bytes: int = MAX_TEXT_BYTES, path: str | None = None) -> Split:
    """Judge every request once and write it where its verdict belongs.

    The input is read once; both tables read folders of what was written, so neither judges
    again.  Counts are observed while writing and cost no job.  Of a row that fails several checks
    the first counts.  ``path`` must be new; columns ``refused``, ``status`` and ``reason`` of the input
    are replaced.
    """
    checks = text_checks(df, max_bytes)
    judged = with_verdict(df, checks).withColumn("refused", F.col("status").isNotNull())
    reasons = list(dict.fromkeys(c.reason for c in checks))
    seen = Observation()
    observed = judged.observe(
        seen,
        F.count(F.lit(1)).alias("all"),
        *(F.count(F.when(F.col("reason") == r, 1)).alias(f"r{i}") for i, r in enumerate(reasons)),
    )
    path = path or scratch_path(df.sparkSession, "verdicts")
    observed.write.partitionBy("refused").parquet(path)
    found = seen.get
    counts: dict[str | None, int] = {r: found[f"r{i}"] for i, r in enumerate(reasons) if found[f"r{i}"]}
    counts[None] = found["all"] - sum(counts.values())
    told = df.sparkSession.read.schema(observed.schema).parquet(path)
    return Split(
        told.filter("not refused").select(*(c for c in df.columns if c not in ("refused", "status", "reason"))),
        told.filter("refused").drop("refused"),
        counts,
    )
