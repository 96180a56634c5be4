"""Totals, throughput and latency."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbar.plans.scratch import written

BOUNDS = 1024
SMALL = 4096


def corpus_totals(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars"),
    )


def span_total(df: DataFrame) -> DataFrame:
    return df.agg(
        F.coalesce(F.sum(F.size("spans").cast("long")), F.lit(0)).alias("spans")
    )


def entity_counts(df: DataFrame) -> DataFrame:
    """Spans and documents per category.

    A document is counted once per category inside its own row, so nothing but
    two sums is shuffled.
    """
    names = F.transform("spans", lambda s: s.entity)
    tallies = F.transform(
        F.array_distinct(names),
        lambda e: F.struct(
            e.alias("entity"), F.size(F.filter("spans", lambda s: s.entity == e)).alias("k")
        ),
    )
    per_doc = df.select(F.explode_outer(tallies).alias("t")).filter("t is not null").select("t.*")
    return per_doc.groupBy("entity").agg(
        F.sum(F.col("k").cast("long")).alias("spans"), F.count("*").alias("documents")
    )


def throughput_by_run(latencies: DataFrame) -> DataFrame:
    """Characters per second of each run (``run, chars, elapsed`` in seconds)."""
    return latencies.groupBy("run").agg(
        (
            F.sum("chars").cast("double") / F.greatest(F.sum("elapsed"), F.lit(1e-9))
        ).alias("chars_per_s")
    )


def mean_throughput(latencies: DataFrame) -> DataFrame:
    return throughput_by_run(latencies).agg(F.avg("chars_per_s").alias("chars_per_s"))


def latency_percentiles(
    df: DataFrame, value: str, percents: tuple[float, ...] = (50, 90, 99)
) -> DataFrame:
    """Percentiles by rounded rank: ``pct, value``; 0.0 where there are no rows.

    The rank is ``p / 100 * (n - 1)`` rounded half to even and kept within the rows,
    which neither of Spark's percentile functions gives.  Exact, without sorting
    everything in one place: equal values are counted once and written; approximate
    quantiles cut the rest into ranges, whose counts tell where a rank falls; and a
    range is cut again until it is small.  Null and NaN are left out.  A few
    thousand numbers for each rank pass through the driver, however much data there is.
    """
    counted = (
        df.select(F.col(value).cast("double").alias("v"))
        .where("v is not null and not isnan(v)")
        .groupBy("v")
        .agg(F.count("*").alias("n"))
    )
    counted = written(counted, "percentile-counts")
    total = counted.agg(F.sum("n")).first()[0]
    found = {}
    for p in percents:
        if total:
            found[p] = min(max(round(p / 100 * (total - 1)), 0), total - 1)
    values = _at_ranks(counted, sorted(set(found.values())), float("-inf"), float("inf"))
    rows = [(float(p), float(values[found[p]]) if p in found else 0.0) for p in percents]
    return df.sparkSession.createDataFrame(rows, "pct double, value double")


def _at_ranks(counted: DataFrame, ranks: list[int], low: float, high: float) -> dict[int, float]:
    """The values at the ranks among those of ``counted(v, n)`` from ``low`` to ``high``.

    Up to ``SMALL`` distinct values are read outright.  More are cut at about ``BOUNDS``
    quantiles, and each range that holds a rank is looked at in the same way.
    """
    if not ranks:
        return {}
    inside = counted.filter(F.col("v").between(low, high))
    few = inside.limit(SMALL + 1).count()
    if few <= SMALL:
        out, below = {}, 0
        for v, n in inside.orderBy("v").collect():
            out |= {k: v for k in ranks if below <= k < below + n}
            below += n
        return out
    steps = [i / BOUNDS for i in range(1, BOUNDS)]
    bounds = inside.agg(F.percentile_approx("v", steps, 10 * BOUNDS)).first()[0]
    inner = sorted({b for b in bounds if math.isfinite(b)} - {low, high})
    ranged = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")], inputCol="v", outputCol="r"
    ).transform(inside)
    # one row for each range
    parts = ranged.groupBy("r").agg(F.sum("n").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    out, below = {}, 0
    for _, n, a, b in parts.orderBy("r").collect():
        here = [k - below for k in ranks if below <= k < below + n]
        out |= {k + below: v for k, v in _at_ranks(counted, here, a, b).items()}
        below += n
    return out


def latency_mean(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))
