"""Each distinct request is scored once and repeats are marked.

Requests carry a unique ``req_id`` that grows in order of arrival.  Texts are
compared by fingerprint.  One pass over the texts writes ``req_id, fp``; all
grouping and marking reads that narrow table, and the texts are read once more
for the requests that are scored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbar.functions.keys import exact_fingerprint
from inkbar.functions.spans import computed_once, no_spans
from inkbar.operators.detect import request_options
from inkbar.operators.skew import join_hot
from inkbar.plans.scratch import written


def with_fingerprint(requests: DataFrame) -> DataFrame:
    options = request_options(requests)
    return requests.withColumn(
        "fp",
        exact_fingerprint(
            F.col("text"),
            options["min_score"],
            options["ru_postpass"],
            options["ru_postpass_strict"],
        ),
    )


def fingerprints(requests: DataFrame) -> DataFrame:
    """``req_id, fp`` of every request, written once."""
    return written(with_fingerprint(requests).select("req_id", "fp"), "fingerprints")


def first_requests(keys: DataFrame) -> DataFrame:
    """Per fingerprint the first request and the number of requests.

    A sum and a minimum over short keys: combined before the shuffle, so a text
    that makes up a third of all requests costs one row per task.
    """
    return keys.groupBy("fp").agg(F.min("req_id").alias("first_id"), F.count("*").alias("n"))


def _marks(keys: DataFrame, firsts: DataFrame) -> DataFrame:
    """A request is first if its id is its fingerprint's smallest.  That is a join
    on the unique id, so no fingerprint's rows ever meet in one task."""
    first_ids = firsts.select(F.col("first_id").alias("req_id"), F.lit(False).alias("_repeat"))
    return keys.join(first_ids, "req_id", "left").select(
        "req_id", "fp", F.coalesce("_repeat", F.lit(True)).alias("cached")
    )


def mark_cached(requests: DataFrame) -> DataFrame:
    """``req_id, fp, cached``: true from the second request of a fingerprint on."""
    keys = fingerprints(requests)
    return _marks(keys, first_requests(keys))


def _distinct(requests: DataFrame, firsts: DataFrame) -> DataFrame:
    wanted = firsts.select(F.col("first_id").alias("req_id"), "fp")
    return requests.join(wanted, "req_id")


def distinct_requests(requests: DataFrame) -> DataFrame:
    """The first request of every fingerprint, with its text and options."""
    return _distinct(requests, first_requests(fingerprints(requests)))


def detect_distinct_once(
    requests: DataFrame, detect: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``req_id, fp, spans, cached`` with ``detect`` run on distinct requests only.

    ``detect`` adds a ``spans`` column.  Only documents that have spans take part
    in the join back; the others get an empty array.
    """
    keys = fingerprints(requests)
    firsts = written(first_requests(keys), "firsts")
    scored = detect(_distinct(requests, firsts)).select("fp", "spans")
    found = computed_once(scored, "spans").filter(F.size("spans") > 0)
    joined = join_hot(
        _marks(keys, firsts), found, "fp", "req_id", firsts.select("fp", "n")
    )
    return joined.select(
        "req_id", "fp", F.coalesce("spans", no_spans()).alias("spans"), "cached"
    )


def cache_stats(requests: DataFrame) -> DataFrame:
    """One row: distinct results, repeats, and first requests."""
    keys = with_fingerprint(requests).select("req_id", "fp")
    return first_requests(keys).agg(
        F.count("*").alias("size"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"),
        F.count("*").alias("misses"),
    )
