"""Joining on a key that a few values may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more than 1 / share of all rows.  So there are at most ``share`` hot keys
# whatever the data, which is what makes the broadcast of their list safe.  The share is
# such that a lane holds LANE_ROWS rows, between these bounds.
HOT_SHARE = 1000
MOST_HOT = 100_000
LANE_ROWS = 1_000_000


def hot_share(total: int) -> int:
    """Parts of ``total`` rows of which a key or lane may hold one."""
    return max(HOT_SHARE, min(MOST_HOT, total // LANE_ROWS))


def hot_keys(rows: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """At most ``hot_share`` rows: hot keys and how many lanes each is split in.

    ``counts`` (``key, n``) saves the counting where it is known.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # a count, known before the join
    share = F.col("n") * F.lit(hot_share(total)) / F.lit(max(total, 1))
    return counts.filter(share > 1).select(
        key, F.ceil(share).cast("int").alias("_lanes")
    )


def join_hot(
    many: DataFrame,
    one: DataFrame,
    key: str,
    row_id: str,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join of ``many`` rows to ``one`` row per key, hot keys split in lanes.

    The rows of a hot key are spread over its lanes and its single partner row is
    repeated once per lane: at most 2 * ``hot_share`` extra rows in total.
    """
    hot = F.broadcast(hot_keys(many, key, counts))
    left = many.join(hot, key, "left").withColumn(
        "_lane",
        F.coalesce(
            F.pmod(F.xxhash64(row_id), F.col("_lanes").cast("long")).cast("int"), F.lit(0)
        ),
    )
    right = one.join(hot, key, "left").withColumn(
        "_lane",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_lanes"), F.lit(1)) - 1)),
    )
    return left.drop("_lanes").join(right.drop("_lanes"), [key, "_lane"], "left").drop("_lane")
