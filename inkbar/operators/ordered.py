"""Running totals along an order, however many rows one key has.

Rows are range-partitioned by key and order, so a large key spreads over many
partitions.  Totals inside a partition are a window over (partition, key); what
went before the partition is a total over one row for each partition of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbar.plans.scratch import written


def with_running(
    rows: DataFrame,
    key: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
) -> DataFrame:
    """``rows`` with running sums, and greatest values, of the rows before each one.

    ``sums`` and ``highest`` name the new columns; a first row has 0, or null.  ``order`` must
    settle the order of the rows of a key.  A null key is a key of its own.
    """
    sums, highest = sums or {}, highest or {}
    made = {**sums, **highest}
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        rows.withColumns({f"_x_{name}": value for name, value in made.items()})
        .repartitionByRange(n, key, *order)
        .withColumn("_part", F.spark_partition_id()),
        "ordered",
    )
    within = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    of = {name: F.sum if name in sums else F.max for name in made}
    parts = placed.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(
        *(of[name](f"_x_{name}").alias(f"_x_{name}") for name in made)
    )
    starts = parts.select(
        "_k", "_p", *(of[name](f"_x_{name}").over(ahead).alias(f"_s_{name}") for name in made)
    )
    inner = placed.withColumns({f"_w_{name}": of[name](f"_x_{name}").over(within) for name in made})
    joined = inner.join(starts, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))

    def total(name: str) -> Column:
        before, inside = F.col(f"_s_{name}"), F.col(f"_w_{name}")
        if name in highest:
            return F.greatest(before, inside).alias(name)
        return (F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))).alias(name)

    return joined.select(*rows.columns, *(total(name) for name in made))
