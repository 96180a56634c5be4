"""Mixing sources to target weights by distributed prefix sums.

Each document gets a hash-random key from its id and text.  Rows are range-sorted by
(source, key), each partition sums its words per source, a running total over
the partitions of a source gives where each partition starts, and a running total
inside the partition places every document.  A source is cut at its exact budget in
words; a budget above the source's size starts a second epoch over the same order.

A hot source spreads over many range partitions.  What is gathered per source is
one row for each partition (never documents), and per table one row for each source.

Defined cases: a null source is a source of its own, placed last; null texts have
size 0 and are never taken; documents of size 0 in a source without words have
target 0; ties on the key fall to doc_id; equal rows are interchangeable.  Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbar.llm.rows import boxed, unboxed
from inkbar.operators.ordered import with_running
from inkbar.plans.scratch import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weight: Column, share: float = SHARE, most: int = MOST_EPOCHS
) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``.

    The total is ``share`` of all words.  A source's target is its weight's part of
    it, but ``most`` times its size at the highest; the excess is reshared by weight.
    That is one level L for all: target = min(most * size, L * weight).  In order of
    size / weight the capped sources come first, so running sums give L.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.withColumn(
            "rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
        )
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(most))
    )
    levels = ranked.withColumn(
        "level",
        (
            F.sum("source_size").over(every) * F.lit(share)
            - F.coalesce(F.sum("cap").over(before), F.lit(0))
        )
        / F.sum("weight").over(after),
    )
    # L is the level at the first source that stays below its cap; later ones are lower
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return levels.withColumn("L", level).select(
        "source",
        "source_size",
        F.when(F.col("L").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("L") * F.col("weight")))
        .cast("double")
        .alias("target"),
    )


def cycle(weights: tuple[int, ...] = WEIGHTS) -> Column:
    """The weights in turn, by the source's rank."""
    return F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)),
        (F.col("rank") % F.lit(len(weights)) + 1).cast("int"),
    )


def placed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE
) -> DataFrame:
    """``doc_id, source, tkey, size, source_size, target, before``, a row per document.

    ``before`` is the number of words of the same source ahead of the document in hash-random order.
    """
    tkey = F.md5(F.coalesce("text", F.lit("")))
    sized = docs.select("doc_id", "source", tkey.alias("tkey"), words(F.col("text")).alias("size"))
    keyed = sized.withColumn(
        "key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "tkey"))
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(
        keyed.repartitionByRange(n, F.col("source").isNull(), "source", "key", "doc_id").withColumn(
            "part", F.spark_partition_id()
        ),
        "mix-order",
    )
    parts = ordered.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("source").alias("s"), F.col("part").alias("p"),
        F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"),
    )
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, cycle(weights), share).withColumnRenamed("source", "g")
    # a source of a partition is one group, as long as the partition at most
    inside = (
        Window.partitionBy("part", "source").orderBy("key", "doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bounds = starts.join(goals, F.col("s").eqNullSafe(F.col("g")))
    return (
        ordered.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bounds, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
        .select(
            "doc_id", "source", "tkey", "size", "source_size", "target",
            (F.col("start") + F.col("own")).alias("before"),
        )
    )


def taken(exact: bool = True) -> Column:
    """Words the mix takes of a placed document, all epochs together.

    ``exact`` cuts the document at the budget's end inside; otherwise it is taken whole if
    at least half of it fits, so a source misses its target by half a document at most.
    """
    budget, size = F.floor("target"), F.col("source_size")
    full = F.when(size > 0, F.floor(budget / size)).otherwise(0)
    left = budget - full * size - F.col("before")
    if exact:
        last = F.greatest(F.lit(0), F.least(left, F.col("size")))
    else:
        last = F.when((left > 0) & (left * 2 >= F.col("size")), F.col("size")).otherwise(0)
    return (full * F.col("size") + last).cast("long")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, exact: bool = True
) -> DataFrame:
    """``doc_id, source, tkey, size, source_size, target, taken``, a row per document."""
    return placed(docs, weights, share).withColumn("taken", taken(exact)).drop("before")


def mixed_rows(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE
) -> DataFrame:
    """The mix itself: each document as often as it is taken, always whole.

    Columns are those of ``docs``.  Documents without words are never taken.  Rows of one doc_id, source
    and text share what all of them are taken, each as often as another or once more.
    """
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    chosen = written(
        mix_sources(docs, weights, share, exact=False)
        .groupBy("doc_id", "source", "tkey")
        .agg(F.sum(times).alias("_all"), F.count("*").alias("_equal"))
        .filter("_all > 0")
        .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("tkey").alias("_t"), "_all", "_equal"),
        "mix-chosen",
    )
    keyed = boxed(
        docs, doc_id=F.col("doc_id"), source=F.col("source"), key=F.md5(F.coalesce("text", F.lit("")))
    )
    rows = keyed.join(
        chosen,
        F.col("doc_id").eqNullSafe(F.col("_d"))
        & F.col("source").eqNullSafe(F.col("_s"))
        & (F.col("key") == F.col("_t")),
    )
    taken_rows = rows.filter("_equal = 1").select("row", F.col("_all").alias("_times"))
    if not chosen.filter("_equal > 1").isEmpty():
        equal = written(
            rows.filter("_equal > 1").select(
                "row", "_all", "_equal", F.monotonically_increasing_id().alias("_id"),
                F.xxhash64("doc_id", "source", "key").alias("_group"),
            ),
            "mix-equal",
        )
        numbered = with_running(equal, "_group", ["_id"], {"_pos": F.lit(1)})
        more = (F.col("_pos") < F.col("_all") % F.col("_equal")).cast("long")
        taken_rows = taken_rows.unionByName(
            numbered.select("row", (F.expr("_all div _equal") + more).alias("_times")).filter("_times > 0")
        )
    return unboxed(taken_rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))))
