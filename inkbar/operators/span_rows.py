"""Span algebra on long span tables, for any number of spans per document.

The array forms in ``functions.spans`` hold one document's spans in one row.  The
forms here never do that and never pair spans with each other: overlaps are
counted from running totals, choices between spans (``operators.choices``) gather no island, and what
is only needed for redaction is reduced to at most a few spans per text position
before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkbar.functions.spans import filter_min_score, filter_min_score_final
from inkbar.operators import choices
from inkbar.operators.ordered import with_running
from inkbar.operators.skew import LANE_ROWS, hot_share
from inkbar.plans.scratch import written

# Documents are counted by so many hashes, so that no row for each of them is shuffled.
HASHES = 1 << 16
# Stands for a missing place, which comes before all others.
NOWHERE = np.iinfo(np.int64).min


def overlap_counts(
    candidates: DataFrame, existing: DataFrame, key: str = "doc_id", out: str = "n_overlaps"
) -> DataFrame:
    """Candidates plus the number of existing spans each of them overlaps.

    An existing span overlaps a candidate if it starts before the candidate's end
    and does not end at or before its start, so the number is a difference of two
    running counts along the document.  Two empty spans never overlap, so an empty
    candidate counts spans that are not empty only.  Each start, end and question is a
    row of its own: no place and no document is gathered.
    """
    filled = F.col("end") > F.col("start")

    def event(at: str, turn: int, s: Column, e: Column, sign: int) -> Column:
        return F.struct(
            F.col(at).alias("at"), F.lit(turn).alias("turn"), s.cast("long").alias("s"), e.cast("long").alias("e"),
            (s * filled.cast("int")).cast("long").alias("fs"), (e * filled.cast("int")).cast("long").alias("fe"),
            F.lit(sign).alias("sign"),
        )

    # a candidate's end asks before the starts of its place count, its start after the ends do
    none, one = F.lit(0), F.lit(1)
    marks = existing.select(
        key, F.inline(F.array(event("start", 1, one, none, 0), event("end", 1, none, one, 0)))
    )
    asked = candidates.select(
        key, F.struct(*candidates.columns).alias("row"), F.monotonically_increasing_id().alias("id"),
        F.array(event("end", 0, none, none, 1), event("start", 2, none, none, -1)).alias("events"),
    ).select(key, "row", "id", F.inline("events"))
    events = asked.unionByName(marks, allowMissingColumns=True)
    told = with_running(
        events, key, ["at", "turn", "id"],
        {"starts": F.col("s"), "ends": F.col("e"), "filled_starts": F.col("fs"), "filled_ends": F.col("fe")},
    ).filter("sign <> 0")
    of = F.when(
        F.col("row.end") > F.col("row.start"), F.when(F.col("sign") > 0, F.col("starts")).otherwise(-F.col("ends"))
    ).otherwise(F.when(F.col("sign") > 0, F.col("filled_starts")).otherwise(-F.col("filled_ends")))
    counted = told.groupBy("id").agg(F.first("row").alias("row"), F.sum(of).alias(out))
    return counted.select("row.*", out)


def _places(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.cast(batch.column(name), pa.int64()), NOWHERE))


def _partners(start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each span how many of its document's spans overlap it, from totals along the documents.

    Ends come before the starts of their place.  A span's end tells the starts before it, its start
    the ends up to it; what earlier documents add to both is equal.
    """
    n, filled = len(start), (end > start) & (start > NOWHERE)
    turn = np.repeat(np.array([0, 1], np.int8), n)
    order = np.lexsort((turn, np.concatenate((end, start)), np.concatenate((code, code))))
    place = np.empty(2 * n, np.int64)
    place[order] = np.arange(2 * n)
    starts = order >= n

    def told(counted: np.ndarray) -> np.ndarray:
        counted = counted[order % n]
        return np.cumsum(counted & starts)[place[:n]] - np.cumsum(counted & ~starts)[place[n:]]

    if filled.all():
        return told(filled) - 1
    # two empty spans never overlap
    return np.where(filled, told(np.ones(n, bool)) - 1, told(filled))


def _count_whole(key: str, out: str) -> Callable:
    """Batches in order of ``key`` with the count; a document that goes on in the next batch waits for it."""

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code = np.asarray(table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices)
        n = pa.array(_partners(_places(table, "start"), _places(table, "end"), code), pa.int64())
        missing = pc.or_(pc.is_null(table.column("start")), pc.is_null(table.column("end")))
        yield from table.append_column(out, pc.if_else(missing, pa.scalar(None, pa.int64()), n)).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = choices._Keys(key), []
        for batch in batches:
            if not batch.num_rows:
                continue
            begun = np.flatnonzero(keys.new(batch))
            if len(begun):
                yield from counted(pa.Table.from_batches([*held, batch.slice(0, begun[-1])]))
                held, batch = [], batch.slice(begun[-1])
            held.append(batch)
        if held:
            yield from counted(pa.Table.from_batches(held))

    return count


def _hot_overlap_pairs(spans: DataFrame, key: str, out: str) -> DataFrame:
    """``span_overlap_pairs`` for documents of any size, as rows of starts and ends; no document is gathered."""
    filled = F.col("end") > F.col("start")
    asked = spans.select(
        key, F.struct(*spans.columns).alias("row"), filled.alias("filled"), F.monotonically_increasing_id().alias("id")
    )
    nothing = F.lit(None).cast(asked.schema["row"].dataType)

    def event(at: str, turn: int, row: Column) -> Column:
        return F.struct(F.col(f"row.{at}").alias("at"), F.lit(turn).alias("turn"), row.alias("row"))

    # an end asks before the starts of its place count, a start after the ends do
    ends, starts = event("end", 0, nothing), event("start", 1, F.col("row"))
    events = asked.select(key, "filled", "id", F.inline(F.array(ends, starts)))
    start, counts = F.col("turn").cast("long"), F.col("filled").cast("long")
    told = with_running(
        events, key, ["at", "turn", "id"],
        {"starts": start, "ends": 1 - start, "filled_starts": start * counts, "filled_ends": (1 - start) * counts},
    )
    at_end = F.col("turn") == 0
    of = F.when(F.col("filled"), F.when(at_end, F.col("starts")).otherwise(-F.col("ends"))).otherwise(
        F.when(at_end, F.col("filled_starts")).otherwise(-F.col("filled_ends"))
    )
    counted = told.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.sum(of).alias(out))
    return counted.select("row.*", (F.col(out) - (F.col("row.end") > F.col("row.start")).cast("long")).alias(out))


def span_overlap_pairs(
    spans: DataFrame, key: str = "doc_id", out: str = "n_partners"
) -> DataFrame:
    """Each span with the number of other spans of its document it overlaps.

    The pairs themselves are never formed.  Rows are shuffled once, by document, and counted as they come in
    its order.  A document with more than a ``hot_share`` of all rows would be too much for a task: it, and what
    has its hash, is counted from rows of starts and ends.
    """
    hashed = F.pmod(F.xxhash64(key), F.lit(HASHES))
    counts = written(spans.groupBy(hashed.alias("_hash")).agg(F.count("*").alias("n")), "span-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("n") * hot_share(total) > total).select("_hash")
    any_hot = not hot.isEmpty()

    def of(how: str) -> DataFrame:
        return spans.join(F.broadcast(hot), hashed == F.col("_hash"), how) if any_hot else spans

    parts = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // LANE_ROWS))
    schema = T.StructType([*spans.schema.fields, T.StructField(out, T.LongType())])
    whole = of("left_anti").repartition(parts, key).sortWithinPartitions(key).mapInArrow(_count_whole(key, out), schema)
    return whole.unionByName(_hot_overlap_pairs(of("left_semi"), key, out)) if any_hot else whole


def scored(spans: DataFrame, min_score: Column, final: bool = False) -> DataFrame:
    """The score gates on span rows: those before the rules, or the ``final`` one after them."""
    one = F.array(F.struct(F.col("score")))
    gate = filter_min_score_final if final else filter_min_score
    return spans.filter(F.size(gate(one, min_score)) > 0)


def numbered(
    spans: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("start", "ord")
) -> DataFrame:
    """Span rows with ``pos``, their place in the document's list, from 0."""
    return with_running(spans, key, list(order), {"pos": F.lit(1)}).withColumn(
        "pos", F.col("pos").cast("int")
    )


def merge_rows(
    existing: DataFrame, additions: DataFrame, key: str = "doc_id", order: str = "ord"
) -> DataFrame:
    """Both span tables in one, numbered by start; existing ones first where starts are equal."""
    both = existing.withColumn("added", F.lit(0)).unionByName(
        additions.withColumn("added", F.lit(1)), allowMissingColumns=True
    )
    return numbered(both, key, ("start", "added", order)).drop("added")


def sweep_rows(spans: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Spans that begin at or after the end of the last kept one, in order of start."""
    return choices.sweep(spans, key, order)


def resolve_rows(spans: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Spans that overlap none that was accepted before them in the order of ``order``."""
    return choices.resolve(spans, key, order)


def drop_overlapping_rows(
    candidates: DataFrame, existing: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Candidates that overlap no existing span of their document."""
    return overlap_counts(candidates, existing, key, "_n").filter("_n = 0").drop("_n")


def essential_spans(
    spans: DataFrame, key: str = "doc_id", order: str = "ord"
) -> DataFrame:
    """The spans that decide how a document is redacted, and no others.

    Of the spans that start at one position only the first non-empty one (and
    empty ones before it) can be drawn, and only the longest matters for whether
    a rule's match is covered.  Dropping the rest changes neither the redacted
    text nor the rules' additions, and leaves at most two non-empty spans per
    text position, so that the array per document is bounded by its text.
    """
    cols = spans.columns
    cell = F.struct(*[F.col(c) for c in cols])
    place = [key, "start"]
    wide = spans.filter(F.col("end") > F.col("start"))

    def pick(by: Column) -> Column:
        return F.min_by(cell, by)

    chosen = wide.groupBy(*place).agg(
        pick(F.col(order)).alias("first"),
        pick(F.struct(-F.col("end"), F.col(order))).alias("widest"),
    )
    kept = chosen.select(
        F.explode(F.array_distinct(F.array("first", "widest"))).alias("c")
    ).select("c.*")
    empty = spans.filter(F.col("end") == F.col("start"))
    first_at = chosen.select(*place, F.col(f"first.{order}").alias("_first"))
    drawn_empty = (
        empty.join(first_at, place, "left")
        .filter(F.col("_first").isNull() | (F.col(order) < F.col("_first")))
        .select(*cols)
    )
    return kept.unionByName(drawn_empty)
