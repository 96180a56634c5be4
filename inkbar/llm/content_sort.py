"""Exact duplicates by sorting content.

Texts are normalised by deleting ASCII white space and range-partitioned on their
normalised content: sampled splitters over (first ``LEAD`` characters, sha-256 of all, length of
the original, doc_id).  The leading characters and the digest order whole texts
without sampling them, and length and id cut a group of copies that is larger than
a partition.  Each partition is sorted externally by the same key, so equals stand
side by side, and each row is compared in full with its neighbour.  A run's first row
is the one that stays.

A group cut by a partition boundary shows as a run at the edge of both partitions.
Those runs, two for each partition at most, are merged and handed back; nothing else crosses
partitions, and no group is ever gathered.

Defined cases: null texts count as empty, and all texts without other characters
are equal.  A null doc_id sorts last among rows of the same length.  Of repeated rows one is kept.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.plans.scratch import written

LEAD = 32
_FIELDS = [
    ("doc_id", pa.int64()),
    ("text_sha256", pa.string()),
    ("keep_id", pa.int64()),
    ("length", pa.int64()),
    ("n", pa.int64()),
    ("head", pa.bool_()),
    ("edge", pa.bool_()),
    ("part", pa.int64()),
]
_SCHEMA = pa.schema(_FIELDS)


def normalised(text: Column) -> Column:
    """``text`` without the six ASCII white-space characters; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in " \n\r\t\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _runs(batches):
    """Runs of equal neighbours in a sorted partition; ids only are held of a run."""
    content, sha, keep, length, part = None, None, None, None, 0
    ids: list[np.ndarray] = []
    first_run = True

    def close(last: bool) -> pa.RecordBatch:
        every = pa.concat_arrays(ids)
        n = len(every)
        heads = np.zeros(n, dtype=bool)
        heads[0] = True
        same = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(n, np.int64)))
        return pa.RecordBatch.from_arrays(
            [
                every, same(sha, pa.string()), same(keep, pa.int64()), same(length, pa.int64()),
                same(n, pa.int64()), pa.array(heads), same(first_run or last, pa.bool_()),
                same(part, pa.int64()),
            ],
            schema=_SCHEMA,
        )

    pending: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("content").cast(pa.large_binary()).to_pylist()
        shas = batch.column("text_sha256").to_pylist()
        lengths = batch.column("length").to_pylist()
        doc_ids = batch.column("doc_id")
        start = 0
        for i, text in enumerate(texts):
            if text == content:
                continue
            if i > start:
                ids.append(doc_ids.slice(start, i - start))
            if content is not None:
                pending.append(close(False))
                size += pending[-1].num_rows
                ids, first_run = [], False
            content, sha, length, start = text, shas[i], lengths[i], i
            keep, part = doc_ids[i].as_py(), batch.column("part")[i].as_py()
        ids.append(doc_ids.slice(start))
        if size > 4096:
            yield from pa.Table.from_batches(pending).combine_chunks().to_batches()
            pending, size = [], 0
    if content is not None:
        pending.append(close(True))
        yield from pa.Table.from_batches(pending).combine_chunks().to_batches()


def content_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, a row for each row of docs."""
    content = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(F.col(text)).alias("content"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("length"),
    ).withColumn("text_sha256", F.sha2("content", 256))
    key = [
        F.left("content", F.lit(LEAD)), F.col("text_sha256"), F.desc("length"),
        F.asc_nulls_last("doc_id"),
    ]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        content.repartitionByRange(n, *key)
        .sortWithinPartitions(*key)
        .withColumn("part", F.spark_partition_id().cast("long"))
    )
    rows = written(
        ordered.mapInArrow(
            _runs,
            "doc_id long, text_sha256 string, keep_id long, length long, n long, head boolean, "
            "edge boolean, part long",
        ),
        "content-runs",
    )
    # runs at the edges of partitions: one row for each, two for each partition at most
    best = F.struct((-F.col("length")).alias("l"), F.col("keep_id").isNull().alias("none"), "keep_id", "part")
    merged = (
        rows.filter("edge and head")
        .groupBy(F.col("text_sha256").alias("sha"))
        .agg(F.min(best).alias("best"), F.sum("n").alias("size"))
        .select("sha", F.col("best.keep_id").alias("best_id"), F.col("best.part").alias("best_part"), "size")
    )
    return rows.join(
        F.broadcast(merged), F.col("edge") & (F.col("text_sha256") == F.col("sha")), "left"
    ).select(
        "doc_id",
        F.when(F.col("sha").isNull(), F.col("keep_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", "n").alias("group_size"),
        (F.col("head") & (F.col("sha").isNull() | (F.col("part") == F.col("best_part")))).alias("kept"),
        "text_sha256",
    )
