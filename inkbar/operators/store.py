"""Results that outlive a job: a text is scored once, however many runs ask for it.

The store is a folder with a table of ``fp, spans``, bucketed and sorted by fingerprint, and a
Bloom filter for each bucket and run.  A run deals its distinct fingerprints to the buckets, reads
each bucket's filters beside them and asks the table only for those that may be there.  That join
takes the table's buckets as they lie: the store is never shuffled.  Texts that are not
found are scored and appended, filters first, so a run that breaks off costs at most scoring them again.

Defined cases.  A store of an empty or missing folder is empty.  Its number of buckets is
fixed when it is made; a later session finds it in the folder.  Runs follow one another; where two
append at once, a fingerprint may stand twice, which changes no result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions.spans import no_spans
from inkbar.operators.dedup import fingerprints, first_requests
from inkbar.operators.skew import join_hot
from inkbar.plans.scratch import written

BUCKETS = 64
BITS = 12  # of a filter, for each fingerprint
HASHES = 6
_ASKED = "fp string, first_id long, n long, maybe boolean"
_FILTERS = "bucket int, run string, bits binary"


def _places(fp: pa.Array, size: int) -> np.ndarray:
    """(fingerprint, hash) -> place in a filter of ``size`` bits; fingerprints are hexadecimal digests."""
    digits = b"".join(x[:32].encode() for x in fp.to_pylist())
    halves = np.frombuffer(bytes.fromhex(digits.decode()), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _filter_of(table: pa.Table) -> pa.Table:
    """One run's filter of a bucket."""
    size = max(64, 8 * -(-table.num_rows * BITS // 8))
    bits = np.zeros(size, dtype=bool)
    bits[_places(table.column("fp").combine_chunks(), size).ravel()] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "bits": pa.array([packed], pa.binary())})


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of a bucket, told by the filters that come before them."""
    filters: list[np.ndarray] = []
    for batch in batches:
        for bits in batch.column("bits").drop_null().to_pylist():
            filters.append(np.frombuffer(bits, dtype=np.uint8))
        asked = batch.filter(batch.column("fp").is_valid())
        if not asked.num_rows:
            continue
        maybe = np.zeros(asked.num_rows, dtype=bool)
        for bits in filters:
            at = _places(asked.column("fp"), 8 * len(bits))
            maybe |= ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
        yield asked.select(["fp", "first_id", "n"]).append_column("maybe", pa.array(maybe))


class ResultStore:
    """Spans by fingerprint in ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        layout = f"{self.path}/layout"
        try:
            self.buckets = spark.read.schema("buckets int").parquet(layout).first()["buckets"]
        except AnalysisException:
            self.buckets = buckets
            spark.createDataFrame([(buckets,)], "buckets int").write.parquet(layout)
            spark.createDataFrame([], _FILTERS).write.parquet(f"{self.path}/filters")
        self.name = f"inkbar_store_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (fp STRING, spans {S.SPANS_DDL}) USING parquet "
            f"CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/results'"
        )

    def results(self) -> DataFrame:
        return self.spark.table(self.name)

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.hash("fp"), F.lit(self.buckets)).cast("int"))

    def ask(self, firsts: DataFrame) -> DataFrame:
        """``fp, first_id, n`` with ``maybe``: whether a filter admits the fingerprint."""
        filters = self.spark.read.schema(_FILTERS).parquet(f"{self.path}/filters").select("bucket", "bits")
        both = filters.unionByName(
            self._bucket(firsts.select("fp", "first_id", "n")), allowMissingColumns=True
        )
        return (
            both.repartitionById(self.buckets, "bucket")
            .sortWithinPartitions(F.col("fp").isNotNull())
            .select("bits", "fp", "first_id", "n")
            .mapInArrow(_tested, _ASKED)
        )

    def find(self, asked: DataFrame) -> DataFrame:
        """``fp, spans`` of the fingerprints that are in the store."""
        wanted = asked.filter("maybe").select("fp").repartition(self.buckets, "fp")
        return wanted.join(self.results().hint("merge"), "fp").dropDuplicates(["fp"])

    def append(self, scored: DataFrame) -> None:
        """Add ``fp, spans``; the fingerprints must not be in the store."""
        run = uuid.uuid4().hex
        filters = (
            self._bucket(scored.select("fp")).groupBy("bucket").applyInArrow(_filter_of, "bucket int, bits binary")
        )
        filters.select("bucket", F.lit(run).alias("run"), "bits").write.mode("append").parquet(f"{self.path}/filters")
        scored.select("fp", "spans").repartition(self.buckets, "fp").write.insertInto(self.name)


def detect_across_runs(
    requests: DataFrame, detect: Callable[[DataFrame], DataFrame], store: ResultStore
) -> DataFrame:
    """``req_id, fp, spans, cached`` as in one run over this and all earlier requests to the store.

    ``detect`` adds a ``spans`` column to the first request of each fingerprint that
    the store lacks; what it gives is in the store when this returns.
    """
    keys = fingerprints(requests)
    asked = written(store.ask(first_requests(keys)), "store-asked")
    seen = written(store.find(asked), "store-seen")
    fresh = asked.join(seen.select("fp"), "fp", "left_anti")
    wanted = fresh.select(F.col("first_id").alias("req_id"), "fp")
    scored = written(detect(requests.join(wanted, "req_id")).select("fp", "spans"), "store-scored")
    store.append(scored)
    firsts = scored.select("fp").join(asked, "fp").select(F.col("first_id").alias("req_id"), F.lit(False).alias("_repeat"))
    marks = keys.join(firsts, "req_id", "left").select("req_id", "fp", F.coalesce("_repeat", F.lit(True)).alias("cached"))
    found = seen.unionByName(scored).filter(F.size("spans") > 0)
    return join_hot(marks, found, "fp", "req_id", asked.select("fp", "n")).select(
        "req_id", "fp", F.coalesce("spans", no_spans()).alias("spans"), "cached"
    )
