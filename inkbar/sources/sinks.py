"""Result shapes and writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.functions.rules import BLANK
from inkbar.functions.spans import explode_spans, no_spans

NO_HITS = "No PII detected"
SHELVES = 512  # folders of a table of files


def _model(name: str | Column) -> Column:
    return (name if isinstance(name, Column) else F.lit(name)).alias("model")


def _cached(df: DataFrame) -> Column:
    known = F.col("cached") if "cached" in df.columns else F.lit(False)
    return known.alias("cached")


def detect_response(df: DataFrame, model: str, key: str = "req_id") -> DataFrame:
    return df.select(key, _model(model), "spans", _cached(df))


def redact_response(df: DataFrame, model: str, key: str = "req_id") -> DataFrame:
    return df.select(key, _model(model), "redacted", "spans", _cached(df))


def result_json(text: Column, redacted: Column, spans: Column) -> Column:
    """One JSON object per row; letters outside ASCII are kept as they are."""
    return F.to_json(
        F.struct(text.alias("input"), redacted.alias("redacted"), spans.alias("spans")),
        {"ignoreNullFields": "false"},
    )


def suite_json(name: Column, text: Column, redacted: Column, spans: Column) -> Column:
    return F.to_json(
        F.struct(
            name.alias("name"),
            text.alias("input"),
            redacted.alias("redacted"),
            spans.alias("spans"),
        ),
        {"ignoreNullFields": "false"},
    )


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(
        text, F.lit(f"^[{BLANK}]++|(?<![{BLANK}])[{BLANK}]++\\z"), F.lit("")
    )


def span_report(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One printable row per span."""
    return explode_spans(df, key).select(
        key,
        "pos",
        "entity",
        strip(F.col("text")).alias("text"),
        F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias(
            "range"
        ),
        F.format_string("%.4f", F.bround("score", 4)).alias("score"),
    )


def span_report_empty(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """As ``span_report``, with one row for a document without spans."""
    rows = df.select(key, F.posexplode_outer("spans").alias("pos", "s"))
    return rows.select(
        key,
        "pos",
        F.coalesce("s.entity", F.lit(NO_HITS)).alias("entity"),
        strip(F.col("s.text")).alias("text"),
        F.when(
            F.col("s").isNotNull(),
            F.concat_ws("-", F.col("s.start").cast("string"), F.col("s.end").cast("string")),
        ).alias("range"),
        F.when(F.col("s").isNotNull(), F.format_string("%.4f", F.bround("s.score", 4))).alias("score"),
    )


def span_count_per_doc(spans: Column) -> Column:
    return F.size(F.coalesce(spans, no_spans()))


def redacted_text_sink(df: DataFrame, path: str, as_text: bool = False) -> None:
    """Write the redacted text only.

    A text file holds one line per line, so a document with line ends is no
    longer one record there; parquet keeps documents apart.
    """
    only = df.select("redacted")
    if as_text:
        only.write.mode("errorifexists").text(path)
    else:
        only.write.mode("errorifexists").parquet(path)


def result_json_sink(df: DataFrame, path: str) -> None:
    """Write one JSON object per document."""
    df.select(F.col("text").alias("input"), "redacted", "spans").write.mode(
        "errorifexists"
    ).option("ignoreNullFields", "false").json(path)


def files_by_key(df: DataFrame, key: str, path: str) -> None:
    """A text file for each value of ``key``, ``<path>/shelf=<n>/<key>=<value>.txt``.

    It holds the key's ``value`` rows as lines; a null one is an empty line, and a null key is named as Spark
    names its partition.  ``path`` is below a folder all executors share.  Spark's writer gives a file a
    folder of its own, starts two processes to set its permissions, and lets the driver move it;
    here a task writes its folders' files, each under a hidden name until it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("shelf", "key", "value"))))
        written, made = 0, None
        for (shelf, name), lines in groupby(rows, lambda row: row[:2]):
            folder = f"{base}/shelf={shelf}"
            if shelf != made:
                files.create_dir(folder, recursive=True)
                made = shelf
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(hidden) as out:
                for line in lines:
                    out.write(f"{line[2] or ''}\n".encode())
            files.move(hidden, f"{folder}/{key}={name}.txt")
            written += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    shelved = df.select(
        F.pmod(F.xxhash64(key), F.lit(SHELVES)).alias("shelf"),
        F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("key"),
        F.col("value").cast("string").alias("value"),
    )
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    dealt = shelved.repartition(tasks, "shelf").sortWithinPartitions("shelf", "key")
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()
