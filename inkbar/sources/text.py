"""Texts as tables: files, inline texts, requests, uploads, external spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkbar import schema as S
from inkbar.functions.redact import cut_spans
from inkbar.functions.spans import let, no_spans, span
from inkbar.operators.skew import join_hot
from inkbar.operators.validate import MALFORMED, file_checks, oversized_file, with_verdict

# The file endings accepted besides a text/* media type.
TEXT_ENDINGS = ("txt", "md", "log", "csv", "json", "html", "xml", "yml", "yaml")


def read_text_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One file is one document: ``doc_id`` is its path.  Line ends are kept."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


def read_inline_documents(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """A few named texts given by the caller."""
    return spark.createDataFrame(list(texts.items()), "name string, text string")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines with the declared schema; nothing is inferred.

    A line that is not JSON, or whose values have other types, is kept whole in the column
    ``malformed`` (null otherwise), which the request checks refuse.
    """
    schema = T.StructType([*S.REQUEST.fields, T.StructField(MALFORMED, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .json(path)
    )


def file_ending(path: Column) -> Column:
    """What follows the last dot, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_text_file(path: Column, media_type: Column | None = None) -> Column:
    by_ending = file_ending(path).isin(*TEXT_ENDINGS)
    if media_type is None:
        return by_ending
    return by_ending | F.coalesce(F.startswith(media_type, F.lit("text/")), F.lit(False))


def filter_text_files(df: DataFrame, media_type: str | None = None) -> DataFrame:
    return df.filter(
        is_text_file(F.col("path"), F.col(media_type) if media_type else None)
    )


def read_uploads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def ingest_binary_files(
    files: DataFrame, max_bytes: int = S.MAX_TEXT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Uploads (``path, length, content`` and options) to texts and rejects.

    The size test on ``length`` reaches the file source, so the bytes of an
    oversized file are not read; its reject row is made from ``length`` alone.
    """
    fits = with_verdict(files.filter(~oversized_file(F.col("length"), max_bytes)), file_checks(files, max_bytes))
    too_large = with_verdict(
        files.filter(oversized_file(F.col("length"), max_bytes)).drop("content"),
        [c for c in file_checks(files, max_bytes) if c.status != 400],
    )
    accepted = (
        fits.filter("status is null")
        .withColumn("text", F.col("content").cast("string"))
        .drop("content", "status", "reason")
    )
    rejected = fits.filter("status is not null").drop("content")
    return accepted, rejected.unionByName(too_large)


def span_is_valid(s: Column, text_length: Column) -> Column:
    return F.coalesce(
        (s.start >= 0) & (s.start <= s.end) & (s.end <= text_length) & ~F.isnan(s.score),
        F.lit(False),
    )


SPAN_BUCKET = 1024


def collect_spans(
    spans: DataFrame,
    key: str = "doc_id",
    order: str = "ord",
    out: str = "spans",
    by_start: bool = True,
) -> DataFrame:
    """Long span rows back to one array per document, sorted by start, then order.

    With ``by_start=False`` the order column alone decides.  Two levels: spans of
    one stretch of a document are gathered and sorted first, then the stretches are
    strung together.  A document with very many spans is thus spread over many
    tasks, and what the last step holds is the finished row.
    """
    cell = F.struct(
        (F.col("start") if by_start else F.lit(0)).cast("int").alias("k"),
        F.col(order).cast("long").alias("i"),
        span(F.col("entity"), F.col("text"), F.col("start"), F.col("end"), F.col("score")).alias("s"),
    )
    stretches = (
        spans.withColumn("_stretch", F.floor(F.col("start") / SPAN_BUCKET).cast("int"))
        .groupBy(key, "_stretch")
        .agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    )
    strung = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_stretch", "_cells"))), lambda b: b["_cells"]
        )
    )
    if not by_start:
        strung = F.array_sort(strung)
    return (
        stretches.groupBy(key)
        .agg(strung.alias("_all"))
        .select(key, F.transform("_all", lambda c: c.s).alias(out))
    )


def attach_external_spans(
    docs: DataFrame, spans: DataFrame, key: str = "doc_id", out: str = "spans"
) -> DataFrame:
    """Give each document the spans a caller supplies; none becomes an empty array.

    Spans that do not lie inside their text are left out here and returned by
    ``reject_external_spans``.  The span's text is cut from the document.
    """
    collected = collect_spans(spans, key, out="_external")
    joined = docs.join(collected, key, "left")

    def cleaned(text: Column, external: Column) -> Column:
        valid = let(
            F.length(text),
            lambda n: F.filter(external, lambda s: span_is_valid(s, n)),
        )
        return cut_spans(text, valid)

    return joined.withColumn(
        out,
        F.when(F.col("_external").isNull() | F.col("text").isNull(), no_spans()).otherwise(
            cleaned(F.col("text"), F.col("_external"))
        ),
    ).drop("_external")


def with_text_length(
    docs: DataFrame, spans: DataFrame, key: str = "doc_id", order: str = "ord"
) -> DataFrame:
    """Span rows plus ``_n``, the length of their document; null without one.

    Only the length of each text takes part in the join, not the text, and a
    document that holds a large share of the spans is split over many tasks.
    """
    lengths = docs.select(key, F.coalesce(F.length("text"), F.lit(-1)).alias("_n"))
    return join_hot(spans, lengths, key, order)


def reject_external_spans(
    docs: DataFrame, spans: DataFrame, key: str = "doc_id", order: str = "ord"
) -> DataFrame:
    """Supplied spans that do not lie inside their document, with a reason."""
    inside = span_is_valid(
        F.struct(F.col("start"), F.col("end"), F.col("score").cast("double").alias("score")),
        F.col("_n"),
    )
    return (
        with_text_length(docs, spans, key, order)
        .filter(~inside)
        .withColumn("status", F.lit(422))
        .withColumn(
            "reason",
            F.when(F.col("_n").isNull(), "no such document").otherwise(
                "span does not lie inside the text"
            ),
        )
        .drop("_n")
    )
