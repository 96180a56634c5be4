"""The registered queries of the operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbar.llm import content_sort, disclosure, divergence, language, lexical, line_dedup, mixing, ngram_join, phrases, sharding, templates, toxicity, warc
from inkbar.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    archive = warc.write(spark.read.parquet(f"{sf}/pages.parquet"))
    return warc.read_back(archive, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.repeated_lines(_docs(spark, sf))
    spelled = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["first"], x["last"])), ",")
    return found.select(
        "doc.doc_id", "n_lines", "removed_lines", "removed_words", spelled.alias("removed")
    )


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_join(_docs(spark, sf)).select(
        "doc_id", "class_id", "copy_of", "n_links"
    )


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return content_sort.content_groups(_docs(spark, sf))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return templates.decontaminate(
        _docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    )


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "text")
    return sharding.place(docs).select("doc_id", "shard")


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    found = disclosure.detect(_docs(spark, sf))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "extra"))
    return found.select(
        "doc_id",
        of(0).alias("n_email"),
        of(1).alias("n_ip"),
        of(2).alias("n_card"),
        of(3).alias("n_phone"),
        F.sha2(disclosure.spelled(F.col("base")), 256).alias("base_sha256"),
        disclosure.spelled(every).alias("spans"),
    )


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_docs(spark, sf))


def op11_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.with_neighbours(_docs(spark, sf))


def op12_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf))


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(lexical.build(_docs(spark, sf)), spark.read.parquet(f"{sf}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_disclosure": op9_disclosure,
    "op10_language_id": op10_language_id,
    "op11_fingerprint": op11_fingerprint,
    "op12_divergence": op12_divergence,
    "op13_lexical_search": op13_lexical_search,
}
