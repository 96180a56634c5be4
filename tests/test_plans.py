"""What the physical plans must look like."""

import pytest
from pyspark.sql import functions as F

from inkbar.functions.redact import redact
from inkbar.operators import dedup
from inkbar.operators.detect import detect_pii, detect_regex_only, pii_spans
from inkbar.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(spark, df):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    """How often the rules are run: one of their patterns, once per scan."""
    return plan.count("AKIA[0-9A-Z]{16}")


@pytest.mark.parametrize(
    "name",
    [
        "detect_regex_only", "detect_regex_only_pages", "redact", "redact_response",
        "span_report", "span_report_empty", "entity_counts", "entities_present",
        "spans_by_entity", "span_total", "detect_distinct_once", "validate_options",
    ],
)
def test_rules_run_once_per_text(spark, name):
    assert scans(plan_of(spark, QUERIES[name](spark, SF))) == 1


def test_detection_and_redaction_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    done = detect_regex_only(docs).withColumn("redacted", redact(F.col("text"), F.col("spans")))
    plan = plan_of(spark, done.select("doc_id", "redacted"))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_file(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_of(spark, detect_regex_only(docs).filter("lang = 'en'").select("doc_id", "spans"))
    assert "EqualTo(lang,en)" in plan and scans(plan) == 1


def test_marks_are_made_without_the_text(spark):
    req = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as req_id", "text")
    plan = plan_of(spark, dedup.mark_cached(req))
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffles and "Window" not in plan
    # Only fingerprints and ids are exchanged; no row is ordered by fingerprint.
    assert "collect_list" not in plan


def test_existing_spans_do_not_double_the_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = docs.withColumn("m", F.array().cast("array<struct<entity:string,text:string,start:int,end:int,score:double>>"))
    out = detect_pii(df.withColumn("ru_postpass", F.lit(True)), model_spans="m")
    assert scans(plan_of(spark, out.select("doc_id", "spans"))) == 1
    by_row = pii_spans(F.col("text"), strict=F.col("doc_id") > 3).alias("spans")
    assert scans(plan_of(spark, docs.select(by_row))) == 1


@pytest.mark.parametrize(
    "name, most",
    [("detect_distinct_once", 8), ("redact_with_external_spans", 8), ("drop_overlapping_existing", 8)],
)
def test_shuffles_stay_few_without_broadcasts(spark, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= most and "ShuffledHashJoin" not in plan


def test_no_span_table_is_gathered_or_ordered_by_document_alone(spark):
    for name in ("sweep_non_overlapping", "resolve_overlaps", "explode_spans", "span_overlap_pairs", "merge_spans"):
        plan = plan_of(spark, QUERIES[name](spark, SF))
        # windows are by (partition, document) or, over one row per partition, by document
        for line in plan.split("\n"):
            if "windowspecdefinition(doc_id" in line:
                raise AssertionError(f"{name}: {line[:200]}")


def test_templates_use_all_cores_whatever_the_row_groups(spark, tmp_path):
    """A table in one row group is one task's, however the rows are worked on."""
    spark.read.parquet(f"{SF}/customer.parquet").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("detect_pii", "ru_postpass", "rules_strict", "rules_loose", "highlight_html"):
        rows = QUERIES[name](spark, str(tmp_path)).rdd.glom().map(len).collect()
        assert sum(n > 0 for n in rows) >= spark.sparkContext.defaultParallelism, name
