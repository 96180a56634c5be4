"""Redaction stretch by stretch against the redaction of whole rows."""

import random

import pytest
from pyspark.sql import functions as F

from inkbar.operators import stretches
from inkbar.plans.job import redact_with_external_spans

SPANS = "doc_id long, entity string, start int, end int, score double, ord long"


def tables(spark):
    rnd = random.Random(6)
    docs = [(i, "".join(rnd.choice("aя\U0001f600 \n[") for _ in range(n))) for i, n in enumerate([0, 1, 16, 17, 31, 32, 33, 160, 500, 2000])]
    docs += [(20, None), (21, ""), (22, "no spans at all " * 5)]
    rows = []
    for i, text in docs[:-1]:
        n = len(text or "")
        for _ in range(n // 3 + 3):
            a = rnd.randint(-1, n)
            rows.append((i, rnd.choice(["e", "f_g"]), a, a + rnd.choice([0, 0, 1, 3, 5, 16, 40, 200]), rnd.choice([0.5, float("nan")]), len(rows)))
    rows += [(9, "e", 100, 1900, 0.5, -1), (6, "e", 33, 33, 0.5, -2), (5, "e", 32, 32, 0.5, -3)]
    spans = spark.createDataFrame(rows, SPANS).withColumn("text", F.lit(None).cast("string"))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spans


@pytest.mark.parametrize("options", [{}, {"placeholder": ""}, {"placeholder": "<x>"}, {"mask_char": "*"}, {"mask_char": "\U0001f600", "placeholder": "y"}])
def test_parts_strung_together_equal_whole_texts(spark, options):
    docs, spans = tables(spark)
    whole = {r.doc_id: r.redacted for r in redact_with_external_spans(docs, spans, **options).collect()}
    parts = stretches.redact_in_stretches(docs, spans, size=16, **options)
    got = {r.doc_id: r.redacted for r in stretches.strung(parts).collect()}
    assert got == whole


def test_stretches_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "x\U0001f600" * 50), (2, ""), (3, None)], "doc_id long, text string")
    rows = stretches.text_stretches(docs, size=8).collect()
    assert sorted(len(r.part) for r in rows if r.doc_id == 1) == [4, *[8] * 12]
    assert [(r.pos, r.part) for r in rows if r.doc_id > 1] == [(0, ""), (0, None)]


def test_a_document_with_very_many_spans(spark):
    """A hot document of 200,000 spans: no array holds more than its stretch's."""
    n = 200_000
    docs = spark.createDataFrame([(1, "ab " * n)], "doc_id long, text string")
    spans = spark.range(n).selectExpr("1L as doc_id", "'e' as entity", "cast(3 * id as int) as start", "cast(3 * id + 2 as int) as end", "0.5D as score", "id as ord", "'' as text")
    parts = stretches.redact_in_stretches(docs, spans, placeholder="_")
    told = parts.agg(F.count("*").alias("n"), F.max(F.length("redacted")).alias("most"), F.sum(F.length("redacted")).alias("all")).first()
    assert told["n"] == -(-3 * n // stretches.SIZE) and told["all"] == 2 * n and told["most"] <= stretches.SIZE
    assert stretches.strung(parts).first()["redacted"] == "_ " * n
