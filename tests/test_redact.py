"""Modes of redaction, rendering, span algebra."""

import pytest
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions import spans as A
from inkbar.functions.redact import highlight_html, human_bytes, redact, segment_text
from inkbar.sources import sinks


def row(spark, text, spans):
    return spark.createDataFrame([(text, spans)], f"text string, s {S.SPANS_DDL}")


def one(df, c):
    return df.select(c.alias("x")).first().x


CASE = ("Nora met Piet in Ghent", [("private_person", "Nora", 0, 4, 0.9), ("place", "Ghent", 17, 22, 0.8)])


def test_tag_placeholder_mask_and_precedence(spark):
    df, t, s = row(spark, *CASE), F.col("text"), F.col("s")
    assert one(df, redact(t, s)) == "[PRIVATE_PERSON] met Piet in [PLACE]"
    assert one(df, redact(t, s, "[X]")) == "[X] met Piet in [X]"
    assert one(df, redact(t, s, "")) == " met Piet in "
    assert one(df, redact(t, s, "[X]", "*")) == "**** met Piet in *****"


def test_overlapping_span_is_skipped(spark):
    df = row(spark, "ninebark", [("u", "", 0, 4, 0.9), ("v", "", 2, 6, 0.9), ("w", "", 6, 8, 0.9)])
    assert one(df, redact(F.col("text"), F.col("s"))) == "[U]ba[W]"


def test_bad_mask_is_refused_only_where_there_are_spans(spark):
    t, s = F.col("text"), F.col("s")
    assert one(row(spark, "abc", []), redact(t, s, mask_char="**")) == "abc"
    with pytest.raises(Exception, match="single character"):
        one(row(spark, *CASE), redact(t, s, mask_char="**"))


def test_segments_and_html(spark):
    df = row(spark, "a<b> & 'c'", [("x\"y", "b", 2, 3, 0.5)])
    t, s = F.col("text"), F.col("s")
    assert [tuple(g) for g in one(df, segment_text(t, s))] == [
        ("a<", None, None), ("b", 'x"y', 0.5), ("> & 'c'", None, None),
    ]
    assert one(df, highlight_html(t, s)) == (
        'a&lt;<span class="pii" data-entity="x&quot;y" title="x&quot;y (0.500)">b</span>'
        "&gt; &amp; &#39;c&#39;"
    )
    assert one(row(spark, "a<b", []), highlight_html(t, s)) == "a<b"
    assert one(row(spark, "", []), highlight_html(t, s)) == "(empty)"


def test_human_bytes(spark):
    df = spark.createDataFrame([(0,), (1023,), (1280,), (5 * 1024 * 1024,)], "n long")
    got = [r.x for r in df.select(human_bytes(F.col("n")).alias("x")).collect()]
    assert got == ["0 B", "1023 B", "1.3 KB", "5.0 MB"]


def test_merge_is_stable_and_resolve_is_greedy(spark):
    df = row(spark, "", [("a", "", 5, 9, 1.0), ("b", "", 0, 5, 1.0), ("c", "", 8, 10, 1.0)])
    more = F.array(A.span(F.lit("d"), F.lit(""), F.lit(5), F.lit(6), F.lit(1.0)))
    merged = one(df, A.merge_spans(F.col("s"), more))
    assert [s.entity for s in merged] == ["b", "a", "d", "c"]
    assert [s.entity for s in one(df, A.resolve_overlaps(F.col("s")))] == ["a", "b"]
    assert [s.entity for s in one(df, A.sweep_non_overlapping(F.col("s")))] == ["b", "a"]


def test_thresholds(spark):
    df = row(spark, "", [("a", "", 0, 1, 0.5), ("b", "", 1, 2, 0.95)])
    names = lambda c: [s.entity for s in one(df, c)]
    assert names(A.filter_min_score(F.col("s"), F.lit(0.5))) == ["a", "b"]
    assert names(A.filter_min_score(F.col("s"), F.lit(0.96))) == []
    assert names(A.filter_min_score_final(F.col("s"), F.lit(0.0))) == ["a", "b"]
    assert names(A.filter_min_score_final(F.col("s"), F.lit(0.6))) == ["b"]


def test_report_strips_every_blank(spark):
    df = row(spark, "x", [("a", "  q \x1f\n", 0, 6, 0.03125)]).selectExpr("1L as doc_id", "s as spans")
    r = sinks.span_report(df).first()
    assert (r.text, r.range, r.score) == ("q", "0-6", "0.0312")


def test_json_keeps_letters(spark):
    df = row(spark, "я", [])
    got = one(df, sinks.result_json(F.col("text"), F.lit("z"), F.col("s")))
    assert got == '{"input":"я","redacted":"z","spans":[]}'
