"""One query per operator, over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions import redact as R
from inkbar.functions import spans as A
from inkbar.functions.keys import detect_fingerprint
from inkbar.functions.rules import PART_RULES, make_rule
from inkbar.functions.sql import register_sql_functions
from inkbar.operators import dedup, metrics, span_rows, store
from inkbar.operators import validate as V
from inkbar.operators.detect import detect_part, detect_pii, detect_regex_only, pii_spans
from inkbar.operators.long_texts import detect_long
from inkbar.operators.model import detect_batch, detect_one, normalize_raw_spans
from inkbar.operators.rulebook import detect_with_rulebook
from inkbar.operators.stretches import redact_in_stretches, strung
from inkbar.operators.verdicts import split_requests
from inkbar.plans.job import (
    redact_per_row_options,
    redact_uploads,
    redact_with_external_spans,
    run,
    serve_requests,
)
from inkbar.plans.scratch import scratch_path
from inkbar.plans.templates import TEMPLATES
from inkbar.sources import sinks, text as sources
from inkbar.streaming import recent as recents
from inkbar.streaming import stream as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a source of few splits; leave a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents", "doc_id", "text"))


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows with much work on each, dealt over all cores.

    However many splits a file has, its rows may lie in a few row groups, and each is one task's.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * cores, df.rdd.getNumPartitions()))


def template(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, key, text = TEMPLATES[name]
    return dealt(table(spark, sf, source)).selectExpr(f"{key} as doc_id", f"{text} as text")


def spans_long(df: DataFrame, spans: Column, key: str = "doc_id") -> DataFrame:
    return A.explode_spans(df, key, spans)


# -- detectors -------------------------------------------------------------
def _detector(name: str) -> Query:
    def run_one(spark: SparkSession, sf: str) -> DataFrame:
        return spans_long(template(spark, sf, name), detect_part(F.col("text"), name))

    return run_one


for _name in PART_RULES:
    if _name in TEMPLATES:
        QUERIES[f"detect_{_name}"] = _detector(_name)


def _detector_on_documents(name: str) -> Query:
    def run_one(spark: SparkSession, sf: str) -> DataFrame:
        return spans_long(documents(spark, sf), detect_part(F.col("text"), name))

    return run_one


for _name in ("email", "card_plain", "date_numeric", "url_bare_host"):
    QUERIES[f"detect_{_name}_documents"] = _detector_on_documents(_name)


@query("rules_loose")
def _rules_loose(spark, sf):
    return spans_long(template(spark, sf, "form"), pii_spans(F.col("text")))


@query("rules_strict")
def _rules_strict(spark, sf):
    return spans_long(template(spark, sf, "form"), pii_spans(F.col("text"), strict=True))


@query("detect_regex_only")
def _detect_regex_only(spark, sf):
    return spans_long(detect_regex_only(documents(spark, sf)), F.col("spans"))


@query("detect_regex_only_pages")
def _detect_regex_only_pages(spark, sf):
    pages = spread(table(spark, sf, "pages", "page_id", "html")).select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text")
    )
    found = A.explode_spans(detect_regex_only(pages))
    return found.groupBy("entity").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars")
    )


# -- redaction -------------------------------------------------------------
@query("redact_tag")
def _redact_tag(spark, sf):
    docs = documents(spark, sf)
    return docs.select(
        "doc_id", R.redact(F.col("text"), detect_part(F.col("text"), "email")).alias("redacted")
    )


@query("redact_placeholder")
def _redact_placeholder(spark, sf):
    docs = documents(spark, sf)
    spans = detect_part(F.col("text"), "email")
    return docs.select("doc_id", R.redact(F.col("text"), spans, "[X]").alias("redacted"))


@query("redact_mask")
def _redact_mask(spark, sf):
    docs = documents(spark, sf)
    spans = detect_part(F.col("text"), "card_plain")
    return docs.select(
        "doc_id", R.redact(F.col("text"), spans, "[X]", "*").alias("redacted")
    )


@query("redact")
def _redact(spark, sf):
    done = run(documents(spark, sf), V.Options(no_model=True, ru_postpass=True))
    return done.select("doc_id", "redacted", F.size("spans").alias("n_spans"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as requests whose options vary by id, some of them bad."""
    return spread(table(spark, sf, "documents", "doc_id", "text")).selectExpr(
        "doc_id as req_id",
        "text",
        "case when doc_id % 10 = 3 then 0.99D when doc_id % 50 = 7 then 1.5D else 0.5D end as min_score",
        "doc_id % 6 <> 5 as ru_postpass",
        "doc_id % 2 = 0 as ru_postpass_strict",
        "case when doc_id % 4 = 1 then '[gone]' when doc_id % 4 = 2 then '' end as placeholder",
        "case when doc_id % 5 = 2 then '*' when doc_id % 40 = 9 then '**' end as mask_char",
    )


@query("redact_per_row_options")
def _redact_per_row_options(spark, sf):
    requests = _requests(spark, sf).filter("mask_char is null or length(mask_char) = 1")
    found = requests.withColumn("spans", detect_part(F.col("text"), "email"))
    return redact_per_row_options(found).select("req_id", "redacted")


@query("segment_text")
def _segment_text(spark, sf):
    docs = documents(spark, sf)
    segments = R.segment_text(F.col("text"), detect_part(F.col("text"), "email"))
    return docs.select("doc_id", F.posexplode(segments).alias("pos", "g")).select(
        "doc_id", "pos", "g.text", "g.entity", "g.score"
    )


@query("highlight_html")
def _highlight_html(spark, sf):
    docs = template(spark, sf, "form")
    return docs.select(
        "doc_id",
        R.highlight_html(F.col("text"), detect_part(F.col("text"), "email")).alias("html"),
    )


@query("human_bytes")
def _human_bytes(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    size = F.octet_length("text")
    return docs.select(
        "doc_id",
        R.human_bytes(size).alias("size"),
        R.human_bytes(size.cast("long") * 512).alias("size_512"),
    )


# -- span algebra ----------------------------------------------------------
def _model_span_rows(spark: SparkSession, sf: str, deal: Callable = spread) -> DataFrame:
    """Line items as span rows: some touch, some overlap, some stand apart."""
    return deal(
        table(
            spark, sf, "lineitem",
            "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_returnflag",
        )
    ).selectExpr(
        "l_orderkey as doc_id",
        "concat('kind_', l_returnflag) as entity",
        "cast(null as string) as text",
        "cast(l_linenumber * 15 + l_suppkey % 10 as int) as start",
        "cast(l_linenumber * 15 + l_suppkey % 10 + l_quantity as int) as end",
        "1 - l_discount as score",
        "cast(round(l_extendedprice * 100) as bigint) as ord",
    )


def _candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as candidate rows over the same documents."""
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").selectExpr(
        "o_orderkey as doc_id",
        "cast(o_custkey % 120 as int) as start",
        "cast(o_custkey % 120 + 8 as int) as end",
    )


def _model_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return sources.collect_spans(_model_span_rows(spark, sf))


@query("collect_spans")
def _collect_spans(spark, sf):
    return _model_arrays(spark, sf).select(
        "doc_id",
        F.size("spans").alias("n"),
        F.concat_ws(
            ",", F.transform("spans", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string")))
        ).alias("ranges"),
    )


@query("explode_spans")
def _explode_spans(spark, sf):
    rows = span_rows.numbered(_model_span_rows(spark, sf))
    return rows.select("doc_id", "pos", "entity", "start", "end", "score")


@query("span_overlap_pairs")
def _span_overlap_pairs(spark, sf):
    # shuffled by document at once, with these columns only
    rows = _model_span_rows(spark, sf, deal=lambda df: df).select("doc_id", "ord", "start", "end")
    return span_rows.span_overlap_pairs(rows)


@query("drop_overlapping_existing")
def _drop_overlapping_existing(spark, sf):
    return span_rows.drop_overlapping_rows(
        _candidate_rows(spark, sf), _model_span_rows(spark, sf)
    )


@query("drop_overlapping_existing_arrays")
def _drop_overlapping_existing_arrays(spark, sf):
    held = _candidate_rows(spark, sf).join(_model_arrays(spark, sf), "doc_id", "left")
    candidate = F.array(
        A.span(F.lit("c"), F.lit(None), F.col("start"), F.col("end"), F.lit(S.RULE_SCORE))
    )
    return (
        held.withColumn(
            "free",
            A.drop_overlapping_existing(candidate, F.coalesce("spans", A.no_spans())),
        )
        .filter(F.size("free") > 0)
        .select("doc_id", "start", "end")
    )


@query("resolve_overlaps")
def _resolve_overlaps(spark, sf):
    """Greedy choice in the order of ``ord``, whatever the position."""
    kept = span_rows.resolve_rows(_model_span_rows(spark, sf))
    return span_rows.numbered(kept, order=("ord",)).select("doc_id", "pos", "entity", "start", "end")


@query("merge_spans")
def _merge_spans(spark, sf):
    added = _candidate_rows(spark, sf).select(
        "doc_id", F.lit("added").alias("entity"), "start", "end", F.lit(0).cast("long").alias("ord")
    )
    rows = _model_span_rows(spark, sf).join(added.select("doc_id"), "doc_id", "left_semi")
    return span_rows.merge_rows(rows, added).select("doc_id", "pos", "entity", "start", "end")


@query("sweep_non_overlapping")
def _sweep(spark, sf):
    kept = span_rows.sweep_rows(_model_span_rows(spark, sf))
    return span_rows.numbered(kept).select("doc_id", "pos", "entity", "start", "end")


@query("filter_min_score")
def _filter_min_score(spark, sf):
    kept = span_rows.scored(_model_span_rows(spark, sf), F.lit(0.95))
    return kept.select("doc_id", "start", "end", "score", "ord")


@query("filter_min_score_final")
def _filter_min_score_final(spark, sf):
    threshold = F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(0.97)
    kept = span_rows.scored(_model_span_rows(spark, sf), threshold, final=True)
    return kept.select("doc_id", "start", "end", "score", "ord")


@query("ru_postpass")
def _ru_postpass(spark, sf):
    """Rules over texts whose first six characters after the number are taken."""
    docs = template(spark, sf, "form")
    at = F.instr("text", "@") - 3
    existing = F.array(
        A.span(F.lit("private_person"), F.lit(None), at, at + 2, F.lit(0.9))
    )
    return spans_long(docs, pii_spans(F.col("text"), existing)).drop("text")


# -- model -----------------------------------------------------------------
def _word_scorer():
    """A stand-in for a model: finds the word 'the' and scores it by position."""

    def predict(texts):
        out = []
        for t in texts:
            at, found = t.find("the "), []
            while at >= 0:
                found.append(
                    {"entity_group": "", "entity": "word", "start": at, "end": at + 3,
                     "score": ((at * 7) % 100) / 100, "word": "ignored"}
                )
                at = t.find("the ", at + 4)
            out.append(found)
        return out

    return predict


@query("normalize_raw_spans")
def _normalize_raw_spans(spark, sf):
    docs = documents(spark, sf)
    last = F.length("text")
    raw = F.array(
        *[
            F.struct(
                F.lit(group).alias("entity_group"),
                F.lit(entity).alias("entity"),
                ((F.col("doc_id") % 100) / 100 + plus).alias("score"),
                F.least(last, F.lit(a)).alias("start"),
                F.least(last, F.lit(b)).alias("end"),
            )
            for group, entity, plus, a, b in (
                ("person", "x", 0.0, 0, 4),
                ("", "place", 0.1, 3, 9),
                (None, "", -0.2, 5, 30),
            )
        ]
    )
    return spans_long(docs, normalize_raw_spans(F.col("text"), raw, F.lit(0.45)))


@query("detect_batch")
def _detect_batch(spark, sf):
    found = detect_batch(documents(spark, sf), _word_scorer, 0.5, batch_size=16)
    return spans_long(found, F.col("spans"))


def _near_scorer():
    """The same words, with a score that depends on what stands next to them, not on the place."""

    def predict(texts):
        found = [[m.start() for m in re.finditer("the (?=.)", t, re.DOTALL)] for t in texts]
        return [
            [{"entity_group": "word", "entity": None, "start": at, "end": at + 3, "score": ord(t[at + 4]) % 8 / 8} for at in x]
            for t, x in zip(texts, found)
        ]

    return predict


@query("detect_long")
def _detect_long(spark, sf):
    """A scorer that is given 200 characters at most, as if it had read the whole text."""
    found = detect_long(documents(spark, sf), _near_scorer, 200, 80, 0.25, batch_chars=1 << 14)
    return spans_long(found, F.col("spans"))


@query("detect_one")
def _detect_one(spark, sf):
    found = detect_one(documents(spark, sf), _word_scorer, 0.9)
    return spans_long(found, F.col("spans"))


@query("detect_pii")
def _detect_pii(spark, sf):
    """Scorer spans over every e-mail's first three characters, then rules."""
    docs = template(spark, sf, "form")
    at = F.instr("text", "@") - 3
    scored = docs.select(
        "doc_id",
        "text",
        F.array(
            A.span(F.lit("private_person"), F.substring("text", at + 1, 2), at, at + 2,
                   F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.3))
        ).alias("model_spans"),
        F.when(F.col("doc_id") % 7 == 0, 0.97).otherwise(0.5).alias("min_score"),
        (F.col("doc_id") % 5 != 0).alias("ru_postpass"),
        (F.col("doc_id") % 3 == 0).alias("ru_postpass_strict"),
    )
    return spans_long(detect_pii(scored, model_spans="model_spans"), F.col("spans")).drop("pos")


@query("extra_rules")
def _extra_rules(spark, sf):
    rule = make_rule("order_word", r"(?<![A-Za-z])the(?![A-Za-z])", literals=("the",))
    found = detect_regex_only(documents(spark, sf), extra_rules=(rule,))
    only = F.filter("spans", lambda s: s.entity == "order_word")
    return A.explode_spans(found, "doc_id", only).select("doc_id", "pos", "text", "start", "end")


@query("register_sql_functions")
def _register_sql_functions(spark, sf):
    register_sql_functions(spark)
    documents(spark, sf).createOrReplaceTempView("inkbar_documents")
    return spark.sql(
        "select doc_id, pii_redact(text, spans, null, null) as redacted, size(spans) as n_spans "
        "from (select doc_id, text, pii_spans(text, false) as spans from inkbar_documents)"
    )


@query("sql_table_functions")
def _sql_table_functions(spark, sf):
    """From a request table to rejects and span rows in SQL alone."""
    register_sql_functions(spark)
    _requests(spark, sf).createOrReplaceTempView("inkbar_requests")
    return spark.sql(
        """
        with judged as (select *, pii_verdict(text, min_score, mask_char, 6000) as verdict from inkbar_requests),
        found as (
          select req_id, filter(pii_spans(text, ru_postpass_strict), s -> s.score >= min_score or min_score <= 0) as spans
          from judged where verdict is null and ru_postpass
        )
        select req_id, verdict.reason as reason, cast(null as int) as pos, cast(null as string) as entity,
          cast(null as int) as start, cast(null as int) as `end`
        from judged where verdict is not null
        union all
        select f.req_id, 'ok', r.pos, r.entity, r.start, r.`end` from found as f, lateral pii_span_rows(f.spans) as r
        """
    )


# -- validation ------------------------------------------------------------
@query("reject_oversized_text")
def _reject_oversized_text(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    return docs.filter(V.oversized_text(F.col("text"), 4000)).select("doc_id")


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as uploads; some hold a byte that UTF-8 never has."""
    return table(spark, sf, "documents", "doc_id", "text").selectExpr(
        "doc_id",
        "concat('in/', cast(doc_id as string), case doc_id % 5 when 0 then '.txt' when 1 then '.MD' when 2 then '.bin' when 3 then '' else '.tar.json' end) as path",
        "case when doc_id % 9 = 2 then 'text/x-any' when doc_id % 9 = 3 then 'image/png' end as media_type",
        "case when doc_id % 7 = 4 then concat(cast(text as binary), X'FF') else cast(text as binary) end as content",
        "case when doc_id % 13 = 0 then '--' when doc_id % 3 = 0 then '#' end as mask_char",
    ).withColumn("length", F.length("content").cast("long"))


@query("reject_oversized_file")
def _reject_oversized_file(spark, sf):
    return _uploads(spark, sf).filter(V.oversized_file(F.col("length"), 4000)).select("path", "length")


@query("reject_invalid_utf8")
def _reject_invalid_utf8(spark, sf):
    return _uploads(spark, sf).filter(V.invalid_utf8(F.col("content"))).select("path")


@query("reject_bad_mask_char")
def _reject_bad_mask_char(spark, sf):
    return _requests(spark, sf).filter(V.bad_mask_char(F.col("mask_char"))).select("req_id", "mask_char")


@query("reject_bad_min_score")
def _reject_bad_min_score(spark, sf):
    return _requests(spark, sf).filter(V.bad_min_score(F.col("min_score"))).select("req_id", "min_score")


@query("skip_empty_text")
def _skip_empty_text(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text").selectExpr(
        "doc_id", "case when doc_id % 3 = 0 then '' else text end as text"
    )
    one = detect_one(spread(docs), _any_text_scorer, 0.0)
    batch = detect_batch(one, _any_text_scorer, 0.0, out="batch_spans")
    return batch.select(
        "doc_id", F.size("spans").alias("n_one"), F.size("batch_spans").alias("n_batch")
    )


def _any_text_scorer():
    """Reports one span for every text it is given, even an empty one."""

    def predict(texts):
        return [
            [{"entity": "any", "start": 0, "end": min(len(t), 1), "score": 1.0}] for t in texts
        ]

    return predict


@query("flag_blank_text")
def _flag_blank_text(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text").selectExpr(
        "doc_id",
        "case doc_id % 4 when 0 then concat(' ', chr(9), chr(10)) when 1 then '' when 2 then ' x ' else text end as text",
    )
    return docs.select("doc_id", V.blank_text(F.col("text")).alias("blank"))


@query("validate_requests")
def _validate_requests(spark, sf):
    """Request lines, some broken off, of wrong types or without a text; one row for each line."""
    path = scratch_path(spark, "lines")
    whole = F.to_json(F.struct("req_id", "text", "min_score", "ru_postpass", "placeholder", "mask_char"))
    line = F.expr(
        "case req_id % 20 when 11 then concat('{\"req_id\": ', req_id, ', \"text\": \"') "
        "when 12 then concat('{\"req_id\": \"', req_id, ' x\", \"text\": \"a\"}') "
        "when 13 then concat('{\"req_id\": ', req_id, ', \"min_score\": 0.5}') else whole end"
    )
    _requests(spark, sf).withColumn("whole", whole).select(line.alias("value")).write.text(path)
    accepted, rejects = V.validate_requests(sources.read_requests(spark, path), 6000)
    return accepted.select("req_id", F.lit(200).alias("status"), F.lit("ok").alias("reason")).unionByName(
        rejects.select(F.when(F.col("malformed").isNull(), F.col("req_id")).alias("req_id"), "status", "reason")
    )


@query("split_requests")
def _split_requests(spark, sf):
    """Rows by verdict, as counted in the pass that splits them, beside a count of what it wrote."""
    split = split_requests(_requests(spark, sf), 6000)
    counted = spark.createDataFrame([(k or "ok", n) for k, n in split.counts.items()], "reason string, n long")
    every = split.accepted.select("req_id", F.lit("ok").alias("reason")).unionByName(split.rejects.select("req_id", "reason"))
    written_rows = every.groupBy("reason").agg(
        F.count("*").alias("n_written"), F.sum("req_id").alias("ids")
    )
    return counted.filter("n > 0").join(written_rows, "reason", "full").select("reason", "n", "n_written", "ids")


@query("validate_options")
def _validate_options(spark, sf):
    """Options with the stars shortcut, applied to every document."""
    options = V.validate_options(no_model=True, ru_postpass=True, ru_postpass_strict=True, stars=True)
    done = run(documents(spark, sf), options)
    return done.select("doc_id", "redacted")


# -- sources and sinks -----------------------------------------------------
@query("read_text_documents")
def _read_text_documents(spark, sf):
    """Every supplier's note is written as a file of its own and read back."""
    notes = table(spark, sf, "supplier", "s_suppkey", "s_name").selectExpr(
        "s_suppkey", "concat('Note for ', s_name, chr(13), chr(10), 'mail s', cast(s_suppkey as string), '@mail.ru') as value"
    )
    path = scratch_path(spark, "texts")
    sinks.files_by_key(notes, "s_suppkey", path)
    docs = sources.read_text_documents(spark, path)
    found = detect_regex_only(docs)
    return found.select(
        F.regexp_extract("doc_id", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"),
        "text",
        F.size("spans").alias("n"),
    )


@query("read_requests")
def _read_requests(spark, sf):
    path = scratch_path(spark, "requests")
    _requests(spark, sf).drop("ru_postpass_strict").write.json(path)
    back = sources.read_requests(spark, path)
    return back.select("req_id", "text", "min_score", "ru_postpass", "ru_postpass_strict", "placeholder", "mask_char")


@query("ingest_binary_files")
def _ingest_binary_files(spark, sf):
    """Uploads to redacted texts, or refused with a reason."""
    files = _uploads(spark, sf).withColumn("ru_postpass", F.lit(True))
    done, rejects = redact_uploads(files, max_bytes=6000)
    return done.select(
        "path", F.lit(200).alias("status"), F.lit("ok").alias("reason"), "redacted",
        F.size("spans").alias("n_spans"), "cached",
    ).unionByName(rejects.select("path", "status", "reason"), allowMissingColumns=True)


@query("redact_stored_files")
def _redact_stored_files(spark, sf):
    """Every supplier's note is stored as a file of its own, read as bytes and redacted."""
    notes = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "concat('s', cast(s_suppkey % 7 as string), '@mail.ru, card 5284 7710 3962 4408') as value"
    )
    path = scratch_path(spark, "files")
    sinks.files_by_key(notes, "s_suppkey", path)
    files = sources.filter_text_files(sources.read_uploads(spark, path)).withColumn("ru_postpass", F.lit(True))
    done, _ = redact_uploads(files)
    return done.select(
        F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"),
        "redacted", F.size("spans").alias("n_spans"),
    )


@query("filter_text_files")
def _filter_text_files(spark, sf):
    return sources.filter_text_files(_uploads(spark, sf), "media_type").select("path")


@query("attach_external_spans")
def _attach_external_spans(spark, sf):
    rows = _external_rows(spark, sf)
    found = sources.attach_external_spans(table(spark, sf, "documents", "doc_id", "text"), rows)
    return A.explode_spans(found)


def _external_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as spans of the documents with the same number."""
    docs = table(spark, sf, "documents", "doc_id")
    return _model_span_rows(spark, sf).join(docs, "doc_id", "left_semi")


@query("reject_external_spans")
def _reject_external_spans(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    rejects = sources.reject_external_spans(docs, _model_span_rows(spark, sf))
    return rejects.select("doc_id", "ord", "status", "reason")


@query("redact_with_external_spans")
def _redact_with_external_spans(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    return redact_with_external_spans(docs, _model_span_rows(spark, sf))


@query("redact_in_stretches")
def _redact_in_stretches(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    return strung(redact_in_stretches(docs, _model_span_rows(spark, sf), size=256))


@query("detect_response")
def _detect_response(spark, sf):
    found = dedup.detect_distinct_once(_good_requests(spark, sf), detect_pii)
    answer = sinks.detect_response(found, "rules-only")
    return answer.select(
        "req_id", "model", F.size("spans").alias("n_spans"),
        F.concat_ws(",", F.transform("spans", lambda s: s.text)).alias("texts"), "cached",
    )


@query("redact_response")
def _redact_response(spark, sf):
    """Answers, and the refused requests with status and reason."""
    results, rejects = serve_requests(_requests(spark, sf), max_bytes=6000)
    answer = sinks.redact_response(results, "rules-only")
    done = answer.select(
        "req_id", "model", "redacted", F.size("spans").alias("n_spans"), "cached",
        F.lit(200).alias("status"), F.lit("ok").alias("reason"),
    )
    return done.unionByName(rejects.select("req_id", "status", "reason"), allowMissingColumns=True)


def _email_results(spark: SparkSession, sf: str) -> DataFrame:
    docs = template(spark, sf, "email").withColumn("spans", detect_part(F.col("text"), "email"))
    return docs.withColumn("redacted", R.redact(F.col("text"), F.col("spans")))


@query("result_json")
def _result_json(spark, sf):
    done = _email_results(spark, sf)
    return done.select(
        "doc_id", sinks.result_json(F.col("text"), F.col("redacted"), F.col("spans")).alias("json")
    )


@query("suite_json")
def _suite_json(spark, sf):
    done = _email_results(spark, sf)
    name = F.concat(F.lit("case_"), F.col("doc_id").cast("string"))
    return done.select(
        "doc_id",
        sinks.suite_json(name, F.col("text"), F.col("redacted"), F.col("spans")).alias("json"),
    )


@query("redacted_text_sink")
def _redacted_text_sink(spark, sf):
    path = scratch_path(spark, "redacted")
    done = documents(spark, sf).select(
        R.redact(F.col("text"), detect_part(F.col("text"), "email")).alias("redacted")
    )
    sinks.redacted_text_sink(done, path)
    return spark.read.parquet(path).groupBy("redacted").agg(F.count("*").alias("n"))


@query("span_report")
def _span_report(spark, sf):
    return sinks.span_report(detect_regex_only(documents(spark, sf)))


@query("span_report_empty")
def _span_report_empty(spark, sf):
    return sinks.span_report_empty(detect_regex_only(documents(spark, sf)))


@query("span_count_per_doc")
def _span_count_per_doc(spark, sf):
    found = detect_regex_only(documents(spark, sf))
    return found.select("doc_id", sinks.span_count_per_doc(F.col("spans")).alias("n_spans"))


# -- repeats ---------------------------------------------------------------
def _good_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as requests, with thresholds that differ for some."""
    return spread(table(spark, sf, "documents", "doc_id", "text")).selectExpr(
        "doc_id as req_id",
        "text",
        "case when doc_id % 3 = 0 then 0.5D else 0.25D end as min_score",
        "true as ru_postpass",
        "false as ru_postpass_strict",
    )


@query("detect_fingerprint")
def _detect_fingerprint(spark, sf):
    r = _requests(spark, sf)
    return r.select(
        "req_id",
        detect_fingerprint(
            F.col("text"), F.col("min_score"), F.col("ru_postpass"), F.col("ru_postpass_strict")
        ).alias("fp"),
    )


@query("detect_distinct_once")
def _detect_distinct_once(spark, sf):
    found = dedup.detect_distinct_once(_good_requests(spark, sf), detect_pii)
    return found.select(
        "req_id",
        F.concat_ws(
            ",",
            F.transform("spans", lambda s: F.concat_ws(":", s.entity, s.start.cast("string"), s.end.cast("string"))),
        ).alias("ranges"),
        "cached",
    )


@query("extra_rules_by_hundred")
def _extra_rules_by_hundred(spark, sf):
    """A rule for each network of addresses: 256 of them, each with its own literal."""
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    rules = [
        make_rule(f"net_{k}", rf"(?<![0-9.]){k}(?:\.[0-9]{{1,3}}){{3}}(?![0-9.])", literals=(f"{k}.",)) for k in range(256)
    ]
    found = detect_with_rulebook(docs, rules)
    return A.explode_spans(found).select("doc_id", "pos", "entity", "text", "start", "end")


@query("detect_across_runs")
def _detect_across_runs(spark, sf):
    """The second of two runs over one store: all documents again, and all conversations."""
    docs = spread(table(spark, sf, "documents", "doc_id", "text")).selectExpr(
        "doc_id as req_id", "text", "0.5D as min_score", "true as ru_postpass", "false as ru_postpass_strict"
    )
    turns = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "1000000000 + conv_id * 1000 + turn as req_id", "text", "0.5D as min_score", "true as ru_postpass",
        "false as ru_postpass_strict",
    )
    held = store.ResultStore(spark, scratch_path(spark, "result-store"), buckets=8)
    store.detect_across_runs(docs, detect_pii, held)
    found = store.detect_across_runs(docs.unionByName(turns), detect_pii, held)
    return found.select(
        "req_id",
        F.concat_ws(
            ",", F.transform("spans", lambda s: F.concat_ws(":", s.entity, s.start.cast("string"), s.end.cast("string")))
        ).alias("ranges"),
        "cached",
    )


@query("mark_cached")
def _mark_cached(spark, sf):
    return dedup.mark_cached(_good_requests(spark, sf)).select("req_id", "cached")


@query("cache_stats")
def _cache_stats(spark, sf):
    return dedup.cache_stats(_good_requests(spark, sf))


# -- metrics ---------------------------------------------------------------
@query("corpus_totals")
def _corpus_totals(spark, sf):
    return metrics.corpus_totals(table(spark, sf, "documents", "text"))


@query("span_total")
def _span_total(spark, sf):
    return metrics.span_total(detect_regex_only(documents(spark, sf)))


@query("entities_present")
def _entities_present(spark, sf):
    found = detect_regex_only(documents(spark, sf))
    return found.select(
        "doc_id", F.concat_ws(",", A.entities_present(F.col("spans"))).alias("entities")
    )


@query("spans_by_entity")
def _spans_by_entity(spark, sf):
    found = detect_regex_only(documents(spark, sf))
    texts = A.spans_by_entity(F.col("spans"), S.ACCOUNT_NUMBER)
    return found.select("doc_id", F.concat_ws(",", texts).alias("accounts"))


@query("entity_counts")
def _entity_counts(spark, sf):
    return metrics.entity_counts(detect_regex_only(documents(spark, sf)))


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_id", "user_id", "value").selectExpr(
        "user_id % 7 as run", "event_id % 1000 as chars", "value / 1000 as elapsed", "value"
    )


@query("throughput_by_run")
def _throughput_by_run(spark, sf):
    return metrics.throughput_by_run(_latencies(spark, sf)).select(
        "run", F.round("chars_per_s", 3).alias("chars_per_s")
    )


@query("mean_throughput")
def _mean_throughput(spark, sf):
    return metrics.mean_throughput(_latencies(spark, sf)).select(
        F.round("chars_per_s", 3).alias("chars_per_s")
    )


@query("latency_percentiles")
def _latency_percentiles(spark, sf):
    return metrics.latency_percentiles(_latencies(spark, sf), "value", (0, 12.5, 50, 90, 99, 100))


@query("latency_mean")
def _latency_mean(spark, sf):
    return metrics.latency_mean(_latencies(spark, sf), "value").select(
        F.round("mean", 6).alias("mean")
    )


# -- streams ---------------------------------------------------------------
def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    # the pattern holds for a single file and for a folder of part files
    return spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, into files, and read those."""
    path = scratch_path(spark, name)
    streams.start_to_files(stream, path, scratch_path(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_redact")
def _stream_redact(spark, sf):
    requests = _document_stream(spark, sf).selectExpr(
        "doc_id as req_id",
        "text",
        "case when doc_id % 50 = 7 then 1.5D else 0.5D end as min_score",
        "true as ru_postpass",
        "case when doc_id % 5 = 2 then '*' end as mask_char",
    )
    done = streams.stream_redact(requests).select("req_id", "redacted", "status")
    return _drain(spark, done, "stream_redact")


@query("stream_mark_cached")
def _stream_mark_cached(spark, sf):
    requests = _document_stream(spark, sf).selectExpr(
        "doc_id as req_id", "text", "0.5D as min_score", "true as ru_postpass"
    )
    marks = streams.stream_mark_cached(requests)
    return _drain(spark, marks, "stream_mark").select("req_id", "cached")


@query("stream_mark_recent")
def _stream_mark_recent(spark, sf):
    """Repeats within a day, by event time, of what each user does."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    requests = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").selectExpr(
        "event_id as req_id", "concat(event_type, ' ', user_id) as text", "ts"
    )
    marks = recents.stream_mark_recent(requests, "1 day")
    return _drain(spark, marks, "stream_recent").select("req_id", "cached")
