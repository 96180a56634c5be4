"""Validation, sources, repeats, metrics, span tables, scorers, streams."""

import pathlib
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions.keys import detect_fingerprint
from inkbar.operators import dedup, metrics, skew, span_rows
from inkbar.operators.detect import detect_pii, detect_regex_only
from inkbar.operators.model import detect_batch, detect_one, normalize_raw_spans
from inkbar.operators.validate import Options, blank_text, validate_requests
from inkbar.plans.job import redact_with_external_spans, run, serve_requests
from inkbar.plans.scratch import scratch_path
from inkbar.sources import sinks
from inkbar.sources import text as src
from inkbar.sources.samples import SAMPLES, sample_corpus
from inkbar.streaming import stream as st


# -- validation and sources ------------------------------------------------
def test_rejects_carry_status_and_reason(spark):
    rows = [
        (1, "ok", 0.5, None), (2, "я" * 6, 0.5, None), (3, "ok", 1.1, None),
        (4, "ok", float("nan"), None), (5, "ok", 0.5, "**"), (6, "ok", 0.5, ""),
        (7, "ok", None, "\U0001f600"), (8, None, 0.5, None),
    ]
    df = spark.createDataFrame(rows, "req_id long, text string, min_score double, mask_char string")
    good, bad = validate_requests(df, max_bytes=10)
    assert sorted(r.req_id for r in good.collect()) == [1, 7]
    assert sorted((r.req_id, r.status) for r in bad.collect()) == [(i, 422) for i in (2, 3, 4, 5, 6, 8)]
    assert [r.reason for r in bad.collect() if r.req_id == 8] == ["text missing"]


def test_malformed_request_lines_are_refused(spark, tmp_path):
    lines = [
        '{"req_id": 1, "text": "fine"}', '{"req_id": 2, "text": "cut', '{"req_id": "x", "text": "a"}',
        '{"req_id": 4, "min_score": 0.5}', "nothing", '{"req_id": 6, "text": "a", "min_score": "high"}',
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    good, bad = validate_requests(src.read_requests(spark, str(tmp_path)))
    assert [r.req_id for r in good.collect()] == [1]
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["malformed request"] * 4 + ["text missing"]
    done = st.stream_redact(src.read_requests(spark, str(tmp_path))).collect()
    assert sorted(str(r.status) for r in done) == ["422"] * 5 + ["None"]


def test_options_refuse_contradictions():
    assert Options(stars=True).mask_char == "*"
    for bad in (
        {"stars": True, "mask_char": "#"},
        {"ru_postpass_strict": True},
        {"no_model": True},
        {"mask_char": "ab"},
    ):
        with pytest.raises(ValueError):
            Options(**bad)


def test_blank_text(spark):
    df = spark.createDataFrame([("",), (" \n﻿　",), ("\x1f",), (" x",)], "text string")
    assert [r.b for r in df.select(blank_text(F.col("text")).alias("b")).collect()] == [
        True, True, False, False,
    ]


def test_uploads_are_judged_in_order(spark, tmp_path):
    files = {"a.txt": b"mail a@b.com\r\n", "b.MD": b"\xff\xfe", "c.bin": b"x", "d.log": b"y" * 64}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    up = src.read_uploads(spark, str(tmp_path))
    texts = src.filter_text_files(up)
    assert texts.count() == 3
    good, bad = src.ingest_binary_files(texts.withColumn("mask_char", F.lit("*")), max_bytes=32)
    assert [r.text for r in good.collect()] == ["mail a@b.com\r\n"]
    assert sorted(r.status for r in bad.collect()) == [400, 413]
    good, bad = src.ingest_binary_files(texts.withColumn("mask_char", F.lit("**")), max_bytes=32)
    assert good.count() == 0
    assert sorted(r.status for r in bad.collect()) == [400, 413, 422]


def test_text_files_and_samples(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"l1\r\nl2\n")
    assert [r.text for r in src.read_text_documents(spark, str(tmp_path)).collect()] == ["l1\r\nl2\n"]
    found = {r.name: r.spans for r in detect_regex_only(sample_corpus(spark)).collect()}
    assert set(found) == set(SAMPLES) and found["plain"] == []
    assert {s.entity for s in found["russian_form"]} == {
        "account_number", "private_date", "private_email", "private_phone", "private_url",
    }


def test_sinks_write_what_they_say(spark, tmp_path):
    done = run(
        spark.createDataFrame([(1, "a@b.com\nя")], "doc_id long, text string"),
        Options(no_model=True, ru_postpass=True),
    )
    sinks.redacted_text_sink(done, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().redacted == "[PRIVATE_EMAIL]\nя"
    sinks.redacted_text_sink(done, str(tmp_path / "t"), as_text=True)
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    sinks.result_json_sink(done, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().input == "a@b.com\nя"


# -- repeats ---------------------------------------------------------------
def requests_with_a_hot_text(spark, n=3000):
    """A third of all requests hold one text."""
    rnd = random.Random(1)
    rows = [
        (i, "same a@b.com" if i % 3 == 0 else f"text {rnd.randint(0, n // 2)} u{i % 50}@x.ru", 0.5, True)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "req_id long, text string, min_score double, ru_postpass boolean"
    ).repartition(8)


def test_distinct_once_marks_and_counts(spark):
    req = requests_with_a_hot_text(spark)
    rows = {r.req_id: r for r in dedup.detect_distinct_once(req, detect_pii).collect()}
    seen = set()
    texts = {r.req_id: r.text for r in req.collect()}
    direct = {r.req_id: r.spans for r in detect_pii(req).collect()}
    assert set(rows) == set(texts)
    for i in sorted(texts):
        assert rows[i].cached == (texts[i] in seen)
        assert rows[i].spans == direct[i]
        seen.add(texts[i])
    stats = dedup.cache_stats(req).first()
    assert (stats["size"], stats.hits, stats.misses) == (len(seen), len(texts) - len(seen), len(seen))


def test_hot_keys_are_few_and_split(spark):
    keys = dedup.fingerprints(requests_with_a_hot_text(spark))
    hot = skew.hot_keys(keys, "fp").collect()
    assert 1 <= len(hot) <= skew.HOT_SHARE
    assert max(r._lanes for r in hot) > 300


def test_thresholds_share_a_key_to_four_decimals(spark):
    df = spark.createDataFrame([(0.5,), (0.50000001,), (0.5001,)], "m double")
    keys = [
        r.k for r in df.select(
            detect_fingerprint(F.lit("x"), F.col("m"), F.lit(True), F.lit(False)).alias("k")
        ).collect()
    ]
    assert keys[0] == keys[1] != keys[2]


# -- metrics ---------------------------------------------------------------
def rounded_rank(values, p):
    if not values:
        return 0.0
    rank = min(max(round(p / 100 * (len(values) - 1)), 0), len(values) - 1)
    below = 0
    for value, same in sorted(Counter(values).items()):
        if below <= rank < below + same:
            return value
        below += same


@pytest.mark.parametrize("kind", ["spread", "hot", "single", "empty"])
def test_percentiles_by_rounded_rank(spark, kind):
    rnd = random.Random(2)
    values = {
        "spread": [rnd.expovariate(0.1) for _ in range(5000)],
        "hot": [7.0] * 2000 + [rnd.random() * 20 for _ in range(2001)],
        "single": [3.0],
        "empty": [],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    ps = (0, 1, 33.3, 50, 90, 99, 100)
    got = {r.pct: r.value for r in metrics.latency_percentiles(df, "v", ps).collect()}
    assert got == {float(p): rounded_rank(values, p) for p in ps}


# -- span tables -----------------------------------------------------------
SPAN_ROWS = "doc_id long, entity string, text string, start int, end int, score double, ord long"


def span_table(spark, n, docs, seed):
    """Random spans; document 0 holds a third of them."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = rnd.randint(0, 200)
        rows.append((0 if i % 3 == 0 else rnd.randint(1, docs), f"k{i % 4}", None, a,
                     a + rnd.choice([0, 1, 5, 40]), 0.5, i))
    return rows, spark.createDataFrame(rows, SPAN_ROWS).repartition(8)


def test_overlap_counts_without_pairs(spark):
    old, old_df = span_table(spark, 600, 20, 1)
    new = [r for r in span_table(spark, 300, 20, 2)[0] if r[4] > r[3]]
    new_df = spark.createDataFrame(new, SPAN_ROWS)
    want = {
        c[6]: sum(e[0] == c[0] and e[3] < c[4] and e[4] > c[3] for e in old) for c in new
    }
    got = {r.ord: r.n_overlaps for r in span_rows.overlap_counts(new_df, old_df).collect()}
    assert got == want
    free = {r.ord for r in span_rows.drop_overlapping_rows(new_df, old_df).collect()}
    assert free == {k for k, n in want.items() if n == 0}


def test_external_spans_and_their_essence(spark):
    rows, df = span_table(spark, 900, 12, 3)
    docs = [(d, "".join(chr(97 + (d + i) % 26) for i in range(150)) + " a@b.com") for d in range(14)]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    attached = {r.doc_id: r.spans for r in src.attach_external_spans(docs_df, df).collect()}
    assert attached[13] == []
    rejected = {r.ord for r in src.reject_external_spans(docs_df, df).collect()}
    for d, text in docs:
        want = sorted((r for r in rows if r[0] == d and r[4] <= len(text)), key=lambda r: (r[3], r[6]))
        assert [(s.entity, s.text, s.start, s.end) for s in attached[d]] == [
            (r[1], text[r[3]:r[4]], r[3], r[4]) for r in want
        ]
    assert rejected == {r[6] for r in rows if r[4] > 158}
    # What is left out changes neither the redaction nor the rules' part in it.
    for rules in (False, True):
        slim = redact_with_external_spans(docs_df, df, ru_postpass=rules).collect()
        whole = src.attach_external_spans(docs_df, df).withColumns(
            {"min_score": F.lit(0.0), "ru_postpass": F.lit(rules)}
        )
        full, _ = serve_requests(whole.withColumnRenamed("spans", "m"), model_spans="m")
        assert {r.doc_id: r.redacted for r in slim} == {r.doc_id: r.redacted for r in full.collect()}
    kept = span_rows.essential_spans(df.filter("end > start")).groupBy("doc_id", "start").count()
    assert kept.agg(F.max("count")).first()[0] <= 2


# -- scorers ---------------------------------------------------------------
def test_raw_records(spark):
    raw = [
        ("g", "e", 0.9, 0, 2), ("", "e", 0.9, 1, 3), (None, "", 0.9, 2, 4),
        ("low", "e", 0.1, 0, 1), ("nan", "e", float("nan"), 0, 1),
    ]
    df = spark.createDataFrame([("aя\U0001f600d", raw)], f"text string, raw {S.RAW_SPANS_DDL}")
    got = df.select(normalize_raw_spans(F.col("text"), F.col("raw"), F.lit(0.5)).alias("s")).first().s
    assert [(s.entity, s.text) for s in got] == [("g", "aя"), ("e", "я\U0001f600"), ("UNKNOWN", "\U0001f600d")]


def make_stub():
    def build():
        def predict(texts):
            assert len(texts) <= 3
            return [[{"entity": "all", "start": 0, "end": len(t), "score": 0.7}] for t in texts]

        return predict

    return build


def test_predictor_gets_slices_and_no_nulls(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "", None, "cde"] * 5)], "id long, text string")
    stub = make_stub()
    got = {r.id: r.spans for r in detect_batch(df, stub, 0.5, batch_size=3).collect()}
    assert [len(got[i]) for i in range(4)] == [1, 1, 0, 1]
    one = {r.id: r.spans for r in detect_one(df, stub).collect()}
    assert [len(one[i]) for i in range(4)] == [1, 0, 0, 1]
    assert one[3][0].text == "cde"


# -- streams ---------------------------------------------------------------
def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"u{i % 7}@mail.ru and lot {i}", 2.0 if i == 5 else 0.5, True) for i in range(60)]
    df = spark.createDataFrame(rows, "req_id long, text string, min_score double, ru_postpass boolean")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = st.start_to_files(st.stream_redact(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    cols = ["req_id", "redacted", "status"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())
    want = sorted(tuple(r) for r in st.stream_redact(df).select(*cols).collect())
    assert got == want and sum(r[2] == 422 for r in got) == 1


def test_stream_marks_every_repeat_once(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"t{i % 30}") for i in range(90)]
    schema = "req_id long, text string"
    for k in range(3):
        part = spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = st.start_to_files(st.stream_mark_cached(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = {r.req_id: r.cached for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 90
    assert sum(not c for c in got.values()) == len({t for _, t in rows})


def test_settled_rows_and_buckets_share_python_calls(spark):
    rows = [(i, f"{i % 3000:064x}", i % 5 - 1) for i in range(6000)]
    keyed = st.keyed(spark.createDataFrame(rows, "req_id long, fp string, lane int")).collect()
    assert len(keyed) == 6000 and all((r.asks == r.fp) == (r.lane == 0) for r in keyed)
    calls = {(r.asks, r.lane) for r in keyed if r.lane != 0}
    assert len(calls) <= 2 * st.SETTLED and {a for a, _ in calls} == {""}
    # repeats stay above zero, rows without a time below
    sign = {i: lane > 0 for i, _, lane in rows if lane}
    assert {r.req_id: r.lane > 0 for r in keyed if r.lane} == sign


def test_texts_of_a_bucket_are_asked_in_one_call():
    class Map(dict):
        def containsKey(self, key):
            return key in self

        updateValue = dict.__setitem__

    seen = st.Seen()
    seen.seen = Map({("old",): (1,)})
    batches = [pd.DataFrame({"req_id": [9, 4], "fp": ["new", "old"]}), pd.DataFrame({"req_id": [7, 8], "fp": ["new", "two"]})]
    (out,) = seen.handleInputRows(("abc", 0), iter(batches), None)
    assert dict(zip(out["req_id"], out["cached"])) == {9: True, 4: True, 7: False, 8: False}
    assert dict(seen.seen) == {("old",): (1,), ("new",): (7,), ("two",): (8,)}


def test_only_one_row_per_batch_asks_the_state():
    b = pd.DataFrame({"req_id": [5, 3, 9, 4], "fp": ["a", "a", "b", "a"]})
    (out,) = st.first_of_batch(iter([b]))
    assert out["lane"].tolist()[1] == 0 and out["lane"].tolist()[2] == 0
    assert all(x > 0 for x in (out["lane"].tolist()[0], out["lane"].tolist()[3]))


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# -- span rows, streams over folders, percentiles at the edges ---------------
def plain_overlap(a, b):
    return a[1] > b[0] and b[1] > a[0]


def empty_and_hot_spans(n=300):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        a = rnd.randint(0, 150)
        doc = 0 if i % 3 == 0 else rnd.randint(1, 5) if i % 7 else None
        rows.append((doc, "e", None, a, a + rnd.choice([0, 0, 1, 3, 9, 40]), 0.5, i))
    return rows


def test_span_rows_equal_plain_python_with_empty_spans(spark):
    rows = empty_and_hot_spans()
    spans = spark.createDataFrame(rows, SPAN_ROWS)
    asked = [(r[0], r[3] - 2, r[3] + (r[6] % 3) * 2 - 2) for r in rows[:120]]
    candidates = spark.createDataFrame(asked, "doc_id long, start int, end int")
    counted = span_rows.overlap_counts(candidates, spans).collect()
    counts = Counter((r.doc_id, r.start, r.end, r.n_overlaps) for r in counted)
    assert counts == Counter(
        (d, a, b, sum(x[0] == d and plain_overlap((a, b), x[3:5]) for x in rows)) for d, a, b in asked
    )
    left = span_rows.drop_overlapping_rows(candidates, spans).collect()
    free = {k[:3]: v for k, v in counts.items() if k[3] == 0}
    assert Counter((r.doc_id, r.start, r.end) for r in left) == Counter(free)
    partners = {r.ord: r.n_partners for r in span_rows.span_overlap_pairs(spans).collect()}
    places = {r.ord: r.pos for r in span_rows.numbered(spans).collect()}
    swept, taken = set(), set()
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        for r in own:
            assert partners[r[6]] == sum(x is not r and plain_overlap(r[3:5], x[3:5]) for x in own)
        reach, kept = 0, []
        for pos, r in enumerate(sorted(own, key=lambda r: (r[3], r[6]))):
            assert places[r[6]] == pos
            if r[3] >= reach:
                swept.add(r[6])
                reach = r[4]
        for r in own:
            if not any(plain_overlap(r[3:5], k[3:5]) for k in kept):
                kept.append(r)
                taken.add(r[6])
    assert {r.ord for r in span_rows.sweep_rows(spans).collect()} == swept
    assert {r.ord for r in span_rows.resolve_rows(spans).collect()} == taken


def plain_partners(r, own):
    """A missing place comes before all others; a span that misses one has no number."""
    if None in r[3:5]:
        return None
    filled = [x for x in own if None not in x[3:5] and x[4] > x[3]]
    asked, before = (own, 1) if r in filled else (filled, 0)
    low = [(float("-inf") if a is None else a, float("-inf") if b is None else b) for a, b in (x[3:5] for x in asked)]
    return sum(a < r[4] for a, _ in low) - sum(b <= r[3] for _, b in low) - before


@pytest.mark.parametrize("share", [0, 6, 10**9])
def test_partners_of_hot_and_other_documents(spark, monkeypatch, share):
    """No document, some and all of them count as hot; documents go on over several batches."""
    monkeypatch.setattr(span_rows, "hot_share", lambda total: share)
    rows = empty_and_hot_spans()
    rows = [(*r[:3], r[3] if r[6] % 11 else None, r[4] if r[6] % 13 else None, *r[5:]) for r in rows]
    rows += [(r[0], "e", None, r[3], r[3] - 4, 0.5, 1000 + r[6]) for r in rows if r[6] % 17 == 0 and r[3]]
    rows += [(100 + i // 3, "e", None, i % 3, i % 3 + 2, 0.5, 2000 + i) for i in range(300)]
    rows += rows[::5]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = Counter(map(tuple, span_rows.span_overlap_pairs(spark.createDataFrame(rows, SPAN_ROWS)).collect()))
        none = span_rows.span_overlap_pairs(spark.createDataFrame([], SPAN_ROWS))
        assert none.collect() == [] and none.columns[-1] == "n_partners"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = {d: [r for r in rows if r[0] == d] for d in {r[0] for r in rows}}
    assert got == Counter((*r, plain_partners(r, own[r[0]])) for r in rows)


def test_partners_take_one_shuffle_of_the_spans(spark):
    """Rows for each start and end, shuffled and written again and again, took 16 times the table in disk."""
    spans = spark.range(20_000).selectExpr(
        "cast(id / 4 as long) as doc_id", "id as ord", "cast(id % 4 * 5 as int) as start", "cast(id % 4 * 5 + 7 as int) as end"
    )
    kept = pathlib.Path(spark.conf.get("spark.checkpoint.dir"), "inkbar")
    before = set(kept.glob("*"))
    counted = span_rows.span_overlap_pairs(spans)
    assert Counter(r.n_partners for r in counted.collect()) == {1: 10_000, 2: 10_000}
    assert sum(spark.read.parquet(str(p)).count() for p in set(kept.glob("*")) - before) <= 5_000
    plan = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Generate" not in plan


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_queries_read_files_and_folders(spark, tmp_path, parts):
    from inkbar.plans.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("stream_redact", "stream_mark_cached"):
        one = sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
        assert sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == one and len(one) == 200


def test_percentiles_with_odd_numbers_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SMALL", 20)
    monkeypatch.setattr(metrics, "BOUNDS", 8)
    inf = float("inf")
    values = [float(i * i % 997) for i in range(500)] + [inf, -inf, inf]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "v double").repartition(3)
    asked = (-5, 0, 37.5, 50, 99.9, 100, 130)
    got = {r.pct: r.value for r in metrics.latency_percentiles(df, "v", asked).collect()}
    assert got == {float(p): rounded_rank(values, p) for p in asked}


def test_scorer_records_outside_their_text_are_told_apart(spark):
    from inkbar.operators.model import misplaced_raw_spans

    raw = [("g", None, 0.9, -2, 3), ("g", None, 0.9, 4, 99), ("g", None, 0.9, 5, 2), ("g", None, 0.9, 1, 4)]
    df = spark.createDataFrame([("abcdef", raw)], f"text string, raw {S.RAW_SPANS_DDL}")
    row = df.select(
        normalize_raw_spans(F.col("text"), F.col("raw"), F.lit(0.0)).alias("ok"),
        misplaced_raw_spans(F.col("text"), F.col("raw")).alias("bad"),
    ).first()
    assert [(s.text, s.start, s.end) for s in row.ok] == [("bcd", 1, 4)]
    assert [(s.start, s.end) for s in row.bad] == [(-2, 3), (4, 99), (5, 2)]


def test_files_by_key_write_one_file_for_each_key(spark, tmp_path):
    """More keys than folders, one key twice, one value null: as Spark's partitioned text files, without a folder for each."""
    rows = [(i, f"я {i}\r\n.") for i in range(1500)] + [(7, "again"), (1500, None)]
    out = tmp_path / "notes"
    sinks.files_by_key(spark.createDataFrame(rows, "k long, value string"), "k", str(out))
    assert len(list(out.iterdir())) <= sinks.SHELVES and not list(out.glob("*/.*"))
    docs = src.read_text_documents(spark, str(out)).select(F.regexp_extract("doc_id", r"k=(\d+)\.txt$", 1).alias("k"), "text")
    got = {int(r.k): r.text for r in docs.collect()}
    assert sorted(got.pop(7).splitlines()) == sorted(["я 7", ".", "again"]) and got.pop(1500) == "\n"
    assert got == {i: f"я {i}\r\n.\n" for i in range(1500) if i != 7}
    assert src.filter_text_files(src.read_uploads(spark, str(out))).count() == 1501


@pytest.mark.parametrize("name", ["read_text_documents", "redact_stored_files"])
def test_stored_files_do_not_each_take_a_folder(spark, tmp_path, name):
    from inkbar.plans.queries import QUERIES

    spark.range(1200).selectExpr("id as s_suppkey", "concat('S', id) as s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("inkbar/*"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 1200
    stored = [f for new in set(shared.glob("inkbar/*")) - before for f in new.rglob("*s_suppkey*") if f.is_file()]
    assert len(stored) == 1200 and len({f.parent for f in stored}) <= 512
