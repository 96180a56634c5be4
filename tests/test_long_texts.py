"""A scorer limited to some characters against the same scorer without a limit; verdicts in one pass."""

import random
import re

import pytest

from inkbar.operators import long_texts
from inkbar.operators.model import detect_batch
from inkbar.operators.validate import validate_requests
from inkbar.operators.verdicts import split_requests

NAMES = re.compile(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*|#+|\d{3,}")


def make(limit=None):
    def build():
        def predict(texts):
            assert limit is None or all(len(t) <= limit for t in texts)
            return [
                [{"entity_group": "name" if m[0][0].isalpha() else "mark" if m[0][0] == "#" else None, "entity": "number",
                  "score": 0.9 if len(m[0]) % 2 else 0.7, "start": m.start(), "end": m.end()} for m in NAMES.finditer(t)]
                for t in texts
            ]

        return predict

    return build


def texts():
    rnd = random.Random(8)
    words = ["ann", "Bob", "Cy Dee", "x" * 30, "#" * 9, "4711", "12", "Eve Fay Guy", "\U0001f600"]
    out = [" ".join(rnd.choice(words) for _ in range(n)) for n in (0, 1, 5, 40, 300, 2000, 2500)]
    long = "a " + "#" * 700 + " b " + "#" * 333 + " Cy " + "7" * 250
    return [*out, None, "", "#" * 64, "#" * 65, "#" * 500, long, out[4], out[4]]


def told(df):
    return [[(s.entity, s.text, s.start, s.end) for s in r.spans] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("limit, overlap", [(64, 32), (128, 30), (10_000, 40)])
def test_a_limited_scorer_gives_the_spans_of_an_unlimited_one(spark, limit, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, text string").repartition(3)
    got = long_texts.detect_long(df, make(limit), limit, overlap, batch_chars=500)
    assert told(got) == told(detect_batch(df, make())) and got.columns == ["i", "text", "spans"]
    high = long_texts.detect_long(df, make(limit), limit, overlap, min_score=0.8)
    assert {s.score for r in high.collect() for s in r.spans} == {0.9}


def test_windows_of_a_text_are_rows(spark):
    df = spark.createDataFrame([(1, "x" * 6400), (2, ""), (3, None)], "_id long, text string")
    rows = long_texts.windows(df, 64, 32).collect()
    assert sum(r._id == 1 for r in rows) == 199 and sum(r._id == 2 for r in rows) == 1 and all(r._id != 3 for r in rows)
    assert all(len(r._part) == 64 for r in rows if r._id == 1) and sum(r._last for r in rows) == 2
    with pytest.raises(ValueError):
        long_texts.detect_long(df, make(), 10, 10)


def test_verdicts_in_one_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            read.add(len(b))
            yield b

    schema = "req_id long, text string, min_score double, mask_char string"
    rows = [(i, None if i % 9 == 0 else "x" * (i % 50), 1.5 if i % 7 == 0 else 0.5, "**" if i % 5 == 0 else "*") for i in range(200)]
    plain = spark.createDataFrame(rows, schema)
    split = split_requests(plain.mapInPandas(once, schema), 40, str(tmp_path / "v"))
    accepted, rejects = validate_requests(plain, 40)
    assert sorted(map(str, split.accepted.collect())) == sorted(map(str, accepted.collect()))
    columns = rejects.columns
    assert sorted(map(str, split.rejects.select(*columns).collect())) == sorted(map(str, rejects.collect()))
    assert read.value == 200  # judged and read once, counts included
    by = {r.reason: r["count"] for r in rejects.groupBy("reason").count().collect()}
    assert split.counts == {**by, None: accepted.count()} and split.accepted.columns == plain.columns
    none = split_requests(plain.limit(0), 40)
    assert none.counts == {None: 0} and none.accepted.count() == none.rejects.count() == 0


def test_stitching_takes_the_window_that_holds_a_span_whole():
    # windows [0, 20), [10, 30): the first sees [12, 20) cut, the second all of it
    found = [(0, False, "n", 12, 20, 0.5), (10, True, "n", 12, 24, 0.6), (10, True, "n", 26, 28, 0.7)]
    assert long_texts.stitched(found, 20, 10) == [(12, 24, "n", 0.6), (26, 28, "n", 0.7)]
    assert long_texts.stitched([(0, False, "n", 0, 20, 0.5), (10, True, "n", 10, 30, 0.6)], 20, 10) == [(0, 30, "n", 0.6)]
