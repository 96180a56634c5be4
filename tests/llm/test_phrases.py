"""Phrase fingerprints against a plain parse and exact sets."""

import hashlib

import pytest

from inkbar.llm import phrases

SCHEMA = "doc_id long, text string, part string, last string"


def plain_phrases(text):
    """The phrase set by definition: the shortest run that is new, again and again."""
    known, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        if end > len(text):
            break
        known.add(text[at:end])
        at = end
    return known


def plain_likeness(one, other):
    a, b = plain_phrases(one), plain_phrases(other)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), sha, plain_likeness(text, edited), plain_likeness(text, after)))
    return out


def told(rows):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in rows), key=key)


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_neighbours_equal_brute_force_on_odd_rows(spark, partitions):
    words = "the cat sat on a mat and saw the cat ".split()
    rows = [(i * 7 % 61, " ".join(words[(i + k * k) % len(words)] for k in range(i % 23))) for i in range(50)]
    rows += [(None, "no id"), (None, None), (None, "no id"), (100, None), (101, ""), (-(2**63), "least"), (2**63 - 1, "é😀é😀é😀")]
    rows += [(5, "tie b"), (5, "tie a"), (5, "tie a"), (200, "x" * 90), (201, "ab")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
        got = phrases.with_neighbours(table).collect()
        assert phrases.with_neighbours(table.limit(0)).collect() == []
        one = phrases.with_neighbours(table.filter("doc_id = 201")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    small = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got]
    assert told(small) == told(plain_rows(rows))  # sets of fewer than KEPT phrases: exact
    assert one.near_next == one.near_edited == 1.0 and one.n_chars == 2


def test_equal_texts_have_equal_fingerprints_and_estimates_are_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in phrases.with_neighbours(docs).collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, text in texts.items():
        assert got[i].fingerprint == phrases.fingerprint(text) == prints.setdefault(text, got[i].fingerprint)
    plain = {r[0]: r for r in plain_rows([(i, t) for i, t in texts.items()])}
    assert all(got[i].edited_sha256 == r[2] for i, r in plain.items())
    off = [abs(got[i].near_edited - r[3]) for i, r in plain.items()] + [abs(got[i].near_next - r[4]) for i, r in plain.items()]
    assert max(off) < 0.2 and sum(off) / len(off) < 0.04
    assert sum(got[i].near_edited > got[i].near_next for i in got) >= 0.99 * len(got)


def test_likeness_of_columns_and_fingerprints_without_neighbours(spark):
    rows = [(1, "abcabcabcabd", None, None), (2, "abcabcabcabd", None, None), (3, "zyxw", None, None), (4, None, None, None), (5, "", None, None)]
    prints = phrases.fingerprints(spark.createDataFrame(rows, SCHEMA))
    pairs = prints.toDF("a", "one").crossJoin(prints.toDF("b", "other"))
    got = {(r.a, r.b): r.x for r in pairs.select("a", "b", phrases.likeness("one", "other").alias("x")).collect()}
    assert got[1, 2] == 1.0 and got[1, 3] == 0.0 and got[4, 5] == 1.0 and got[1, 4] == 0.0


def test_long_and_repetitive_texts():
    assert len(phrases.fingerprint("x" * 200_000)) == phrases.KEPT * 12
    text = "".join(chr(33 + (i * i) % 90) for i in range(50_000))
    parsed = phrases._Parsed(text)
    again, sketch = parsed.edited(text[parsed.cut :])
    assert again == text and phrases.likeness_of(sketch, parsed.sketch) == 1.0
