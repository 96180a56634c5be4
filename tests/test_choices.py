"""Sweeping and resolving over range partitions against plain greedy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkbar.operators import choices, span_rows

ROWS = "doc_id string, start int, end int, ord long, row string, part string"


def plain_sweep(rows):
    kept, reach = [], {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[3])):
        if r[1] >= reach.get(r[0], 0):
            kept.append(r[3])
            reach[r[0]] = r[2]
    return sorted(kept)


def plain_resolve(rows):
    taken = {}
    for r in sorted(rows, key=lambda r: r[3]):
        own = taken.setdefault(r[0], [])
        if not any(r[2] > t[1] and t[2] > r[1] for t in own):
            own.append(r)
    return sorted(r[3] for own in taken.values() for r in own)


def ords(df):
    return sorted(r.ord for r in df.select("ord").collect())


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, "own", "own") for r in rows], ROWS)


@pytest.fixture()
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def made(kind):
    """A hot document among small ones: all its spans chain, in an order of the given kind."""
    rng = np.random.default_rng(len(kind))
    n = 1500
    start = np.sort(rng.integers(0, 2 * n, size=n))
    size = rng.integers(0 if "empty" in kind else 1, 9, size=n)
    if "cover" in kind:
        size[3] = 2 * n
    if "regular" in kind:
        start, size = np.arange(n), np.full(n, 3)
    order = {"random": rng.permutation(n), "falling": np.arange(n)[::-1]}.get(kind.split()[0], np.arange(n))
    rows = [("hot", int(s), int(s + k), int(o)) for s, k, o in zip(start, size, order)]
    for i in range(120):
        key = None if i % 7 == 0 else f"{'a' if i % 2 else 'z'}{i % 50}"
        s = int(rng.integers(0, 30))
        rows.append((key, s, s + int(rng.integers(0, 12)), n + int(rng.integers(0, 10**6)) * 200 + i))
    return rows


KINDS = ["rising regular", "rising empty", "rising cover", "random empty", "random cover empty", "falling"]


@pytest.mark.parametrize("kind", KINDS)
def test_choices_equal_plain_loops(table, partitions, monkeypatch, kind):
    rows = made(kind)
    partitions(5)
    spans = table(rows)
    swept = span_rows.sweep_rows(spans)
    assert ords(swept) == plain_sweep(rows) and swept.columns == spans.columns
    # few: rounds go on until few spans are undecided
    resolved = choices.resolve(spans, "doc_id", "ord", few=40) if "cover" in kind or kind == "falling" else span_rows.resolve_rows(spans)
    assert ords(resolved) == plain_resolve(rows)


@pytest.mark.parametrize("parts", [1, 23])
def test_any_number_of_partitions_gives_the_same(table, partitions, parts):
    rows = made("random empty")[::3]
    partitions(parts)
    assert ords(span_rows.sweep_rows(table(rows))) == plain_sweep(rows)
    assert ords(span_rows.resolve_rows(table(rows))) == plain_resolve(rows)


def test_empty_tables(table):
    assert span_rows.sweep_rows(table([])).collect() == [] == span_rows.resolve_rows(table([])).collect()


@pytest.mark.parametrize("choose", [choices.sweep, choices.resolve])
def test_one_island_is_spread_over_tasks(spark, partitions, monkeypatch, choose):
    """200,000 spans that all chain: no partition gets more than its share, and few rows go on."""
    partitions(8)
    n = 200_000
    rows = spark.range(n).selectExpr(
        "1 as doc_id", "cast(id as int) as start", "cast(id + 2 + id % 3 as int) as end", "(id * 7919) % 200003 as ord"
    )
    tables, write = [], choices.written
    monkeypatch.setattr(choices, "written", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    kept = choose(rows, "doc_id", "ord").select("start", "end", "ord").toPandas()
    first = tables[0][1]
    shares = [r["count"] for r in first.filter("kind is null").groupBy("part").count().collect()]
    assert len(shares) == 8 and max(shares) < 0.2 * n
    steps = first.filter("kind = 'step'").groupBy("part").agg(F.collect_list("before").alias("b")).collect()
    for r in steps:  # spans of 4 at most reach few steps
        least = min(r.b)
        assert sum(b < least + 6 for b in r.b) < 10
    if choose is choices.resolve:
        assert dict(tables)["resolved-rest"].filter("kept is null").count() < 1000
    spans = kept.sort_values("start")
    assert (spans["start"].to_numpy()[1:] >= spans["end"].to_numpy()[:-1]).all()
    plain = [(1, i, i + 2 + i % 3, (i * 7919) % 200003) for i in range(n)]
    if choose is choices.sweep:
        assert sorted(kept["ord"]) == plain_sweep(plain)
    else:
        used, wanted = np.zeros(n + 8, bool), []
        for _, s, e, o in sorted(plain, key=lambda r: r[3]):
            if not used[s:e].any():
                used[s:e] = True
                wanted.append(o)
        assert sorted(kept["ord"]) == sorted(wanted)
