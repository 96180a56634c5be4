"""Ranked search against scoring every document for every query."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkbar.llm import lexical

SCHEMA = "doc_id long, text string, m string, term string, block string"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _TERM.findall((text or "").translate(_LOWER))


def plain_search(docs, queries, best=10):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, every = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, counts in held:
            m = 10 + 90 * sum(counts.values()) * n // every
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in terms if t in counts
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scored[:best])]
    return key_sorted(out)


def key_sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block", [40, 600, 1 << 20])
def test_search_equals_brute_force(spark, block):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "É", "x9"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    made = lambda n: " ".join(rng.choice(vocabulary, size=n, p=weight / weight.sum()))
    docs = [(i, made(int(rng.integers(0, 40)))) for i in range(300)]
    docs += [(400 + i, "copy of the same words W1 w2") for i in range(25)] + [(7, "twice w3 w3"), (7, "twice w3 w3")]
    docs += [(None, "w5 w6 rare"), (None, "w5 w6 rare"), (None, None), (900, None), (901, ""), (902, "?! --"), (903, "long " * 5000 + "rare")]
    queries = [(i, made(int(rng.integers(1, 12)))) for i in range(20)]
    queries += [(50, "copy same"), (51, "nothing that-occurs"), (52, ""), (53, None), (None, "rare W5"), (54, "w1"), (54, "w2 rare"), (55, "LONG")]
    table = spark.createDataFrame([(*d, "own", "own", "own") for d in docs], SCHEMA)
    asked = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "1 as no", "2 as part")
    index = lexical.build(table, block=block)
    assert key_sorted(lexical.search(index, asked).collect()) == plain_search(docs, queries)
    assert key_sorted(lexical.search(index, asked, best=3).collect()) == plain_search(docs, queries, 3)
    blocks = index.blocks.filter("term is null").collect()
    assert sum(b["size"] for b in blocks) == sum(bool(words(t)) for _, t in docs)
    assert all(b.m == sorted(b.m) for b in blocks) and (block > 40 or len(blocks) > 20)


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(60)]
    queries = [(i, f"a{i % 3} b{i} c{i * 2}") for i in range(9)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    monkeypatch.setattr(lexical, "QUERY_TERMS", 7)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert lexical._queries(asked).select("part").distinct().count() > 2
    assert key_sorted(lexical.search(index, asked).collect()) == plain_search(docs, queries)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical.search(lexical.build(none), asked).collect() == []
    assert lexical.search(lexical.build(some), asked.limit(0)).collect() == []
    assert [r.item_id for r in lexical.search(lexical.build(some), asked).collect()] == ["q"]


def test_low_strata_are_not_scored(monkeypatch):
    """A stratum whose bound is below the k-th best score is skipped."""
    m = np.array([10] * 20 + list(range(20, 50)))
    sizes = np.array([2] * 20 + [1] * 30)
    terms = np.array([1, 2] * 20 + [2] * 30)
    block = pa.Table.from_batches([lexical._block(0, pa.array(range(50)), m, sizes, terms, np.ones(len(terms), np.int32))])
    table = block.append_column("w", pa.array([1000, 10, None]))
    visited, score = [], lexical._Term.score
    monkeypatch.setattr(lexical._Term, "score", lambda self, chosen, scores: (visited.extend(chosen), score(self, chosen, scores)))

    class Held:
        value = [(1, [1, 2], 0)]

    found = lexical._searched(Held, 10)(table)
    assert found.column("doc_id").to_pylist() == list(range(10)) and set(visited) == {0}
    Held.value = [(1, [2], 0), (2, [1], 10**9), (3, [5], 0)]
    assert set(lexical._searched(Held, 10)(table).column("no").to_pylist()) == {1}
