"""Ranked lexical search over a length-stratified index.

A term is a run of letters, digits and characters beyond ASCII, with A-Z lower-cased, known
by a 64-bit hash.  Documents of one normaliser m = 10 + floor(90 * n * N / L) form a stratum (n terms
in the document, N documents with terms, L terms in all).

``build`` turns each document into its terms and their counts once and packs the strata, in order of m, into
partitions of equal numbers of postings (a large stratum spans several, dealt by a hash of the id).
Each sorted partition is cut into blocks of about ``BLOCK`` postings.  A block's row for a term lists its documents in runs of equal (m, count),
so what a posting adds to a score is computed once for each run:
w * floor(10**9 * tf / (1000 * tf + 8 * m)), w = floor(1000 * ln((2N + 2) / (2df + 1))).

``search`` sends the postings of the queries' terms to their block's task.  For each query, the sum
over its terms of the greatest addition in a stratum bounds all scores there.  Strata are visited
in falling order of the bound until it is below the k-th best score so far; equal scores are
decided by doc_id, so a bound that equals it is still visited.  A sixteenth of the blocks is searched
first, and its k-th best scores are the starting point for the others.  Nothing is skipped that
could be among the best, so results are exact.

Queries are held in blocks of ``QUERY_TERMS`` terms, each with one pass of its own over the
postings of its terms.  Sums are 64-bit integers.

Defined cases: null and empty texts have no terms and are never found.  A null doc_id comes last
among equal scores; of repeated rows each is a document.  Queries of one id are one query with
the terms of all; a null id is an id.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbar.llm.kernel import ALNUM, Tokens, mix, pieces, text_bytes
from inkbar.operators.ordered import with_running
from inkbar.plans.scratch import written

BEST = 10
BLOCK = 1 << 20
QUERY_TERMS = 200_000
PROBE = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROW = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max
_VECTORS = "doc_id long, n long, terms array<long>, tf array<int>"
_BLOCKS = (
    "block long, term long, size long, m array<long>, tf array<int>, run array<int>, doc array<int>, ids array<long>"
)


@dataclass
class Index:
    """``blocks``: for each block a row for each term, and one (term null) of its documents."""

    blocks: DataFrame
    docs: int
    terms: int


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its terms' number; of all its distinct terms, row by row: row, hash, count."""
    raw, at = text_bytes(column)
    tokens = Tokens(_LOWER[raw], at, ALNUM)
    n = np.diff(tokens.row)
    row, hashes = np.repeat(np.arange(len(n)), n), tokens.hashes()
    _, first, tf = np.unique(mix(hashes + row.astype(np.uint64) * _ROW), return_index=True, return_counts=True)
    order = np.argsort(first)  # by row
    first = first[order]
    return n, row[first], hashes[first].view(np.int64), tf[order]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        n, row, terms, tf = _counted(batch.column("text"))
        some = np.flatnonzero(n)
        at = np.append(np.searchsorted(row, some), len(row))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(some)), pa.array(n[some], pa.int64()),
             _lists(terms, at, pa.int64()), _lists(tf.astype(np.int32), at, pa.int32())],
            names=[f.split()[0] for f in _VECTORS.split(", ")],
        )


def _block(number: int, ids: pa.Array, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The rows of one block, its documents in order of m."""
    doc = np.repeat(np.arange(len(m)), sizes)
    order = np.lexsort((-tf, m[doc], terms))
    terms, tf, doc = terms[order], tf[order], doc[order]
    of = m[doc]
    new = np.ones(len(terms), dtype=bool)
    new[1:] = (terms[1:] != terms[:-1]) | (of[1:] != of[:-1]) | (tf[1:] != tf[:-1])
    runs = np.flatnonzero(new)
    head = np.ones(len(runs), dtype=bool)
    head[1:] = terms[runs[1:]] != terms[runs[:-1]]
    first = np.flatnonzero(head)  # of each term, its first run
    run_at, doc_at = np.append(first, len(runs)), np.append(runs[first], len(terms))
    # the documents are one more row, whose term is null
    last = lambda x: np.append(x, x[-1])
    documents = np.append(np.zeros(len(first), np.int32), [0, len(m)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first) + 1, number)),
            pa.array(np.append(terms[runs[first]], 0), mask=np.append(np.zeros(len(first), bool), True)),
            pa.array(np.append(np.diff(doc_at), len(m)).astype(np.int64)),
            _lists(np.concatenate([of[runs], m]), np.append(run_at, len(runs) + len(m)), pa.int64()),
            _lists(tf[runs], last(run_at), pa.int32()),
            _lists(np.diff(np.append(runs, len(terms))).astype(np.int32), last(run_at), pa.int32()),
            _lists(doc.astype(np.int32), last(doc_at), pa.int32()),
            pa.ListArray.from_arrays(pa.array(documents, pa.int32()), ids),
        ],
        names=[f.split()[0] for f in _BLOCKS.split(", ")],
    )


def _cut(size: int) -> Callable:
    """Blocks of about ``size`` postings of a partition in order of m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        total = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: table.column(c).combine_chunks()
            terms, tf = column("terms"), column("tf")
            return _block(
                number, column("doc_id"), np.asarray(column("m")), np.diff(np.asarray(terms.offsets)),
                np.asarray(terms.flatten()), np.asarray(tf.flatten()),
            )

        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("terms").offsets))
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if total and total + n > size:
                    held.append(batch.slice(start, i - start))
                    yield close()
                    number, start, total = number + 1, i, 0
                    held.clear()
                total += n
            held.append(batch.slice(start))
        if total:
            yield close()

    return run


def build(docs: DataFrame, text: str = "text", block: int = BLOCK) -> Index:
    """The index of all rows of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    vectors = written(rows.mapInArrow(_vectors, _VECTORS), "lexical-vectors")
    n, terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wide = lambda x, digits: F.lit(x).cast(f"decimal({digits},0)")
    over = F.call_function("div", wide(90, 2) * F.col("n").cast("decimal(12,0)") * wide(n, 19), wide(max(terms, 1), 19))
    vectors = vectors.withColumn("m", F.lit(10) + over)
    strata = vectors.groupBy("m").agg(F.sum(F.size("terms")).alias("postings")).withColumn("all", F.lit(0))
    strata = written(with_running(strata, "all", ["m"], {"before": F.col("postings")}).drop("all"), "lexical-strata")
    total = strata.agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (2 * block)))
    # a place among the postings in order of m: that of the stratum, and a hash of the id within it
    spot = F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = F.floor((F.col("before") + spot * F.col("postings")) * parts / max(total, 1)).cast("int")
    placed = (
        vectors.join(strata, "m")
        .select("doc_id", "m", "terms", "tf", F.least(part, F.lit(parts - 1)).alias("part"))
        .repartitionById(parts, "part")
        .sortWithinPartitions("m", "doc_id")
        .select("doc_id", "m", "terms", "tf")
    )
    return Index(written(placed.mapInArrow(_cut(block), _BLOCKS), "lexical-index"), n, terms)


def _queries(queries: DataFrame) -> DataFrame:
    """``no, item_id, terms, part``: each query with its number and the block of queries it is in."""

    def run(batches):
        for batch in pieces(batches):
            _, row, terms, _ = _counted(batch.column("text"))
            rows = pa.RecordBatch.from_arrays([pa.array(row), pa.array(terms)], names=["at", "term"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(rows.column("at")), rows.column("term")], names=["item_id", "term"]
            )

    kind = queries.schema["item_id"].dataType.simpleString()
    rows = queries.select("item_id", F.col("text").cast("string").alias("text"))
    items = (
        rows.mapInArrow(run, f"item_id {kind}, term long")
        .groupBy("item_id")
        .agg(F.collect_set("term").alias("terms"))
        .withColumn("all", F.lit(0))
    )
    placed = with_running(items, "all", ["item_id"], {"no": F.lit(1), "_before": F.size("terms")})
    return written(
        placed.select("no", "item_id", "terms", F.floor(F.col("_before") / QUERY_TERMS).alias("part")), "lexical-queries"
    )


class _Term:
    """The postings of a term in a block: what each run adds, and its documents."""

    def __init__(self, weight: int, m, tf, run, doc, strata: np.ndarray):
        m, tf = np.asarray(m), np.asarray(tf).astype(np.int64)
        self.adds = weight * (10**9 * tf // (1000 * tf + 8 * m))
        self.stratum = np.searchsorted(strata, m)
        self.at = np.concatenate([[0], np.cumsum(np.asarray(run))])
        self.doc = np.asarray(doc)
        first = np.ones(len(m), dtype=bool)
        first[1:] = self.stratum[1:] != self.stratum[:-1]
        # counts fall within a stratum, so the first run there adds most
        self.strata, self.most = self.stratum[first], self.adds[first]

    def score(self, chosen: np.ndarray, scores: np.ndarray) -> None:
        """Add to ``scores`` what the term adds in the ``chosen`` strata (in order)."""
        low, high = np.searchsorted(self.stratum, chosen), np.searchsorted(self.stratum, chosen, side="right")
        some = high > low
        if not some.any():
            return
        low, n = low[some], (high - low)[some]
        runs = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        size = self.at[runs + 1] - self.at[runs]
        place = np.arange(size.sum()) + np.repeat(self.at[runs] - np.cumsum(size) + size, size)
        scores[self.doc[place]] += np.repeat(self.adds[runs], size)


def _searched(held, best: int) -> Callable:
    """The best documents of a block for each query in ``held``: (number, terms, least score)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        terms = rows.column("term").to_pylist()
        head = terms.index(None)
        value = lambda c, i: rows.column(c)[i].values
        ids = value("ids", head)
        m = np.asarray(value("m", head))
        strata, low = np.unique(m, return_index=True)
        high = np.append(low[1:], len(m))
        id_key = np.asarray(ids.fill_null(_NONE))
        missing = np.asarray(ids.is_null())
        weights = rows.column("w").to_pylist()
        known = {
            t: _Term(weights[i], value("m", i), value("tf", i), value("run", i), value("doc", i), strata)
            for i, t in enumerate(terms)
            if t is not None
        }
        scores = np.zeros(len(m), dtype=np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for number, asked, least in held.value:
            here = [known[t] for t in asked if t in known]
            bounds = np.zeros(len(strata), dtype=np.int64)
            for t in here:
                bounds[t.strata] += t.most
            order = np.argsort(-bounds, kind="stable")
            floor, done, step = max(1, least), 0, 1
            docs = np.zeros(0, dtype=np.int64)
            kept = np.zeros(0, dtype=np.int64)
            while done < len(order) and bounds[order[done]] >= floor:
                chosen = order[done : done + step]
                chosen = np.sort(chosen[bounds[chosen] >= floor])
                for t in here:
                    t.score(chosen, scores)
                n = (high - low)[chosen]
                seen = np.arange(n.sum()) + np.repeat(low[chosen] - np.cumsum(n) + n, n)
                found = seen[scores[seen] >= floor]
                docs = np.concatenate([docs, found])
                kept = np.concatenate([kept, scores[found]])
                scores[seen] = 0
                first = np.lexsort((id_key[docs], missing[docs], -kept))[:best]
                docs, kept = docs[first], kept[first]
                if len(docs) == best:
                    floor = max(floor, int(kept[-1]))
                done, step = done + step, 2 * step
            out.append((np.full(len(docs), number), docs, kept))
        numbers, docs, kept = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"no": pa.array(numbers, pa.int64()), "doc_id": ids.take(pa.array(docs, pa.int64())), "score": pa.array(kept, pa.int64())})

    return run


def _best(found: DataFrame, best: int) -> DataFrame:
    first = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= best)


def search(index: Index, queries: DataFrame, best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of each query ``(item_id, text)``."""
    spark = index.blocks.sparkSession
    asked = _queries(queries)
    found = spark.createDataFrame([], "no long, doc_id long, score long")
    heads = index.blocks.filter("term is null").withColumn("w", F.lit(None).cast("long"))
    for part in [r.part for r in asked.select("part").distinct().orderBy("part").collect()]:
        items = asked.filter(F.col("part") == part)
        wanted = written(items.select(F.explode("terms").alias("term")).distinct(), "lexical-wanted")
        df = index.blocks.select("term", "size").join(wanted, "term").groupBy("term").agg(F.sum("size").alias("df"))
        weight = F.floor(1000 * F.ln(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1)))
        weights = written(df.select("term", weight.cast("long").alias("w")), "lexical-weights")
        rows = index.blocks.join(weights, "term").select(*index.blocks.columns, "w").unionByName(heads)
        held = [(r.no, r.terms) for r in items.select("no", "terms").collect()]  # QUERY_TERMS terms and one query
        probe = F.pmod(F.xxhash64("block"), F.lit(PROBE)) == 0
        floors: dict[int, int] = {}
        for turn in (probe, ~probe):
            shared = spark.sparkContext.broadcast([(no, terms, floors.get(no, 0)) for no, terms in held])
            told = rows.filter(turn).groupBy("block").applyInArrow(_searched(shared, best), found.schema)
            told = written(_best(told, best), "lexical-found")
            floors = {r.no: r.score for r in told.filter(F.col("rank") == best).select("no", "score").collect()}
            found = found.unionByName(told.drop("rank"))
    return _best(found, best).join(asked.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")
