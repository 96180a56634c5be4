"""Line deduplication by pairwise alignment.

A line is a stretch of words that ends at a line break or at the end of a sentence; lines
are equal if their lower-case words are.  A stretch of lines of ``BLOCK_WORDS`` words or
more that also stands, line by line, in an earlier document goes from the later one,
however many documents hold it.

* A *run* is a shortest series of lines of ``BLOCK_WORDS`` words from a line on, or up to a
  line.  Each common stretch is covered by its runs, so documents are met through run
  hashes: a run pairs a document with the first one that holds it and, if it is rare (in
  ``RARE`` documents at most), with the one before it in order of doc_id.  Each pair is aligned by patience
  diff: lines that are unique in both and in the same order are fixed, equal lines next to
  them join, and the gaps are aligned in the same way.  Aligned blocks of ``BLOCK_WORDS``
  words or more go from the later document.
* What alignment leaves (lines that are not unique, passages in another order, holders that
  are not paired) goes by the runs themselves: every run that an earlier document holds.
  No count bounds this, and no group of documents meets in one task.

Pairs grow with the shared runs, two for each at most.  What is sent for a pair
are two lists of line hashes, never texts.

Defined cases: null and empty texts have no lines.  A null doc_id counts as the latest.  Repeated
rows (same doc_id and text) are one document and leave each other alone.  Ties cannot
occur.  Empty tables give empty results; ``clean`` keeps other columns.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbar.llm.kernel import ALNUM, Tokens, lower, mix, pieces, text_bytes
from inkbar.llm.rows import boxed
from inkbar.operators.skew import join_hot
from inkbar.plans.scratch import written

BLOCK_WORDS = 20
RARE = 64
_DOC = "struct<none:boolean,doc_id:bigint,tkey:string>"
_BLOCKS = "array<struct<first:int,last:int>>"


class Lines:
    """Lines of the rows of a text column: hash, words, first byte, first line of each row.

    Lower case changes no character's kind, so the words of both are the same; only ``hash`` reads it.
    """

    def __init__(self, column: pa.Array):
        raw, raw_at = text_bytes(column)
        there = Tokens(raw, raw_at, ALNUM)
        n = len(there)
        self.column = column
        if not n:
            self.first, self.words, self.start = (np.zeros(0, np.int64) for _ in range(3))
            self.row = np.zeros(len(raw_at), np.int64)
            return
        stop = np.isin(raw, np.frombuffer(b".!?", np.uint8))
        stop[:-1] &= np.isin(raw[1:], np.frombuffer(b" \t\r\n", np.uint8))  # not inside 3.5 or a.b
        stop |= raw == 10
        stops = np.concatenate([[0], np.cumsum(stop)])
        begins = np.zeros(n, dtype=bool)
        begins[there.row[:-1][there.row[:-1] < n]] = True
        begins[0] = True
        begins[1:] |= stops[there.start[1:]] > stops[there.end[:-1]]
        self.first = np.flatnonzero(begins)
        self.words = np.diff(np.append(self.first, n))
        self.start = there.start[self.first]
        self.row = np.searchsorted(self.first, there.row)

    @cached_property
    def hash(self) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, np.uint64)
        data, at = text_bytes(lower(self.column))
        tokens = Tokens(data, at, ALNUM)
        place = np.arange(len(tokens)) - np.repeat(self.first, self.words)
        power = np.cumprod(np.full(int(self.words.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        return mix(np.add.reduceat(tokens.hashes() * power[place], self.first))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks of two lists: (place in a, place in b, length)."""
    found: list[tuple[int, int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0, 1))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1, 1))
        if a0 >= a1 or b0 >= b1:
            continue
        fixed = _unique_in_order(a, a0, a1, b, b0, b1)
        if not fixed:
            continue
        x, y = a0, b0
        for i, j in fixed:
            # equal neighbours before a fixed line join it, the rest is a gap
            s, t = i, j
            while s > x and t > y and a[s - 1] == b[t - 1]:
                s, t = s - 1, t - 1
            found += [(s + k, t + k, 1) for k in range(i - s + 1)]
            if x < s and y < t:
                work.append((x, s, y, t))
            x, y = i + 1, j + 1
        if x < a1 and y < b1:
            work.append((x, a1, y, b1))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def _unique_in_order(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Lines that both stretches hold once, the longest series in the same order."""
    place: dict[int, list[int]] = {}
    for side, values, low, high in ((0, a, a0, a1), (1, b, b0, b1)):
        for k in range(low, high):
            entry = place.setdefault(values[k], [-1, -1])
            entry[side] = k if entry[side] == -1 else -2
    pairs = sorted((i, j) for i, j in place.values() if i >= 0 and j >= 0)
    tops: list[int] = []  # least last place in b of a series of each length
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        before[k] = at[n - 1] if n else -1
        tops[n : n + 1] = [j]
        at[n : n + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _doc() -> Column:
    return F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("tkey")
    )


def lines(docs: DataFrame) -> DataFrame:
    """``doc, hashes, words``: the lines of every row; ``doc`` orders documents."""

    def run(batches):
        for batch in pieces(batches):
            found = Lines(batch.column("text"))
            offsets = pa.array(found.row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.ListArray.from_arrays(offsets, pa.array(found.hash.view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(found.words.astype(np.int32))),
                ],
                names=["doc", "hashes", "words"],
            )

    return docs.select(_doc().alias("doc"), "text").mapInArrow(
        run, f"doc {_DOC}, hashes array<long>, words array<int>"
    )


_STEP = 0xD1342543DE82EF95
_STEP_BACK = pow(_STEP, -1, 1 << 64)


def _runs(hashes: np.ndarray, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, end and hash of every run, in order of the first line; ``row`` as in ``Lines``."""
    n, count = len(hashes), np.diff(row)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    here = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + BLOCK_WORDS, side="left")
    back = np.searchsorted(total, total[1:] - BLOCK_WORDS, side="right") - 1
    fits, reaches = ahead <= np.repeat(row[1:], count), back >= np.repeat(row[:-1], count)
    first = np.concatenate([here[fits], back[reaches]])
    end = np.concatenate([ahead[fits], here[reaches] + 1])
    code = np.unique(first * (n + 1) + end)
    first, end = code // (n + 1), code % (n + 1)
    power, inverse = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_STEP, _STEP_BACK))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1])])
    return first, end, mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))


def _runs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a batch of ``lines``, and the first line of each row."""
    column = batch.column("hashes")
    row = np.asarray(column.offsets, dtype=np.int64)
    hashes, words = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("hashes", "words"))
    row = row - row[0]
    return *_runs(hashes.view(np.uint64), words, row), row


def _run_rows(batches):
    """``doc, hash``: the distinct runs of every row."""
    for batch in batches:
        first, _, key, row = _runs_of(batch)
        of = np.searchsorted(row, first, side="right") - 1
        order = np.lexsort((key, of))
        of, key = of[order], key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(pa.array(of[new])), pa.array(key[new].view(np.int64))], names=["doc", "hash"]
        )


def _long_enough(blocks, words) -> list[dict]:
    return [
        {"first": s, "last": e - 1} for s, e in blocks if sum(words[s:e]) >= BLOCK_WORDS
    ]


def _aligned(batches):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        out = []
        for a, b, words in zip(*(batch.column(c).to_pylist() for c in ("a_hashes", "hashes", "words"))):
            out.append(_long_enough([(j, j + n) for _, j, n in patience(a, b)], words))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, kind)], names=["doc", "blocks"])


def _merged(batches):
    """All blocks of a row, and its runs that an earlier document holds, as one sorted list."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        out, n_removed, w_removed = [], [], []
        first, end, key, row = _runs_of(batch)
        key, at = key.view(np.int64), np.searchsorted(first, row)
        for i, (words, blocks, held) in enumerate(
            zip(*(batch.column(c).to_pylist() for c in ("words", "blocks", "held")))
        ):
            gone = [False] * len(words)
            for block in blocks or []:
                gone[block["first"] : block["last"] + 1] = [True] * (block["last"] - block["first"] + 1)
            own = slice(at[i], at[i + 1])
            known = np.flatnonzero(np.isin(key[own], held or [])) + at[i]
            for s, e in zip((first[known] - row[i]).tolist(), (end[known] - row[i]).tolist()):
                gone[s:e] = [True] * (e - s)
            runs, start = [], None
            for k, dead in enumerate([*gone, False]):
                if dead and start is None:
                    start = k
                elif not dead and start is not None:
                    runs.append({"first": start, "last": k - 1})
                    start = None
            out.append(runs)
            n_removed.append(sum(gone))
            w_removed.append(sum(w for w, dead in zip(words, gone) if dead))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"), pa.array([len(w) for w in batch.column("words")], pa.int64()),
                pa.array(n_removed, pa.int64()), pa.array(w_removed, pa.int64()), pa.array(out, kind),
            ],
            names=["doc", "n_lines", "removed_lines", "removed_words", "removed"],
        )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc, n_lines, removed_lines, removed_words, removed``, a row for each row of docs.

    ``removed`` lists the first and last number of the stretches of lines to delete.
    """
    held = written(lines(docs), "line-hashes")
    one = held.dropDuplicates(["doc"])
    runs = written(
        held.select("doc", "hashes", "words").mapInArrow(_run_rows, f"doc {_DOC}, hash long"), "line-runs"
    )
    shared = written(
        runs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc").alias("head")).filter("n > 1"),
        "line-shared",
    )
    told = written(
        join_hot(runs, shared, "hash", "doc", shared.select("hash", "n")).filter("n > 1 and doc > head"),
        "line-told",
    )
    rare = told.filter(F.col("n") <= RARE)
    # the rows of one rare hash are RARE at most
    one_before = F.lag("doc").over(Window.partitionBy("hash").orderBy("doc"))
    pairs = (
        told.select("doc", F.col("head").alias("a"))
        .union(rare.select("doc", one_before.alias("a")).filter("a is not null and a < doc"))
        .distinct()
    )
    pairs = written(pairs, "line-pairs")
    firsts = one.select(F.col("doc").alias("a"), F.col("hashes").alias("a_hashes"))
    with_first = join_hot(pairs, firsts, "a", "doc")
    both = with_first.join(one, "doc")
    aligned = (
        both.select("doc", "a_hashes", "hashes", "words").mapInArrow(_aligned, f"doc {_DOC}, blocks {_BLOCKS}")
        .filter(F.size("blocks") > 0)
        .select("doc", F.explode("blocks").alias("block"))
        .groupBy("doc").agg(F.collect_set("block").alias("blocks"))
    )
    # a document's own runs, two for each of its lines at most
    known = told.groupBy("doc").agg(F.collect_set("hash").alias("held"))
    return (
        held.join(aligned, "doc", "left").join(known, "doc", "left")
        .mapInArrow(
            _merged,
            f"doc {_DOC}, n_lines long, removed_lines long, removed_words long, removed {_BLOCKS}",
        )
    )


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` and a column ``cleaned``: the text without its repeated lines."""
    gone = repeated_lines(docs).filter("removed_lines > 0").dropDuplicates(["doc"])
    rows = boxed(docs, text=F.col("text"), doc=_doc())
    joined = rows.join(gone.select("doc", "removed"), "doc", "left").select("row", "text", "removed")
    kind = docs.schema.simpleString()

    def run(batches):
        for batch in pieces(batches):
            every, removed = batch.column("text"), batch.column("removed").to_pylist()
            cut = pa.array([bool(blocks) for blocks in removed])
            column = every.filter(cut)
            found = Lines(column)
            data, at = text_bytes(column)
            raw, out = data.tobytes(), []
            for i, blocks in enumerate(blocks for blocks in removed if blocks):
                starts = [*found.start[found.row[i] : found.row[i + 1]].tolist(), int(at[i + 1])]
                kept, here = [], int(at[i])
                for block in blocks:
                    kept.append(raw[here : starts[block["first"]]])
                    here = starts[block["last"] + 1]
                out.append(b"".join([*kept, raw[here : at[i + 1]]]).decode())
            cleaned = pc.replace_with_mask(every, cut, pa.array(out, every.type)) if out else every
            yield pa.RecordBatch.from_arrays([batch.column("row"), cleaned], names=["row", "cleaned"])

    return joined.mapInArrow(run, f"row {kind}, cleaned string").select("row.*", "cleaned")
