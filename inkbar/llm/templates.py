"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-case word tokens in which numbers, names
(capitalised words, ``MOST_NAMES`` on end at most) and units after a number are
typed placeholders.  Digit groups with an inner comma or point are one number.  A capital that begins
a sentence may be a name or not, and so may those of a longer series of capitals, so items and documents are
read both ways.  Windows of ``SHINGLE`` template tokens are looked up by hash.
A benchmark item is found in a document if ``NEED`` of its windows (80% of a
shorter item's) stand there in the same order, within a small drift for words
put in or left out, and if its slots are filled consistently: equal values of the
item are equal values in the document.  So a question with other numbers or names is
found, while a text that only shares its form by chance is not.

An item of n windows that needs k of them must show one of its n - k + 1 rarest, those that the
fewest other items share.  Only these are looked up first; an item and a text that they join are then
compared on all windows, pair by pair.  So openings that thousands of questions share cost
nothing unless one of the questions is there.

The benchmark is cut in blocks of bounded size; each block's window table is
broadcast and all documents are read against it.  Documents are not shuffled; what
leaves a pass is one narrow row for each item found in a document.

Defined cases: null and empty texts hold nothing and are clean; an item without
words is found nowhere; an item of fewer than ``SHINGLE`` tokens is found
only as a whole document; windows with fewer than two plain words are not used.
Repeated rows and repeated items give equal answers.  Empty tables: every document is clean.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbar.llm.kernel import ALNUM, Tokens, lower, pieces, text_bytes, windows
from inkbar.llm.rows import boxed, unboxed
from inkbar.plans.scratch import written

SHINGLE = 5
NEED = 9
COVER = 0.8
CONSISTENT = 0.8
MOST_NAMES = 4
BLOCK_WINDOWS = 1_000_000

UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles g kg mg gram grams "
    "kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons tonne tonnes "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years percent "
    "dollar dollars euro euros cent cents usd eur degree degrees meter meters metre metres"
).split()
_NUMBER, _NAME, _UNIT = (np.uint64(0xA5A5_0000_0000_0001 + k) for k in range(3))
_BITS = 22
_PAIRS = 1 << 20  # of windows and items, looked at together


@dataclass
class Template:
    """Tokens of several rows: plain hashes, template hashes, first token of each row.

    In ``initial`` capitals that begin a sentence, or stand in a long series, are names too.
    """

    plain: np.ndarray
    template: np.ndarray
    row: np.ndarray
    initial: np.ndarray


_STOP = np.zeros(256, dtype=bool)
_STOP[np.frombuffer(b".!?\n", dtype=np.uint8)] = True


def _unit_hashes() -> np.ndarray:
    data, offsets = text_bytes(pa.array(UNITS))
    return np.sort(Tokens(data, offsets, ALNUM).hashes())


def _joined(tokens: Tokens, lead: np.ndarray) -> np.ndarray:
    """Which tokens go on a number: digits right after digits and an inner comma or point."""
    digit = (tokens.data >= 48) & (tokens.data <= 57)
    others = np.concatenate([[0], np.cumsum(~digit)])
    whole = others[tokens.end] == others[tokens.start]
    inner = tokens.data[np.minimum(tokens.end, len(tokens.data) - 1)]
    on = np.zeros(len(tokens), dtype=bool)
    on[1:] = (
        whole[:-1] & lead[1:] & (tokens.start[1:] == tokens.end[:-1] + 1) & ((inner[:-1] == 44) | (inner[:-1] == 46))
    )
    on[tokens.row[:-1][tokens.row[:-1] < len(tokens)]] = False
    return on


def template(column: pa.Array) -> Template:
    raw, raw_at = text_bytes(column)
    data, at = text_bytes(lower(column))
    tokens, written_as = Tokens(data, at, ALNUM), Tokens(raw, raw_at, ALNUM)
    plain = tokens.hashes()
    if not len(tokens):
        return Template(plain, plain, tokens.row, plain)
    lead = data[tokens.start]
    head = np.flatnonzero(~_joined(tokens, (lead >= 48) & (lead <= 57)))
    last = np.append(head[1:], len(tokens)) - 1
    place = np.arange(len(tokens)) - np.repeat(head, last - head + 1)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(place.max()), 0x9E3779B97F4A7C15, dtype=np.uint64)))
    plain = np.add.reduceat(plain * power[place], head)
    row = np.searchsorted(head, tokens.row)
    start, end, raw_start, raw_end = tokens.start[head], tokens.end[last], written_as.start[head], written_as.end[last]
    n, lead = len(head), lead[head]
    number = (lead >= 48) & (lead <= 57)
    # a first letter is a capital if lower case changes it
    bytes_of = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    capital = np.zeros(n, dtype=bool)
    for k in range(4):
        here = np.minimum(start + k, len(data) - 1)
        there = np.minimum(raw_start + k, len(raw) - 1)
        capital |= (bytes_of > k) & (data[here] != raw[there])
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    first = np.zeros(n, dtype=bool)
    first[row[:-1][row[:-1] < n]] = True
    begins = first.copy()
    begins[1:] |= stops[raw_start[1:]] > stops[raw_end[:-1]]
    long = end - start > bytes_of
    # more than MOST_NAMES capitals on end are a way of writing, not names
    shout = capital | number
    edge = np.flatnonzero(np.concatenate([[True], (shout[1:] != shout[:-1]) | first[1:], [True]]))
    run = np.repeat(np.diff(edge), np.diff(edge))
    initial = capital & ~number & long
    name = initial & (run <= MOST_NAMES) & ~begins
    units = _unit_hashes()
    place = np.minimum(np.searchsorted(units, plain), len(units) - 1)
    unit = np.zeros(n, dtype=bool)
    unit[1:] = (units[place[1:]] == plain[1:]) & number[:-1] & ~first[1:]
    typed, every = (
        np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(x, _NAME, plain))) for x in (name, initial)
    )
    return Template(plain, typed, row, every)


def _windows(t: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes, offsets by row, and which windows hold two plain words."""
    hashes, at = windows(t.template, t.row, SHINGLE)
    literal = np.concatenate([[0], np.cumsum(t.plain == t.template)])
    starts = np.repeat(t.row[:-1] - at[:-1], np.diff(at)) + np.arange(at[-1])
    ends = np.minimum(starts + SHINGLE, np.repeat(t.row[1:], np.diff(at)))
    return hashes, at, literal[ends] - literal[starts] >= 2


class Index:
    """The windows of a block of benchmark items."""

    def __init__(self, ids: list[int | None], texts: pa.Array):
        t = template(texts)
        hashes, at, useful = _windows(t)
        # documents written without capitals, or in capitals only, show no names
        flat = replace(t, template=np.where(t.template == _NAME, t.plain, t.template))
        flat_hashes, _, flat_useful = _windows(flat)
        all_hashes, _, all_useful = _windows(replace(t, template=t.initial))
        item = np.repeat(np.arange(len(ids)), np.diff(at))
        place = np.arange(len(hashes)) - at[item]
        self.n = np.bincount(item[useful | flat_useful], minlength=len(ids))
        other = flat_useful & (hashes != flat_hashes)
        more = all_useful & (hashes != all_hashes)
        hashes = np.concatenate([hashes[useful], flat_hashes[other], all_hashes[more]])
        item = np.concatenate([item[useful], item[other], item[more]])
        place = np.concatenate([place[useful], place[other], place[more]])
        self.need = np.minimum(NEED, np.ceil(COVER * self.n)).astype(np.int64)
        self.ids, self.t = ids, t
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        # of each item, its entries
        order = np.lexsort((hashes, item))
        self.of_item, self.hash, self.place = np.searchsorted(item[order], np.arange(len(ids) + 1)), hashes[order], place[order]
        # a place is as common as the most shared of its readings
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        by_place = np.lexsort((-times[back], place, item))
        head = np.ones(len(by_place), dtype=bool)
        head[1:] = (np.diff(item[by_place]) != 0) | (np.diff(place[by_place]) != 0)
        common = times[back][by_place][head]
        spot = np.cumsum(head) - 1
        owner = item[by_place][head]
        rarest = np.lexsort((common, owner))
        rank = np.empty(len(rarest), dtype=np.int64)
        rank[rarest] = np.arange(len(rarest)) - np.searchsorted(owner[rarest], owner[rarest])
        places = np.bincount(owner, minlength=len(ids))
        rare = rank < (places - self.need + 1)[owner]
        some = by_place[rare[spot]]
        some = some[np.argsort(hashes[some], kind="stable")]
        self.rare_hash, self.rare_item = hashes[some], item[some]

    def _consistent(self, doc: Template, base: int, item: int, at: np.ndarray, to: np.ndarray) -> bool:
        """Whether the item's slots that the matched windows cover have steady values."""
        own = self.t.row[item]
        length = min(SHINGLE, int(self.t.row[item + 1] - own))
        x = (to[:, None] + np.arange(length)).ravel() + own
        y = (at[:, None] + np.arange(length)).ravel() + base
        slot = self.t.plain[x] != self.t.template[x]
        # a word that begins a sentence fills a slot if it was changed, or stands in another slot
        begins = (self.t.plain[x] != self.t.initial[x]) & ~slot
        slot |= begins & (
            (self.t.plain[x] != doc.plain[y]) | np.isin(self.t.plain[x], self.t.plain[x[slot]])
        )
        pairs = np.unique(np.stack([x[slot].astype(np.uint64), self.t.plain[x[slot]], doc.plain[y[slot]]]), axis=1)
        if np.sum(pairs[1] == pairs[2]) >= CONSISTENT * pairs.shape[1]:
            return True  # the item's own values
        held, times = np.unique(pairs[1], return_counts=True)
        again = pairs[:, np.isin(pairs[1], held[times > 1])]
        _, value, times = np.unique(again[1:], axis=1, return_index=True, return_counts=True)
        best: dict[int, int] = {}
        for v, n in zip(again[1][value].tolist(), times.tolist()):
            best[v] = max(best.get(v, 0), n)
        return sum(best.values()) >= CONSISTENT * again.shape[1]

    def search(self, column: pa.Array) -> list[tuple[int, int, float, bool]]:
        """(row, item, share of its windows, same slots) of every item found."""
        doc = template(column)
        hashes, at, useful = _windows(doc)
        if not len(hashes) or not len(self.hash):
            return []
        all_hashes, _, all_useful = _windows(replace(doc, template=doc.initial))
        more = np.flatnonzero(all_useful & (all_hashes != hashes))
        spot = np.concatenate([np.flatnonzero(useful), more])
        hashes = np.concatenate([hashes[useful], all_hashes[more]])
        near = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        hashes, spot = hashes[near], spot[near]
        row = np.searchsorted(at, spot, side="right") - 1
        order = np.lexsort((hashes, row))
        hashes, row, here = hashes[order], row[order], (spot - at[row])[order]
        found = []
        for k, i in self._candidates(hashes, row):
            first, last = np.searchsorted(row, [i, i + 1])
            got = self._matched(k, hashes[first:last], here[first:last])
            if got is not None:
                told = self._ordered(doc, i, k, *got)
                if told is not None:
                    found.append(told)
        return sorted(found)

    def _candidates(self, hashes: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """Items and rows that a rare window joins, ``_PAIRS`` pairs looked at together."""
        low = np.searchsorted(self.rare_hash, hashes, side="left")
        n = np.searchsorted(self.rare_hash, hashes, side="right") - low
        row, low, n = row[n > 0], low[n > 0], n[n > 0]
        if not len(n):
            return []
        # a window that stands often in a row counts once
        _, once = np.unique(row * np.int64(len(self.rare_hash) + 1) + low, return_index=True)
        row, low, n = row[once], low[once], n[once]
        done, codes, total = 0, np.zeros(0, np.int64), np.cumsum(n)
        while done < len(n):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, side="right")))
            part = slice(done, stop)
            entry = np.repeat(low[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(n[part].sum())
            code = self.rare_item[entry] + np.repeat(row[part], n[part]) * len(self.ids)
            codes, done = np.union1d(codes, code), stop
        return list(zip((codes % len(self.ids)).tolist(), (codes // len(self.ids)).tolist()))

    def _matched(self, k: int, hashes: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Places in a row and in item ``k`` of all windows they share, by place in the item."""
        own = slice(self.of_item[k], self.of_item[k + 1])
        low = np.searchsorted(hashes, self.hash[own], side="left")
        n = np.searchsorted(hashes, self.hash[own], side="right") - low
        if np.count_nonzero(n) < self.need[k]:
            return None
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(self.place[own], n)
        order = np.lexsort((here[entry], place))
        return here[entry][order], place[order]

    def _ordered(self, doc: Template, row: int, k: int, here: np.ndarray, place: np.ndarray) -> tuple | None:
        """What ``search`` tells of item ``k`` in a row, if its windows stand there in order, slots alike."""
        base = int(doc.row[row])
        shift = here - place
        drift = max(5, int(self.n[k]) // 4)
        by_shift = np.sort(shift)
        count = np.searchsorted(by_shift, by_shift + drift, side="right") - np.arange(len(shift))
        for start in np.unique(by_shift[count >= self.need[k]]).tolist():
            on = (shift >= start) & (shift <= start + drift)
            to, pick = np.unique(place[on], return_index=True)
            places = here[on][pick]
            if len(to) < self.need[k]:
                continue
            if self._consistent(doc, base, k, places, to):
                a, b = doc.plain[base + places], self.t.plain[self.t.row[k] + to]
                return row, k, len(to) / float(self.n[k]), bool((a == b).all())
        return None


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in blocks of about ``BLOCK_WINDOWS`` words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(words / (4 * BLOCK_WINDOWS)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.filter(block == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, tkey, item_id, share, same``: the items found in each document.

    ``share`` is the part of the item's windows, ``same`` tells whether the words of the
    matched places are the item's own; ``tkey`` is the md5 of the text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("tkey"))
    out = None
    for block in _blocks(benchmark):
        rows = block.collect()
        index = spark.sparkContext.broadcast(
            Index([r.item_id for r in rows], pa.array([r.text for r in rows], pa.string()))
        )

        def run(batches, index=index):
            for batch in pieces(batches):
                found = index.value.search(batch.column("text"))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        batch.column("tkey").take(at),
                        pa.array([index.value.ids[f[1]] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.float64()),
                        pa.array([f[3] for f in found], pa.bool_()),
                    ],
                    names=["doc_id", "tkey", "item_id", "share", "same"],
                )

        part = texts.mapInArrow(
            run, "doc_id long, tkey string, item_id long, share double, same boolean"
        )
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, varied_ids``, a row for each row of docs.

    ``item_ids`` are the items found, in order; ``varied_ids`` those of them found
    with other words in the matched places than the item's own.
    """
    found = (
        written(leaks(docs, benchmark), "leaks")
        .groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t"))
        .agg(
            F.sort_array(F.collect_set("item_id")).alias("item_ids"),
            F.sort_array(F.collect_set(F.when(~F.col("same"), F.col("item_id")))).alias("varied_ids"),
        )
    )
    none = F.array().cast("array<bigint>")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("tkey"))
        .join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left")
        .select(
            "doc_id",
            F.col("t").isNotNull().alias("contaminated"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"),
            F.coalesce("varied_ids", none).alias("varied_ids"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = written(
        leaks(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")), "leaks"
    )
    keyed = boxed(docs, doc_id=F.col("doc_id").cast("long"), key=F.md5("text"))
    return unboxed(
        keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_t")), "left_anti")
    )
