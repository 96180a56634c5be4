"""How far the sources of a language diverge in their use of words.

The terms that are compared are found by iceberg prefix refinement.  A level counts, for
each language, the documents that hold a term with a given prefix of ``length`` bytes.
Prefixes below the threshold are discarded, and the next level, of twice the length, looks
only at terms that go on from a prefix that is left.  A term that ends within a level's
length is complete and is counted with its occurrences there; levels stop when no prefix is left.
What is left of a level reaches the next as a bitmap, sized by the number of prefixes up to
2 ** ``MOST_BITS`` places.  Hashes that fall together let a prefix through, never stop one,
and complete terms are counted by their bytes, so the kept terms are exact.

From the second level on, a level also writes what is open of each document (its terms that are longer), so
later levels read short rests and not the texts.  Counts are summed in each slice of about
2 MB of text and then map-side.  A source or language may hold any share of the rows.

Shares are exact integers: p = 1 + floor(10**9 * (n + 1) / (N + V)) of a term with n
of the N occurrences of V kept terms, and one use diverges from another by
floor((p - q)**2 / q).  Sums over all kept terms for all pairs of sources of a language are
matrices over slices of terms; neither pairs of rows nor terms that a source lacks are written.

Defined cases: null text, language or source is the empty string.  A language
without a kept term gives its pairs the value 0.  Repeated rows are documents of their own.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbar.llm.kernel import LETTERS, Tokens, mix, pieces, text_bytes
from inkbar.plans.scratch import written

THRESHOLD = 3
FIRST = 4
TOP_TERMS = 200
MOST_BITS = 28
_LEVEL = "lang string, source string, term binary, key long, docs long, n long, rest string"
_CELLS = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_ROW = np.uint64(_BASE)
_BACK = pow(_BASE, -1, 1 << 64)


class _Hashed:
    """Hashes of any stretches of a byte string, from running sums."""

    def __init__(self, data: np.ndarray):
        def powers(x: int) -> np.ndarray:
            steps = np.full(len(data) + 1, x, dtype=np.uint64)
            steps[0] = 1
            return np.cumprod(steps)

        self.back = powers(_BACK)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = pc.fill_null(column, "").dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()


def _seed(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")


def _summed(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A place of each distinct key, and its sums of weights."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    heads = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return order[heads], [np.add.reduceat(w[order], heads) for w in weights]


def _stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Parts of a byte string as binary values."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    out = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())]
    )


class _Held:
    """Counts by key over many slices: some ``most`` rows are held, then summed, then let go."""

    def __init__(self, most: int = 1 << 19):
        self.most, self.rows, self.parts = most, 0, []

    def add(self, key: np.ndarray, sums: list[np.ndarray], values: list[pa.Array]) -> list:
        self.parts.append((key, sums, values))
        self.rows += len(key)
        if self.rows < self.most:
            return []
        self._sum()
        return self.let_go() if self.rows > self.most // 2 else []

    def _sum(self) -> None:
        keys, sums, values = zip(*self.parts)
        key = np.concatenate(keys)
        first, sums = _summed(key, *(np.concatenate(x) for x in zip(*sums)))
        pick = pa.array(first)
        self.parts = [(key[first], sums, [pa.concat_arrays(x).take(pick) for x in zip(*values)])]
        self.rows = len(first)

    def let_go(self) -> list:
        """All that is held, as (key, sums, values)."""
        if self.parts:
            self._sum()
        out, self.parts, self.rows = self.parts, [], 0
        return out


def _spliced(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> tuple[pa.Array, np.ndarray]:
    """The tokens of each row, with blanks between, for the rows that have some."""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    from_ = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    out = data[np.minimum(from_, len(data) - 1)]
    out[at[1:] - 1] = 32
    some = np.unique(row)
    ends = at[np.searchsorted(row, some, side="right")]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
    return column.cast(pa.string()), some


def _level(before: int, length: int, left, keep_rest: bool) -> Callable:
    """The counts of one level over (lang, source, text), and the rests it leaves."""

    def told(columns: dict, size: int) -> pa.RecordBatch:
        fields = [(f.split()[0], f.split()[1]) for f in _LEVEL.split(", ")]
        kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [columns[n].cast(kinds[k]) if n in columns else pa.nulls(size, kinds[k]) for n, k in fields],
            names=[n for n, _ in fields],
        )

    def terms_told(rows: list) -> Iterator[pa.RecordBatch]:
        for _, (docs, n), (lang, source, term) in rows:
            yield told(
                {"lang": lang, "source": source, "term": term, "docs": pa.array(docs), "n": pa.array(n)}, len(docs)
            )

    def prefixes_told(rows: list) -> Iterator[pa.RecordBatch]:
        for key, (docs,), _ in rows:
            yield told({"key": pa.array(key.view(np.int64)), "docs": pa.array(docs)}, len(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete, prefixes = _Held(), _Held()
        for batch in pieces(batches):
            raw, at = text_bytes(batch.column("text"))
            data = _LOWER[raw]
            tokens = Tokens(data, at, LETTERS)
            (lang, langs), (source, sources) = _codes(batch.column("lang")), _codes(batch.column("source"))
            lang_seeds, source_seeds = (np.array([_seed(x) for x in names], dtype=np.uint64) for names in (langs, sources))
            row = np.repeat(np.arange(batch.num_rows), np.diff(tokens.row))
            start, end = tokens.start, tokens.end
            hashed = _Hashed(data)
            if before:
                long = end - start > before
                start, end, row = start[long], end[long], row[long]
                keys = mix(hashed.of(start, start + before) ^ lang_seeds[lang[row]])
                bits = left.value
                place = (keys >> np.uint64(64 - bits[0])).astype(np.int64)
                alive = (bits[1][place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                start, end, row = start[alive], end[alive], row[alive]
            if not len(start):
                continue
            ends_here = end - start <= length
            names = lambda values, code: pa.array(values, pa.string()).take(pa.array(code))
            # complete terms: documents and occurrences by language and source
            s, e, r = start[ends_here], end[ends_here], row[ends_here]
            if len(s):
                whole = hashed.of(s, e)
                first, (n,) = _summed(mix(whole + r.astype(np.uint64) * _ROW), np.ones(len(s), np.int64))
                of = r[first]
                key = mix(mix(whole[first] ^ lang_seeds[lang[of]]) + source_seeds[source[of]])
                some, (docs, n) = _summed(key, np.ones(len(first), np.int64), n)
                pick = first[some]
                values = [names(langs, lang[r[pick]]), names(sources, source[r[pick]]), _stretches(data, s[pick], e[pick])]
                yield from terms_told(complete.add(key[some], [docs, n], values))
            # prefixes of longer ones: documents by language
            s, e, r = start[~ends_here], end[~ends_here], row[~ends_here]
            if len(s):
                keys = mix(hashed.of(s, s + length) ^ lang_seeds[lang[r]])
                first, _ = _summed(mix(keys + r.astype(np.uint64) * _ROW))
                some, (docs,) = _summed(keys[first], np.ones(len(first), np.int64))
                yield from prefixes_told(prefixes.add(keys[first][some], [docs], []))
                if keep_rest:
                    rest, some = _spliced(data, s, e, r, batch.num_rows)
                    yield told({"lang": names(langs, lang[some]), "source": names(sources, source[some]), "rest": rest}, len(some))
        yield from terms_told(complete.let_go())
        yield from prefixes_told(prefixes.let_go())

    return run


def _bitmap(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, packed table) of the leading bits of all ``key`` values; (0, ..) if there are none."""
    n = keys.count()
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(16 * n)))) if n else 0
    if not n:
        return 0, np.zeros(0, dtype=np.uint8)
    at = (F.shiftrightunsigned("key", 64 - bits) + 1).cast("long")
    rows = (
        keys.groupBy(F.bitmap_bucket_number(at).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .toLocalIterator()
    )
    table = np.zeros(max(1 << (bits - 3), 4096), dtype=np.uint8)
    for r in rows:  # 4 kB each, 2 ** bits / 8 bytes in all
        part = np.frombuffer(r.bits, dtype=np.uint8)
        table[(r.bucket - 1) * 4096 : r.bucket * 4096] |= part
    return bits, table


def iceberg_terms(docs: DataFrame, threshold: int = THRESHOLD, first: int = FIRST) -> DataFrame:
    """``lang, source, term (binary), docs, n``: counts of the terms of each language that
    at least ``threshold`` of its documents hold, and of some others; ``kept_terms`` tells them."""
    context = docs.sparkSession.sparkContext
    rest = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    )
    before, length, left, tables = 0, first, None, []
    while True:
        level = _level(before, length, left, keep_rest=before > 0)
        told = written(rest.mapInArrow(level, _LEVEL), "iceberg-level")
        tables.append(told.filter("term is not null").select("lang", "source", "term", "docs", "n"))
        alive = written(
            told.filter("key is not null").groupBy("key").agg(F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= threshold).select("key"),
            "iceberg-prefixes",
        )
        bits, table = _bitmap(alive)
        if not bits:
            break
        left = context.broadcast((bits, table))
        if before:
            rest = told.filter("rest is not null").select("lang", "source", F.col("rest").alias("text"))
        before, length = length, 2 * length
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every


def source_places(docs: DataFrame) -> DataFrame:
    """``lang, source, own``: the sources of each language, numbered from 0."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return docs.select(named("lang"), named("source")).distinct().withColumn("own", number)


def kept_terms(docs: DataFrame, places: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``lang, term, n, uses``: each kept term of a language, its occurrences, and those of each source.

    Counts are dealt by language and term once; what a task sends of a term is one row for each source.
    """
    counts = iceberg_terms(docs, threshold).join(places, ["lang", "source"]).select("lang", "term", "own", "docs", "n")
    return (
        counts.repartition("lang", "term")
        .groupBy("lang", "term", "own")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("own", "n")).alias("uses"))
        .filter(F.col("docs") >= threshold)
        .drop("docs")
    )


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (n + 1) / total), exact."""
    if len(n) and int(n.max()) >= 9_000_000_000:  # beyond 64 bits
        return (1 + 10**9 * (n.astype(object) + 1) // total.astype(object)).astype(np.int64)
    return 1 + 10**9 * (n + 1) // total


def _compared(top: int):
    """Sums over terms of how far each source's shares are from each other one's, and the
    terms (``item``) that each source uses most beyond its language, the ``top`` of a task."""
    order = [("own", "ascending"), ("value", "descending"), ("item", "ascending")]

    def first(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order).combine_chunks()
        own = np.asarray(rows.column("own"))
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))
        return rows.filter(pa.array(place < top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        best: dict[str, pa.Table] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, table in sums.items():
                own, other = np.divmod(np.arange(table.size), len(table))
                items = first(best[lang])
                n, size = items.num_rows, table.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (size + n), pa.string()),
                        pa.concat_arrays([pa.array(own.astype(np.int32)), *items.column("own").chunks]),
                        pa.concat_arrays([pa.array(other.astype(np.int32)), pa.nulls(n, pa.int32())]),
                        pa.concat_arrays([pa.array(table.ravel()), *items.column("value").chunks]),
                        pa.concat_arrays([pa.nulls(size, pa.binary()), *items.column("item").chunks]),
                    ],
                    names=["lang", "own", "other", "value", "item"],
                )
            sums.clear()
            best.clear()

        for batch in batches:
            lang, langs = _codes(batch.column("lang"))
            for code, name in enumerate(langs):
                rows = np.flatnonzero(lang == code)
                totals = np.array(batch.column("totals")[int(rows[0])].as_py(), dtype=np.int64)
                terms, whole = (batch.column(c)[int(rows[0])].as_py() for c in ("terms", "all_total"))
                totals += terms
                absent = _shares(np.zeros(len(totals), np.int64), totals)
                into = sums.setdefault(name, np.zeros((len(totals), len(totals)), dtype=np.int64))
                step = max(1, _CELLS // len(totals))
                for i in range(0, len(rows), step):
                    some = pa.array(rows[i : i + step])
                    uses = batch.column("uses").take(some)
                    own, n = (np.asarray(x) for x in uses.flatten().flatten())
                    which = np.repeat(np.arange(len(some)), np.asarray(pc.list_value_length(uses)))
                    p = _shares(n, totals[own])
                    q = _shares(np.asarray(batch.column("n").take(some)), np.full(len(some), whole + terms))[which]
                    table = np.repeat(absent[:, None], len(some), axis=1)
                    table[own, which] = p
                    for one in range(len(totals)):
                        off = table[one] - table
                        into[one] += (off * off // table).sum(axis=1)
                    more = np.flatnonzero(p > q)
                    off = (p - q)[more]
                    found = pa.table({
                        "own": pa.array(own[more].astype(np.int32)), "value": pa.array(off * off // q[more]),
                        "item": batch.column("term").take(some).take(pa.array(which[more])),
                    })
                    held = [best[name], first(found)] if name in best else [first(found)]
                    best[name] = pa.concat_tables(held)
                    if best[name].num_rows > 4 * top * len(totals):
                        best[name] = first(best[name])
            if sum(t.size for t in sums.values()) > 4 * _CELLS:
                yield from flush()
        yield from flush()

    return run


def audit(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``docs``.

    Part ``pair``: how far the source is from each other source (``item``) of its language.  Part
    ``term``: the ``top`` terms that the source uses more than its language does.
    """
    places = written(source_places(docs), "iceberg-sources")
    kept = written(kept_terms(docs, places, threshold), "iceberg-kept")
    totals = (
        kept.select("lang", F.explode("uses").alias("u"))
        .groupBy("lang", F.col("u.own").alias("own")).agg(F.sum("u.n").alias("total"))
    )
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all_total"))
    # one row for each language: the totals of its sources in order
    by_lang = written(
        places.join(totals, ["lang", "own"], "left")
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("own", F.coalesce("total", F.lit(0)).alias("total")))).alias("s"))
        .join(whole, "lang")
        .select("lang", F.col("s.total").alias("totals"), "terms", "all_total"),
        "iceberg-totals",
    )
    told = written(
        kept.join(by_lang, "lang").mapInArrow(_compared(top), "lang string, own int, other int, value long, item binary"),
        "iceberg-compared",
    )
    sums = told.filter("other is not null").groupBy("lang", "own", "other").agg(F.sum("value").alias("value"))
    others = places.select("lang", F.col("own").alias("other"), F.col("source").alias("item"))
    pairs = (
        places.join(others, "lang")
        .filter("own <> other")
        .join(sums, ["lang", "own", "other"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    terms = (
        told.filter("other is null").join(places, ["lang", "own"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    )
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(first).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= top))
