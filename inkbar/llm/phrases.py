"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right: the shortest run of characters that is not yet in
the dictionary is the next phrase and enters it.  What is left at the end is in the
dictionary already and adds nothing.  Texts that compress each other well share phrases,
so the Jaccard similarity of two phrase sets is a compression-like similarity.  Each
phrase is hashed to 48 bits and the ``KEPT`` least hashes are the fingerprint; of two
fingerprints the least hashes of both together are a uniform sample of the union, and
the share that both hold estimates the similarity (exactly, for sets of up to ``KEPT``).

``with_neighbours`` also compares each document with an edited text, its last third
replaced by the beginning of the next document in descending order of doc_id.  Documents
are dealt to range partitions by quantiles of doc_id.  Each partition is sorted and read
once, with the first row of the next partition added at its end: one row for each partition.
The edited text goes on from the dictionary at the cut, so the shared part is parsed once.

Defined cases: null texts count as empty; an empty text has an empty fingerprint, like (1.0)
another empty one and unlike (0.0) any other.  A null doc_id comes last.  Documents of one
doc_id follow each other in order of text, and repeated rows are each other's next.  The
document after the last is the first; a single one is its own next.  Empty tables give empty
results.  Other columns are ignored.  A task holds two texts and their dictionaries at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.llm.kernel import mix

KEPT = 128
_BYTES = 6  # of each hash
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 512  # in an Arrow batch of results
NEIGHBOURS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _grow(text: str, seen: set[str], phrase: str, at: int, ends: list[int]) -> str:
    """Parse on: new phrases go to ``seen``, where they end (after ``at``) to ``ends``.

    ``phrase`` is what was open before ``text``; what is open after it is returned.
    """
    for c in text:
        at += 1
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            ends.append(at)
            phrase = ""
    return phrase


def _sketch(text: str, ends: list[int]) -> np.ndarray:
    """The ``KEPT`` least hashes of the phrases that end at ``ends``, in order."""
    if not ends:
        return np.zeros(0, dtype=np.uint64)
    stop = np.array(ends)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[: stop[-1]]
    start = np.concatenate([[0], stop[:-1]])
    length = stop - start
    power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
    place = np.arange(len(points)) - np.repeat(start, length)
    value = mix(points.astype(np.uint64) + np.uint64(1)) * power[place]
    hashes = mix(np.add.reduceat(value, start) + length.astype(np.uint64)) >> np.uint64(64 - 8 * _BYTES)
    if len(hashes) > 4 * KEPT:
        hashes = hashes[hashes <= np.partition(hashes, 2 * KEPT)[2 * KEPT]]
    return np.unique(hashes)[:KEPT]


def spelled(sketch: np.ndarray) -> str:
    """A fingerprint as text: the hashes in hexadecimal, least first."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :].tobytes().hex()


def likeness_of(one: np.ndarray, other: np.ndarray) -> float:
    """The estimated share of phrases that two texts have in common."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    both, n = np.unique(np.concatenate([one, other]), return_counts=True)
    return float(np.mean(n[:KEPT] == 2))


class _Parsed:
    """A text, its sketch, and the dictionary where its last third begins."""

    def __init__(self, text: str):
        self.text, self.cut = text, len(text) - len(text) // 3
        self.seen: set[str] = set()
        self.ends: list[int] = []
        self.open = _grow(text[: self.cut], self.seen, "", 0, self.ends)
        held, tail = len(self.ends), text[self.cut :]
        whole = self.ends.copy()
        _grow(tail, self.seen, self.open, self.cut, whole)
        self.sketch = _sketch(text, whole)
        starts = [self.ends[-1] if held else 0, *whole[held:-1]]
        self.seen.difference_update(text[s:e] for s, e in zip(starts, whole[held:]))

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last third replaced, and its sketch; the dictionary is used up."""
        new = other[: len(self.text) - self.cut]
        text = self.text[: self.cut] + new
        _grow(new, self.seen, self.open, self.cut, self.ends)
        return text, _sketch(text, self.ends)


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    return spelled(_Parsed(text or "").sketch)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row, without a shuffle."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.string())], names=["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def read(fingerprint: str | None) -> np.ndarray:
    """The hashes that a fingerprint spells."""
    raw = np.frombuffer(bytes.fromhex(fingerprint or ""), dtype=np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 8 - _BYTES :] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def likeness(one: Column | str, other: Column | str) -> Column:
    """How alike two columns of fingerprints are, 0 to 1."""

    @F.pandas_udf("double")
    def compare(a, b):
        return a.combine(b, lambda x, y: likeness_of(read(x), read(y)))

    return compare(one, other)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each told when the next one is read."""
    out: list[list] = [[] for _ in range(7)]

    def full() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(out, kinds)], names=[f.split()[0] for f in NEIGHBOURS.split(", ")]
        )
        for x in out:
            x.clear()
        return batch

    doc_id, before = None, None
    for batch in batches:
        for row_id, value in zip(batch.column("doc_id"), batch.column("text")):
            now = _Parsed(value.as_py() or "")
            if before is not None:
                edited, sketch = before.edited(now.text)
                told = (
                    doc_id, len(before.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    spelled(before.sketch), spelled(sketch),
                    likeness_of(before.sketch, sketch), likeness_of(before.sketch, now.sketch),
                )
                for column, x in zip(out, told):
                    column.append(x)
                if len(out[0]) >= _ROWS:
                    yield full()
            doc_id, before = row_id.as_py(), now
    if out[0]:  # the last row read is the next partition's first, told there
        yield full()


def _part_of(doc_id: Column, splitters: list[int]) -> Column:
    """How many of the descending ``splitters`` exceed the id; null is least.

    They are looked up in two steps, so a row costs about twice their number's root.
    """
    step = max(1, round(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    if not groups:
        return F.lit(0)
    over = lambda values: F.size(F.filter(values, lambda s: doc_id.isNull() | (s > doc_id)))
    longs = lambda values: F.array(*(F.lit(x).cast("long") for x in values))
    whole = over(longs([g[-1] for g in groups]))
    inside = F.get(F.array(*(longs(g) for g in groups)), whole)
    # after the last group come all of them, also where it is shorter than the others
    return F.when(inside.isNull(), len(splitters)).otherwise(whole * step + over(inside))


def with_neighbours(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and how like they and the next text's are."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 100 * n).alias("s")).first()["s"] if n > 1 else []
    splitters = sorted(set(found or []), reverse=True)
    rows = rows.withColumn("part", _part_of(F.col("doc_id"), splitters))
    # the first document of each part: one row for each
    first = rows.groupBy("part").agg(F.max("doc_id").alias("first_id"))
    heads = rows.join(
        F.broadcast(first.withColumnRenamed("part", "_part")),
        (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("first_id")),
    )
    heads = heads.groupBy("part").agg(F.min("text").alias("text"))
    used = sorted(r.part for r in first.select("part").collect())
    if not used:
        return rows.sparkSession.createDataFrame([], NEIGHBOURS)
    before = dict(zip(used, used[-1:] + used[:-1]))
    told = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    ends = heads.select(told[F.col("part")].alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("last"))
    dealt = rows.withColumn("last", F.lit(0)).unionByName(ends)
    return (
        dealt.repartitionById(max(n, len(splitters) + 1), F.col("part").cast("int"))
        .sortWithinPartitions("last", F.desc_nulls_last("doc_id"), "text")
        .select("doc_id", "text")
        .mapInArrow(_neighbours, NEIGHBOURS)
    )
