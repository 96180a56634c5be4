"""Greedy choices between overlapping spans, however many spans one document has.

Spans are range-partitioned by (key, start, order), once, and each sorted partition is read in
order.  Keys that lie inside a partition are settled there.  A partition's first key may
go on from the partition before, and its last one in the partition behind; rows that this could
change are written undecided, together with a few rows on what the partition
does to the choice.  Those are put together, and the undecided rows are read once more.
Neither a document nor an island of overlapping spans is ever gathered.

*Sweep*.  A span is kept if it begins at or after the end of the last kept one, the cursor.  What a
partition does to the cursor of its first key is a step function: from a cursor, the first span
at or behind it is kept, and the chain of kept spans from there is settled.  Only steps that
spans of earlier partitions reach are read, in order, to pass the cursor on.

*Resolve*.  A span is kept if it overlaps none kept before it in a given order.  A
partition settles all spans whose overlaps, and theirs that come before, lie inside it; the others go to another
round over other partitions, without what is settled.  When few are left their keys are
settled whole.  Documents in which the order follows the start are swept instead, as they would make
long chains from partition to partition.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkbar.plans.scratch import written

# so few undecided spans are settled by whole keys: the most that one task may get
FEW = 1 << 20


def _laid(spans: DataFrame, key: str, order: str) -> DataFrame:
    """Any columns in ``row``, beside the key, the span and its order."""
    return spans.select(
        F.struct(*(F.col(f"`{c}`") for c in spans.columns)).alias("row"),
        F.col(key).alias("k"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"),
        F.col(order).alias("o"),
    )


def _ranged(laid: DataFrame, parts: int) -> DataFrame:
    return laid.repartitionByRange(parts, "k", "s", "o").sortWithinPartitions("k", "s", "o")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _told(laid: DataFrame) -> T.StructType:
    """``laid`` with a verdict; or, with ``kind``, what is said of a key in a partition."""
    o = laid.schema["o"].dataType
    more = [
        ("kept", T.BooleanType()), ("part", T.IntegerType()), ("kind", T.StringType()), ("low", T.LongType()),
        ("out", T.LongType()), ("before", T.LongType()), ("o_first", o), ("o_last", o), ("fits", T.BooleanType()),
    ]
    own = [(f.name, f.dataType) for f in laid.schema.fields]
    return T.StructType([T.StructField(n, t) for n, t in own + more])


def _batch(like: pa.Schema, size: int, columns: dict) -> pa.RecordBatch:
    kinds = {
        **{f.name: f.type for f in like}, "kept": pa.bool_(), "part": pa.int32(), "kind": pa.string(), "low": pa.int64(),
        "out": pa.int64(), "before": pa.int64(), "o_first": like.field("o").type, "o_last": like.field("o").type,
        "fits": pa.bool_(),
    }
    made = []
    for name, kind in kinds.items():
        value = columns.get(name)
        if value is None:
            made.append(pa.nulls(size, kind))
        elif isinstance(value, pa.Array):
            made.append(value)
        else:
            made.append(pa.array([value] * size if not isinstance(value, list) else value, kind))
    return pa.RecordBatch.from_arrays(made, names=list(kinds))


class _Keys:
    """Tells, batch by batch, where a new key begins."""

    def __init__(self, *names: str):
        self.names, self.last = names, None

    def new(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, dtype=bool)
        for name in self.names:
            codes = np.asarray(batch.column(name).dictionary_encode(null_encoding="encode").indices)
            out[1:] |= codes[1:] != codes[:-1]
        first = tuple(batch.column(n)[0].as_py() for n in self.names)
        out[0] = first != self.last
        self.last = tuple(batch.column(n)[-1].as_py() for n in self.names)
        return out


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name), dtype=np.int64)


def _swept(start: list[int], end: list[int], new: list[bool], cursor: int) -> tuple[list[bool], int]:
    kept = []
    for s, e, n in zip(start, end, new):
        if n:
            cursor = 0
        kept.append(s >= cursor)
        if s >= cursor:
            cursor = e
    return kept, cursor


def _steps(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """A cursor of up to ``low`` (and above ``before``) leaves the spans as ``out``."""
    n = len(start)
    follow = np.maximum(np.searchsorted(start, end), np.arange(1, n + 1)).tolist()
    out = end.tolist()
    for i in range(n - 1, -1, -1):
        if follow[i] < n:
            out[i] = out[follow[i]]
    first = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
    low, out = start[first], np.array(out)[first]
    last = np.append(out[1:] != out[:-1], True)
    low, out = low[last], out[last]
    return low, out, [None, *low[:-1].tolist()]


def _sweep_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, keys, cursor, first = TaskContext.get().partitionId(), _Keys("k"), 0, True
    starts, ends, key_first, last, reach, schema = [], [], None, None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, e, new, n = _ints(batch, "s"), _ints(batch, "e"), keys.new(batch), batch.num_rows
        if schema is None:
            schema, key_first, new[0] = batch.schema, batch.column("k").slice(0, 1), False
        stop = 0
        if first:
            stop = int(np.argmax(new)) if new.any() else n
            starts.append(s[:stop])
            ends.append(e[:stop])
            first = not new.any()
        kept, cursor = _swept(s[stop:].tolist(), e[stop:].tolist(), new[stop:].tolist(), cursor)
        if not first:
            begin = int(np.flatnonzero(new)[-1]) if new.any() else 0
            reach = max(0 if new.any() else reach, int(e[begin:].max()))
            last = batch.column("k").slice(n - 1, 1)
        verdict = pa.array([None] * stop + kept, pa.bool_())
        yield _batch(schema, n, {**dict(zip(batch.schema.names, batch.columns)), "kept": verdict, "part": part})
    if schema is None:
        return
    start, end = np.concatenate(starts), np.concatenate(ends)
    low, out, before = _steps(start, end)
    yield _batch(
        schema, len(low),
        {"k": key_first.take(pa.array(np.zeros(len(low), np.int64))), "part": part, "kind": "step", "low": low.tolist(),
         "out": out.tolist(), "before": before},
    )
    yield _batch(schema, 1, {"k": key_first, "part": part, "kind": "edge", "out": int(end.max())})
    if not first:
        yield _batch(schema, 1, {"k": last, "part": part, "kind": "edge", "out": reach})
        yield _batch(schema, 1, {"k": last, "part": part, "kind": "cursor", "out": cursor})


def _pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cursor with which each partition's first key begins, from steps in order."""
    keys, cursor, at, done = _Keys("k"), 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, cursors = [], []
        rows = (batch.column(c).to_pylist() for c in ("part", "kind", "low", "out"))
        for new, part, kind, low, out in zip(keys.new(batch).tolist(), *rows):
            if new:
                cursor, at = 0, None
            if kind == "cursor":
                cursor = out
            else:
                if part != at:
                    at, done = part, False
                    parts.append(part)
                    cursors.append(cursor)
                if not done and low >= cursor:
                    cursor, done = out, True
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(cursors, pa.int64())], names=["part", "cursor"])


def _sweep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, cursor = _Keys("part"), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        # a partition's first key alone is undecided, so the key changes with the partition
        new, begin = keys.new(batch), _ints(batch, "cursor")
        kept: list[bool] = []
        edges = sorted({0, *np.flatnonzero(new).tolist()}) + [batch.num_rows]
        s, e = _ints(batch, "s").tolist(), _ints(batch, "e").tolist()
        for low, high in zip(edges, edges[1:]):
            if new[low]:
                cursor = int(begin[low])
            part, cursor = _swept(s[low:high], e[low:high], [False] * (high - low), cursor)
            kept += part
        yield batch.filter(pa.array(kept)).select(["row"])


def sweep(spans: DataFrame, key: str, order: str) -> DataFrame:
    """Spans that begin at or after the end of the last kept one, in order of start and ``order``."""
    laid, n = _laid(spans, key, order), _parts(spans)
    told = written(_ranged(laid, n).mapInArrow(_sweep_parts, _told(laid)), "swept")
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # two rows for each partition at most
    reach = told.filter("kind = 'edge'").select(
        F.col("k").alias("_k"), F.col("part").alias("_part"), F.max("out").over(earlier).alias("reach")
    )
    steps = (
        told.filter("kind = 'step'")
        .join(reach, F.col("k").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_part")))
        .filter("before is null or before < reach")
        .select("k", "part", "kind", "low", "out")
    )
    chains = steps.unionByName(told.filter("kind = 'cursor'").select("k", "part", "kind", "low", "out"))
    cursors = (
        chains.repartition("k").sortWithinPartitions("k", "part", F.col("kind") == "cursor", "low")
        .mapInArrow(_pass_on, "part int, cursor long")
    )
    rest = (
        told.filter("kind is null and kept is null")
        .join(F.broadcast(cursors), "part")  # one row for each partition
        .repartitionById(n, "part")
        .sortWithinPartitions("part", "s", "o")
        .select("row", "part", "s", "e", "cursor")
        .mapInArrow(_sweep_rest, T.StructType([laid.schema["row"]]))
    )
    return told.filter("kept").select("row.*").unionByName(rest.select("row.*"))


def _choose(order: list, start: list[int], end: list[int], exposed: list[bool]) -> list[bool | None]:
    """Kept, dropped or (None) not known of the spans of an island, by ``order``.

    ``exposed`` spans may overlap spans that are not here.  Kept spans, and stretches
    under doubt, do not overlap, so both are lists in order that are searched by halving.
    """
    if len(start) == 1:
        return [None if exposed[0] else True]
    kept_s: list[int] = []
    kept_e: list[int] = []
    open_s: list[int] = []
    open_e: list[int] = []
    out: list[bool | None] = [False] * len(start)
    for i in sorted(range(len(start)), key=lambda i: (order[i] is not None, order[i])):
        s, e = start[i], end[i]
        at = bisect_left(kept_s, e)
        if at and kept_e[at - 1] > s:
            continue
        at = bisect_left(open_s, e)
        if exposed[i] or (at and open_e[at - 1] > s):
            out[i] = None
            low, high = bisect_right(open_e, s), bisect_left(open_s, e)
            if low < high:
                s, e = min(s, open_s[low]), max(e, open_e[high - 1])
            open_s[low : max(low, high)], open_e[low : max(low, high)] = [s], [e]
        else:
            out[i] = True
            at = bisect_right(kept_s, s) if e > s else bisect_left(kept_s, s)
            kept_s.insert(at, s)
            kept_e.insert(at, e)
    return out


class _Islands:
    """Reads sorted spans of one key after another and settles them island by island.

    Batches wait until all their rows are settled: those of the island that is being read.
    """

    def __init__(self):
        self.waiting: list[pa.RecordBatch] = []
        self.verdicts: list[bool | None] = []
        self.island: tuple[list, list, list, list] = ([], [], [], [])
        self.reach = 0

    def close(self, known: bool = True) -> None:
        if self.island[0]:
            self.verdicts += _choose(*self.island) if known else [None] * len(self.island[0])
            self.island = ([], [], [], [])

    def read(self, batch: pa.RecordBatch, new: np.ndarray, exposed: np.ndarray, skip: int = 0) -> None:
        """``skip`` first rows are left undecided."""
        self.waiting.append(batch)
        self.verdicts += [None] * skip
        rest = batch.slice(skip)
        columns = rest.column("o").to_pylist(), _ints(rest, "s").tolist(), _ints(rest, "e").tolist()
        for o, s, e, n, x in zip(*columns, new[skip:].tolist(), exposed[skip:].tolist()):
            if n or s >= self.reach:
                self.close()
                self.reach = e
            elif e > self.reach:
                self.reach = e
            for column, value in zip(self.island, (o, s, e, x)):
                column.append(value)

    def settled(self) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        while self.waiting and len(self.verdicts) >= self.waiting[0].num_rows:
            batch = self.waiting.pop(0)
            n = batch.num_rows
            yield batch, pa.array(self.verdicts[:n], pa.bool_())
            del self.verdicts[:n]


def _resolve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, keys, islands = TaskContext.get().partitionId(), _Keys("k"), _Islands()
    first, schema, edge = True, None, None

    def out(batch: pa.RecordBatch, verdict: pa.Array) -> pa.RecordBatch:
        return _batch(schema, batch.num_rows, {**dict(zip(batch.schema.names, batch.columns)), "kept": verdict, "part": part})

    def said() -> pa.RecordBatch:
        return _batch(schema, 1, {"part": part, "kind": "edge", **edge})

    for batch in batches:
        if not batch.num_rows:
            continue
        new, n = keys.new(batch), batch.num_rows
        if schema is None:
            schema, new[0] = batch.schema, False
        s, e, o = _ints(batch, "s"), _ints(batch, "e"), batch.column("o")
        heads = np.flatnonzero(new).tolist()
        stop = 0
        if first:
            stop = heads[0] if heads else n
        # what there is to say of the first key and of the last one
        follows = np.append(True, np.asarray(pc.fill_null(pc.less(o.slice(0, n - 1), o.slice(1)), False))) if n > 1 else np.ones(1, bool)
        pieces = [(0, heads[0] if heads else n), (heads[-1], n)] if heads else [(0, n)]
        for low, high in pieces:
            if low == high:
                continue
            if edge is None or (low in heads):
                if edge is not None and first:
                    yield said()
                    first = False
                joined, edge = True, {"k": batch.column("k").slice(low, 1), "o_first": o.slice(low, 1), "out": 0, "fits": True}
            else:
                before = edge["o_last"][0].as_py()
                now = o[low].as_py()
                joined = before is not None and now is not None and before < now
            plain = bool((e[low:high] > s[low:high]).all())
            edge["fits"] = edge["fits"] and joined and plain and bool(follows[low + 1 : high].all())
            edge["out"] = max(edge["out"], int(e[low:high].max()))
            edge["low"], edge["o_last"] = int(s[high - 1]), o.slice(high - 1, 1)
        islands.read(batch, new, np.zeros(n, dtype=bool), stop)
        for settled in islands.settled():
            yield out(*settled)
    if schema is None:
        return
    islands.close(known=False)  # the last island may go on in the next partition
    for settled in islands.settled():
        yield out(*settled)
    yield said()


def _resolve_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Undecided rows with the reach of what is before them, and where the rest begins."""
    keys, islands = _Keys("part", "k"), _Islands()
    for batch in batches:
        if not batch.num_rows:
            continue
        reach, behind = _ints(batch, "reach"), _ints(batch, "behind")
        exposed = (_ints(batch, "s") < reach) | (_ints(batch, "e") > behind)
        islands.read(batch, keys.new(batch), exposed)
        for settled, verdict in islands.settled():
            yield pa.RecordBatch.from_arrays([*(settled.column(c) for c in "row k s e o".split()), verdict], names=[*"row k s e o".split(), "kept"])
    islands.close()
    for settled, verdict in islands.settled():
        yield pa.RecordBatch.from_arrays([*(settled.column(c) for c in "row k s e o".split()), verdict], names=[*"row k s e o".split(), "kept"])


def _round(laid: DataFrame, parts: int) -> tuple[list[DataFrame], DataFrame]:
    """Kept rows, and the rows that are still undecided."""
    told = written(_ranged(laid, parts).mapInArrow(_resolve_parts, _told(laid)), "resolved")
    # two rows for each partition at most
    ahead = Window.partitionBy("k").orderBy("part")
    edges = told.filter("kind = 'edge'").select(
        F.col("k").alias("_k"), F.col("part").alias("_part"),
        F.max("out").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"),
        F.when(F.lead("part").over(ahead).isNotNull(), F.col("low")).alias("behind"),
        (F.col("fits") & F.coalesce(F.lag("o_last").over(ahead) < F.col("o_first"), F.lag("part").over(ahead).isNull())).alias("fits"),
    )
    of_key = Window.partitionBy("_k")
    edges = written(
        edges.withColumn("fits", F.min("fits").over(of_key) & (F.count("*").over(of_key) > 1)), "resolved-edges"
    )
    rows = (
        told.filter("kind is null and kept is null")
        .select("row", "k", "s", "e", "o", "part")
        .join(F.broadcast(edges), F.col("k").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_part")))
    )
    kept = [told.filter("kept").select("row")]
    if not edges.filter("fits").isEmpty():
        chained = rows.filter("fits").select("row", "k", F.col("s").alias("start"), F.col("e").alias("end"), "o")
        kept.append(sweep(chained, "k", "o").select("row"))
    none = np.iinfo(np.int64)
    rest = (
        rows.filter("not fits")
        .withColumns({"reach": F.coalesce("reach", F.lit(int(none.min))), "behind": F.coalesce("behind", F.lit(int(none.max)))})
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "k", "s", "o")
    )
    schema = T.StructType([*laid.schema.fields, T.StructField("kept", T.BooleanType())])
    settled = written(rest.mapInArrow(_resolve_rest, schema), "resolved-rest")
    return [*kept, settled.filter("kept").select("row")], settled.filter("kept is null").select("row", "k", "s", "e", "o")


def _whole(laid: DataFrame) -> DataFrame:
    """All of a key's rows settled by one task."""
    schema = T.StructType([*laid.schema.fields, T.StructField("kept", T.BooleanType())])
    none = np.iinfo(np.int64)
    ready = laid.withColumns({"part": F.lit(0), "reach": F.lit(int(none.min)), "behind": F.lit(int(none.max))})
    sorted_ = ready.repartition("k").sortWithinPartitions("k", "s", "o")
    return sorted_.mapInArrow(_resolve_rest, schema).filter("kept").select("row")


def resolve(spans: DataFrame, key: str, order: str, few: int = FEW) -> DataFrame:
    """Spans that overlap none that was kept before them in the order of ``order``."""
    open_rows, parts, before = _laid(spans, key, order), _parts(spans), None
    kept: list[DataFrame] = []
    while True:
        more, open_rows = _round(open_rows, parts)
        kept += more
        left = open_rows.count()
        if left <= few:
            break
        # other cuts; fewer of them where a round has settled little
        parts = parts + 1 if before is None or left < 0.9 * before else max(1, parts // 2)
        before = left
    if left:
        kept.append(_whole(open_rows))
    every = kept[0]
    for rows in kept[1:]:
        every = every.unionByName(rows)
    return every.select("row.*")
