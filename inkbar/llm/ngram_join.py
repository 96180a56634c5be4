"""N-gram Jaccard join by MinHash banding.

A document is the set of its runs of ``SHINGLE`` words (lower case, separated by
white space); a text of fewer words is one run.  Two documents are linked if the
Jaccard similarity of their sets reaches the threshold.

1. One pass over the texts gives each row the digest of its set and the hashes of
   its MinHash bands.  Rows with equal sets are one class from here on.
2. Bands are shuffled by hash.  A band hash that several classes share ties them to
   its least class, so a bucket of n classes gives n - 1 rows, not n * n.
3. Tied classes form candidate groups; each class's set is sent to its group
   once (texts are read again, and a bitmap of fixed size tells most that are not needed).  Groups of more than ``BLOCK``
   classes, or ``GRAMS`` n-grams, are cut in blocks, so no group is gathered whole.
4. Inside a block all pairs are compared on their full sets by matrix products.  Each
   class gets its number of links and its root, the least class it is connected with there.  Sets of
   groups with several blocks are written once, by block; each pair of blocks is then
   compared by a task, which adds to the numbers and gives a forest of the roots that are linked.
   Pairs are never written, and the forests grow with the blocks, not with the classes.
5. Connected roots give each document its class id.

Defined cases: null and empty texts have no words, hence no links, and each such
row is a class of its own kind: all of them share ``class_id`` with nobody.  A null
doc_id sorts last when a least doc_id is chosen.  Repeated rows are copies and link
to each other.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.llm.components import components
from inkbar.llm.kernel import NOT_SPACE, Tokens, lower, mix, pieces, text_bytes, windows
from inkbar.llm.rows import boxed, unboxed
from inkbar.operators.skew import join_hot
from inkbar.plans.scratch import written

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
BLOCK = 1024  # classes
GRAMS = 1 << 21
STEP = 128  # classes on a side of a matrix product
_BITS = 24


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``most`` hashes.

    A pair of similarity t shares a band of r rows with probability t ** r; with b
    bands it is found with probability 1 - (1 - t ** r) ** b, which must reach the
    recall at the threshold.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted n-gram set of each row."""
    data, offsets = text_bytes(lower(batch.column("text")))
    tokens = Tokens(data, offsets, NOT_SPACE)
    grams, at = windows(tokens.hashes(), tokens.row, size)
    for i in range(batch.num_rows):
        yield np.unique(grams[at[i] : at[i + 1]])


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, tkey, set_key, size, bands``; set_key is null where there are no words."""
    n = bands * rows
    rng = np.random.Generator(np.random.PCG64(4))
    salt = rng.integers(1, 2**64, size=n, dtype=np.uint64)
    odd = rng.integers(1, 2**64, size=n, dtype=np.uint64) | np.uint64(1)
    places = np.array([31**k for k in range(rows)], dtype=np.uint64)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("tkey", pa.string()),
            ("set_key", pa.binary()),
            ("size", pa.int64()),
            ("bands", pa.list_(pa.int64())),
        ]
    )

    def run(batches):
        for batch in pieces(batches):
            data, offsets = text_bytes(lower(batch.column("text")))
            tokens = Tokens(data, offsets, NOT_SPACE)
            grams, at = windows(tokens.hashes(), tokens.row, size)
            full = np.flatnonzero(np.diff(at))
            least = np.empty((len(full), n), dtype=np.uint64)
            if len(full):
                for k in range(n):
                    least[:, k] = np.minimum.reduceat((grams ^ salt[k]) * odd[k], at[full])
            keys = mix((mix(least).reshape(len(full), bands, rows) * places).sum(axis=2))
            set_key = [None] * batch.num_rows
            sizes = [0] * batch.num_rows
            hashes = [None] * batch.num_rows
            for j, i in enumerate(full.tolist()):
                own = np.unique(grams[at[i] : at[i + 1]])
                sizes[i] = len(own)
                set_key[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                hashes[i] = keys[j].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("tkey"),
                    pa.array(set_key, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("tkey"))
    return keyed.mapInArrow(run, "doc_id long, tkey string, set_key binary, size long, bands array<long>")


def _linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a matrix."""
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    every = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
    values, place, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1  # an n-gram of one set adds to no intersection
    column = np.cumsum(shared) - 1
    keep = shared[place]
    row, place = row[keep], column[place[keep]]
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    step = 8192
    for low in range(0, int(shared.sum()), step):
        part = slice(*np.searchsorted(place, [low, low + step]))
        present = np.zeros((len(a) + len(b), step), dtype=np.float32)
        present[row[part], place[part] - low] = 1
        common += present[: len(a)] @ present[len(a) :].T
    either = sizes[0][:, None] + sizes[1][None, :] - common
    return common >= threshold * either - 1e-6


def _links(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """``_linked`` of any two lists of sets, ``STEP`` sets of each at a time."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for i in range(0, len(a), STEP):
        for j in range(i if a is b else 0, len(b), STEP):
            out[i : i + STEP, j : j + STEP] = _linked(a[i : i + STEP], b[j : j + STEP], threshold)
            if a is b:
                out[j : j + STEP, i : i + STEP] = out[i : i + STEP, j : j + STEP].T
    return out


def _read(table: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray]:
    """Rows in order of their set's key, one for each, with the sets and numbers of copies."""
    table = table.sort_by("set_key").combine_chunks()
    keys = table.column("set_key").to_pylist()
    table = table.take(pa.array([i for i, k in enumerate(keys) if not i or keys[i - 1] != k], pa.int64()))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
    return table, sets, np.asarray(table.column("copies"), dtype=np.int64)


_BLOCK_ROWS = (
    "set_key binary, copies long, label binary, n_blocks int, block int, root binary, links long, grams binary"
)


def _inside(threshold: float):
    """Links and roots of the classes of a block."""

    def run(table: pa.Table) -> pa.Table:
        table, sets, copies = _read(table)
        linked = _links(sets, sets, threshold)
        np.fill_diagonal(linked, False)
        root = np.arange(len(sets))
        u, v = np.nonzero(linked)
        while len(u):
            least = root.copy()
            np.minimum.at(least, u, root[v])
            least = least[least]
            if (least == root).all():
                break
            root = least
        grams = table.column("grams")
        if table.column("n_blocks")[0].as_py() == 1:
            grams = pa.nulls(len(sets), pa.binary())
        keys = table.column("set_key")
        return table.select(["set_key", "copies", "label", "n_blocks", "block"]).append_column(
            "root", keys.take(pa.array(root))
        ).append_column("links", pa.array(linked @ copies, pa.int64())).append_column("grams", grams)

    return run


def _across(threshold: float):
    """Links between the classes of two blocks, and a forest of their roots."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("links", pa.int64())])

    def run(key, table):
        table, sets, copies = _read(table)
        block = np.asarray(table.column("block"))
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        linked = _links([sets[i] for i in left], [sets[i] for i in right], threshold)
        links = np.zeros(len(sets), dtype=np.int64)
        links[left] += linked @ copies[right]
        links[right] += linked.T @ copies[left]
        coded = table.column("root").combine_chunks().dictionary_encode()
        code, names = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        x, y = np.nonzero(linked)
        pairs = np.unique(code[left[x]] * len(names) + code[right[y]])
        parent = list(range(len(names)))

        def root(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        u, v = [], []
        for p, q in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist()):
            if (low := root(p)) != (high := root(q)):
                parent[low] = high
                u.append(p)
                v.append(q)
        some = np.flatnonzero(links)
        roots = lambda codes: names.take(pa.array(codes, pa.int64()))
        return pa.table(
            [
                pa.concat_arrays([roots(u), table.column("set_key").combine_chunks().take(pa.array(some))]),
                pa.concat_arrays([roots(v), pa.nulls(len(some), pa.binary())]),
                pa.array([0] * len(u) + links[some].tolist(), pa.int64()),
            ],
            schema=schema,
        )

    return run


def _place_of(tkey: str | Column) -> Column:
    """A place in the bitmap, by the first digits of a text's md5."""
    return F.conv(F.substring(tkey, 1, _BITS // 4), 16, 10).cast("long").alias("place")


def _bitmap(places: DataFrame) -> np.ndarray:
    """Which places occur: of fixed size, it only thins out what is then joined exactly."""
    table = np.zeros(1 << _BITS, dtype=bool)
    table[np.asarray(places.distinct().toArrow().column("place"), dtype=np.int64)] = True
    return table


def _linked_sets(
    docs: DataFrame, threshold: float, size: int, recall: float
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signed rows, their classes, ``u, links`` in parts, and ``node, label`` of the classes in candidate groups."""
    bands, rows = bands_for(threshold, recall)
    signed = written(signatures(docs, size, bands, rows), "ngram-signatures")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    classes = written(
        signed.filter("set_key is not null")
        .groupBy("set_key")
        .agg(F.min(least).alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .select("set_key", "least.doc_id", "least.tkey", "copies", "size", "bands"),
        "ngram-classes",
    )
    # hashes of different bands are no more alike than any two hashes
    banded = classes.select("set_key", F.explode("bands").alias("hash"))
    heads = banded.groupBy("hash").agg(
        F.min("set_key").alias("head"), F.count("*").alias("n")
    )
    ties = (
        banded.join(heads.filter("n > 1").drop("n"), "hash")
        .filter("set_key <> head")
        .select(F.col("set_key").alias("u"), F.col("head").alias("v"))
        .distinct()
    )
    groups = components(ties)
    grouped = written(classes.drop("bands").join(groups, F.col("set_key") == F.col("node")), "ngram-grouped")
    blocks = grouped.groupBy("label").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / GRAMS)).cast("int").alias("n_blocks")
    )
    wanted = (
        grouped.join(blocks, "label")
        .select(
            F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "set_key", "copies", "label",
            "n_blocks", F.expr("cast(pmod(xxhash64(set_key), n_blocks) as int)").alias("block"),
        )
    )
    wanted = written(wanted, "ngram-wanted")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("tkey"), _place_of(F.md5("text"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(_place_of("t"))))

    def with_sets(batches):
        for batch in batches:
            near = np.flatnonzero(shared.value[np.asarray(batch.column("place").fill_null(0))])
            for part in pieces(iter([batch.take(pa.array(near))])):
                grams = pa.array([x.tobytes() for x in _sets(part, size)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tkey"), grams], names=["doc_id", "tkey", "grams"]
                )

    sets = texts.mapInArrow(with_sets, "doc_id long, tkey string, grams binary").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))
    )
    inside = written(
        sets.select("set_key", "copies", "label", "n_blocks", "block", "grams")
        .groupBy("label", "block")
        .applyInArrow(_inside(threshold), _BLOCK_ROWS),
        "ngram-blocks",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    across = written(
        inside.filter("n_blocks > 1")
        .select("set_key", "copies", "label", "block", "root", "grams", other)
        .filter("block <> other")
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .groupBy("label", "low", "high")
        .applyInArrow(_across(threshold), "u binary, v binary, links long"),
        "ngram-links",
    )
    roots = components(across.filter("v is not null").select("u", "v")).select(
        F.col("node").alias("root"), F.col("label").alias("whole")
    )
    joined = inside.select("set_key", "root").join(roots, "root", "left").select(
        F.col("set_key").alias("node"), F.coalesce("whole", "root").alias("label")
    )
    found = inside.filter("links > 0").select(F.col("set_key").alias("u"), "links").unionByName(
        across.filter("links > 0").select("u", "links")
    )
    return signed, classes, found, written(joined, "ngram-joined")


def ngram_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, tkey, set_key, class_id, copy_of, n_links``, a row for each row of docs.

    ``class_id`` is the least doc_id of the document's connected group,
    ``copy_of`` the least doc_id with the same n-gram set, ``n_links`` the number
    of other rows whose similarity reaches the threshold.  ``tkey`` is the md5 of the text.
    A doc_id may stand on several texts, so ``class_id`` names a group but is no key of it.
    """
    signed, classes, found, joined = _linked_sets(docs, threshold, size, recall)
    linked = (
        classes.select("set_key", "doc_id", "copies")
        .join(joined, F.col("set_key") == F.col("node"))
        .select("set_key", "doc_id", "label")
    )
    none_last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    ids = linked.groupBy("label").agg(F.min(none_last).getField("doc_id").alias("class_id"))
    counts = found.groupBy(F.col("u").alias("set_key")).agg(F.sum("links").alias("links"))
    table = (
        classes.select("set_key", F.col("doc_id").alias("copy_of"), "copies")
        .join(linked.join(ids, "label").select("set_key", "class_id"), "set_key", "left")
        .join(counts, "set_key", "left")
        .select(
            "set_key",
            "copy_of",
            F.when(F.col("class_id").isNull(), F.col("copy_of")).otherwise(F.col("class_id")).alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    names = ["doc_id", "tkey", "set_key", "class_id", "copy_of", "n_links"]
    rows = signed.select("doc_id", "tkey", "set_key")
    wordless = rows.filter("set_key is null").select(
        "doc_id", "tkey", "set_key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"),
        F.lit(0).cast("long").alias("n_links"),
    )
    counts = classes.select("set_key", F.col("copies").alias("n"))
    members = join_hot(rows.filter("set_key is not null"), table, "set_key", "doc_id", counts)
    return members.select(*names).union(wordless)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one document left of each connected group.

    The row of the least (doc_id, md5 of the text), null ids last, stays (of repeated rows
    with it, one).  Groups are told by their sets, never by doc_id, which may be null or stand on
    several texts.  Rows without words are linked to nothing and stay.
    """
    signed, classes, _, joined = _linked_sets(docs, threshold, SHINGLE, RECALL)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    # one text has one set, so a doc_id and text head one group at most
    heads = (
        classes.select("set_key", least.alias("least"))
        .join(joined, F.col("set_key") == F.col("node"), "left")
        .groupBy(F.coalesce("label", "set_key").alias("group"))
        .agg(F.min("least").alias("least"))
        .select(F.col("least.doc_id").alias("_d"), F.col("least.tkey").alias("_t"))
    )
    times = (
        signed.filter("set_key is not null")
        .groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.count("*").alias("n"))
    )
    heads = written(
        heads.join(times, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t"))).select("_d", "_t", "n"),
        "ngram-heads",
    )
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = boxed(docs, doc_id=F.col("doc_id").cast("long"), key=F.md5("text"), words=words)
    rest = keyed.filter("words").join(
        heads, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_t"))
    )
    single = rest.filter("n = 1")
    repeated = rest.filter("n > 1").dropDuplicates(["doc_id", "key"])
    return unboxed(single.union(repeated).select("row").union(keyed.filter("not words").select("row")))
