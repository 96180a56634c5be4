"""Language identification by a byte convolutional network.

Lower-cased UTF-8 bytes are embedded; filters of several widths run over windows of
``WINDOW`` bytes; each filter's greatest answer in the window feeds a softmax.  The
network is trained in numpy on one window of each document of a bounded sample
(``PER_LANGUAGE`` documents of each language; ``SAMPLE`` in all, if there are so many
languages, but one of each at least).  All windows of a text are scored,
and the document's probabilities are their mean, weighted by length.

At scoring time a filter is a sum of table rows, one for each pair of bytes, so a
window costs look-ups and additions only.  Scoring is one pass with no shuffle.

Defined cases: a null text, and a text without a letter, is ``und`` with score 0.
Rows with a null label teach nothing; if no row is labelled, every text is ``und``.
A null doc_id counts as the empty string when folds are dealt.  Repeated rows get
equal answers; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbar.llm.kernel import lower, pieces, text_bytes
from inkbar.plans.scratch import written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANGUAGE = 1500
EPOCHS = 8
LEAST_SCORE = 0.3
SAMPLE = 300_000
UNKNOWN = "und"
_BLANK = 32


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # one for each width: (width, EMBEDDING, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Cross-entropy gradients over windows ``x`` (rows of bytes) of labels ``y``."""
    n = np.arange(len(x))
    seen = net.embedding[x]
    pooled, places = [], []
    for w, b in zip(net.filters, net.bias):
        steps = x.shape[1] - len(w) + 1
        total = sum(seen[:, j : j + steps] @ w[j] for j in range(len(w))) + b
        places.append(total.argmax(axis=1))
        pooled.append(np.maximum(total.max(axis=1), 0))
    features = np.concatenate(pooled, axis=1)
    error = _softmax(features @ net.out + net.out_bias)
    error[n, y] -= 1
    error /= len(x)
    back = (error @ net.out.T) * (features > 0)
    d_embedding = np.zeros_like(net.embedding)
    d_filters, d_bias = [], []
    for k, w in enumerate(net.filters):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        d_w = np.empty_like(w)
        for j in range(len(w)):
            byte = x[n[:, None], places[k] + j]
            d_w[j] = np.einsum("bfd,bf->df", net.embedding[byte], g)
            np.add.at(d_embedding, byte, g[:, :, None] * w[j].T[None])
        d_filters.append(d_w)
        d_bias.append(g.sum(axis=0))
    return [d_embedding, *d_filters, *d_bias, features.T @ error, error.sum(axis=0)]


def fit(windows: list[bytes], labels: list[str], seed: int = 10) -> Network:
    """Train on ``windows`` (bytes, ``WINDOW`` at most are used) with Adam."""
    rng = np.random.Generator(np.random.PCG64(seed))
    known = sorted(set(labels))
    number = {v: k for k, v in enumerate(known)}
    y = np.array([number[v] for v in labels])
    x = np.full((len(windows), WINDOW), _BLANK, dtype=np.uint8)
    for i, w in enumerate(windows):
        raw = np.frombuffer(w[:WINDOW], dtype=np.uint8)
        x[i, : len(raw)] = raw
    draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    net = Network(
        known,
        draw(256, EMBEDDING),
        [draw(w, EMBEDDING, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw(len(WIDTHS) * FILTERS, len(known)),
        np.zeros(len(known), np.float32),
    )
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 64):
            rows = order[low : low + 64]
            batch = x[rows].copy()
            cut = rng.integers(24, 2 * WINDOW, size=len(rows))  # half are made short
            batch[np.arange(WINDOW)[None, :] >= cut[:, None]] = _BLANK
            step += 1
            for p, m, v, g in zip(net.parts(), first, second, _gradients(net, batch, y[rows])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """The network as tables of byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []
        for w in net.filters:
            one = np.einsum("vd,jdf->jvf", net.embedding, w)
            parts = []
            for j in range(0, len(w), 2):
                if j + 1 < len(w):
                    pair = (one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, -1)
                    parts.append((j, True, np.ascontiguousarray(pair, dtype=np.float32)))
                else:
                    parts.append((j, False, np.ascontiguousarray(one[j], dtype=np.float32)))
            self.tables.append(parts)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows of bytes."""
        out = []
        for low in range(0, len(x), 128):
            part = x[low : low + 128].T.astype(np.intp)  # bytes first, windows second
            pairs = part[:-1] * 256 + part[1:]
            pooled = []
            for parts, bias in zip(self.tables, self.net.bias):
                width = parts[-1][0] + (2 if parts[-1][1] else 1)
                steps = x.shape[1] - width + 1
                total = None
                for j, paired, table in parts:
                    rows = np.take(table, (pairs if paired else part)[j : j + steps], axis=0)
                    total = rows if total is None else np.add(total, rows, out=total)
                pooled.append(np.maximum(total.max(axis=0) + bias, 0))
            out.append(_softmax(np.concatenate(pooled, axis=1) @ self.net.out + self.net.out_bias))
        return np.concatenate(out)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of the rows of a byte buffer; an empty row is uniform."""
        length = np.diff(offsets)
        n = np.maximum(1, -(-length // WINDOW))
        at = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=at[1:])
        start = np.repeat(offsets[:-1] - at[:-1] * WINDOW, n) + np.arange(at[-1]) * WINDOW
        end = np.repeat(offsets[1:], n)
        padded = np.append(data, np.full(WINDOW, _BLANK, dtype=np.uint8))
        mean = np.zeros((len(n), len(self.net.labels)))
        for low in range(0, len(start), 4096):
            s, e = start[low : low + 4096], end[low : low + 4096]
            place = s[:, None] + np.arange(WINDOW)[None, :]
            x = padded[place]
            x[place >= e[:, None]] = _BLANK
            weight = np.maximum(np.minimum(e - s, WINDOW), 1e-9)
            row = np.searchsorted(at, np.arange(low, low + len(s)), side="right") - 1
            np.add.at(mean, row, self.windows(x) * weight[:, None])
        return mean / mean.sum(axis=1, keepdims=True)


def thinned(rows: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    """``rows`` thinned to about 4 * ``n`` for each value of ``by``, those of least ``order``.

    Values with fewer rows keep all, and rows without a value go.  Only values with more rows
    stand in the table of bounds that is joined; it is small unless there are very many such values,
    and Spark picks the join by its size.
    """
    part = F.lit(4.0 * n + 100) / F.col("count")
    bounds = written(
        rows.groupBy(F.col(by).alias("_by")).count().filter(part < 1)
        .select("_by", (part * F.lit(2.0**64) - F.lit(2.0**63)).cast("long").alias("_bound")),
        "label-bounds",
    )
    keyed = rows.withColumn("_order", order)
    return (
        keyed.join(bounds, F.col(by) == F.col("_by"), "left")
        .filter(F.col(by).isNotNull() & (F.col("_bound").isNull() | (F.col("_order") < F.col("_bound"))))
        .drop("_by", "_bound", "_order")
    )


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """One window of at most ``WINDOW`` characters of each sampled labelled document.

    The sample is fixed by a hash of the text; only its windows reach the driver.
    """
    place = F.pmod(
        F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    ).cast("int")
    rows = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n_labels = rows.agg(F.count_distinct("lang")).first()[0]
    per_language = max(1, min(per_language, SAMPLE // max(1, n_labels)))
    drawn = (
        thinned(rows, "lang", F.xxhash64("text"), per_language)
        .select("lang", F.xxhash64("text").alias("order"), F.lower(F.substring("text", place + 1, WINDOW)).alias("part"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "part")))
        .filter(F.col("n") <= per_language)
        .orderBy("lang", "order", "part")
        .select("lang", "part")
        .collect()
    )
    return [r.part.encode() for r in drawn], [r.lang for r in drawn]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network from labelled ``docs(text, lang)``; None if none is labelled."""
    windows, labels = sample(docs, per_language)
    return fit(windows, labels) if windows else None


def predict(docs: DataFrame, net: Network | None, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs, and ``lang_pred, score`` from the text alone."""
    told = _told(docs, net, keep)
    return told.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")


def _told(docs: DataFrame, net: Network | None, keep: tuple[str, ...]) -> DataFrame:
    """As ``predict``, with the columns ``keep`` named c0, c1, ..."""
    place = [f"c{i}" for i in range(len(keep))]
    held = [F.col(f"`{c}`").alias(p) for c, p in zip(keep, place)]
    fields = [f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(keep, place)]
    if net is None:
        return docs.select(*held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(shared.value)
        labels = np.array(scorer.net.labels, dtype=object)
        for batch in pieces(batches, "_text"):
            data, at = text_bytes(lower(batch.column("_text")))
            letters = np.asarray(batch.column("_letters").fill_null(False).to_numpy(False))
            best, top = np.zeros(len(letters), np.int64), np.zeros(len(letters))
            step = max(1, (1 << 22) // len(labels))  # rows whose probabilities are held at once
            for low in range(0, len(letters), step):
                own = at[low : low + step + 1]
                means = scorer.texts(data[own[0] : own[-1]], own - own[0])
                best[low : low + step], top[low : low + step] = means.argmax(axis=1), means.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(p) for p in place),
                    pa.array(np.where(letters, labels[best], UNKNOWN), pa.string()),
                    pa.array(np.where(letters, top, 0.0), pa.float64()),
                ],
                names=[*place, "lang_pred", "score"],
            )

    return docs.select(
        *held, F.col("text").alias("_text"), F.col("text").rlike(r"\p{L}").alias("_letters")
    ).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; fold ``held`` of ``folds`` teaches nothing."""
    held_out = fold(F.col("doc_id"), folds) == held
    net = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), net, "doc_id", "held_out")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more."""
    told = _told(docs, train(docs), tuple(docs.columns))
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns))
    )
