"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Two levels share one layer.  The first reads the bytes of a word in both directions and
pools them by attention; joined with an embedding of the word itself it is the
word's input to the second, which reads the words of a text in both directions; attention
pools the states of a window of ``WINDOW`` words into one score.  A text's score is the highest of
all its overlapping windows: one begins at every word that has ``WINDOW`` words from it on, so every
stretch of up to ``WINDOW`` words is whole in one of them.

Words are read once, not once for each window.  A text is cut in chunks of ``CHUNK`` words; a chunk is
read with ``WINDOW`` words on either side to warm up, so a state depends on the text
alone.  Each word then has a weight and what it says for toxicity, and every window is a
weighted mean of 32 of those.

A text's label says that some window is toxic, not which.  Training therefore
picks one window of each toxic text: first the one whose words and word
parts the labels speak for most, of windows ``STRIDE`` words apart, later the one of all overlapping windows
that the network itself scores highest.  It is read with ``CONTEXT`` words on either side.  The bound between the labels is
set on all overlapping windows, as scored.
The sample is bounded: ``PER_CLASS`` texts of each label, of ``LONGEST`` characters.  Longer texts are drawn
only where a label has too few others, by a passage at a hash-random place.

Scoring is one pass without a shuffle.  A word's first level is computed once for each slice.

Defined cases: null texts and texts without letters have no window and score 0.
Rows whose label is null teach nothing; of several labels of a document the highest
counts; without texts of both labels every score is 0.  A null doc_id counts
as the empty string when folds are dealt.  Repeated rows get equal answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbar.llm.kernel import LETTERS, Tokens, lower, pieces, text_bytes
from inkbar.llm.language import fold, thinned

WINDOW = 32
STRIDE = 24
CHUNK = 224
CONTEXT = 8
LETTERS_OF = 20  # bytes of a token; longer words are several tokens
PER_CLASS = 3000
LONGEST = 4000
EPOCHS = 8
ALARM = 4  # a clean text called toxic costs as much as this many missed ones
UNIT, WORD_ROWS, WORD_UNIT = 8, 4096, 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gathered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row, ``n`` rows."""
    rows, values = rows.ravel(), values.reshape(-1, values.shape[-1])
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


class Layer:
    """A bidirectional GRU with attention pooling; arrays are (time, row, unit)."""

    def __init__(self, inputs: int, unit: int, draw):
        self.unit = unit
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = draw(inputs, 3 * unit)
            self.p[f"U{d}"] = draw(unit, 3 * unit)
            self.p[f"c{d}"] = np.zeros(3 * unit, np.float32)
        self.p["A"], self.p["a"], self.p["v"] = draw(2 * unit, unit), np.zeros(unit, np.float32), draw(unit)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def states(self, given: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of both directions from projected inputs (time, row, 3 * unit); ``mask`` is (time, row)."""
        # both directions are stepped at once; the backward one reads its inputs from the end
        h = self.unit
        x = np.stack([given["f"], given["b"][::-1]], axis=1)
        m = np.stack([mask, mask[::-1]], axis=1)[..., None]
        u = np.stack([self.p["Uf"], self.p["Ub"]])
        state, trail = np.zeros((2, mask.shape[1], h), np.float32), []
        out = np.empty((len(mask), *state.shape), np.float32)
        for t in range(len(mask)):
            g = state @ u
            gates = _sigmoid(x[t, ..., : 2 * h] + g[..., : 2 * h])
            z, r = gates[..., :h], gates[..., h:]
            n = np.tanh(x[t, ..., 2 * h :] + r * g[..., 2 * h :])
            if keep:
                trail.append((state, z, r, n, g[..., 2 * h :]))
            state = state + m[t] * (1 - z) * (n - state)
            out[t] = state
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=-1), trail

    def forward(self, given: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False, pool: np.ndarray | None = None):
        """Pooled states; where ``pool`` is given, of its places only, the others being read as context."""
        states, trail = self.states(given, mask, keep)
        e = np.tanh(states @ self.p["A"] + self.p["a"])
        weight = np.where((mask if pool is None else pool) > 0, e @ self.p["v"], -np.inf)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return (pooled, (states, e, weight, trail, mask)) if keep else pooled

    def backward(self, d_pooled: np.ndarray, memory) -> tuple[dict, dict]:
        """Gradients of the parameters and of the projected inputs."""
        states, e, weight, trail, mask = memory
        h, p = self.unit, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=-1)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = d_score.ravel() @ e.reshape(-1, h)
        d_e = d_score[:, :, None] * p["v"] * (1 - e * e)
        g["A"] = states.reshape(-1, 2 * h).T @ d_e.reshape(-1, h)
        g["a"] = d_e.sum(axis=(0, 1))
        d_states += d_e @ p["A"].T
        d_out = np.stack([d_states[..., :h], d_states[::-1, :, h:]], axis=1)
        m = np.stack([mask, mask[::-1]], axis=1)[..., None]
        u = np.stack([p["Uf"], p["Ub"]])
        d_x = np.empty((*m.shape[:3], 3 * h), np.float32)
        carry, d_u = np.zeros(d_out.shape[1:], np.float32), np.zeros(u.shape, np.float32)
        for t in range(len(mask) - 1, -1, -1):
            state, z, r, n, gn = trail[t]
            d_new = d_out[t] + carry
            d_n = d_new * m[t] * (1 - z) * (1 - n * n)
            d_z = -d_new * m[t] * (n - state) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_n], axis=-1)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=-1)
            d_u += np.swapaxes(state, 1, 2) @ d_g
            carry = d_new * (1 - m[t] * (1 - z)) + d_g @ np.swapaxes(u, 1, 2)
        for k, d in enumerate("fb"):
            g[f"U{d}"], g[f"c{d}"] = d_u[k], d_x[:, k].sum(axis=(0, 1))
        return g, {"f": d_x[:, 0], "b": d_x[::-1, 1]}


class Words:
    """Tokens of some rows of text and, for each distinct one, its bytes."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(lower(column))
        tokens = Tokens(data, offsets, LETTERS)
        n = np.maximum(1, -(-(tokens.end - tokens.start) // LETTERS_OF))
        at = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(at[-1]) - np.repeat(at[:-1], n)
        start = np.repeat(tokens.start, n) + place * LETTERS_OF
        end = np.minimum(start + LETTERS_OF, np.repeat(tokens.end, n))
        self.row = at[tokens.row]
        hashes = np.repeat(tokens.hashes(), n) + place.astype(np.uint64)
        self.hash, first, self.token = np.unique(hashes, return_index=True, return_inverse=True)
        spot = start[first][:, None] + np.arange(LETTERS_OF)
        self.mask = spot < end[first][:, None]
        padded = np.append(data, np.zeros(LETTERS_OF, np.uint8))
        self.bytes = np.where(self.mask, padded[np.minimum(spot, len(padded) - 1)], 0)

    def starts(self, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token of each window, end of its row, and the first window of each row."""
        count = np.diff(self.row)
        n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // stride)), 0)
        at = np.concatenate([[0], np.cumsum(n)])
        start = np.repeat(self.row[:-1], n) + (np.arange(at[-1]) - np.repeat(at[:-1], n)) * stride
        return start, np.repeat(self.row[1:], n), at

    def tokens_from(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(window, place) -> distinct token or -1."""
        place = start[:, None] + np.arange(WINDOW)
        token = np.append(self.token, [0])[np.minimum(place, len(self.token))]
        return np.where(place < end[:, None], token, -1)

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) -> distinct token or -1, and the first window of each row."""
        start, end, at = self.starts(stride)
        return self.tokens_from(start, end), at

    def around(self, start: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows with ``CONTEXT`` words on either side (-1 outside the row), and which places are the window."""
        own = np.arange(-CONTEXT, WINDOW + CONTEXT)
        place = start[:, None] + own
        inside = (place >= first[:, None]) & (place < end[:, None])
        token = np.append(self.token, [0])[np.clip(place, 0, len(self.token))]
        return np.where(inside, token, -1), inside & (own >= 0) & (own < WINDOW)


class Known:
    """First-level results of the words met first, ``most`` at the highest."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.hash = np.zeros(0, np.uint64)
        self.given = {d: np.zeros((0, 3 * UNIT), np.float32) for d in "fb"}

    def add(self, hashes: np.ndarray, given: dict[str, np.ndarray]) -> None:
        if len(self.hash) >= self.most:
            return
        every, first = np.unique(np.concatenate([self.hash, hashes]), return_index=True)
        self.given = {d: np.concatenate([self.given[d], given[d]])[first] for d in "fb"}
        self.hash = every


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)
        self.low, self.high = Layer(UNIT, UNIT, draw), Layer(2 * UNIT + WORD_UNIT, UNIT, draw)
        self.own = {
            "bytes": draw(256, UNIT), "words": draw(WORD_ROWS, WORD_UNIT) * 0.2, "out": draw(2 * UNIT),
            "bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def parts(self) -> list[dict[str, np.ndarray]]:
        return [self.low.p, self.high.p, self.own]

    def _inputs(self, chars: np.ndarray, mask: np.ndarray, hashes: np.ndarray, keep: bool = False):
        seen = self.own["bytes"][chars.T]
        table = {d: (self.own["bytes"] @ self.low.p[f"W{d}"] + self.low.p[f"c{d}"])[chars.T] for d in "fb"}
        done = self.low.forward(table, mask.T.astype(np.float32), keep)
        pooled, memory = done if keep else (done, None)
        rows = (hashes % np.uint64(WORD_ROWS)).astype(np.int64)
        return np.concatenate([pooled, self.own["words"][rows]], axis=1), (seen, rows, memory)

    def logits(self, words: Words, window: np.ndarray, pool: np.ndarray | None = None) -> np.ndarray:
        """Scores of windows that are read by themselves, but for what of them is not in ``pool``."""
        given, out = self._given(words, None), [np.zeros(0, np.float32)]
        for low in range(0, len(window), 2048):
            part = window[low : low + 2048].T
            chosen = None if pool is None else pool[low : low + 2048].T
            pooled = self.high.forward({d: given[d][np.maximum(part, 0)] for d in "fb"}, (part >= 0).astype(np.float32), False, chosen)
            out.append(pooled @ self.own["out"] + self.own["bias"][0])
        return np.concatenate(out)

    def _along(self, words: Words, given: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token its weight, and its weight times what it says for toxicity."""
        weight, says = np.zeros(len(words.token)), np.zeros(len(words.token))
        count = np.diff(words.row)
        chunks = -(-count // CHUNK)
        begin, end = np.repeat(words.row[:-1], chunks), np.repeat(words.row[1:], chunks)
        first = begin + (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        low, high = np.maximum(begin, first - WINDOW), np.minimum(end, first + CHUNK + WINDOW)
        order = np.argsort(high - low, kind="stable")
        for i in range(0, len(order), 512):
            part = order[i : i + 512]
            place = low[part] + np.arange(int((high - low)[part].max()))[:, None]
            inside = place < high[part]
            place = np.where(inside, place, 0)
            token = words.token[place]
            states, _ = self.high.states({d: given[d][token] for d in "fb"}, inside.astype(np.float32))
            raw = np.tanh(states @ self.high.p["A"] + self.high.p["a"]) @ self.high.p["v"]
            own = inside & (place >= first[part]) & (place < first[part] + CHUNK)
            heavy = np.exp(raw[own].astype(np.float64))
            weight[place[own]], says[place[own]] = heavy, heavy * (states @ self.own["out"])[own]
        return weight, says

    def every_window(self, words: Words, known: Known | None = None) -> np.ndarray:
        """The scores of all overlapping windows, in the order of ``words.starts(1)``."""
        start, _, at = words.starts(1)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        shift = np.repeat(np.arange(len(words.row) - 1), np.diff(words.row)) * WINDOW
        place = np.arange(len(words.token)) + shift  # rows lie apart, so a short one's window holds it alone
        size = len(words.token) + len(words.row) * WINDOW
        sums = []
        for values in self._along(words, self._given(words, known)):
            apart = np.zeros(size)
            apart[place] = values
            total = apart.copy()
            for k in range(1, WINDOW):
                total[:-k] += apart[k:]
            sums.append(total[start + row * WINDOW])
        return (sums[1] / sums[0] + self.own["bias"][0]).astype(np.float32)

    def highest(self, words: Words, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a window, and the highest score of all overlapping windows of each."""
        value = self.every_window(words, known)
        at = words.starts(1)[2]
        full = np.flatnonzero(np.diff(at))
        return full, np.maximum.reduceat(value, at[full]) if len(full) else value

    def _given(self, words: Words, known: Known | None) -> dict[str, np.ndarray]:
        given = {d: np.empty((len(words.hash), 3 * UNIT), np.float32) for d in "fb"}
        new = np.arange(len(words.hash))
        if known is not None and len(known.hash):
            place = np.minimum(np.searchsorted(known.hash, words.hash), len(known.hash) - 1)
            seen = known.hash[place] == words.hash
            for d in "fb":
                given[d][seen] = known.given[d][place[seen]]
            new = np.flatnonzero(~seen)
        length = words.mask.sum(axis=1)
        new = new[np.argsort(length[new], kind="stable")]  # short words take few steps
        for low in range(0, len(new), 2048):
            part = new[low : low + 2048]
            steps = int(length[part[-1]])
            x, _ = self._inputs(words.bytes[part, :steps], words.mask[part, :steps], words.hash[part])
            for d, rows in self.high.project(x).items():
                given[d][part] = rows
        if known is not None:
            known.add(words.hash, given)
        return given

    def gradients(self, words: Words, window: np.ndarray, y: np.ndarray, pool: np.ndarray | None = None) -> list[dict]:
        used, token = np.unique(np.where(window < 0, 0, window), return_inverse=True)
        # short words take few steps: they are read apart from long ones
        length = words.mask[used].sum(axis=1)
        order = np.argsort(length, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        used, length = used[order], length[order]
        token = place[token].reshape(window.shape).T
        cut = int(np.searchsorted(length, 8, side="right"))
        parts = []
        for part in (slice(0, cut), slice(cut, None)):
            if len(used[part]):
                own, steps = used[part], int(length[part][-1])
                chars = words.bytes[own, :steps]
                parts.append((part, chars, self._inputs(chars, words.mask[own, :steps], words.hash[own], True)))
        x = np.concatenate([inputs[0] for _, _, inputs in parts])
        given = self.high.project(x)
        mask = (window.T >= 0).astype(np.float32)
        pooled, top = self.high.forward({d: given[d][token] for d in "fb"}, mask, True, None if pool is None else pool.T)
        error = (_sigmoid(pooled @ self.own["out"] + self.own["bias"][0]) - y) / len(y)
        own = {k: np.zeros_like(v) for k, v in self.own.items()}
        own["out"], own["bias"] = pooled.T @ error, np.array([error.sum()], np.float32)
        high, d_given = self.high.backward(error[:, None] * self.own["out"], top)
        d_x = np.zeros_like(x)
        for d in "fb":
            d_table = _gathered(token, d_given[d], len(x))
            high[f"W{d}"] = x.T @ d_table
            d_x += d_table @ self.high.p[f"W{d}"].T
        low = {k: np.zeros_like(v) for k, v in self.low.p.items()}
        for part, chars, (_, (seen, rows, memory)) in parts:
            own["words"] += _gathered(rows, d_x[part, 2 * UNIT :], WORD_ROWS)
            of_part, d_low = self.low.backward(d_x[part, : 2 * UNIT], memory)
            for d in "fb":
                of_part[f"W{d}"] = seen.reshape(-1, UNIT).T @ d_low[d].reshape(-1, 3 * UNIT)
                own["bytes"] += _gathered(chars.T, d_low[d] @ self.low.p[f"W{d}"].T, 256)
            for k in low:
                low[k] += of_part[k]
        return [low, high, own]


def _spoken_for(words: Words, toxic: np.ndarray) -> np.ndarray:
    """How much the labels speak for each distinct token: the best log odds of its parts."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(words.row))
    parts = [words.hash]
    length = words.mask.sum(axis=1)
    wide = words.bytes.astype(np.uint64)
    for k in range(LETTERS_OF - 3):  # runs of four bytes
        gram = sum(wide[:, k + j] << np.uint64(8 * j) for j in range(4))
        parts.append(np.where(length >= k + 4, gram, np.uint64(0)))
    feature, place = np.unique(np.stack(parts), return_inverse=True)
    place = place.reshape(len(parts), -1)
    pair = np.unique(doc * len(words.hash) + words.token)  # a text's distinct tokens
    of, token = pair // len(words.hash), pair % len(words.hash)
    counts = [np.zeros(len(feature)), np.zeros(len(feature))]
    for row in place:  # one kind of part at a time, so memory follows the tokens
        once = np.unique(of * len(feature) + row[token])
        for count, v in zip(counts, (1, 0)):
            count += np.bincount(once[toxic[once // len(feature)] == v] % len(feature), minlength=len(feature))
    total = [max(1, int((toxic == v).sum())) for v in (1, 0)]
    odds = np.log((counts[0] + 0.5) / (total[0] + 4)) - np.log((counts[1] + 0.5) / (total[1] + 4))
    odds[feature == 0] = -9
    return odds[place].max(axis=0)


def fit(texts: list[str], toxic: list[int], seed: int = 3) -> Network:
    """Train on texts with their labels by Adam; reruns agree."""
    rng = np.random.Generator(np.random.PCG64(seed))
    toxic = np.array(toxic)
    words = Words(pa.array(texts, pa.string()))
    start, end, at = words.starts(1)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    begin = words.row[doc]
    odds = np.append(_spoken_for(words, toxic), [-99.0])
    some = np.flatnonzero((start - begin) % STRIDE == 0)
    value = np.full(len(start), -np.inf)
    value[some] = np.sort(odds[words.tokens_from(start[some], end[some])], axis=1)[:, -3:].sum(axis=1)  # -1 takes the last
    net = Network(seed)
    first = [{k: np.zeros_like(v) for k, v in p.items()} for p in net.parts()]
    second = [{k: np.zeros_like(v) for k, v in p.items()} for p in net.parts()]
    step = 0

    def chosen() -> tuple[np.ndarray, np.ndarray]:
        """The best window of each text, and that text."""
        order = np.lexsort((value, doc))
        last = np.flatnonzero(np.append(np.diff(doc[order]) != 0, True))
        return order[last], doc[order[last]]

    for epoch in range(EPOCHS):
        best, of = chosen()
        positive, hard = best[toxic[of] == 1], best[toxic[of] == 0]
        clean = np.flatnonzero(toxic[doc] == 0)
        easy = rng.choice(clean, size=min(len(clean), len(positive) + 1), replace=False)
        rows = np.concatenate([positive, hard, easy])
        y = np.concatenate([np.ones(len(positive)), np.zeros(len(hard) + len(easy))]).astype(np.float32)
        order = rng.permutation(len(rows))
        batch = int(np.clip(len(rows) // 20, 16, 128))
        for low in range(0, len(rows), batch):
            part = order[low : low + batch]
            step += 1
            picked = rows[part]
            window, own = words.around(start[picked], begin[picked], end[picked])
            grads = net.gradients(words, window, y[part], own)
            for p, m, v, g in zip(net.parts(), first, second, grads):
                rate = 0.014 * (1 - epoch / EPOCHS)
                for k in p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] * g[k] - v[k])
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        value = net.every_window(words)
    of, top = net.highest(words)
    label = toxic[of]
    order = np.argsort(top)
    top, label = top[order], label[order]
    # cost if the bound lies before each place; the middle of the cheapest stretch is taken
    wrong = ALARM * np.concatenate([np.cumsum((label == 0)[::-1])[::-1], [0]])
    errors = wrong + np.concatenate([[0], np.cumsum(label)])
    good = np.flatnonzero(errors == errors.min())
    edge = np.concatenate([[top[0] - 1], top, [top[-1] + 1]])
    k = good[len(good) // 2]
    net.shift = float((edge[k] + edge[k + 1]) / 2)
    return net


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``text, toxic`` of at most ``per_class`` documents of each label, by a hash of their id.

    Labelled documents with a word are drawn, those of ``LONGEST`` characters at most before longer
    ones, of which the text is a passage of that length at a hash-random place.
    """
    known = (
        labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    usable = (
        docs.filter(F.col("text").rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"))
        .groupBy("doc_id").agg(F.min(F.length("text") > LONGEST).alias("long"))
    )
    kinds = known.join(usable, "doc_id").withColumn("kind", 2 * F.col("toxic") + F.col("long").cast("int"))
    first = Window.partitionBy("toxic").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    drawn = (
        thinned(kinds, "kind", F.xxhash64("doc_id"), per_class)
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= per_class).select("doc_id", "toxic", "long")
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - LONGEST, F.lit(0)) + 1).cast("int")
    # two labels, per_class rows each: the bound of the broadcast
    return (
        docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
        .filter((F.length("text") > LONGEST) == F.col("long"))
        .select(F.substring("text", place + 1, F.lit(LONGEST)).alias("text"), "toxic")
    )


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """A network from documents and ``labels(doc_id, toxic)``; None without both labels."""
    rows = sample(docs, labels, per_class).collect()
    rows.sort(key=lambda r: (r.toxic, r.text))
    rows = [r for r in rows if any(c.isalpha() for c in r.text)]
    if len({r.toxic for r in rows}) < 2:
        return None
    return fit([r.text for r in rows], [int(r.toxic) for r in rows])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, score`` of every row of docs, from the text alone."""
    if net is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = Known()
        for batch in pieces(batches, limit=1 << 22):
            words = Words(batch.column("text"))
            full, best = shared.value.highest(words, known)
            out = np.zeros(batch.num_rows)
            out[full] = _sigmoid(best.astype(np.float64) - shared.value.shift)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted``; fold ``held`` of ``folds`` teaches nothing."""
    net = train(
        docs.filter(fold(F.col("doc_id"), folds) != held),
        labels.filter(fold(F.col("doc_id"), folds) != held),
    )
    return score(docs, net).select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
