"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that plain
patterns find (base spans).  The corpus then tells which other words give
an entity away.  With p(e | t) the part of a term's occurrences that stand near entity e
(``NEAR`` words on either side in the same line, however far) and IC(e) = -log2 of the part of all
words that stand near e, a term reveals

    PMI(t; e) / IC(e) = 1 + log2 p(e | t) / IC(e)

of the entity.  At ``REMOVE`` or above the term is removed wherever it stands, at
``GENERALISE`` or above it is generalised.  A term must stand near the entity in ``SUPPORT``
different surroundings, so copies of one text reveal nothing.

Three passes over the texts, all counts over the whole corpus: (1) base spans and
the words near them; (2) occurrences of candidate terms; (3) places of terms that
reveal too much.  Candidates are passed to (2) and (3) as a bitmap of 64 places for each, up to
2 ** ``_MOST_BITS``, which only thins out what is then joined exactly.

Defined cases: null texts count as empty and have no spans.  A term is a word of letters of any length
and is never one inside a base span; words that touch a base span are in no count.  Repeated rows get equal answers, and their
occurrences all count.  Empty tables give empty results; other columns are kept by ``sanitise`` only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.llm.kernel import LETTERS, Tokens, lower, pieces, text_bytes
from inkbar.llm.rows import boxed
from inkbar.plans.scratch import written

NEAR = 12
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.97
KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
_MOST_BITS = 24

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[a-zA-Z\x80-\U0010ffff]+")


def _emails(text: str):
    """Leftmost addresses: the longest local part before each sign, then a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of base spans, in order."""
    if not text:
        return []
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _near(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int]]:
    """(entity, term, hash of the surroundings) for the words near each span.

    An occurrence of a word counts once for an entity, however many of its spans are near.
    """
    out, told = [], set()
    covered = [False] * (len(text) + 1)
    for s, _, e in spans:
        covered[s:e] = [True] * (e - s)
    line_end, words_of, starts = -1, [], []
    for s, kind, e in spans:
        entity = f"{KINDS[kind]}:{text[s:e].lower()}"
        if e > line_end:  # the words of a line are read once
            line = text.rfind("\n", 0, s) + 1
            line_end = stop if (stop := text.find("\n", e)) >= 0 else len(text)
            words_of = [
                m for m in _TERM.finditer(text, line, line_end) if not (covered[m.start()] or covered[m.end() - 1])
            ]
            starts = [m.start() for m in words_of]
        at = bisect_left(starts, s)
        near = words_of[max(0, at - NEAR) : at + NEAR]
        around = " ".join(m[0].lower() for m in near)
        seen = int.from_bytes(hashlib.blake2b(around.encode(), digest_size=8).digest(), "big", signed=True)
        for m in near:
            if (entity, m.start()) not in told:
                told.add((entity, m.start()))
                out.append((entity, m[0].lower(), seen))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("around", pa.int64())]))


def _based(batches):
    for batch in batches:
        spans, near = [], []
        for value in batch.column("text"):
            text = value.as_py()
            found = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            near.append([dict(zip(("entity", "term", "around"), x)) for x in _near(text, found)] if found else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tkey"), pa.array(spans, _SPAN), pa.array(near, _NEAR)],
            names=["doc_id", "tkey", "base", "near"],
        )


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which places of a table the terms' hashes fall on."""
    bits = min(_MOST_BITS, max(20, (64 * terms.count()).bit_length()))

    def places(batches):
        for batch in batches:
            data, at = text_bytes(batch.column("term"))
            hashes = Tokens(data, at, LETTERS).hashes()
            yield pa.RecordBatch.from_arrays([pa.array(_places(hashes, 1 << bits))], names=["at"])

    rows = terms.select("term").mapInArrow(places, "at long").distinct().toArrow()
    table = np.zeros(1 << bits, dtype=bool)
    table[np.asarray(rows.column("at"), dtype=np.int64)] = True
    return table


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _free(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of a text column touch no base span, and their code points in the row: start, end."""
    raw, raw_at = text_bytes(column)
    there = Tokens(raw, raw_at, LETTERS)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = np.repeat(point[raw_at[:-1]], np.diff(there.row))
    start, end = point[there.start] - base, point[there.end] - base
    free = np.ones(len(start), dtype=bool)
    for i, value in enumerate(column):
        own = slice(there.row[i], there.row[i + 1])
        for s, _, e in base_spans(value.as_py()) if own.start < own.stop else ():
            low, high = np.searchsorted(end[own], s, side="right"), np.searchsorted(start[own], e, side="left")
            free[own.start + low : own.start + high] = False
    return free, start, end


def _count(shared):
    def run(batches):
        for batch in pieces(batches):
            data, at = text_bytes(lower(batch.column("text")))
            tokens = Tokens(data, at, LETTERS)
            free, _, _ = _free(batch.column("text"))
            hashes = tokens.hashes()
            near = np.flatnonzero(shared.value[_places(hashes, len(shared.value))] & free)
            _, first, n = np.unique(hashes[near], return_index=True, return_counts=True)
            # a row without a term counts all words
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *tokens.strings(near[first])], pa.string()), pa.array([int(free.sum()), *n.tolist()], pa.int64())],
                names=["term", "n"],
            )

    return run


def _occurrences(shared):
    def run(batches):
        for batch in pieces(batches):
            column = batch.column("text")
            data, at = text_bytes(lower(column))
            tokens = Tokens(data, at, LETTERS)
            near = np.flatnonzero(shared.value[_places(tokens.hashes(), len(shared.value))]) if shared.value.any() else np.zeros(0, np.int64)
            row = np.searchsorted(tokens.row, near, side="right") - 1
            some = np.unique(row)  # spans are looked for in these rows only
            free, start, end = _free(column.take(pa.array(some)))
            own = np.diff(tokens.row)[some]
            held = near - tokens.row[row] + np.concatenate([[0], np.cumsum(own)]).astype(np.int64)[np.searchsorted(some, row)]
            keep = free[held]
            row, near, start, end = row[keep], near[keep], start[held][keep], end[held][keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    batch.column("tkey").take(pa.array(row)),
                    pa.array(tokens.strings(near), pa.string()),
                    pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                ],
                names=["doc_id", "tkey", "term", "start", "end"],
            )

    return run


def revealing(texts: DataFrame, based: DataFrame) -> DataFrame:
    """``term, kind``: the terms that reveal an entity, and whether they are removed."""
    near = based.filter(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*")
    pairs = written(
        near.groupBy("entity", "term").agg(
            F.count("*").alias("both"), F.countDistinct("around").alias("around")
        ).filter(F.col("around") >= SUPPORT),
        "disclosure-pairs",
    )
    entities = near.groupBy("entity").agg(F.count("*").alias("words"))
    candidates = written(pairs.select("term").distinct(), "disclosure-candidates")
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(candidates))
    counted = written(
        texts.mapInArrow(_count(shared), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")),
        "disclosure-counts",
    )
    total = F.broadcast(counted.filter("term is null").select(F.col("n").alias("total")))  # one row
    content = -F.log2(F.col("words") / F.col("total"))
    share = 1 + F.log2(F.least(F.col("both") / F.col("n"), F.lit(1.0))) / F.greatest(content, F.lit(1e-9))
    return (
        pairs.join(counted.filter("term is not null"), "term")
        .join(entities, "entity")
        .join(total, F.lit(True))
        .groupBy("term").agg(F.max(share).alias("share"))
        .filter(F.col("share") >= GENERALISE)
        .select("term", F.when(F.col("share") >= REMOVE, 4).otherwise(5).alias("kind"))
    )


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, base, extra``: base spans and spans of revealing terms, a row for each row.

    A span is ``start, kind, end`` in code points, its kind a place in ``KINDS``; ``tkey`` is the md5 of the text.
    """
    texts = docs.select("doc_id", "text", F.md5("text").alias("tkey"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:int,kind:int,end:int>>"
    based = written(
        texts.mapInArrow(
            _based,
            f"doc_id {kind}, tkey string, base {span}, near array<struct<entity:string,term:string,around:long>>",
        ),
        "disclosure-base",
    )
    terms = written(revealing(texts, based), "disclosure-terms")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))
    places = (
        texts.mapInArrow(_occurrences(shared), f"doc_id {kind}, tkey string, term string, start int, end int")
        .join(terms, "term")
        .groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("extra"))
    )
    return based.join(
        places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left"
    ).select("doc_id", "tkey", "base", F.coalesce("extra", F.array().cast(span)).alias("extra"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])
        ),
        ",",
    )


def rewrite(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with base spans tagged, revealing terms removed or generalised; overlaps join."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, kind, e in sorted(spans):
        if e <= at:
            continue
        s = max(s, at)
        tag = "" if kind == 4 else "[WORD]" if kind == 5 else f"[{KINDS[kind].upper()}]"
        out += [text[at:s], tag]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` and a column ``sanitised`` after them."""
    found = (
        detect(docs).dropDuplicates(["doc_id", "tkey"])
        .select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), F.concat("base", "extra").alias("_spans"))
    )
    keyed = boxed(docs, doc_id=F.col("doc_id"), text=F.col("text"), key=F.md5("text"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_t")), "left")

    @F.udf("string")
    def rewritten(text, spans):
        return rewrite(text, [(x["start"], x["kind"], x["end"]) for x in spans or []])

    return joined.select("row.*", rewritten("text", "_spans").alias("sanitised"))
