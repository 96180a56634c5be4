"""Small pieces of Spark SQL text for the two long expressions.

Detection and redaction are deep nests of higher-order functions.  Written as
SQL they are sent to Spark as one string and parsed there, where composing them
from single function calls takes hundreds of round trips to the JVM.  A lambda
in SQL text may be given any column: ``apply`` does that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbar.schema import SPANS_DDL

BLOCK = 256
NO_SPANS = f"cast(array() as {SPANS_DDL})"


def literal(s: str) -> str:
    """Raw string literal: no escape is interpreted, whatever the settings.

    A dollar and a brace are kept apart, because SQL text with both in a row is
    taken for a variable.
    """
    parts = s.replace("${", "$\0{").replace("'", "\0'\0").split("\0")
    quoted = ["\"'\"" if p == "'" else f"r'{p}'" for p in parts if p] or ["''"]
    return quoted[0] if len(quoted) == 1 else f"concat({', '.join(quoted)})"


def pattern(s: str) -> str:
    """Literal of a regular expression, quotes written as their code."""
    return literal(s.replace("'", r"\x27"))


def apply(body: str, **inputs: Column) -> Column:
    """``body`` with ``v.<name>`` for every input."""
    row = F.struct(*[c.alias(n) for n, c in inputs.items()])
    return F.element_at(
        F.call_function("transform", F.array(row), F.expr(f"v -> {body}")), 1
    )


def let(value: str, name: str, body: str) -> str:
    """``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def span(entity: str, text: str, start: str, end: str, score: str) -> str:
    return (
        f"named_struct('entity', {entity}, 'text', {text}, 'start', {start}, "
        f"'end', {end}, 'score', {score})"
    )


def fold_blocks(
    items: str, state: str, out: str, item: str, next_state: str, more: str
) -> str:
    """Fold ``items`` from left to right, collecting an array of type ``out``.

    ``next_state`` and ``more`` speak of ``acc.s`` and ``item``.  Every step of a
    fold copies what it carries, so the output should be plain numbers or flags,
    and it grows in blocks of ``BLOCK`` items that are joined afterwards.
    """
    empty = f"cast(array() as {out})"
    one = f"named_struct('s', {next_state}, 'out', concat(acc.out, {more}))"
    block = (
        f"aggregate(slice(xs, at + 1, {BLOCK}), named_struct('s', sum.s, 'out', {empty}), "
        f"(acc, {item}) -> {one})"
    )
    joined = let(block, "r", "named_struct('s', r.s, 'out', concat(sum.out, r.out))")
    return let(
        items,
        "xs",
        f"aggregate(sequence(0, size(xs), {BLOCK}), "
        f"named_struct('s', {state}, 'out', {empty}), (sum, at) -> {joined}).out",
    )


def sort_spans(spans: str) -> str:
    """Stable sort by start."""
    keyed = f"transform({spans}, (s, i) -> named_struct('k', s.start, 'i', i, 's', s))"
    return f"transform(array_sort({keyed}), e -> e.s)"


def sweep(spans: str) -> str:
    """Spans in order, without those that begin inside a kept one."""
    keep = fold_blocks(
        "ordered",
        "0",
        "array<boolean>",
        "x",
        "if(x.start < acc.s, acc.s, x.end)",
        "array(x.start >= acc.s)",
    )
    return let(
        sort_spans(spans),
        "ordered",
        let(keep, "keep", "filter(ordered, (s, i) -> keep[i])"),
    )


def resolve(spans: str) -> str:
    """Spans that overlap none accepted before them, island by island, in their order."""
    keyed = f"array_sort(transform({spans}, (s, i) -> named_struct('k', s.start, 'i', i, 's', s)))"
    begins = fold_blocks(
        "ordered",
        "-1",
        "array<boolean>",
        "x",
        "greatest(acc.s, x.s.end)",
        "array(x.k >= acc.s)",
    )
    heads = "filter(sequence(0, greatest(size(ordered) - 1, 0)), j -> begins[j])"
    island = (
        "array_sort(transform(slice(ordered, a + 1, coalesce(get(heads, j + 1), size(ordered)) - a), "
        "e -> named_struct('i', e.i, 's', e.s)))"
    )
    taken = let(
        island,
        "near",
        "aggregate(near, slice(near, 1, 0), "
        "(kept, e) -> if(exists(kept, k -> k.s.end > e.s.start and e.s.end > k.s.start), kept, "
        "concat(kept, array(e))))",
    )
    chosen = f"array_sort(flatten(transform(heads, (a, j) -> {taken})))"
    return let(
        keyed,
        "ordered",
        let(begins, "begins", let(heads, "heads", f"transform({chosen}, e -> e.s)")),
    )
