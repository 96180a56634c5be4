"""A caller's rules by the hundred.

Rules given to ``detect_pii`` become part of one expression, in which each looks for its
literals in each piece of text; that suits a handful.  Here a text is read once by an
automaton of all literals, whatever their number, which tells the rules that can match.  Only those
are tried, in their order, by an expression that takes pattern and category from an array, so
neither the plan nor the work of a text without a hit grows with the rules.

Results are those of ``detect_regex_only`` with the same rules as ``extra_rules``.  Rules without
literals are tried on every text.  Rules with a mode or a context are not a caller's and are
refused.  Null texts have no spans; without rules only the built-in ones speak.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbar.functions import scan
from inkbar.functions import sqltext as Q
from inkbar.functions.rules import Rule
from inkbar.functions.spans import filter_min_score_final, let
from inkbar.operators.detect import pii_spans


def rules_that_may_match(rules: tuple[Rule, ...]):
    """Arrow UDF ``text -> array<int>``: the places of the rules with a literal in the text, in order."""
    always = [i for i, r in enumerate(rules) if not all(p.literals for p in r.parts)]
    of: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for literal in {x for p in r.parts for x in p.literals} if i not in always else ():
            of.setdefault(literal, []).append(i)

    @F.pandas_udf("array<int>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = None
        if of:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for literal, places in of.items():
                automaton.add_word(literal, places)
            automaton.make_automaton()
            find = automaton.iter
        for texts in batches:
            out = []
            for text in texts:
                if text is None:
                    out.append([])
                    continue
                hit = set(always)
                for _, places in find(text) if find else ():
                    hit.update(places)
                out.append(sorted(hit))
            yield pd.Series(out, index=texts.index, dtype=object)

    return read


def _found(rules: tuple[Rule, ...]) -> str:
    """The matches in ``v.text`` of each rule of ``v.hits``."""
    patterns = f"array({', '.join(Q.pattern(r.pattern) for r in rules)})"
    entities = f"array({', '.join(Q.literal(r.entity) for r in rules)})"
    # a text that holds the mark is scanned with a stand-in
    scanned = "if(contains(v.text, char(1)), replace(v.text, char(1), char(2)), v.text)"
    marked = (
        f"named_struct('entity', {entities}[r], 'marked', "
        f"regexp_replace({scanned}, {patterns}[r], concat(char(1), '$0', char(1))))"
    )
    return f"transform(v.hits, r -> {Q.let(marked, 'm', scan._matches())})"


def _accepted() -> str:
    """``v.kept`` and what of ``v.each``, rule by rule, overlaps nothing accepted before it."""
    step = f"if(size(found) = 0, kept, concat(kept, {scan._free_of_kept()}))"
    return f"aggregate(v.each, v.kept, (kept, found) -> {step})"


def _told() -> str:
    """``v.spans`` in order; they show the text itself where it holds the mark."""
    whole = Q.span("s.entity", "substring(v.text, s.start + 1, s.end - s.start)", "s.start", "s.end", "s.score")
    return Q.sort_spans(f"if(contains(v.text, char(1)), transform(v.spans, s -> {whole}), v.spans)")


def detect_with_rulebook(
    df: DataFrame, rules: tuple[Rule, ...] | list[Rule], min_score: float = 0.0, strict: bool = False, out: str = "spans"
) -> DataFrame:
    """Spans from the built-in rules and any number of a caller's own, which come last."""
    rules = tuple(rules)
    if any(r.mode is not None or r.has_context for r in rules):
        raise ValueError("a rulebook holds a caller's rules, without mode or context")
    spans = pii_spans(F.col("text"), None, strict)
    if rules:
        held = df.withColumns({"_hits": rules_that_may_match(rules)(F.col("text")), "_kept": spans})
        some = lambda body, **inputs: F.when(F.size("_hits") > 0, Q.apply(body, **inputs)).otherwise(F.col("_kept"))
        held = held.withColumn("_each", Q.apply(_found(rules), text=F.col("text"), hits=F.col("_hits")))
        held = held.withColumn("_both", some(_accepted(), kept=F.col("_kept"), each=F.col("_each")))
        spans = some(_told(), text=F.col("text"), spans=F.col("_both"))
    else:
        held = df
    if min_score > 0:
        spans = let(spans, lambda s: filter_min_score_final(s, F.lit(float(min_score))))
    return held.withColumn(out, spans).drop("_hits", "_kept", "_each", "_both")


