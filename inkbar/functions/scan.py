"""From a text column to rule spans, as one native expression.

A rule is scanned in one pass: ``regexp_replace`` puts a mark on both sides of
every match, ``split`` at the mark gives gap, match, gap, match, ..., and a
running sum of lengths gives the offsets.  The mark is U+0001.  Where a text
holds that character, the scan reads U+0002 in its place: no rule tells the two
apart, both are one code point, and the span's text is then cut from the
original.

Long texts are cut into pieces of about ``PIECE`` characters at places no match
can cross, so overlap resolution compares spans of one piece only.  A text with no
such place, and a caller's rule that may cross them, is read in one piece; there
matches are held against accepted spans in order of their start.  Either way the work
stays close to linear in the length of the text.  Pieces that lack a rule's necessary
shape skip that rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbar import schema as S
from inkbar.functions import sqltext as Q
from inkbar.functions.rules import BLANK, RULES_LOOSE, SOME_NUMBER, Rule
from inkbar.functions.spans import no_spans

MARK = "\x01"
PIECE = 4096
GROUP = 128

# After one of the first characters, or after a blank that none
# of the second set follows, a text may be cut.  No match contains the first;
# inside a match a blank is followed only by the second (capitals, digits,
# separators, and the letters that start a month, a year mark or the second word
# of a keyword).
_NEVER_INSIDE = ",;<>\"'"
_AFTER_INNER_BLANK = (
    f"A-Zn\\p{{Nd}}\\-.():№#{BLANK}яфмаисондгкЯФМАИСОНДГК\\u1c80-\\u1c88"
)
CUT = (
    f"(?s)\\G(.{{{PIECE},}}?"
    f"(?:[{_NEVER_INSIDE}]|[{BLANK}](?=[^{_AFTER_INNER_BLANK}])))"
)


def _text_pieces(text: str, cuttable: bool) -> str:
    """Array of pieces whose concatenation is the text."""
    if not cuttable:
        return f"array({text})"
    cut = f"regexp_replace({text}, {Q.pattern(CUT)}, concat('$1', char(1)))"
    return (
        f"if(length({text}) > {2 * PIECE}, split({cut}, char(1), -1), array({text}))"
    )


def _gate(rule: Rule) -> str:
    """Necessary condition for a match in ``piece``, cheap tests first."""
    tests = []
    shapes = [p.shape for p in rule.parts if p.shape and p.needs_digits]
    if shapes:
        flags = "(?iu)" if rule.ignore_case else ""
        shape = f"{flags}(?=\\p{{Nd}})(?:{'|'.join(dict.fromkeys(shapes))})"
        tests.append(f"(digits and piece rlike {Q.pattern(shape)})")
    for p in rule.parts:
        if p.needs_digits:
            continue
        all_of = []
        if p.literals:
            any_of = [f"contains(piece, {Q.literal(x)})" for x in p.literals]
            all_of.append("(" + " or ".join(any_of) + ")")
        if p.shape:
            all_of.append(f"piece rlike {Q.pattern(p.shape)}")
        tests.append("(" + " and ".join(all_of or ["true"]) + ")")
    return "(" + " or ".join(tests) + ")"


def _marked(rule: Rule, by_row: bool) -> str:
    """The piece with every match of ``rule`` marked, null if there can be none."""
    gate = _gate(rule)
    if by_row and rule.mode is not None:
        gate = f"({'' if rule.mode == 'strict' else 'not '}v.strict and {gate})"
    to = ", ".join(
        "char(1)" if part == MARK else Q.literal(part)
        for part in rule.replacement_parts(MARK)
    )
    return (
        f"named_struct('entity', {Q.literal(rule.entity)}, 'marked', "
        f"if({gate}, regexp_replace(piece, {Q.pattern(rule.pattern)}, concat({to})), null))"
    )


def _matches() -> str:
    """Spans of the marked matches ``m`` of one piece, left to right."""
    ends = Q.fold_blocks(
        "parts",
        "0",
        "array<int>",
        "x",
        "acc.s + length(x)",
        "array(acc.s + length(x))",
    )
    hit = Q.span("m.entity", "parts[j]", "ends[j - 1]", "ends[j]", f"{S.RULE_SCORE}D")
    hits = Q.let(
        ends, "ends", f"transform(sequence(1, size(parts) - 1, 2), j -> {hit})"
    )
    return Q.let(
        "split(m.marked, char(1), -1)",
        "parts",
        f"if(size(parts) < 3, {Q.NO_SPANS}, {hits})",
    )


def _free_of_kept() -> str:
    """Spans of ``found`` that overlap none of ``kept``, which is looked at in groups."""
    group = f"slice(kept, i + 1, {GROUP})"
    groups = (
        f"transform(sequence(0, greatest(size(kept) - 1, 0), {GROUP}), i -> named_struct('spans', {group}, "
        f"'low', array_min(transform({group}, k -> k.start)), 'high', array_max(transform({group}, k -> k.end))))"
    )
    hit = "exists(g.spans, k -> k.end > c.start and c.end > k.start)"
    free = f"filter(found, c -> not exists(groups, g -> g.high > c.start and c.end > g.low and {hit}))"
    return Q.let(groups, "groups", free)


def _free_by_order() -> str:
    """Spans of ``v.found`` that overlap none of ``v.kept``, without comparing pairs.

    Both are put in order of start.  A match (never empty, disjoint from the other
    matches) is taken if a kept span that begins no later ends after its start, or if the next
    kept span begins before its end.
    """
    events = (
        "array_sort(concat("
        "transform(v.kept, k -> named_struct('at', k.start, 'own', 0, 'stop', k.end)), "
        "transform(v.found, c -> named_struct('at', c.start, 'own', 1, 'stop', c.end))))"
    )
    own = "if(x.own = 1, array({}), cast(array() as array<boolean>))"
    before = Q.fold_blocks(
        "events", "-1", "array<boolean>", "x",
        "if(x.own = 1, acc.s, greatest(acc.s, x.stop))", own.format("acc.s > x.at"),
    )
    after = Q.fold_blocks(
        "reverse(events)", str(2**31 - 1), "array<boolean>", "x",
        "if(x.own = 1, acc.s, x.at)", own.format("acc.s < x.stop"),
    )
    kept = "filter(v.found, (c, i) -> not near.hit[i] and not near.met[i])"
    near = f"named_struct('hit', {before}, 'met', reverse({after}))"
    return Q.let(events, "events", Q.let(near, "near", kept))


def _piece_spans(rules: tuple[Rule, ...], before: str, by_row: bool) -> str:
    """Spans ``before`` and the matches accepted after them, in rule order.

    The matches of one rule never overlap each other, so each rule takes one look
    at what was accepted before it.
    """
    free = _free_of_kept()
    accept = Q.let(
        _matches(), "found", f"if(size(kept) = 0, found, concat(kept, {free}))"
    )
    tried = ", ".join(_marked(r, by_row) for r in rules)
    return Q.let(
        f"piece rlike {Q.pattern(SOME_NUMBER)}",
        "digits",
        f"aggregate(array({tried}), {before}, "
        f"(kept, m) -> if(m.marked is null, kept, {accept}))",
    )


def scan_body(
    rules: tuple[Rule, ...], with_existing: bool, by_row: bool, merge: bool
) -> str:
    """SQL text of the scan over ``v.text``, ``v.existing`` and ``v.strict``."""

    def shifted(spans: str, by: str, text: str = "s.text") -> str:
        moved = Q.span("s.entity", text, f"s.start + {by}", f"s.end + {by}", "s.score")
        return f"transform({spans}, s -> {moved})"

    if not with_existing:
        found = _piece_spans(rules, Q.NO_SPANS, by_row)
    else:
        near = "filter(v.existing, s -> s.end > base and s.start < stop)"
        # What was there before stands at the front and is cut off again.
        found = Q.let(
            shifted(near, "(-base)"),
            "old",
            f"filter({_piece_spans(rules, 'old', by_row)}, (s, i) -> i >= size(old))",
        )
    # With a stand-in for the mark, the span's text comes from the original.
    original = "substring(v.text, base + 1, length(piece))"
    restored = Q.let(
        original,
        "raw",
        shifted("found", "base", "substring(raw, s.start + 1, s.end - s.start)"),
    )
    placed = Q.let(
        found, "found", f"if(has_mark, {restored}, {shifted('found', 'base')})"
    )
    in_piece = Q.let("bases[n]", "base", Q.let("base + length(piece)", "stop", placed))
    bases = Q.fold_blocks(
        "pieces", "0", "array<int>", "q", "acc.s + length(q)", "array(acc.s)"
    )
    scan_text = "if(has_mark, replace(v.text, char(1), char(2)), v.text)"
    pieces = Q.let(scan_text, "scanned", _text_pieces("scanned", all(r.cuttable for r in rules)))
    whole = Q.let(
        pieces,
        "pieces",
        Q.let(bases, "bases", f"flatten(transform(pieces, (piece, n) -> {in_piece}))"),
    )
    found = Q.let("contains(v.text, char(1))", "has_mark", whole)
    if merge and with_existing:
        found = f"concat(v.existing, {found})"
    return f"if(v.text is null, {Q.NO_SPANS}, {Q.sort_spans(found)})"


def scan_rules(
    text: Column,
    rules: tuple[Rule, ...],
    existing: Column | None = None,
    strict: Column | None = None,
    merge: bool = False,
) -> Column:
    """Spans the rules add to ``existing``, sorted by start.

    Rules are tried in order and their matches from left to right.  A match is
    dropped as a whole if it overlaps an existing span or an accepted match.
    ``strict`` chooses per row between the rules of the two modes.  ``merge``
    returns the existing spans too.
    """
    free = next((i for i, r in enumerate(rules) if not r.cuttable), len(rules))
    if 0 < free < len(rules) and (merge or existing is None):
        # rules that need the whole text read it in one piece, one after the other
        taken = scan_rules(text, rules[:free], existing, strict, merge)
        for rule in rules[free:]:
            found = scan_rules(text, (rule,), strict=strict)
            both = f"concat(v.kept, {_free_by_order()})"
            taken = Q.apply(Q.sort_spans(both), kept=taken, found=found)
        return taken
    inputs = {"text": text}
    if existing is not None:
        inputs["existing"] = F.coalesce(existing, no_spans())
    if strict is not None:
        inputs["strict"] = strict
    body = scan_body(rules, existing is not None, strict is not None, merge)
    return Q.apply(body, **inputs)


def ru_postpass(
    text: Column,
    existing: Column | None = None,
    rules: tuple[Rule, ...] = RULES_LOOSE,
    strict: Column | None = None,
) -> Column:
    """Rule spans merged into existing ones, stably sorted by start."""
    return scan_rules(text, rules, existing, strict, merge=True)
