"""Cutting, redacting and rendering text around spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbar.functions import sqltext as Q
from inkbar.functions.spans import no_spans

BLOCK_CHARS = 1024
_BLOCKS = f"(?s).{{1,{BLOCK_CHARS}}}"


# Counting code points from the start costs a walk over the text.  So a long text
# is first taken apart in equal blocks, and each cut reads only the blocks it
# touches.
_BLOCKS_OF = (
    f"if(length(v.text) > {BLOCK_CHARS}, "
    f"regexp_extract_all(v.text, {Q.pattern(_BLOCKS)}, 0), array(v.text))"
)


def _cut(start: str, end: str) -> str:
    """Characters ``[start, end)`` of the text behind ``blocks``."""
    first = f"cast({start} div {BLOCK_CHARS} as int)"
    last = f"cast(({end} - 1) div {BLOCK_CHARS} as int)"
    offset = f"{start} - {first} * {BLOCK_CHARS} + 1"
    many = f"slice(blocks, {first} + 1, {last} - {first} + 1)"
    return (
        f"case when {end} <= {start} then '' "
        f"when {first} = {last} then substring(coalesce(get(blocks, {first}), ''), {offset}, {end} - {start}) "
        f"else substring(array_join({many}, ''), {offset}, {end} - {start}) end"
    )


_GAP = _cut("if(i = 0, 0, kept[i - 1].end)", "s.start")
_TAIL = _cut(
    "if(size(kept) = 0, 0, kept[size(kept) - 1].end)", f"({BLOCK_CHARS} * size(blocks))"
)


def _rendered(body: str) -> str:
    """``body`` over ``blocks`` of the text and the ``kept`` spans."""
    return Q.let(_BLOCKS_OF, "blocks", Q.let(Q.sweep("v.spans"), "kept", body))


def _render(body: str, **inputs: Column) -> Column:
    return Q.apply(_rendered(body), **inputs)


def cut_spans(text: Column, spans: Column) -> Column:
    """Spans with their text set to what stands at their offsets."""
    cut = Q.span("s.entity", _cut("s.start", "s.end"), "s.start", "s.end", "s.score")
    return Q.apply(
        Q.let(_BLOCKS_OF, "blocks", f"transform(v.spans, s -> {cut})"), text=text, spans=spans
    )


def _column(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def redact_body() -> str:
    """SQL text of the redaction over ``v.text``, ``v.spans``, ``v.mask``, ``v.fixed``."""
    drawn = (
        "coalesce(repeat(v.mask, s.end - s.start), v.fixed, concat('[', upper(s.entity), ']'))"
    )
    pieces = f"transform(kept, (s, i) -> concat({_GAP}, {drawn}))"
    done = _rendered(f"concat(array_join({pieces}, ''), {_TAIL})")
    return (
        "case when v.text is null or v.spans is null or size(v.spans) = 0 then v.text "
        "when length(v.mask) <> 1 then "
        "cast(raise_error('mask_char must be a single character') as string) "
        f"else {done} end"
    )


def redact(
    text: Column,
    spans: Column,
    placeholder: Column | str | None = None,
    mask_char: Column | str | None = None,
) -> Column:
    """The text with every span replaced.

    The mask character wins over the placeholder, and both win over the typed
    tag.  Both may be columns, so that each row brings its own options.  An
    empty placeholder deletes the span.  Spans that begin inside one already
    replaced are skipped.
    """
    return Q.apply(
        redact_body(),
        text=text,
        spans=spans,
        mask=_column(mask_char),
        fixed=_column(placeholder),
    )


def segment_text(text: Column, spans: Column) -> Column:
    """Alternating plain and span segments; empty plain ones are left out."""

    def segment(t: str, entity: str, score: str) -> str:
        return f"named_struct('text', {t}, 'entity', {entity}, 'score', {score})"

    def plain(t: str) -> str:
        return segment(t, "cast(null as string)", "cast(null as double)")

    hit = segment(_cut("s.start", "s.end"), "s.entity", "s.score")
    pairs = f"flatten(transform(kept, (s, i) -> array({plain(_GAP)}, {hit})))"
    body = (
        f"filter(concat({pairs}, array({plain(_TAIL)})), "
        "g -> g.entity is not null or g.text <> '')"
    )
    return F.when(
        text.isNotNull(), _render(body, text=text, spans=F.coalesce(spans, no_spans()))
    )


# The five escaped characters; the ampersand comes first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#39;"),
)


def escape_html(text: Column) -> Column:
    for raw, safe in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _escape_sql(text: str) -> str:
    for raw, safe in HTML_ESCAPES:
        quoted = '"\'"' if raw == "'" else f"'{raw}'"
        text = f"replace({text}, {quoted}, '{safe}')"
    return text


def highlight_html(text: Column, spans: Column) -> Column:
    """Escaped HTML with one tagged element per span; plain text if none."""
    entity = _escape_sql("s.entity")
    element = (
        f"""concat('<span class="pii" data-entity="', {entity}, '" title="', {entity}, """
        f"""format_string(' (%.3f)">', s.score), {_escape_sql(_cut("s.start", "s.end"))}, '</span>')"""
    )
    pieces = f"transform(kept, (s, i) -> concat({_escape_sql(_GAP)}, {element}))"
    html = _render(
        f"concat(array_join({pieces}, ''), {_escape_sql(_TAIL)})", text=text, spans=spans
    )
    return F.when(
        F.size(F.coalesce(spans, no_spans())) == 0,
        F.when(text == "", F.lit("(empty)")).otherwise(text),
    ).otherwise(html)


def human_bytes(n: Column) -> Column:
    """Size in B, KB or MB, one decimal, base 1024."""
    kib = n / F.lit(1024.0)
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", kib))
        .otherwise(F.format_string("%.1f MB", kib / F.lit(1024.0)))
    )
