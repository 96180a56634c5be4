"""The same results stated in SQL for DuckDB, by other means.

DuckDB's regular expressions have no look-around, so a bounded match takes its
neighbours along and the replacement runs twice (two matches may share one).
Matches are marked with chr(1); splitting at the marks gives gaps and matches in
turn, and a running sum of lengths gives offsets.  Rule order is a chain of
anti-joins, redaction a string aggregate.
"""

from __future__ import annotations

from inkbar.plans.templates import TEMPLATES, template_sql

# The shapes in RE2's dialect.
_NOT_WORD = r"[^\p{L}\p{N}_\x01]"
_KEYWORDS = (
    r"ИНН|инн|INN|ОГРН(?:ИП)?|огрн(?:ип)?|OGRN(?:IP)?|СНИЛС|снилс|SNILS|паспорт|"
    r"passport|номер\s+карты|card\s+(?:no|number)"
)
_MONTHS = (
    r"янв(?:аря|\.)|фев(?:раля|\.)|мар(?:та|\.)|апр(?:еля|\.)|мая|июн(?:я|\.)|"
    r"июл(?:я|\.)|авг(?:уста|\.)|сен(?:тября|\.)|окт(?:ября|\.)|ноя(?:бря|\.)|"
    r"дек(?:абря|\.)"
)
_ENDINGS = (
    "ru|by|kz|ua|uk|рф|москва|рус|онлайн|com|net|org|info|biz|edu|gov|io|dev|app|"
    "ai|co|me|tech|xyz|cloud|site|store|page"
)
_IBAN = r"[A-Z]{2}\p{Nd}{2}(?:\s?[A-Z0-9]{4}){3,7}"
_CARD_GROUPED = r"(?:\p{Nd}{4}[\s\-]){3}\p{Nd}{4}"
_CARD_PLAIN = r"\p{Nd}{16}"
_PHONE = (
    r"(?:\+7|8|7)[\s\-.()]+\p{Nd}{3}[\s\-.()]*\p{Nd}{3}[\s\-.]*\p{Nd}{2}[\s\-.]*\p{Nd}{2}"
)
_EMAIL = r"[A-Za-zА-Яа-я0-9._%+\-]+@[A-Za-zА-Яа-я0-9.\-]+\.[A-Za-zА-Яа-я]{2,}"
_RUN = r"[^\s<>\"',;\x01]"
_SCHEME = rf"(?:https?://|www\.){_RUN}+"
_HOST = rf"[A-Za-zА-Яа-я0-9\-]+\.(?:{_ENDINGS})(?:/{_RUN}*)?"
_DATE_NUMERIC = r"\p{Nd}{1,2}\.\p{Nd}{1,2}\.\p{Nd}{2,4}"
_DATE_MONTH = rf"\p{{Nd}}{{1,2}}\s+(?:{_MONTHS})\s+\p{{Nd}}{{4}}(?:\s*г\.?)?"
_OGRN = r"\p{Nd}{15}|\p{Nd}{13}"
_INN = r"\p{Nd}{12}|\p{Nd}{10}"
_PASSPORT = r"\p{Nd}{4}\s\p{Nd}{6}"
_SNILS = r"\p{Nd}{3}-\p{Nd}{3}-\p{Nd}{3}[\s\-]\p{Nd}{2}"
_KEY = r"\b(?:sk|pk|rk)-[A-Za-z0-9_\-]{16,}\b"
_AWS = r"\bAKIA[0-9A-Z]{16}\b"
_GITHUB = r"\b(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,}\b"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(text: str, pattern: str, *parts: str) -> str:
    """``parts`` are group numbers, or M for the mark."""
    to = " || ".join("chr(1)" if p == "M" else _q("\\" + p) for p in parts)
    return f"regexp_replace({text}, {_q(pattern)}, {to}, 'g')"


def bounded(body: str, flags: str = "") -> str:
    pattern = f"{flags}(^|{_NOT_WORD})({body})($|{_NOT_WORD})"
    once = _replace("text", pattern, "1", "M", "2", "M", "3")
    return _replace(once, pattern, "1", "M", "2", "M", "3")


def free(body: str) -> str:
    return _replace("text", f"({body})", "M", "1", "M")


def phone() -> str:
    pattern = rf"(^|[\s,;:()\[\]<>\"'])({_PHONE})"
    return _replace("text", pattern, "1", "M", "2", "M")


def with_keyword(digits: str, text: str = "text") -> str:
    pattern = rf"((?:{_KEYWORDS})[\s:№#]+)({digits})($|{_NOT_WORD})"
    return _replace(text, pattern, "1", "M", "2", "M", "3")


def url(body: str) -> str:
    """Greedy run, then a sentence mark at its end is moved out."""
    marked = free(body)
    marked = _replace(
        marked, r"((?:https?://|www\.)[^\x01]+)([.!?])\x01(\s|$)", "1", "M", "2", "3"
    )
    return _replace(marked, r"(/[^\x01]*)([.!?])\x01(\s|$)", "1", "M", "2", "3")


def rule_six(strict: bool) -> str:
    if not strict:
        return bounded(f"{_OGRN}|{_INN}|{_PASSPORT}|{_SNILS}")
    keyed = with_keyword(f"{_OGRN}|{_INN}")
    body = f"(^|{_NOT_WORD})({_PASSPORT}|{_SNILS})($|{_NOT_WORD})"
    once = _replace(keyed, body, "1", "M", "2", "M", "3")
    return _replace(once, body, "1", "M", "2", "M", "3")


def spans(src: str, marked: str, entity: str, rule: int = 0) -> str:
    """``doc_id, rule, entity, text, start, end`` of the marked matches."""
    return f"""
      SELECT doc_id, {rule} AS rule, '{entity}' AS entity, t AS text,
             CAST(e - length(t) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end"
      FROM (SELECT doc_id, t, i,
                   sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e
            FROM (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i
                  FROM (SELECT doc_id, string_split({marked}, chr(1)) AS p
                        FROM ({src}) AS src0) AS p0) AS p1) AS p2
      WHERE i % 2 = 0"""


def numbered(rows: str, order: str = "start", score: str = "CAST(0.95 AS DOUBLE)") -> str:
    return f"""
      SELECT doc_id,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS INTEGER) AS pos,
             entity, text, start, "end", {score} AS score
      FROM ({rows}) AS r0"""


_RULES = (
    ("account_number", lambda s: bounded(f"{_IBAN}|{_CARD_GROUPED}|{_CARD_PLAIN}")),
    ("private_phone", lambda s: phone()),
    ("private_email", lambda s: free(_EMAIL)),
    ("private_url", lambda s: url(f"{_SCHEME}|{_HOST}")),
    ("private_date", lambda s: bounded(f"{_DATE_NUMERIC}|{_DATE_MONTH}", "(?i)")),
    ("account_number", rule_six),
    ("secret", lambda s: free(f"{_KEY}|{_AWS}|{_GITHUB}")),
)
_EXTRA = (
    "order_word",
    lambda s: _replace(
        _replace("text", r"(^|[^A-Za-z\x01])(the)($|[^A-Za-z\x01])", "1", "M", "2", "M", "3"),
        r"(^|[^A-Za-z\x01])(the)($|[^A-Za-z\x01])", "1", "M", "2", "M", "3",
    ),
)


_NET = r"(^|[^0-9.\x01])((?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.[0-9]{1,3}){3})($|[^0-9.\x01])"
_NETS = ("net", lambda s: _replace(_replace("text", _NET, "1", "M", "2", "M", "3"), _NET, "1", "M", "2", "M", "3"))


def chain(
    src: str, strict: bool = False, existing: str | None = None, extra: bool | tuple = False,
    name: str = "a",
) -> tuple[str, str]:
    """CTEs that accept rule after rule, and the name of the last one.

    Existing spans come in as rule 0 and stay.
    """
    rules = _RULES + (((_EXTRA,) if extra is True else (extra,)) if extra else ())
    ctes, last = [f"{name}_src AS ({src})"], None
    if existing:
        ctes.append(f"{name}_0 AS ({existing})")
        last = f"{name}_0"
    for n, (entity, marked) in enumerate(rules, 1):
        found = spans(f"SELECT doc_id, text FROM {name}_src", marked(strict), entity, n)
        if last is None:
            ctes.append(f"{name}_{n} AS ({found})")
        else:
            ctes.append(
                f"""{name}_{n} AS (
                SELECT * FROM {last} UNION ALL
                SELECT * FROM ({found}) AS c WHERE NOT EXISTS (
                  SELECT 1 FROM {last} AS k WHERE k.doc_id = c.doc_id
                    AND k.start < c."end" AND c.start < k."end"))"""
            )
        last = f"{name}_{n}"
    return ", ".join(ctes), last


def redacted(docs: str, found: str, replacement: str) -> str:
    """``doc_id, redacted, n_spans`` from disjoint spans ``found``."""
    return f"""
      SELECT d.doc_id,
             coalesce(g.head, '') || substring(d.text, coalesce(g.cut, 0) + 1) AS redacted,
             CAST(coalesce(g.n, 0) AS INTEGER) AS n_spans
      FROM {docs} AS d LEFT JOIN (
        SELECT doc_id, string_agg(piece, '' ORDER BY start) AS head, max("end") AS cut, count(*) AS n
        FROM (SELECT f.doc_id, f.start, f."end",
                     substring(d.text, coalesce(lag(f."end") OVER w, 0) + 1,
                               f.start - coalesce(lag(f."end") OVER w, 0))
                     || {replacement} AS piece
              FROM {found} AS f JOIN {docs} AS d ON d.doc_id = f.doc_id
              WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.start)) AS pieces
        GROUP BY doc_id) AS g ON g.doc_id = d.doc_id"""


_TAG = "'[' || upper(f.entity) || ']'"
_DOCS = "SELECT doc_id, text FROM documents"
ORACLES: dict[str, str] = {}

# -- detectors -------------------------------------------------------------
_DETECTORS = {
    "iban": (bounded(_IBAN), "account_number"),
    "card_grouped": (bounded(_CARD_GROUPED), "account_number"),
    "card_plain": (bounded(_CARD_PLAIN), "account_number"),
    "phone_ru": (phone(), "private_phone"),
    "email": (free(_EMAIL), "private_email"),
    "url_scheme": (url(_SCHEME), "private_url"),
    "url_bare_host": (url(_HOST), "private_url"),
    "date_numeric": (bounded(_DATE_NUMERIC), "private_date"),
    "date_month_name": (bounded(_DATE_MONTH, "(?i)"), "private_date"),
    "ogrn": (bounded(_OGRN), "account_number"),
    "inn": (bounded(_INN), "account_number"),
    "passport_ru": (bounded(_PASSPORT), "account_number"),
    "snils": (bounded(_SNILS), "account_number"),
    "ogrn_strict": (with_keyword(_OGRN), "account_number"),
    "inn_strict": (with_keyword(_INN), "account_number"),
    "secret_prefixed_key": (free(_KEY), "secret"),
    "secret_aws_key": (free(_AWS), "secret"),
    "secret_github_token": (free(_GITHUB), "secret"),
}
for _name, (_marked, _entity) in _DETECTORS.items():
    ORACLES[f"detect_{_name}"] = numbered(spans(template_sql(_name), _marked, _entity))
for _name in ("email", "card_plain", "date_numeric", "url_bare_host"):
    ORACLES[f"detect_{_name}_documents"] = numbered(spans(_DOCS, *_DETECTORS[_name]))

_FORM = template_sql("form")
for _name, _strict in (("rules_loose", False), ("rules_strict", True)):
    _ctes, _last = chain(_FORM, _strict)
    ORACLES[_name] = f"WITH {_ctes} {numbered(f'SELECT * FROM {_last}')}"

_ON_DOCS, _FOUND = chain(_DOCS)
ORACLES["detect_regex_only"] = f"WITH {_ON_DOCS} {numbered(f'SELECT * FROM {_FOUND}')}"
_ctes, _last = chain("SELECT page_id AS doc_id, html AS text FROM pages")
ORACLES["detect_regex_only_pages"] = f"""WITH {_ctes}
  SELECT entity, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
  FROM {_last} GROUP BY entity"""

# -- redaction -------------------------------------------------------------
ORACLES["redact_tag"] = f"""SELECT doc_id,
  regexp_replace(text, {_q(_EMAIL)}, '[PRIVATE_EMAIL]', 'g') AS redacted FROM documents"""
ORACLES["redact_placeholder"] = f"""SELECT doc_id,
  regexp_replace(text, {_q(_EMAIL)}, '[X]', 'g') AS redacted FROM documents"""
_STARS = f"'\\1' || repeat('*', 16) || '\\3', 'g'"
_CARD = _q(f"(^|{_NOT_WORD})({_CARD_PLAIN})($|{_NOT_WORD})")
ORACLES["redact_mask"] = f"""SELECT doc_id, regexp_replace(
  regexp_replace(text, {_CARD}, {_STARS}), {_CARD}, {_STARS}) AS redacted FROM documents"""
ORACLES["redact"] = f"WITH {_ON_DOCS} {redacted('a_src', _FOUND, _TAG)}"
ORACLES["register_sql_functions"] = ORACLES["redact"]
_ctes, _last = chain(_DOCS, True, name="o")
ORACLES["validate_options"] = f"""WITH {_ctes} SELECT doc_id, redacted
  FROM ({redacted("o_src", _last, "repeat('*', f.\"end\" - f.start)")}) AS x"""

_REQUESTS = """SELECT doc_id AS req_id, doc_id, text,
  CAST(CASE WHEN doc_id % 10 = 3 THEN 0.99 WHEN doc_id % 50 = 7 THEN 1.5 ELSE 0.5 END AS DOUBLE) AS min_score,
  doc_id % 6 <> 5 AS ru_postpass, doc_id % 2 = 0 AS ru_postpass_strict,
  CASE WHEN doc_id % 4 = 1 THEN '[gone]' WHEN doc_id % 4 = 2 THEN '' END AS placeholder,
  CASE WHEN doc_id % 5 = 2 THEN '*' WHEN doc_id % 40 = 9 THEN '**' END AS mask_char
  FROM documents"""
_BY_ROW = """coalesce(repeat(d.mask_char, f."end" - f.start), d.placeholder, '[' || upper(f.entity) || ']')"""
ORACLES["redact_per_row_options"] = f"""WITH r AS (
    SELECT * FROM ({_REQUESTS}) AS q WHERE mask_char IS NULL OR length(mask_char) = 1),
  f AS ({spans("SELECT doc_id, text FROM r", free(_EMAIL), "private_email")})
  SELECT doc_id AS req_id, redacted FROM ({redacted("r", "f", _BY_ROW)}) AS x"""

ORACLES["segment_text"] = f"""WITH p AS (
    SELECT doc_id, string_split({free(_EMAIL)}, chr(1)) AS p FROM documents),
  e AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM p)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
    text, CASE WHEN i % 2 = 0 THEN 'private_email' END AS entity,
    CASE WHEN i % 2 = 0 THEN CAST(0.95 AS DOUBLE) END AS score
  FROM e WHERE i % 2 = 0 OR text <> ''"""


def _escaped(t: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), "
        f"'>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"
    )


ORACLES["highlight_html"] = f"""WITH t AS ({_FORM}),
  p AS (SELECT doc_id, string_split({free(_EMAIL)}, chr(1)) AS p FROM t),
  e AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p)
  SELECT doc_id, string_agg(CASE WHEN i % 2 = 1 THEN {_escaped("x")} ELSE
    '<span class="pii" data-entity="private_email" title="private_email (0.950)">'
    || {_escaped("x")} || '</span>' END, '' ORDER BY i) AS html
  FROM e GROUP BY doc_id"""


def _human(n: str) -> str:
    """Of two equally near decimals the page shows the larger, printf the even."""

    def tenths(x: str) -> str:
        return f"floor({x} * 10 + 0.5) / 10"

    return (
        f"CASE WHEN {n} < 1024 THEN printf('%d B', {n}) "
        f"WHEN {n} < 1048576 THEN printf('%.1f KB', {tenths(f'{n} / 1024.0::DOUBLE')}) "
        f"ELSE printf('%.1f MB', {tenths(f'{n} / 1048576.0::DOUBLE')}) END"
    )


ORACLES["human_bytes"] = f"""SELECT doc_id, {_human("n")} AS size, {_human("(n * 512)")} AS size_512
  FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents) AS d"""

# -- span algebra ----------------------------------------------------------
_ROWS = """SELECT l_orderkey AS doc_id, 'kind_' || l_returnflag AS entity, CAST(NULL AS VARCHAR) AS text,
  CAST(l_linenumber * 15 + l_suppkey % 10 AS INTEGER) AS start,
  CAST(l_linenumber * 15 + l_suppkey % 10 + l_quantity AS INTEGER) AS "end",
  1 - l_discount AS score,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS ord FROM lineitem"""
_CANDIDATES = """SELECT o_orderkey AS doc_id, CAST(o_custkey % 120 AS INTEGER) AS start,
  CAST(o_custkey % 120 + 8 AS INTEGER) AS "end" FROM orders"""

ORACLES["collect_spans"] = f"""SELECT doc_id, CAST(count(*) AS INTEGER) AS n,
  string_agg(start || '-' || "end", ',' ORDER BY start, ord) AS ranges
  FROM ({_ROWS}) AS r GROUP BY doc_id"""
ORACLES["explode_spans"] = f"""SELECT doc_id,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, ord) - 1 AS INTEGER) AS pos,
  entity, start, "end", score FROM ({_ROWS}) AS r"""
ORACLES["span_overlap_pairs"] = f"""WITH r AS ({_ROWS})
  SELECT a.doc_id, a.ord, a.start, a."end", CAST(count(b.ord) AS BIGINT) AS n_partners
  FROM r AS a LEFT JOIN r AS b ON a.doc_id = b.doc_id AND a.ord <> b.ord
    AND a.start < b."end" AND b.start < a."end"
  GROUP BY a.doc_id, a.ord, a.start, a."end" """
ORACLES["drop_overlapping_existing"] = f"""WITH r AS ({_ROWS})
  SELECT c.doc_id, c.start, c."end" FROM ({_CANDIDATES}) AS c WHERE NOT EXISTS (
    SELECT 1 FROM r WHERE r.doc_id = c.doc_id AND r.start < c."end" AND c.start < r."end")"""
ORACLES["drop_overlapping_existing_arrays"] = ORACLES["drop_overlapping_existing"]
ORACLES["resolve_overlaps"] = f"""WITH RECURSIVE r AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM ({_ROWS}) AS r0),
  w AS (SELECT doc_id, rn, entity, start, "end", TRUE AS kept,
          [struct_pack(s := start, e := "end")] AS taken FROM r WHERE rn = 1
        UNION ALL
        SELECT r.doc_id, r.rn, r.entity, r.start, r."end",
          len(list_filter(w.taken, lambda k: k.s < r."end" AND r.start < k.e)) = 0,
          CASE WHEN len(list_filter(w.taken, lambda k: k.s < r."end" AND r.start < k.e)) = 0
            THEN list_append(w.taken, struct_pack(s := r.start, e := r."end")) ELSE w.taken END
        FROM w JOIN r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS INTEGER) AS pos,
    entity, start, "end" FROM w WHERE kept"""
ORACLES["merge_spans"] = f"""WITH o AS ({_CANDIDATES}), m AS (
    SELECT doc_id, 'added' AS entity, start, "end", 1 AS later, 0 AS ord FROM o
    UNION ALL SELECT doc_id, entity, start, "end", 0, ord FROM ({_ROWS}) AS r
    WHERE doc_id IN (SELECT doc_id FROM o))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, later, ord) - 1 AS INTEGER) AS pos,
    entity, start, "end" FROM m"""


def _sweep(rows: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, ord) AS rn
      FROM ({rows}) AS r0),
    w AS (SELECT doc_id, rn, entity, start, "end", TRUE AS kept, "end" AS cur FROM r WHERE rn = 1
      UNION ALL
      SELECT r.doc_id, r.rn, r.entity, r.start, r."end", r.start >= w.cur,
        CASE WHEN r.start >= w.cur THEN r."end" ELSE w.cur END
      FROM w JOIN r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)"""


ORACLES["sweep_non_overlapping"] = f"""WITH RECURSIVE {_sweep(_ROWS)}
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS INTEGER) AS pos,
    entity, start, "end" FROM w WHERE kept"""
ORACLES["filter_min_score"] = f"""SELECT doc_id, start, "end", score, ord
  FROM ({_ROWS}) AS r WHERE NOT score < 0.95::DOUBLE"""
ORACLES["filter_min_score_final"] = f"""SELECT doc_id, start, "end", score, ord
  FROM ({_ROWS}) AS r WHERE doc_id % 3 = 0 OR score >= 0.97::DOUBLE"""

_EXISTING = f"""SELECT doc_id, 0 AS rule, 'private_person' AS entity,
  substring(text, CAST(instr(text, '@') - 2 AS INTEGER), 2) AS text,
  CAST(instr(text, '@') - 3 AS INTEGER) AS start, CAST(instr(text, '@') - 1 AS INTEGER) AS "end"
  FROM ({_FORM}) AS x"""
_ctes, _last = chain(_FORM, existing=_EXISTING)
_post = numbered(
    f"SELECT * FROM {_last}", "start, rule",
    "CASE WHEN rule = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END",
)
ORACLES["ru_postpass"] = f"""WITH {_ctes}
  SELECT doc_id, pos, entity, start, "end", score FROM ({_post}) AS x"""

# -- model -----------------------------------------------------------------
_raw = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS i, '{entity}' AS entity, least(length(text), {a}) AS s,
    least(length(text), {b}) AS e, text AS t, (doc_id % 100) / 100 + {plus}::DOUBLE AS score FROM documents"""
    for i, (entity, plus, a, b) in enumerate(
        (("person", "0.0", 0, 4), ("place", "0.1", 3, 9), ("UNKNOWN", "-0.2", 5, 30))
    )
)
ORACLES["normalize_raw_spans"] = f"""SELECT doc_id,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, entity,
  substring(t, s + 1, e - s) AS text, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", score
  FROM ({_raw}) AS r WHERE score >= 0.45::DOUBLE"""


def _words(threshold: str) -> str:
    marked = "replace(text, 'the ', chr(1) || 'the' || chr(1) || ' ')"
    return f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos,
      entity, text, start, "end", score
      FROM (SELECT *, (start * 7) % 100 / 100 AS score FROM ({spans(_DOCS, marked, "word")}) AS m) AS x
      WHERE score >= {threshold}::DOUBLE"""


ORACLES["detect_batch"] = _words("0.5")
_near = spans(_DOCS, "replace(text, 'the ', chr(1) || 'the' || chr(1) || ' ')", "word")
ORACLES["detect_long"] = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos,
    entity, text, start, "end", score
  FROM (SELECT m.*, (unicode(substring(d.text, m.start + 5, 1)) % 8) / 8::DOUBLE AS score, length(d.text) AS n
    FROM ({_near}) AS m JOIN documents AS d ON d.doc_id = m.doc_id) AS x
  WHERE start + 4 < n AND score >= 0.25"""
ORACLES["detect_one"] = _words("0.9")
ORACLES["skip_empty_text"] = """SELECT doc_id,
  CASE WHEN doc_id % 3 = 0 OR text = '' THEN 0 ELSE 1 END AS n_one, 1 AS n_batch FROM documents"""

_SCORED = f"SELECT * FROM ({_EXISTING}) AS e WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0"


def _some(where: str, sql: str) -> str:
    return f"SELECT * FROM ({sql}) AS s0 WHERE {where}"


_loose, _a = chain(
    _some("doc_id % 5 <> 0 AND doc_id % 3 <> 0", _FORM), False,
    _some("doc_id % 5 <> 0 AND doc_id % 3 <> 0", _SCORED), name="a",
)
_strict, _b = chain(
    _some("doc_id % 5 <> 0 AND doc_id % 3 = 0", _FORM), True,
    _some("doc_id % 5 <> 0 AND doc_id % 3 = 0", _SCORED), name="b",
)
ORACLES["detect_pii"] = f"""WITH {_loose}, {_strict}, u AS (
    SELECT * FROM {_a} UNION ALL SELECT * FROM {_b}
    UNION ALL {_some("doc_id % 5 = 0", _SCORED)})
  SELECT doc_id, entity, text, start, "end",
    CASE WHEN rule = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS score
  FROM u WHERE doc_id % 7 <> 0"""
_ctes, _last = chain(_DOCS, extra=True)
ORACLES["extra_rules"] = f"""WITH {_ctes}
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos,
    text, start, "end" FROM {_last} WHERE entity = 'order_word'"""

# -- validation ------------------------------------------------------------
_BYTES = "octet_length(encode(text))"
ORACLES["reject_oversized_text"] = f"SELECT doc_id FROM documents WHERE {_BYTES} > 4000"
_UPLOADS = f"""SELECT doc_id, text,
  'in/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.bin'
    WHEN 3 THEN '' ELSE '.tar.json' END AS path,
  CASE doc_id % 9 WHEN 2 THEN 'text/x-any' WHEN 3 THEN 'image/png' END AS media_type,
  CAST({_BYTES} + CASE WHEN doc_id % 7 = 4 THEN 1 ELSE 0 END AS BIGINT) AS length,
  doc_id % 7 = 4 AS broken,
  CASE WHEN doc_id % 13 = 0 THEN '--' WHEN doc_id % 3 = 0 THEN '#' END AS mask_char FROM documents"""
ORACLES["reject_oversized_file"] = f"SELECT path, length FROM ({_UPLOADS}) AS u WHERE length > 4000"
ORACLES["reject_invalid_utf8"] = f"SELECT path FROM ({_UPLOADS}) AS u WHERE broken"
ORACLES["reject_bad_mask_char"] = (
    f"SELECT req_id, mask_char FROM ({_REQUESTS}) AS r WHERE length(mask_char) <> 1"
)
ORACLES["reject_bad_min_score"] = (
    f"SELECT req_id, min_score FROM ({_REQUESTS}) AS r WHERE min_score < 0 OR min_score > 1"
)
ORACLES["flag_blank_text"] = r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE
  WHEN 2 THEN FALSE ELSE NOT regexp_matches(text, '\S') END AS blank FROM documents"""
_VERDICT = f"""CASE WHEN {_BYTES} > 6000 THEN 'text exceeds 6000 bytes'
  WHEN min_score < 0 OR min_score > 1 THEN 'min_score must be between 0 and 1'
  WHEN length(mask_char) <> 1 THEN 'mask_char must be a single character' ELSE 'ok' END"""
ORACLES["validate_requests"] = f"""SELECT CASE WHEN reason <> 'malformed request' THEN req_id END AS req_id,
  CASE WHEN reason = 'ok' THEN 200 ELSE 422 END AS status, reason
  FROM (SELECT req_id, CASE WHEN req_id % 20 IN (11, 12) THEN 'malformed request'
    WHEN req_id % 20 = 13 THEN 'text missing' ELSE {_VERDICT} END AS reason FROM ({_REQUESTS}) AS r) AS v"""
ORACLES["split_requests"] = f"""SELECT reason, count(*) AS n, count(*) AS n_written, CAST(sum(req_id) AS BIGINT) AS ids
  FROM (SELECT req_id, {_VERDICT} AS reason FROM ({_REQUESTS}) AS r) AS v GROUP BY reason"""
_loose, _loose_last = chain("SELECT req_id AS doc_id, text FROM good WHERE NOT ru_postpass_strict", name="l")
_strict, _strict_last = chain("SELECT req_id AS doc_id, text FROM good WHERE ru_postpass_strict", True, name="s")
ORACLES["sql_table_functions"] = f"""WITH judged AS (SELECT *, {_VERDICT} AS reason FROM ({_REQUESTS}) AS r),
  good AS (SELECT * FROM judged WHERE reason = 'ok' AND ru_postpass), {_loose}, {_strict},
  kept AS (SELECT f.* FROM (SELECT * FROM {_loose_last} UNION ALL SELECT * FROM {_strict_last}) AS f
    JOIN good AS g ON g.req_id = f.doc_id WHERE 0.95 >= g.min_score OR g.min_score <= 0)
  SELECT req_id, reason, CAST(NULL AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS INTEGER) AS start,
    CAST(NULL AS INTEGER) AS "end" FROM judged WHERE reason <> 'ok'
  UNION ALL SELECT doc_id, 'ok', pos, entity, start, "end" FROM ({numbered('SELECT * FROM kept')}) AS k"""

# -- sources and sinks -----------------------------------------------------
ORACLES["read_text_documents"] = """SELECT s_suppkey,
  'Note for ' || s_name || chr(13) || chr(10) || 'mail s' || s_suppkey || '@mail.ru' || chr(10) AS text,
  1 AS n FROM supplier"""
ORACLES["read_requests"] = f"""SELECT req_id, text, min_score, ru_postpass,
  CAST(NULL AS BOOLEAN) AS ru_postpass_strict, placeholder, mask_char FROM ({_REQUESTS}) AS r"""
_judged = f"""(SELECT *, CASE status WHEN 413 THEN 'file exceeds 6000 bytes' WHEN 400 THEN 'not UTF-8'
    WHEN 422 THEN 'mask_char must be a single character' ELSE 'ok' END AS reason
    FROM (SELECT *, CASE WHEN length > 6000 THEN 413 WHEN broken THEN 400
      WHEN length(mask_char) <> 1 THEN 422 ELSE 200 END AS status
      FROM ({_UPLOADS}) AS u) AS v)"""
_ctes, _last = chain("SELECT doc_id, text FROM good", name="u")
_MASKED = """coalesce(repeat(d.mask_char, f."end" - f.start), '[' || upper(f.entity) || ']')"""
ORACLES["ingest_binary_files"] = f"""WITH judged AS {_judged},
  good AS (SELECT * FROM judged WHERE status = 200), {_ctes}
  SELECT g.path, 200 AS status, 'ok' AS reason, redacted, n_spans,
    row_number() OVER (PARTITION BY g.text ORDER BY g.path) > 1 AS cached
  FROM ({redacted("good", _last, _MASKED)}) AS x JOIN good AS g ON g.doc_id = x.doc_id
  UNION ALL SELECT path, status, reason, NULL, NULL, NULL FROM judged WHERE status <> 200"""
ORACLES["redact_stored_files"] = """SELECT s_suppkey,
  '[PRIVATE_EMAIL], card [ACCOUNT_NUMBER]' || chr(10) AS redacted, 2 AS n_spans FROM supplier"""
ORACLES["filter_text_files"] = f"""SELECT path FROM ({_UPLOADS}) AS u
  WHERE media_type LIKE 'text/%' OR doc_id % 5 IN (0, 1, 4)"""
_INSIDE = f"""SELECT r.doc_id, r.entity, substring(d.text, r.start + 1, r."end" - r.start) AS text,
  r.start, r."end", r.score, r.ord FROM ({_ROWS}) AS r JOIN documents AS d ON d.doc_id = r.doc_id
  WHERE r.start >= 0 AND r."end" <= length(d.text)"""
ORACLES["attach_external_spans"] = f"""SELECT doc_id,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, ord) - 1 AS INTEGER) AS pos,
  entity, text, start, "end", score FROM ({_INSIDE}) AS i"""
ORACLES["reject_external_spans"] = f"""SELECT r.doc_id, r.ord, 422 AS status,
  CASE WHEN d.doc_id IS NULL THEN 'no such document' ELSE 'span does not lie inside the text' END AS reason
  FROM ({_ROWS}) AS r LEFT JOIN documents AS d ON d.doc_id = r.doc_id
  WHERE d.doc_id IS NULL OR r."end" > length(d.text)"""
ORACLES["redact_with_external_spans"] = f"""WITH RECURSIVE {_sweep(_INSIDE)},
  f AS (SELECT * FROM w WHERE kept)
  SELECT doc_id, redacted FROM ({redacted("documents", "f", _TAG)}) AS x"""
ORACLES["redact_in_stretches"] = ORACLES["redact_with_external_spans"]

_MARKS = """SELECT doc_id AS req_id, row_number() OVER (
  PARTITION BY text, doc_id % 3 = 0 ORDER BY doc_id) > 1 AS cached FROM documents"""
ORACLES["detect_response"] = f"""WITH {_ON_DOCS}, m AS ({_MARKS})
  SELECT m.req_id, 'rules-only' AS model, CAST(count(f.doc_id) AS INTEGER) AS n_spans,
    coalesce(string_agg(f.text, ',' ORDER BY f.start), '') AS texts, m.cached
  FROM m LEFT JOIN {_FOUND} AS f ON f.doc_id = m.req_id GROUP BY m.req_id, m.cached"""
_ok = f"SELECT * FROM (SELECT *, {_VERDICT} AS reason FROM ({_REQUESTS}) AS r) AS v WHERE reason = 'ok'"
_loose, _a = chain(
    "SELECT doc_id, text FROM ok WHERE ru_postpass AND min_score <= 0.95 AND NOT ru_postpass_strict",
    False, name="a",
)
_strict, _b = chain(
    "SELECT doc_id, text FROM ok WHERE ru_postpass AND min_score <= 0.95 AND ru_postpass_strict",
    True, name="b",
)
ORACLES["redact_response"] = f"""WITH ok AS ({_ok}), {_loose}, {_strict},
  f AS (SELECT * FROM {_a} UNION ALL SELECT * FROM {_b})
  SELECT x.doc_id AS req_id, 'rules-only' AS model, redacted, n_spans, cached, 200 AS status, 'ok' AS reason
  FROM ({redacted("ok", "f", _BY_ROW)}) AS x JOIN (SELECT doc_id, row_number() OVER (
    PARTITION BY text, min_score, ru_postpass, ru_postpass_strict ORDER BY doc_id) > 1 AS cached FROM ok) AS c
    ON c.doc_id = x.doc_id
  UNION ALL SELECT req_id, NULL, NULL, NULL, NULL, 422, reason
  FROM (SELECT req_id, {_VERDICT} AS reason FROM ({_REQUESTS}) AS r) AS v WHERE reason <> 'ok'"""

_MAIL = template_sql("email")


def _json(extra: str) -> str:
    return f"""WITH t AS ({_MAIL}), f AS ({spans("SELECT doc_id, text FROM t", free(_EMAIL), "private_email")})
  SELECT t.doc_id, '{{' || {extra} || '"input":' || to_json(t.text) || ',"redacted":'
    || to_json(regexp_replace(t.text, {_q(_EMAIL)}, '[PRIVATE_EMAIL]', 'g')) || ',"spans":['
    || coalesce(string_agg('{{"entity":"private_email","text":' || to_json(f.text) || ',"start":'
      || f.start || ',"end":' || f."end" || ',"score":0.95}}', ',' ORDER BY f.start), '') || ']}}' AS json
  FROM t LEFT JOIN f ON f.doc_id = t.doc_id GROUP BY t.doc_id, t.text"""


ORACLES["result_json"] = _json("''")
ORACLES["suite_json"] = _json("'\"name\":\"case_' || t.doc_id || '\",'")
ORACLES["redacted_text_sink"] = f"""SELECT redacted, count(*) AS n
  FROM ({ORACLES["redact_tag"]}) AS r GROUP BY redacted"""
_REPORT = """entity, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text,
  start || '-' || "end" AS range, printf('%.4f', score) AS score"""
ORACLES["span_report"] = (
    f"WITH {_ON_DOCS} SELECT doc_id, pos, {_REPORT} "
    f"FROM ({numbered(f'SELECT * FROM {_FOUND}')}) AS n"
)
ORACLES["span_report_empty"] = f"""WITH {_ON_DOCS}
  SELECT doc_id, pos, {_REPORT} FROM ({numbered(f'SELECT * FROM {_FOUND}')}) AS n
  UNION ALL SELECT doc_id, NULL, 'No PII detected', NULL, NULL, NULL FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM {_FOUND})"""
ORACLES["span_count_per_doc"] = f"""WITH {_ON_DOCS}
  SELECT d.doc_id, CAST(count(f.doc_id) AS INTEGER) AS n_spans FROM documents AS d
  LEFT JOIN {_FOUND} AS f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""

# -- repeats ---------------------------------------------------------------
ORACLES["detect_fingerprint"] = f"""SELECT req_id, sha256(concat_ws(chr(31), text,
  printf('%.4f', round_even(min_score, 4)), CAST(CAST(ru_postpass AS INTEGER) AS VARCHAR),
  CAST(CAST(ru_postpass_strict AS INTEGER) AS VARCHAR))) AS fp FROM ({_REQUESTS}) AS r"""
ORACLES["detect_distinct_once"] = f"""WITH {_ON_DOCS}, m AS ({_MARKS})
  SELECT m.req_id, coalesce(string_agg(f.entity || ':' || f.start || ':' || f."end", ',' ORDER BY f.start), '') AS ranges,
    m.cached FROM m LEFT JOIN {_FOUND} AS f ON f.doc_id = m.req_id GROUP BY m.req_id, m.cached"""
_ctes, _last = chain(_DOCS, extra=_NETS)
ORACLES["extra_rules_by_hundred"] = f"""WITH {_ctes}
  SELECT doc_id, pos, CASE entity WHEN 'net' THEN 'net_' || string_split(text, '.')[1] ELSE entity END AS entity,
    text, start, "end" FROM ({numbered(f'SELECT * FROM {_last}')})"""
_ASKED = """SELECT doc_id, text, 0 AS late FROM documents
  UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text, 1 FROM conversations"""
_ctes, _last = chain(f"SELECT doc_id, text FROM ({_ASKED})")
ORACLES["detect_across_runs"] = f"""WITH {_ctes}, m AS (
  SELECT doc_id AS req_id,
    late = 0 OR row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS cached FROM ({_ASKED})
) SELECT m.req_id, coalesce(string_agg(f.entity || ':' || f.start || ':' || f."end", ',' ORDER BY f.start), '') AS ranges,
    m.cached FROM m LEFT JOIN {_last} AS f ON f.doc_id = m.req_id GROUP BY m.req_id, m.cached"""
ORACLES["mark_cached"] = _MARKS
ORACLES["cache_stats"] = f"""SELECT count(*) FILTER (WHERE NOT cached) AS size,
  count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE NOT cached) AS misses
  FROM ({_MARKS}) AS m"""

# -- metrics ---------------------------------------------------------------
ORACLES["corpus_totals"] = """SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars
  FROM documents"""
ORACLES["span_total"] = f"WITH {_ON_DOCS} SELECT count(*) AS spans FROM {_FOUND}"
ORACLES["entities_present"] = f"""WITH {_ON_DOCS}
  SELECT d.doc_id, coalesce(string_agg(DISTINCT f.entity, ',' ORDER BY f.entity), '') AS entities
  FROM documents AS d LEFT JOIN {_FOUND} AS f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""
ORACLES["spans_by_entity"] = f"""WITH {_ON_DOCS}
  SELECT d.doc_id, coalesce(string_agg(f.text, ',' ORDER BY f.start), '') AS accounts
  FROM documents AS d LEFT JOIN {_FOUND} AS f
    ON f.doc_id = d.doc_id AND f.entity = 'account_number' GROUP BY d.doc_id"""
ORACLES["entity_counts"] = f"""WITH {_ON_DOCS}
  SELECT entity, count(*) AS spans, count(DISTINCT doc_id) AS documents FROM {_FOUND} GROUP BY entity"""
_LATENCIES = """SELECT user_id % 7 AS run, event_id % 1000 AS chars, value / 1000 AS elapsed, value FROM events"""
_PER_RUN = f"""SELECT run, CAST(sum(chars) AS DOUBLE) / greatest(sum(elapsed), 1e-9) AS c
  FROM ({_LATENCIES}) AS l GROUP BY run"""
ORACLES["throughput_by_run"] = f"SELECT run, round(c, 3) AS chars_per_s FROM ({_PER_RUN}) AS r"
ORACLES["mean_throughput"] = f"SELECT round(avg(c), 3) AS chars_per_s FROM ({_PER_RUN}) AS r"
ORACLES["latency_percentiles"] = """WITH v AS (
    SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n
    FROM events WHERE value IS NOT NULL),
  p AS (SELECT unnest([0.0, 12.5, 50.0, 90.0, 99.0, 100.0])::DOUBLE AS pct)
  SELECT p.pct, v.value FROM p JOIN v ON v.k = round_even(p.pct / 100 * (v.n - 1), 0)"""
ORACLES["latency_mean"] = "SELECT round(avg(value), 6) AS mean FROM events"

# -- streams ---------------------------------------------------------------
ORACLES["stream_redact"] = f"""WITH {_ON_DOCS}, d AS (
    SELECT doc_id, text, CASE WHEN doc_id % 5 = 2 THEN '*' END AS mask_char FROM documents),
  x AS ({redacted("d", _FOUND, '''coalesce(repeat(d.mask_char, f."end" - f.start), '[' || upper(f.entity) || ']')''')})
  SELECT doc_id AS req_id, CASE WHEN doc_id % 50 <> 7 THEN redacted END AS redacted,
    CASE WHEN doc_id % 50 = 7 THEN 422 END AS status FROM x"""
ORACLES["stream_mark_cached"] = """SELECT doc_id AS req_id,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS cached FROM documents"""

ORACLES["stream_mark_recent"] = """SELECT event_id AS req_id,
  coalesce(ts - lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY, false)
    AS cached FROM events"""
