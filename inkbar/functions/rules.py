"""The ordered pattern rules, as data.

A ``Part`` is one shape; a ``Rule`` is an ordered choice of parts that share a
category.  ``functions.scan`` turns a rule list into one Column expression.

Dialect notes (Java regular expressions, code-point semantics):

* Java's ``\\w \\d \\s`` are ASCII only, so the Unicode classes are spelled out.
* ``WORD`` holds one astral letter on purpose: Java then steps over surrogate
  pairs as whole characters in a look-behind.
* Patterns that have no left boundary start with ``\\G`` or a look-behind on
  their own class.  They match what they would match without it, but a long run
  of letters is read once instead of once per letter.
"""

from __future__ import annotations

from dataclasses import dataclass

from inkbar import schema as S

# --------------------------------------------------------------------------
# Word lists and character classes the results depend on.
# --------------------------------------------------------------------------
MONTHS = (
    "янв(?:аря|\\.)|фев(?:раля|\\.)|мар(?:та|\\.)|апр(?:еля|\\.)|мая|июн(?:я|\\.)|"
    "июл(?:я|\\.)|авг(?:уста|\\.)|сен(?:тября|\\.)|окт(?:ября|\\.)|ноя(?:бря|\\.)|"
    "дек(?:абря|\\.)"
)
HOST_ENDINGS = (
    "ru by kz ua uk рф москва рус онлайн com net org info biz edu gov io dev app "
    "ai co me tech xyz cloud site store page"
).split()
KEYWORDS = (
    "ИНН|инн|INN|ОГРН(?:ИП)?|огрн(?:ип)?|OGRN(?:IP)?|СНИЛС|снилс|SNILS|паспорт|"
    "passport|номер{blank}+карты|card{blank}+(?:no|number)"
)
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = "[\\p{L}\\p{N}_\U00010000]"
DIGIT = r"\p{Nd}"
# What the web page's trim takes for blank.
PAGE_BLANK = r"\t-\r\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
STOP = f"[{BLANK}<>\"',;]"
NOT_STOP = f"[^{BLANK}<>\"',;]"
SENTENCE_END = f"[.!?](?:[{BLANK}]|$)"
SOME_NUMBER = f"{DIGIT}[{DIGIT}{BLANK}.\\-()]"
MAIL_LOCAL = r"[A-Za-zА-Яа-я0-9._%+\-]"
HOST_LABEL = r"[A-Za-zА-Яа-я0-9\-]"
# --------------------------------------------------------------------------

_ENDINGS = "|".join(HOST_ENDINGS)
_KEYWORD = f"(?:{KEYWORDS.format(blank=f'[{BLANK}]')})[{BLANK}:№#]*+"


def _whole(body: str, first: str = DIGIT) -> str:
    """``body`` not next to a word character; ``first`` is a cheap first test."""
    return f"(?=[{first}])(?<!{WORD}){body}(?!{WORD})"


def _digits(*lengths: int) -> str:
    return "|".join(_whole(f"{DIGIT}{{{n}}}") for n in lengths)


def _unbounded(cls: str) -> str:
    return f"(?:\\G|(?<!{cls})){cls}++"


@dataclass(frozen=True)
class Part:
    """One shape.

    ``context`` must stand right before the match but is not part of the span.
    ``literals`` (any of them) and ``shape`` are necessary for a match; a text
    without them is not scanned.  ``needs_digits`` says that every match also
    contains ``SOME_NUMBER`` and that ``shape`` starts at a digit.
    """

    name: str
    pattern: str
    literals: tuple[str, ...] = ()
    shape: str | None = None
    needs_digits: bool = False
    context: str | None = None


@dataclass(frozen=True)
class Rule:
    """Ordered choice of parts under one category.

    ``cuttable`` promises that no match contains any of ``, ; < > " '`` and that
    a blank inside a match is followed only by what ``scan.CUT`` leaves alone.
    Rules added by a caller are not cuttable unless they say so, and then
    read every text in one piece.  ``mode`` is "loose" or
    "strict" for a rule of that mode only.
    """

    entity: str
    parts: tuple[Part, ...]
    ignore_case: bool = False
    cuttable: bool = False
    mode: str | None = None

    @property
    def has_context(self) -> bool:
        return any(p.context for p in self.parts)

    @property
    def pattern(self) -> str:
        flags = "(?iu)" if self.ignore_case else ""
        if not self.has_context:
            return flags + "|".join(p.pattern for p in self.parts)
        return flags + "|".join(
            f"(?<c{i}>{p.context or ''})(?<b{i}>{p.pattern})"
            for i, p in enumerate(self.parts)
        )

    def replacement_parts(self, mark: str) -> list[str]:
        """``mark`` on both sides of the span; its context stays outside."""
        if not self.has_context:
            return [mark, "$0", mark]
        n = len(self.parts)
        context = "".join(f"${{c{i}}}" for i in range(n))
        body = "".join(f"${{b{i}}}" for i in range(n))
        return [context, mark, body, mark]


# --------------------------------------------------------------------------
# The shapes.
# --------------------------------------------------------------------------
_SHAPES = (
    Part(
        "iban",
        _whole(f"[A-Z]{{2}}{DIGIT}{{2}}(?:[{BLANK}]?[A-Z0-9]{{4}}){{3,7}}", "A-Z"),
        shape=f"{DIGIT}{{2}}(?<=[A-Z]{{2}}{DIGIT}{{2}})",
        needs_digits=True,
    ),
    Part(
        "card_grouped",
        _whole(f"(?:{DIGIT}{{4}}[{BLANK}\\-]){{3}}{DIGIT}{{4}}"),
        shape=f"{DIGIT}{{4}}[{BLANK}\\-]{DIGIT}{{4}}",
        needs_digits=True,
    ),
    Part("card_plain", _digits(16), shape=f"{DIGIT}{{16}}", needs_digits=True),
    Part(
        "phone_ru",
        f"(?=[+78])(?:^|(?<=[{BLANK},;:()\\[\\]<>\"']))(?:\\+7|8|7)"
        f"[{BLANK}\\-.()]+{DIGIT}{{3}}[{BLANK}\\-.()]*{DIGIT}{{3}}"
        f"[{BLANK}\\-.]*{DIGIT}{{2}}[{BLANK}\\-.]*{DIGIT}{{2}}",
        shape=f"[78][{BLANK}\\-.()]++{DIGIT}{{3}}",
        needs_digits=True,
    ),
    Part(
        "email",
        _unbounded(MAIL_LOCAL) + r"@[A-Za-zА-Яа-я0-9.\-]+\.[A-Za-zА-Яа-я]{2,}",
        literals=("@",),
    ),
    Part(
        "url_scheme",
        f"(?:https?://|www\\.){NOT_STOP}+?(?={STOP}|{SENTENCE_END}|$)",
        literals=("://", "www."),
    ),
    Part(
        "url_bare_host",
        _unbounded(HOST_LABEL)
        + f"\\.(?:{_ENDINGS})(?:/{NOT_STOP}*?(?={SENTENCE_END}|{STOP}|$))?",
        shape=f"\\.(?:{_ENDINGS})",
    ),
    Part(
        "date_numeric",
        _whole(f"{DIGIT}{{1,2}}\\.{DIGIT}{{1,2}}\\.{DIGIT}{{2,4}}"),
        shape=f"{DIGIT}\\.{DIGIT}{{1,2}}\\.{DIGIT}{{2}}",
        needs_digits=True,
    ),
    Part(
        "date_month_name",
        _whole(
            f"{DIGIT}{{1,2}}[{BLANK}]+(?:{MONTHS})[{BLANK}]+{DIGIT}{{4}}"
            f"(?:[{BLANK}]*г\\.?)?"
        ),
        shape=f"{DIGIT}[{BLANK}]++(?:{MONTHS})",
        needs_digits=True,
    ),
    Part("ogrn", _digits(15, 13), shape=f"{DIGIT}{{13}}", needs_digits=True),
    Part("inn", _digits(12, 10), shape=f"{DIGIT}{{10}}", needs_digits=True),
    Part(
        "passport_ru",
        _whole(f"{DIGIT}{{4}}[{BLANK}]{DIGIT}{{6}}"),
        shape=f"{DIGIT}{{4}}[{BLANK}]{DIGIT}{{6}}",
        needs_digits=True,
    ),
    Part(
        "snils",
        _whole(f"{DIGIT}{{3}}-{DIGIT}{{3}}-{DIGIT}{{3}}[{BLANK}\\-]{DIGIT}{{2}}"),
        shape=f"{DIGIT}{{3}}-{DIGIT}{{3}}-{DIGIT}{{3}}",
        needs_digits=True,
    ),
    Part(
        "ogrn_strict",
        _digits(15, 13),
        shape=f"{DIGIT}{{13}}",
        needs_digits=True,
        context=_KEYWORD,
    ),
    Part(
        "inn_strict",
        _digits(12, 10),
        shape=f"{DIGIT}{{10}}",
        needs_digits=True,
        context=_KEYWORD,
    ),
    Part(
        "secret_prefixed_key",
        f"(?=[spr])(?<!{WORD})(?:sk|pk|rk)-[A-Za-z0-9_\\-]{{16,}}"
        f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))",
        literals=("sk-", "pk-", "rk-"),
    ),
    Part(
        "secret_aws_key",
        f"(?=A)(?<!{WORD})AKIA[0-9A-Z]{{16}}(?!{WORD})",
        literals=("AKIA",),
    ),
    Part(
        "secret_github_token",
        f"(?=g)(?<!{WORD})(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{{20,}}+(?!{WORD})",
        literals=("_",),
        shape="g(?:h[pousr]|ithub_pat)_",
    ),
)
# --------------------------------------------------------------------------

PARTS = {p.name: p for p in _SHAPES}


def _rule(
    entity: str, *names: str, ignore_case: bool = False, mode: str | None = None
) -> Rule:
    parts = tuple(PARTS[n] for n in names)
    return Rule(entity, parts, ignore_case=ignore_case, cuttable=True, mode=mode)


# The order decides which of two overlapping matches is kept.
RULES: tuple[Rule, ...] = (
    _rule(S.ACCOUNT_NUMBER, "iban", "card_grouped", "card_plain"),
    _rule(S.PRIVATE_PHONE, "phone_ru"),
    _rule(S.PRIVATE_EMAIL, "email"),
    _rule(S.PRIVATE_URL, "url_scheme", "url_bare_host"),
    _rule(S.PRIVATE_DATE, "date_numeric", "date_month_name", ignore_case=True),
    _rule(S.ACCOUNT_NUMBER, "ogrn", "inn", "passport_ru", "snils", mode="loose"),
    _rule(
        S.ACCOUNT_NUMBER,
        "ogrn_strict",
        "inn_strict",
        "passport_ru",
        "snils",
        mode="strict",
    ),
    _rule(S.SECRET, "secret_prefixed_key", "secret_aws_key", "secret_github_token"),
)
RULES_LOOSE = tuple(r for r in RULES if r.mode != "strict")
RULES_STRICT = tuple(r for r in RULES if r.mode != "loose")

# Category of each shape, for running one shape alone.
PART_RULES = {
    p.name: Rule(r.entity, (p,), ignore_case=r.ignore_case, cuttable=True)
    for r in RULES
    for p in r.parts
}


def rules_for(
    strict: bool | None = False, extra_rules: tuple[Rule, ...] | list[Rule] = ()
) -> tuple[Rule, ...]:
    """The ordered rules, a caller's own last; None means both modes."""
    own = RULES if strict is None else RULES_STRICT if strict else RULES_LOOSE
    return own + tuple(extra_rules)


def make_rule(
    entity: str,
    *patterns: str,
    literals: tuple[str, ...] = (),
    ignore_case: bool = False,
    cuttable: bool = False,
) -> Rule:
    """A caller's rule.  ``patterns`` use the Java dialect and must not match ''.

    ``cuttable`` promises what ``Rule`` says of it, so that long texts are read in pieces.
    """
    if not patterns or not all(patterns):
        raise ValueError("a rule needs at least one pattern, none of them empty")
    parts = tuple(
        Part(f"{entity}_{i}", p, literals=literals) for i, p in enumerate(patterns)
    )
    return Rule(entity, parts, ignore_case=ignore_case, cuttable=cuttable)
