"""Plain Python statement of what a detection returns, for checking Spark.

One text at a time, patterns in Python's own dialect, no shared code with the
package: the point is that two independent statements agree.
"""

import re

# Word lists and patterns the results depend on, in natural order.
ENDINGS = (
    "ru|by|kz|ua|uk|рф|москва|рус|онлайн|com|net|org|info|biz|edu|gov|io|dev|app|"
    "ai|co|me|tech|xyz|cloud|site|store|page"
)
MONTH = (
    r"янв(?:аря|\.)|фев(?:раля|\.)|мар(?:та|\.)|апр(?:еля|\.)|мая|июн(?:я|\.)|"
    r"июл(?:я|\.)|авг(?:уста|\.)|сен(?:тября|\.)|окт(?:ября|\.)|ноя(?:бря|\.)|"
    r"дек(?:абря|\.)"
)
CONTEXT = (
    r"(?:ИНН|инн|INN|ОГРН(?:ИП)?|огрн(?:ип)?|OGRN(?:IP)?|СНИЛС|снилс|SNILS|паспорт|"
    r"passport|номер\s+карты|card\s+(?:no|number))[\s:№#]*"
)


def whole(body):
    return r"(?<!\w)" + body + r"(?!\w)"


SHAPES = {
    "iban": whole(r"[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}"),
    "card_grouped": whole(r"(?:\d{4}[\s\-]){3}\d{4}"),
    "card_plain": whole(r"\d{16}"),
    "phone_ru": r"(?:^|(?<=[\s,;:()\[\]<>\"']))(?:\+7|8|7)[\s\-.()]+\d{3}"
    r"[\s\-.()]*\d{3}[\s\-.]*\d{2}[\s\-.]*\d{2}",
    "email": r"[A-Za-zА-Яа-я0-9._%+\-]+@[A-Za-zА-Яа-я0-9.\-]+\.[A-Za-zА-Яа-я]{2,}",
    "url_scheme": r"(?:https?://|www\.)[^\s<>\"',;]+?(?=[\s<>\"',;]|[.!?](?:\s|$)|$)",
    "url_bare_host": r"[A-Za-zА-Яа-я0-9\-]+\.(?:" + ENDINGS + r")"
    r"(?:/[^\s<>\"',;]*?(?=[.!?](?:\s|$)|[\s<>\"',;]|$))?",
    "date_numeric": whole(r"\d{1,2}\.\d{1,2}\.\d{2,4}"),
    "date_month_name": whole(
        r"\d{1,2}\s+(?:" + MONTH + r")\s+\d{4}(?:\s*г\.?)?"
    ),
    "ogrn": whole(r"\d{15}") + "|" + whole(r"\d{13}"),
    "inn": whole(r"\d{12}") + "|" + whole(r"\d{10}"),
    "passport_ru": whole(r"\d{4}\s\d{6}"),
    "snils": whole(r"\d{3}-\d{3}-\d{3}[\s\-]\d{2}"),
    "secret_prefixed_key": r"\b(?:sk|pk|rk)-[A-Za-z0-9_\-]{16,}\b",
    "secret_aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret_github_token": r"\b(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,}\b",
}
for kind in ("ogrn", "inn"):
    SHAPES[f"{kind}_strict"] = f"{CONTEXT}(?P<{kind}>{SHAPES[kind]})"


def rule_list(strict):
    six = ["ogrn_strict", "inn_strict"] if strict else ["ogrn", "inn"]
    return [
        ("account_number", ["iban", "card_grouped", "card_plain"], 0),
        ("private_phone", ["phone_ru"], 0),
        ("private_email", ["email"], 0),
        ("private_url", ["url_scheme", "url_bare_host"], 0),
        ("private_date", ["date_numeric", "date_month_name"], re.IGNORECASE),
        ("account_number", six + ["passport_ru", "snils"], 0),
        (
            "secret",
            ["secret_prefixed_key", "secret_aws_key", "secret_github_token"],
            0,
        ),
    ]


def find(names, text, flags=0):
    for m in re.finditer("|".join(SHAPES[n] for n in names), text, flags):
        yield m.span(m.lastgroup or 0)  # the digits only, where a keyword stands before them


def part(name, text):
    flags = re.IGNORECASE if name.startswith("date") else 0
    return list(find([name], text, flags))


def spans(text, strict=False, existing=()):
    """A map of occupied places decides which matches are let in."""
    occupied = bytearray(len(text))
    points = set()  # empty spans occupy no place, but a match may not hold one inside
    places = [[] for _ in range(len(text) + 1)]

    def enter(entity, a, b, score):
        occupied[a:b] = b"x" * (b - a)
        points.update({a} if a == b else ())
        places[a].append((entity, a, b, score))

    for e in existing:
        enter(*e[:4])
    for entity, names, flags in rule_list(strict):
        for a, b in find(names, text, flags):
            if not any(occupied[a:b]) and not any(a < p < b for p in points):
                enter(entity, a, b, 0.95)
    return [s for at in places for s in at]
