"""Texts built from table columns by SQL that Spark and DuckDB read alike.

The test tables hold few of the shapes the rules look for, so these expressions
write them around keys and dates.  Each also writes near misses.
"""

# name -> (table, id column, text expression)
TEMPLATES: dict[str, tuple[str, str, str]] = {
    "iban": (
        "orders",
        "o_orderkey",
        """concat('Wire to ', case o_orderkey % 4
             when 0 then concat('GB29 NWBK 6016 ', lpad(cast(o_orderkey as string), 8, '0'), ' 0000')
             when 1 then concat('DE89', lpad(cast(o_orderkey as string), 16, '3'))
             when 2 then concat('DE89 3704 ', lpad(cast(o_orderkey as string), 8, '1'), ' 0532 0130 00')
             else concat('xDE89', lpad(cast(o_orderkey as string), 16, '3')) end,
             ' by noon')""",
    ),
    "card_grouped": (
        "orders",
        "o_orderkey",
        """concat('card 4111', case when o_orderkey % 3 = 0 then '-' else ' ' end,
             lpad(cast(o_orderkey % 10000 as string), 4, '0'),
             case when o_orderkey % 5 = 0 then '/' else ' ' end,
             '1111', ' ', lpad(cast(o_orderkey % 9973 as string), 4, '0'),
             case when o_orderkey % 7 = 0 then '9' else '.' end, ' end')""",
    ),
    "card_plain": (
        "orders",
        "o_orderkey",
        """concat('no ', lpad(cast(o_orderkey as string), 14 + cast(o_orderkey % 4 as int), '4'),
             ', ', lpad(cast(o_orderkey as string), 16, '5'),
             case when o_orderkey % 3 = 0 then 'x' else '' end)""",
    ),
    "phone_ru": (
        "customer",
        "c_custkey",
        """concat('тел.', case when c_custkey % 5 = 4 then '' else ' ' end,
             case c_custkey % 3 when 0 then '+7' when 1 then '8' else '7' end,
             case c_custkey % 4 when 0 then '' when 1 then ' ' when 2 then '-' else ' (' end,
             '495', case when c_custkey % 4 = 3 then ') ' else ' ' end,
             lpad(cast(c_custkey % 1000 as string), 3, '0'), '-',
             lpad(cast(c_custkey % 97 as string), 2, '0'), '-',
             lpad(cast(c_custkey % 89 as string), 2, '0'),
             case when c_custkey % 6 = 0 then '77' else ' доб' end)""",
    ),
    "email": (
        "customer",
        "c_custkey",
        """concat('Write to user.', cast(c_custkey as string), '@mail',
             cast(c_custkey % 7 as string),
             case c_custkey % 3 when 0 then '.example.com' when 1 then '.ru.' else '.x' end,
             ' or имя', cast(c_custkey as string), '@почта.рф, thanks')""",
    ),
    "url_scheme": (
        "customer",
        "c_custkey",
        """concat('See https://host', cast(c_custkey as string), '.example/p?a=',
             cast(c_custkey % 11 as string),
             case c_custkey % 4 when 0 then '.' when 1 then ',' when 2 then ')' else '' end,
             ' or www.site', cast(c_custkey as string), '.info',
             case when c_custkey % 2 = 0 then '!' else '; done' end)""",
    ),
    "url_bare_host": (
        "customer",
        "c_custkey",
        """concat('On word', cast(c_custkey as string),
             case c_custkey % 5 when 0 then '.community' when 1 then '.xyz/p/1'
               when 2 then '.рф' when 3 then '.dev.' else '.zzz' end,
             ' and demo-', cast(c_custkey as string), '.app, ok')""",
    ),
    "date_numeric": (
        "orders",
        "o_orderkey",
        """concat('от ', cast(day(o_orderdate) as string), '.',
             lpad(cast(month(o_orderdate) as string), 2, '0'), '.',
             case when o_orderkey % 3 = 0 then cast(year(o_orderdate) as string)
                  else cast(year(o_orderdate) % 100 + 100 as string) end,
             case when o_orderkey % 4 = 0 then 'г' else ' г' end,
             ', ip 10.20.', cast(o_orderkey % 256 as string), '.7')""",
    ),
    "date_month_name": (
        "orders",
        "o_orderkey",
        """concat('Выдан ', cast(day(o_orderdate) as string), ' ',
             case month(o_orderdate) when 1 then 'января' when 2 then 'ФЕВРАЛЯ' when 3 then 'мар.'
               when 4 then 'апреля' when 5 then 'Мая' when 6 then 'июнь' when 7 then 'июля'
               when 8 then 'авг.' when 9 then 'сентября' when 10 then 'окт.' when 11 then 'ноября'
               else 'ДЕК.' end,
             ' ', cast(year(o_orderdate) as string),
             case o_orderkey % 4 when 0 then ' г.' when 1 then 'г' when 2 then '' else 'год' end,
             ' в городе')""",
    ),
    "ogrn": (
        "customer",
        "c_custkey",
        """concat('ОГРН ', lpad(cast(c_custkey as string), 13 + cast(c_custkey % 3 as int), '1'),
             ', другой ', lpad(cast(c_custkey as string), 13, '5'),
             case when c_custkey % 4 = 0 then 'a' else ';' end)""",
    ),
    "inn": (
        "customer",
        "c_custkey",
        """concat('ИНН: ', lpad(cast(c_custkey as string), 10 + cast(c_custkey % 3 as int), '7'),
             ', лот ', lpad(cast(c_custkey as string), 12, '3'),
             case when c_custkey % 4 = 0 then '_' else '.' end)""",
    ),
    "passport_ru": (
        "orders",
        "o_orderkey",
        """concat('паспорт 4510 ', lpad(cast(o_orderkey as string), 6, '0'),
             case when o_orderkey % 3 = 0 then '5' else ' выдан' end)""",
    ),
    "snils": (
        "orders",
        "o_orderkey",
        """concat('СНИЛС 112-', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '-233',
             case o_orderkey % 3 when 0 then ' ' when 1 then '-' else '/' end,
             lpad(cast(o_orderkey % 100 as string), 2, '0'), ' ок')""",
    ),
    "inn_strict": (
        "customer",
        "c_custkey",
        """concat(case c_custkey % 5 when 0 then 'ИНН ' when 1 then 'инн: № ' when 2 then 'Инн '
               when 3 then 'card  number #' else 'ИНН-' end,
             lpad(cast(c_custkey as string), 10 + cast(c_custkey % 3 as int), '7'), ' лот ',
             lpad(cast(c_custkey as string), 12, '3'))""",
    ),
    "ogrn_strict": (
        "customer",
        "c_custkey",
        """concat(case c_custkey % 5 when 0 then 'ОГРНИП ' when 1 then 'огрн:' when 2 then 'Огрн '
               when 3 then 'номер карты ' else 'passport' end,
             lpad(cast(c_custkey as string), 13 + cast(c_custkey % 3 as int), '1'), ' лот ',
             lpad(cast(c_custkey as string), 15, '3'))""",
    ),
    "secret_prefixed_key": (
        "orders",
        "o_orderkey",
        """concat('key=', case o_orderkey % 4 when 0 then 'sk-' when 1 then 'pk-live_' when 2 then 'rk-'
               else 'xsk-' end,
             lpad(cast(o_orderkey as string), 12 + cast(o_orderkey % 7 as int), 'a'),
             case when o_orderkey % 3 = 0 then '-' else '' end, ' end')""",
    ),
    "secret_aws_key": (
        "orders",
        "o_orderkey",
        """concat('id AKIA', lpad(cast(o_orderkey as string), 15 + cast(o_orderkey % 3 as int), 'Q'),
             case when o_orderkey % 5 = 0 then 'z' else ' ' end, 'end')""",
    ),
    "secret_github_token": (
        "orders",
        "o_orderkey",
        """concat('tok ', case o_orderkey % 4 when 0 then 'ghp_' when 1 then 'gho_' when 2 then 'github_pat_'
               else 'ghx_' end,
             lpad(cast(o_orderkey as string), 18 + cast(o_orderkey % 5 as int), 'b'),
             case when o_orderkey % 3 = 0 then '-' else ' ' end, 'end')""",
    ),
    # Every category in one text, with overlaps between rules.
    "form": (
        "customer",
        "c_custkey",
        """concat('Анкета ', cast(c_custkey as string), ', ИНН ',
             lpad(cast(c_custkey as string), 10, '7'), ', лот ',
             lpad(cast(c_custkey as string), 13, '4'), '; карта 4111 1111 1111 ',
             lpad(cast(c_custkey as string), 4, '0'), ', тел. +7 (495) ',
             lpad(cast(c_custkey % 1000 as string), 3, '0'), '-11-22, почта u',
             cast(c_custkey as string), '@mail.ru, сайт сайт', cast(c_custkey as string),
             '.рф/лк, см. https://a', cast(c_custkey as string), '.example/x, от 3 мая 2019 г. и ',
             '01.02.', cast(1990 + c_custkey % 30 as string), ', ключ AKIA',
             lpad(cast(c_custkey as string), 16, '0'), ' конец <', c_mktsegment, '>')""",
    ),
}


def template_sql(name: str) -> str:
    """``doc_id, text`` of a template."""
    table, key, text = TEMPLATES[name]
    return f"SELECT {key} AS doc_id, {text} AS text FROM {table}"
