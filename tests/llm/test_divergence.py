"""The divergence audit against a plain restatement."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkbar.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, key long, rest string"
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _TERM.findall((text or "").translate(_LOWER))


def plain_audit(rows, top=200):
    docs, used = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        docs[lang].update(set(words(text)))
        used[lang, source].update(words(text))
    out = []
    for lang, source in used:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = Counter()
        for (other_lang, _), n in used.items():
            if other_lang == lang:
                whole.update(n)

        def share(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        def off(p, q):
            return (p - q) ** 2 // q

        own, every = share(used[lang, source]), share(whole)
        pairs = []
        for other_lang, other in used:
            if other_lang == lang and other != source:
                q = share(used[lang, other])
                pairs.append((other, sum(off(own[t], q[t]) for t in kept)))
        terms = [(t, off(own[t], every[t])) for t in kept if used[lang, source][t] and own[t] > every[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def odd_rows():
    rng = np.random.default_rng(5)
    # words of all lengths round the levels, in two to four documents of a language
    made = ["ab" * n + c for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 33) for c in ("", "x", "yé", "Ü")]
    rows = []
    for i in range(120):
        text = "-".join(made[j] for j in rng.integers(0, len(made), size=int(rng.integers(0, 9))))
        rows.append((text, ["en", "de", None, "EN"][i % 4], ["s1", "s2", None, "S", "é", "z"][int(rng.integers(0, 6)) % (1 + i % 6)]))
    long = "q" * 3000
    rows += [(f"{long} {'w' * 90}{i}{'w' * 90}b", "fr", f"h{i % 2}") for i in range(4)]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("only twice", "xx", "a"), ("ONLY once 123", "xx", None), ("12 34", "yy", "alone")]
    rows += [("Same same SAME", "zz", "hot")] * 5 + [("Ünder Ï straße", "zz", "cold")] * 3
    return rows


def test_audit_equals_brute_force_on_odd_rows(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(i, t, g, s, "own", 7, "own") for i, (t, g, s) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in divergence.audit(table).collect())
    assert got == plain_audit(rows)
    few = divergence.audit(table, top=2)
    assert sorted(tuple(r) for r in few.collect()) == plain_audit(rows, 2)
    assert divergence.audit(table.limit(0)).collect() == []
    none = table.filter("lang = 'yy'")
    assert divergence.audit(none).collect() == []


@pytest.mark.parametrize("first", [1, 4, 64])
def test_levels_keep_exactly_the_frequent_terms(spark, first):
    rows = odd_rows()
    table = spark.createDataFrame([(i, t, g, s, "own", 7, "own") for i, (t, g, s) in enumerate(rows)], SCHEMA)
    found = divergence.iceberg_terms(table, first=first).groupBy("lang", "term").sum("docs", "n").collect()
    got = {(r.lang, bytes(r.term).decode()): (r[2], r[3]) for r in found if r[2] >= 3}
    docs, n = Counter(), Counter()
    for text, lang, _ in rows:
        n.update((lang or "", w) for w in words(text))
        docs.update((lang or "", w) for w in set(words(text)))
    assert got == {k: (v, n[k]) for k, v in docs.items() if v >= 3}


def test_prefixes_below_the_threshold_are_not_read_on(spark):
    rows = [(i, f"common{'x' * 40} rare{i}{'y' * 40} {chr(97 + i)}unique{'z' * 40}", "en", "a", "", 0, "") for i in range(6)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = divergence.iceberg_terms(table).collect()
    assert {bytes(r.term) for r in found if len(r.term) > 8} == {b"common" + b"x" * 40, b"y" * 40}


def test_stretch_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abcab abcab", dtype=np.uint8)
    hashed = divergence._Hashed(data)
    at = np.array([0, 3, 6, 9, 0]), np.array([2, 5, 8, 11, 3])
    h = hashed.of(*at).tolist()
    assert len(set(h[:4])) == 1 and h[4] != h[0]
    column, some = divergence._spliced(data, np.array([0, 6, 9]), np.array([2, 8, 11]), np.array([1, 3, 3]), 5)
    assert column.to_pylist() == ["ab ", "ab ab "] and some.tolist() == [1, 3]
    assert pa.types.is_string(column.type)
