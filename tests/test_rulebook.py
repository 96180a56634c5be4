"""Many rules of a caller's own: the spans of the same rules one by one, at a flat cost."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkbar.functions.rules import RULES, make_rule
from inkbar.operators.detect import detect_regex_only
from inkbar.operators.rulebook import detect_with_rulebook, rules_that_may_match


def spans_of(df):
    return [[tuple(s) for s in r.spans] if r.spans is not None else None for r in df.orderBy("i").select("spans").collect()]


def plain_rules(text, kept, rules):
    kept = list(kept)
    for rule in rules:
        flags = re.IGNORECASE if rule.ignore_case else 0
        found = [m.span() for m in re.finditer("|".join(p.pattern for p in rule.parts), text or "", flags)]
        free = [(s, e) for s, e in found if not any(s < k[3] and k[2] < e for k in kept)]
        kept += [(rule.entity, text[s:e], s, e, 0.95) for s, e in free]
    return sorted(kept, key=lambda s: s[2])


def test_spans_equal_those_of_extra_rules(spark):
    rnd = random.Random(4)
    words = ["AB-77", "CD-9", "it's", "order", "ab@cd.com", "1.2.2024", "x\x01y", "AB-\x011", "\U0001f600EF-3", "no", "cd-5", "4111 1111 1111 1111"]
    texts = [rnd.choice(" ,\n").join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 6, 40, 900]))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, text string").repartition(3)
    rules = [
        make_rule("order", r"AB-\d+", literals=("AB-",)),
        make_rule("short", r"B-7", r"it's", literals=("B-7", "it's")),
        make_rule("any", r"no\s+no", cuttable=False),
        make_rule("folded", r"cd-\d", literals=("cd-", "CD-"), ignore_case=True),
        make_rule("wide", r"order \S+", literals=("order",)),
        make_rule("${x}", r"EF-\d|y", literals=("EF-", "y")),
        make_rule("never", r"zzz", literals=("zzz",)),
    ]
    kept = spans_of(detect_regex_only(df))
    wanted = [plain_rules(t, own, rules) for t, own in zip([*texts, None, ""], kept)]
    assert spans_of(detect_with_rulebook(df, rules)) == wanted
    assert spans_of(detect_with_rulebook(df, rules[:2])) == spans_of(detect_regex_only(df, extra_rules=tuple(rules[:2])))
    assert spans_of(detect_with_rulebook(df, [])) == spans_of(detect_regex_only(df))
    few = detect_with_rulebook(df, rules[:1], min_score=0.99, strict=True)
    assert spans_of(few) == spans_of(detect_regex_only(df, 0.99, True, (rules[0],)))
    with pytest.raises(ValueError):
        detect_with_rulebook(df, [r for r in RULES if r.mode])


def test_the_automaton_tells_the_rules(spark):
    rules = tuple([make_rule("a", "x1", literals=("x1",)), make_rule("b", "q"), make_rule("c", "1y", literals=("1y", "x1y"))])
    df = spark.createDataFrame([("x1",), ("ax1y",), ("",), (None,)], "text string").coalesce(1)
    got = [r.h for r in df.select(rules_that_may_match(rules)("text").alias("h")).collect()]
    assert got == [[0, 1], [0, 1, 2], [1], []]


def test_a_thousand_rules_cost_little_more_than_ten(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").repartition(4).cache()
    docs.count()

    def took(n):
        rules = [make_rule(f"rare{i}", rf"\bsecret{i}-\d+", literals=(f"secret{i}-",)) for i in range(n)]
        times = []
        for _ in range(4):
            start = time.perf_counter()
            detect_with_rulebook(docs, rules).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times[1:])

    few, many = took(10), took(1000)
    docs.unpersist()
    assert many < 3 * few, (few, many)


def test_rare_rules_find_their_texts(spark):
    df = spark.range(200).select(F.col("id").cast("int").alias("i"), F.concat(F.lit("see secret"), "id", F.lit("-12 now")).alias("text"))
    rules = [make_rule(f"rare{i}", rf"\bsecret{i}-\d+", literals=(f"secret{i}-",)) for i in range(0, 1000, 2)]
    got = spans_of(detect_with_rulebook(df, rules))
    assert all(([s[0] for s in x] == [f"rare{i}"]) if i % 2 == 0 else x == [] for i, x in enumerate(got))
