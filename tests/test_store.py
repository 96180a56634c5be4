"""Results kept across runs: only new texts are scored, and runs add up."""

from pyspark.sql import functions as F

from inkbar.operators import dedup, store
from inkbar.operators.detect import detect_pii

SCHEMA = "req_id long, text string, min_score double, ru_postpass boolean, ru_postpass_strict boolean"


def requests(spark, ids, repeat=7):
    rows = [(i, f"mail user{i % repeat}@example.org now" if i % 3 else f"plain {i % repeat}", 0.5, True, False) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return sorted((r.req_id, tuple((s.entity, s.start, s.end) for s in r.spans), r.cached) for r in df.collect())


def counting(scored):
    def detect(df):
        scored.append([r.text for r in df.select("text").collect()])
        return detect_pii(df)

    return detect


def test_a_later_run_scores_only_new_texts(spark, tmp_path):
    first, second = requests(spark, range(40)), requests(spark, range(40, 100), 11).unionByName(
        spark.createDataFrame([(200, None, 0.5, True, False), (201, None, 0.5, True, False), (202, "", 0.25, True, False)], SCHEMA)
    )
    scored = []
    held = store.ResultStore(spark, str(tmp_path / "kept"), buckets=5)
    one = told(store.detect_across_runs(first, counting(scored), held))
    # as in a later session, which knows the folder alone
    spark.sql(f"DROP TABLE {held.name}")
    again = store.ResultStore(spark, str(tmp_path / "kept"), buckets=64)
    assert again.buckets == 5
    two = told(store.detect_across_runs(second, counting(scored), again))
    both = first.unionByName(second)
    assert sorted(one + two) == told(dedup.detect_distinct_once(both, detect_pii))
    texts = {r.text for r in first.collect()}
    assert set(scored[0]) == texts and len(scored[0]) == len(texts)
    assert scored[1] and not texts & {t for t in scored[1] if t}
    assert len(scored[1]) == len({r.text for r in second.collect()} - texts)
    three = told(store.detect_across_runs(both, counting(scored), again))
    assert scored[2] == [] and all(cached for *_, cached in three)
    assert [x[:2] for x in three] == [x[:2] for x in sorted(one + two)]
    assert again.results().count() == again.results().select("fp").distinct().count() == len(scored[0] + scored[1])


def test_the_store_is_not_shuffled(spark, tmp_path):
    held = store.ResultStore(spark, str(tmp_path / "kept"), buckets=4)
    store.detect_across_runs(requests(spark, range(60), 50), detect_pii, held)
    asked = held.ask(dedup.first_requests(dedup.fingerprints(requests(spark, range(90), 80))))
    assert {r.maybe for r in asked.collect()} == {True, False}
    found = held.find(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("SortMergeJoin") :]
    right = scan[scan.index(held.name) - 400 : scan.index(held.name) + 400]
    assert "Bucketed: true" in scan and "Exchange" not in right
    assert found.count() == held.results().count()


def test_filters_tell_what_is_missing(spark, tmp_path):
    held = store.ResultStore(spark, str(tmp_path / "kept"), buckets=3)
    made = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("fp"), F.col("id").alias("first_id"), F.lit(1).cast("long").alias("n"))
    held.append(made.filter("first_id < 1000").withColumn("spans", F.expr(f"cast(array() as {store.S.SPANS_DDL})")))
    asked = held.ask(made).collect()
    assert all(r.maybe for r in asked if r.first_id < 1000)
    assert sum(r.maybe for r in asked if r.first_id >= 1000) < 30
    none = held.ask(made.limit(0))
    assert none.collect() == [] and held.find(none).collect() == []
