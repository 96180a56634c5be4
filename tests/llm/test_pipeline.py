"""The pipeline's stages against their operators and plain restatements."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from inkbar.llm import language, mixing, ngram_join, templates  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        after = spark.createDataFrame(after.collect(), before.schema)
        assert after.columns == columns
        own = {r.doc_id: r for r in before.collect()}
        assert all(own[r.doc_id] == r for r in after.collect())
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "language_id":
            told = language.predict(before, language.train(before), "doc_id").collect()
            assert ids == {r.doc_id for r in told if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
        elif name == "near_duplicates":
            assert ids == {r.class_id for r in ngram_join.ngram_join(before).collect()}
        elif name == "decontamination":
            found = templates.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert ids == {r.doc_id for r in found if not r.contaminated} and len(ids) < len(own)
        elif name == "mixing":
            assert ids == {r.doc_id for r in mixing.mix_sources(before, exact=False).collect() if r.taken}
        before = after
    placed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert placed.columns == [*columns, "shard"] and placed.count() == before.count()


def test_run_on_rows_that_hold_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0)], docs.schema)
    docs.limit(40).unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == [*docs.columns, "shard"] and 0 < done.count()
    assert done.filter("text is null or text = ''").count() == 0
