import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from rostrum.llm import decontaminate, langid, neardup, packing, surrogates

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def outputs(spark):
    entry._on_workers(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(outputs):
    for df in outputs[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS


def test_language_stage(outputs):
    docs, kept = outputs[0], outputs[1]
    found = langid.predict(docs, langid.learn(docs)).collect()
    assert ids(kept) == {r.doc_id for r in found if r.lang_pred != "und" and r.lang_score >= 0.1}
    assert len(ids(kept)) > 0.98 * docs.count()


def test_dedup_stage_keeps_one_of_each_group(outputs):
    before, after = outputs[1], outputs[2]
    groups = neardup.near_duplicates(before).collect()
    assert ids(after) == {r.component_id for r in groups}


def test_decontamination_stage(spark, outputs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    hits = {r.doc_id for r in decontaminate.contained(outputs[2], items).collect()}
    assert ids(outputs[3]) == ids(outputs[2]) - hits and ids(outputs[3])
    assert decontaminate.contained(outputs[3], items).count() == 0


def test_pii_stage(outputs):
    before, after = outputs[3], outputs[4]
    known = {r.key for r in surrogates.mentions(before, "text").filter("kind in ('email', 'ip', 'card')").collect()}
    texts = {r.doc_id: r.text for r in after.collect()}
    assert set(texts) == ids(before) and not any(k in t for k in known for t in texts.values())
    assert after.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_packing_stage_is_an_exact_round_trip(outputs):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    got = outputs[5].toPandas().sort_values(["doc_id", "start"])
    for r in outputs[4].collect():
        flat = [x for part in got[got.doc_id == r.doc_id].ids for x in part]
        assert flat == tokenizer.encode(r.text, add_special_tokens=False).ids + [1]


def test_run_gives_the_last_stage(spark, outputs):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.agg(F.sum("length")).first() == outputs[5].agg(F.sum("length")).first()


def test_empty_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_nulls_extra_columns_and_repeated_rows(spark):
    rows = [(1, None, None, None, None), (None, "some text here", "en", None, 3), (2, "some text here too", "en", "s", 9), (2, "some text here too", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["2", "2", "None"]
