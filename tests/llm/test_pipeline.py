"""The pipeline's stages on the small tables."""

import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diffloom.llm import kneser, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        result = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert set(result.columns) == set(docs.columns)
            assert {r[0] for r in result.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        kept.append(result.count())
        docs = result
    assert kept[0] >= kept[1] >= kept[2] > 0
    slots = sorted(r.slot for r in docs.select("slot").collect())
    assert slots == list(range(len(slots)))


def test_one_row_of_each_group_of_near_copies_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.where("size(split(text, ' ')) > 200").orderBy("doc_id").limit(3)
    planted = docs.unionByName(long.withColumn("doc_id", F.col("doc_id") + 100000).withColumn("text", F.concat("text", F.lit(" one more end"))))
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text.lower()) for r in planted.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in texts.items()}
    least = {i: i for i in sets}
    for _ in sets:
        before = dict(least)
        for i, j in itertools.combinations(sets, 2):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, planted, SF).collect()}
    assert kept == set(least.values()) and len(kept) <= len(sets) - 3


def test_rejected_rows_go_and_no_others(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    accepted = {r.doc_id for r in kneser.quality_scores(docs, labels).where("accepted").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == accepted


def test_a_model_too_large_for_tasks_decides_alike(spark, monkeypatch):
    docs, train = spark.read.parquet(f"{SF}/documents.parquet"), kneser.train
    small = sorted(corpus_pipeline.quality(spark, docs, SF).collect())
    monkeypatch.setattr(kneser, "train", lambda texts: train(texts, 0))
    assert sorted(corpus_pipeline.quality(spark, docs, SF).collect()) == small


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_of_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, docs, SF).count() == 0


def test_contaminated_rows_without_a_doc_id_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    rows = [(None, item, "en", "s", 1), (None, "clean text", "en", "s", 1), (1, item, "en", "s", 1), (2, "other text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.text for r in corpus_pipeline.decontamination(spark, docs, SF).collect()) == ["clean text", "other text"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    from oracle_check import differences, open_tables

    assert differences(queries.QUERIES[name](spark, SF), open_tables(SF).execute(queries.ORACLE_SQL[name]) and
                       open_tables(SF).sql(queries.ORACLE_SQL[name])) == []


def test_oracle_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and duckdb.__version__
