"""The registered queries on the small tables, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from careerspark.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    out = QUERIES[name](spark, FOLDER)
    columns = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert Counter(map(str, (tuple(r) for r in out.select(columns).collect()))) == Counter(map(str, want))


def test_model_beats_its_base_on_held_out_texts(spark):
    sums = QUERIES["op1_deleted_interpolation"](spark, FOLDER).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_languages_of_held_out_texts(spark):
    found = QUERIES["op5_rank_profiles"](spark, FOLDER).filter("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    known = corpus_pipeline.language(spark, docs, FOLDER)
    assert known.columns == docs.columns and known.count() == docs.count()
    good = corpus_pipeline.quality(spark, known, FOLDER)
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    marks = labels.collect()
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in marks)
    assert right >= 0.97 * len(marks)
    single = corpus_pipeline.deduplicated(spark, good, FOLDER)
    assert single.columns == docs.columns
    groups = QUERIES["op7_ngram_jaccard"](spark, FOLDER).filter(F.col("doc_id") == F.col("component_id")).count()
    assert 0 < single.count() <= min(good.count(), groups)
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == single.count()


def test_deduplicated_handles_odd_rows(spark):
    text = "some words that are long enough to make a few shingles of five"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 1), (None, text, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.deduplicated(spark, docs, FOLDER).collect()) == [0, 1, 3, 4]


def test_deduplicated_keeps_one_row_of_each_group_for_repeated_and_missing_ids(spark):
    one, two, three = ([f"{name}{k}" for k in range(40)] for name in ("river", "stone", "light"))
    near = " ".join([*one[:39], "changed"])
    rows = [(1, " ".join(one)), (5, " ".join(one)), (5, " ".join(two)), (7, " ".join(three)), (7, " ".join([*three[:39], "changed"])),
            *[(None, near)] * 30, (None, " ".join(f"walk{k}" for k in range(40))), (9, ""), (9, ""), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = Counter((r.doc_id, (r.text or "")[:4]) for r in corpus_pipeline.deduplicated(spark, docs, FOLDER).collect())
    assert got == Counter({(1, "rive"): 1, (5, "ston"): 1, (7, "ligh"): 1, (None, "rive"): 1, (None, "walk"): 1, (9, ""): 2, (None, ""): 1})
