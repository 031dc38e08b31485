"""Stages of the pipeline, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from evidra.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    now = table(spark, SF, "documents")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, now, SF), "test")
        if name != "token ids":
            assert out.columns == columns
        if name not in ("mixture", "token ids"):  # filters: rows of their input, as they were
            assert out.exceptAll(now).count() == 0
        kept[name], now = out.count(), out
    assert kept["quality rules"] < 200 and kept["near duplicates"] <= kept["quality classifier"] and kept["token ids"] == kept["mixture"]
    assert now.where("not round_trip").count() == 0


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (3, base), (9, base.replace("w50 ", "x ")), (7, "something else here and now"), (None, base), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [r["doc_id"] for r in got] == [3, 7, 11, None]


def test_empty_table(spark):
    now = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, SF), "test")
    assert now.count() == 0
