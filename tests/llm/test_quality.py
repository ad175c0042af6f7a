"""Rule ensemble: compiled column, held-out accuracy, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenspark.llm import quality as Q

MID = "/root/testdata/sf0.01"


def plain(model, row):
    bias, rules = model
    z = bias + sum(w for w, rule in rules if all(row[n] <= b if side == "<=" else row[n] > b for n, side, b in rule))
    return 1 / (1 + np.exp(-z))


def test_held_out_accuracy_and_compiled_rules(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    model = Q.train(docs, labels)
    assert 0 < len(model[1]) < 150
    rows = Q.scored(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    stats = docs.limit(50).select("doc_id", *[c.alias(k) for k, c in Q.statistics(F.col("text")).items()]).collect()
    scores = {r.doc_id: r.score for r in Q.scored(docs, model).collect()}
    assert all(scores[s["doc_id"]] == pytest.approx(plain(model, s.asDict()), rel=1e-9) for s in stats)
    assert Q.train(docs, labels) == model


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    from provenspark.llm.shared import held_out

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id"), 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.train(docs, labels) == Q.train(docs, flipped)


def test_edges(spark, make):
    df = make([(1, None), (2, ""), (3, "word " * 60_000), (None, "x"), (3, "y")])
    labels = spark.createDataFrame([(1, 1, "a"), (2, None, "b"), (None, 0, "c"), (3, 0, "d")], "doc_id long, quality int, text string")
    model = Q.train(df, labels)
    rows = Q.scored(df, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert Q.scored(df.limit(0), model).count() == 0
    empty = Q.train(df.limit(0), labels)
    assert empty == (0.0, []) and Q.scored(df, empty).first()["score"] == 0.5
    assert Q.keep(df, model).columns == df.columns


def test_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    assert Q.sampled(labels, "doc_id", "quality", 100, 5, 0).count() == 100
    assert Q.train(docs, labels, most=100)[0] != 0
