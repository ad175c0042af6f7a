"""Ordinal regression: gradient, held-out accuracy, edges."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from provenspark.llm import toxicity as T
from provenspark.llm.shared import held_out

MID = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    model = T.train(docs, labels)
    assert np.all(np.diff(model.theta) > 0)
    rows = T.scored(docs, model).join(labels.where(held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    bad, good = rows[rows.y == 1], rows[rows.y == 0]
    assert bad.toxic.mean() >= 0.75 and good.toxic.mean() <= 0.02
    assert bad.severity.mean() > good.severity.mean() + 0.5
    assert rows.severity.between(0, T.GRADES).all()


def test_learned_words_raise_severity(make, spark):
    rows = [(i, ("vile rotten " if i % 3 == 0 else "") + " ".join(f"w{(i * 7 + k) % 50}" for k in range(30))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "t") for i, _ in rows], "doc_id long, toxic int, text string")
    model = T.train(make(rows), labels)
    got = {r.doc_id: r for r in T.scored(make([(1, "w1 w2 VILE, rotten w3"), (2, "w1 w2 w3"), (3, "vile " * 20)]), model).collect()}
    assert got[1].severity > got[2].severity and got[1].toxic == 1 and got[2].toxic == 0


def test_edges(make, spark):
    df = make([(1, None), (2, ""), (3, "a " * 300_000), (None, "x"), (3, "y")])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0), spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")):
        model = T.train(df, labels)
        assert T.scored(df, model).count() == 5
    assert T.scored(df.limit(0), model).count() == 0


def test_margins_match_plain_sums():
    column = pa.array(["bad bad ok", "", None, "fine"])
    keys = np.concatenate([h for h, _, _ in T.features(column)])
    keys = np.unique(keys)
    model = T.Model(keys, np.linspace(-1, 1, len(keys)), np.array([0.0, 1.0, 2.0]))
    kept = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    want = [sum(kept.get(int(h), 0) * T.values(np.float64(c), np.float64(n)) for h, c in zip(hs, cs, strict=True)) for hs, cs, n in T.features(column)]
    assert np.allclose(model.margins(column), want)
