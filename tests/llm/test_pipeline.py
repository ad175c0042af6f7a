"""The pipeline against its parts by brute force on the smallest tables, and the registered queries."""

import re

from oracle import connect, oracle_rows, rows_of
from pyspark.sql import functions as F
from test_near_dedup import brute
from test_secret_scan import spans

import corpus_pipeline as C
from provenspark.llm import quality
from provenspark.llm.queries import oracle_sql, queries


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.train(docs, labels)
    names = docs.columns
    first = C.quality_stage(spark, docs, small)
    assert first.columns == names
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in quality.scored(docs, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in first.collect()]
    second = C.near_dedup_stage(spark, first, small)
    assert {r.doc_id for r in second.collect()} == {i for i, (_, c) in brute(rows).items() if i == c}
    third = C.decontamination_stage(spark, second, small)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in third.collect()}
    assert not any(b in t for t in left.values() for b in items)
    fourth = C.secret_stage(spark, third, small)
    assert fourth.columns == names
    for r in fourth.collect():
        t, at, out = left[r.doc_id], 0, ""
        for s, _, e, _ in spans(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == out + t[at:]
    whole = C.run(spark, small)
    assert {r.doc_id for r in whole.collect()} == set(left)


def test_registered_queries(spark, small):
    assert [k for k in queries()] and {int(re.match(r"op(\d+)_", k)[1]) for k in queries()} == set(range(1, 11))
    con = connect(small)
    for name, sql in oracle_sql().items():
        assert rows_of(queries()[name](spark, small)) == oracle_rows(con, sql), name


def test_extra_columns_stay(spark, make):
    df = make([(1, "Token = abcdefgh12 and more plain words here."), (2, "Plain words.")]).withColumn("base", F.lit(1)).withColumn("spans", F.lit("s"))
    assert C.secret_stage(spark, df, "").columns == df.columns


def folder(spark, make, path, rows):
    """A folder of tables: documents with columns that clash with inner names, labels for all of them, one benchmark item."""
    docs = make(rows).withColumn("_key", F.lit("k")).withColumn("rep", F.lit(1)).withColumn("component", F.lit(None).cast("string"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(len(t or "") > 30), 0) for i, t in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over nine lazy dogs near the old river bank")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_odd_rows_pass_through_every_stage(spark, make, tmp_path):
    """Null ids and texts, blank and very long texts, repeated rows and clashing columns: no stage fails, drops a clean row or changes columns."""
    plain = [f"Text number {w} tells at some length of {w} and of the things that {w} brought home." for w in ("amber", "birch", "cedar", "dahlia", "elder", "fern")]
    rows = [*enumerate(plain), (None, plain[0]), (None, None), (20, None), (21, ""), (22, " \t"), (23, "long words here " * 30_000), (0, plain[0]), (24, plain[1].upper())]
    path = "file://" + str(tmp_path / "odd")
    docs = folder(spark, make, path, rows)
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    near = C.near_dedup_stage(spark, docs, path).collect()
    assert sorted(str(r.doc_id) for r in near) == sorted(["0", "1", "2", "3", "4", "5", "20", "21", "22", "23", "None", "None"])
    assert C.decontamination_stage(spark, docs, path).count() == len(rows) == C.secret_stage(spark, docs, path).count()
    packed = C.packing_stage(spark, docs, path).collect()
    assert len({(r.doc_id, r.start) for r in packed if r.doc_id == 23}) > 1 and sum(r.doc_id is None for r in packed) == 2
    assert C.run(spark, path).count() >= 0


def test_empty_tables(spark, make, tmp_path):
    path = "file://" + str(tmp_path / "none")
    folder(spark, make, path, [])
    assert C.run(spark, path).count() == 0
