"""The subpackage's queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all rows."""
    from provenspark.llm.ann import index, search

    vectors = table(spark, sf_dir, "embeddings")
    return search(index(vectors), vectors.where("vec_id % 20 = 0"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exactly or with other numbers, names or units."""
    from provenspark.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from provenspark.llm.quality import scored, train

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    from provenspark.llm.warc import archived

    return archived(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every document."""
    from provenspark.llm.toxicity import scored, train

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; a page's outcome is the quality label of the document that its path names."""
    from provenspark.llm.url_filter import host_of, judge, path_of

    pages = table(spark, sf_dir, "pages")
    doc_id = F.regexp_extract(path_of(F.col("url")), "^/[a-z]+/([0-9]+)", 1).try_cast("long").alias("doc_id")
    named = pages.select(host_of(F.col("url")).alias("host"), doc_id)
    outcomes = named.join(table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").select("host", "bad")
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent log10 probabilities of every document."""
    from provenspark.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    from provenspark.llm.secret_scan import joined, secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of up to 4096 ids."""
    from provenspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class, set size and survivor flag of every document."""
    from provenspark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from provenspark.llm.oracles import oracle_sql as found

    return found()
