"""Queries over policies: demotion, discrediting, convergence, failures, commitments, absences, the store and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenspark.operators import diagnostics, graph, ledger, retrieval
from provenspark.plans.graphs import EDGES, edges
from provenspark.plans.registry import ORACLES, query, values
from provenspark.plans.stats import SURPRISE  # noqa: F401 - registers the queries that this module builds on
from provenspark.plans.texts import _screened, toks
from provenspark.sources import handover

DOCUMENT = "'document'"
TAG = "CASE quality WHEN 1 THEN CASE toxic WHEN 1 THEN 'inferred' ELSE 'observed' END ELSE CASE toxic WHEN 1 THEN 'hypothesized' ELSE 'reported' END END"


@query("graft_demotion", f"SELECT doc_id, CASE {TAG} WHEN 'observed' THEN 'reported' WHEN 'reported' THEN 'inferred' WHEN 'inferred' THEN 'hypothesized' END AS admitted_as FROM labels")
def _(t):
    return handover.demotions(t.labels.select("doc_id", F.expr(TAG).alias("epistemic_tag"))).select("doc_id", "admitted_as")


@query("discredit_plan", f"""WITH RECURSIVE {EDGES}, r(root, node) AS (SELECT DISTINCT parent_id, parent_id FROM edges WHERE parent_id = 'nat_3' OR parent_id = 'nat_7' UNION SELECT root, child_id FROM r JOIN edges ON parent_id = node),
d AS (SELECT 'cus_' || c_custkey AS id, ((c_custkey % 89) / 100.0)::DOUBLE AS conf, (c_custkey % 4) AS k FROM customer)
SELECT root, id, round(CASE WHEN round(conf * 0.45 + 1e-9, 4) < 0.15 THEN 0.05 ELSE round(conf * 0.45 + 1e-9, 4) END, 3)::DOUBLE AS confidence, CASE WHEN round(conf * 0.45 + 1e-9, 4) < 0.15 THEN 'hypothesized' ELSE ['observed', 'reported', 'inferred', 'hypothesized'][(least(3, k + 1) + 1)::INT] END AS epistemic,
CASE WHEN round(conf * 0.45 + 1e-9, 4) < 0.15 THEN 'quarantined' ELSE 'demoted' END AS fate FROM r JOIN d ON r.node = d.id""")
def _(t):
    radius = graph.closure(edges(t), t.rows([("nat_3",), ("nat_7",)], "n string"), 12, "parent_id", "child_id")
    made = t.customer.select(F.concat(F.lit("cus_"), "c_custkey").alias("id"), (F.col("c_custkey") % 89 / 100.0).alias("confidence"), F.get(F.array(*[F.lit(x) for x in ("observed", "reported", "inferred", "hypothesized")]), (F.col("c_custkey") % 4).cast("int")).alias("epistemic_tag"))
    return ledger.discredit_plan(radius, made, "D").withColumn("confidence", F.round("confidence", 3))


@query("converge", f"""WITH p AS (SELECT substr(sha256(array_to_string(list_sort(list_distinct({toks("text")})), ' ')), 1, 24) AS h, doc_id % 3 AS op, source FROM documents)
SELECT h AS prop_hash, count(DISTINCT op) AS operators, count(DISTINCT source) AS origins, count(DISTINCT op) > 1 AND count(DISTINCT source) > 1 AS agreed FROM p GROUP BY h""")
def _(t):
    return ledger.converge(t.documents.select((F.col("doc_id") % 3).alias("operator"), F.col("source").alias("source_ref"), F.col("text").alias("content")))


@query("prior_failures", f"""WITH p AS (SELECT item_id, list_distinct({toks("text")}) AS a FROM benchmark), f AS (SELECT doc_id, list_distinct({toks("text")}) AS b FROM documents),
pu AS (SELECT item_id, len(a) AS na, unnest(a) AS t FROM p), fu AS (SELECT doc_id, len(b) AS nb, unnest(b) AS t FROM f),
s AS (SELECT item_id, doc_id, count(*) AS i, na + nb AS n FROM pu JOIN fu USING (t) GROUP BY item_id, doc_id, na, nb) SELECT item_id AS proposal_id, doc_id AS failure_id, round(i / (n - i), 6) AS similarity FROM s WHERE i / (n - i) >= 0.25""")
def _(t):
    mine = t.benchmark.select(F.col("item_id").alias("proposal_id"), F.col("text").alias("proposal"))
    theirs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("approach"), F.lit(None).cast("string").alias("superseded_by"))
    return ledger.prior_failures(mine, theirs, 0.25).withColumn("similarity", F.round("similarity", 6))


@query("commitments_due", "SELECT l_orderkey, l_linenumber, round((epoch(TIMESTAMP '1998-12-01') - epoch(l_shipdate)) / 86400.0, 3)::DOUBLE AS overdue_days FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '1998-12-01'")
def _(t):
    rows = t.lineitem.where("l_linestatus = 'O'").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").alias("claimant_id"), F.lit("ship").alias("statement"), F.lit("open").alias("status"), F.col("l_shipdate").cast("timestamp").cast("double").alias("due_at"))
    return ledger.due(rows, 912470400.0).select("id.l_orderkey", "id.l_linenumber", F.round("overdue_days", 3).alias("overdue_days"))


ABSENCES = [("fuel depot north", 10.0, None), ("fuel depot north ridge", 20.0, 50.0), ("water clinic", 5.0, 500.0)]
ASKED = [(1, "fuel depot north"), (2, "the depot fuel"), (3, "water near clinic"), (4, "convoy"), (5, "water pump clinic valley route")]


@query("absence_override", f"SELECT query_id, absent FROM ({values([(1, 'fuel depot north'), (2, 'fuel depot north'), (3, 'water clinic')])}) AS v(query_id, absent)")
def _(t):
    a = t.rows(ABSENCES, "query string, searched_at double, expires_at double")
    return retrieval.absent(t.rows(ASKED, "query_id int, query string"), a, 100.0)


@query("sleep_plan", "SELECT lang, CASE WHEN n * (0.5 + 0.1) + 12 / 24.0 >= 4 THEN 'rem' WHEN n * (0.5 + 0.1) + 12 / 24.0 >= 1 THEN 'nrem' ELSE 'none' END AS phase FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).select("lang", ledger.sleep_plan(F.col("n"), F.lit(0.1), F.lit(12.0), F.lit(3), F.lit(2)).alias("phase"))


def _fresh(t):
    import uuid

    from provenspark.sources.store import Store, shared_dir

    return Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")


def _filled(t):
    """A store with the documents observed, by language."""
    store = _fresh(t)
    rows = t.documents.select(F.col("text").alias("content"), F.col("lang").alias("partition"), F.col("source").alias("source_ref"), (1.7e9 + F.col("doc_id") * 60.0).alias("observed_at"))
    store.write(ledger.observe(store, rows, 1.7e9))
    return store


@query("store_recall")
def _(t):
    """States of knowing for every benchmark text, asked of a store of all documents."""
    store = _filled(t)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("en").alias("viewer"))
    answers, _ = ledger.recall(store, asked, 1.7e9 + 86400)
    return answers


DOCTOR = [
    ("store.path", "pass"), ("substrate.provenance_intact", "pass"), ("substrate.indexed", "pass"), ("substrate.append_only", "pass"), ("epistemics.monotonic", "pass"), ("embedder.present", "pass"), ("embedder.semantic", "pass"),
    ("embedder.calibrated", "warn"), ("vectors.single_model", "pass"), ("vectors.coverage", "fail"), ("queue.pending", "pass"), ("queue.abandoned", "pass"), ("defence.self_audit", "pass"), ("decisions.impacts_acknowledged", "pass"),
    ("shards.layout", "pass"), ("shards.partition_agrees", "pass"),
]


@query("store_doctor", f"SELECT * FROM ({values(DOCTOR)}) AS v(\"check\", status) UNION ALL SELECT 'defence.quarantine_reviewed', CASE WHEN bool_or(verdict <> 'clean') THEN 'warn' ELSE 'pass' END FROM ({_screened('documents', 'doc_id', 'text', DOCUMENT)})")
def _(t):
    """All checks of a store of all documents that has no vector yet."""
    return diagnostics.run(_filled(t), model="model").select("check", "status")


@query("stream_segments", ORACLES["episodes"].replace("s.part AS role, s.o,", "s.part AS part, s.o AS seq,"))
def _(t):
    """Stateful segmentation of the conversations as a stream, by role; equals the batch query `episodes`."""
    import uuid

    from provenspark.sources.store import shared_dir
    from provenspark.streaming.segments import segments

    source = t.conversations
    stream = t.spark.readStream.schema(source.schema).parquet(f"{t.folder}/conversations.parquet" + ("" if _is_dir(t) else "*"))
    path = f"{shared_dir(t.spark)}/segments-{uuid.uuid4().hex}"
    found = segments(stream.select(F.col("role").alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("content")))
    run = found.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()  # until all input is read; raises where the stream fails
    return t.spark.read.schema(found.schema).parquet(f"{path}/rows").withColumn("surprise", F.round("surprise", 6))


def _is_dir(t) -> bool:
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/conversations.parquet")
    return path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
