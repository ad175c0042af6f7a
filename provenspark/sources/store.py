"""Append-only evidence tables over Parquet, and checkpoints of iterative plans.

Evidence is never updated: every table is a folder of Parquet parts that only
grows, state is derived by aggregates over event logs, and a redaction hides a
row on read.  A commit writes its parts below folders of its own and becomes
visible by one marker, so a half-finished or repeated one is never read.  The
driver is the only writer; a generation number that moves with every commit is
what caches are keyed by.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "partition": "name string, sealed boolean, created_at double",
    "partition_flow": "src string, dst string, level string",
    "observation": "id string, partition string, observed_at double, valid_from double, valid_to double, origin string, source_ref string, content string, content_hash string, context_env string, episode_id string, period_id string, affect double, claim_class string, reliability string, trust string, producer_model string, acquisition_cost double, credibility int",
    "redaction": "observation_id string, redacted_at double, reason string",
    "review_event": "node_id string, at double, grade int",
    "suppress_event": "node_id string, at double, reason string",
    "derived": "id string, partition string, created_at double, kind string, epistemic_tag string, producer string, producer_model string, acquisition_cost double, content string, confidence double, supersedes string, locked_at double, falsifier string",
    "derivation_edge": "child_id string, parent_id string, role string",
    "episode": "id string, partition string, period_id string, started_at double, ended_at double, boundary_surprise double, label string",
    "period": "id string, partition string, label string, opened_at double, closed_at double, summary_id string",
    "assoc_edge": "src string, dst string, weight double, kind string",
    "succession": "src string, dst string, count int",
    "intention": "id string, partition string, created_at double, trigger_kind string, trigger_spec string, action string, status string, origin_ref string",
    "lexeme": "term string, node_id string, tf double, partition string",
    "calibration": "id string, producer string, claim_kind string, confidence double, outcome int, recorded_at double",
    "exposure": "who string, node_id string, at double, channel string, depth double",
    "supersession": "old_node string, new_node string, claim_class string, survived double, at double",
    "absence": "id string, partition string, query string, scope string, searched_at double, reason string, expires_at double",
    "embed_queue": "node_id string, content string, partition string, queued_at double, attempts int, last_error string",
    "community": "id string, partition string, members array<string>, generation int, lineage array<string>",
    "vector": "node_id string, space string, dim int, model string, data array<float>, hubness double, partition string",
    "entity": "id string, partition string, name string, kind string, canonical string, first_seen double",
    "mention": "entity_id string, node_id string, role string",
    "relation": "src string, dst string, kind string, evidence_node string, weight double",
    "composite_member": "composite_id string, member_id string, level int",
    "decision": "id string, partition string, statement string, decided_at double, decided_by string, reversible_until double, status string, outcome string, resolved_at double",
    "decision_basis": "decision_id string, node_id string, weight double",
    "decision_impact": "id string, decision_id string, basis_node string, cause string, detected_at double, severity double, acknowledged_at double",
    "criticality": "node_id string, score double, dependents int, decisions int, computed_at double",
    "receipt": "id string, at double, partition string, query string, state string, reason string, returned array<string>, rejected array<string>, tier int",
    "source_assessment": "source_ref string, reliability string, credibility int, reason string, assessed_at double",
    "write_screen": "node_id string, at double, verdict string, signals array<string>, score double",
    "supersession_attempt": "at double, source_ref string, old_node string, allowed boolean, reason string",
    "source_origin": "source_ref string, origin_cluster string, domain string, ingest_batch string, first_seen double",
    "claimant": "id string, partition string, name string, canonical string, kind string, first_seen double",
    "claim": "id string, claimant_id string, node_id string, proposition string, prop_hash string, asserted_at double, outcome string",
    "commitment": "id string, partition string, claimant_id string, node_id string, statement string, made_at double, due_at double, status string, resolved_at double, note string",
    "failure": "id string, partition string, approach string, reason string, context string, failed_at double, node_id string, recurrence int, superseded_by string",
    "claim_outcome": "claim_id string, outcome string, at double",
    "commitment_event": "commitment_id string, status string, note string, at double",
    "decision_event": "decision_id string, status string, outcome string, at double",
    "impact_ack": "impact_id string, status string, outcome string, at double",
    "intention_event": "intention_id string, status string, at double",
    "prediction_outcome": "id string, outcome int, at double",
    "revaluation": "node_id string, confidence double, epistemic string, fate string, cause string, at double",
    "access_log": "node_id string, at double",
    "belief_divergence": "who string, held_node string, truth_node string, detected_at double, severity double, direction string, resolved_at double",
}
#: Tables split by partition on disk, so that a viewer's reads prune to what it may see.
BY_PARTITION = {k for k, v in TABLES.items() if " partition string" in " " + v.replace(", ", ",  ") and k not in ("partition",)}


class ReadOnlyError(RuntimeError):
    """The store was opened for reading."""


class PartitionError(ValueError):
    """A flow that a sealed partition forbids, or a read across a closed boundary."""


class MonotonicityError(ValueError):
    """A conclusion that would outrank its evidence."""


class Store:
    """Tables of evidence below one root folder."""

    def __init__(self, spark: SparkSession, root: str, *, readonly: bool = False) -> None:
        self.spark, self.root, self.readonly, self.generation = spark, root.rstrip("/"), readonly, 0
        if readonly and not self.exists("observation"):
            raise ValueError(f"no observation table below {root}")

    def _path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(table)
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        return bool(self.commits(table))

    def _fs(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self, table: str) -> list[str]:
        """Folders of a table's committed parts: those that a finished commit's marker names."""
        jvm, fs = self.spark._jvm, self._fs()
        markers = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        if not fs.exists(markers):
            return []
        done = sorted(s.getPath().getName() for s in fs.listStatus(markers))
        paths = [f"{self._path(table)}/commit={d}" for d in done]
        return [p for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p))]

    def read(self, table: str) -> DataFrame:
        """A table with its declared columns; empty if nothing was committed, older parts get nulls or the default partition."""
        parts = self.commits(table)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        found = self.spark.read.schema(TABLES[table]).option("basePath", self._path(table)).parquet(*parts).select(*[f.split()[0] for f in TABLES[table].split(", ")])
        return found.withColumn("partition", F.coalesce("partition", F.lit("default"))) if "partition" in found.columns else found

    def one(self, table: str, **key):
        """The first row whose columns have these values, or None: a point lookup for a person; plans join instead."""
        found = self.read(table)
        for name, value in key.items():
            found = found.where(F.col(name).eqNullSafe(F.lit(value)))
        return found.first()

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows, missing columns as nulls; moves the generation."""
        self.write({table: rows})

    def write(self, changes: dict[str, DataFrame], batch: str | None = None) -> bool:
        """Several appends as one commit; False if a batch of that name was committed before.

        All parts are written first, below folders named by the commit; a
        single marker then makes them visible.  A failure before the marker
        leaves nothing that read() sees, and a batch that is written again
        under its name adds nothing.
        """
        if self.readonly:
            raise ReadOnlyError(", ".join(changes))
        jvm, fs = self.spark._jvm, self._fs()
        commit = batch or f"{self._now():020d}-{uuid.uuid4().hex}"
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits/{commit}")
        if fs.exists(marker):
            return False
        for table, rows in changes.items():
            schema = self.spark.createDataFrame([], TABLES[table]).schema
            whole = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            writer = whole.write.mode("overwrite")
            (writer.partitionBy("partition") if table in BY_PARTITION else writer).parquet(f"{self._path(table)}/commit={commit}")
        fs.create(marker, False).close()
        self.generation += 1
        return True

    @staticmethod
    def _now() -> int:
        return time.time_ns()

    def count(self, table: str) -> int:
        return self.read(table).count()

    def sql(self, text: str, **values) -> DataFrame:
        """SQL over the tables with named parameters."""
        for table in TABLES:
            if f"{table}" in text:
                self.read(table).createOrReplaceTempView(table)
        return self.spark.sql(text, args=values)

    def close(self) -> None:
        self.spark.catalog.clearCache()


def observations(store: Store) -> DataFrame:
    """Evidence without what was redacted."""
    return store.read("observation").join(store.read("redaction").select(F.col("observation_id").alias("id")), "id", "left_anti")


def nodes(store: Store) -> DataFrame:
    """Evidence and conclusions as one view."""
    seen = observations(store).select("id", "partition", F.col("observed_at").alias("at"), "content", "source_ref", "origin", "claim_class", "reliability", "credibility", "trust", "valid_from", "valid_to", "affect", F.lit(1.0).alias("confidence"), F.lit("observed").alias("epistemic"), F.lit("observation").alias("kind"))
    made = conclusions(store).select("id", "partition", F.col("created_at").alias("at"), "content", F.col("producer").alias("source_ref"), F.lit("derived").alias("origin"), F.lit("unknown").alias("claim_class"), F.lit("F").alias("reliability"), F.lit(6).alias("credibility"), F.lit("trusted").alias("trust"), F.lit(None).cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_to"), F.lit(0.0).alias("affect"), "confidence", F.col("epistemic_tag").alias("epistemic"), "kind")
    return seen.unionByName(made)


def current(rows: DataFrame, events: DataFrame, key: str, columns: list[str], order: str = "at") -> DataFrame:
    """rows (id, ...) with columns as the latest event of each id says, else as they were."""
    latest = events.groupBy(F.col(key).alias("id")).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    met = rows.join(latest, "id", "left")
    return met.select(*[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def claims(store: Store) -> DataFrame:
    return current(store.read("claim"), store.read("claim_outcome"), "claim_id", ["outcome"])


def commitments(store: Store) -> DataFrame:
    return current(store.read("commitment"), store.read("commitment_event"), "commitment_id", ["status", "note"])


def decisions(store: Store) -> DataFrame:
    """Decisions with their latest status and outcome; an executed one can no longer be reversed."""
    found = current(store.read("decision"), store.read("decision_event"), "decision_id", ["status", "outcome"])
    return found.withColumn("reversible_until", F.when(F.col("status") != "executed", F.col("reversible_until")))


def intentions(store: Store) -> DataFrame:
    return current(store.read("intention"), store.read("intention_event"), "intention_id", ["status"])


def impacts(store: Store) -> DataFrame:
    """Impacts with the time of their first acknowledgement."""
    done = store.read("impact_ack").groupBy(F.col("impact_id").alias("id")).agg(F.min("at").alias("_done"))
    return store.read("decision_impact").join(done, "id", "left").withColumn("acknowledged_at", F.coalesce("_done", "acknowledged_at")).drop("_done")


def conclusions(store: Store) -> DataFrame:
    """Derived nodes at their latest revaluation."""
    latest = store.read("revaluation").groupBy(F.col("node_id").alias("id")).agg(F.max_by(F.struct("confidence", "epistemic"), F.struct("at", -F.col("confidence"))).alias("_new"))
    met = store.read("derived").join(latest, "id", "left")
    return met.withColumn("confidence", F.coalesce("_new.confidence", "confidence")).withColumn("epistemic_tag", F.coalesce("_new.epistemic", "epistemic_tag")).drop("_new")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own where that is unset and all tasks run in this process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("provenspark.steps.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="provenspark-steps-")
        spark.conf.set("provenspark.steps.dir", folder)
    return folder.rstrip("/")


def step(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, to cut an iteration's lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
