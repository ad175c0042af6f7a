"""The read-only checks of a store: one row each with a status, what was found and what to do about it."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenspark.functions import fixed
from provenspark.operators import ledger
from provenspark.sources.sidecar import Calibration
from provenspark.sources.store import BY_PARTITION, Store, conclusions, impacts, nodes, observations

REPORT = "check string, title string, status string, detail string, remedy string"


class Checker:
    """Runs checks one by one; one that fails to run is itself a failure."""

    def __init__(self, store: Store, model: str | None = None, semantic: bool = True, calibration: Calibration | None = None, keyfile: str | None = None) -> None:
        self.store, self.model, self.semantic, self.calibration, self.keyfile = store, model, semantic, calibration, keyfile
        self.rows: list[tuple] = []

    def add(self, check: str, title: str, status: str, detail: str, remedy: str = "") -> None:
        self.rows.append((check, title, status, detail, "" if status == "pass" else remedy))

    def none(self, check: str, title: str, found: int, what: str, remedy: str, severe: bool = True) -> None:
        """Passes if nothing was found."""
        self.add(check, title, "pass" if not found else "fail" if severe else "warn", f"{found} {what}", remedy)

    def count(self, df: DataFrame) -> int:
        return df.count()

    def store_checks(self) -> None:
        self.add("store.path", "Where the store is", "pass", self.store.root)
        if self.store.readonly:
            self.add("store.readonly", "Opened for reading", "pass", "nothing will be recorded")
            self.add("store.liveness", "A snapshot", "warn", "commits after opening are seen on the next read only", "open it for writing to keep it current")

    def substrate(self) -> None:
        found = {r["check"]: r["n"] for r in ledger.audit(self.store).groupBy("check").agg(F.count("*").alias("n")).collect()}  # one row a rule
        self.found = found
        self.none("substrate.provenance_intact", "Every derivation has a real parent", found.get("orphan_edge", 0), "edges point nowhere", "write the missing parents, or supersede the children")
        self.none("substrate.indexed", "Every node is findable by its words", found.get("unindexed", 0), "nodes without postings", "write postings of their texts")
        again = self.store.read("observation").groupBy("id").agg(F.countDistinct("content_hash").alias("n")).where("n > 1")
        self.none("substrate.append_only", "Evidence was never rewritten", self.count(again), "observations with two contents", "the store was altered from outside; import it again from its source")

    def monotonic(self) -> None:
        self.none("epistemics.monotonic", "No conclusion outranks its evidence", self.found.get("monotonic", 0), "conclusions surer than their parents", "supersede them; conclusions are not edited")

    def embedder(self) -> None:
        if self.model is None:
            self.add("embedder.present", "Search by meaning", "warn", "no encoder; recall is by words only", "give an encoder's name and vectors")
            return
        self.add("embedder.present", "Search by meaning", "pass", self.model)
        self.add("embedder.semantic", "The encoder knows meaning", "pass" if self.semantic else "fail", "a model" if self.semantic else "hashed tokens, which match no paraphrase", "attach a real model")
        c = self.calibration
        self.add("embedder.calibrated", "Thresholds measured for this encoder", "pass" if c else "warn", f"floor {c.noise_floor}, ceiling {c.ceiling}" if c else "defaults of another model", "measure related and unrelated pairs")
        if c:
            self.add("embedder.ceiling_measured", "Scores scaled to the encoder's range", "pass" if c.ceiling < 1 else "warn", f"ceiling {c.ceiling}", "measure related pairs")
            if c.separability:
                self.add("embedder.separability", "Matches stand out from noise", "pass" if c.separability >= 0.95 else "warn", f"area under the curve {c.separability:.4f}", "try another model")

    def vectors(self) -> None:
        if self.model is None:
            return
        other = self.store.read("vector").where((F.col("space") == "read") & (F.col("model") != self.model))
        self.none("vectors.single_model", "All vectors come from this encoder", self.count(other), "vectors of other encoders, which search leaves out", "embed those nodes again")
        n = nodes(self.store).count()
        have = self.store.read("vector").select("node_id", "space").distinct().count()
        queued = self.store.read("embed_queue").select("node_id").distinct().count()
        self.none("vectors.coverage", "Every node is findable by meaning", max(0, 2 * n - have - 2 * queued), "vectors missing and not queued", "embed what has no vector")

    def queue(self) -> None:
        left = self.store.read("embed_queue").groupBy("node_id").agg(F.max("attempts").alias("attempts")).join(self.store.read("vector").select("node_id").distinct(), "node_id", "left_anti")
        waiting = left.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("attempts") >= 3).cast("long")), F.lit(0)).alias("dead")).first()
        self.none("queue.pending", "Nothing waits to be embedded", waiting["n"], "texts wait", "drain the queue", severe=False)
        self.none("queue.abandoned", "Nothing was given up", waiting["dead"], "texts failed three times", "look at last_error and queue them anew")

    def defence(self) -> None:
        held = observations(self.store).where("trust != 'trusted'")
        self.none("defence.quarantine_reviewed", "No untrusted text waits for review", self.count(held), "untrusted observations", "review them; they are held, not deleted", severe=False)
        rules = ("monotonic", "untestable_hypothesis", "kind_tag_mismatch", "untraceable_fact", "orphan_edge", "flow_violation")
        bad = {k: v for k, v in sorted(self.found.items()) if k in rules}
        self.add("defence.self_audit", "The rules hold", "fail" if bad else "pass", "; ".join(f"{k}: {v}" for k, v in bad.items()) or "clean", "see ledger.audit for the rows")

    def crypto(self) -> None:
        if self.keyfile:
            bad = key_permissions(self.keyfile)
            self.add("crypto.key_permissions", "Only its owner reads the key", "fail" if bad else "pass", "; ".join(bad) or "0600", f"chmod 600 {self.keyfile}")

    def decisions(self) -> None:
        self.none("decisions.impacts_acknowledged", "No decision rests on moved evidence unseen", self.count(impacts(self.store).where("acknowledged_at is null")), "impacts not looked at", "look at them and acknowledge", severe=False)

    def shards(self) -> None:
        parts = self.store.read("partition").select("name").distinct().count()
        layout = {"lexeme", "vector", "observation", "derived"} <= BY_PARTITION
        self.add("shards.layout", "Tables are split by partition", "pass" if layout else "warn", f"{parts} partitions", "")
        self.none("shards.partition_agrees", "Index rows lie in their node's partition", self.found.get("partition_disagrees", 0), "rows filed elsewhere, visible across a boundary", "import the store again from its source")


CHECKS: tuple[Callable[[Checker], None], ...] = (
    Checker.store_checks, Checker.substrate, Checker.monotonic, Checker.embedder, Checker.vectors, Checker.queue, Checker.defence, Checker.crypto, Checker.decisions, Checker.shards,
)


def run(store: Store, checks=CHECKS, **about) -> DataFrame:
    """(check, title, status, detail, remedy): all checks that apply; about: model, semantic, calibration, keyfile."""
    checker = Checker(store, **about)
    checker.found = {}
    for check in checks:
        try:
            check(checker)
        except Exception as e:  # noqa: BLE001 - whatever stops a check is its result
            checker.add(f"{check.__name__}.crashed", "The check itself failed", "fail", f"{type(e).__name__}: {str(e)[:200]}", "mend what stops it")
    return store.spark.createDataFrame(checker.rows, REPORT)  # one row a check


def key_permissions(path: str) -> list[str]:
    """What is wrong with who may read a key file."""
    if not os.path.exists(path):
        return [f"{path} does not exist"]
    mode = stat.S_IMODE(os.stat(path).st_mode)
    return [f"{path} is {mode:04o}"] if mode & 0o077 else []


def facts(store: Store) -> DataFrame:
    """(metric, value): how much a store holds, and how much of it may be told as fact."""
    made = conclusions(store)
    fact = F.col("epistemic_tag").isin(*[k for k, r in fixed.EPISTEMIC_RANK.items() if r <= 1])
    one = observations(store).agg(F.count("*").cast("double").alias("observations"), F.countDistinct("source_ref").cast("double").alias("sources"))
    two = made.agg(F.count("*").cast("double").alias("derived"), F.coalesce(F.sum(fact.cast("double")), F.lit(0.0)).alias("derived_facts"))
    both = one.join(F.broadcast(two))  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in both.columns])).alias("x")).select("x.*")
