"""What is recorded about people, promises, decisions, predictions and gaps: checked batches of rows to append.

Nothing is updated.  What happens to a row later is an event beside it, and
`store.claims`, `commitments`, `decisions`, `intentions`, `impacts` and
`conclusions` give the rows as the latest event says.  Functions that may
refuse rows return (tables, refused).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenspark.functions import fixed, memory, text
from provenspark.operators import graph, sequences
from provenspark.operators.ledger import discredit_plan, made_id, raise_impacts
from provenspark.sources.store import PartitionError, Store, claims, commitments, conclusions, decisions, impacts, nodes, step


def declare(store: Store, name: str, now: float, flows_to: Iterable[str] = (), reads_from: Iterable[str] = (), summary_reads_from: Iterable[str] = (), sealed: bool = False) -> dict[str, DataFrame]:
    """A partition and its flows; a sealed one lets nothing out, and nobody reads from one."""
    spark, closed = store.spark, {r["name"] for r in store.read("partition").where("sealed").collect()}  # partitions are few
    if (sealed or name in closed) and (out := sorted(flows_to)):
        raise PartitionError(f"{name!r} is sealed and cannot flow to {out}")
    if bad := sorted((set(reads_from) | set(summary_reads_from)) & closed):
        raise PartitionError(f"{bad} are sealed and cannot be read from")
    flows = [(name, d, "full") for d in flows_to] + [(s, name, "full") for s in reads_from] + [(s, name, "summary") for s in summary_reads_from]
    return {
        "partition": spark.createDataFrame([(name, sealed, now)], "name string, sealed boolean, created_at double"),
        "partition_flow": spark.createDataFrame(flows, "src string, dst string, level string"),
    }


def in_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """rows (id, partition, at) with period_id: the latest opened period of the partition that was open then; null without one."""
    p = periods.select(F.col("id").alias("period_id"), "partition", "opened_at", "closed_at")
    met = rows.select("id", "partition", "at").join(p, "partition").where("at >= opened_at and (closed_at is null or at <= closed_at)")
    inner = met.groupBy("id").agg(F.max_by("period_id", F.struct("opened_at", "period_id")).alias("period_id"))
    return rows.join(inner, "id", "left")


def suppressed(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Nodes (node_id, reason) that recall shall offer last; nothing is removed."""
    return {"suppress_event": rows.select("node_id", F.lit(now).alias("at"), "reason")}


def corrected(rows: DataFrame, known: DataFrame, now: float) -> dict[str, DataFrame]:
    """Corrections (node_id, corrected, by, reason) of known nodes as evidence that supersedes them; both stay.

    Whoever corrects has been told the new wording.
    """
    met = rows.join(known.select(F.col("id").alias("node_id"), "content", "partition", "claim_class", "at"), "node_id")
    note = text.correction_note(F.col("content"), F.col("corrected"), F.col("by"), F.col("reason"))
    new = met.select("*", note.alias("note")).withColumn("id", made_id("obs", "partition", "node_id", "note"))
    seen = new.select("id", "partition", F.lit(now).alias("observed_at"), F.lit("user_utterance").alias("origin"), F.concat(F.lit("correction:"), F.col("by")).alias("source_ref"), F.col("note").alias("content"), F.sha2("note", 256).alias("content_hash"), "claim_class", F.lit("trusted").alias("trust"), F.lit("F").alias("reliability"), F.lit(6).alias("credibility"))
    return {
        "observation": seen,
        "review_event": seen.select(F.col("id").alias("node_id"), F.lit(now).alias("at"), F.lit(4).alias("grade")),
        "supersession": new.select(F.col("node_id").alias("old_node"), F.col("id").alias("new_node"), "claim_class", (F.lit(now) - F.col("at")).alias("survived"), F.lit(now).alias("at")),
        "exposure": told(new.select(F.col("by").alias("who"), F.col("id").alias("node_id"), F.lit("correction").alias("channel")), now)["exposure"],
    }


def told(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Who was told which node (who, node_id, channel, at), with the channel's depth."""
    at = F.coalesce("at", F.lit(now)) if "at" in rows.columns else F.lit(now)
    return {"exposure": rows.select("who", "node_id", at.alias("at"), "channel", text.lookup(fixed.CHANNEL_DEPTH, F.col("channel"), fixed.OTHER_DEPTH).alias("depth"))}


def claimants(rows: DataFrame, now: float) -> DataFrame:
    """(id, partition, name, canonical, kind, first_seen): one claimant for all spellings of a name (name, partition, kind)."""
    named = rows.withColumn("canonical", text.canonical(F.col("name"))).where("canonical != ''")
    return named.groupBy("partition", "canonical").agg(F.min("name").alias("name"), F.min("kind").alias("kind")).select(made_id("who", "partition", "canonical").alias("id"), "partition", "name", "canonical", "kind", F.lit(now).alias("first_seen"))


def people(store: Store) -> DataFrame:
    """Claimants by id, under the name they were first known by; every batch that names one adds a row."""
    return store.read("claimant").groupBy("id").agg(F.min(F.struct("first_seen", "name", "canonical", "kind", "partition")).alias("f")).select("id", "f.*")


def claimed(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Claims (who, kind, partition, proposition, node_id): the claimant and the proposition's identity."""
    named = rows.withColumn("name", F.col("who"))
    claim = named.withColumn("claimant_id", made_id("who", "partition", text.canonical(F.col("who")))).withColumn("prop_hash", text.proposition_hash(F.col("proposition")))
    return {
        "claimant": claimants(named, now),
        "claim": claim.select(made_id("clm", "claimant_id", "prop_hash", "node_id").alias("id"), "claimant_id", "node_id", "proposition", "prop_hash", F.lit(now).alias("asserted_at")),
    }


def who_claims(store: Store, propositions: DataFrame) -> DataFrame:
    """(proposition, claimant_id, name, asserted_at, outcome) of everyone who claimed the same."""
    asked = propositions.select("proposition", text.proposition_hash(F.col("proposition")).alias("prop_hash"))
    return asked.join(claims(store).drop("proposition"), "prop_hash").join(people(store).select(F.col("id").alias("claimant_id"), "name"), "claimant_id").select("proposition", "claimant_id", "name", "asserted_at", "outcome")


def claim_outcomes(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """What became of claims (claim_id, confirmed)."""
    return {"claim_outcome": rows.select("claim_id", F.when(F.col("confirmed"), "confirmed").otherwise("refuted").alias("outcome"), F.lit(now).alias("at"))}


def committed(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Promises (who, partition, statement, node_id, due_at), each with an intention to check it then."""
    made = rows.withColumn("claimant_id", made_id("who", "partition", text.canonical(F.col("who")))).withColumn("id", made_id("cmt", "claimant_id", "statement", "due_at"))
    check = made.select(made_id("int", "id").alias("id"), "partition", F.lit(now).alias("created_at"), F.lit("time").alias("trigger_kind"), F.col("due_at").cast("string").alias("trigger_spec"), F.concat(F.lit("check: "), F.col("statement")).alias("action"), F.lit("pending").alias("status"), F.col("id").alias("origin_ref"))
    return {
        "claimant": claimants(rows.select(F.col("who").alias("name"), "partition", F.lit("person").alias("kind")), now),
        "commitment": made.select("id", "partition", "claimant_id", "node_id", "statement", F.lit(now).alias("made_at"), "due_at", F.lit("open").alias("status")),
        "intention": check,
    }


def commitment_outcomes(store: Store, rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Promises kept or broken (commitment_id, kept, note); their intentions to check are done."""
    ended = rows.select("commitment_id", F.when(F.col("kept"), "kept").otherwise("broken").alias("status"), "note", F.lit(now).alias("at"))
    check = store.read("intention").join(ended.select(F.col("commitment_id").alias("origin_ref")), "origin_ref", "left_semi")
    return {"commitment_event": ended, "intention_event": check.select(F.col("id").alias("intention_id"), F.lit("done").alias("status"), F.lit(now).alias("at"))}


def outcomes(claim: DataFrame, commitment: DataFrame) -> DataFrame:
    """(claimant_id, good, bad): claims confirmed and promises kept against those refuted and broken."""
    one = claim.select("claimant_id", F.when(F.col("outcome") == "confirmed", 1).when(F.col("outcome") == "refuted", 0).alias("ok"))
    two = commitment.select("claimant_id", F.when(F.col("status") == "kept", 1).when(F.col("status") == "broken", 0).alias("ok"))
    both = one.unionByName(two).where("ok is not null")
    return both.groupBy("claimant_id").agg(F.sum("ok").alias("good"), F.sum(1 - F.col("ok")).alias("bad"))


#: Credibility that goes with a learned grade.
CREDIBILITY_OF_GRADE = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6}


def learned_grades(claim: DataFrame, commitment: DataFrame, spoken: DataFrame) -> DataFrame:
    """(source_ref, claimant_id, reliability, credibility): the grade that three or more outcomes earn, for every source a claimant spoke through.

    spoken (node_id, source_ref) gives the nodes of claims and commitments.
    """
    graded = sequences.track_record(outcomes(claim, commitment), "claimant_id", "good", "bad").where("good + bad >= 3")
    through = claim.select("claimant_id", "node_id").unionByName(commitment.select("claimant_id", "node_id")).join(spoken, "node_id").select("claimant_id", "source_ref").distinct()
    return through.join(graded, "claimant_id").select("source_ref", "claimant_id", F.col("grade").alias("reliability"), text.lookup(CREDIBILITY_OF_GRADE, F.col("grade")).alias("credibility"))


def revalue_claimants(store: Store, now: float) -> dict[str, DataFrame]:
    """Assessments of the sources of all claimants with a record; where several speak through one, the worst grade counts."""
    learned = learned_grades(claims(store), commitments(store), nodes(store).select(F.col("id").alias("node_id"), "source_ref"))
    worst = learned.groupBy("source_ref").agg(F.max(F.struct("reliability", "credibility")).alias("g"))
    return {"source_assessment": worst.select("source_ref", "g.reliability", "g.credibility", F.lit("track record").alias("reason"), F.lit(now).alias("assessed_at"))}


def current_grades(rows: DataFrame, assessments: DataFrame) -> DataFrame:
    """rows (source_ref, reliability, credibility, ...) graded by the latest assessment of the source, else as at ingest."""
    latest = assessments.groupBy("source_ref").agg(F.max_by(F.struct("reliability", "credibility"), F.struct("assessed_at", "credibility")).alias("_g"))
    met = rows.join(latest, "source_ref", "left")
    return met.withColumn("reliability", F.coalesce("_g.reliability", "reliability")).withColumn("credibility", F.coalesce("_g.credibility", "credibility")).drop("_g")


def checked_bases(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, basis, refused) by decision of rows (id, because array): why one is refused; null where every basis is known."""
    each = rows.select("id", F.explode_outer(F.array_distinct("because")).alias("basis")).join(known.select(F.col("id").alias("basis"), F.lit(True).alias("known")), "basis", "left")
    g = each.groupBy("id").agg(F.count("basis").alias("n"), F.count("known").alias("found"))
    return g.select("id", F.when(F.col("n") == 0, "no basis").when(F.col("found") < F.col("n"), "unknown basis").alias("refused"))


def decided(store: Store, rows: DataFrame, now: float) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, refused): decisions (statement, because, partition, by, reversible_until) with their bases; every basis must be known."""
    made = rows.withColumn("id", made_id("dec", "statement", F.concat_ws(",", F.array_sort("because"))))
    judged = step(made.join(checked_bases(made, nodes(store)), "id"), "decided")
    good = judged.where("refused is null")
    tables = {
        "decision": good.select("id", "partition", "statement", F.lit(now).alias("decided_at"), F.col("by").alias("decided_by"), "reversible_until", F.lit("standing").alias("status")),
        "decision_basis": good.select(F.col("id").alias("decision_id"), F.explode(F.array_distinct("because")).alias("node_id"), F.lit(1.0).alias("weight")),
    }
    return tables, judged.where("refused is not null").select("id", "statement", "refused")


def executed(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Decisions (decision_id, outcome) carried out, which can no longer be reversed."""
    return {"decision_event": rows.select("decision_id", F.lit("executed").alias("status"), "outcome", F.lit(now).alias("at"))}


def acknowledged(store: Store, rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Impacts (impact_id, status, outcome) looked at; their decisions take the status."""
    told_of = rows.join(store.read("decision_impact").select(F.col("id").alias("impact_id"), "decision_id"), "impact_id")
    return {
        "impact_ack": rows.select("impact_id", "status", "outcome", F.lit(now).alias("at")),
        "decision_event": told_of.select("decision_id", "status", "outcome", F.lit(now).alias("at")),
    }


def radius(store: Store, roots: DataFrame) -> dict[str, DataFrame]:
    """What rests on each root (node): conclusions, composites, decisions and people told, by (root, ...)."""
    edges = store.read("derivation_edge").select("child_id", "parent_id").unionByName(store.read("composite_member").select(F.col("composite_id").alias("child_id"), F.col("member_id").alias("parent_id"))).distinct()
    reached = graph.closure(edges, roots, 64, "parent_id", "child_id")
    return {
        "reached": reached,
        "derived": reached.where("root != node").join(store.read("derived").select(F.col("id").alias("node")), "node", "left_semi"),
        "composites": reached.join(store.read("composite_member").select(F.col("composite_id").alias("node")).distinct(), "node", "left_semi"),
        "decisions": reached.join(store.read("decision_basis").withColumnRenamed("node_id", "node"), "node").select("root", "decision_id").distinct(),
        "told": reached.join(store.read("exposure").withColumnRenamed("node_id", "node"), "node").groupBy("root", "who").agg(F.min("at").alias("first"), F.countDistinct("node").alias("nodes")),
    }


def effective_criticality(stored: DataFrame, edges: DataFrame, basis: DataFrame, decision: DataFrame) -> DataFrame:
    """(node, score): the stored rank, but never less than what decisions on a node, or else its dependents, give it at once.

    stored (node, score), edges (child_id, parent_id), basis (decision_id, node_id), decision (id, status).
    """
    standing = basis.join(decision.where("status != 'reversed'").select(F.col("id").alias("decision_id")), "decision_id", "left_semi").groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("n_dec"))
    below = edges.groupBy(F.col("parent_id").alias("node")).agg(F.count("*").alias("n_dep"))
    met = stored.select("node", "score").join(standing, "node", "full").join(below, "node", "full")
    floor = F.when(F.col("n_dec") > 0, F.least(F.lit(1.0), 0.6 + 0.15 * (F.col("n_dec") - 1))).when(F.col("n_dep") > 0, F.least(F.lit(0.5), 0.15 * F.col("n_dep"))).otherwise(0.0)
    return met.select("node", F.greatest(F.coalesce("score", F.lit(0.0)), floor).alias("score"))


def recompute_criticality(store: Store, now: float) -> dict[str, DataFrame]:
    """A snapshot of every node's rank with its dependents and decisions; decisions themselves are left out."""
    edges, basis = store.read("derivation_edge"), store.read("decision_basis")
    score = graph.criticality(edges, basis).join(basis.select(F.col("decision_id").alias("node")).distinct(), "node", "left_anti")
    dec = basis.groupBy(F.col("node_id").alias("node")).agg(F.countDistinct("decision_id").cast("int").alias("decisions"))
    dep = graph.dependents(edges).select("node", F.col("dependents").cast("int").alias("dependents"))
    return {"criticality": score.join(dep, "node", "left").join(dec, "node", "left").na.fill({"dependents": 0, "decisions": 0}).select(F.col("node").alias("node_id"), "score", "dependents", "decisions", F.lit(now).alias("computed_at"))}


def discredited(store: Store, roots: DataFrame, reason: str, now: float, reliability: str = "E") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, plan): roots (node) lowered, and all that rests on them with them.

    The root's source gets an assessment (a conclusion loses confidence
    instead), conclusions below get a revaluation, each root a recorded absence,
    and every decision on a moved node an impact.  Where roots share a
    conclusion, its lowest value counts.  No evidence is changed.
    """
    roots = step(roots.select(F.col(roots.columns[0]).alias("node")).distinct(), "roots")
    found, made = radius(store, roots), conclusions(store)
    reached = step(found["reached"], "radius")
    plan = step(discredit_plan(reached, made.select("id", "confidence", "epistemic_tag"), reliability), "plan")
    every = nodes(store)
    met = roots.join(every.select(F.col("id").alias("node"), "partition", "source_ref", "kind", "confidence", "epistemic"), "node")
    lower = F.round(F.col("confidence") * fixed.RELIABILITY.get(reliability, 0.2), 4)
    own = met.where("kind != 'observation'").select(F.col("node").alias("node_id"), lower.alias("confidence"), "epistemic", F.lit("demoted").alias("fate"), F.lit(reason).alias("cause"), F.lit(now).alias("at"))
    below = plan.groupBy("id").agg(F.min(F.struct("confidence", "epistemic", "fate")).alias("w")).select(F.col("id").alias("node_id"), "w.confidence", "w.epistemic", "w.fate", F.lit(reason).alias("cause"), F.lit(now).alias("at"))
    moved = reached.select(F.col("node").alias("node_id"), F.lit("discredited").alias("cause")).distinct()
    weight = effective_criticality(store.read("criticality").groupBy(F.col("node_id").alias("node")).agg(F.max_by("score", "computed_at").alias("score")), store.read("derivation_edge"), store.read("decision_basis"), decisions(store))
    tables = {
        "source_assessment": met.where("kind = 'observation'").select("source_ref", F.lit(reliability).alias("reliability"), F.lit(5).alias("credibility"), F.lit(reason).alias("reason"), F.lit(now).alias("assessed_at")).distinct(),
        "revaluation": own.join(below.select("node_id"), "node_id", "left_anti").unionByName(below),
        "absence": met.select(made_id("abs", F.lit("discredited"), "node").alias("id"), "partition", F.concat(F.lit("discredited:"), F.col("node")).alias("query"), F.lit("revaluation").alias("scope"), F.lit(now).alias("searched_at"), F.lit(f"source discredited: {reason}").alias("reason")),
        "decision_impact": raise_impacts(moved, store.read("decision_basis"), decisions(store), impacts(store), weight, now),
    }
    return tables, plan


def failed(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Approaches that did not work (approach, reason, context, partition, node_id); one that failed before counts up."""
    told_once = rows.groupBy("partition", "approach").agg(F.max("reason").alias("reason"), F.max("context").alias("context"), F.max("node_id").alias("node_id"), F.count("*").cast("int").alias("recurrence"))
    return {"failure": told_once.select(made_id("fail", "partition", "approach", F.lit(now)).alias("id"), "partition", "approach", "reason", "context", F.lit(now).alias("failed_at"), "node_id", "recurrence")}


def absences(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Searches that found nothing (query, partition, scope, reason, expires_in seconds or null)."""
    return {"absence": rows.select(made_id("abs", "partition", "query", F.lit(now)).alias("id"), "partition", "query", F.coalesce("scope", F.lit("all")).alias("scope"), F.lit(now).alias("searched_at"), F.coalesce("reason", F.lit("")).alias("reason"), (F.lit(now) + F.col("expires_in")).alias("expires_at"))}


def predicted(rows: DataFrame, known: DataFrame, now: float) -> dict[str, DataFrame]:
    """Predictions (node_id, confidence, claim_kind) by a node's source or origin; confidence and kind default to the node's own."""
    met = rows.join(known.select(F.col("id").alias("node_id"), "source_ref", "origin", F.col("confidence").alias("own"), "claim_class"), "node_id")
    producer = F.coalesce(F.when(F.col("source_ref") != "", F.col("source_ref")), "origin")
    return {"calibration": met.select(made_id("prd", "node_id", F.lit(now)).alias("id"), producer.alias("producer"), F.coalesce("claim_kind", "claim_class").alias("claim_kind"), F.coalesce("confidence", "own").alias("confidence"), F.lit(now).alias("recorded_at"))}


def prediction_outcomes(rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Whether predictions (id, correct) came true."""
    return {"prediction_outcome": rows.select("id", F.col("correct").cast("int").alias("outcome"), F.lit(now).alias("at"))}


def calibration(store: Store) -> tuple[DataFrame, DataFrame]:
    """(by producer and kind, curve) over the predictions whose outcome is known."""
    latest = store.read("prediction_outcome").groupBy("id").agg(F.max_by("outcome", "at").alias("_outcome"))
    rows = store.read("calibration").join(latest, "id", "left").withColumn("outcome", F.coalesce("_outcome", "outcome"))
    return sequences.brier(rows), sequences.reliability_curve(rows)


def intended(rows: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(intentions, refused) of (action, when_at, on_event, partition, origin_ref): exactly one trigger, a cue of two tokens at least."""
    both = F.col("when_at").isNotNull().cast("int") + F.col("on_event").isNotNull().cast("int")
    why = F.when(both != 1, "exactly one of when and on_event").when(F.col("on_event").isNotNull() & (F.size(text.tokens(F.col("on_event"))) < 2), "a cue of fewer than two tokens")
    judged = rows.withColumn("refused", why)
    spec = F.coalesce(F.col("when_at").cast("string"), "on_event")
    good = judged.where("refused is null").select(made_id("int", "partition", "action", spec).alias("id"), "partition", F.lit(now).alias("created_at"), F.when(F.col("when_at").isNotNull(), "time").otherwise("event").alias("trigger_kind"), spec.alias("trigger_spec"), "action", F.lit("pending").alias("status"), "origin_ref")
    return good, judged.where("refused is not null").select("action", "refused")


def receipts(queries: DataFrame, answers: DataFrame, results: DataFrame, now: float, rejected: DataFrame | None = None) -> dict[str, DataFrame]:
    """What each query was answered with, as compact JSON of the results (n, s, r, stale, epi, src) and up to five rejected ones (n, s)."""
    one = F.to_json(F.struct(F.col("node").alias("n"), F.col("score").alias("s"), F.col("retrievability").alias("r"), F.col("staleness").alias("stale"), F.col("epistemic").alias("epi"), F.col("source_ref").alias("src")))
    shown = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("j")))), lambda x: x["j"]).alias("returned"))
    met = queries.join(answers.select("query_id", "state"), "query_id").join(shown, "query_id", "left")
    if rejected is not None:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
        lost = rejected.withColumn("rn", F.row_number().over(order)).where("rn <= 5").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.to_json(F.struct(F.col("node").alias("n"), F.col("score").alias("s"))).alias("j")))), lambda x: x["j"]).alias("rejected"))
        met = met.join(lost, "query_id", "left")
    else:
        met = met.withColumn("rejected", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return {"receipt": met.select(made_id("rcp", "query_id", "query", F.lit(now)).alias("id"), F.lit(now).alias("at"), F.col("viewer").alias("partition"), "query", "state", F.coalesce("returned", none).alias("returned"), F.coalesce("rejected", none).alias("rejected"), F.lit(0).alias("tier"))}


def receipts_for(store: Store, like: str | None = None, most: int = 20) -> DataFrame:
    """The newest receipts, of queries that hold that text if given."""
    found = store.read("receipt")
    return (found if like is None else found.where(F.col("query").contains(like))).orderBy(F.col("at").desc(), "id").limit(most)


def accessed(rows: DataFrame, last: int = 64) -> DataFrame:
    """(node_id, log): the last accesses of each node in order; earlier ones go map-side, so a hot node keeps a short list."""
    order = Window.partitionBy("node_id").orderBy(F.col("at").desc())
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= last).groupBy("node_id").agg(F.array_sort(F.collect_list("at")).alias("log"))


def successions(rows: DataFrame, by: str, order: str, node: str) -> DataFrame:
    """(src, dst, count): how often one node directly follows another in a stream."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("src", F.lag(node).over(w)).where(f"src is not null and src != {node}").groupBy("src", F.col(node).alias("dst")).agg(F.count("*").cast("int").alias("count"))


def _recent(most: int):
    """The entities last mentioned before each asking row, from mentions and asking rows of a partition in order of time.

    An entity keeps its newest mention and the newest by another node than that: one
    of them is not of the row that asks.  Entities are held in the order of their
    newest mention, so few are looked at for a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()  # entity: (turn, at, node, turn of another node, at of another node)
        part, turn, now = None, 0, None
        for batch in batches:
            out: list[tuple] = []
            for p, at, asks, node, entity in zip(*(batch.column(c).to_pylist() for c in ("partition", "at", "asks", "node", "entity_id")), strict=True):
                if p != part:
                    held, part = OrderedDict(), p
                if at != now and (at == at or now == now):
                    turn, now = turn + 1, at  # times are told apart by turns, in Spark's order of them
                if not asks:
                    old = held.get(entity)
                    held[entity] = (turn, at, node, *((None, None) if old is None else old[3:] if old[2] == node else old[:2]))
                    held.move_to_end(entity)
                    continue
                best: list[tuple] = []
                for e in reversed(held):
                    s = held[e]
                    if len(best) == most and s[0] < -best[-1][0]:
                        break
                    t, last = s[:2] if s[2] != node else s[3:]
                    if t is not None:
                        best = sorted([*best, (-t, e is not None, e, last)], key=lambda x: x[:3] if x[1] else x[:2])[:most]  # of one time in the order of entities
                out += [(node, e, last) for _, _, e, last in best]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], batch.schema.field(c).type) for i, c in enumerate(("node", "entity_id", "at"))], names=["id", "entity_id", "last"])

    return run


def recent_entities(rows: DataFrame, mention: DataFrame, entity: DataFrame, most: int = 3) -> DataFrame:
    """(id, candidates): the entities last mentioned at or before each row (id, partition, at) in its partition, newest first.

    mention (entity_id, node_id, partition, at).  Only the newest mention of an
    entity before the row counts, and none by the row itself.  Mentions and rows
    of a partition are folded once in order of time, whatever the pairs of them.
    """
    told = mention.select("partition", "at", F.lit(0).alias("asks"), F.col("node_id").alias("node"), "entity_id")
    asked = rows.select("partition", "at", F.lit(1).alias("asks"), F.col("id").alias("node"), F.lit(None).cast(mention.schema["entity_id"].dataType).alias("entity_id"))
    every = told.unionByName(asked).where("partition is not null and at is not null and node is not null").repartition("partition").sortWithinPartitions("partition", "at", "asks")
    kind = {c: every.schema[c].dataType.simpleString() for c in ("node", "entity_id", "at")}
    met = every.mapInArrow(_recent(most), f"id {kind['node']}, entity_id {kind['entity_id']}, last {kind['at']}")
    last = met.groupBy("id", "entity_id").agg(F.max("last").alias("last"))
    order = Window.partitionBy("id").orderBy(F.col("last").desc(), "entity_id")
    top = last.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).join(entity.select(F.col("id").alias("entity_id"), "name", "kind"), "entity_id")
    return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name", "kind"))), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"))).alias("candidates"))


def sessions(rows: DataFrame, by: str, at: str = "at", gap: float = 1800.0) -> DataFrame:
    """rows with session: a new one after that many seconds of silence in a stream."""
    w = Window.partitionBy(by).orderBy(at)
    cut = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False)).cast("int")
    return rows.withColumn("_cut", cut).withColumn("session", F.sum("_cut").over(w)).drop("_cut")


def composites(clusters: DataFrame, known: DataFrame, now: float, level: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, members): a denser node for each cluster (node, target) of two or more, none of them verbatim.

    Its text is that of the most confident, newest member, its confidence the
    least of all members'.  known (id, content, partition, confidence, at, claim_class).
    """
    met = clusters.join(known.withColumnRenamed("id", "node"), "node")
    best = F.max_by("content", F.struct("confidence", "at", "node"))
    made = met.groupBy("target").agg(best.alias("content"), F.min("confidence").alias("confidence"), F.min("partition").alias("partition"), F.count("*").alias("n"), F.max((F.col("claim_class") == "verbatim").cast("int")).alias("exact"), F.array_sort(F.collect_set("node")).alias("members"))
    good = made.where("n >= 2 and exact = 0").withColumn("id", made_id("der", "content", F.concat_ws(",", "members"), F.lit("summary")))
    members = good.select(F.col("id").alias("composite_id"), F.explode("members").alias("member_id"), F.lit(level).alias("level"))
    return {
        "derived": good.select("id", "partition", F.lit(now).alias("created_at"), F.lit("summary").alias("kind"), F.lit("inferred").alias("epistemic_tag"), F.lit("fusion").alias("producer"), "content", "confidence"),
        "derivation_edge": members.select(F.col("composite_id").alias("child_id"), F.col("member_id").alias("parent_id"), F.lit("evidence").alias("role")),
        "composite_member": members,
    }, good.select("id", "content", "confidence", "members")


def fuse(pairs, known: DataFrame, now: float, levels: int = 2, dedupe: float = 0.85, cluster: float = 0.75) -> list[tuple[dict[str, DataFrame], DataFrame]]:
    """Fusion by levels: first nodes, then the composites that came of them; ends where nothing is left to fuse.

    pairs(rows) gives the similar pairs (a, b, sim) of rows (id, content).
    Verbatim and untrusted nodes are never merged.
    """
    out, rows = [], known
    for level in range(levels):
        protected = rows.where("claim_class = 'verbatim' or trust != 'trusted'").select("id")
        plan = step(graph.fusion_plan(pairs(rows), dedupe, cluster, protected), "fusion")
        tables, made = composites(plan.where("role = 'cluster'"), rows, now, level)
        made = step(made, "composites")
        out.append((tables | {"suppress_event": plan.where("role = 'duplicate'").select(F.col("node").alias("node_id"), F.lit(now).alias("at"), F.lit("duplicate").alias("reason"))}, made))
        if made.isEmpty():
            break
        rows = made.select("id", "content", "confidence", F.lit(now).alias("at"), F.lit("unknown").alias("claim_class"), F.lit("trusted").alias("trust")).join(tables["derived"].select("id", "partition"), "id")
    return out


def communities(store: Store, found: DataFrame, partition: str) -> dict[str, DataFrame]:
    """New generations of communities (community, node) whose members changed; an unchanged one adds nothing.

    Lineage names what a community came from: its best earlier match by Jaccard of members, at least a half.
    """
    from provenspark.operators.context import reconciled

    old = store.read("community").where(F.col("partition") == partition)
    newest = old.groupBy("id").agg(F.max_by(F.struct("members", "generation", "lineage"), "generation").alias("c")).select("id", "c.*")
    matched = reconciled(found, newest.select(F.col("id").alias("community"), F.explode("members").alias("node")))
    now = found.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("members"))
    met = now.join(matched.select("community", F.col("previous").alias("id")), "community", "left").join(newest.select("id", F.col("members").alias("before"), "generation", F.col("lineage").alias("old")), "id", "left")
    changed = met.where("before is null or not members <=> before")
    lineage = F.when(F.col("id").isNotNull(), F.concat(F.coalesce("old", F.array().cast("array<string>")), F.array("id"))).otherwise(F.array().cast("array<string>"))
    return {"community": changed.select(made_id("com", F.concat_ws(",", "members")).alias("id"), F.lit(partition).alias("partition"), "members", (F.coalesce("generation", F.lit(0)) + 1).alias("generation"), lineage.alias("lineage"))}


def queue_depth(store: Store) -> DataFrame:
    """(partition, pending, abandoned): texts that wait for a vector, and those given up after three attempts."""
    last = store.read("embed_queue").groupBy("partition", "node_id").agg(F.max("attempts").alias("attempts"))
    left = last.join(store.read("vector").select("node_id").distinct(), "node_id", "left_anti")
    return left.groupBy("partition").agg(F.sum((F.col("attempts") < 3).cast("long")).alias("pending"), F.sum((F.col("attempts") >= 3).cast("long")).alias("abandoned"))


def without_vector(store: Store, model: str, space: str = "read") -> DataFrame:
    """(node_id, content, partition) that have no vector of that model and space."""
    have = store.read("vector").where((F.col("model") == model) & (F.col("space") == space)).select(F.col("node_id").alias("id"))
    return nodes(store).join(have, "id", "left_anti").select(F.col("id").alias("node_id"), "content", "partition")


def vector_rows(rows: DataFrame, model: str, space: str = "read") -> dict[str, DataFrame]:
    """Vectors (node_id, partition, v) to store; a node's latest one of a model and space counts."""
    return {"vector": rows.select("node_id", "partition", F.lit(space).alias("space"), F.size("v").alias("dim"), F.lit(model).alias("model"), F.col("v").cast("array<float>").alias("data"), F.lit(0.0).alias("hubness"))}


def reindex(store: Store, embed, model: str) -> dict[str, DataFrame]:
    """Vectors of everything that has none, by embed(DataFrame of node_id, content, partition) -> (node_id, partition, v)."""
    return vector_rows(embed(without_vector(store, model)), model)


def ledger_view(store: Store, partition: str, most: int = 100, derived: bool = True) -> DataFrame:
    """(node_id, content, kind, epistemic, confidence, source_ref, at, corrected, corrected_by, line): the newest rows, nothing suppressed."""
    own = nodes(store).where(F.col("partition") == partition)
    own = own if derived else own.where("kind = 'observation'")
    own = own.join(store.read("suppress_event").select(F.col("node_id").alias("id")).distinct(), "id", "left_anti")
    newer = store.read("supersession").groupBy(F.col("old_node").alias("id")).agg(F.max_by("new_node", "at").alias("corrected_by"))
    top = own.orderBy(F.col("at").desc(), "id").limit(most).join(newer, "id", "left")
    rows = top.select(F.col("id").alias("node_id"), "content", F.when(F.col("kind") == "observation", "observation").otherwise("derived").alias("kind"), "epistemic", "confidence", "source_ref", "at", F.col("corrected_by").isNotNull().alias("corrected"), "corrected_by")
    return rows.withColumn("line", ledger_line(F.col("content"), F.col("epistemic"), F.col("corrected"), F.col("source_ref")))


def ledger_line(content: Column, epistemic: Column, was_corrected: Column, source_ref: Column) -> Column:
    """One entry as Markdown: what is not a fact and what was corrected is marked."""
    return F.concat(F.lit("- "), content, F.when(presentable(epistemic), "").otherwise(F.concat(F.lit("  *"), epistemic, F.lit(", not fact*"))), F.when(was_corrected, "  [corrected]").otherwise(""), F.lit("\n  <sub>"), source_ref, F.lit("</sub>"))


def ledger_text(rows: DataFrame, partition: str) -> str:
    """The view as Markdown for a person: what was told first, then what was concluded."""
    found = [r.asDict() for r in rows.orderBy(F.col("at").desc(), "node_id").collect()]  # at most the view's limit
    out = [f"# On record: `{partition}`", "", "Everything can be corrected; a correction supersedes, and both stay.", ""]
    for title, kind in (("Told or shown", "observation"), ("Worked out (not facts)", "derived")):
        if lines := [r["line"] for r in found if r["kind"] == kind]:
            out += [f"## {title}", "", *lines, ""]
    return "\n".join(out if found else [*out, "*Nothing on record.*"]).strip()


def presentable(epistemic: Column) -> Column:
    """Whether something may be told as a fact: observed or reported."""
    return text.lookup(fixed.EPISTEMIC_RANK, epistemic) <= 1


def node_opinions(rows: DataFrame) -> DataFrame:
    """(id, b, d, u, a, expectation, verdict) from rows (id, derived boolean, origins, against, superseded, reliability, credibility).

    One origin supports as 1, more as 1 and their corroboration; counter
    strengths and a supersession count against; what is left is discounted by
    the mean of the grade's two weights.
    """
    support = F.when(F.col("origins") > 1, 1 + memory.corroboration(F.col("origins"))).when(~F.col("derived"), 1.0).otherwise(0.0)
    against = F.col("against") + F.when(F.col("superseded"), 1.0).otherwise(0.0)
    trust = (text.lookup(fixed.OPINION_DISCOUNT, F.col("reliability"), 0.6) + text.lookup(fixed.OPINION_DISCOUNT_CREDIBILITY, F.col("credibility"), 0.6)) / 2
    o = text.let(memory.opinion(support, against), lambda x: memory.discounted(trust, x))
    told_of = rows.select("id", o.alias("o"))
    return told_of.select("id", F.round("o.b", 6).alias("b"), F.round("o.d", 6).alias("d"), F.round("o.u", 6).alias("u"), F.col("o.a").alias("a"), memory.expectation(F.col("o")).alias("expectation"), memory.verdict(F.col("o")).alias("verdict"))


def urgent(found: DataFrame, decision: DataFrame, now: float) -> DataFrame:
    """Open impacts of decisions that can still be reversed, of severity a half or more."""
    may = decision.where((F.col("reversible_until").isNull() | (F.col("reversible_until") > now)) & (F.col("status") != "executed")).select(F.col("id").alias("decision_id"))
    return found.where("acknowledged_at is null and severity >= 0.5").join(may, "decision_id", "left_semi")


def session_prefix(store: Store, partition: str, now: float, who: str | None = None, budget: int = 400) -> DataFrame:
    """(tier, rank, content) to start a session with: impacts, due promises, open loops, what the person is about to forget; whole tiers or none."""
    from provenspark.operators.context import prefix

    own = lambda df: df.where(F.col("partition") == partition)
    decided_on = own(decisions(store)).select(F.col("id").alias("decision_id"), "statement")
    one = impacts(store).where("acknowledged_at is null").join(decided_on, "decision_id").select(F.lit(1).alias("tier"), (-F.col("severity")).alias("by"), F.concat("cause", F.lit(": "), "statement").alias("content"))
    two = own(commitments(store)).where((F.col("status").isin("open", "due")) & (F.col("due_at") <= now)).select(F.lit(2), F.col("due_at"), "statement")
    three = own(current_intentions(store)).where("status = 'pending'").select(F.lit(3), "created_at", "action")
    rows = one.union(two).union(three)
    if who is not None:
        held = sequences.retention(store.read("exposure").where(F.col("who") == who).withColumnRenamed("node_id", "node"), F.lit(now)).where("retrievability < 0.4")
        rows = rows.union(held.join(own(nodes(store)).select(F.col("id").alias("node"), "content"), "node").select(F.lit(4), "retrievability", "content"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy("by", "content")))
    return prefix(ranked.select("tier", "rank", "content"), budget)


def current_intentions(store: Store) -> DataFrame:
    from provenspark.sources.store import intentions

    return intentions(store)


def maturity_text(days: Column, memories: Column, sources: Column, coverage: Column) -> Column:
    """What to know before trusting a gap: the store's age and size, and how much an absence means."""
    age = F.when(days < 60, F.concat(F.format_string("%.0f day", days), F.when(F.round(days) != 1, "s").otherwise(""))).otherwise(F.format_string("%.0f months", days / 30))
    base = F.concat(age, F.lit(" of history, "), memories.cast("string"), F.lit(" memories, "), sources.cast("string"), F.when(sources != 1, " sources").otherwise(" source"))
    means = F.when(coverage < 0.25, "new: a gap is ignorance, not absence").when(coverage < 0.5, "thin: a gap is weak evidence of absence").when(coverage < 0.8, "fair: a gap in a well-covered area means something").otherwise("mature: a recorded absence is evidence of absence")
    return F.concat(base, F.lit(". "), means)


def nightly(spent: Column, allowed: Column, pressure: Column, coverage: Column, least: float = 4.0) -> Column:
    """struct<run, reason>: whether a model call is worth it tonight; refused when the quota is spent, nothing is owed, or the store is too new."""
    why = F.when(spent >= allowed, "quota spent").when(pressure < least, "nothing owed").when(coverage < 0.25, "store too new")
    return F.struct(why.isNull().alias("run"), F.coalesce(why, F.lit("worth one call")).alias("reason"))


def kept_verdict(offered: Column, used: Column) -> Column:
    """struct<rate, keep>: whether an offer earns its place: from ten offers on, if three tenths are taken up; before that it stays."""
    rate = F.when(offered >= 10, F.round(used / offered, 3))
    return F.struct(rate.alias("rate"), F.coalesce(used / offered >= 0.3, F.lit(True)).alias("_k")).withField("keep", F.when(offered < 10, True).otherwise(used / offered >= 0.3)).dropFields("_k")


def prediction_error(observed: Column, expected: Column) -> Column:
    """How far a novelty was from what was expected, 0 to 1."""
    return memory.clamp(F.abs(observed - expected), 0.0, 1.0)


def path_text(names: Column, kinds: Column) -> Column:
    """a --[kind]--> b --[kind]--> c of an array of names and the kinds between them."""
    rest = F.zip_with(F.slice(names, 2, F.greatest(F.lit(0), F.size(names) - 1)), kinds, lambda n, k: F.concat(F.lit(" --["), k, F.lit("]--> "), n))
    return F.concat(F.get(names, F.lit(0)), F.array_join(rest, ""))
