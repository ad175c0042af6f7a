"""The evidence engine: writing, deriving, revaluing, deciding and auditing, as batches over append-only tables.

Every method takes DataFrames or plain values and the time `now` in seconds;
ids are made from content and keys, so repeating a batch makes the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenspark.functions import fixed, memory, text
from provenspark.operators import graph, retrieval, sequences
from provenspark.sources.store import Store, nodes, observations, step

NOT_CONCLUDED = ("summary", "abstraction", "graft")


def made_id(prefix: str, *parts) -> Column:
    """A node id that its parts decide."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def observe(store: Store, rows: DataFrame, now: float) -> dict[str, DataFrame]:
    """Tables that a batch of evidence adds.

    rows: content, partition, source_ref, origin and optionally claim_class,
    reliability, credibility, trust, observed_at, valid_from, valid_to, affect.
    Blank content is left out.  Texts are classed and screened: blocked ones
    are quarantined, suspect ones untrusted, unless the caller trusted them less.
    """
    default = {"partition": "default", "source_ref": "inline", "origin": "document", "reliability": "F", "credibility": 6, "trust": "trusted", "affect": 0.0, "acquisition_cost": 0.0, "observed_at": now}
    given = rows.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    for name, value in default.items():
        given = given.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    own_class = F.col("claim_class") if "claim_class" in rows.columns else F.lit(None).cast("string")
    given = given.withColumn("claim_class", F.coalesce(own_class, text.claim_class(F.col("content")))).withColumn("content_hash", F.sha2("content", 256))
    given = given.withColumn("id", made_id("obs", "partition", "source_ref", "content_hash", "observed_at")).withColumn("_s", text.screen(F.col("content"), F.col("origin")))
    trust = F.when(F.col("trust") != "trusted", F.col("trust")).when(F.col("_s.verdict") == "blocked", "quarantined").when(F.col("_s.verdict") == "suspect", "untrusted").otherwise("trusted")
    given = step(given.withColumn("trust", trust), "observed")
    told = sequences.episodes(given.select("partition", F.struct("observed_at", "id").alias("o"), "content"), "partition", "o")
    # written once: six tables read it
    seen = step(given.join(told.select(F.col("o.id").alias("id"), "episode", "surprise", "boundary"), "id").withColumn("episode_id", made_id("epi", "partition", F.col("episode"), F.lit(now))), "segmented")
    post = retrieval.postings(seen)
    return {
        "observation": seen,
        "review_event": seen.select(F.col("id").alias("node_id"), F.col("observed_at").alias("at"), F.lit(3).alias("grade")),
        "lexeme": post.select("term", F.col("node").alias("node_id"), "tf", "partition"),
        "write_screen": seen.select(F.col("id").alias("node_id"), F.lit(now).alias("at"), "_s.verdict", "_s.signals", "_s.score"),
        "source_origin": seen.groupBy("source_ref").agg(F.min("observed_at").alias("first_seen")).select("source_ref", text.origin_key(F.col("source_ref")).alias("origin_cluster"), F.floor(F.col("first_seen") / 300).cast("string").alias("ingest_batch"), "first_seen"),
        "episode": seen.groupBy("episode_id", "partition").agg(F.min("observed_at").alias("started_at"), F.max("surprise").alias("boundary_surprise")).withColumnRenamed("episode_id", "id"),
    }


def supersede(attempts: DataFrame) -> DataFrame:
    """attempts with allowed and reason: authority first, then the hourly limit of allowed attempts by source.

    attempts: source_ref, at, old_node, new_grade, old_grade, trust.
    """
    may = attempts.withColumn("may", memory.may_supersede(F.col("new_grade"), F.col("old_grade"), F.col("trust")))
    flow = sequences.coup(may.where("may").select("source_ref", "at").distinct(), "source_ref")
    joined = may.join(flow, ["source_ref", "at"], "left")
    return joined.withColumn("allowed", F.col("may") & F.coalesce("allowed", F.lit(False))).withColumn("reason", F.when(~F.col("may"), "authority").when(~F.col("allowed"), "coup").otherwise("allowed")).drop("may")


def derive(store: Store, rows: DataFrame, now: float) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, refused): conclusions held to their parents' least confidence and weakest epistemic tag.

    rows: content, parents array<string>, kind, producer, confidence, epistemic,
    falsifier.  Hypotheses need a falsifier; summaries, abstractions and grafts
    may not change a quantity of a parent; every parent must be known.
    """
    rank = text.lookup(fixed.EPISTEMIC_RANK, F.col("epistemic"))
    rows = rows.withColumn("id", made_id("der", "content", F.concat_ws(",", F.array_sort("parents")), "kind"))
    known = nodes(store).select(F.col("id").alias("parent_id"), F.col("confidence").alias("pc"), text.lookup(fixed.EPISTEMIC_RANK, F.col("epistemic")).alias("pr"), F.col("content").alias("ptext"), "partition")
    links = rows.select("id", "content", "kind", F.explode("parents").alias("parent_id")).join(known, "parent_id", "left")
    clash = F.col("kind").isin(*NOT_CONCLUDED) & F.col("ptext").isNotNull() & (F.size(text.unit_conflicts(F.col("ptext"), F.col("content"))) > 0)
    facts = links.groupBy("id").agg(F.min("pc").alias("pc"), F.max("pr").alias("pr"), F.max(F.col("pc").isNull()).alias("unknown"), F.max(clash).alias("clash"), F.min("partition").alias("partition"))
    whole = rows.join(facts, "id", "left")
    why = (
        F.when((F.col("kind") == "hypothesis") & (F.coalesce("falsifier", F.lit("")) == ""), "hypothesis without a falsifier")
        .when(F.size("parents") == 0, "no parent")
        .when(F.col("unknown"), "unknown parent")
        .when(F.col("clash"), "changes a quantity")
    )
    whole = step(whole.withColumn("refused", why), "derived")
    floor = F.when(F.col("kind") == "hypothesis", 3).when(F.col("kind") == "reflection", 2).otherwise(0)
    tags = F.array(*[F.lit(k) for k in sorted(fixed.EPISTEMIC_RANK, key=fixed.EPISTEMIC_RANK.get)])
    tag = F.get(tags, F.greatest(F.coalesce(rank, F.lit(2)), F.col("pr"), floor).cast("int"))
    good = whole.where("refused is null").select("id", "partition", F.lit(now).alias("created_at"), "kind", tag.alias("epistemic_tag"), "producer", "content", F.least(F.coalesce("confidence", F.lit(0.7)), F.col("pc")).alias("confidence"), "falsifier", "parents")
    tables = {
        "derived": good.drop("parents"),
        "derivation_edge": good.select(F.col("id").alias("child_id"), F.explode("parents").alias("parent_id"), F.lit("evidence").alias("role")),
        "review_event": good.select(F.col("id").alias("node_id"), F.lit(now).alias("at"), F.lit(3).alias("grade")),
        "lexeme": retrieval.postings(good).select("term", F.col("node").alias("node_id"), "tf", "partition"),
    }
    return tables, whole.where("refused is not null").select("id", "content", "refused")


def states(store: Store, now: float) -> DataFrame:
    """(node, s, d, r, tier, suppressed): the memory state of every node, folded from its events."""
    s = sequences.memory_state(store.read("review_event"), "node_id")
    quiet = store.read("suppress_event").select("node_id").distinct().withColumn("suppressed", F.lit(True))
    r = memory.retrievability(F.lit(now) - F.col("last"), F.col("s"))
    return s.join(quiet, "node_id", "left").select(F.col("node_id").alias("node"), "s", "d", r.alias("r"), memory.tier(r).alias("tier"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"))


def grades(store: Store) -> DataFrame:
    """(source_ref, reliability, credibility): the latest assessment of each source."""
    return store.read("source_assessment").groupBy("source_ref").agg(F.max_by(F.struct("reliability", "credibility"), "assessed_at").alias("g")).select("source_ref", "g.*")


def visible(store: Store) -> DataFrame:
    return graph.visibility(store.read("partition_flow"), store.read("partition").select("name").union(store.read("observation").select("partition")).distinct())


def recall(store: Store, queries: DataFrame, now: float, hits: DataFrame | None = None, mentioned: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """Answers and results for queries (query_id, query, viewer); nothing is reinforced by asking.

    hits: semantic hits of an encoder (query_id, node, sim); mentioned: entities
    that queries name (query_id, entity_id).  answers also say whether they are
    degraded (no encoder), provisional (texts wait to be embedded), at full
    strength and informative.
    """
    made, edges = store.read("derived"), store.read("derivation_edge")
    every = nodes(store)
    placed = every.join(observations(store).select("id", "episode_id", "period_id"), "id", "left")
    signals = {
        "post": store.read("lexeme").select("term", F.col("node_id").alias("node"), "partition", "tf"),
        "assoc": associations(store),
        "succession": store.read("succession"),
        "recollection": retrieval.surroundings(placed, store.read("assoc_edge"), store.read("mention"), edges, made),
        "entities": store.read("entity"),
        "criticality": store.read("criticality").groupBy(F.col("node_id").alias("node")).agg(F.max_by("score", "computed_at").alias("score")),
        "grades": grades(store),
        "half_lives": sequences.half_life(store.read("supersession")),
        "parents": edges,
    }
    if hits is not None:
        signals["hits"] = hits
    if mentioned is not None:
        signals |= {"mentioned": mentioned, "mention": store.read("mention"), "relation": store.read("relation")}
    answers, results = retrieval.recall(queries, placed, states(store, now), visible(store), store.read("absence"), now, **signals, **limits)
    waiting = store.read("embed_queue").select("node_id").distinct().agg(F.count("*").alias("pending"))  # one row
    flags = answers.join(F.broadcast(waiting)).withColumn("degraded", F.lit(hits is None)).withColumn("provisional", F.col("pending") > 0)
    return flags.withColumn("full_strength", ~F.col("degraded") & ~F.col("provisional")).withColumn("informative", F.col("state") != "dont_know").drop("pending"), results


def associations(store: Store) -> DataFrame:
    """(src, dst, weight): associations with the weight of their whole history: one, and a quarter more for each repetition up to four."""
    g = store.read("assoc_edge").groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("weight").alias("most"))
    return g.select("src", "dst", F.least(F.lit(4.0), F.col("most") + 0.25 * (F.col("n") - 1)).alias("weight"))


def reinforced(results: DataFrame, now: float) -> dict[str, DataFrame]:
    """What using results adds: a good review of each node, and an association between nodes returned together."""
    used = results.select("query_id", "node")
    both = used.join(used.withColumnRenamed("node", "other"), "query_id").where("node != other")
    pairs = both.groupBy(F.col("node").alias("src"), F.col("other").alias("dst")).agg(F.count("*").alias("n"))
    return {
        "review_event": used.select(F.col("node").alias("node_id"), F.lit(now).alias("at"), F.lit(3).alias("grade")),
        "assoc_edge": pairs.select("src", "dst", F.least(F.lit(4.0), 1 + 0.25 * (F.col("n") - 1)).alias("weight"), F.lit("recalled").alias("kind")),
    }


def discredit_plan(radius: DataFrame, derived: DataFrame, reliability: str) -> DataFrame:
    """(root, id, confidence, epistemic, fate): what lowering a root does to each conclusion that rests on it.

    radius (root, node), derived (id, confidence, epistemic_tag).  Confidence
    is scaled and rounded to four places, the tag falls one step; below .15 the
    conclusion is quarantined.
    """
    below = radius.where("root != node").join(derived.select(F.col("id").alias("node"), "confidence", "epistemic_tag"), "node")
    names = F.array(*[F.lit(k) for k in sorted(fixed.EPISTEMIC_RANK, key=fixed.EPISTEMIC_RANK.get)])
    tag = F.get(names, F.least(F.lit(3), text.lookup(fixed.EPISTEMIC_RANK, F.col("epistemic_tag")) + 1))
    new = F.round(F.col("confidence") * fixed.RELIABILITY.get(reliability, 0.2), 4)
    gone = new < 0.15
    return below.select("root", F.col("node").alias("id"), F.when(gone, 0.05).otherwise(new).alias("confidence"), F.when(gone, "hypothesized").otherwise(tag).alias("epistemic"), F.when(gone, "quarantined").otherwise("demoted").alias("fate"))


def raise_impacts(moved: DataFrame, basis: DataFrame, decisions: DataFrame, open_impacts: DataFrame, criticality: DataFrame, now: float) -> DataFrame:
    """New decision impacts of moved bases (node_id, cause) that no unacknowledged impact covers."""
    met = moved.join(basis, "node_id").join(decisions.select(F.col("id").alias("decision_id"), "status", "reversible_until"), "decision_id").join(criticality.select(F.col("node").alias("node_id"), "score"), "node_id", "left")
    met = met.join(open_impacts.where("acknowledged_at is null").select("decision_id", F.col("basis_node").alias("node_id"), "cause"), ["decision_id", "node_id", "cause"], "left_anti")
    reversible = (F.col("reversible_until").isNull() | (F.col("reversible_until") > now)) & (F.col("status") != "executed")
    return met.select(made_id("imp", "decision_id", "node_id", "cause").alias("id"), "decision_id", F.col("node_id").alias("basis_node"), "cause", F.lit(now).alias("detected_at"), memory.severity(F.coalesce("score", F.lit(0.0)), F.col("weight"), F.col("cause"), reversible).alias("severity"), F.lit(None).cast("double").alias("acknowledged_at"))


def prior_failures(proposals: DataFrame, failures: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(proposal_id, failure_id, similarity) of live failures; candidates share a token."""
    mine = proposals.select("proposal_id", F.array_distinct(text.tokens(F.col("proposal"))).alias("a"))
    theirs = failures.where("superseded_by is null").select(F.col("id").alias("failure_id"), F.array_distinct(text.tokens(F.col("approach"))).alias("b"))
    met = mine.withColumn("t", F.explode("a")).join(theirs.withColumn("t", F.explode("b")), "t").groupBy("proposal_id", "failure_id").agg(F.count("*").alias("i"), F.first(F.size("a")).alias("na"), F.first(F.size("b")).alias("nb"))
    return met.select("proposal_id", "failure_id", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("similarity")).where(F.col("similarity") >= threshold)


def due(commitments: DataFrame, now: float) -> DataFrame:
    """Open commitments whose time has come, with the days they are late."""
    return commitments.where(F.col("status").isin("open", "due") & (F.col("due_at") <= now)).select("id", "claimant_id", "statement", ((F.lit(now) - F.col("due_at")) / fixed.DAY).alias("overdue_days"))


def converge(rows: DataFrame) -> DataFrame:
    """(prop_hash, operators, origins, agreed) over several packs' propositions (operator, source_ref, content)."""
    g = rows.groupBy(text.proposition_hash(F.col("content")).alias("prop_hash")).agg(F.countDistinct("operator").alias("operators"), F.countDistinct(text.origin_key(F.col("source_ref"))).alias("origins"))
    return g.withColumn("agreed", (F.col("operators") > 1) & (F.col("origins") > 1))


def sleep_plan(n: Column, interference: Column, hours: Column, confusable: Column, distant: Column) -> Column:
    """Phase of consolidation that is owed: rem, nrem or none."""
    p = memory.sleep_pressure(n, interference, hours)
    return F.when((p >= 4) & (distant > 0), "rem").when((p >= 1) & (confusable > 0), "nrem").otherwise("none")


def audit(store: Store) -> DataFrame:
    """(check, node, detail): every violation of the store's rules."""
    rank = lambda c: text.lookup(fixed.EPISTEMIC_RANK, F.col(c))
    made, edges, every = store.read("derived"), store.read("derivation_edge"), nodes(store)
    facts = edges.join(every.select(F.col("id").alias("parent_id"), F.col("confidence").alias("pc"), rank("epistemic").alias("pr")), "parent_id").groupBy("child_id").agg(F.min("pc").alias("pc"), F.max("pr").alias("pr"))
    held = made.join(facts, made["id"] == facts["child_id"])
    found = [
        held.where((F.col("confidence") > F.col("pc") + 1e-9) | (rank("epistemic_tag") < F.col("pr"))).select(F.lit("monotonic").alias("check"), F.col("id").alias("node"), F.lit("exceeds its parents").alias("detail")),
        made.where("kind = 'hypothesis' and coalesce(falsifier, '') = ''").select(F.lit("untestable_hypothesis"), "id", F.lit("no falsifier")),
        made.where("(kind = 'hypothesis') != (epistemic_tag = 'hypothesized')").select(F.lit("kind_tag_mismatch"), "id", F.col("epistemic_tag")),
        made.where("epistemic_tag in ('observed', 'reported')").join(edges.select(F.col("child_id").alias("id")), "id", "left_anti").select(F.lit("untraceable_fact"), "id", F.col("epistemic_tag")),
        edges.join(every.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.lit("orphan_edge"), "child_id", F.col("parent_id")),
        every.join(store.read("lexeme").select(F.col("node_id").alias("id")).distinct(), "id", "left_anti").where(F.size(text.tokens(F.col("content"))) > 0).select(F.lit("unindexed"), "id", F.col("partition")),
        store.read("lexeme").join(every.select(F.col("id").alias("node_id"), F.col("partition").alias("own")), "node_id").where("own != partition").select(F.lit("partition_disagrees"), "node_id", F.col("partition")).distinct(),
        edges.join(every.select(F.col("id").alias("child_id"), F.col("partition").alias("viewer")), "child_id").join(every.select(F.col("id").alias("parent_id"), F.col("partition").alias("owner")), "parent_id").join(visible(store).select("viewer", "owner"), ["viewer", "owner"], "left_anti").select(F.lit("flow_violation"), "child_id", F.col("owner")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def doctor(store: Store, **about) -> DataFrame:
    """(check, title, status, detail, remedy): one row per check, read-only; about: model, semantic, calibration, keyfile."""
    from provenspark.operators import diagnostics

    return diagnostics.run(store, **about)


def confusable(rows: DataFrame, near: int = 25, least: float = 0.6) -> DataFrame:
    """(a, b, similarity): texts of a partition written fewer than `near` rows apart, of different content, whose tokens overlap more than that.

    rows: id, partition, at, content.  Rows are numbered within a partition and
    met by number in blocks of `near`, so no row meets more than two blocks.
    """
    order = Window.partitionBy("partition").orderBy(F.col("at").desc(), "id")
    numbered = rows.select("id", "partition", "content", F.array_distinct(text.tokens(F.col("content"))).alias("t"), F.row_number().over(order).alias("rn")).withColumn("block", F.floor(F.col("rn") / near))
    one = numbered.select("partition", F.col("id").alias("a"), F.col("content").alias("ca"), F.col("t").alias("ta"), F.col("rn").alias("ra"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    two = numbered.select("partition", F.col("id").alias("b"), F.col("content").alias("cb"), F.col("t").alias("tb"), F.col("rn").alias("rb"), "block")
    met = one.join(two, ["partition", "block"]).where(f"rb > ra and rb < ra + {near} and ca != cb")
    return met.select("a", "b", text.jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") > least)


def schemas(rows: DataFrame, least: int = 3) -> DataFrame:
    """(schema, members, deltas): texts that differ only in their varying parts, from `least` of one form on; rows: id, content."""
    g = rows.withColumn("schema", text.schema_of(F.col("content"))).groupBy("schema").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("id", text.deltas_of(F.col("content")).alias("d")))).alias("deltas"))
    return g.where(F.col("members") >= least)


def verification_queue(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(id, priority): what to verify first; rows: id, score, reliability, credibility, dependents."""
    doubt = 1 - memory.admiralty(F.col("reliability"), F.col("credibility"))
    out = rows.select("id", F.round(F.col("score") * doubt * F.when(F.col("dependents") > 0, 1.0).otherwise(0.5), 4).alias("priority"))
    return out if most is None else out.orderBy(F.col("priority").desc(), "id").limit(most)


def quarantine(store: Store, most: int = 25) -> DataFrame:
    """(id, content, source_ref, trust, verdict, score, signals): untrusted evidence with what its screen said, newest first."""
    held = observations(store).where("trust != 'trusted'").select("id", "content", "source_ref", "trust", "observed_at")
    screens = store.read("write_screen").select(F.col("node_id").alias("id"), "verdict", "score", "signals")
    return held.join(screens, "id", "left").orderBy(F.col("observed_at").desc(), "id").limit(most).drop("observed_at")


def divergence(store: Store, now: float) -> DataFrame:
    """(who, held_node, truth_node, severity, direction): people who were told something that was superseded, and not what replaced it."""
    told = store.read("exposure")
    old = store.read("supersession").select("old_node", "new_node", "claim_class", F.col("at").alias("changed"))
    holds = sequences.retention(told.withColumnRenamed("node_id", "node"), F.lit(now))
    met = old.join(holds.select("who", F.col("node").alias("old_node"), "retrievability", "last"), "old_node")
    met = met.join(told.select("who", F.col("node_id").alias("new_node")).distinct(), ["who", "new_node"], "left_anti")
    present = met.join(store.read("exposure").where("channel = 'conversation'").select("who", F.col("node_id").alias("old_node"), F.lit(True).alias("present")).distinct(), ["who", "old_node"], "left")
    stale = memory.staleness(F.lit(now) - F.col("changed"), F.col("claim_class"))
    side = memory.stale_side(F.lit(now) - F.col("last"), F.coalesce("present", F.lit(False)), F.lit(now) - F.col("changed"), F.lit(1.0))
    return present.select("who", F.col("old_node").alias("held_node"), F.col("new_node").alias("truth_node"), F.round(memory.divergence_severity(F.col("retrievability"), stale), 6).alias("severity"), side.alias("direction"))


def tend(store: Store, now: float, grace: float = 0.0, partition: str | None = None) -> dict[str, DataFrame]:
    """One maintenance pass as independent plans, to be written or looked at by who runs it.

    Tiers, duplicates, confusable texts, schemas, compression, sleep phases,
    criticality, intentions whose time passed more than `grace` seconds ago,
    contextless texts, texts that wait for a vector, learned half-lives.
    """
    from provenspark.operators import record
    from provenspark.operators.context import compression_plan
    from provenspark.sources.store import intentions

    seen = observations(store)
    seen = seen if partition is None else seen.where(F.col("partition") == partition)
    state = step(states(store, now), "states")
    pairs = step(confusable(seen.select("id", "partition", F.col("observed_at").alias("at"), "content")), "confusable")
    rebuilt = seen.join(state.select(F.col("node").alias("id"), "tier"), "id").select("id", "claim_class", "tier", "content", F.lit(None).cast("string").alias("rebuilt"))
    by = seen.groupBy("partition").agg(F.count("*").alias("n"), F.max("observed_at").alias("last"))
    confused = pairs.join(seen.select(F.col("id").alias("a"), "partition"), "a").groupBy("partition").agg(F.count("*").alias("confusable"))
    owed = by.join(confused, "partition", "left").na.fill({"confusable": 0})
    phase = sleep_plan(F.col("n"), F.col("confusable") / F.greatest(F.col("n"), F.lit(1)), (F.lit(now) - F.col("last")) / 3600, F.col("confusable"), F.col("n") - F.col("confusable"))
    return {
        "tiers": state.select("node", "tier"),
        "duplicates": seen.groupBy("partition", "content_hash").agg(F.count("*").alias("copies"), F.min("id").alias("keep")).where("copies > 1"),
        "confusable": pairs,
        "schemas": schemas(seen.select("id", "content")),
        "compression": compression_plan(rebuilt),
        "sleep": owed.select("partition", phase.alias("phase")),
        "criticality": record.recompute_criticality(store, now)["criticality"],
        "expired": intentions(store).where((F.col("trigger_kind") == "time") & (F.col("status") == "pending") & (F.col("trigger_spec").cast("double") < now - grace)).select(F.col("id").alias("intention_id"), F.lit("expired").alias("status"), F.lit(now).alias("at")),
        "decontext": seen.where(text.needs_context(F.col("content"))).select("id", "content"),
        "queue": record.queue_depth(store),
        "half_lives": sequences.half_life(store.read("supersession")),
    }
