"""Batch recall: postings, lexical candidates, gate signals and ranked results for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenspark.functions import fixed, memory, text
from provenspark.sources.store import step

#: About as many nodes go in one list of those that queries of one kind have in common; parts that queries of one kind are dealt into.
LIST, SALTS = 1024, 8


def postings(nodes: DataFrame, id_col: str = "id", content: str = "content", partition: str = "partition") -> DataFrame:
    """(term, node, partition, tf): counts of a node's tokens over their Euclidean norm.

    The norm is taken inside the row, so one pass makes the postings without a shuffle.
    """

    def starts(tok):
        return F.filter(F.sequence(F.lit(1), F.size(tok)), lambda i: (i == 1) | (F.get(tok, i - 1) != F.get(tok, i - 2)))

    def runs(x):
        """Terms with their counts: where a run of the sorted tokens starts, and how far the next start is."""
        count = lambda at, i: (F.coalesce(F.get(x["at"], i + 1), F.size(x["tok"]) + 1) - at).cast("double")
        return F.transform(x["at"], lambda at, i: F.struct(F.get(x["tok"], at - 1).alias("term"), count(at, i).alias("c")))

    def weighted(terms):
        norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["c"] * t["c"]))
        return text.let(norm, lambda n: F.transform(terms, lambda t: F.struct(t["term"].alias("term"), (t["c"] / n).alias("tf"))))

    # bound values: an expression named in a lambda would be worked out again for each element; and an outer explode,
    # since for an inner one the optimiser works the array out twice more to filter empty ones
    found = text.let(F.sort_array(text.tokens(F.col(content))), lambda tok: F.when(F.size(tok) > 0, text.let(text.let(F.struct(tok.alias("tok"), starts(tok).alias("at")), runs), weighted)))
    rows = nodes.select(F.col(id_col).alias("node"), F.col(partition).alias("partition"), F.explode_outer(found).alias("t"))
    return rows.select("t.term", "node", "partition", "t.tf").where("term is not null")


def term_idf(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf); n_docs holds one number n."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs)).select("term", "df", text.idf(F.col("df"), F.col("n")).alias("idf"))  # one row is broadcast


def query_terms(queries: DataFrame, id_col: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, term, n_terms) of distinct tokens."""
    terms = F.array_distinct(text.tokens(F.col(query)))
    return queries.select(F.col(id_col).alias("query_id"), F.size(terms).alias("n_terms"), F.explode(terms).alias("term"))


def sought(post: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of terms that some query has; frequencies of those terms are the same there."""
    return post.join(terms.select("term").distinct(), "term", "left_semi")


def lexical_candidates(terms: DataFrame, post: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, node, score): coverage of the query's terms times the summed weight over the query's best.

    Postings are cut to the queries' terms by a semi join before anything is
    multiplied out; weights are summed map-side by query and node.
    """
    wanted = terms.select("term").distinct().join(idf, "term")
    hits = post.join(wanted, "term").join(terms, "term")
    summed = hits.groupBy("query_id", "node", "n_terms").agg(F.sum(F.col("tf") * F.greatest("idf", F.lit(0.05))).alias("raw"), F.count("*").alias("matched"))
    top = summed.groupBy("query_id").agg(F.max("raw").alias("top"))
    return summed.join(top, "query_id").select("query_id", "node", (F.col("raw") / F.col("top") * F.col("matched") / F.col("n_terms")).alias("score"))


def coverage(terms: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, coverage): share of a query's distinct terms that some node holds."""
    known = terms.join(post.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    return known.groupBy("query_id").agg((F.count("known") / F.first("n_terms")).alias("coverage"))


def gap_terms(terms: DataFrame, post: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, missing): up to four terms that no node holds, in order."""
    missing = terms.join(post.select("term").distinct(), "term", "left_anti")
    return missing.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("term")), 1, most).alias("missing"))


def background(hits: DataFrame) -> DataFrame:
    """(query_id, background): mean of the lowest three fifths of a query's similarities; null under three."""
    order = Window.partitionBy("query_id").orderBy("sim", "node")
    n = F.count("*").over(Window.partitionBy("query_id"))
    ranked = hits.withColumn("rn", F.row_number().over(order)).withColumn("n", n)
    low = ranked.where("rn <= greatest(1, cast(floor(0.6 * n) as int))").groupBy("query_id").agg(F.avg("sim").alias("mean"), F.first("n").alias("n"))
    return low.select("query_id", F.when(F.col("n") >= 3, F.col("mean")).alias("background"))


def conflict(scores: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, n, best, conflict) over each query's best dozen scores."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    top = scores.withColumn("rn", F.row_number().over(order)).where(f"rn <= {most}")
    best = F.max("score").over(Window.partitionBy("query_id"))
    near = top.withColumn("best", best).withColumn("near", (F.col("best") - F.col("score") <= fixed.CONFLICT_BAND * F.col("best")).cast("int"))
    ratio = F.when((F.count("*") < 2) | (F.max("best") <= 0), 0.0).otherwise((F.sum("near") - 1) / (F.count("*") - 1))
    return near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("best").alias("best"), ratio.alias("conflict"))


def group_cap(ranked: DataFrame, group: str, per_group: int, take: int) -> DataFrame:
    """The first `take` results of each query with at most per_group of a group; what is over the cap fills up."""
    within = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    order = Window.partitionBy("query_id").orderBy((F.col("within") > per_group).cast("int"), "rank")
    return ranked.withColumn("within", within).withColumn("place", F.row_number().over(order)).where(F.col("place") <= take).drop("within")


def contenders(scored: DataFrame, group: str, per_group: int, most: int) -> DataFrame:
    """The rows (query_id, node, score, ...) that group_cap may choose `most` of or that may rank first, however ties are broken.

    A row within its group's cap is chosen only if fewer than `most` such rows
    score higher, one over the cap only if fewer than `most` rows at all do.
    Ties stay in whole, so ranks among the rows left, and their places within
    groups, are those among all rows as far as `most`.
    """
    whole, own = Window.partitionBy("query_id").orderBy(F.col("score").desc()), Window.partitionBy("query_id", group).orderBy(F.col("score").desc())
    near = scored.withColumn("_g", F.rank().over(own)).where(F.col("_g") <= max(most, per_group))
    near = near.withColumn("_in", (F.row_number().over(own) <= per_group).cast("int")).withColumn("_all", F.rank().over(whole))
    upto, same = F.sum("_in").over(whole.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("_in").over(Window.partitionBy("query_id", "score"))
    near = near.withColumn("_over", upto - same)
    return near.where((F.col("_all") <= most) | ((F.col("_g") <= per_group) & (F.col("_over") < most))).drop("_g", "_in", "_all", "_over")


def token_budget(ranked: DataFrame, budget: int, content: str = "content") -> DataFrame:
    """Results up to and with the one that reaches the budget of quarter characters."""
    cost = F.greatest(F.lit(1), F.floor(F.length(content) / 4))
    before = F.sum(cost).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).drop("before")


def as_of(t: Column) -> Column:
    """Rows that were known and valid at a time."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t)) & ((F.col("observed_at") <= t) | F.col("valid_from").isNotNull())


def bridge(cands: DataFrame, mentioned: DataFrame, mention: DataFrame, relation: DataFrame, weight: float = 0.55, hop: float = 0.7, form: Callable[[str], Column] = F.col) -> DataFrame:
    """Candidates raised by entities: mentions of a query's entities at weight, of related ones a hop lower; the larger score stays.

    Queries of the same entities are one kind, and nodes are found by kind; a
    query's candidates among them are looked up, and all others are only multiplied
    out at the end.  form, which keeps the order of scores, is worked out before that.
    """
    near = mentioned.select("query_id", "entity_id", F.lit(weight).alias("w"))
    ends = relation.select(F.col("src").alias("entity_id"), F.col("dst").alias("other")).unionByName(relation.select(F.col("dst").alias("entity_id"), F.col("src").alias("other"))).distinct()
    far = near.join(ends, "entity_id").select("query_id", F.col("other").alias("entity_id"), (F.col("w") * hop).alias("w"))
    best = near.unionByName(far).groupBy("query_id", "entity_id").agg(F.max("w").alias("w"))
    kind = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "w"))).alias("es"))
    asked = step(kind.withColumn("qk", F.to_json("es")), "asked")
    held = asked.select("qk", "es").dropDuplicates(["qk"]).select("qk", F.inline("es"))
    lifted = held.join(mention.select("entity_id", F.col("node_id").alias("node")), "entity_id").groupBy("qk", "node").agg(F.max("w").alias("score"))
    lifted = step(lifted.withColumn("score", form("score")), "lifted")
    known = lifted.select("qk", F.col("node").alias("n"), F.col("score").alias("w"), F.lit(True).alias("hit"))
    given = cands.select(F.col("query_id").alias("q"), "node", "score").join(asked.select("query_id", "qk"), F.expr("q <=> query_id"), "left").drop("query_id").withColumnRenamed("q", "query_id")
    met = given.join(known.withColumnRenamed("qk", "k"), F.expr("qk = k and node <=> n"), "left").select("query_id", "node", form("score").alias("score"), "w", "hit")
    raised = step(met.groupBy("query_id", "node").agg(F.max(F.greatest("score", "w")).alias("score"), F.max("hit").alias("hit")), "raised")
    nodes = lambda: F.when(F.max(F.col("node").isNull()), F.array_append(F.collect_list("node"), None)).otherwise(F.collect_list("node"))
    hits = raised.where("hit").groupBy("query_id").agg(nodes().alias("hits")).withColumnRenamed("query_id", "q")
    size = lifted.groupBy("qk", "score").agg(F.ceil(F.count("*") / LIST).alias("parts"))
    lists = lifted.join(size, ["qk", "score"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).groupBy("qk", "score", "part").agg(nodes().alias("nodes"))
    lists = step(lists.select("qk", "score", "nodes"), "lists").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = asked.select("query_id", "qk", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int").alias("salt"))  # most queries may be of one kind
    every = dealt.join(hits, F.expr("query_id <=> q"), "left").join(lists, ["qk", "salt"])
    rest = every.select("query_id", F.explode(F.when(F.col("hits").isNull(), F.col("nodes")).otherwise(F.array_except("nodes", "hits"))).alias("node"), "score")
    return raised.select("query_id", "node", "score").unionByName(rest)


def spread(cands: DataFrame, assoc: DataFrame, succession: DataFrame | None = None, damping: float = 0.35) -> DataFrame:
    """Candidates with what one hop of association adds to them."""
    links = assoc.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(damping).alias("damp"), F.col("weight").alias("w"))
    if succession is not None:
        links = links.unionByName(succession.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(damping / 2).alias("damp"), F.least(F.lit(1.0), F.col("count") / 5).alias("w")))
    # the score is damped before it is weighed: products of three numbers depend on their order
    given = cands.join(links, "node").select("query_id", F.col("to").alias("node"), (F.col("score") * F.col("damp") * F.col("w")).alias("score"))
    return cands.select("query_id", "node", "score").unionByName(given).groupBy("query_id", "node").agg(F.sum("score").alias("score"))


def scope(queries: DataFrame, visible: DataFrame) -> DataFrame:
    """(viewer, owner, level) for the viewers that ask."""
    return queries.select("viewer").distinct().join(visible, "viewer").select("viewer", "owner", "level")


def scoped_terms(held: DataFrame, seen: DataFrame) -> DataFrame:
    """(viewer, term, df): how many of the postings of a term each viewer may see; counts by partition come first."""
    by_owner = held.groupBy(F.col("partition").alias("owner"), "term").agg(F.count("*").alias("n"))
    return by_owner.join(seen, "owner").groupBy("viewer", "term").agg(F.sum("n").alias("df"))


def scoped_sizes(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """(viewer, n): nodes of the partitions that each viewer may see, whatever their tier."""
    return nodes.groupBy(F.col("partition").alias("owner")).agg(F.count("*").alias("n")).join(seen, "owner").groupBy("viewer").agg(F.sum("n").alias("n"))


def scoped_candidates(terms: DataFrame, live: DataFrame, seen: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, node, score) as lexical_candidates, from what each query's viewer may see alone.

    terms (query_id, viewer, term, n_terms), live postings (term, node, partition, tf).
    """
    weight = scoped_terms(live, seen).join(sizes, "viewer").select("viewer", "term", F.greatest(text.idf(F.col("df"), F.greatest("n", F.lit(1))), F.lit(0.05)).alias("w"))
    hits = live.join(terms.join(weight, ["viewer", "term"]), "term").join(seen.select("viewer", F.col("owner").alias("partition")), ["viewer", "partition"])
    summed = hits.groupBy("query_id", "node", "n_terms").agg(F.sum(F.col("tf") * F.col("w")).alias("raw"), F.count("*").alias("matched"))
    top = summed.groupBy("query_id").agg(F.max("raw").alias("top"))
    return summed.join(top, "query_id").select("query_id", "node", (F.col("raw") / F.col("top") * F.col("matched") / F.col("n_terms")).alias("score"))


def blended(cands: DataFrame, hits: DataFrame, floor: float = fixed.SIMILARITY_FLOOR, ceiling: float = 1.0) -> DataFrame:
    """Candidates with semantic hits (query_id, node, sim): the greater of the score and the similarity's level in the encoder's range."""
    near = hits.select("query_id", "node", memory.level(F.col("sim"), floor, ceiling).alias("score"))
    return cands.select("query_id", "node", "score").unionByName(near).groupBy("query_id", "node").agg(F.max("score").alias("score"))


def densities(hits: DataFrame, floor: float = fixed.SIMILARITY_FLOOR, ceiling: float = 1.0) -> DataFrame:
    """(query_id, density) of the best semantic hit over the background of the others."""
    best = hits.groupBy("query_id").agg(F.max("sim").alias("best")).join(background(hits), "query_id", "left")
    return best.select("query_id", memory.density(F.col("best"), F.col("background"), floor, ceiling=ceiling).alias("density"))


def surroundings(nodes: DataFrame, assoc: DataFrame, mention: DataFrame, edges: DataFrame, derived: DataFrame) -> DataFrame:
    """(node, recollection): how much surrounds each node: an episode of more than one, a period, a source, a standalone copy, neighbours.

    nodes (id, episode_id, period_id, source_ref).
    """
    shared = nodes.where("episode_id is not null").groupBy("episode_id").agg((F.count("*") > 1).alias("_shared"))
    ends = assoc.select(F.col("src").alias("id")).unionByName(mention.select(F.col("node_id").alias("id"))).groupBy("id").agg(F.count("*").alias("_near"))
    copies = edges.join(derived.where("kind = 'decontext'").select(F.col("id").alias("child_id")), "child_id").select(F.col("parent_id").alias("id"), F.lit(True).alias("_alone")).distinct()
    met = nodes.select("id", "episode_id", "period_id", "source_ref").join(shared, "episode_id", "left").join(ends, "id", "left").join(copies, "id", "left")
    no = F.lit(False)
    sourced = F.coalesce((F.col("source_ref") != "") & (F.col("source_ref") != "inline"), no)
    return met.select(F.col("id").alias("node"), memory.recollection(F.coalesce("_shared", no), F.col("period_id").isNotNull(), sourced, F.coalesce("_alone", no), F.coalesce("_near", F.lit(0))).alias("recollection"))


def answerable(queries: DataFrame, entities: DataFrame, seen: DataFrame) -> DataFrame:
    """(query_id, has_answer): whether a visible entity is of the kind asked for; null where nothing is asked for or there is no entity at all."""
    asked = queries.select("query_id", "viewer", text.answer_type(F.col("query")).alias("kind"))
    held = entities.select(F.col("partition").alias("owner"), "kind").distinct().join(seen, "owner").select("viewer", "kind").distinct().withColumn("held", F.lit(True))
    some = entities.agg((F.count("*") > 0).alias("some"))  # one row
    met = asked.join(held, ["viewer", "kind"], "left").join(F.broadcast(some))
    return met.select("query_id", F.when(F.col("kind").isNotNull() & F.col("some"), F.coalesce("held", F.lit(False))).alias("has_answer"))


def knew_once(terms: DataFrame, pruned: DataFrame, seen: DataFrame) -> DataFrame:
    """(query_id, node): the pruned node that holds most of a query's terms, at least half; of equals the smallest."""
    hits = pruned.join(terms, "term").join(seen.select("viewer", F.col("owner").alias("partition")), ["viewer", "partition"])
    held = hits.groupBy("query_id", "node", "n_terms").agg(F.count("*").alias("matched")).where("2 * matched >= n_terms")
    return held.groupBy("query_id").agg(F.min_by("node", F.struct(-F.col("matched"), F.col("node"))).alias("node"))


#: What recall looks at besides nodes, states and visibility; every table may be left out.
SIGNALS = ("post", "hits", "mentioned", "mention", "relation", "assoc", "succession", "recollection", "entities", "criticality", "grades", "half_lives", "parents")


def recall(
    queries: DataFrame, nodes: DataFrame, states: DataFrame, visible: DataFrame, absences: DataFrame, now: float,
    budget: int = 5, per_group: int = 2, group: str = "source_ref", tokens: int | None = None, at: float | None = None,
    most_affect: float = 1.01, inferred: bool = True, typed: bool = True, floor: float = fixed.SIMILARITY_FLOOR, ceiling: float = 1.0, **signals: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(answers, results) for a table of queries (query_id, query, viewer).

    nodes (id, partition, content, source_ref, at, claim_class, epistemic,
    kind and where known valid_from, valid_to, affect, reliability,
    credibility), states (node, r, tier, suppressed), visible (viewer, owner,
    level), absences (partition, query, expires_at, searched_at).  Every number
    that reaches an answer - documents, frequencies, coverage, the best score -
    counts what the query's viewer may see and nothing else.

    signals, by the names in SIGNALS: stored postings, semantic hits (query_id,
    node, sim), entities a query mentions with mentions and relations,
    associations and successions, recollection by node, entities, criticality,
    source grades, learned half-lives, derivation edges.  at: the time whose
    knowledge is asked for.  group: column of nodes that the cap spreads over.
    tokens: budget of quarter characters.  typed: whether the kind of answer
    and identifiers weigh.  answers has a row per query; a blank query knows
    nothing; results holds the ranked rows of queries that know something.
    Scoring is pure: reinforcement is a separate append of review events.
    """
    if unknown := set(signals) - set(SIGNALS):
        raise TypeError(f"unknown signals {sorted(unknown)}")
    has = signals.get
    seen = scope(queries, visible)
    terms = query_terms(queries).join(queries.select("query_id", "viewer"), "query_id")
    post = has("post") if has("post") is not None else postings(nodes)
    # four tables are written once and read by all that follows: postings of the queries' terms, scored candidates without texts, the few that may be shown, answers
    held = step(sought(post, terms).join(states.select("node", "tier"), "node"), "held")
    live, gone = held.where("tier != 'pruned'").drop("tier"), held.where("tier = 'pruned'").drop("tier")
    cands = scoped_candidates(terms, live, seen, scoped_sizes(nodes, seen))
    hits = has("hits")
    if hits is not None:
        hits = hits.join(nodes.select(F.col("id").alias("node"), F.col("partition").alias("owner")), "node").join(queries.select("query_id", "viewer"), "query_id").join(seen.select("viewer", "owner"), ["viewer", "owner"]).select("query_id", "node", "sim")
        cands = blended(cands, hits, floor, ceiling)
    if has("mentioned") is not None:
        cands = bridge(cands, has("mentioned"), has("mention"), has("relation"))
    if has("assoc") is not None:
        cands = spread(cands, has("assoc"), has("succession"))

    own = {c: F.col(c) if c in nodes.columns else F.lit(None).cast(k).alias(c) for c, k in (("valid_from", "double"), ("valid_to", "double"), ("affect", "double"), ("surprise", "double"), ("open_loop", "boolean"), ("acquisition_cost", "double"), ("reliability", "string"), ("credibility", "int"))}
    facts = nodes.select(F.col("id").alias("node"), F.col("partition").alias("owner"), F.col("content"), F.col("at").alias("observed_at"), "claim_class", "epistemic", "kind", F.col("source_ref"), *([F.col(group)] if group != "source_ref" else []), *own.values())
    # what weighs in a text is looked up once a node; texts themselves meet only the few rows that may be shown
    traits = facts.select("node", "owner", *sorted({"epistemic", "kind", group} - {"owner", "node"}), *own, text.identifiers(F.col("content")).alias("ids"), text.shapes(F.col("content")).alias("shapes"))
    asked = queries.select("query_id", "viewer", text.answer_type(F.col("query")).alias("want"), text.identifiers(F.col("query")).alias("asked"))
    met = cands.join(traits, "node").join(asked, "query_id").join(seen, ["viewer", "owner"]).where("level = 'full' or kind in ('summary', 'abstraction', 'community')")
    met = met.join(states, "node").where("tier != 'pruned'").where(F.coalesce("affect", F.lit(0.0)) <= most_affect)
    if at is not None:
        met = met.where(as_of(F.lit(at)))
    if not inferred:
        met = met.where(F.col("epistemic").isin("observed", "reported"))
    if has("criticality") is not None:
        met = met.join(has("criticality").select("node", F.col("score").alias("weight")), "node", "left")
    weight = F.coalesce("weight", F.lit(0.0)) if has("criticality") is not None else F.lit(0.0)
    score = F.col("score") * F.when(F.coalesce("suppressed", F.lit(False)), fixed.SUPPRESSED).otherwise(1.0)
    score = score * memory.salience(F.col("r"), F.coalesce("surprise", F.lit(0.0)), F.coalesce("open_loop", F.lit(False)), F.coalesce("acquisition_cost", F.lit(0.0)), weight)
    if typed:
        score = score * text.fitting(F.col("shapes"), F.col("want")) * text.exactness(F.col("ids"), F.col("asked"))
    # scores that agree to nine places are equal, however the sums were ordered
    scored = step(met.select("query_id", "node", F.round(score, 9).alias("score"), "r", *([group] if group not in ("query_id", "node", "r") else [])), "scored")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "content", "node")
    few = contenders(scored, group, per_group, fixed.MOST_RESULTS).select("query_id", "node", "score", "r").distinct().join(facts, "node")
    ranked = step(few.withColumn("rank", F.row_number().over(order)), "ranked")

    best = ranked.where("rank = 1").select("query_id", "node", F.col("r").alias("best_r"))
    if has("recollection") is not None:
        best = best.join(has("recollection"), "node", "left")
    best = best.select("query_id", "best_r", (F.coalesce("recollection", F.lit(0.0)) if has("recollection") is not None else F.lit(0.25)).alias("recollection"))
    known = terms.join(scoped_terms(held, seen).select("viewer", "term", F.lit(1).alias("known")), ["viewer", "term"], "left")
    covered = known.groupBy("query_id").agg((F.count("known") / F.first("n_terms")).alias("coverage"), F.slice(F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("term")))), 1, 4).alias("missing"))
    gathered = queries.select("query_id", "query", "viewer").join(covered, "query_id", "left").join(conflict(scored), "query_id", "left").join(best, "query_id", "left")
    gathered = gathered.join(densities(hits, floor, ceiling), "query_id", "left") if hits is not None else gathered.withColumn("density", F.lit(0.0))
    gathered = gathered.join(answerable(queries, has("entities"), seen), "query_id", "left") if has("entities") is not None else gathered.withColumn("has_answer", F.lit(None).cast("boolean"))
    gathered = gathered.na.fill({"coverage": 0.0, "n": 0, "best": 0.0, "conflict": 0.0, "best_r": 0.0, "recollection": 0.0, "density": 0.0}).withColumn("best", F.least(F.lit(1.0), "best"))
    familiarity = F.greatest("coverage", "density")
    blank = F.size(F.array_distinct(text.tokens(F.col("query")))) == 0
    state = F.when(blank, "dont_know").otherwise(memory.gate(F.col("n"), familiarity, F.col("best"), F.col("best_r"), F.col("conflict"), F.col("recollection"), F.col("has_answer")))
    told = gathered.withColumn("state", state).withColumn("familiarity", familiarity).join(absent(queries, absences, now), "query_id", "left").join(knew_once(terms, gone, seen).withColumnRenamed("node", "once"), "query_id", "left")
    final = (
        F.when(F.col("absent").isNotNull() & (F.col("state") != "know") & ~blank, "searched_and_absent")
        .when((F.col("state") == "dont_know") & F.col("once").isNotNull(), "knew_once")
        .otherwise(F.col("state"))
    )
    answers = step(told.withColumn("state", final), "answers")

    most = min(max(1, budget), fixed.MOST_RESULTS)
    take = F.when(F.col("state") == "tip_of_tongue", min(most + 2, fixed.MOST_RESULTS)).when(F.col("state") == "searched_and_absent", 2).otherwise(most)
    open_ = ranked.join(answers.where("state not in ('dont_know', 'knew_once')").select("query_id", "state", take.alias("take")), "query_id")
    shown = group_cap(open_, group, per_group, fixed.MOST_RESULTS).where("place <= take").withColumn("rank", F.col("place"))
    if tokens is not None:
        shown = token_budget(shown, tokens)
    if has("grades") is not None:
        latest = has("grades").select("source_ref", F.col("reliability").alias("_rel"), F.col("credibility").alias("_cred"))
        shown = shown.join(latest, "source_ref", "left").withColumn("reliability", F.coalesce("_rel", "reliability")).withColumn("credibility", F.coalesce("_cred", "credibility"))
    learned = None
    if has("half_lives") is not None:
        shown = shown.join(has("half_lives").select("claim_class", "half_life"), "claim_class", "left")
        learned = F.col("half_life")
    aged = memory.staleness(F.lit(now) - F.col("observed_at"), F.col("claim_class"), learned)
    columns = ["query_id", "rank", "node", F.round("score", 6).alias("score"), "content", "source_ref", "epistemic", F.round(aged, 6).alias("staleness"), F.round("r", 6).alias("retrievability"), "claim_class", "reliability", "credibility"]
    results = shown.select(*columns)
    faded = answers.where("state = 'knew_once'").select("query_id", F.col("once").alias("node")).join(facts, "node")
    results = results.unionByName(faded.select("query_id", F.lit(1).alias("rank"), "node", F.lit(0.0).alias("score"), F.lit("").alias("content"), "source_ref", "epistemic", F.lit(1.0).alias("staleness"), F.lit(0.0).alias("retrievability"), "claim_class", "reliability", "credibility"))
    if has("parents") is not None:
        results = results.join(has("parents").groupBy(F.col("child_id").alias("node")).agg(F.array_sort(F.collect_set("parent_id")).alias("parents")), "node", "left")
    return answers.select("query_id", "state", F.col("n").alias("candidates"), F.round("best", 6).alias("best"), F.round("coverage", 6).alias("coverage"), F.round("conflict", 6).alias("conflict"), F.round("recollection", 6).alias("recollection"), F.round("familiarity", 6).alias("familiarity"), F.when(F.col("state") == "dont_know", F.col("missing")).alias("missing"), "absent"), results


def absent(queries: DataFrame, absences: DataFrame, now: float) -> DataFrame:
    """(query_id, absent): the newest unexpired recorded absence that covers a query.

    Absences with a partition count for queries of that viewer only.
    Candidates share a term; a query is covered where its terms are all in the
    absence or their overlap is over a half.
    """
    scoped = "partition" in absences.columns and "viewer" in queries.columns
    live = absences.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.col("query").alias("absent"), "searched_at", F.array_distinct(text.tokens(F.col("query"))).alias("theirs"), *([F.col("partition").alias("viewer")] if scoped else []))
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("mine"), *(["viewer"] if scoped else []))
    met = asked.withColumn("t", F.explode("mine")).join(live.withColumn("t", F.explode("theirs")), ["t", "viewer"] if scoped else "t").drop("t").dropDuplicates(["query_id", "absent", "searched_at"])
    covered = met.where((text.jaccard(F.col("mine"), F.col("theirs")) > 0.5) | (F.size(F.array_except("mine", "theirs")) == 0))
    return covered.groupBy("query_id").agg(F.max(F.struct("searched_at", "absent"))["absent"].alias("absent"))


def counter_evidence(questions: DataFrame, notes: DataFrame, replaced: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(query_id, node, strength): notes that share terms with what a question takes for granted and deny or oppose it.

    questions (query_id, query), notes (node, content).  A denial counts by the
    share of the premise's terms it has, an opposed word a fifth more.  replaced
    (old_node, new_node): what superseded a note that shares the premise counts
    against it in full.
    """
    asked = questions.select("query_id", text.presupposition(F.col("query")).alias("p"))
    asked = asked.select("query_id", "p", text.counter_terms(F.col("p")).alias("pt"), text.polarity_flip(F.col("p")).alias("flips"), text.negated(F.col("p")).alias("pn"))
    asked = asked.withColumn("qk", F.to_json(F.struct("pt", "flips", "pn")))
    told = notes.select("node", text.counter_terms(F.col("content")).alias("nt"), text.negated(F.col("content")).alias("nn"))
    told = told.withColumn("nk", F.to_json(F.struct("nt", "nn")))
    # questions of the same words, and notes of the same, are one kind: kinds are held against each other, rows are only multiplied out
    ask, tell = asked.select("qk", "pt", "flips", "pn").dropDuplicates(["qk"]), told.select("nk", "nt", "nn").dropDuplicates(["nk"])
    shared = ask.select("qk", F.explode("pt").alias("t")).join(tell.select("nk", F.explode("nt").alias("t")), "t").groupBy("qk", "nk").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    met = shared.join(ask, "qk").join(tell, "nk")
    share = F.col("shared") / F.size("pt")
    strength = F.greatest(F.when(F.col("pn") != F.col("nn"), share).otherwise(0.0), F.when(F.arrays_overlap("nt", "flips"), F.least(F.lit(1.0), share + 0.2)).otherwise(0.0))
    kinds = step(met.select("qk", "nk", F.round(strength, 6).alias("strength")), "kinds")
    every = lambda pairs: asked.select("query_id", "qk").join(pairs, "qk").join(told.select("node", "nk"), "nk")
    out = every(kinds.where("strength > 0")).select("query_id", "node", "strength")
    twice = lambda df, key: not df.groupBy(key).count().where("count > 1").isEmpty()
    if replaced is None and not twice(asked, "query_id") and not twice(told, "node"):
        return out  # a pair occurs once
    if replaced is not None:
        newer = every(kinds).select("query_id", F.col("node").alias("old_node")).join(replaced.select("old_node", "new_node"), "old_node").select("query_id", F.col("new_node").alias("node"), F.lit(1.0).alias("strength"))
        out = out.unionByName(newer)
    return out.groupBy("query_id", "node").agg(F.max("strength").alias("strength"))
