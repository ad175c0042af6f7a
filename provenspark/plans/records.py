"""Queries over what is recorded: claims, promises, decisions, grades, periods, streams of access, fusion and scoped recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenspark.functions import fixed, memory, text
from provenspark.operators import caches, record, retrieval
from provenspark.plans.graphs import EDGES, basis, edges
from provenspark.plans.registry import query, rounded
from provenspark.plans.texts import documents, toks
from provenspark.sources.store import current

DEPTHS = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CHANNEL_DEPTH.items()) + f" ELSE {fixed.OTHER_DEPTH} END"

CLAIMS = """cl AS (SELECT l_suppkey AS who, l_orderkey AS node, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'refuted' END AS outcome FROM lineitem),
cm AS (SELECT o_custkey % 10 + 1 AS who, o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 'kept' WHEN 'P' THEN 'broken' ELSE 'open' END AS status FROM orders),
oc AS (SELECT who, (outcome = 'confirmed')::INT AS ok FROM cl WHERE outcome IS NOT NULL UNION ALL SELECT who, (status = 'kept')::INT FROM cm WHERE status <> 'open'),
tr AS (SELECT who, sum(ok) AS good, sum(1 - ok) AS bad FROM oc GROUP BY who),
gr AS (SELECT who, CASE WHEN acc >= 0.9 THEN 'A' WHEN acc >= 0.75 THEN 'B' WHEN acc >= 0.6 THEN 'C' WHEN acc >= 0.4 THEN 'D' ELSE 'E' END AS g FROM (SELECT *, (good + 1) / (good + bad + 2) AS acc FROM tr WHERE good + bad >= 3))"""


def spoken(t):
    claim = t.lineitem.select(F.col("l_suppkey").alias("claimant_id"), F.col("l_orderkey").alias("node_id"), F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "refuted").alias("outcome"))
    promise = t.orders.select((F.col("o_custkey") % 10 + 1).alias("claimant_id"), F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderstatus") == "F", "kept").when(F.col("o_orderstatus") == "P", "broken").otherwise("open").alias("status"))
    return claim, promise


@query("claim_outcomes", f"WITH {CLAIMS} SELECT who AS claimant_id, good::BIGINT AS good, bad::BIGINT AS bad FROM tr")
def _(t):
    return record.outcomes(*spoken(t))


@query("learned_grades", f"WITH {CLAIMS}, th AS (SELECT DISTINCT who, node % 7 AS ref FROM (SELECT who, node FROM cl UNION SELECT who, node FROM cm)) SELECT ref AS source_ref, who AS claimant_id, g AS reliability, (ascii(g) - 64)::INT AS credibility FROM th JOIN gr USING (who)")
def _(t):
    return record.learned_grades(*spoken(t), t.orders.select(F.col("o_orderkey").alias("node_id"), (F.col("o_orderkey") % 7).alias("source_ref")))


@query("commitments_current", "SELECT o_orderkey AS id, coalesce(arg_max(l_returnflag, l_linenumber * 1e9 + l_extendedprice), 'open') AS status, arg_max(l_linestatus, l_linenumber * 1e9 + l_extendedprice) AS note FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("note"))
    happened = t.lineitem.select(F.col("l_orderkey").alias("commitment_id"), F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("note"), (F.col("l_linenumber") * 1e9 + F.col("l_extendedprice")).alias("at"))
    return current(rows, happened, "commitment_id", ["status", "note"])


@query("current_grades", """WITH a AS (SELECT l_suppkey AS s, arg_max({'g': substr('ABCDEF', l_linenumber % 6 + 1, 1), 'c': l_partkey % 6 + 1}, l_orderkey * 100 + l_linenumber) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey AS source_ref, coalesce(x.g, 'F') AS reliability, coalesce(x.c, 6)::INT AS credibility FROM supplier LEFT JOIN a ON s = s_suppkey""")
def _(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("source_ref"), F.lit("F").alias("reliability"), F.lit(6).alias("credibility"))
    letter = F.substring(F.lit("ABCDEF"), (F.col("l_linenumber") % 6 + 1).cast("int"), F.lit(1))
    told = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("source_ref"), letter.alias("reliability"), (F.col("l_partkey") % 6 + 1).cast("int").alias("credibility"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("assessed_at"))
    return record.current_grades(rows, told).select("source_ref", "reliability", "credibility")


@query("decision_refusals", """WITH d AS (SELECT o_orderkey AS id, l_partkey AS b FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 30) ON l_orderkey = o_orderkey),
g AS (SELECT id, count(b) AS n, count(p_partkey) AS k FROM d LEFT JOIN part ON p_partkey = b AND p_size <= 45 GROUP BY id) SELECT id, CASE WHEN n = 0 THEN 'no basis' WHEN k < n THEN 'unknown basis' END AS refused FROM g""")
def _(t):
    because = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("because"))
    rows = t.orders.select(F.col("o_orderkey").alias("id")).join(because, "id", "left")
    return record.checked_bases(rows, t.part.where("p_size <= 45").select(F.col("p_partkey").alias("id")))


@query("effective_criticality", f"""WITH {EDGES}, st AS (SELECT 'ord_' || o_orderkey AS node, (o_orderkey % 100) / 200.0 AS score FROM orders UNION ALL SELECT 'cus_' || c_custkey, (c_custkey % 10) / 20.0 FROM customer),
de AS (SELECT node_id AS node, count(*) AS n FROM basis WHERE substr(decision_id, 5)::BIGINT % 9 <> 0 GROUP BY 1), dp AS (SELECT parent_id AS node, count(*) AS n FROM edges GROUP BY 1),
every AS (SELECT node FROM st UNION SELECT node FROM de UNION SELECT node FROM dp)
SELECT node, round(greatest(coalesce(score, 0), CASE WHEN de.n > 0 THEN least(1.0, 0.6 + 0.15 * (de.n - 1)) WHEN dp.n > 0 THEN least(0.5, 0.15 * dp.n) ELSE 0 END)::DOUBLE, 6) AS score FROM every LEFT JOIN st USING (node) LEFT JOIN de USING (node) LEFT JOIN dp USING (node)""")
def _(t):
    one = t.orders.select(F.concat(F.lit("ord_"), "o_orderkey").alias("node"), (F.col("o_orderkey") % 100 / 200.0).alias("score"))
    two = t.customer.select(F.concat(F.lit("cus_"), "c_custkey").alias("node"), (F.col("c_custkey") % 10 / 20.0).alias("score"))
    b = basis(t)
    status = F.when(F.substring("decision_id", 5, 20).cast("long") % 9 == 0, "reversed").otherwise("standing")
    decision = b.select(F.col("decision_id").alias("id"), status.alias("status")).distinct()
    return record.effective_criticality(one.unionByName(two), edges(t), b, decision).withColumn("score", F.round("score", 6))


@query("urgent_impacts", "SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount * 10 >= 0.5 AND l_returnflag <> 'A' AND o_orderstatus <> 'F' AND (o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1996-01-01')")
def _(t):
    found = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("decision_id"), (F.col("l_discount") * 10).alias("severity"), F.when(F.col("l_returnflag") == "A", 1.0).alias("acknowledged_at"))
    decision = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "executed").otherwise("standing").alias("status"), F.col("o_orderdate").cast("timestamp").cast("double").alias("reversible_until"))
    return record.urgent(found, decision, 820454400.0).select(F.col("id.l_orderkey").alias("id"), F.col("id.l_linenumber").alias("line"))


@query("period_assignment", """WITH p AS (SELECT 'p' || n_nationkey AS pid, ['click', 'error', 'signup', 'view'][(n_nationkey % 4 + 1)] AS part, 1704067200 + n_nationkey * 86400.0 AS o, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 1704067200 + n_nationkey * 86400.0 + 43200 * (n_nationkey % 6) END AS c FROM nation)
SELECT event_id AS id, arg_max(pid, o) AS period_id FROM events LEFT JOIN p ON part = event_type AND epoch(ts) >= o AND (c IS NULL OR epoch(ts) <= c) GROUP BY 1""")
def _(t):
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "signup", "view")])
    start = 1704067200 + F.col("n_nationkey") * 86400.0
    p = t.nation.select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.get(kinds, F.col("n_nationkey") % 4).alias("partition"), start.alias("opened_at"), F.when(F.col("n_nationkey") % 5 != 0, start + 43200 * (F.col("n_nationkey") % 6)).alias("closed_at"))
    rows = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("partition"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return record.in_periods(rows, p).select("id", "period_id")


CHANNEL = "CASE event_type WHEN 'click' THEN 'briefing' WHEN 'view' THEN 'document' WHEN 'signup' THEN 'conversation' WHEN 'error' THEN 'correction' ELSE 'rumour' END"


@query("exposure_depths", f"SELECT user_id AS who, event_id AS node_id, {CHANNEL} AS channel, ({DEPTHS.format(CHANNEL)})::DOUBLE AS depth FROM events")
def _(t):
    rows = t.events.select(F.col("user_id").alias("who"), F.col("event_id").alias("node_id"), F.expr(CHANNEL).alias("channel"))
    return record.told(rows, 0.0)["exposure"].drop("at")


@query("intentions_checked", f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id * 1.0 END AS w, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 12) END AS e FROM documents)
SELECT doc_id, CASE WHEN (w IS NOT NULL)::INT + (e IS NOT NULL)::INT <> 1 THEN 'exactly one of when and on_event' WHEN e IS NOT NULL AND len({toks("e")}) < 2 THEN 'a cue of fewer than two tokens' END AS refused FROM r""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("action"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 1.0).alias("when_at"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 12)).alias("on_event"), F.lit("p").alias("partition"), F.lit("user").alias("origin_ref"))
    good, refused = record.intended(rows, 0.0)
    return good.select(F.col("action").alias("doc_id"), F.lit(None).cast("string").alias("refused")).unionByName(refused.select(F.col("action").alias("doc_id"), "refused"))


@query("succession_counts", "WITH s AS (SELECT event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events) SELECT src, dst, count(*)::INT AS count FROM s WHERE src IS NOT NULL AND src <> dst GROUP BY ALL")
def _(t):
    return record.successions(t.events.withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "event_type")


@query("access_log", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id AS node_id, list(event_id ORDER BY event_id) AS log FROM r WHERE rn <= 64 GROUP BY 1")
def _(t):
    return record.accessed(t.events.select(F.col("user_id").alias("node_id"), F.col("event_id").alias("at")))


@query("session_gaps", "WITH g AS (SELECT user_id, event_id, ts, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800)::INT AS c FROM events) SELECT user_id, count(*) AS n, 1 + sum(coalesce(c, 0))::BIGINT AS sessions FROM g GROUP BY 1")
def _(t):
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return record.sessions(rows, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), (1 + F.max("session")).alias("sessions"))


@query("recent_entities", """WITH m AS (SELECT s_suppkey AS id, c_nationkey AS e, max(c_custkey) AS last FROM supplier JOIN customer ON s_nationkey % 5 = c_nationkey % 5 AND c_custkey <= s_suppkey * 15 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last DESC, e) AS rn FROM m) SELECT id, list(n_name ORDER BY rn) AS names FROM r JOIN nation ON n_nationkey = e WHERE rn <= 3 GROUP BY 1""")
def _(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("partition"), (F.col("s_suppkey") * 15).alias("at"))
    mention = t.customer.select(F.col("c_nationkey").alias("entity_id"), (-F.col("c_custkey") - 1).alias("node_id"), (F.col("c_nationkey") % 5).alias("partition"), F.col("c_custkey").alias("at"))
    entity = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("place").alias("kind"))
    return record.recent_entities(rows, mention, entity).select("id", F.transform("candidates", lambda c: c["name"]).alias("names"))


@query("composites", """WITH d AS (SELECT doc_id, text, (doc_id % 7) / 10.0 + 0.2 AS conf, min(doc_id) OVER (PARTITION BY text) AS target FROM documents WHERE text IS NOT NULL)
SELECT target, count(*) AS members, min(conf)::DOUBLE AS confidence, arg_max(doc_id, conf * 1e9 + doc_id) AS spokesman FROM d GROUP BY target HAVING count(*) >= 2 AND NOT bool_or(doc_id % 11 = 0)""")
def _(t):
    docs = t.documents.where("text is not null")
    copies = docs.join(docs.groupBy("text").agg(F.min("doc_id").alias("target")), "text").select(F.col("doc_id").alias("node"), "target")
    known = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("content"), F.lit("p").alias("partition"), (F.col("doc_id") % 7 / 10.0 + 0.2).alias("confidence"), F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 11 == 0, "verbatim").otherwise("status").alias("claim_class"))
    _, made = record.composites(copies, known, 0.0)
    return made.select(F.array_min("members").alias("target"), F.size("members").cast("long").alias("members"), "confidence", F.col("content").cast("long").alias("spokesman"))


@query("node_opinions", """WITH r AS (SELECT p_partkey AS id, p_size % 4 AS o, (p_size % 3) * 0.5 AS ag, p_size % 5 = 0 AS sup, p_size % 2 = 0 AS der, substr('ABCDEF', p_size % 6 + 1, 1) AS g, p_size % 6 + 1 AS c FROM part),
s AS (SELECT id, CASE WHEN o > 1 THEN 1 + round(least(1.0, 0.5 + 0.2 * (o - 2)), 3) WHEN NOT der THEN 1.0 ELSE 0.0 END AS sp, ag + sup::INT AS ag,
 ((CASE g WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.9 WHEN 'C' THEN 0.75 WHEN 'D' THEN 0.55 WHEN 'E' THEN 0.3 ELSE 0.6 END) + (CASE c WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.75 WHEN 4 THEN 0.55 WHEN 5 THEN 0.3 ELSE 0.6 END)) / 2 AS w FROM r),
o AS (SELECT id, w * sp / (sp + ag + 2) AS b, w * ag / (sp + ag + 2) AS d FROM s)
SELECT id, round(b::DOUBLE, 6) AS b, round(d::DOUBLE, 6) AS d, round((1 - b - d)::DOUBLE, 6) AS u, CASE WHEN 1 - b - d > 0.8 THEN 'vacuous' WHEN b > 0.2 AND d > 0.2 AND 1 - b - d < 0.5 THEN 'contested' WHEN b > d THEN 'supported' ELSE 'disputed' END AS verdict FROM o""")
def _(t):
    size = F.col("p_size")
    rows = t.part.select(F.col("p_partkey").alias("id"), (size % 4).alias("origins"), (size % 3 * 0.5).alias("against"), (size % 5 == 0).alias("superseded"), (size % 2 == 0).alias("derived"), F.substring(F.lit("ABCDEF"), size % 6 + 1, F.lit(1)).alias("reliability"), (size % 6 + 1).alias("credibility"))
    return record.node_opinions(rows).select("id", "b", "d", "u", "verdict")


@query("recollection", """WITH n AS (SELECT doc_id, doc_id // 2 AS ep, CASE WHEN doc_id % 4 = 0 THEN 'x' END AS pe, CASE WHEN doc_id % 5 = 0 THEN 'inline' ELSE source END AS ref FROM documents), e AS (SELECT ep, count(*) > 1 AS s FROM n GROUP BY ep),
k AS (SELECT l_orderkey % 1000 AS id, count(*) AS c FROM lineitem GROUP BY 1)
SELECT doc_id AS node, round(least(1.0, CASE WHEN s THEN 0.3 ELSE 0 END + CASE WHEN pe IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN ref <> '' AND ref <> 'inline' THEN 0.25 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 0.15 ELSE 0 END + least(0.15, 0.05 * coalesce(c, 0))), 3)::DOUBLE AS recollection FROM n JOIN e USING (ep) LEFT JOIN k ON k.id = doc_id""")
def _(t):
    n = t.documents.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 2).alias("episode_id"), F.when(F.col("doc_id") % 4 == 0, "x").alias("period_id"), F.when(F.col("doc_id") % 5 == 0, "inline").otherwise(F.col("source")).alias("source_ref"))
    assoc = t.lineitem.select((F.col("l_orderkey") % 1000).alias("src"))
    copy = t.documents.where("doc_id % 6 = 0").select((-F.col("doc_id") - 1).alias("child_id"), F.col("doc_id").alias("parent_id"))
    made = copy.select(F.col("child_id").alias("id"), F.lit("decontext").alias("kind"))
    return retrieval.surroundings(n, assoc, t.rows([], "node_id long"), copy, made)


@query("entity_bridge", """WITH c AS (SELECT o_custkey AS q, o_orderkey AS node, max(o_totalprice / 500000) AS s FROM orders GROUP BY ALL), m AS (SELECT c_custkey AS q, c_nationkey AS e, 0.55 AS w FROM customer),
r AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey <> n_regionkey), u AS (SELECT a, b FROM r UNION SELECT b, a FROM r), w AS (SELECT q, e, max(w) AS w FROM (SELECT * FROM m UNION ALL SELECT q, b, w * 0.7 FROM m JOIN u ON a = e) GROUP BY ALL),
l AS (SELECT q, -s_suppkey AS node, w AS s FROM w JOIN supplier ON s_nationkey = e) SELECT q AS query_id, node, round(max(s)::DOUBLE, 6) AS score FROM (SELECT * FROM c UNION ALL SELECT * FROM l) GROUP BY ALL""")
def _(t):
    cands = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 500000).alias("score"))
    mention = t.supplier.select(F.col("s_nationkey").alias("entity_id"), (-F.col("s_suppkey")).alias("node_id"))
    relation = t.nation.where("n_nationkey != n_regionkey").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return retrieval.bridge(cands, t.customer.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("entity_id")), mention, relation, form=rounded)


@query("assoc_spread", """WITH c AS (SELECT o_custkey AS q, o_orderkey AS node, o_totalprice / 500000 AS s FROM orders), a AS (SELECT l_orderkey AS src, -l_partkey AS dst, max(l_quantity) / 50 AS w FROM lineitem GROUP BY ALL), k AS (SELECT l_orderkey AS src, -l_suppkey - 1000000 AS dst, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT q, dst AS node, s * 0.35 * w AS s FROM c JOIN a ON src = node UNION ALL SELECT q, dst, s * 0.175 * least(1.0, n / 5) FROM c JOIN k ON src = node) SELECT q AS query_id, node, round(sum(s)::DOUBLE, 6) AS score FROM (SELECT * FROM c UNION ALL SELECT * FROM g) GROUP BY ALL""")
def _(t):
    cands = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 500000).alias("score"))
    assoc = t.lineitem.groupBy(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst")).agg((F.max("l_quantity") / 50).alias("weight"))
    follow = t.lineitem.groupBy(F.col("l_orderkey").alias("src"), (-F.col("l_suppkey") - 1000000).alias("dst")).agg(F.count("*").alias("count"))
    return retrieval.spread(cands, assoc, follow).withColumn("score", rounded("score"))


@query("answerable", """WITH s AS (SELECT DISTINCT lang AS v, lang AS o FROM documents UNION SELECT 'en', lang FROM documents), k AS (SELECT DISTINCT v, ['place', 'time', 'person'][(doc_id % 3 + 1)] AS kind FROM documents JOIN s ON o = lang WHERE lang <> 'fr'),
q AS (SELECT * FROM (VALUES (1, 'who runs it', 'en', 'person'), (2, 'where is it', 'fr', 'place'), (3, 'when', 'de', 'time'), (4, 'water', 'en', NULL), (5, 'how many litres', 'en', 'quantity')) AS x(id, query, v, kind))
SELECT id AS query_id, CASE WHEN q.kind IS NOT NULL THEN k.kind IS NOT NULL END AS has_answer FROM q LEFT JOIN k ON k.v = q.v AND k.kind = q.kind""")
def _(t):
    asked = t.rows([(1, "who runs it", "en"), (2, "where is it", "fr"), (3, "when", "de"), (4, "water", "en"), (5, "how many litres", "en")], "query_id int, query string, viewer string")
    kinds = F.get(F.array(*[F.lit(x) for x in ("place", "time", "person")]), (F.col("doc_id") % 3).cast("int"))
    return retrieval.answerable(asked, t.documents.where("lang != 'fr'").select(F.col("lang").alias("partition"), kinds.alias("kind")), retrieval.scope(asked, seen_by(t)))


def seen_by(t):
    """Every language reads itself, and one of them all others."""
    langs = t.documents.select("lang").distinct()
    own = langs.select(F.col("lang").alias("viewer"), F.col("lang").alias("owner"))
    return own.unionByName(langs.select(F.lit("en").alias("viewer"), F.col("lang").alias("owner"))).distinct().withColumn("level", F.lit("full"))


@query("vocabulary_filters", "SELECT 0::BIGINT AS lost, true AS few_false")
def _(t):
    """A filter loses no term that its partition has, and passes few others."""
    post = retrieval.postings(documents(t))
    filters = caches.vocabulary_filters(post)
    mine = post.select(F.lit(0).alias("query_id"), "term", F.col("partition").alias("owner")).distinct()
    strange = mine.select("query_id", F.concat("term", F.lit("~")).alias("term"), "owner")
    told = caches.possible(mine.unionByName(strange), filters)
    return told.agg(F.sum((~F.col("possible") & ~F.col("term").endswith("~")).cast("long")).alias("lost"), (F.avg(F.when(F.col("term").endswith("~"), F.col("possible").cast("int"))) < 0.03).alias("few_false"))


@query("nightly_quota", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 >= 1 THEN 'quota spent' WHEN n_nationkey / 4.0 < 4 THEN 'nothing owed' WHEN n_nationkey / 80.0 < 0.25 THEN 'store too new' ELSE 'worth one call' END AS reason FROM nation")
def _(t):
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("id"), record.nightly(n % 2, F.lit(1), n / 4.0, n / 80.0)["reason"].alias("reason"))


@query("kept_verdicts", "SELECT p_partkey AS id, CASE WHEN p_size >= 10 THEN round((p_partkey % 10) / p_size, 3) END AS rate, CASE WHEN p_size < 10 THEN true ELSE (p_partkey % 10) / p_size >= 0.3 END AS keep FROM part")
def _(t):
    v = record.kept_verdict(F.col("p_size"), F.col("p_partkey") % 10)
    return t.part.select(F.col("p_partkey").alias("id"), v["rate"].alias("rate"), v["keep"].alias("keep"))


@query("fact_gate", "SELECT doc_id, CASE quality WHEN 1 THEN toxic = 0 ELSE toxic = 0 END AS fact FROM labels")
def _(t):
    tag = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "inferred").otherwise("observed")).otherwise(F.when(F.col("toxic") == 1, "hypothesized").otherwise("reported"))
    return t.labels.select("doc_id", record.presentable(tag).alias("fact"))


@query("path_texts", "SELECT c_custkey AS id, c_name || ' --[lives in]--> ' || n_name || ' --[part of]--> ' || r_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("c_custkey").alias("id"), record.path_text(F.array("c_name", "n_name", "r_name"), F.array(F.lit("lives in"), F.lit("part of"))).alias("path"))


@query("source_weights", "SELECT p_partkey AS id, round(((CASE substr('ABCDEF', p_size % 6 + 1, 1) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.85 WHEN 'C' THEN 0.65 WHEN 'D' THEN 0.45 WHEN 'E' THEN 0.2 ELSE 0.5 END) * (CASE p_partkey % 6 + 1 WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.45 WHEN 5 THEN 0.2 ELSE 0.5 END))::DOUBLE, 6) AS weight, greatest(0.0, least(1.0, abs(p_size / 50.0 - (p_partkey % 40) / 20.0)))::DOUBLE AS error FROM part")
def _(t):
    grade = F.substring(F.lit("ABCDEF"), F.col("p_size") % 6 + 1, F.lit(1))
    return t.part.select(F.col("p_partkey").alias("id"), F.round(memory.admiralty(grade, (F.col("p_partkey") % 6 + 1).cast("int")), 6).alias("weight"), record.prediction_error(F.col("p_size") / 50.0, F.col("p_partkey") % 40 / 20.0).alias("error"))


RECALL = f"""
vis AS (SELECT DISTINCT lang AS v, lang AS o FROM documents UNION SELECT 'en', lang FROM documents),
st AS (SELECT doc_id AS node, 0.3 + (doc_id % 7) * 0.1 AS r, doc_id % 13 = 0 AS pruned, doc_id % 17 = 0 AS quiet FROM documents),
tok AS (SELECT doc_id AS node, lang AS part, {toks("text")} AS t FROM documents),
cnt AS (SELECT node, part, u AS term, count(*)::DOUBLE AS c FROM (SELECT node, part, unnest(t) AS u FROM tok) GROUP BY ALL),
post AS (SELECT term, node, part, c / sqrt(sum(c * c) OVER (PARTITION BY node)) AS tf FROM cnt),
nn AS (SELECT v, count(*) AS n FROM documents JOIN vis ON o = lang GROUP BY v),
qq AS (SELECT item_id AS q, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS v, list_distinct({toks("text")}) AS t FROM benchmark),
qt AS (SELECT q, v, len(t) AS k, unnest(t) AS term FROM qq),
seen AS (SELECT post.*, vis.v, st.pruned FROM post JOIN vis ON o = part JOIN st USING (node)),
df AS (SELECT v, term, count(*) AS df FROM seen WHERE NOT pruned GROUP BY ALL),
w AS (SELECT v, term, greatest(0.05, ln(1 + (n - df + 0.5) / (df + 0.5))) AS w FROM df JOIN nn USING (v)),
hit AS (SELECT q, node, k, sum(tf * w) AS raw, count(*) AS m FROM qt JOIN w USING (v, term) JOIN seen USING (v, term) WHERE NOT pruned GROUP BY ALL),
sc AS (SELECT q, node, round(raw / max(raw) OVER (PARTITION BY q) * m / k * CASE WHEN quiet THEN 0.02 ELSE 1.0 END * r, 9) AS score, r FROM hit JOIN st USING (node)),
rk AS (SELECT sc.*, text, source, row_number() OVER (PARTITION BY q ORDER BY score DESC, text, node) AS rank, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS rn FROM sc JOIN documents ON doc_id = node),
cf AS (SELECT q, count(*) AS n, max(score) AS best, CASE WHEN count(*) < 2 OR max(score) <= 0 THEN 0 ELSE (count(*) FILTER (best - score <= 0.15 * best) - 1) / (count(*) - 1) END AS conflict FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM rk WHERE rn <= 12) GROUP BY q),
cov AS (SELECT q, count(s.term) / count(*) AS coverage FROM qt LEFT JOIN (SELECT DISTINCT v, term FROM seen) s USING (v, term) GROUP BY q),
sg AS (SELECT qq.q, coalesce(n, 0) AS n, least(1.0, coalesce(best, 0)) AS best, coalesce(conflict, 0) AS conflict, coalesce(coverage, 0) AS coverage, coalesce(rk.r, 0) AS br FROM qq LEFT JOIN cf USING (q) LEFT JOIN cov USING (q) LEFT JOIN rk ON rk.q = qq.q AND rk.rank = 1),
once AS (SELECT q, arg_min(node, -m * 1e9 + node) AS once FROM (SELECT q, k, node, count(*) AS m FROM qt JOIN seen USING (v, term) WHERE pruned GROUP BY ALL) WHERE 2 * m >= k GROUP BY q),
g AS (SELECT sg.*, once, CASE WHEN n = 0 OR coverage < 0.25 THEN 'dont_know' WHEN best >= 0.18 AND br < 0.5 THEN 'tip_of_tongue' WHEN best >= 0.18 AND conflict > 0.55 THEN 'tip_of_tongue' WHEN best >= 0.55 THEN 'know' WHEN best >= 0.18 THEN 'know_where' ELSE 'dont_know' END AS s0 FROM sg LEFT JOIN once USING (q)),
a AS (SELECT *, CASE WHEN s0 = 'dont_know' AND once IS NOT NULL THEN 'knew_once' ELSE s0 END AS state FROM g)"""


def scoped_recall(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("partition"), F.col("text").alias("content"), F.col("source").alias("source_ref"), F.lit(0.0).alias("at"), F.lit("unknown").alias("claim_class"), F.lit("observed").alias("epistemic"), F.lit("observation").alias("kind"))
    states = t.documents.select(F.col("doc_id").alias("node"), (0.3 + F.col("doc_id") % 7 * 0.1).alias("r"), F.when(F.col("doc_id") % 13 == 0, "pruned").otherwise("hot").alias("tier"), (F.col("doc_id") % 17 == 0).alias("suppressed"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("de").alias("viewer"))
    none = t.rows([], "partition string, query string, expires_at double, searched_at double")
    return retrieval.recall(asked, docs, states, seen_by(t), none, 0.0, typed=False)


@query("recall_states", f"WITH {RECALL.strip()} SELECT q AS query_id, state, n AS candidates, round(best, 6) AS best, round(coverage, 6) AS coverage, round(conflict, 6) AS conflict FROM a")
def _(t):
    return scoped_recall(t)[0].select("query_id", "state", "candidates", "best", "coverage", "conflict")


@query("recall_results", f"""WITH {RECALL.strip()}, op AS (SELECT rk.q, node, score, rank, source, CASE state WHEN 'tip_of_tongue' THEN 7 ELSE 5 END AS take, row_number() OVER (PARTITION BY rk.q, source ORDER BY rank) AS wi FROM rk JOIN a USING (q) WHERE state NOT IN ('dont_know', 'knew_once')),
pl AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (wi > 2)::INT, rank) AS place FROM op)
SELECT q AS query_id, place::INT AS rank, node, round(score, 6) AS score FROM pl WHERE place <= take UNION ALL SELECT q, 1, once, 0.0 FROM a WHERE state = 'knew_once'""")
def _(t):
    return scoped_recall(t)[1].select("query_id", "rank", "node", "score")


@query("standalone_texts", f"SELECT doc_id, NOT regexp_matches(lower(text), {chr(39)}{fixed.RELATIVE_DATE.replace(chr(39), chr(39) * 2)}{chr(39)}) AS untouched FROM documents WHERE text IS NOT NULL")
def _(t):
    """A text without relative dates stays as it is; one with them changes."""
    rows = t.documents.where("text is not null")
    return rows.select("doc_id", (text.dated(F.col("text"), F.lit(1.7e9)) == F.col("text")).alias("untouched"))
