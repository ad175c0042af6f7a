"""Queries over derivation, decision, partition and similarity graphs, and over vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenspark.functions import memory
from provenspark.operators import graph, vectors
from provenspark.plans.registry import query, values
from provenspark.sources.store import step

# Derivation edges (child rests on parent): lineitem lines on their order, orders on customers, customers on nations, nations on regions.
EDGES = """edges AS (
  SELECT DISTINCT 'ord_' || o_orderkey AS child_id, 'cus_' || o_custkey AS parent_id FROM orders
  UNION SELECT 'cus_' || c_custkey, 'nat_' || c_nationkey FROM customer
  UNION SELECT 'nat_' || n_nationkey, 'reg_' || n_regionkey FROM nation),
basis AS (SELECT DISTINCT 'dec_' || l_orderkey AS decision_id, 'ord_' || l_orderkey AS node_id FROM lineitem)"""


def edges(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = t.orders.select(name("ord_", "o_orderkey").alias("child_id"), name("cus_", "o_custkey").alias("parent_id"))
    two = t.customer.select(name("cus_", "c_custkey").alias("child_id"), name("nat_", "c_nationkey").alias("parent_id"))
    three = t.nation.select(name("nat_", "n_nationkey").alias("child_id"), name("reg_", "n_regionkey").alias("parent_id"))
    return one.unionByName(two).unionByName(three).distinct()


def basis(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return t.lineitem.select(name("dec_", "l_orderkey").alias("decision_id"), name("ord_", "l_orderkey").alias("node_id")).distinct()


@query("why_closure", f"WITH RECURSIVE {EDGES}, r(root, node, depth) AS (SELECT child_id, child_id, 0 FROM edges WHERE child_id LIKE 'ord_%' UNION SELECT root, parent_id, depth + 1 FROM r JOIN edges ON child_id = node) SELECT root, node, depth FROM r")
def _(t):
    e = edges(t)
    return graph.closure(e, e.where("child_id like 'ord_%'").select("child_id"), 12, "child_id", "parent_id")


@query("blast_radius", f"WITH RECURSIVE {EDGES}, r(root, node, depth) AS (SELECT DISTINCT parent_id, parent_id, 0 FROM edges WHERE parent_id LIKE 'reg_%' UNION SELECT root, child_id, depth + 1 FROM r JOIN edges ON parent_id = node) SELECT root, max(depth) AS depth, count(*) - 1 AS reached FROM r GROUP BY root")
def _(t):
    e = edges(t)
    found = graph.closure(e, e.where("parent_id like 'reg_%'").select("parent_id"), 12, "parent_id", "child_id")
    return found.groupBy("root").agg(F.max("depth").alias("depth"), (F.count("*") - 1).alias("reached"))


@query("dependent_counts", f"WITH RECURSIVE {EDGES}, r(root, node) AS (SELECT parent_id, child_id FROM edges UNION SELECT root, child_id FROM r JOIN edges ON parent_id = node) SELECT root AS node, count(*) AS dependents FROM r GROUP BY root")
def _(t):
    return graph.dependents(edges(t))


def _pagerank() -> str:
    out = f"WITH {EDGES}, l AS (SELECT child_id AS c, parent_id AS p FROM edges UNION ALL SELECT decision_id, node_id FROM basis), o AS (SELECT c, count(*) AS k FROM l GROUP BY c), lk AS (SELECT l.c, l.p, o.k FROM l JOIN o USING (c)), seed AS (SELECT n, CASE WHEN n LIKE 'dec_%' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM (SELECT c AS n FROM l UNION SELECT p FROM l)), r0 AS (SELECT n, s AS r FROM seed)"
    for k in range(20):
        out += f", r{k + 1} AS MATERIALIZED (SELECT seed.n, 0.15 * any_value(s) + coalesce(sum(0.85 * r{k}.r / lk.k), 0) AS r FROM seed LEFT JOIN lk ON lk.p = seed.n LEFT JOIN r{k} ON r{k}.n = lk.c GROUP BY seed.n)"
    return out + " SELECT n AS node, round(r / max(r) OVER (), 6) AS score FROM r20"


@query("criticality_pagerank", _pagerank())
def _(t):
    return graph.criticality(edges(t), basis(t))


@query("components")
def _(t):
    """Parts and orders that hang together over all line items; recursive SQL cannot do it on whole tables, so a test holds it against union-find."""
    e = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("o"), "l_orderkey").alias("b")).distinct()
    return graph.components(e)


FLOWS = [("field", "desk", "full"), ("desk", "review", "summary"), ("desk", "archive", "full"), ("archive", "review", "full"), ("legal", "review", "summary"), ("review", "press", "summary")]


@query("visibility_closure", f"""WITH RECURSIVE f AS (SELECT * FROM ({values(FLOWS)}) AS v(src, dst, level)), p AS (SELECT src AS n FROM f UNION SELECT dst FROM f),
r(viewer, owner, lv) AS (SELECT n, n, 1 FROM p UNION SELECT viewer, src, least(lv, (level = 'full')::INT) FROM r JOIN f ON f.dst = r.owner)
SELECT viewer, owner, CASE WHEN max(lv) = 1 THEN 'full' ELSE 'summary' END AS level FROM r GROUP BY ALL""")
def _(t):
    f = t.rows(FLOWS, "src string, dst string, level string")
    return graph.visibility(f, f.select("src").union(f.select("dst")).distinct())


@query("paths", f"""WITH RECURSIVE {EDGES}, e AS (SELECT child_id AS s, parent_id AS d FROM edges UNION SELECT parent_id, child_id FROM edges),
r(node, hops, path) AS (SELECT 'reg_1', 0, ['reg_1'] UNION ALL SELECT e.d, hops + 1, list_append(path, e.d) FROM r JOIN e ON e.s = r.node WHERE hops < 3 AND NOT list_contains(path, e.d)),
b AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)
SELECT r.node, r.hops, array_to_string(min(path), '>') AS path FROM r JOIN b ON r.node = b.node AND r.hops = b.hops GROUP BY ALL""")
def _(t):
    e = edges(t).select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"))
    return graph.paths(e, t.rows([("reg_1",)], "n string")).select("node", "hops", F.array_join("path", ">").alias("path"))


@query("monotonic_audit", """WITH d AS (SELECT o_orderkey AS id, o_custkey AS parent, o_totalprice / 500000 AS conf FROM orders), p AS (SELECT c_custkey AS id, (c_acctbal + 1000) / 11000 AS conf FROM customer)
SELECT d.id, round(d.conf - p.conf, 4) AS excess FROM d JOIN p ON d.parent = p.id WHERE d.conf > p.conf + 1e-9""")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") / 500000).alias("conf"))
    p = t.customer.select("c_custkey", ((F.col("c_acctbal") + 1000) / 11000).alias("least"))
    return d.join(p, "c_custkey").where("conf > least + 1e-9").select("id", F.round(F.col("conf") - F.col("least"), 4).alias("excess"))


@query("orphan_edges", "SELECT DISTINCT l_orderkey FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) o ON l_orderkey = o_orderkey")
def _(t):
    return t.lineitem.select("l_orderkey").distinct().join(t.orders.where("o_orderkey % 7 != 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")


@query("impacts", """WITH i AS (SELECT o_orderkey AS decision, l_partkey AS basis, CASE l_returnflag WHEN 'R' THEN 'retracted' WHEN 'A' THEN 'superseded' ELSE 'stale' END AS cause, o_orderstatus = 'O' AS rev, p_size / 51.3 AS crit, l_quantity / 48.7 AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT decision, basis, cause, round(max(least(1.0, (CASE cause WHEN 'retracted' THEN 1.0 WHEN 'superseded' THEN 0.75 ELSE 0.45 END)::DOUBLE * (0.4 + 0.6 * least(1.0, crit)) * greatest(0.2, least(1.0, w)) * CASE WHEN rev THEN 1.25 ELSE 1.0 END)), 4) AS severity FROM i GROUP BY ALL""")
def _(t):
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    cause = F.when(F.col("l_returnflag") == "R", "retracted").when(F.col("l_returnflag") == "A", "superseded").otherwise("stale")
    s = memory.severity(F.col("p_size") / 51.3, F.col("l_quantity") / 48.7, F.col("cause"), F.col("o_orderstatus") == "O")
    return rows.withColumn("cause", cause).withColumn("s", s).groupBy(F.col("l_orderkey").alias("decision"), F.col("l_partkey").alias("basis"), "cause").agg(F.max("s").alias("severity"))


@query("verification_queue", """WITH s AS (SELECT s_suppkey, substr('ABCDEF', (s_suppkey % 6 + 1)::BIGINT, 1) AS g, (s_suppkey % 5 + 1) AS c, count(l_orderkey) AS deps FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
w AS (SELECT *, (CASE g WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.85 WHEN 'C' THEN 0.65 WHEN 'D' THEN 0.45 WHEN 'E' THEN 0.2 ELSE 0.5 END * CASE c WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.45 ELSE 0.2 END)::DOUBLE AS adm FROM s)
SELECT s_suppkey, round((deps / 20.0) * (1 - adm) * CASE WHEN deps > 0 THEN 1.0 ELSE 0.5 END + 1e-9, 4)::DOUBLE AS priority FROM w""")
def _(t):
    deps = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("deps"))
    rows = t.supplier.select("s_suppkey").join(deps, "s_suppkey", "left").na.fill({"deps": 0})
    adm = memory.admiralty(F.substring(F.lit("ABCDEF"), (F.col("s_suppkey") % 6 + 1).cast("int"), F.lit(1)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return rows.select("s_suppkey", F.round(F.col("deps") / 20.0 * (1 - adm) * F.when(F.col("deps") > 0, 1.0).otherwise(0.5) + 1e-9, 4).alias("priority"))


def vecs(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("brute_topk", """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 10 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM p) SELECT query_id, rank::INT AS rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 10""")
def _(t):
    return vectors.top_k(vecs(t), vecs(t).where("id % 10 = 0"), 10).withColumn("sim", F.round("sim", 6))


HUB = """p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 11 = 0), m AS (SELECT e.vec_id AS id, avg(list_dot_product(e.embedding::DOUBLE[], p.v)) AS m FROM embeddings e JOIN p ON p.vec_id <> e.vec_id GROUP BY 1),
hub AS (SELECT id, greatest(0, m - avg(m) OVER ()) AS hub FROM m)"""


@query("hubness", f"WITH {HUB} SELECT id, round(hub, 6) AS hub FROM hub")
def _(t):
    return vectors.hubness(vecs(t), vecs(t).where("id % 11 = 0")).withColumn("hub", F.round("hub", 6))


@query("neighbours", f"""WITH {HUB}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) - 0.6 * hub AS sim FROM embeddings q, embeddings e JOIN hub ON hub.id = e.vec_id WHERE q.vec_id % 20 = 1 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.25) SELECT query_id, rank::INT AS rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 12""")
def _(t):
    hub = vectors.hubness(vecs(t), vecs(t).where("id % 11 = 0"))
    return vectors.top_k(vecs(t).join(hub, "id"), vecs(t).where("id % 20 = 1"), 12, floor=0.25, hubness=True).withColumn("sim", F.round("sim", 6))


@query("background_margin", """WITH p AS (SELECT q.vec_id AS q, e.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 25 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rk FROM p), h AS (SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim, id) AS rn, count(*) OVER (PARTITION BY q) AS n FROM r WHERE rk <= 60)
SELECT q AS query_id, round(max(sim), 6) AS best, round(avg(sim) FILTER (rn <= greatest(1, floor(0.6 * n))), 6) AS background FROM h GROUP BY q""")
def _(t):
    from provenspark.operators import retrieval

    hits = vectors.top_k(vecs(t), vecs(t).where("id % 25 = 0"), 60).withColumnRenamed("id", "node")
    best = hits.groupBy("query_id").agg(F.round(F.max("sim"), 6).alias("best"))
    return best.join(retrieval.background(hits), "query_id").withColumn("background", F.round("background", 6))


DENSITIES = [(1, 0.69, 0.35), (2, 0.51, 0.45), (3, 0.39, 0.1), (4, 0.9, None), (5, 0.41, 0.2)]


@query("semantic_density", f"SELECT id, (CASE WHEN best <= 0.4 THEN 0 WHEN bg IS NULL THEN (best - 0.4) / 0.6 ELSE round(least(1.0, 0.25 * (best - 0.4) / 0.6 + 0.75 * least(1.0, greatest(0, best - bg) / 0.3)), 4) END)::DOUBLE AS density FROM ({values(DENSITIES)}) AS v(id, best, bg)")
def _(t):
    return t.rows(DENSITIES, "id int, best double, bg double").select("id", memory.density(F.col("best"), F.col("bg")).alias("density"))


@query("separation", """WITH s AS (SELECT vec_id, list_transform(range(0, 128), lambda i: ('0x' || substr(md5(vec_id || chr(31) || i), 1, 4))::INT / 32767.5 - 1) AS c, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM s)
SELECT a.vec_id AS a, b.vec_id AS b, round(0.8775 * list_dot_product(a.v, b.v) + 0.1225 * list_dot_product(a.c, b.c), 6) AS sim FROM u a JOIN u b ON a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id""")
def _(t):
    rows = vecs(t).select("id", vectors.separated(F.col("v"), vectors.context_signature(F.col("id").cast("string"))).alias("w"))
    return vectors.products(rows, rows.where("id % 25 = 0"), vec="w").select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("sim", 6).alias("sim"))


@query("ivf_recall")
def _(t):
    rows = vecs(t)
    centroids, lists = vectors.inverted_lists(rows, 16)
    asked = rows.where("id % 10 = 0")
    return vectors.recall_at_k(vectors.probe(centroids, lists, asked, 10, nprobe=8), vectors.top_k(rows, asked, 10))


@query("ivf_sweep", "SELECT nprobe, nprobe = 16 AS exact FROM (VALUES (1), (2), (4), (8), (16)) AS v(nprobe)")
def _(t):
    """Recall grows with the lists that are looked into, and is whole with all of them."""
    rows = vecs(t)
    unit = rows.select("id", vectors.unit(F.col("v")).alias("v"))
    told = vectors.sweep(unit, unit.where("id % 10 = 0"))
    return told.select("nprobe", (F.col("recall") > 0.9999).alias("exact"))


SIMS = "s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.label = b.label)"


@query("fusion_pairs", f"WITH {SIMS} SELECT a, b, round(sim, 6) AS sim FROM s WHERE sim >= 0.40")
def _(t):
    v = vecs(t)
    a, b = v.select(F.col("id").alias("a"), F.col("v").alias("va"), "label"), v.select(F.col("id").alias("b"), F.col("v").alias("vb"), "label")
    return a.join(b, "label").where("a < b").select("a", "b", vectors.dot(F.col("va"), F.col("vb")).alias("sim")).where("sim >= 0.40").withColumn("sim", F.round("sim", 6))


@query("fusion_plan", f"""WITH RECURSIVE {SIMS}, u AS (SELECT a, b, sim, row_number() OVER (ORDER BY sim DESC, a, b) AS rn FROM s WHERE sim >= 0.42),
g(rn, gone, kept) AS (SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[] UNION ALL SELECT u.rn, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, b) END, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN kept ELSE list_append(kept, b || ':' || a) END FROM g JOIN u ON u.rn = g.rn + 1),
d AS (SELECT unnest(kept) AS x FROM (SELECT kept FROM g ORDER BY rn DESC LIMIT 1)), dd AS (SELECT split_part(x, ':', 1)::BIGINT AS node, split_part(x, ':', 2)::BIGINT AS target FROM d),
e AS (SELECT a, b FROM s WHERE sim >= 0.38 AND a NOT IN (SELECT node FROM dd) AND b NOT IN (SELECT node FROM dd)), un AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, a FROM un UNION SELECT r.x, un.b FROM r JOIN un ON un.a = r.y)
SELECT node, 'duplicate' AS role, target FROM dd UNION ALL SELECT x, 'cluster', min(y) FROM r GROUP BY x""")
def _(t):
    return graph.fusion_plan(vectors.pairs_within(vecs(t), "label", 0.38), dedupe=0.42, cluster=0.38)


@query("label_propagation")
def _(t):
    return graph.label_propagation(step(vectors.pairs_within(vecs(t), "label", 0.30).withColumnRenamed("sim", "w"), "edges"))


ROLES = [("n1", "actor", "ahmed"), ("n1", "place", "depot"), ("n1", "object", "fuel"), ("n2", "actor", "sara"), ("n2", "place", "depot"), ("n3", "actor", "ahmed"), ("n3", "place", "clinic"), ("n4", "actor", "lena"), ("n4", "place", "depot"), ("n4", "object", "fuel")]


@query("structural_query", f"SELECT a.node, a.filler FROM ({values(ROLES)}) AS a(node, role, filler) SEMI JOIN ({values(ROLES)}) AS b(node, role, filler) ON a.node = b.node AND b.role = 'place' AND b.filler = 'depot' WHERE a.role = 'actor'")
def _(t):
    return vectors.structural(t.rows(ROLES, "node string, role string, filler string"), "actor", {"place": "depot"})


@query("role_traces")
def _(t):
    return vectors.traces(t.rows(ROLES, "node string, role string, filler string"), 1024)


@query("p95_cosine", f"WITH {SIMS}, o AS (SELECT sim, row_number() OVER (ORDER BY sim) AS rn, count(*) OVER () AS n FROM s) SELECT round(avg(sim), 6) AS mean, round(max(sim) FILTER (rn = least(n, floor(0.95 * n) + 1)), 6) AS p95 FROM o")
def _(t):
    found = vectors.quantile_within(vecs(t), "label", 0.95)
    if found is None:
        return t.rows([(None, None)], "mean double, p95 double")
    near, mean, k = found
    levels = near.groupBy("sim").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("sim")))
    return levels.where((F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)).select(F.round(F.lit(mean), 6).alias("mean"), F.round("sim", 6).alias("p95"))  # distinct products of one bin
