"""Queries over outcomes, streams and memory states."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenspark.functions import fixed, memory, text
from provenspark.operators import retrieval, sequences
from provenspark.plans.registry import query, values
from provenspark.plans.texts import toks

#: Confidence that a document's labeller stated: a fixed function of its id.
CONFIDENCE = "((doc_id * 37) % 100) / 100.0"
NOW = "(epoch(max(ts)) + 86400)"


def predictions(t):
    return t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id").select(F.col("source").alias("producer"), F.col("lang").alias("claim_kind"), F.expr(f"cast({CONFIDENCE} as double)").alias("confidence"), F.col("quality").alias("outcome"))


@query(
    "brier",
    f"""WITH p AS (SELECT source, lang, ({CONFIDENCE})::DOUBLE AS c, quality::DOUBLE AS o FROM labels JOIN documents USING (doc_id)),
g AS (SELECT source, lang, count(*) AS n, avg(c) AS c, avg(o) AS a, avg((c - o) * (c - o)) AS b FROM p GROUP BY ALL)
SELECT source AS producer, lang AS claim_kind, n, round(c, 3) AS confidence, round(a, 3) AS accuracy, round(b, 4) AS brier,
CASE WHEN n < 10 THEN 'insufficient' WHEN c - a > 0.10 THEN 'overconfident' WHEN a - c > 0.15 THEN 'underconfident' ELSE 'calibrated' END AS verdict FROM g""",
)
def _(t):
    return sequences.brier(predictions(t))


@query(
    "reliability_curve",
    f"""WITH p AS (SELECT ({CONFIDENCE})::DOUBLE AS c, quality::DOUBLE AS o FROM labels),
g AS (SELECT floor(least(0.999, greatest(0, c)) * 7)::INT AS bin, count(*) AS n, round(avg(c), 3) AS stated, round(avg(o), 3) AS observed FROM p GROUP BY 1)
SELECT b.bin::INT AS bin, coalesce(n, 0) AS n, stated, observed FROM range(7) AS b(bin) LEFT JOIN g ON g.bin = b.bin""",
)
def _(t):
    return sequences.reliability_curve(t.labels.select(F.expr(f"cast({CONFIDENCE} as double)").alias("confidence"), F.col("quality").alias("outcome")), 7)


@query("auc", "WITH p AS (SELECT n_chars, quality FROM labels JOIN documents USING (doc_id)) SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END), 4) AS auc FROM p a, p b WHERE a.quality = 1 AND b.quality = 0")
def _(t):
    return sequences.auc(t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality")


@query(
    "claimant_record",
    """WITH r AS (SELECT l_suppkey AS k, sum((date_diff('day', o_orderdate, l_shipdate) <= 60)::INT) AS good, sum((date_diff('day', o_orderdate, l_shipdate) > 60)::INT) AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
a AS (SELECT *, (good + 1) / (good + bad + 2) AS acc FROM r)
SELECT k AS l_suppkey, good::BIGINT AS good, bad::BIGINT AS bad, round(acc, 3) AS accuracy, CASE WHEN good + bad < 3 THEN 'F' WHEN acc >= 0.9 THEN 'A' WHEN acc >= 0.75 THEN 'B' WHEN acc >= 0.6 THEN 'C' WHEN acc >= 0.4 THEN 'D' ELSE 'E' END AS grade FROM a""",
)
def _(t):
    late = F.datediff("l_shipdate", "o_orderdate") > 60
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return sequences.track_record(rows.select("l_suppkey", (~late).alias("kept"), late.alias("broken")), "l_suppkey", "kept", "broken")


SURVIVAL = "s AS (SELECT event_type, epoch(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) - epoch(ts) AS survived FROM events)"


def survivals(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    return t.events.select("event_type", (F.lead(at).over(w) - at).alias("survived")).where("survived is not null")


@query("supersession_survival", f"WITH {SURVIVAL} SELECT event_type AS claim_class, count(*) AS n, round(min(survived), 3) AS least, round(avg(survived), 3) AS mean, round(max(survived), 3) AS most FROM s WHERE survived IS NOT NULL GROUP BY 1")
def _(t):
    return survivals(t).groupBy(F.col("event_type").alias("claim_class")).agg(F.count("*").alias("n"), F.round(F.min("survived"), 3).alias("least"), F.round(F.avg("survived"), 3).alias("mean"), F.round(F.max("survived"), 3).alias("most"))


@query("halflife_fit", f"WITH {SURVIVAL} SELECT event_type AS claim_class, count(*) AS n, round(CASE WHEN count(*) >= 12 AND avg(survived) > 0 THEN avg(survived) * {math.log(2)!r} END, 3) AS half_life FROM s WHERE survived IS NOT NULL GROUP BY 1")
def _(t):
    return sequences.half_life(survivals(t).withColumnRenamed("event_type", "claim_class")).withColumn("half_life", F.round("half_life", 3))


@query(
    "corroboration",
    f"""WITH p AS (SELECT substr(sha256(array_to_string(list_sort(list_distinct({toks("text")})), ' ')), 1, 24) AS h, source FROM documents),
g AS (SELECT h, count(DISTINCT nullif(source, '')) AS n FROM p GROUP BY h)
SELECT h AS prop_hash, n AS independent, CASE WHEN n <= 1 THEN 0.0::DOUBLE ELSE round(least(1.0, 0.5 + 0.2 * (n - 2))::DOUBLE, 3) END AS weight FROM g""",
)
def _(t):
    return sequences.corroboration(t.documents.select(text.proposition_hash(F.col("text")).alias("prop_hash"), "source"), "prop_hash", "source")


@query("flooding", "SELECT event_type AS claim, count(*) AS copies, count(DISTINCT user_id % 3) AS origins, CASE WHEN count(DISTINCT user_id % 3) <= 1 THEN 0.0::DOUBLE ELSE round((0.5 + 0.2 * (count(DISTINCT user_id % 3) - 2))::DOUBLE, 3) END AS weight FROM events GROUP BY 1")
def _(t):
    g = t.events.groupBy(F.col("event_type").alias("claim")).agg(F.count("*").alias("copies"), F.countDistinct(F.col("user_id") % 3).alias("origins"))
    return g.withColumn("weight", memory.corroboration(F.col("origins")))


@query("maturity", "WITH g AS (SELECT ((max(doc_id) - min(doc_id)) * 3600 / 86400.0)::DOUBLE AS x, count(*) AS n, count(DISTINCT source) AS k FROM documents) SELECT round(x, 6) AS days, n AS memories, k AS sources, round(pow((x / (x + 21)) * (n / (n + 200)) * (k / (k + 8)), 1.0 / 3), 4) AS coverage FROM g")
def _(t):
    return sequences.maturity(t.documents.select((F.col("doc_id") * 3600.0).alias("at"), "source"), "at", "source").withColumn("days", F.round("days", 6))


@query("correlation", "SELECT event_type, round(CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(corr(value, user_id), 0) END, 4) AS r FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.when(F.count("*") < 3, 0.0).otherwise(sequences.correlation("value", "user_id")), 4).alias("r"))


SURPRISE = f"""m AS (SELECT conv_id, turn, list_distinct({toks("text")}) AS t, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, flatten(list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS b FROM m),
s AS (SELECT conv_id, turn, rn, (CASE WHEN len(t) = 0 THEN 0.0 WHEN rn = 1 THEN 1.0 ELSE len(list_filter(t, lambda x: NOT list_contains(coalesce(b, []), x))) / len(t) END)::DOUBLE AS surprise FROM p)"""


@query("surprise", f"WITH {SURPRISE} SELECT conv_id, turn, round(surprise, 6) AS surprise FROM s")
def _(t):
    return sequences.surprise(t.conversations, ["conv_id"], ["turn"], "text").select("conv_id", "turn", F.round("surprise", 6).alias("surprise"))


@query(
    "episodes",
    f"""WITH RECURSIVE {SURPRISE.replace("PARTITION BY conv_id ", "PARTITION BY part ").replace("SELECT conv_id, turn, list_distinct", "SELECT role AS part, conv_id * 1000 + turn AS o, list_distinct").replace("ORDER BY turn", "ORDER BY o").replace("FROM conversations WINDOW w AS (PARTITION BY part ORDER BY o)", "FROM conversations WINDOW w AS (PARTITION BY role ORDER BY conv_id * 1000 + turn)").replace("s AS (SELECT conv_id, turn, rn,", "s AS (SELECT part, o, rn,")},
f(part, rn, since, past, cut) AS (
  SELECT part, rn, 1, [surprise], false FROM s WHERE rn = 1
  UNION ALL
  SELECT part, rn, CASE WHEN cut THEN 0 ELSE since + 1 END, past, cut FROM (
    SELECT s.part, s.rn, f.since, list_append(f.past, s.surprise)[-64:] AS past,
      f.since >= 2 AND len(f.past) >= 3 AND list_stddev_pop(f.past) >= 1e-6 AND (s.surprise - list_avg(f.past)) / list_stddev_pop(f.past) > 1.0 AS cut
    FROM f JOIN s ON s.part = f.part AND s.rn = f.rn + 1))
SELECT s.part AS role, s.o, round(s.surprise, 6) AS surprise, f.cut AS boundary, sum(f.cut::INT) OVER (PARTITION BY s.part ORDER BY s.o) AS episode FROM s JOIN f ON s.part = f.part AND s.rn = f.rn""",
)
def _(t):
    rows = t.conversations.select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), F.col("text").alias("content"))
    return sequences.episodes(rows, "role", "o").withColumn("surprise", F.round("surprise", 6))


GRADE = "CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'purchase' THEN 4 ELSE 3 END"
REVIEWS = f"e AS (SELECT user_id, epoch(ts)::DOUBLE AS tm, {GRADE} AS g, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), {GRADE}) AS rn FROM events)"
FOLD = f"""{REVIEWS},
st(user_id, rn, s, d, last) AS (
  SELECT user_id, rn, [0.40, 1.18, 3.17, 15.69][g]::DOUBLE, greatest(1.0, least(10.0, 7.19 - 1.30 * (g - 3)))::DOUBLE, tm FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, CASE WHEN g = 1 THEN least(36500.0, greatest(0.1, s * 0.3)) ELSE least(36500.0, s * greatest(1.0, 1 + 1.6 * exp(2 * (1 - nd / 10)) * pow(s, -0.4) * (pow({math.e!r}, 1 - r) - 1) * CASE WHEN g = 2 THEN 0.85 ELSE 1.0 END * CASE WHEN g = 4 THEN 1.25 ELSE 1.0 END)) END, nd, tm
  FROM (SELECT e.user_id, e.rn, e.g, e.tm, st.s, greatest(1.0, least(10.0, 0.07 * (7.19 - 1.30) + 0.93 * (st.d - 1.05 * (e.g - 3))))::DOUBLE AS nd, pow(1 + 19.0::DOUBLE / 81.0 * greatest(0, e.tm - st.last) / 86400 / st.s, -0.5) AS r FROM st JOIN e ON e.user_id = st.user_id AND e.rn = st.rn + 1)
),
fin AS (SELECT user_id, arg_max(s, rn) AS s, arg_max(d, rn) AS d, max(last) AS last FROM st GROUP BY user_id),
nw AS (SELECT epoch(max(ts)) + 864000 AS now FROM events)"""


def reviews(t):
    grade = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 4).otherwise(3)
    return t.events.select("user_id", F.col("ts").cast("timestamp").cast("double").alias("at"), grade.alias("grade"))


def state_now(t):
    state = sequences.memory_state(reviews(t), "user_id")
    now = t.events.agg((F.max(F.col("ts").cast("timestamp").cast("double")) + 864000).alias("now"))
    return state.join(F.broadcast(now))  # one row


@query("fsrs_state", f"WITH RECURSIVE {FOLD} SELECT user_id, round(s, 4) AS s, round(d, 4) AS d FROM fin")
def _(t):
    return sequences.memory_state(reviews(t), "user_id").select("user_id", F.round("s", 4).alias("s"), F.round("d", 4).alias("d"))


@query("retention", f"WITH RECURSIVE {FOLD} SELECT user_id, round(pow(1 + 19.0::DOUBLE / 81.0 * (now - last) / 86400 / s, -0.5), 6) AS r FROM fin, nw")
def _(t):
    return state_now(t).select("user_id", F.round(memory.retrievability(F.col("now") - F.col("last"), F.col("s")), 6).alias("r"))


@query("at_risk", f"WITH RECURSIVE {FOLD}, r AS (SELECT user_id, pow(1 + 19.0::DOUBLE / 81.0 * (now - last) / 86400 / s, -0.5) AS r FROM fin, nw) SELECT user_id, round(1 - r, 6) AS risk FROM r WHERE r < 0.9")
def _(t):
    r = memory.retrievability(F.col("now") - F.col("last"), F.col("s"))
    return state_now(t).select("user_id", r.alias("r")).where("r < 0.9").select("user_id", F.round(1 - F.col("r"), 6).alias("risk"))


@query("tiers", f"WITH RECURSIVE {FOLD}, r AS (SELECT pow(1 + 19.0::DOUBLE / 81.0 * (now + user_id * 864000 - last) / 86400 / s, -0.5) AS r FROM fin, nw) SELECT CASE WHEN r >= 0.6 THEN 'hot' WHEN r >= 0.25 THEN 'warm' WHEN r >= 0.05 THEN 'cold' ELSE 'pruned' END AS tier, count(*) AS n FROM r GROUP BY 1")
def _(t):
    r = memory.retrievability(F.col("now") + F.col("user_id") * 864000 - F.col("last"), F.col("s"))
    return state_now(t).select(memory.tier(r).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


CLASSES = [(i, k, float(d) * fixed.DAY) for i, (k, d) in enumerate([("verbatim", 900), ("identity", 900), ("capacity", 180), ("status", 3), ("position", 0.25), ("unknown", 15), ("status", 45)])]
HALF = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.HALF_LIFE.items() if v)


@query("staleness", f"SELECT id, round((CASE WHEN k IN ('verbatim', 'identity') THEN 0.0 ELSE 1 - pow(0.5, age / CASE k {HALF} END) END)::DOUBLE, 6) AS staleness FROM ({values(CLASSES)}) AS v(id, k, age)")
def _(t):
    return t.rows(CLASSES, "id int, k string, age double").select("id", F.round(memory.staleness(F.col("age"), F.col("k")), 6).alias("staleness"))


@query(
    "coup_windows",
    """WITH RECURSIVE a AS (SELECT user_id AS src, epoch(ts)::DOUBLE / 400 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)) AS rn FROM events),
f(src, rn, tm, ok, allowed) AS (
  SELECT src, rn, tm, [tm], true FROM a WHERE rn = 1
  UNION ALL
  SELECT src, rn, tm, CASE WHEN len(live) <= 5 THEN list_append(live, tm) ELSE live END, len(live) <= 5
  FROM (SELECT a.src, a.rn, a.tm, list_filter(f.ok, lambda x: x > a.tm - 3600) AS live FROM f JOIN a ON a.src = f.src AND a.rn = f.rn + 1))
SELECT src, count(*) AS attempts, count(*) FILTER (allowed) AS allowed FROM f GROUP BY src""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("src"), (F.col("ts").cast("timestamp").cast("double") / 400).alias("at"))
    return sequences.coup(rows, "src").groupBy("src").agg(F.count("*").alias("attempts"), F.sum(F.col("allowed").cast("long")).alias("allowed"))


@query("group_cap", """WITH r AS (SELECT lang AS q, source AS g, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY q, g ORDER BY rank) AS k FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (k > 2)::INT, rank) AS place FROM w)
SELECT q AS query_id, place::INT AS place, doc_id FROM p WHERE place <= 50""")
def _(t):
    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    ranked = t.documents.select(F.col("lang").alias("query_id"), "source", "doc_id", F.row_number().over(w).alias("rank"))
    return retrieval.group_cap(ranked, "source", 2, 50).select("query_id", "place", "doc_id")


@query("token_budget", """WITH r AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS c, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)
SELECT conv_id, count(*) AS kept, sum(c)::BIGINT AS tokens FROM r WHERE s - c < 100 GROUP BY conv_id""")
def _(t):
    rows = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    kept = retrieval.token_budget(rows, 100, "text")
    return kept.groupBy(F.col("query_id").alias("conv_id")).agg(F.count("*").alias("kept"), F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("tokens"))


@query("as_of", """WITH o AS (SELECT doc_id, doc_id * 60 AS observed_at, CASE WHEN doc_id % 3 = 0 THEN doc_id * 30 END AS valid_from, CASE WHEN doc_id % 5 = 0 THEN doc_id * 50 END AS valid_to FROM documents)
SELECT doc_id FROM o WHERE (valid_from IS NULL OR valid_from <= 20000) AND (valid_to IS NULL OR valid_to >= 20000) AND (observed_at <= 20000 OR valid_from IS NOT NULL)""")
def _(t):
    i = F.col("doc_id")
    rows = t.documents.select("doc_id", (i * 60).alias("observed_at"), F.when(i % 3 == 0, i * 30).alias("valid_from"), F.when(i % 5 == 0, i * 50).alias("valid_to"))
    return rows.where(retrieval.as_of(F.lit(20000))).select("doc_id")


@query("divergence", """WITH e AS (SELECT user_id, event_type, epoch(ts) AS tm FROM events), old AS (SELECT user_id, max(tm) AS held FROM e WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, round(held, 3)::DOUBLE AS held FROM old WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = old.user_id AND e.event_type = 'purchase' AND e.tm > old.held)""")
def _(t):
    at = F.col("ts").cast("timestamp").cast("double")
    rows = t.events.select("user_id", "event_type", at.alias("at"))
    old = rows.where("event_type = 'view'").groupBy("user_id").agg(F.max("at").alias("held"))
    newest = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("at").alias("new"))
    return old.join(newest, "user_id", "left").where("new is null or new <= held").select("user_id", F.round("held", 3).alias("held"))


@query("quarantine_report", "SELECT source, count(*) AS written, count(*) FILTER (toxic = 1) AS quarantined FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def _(t):
    joined = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("written"), F.sum(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("quarantined"))


OPINIONS = [(1, 1.0, 0.0, 0.9), (2, 5.0, 4.0, 0.9), (3, 0.0, 6.0, 0.5), (4, 20.0, 1.0, 1.0), (5, 0.0, 0.0, 1.0)]


@query("opinion", f"""WITH o AS (SELECT id, w * s / (s + a + 2) AS b, w * a / (s + a + 2) AS d FROM ({values(OPINIONS)}) AS v(id, s, a, w)), u AS (SELECT *, 1 - b - d AS u FROM o)
SELECT id, round(b, 6)::DOUBLE AS belief, round(d, 6)::DOUBLE AS disbelief, round(u, 6)::DOUBLE AS uncertainty, round(b + 0.5 * u, 4)::DOUBLE AS expectation,
CASE WHEN u > 0.8 THEN 'vacuous' WHEN b > 0.2 AND d > 0.2 AND u < 0.5 THEN 'contested' WHEN b > d THEN 'supported' ELSE 'disputed' END AS verdict FROM u""")
def _(t):
    o = memory.discounted(F.col("w"), memory.opinion(F.col("s"), F.col("a")))
    rows = t.rows(OPINIONS, "id int, s double, a double, w double").select("id", o.alias("o"))
    r = lambda f, n: F.round(F.col(f"o.{f}"), 6).alias(n)
    return rows.select("id", r("b", "belief"), r("d", "disbelief"), r("u", "uncertainty"), memory.expectation(F.col("o")).alias("expectation"), memory.verdict(F.col("o")).alias("verdict"))


GATES = [(1, 0, 0.9, 0.9, 0.9, 0.0, 0.5, None, "dont_know"), (2, 3, 0.1, 0.9, 0.9, 0.0, 0.5, None, "dont_know"), (3, 3, 0.9, 0.3, 0.2, 0.0, 0.5, None, "tip_of_tongue"), (4, 3, 0.9, 0.3, 0.9, 0.8, 0.5, None, "tip_of_tongue"),
         (5, 3, 0.9, 0.7, 0.9, 0.0, 0.5, None, "know"), (6, 3, 0.9, 0.7, 0.9, 0.0, 0.5, 0, "know_where"), (7, 3, 0.9, 0.3, 0.9, 0.0, 0.1, None, "familiar"), (8, 3, 0.9, 0.3, 0.9, 0.0, 0.5, 1, "know_where"), (9, 3, 0.9, 0.1, 0.9, 0.0, 0.5, None, "dont_know")]


@query("gate_states", f"SELECT id, state FROM ({values([(g[0], g[-1]) for g in GATES])}) AS v(id, state)")
def _(t):
    rows = t.rows(GATES, "id int, n int, f double, best double, r double, c double, rec double, has int, want string")
    return rows.select("id", memory.gate(F.col("n"), F.col("f"), F.col("best"), F.col("r"), F.col("c"), F.col("rec"), F.col("has").cast("boolean")).alias("state"))


def _streamed(t, plan):
    """The last result of a streaming aggregate over the events, all of them read, written by the executors."""
    import uuid

    from provenspark.sources.store import shared_dir

    rows = t.events
    path = f"{shared_dir(t.spark)}/batches-{uuid.uuid4().hex}"
    found = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/events.parquet")
    several = found.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{t.folder}/events.parquet" + ("" if several else "*"))
    told = plan(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    run = told.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows-{n}")).option("checkpointLocation", f"{path}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    last = max(p["batchId"] for p in run.recentProgress)
    return t.spark.read.schema(told.schema).parquet(f"{path}/rows-{last}")


@query("stream_batches", "SELECT to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS start, event_type AS partition, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    from provenspark.streaming.segments import batches

    return _streamed(t, lambda s: batches(s.withColumnRenamed("event_type", "partition"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_attempts", f"""WITH e AS (SELECT user_id, ts, unnest(range(0, 12)) AS k FROM events) SELECT to_timestamp(floor(epoch(ts) / 300) * 300 - k * 300)::TIMESTAMP AS start, user_id AS source_ref, count(*) AS n, count(*) > {fixed.COUP_LIMIT} AS alarm FROM e GROUP BY ALL""")
def _(t):
    from provenspark.streaming.segments import attempts

    return _streamed(t, lambda s: attempts(s.withColumnRenamed("user_id", "source_ref"))).withColumn("start", F.col("start").cast("timestamp_ntz"))
