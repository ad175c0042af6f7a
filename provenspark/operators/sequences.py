"""Sequence operators: event segmentation, memory folds, supersession windows, calibration and track records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenspark.functions import fixed, memory, text

WINDOW, SEEN, THRESHOLD, LEAST = 8, 64, 1.0, 2


def surprise(rows: DataFrame, by: list[str], order: list[str], content: str = "content") -> DataFrame:
    """rows with surprise: share of a text's distinct tokens that the eight before it do not have."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_tok", F.array_distinct(text.tokens(F.col(content)))).withColumn("_rn", F.row_number().over(w))
    before = F.flatten(F.collect_list("_tok").over(w.rowsBetween(-WINDOW, -1)))
    seen = marked.withColumn("_before", before)
    share = F.size(F.array_except("_tok", "_before")) / F.size("_tok")
    return seen.withColumn("surprise", F.when(F.size("_tok") == 0, 0.0).when(F.col("_rn") == 1, 1.0).otherwise(share)).drop("_tok", "_before", "_rn")


def _stands_out(past: Column, s: Column) -> Column:
    """Whether a surprise is more than one deviation over those before it, of which there are three at least."""
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    spread = lambda p, mean: F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(p))
    over = text.let(total(past) / F.size(past), lambda mean: text.let(spread(past, mean), lambda sd: F.when(sd < 1e-6, False).otherwise((s - mean) / sd > THRESHOLD)))
    return F.when(F.size(past) < 3, False).otherwise(F.coalesce(over, F.lit(False)))


def episodes(rows: DataFrame, by: str, order: str, content: str = "content") -> DataFrame:
    """(by, order, surprise, boundary, episode) for each row of a stream.

    A boundary stands out from the 64 rows before it and silences the two after
    it.  Rows that stand out three or more apart do not meet, so only runs of
    closer ones are folded; those are short, as no more than half of a window
    lies a deviation over its mean.
    """
    told = surprise(rows, [by], [order], content).select(by, order, "surprise")
    w = Window.partitionBy(by).orderBy(order)
    past = F.collect_list("surprise").over(w.rowsBetween(-SEEN, -1))
    placed = told.withColumn("_past", past).withColumn("_rn", F.row_number().over(w))
    marked = placed.withColumn("_out", F.when(_stands_out(F.col("_past"), F.col("surprise")), F.col("_rn"))).drop("_past")
    last = F.last("_out", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("_new", F.coalesce(F.col("_out") - last > LEAST, F.col("_out").isNotNull()).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.collect_list("_out").over(Window.partitionBy(by, "_run").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0))
    cut = F.aggregate("_near", F.lit(-LEAST), lambda at, x: F.when(x - at > LEAST, x).otherwise(at)) == F.col("_out")
    flat = runs.withColumn("_near", near).withColumn("boundary", F.coalesce(cut, F.lit(False)))
    return flat.withColumn("episode", F.sum(F.col("boundary").cast("int")).over(Window.partitionBy(by).orderBy("_rn"))).select(by, order, "surprise", "boundary", "episode")


def memory_state(reviews: DataFrame, key: str | list[str], at: str = "at", grade: str = "grade") -> DataFrame:
    """(key, s, d, last) after all reviews in order."""
    keys = [key] if isinstance(key, str) else key
    history = reviews.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("at"), F.col(grade).cast("int").alias("grade")))).alias("h"))
    return history.select(*keys, memory.reviewed(F.col("h")).alias("m")).select(*keys, "m.s", "m.d", "m.last")


def retention(exposures: DataFrame, now: Column) -> DataFrame:
    """(who, node, retrievability, last): what each person still holds, from how they were told."""
    state = memory_state(exposures.withColumn("grade", memory.channel_grade(F.col("channel"))), ["who", "node"])
    return state.select("who", "node", memory.retrievability(now - F.col("last"), F.col("s")).alias("retrievability"), "last")


def coup(attempts: DataFrame, by: str = "source_ref", at: str = "at") -> DataFrame:
    """(by, at, allowed): a source's attempts to supersede; more than five allowed ones within an hour block the next.

    Only allowed attempts count, so each decision feeds the next: a fold.
    """
    zero = F.struct(F.array().cast("array<double>").alias("ok"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        live = F.filter(acc["ok"], lambda x: x > t - fixed.COUP_SECONDS)
        allowed = F.size(live) <= fixed.COUP_LIMIT
        return F.struct(F.when(allowed, F.concat(live, F.array(t))).otherwise(live).alias("ok"), F.concat(acc["out"], F.array(allowed)).alias("out"))

    packed = attempts.groupBy(by).agg(F.array_sort(F.collect_list(F.col(at).cast("double"))).alias("t"))
    flags = packed.select(by, "t", F.aggregate("t", zero, step, lambda acc: acc["out"]).alias("a"))
    return flags.select(by, F.explode(F.arrays_zip("t", "a")).alias("x")).select(by, F.col("x.t").alias("at"), F.col("x.a").alias("allowed"))


def brier(rows: DataFrame) -> DataFrame:
    """Calibration by producer and claim kind from (producer, claim_kind, confidence, outcome); open rows do not count."""
    done = rows.where("outcome is not null").withColumn("o", F.col("outcome").cast("double"))
    g = done.groupBy("producer", "claim_kind").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("o").alias("a"), F.avg((F.col("confidence") - F.col("o")) * (F.col("confidence") - F.col("o"))).alias("b"))
    verdict = F.when(F.col("n") < 10, "insufficient").when(F.col("c") - F.col("a") > 0.10, "overconfident").when(F.col("a") - F.col("c") > 0.15, "underconfident").otherwise("calibrated")
    return g.select("producer", "claim_kind", "n", F.round("c", 3).alias("confidence"), F.round("a", 3).alias("accuracy"), F.round("b", 4).alias("brier"), verdict.alias("verdict"))


def reliability_curve(rows: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, n, stated, observed) of equal bins, empty ones too."""
    done = rows.where("outcome is not null").withColumn("bin", F.floor(F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("confidence"))) * bins).cast("int"))
    g = done.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("stated"), F.round(F.avg(F.col("outcome").cast("double")), 3).alias("observed"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "stated", "observed")


def running(rows: DataFrame, order: str, value: str, name: str, ranges: int = 200) -> DataFrame:
    """rows with the sum of value over all rows of a smaller order: sums of ranges between quantiles first, then within a range.

    Rows of equal order must be one row.
    """
    cuts = rows.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)]).alias("_cuts"))  # one row
    placed = rows.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(order)))).drop("_cuts")
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_range", "_before")  # at most `ranges` rows
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return placed.withColumn(name, within).join(F.broadcast(totals), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: probability that a positive scores above a negative, ties half, null without both; from ranks of score groups."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("p"))
    parts = running(by, "s", "neg", "below")
    return parts.agg(F.round(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("neg") / 2)), F.sum("p") * F.sum("neg")), 4).alias("auc"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; 0 where either side does not vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def track_record(rows: DataFrame, key: str, good: str, bad: str) -> DataFrame:
    """(key, good, bad, accuracy, grade) with Laplace's rule; fewer than three outcomes are grade F."""
    g = rows.groupBy(key).agg(F.sum(F.col(good).cast("long")).alias("good"), F.sum(F.col(bad).cast("long")).alias("bad"))
    n = F.col("good") + F.col("bad")
    acc = (F.col("good") + 1) / (n + 2)
    grade = F.when(n < 3, "F").when(acc >= 0.9, "A").when(acc >= 0.75, "B").when(acc >= 0.6, "C").when(acc >= 0.4, "D").otherwise("E")
    return g.select(key, "good", "bad", F.round(acc, 3).alias("accuracy"), grade.alias("grade"))


def half_life(rows: DataFrame, key: str = "claim_class", survived: str = "survived") -> DataFrame:
    """(key, n, half_life): ln 2 times the mean survival, from twelve events on."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(survived).alias("m"))
    return g.select(key, "n", F.when((F.col("n") >= fixed.EVENTS_TO_FIT) & (F.col("m") > 0), F.col("m") * math.log(2)).alias("half_life"))


def corroboration(rows: DataFrame, proposition: str, origin: str) -> DataFrame:
    """(proposition, independent, weight) of distinct non-empty origins."""
    g = rows.groupBy(proposition).agg(F.countDistinct(F.when(F.col(origin) != "", F.col(origin))).alias("independent"))
    return g.withColumn("weight", memory.corroboration(F.col("independent")))


def maturity(rows: DataFrame, at: str, source: str) -> DataFrame:
    """One row: geometric mean of days, memories and sources, each half full at 21, 200 and 8."""
    g = rows.agg(((F.max(at) - F.min(at)) / fixed.DAY).alias("days"), F.count("*").alias("memories"), F.countDistinct(source).alias("sources"))
    part = lambda c, half: F.when(F.col(c) > 0, F.col(c) / (F.col(c) + half)).otherwise(0.0)
    return g.select("days", "memories", "sources", F.round(F.pow(part("days", 21.0) * part("memories", 200.0) * part("sources", 8.0), F.lit(1 / 3)), 4).alias("coverage"))
