"""Memory, evidence and gate arithmetic as Column -> Column functions and native folds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenspark.functions import fixed
from provenspark.functions.text import lookup


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def retrievability(seconds: Column, stability: Column) -> Column:
    """Probability of recall after that many seconds; 0 without stability."""
    days = F.greatest(F.lit(0.0), seconds) / fixed.DAY
    return F.when(stability <= 0, 0.0).otherwise(F.pow(1 + fixed.CURVE * days / stability, F.lit(fixed.POWER)))


def first_state(grade: Column) -> Column:
    """struct<s, d> of a new memory by grade 1 to 4."""
    g = clamp(grade.cast("int"), 1, 4).cast("int")
    d = clamp(fixed.DIFFICULTY - fixed.DIFFICULTY_SLOPE * (g - 3), 1.0, 10.0)
    return F.struct(F.element_at(F.array(*[F.lit(x) for x in fixed.FIRST_STABILITY]), g).alias("s"), d.alias("d"))


def review(s: Column, d: Column, seconds: Column, grade: Column) -> Column:
    """struct<s, d> after a review."""
    g = clamp(grade.cast("int"), 1, 4).cast("int")
    r = retrievability(seconds, s)
    target = d - fixed.DIFFICULTY_STEP * (g - 3)
    hard = clamp(fixed.REVERT * (fixed.DIFFICULTY - fixed.DIFFICULTY_SLOPE) + (1 - fixed.REVERT) * target, 1.0, 10.0)
    bonus = F.when(g == 2, fixed.HARD).otherwise(1.0) * F.when(g == 4, fixed.EASY).otherwise(1.0)
    gain = 1 + fixed.GAIN * F.exp(fixed.GAIN_FACTOR * (1 - hard / 10)) * F.pow(s, F.lit(fixed.GAIN_DECAY)) * (F.pow(F.lit(math.e), 1 - r) - 1) * bonus
    new = F.when(g == 1, F.greatest(F.lit(fixed.LEAST_STABILITY), s * fixed.LAPSE)).otherwise(s * F.greatest(F.lit(1.0), gain))
    return F.struct(F.least(new, F.lit(fixed.MOST_STABILITY)).alias("s"), hard.alias("d"))


def reviewed(history: Column) -> Column:
    """struct<s, d, last> after array<struct<at: double, grade: int>> in order, the first one being the start."""
    head = history[0]
    start = first_state(head["grade"])
    zero = F.struct(start["s"].cast("double").alias("s"), start["d"].cast("double").alias("d"), head["at"].cast("double").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        new = review(acc["s"], acc["d"], x["at"] - acc["last"], x["grade"])
        return F.struct(new["s"].alias("s"), new["d"].alias("d"), x["at"].cast("double").alias("last"))

    return F.aggregate(F.slice(history, 2, F.greatest(F.lit(0), F.size(history) - 1)), zero, step)


def salience(r: Column, surprise: Column, open_loop: Column, cost: Column, criticality: Column) -> Column:
    """Weight of a memory in ranking."""
    return r * (1 + 0.5 * surprise) * F.when(open_loop, 1.35).otherwise(1.0) * (1 + 0.6 * cost) * (1 + 0.5 * criticality)


def tier(r: Column) -> Column:
    """hot, warm, cold or pruned."""
    out = F.when(r >= fixed.TIERS[0][1], fixed.TIERS[0][0])
    for name, least in fixed.TIERS[1:]:
        out = out.when(r >= least, name)
    return out.otherwise("pruned")


def activation(log: Column, now: Column, power: float = 0.5) -> Column:
    """Base-level activation of an access log in seconds; minus infinity if it is empty."""
    total = F.aggregate(log, F.lit(0.0), lambda acc, t: acc + F.pow(F.greatest(F.lit(1.0), now - t) / fixed.DAY, F.lit(-power)))
    return F.when(total > 0, F.ln(total)).otherwise(F.lit(float("-inf")))


def acquisition_cost(seconds: Column, calls: Column, sources: Column, minutes: Column, travel: Column) -> Column:
    """How dear a memory was, 0 to 1: each part is half its weight at its half point."""
    part = lambda x, half, weight: F.when(x > 0, weight * x / (x + half)).otherwise(0.0)
    mix = part(seconds, 900.0, 0.15) + part(calls, 4.0, 0.15) + part(sources, 3.0, 0.25) + part(minutes, 20.0, 0.45)
    return F.round(clamp(F.when(travel, F.greatest(mix, F.lit(0.75))).otherwise(mix), 0.0, 1.0), 4)


def credibility(seconds: Column, claim_class: Column, learned: Column | None = None) -> Column:
    """Share of a claim that is still good; classes without a half-life never decay."""
    prior = lookup({k: v for k, v in fixed.HALF_LIFE.items() if v}, claim_class)
    never = claim_class.isin(*[k for k, v in fixed.HALF_LIFE.items() if v is None])
    half = prior if learned is None else F.coalesce(learned, prior)
    half = F.coalesce(half, F.lit(fixed.HALF_LIFE["unknown"]))
    kept = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), seconds) / half)
    return F.when(never & (F.lit(learned is None) if learned is None else learned.isNull()), 1.0).otherwise(kept)


def staleness(seconds: Column, claim_class: Column, learned: Column | None = None) -> Column:
    return 1 - credibility(seconds, claim_class, learned)


def admiralty(reliability: Column, cred: Column) -> Column:
    """Product of the reliability's and the credibility's weight."""
    return lookup(fixed.RELIABILITY, reliability, 0.5) * lookup(fixed.CREDIBILITY, cred, 0.5)


def corroborated_grade(rel_a: Column, cred_a: Column, rel_b: Column, cred_b: Column) -> Column:
    """struct<reliability, credibility>: the better of both, one step more credible if they differ."""
    best = F.least(cred_a, cred_b)
    differ = (rel_a != rel_b) | (cred_a != cred_b)
    return F.struct(F.least(rel_a, rel_b).alias("reliability"), F.when(differ, F.greatest(F.lit(1), best - 1)).otherwise(best).alias("credibility"))


def corroboration(n: Column) -> Column:
    """Weight of n independent origins; none for one."""
    return F.when(n <= 1, 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.5 + 0.2 * (n - 2)), 3))


def may_supersede(new: Column, old: Column, trust: Column) -> Column:
    """A trusted source of no lower rank."""
    rank = lambda g: lookup(fixed.SUPERSESSION_RANK, g, 2)
    return (trust == "trusted") & (rank(new) >= rank(old))


def severity(criticality: Column, weight: Column, cause: Column, reversible: Column) -> Column:
    """How much it matters that a decision's basis moved."""
    base = lookup({"retracted": 1.0, "discredited": 0.9, "superseded": 0.75, "stale": 0.45}, cause)
    s = base * (0.4 + 0.6 * F.least(F.lit(1.0), criticality)) * clamp(weight, 0.2, 1.0)
    return F.round(F.when(reversible, F.least(F.lit(1.0), s * 1.25)).otherwise(s), 4)


def channel_grade(channel: Column) -> Column:
    """Review grade of a way of being told."""
    depth = lookup(fixed.CHANNEL_DEPTH, channel, fixed.OTHER_DEPTH)
    return F.when(depth >= 1.4, 4).when(depth >= 1.0, 3).when(depth >= 0.6, 2).otherwise(1)


def divergence_severity(retention: Column, stale: Column, consequence: Column | float = 1.0) -> Column:
    return clamp(retention * stale * consequence, 0.0, 1.0)


def stale_side(person_seconds: Column, present: Column, record_seconds: Column, weight: Column) -> Column:
    """Which side holds the older belief: a first-hand, fresher person outranks the record."""
    return F.when(present & (person_seconds < record_seconds), "ledger_stale").otherwise("user_stale")


def demoted(tag: Column, steps: int = 1) -> Column:
    """The epistemic tag some steps down; null beyond the last."""
    names = sorted(fixed.EPISTEMIC_RANK, key=fixed.EPISTEMIC_RANK.get)
    down = {n: names[i + steps] for i, n in enumerate(names) if i + steps < len(names)}
    return lookup(down, tag)


def level(similarity: Column, floor: float = fixed.SIMILARITY_FLOOR, ceiling: float = 1.0) -> Column:
    """Place of a similarity in the encoder's own range."""
    return clamp((similarity - floor) / max(0.05, ceiling - floor), 0.0, 1.0)


def density(best: Column, background: Column, floor: float = fixed.SIMILARITY_FLOOR, level_weight: float = fixed.LEVEL_WEIGHT, ceiling: float = 1.0) -> Column:
    """Level and margin above the background as one number."""
    own = level(best, floor, ceiling)
    margin = clamp((best - background) / fixed.MARGIN_SCALE, 0.0, 1.0)
    mixed = F.round(F.least(F.lit(1.0), level_weight * own + (1 - level_weight) * margin), 4)
    return F.when(best <= floor, 0.0).when(background.isNull(), own).otherwise(mixed)


def recollection(episode: Column, period: Column, provenance: Column, standalone: Column, neighbours: Column) -> Column:
    """How much surrounds a match."""
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    total = one(episode, 0.30) + one(period, 0.15) + one(provenance, 0.25) + one(standalone, 0.15) + F.least(F.lit(0.15), 0.05 * neighbours)
    return F.round(F.least(F.lit(1.0), total), 3)


def gate(candidates: Column, familiarity: Column, best: Column, retrievable: Column, conflict: Column, recollected: Column, has_answer: Column) -> Column:
    """State of knowing; has_answer: null where the question asks for nothing in particular."""
    familiar = best >= fixed.KNOW_WHERE
    held = retrievable >= fixed.KNOW_RETRIEVABILITY
    return (
        F.when((candidates == 0) | (familiarity < fixed.COVERAGE_FLOOR), "dont_know")
        .when(familiar & ~held, "tip_of_tongue")
        .when(familiar & (conflict > fixed.CONFLICT_CEILING), "tip_of_tongue")
        .when((best >= fixed.KNOW) & held & ~F.coalesce(has_answer, F.lit(True)), "know_where")
        .when((best >= fixed.KNOW) & held, "know")
        .when(familiar & (recollected < fixed.RECOLLECTION_FLOOR), "familiar")
        .when(familiar, "know_where")
        .otherwise("dont_know")
    )


def opinion(support: Column, against: Column, base_rate: float = 0.5, prior: float = 2.0) -> Column:
    """struct<b, d, u, a> of counted evidence."""
    total = support + against + prior
    return F.struct((support / total).alias("b"), (against / total).alias("d"), (F.lit(prior) / total).alias("u"), F.lit(base_rate).alias("a"))


def discounted(trust: Column, o: Column) -> Column:
    """What is left of an opinion told by a source of that trust; the lost mass is ignorance."""
    b, d = clamp(trust, 0.0, 1.0) * o["b"], clamp(trust, 0.0, 1.0) * o["d"]
    return F.struct(b.alias("b"), d.alias("d"), (1 - b - d).alias("u"), o["a"].alias("a"))


def fused(x: Column, y: Column) -> Column:
    """Cumulative fusion of two independent opinions; two certain ones are averaged."""
    certain = (x["u"] < 1e-9) & (y["u"] < 1e-9)
    k = F.when(certain, 1.0).otherwise(x["u"] + y["u"] - x["u"] * y["u"])
    mix = lambda f: F.when(certain, (x[f] + y[f]) / 2).otherwise((x[f] * y["u"] + y[f] * x["u"]) / k)
    return F.struct(mix("b").alias("b"), mix("d").alias("d"), F.when(certain, 0.0).otherwise(x["u"] * y["u"] / k).alias("u"), ((x["a"] + y["a"]) / 2).alias("a"))


def concluded(least_belief: Column, most_ignorance: Column, own: Column) -> Column:
    """An opinion held to its parents': no more belief, no less ignorance, and ignorance wins."""
    u = F.greatest(own["u"], most_ignorance)
    b = F.least(own["b"], least_belief)
    b = F.when(b + u > 1, F.greatest(F.lit(0.0), 1 - u)).otherwise(b)
    return F.struct(b.alias("b"), F.greatest(F.lit(0.0), 1 - b - u).alias("d"), u.alias("u"), own["a"].alias("a"))


def expectation(o: Column) -> Column:
    return F.round(o["b"] + o["a"] * o["u"], 4)


def verdict(o: Column) -> Column:
    """vacuous, contested, supported or disputed."""
    contested = (o["b"] > 0.2) & (o["d"] > 0.2) & (o["u"] < 0.5)
    return F.when(o["u"] > 0.8, "vacuous").when(contested, "contested").when(o["b"] > o["d"], "supported").otherwise("disputed")


def sleep_pressure(unconsolidated: Column, interference: Column, hours: Column) -> Column:
    return F.round(unconsolidated * (0.5 + interference) + hours / 24.0, 4)


def hypothesis_status(status: Column, expires: Column, now: Column, supporting: Column, opposing: Column) -> Column:
    """The next state of a hypothesis; promoted and failed ones stay."""
    return (
        F.when(status.isin("promoted", "archived_failed"), status)
        .when(F.coalesce(now >= expires, F.lit(False)) & (status != "testing"), "expired")
        .when(opposing > supporting, "archived_failed")
        .when((supporting >= 2) & (opposing == 0), "promoted")
        .when(supporting + opposing > 0, "testing")
        .otherwise(status)
    )


def rescaled(threshold: float, background: Column) -> Column:
    """A threshold moved into the range above the background."""
    return F.round(background + threshold * (1 - background), 3)
