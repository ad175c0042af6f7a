"""Deterministic text kernels as Column -> Column functions, free of Python at run time."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenspark.functions import fixed

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēėęěğīįłńňōőřśşšťūůűųźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeeegiilnnoorssstuuuuzzz"


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small literal table as a map."""
    items = [F.lit(x) for pair in table.items() for x in pair]
    found = F.element_at(F.create_map(*items), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often a lambda inside f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(text: Column) -> Column:
    """Search tokens in order, stop words and single characters left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(fixed.TOKEN), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*fixed.STOP_WORDS) & (F.length(t) > 1))


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (n - df + .5) / (df + .5)); 0 without documents."""
    return F.when((df > 0) & (n > 0), F.log1p((n - df + 0.5) / (df + 0.5))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_cue(text: Column, cues, default: str | None) -> Column:
    """The name of the first pattern that is found."""
    out = F.when(text.rlike(cues[0][1]), F.lit(cues[0][0]))
    for name, pattern in cues[1:]:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default)) if default is not None else out


def claim_class(text: Column) -> Column:
    """verbatim, position, status, capacity, identity or unknown."""
    t = F.coalesce(text, F.lit(""))
    exact = reduce(lambda a, b: a | b, [t.rlike("(?i)" + p) for p in fixed.VERBATIM])
    return F.when(exact, "verbatim").otherwise(first_cue(F.lower(t), fixed.CLASS_CUES, "unknown"))


def identifiers(text: Column) -> Column:
    """array<array<string>>: the upper-cased identifiers of each of the seven kinds."""
    t = F.coalesce(text, F.lit(""))
    return F.array(*[F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(0)), lambda x: F.upper(F.trim(x)))) for p in fixed.VERBATIM[: fixed.IDENTIFIERS]])


def exactness(have: Column, wanted: Column) -> Column:
    """Factor for a text's identifiers against a query's: exact, impostor of the same kind, none, or 1 if none is wanted."""
    kinds = F.zip_with(have, wanted, lambda h, w: F.struct(F.arrays_overlap(h, w).alias("hit"), ((F.size(h) > 0) & (F.size(w) > 0)).alias("same")))
    return (
        F.when(F.forall(wanted, lambda w: F.size(w) == 0), 1.0)
        .when(F.exists(kinds, lambda k: F.coalesce(k["hit"], F.lit(False))), fixed.EXACT)
        .when(F.exists(kinds, lambda k: k["same"]), fixed.IMPOSTOR)
        .otherwise(fixed.NO_IDENTIFIER)
    )


def answer_type(query: Column) -> Column:
    """What a question asks for, or null."""
    return first_cue(F.lower(F.coalesce(query, F.lit(""))), fixed.ANSWER_CUES, None)


def affinity(text: Column, want: Column) -> Column:
    """1.25 if the text holds the kind of thing asked for, .85 if not, 1 if nothing is asked for."""
    out = F.when(want.isNull(), 1.0)
    for kind, pattern in fixed.ANSWER_SHAPES.items():
        out = out.when((want == kind) & text.rlike(pattern), fixed.AFFINE).when(want == kind, fixed.NOT_AFFINE)
    return out.otherwise(1.0)


def shapes(text: Column) -> Column:
    """array<string>: the kinds of answer whose shape a text holds."""
    return F.filter(F.array(*[F.when(text.rlike(p), kind) for kind, p in fixed.ANSWER_SHAPES.items()]), lambda k: k.isNotNull())


def fitting(held: Column, want: Column) -> Column:
    """affinity of a text whose shapes are known."""
    return F.when(F.coalesce(want.isin(*fixed.ANSWER_SHAPES), F.lit(False)), F.when(F.array_contains(held, want), fixed.AFFINE).otherwise(fixed.NOT_AFFINE)).otherwise(1.0)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    t = F.coalesce(text, F.lit(""))

    def bits(x: Column) -> Column:
        left = lambda c: 1 - F.length(F.replace(x["t"], c, F.lit(""))) / x["n"]
        return F.aggregate(x["chars"], F.lit(0.0), lambda acc, c: acc - let(left(c), lambda p: p * F.log2(p)))

    return let(F.struct(t.alias("t"), F.length(t).alias("n"), F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")).alias("chars")), bits)


def screen(text: Column, origin: Column, contradiction: Column | None = None) -> Column:
    """struct<score, verdict, signals> of the signs that a text was planted.

    Every test is worked out once and bound; the costly ones only where a text is long.
    """
    t = F.coalesce(text, F.lit(""))
    (_, _, low), (_, _, repeated), (_, _, most) = fixed.LOW_ENTROPY, fixed.REPETITION, fixed.CONTRADICTION
    marks = [t.rlike(pattern) for _, _, pattern in fixed.INJECTION]
    long = F.length(t) > 200
    many = let(tokens(t), lambda k: F.struct((F.size(k) > 0).alias("some"), (F.size(F.array_distinct(k)) / F.greatest(F.size(k), F.lit(1)) < repeated).alias("few")))
    seen = F.struct(
        F.array(*marks).alias("marks"),
        t.rlike(fixed.BARE_IMPERATIVE[2]).alias("bare"),
        F.when(long, many).alias("many"),
        F.when(long, entropy(t) < low).alias("low"),
        (F.lit(False) if contradiction is None else F.coalesce(contradiction > most, F.lit(False))).alias("against"),
        F.when(origin == "user_utterance", fixed.USER_WEIGHT).otherwise(1.0).alias("weight"),
    )
    names = [n for n, _, _ in (*fixed.INJECTION, fixed.BARE_IMPERATIVE, fixed.LOW_ENTROPY, fixed.REPETITION, fixed.CONTRADICTION)]
    weights = [w for _, w, _ in (*fixed.INJECTION, fixed.BARE_IMPERATIVE, fixed.LOW_ENTROPY, fixed.REPETITION, fixed.CONTRADICTION)]

    def told(x: Column) -> Column:
        dense = F.coalesce(x["many"]["some"], F.lit(False))
        rest = F.array(x["bare"] & F.exists(x["marks"], lambda m: m), dense & F.coalesce(x["low"], F.lit(False)), dense & F.coalesce(x["many"]["few"], F.lit(False)), x["against"])
        return F.struct(F.concat(x["marks"], rest).alias("hits"), x["weight"].alias("weight"))

    def scored(x: Column) -> Column:
        total = F.aggregate(F.zip_with(x["hits"], F.array(*[F.lit(w) for w in weights]), lambda h, w: F.when(h, w).otherwise(0.0)), F.lit(0.0), lambda acc, w: acc + w)
        signals = F.array_compact(F.zip_with(x["hits"], F.array(*[F.lit(n) for n in names]), lambda h, n: F.when(h, n)))
        return F.struct(F.round(F.least(F.lit(1.0), total * x["weight"]), 3).alias("score"), signals.alias("signals"))

    judged = lambda x: F.struct(x["score"].alias("score"), F.when(x["score"] >= fixed.BLOCKED, "blocked").when(x["score"] >= fixed.SUSPECT, "suspect").otherwise("clean").alias("verdict"), x["signals"].alias("signals"))
    return let(let(let(seen, told), scored), judged)


def origin_key(source_ref: Column) -> Column:
    """The coarse origin of a source reference: its directory, or the first two parts of a colon reference."""
    s = F.lower(F.trim(F.coalesce(source_ref, F.lit(""))))
    scheme = s.rlike(r"^[a-z][a-z0-9+.-]*://")
    colon = F.filter(F.split(s, ":"), lambda x: x != "")
    path = F.filter(F.split(F.regexp_replace(s, r"^file://", ""), r"[/\\]"), lambda x: x != "")
    pieces = F.filter(F.split(s, r"[/\\]"), lambda x: x != "")
    parent = lambda a: F.array_join(F.slice(a, 1, F.greatest(F.lit(1), F.size(a) - 1)), "/")
    return (
        F.when(s == "", "unknown")
        .when(~scheme & s.contains(":"), F.array_join(F.slice(colon, 1, 2), ":"))
        .when(s.startswith("file://"), F.concat(F.lit("file:"), F.when(F.size(path) > 1, parent(path)).otherwise("")))
        .when(F.size(pieces) > 1, parent(pieces))
        .otherwise(F.regexp_extract(s, r"^(?:[a-z]+://)?([^/\\:]+)", 1))
    )


def proposition_hash(text: Column) -> Column:
    """One identity for texts of the same tokens."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens(text))), " "), 256), 1, 24)


def canonical(name: Column) -> Column:
    """A name without accents, case, leading title, punctuation or double spaces."""
    s = F.translate(F.lower(F.coalesce(name, F.lit(""))), ACCENTED[: len(PLAIN)], PLAIN)
    s = F.regexp_replace(F.trim(s), fixed.TITLES, "")
    s = F.regexp_replace(s, r"[^\w\s-]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _unit_table() -> dict[str, str]:
    return {u: u for u in fixed.UNITS} | fixed.UNIT_ALIASES


def unit_pattern() -> str:
    """A number and a unit, longest unit names first."""
    return r"(?i)" + fixed.NUMBER + r"\s*(" + "|".join(re.escape(u) for u in sorted(_unit_table(), key=lambda u: (-len(u), u))) + r")\b"


def quantities(text: Column) -> Column:
    """array<struct<value, unit, dimension, base, raw>> in order."""
    t, p = F.coalesce(text, F.lit("")), F.lit(unit_pattern())
    raw, number, unit = (F.regexp_extract_all(t, p, F.lit(k)) for k in (0, 1, 2))
    units, dims, scale = _unit_table(), {u: d for u, (d, _) in fixed.UNITS.items()}, {u: f for u, (_, f) in fixed.UNITS.items()}
    rows = F.transform(F.arrays_zip(raw.alias("raw"), number.alias("number"), unit.alias("unit")), lambda x: F.struct(F.replace(x["number"], F.lit(","), F.lit("")).cast("double").alias("value"), lookup(units, F.lower(x["unit"])).alias("unit"), x["raw"].alias("raw")))
    return F.transform(rows, lambda x: F.struct(x["value"].alias("value"), x["unit"].alias("unit"), lookup(dims, x["unit"]).alias("dimension"), (x["value"] * lookup(scale, x["unit"])).alias("base"), x["raw"].alias("raw")))


def bare_numbers(text: Column) -> Column:
    """Distinct numbers that no quantity of the text has as its value."""
    every = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    return F.array_except(every, F.transform(quantities(text), lambda q: q["value"]))


def same_magnitude(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Two quantities of one dimension within the tolerance of the larger."""
    most = F.greatest(F.abs(a["base"]), F.abs(b["base"]))
    return (a["dimension"] == b["dimension"]) & ((most == 0) | (F.abs(a["base"] - b["base"]) / F.when(most == 0, 1.0).otherwise(most) <= tolerance))


def unit_conflicts(before: Column, after: Column) -> Column:
    """array<string>: quantities whose value changed or whose unit was lost by a rewrite; dropping one is no conflict."""
    def told(x: Column) -> Column:
        kept = lambda q: F.exists(x["new"], lambda n: same_magnitude(q, n))
        same_kind = lambda q: F.exists(x["new"], lambda n: n["dimension"] == q["dimension"])
        lost = lambda q: F.array_contains(x["bare"], q["value"])
        return F.transform(F.filter(x["old"], lambda q: ~kept(q) & (same_kind(q) | lost(q))), lambda q: F.concat(q["raw"], F.when(same_kind(q), ": value changed").otherwise(": lost its unit")))

    return let(F.struct(quantities(before).alias("old"), quantities(after).alias("new"), bare_numbers(after).alias("bare")), told)


def schema_of(text: Column) -> Column:
    """The text with its varying parts blanked, lower-cased."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), fixed.VARIABLE, "{}"))


def deltas_of(text: Column) -> Column:
    """The varying parts, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.VARIABLE), F.lit(0))


def negated(text: Column) -> Column:
    return text.rlike(r"(?i)(?<![\w'])(" + "|".join(fixed.NEGATORS) + r")(?![\w'])")


def presupposition(query: Column) -> Column:
    """What a question takes for granted: its text without the frame."""
    q = F.regexp_replace(F.trim(query), r"\?+$", "")
    q = F.trim(F.regexp_replace(q, fixed.FAILURE_FRAME, ""))
    return F.trim(F.regexp_replace(q, r"(?i)^(the|a|an)\s+", ""))


def counter_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9-]+)"), F.lit(1)), lambda w: F.length(w) > 2))


def polarity_flip(text: Column) -> Column:
    """Sorted words whose presence would turn the text's claim round."""
    terms = counter_terms(text)
    out = F.array().cast("array<string>")
    for left, right in fixed.OPPOSED:
        for side, other in ((left, right), (right, left)):
            have = F.arrays_overlap(terms, F.array(*[F.lit(w) for w in sorted(side)]))
            out = F.array_union(out, F.when(have, F.array(*[F.lit(w) for w in sorted(other)])).otherwise(F.array().cast("array<string>")))
    return F.array_sort(out)


def fidelity(original: Column, rebuilt: Column) -> Column:
    """Share of the original's tokens, repeats included, that remain; 0 if one with a digit is lost, 1 without tokens."""

    def share(x: Column) -> Column:
        lost = F.size(F.filter(x["old"], lambda t: F.array_contains(x["lost"], t)))
        return F.when(F.size(x["old"]) == 0, 1.0).when(F.exists(x["lost"], lambda t: t.rlike("[0-9]")), 0.0).otherwise(1.0 - lost / F.size(x["old"]))

    return let(F.struct(tokens(original).alias("old"), tokens(rebuilt).alias("new")), lambda x: let(F.struct(x["old"].alias("old"), F.array_except(x["old"], x["new"]).alias("lost")), share))


def needs_context(text: Column) -> Column:
    """Pronouns, relative dates or words such as here and now."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(r"\b(" + "|".join(fixed.PRONOUN_KINDS) + r")\b") | low.rlike(fixed.RELATIVE_DATE) | low.rlike(fixed.DEICTIC)


def resolve_date(phrase: Column, at: Column) -> Column:
    """ISO date of a relative phrase said at a time (UTC); null where it has none."""
    p, day = F.lower(F.trim(phrase)), F.to_date(at)
    out = (
        F.when(p.isin("today", "tonight", "this morning", "this afternoon", "this evening"), day)
        .when(p == "tomorrow", F.date_add(day, 1))
        .when(p.isin("yesterday", "last night"), F.date_sub(day, 1))
    )
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    spans = (
        F.when(p == "next week", F.concat(F.lit("week of "), iso(F.date_add(day, 7))))
        .when(p == "last week", F.concat(F.lit("week of "), iso(F.date_sub(day, 7))))
        .when(p == "next month", F.concat(F.lit("month after "), iso(day)))
        .when(p == "last month", F.concat(F.lit("month before "), iso(day)))
    )
    name = F.regexp_extract(p, r"^(?:next |last |this )?(monday|tuesday|wednesday|thursday|friday|saturday|sunday)$", 1)
    want = F.array_position(F.array(*[F.lit(d) for d in fixed.WEEKDAYS]), name).cast("int") - 1
    ahead = F.pmod(want - F.weekday(day), F.lit(7))
    back = F.pmod(F.weekday(day) - want, F.lit(7))
    move = F.when(p.startswith("last "), -F.when(back == 0, 7).otherwise(back)).when(p.startswith("next "), F.when(ahead == 0, 7).otherwise(ahead)).otherwise(ahead)
    return F.coalesce(spans, iso(F.coalesce(out, F.when(want >= 0, F.date_add(day, move)))))


def rewritten(value: Column, pattern: str, state: Column, step) -> Column:
    """struct<out, ...state>: value with every match of a pattern replaced, left to right.

    step(state, match) gives a struct whose field `as` is the replacement and
    whose other fields are the next state; pieces and matches are folded, so
    nothing is exploded.
    """
    hits, rest = F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), F.split(value, pattern, -1)
    names = [f"s{i}" for i in range(len(state))]
    zero = F.struct(F.get(rest, F.lit(0)).alias("out"), *[c.alias(n) for c, n in zip(state, names, strict=True)])

    def one(acc: Column, x: Column) -> Column:
        told = step([acc[n] for n in names], x["h"])
        return F.struct(F.concat(acc["out"], told[0], x["r"]).alias("out"), *[c.alias(n) for c, n in zip(told[1:], names, strict=True)])

    return F.aggregate(F.zip_with(hits, F.slice(rest, 2, F.greatest(F.lit(0), F.size(rest) - 1)), lambda h, r: F.struct(h.alias("h"), r.alias("r"))), zero, one)


def dated(content: Column, seconds: Column) -> Column:
    """A text with every relative date followed by its absolute one, for a time in seconds (UTC)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / fixed.DAY).cast("int"))
    return rewritten(F.coalesce(content, F.lit("")), "(?i)" + fixed.RELATIVE_DATE, [], lambda _, hit: [F.concat(hit, F.coalesce(F.concat(F.lit(" ("), resolve_date(hit, day), F.lit(")")), F.lit("")))])["out"]


def standalone(content: Column, seconds: Column, candidates: Column) -> Column:
    """struct<content, unresolved>: dates made absolute, pronouns named where exactly one unused candidate of a fitting kind is there.

    candidates: array<struct<name, kind>>.  A name stands for one pronoun only;
    a pronoun that fits none or several stays, and is unresolved with the words
    that point at a place or time.
    """
    kinds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(k) for k in x]) for pair in fixed.PRONOUN_KINDS.items() for x in pair])
    none = F.array().cast("array<string>")

    def name(state: list[Column], hit: Column) -> list[Column]:
        used, left = state
        fits = F.filter(F.coalesce(candidates, F.array().cast("array<struct<name:string,kind:string>>")), lambda c: F.array_contains(F.element_at(kinds, F.lower(hit)), c["kind"]) & ~F.array_contains(used, c["name"]))
        only = F.when(F.size(fits) == 1, F.get(fits, F.lit(0))["name"])
        ending = F.when(F.lower(hit).isin(*fixed.POSSESSIVE), "'s").otherwise("")
        return [F.coalesce(F.concat(only, ending), hit), F.when(only.isNull(), used).otherwise(F.concat(used, F.array(only))), F.when(only.isNull(), F.concat(left, F.array(F.lower(hit)))).otherwise(left)]

    words = r"(?i)\b(" + "|".join(sorted(fixed.PRONOUN_KINDS, key=lambda w: (-len(w), w))) + r")\b"
    named = let(dated(content, seconds), lambda t: rewritten(t, words, [none, none], name))
    pointing = F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit("(?i)" + fixed.DEICTIC), F.lit(1)), F.lower)
    return let(named, lambda x: F.struct(x["out"].alias("content"), F.concat(x["s1"], pointing).alias("unresolved")))


def correction_note(original: Column, corrected: Column, by: Column, reason: Column) -> Column:
    """The corrected text with who, why and what it was."""
    why = F.when(F.coalesce(reason, F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), reason))
    return F.concat(corrected, F.lit(" (corrected by "), by, why, F.lit("; was: '"), original, F.lit("')"))
