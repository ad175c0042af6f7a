"""Secrets in whole texts: fixed patterns, plus sliding-window Shannon entropy per character class.

Built-in DataFrame functions only.  A pattern's spans come from its matches and
the pieces between them, so positions are code points without any row being
exploded; a text costs one pass per pattern and has no shuffle.

*Base* kinds are ``assign`` (a named credential and its value), ``access`` (a
cloud access key) and ``hex`` (a long hexadecimal digest).  The entropy method
then looks at candidate strings of ``WINDOW`` characters or more: a window
slides over the candidate, counts of its characters are updated only for the
one that leaves and the one that enters, and the candidate is reported from
the first to the last window whose entropy reaches the bound of the
candidate's character class.  Candidates that match the allow list, are single
words or numbers, or lie within a base span add nothing; base spans stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, with the least length of what is kept.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Window in characters and least bits a character, by character class.
WINDOW = 20
BITS = {"hex": 3.05, "alnum": 3.65, "symbol": 3.75}
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: The candidates' characters, and how many five-bit counts a packed word holds.
ALPHABET, PACKED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 12
#: Strings that look random and are known not to be secrets: UUIDs, placeholders, alphabets, joined words and paths.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]?key|xxxx",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^[A-Za-z]+([/_=+-]+[A-Za-z]+)*[/_=+-]*[0-9]{0,4}$",
    r"^[0-9/_=+-]+$",
)


def _spans(text: Column, pattern: str, least: int | None = None) -> Column:
    """array<struct<start,end,hit>> of a pattern's leftmost non-overlapping matches; least: of group 1."""
    regex = F.lit(pattern)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    values = hits if least is None else F.regexp_extract_all(text, regex, F.lit(1))
    sized = F.zip_with(F.zip_with(F.split(text, pattern, -1), hits, lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit"))), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.length(v).alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        keep = F.concat(acc["found"], one)
        if least is not None:
            keep = F.when(x["value"] >= least, keep).otherwise(acc["found"])
        return F.struct(end.alias("at"), keep.alias("found"))

    some = F.filter(sized, lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(some, start, step, lambda acc: acc["found"])).otherwise(start["found"])


def _c_log_c(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 1)]), (c + 1).cast("int"))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _place(code: Column) -> tuple[Column, Column]:
    """The packed word of a character's count and the bits before it there."""
    return F.floor(code / PACKED).cast("int"), (code % PACKED * 5).cast("int")


def _held(counts: Column, code: Column) -> Column:
    """A character's count out of the packed ones."""
    word, bits = _place(code)
    return F.call_function("shiftright", F.get(counts, word), bits).bitwiseAND(F.lit(31))


def _moved(counts: Column, code: Column, by: int) -> Column:
    """Packed counts with one character's count changed by one."""
    word, bits = _place(code)
    return F.transform(counts, lambda w, i: F.when(i == word, w + by * F.call_function("shiftleft", F.lit(1).cast("long"), bits)).otherwise(w))


def char_class(s: Column) -> Column:
    """hex, alnum or symbol; null for words and numbers, which have no bound."""
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return (
        F.when(mixed & s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(mixed & s.rlike("^[A-Za-z0-9]+$"), "alnum")
        .when(mixed, "symbol")
    )


def hot_windows(s: Column, bits: Column) -> Column:
    """struct<first,last>: zero-based starts of the first and last window of at least that entropy (-1: none).

    The fold holds the count of every character in the window, five bits each,
    and changes those of the character that leaves and of the one that enters.
    """
    most = (math.log2(WINDOW) - bits) * WINDOW  # of the sum of c * log2(c), which is large where entropy is low
    none = F.lit(-1)
    start = F.struct(F.lit(0).alias("i"), F.array(*[F.lit(0).cast("long")] * (-(-len(ALPHABET) // PACKED))).alias("counts"), F.lit(0.0).alias("total"), none.alias("first"), none.alias("last"))

    def step(codes: Column, acc: Column, enters: Column) -> Column:
        leaves = F.get(codes, acc["i"] - WINDOW)  # null until the window is full

        def left(x: Column) -> Column:
            gone, come = _held(acc["counts"], leaves), _held(x, enters)
            lost = F.when(leaves.isNull(), 0.0).otherwise(_c_log_c(gone - 1) - _c_log_c(gone))
            total = acc["total"] + lost + _c_log_c(come + 1) - _c_log_c(come)
            return F.struct(_moved(x, enters, 1).alias("counts"), total.alias("total"))

        def entered(x: Column) -> Column:
            at = acc["i"] - (WINDOW - 1)
            hot = (at >= 0) & (x["total"] <= most + 1e-9)
            first = F.when(hot & (acc["first"] < 0), at).otherwise(acc["first"])
            return F.struct((acc["i"] + 1).alias("i"), x["counts"].alias("counts"), x["total"].alias("total"), first.alias("first"), F.when(hot, at).otherwise(acc["last"]).alias("last"))

        return _let(_let(F.when(leaves.isNull(), acc["counts"]).otherwise(_moved(acc["counts"], leaves, -1)), left), entered)

    codes = F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    return _let(codes, lambda c: F.aggregate(c, start, lambda acc, x: step(c, acc, x), lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def _entropy_spans(candidates: Column, base: Column, allow: tuple[str, ...]) -> Column:
    def bits(s: Column) -> Column:
        return F.coalesce(*[F.when(char_class(s) == k, F.lit(v)) for k, v in BITS.items()])

    doubtful = F.filter(candidates, lambda x: char_class(x["hit"]).isNotNull() & ~_any(x["hit"].rlike(p) for p in allow) & ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    hot = F.transform(doubtful, lambda x: F.struct(x["start"].alias("at"), hot_windows(x["hit"], bits(x["hit"])).alias("w")))
    return F.transform(
        F.filter(hot, lambda x: x["w"]["first"] >= 0),
        lambda x: F.struct((x["at"] + x["w"]["first"]).alias("start"), F.lit(3).alias("rank"), (x["at"] + x["w"]["last"] + WINDOW).alias("end"), F.lit("entropy").alias("kind")),
    )


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _scanned(rows: DataFrame, allow: tuple[str, ...]) -> DataFrame:
    """rows (_row, _text) with base and spans."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    raw = rows.select("_row", "_text", _spans(text, ASSIGN, ASSIGN_VALUE).alias("_assign"), _spans(text, ACCESS).alias("_access"), _spans(text, HEX).alias("_hex"), _spans(text, CANDIDATE).alias("_candidates"))
    ranked = F.concat(*[_ranked(k, r) for r, k in enumerate(["assign", "access", "hex"])])
    based = raw.select("_row", "_text", F.array_sort(ranked).alias("base"), "_candidates")
    return based.select("_row", "_text", "base", F.array_sort(F.concat("base", _entropy_spans(F.col("_candidates"), F.col("base"), allow))).alias("spans"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(id, base, spans): sorted arrays of struct<start,rank,end,kind>, positions in code points, end exclusive.

    Null texts count as empty and give empty arrays; null and repeated ids are
    returned row for row; other columns are not read.
    """
    rows = docs.select(F.struct(F.col(id_col).alias(id_col)).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    return _scanned(rows, allow).select(F.col("_row")[id_col].alias(id_col), "base", "spans")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with every span replaced by mark, and chars_col, where there is one, set anew for those rows.

    Rows without a span, null texts among them, stay as they are.
    """
    done = _scanned(docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text")), allow)
    text = done.select("_row", F.size("spans").alias("_n"), redacted(F.col("_text"), F.col("spans"), mark).alias("_text"))
    new = {text_col: F.col("_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("_n") > 0, F.length("_text")).otherwise(F.col("_row")[chars_col]).cast(docs.schema[chars_col].dataType)
    return text.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (overlapping ones as one) replaced by mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))).otherwise(text)
