"""Benchmark leaks by template canonicalisation.

A text becomes a sequence of tokens in which numbers, names and units are typed
placeholders and every other word is folded; windows of that template are
hashed.  A fixed-size Bloom filter of the benchmark's windows thins the
documents' windows where they are made; a hash join on the window finds items.
Windows on one diagonal (document position less item position) form an
alignment, in which one item value stands for one document value, that of most
of its places: windows off it are dropped, and the alignment where no value has
half of the places.  What is left covers an item's windows;
a document leaks an item from a coverage of ``COVER`` on, exactly where all slot
values agree, re-parameterised where some were replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenspark.llm.shared import cut
from provenspark.llm.words import TABLES, U64, Folded, mix, slices, span_hashes, windows, word_hashes

#: Tokens of a window, words in it that are not slots at least, covered part of an item's windows, and covered windows at least (or all, of an item with fewer).
WINDOW, LITERALS, COVER, LEAST = 8, 4, 0.3, 3
#: Bits of the Bloom filter (as a power of two): its size does not depend on the benchmark.
BLOOM = 23
#: Fixed unit words; they are slots after a number.
UNITS = (
    "%", "cm", "mm", "m", "km", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "ms", "h", "min", "mph", "ft", "in", "mi", "usd", "eur", "$", "meters", "metres", "meter",
    "miles", "mile", "feet", "inches", "inch", "kilometers", "kilograms", "grams", "pounds", "ounces", "liters", "litres", "hours", "hour", "minutes", "minute", "seconds",
    "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "euros", "euro", "percent", "degrees", "degree",
)
NUMBER, NAME, UNIT = 1, 2, 3


def _trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = starts.copy(), ends.copy()
    for _ in range(6):
        s += (s < e - 1) & TABLES.mark[raw[s]] if len(s) else 0
        e -= (e > s + 1) & TABLES.mark[raw[e - 1]] if len(e) else 0
    return s, e


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Folded hashes of byte spans, in blocks."""
    out = np.zeros(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20), "left")))
        lo = int(starts[at])
        out[at:to] = span_hashes(Folded(raw[lo : int(ends[to - 1])]), starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out


def _unit_hashes() -> np.ndarray:
    return np.sort(word_hashes(pa.array([" ".join(UNITS)]))[0])


def template(column: pa.Array):
    """(values, kinds, named, first): token hashes, slot kinds (0: a word), capitalised words that open a sentence, and each text's token range."""
    _, first, starts, ends, raw = word_hashes(column, spans=True)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(len(first), np.int64)
    s, e = _trimmed(raw, starts, ends)
    real = ~((e - s == 1) & TABLES.mark[raw[s]])
    real |= raw[s] == ord("%")
    # a sentence starts at a text's first word, after closing punctuation, a mark on its own or a line's end
    opens = np.ones(len(s), bool)
    last = raw[ends[:-1] - 1]
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    opens[1:] = np.isin(last, np.frombuffer(b".!?:|\"'", np.uint8)) | ~real[:-1] | (lines[starts[1:]] > lines[ends[:-1]])
    opens[first[:-1][first[:-1] < len(s)]] = True
    lead, second = raw[s], raw[np.minimum(s + 1, len(raw) - 1)]
    latin = lead == 0xC3
    upper = ((lead >= 65) & (lead <= 90)) | (latin & (second >= 0x80) & (second <= 0x9E))
    after = np.minimum(s + 1 + latin, len(raw) - 1)
    lower = (s + 1 + latin < e) & (((raw[after] >= 97) & (raw[after] <= 122)) | ((raw[after] == 0xC3) & (raw[np.minimum(after + 1, len(raw) - 1)] >= 0xA0)))
    values = _hash_spans(raw, s, e)
    kinds = np.zeros(len(s), np.int8)
    kinds[upper & lower & ~opens] = NAME
    number = (lead >= 48) & (lead <= 57)
    kinds[number] = NUMBER
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, values), len(units) - 1)
    follows = np.zeros(len(s), bool)
    follows[1:] = number[:-1]
    kinds[(units[at] == values) & follows & ~number] = UNIT
    kept = np.concatenate([[0], np.cumsum(real)])
    return values[real], kinds[real], (upper & lower & opens & (kinds == 0))[real], kept[first]


def _windows(values: np.ndarray, kinds: np.ndarray, named: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, usable, kinds) of each reading of the windows of that size, by first token.

    Templates need words that are not slots: LITERALS, or two in an item shorter
    than WINDOW.  A word that opens a sentence is read as a word and as a name.
    The last reading is the folded words and values themselves, without slots.
    """
    marks = mix(np.arange(4, dtype=U64) + U64(77))
    for read in (kinds, np.where(named, np.int8(NAME), kinds)):
        slots = read > 0
        rolled = windows(np.where(slots, marks[read], values), size)
        words = np.concatenate([[0], np.cumsum(~slots)])
        usable = words[size : size + len(rolled)] - words[: len(rolled)] >= (LITERALS if size >= WINDOW else 2)
        if read is not kinds:
            opens = np.concatenate([[0], np.cumsum(named)])
            usable &= opens[size : size + len(rolled)] > opens[: len(rolled)]
        yield mix(rolled + U64(size)), usable, read
    rolled = windows(values, size)
    yield mix(rolled + U64(size + 1024)), np.ones(len(rolled), bool), np.zeros_like(kinds)


WINDOWS = "id long, size int, h long, pos int, typed boolean, firm boolean, offsets array<int>, kinds array<tinyint>, slots array<long>"
ALIGNED = "doc_id long, item_id long, every array<int>, typed array<int>, slots int, replaced int"


def _emit(ids: list, found: list[tuple]) -> pa.RecordBatch:
    ident, size, h, pos, typed, firm, offsets, kinds, slots = (list(c) for c in zip(*found, strict=True)) if found else ([],) * 9
    return pa.RecordBatch.from_arrays(
        [pa.array(ident, pa.int64()), pa.array(size, pa.int32()), pa.array(h, pa.int64()), pa.array(pos, pa.int32()), pa.array(typed, pa.bool_()), pa.array(firm, pa.bool_()), pa.array(offsets, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int8())), pa.array(slots, pa.list_(pa.int64()))],
        names=[f.split()[0] for f in WINDOWS.split(", ")],
    )


def _scan(sizes: list[int] | None, bloom: np.ndarray | None):
    """Windows of texts; sizes None: each text's own size, else all of those that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bloom is None else np.unpackbits(bloom).astype(bool)
        mask = U64((1 << BLOOM) - 1)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            values, kinds, named, first = template(batch.column("text"))
            ids, found = batch.column("id").to_pylist(), []
            spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            for size in sizes if sizes is not None else range(1, WINDOW + 1):
                for n, (rolled, usable, read) in enumerate(_windows(values, kinds, named, size)):
                    if bits is not None:
                        usable = usable & bits[(rolled & mask).astype(np.int64)] & bits[((rolled >> U64(32)) & mask).astype(np.int64)]
                    hit = np.flatnonzero(usable)
                    owner = np.searchsorted(first, hit, "right") - 1
                    for at, who in zip(hit.tolist(), owner.tolist(), strict=True):
                        lo, hi = spans[who]
                        if at + size > hi or (sizes is None and size != min(WINDOW, hi - lo)):
                            continue
                        k = read[at : at + size]
                        slot = np.flatnonzero(k)
                        found.append((ids[who], size, int(rolled[at].view(np.int64)), at - lo, n < 2, n == 0, slot.tolist(), k[slot].tolist(), values[at + slot].view(np.int64).tolist()))
                if len(found) > 20_000:
                    yield _emit(ids, found)
                    found = []
            if found:
                yield _emit(ids, found)

    return run


def _bloom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's part of the filter, in bytes of a fixed total."""
    bits = np.zeros(1 << BLOOM, bool)
    for batch in batches:
        h = batch.column("h").to_numpy().view(U64)
        mask = U64((1 << BLOOM) - 1)
        bits[(h & mask).astype(np.int64)] = True
        bits[((h >> U64(32)) & mask).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Item windows of each alignment whose slots are consistent."""
    for batch in batches:
        rows = []
        for doc, item, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            firm: dict[int, dict[int, set[int]]] = {}
            loose: dict[int, dict[int, set[int]]] = {}
            for w in met:
                for at, p in zip(w["offsets"], w["pairs"], strict=True):
                    (firm if w["firm"] else loose).setdefault(p["a"], {}).setdefault(p["b"], set()).add(w["item_pos"] + at)
            votes = loose | firm
            # an item value stands for the document value at most of its places, its own one first; with fewer than half of them it has none.
            # Words that only open sentences may not be names: they cost their windows alone
            mapped = {a: min(by, key=lambda b: (-len(by[b]), b != a, b)) for a, by in votes.items()}
            if any(2 * len(votes[a][b]) < len(set().union(*votes[a].values())) for a, b in mapped.items() if a in firm):
                continue
            pairs = {(a, b) for a, by in votes.items() for b in by}
            kept = [w for w in met if all(mapped[p["a"]] == p["b"] for p in w["pairs"])]
            rows.append((doc, item, sorted({w["item_pos"] for w in kept}), sorted({w["item_pos"] for w in kept if w["typed"]}), len(pairs), sum(a != b for a, b in pairs)))
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("every", pa.list_(pa.int32())), ("typed", pa.list_(pa.int32())), ("slots", pa.int32()), ("replaced", pa.int32())])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, matched, coverage, slots, replaced, kind): one row per document and leaked item.

    Items of fewer than WINDOW tokens have one window of their own length; as a
    template it needs two words that are not slots.  Windows with fewer words,
    and copies in another case, meet by their folded words and values.  Coverage
    is that of all windows or of the template windows, whichever is greater.
    Null or empty texts on either side match nothing; null ids take no part;
    rows that repeat an id count once; other columns are not read; an empty
    table gives no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null")
    own = cut(items.mapInArrow(_scan(None, None), WINDOWS), "item-windows")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most WINDOW rows
    # one filter of 2 ** BLOOM bits for each of at most eight parts of the benchmark
    parts = [np.frombuffer(r["bits"], np.uint8) for r in own.select("h").coalesce(8).mapInArrow(_bloom, "bits binary").collect()]
    bloom = np.bitwise_or.reduce(parts) if parts else np.zeros(1 << (BLOOM - 3), np.uint8)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    seen = texts.mapInArrow(_scan(sizes or [WINDOW], bloom), WINDOWS).withColumnRenamed("id", "doc_id")
    known = own.select(F.col("id").alias("item_id"), "size", "h", "typed", F.col("firm").alias("item_firm"), F.col("pos").alias("item_pos"), "offsets", F.col("kinds").alias("item_kinds"), F.col("slots").alias("item_slots"))
    met = seen.drop("offsets").join(known, ["h", "size", "typed"]).where("kinds = item_kinds")
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    one = F.struct("item_pos", "typed", (F.col("firm") & F.col("item_firm")).alias("firm"), "offsets", pairs.alias("pairs"))
    aligned = met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set(one).alias("met"))
    consistent = aligned.select("doc_id", "item_id", "met").mapInArrow(_agreeing, ALIGNED)
    places = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    found = consistent.groupBy("doc_id", "item_id").agg(places("every"), places("typed"), F.max("slots").alias("slots"), F.max("replaced").alias("replaced"))
    count = lambda c: F.countDistinct(c).cast("int")
    total = own.groupBy(F.col("id").alias("item_id")).agg(count(F.col("pos")).alias("n_every"), count(F.when(F.col("typed"), F.col("pos"))).alias("n_typed"))
    # a re-parameterised copy cannot hold windows that have no template, so templates also count by themselves
    enough = lambda k, n: F.col(n).isNotNull() & (F.col(n) > 0) & (F.col(k) / F.nullif(F.col(n), F.lit(0)) >= COVER) & (F.col(k) >= F.least(F.lit(LEAST), F.col(n)))
    way = lambda k, n: F.when(enough(k, n), F.struct((F.col(k) / F.nullif(F.col(n), F.lit(0))).alias("coverage"), F.col(k).alias("matched"), F.col(n).alias("windows")))
    out = found.join(total, "item_id").withColumn("best", F.greatest(way("every", "n_every"), way("typed", "n_typed"))).where("best is not null")
    kind = F.when(F.col("replaced") > 0, "reparameterised").otherwise("exact").alias("kind")
    return out.select("doc_id", "item_id", "best.windows", "best.matched", "best.coverage", "slots", "replaced", kind)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that leak an item; rows with a null id stay."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti")
