"""Near-duplicate documents by bottom-k sketches from one hash function.

1. One pass over the texts gives each document's shingle-set size, a 128-bit
   digest of the set and its *sketch*: the ``K`` smallest values of one hash
   function over the set.  Documents of equal sets form a class and go on as
   one representative, so exact copies never meet in pairs.
2. Inverted lists are keyed by ``RUN`` consecutive retained values.  Sets that
   share 75 % of their union share, in any order of the values, a run of three
   consecutive union values once the union has nine members; sets of up to
   eight shingles are also listed under runs of two.  (With sketches that
   leave values out the run is missed with probability under 1e-6.)
3. Lists of up to ``SHORT`` members give all their pairs, longer ones give
   every member paired with the list's leader.  The union sketch's estimate
   then filters the pairs, and full shingle sets decide.
4. Longer lists that still span several components are finished exactly: their
   members are dealt into blocks of bounded rows and shingles.  Each pair of
   blocks first compares set sizes and counts shared retained values; texts
   follow only for members with a partner, full sets decide, and a spanning
   forest of the links comes back.
5. Components of all links; each document joins its class's component.

A class's representative is known by a hash of its id and text, so rows that
repeat an id with other texts stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenspark.llm.components import connected_components
from provenspark.llm.shared import cut, forget
from provenspark.llm.words import U64, mix, shingle_sets, slices, windows

#: Shingle size in words, and the similarity in per cent.
WORDS, PERCENT = 5, 75
#: Retained values, consecutive values of a list's key, and the least shared part of a union sketch (0.75 less nine parts in two of its deviation).
K, RUN, LEAST = 48, 3, 0.375
#: Members up to which a list gives all pairs; members and shingles of a block of a longer one.
SHORT, BLOCK, SHINGLES = 64, 256, 1 << 18


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text")):
        n, d1, d2, sketch = [], [], [], []
        for s in shingle_sets(batch.column("text"), WORDS):
            n.append(len(s))
            d1.append(int(s.sum(dtype=U64).view(np.int64)))
            d2.append(int(mix(s ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64).view(np.int64)))
            sketch.append(s[:K].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("rep"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketch, pa.binary())],
            names=["id", "rep", "n", "d1", "d2", "sketch"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for rep, n, sketch in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
            values = np.frombuffer(sketch, dtype=U64)
            own = [windows(values, RUN)]
            if n <= 8:
                own.append(windows(values, 2) if n > 1 else mix(values))
            keys += own
            owners.append(np.full(sum(map(len, own)), rep, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "rep"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches cut to 32 bits a value (order kept) and padded, for the estimate."""
    for batch in batches:
        out = []
        for sketch in batch.column("sketch").to_pylist():
            v = (np.frombuffer(sketch, dtype=U64) >> U64(32)).astype(np.uint32)
            out.append(np.concatenate([v, np.full(K - len(v), 0xFFFFFFFF, np.uint32)]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.binary())], names=["rep", "sk"])


def estimated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of two arrays of padded sketches: shared part of the union sketch."""
    y = np.where(y == 0xFFFFFFFF, np.uint32(0xFFFFFFFE), y)
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    twice = both[:, 1:] == both[:, :-1]
    twice &= both[:, 1:] < 0xFFFFFFFE
    real = (both < 0xFFFFFFFE).sum(axis=1) - twice.sum(axis=1)
    rank = np.arange(1, both.shape[1])[None, :] - np.cumsum(twice, axis=1) + 1  # of each second value among the distinct ones
    shared = (twice & (rank <= K)).sum(axis=1)
    return shared / np.maximum(1, np.minimum(K, real))


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, K) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(estimated(x, y) >= LEAST))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Two sorted sets share at least PERCENT of their union."""
    if PERCENT * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(x, y) for x, y in zip(shingle_sets(batch.column("ta"), WORDS), shingle_sets(batch.column("tb"), WORDS), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shared(lists: list[np.ndarray]) -> np.ndarray:
    """Values in common of every two of the lists of distinct values."""
    size = np.array([len(s) for s in lists])
    values, at = np.unique(np.concatenate(lists), return_inverse=True)
    where = np.repeat(np.arange(len(lists)), size)
    often = np.bincount(at, minlength=len(values)) > 1  # values that only one list has cannot be shared
    slot = np.cumsum(often) - 1
    shared = np.zeros((len(lists), len(lists)), np.float32)
    for lo in range(0, int(often.sum()), 8192):
        take = often[at] & (slot[at] >= lo) & (slot[at] < lo + 8192)
        dense = np.zeros((len(lists), 8192), np.float32)
        dense[where[take], slot[at[take]] - lo] = 1
        shared += dense @ dense.T
    return shared


def _across(table: pa.Table) -> np.ndarray:
    """Pairs of a cell's rows that lie in different components and, in a cell of two blocks, on different sides."""
    comp, side = table.column("component").to_numpy(), table.column("side").to_numpy()
    out = comp[:, None] != comp[None, :]
    if side.min() != side.max():
        out &= side[:, None] != side[None, :]
    return out


def _block_partners(table: pa.Table) -> pa.Table:
    """The rows of one cell that share enough retained values with another."""
    sketches = [np.frombuffer(b, dtype=U64) for b in table.column("sketch").to_pylist()]
    shared, size, kept = _shared(sketches), table.column("n").to_numpy(), np.array([len(s) for s in sketches])
    union = np.minimum(K, kept[:, None] + kept[None, :] - shared)
    near = _across(table) & (shared >= LEAST * union) & (PERCENT * np.maximum(size[:, None], size[None, :]) <= 100 * np.minimum(size[:, None], size[None, :]))
    return table.drop_columns(["sketch", "n"]).filter(pa.array(near.any(axis=1)))


def _block_links(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between the two sides of one pair of blocks."""
    rep, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
    sets = list(shingle_sets(table.column("text"), WORDS))
    size = np.array([len(s) for s in sets])
    link = ((100 + PERCENT) * _shared(sets) >= PERCENT * (size[:, None] + size[None, :])) & _across(table)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        p, q = root(int(comp[i])), root(int(comp[j]))
        if p != q:
            parent[p] = q
            a.append(int(rep[i]))
            b.append(int(rep[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, component_id, first): each row with the key of its id and text, and of its component's first row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("rep"), text.alias("text"))
    seen = cut(rows.mapInArrow(_sketches, "id long, rep long, n long, d1 long, d2 long, sketch binary"), "sketches")
    named = seen.where("id is not null and n > 0")
    least = F.min(F.struct("id", "rep"))
    classes = cut(named.groupBy("n", "d1", "d2").agg(least.alias("least"), F.min_by("sketch", F.struct("id", "rep")).alias("sketch")).select("n", "d1", "d2", "sketch", F.col("least.rep").alias("rep"), F.col("least.id").alias("id")), "classes")
    texts = rows.join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]).select("rep", "text")

    keys = classes.select("rep", "n", "sketch").mapInArrow(_keys, "key long, rep long")
    lists = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("leader")).where("c > 1")
    members = cut(keys.join(lists, "key").join(classes.select("rep", "n"), "rep"), "members")

    fits = f"least(n, m) * 100 >= {PERCENT} * greatest(n, m)"
    sizes = classes.select(F.col("rep").alias("leader"), F.col("n").alias("m"))
    stars = members.where(f"c > {SHORT} and rep != leader").select("leader", "rep", "n").distinct().join(sizes, "leader").where(fits).select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    few = members.where(f"c <= {SHORT}")
    other = few.select("key", F.col("rep").alias("b"), F.col("n").alias("m"))
    pairs = few.select("key", F.col("rep").alias("a"), "n").join(other, "key").where(f"a < b and {fits}").select("a", "b").unionByName(stars).distinct()
    links = cut(_verified(pairs, classes, texts), "links")
    first = cut(connected_components(links), "components")

    more = cut(_long_lists(members, classes, first, texts), "links")
    final = cut(connected_components(links.unionByName(more)).withColumnRenamed("node", "rep"), "components")
    forget(members, links, first, more)
    linked = classes.select("rep", "id").join(final, "rep").groupBy("component").agg(F.min(F.struct("id", "rep")).alias("least"))
    by_component = final.join(linked, "component").select("rep", "least")
    by_class = classes.select("n", "d1", "d2", F.struct("id", "rep").alias("own"), "rep").join(by_component, "rep", "left").select("n", "d1", "d2", F.coalesce("least", "own").alias("least"))
    alone = F.col("id").isNull() | (F.col("n") == 0) | F.col("least").isNull()
    return seen.select("id", "rep", "n", "d1", "d2").join(by_class, ["n", "d1", "d2"], "left").select(
        "id", F.col("rep").alias("key"), "n", F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), F.when(alone, F.col("rep")).otherwise(F.col("least.rep")).alias("first")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Null or blank texts have no shingle, stay alone and are kept.  Rows with a
    null id take no part in links: component_id is null and they are kept.
    Rows that repeat an id are each returned, with the component of their own
    text.  Other columns are not read; an empty table gives no rows.
    """
    out = _grouped(docs, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class, of the smallest id.

    Rows with a null id stay; of rows that repeat an id and its text one stays.
    """
    rows = cut(_grouped(docs, id_col, text_col).where("id is not null").groupBy("key").agg(F.count("*").alias("copies"), F.first(F.col("key") == F.col("first")).alias("stays")).where("copies > 1 or not stays"), "repeats")
    own = "_key"
    while own in docs.columns:
        own += "_"
    named = rows.withColumnRenamed("key", own)
    keyed = docs.withColumn(own, F.when(F.col(id_col).cast("long").isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))))
    whole = keyed.join(named.select(own), own, "left_anti")
    again = keyed.join(named.where("stays").select(own), own, "left_semi").dropDuplicates([own])
    return whole.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose union sketch and then whose full sets agree."""
    short = classes.select("rep", "sketch").mapInArrow(_short, "rep long, sk binary")
    near = (
        pairs.join(short.select(F.col("rep").alias("a"), F.col("sk").alias("sa")), "a")
        .join(short.select(F.col("rep").alias("b"), F.col("sk").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_estimate, "a long, b long")
    )
    near = cut(near, "near")
    return (
        near.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(_verify, "a long, b long")
    )


CELL = {"g": "long", "h": "long", "i": "int", "j": "int"}


def _long_lists(members: DataFrame, classes: DataFrame, components: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components inside lists of more than SHORT members."""
    hot = members.where(f"c > {SHORT}").select("key", "c", "rep", "n").join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = hot.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    hot = cut(hot.join(open_keys, "key"), "hot")
    # every document belongs to the longest of its lists; two such groups meet if some list holds members of both
    home = cut(hot.groupBy("rep", "component", "n").agg(F.max(F.struct("c", "key"))["key"].alias("g")).withColumn("spread", F.xxhash64("rep")), "homes")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)).cast("int")
    groups = home.groupBy("g").agg(blocks.alias("blocks"))
    in_list = hot.select("key", "rep").join(home.select("rep", "g"), "rep").select("key", "g").distinct()
    meet = in_list.join(in_list.withColumnRenamed("g", "h"), "key").where("g <= h").select("g", "h").distinct()
    cells = (
        meet.join(groups.select("g", F.col("blocks").alias("gb")), "g")
        .join(groups.select(F.col("g").alias("h"), F.col("blocks").alias("hb")), "h")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)))
        .withColumn("j", F.explode(F.sequence(F.when(F.col("g") == F.col("h"), F.col("i")).otherwise(0), F.col("hb") - 1)))
        .select(*CELL)
    )
    of_block = home.join(groups, "g").select("rep", "component", "n", F.col("g").alias("own"), F.pmod("spread", "blocks").cast("int").alias("block"))
    left = cells.select(*CELL, F.col("g").alias("own"), F.col("i").alias("block"), F.lit(0).alias("side"))
    right = cells.where("not (g = h and i = j)").select(*CELL, F.col("h").alias("own"), F.col("j").alias("block"), F.lit(1).alias("side"))
    dealt = left.unionByName(right).join(of_block, ["own", "block"]).select(*CELL, "side", "rep", "component", "n").join(classes.select("rep", "sketch"), "rep")
    kinds = CELL | {"side": "int", "rep": "long", "component": "long"}
    near = dealt.select(*kinds, "n", "sketch").groupBy(*CELL).applyInArrow(_block_partners, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    near = cut(near, "near")
    return near.join(texts, "rep").groupBy(*CELL).applyInArrow(_block_links, "a long, b long")
