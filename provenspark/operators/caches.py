"""Fast paths that never change an answer: vocabulary filters by partition, shard statistics, and a cache of answers."""

from __future__ import annotations

import collections

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenspark.functions import text

#: Hash functions of a filter, its bits for each term, and the least and most of its size as powers of two.
HASHES, BITS, LEAST, MOST = 7, 10, 16, 22


def _places(term: Column, bits: Column) -> Column:
    """The places of a term in a filter of that many bits, from two hashes."""
    one, two = F.xxhash64(term), F.xxhash64(term, F.lit("second")).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(F.pmod(one, bits) + i * F.pmod(two, bits), bits))


def shard_sizes(post: DataFrame) -> DataFrame:
    """(partition, terms, nodes, bits): distinct terms and nodes of each partition, and the size of its filter."""
    g = post.groupBy("partition").agg(F.countDistinct("term").alias("terms"), F.countDistinct("node").alias("nodes"))
    power = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.ceil(F.log2(F.col("terms") * BITS)))).cast("int")
    return g.withColumn("bits", F.call_function("shiftleft", F.lit(1).cast("long"), power))


def vocabulary_filters(post: DataFrame) -> DataFrame:
    """(partition, bits, word, mask): a Bloom filter of each partition's terms as 64-bit words.

    Words are OR-ed map-side and a filter has at most 2 ** MOST bits, so no
    task and no row grows with the vocabulary.  Writing terms again changes
    nothing; new terms are merged by merge_filters().
    """
    placed = post.select("partition", "term").distinct().join(F.broadcast(shard_sizes(post).select("partition", "bits")), "partition")  # one row a partition
    at = placed.select("partition", "bits", F.explode(_places(F.col("term"), F.col("bits"))).alias("p"))
    return at.groupBy("partition", "bits", F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("mask"))


def merge_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Filters of both, where their sizes agree: a partition that outgrew its size is built anew from its postings."""
    return a.unionByName(b).groupBy("partition", "bits", "word").agg(F.bit_or("mask").alias("mask"))


def possible(terms: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id, term, partition, possible) of terms (query_id, term, owner): False only where the partition surely lacks the term."""
    sizes = filters.select("partition", "bits").distinct()
    asked = terms.select("query_id", "term", F.col("owner").alias("partition")).join(F.broadcast(sizes), "partition", "left")  # one row a partition
    at = asked.select("query_id", "term", "partition", F.explode_outer(F.when(F.col("bits").isNotNull(), _places(F.col("term"), F.col("bits")))).alias("p"))
    at = at.withColumn("word", F.floor(F.col("p") / 64)).join(filters.select("partition", "word", "mask"), ["partition", "word"], "left")
    hit = F.coalesce(F.call_function("shiftright", F.col("mask"), F.pmod("p", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return at.groupBy("query_id", "term", "partition").agg(F.min(hit).alias("possible"))


def definitely_unknown(terms: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id, unknown): queries none of whose terms any of their partitions can hold."""
    return possible(terms, filters).groupBy("query_id").agg((~F.max("possible")).alias("unknown"))


def false_positive_rate(terms: Column, bits: Column) -> Column:
    return F.round(F.pow(1 - F.exp(-HASHES * terms / bits), F.lit(HASHES)), 6)


class AnswerCache:
    """Answers by everything that decides them: query, viewer, time bucket, the store's generation and every limit.

    First in, first out; a cache of no entries holds nothing; any write to the
    store moves its generation, so older answers are never found again.
    """

    def __init__(self, entries: int = 256, bucket: float = 60.0) -> None:
        self.entries, self.bucket, self.hits, self.misses, self.invalidations = entries, bucket, 0, 0, 0
        self._held: collections.OrderedDict = collections.OrderedDict()

    def key(self, query: str, viewer: str, now: float, generation: int, **limits) -> tuple:
        return (query, viewer, int(now // self.bucket), generation, tuple(sorted(limits.items())))

    def get(self, key: tuple):
        found = self._held.get(key)
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return found

    def put(self, key: tuple, value) -> None:
        if self.entries > 0 and key not in self._held:
            while len(self._held) >= self.entries:
                self._held.popitem(last=False)
            self._held[key] = value

    def invalidate(self) -> None:
        self._held.clear()
        self.invalidations += 1


def ask(store, cache: AnswerCache, query: str, viewer: str, now: float, **limits) -> tuple[dict, list[dict]]:
    """(answer, results) of one query for a person, from the cache if nothing that decides it has changed; only full-strength answers are kept."""
    from provenspark.operators import ledger

    key = cache.key(query, viewer, now, store.generation, **limits)
    if (found := cache.get(key)) is not None:
        return found
    answers, results = ledger.recall(store, store.spark.createDataFrame([(0, query, viewer)], "query_id int, query string, viewer string"), now, **limits)
    told = answers.first().asDict(), [r.asDict() for r in results.orderBy("rank").collect()]  # at most seven rows
    if told[0]["full_strength"]:
        cache.put(key, told)
    return told


def vectors_of(store, model: str, space: str = "read") -> DataFrame:
    """(node_id, partition, v): each node's stored vector of a model, kept in executor memory while asked for again."""
    latest = store.read("vector").where((F.col("model") == model) & (F.col("space") == space))
    return latest.groupBy("node_id").agg(F.max("partition").alias("partition"), F.max_by("data", F.xxhash64("data")).alias("v")).persist()


def terms_of(queries: DataFrame, visible: DataFrame) -> DataFrame:
    """(query_id, term, owner) of queries (query_id, query, viewer): every term with every partition its viewer may see."""
    terms = F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term")
    return queries.select("query_id", "viewer", terms).join(visible.select("viewer", "owner"), "viewer").select("query_id", "term", "owner")
