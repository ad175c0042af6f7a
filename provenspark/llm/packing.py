"""Packing documents into sequences by shortest-pack-first over the length histogram.

Every document becomes its ids and one end id, cut at ``SEQUENCE``; what is
left over is packed.  Only the histogram of piece lengths (at most ``SEQUENCE``
rows) reaches the driver.  Lengths are placed longest first, all documents of a
length together: each goes to the packing pattern with the most room, whose
count is split where it outnumbers the documents left.  The patterns are then
laid over the documents by rank within their length; ranks come from bucket
counts and numbers within buckets, so no length, however common, is gathered
in one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenspark.llm.shared import cut, parts
from provenspark.llm.tokens import default_tokenizer, word_ids
from provenspark.llm.words import slices

SEQUENCE, END = 4096, 2
#: Rows of the placement table up to which it goes out with the tasks; a longer one is joined, by runs of so many ranks.
TABLE_ROWS, RUN = 1_000_000, 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, first = cache.encode(batch.column("text"))
                out: list[list] = [[], [], [], [], [], []]
                tail = np.array([end], np.uint32)
                for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.concatenate([ids[lo:hi], tail]).astype("<u4")
                    for at in range(0, len(own), size):
                        piece = own[at : at + size]
                        for c, v in zip(out, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(own), piece if with_ids else None), strict=True):
                            c.append(v)
                arrays = [pa.array(c, pa.int64()) for c in out[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array([p.astype(np.int32) for p in out[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of every placement, for packs of that size.

    Ranks of one placement go to consecutive sequences.  A pattern is a run of
    equally filled sequences; fills only grow, and the patterns with the most
    room are taken from a heap.
    """
    placed: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first sequence, count)
    heap: list[int] = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        moved: list[tuple[int, int, int]] = []
        while left:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            most = -heap[0] if heap else -1
            if most >= length:
                sequence, count = room[most].pop()
                if count > left:
                    room[most].append((sequence + left, count - left))
                    count = left
                offset = size - most
            else:
                sequence, count, offset, most = opened, left, 0, size
                opened += left
            placed.append((length, rank, sequence, offset))
            rank += count
            left -= count
            moved.append((most - length, sequence, count))
            if len(moved) >= 4096 or not left or most < length:  # what has been filled may be filled again
                for rest, sequence, count in moved:
                    if rest:
                        room[rest].append((sequence, count))
                        heapq.heappush(heap, -rest)
                moved = []
    return placed


def _placed(table: np.ndarray):
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, batch.column("length").to_numpy() * (1 << 48) + rank, "right") - 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text is its end id alone.  Null and repeated ids are packed
    row for row; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(tokenizer or default_tokenizer(), size, end, with_ids), schema), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    table = shortest_pack_first(histogram, size)

    buckets = max(16, 4 * parts(spark))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = dealt.withColumn("number", number).join(before, ["length", "bucket"]).select(*pieces.columns, (F.col("before") + F.col("number") - 1).alias("rank"))
    if len(table) <= TABLE_ROWS:
        return ranked.mapInArrow(_placed(np.array(table or [(0, 0, 0, 0)], np.int64)), schema + ", sequence_id long, offset long")
    # a longer table is joined by length and run of ranks: a common length is as many keys as it has runs
    ends = [following[1] if following[0] == length else histogram[length] for (length, *_), following in zip(table, [*table[1:], (0, 0)], strict=True)]
    places = spark.createDataFrame([(*row, end) for row, end in zip(table, ends, strict=True)], "length long, lo long, sequence long, offset long, hi long")
    places = places.withColumn("run", F.explode(F.sequence(F.floor(F.col("lo") / RUN), F.floor((F.col("hi") - 1) / RUN))))
    met = ranked.withColumn("run", F.floor(F.col("rank") / RUN)).join(places, ["length", "run"]).where("rank >= lo and rank < hi")
    return met.select(*pieces.columns, (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids themselves, from pack(..., with_ids=True)."""
    one = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(one, lambda x: x["ids"])).alias("ids"))
