"""WARC archives as seekable Zstandard bundles.

Each task groups its records into independent Zstandard frames and appends
them to bundle files in the shared folder; a bundle ends with a seek table (a
skippable frame in the seekable format: compressed and plain size per frame, a
count and a magic number), so ordinary decoders still read the whole file.  An
index table maps each record to bundle, frame and the record's offset within
the plain frame.  A task names its files freshly and only the names in the
committed index count: a lost or repeated task leaves no wrong record behind.

Records of equal payloads of ``least`` bytes or more are stored once, as the
response with the largest id; the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenspark.llm.shared import cut, new_path, parts

#: Plain bytes after which a frame ends, stored bytes after which a bundle does, and frames in a row that one task reads.
FRAME, BUNDLE, RUN = 1 << 20, 256 << 20, 16
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit record without its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a plain frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        start, size = end + 4, int(headers["Content-Length"])
        yield headers, data[start : start + size]
        at = start + size + 4


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Bundle:
    """Writer of one bundle file."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(f"{path}/{self.uri.rpartition('/')[2]}", compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.at, self.plain, self.waiting = 0, bytearray(), []

    def add(self, page_id: int | None, data: bytes) -> list[tuple]:
        """Index rows of the frame that this record fills, if it does."""
        self.waiting.append((page_id, len(self.plain), len(data)))
        self.plain += data
        return self.flush() if len(self.plain) >= FRAME else []

    def flush(self) -> list[tuple]:
        if not self.waiting:
            return []
        stored = self.pack.compress(bytes(self.plain))
        rows = [(page, self.uri, len(self.sizes), self.at, len(stored), offset, length) for page, offset, length in self.waiting]
        self.out.write(stored)
        self.sizes.append((len(stored), len(self.plain)))
        self.at += len(stored)
        self.plain, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, stored bytes, plain bytes) of each frame, from the bundle's end."""
    end = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    table = file.read_at(width * count, end - 9 - width * count)
    out, at = [], 0
    for k in range(count):
        stored, plain = struct.unpack_from("<II", table, width * k)
        out.append((at, stored, plain))
        at += stored
    return out


def _writer(folder: str):
    names = [f.split()[0] for f in INDEX.split(", ")]

    def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "bytes", "refers_to")]
            for i in range(batch.num_rows):  # a row at a time: payloads may be large
                page, url, html, digest, size, refers_to = (c[i].as_py() for c in columns)
                bundle = bundle or Bundle(folder)
                rows = bundle.add(page, record(page, url, b"" if refers_to is not None or html is None else html.encode("utf-8"), digest, size, refers_to))
                if bundle.at >= BUNDLE:
                    rows += bundle.close()
                    bundle = None
                if rows:
                    yield rows_to_batch(rows)
        if bundle and (rows := bundle.close()):
            yield rows_to_batch(rows)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 1000) -> DataFrame:
    """Archives pages and returns the index (page_id, bundle, frame, frame_start, frame_bytes, offset, length), one row per record.

    Null html is an empty payload, a null url an empty target.  Rows with a null
    id are responses.  Rows that repeat an id are archived each; those with the
    largest id of their payload are all responses.  Other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("html")).select(
        "*", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("bytes")
    )
    # digests alone are shuffled to find the repeated ones; payloads meet only the rows of those, and stay in place if they fit a broadcast
    repeated = cut(rows.where(f"bytes >= {least}").groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).where("n > 1").drop("n"), "repeated")
    linked = rows.join(repeated, ["digest", "bytes"], "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")))
    return cut(linked.select("page_id", "url", "html", "digest", "bytes", "refers_to").mapInArrow(_writer(folder or new_path(pages.sparkSession, "warc")), INDEX), "warc-index")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    refers = headers.get("WARC-Refers-To")
    return _page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, kind, refers and _page(refers), payload if with_payload and kind == "response" else None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])


class _Frames:
    """Plain frames of bundles; the last file and frame are kept, since rows come in order."""

    def __init__(self) -> None:
        import zstandard

        self.unpack, self.uri, self.file, self.at, self.last = zstandard.ZstdDecompressor(), None, None, None, b""

    def __enter__(self) -> _Frames:
        return self

    def __exit__(self, *_) -> None:
        if self.file:
            self.file.close()

    def plain(self, uri: str, frame: int, start: int, stored: int) -> bytes:
        if uri != self.uri:
            if self.file:
                self.file.close()
            store, path = _open(uri)
            self.uri, self.file, self.at = uri, store.open_input_file(path), None
            self.table = seek_table(self.file)
        if self.table[frame][:2] != (start, stored):
            raise ValueError(f"the seek table of {uri} and the index differ at frame {frame}")
        if frame != self.at:
            self.at, self.last = frame, self.unpack.decompress(self.file.read_at(stored, start))
        return self.last


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Frames() as frames:
            for batch in batches:
                for r in batch.to_pylist():
                    if rows := [_row(h, b, with_payload) for h, b in parse(frames.plain(r["bundle"], r["frame"], r["frame_start"], r["frame_bytes"]))]:
                        yield _rows(rows)

    return run


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the index's bundles, read from the files and checked against their digests; an empty index gives no rows.

    Frames are dealt out by place, so that the readers share the bundles' bytes whatever the number of bundles.
    """
    frames = index.groupBy("bundle", "frame").agg(F.min("frame_start").alias("frame_start"), F.min("frame_bytes").alias("frame_bytes"))
    spread = max(parts(index.sparkSession), index.sparkSession.sparkContext.defaultParallelism)
    return frames.repartition(spread, "bundle", F.floor(F.col("frame") / RUN)).sortWithinPartitions("bundle", "frame").mapInArrow(_reader(with_payload), READ)


def _seeker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _Frames() as frames:
        for batch in batches:
            for r in batch.to_pylist():
                frame = frames.plain(r["bundle"], r["frame"], r["frame_start"], r["frame_bytes"])
                yield _rows([_row(h, b, True) for h, b in parse(frame[r["offset"] : r["offset"] + r["length"]])])


def read_records(index: DataFrame, wanted: Column) -> DataFrame:
    """The records that the condition on the index selects, by seeking to their frames, each frame unpacked once a task.

    Rows for which the condition is null are not read; an index row that is selected twice is read twice; an empty index gives no rows.
    """
    chosen = index.where(wanted)
    return chosen.repartition(parts(index.sparkSession), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_seeker, READ)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Round trip: write, then read what was written."""
    return read_archives(write_archives(pages))
