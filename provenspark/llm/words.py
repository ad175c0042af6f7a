"""Vectorised word kernels over Arrow string buffers.

Words are the maximal runs of bytes other than the ASCII white space
``\\x20 \\x09-\\x0D`` after lower-casing ``A-Z``; since those bytes never occur
inside a multi-byte UTF-8 character, working on bytes gives the same words as
working on characters.  A word's hash chains a bijective finaliser over its
eight-byte lanes (first lanes of all words at once, then second lanes of those
that have one, and so on), so no Python object is made per word; the rest of a
word beyond ``LANES`` lanes goes in as one BLAKE2b digest.  Texts of any length
are hashed in blocks cut at white space: memory follows the block, apart from
eight bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of text hashed at a time, and eight-byte lanes of a word hashed side by side with those of other words.
BLOCK, LANES = 1 << 20, 32

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift, twice)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Tables:
    """Byte classes, the folding of A-Z, and the masks of a lane's first bytes."""

    def __init__(self) -> None:
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.mark = np.zeros(256, dtype=bool)
        self.mark[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
        self.lane = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


TABLES = _Tables()


class Folded:
    """Folded bytes that give the eight bytes from any place on as one number."""

    def __init__(self, raw: np.ndarray) -> None:
        self.bytes = np.concatenate([TABLES.fold[raw], np.zeros(8, np.uint8)])
        self.lanes = np.ndarray((len(raw) + 1,), "<u8", buffer=self.bytes, strides=(1,))

    def lane(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes from each place, those beyond `left` as zero."""
        return self.lanes[at] & TABLES.lane[np.minimum(left, 8)]


def span_hashes(folded: Folded, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; spans of up to eight bytes and one length never collide."""
    length = ends - starts
    out = mix(length.astype(U64) + U64(seed << 32) + U64(0x9E3779B97F4A7C15))
    rows, k = np.flatnonzero(length > 0), 0
    while len(rows) and k < LANES:
        out[rows] = mix(out[rows] ^ folded.lane(starts[rows] + 8 * k, length[rows] - 8 * k))
        k += 1
        rows = rows[length[rows] > 8 * k]
    for i in rows.tolist():  # very long words
        rest = hashlib.blake2b(folded.bytes[starts[i] + 8 * k : ends[i]], digest_size=8).digest()
        out[i] = mix(out[i : i + 1] ^ np.frombuffer(rest, U64))[0]
    return out


def same_spans(a: Folded, a_at: np.ndarray, b: Folded, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """True where the spans of that length are equal byte for byte."""
    out = np.ones(len(length), bool)
    rows, k = np.flatnonzero(length > 0), 0
    while len(rows) and k < LANES:
        left = length[rows] - 8 * k
        out[rows] &= a.lane(a_at[rows] + 8 * k, left) == b.lane(b_at[rows] + 8 * k, left)
        k += 1
        rows = rows[length[rows] > 8 * k]
    for i in rows.tolist():
        out[i] &= np.array_equal(a.bytes[a_at[i] + 8 * k : a_at[i] + length[i]], b.bytes[b_at[i] + 8 * k : b_at[i] + length[i]])
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = offs[0] if len(offs) else 0
    return raw[lo : offs[-1] if len(offs) else 0], offs - lo


def _block(raw: np.ndarray, cuts: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of raw; cuts: positions where a word ends in any case.

    hashes has a row for whole words and one for each prefix length in bytes
    (0: the word without ASCII punctuation at its end).
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((1 + len(prefixes), 0), U64)
    word = ~TABLES.space[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[cuts] = True
    before = edge[:-1].copy()
    before[1:] |= ~word[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~word[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    folded, out = Folded(raw), []
    for k, p in enumerate([None, *prefixes]):
        to = ends if p is None else np.minimum(starts + p, ends)
        if p == 0:
            to = ends.copy()
            for _ in range(8):
                to -= (to > starts + 1) & TABLES.mark[raw[to - 1]]
        out.append(span_hashes(folded, starts, to, k))
    return starts, ends, np.stack(out)


def blocks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK bytes that end at a text's end or at white space."""
    at, end = 0, int(offsets[-1])
    while at < end:
        to = min(end, at + BLOCK)
        if to < end:
            text_end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if text_end > at:
                to = text_end
            else:  # inside one long text: the next white space, however far
                while to < end and not TABLES.space[raw[to]]:
                    to += 1
                to = min(to, int(offsets[np.searchsorted(offsets, at, "right")]))
        yield at, to
        at = to


def word_hashes(column: pa.Array | pa.ChunkedArray, spans: bool = False, prefixes: tuple[int, ...] = ()):
    """(hashes, first): all words' hashes in order, and first[i]:first[i+1] are those of text i.

    With spans also the words' byte starts and ends and the bytes themselves.
    With prefixes the hashes have a row for words and one for each prefix length.
    """
    raw, offsets = utf8(column)
    hashes, starts, ends = [np.zeros((1 + len(prefixes), 0), U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in blocks(raw, offsets):
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        s, e, h = _block(raw[lo:hi], inner, prefixes)
        hashes.append(h)
        starts.append(s + lo)
        if spans:
            ends.append(e + lo)
    s = np.concatenate(starts)
    first = np.searchsorted(s, offsets, "left")
    everything = np.concatenate(hashes, axis=1)
    everything = everything if prefixes else everything[0]
    if spans:
        return everything, first, s, np.concatenate(ends), raw
    return everything, first


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size values (those that cross texts too: slice by first)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(size):
        total = (total + hashes[k : k + n]) * U64(_BASE)
    return mix(total)


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words has its whole sequence as one, none without words."""
    hashes, first = word_hashes(column)
    rolled = windows(hashes, size)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(rolled[lo : hi - size + 1])
        elif hi > lo:
            total = U64(0)
            with np.errstate(over="ignore"):
                for h in hashes[lo:hi]:
                    total = (total + h) * U64(_BASE)
                total = total + U64(hi - lo)
            yield mix(np.array([total], dtype=U64))
        else:
            yield np.zeros(0, U64)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Slices of a batch of about that many bytes of text, or of one longer row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy()
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)
