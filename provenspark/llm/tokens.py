"""Token ids of whole texts, each distinct word encoded once per worker.

The tokenizers used here never join characters across white space, so a text's
ids are those of its words in turn.  A worker keeps a bounded cache from word
hash to ids and looks up whole blocks of words with numpy.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from provenspark.llm.words import U64, Folded, same_spans, word_hashes

#: Distinct words that a worker keeps; beyond that it starts afresh.
CACHE_WORDS = 1_000_000


def default_tokenizer() -> str:
    """Path of the public word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Cache from a word to its ids, found by hash and compared byte for byte (A-Z folded: the tokenizer lower-cases)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.lengths = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.spelt, self.spelt_at, self.spelt_length = Folded(np.zeros(0, np.uint8)), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        found = self._ids([w.decode("utf-8", "replace") for w in words])
        lengths, spelt = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(map(len, words), np.int64, len(words))
        before, letters = len(self.ids), len(self.spelt.bytes) - 8
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum()))])
        self.spelt = Folded(np.concatenate([self.spelt.bytes[:letters], np.frombuffer(b"".join(words), np.uint8)]))
        everything = np.concatenate([self.hashes, hashes])
        order = np.argsort(everything, kind="stable")
        self.hashes = everything[order]
        self.starts = np.concatenate([self.starts, before + np.cumsum(lengths) - lengths])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]
        self.spelt_at = np.concatenate([self.spelt_at, letters + np.cumsum(spelt) - spelt])[order]
        self.spelt_length = np.concatenate([self.spelt_length, spelt])[order]

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without the cache."""
        found = self._ids([t or "" for t in column.to_pylist()])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum())), np.concatenate([[0], np.cumsum(lengths)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of all texts in order; first[i]:first[i+1] are those of text i.

        Words of equal hashes that differ are noticed, and the texts encoded without the cache.
        """
        hashes, first, starts, ends, raw = word_hashes(column, spans=True)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        folded, length = Folded(raw), ends - starts
        model = where[inverse]
        if not (np.array_equal(length, length[model]) and same_spans(folded, starts, folded, starts[model], length).all()):
            return self._whole(column)
        slot = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[slot] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if len(self.hashes) + int(new.sum()) > CACHE_WORDS:
            self.clear()
            new[:] = True
        if new.any():
            self.add(distinct[new], [raw[a:b].tobytes() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        slot = np.searchsorted(self.hashes, distinct)
        if not (np.array_equal(length[where], self.spelt_length[slot]) and same_spans(folded, starts[where], self.spelt, self.spelt_at[slot], length[where]).all()):
            return self._whole(column)
        slot = slot[inverse]
        lengths = self.lengths[slot]
        to = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[slot] - (to - lengths), lengths) + np.arange(to[-1])]
        return ids, np.concatenate([[0], to])[first]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The worker's cache for that tokenizer file."""
    return WordIds(path)
