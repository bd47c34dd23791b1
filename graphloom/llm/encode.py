"""Problem 7: byte-level BPE ids of whole texts by numpy merges over length buckets."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every call, this is its default.
TOKENIZERS = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of at most so many bytes are merged in padded matrices, longer ones each by itself.
LONGEST = 256
#: Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of their concatenation, whose id is also its rank."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        values = np.array(list(pairs.values()), np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[left], return_index=True)
            chosen = np.zeros(len(left), bool)
            chosen[first] = True
            put = left[free & chosen]
            self.keys[slot[put]] = keys[put]
            self.values[slot[put]] = values[put]
            left = left[~(free & chosen)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair; a large number where there is none. Negative ids are padding."""
        shape = left.shape
        keys = (left.astype(np.uint64).ravel() << np.uint64(32)) | right.astype(np.uint64).ravel()
        found = np.full(len(keys), _NONE, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slots(keys[open_])
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (held != np.uint64(2**64 - 1))
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return found.reshape(shape)


class Vocabulary:
    """Ids of single bytes and of all pairs that merge."""

    def __init__(self, path: str | Path) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes = np.full(256, -1, np.int32)
        pairs = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.bytes[token[0]] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = PairTable(pairs)


class Encoder:
    """Texts to ids. Words seen before are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        self.vocabulary = vocabulary
        self.words = regex.compile(pattern)
        self.known: dict[str, np.ndarray] = {}

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, merged in matrices of words of like length."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for k in np.flatnonzero(lengths > LONGEST):
            found[k] = self._long(self.vocabulary.bytes[np.frombuffer(raw[k], np.uint8)])
        bucket = np.where(lengths <= 16, lengths, np.int64(1) << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(bucket[(lengths > 0) & (lengths <= LONGEST)]):
            rows = np.flatnonzero((bucket == width) & (lengths > 0) & (lengths <= LONGEST))
            for start in range(0, len(rows), 4096):
                self._matrix(rows[start : start + 4096], raw, int(width), found)
        return found

    def _matrix(self, rows: np.ndarray, raw: list[bytes], width: int, found: list[np.ndarray]) -> None:
        ids = np.full((len(rows), width), -1, np.int32)
        for j, k in enumerate(rows):
            ids[j, : len(raw[k])] = np.frombuffer(raw[k], np.uint8)
        ids = np.where(ids >= 0, self.vocabulary.bytes[ids], -1).astype(np.int32)
        pairs = self.vocabulary.pairs
        ranks = pairs.lookup(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            if width == 1:
                done = np.ones(len(rows), bool)
            else:
                at = ranks.argmin(axis=1)  # the leftmost of the least
                best = ranks[np.arange(len(rows)), at]
                done = best == _NONE
            for j in np.flatnonzero(done):
                found[rows[j]] = ids[j][ids[j] >= 0]
            if done.all():
                return
            keep = ~done
            rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
            line = np.arange(len(rows))
            ids[line, at] = best
            mask = np.ones(ids.shape, bool)
            mask[line, at + 1] = False
            ids = ids[mask].reshape(len(rows), width - 1)
            mask = np.ones(ranks.shape, bool)
            mask[line, at] = False
            ranks = ranks[mask].reshape(len(rows), width - 2)
            if width > 2:
                right = np.flatnonzero(at < width - 2)
                ranks[right, at[right]] = pairs.lookup(ids[right, at[right]], ids[right, at[right] + 1])
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = pairs.lookup(ids[left, at[left] - 1], ids[left, at[left]])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long word: each round merges all places of the least pair from the left, which gives the same ids,
        since a pair that holds a new id ranks behind the pair that made it."""
        pairs = self.vocabulary.pairs
        ranks = pairs.lookup(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == _NONE:
                break
            at = np.flatnonzero(ranks == best)
            run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            ids = ids[keep]
            mask = np.ones(len(ranks), bool)
            mask[at] = False
            ranks = ranks[mask]
            for near in (new - 1, new):
                near = near[(near >= 0) & (near < len(ids) - 1)]
                ranks[near] = pairs.lookup(ids[near], ids[near + 1])
        return ids

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list array of the texts' ids; null and empty texts give empty lists."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w: None for own in split for w in own if w not in self.known})
        self.known.update(zip(new, self.encode_words(new)))
        parts = [self.known[w] for own in split for w in own]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        ends = np.cumsum(np.r_[0, sizes])[np.cumsum([0, *(len(own) for own in split)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))


def token_ids(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)`` of every document by the byte-level vocabulary, without special tokens or changes to the text.

    Null and empty texts both give the empty list; texts of any length are encoded whole. The pair table, bounded by
    the vocabulary, is sent to the executors once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(Path(tokenizers, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), encoder.encode(part.column("text").to_pylist())], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")
