"""Problem 8: passages of evaluation items in documents, by Wu-Manber search over words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import chunks, visible
from graphloom.session import checkpoint, shared_table

#: Consecutive words that make a leak.
WORDS = 15
#: Items whose windows are searched together; more items are searched in further passes.
ITEMS_PER_PASS = 20_000
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:>[ \t]*)*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_CHUNK = 256
_BITS = 20


def words(text: str) -> list[str]:
    """The words of ``text``: case, punctuation, markup, line breaks, compatibility forms and invisible characters taken away."""
    plain = unicodedata.normalize("NFKC", visible(html.unescape(_TAG.sub(" ", text))))
    return _WORD.findall(unicodedata.normalize("NFKC", visible(_BROKEN.sub("", plain)).casefold()))


class Patterns:
    """All windows of ``size`` words of the items, with Wu-Manber's shift table over blocks of two words."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WORDS) -> None:
        self.size = size
        self.ids: dict[str, int] = {}
        windows, owners = [], []
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text or "")]
            for k in range(len(own) - size + 1):
                windows.append(own[k : k + size])
                owners.append(item)
        table = np.array(windows, np.int64).reshape(-1, size)
        owners_ = np.array(owners, np.int64)
        self.shift = np.full(1 << _BITS, size - 1, np.int16)
        for j in range(1, size):
            np.minimum.at(self.shift, self._block(table[:, j - 1], table[:, j]), size - 1 - j)
        key = self._suffix(table)
        order = np.argsort(key, kind="stable")
        self.windows, self.owners, self.keys = table[order], owners_[order], key[order]

    @staticmethod
    def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        value = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (value >> np.uint64(64 - _BITS)).astype(np.int64)

    def _suffix(self, rows: np.ndarray) -> np.ndarray:
        """Hash of each row's last four words and first two: the bucket whose windows are compared directly."""
        value = np.zeros(len(rows), np.uint64)
        for j in (*range(max(0, self.size - 4), self.size), *range(min(2, self.size))):
            value = value * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64) + np.uint64(1)
        return value

    def search(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (number of the text, item) of all occurrences.

        Texts lie end to end in one array of word ids and are scanned in ranges of window ends, each with a cursor of
        its own: a cursor skips by the shift of the block before it, and where the shift is 0 its bucket is compared.
        """
        size = self.size
        lengths = np.array([len(t) for t in texts], np.int64)
        stream = np.fromiter((self.ids.get(w, 0) for t in texts for w in t), np.int64, int(lengths.sum()))
        starts = np.cumsum(np.r_[0, lengths])[:-1]
        cursor, stop = [], []
        for start, length in zip(starts[lengths >= size], lengths[lengths >= size]):
            begin = np.arange(start + size - 1, start + length, _CHUNK)
            cursor.append(begin)
            stop.append(np.minimum(begin + _CHUNK, start + length))
        empty = np.zeros(0, np.int64)
        if not cursor or not len(self.keys):
            return empty, empty
        at, end = np.concatenate(cursor), np.concatenate(stop)
        hits = []
        while len(at):
            shift = self.shift[self._block(stream[at - 1], stream[at])]
            hits.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            live = at < end
            at, end = at[live], end[live]
        hit = np.concatenate(hits)
        rows = stream[hit[:, None] + np.arange(1 - size, 1)]
        known = (rows > 0).all(axis=1)
        hit, rows = hit[known], rows[known]
        key = self._suffix(rows)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        count = high - low
        which = np.repeat(np.arange(len(hit)), count)
        window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        same = (rows[which] == self.windows[window]).all(axis=1)
        text = np.searchsorted(starts, hit[which[same]], "right") - 1
        found = np.unique(np.stack([text, self.owners[window[same]]], axis=1), axis=0)
        return found[:, 0], found[:, 1]


def _plain(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the words of each text, one space apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [" ".join(words(t)) for t in batch["text"]]})

    return documents.mapInPandas(run, "doc_id bigint, text string")


def _search(documents: DataFrame, own: DataFrame, size: int, split: Callable[[str], list[str]]) -> tuple[DataFrame, Broadcast]:
    shared = documents.sparkSession.sparkContext.broadcast(Patterns([(r["item_id"], r["text"]) for r in own.toLocalIterator()], size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, stop in chunks(list(batch["text"])):
                text, item = shared.value.search([split(t) for t in batch["text"].iloc[start:stop]])
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[start:stop][text], "item_id": item})

    return documents.mapInPandas(run, "doc_id bigint, item_id bigint"), shared


def leaks(documents: DataFrame, items: DataFrame, size: int = WORDS, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """``(doc_id, item_id)``: the document holds at least ``size`` consecutive words of the item.

    The items' windows are broadcast. Above ``items_per_pass`` items they are split by a hash into so many passes, run one
    after the other over texts that are read into words once; each pass is kept in the shared folder and its broadcast
    destroyed before the next, so driver and executors hold one pass at a time. Null and short texts hold nothing;
    repeated items each count.
    """
    texts, wanted = documents.where(F.col("text").isNotNull()).select("doc_id", "text"), items.select("item_id", "text")
    passes = max(1, -(-items.count() // items_per_pass))
    if passes == 1:
        return _search(texts, wanted, size, words)[0]
    plain = shared_table(_plain(texts))
    found = []
    for k in range(passes):
        hits, shared = _search(plain, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k), size, str.split)
        found.append(checkpoint(hits))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)
