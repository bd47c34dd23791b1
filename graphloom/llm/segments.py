"""Problem 9: the language of each document and of each segment of a mixed one, by rank-order profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.languages import LANGUAGES, SAMPLE_PER_LABEL, gram_counts, label_language, labelled_sample
from graphloom.llm.text import chunks, is_sentence, letters, ngrams, sentences, unwrapped, without_code, without_names

SIZES = (1, 2, 3, 4, 5)
#: n-grams of each language's profile.
PROFILE = 2000
#: Letters that a sentence must have to be given a language of its own; fewer for scripts without spaces.
LEAST_LETTERS = 12
LEAST_IDEOGRAMS = 4
#: A sentence counts only if the second best language is further off by this share; under WEAK_MARGIN it takes the
#: second best if that is a neighbour's language.
LEAST_MARGIN = 0.02
WEAK_MARGIN = 0.1
#: Sentences of fewer letters need this margin.
SHORT_LETTERS, SHORT_MARGIN = 24, 0.25


_ID_BITS = np.uint64(35)
_ID_MASK = np.uint64((1 << 35) - 1)
_FEW = 255  # counts up to here fit beside owner and id in one number


class Profiles:
    """Rank-order profiles of all languages."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        grams = np.array(sorted({gram for _, gram, _ in rows}), np.int64)
        self.grams = grams.view(np.uint64)
        order = np.argsort(self.grams)
        self.grams = self.grams[order]
        self.ranks = np.full((len(grams) + 1, len(LANGUAGES)), size, np.int32)
        for language, gram, rank in rows:
            at = np.searchsorted(self.grams, np.int64(gram).astype(np.uint64))
            self.ranks[at, LANGUAGES.index(language)] = rank

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean out-of-place distance of each text's most frequent n-grams to each profile, as a share of the worst."""
        found = np.ones((len(texts), len(LANGUAGES)))
        for start, stop in chunks(texts):
            gram, owner = ngrams(texts[start:stop], SIZES)
            if not len(gram):
                continue
            # owner and id in one number: a sort of plain numbers counts each text's grams, a second one ranks them
            key = np.sort((owner.astype(np.uint64) << np.uint64(35)) | gram)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[first, len(key)])
            key = key[first]
            owner, gram = (key >> _ID_BITS).astype(np.int64), key & _ID_MASK
            if count.max() <= _FEW and owner[-1] < 1 << 21:
                ranked = np.sort((owner.astype(np.uint64) << np.uint64(43)) | ((np.uint64(_FEW) - count.astype(np.uint64)) << _ID_BITS) | gram)
                owner, gram = (ranked >> np.uint64(43)).astype(np.int64), ranked & _ID_MASK
            else:
                order = np.lexsort((gram, -count, owner))
                owner, gram = owner[order], gram[order]
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
            top = rank < self.size
            gram, owner, rank = gram[top], owner[top], rank[top]
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            at = np.where(self.grams[at] == gram, at, len(self.grams))
            places = self.ranks[at]
            off = np.where(places < self.size, np.abs(places - rank[:, None]), self.size)
            held = np.diff(np.r_[begin, len(owner)])
            found[start + owner[begin]] = np.add.reduceat(off, begin, axis=0) / (held[:, None] * self.size)
        return found


def fit_profiles(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL, size: int = PROFILE) -> Profiles:
    """Profiles from about ``per_label`` documents of each label; ``size`` rows a language reach the driver."""
    counts = gram_counts(labelled_sample(documents, per_label), SIZES)
    order = Window.partitionBy("language").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return Profiles([(r["language"], r["gram"], r["rank"]) for r in top.select("language", "gram", "rank").collect()], size)


def _enough(words: str) -> bool:
    letters = len(words) - words.count(" ")
    return letters >= LEAST_LETTERS or sum("぀" <= c <= "鿿" for c in words) >= LEAST_IDEOGRAMS


def _wanted_margin(words: str) -> float:
    short = len(words) - words.count(" ") < SHORT_LETTERS and words.isascii()
    return SHORT_MARGIN if short else LEAST_MARGIN


def _segments(pieces: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Stretches of one language with their mean confidence; sentences without a language join their neighbours."""
    found: list[list] = []
    for language, confidence in pieces:
        if found and found[-1][0] == language:
            found[-1][1].append(confidence)
        else:
            found.append([language, [confidence]])
    return [(language, float(np.mean(c))) for language, c in found]


def segment_texts(texts: list[str | None], profiles: Profiles) -> list[list[tuple[str, float]]]:
    """The segments of each text as (language, confidence); empty where there is no natural language."""
    known: dict[str, tuple[str, bool]] = {}
    pieces = []
    for text in texts:
        own = sentences(without_names(unwrapped(without_code(text)))) if text else []
        for s in own:
            if s not in known:
                known[s] = letters(s), is_sentence(s)
        pieces.append([known[s] for s in own])
    unique = list({p: None for p, whole in known.values() if p and whole})
    number = {p: k for k, p in enumerate(unique)}
    far = profiles.distances(unique) if unique else np.ones((0, len(LANGUAGES)))
    order = far.argsort(axis=1, kind="stable")
    near = np.take_along_axis(far, order[:, :2], axis=1)
    margin = (near[:, 1] - near[:, 0]) / np.maximum(near[:, 1], 1e-9)
    sure = [_enough(p) and margin[k] >= _wanted_margin(p) for k, p in enumerate(unique)]
    result = []
    for own in pieces:
        ids = [k for p, whole in own if p and whole and sure[k := number[p]]]
        held = [(int(order[k, 0]), float(margin[k])) for k in ids]
        for j, k in enumerate(ids):
            around = {ids_language for ids_language, _ in held[max(0, j - 1) : j] + held[j + 1 : j + 2]}
            if margin[k] < WEAK_MARGIN and held[j][0] not in around and int(order[k, 1]) in around:
                held[j] = (int(order[k, 1]), 0.0)
        if not held:
            words = " ".join(p for p, _ in own if p)
            if _enough(words):
                d = profiles.distances([words])[0]
                a, b = np.sort(d)[:2]
                held = [(int(d.argmin()), float((b - a) / max(b, 1e-9)))] if b - a >= WEAK_MARGIN * b else []
        result.append([(LANGUAGES[k], c) for k, c in _segments(held)])
    return result


def language_segments(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """``(doc_id, label, segment, lang, confidence, segments)`` of all documents that have natural language.

    Code, identifiers, their headings and lists are no segments; a foreign phrase within a sentence is none either.
    ``label`` is the language that the document's own label names, or null. The confidence is the share by which the
    second best language is further off; ``segments`` is the document's number of them. Null, blank and code-only
    texts have no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, stop in chunks(list(batch["text"])):
                part = batch.iloc[start:stop]
                rows = [
                    (doc, label, k, lang, confidence, len(found))
                    for doc, label, found in zip(part["doc_id"], part["label"], segment_texts(list(part["text"]), shared.value))
                    for k, (lang, confidence) in enumerate(found)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "label", "segment", "lang", "confidence", "segments"])

    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text", label_language(F.col("lang")).alias("label"))
    return rows.mapInPandas(run, "doc_id bigint, label string, segment int, lang string, confidence double, segments int")


def mislabelled(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """``(doc_id, segment, lang)``: all segments of each document that is mixed or whose label does not name its language."""
    found = language_segments(documents, fit_profiles(documents, per_label))
    return found.where((F.col("segments") > 1) | ~F.col("lang").eqNullSafe(F.col("label"))).select("doc_id", "segment", "lang")
