"""Language labels, and n-gram counts of texts by language from a bounded sample of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import letters, ngrams, sentences, without_code, without_names

#: The languages, and the spellings of their labels besides the two-letter code.
NAMES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "it": ("ita", "italian", "italiano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "nl": ("nld", "dut", "dutch", "nederlands", "flemish"),
    "pl": ("pol", "polish", "polski"),
    "ru": ("rus", "russian", "русский"),
    "ja": ("jpn", "japanese", "日本語"),
}
LANGUAGES = tuple(NAMES)
#: Documents of each label that models are fitted on, about.
SAMPLE_PER_LABEL = 600


def label_language(label: Column) -> Column:
    """The two-letter code that a label names, in any case, with or without a region; null if it names none of ours."""
    bare = F.lower(F.trim(label))
    head = F.regexp_extract(bare, r"^([\p{L}]+)", 1)
    known = F.lit(None).cast("string")
    for code, names in NAMES.items():
        known = F.when(head.isin(code, *names), code).otherwise(known)
    return F.when(bare.rlike(r"^[\p{L}]+([-_][\p{L}\d]+)*$"), known)


def labelled(documents: DataFrame) -> DataFrame:
    """``(language, text, doc_id)`` of all documents with a text and a label that names one of our languages."""
    return documents.select(label_language(F.col("lang")).alias("language"), "text", "doc_id").where(F.col("language").isNotNull() & F.col("text").isNotNull())


def labelled_sample(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """``(language, text)``: of each label about ``per_label`` documents, chosen by a hash of ``doc_id``."""
    known = labelled(documents)
    sizes = {row["language"]: row["count"] for row in known.groupBy("language").count().collect()}
    share = F.lit(0)
    for language, size in sizes.items():
        share = F.when(F.col("language") == language, int(min(1.0, per_label / size) * (1 << 20))).otherwise(share)
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("language", "text")


def gram_counts(sample: DataFrame, sizes: Sequence[int], buckets: int = 0) -> DataFrame:
    """``(language, gram, n)``: how often each hashed n-gram occurs in a label's texts; modulo ``buckets`` if given."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, group in batch.groupby("language"):
                for start in range(0, len(group), 200):
                    texts = [letters(s) for t in group["text"].iloc[start : start + 200] for s in sentences(without_names(without_code(t)))]
                    gram, _ = ngrams(texts, sizes)
                    gram, n = np.unique(gram % np.uint64(buckets) if buckets else gram, return_counts=True)
                    yield pd.DataFrame({"language": language, "gram": gram.astype(np.int64), "n": n})

    return sample.mapInPandas(count, "language string, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
