"""Language identification with language-bitmask n-gram filters (operator 3).

A bit-sliced Bloom filter has one bit a language in every slot. One lookup of an n-gram (the AND of a few slots) returns
all languages that contain it. A text's score for a language is the number of its n-grams with that language's bit, corrected for
the filter's false positives: (hits - n * rate) / (1 - rate), where rate is the language's share of set slots to the power
of the number of hash functions. N-grams are 4 bytes of lower-cased UTF-8 with everything in ASCII but letters as blanks.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import private_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The fit reads about this many labelled documents a language (all, if there are fewer), picked by a hash of the id.
SAMPLE_PER_LANGUAGE = 1500
#: Each language's most frequent n-grams that enter the filter, and those that it must hold of its n-grams to count.
GRAMS_PER_LANGUAGE, LEAST_SHARE = 3000, 2e-5
SLOT_BITS, HASHES = 18, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
BLANKS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """All 4-byte n-grams of a text as unsigned 32-bit numbers, repeats included."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(BLANKS), np.uint8)
    if len(data) < 4:
        return np.zeros(0, np.uint32)
    out = data[:-3].astype(np.uint32)
    for j in (1, 2, 3):
        out |= data[j: len(data) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _slots(found: np.ndarray) -> list[np.ndarray]:
    return [(found * np.uint32(a)) >> np.uint32(32 - SLOT_BITS) for a in HASHES]


class LanguageFilter:
    """Byte planes of the bit-sliced filter: bit k % 8 of plane k // 8 is language k."""

    def __init__(self, known: dict[str, list[int]]):
        self.languages = sorted(known)
        self.planes = np.zeros(((len(known) + 7) // 8, 1 << SLOT_BITS), np.uint8)
        for k, lang in enumerate(self.languages):
            for at in _slots(np.array(known[lang], np.uint32)):
                self.planes[k // 8, at] |= np.uint8(1 << k % 8)
        fill = np.array([(self.planes[k // 8] >> np.uint8(k % 8) & 1).mean() for k in range(len(self.languages))])
        self.rate = fill ** len(HASHES)

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, share of the corrected hits); `und` without letters or languages; without any hit the first language at 0."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        found = grams(text)
        at = _slots(found)
        hits = []
        for plane in self.planes:
            both = plane[at[0]] & plane[at[1]] & plane[at[2]]
            counts = np.bincount(both, minlength=256)
            hits.append(counts @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"))
        n = np.concatenate(hits)[: len(self.languages)]
        clean = np.maximum(0, (n - len(found) * self.rate) / (1 - self.rate))
        best, total = int(clean.argmax()), float(clean.sum())
        return self.languages[best], float(clean[best] / total) if total else 0.0


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        totals: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(frame["lang"], frame["text"]):
            values, n = np.unique(grams(text), return_counts=True)
            totals[lang].update(dict(zip(values.tolist(), n.tolist())))
        for lang, found in totals.items():
            yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE,
        grams_per_language: int = GRAMS_PER_LANGUAGE) -> LanguageFilter:
    """The filter learned from a bounded sample of labelled rows; rows without text or language are left out.

    The number of languages is the number of distinct labels, and bounds what reaches the driver.
    """
    rows = labelled.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    mark = F.conv(F.substring(F.md5(F.coalesce("id", F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    counts = rows.where(mark < share[F.col("lang")]).select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("lang")
    top = counts.withColumn("share", F.col("n") / F.sum("n").over(own)).where(F.col("share") >= LEAST_SHARE).withColumn(
        "k", F.row_number().over(own.orderBy(F.desc("n"), "gram"))).where(F.col("k") <= grams_per_language)
    known: dict[str, list[int]] = defaultdict(list)
    for r in top.select("lang", "gram").collect():
        known[r.lang].append(r.gram)
    return LanguageFilter(known)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (both replaced if they exist).

    Null texts and texts without a letter are `und` with score 0. Of languages with equal counts the first by name is taken. Repeated
    rows come back repeated, an empty table gives an empty result. The filter (a few hundred kB for each 8 languages) is broadcast.
    """
    held, made = docs.sparkSession.sparkContext.broadcast(vars(model)), private_name("lang")

    def batch(texts: pd.Series) -> pd.DataFrame:
        own = object.__new__(LanguageFilter)
        vars(own).update(held.value)
        return pd.DataFrame([own.score(x) for x in texts], columns=["lang_pred", "score"])

    out = docs.withColumn(made, F.pandas_udf(batch, "lang_pred string, score double")(F.col(text)))
    return out.withColumn("lang_pred", F.col(f"{made}.lang_pred")).withColumn("score", F.col(f"{made}.score")).drop(made)
