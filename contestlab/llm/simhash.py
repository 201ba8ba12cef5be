"""SimHash near-duplicates with pigeonring filtering (operator 2).

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints at most `3` bits
apart are linked. Candidates come from the strong pigeonring principle (Qin and Xiao, 2018): cut 64 bits into m = 4
segments on a ring; if two fingerprints differ in at most t = 3 bits, some start exists from which every chain of l
consecutive segments differs in at most floor(l * t / m) bits: 0, 1, 2, 3. The budgets of the first three chains go into the
join key itself: the first segment is equal, and of the next two segments' four bytes two are equal, one of them in the second
segment, as they differ in at most 1 and together in at most 2 bits. That gives 20 keys of 32 bits a fingerprint. The whole
chain is tested before the full Hamming check.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import linked_groups, only, scratch, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Pairs of the four bytes that follow the first segment; the first of each pair lies in the second segment.
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of one text's UTF-8 bytes; 0 without words."""
    words = (data or b"").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 2:
        parts = [b" ".join(words)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: n - 1]]]
        parts = [joined[a:b] for a, b in zip(starts, ends[shingle - 1:])]
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts, [seed] * len(parts)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashed), 65536):
        block = hashed[k: k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(parts)).view(">i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    def batch(data: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle, seed) for x in data], dtype="int64")

    return F.pandas_udf(batch, "long")(text.cast("binary"))


def keyed(prints: DataFrame, *carried: str) -> DataFrame:
    """One row for each fingerprint `fp` and key of the filter: (fp, ring) and the carried columns. Fingerprints within 3 bits share a key."""
    options = []
    for i in range(4):
        ring = F.col("fp") if i == 0 else F.shiftrightunsigned("fp", 16 * i).bitwiseOR(F.shiftleft("fp", 64 - 16 * i))
        byte = [F.shiftrightunsigned(ring, 16 + 8 * q).bitwiseAND(F.lit(0xFF)) for q in range(4)]
        for p, (a, b) in enumerate(PAIRS):
            combo = 5 * i + p
            key = F.lit(combo << 32).bitwiseOR(F.shiftleft(ring.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseOR(F.shiftleft(byte[a], 8)).bitwiseOR(byte[b])
            options.append(key)
    return prints.select("fp", *carried, F.explode(F.array(*options)).alias("ring"))


def _passes(x: Column) -> Column:
    """Whether two fingerprints with difference `x` share one of the 20 keys, whose chain stays within its budgets."""
    found = F.lit(False)
    for i in range(4):
        ring = x if i == 0 else F.shiftrightunsigned(x, 16 * i).bitwiseOR(F.shiftleft(x, 64 - 16 * i))
        for a, b in PAIRS:
            mask = 0xFFFF | (0xFF << (16 + 8 * a)) | (0xFF << (16 + 8 * b))
            chains = [F.bit_count(ring.bitwiseAND(F.lit((1 << (16 * n)) - 1))) <= n * MOST_BITS // 4 for n in (2, 3)]
            found = found | ((ring.bitwiseAND(F.lit(mask)) == 0) & chains[0] & chains[1])
    return found


def linked(a: Column, b: Column) -> Column:
    """Whether two fingerprints pass the pigeonring filter, some chain within its budgets, and differ in at most 3 bits."""
    x = a.bitwiseXOR(b)
    return (F.bit_count(x) <= MOST_BITS) & _passes(x)


def fingerprint_groups(prints: DataFrame, keep: Callable[..., DataFrame]) -> DataFrame:
    """(node, component): the distinct fingerprints `fp` that are linked to others, with the smallest one reachable.

    A crowd of close fingerprints does not make all its pairs: each is tried with the first one under each of its keys, then with those
    under its keys that it isn't connected to.
    """
    groups = linked_groups(keyed(only(prints, "fp")).select(F.col("ring").alias("gram"), F.col("fp").alias("key")), prints.select(F.col("fp").alias("key")),
                           lambda members: members.select("key", F.col("key").alias("sketch")), linked, lambda pairs, members: pairs, keep)
    return groups.select(F.col("key").alias("node"), "component")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest id among the documents linked to it, directly or not.

    Null and empty texts have fingerprint 0 and link like any other; texts under `shingle` words hash as a whole. Repeated
    rows come back repeated. A null id takes part, and gets its component's smallest id (null if no row there has one). An
    empty table gives an empty result. Other columns are not looked at.
    """
    with scratch(docs.sparkSession) as keep:
        prints = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp")))
        least = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
        parts = keep(fingerprint_groups(least, keep))
        # a component of fingerprints takes the smallest document id of all its fingerprints
        named = keep(least.join(parts, least["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("part")))
        lowest = named.groupBy("part").agg(F.min("low").alias("component_id"))
        names = written(named.join(lowest, "part").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")
