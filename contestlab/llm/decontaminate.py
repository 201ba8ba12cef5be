"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 7).

The symbols are words. The patterns are the benchmark's 13-word windows; a shorter item is one pattern of its own length, and each
length has its own machine, so that one short item does not shorten every shift. A machine holds, for blocks of two words, how
far the search may jump (a block that no pattern holds lets it jump m - 1 words), and buckets of patterns by their last block.
Where the shift is 0 the bucket's patterns, told apart by a hash, are compared word by word. All tables are flat arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
#: Bytes of benchmark text that one search holds in each task's memory; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 16_000_000
#: Lower-cases A-Z; every byte outside 0-9, a-z and 0x80-0xFF parts words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORD_BYTES).split()


def machines(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict:
    """The search's tables over `items` (id, text): plain arrays of about 30 bytes a benchmark word, and a dict of its distinct words.

    For each pattern length m: the blocks (pairs of word numbers; one word where m is 1), sorted, with their shifts, and the patterns,
    sorted by last block and hash, as offsets into the words of all items in a row.
    """
    number: dict[bytes, int] = {}
    ids, starts, names, offsets, blocks, shifts = [], [0], [], {}, {}, {}
    for name, data in items:
        words = words_of(data)
        n, m = len(words), min(len(words), window)
        if not n:
            continue
        own = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        offsets.setdefault(m, []).append(starts[-1] + np.arange(n - m + 1))
        blocks.setdefault(m, []).append(own if m == 1 else own[:-1] << 32 | own[1:])
        shifts.setdefault(m, []).append(np.maximum(0, m - min(2, m) - np.arange(n if m == 1 else n - 1)))
        ids.append(own)
        starts.append(starts[-1] + n)
        names.append(name)
    words = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    built = {"number": number, "words": words.astype(np.int32), "starts": np.array(starts), "names": names, "by_length": []}
    for m in sorted(offsets):
        block, shift = np.concatenate(blocks[m]), np.concatenate(shifts[m])
        order = np.lexsort((shift, block))
        block, shift = block[order], shift[order]
        first = np.append(True, block[1:] != block[:-1])
        block, shift, at = block[first], shift[first].astype(np.int32), np.concatenate(offsets[m])
        last = words[at] if m == 1 else words[at + m - 2] << 32 | words[at + m - 1]
        key = _keys(np.searchsorted(block, last), _hashes(words, at, m))
        order = np.argsort(key, kind="stable")
        built["by_length"].append((m, block, shift, key[order], at[order]))
    return built


def _hashes(words: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m words from each position on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(m):
        out = (out + words[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _keys(block: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The place of a pattern's bucket and 32 bits of its hash in one number."""
    return block.astype(np.uint64) << np.uint64(32) | hashed >> np.uint64(32)


def occurrences(found: list[bytes], built: dict) -> list[tuple[int, int, set[str]]]:
    """(start, length, items) of every pattern occurrence among the words of a document."""
    get, out = built["number"].get, []
    doc = np.array([get(w, -1) for w in found], np.int64)
    n, words = len(doc), built["words"]
    for m, block, shift, keys, at in built["by_length"]:
        size = min(2, m)
        if n < m:
            continue
        # a word that no pattern holds makes a negative block, or one that is not found
        own = doc if size == 1 else np.where((doc[:-1] < 0) | (doc[1:] < 0), -1, doc[:-1] << 32 | doc[1:])
        place = np.minimum(np.searchsorted(block, own), len(block) - 1)
        jump = np.where(block[place] == own, shift[place], m - size + 1)
        if jump[m - size:].all():
            continue
        steps, ends, end = jump.tolist(), [], m
        while end <= n:
            step = steps[end - size]
            if not step:
                ends.append(end)
            end += step or 1
        start = np.array(ends, np.int64) - m
        key = _keys(place[start + m - size], _hashes(doc, start, m))
        for a, low, high in zip(start.tolist(), np.searchsorted(keys, key).tolist(), np.searchsorted(keys, key, "right").tolist()):
            same = {int(np.searchsorted(built["starts"], p, "right")) - 1 for p in at[low:high].tolist() if np.array_equal(words[p: p + m], doc[a: a + m])}
            if same:
                out.append((a, m, {built["names"][k] for k in same}))
    return out


def _search(held):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = held.value
        for frame in frames:
            n_words, n_hit, items, spans = [], [], [], []
            for data in frame["text"]:
                words = words_of(data)
                hits = occurrences(words, built)
                names: set[str] = set()
                merged: list[list[int]] = []
                for a, m, own in sorted(hits, key=lambda x: x[:2]):
                    names |= own
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], a + m)
                    else:
                        merged.append([a, a + m])
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in merged))
                items.append(sorted(names - {None}))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "row": frame["row"], "n_words": n_words, "n_hit": n_hit, "items": items, "spans": spans})

    return run


FOUND = "doc_id long, row string, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of at most `most` bytes (one larger item is a block of its own); one block is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null").toLocalIterator():
        if block and size + len(row.t) > most:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t)))
        size += len(row.t)
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
                   window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted), spans (word ranges [start, end) that are hit), contaminated.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Only a block of the benchmark of at most `block_bytes` is sent to the
    executors at a time. A benchmark of one block needs one pass and no shuffle; of more, one pass a block, whose spans
    are joined by document and text. Null and empty texts have no words and no hits; null item texts and items without words match
    nothing; an item without an id hits like any other, but is not among `items`. Repeated rows come back repeated. Empty tables
    give an empty result, or no hits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    passes = []
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        held = spark.sparkContext.broadcast(machines(block, window))
        key = F.lit(None).cast("string") if not passes else F.sha2("text", 256)
        passes.append((held, key))
    if len(passes) == 1:
        found = rows.withColumn("row", passes[0][1]).mapInPandas(_search(passes[0][0]), FOUND)
    else:
        each = [rows.withColumn("row", F.sha2("text", 256)).mapInPandas(_search(held), FOUND) for held, _ in passes]
        union = each[0]
        for more in each[1:]:
            union = union.unionByName(more.where("n_hit > 0"))
        first = each[0].select("doc_id", "row", "n_words")
        hits = union.where("n_hit > 0").groupBy("doc_id", "row").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all"))
        merge = """aggregate(all, cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
            case when size(acc) > 0 and s.start <= element_at(acc, -1).end
                 then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))
                 else concat(acc, array(s)) end)"""
        hits = hits.withColumn("spans", F.expr(merge)).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "items", "spans")
        found = first.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row").eqNullSafe(F.col("r")), "left").select(
            "doc_id", "n_words", F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.lit(0)).alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
            F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))
    return found.select("doc_id", "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
