"""Repeated word spans by relative Lempel-Ziv parsing (operator 5).

Every document is factored against all others. The reference index is cut into blocks by the hash of 13-word seeds: each
document looks up the seed at every one of its positions in the block that the seed's hash names, so each seed meets each place
where it occurs without any document being compared with all blocks. A seed found in a document with a smaller id starts
a factor; the greedy parse lengthens a factor while the next seed continues at the same place of the reference. A factor may end
where its reference differs although another reference goes on; the seeds that straddle the boundary are looked up as well,
so nothing is lost there. Words under any factor are duplicates.

Seeds are compared by 80 bits of two hashes, not word by word: among 10^10 seeds about 10^-4 false matches are expected, among 10^13
about 40, each of 13 words. An Arrow batch first settles what repeats inside it, and sends each of
its seeds for the smallest document only, so a seed that a third of all documents share costs one record a batch.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from contestlab.operators import ranks

from .common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
#: Seeds in a block of the index, on average; a block is handled in one task's memory (about 100 bytes a seed).
BLOCK_SEEDS = 600_000
#: Words that a task settles among themselves before it sends seeds (one longer document is settled alone).
SETTLE_WORDS = 400_000
RANGES = "doc_id long, start int, seeds int, ref_doc long, ref_start int"


def _seed_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 and of 16 bits for the `window` words from each position; positions near the end run over it and must be masked."""
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, made = max(0, len(one) - window + 1), []
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        total = np.zeros(n, np.uint64)
        for j in range(window):  # Horner's rule modulo 2**64
            total *= np.uint64(odd)
            total += one[j: j + n]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
        made.append(total)
    return made[0], (made[1] >> np.uint64(48)).astype(np.uint16)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes by byte plane: of small ones nearly all planes are zero, which the shuffle compresses away."""
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()


def _pack(hashes: np.ndarray, more: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Records of one block in order of document and position: 10 bytes of hashes, and the ids and starts by their steps."""
    first = np.append(0, np.flatnonzero(np.diff(docs)) + 1)
    step = np.diff(starts, prepend=0)
    step[first] = starts[first]
    head = np.array([len(hashes), len(first)], np.int64).tobytes()
    return b"".join([head, hashes.tobytes(), more.tobytes(), _planes(np.diff(docs[first], prepend=0)), _planes(np.diff(np.append(first, len(docs)))), _planes(step)])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(data, np.int64, 2))
    hashes, more = np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.uint16, n, 16 + 8 * n)
    at = 16 + 10 * n
    ids, counts, step = np.cumsum(_from_planes(data, m, at)), _from_planes(data, m, at + 8 * m), _from_planes(data, n, at + 16 * m)
    total, first = np.cumsum(step), np.cumsum(counts) - counts
    return hashes, more, np.repeat(ids, counts), total - np.repeat(total[first] - step[first], counts)


def _ranges(docs, starts, ref_docs, ref_starts) -> pa.RecordBatch:
    """Join what continues one another: records sorted by document and start become ranges of seeds."""
    if len(docs):
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1) | (ref_docs[1:] != ref_docs[:-1]) | (ref_starts[1:] != ref_starts[:-1] + 1)
        first = np.flatnonzero(new)
        seeds = np.diff(np.append(first, len(docs)))
    else:
        first = seeds = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(docs[first], pa.int64()), pa.array(starts[first].astype(np.int32)), pa.array(seeds.astype(np.int32)),
                                       pa.array(ref_docs[first], pa.int64()), pa.array(ref_starts[first].astype(np.int32))],
                                      names=["doc_id", "start", "seeds", "ref_doc", "ref_start"])


def _settle(hashes, more, docs, starts):
    """Sort by seed; give back the records, and for each its seed's smallest (document, start)."""
    order = np.lexsort((starts, docs, more, hashes))
    h, x, d, s = hashes[order], more[order], docs[order], starts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return h, x, d, s, d[first][group], s[first][group]


def _send(ids: list[int], counts: list[int], words: list[bytes], window: int, blocks: int, share: int) -> pa.RecordBatch | None:
    """Settle what repeats among these documents; the rows to send: seeds by block, and the settled ranges."""
    ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
    hashes, more = _seed_hashes(words, window)
    if not len(hashes):
        return None
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(ids)), counts)[: len(hashes)]
    at = np.arange(len(hashes))
    whole = at + window <= ends[doc]
    h, x, d, s, least_doc, least_start = _settle(hashes[whole], more[whole], ids[doc[whole]], (at - (ends - counts)[doc])[whole])
    later = d // share > least_doc // share
    keep = np.lexsort((s[later], d[later]))
    here = _ranges(*(v[later][keep] for v in (d, s, least_doc, least_start)))
    block = (h >> np.uint64(40)) % np.uint64(blocks)
    rest = ~later
    order = np.lexsort((s[rest], d[rest], block[rest]))
    block, h, x, d, s = (v[rest][order] for v in (block, h, x, d, s))
    cuts = np.append(np.flatnonzero(np.diff(block)) + 1, len(block)) if len(block) else []
    rows, a = [], 0
    for b in cuts:
        rows.append((int(block[a]), False, _pack(h[a:b], x[a:b], d[a:b], s[a:b])))
        a = b
    if here.num_rows:  # rides along, spread over the blocks
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, here.schema) as out:
            out.write_batch(here)
        rows.append((int(ids[0] % blocks), True, sink.getvalue().to_pybytes()))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], names=["block", "settled", "records"])


def _seeds(window: int, blocks: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, words = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = (text.as_py() or b"").split()
                if words and len(words) + len(own) > SETTLE_WORDS:
                    made = _send(ids, counts, words, window, blocks, share)
                    ids, counts, words = [], [], []
                    if made:
                        yield made
                ids.append(doc_id.as_py())
                counts.append(len(own))
                words += own
        made = _send(ids, counts, words, window, blocks, share)
        if made:
            yield made

    return run


def _look_up(share: int):
    def run(table: pa.Table) -> pa.Table:
        done, found = [], []
        for settled, data in zip(table.column("settled"), table.column("records")):
            if settled.as_py():
                done += list(pa.ipc.open_stream(data.as_buffer()))
            else:
                found.append(_unpack(data.as_py()))
        if found:
            _, _, d, s, least_doc, least_start = _settle(*(np.concatenate(x) for x in zip(*found)))
            later = d // share > least_doc // share
            order = np.lexsort((s[later], d[later]))
            done.append(_ranges(*(x[later][order] for x in (d, s, least_doc, least_start))))
        # a worker waits for its next task without what this one held
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(done)

    return run


def seed_matches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, share: int = 1) -> DataFrame:
    """(doc_id, start, seeds, ref_doc, ref_start): runs of seed positions that occur in a document with a smaller id.

    Ids are whole numbers; those with the same quotient by `share` are one document's, and no copies of each other. Rows without an id take no part.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("doc_id is not null")
    # the number of index blocks follows the amount of text: a word has about 6 bytes
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, round(size / 6 / BLOCK_SEEDS))
    seeds = rows.mapInArrow(_seeds(window, blocks, share), "block int, settled boolean, records binary")
    return seeds.groupBy("block").applyInArrow(_look_up(share), RANGES)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in texts], pa.binary())],
                                         names=["doc_id", "size", "text"])


def _parse(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            lists = batch.column(3)
            flat, ends = lists.flatten(), np.cumsum([len(x) if x.is_valid else 0 for x in lists]) if len(lists) else []
            begin, seeds, ref, ref_at = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)) if len(flat) else ([], [], [], [])
            at = 0
            for k, (size, data) in enumerate(zip(batch.column(1), batch.column(2))):
                words = pa.decompress(data.as_py(), size.as_py(), "zstd", asbytes=True).split()
                a, at = at, int(ends[k])
                factors = []
                if at > a:
                    order = np.argsort(begin[a:at], kind="stable") + a
                    for b, n, r, p in zip(*(x[order].tolist() for x in (begin, seeds, ref, ref_at))):  # greedy: lengthen the last factor while the reference goes on
                        last = factors[-1] if factors else None
                        if last and last["ref_doc"] == r and b == last["start"] + (e := last["n_words"] - window + 1) and p == last["ref_start"] + e:
                            last["n_words"] += n
                        else:
                            factors.append({"start": b, "n_words": n + window - 1, "ref_doc": r, "ref_start": p})
                    gone = np.zeros(len(words), bool)
                    for f in factors:
                        gone[f["start"]: f["start"] + f["n_words"]] = True
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    removed = int(gone.sum())
                else:
                    kept, removed = b" ".join(words), 0
                out[0].append(len(words))
                out[1].append(removed)
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept.decode() if keep_text else None)
                out[4].append(factors if keep_text else [])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"])
        pa.default_memory_pool().release_unused()

    return run


def _keyed(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, int]:
    """(doc_id, key, text), and how many keys an id has (0: too many for 63 bits): key // that number is the id, and rows of one id with different texts have different keys."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b").select("doc_id")
    several = written(several)
    if several.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("key"), "text"), 1
    texts = rows.join(several, "doc_id", "left_semi").select("doc_id", "mark").distinct()
    number, n = ranks.positions(texts, "doc_id", "mark")
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if (max(abs(least), abs(most)) + 1) * n >= 1 << 62:  # no room for several keys an id
        return rows, 0
    return rows.join(number, ["doc_id", "mark"], "left").select("doc_id", (F.col("doc_id") * n + F.coalesce("position", F.lit(0))).alias("key"), "text"), n


def drop_repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, kept_text and factors (start, n_words, ref_doc, ref_start).

    A word goes if a run of `window` words that covers it also starts in a document with a smaller id. Runs are judged on
    the input. Null and empty texts, and texts under `window` words, keep all. Repeated rows come back repeated and are no
    copies of each other, as they share an id; rows of one id with different texts each lose what smaller ids have, and nothing else. Rows without
    an id keep all their words. Ids may be of any type that sorts; those that are no whole numbers, or too large, are numbered by their order first. An empty
    table gives an empty result. With keep_text=False the kept texts and factors stay empty, for callers who need the digests alone.
    """
    kind = docs.schema[doc_id].dataType
    keyed, share = _keyed(docs, text, doc_id) if isinstance(kind, IntegralType) else (None, 0)
    if not share:
        named = docs.select(F.col(f"`{doc_id}`").alias("name"), F.col(f"`{text}`").alias("text"))
        number = written(ranks.positions(named.where("name is not null").select("name").distinct(), "name")[0])
        found = drop_repeated_spans(named.join(number, "name", "left").select(F.col("position").cast("long").alias("doc_id"), "text"), window=window, keep_text=keep_text)
        found = found.withColumn("row", F.monotonically_increasing_id())
        found = written(found) if keep_text else found
        names = number.select(F.col("position").alias("doc_id"), F.col("name"))
        out = found.drop("factors").join(names, "doc_id", "left")
        if keep_text:
            named = found.select("row", F.explode("factors").alias("f")).join(number, F.col("f.ref_doc") == F.col("position")).groupBy("row").agg(F.sort_array(F.collect_list(
                F.struct("f.start", "f.n_words", F.col("name").alias("ref_doc"), "f.ref_start"))).alias("factors"))
            out = out.join(named, "row", "left")
        else:
            out = out.withColumn("factors", F.array().cast(f"array<struct<start:int,n_words:int,ref_doc:{kind.simpleString()},ref_start:int>>"))
        return out.select(F.col("name").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text", F.coalesce("factors", F.array()).alias("factors"))
    # a quotient that rounds down below zero too
    whole = lambda c: F.expr(f"({c} - pmod({c}, {share}L)) div {share}L") if share > 1 else F.col(c)
    # written first, so that the seeds' shuffle is gone before the texts are moved
    spans = written(seed_matches(keyed, "text", "key", window, share)).groupBy(F.col("doc_id").alias("key")).agg(
        F.collect_list(F.struct("start", "seeds", whole("ref_doc").alias("ref_doc"), "ref_start")).alias("spans"))
    rows = keyed.select("key", "text").mapInArrow(_squeeze, "doc_id long, size long, text binary").withColumnRenamed("doc_id", "key")
    return rows.join(spans, "key", "left").select(whole("key").alias("doc_id"), "size", "text", "spans").mapInArrow(
        _parse(window, keep_text),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start:int,n_words:int,ref_doc:bigint,ref_start:int>>")
