"""Random draws from md5 in Arrow batches, many at once, for replicates."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Poisson(1): the shares of draws under 1, 2, ... 6 units.
POISSON_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
#: Messages that are hashed at once; their working arrays stay in a core's cache.
BLOCK = 1 << 15

_SINES = [int(abs(np.sin(k + 1)) * 2 ** 32) for k in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def first_words(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first eight hexadecimal digits of the md5 of `n` one-block messages as numbers; `words` are the 16 words of each block.

    The state's first word is settled three steps before the end.
    """
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t = np.empty(n, np.uint32)
    for k in range(61):
        turn = k // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            at = k
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif turn == 1:  # c ^ (d & (b ^ c))
            at = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif turn == 2:  # b ^ c ^ d
            at = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:  # c ^ (b | ~d)
            at = (7 * k) % 16
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        t += a
        if isinstance(words[at], np.ndarray):
            t += words[at]
            t += np.uint32(_SINES[k])
        else:
            t += np.uint32((_SINES[k] + words[at]) % 2 ** 32)
        s = _TURNS[turn][k % 4]
        np.left_shift(t, np.uint32(s), out=a)
        np.right_shift(t, np.uint32(32 - s), out=t)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    # after the 61st step the newest word is the one that ends as the first
    b += np.uint32(0x67452301)
    return b.byteswap()


def _packed(texts: list[bytes], offset: int, n_words: int) -> np.ndarray:
    """Texts of one length as 32-bit words of a block in which they start at `offset`: one row a text."""
    room = np.zeros((len(texts), 4 * n_words), np.uint8)
    if texts[0]:
        room[:, offset: offset + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return room.view("<u4").astype(np.uint32)


def md5_numbers(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The first 32 bits of md5(head + tail), one row a head and one column a tail; the heads are of one length, and so are the tails."""
    size = len(heads[0]) + len(tails[0])
    if size > 55:  # more than one block
        return np.array([[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads], np.uint32)
    n_words = size // 4 + 1
    left, right = _packed(heads, 0, n_words), _packed([t + b"\x80" for t in tails], len(heads[0]), n_words)
    words: list[np.ndarray | int] = [0] * 16
    for k in range(n_words):
        words[k] = (left[:, None, k] | right[None, :, k]).reshape(-1)
    words[14] = 8 * size
    return first_words(words, len(heads) * len(tails)).reshape(len(heads), len(tails))


def poisson_weights(drawn: np.ndarray) -> np.ndarray:
    """How often each unit is drawn, from 32-bit numbers."""
    weight = np.zeros(drawn.shape, np.uint8)
    for c in POISSON_CUTS:
        weight += drawn >= np.uint32(np.ceil(c * 2 ** 32))
    return weight


def weighted_sums(reps: int):
    """A function for mapInArrow over (head binary, num, den): for each replicate 1 to `reps` the sums of weight * num and weight * den of a task's rows,
    the weights drawn from md5(head + replicate). Null numbers count nothing; `nums` and `dens` say how many were not null.
    """
    columns: dict[int, list[bytes]] = {}
    for rep in range(1, reps + 1):
        columns.setdefault(len(str(rep)), []).append(str(rep).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, seen = np.zeros((2, reps)), [0, 0], False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            heads, values = batch.column(0).to_pylist(), []
            for k in (0, 1):
                column = batch.column(k + 1)
                counts[k] += batch.num_rows - column.null_count
                values.append(column.fill_null(0.0).to_numpy(zero_copy_only=False))
            both, lengths = np.stack(values), np.array([len(h) for h in heads], np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                for texts in columns.values():
                    first = int(texts[0]) - 1
                    for at in range(0, len(texts), BLOCK):
                        part = texts[at: at + BLOCK]
                        step = max(1, BLOCK // len(part))
                        for k in range(0, len(rows), step):
                            some = rows[k: k + step]
                            weight = poisson_weights(md5_numbers([heads[i] for i in some], part))
                            sums[:, first + at: first + at + len(part)] += both[:, some] @ weight.astype(np.float64)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, reps + 1), pa.int32()), pa.array(sums[0]), pa.array(sums[1]), pa.array([counts[0]] * reps, pa.int64()), pa.array([counts[1]] * reps, pa.int64())], ["rep", "num", "den", "nums", "dens"])

    return run


def drawn_winners(sims: int, slot: pa.DataType):
    """A function for mapInArrow over contests (head binary, e: list of structs (slot, cum, o)): for each sim 1 to `sims` and slot that wins in it, the sum of its odds.

    The winner is the first entry whose cumulative probability is not under the number of md5(head + sim), or the last one. Null odds count nothing.
    """
    columns: dict[int, list[bytes]] = {}
    for sim in range(1, sims + 1):
        columns.setdefault(len(str(sim)), []).append(str(sim).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[object, np.ndarray] = {}
        for batch in batches:
            heads, lists = batch.column(0).to_pylist(), batch.column(1)
            rows, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
            names = rows.field(0).dictionary_encode(null_encoding="encode")
            codes, names = names.indices.to_numpy().astype(np.int64), names.dictionary.to_pylist()
            cum, odds = rows.field(1).fill_null(np.nan).to_numpy(zero_copy_only=False), rows.field(2).fill_null(0.0).to_numpy(zero_copy_only=False)
            sums, counts = np.zeros((len(names), sims)), np.zeros((len(names), sims), np.int64)
            lengths = np.array([len(h) for h in heads], np.int64)
            for length, size in {*zip(lengths.tolist(), sizes.tolist())}:
                same = np.flatnonzero((lengths == length) & (sizes == size))
                for texts in columns.values():
                    first, step = int(texts[0]) - 1, max(1, BLOCK // (len(texts) * size))
                    for k in range(0, len(same), step):
                        some = same[k: k + step]
                        drawn = md5_numbers([heads[i] for i in some], texts) / 2.0 ** 32
                        at = np.zeros(drawn.shape, np.int64)
                        for j in range(size):
                            at += cum[starts[some] + j][:, None] < drawn
                        entry = starts[some][:, None] + np.minimum(at, size - 1)
                        cell = (codes[entry] * sims + first + np.arange(len(texts))).reshape(-1)
                        sums += np.bincount(cell, odds[entry].reshape(-1), sums.size).reshape(sums.shape)
                        counts += np.bincount(cell, minlength=sums.size).reshape(sums.shape)
            for name, s, c in zip(names, sums, counts):
                found[name] = found.get(name, 0) + np.stack([s, c])
        for name, (s, c) in found.items():
            won = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(won + 1, pa.int32()), pa.array([name] * len(won), slot), pa.array(s[won])], ["sim", "slot", "o"])

    return run
