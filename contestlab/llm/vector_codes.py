"""Product-quantised codes of integer vectors, with memoised grid cells (operator 13).

Vectors are cut into equal parts, and each part position has a codebook of up to 256 entries, trained by a few rounds of nearest
assignment and mean. The nearest entry of a part is looked up by its coarse grid cell (a box of side 2^SHIFT in every component): for a cell
not met before, each entry's least and greatest distance over the box are computed, and entries whose least distance exceeds some
entry's greatest one are dominated: no point of the box is nearest to them. The others are cached under the cell, and a part is compared
exactly with its cell's entries only. All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private_name, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components are held within this, far beyond any embedding's, so that no sum of squares passes 63 bits.
MOST = 1 << 26
#: Side of a cell as a power of two, cells that a task keeps (it starts again when full), and cells bounded at a time.
SHIFT, CACHED, BLOCK = 5, 1 << 15, 128
#: A label of more than this share of all rows gets its sum by a broadcast of at most 1 / HOT rows.
HOT = 1 / 1000


class Grid:
    """Nearest entries of one part's codebook."""

    def __init__(self, entries: np.ndarray, shift: int = SHIFT, cached: int = CACHED):
        self.entries, self.shift, self.most = entries, shift, cached
        self.cells: dict[bytes, np.ndarray] = {}
        self.largest = int(np.abs(entries).max(initial=0))
        self.bounded = 0

    def _bound(self, cells: np.ndarray, kind: type) -> list[np.ndarray]:
        """For each cell the entries that are not dominated across its box, ascending."""
        low = (cells << self.shift).astype(kind)
        high, entries = low + kind((1 << self.shift) - 1), self.entries.astype(kind)
        least = np.zeros((len(cells), len(entries)), kind)
        greatest = np.zeros_like(least)
        for j in range(cells.shape[1]):
            under, over = low[:, j, None] - entries[None, :, j], entries[None, :, j] - high[:, j, None]
            near = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(-under, -over)  # the distance to the farther side, as high - low >= 0
            least += near * near
            greatest += far * far
        kept = least <= greatest.min(axis=1)[:, None]
        self.bounded += len(cells)
        return [np.flatnonzero(row).astype(np.uint16) for row in kept]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of `parts`; of equally near entries the first."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = parts.shape[1]
        reach = max(self.largest, int(np.abs(parts).max(initial=0))) + (1 << self.shift)
        kind = np.int32 if 4 * reach * reach * max(1, width) < 1 << 31 else np.int64
        cells, of = np.unique(parts >> self.shift, axis=0, return_inverse=True)
        of = of.reshape(-1)
        keys = [row.tobytes() for row in cells]
        found = [self.cells.get(k) for k in keys]
        missing = [k for k, x in enumerate(found) if x is None]
        for at in range(0, len(missing), BLOCK):
            block = missing[at: at + BLOCK]
            for k, x in zip(block, self._bound(cells[block], kind)):
                if len(self.cells) >= self.most:
                    self.cells.clear()
                found[k] = self.cells[keys[k]] = x
        sizes = np.array([len(x) for x in found])
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate(found)
        best, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for at in range(0, len(parts), 4096):  # so many rows are compared at a time
            own = of[at: at + 4096]
            n = sizes[own]
            first = np.cumsum(n) - n
            entry = flat[np.arange(int(n.sum())) + np.repeat(starts[own] - first, n)].astype(np.int64)
            gap = np.repeat(parts[at: at + 4096].astype(kind), n, axis=0) - self.entries.astype(kind)[entry]
            d = np.einsum("ij,ij->i", gap, gap).astype(np.int64)
            least = np.minimum.reduceat(d, first)
            tied = np.where(d == np.repeat(least, n), entry, len(self.entries))
            best[at: at + 4096], distance[at: at + 4096] = np.minimum.reduceat(tied, first), least
        return best, distance


def integer_vectors(df: DataFrame, vector: str, out: str, scale: int = SCALE) -> DataFrame:
    """`df` with `out`: floor(scale * x) of each component; rows without a vector, or with a null or non-finite component, are left out."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    held = F.transform(x, lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v * scale))).cast("int"))
    return df.where(F.coalesce(usable, F.lit(False))).withColumn(out, held)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows, parts, components; zeros are appended to make parts of one size, which adds no distance."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(flat) // n if n else 0
    cut = -(-width // parts) if width else 0
    out = np.zeros((n, parts * cut), np.int64)
    out[:, :width] = flat.reshape(n, width)
    return out.reshape(n, parts, cut)


class VectorCodes:
    """Codebooks (part, entry, component) of one size of vectors."""

    def __init__(self, codebooks: np.ndarray, size: int):
        self.codebooks, self.size = codebooks, size

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.reshape(-1).tolist())).encode()).hexdigest()


def _sums(vectors: DataFrame, codebooks: np.ndarray, shift: int) -> DataFrame:
    """(part, entry, n, sums): totals of the vectors' parts by nearest entry, one partial row a task before the shuffle."""
    parts, entries, width = codebooks.shape

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book, shift) for book in codebooks]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for frame in frames:
            cut = _matrix(frame.column(0), parts)
            for p in range(parts):
                best, _ = grids[p].nearest(cut[:, p])
                n[p] += np.bincount(best, minlength=entries)
                np.add.at(sums[p], best, cut[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                                         names=["part", "entry", "n", "sums"])

    found = vectors.mapInArrow(batch, "part int, entry int, n long, sums array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))


def fit(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, shift: int = SHIFT) -> VectorCodes:
    """Codebooks that start as the parts of the `entries` rows with the smallest ids, after `rounds` rounds over all rows.

    Each round is one job; parts * entries rows of sums come back to the driver. A null id comes after all others, and rows of one id are taken in
    the order of their vectors. The size of the first row's vector is that of all: rows of another size are left out. Fewer rows than `entries` make
    fewer entries, an empty table makes none.
    """
    held = integer_vectors(df, vector, "__v").select(F.col(f"`{vec_id}`").alias("id"), F.col("__v").alias("v"))
    first = [r.v for r in held.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return VectorCodes(np.zeros((parts, 0, 0), np.int64), 0)
    size = len(first[0])
    first = [v for v in first if len(v) == size]
    books = _matrix(pa.array(first, pa.list_(pa.int32())), parts).transpose(1, 0, 2).copy()
    vectors = held.where(F.size("v") == size).select("v")
    for _ in range(rounds):
        for r in _sums(vectors, books, shift).collect():
            books[r.part, r.entry] = np.array(r.sums, np.int64) // r.n  # floors, below zero too
    return VectorCodes(books, size)


def encode(df: DataFrame, model: VectorCodes, vector: str = "embedding", shift: int = SHIFT) -> DataFrame:
    """`df` with `code` (two hex digits a part) and `error` (squared distances to the entries, summed; both replaced if there).

    Rows without a vector, with a null or non-finite component, or of another size are left out. Components beyond 2^26 are held there.
    Repeated rows come back repeated; of equally near entries the first is taken. The codebooks (a few hundred kB) go with the tasks.
    """
    made, books, parts = private_name("v"), model.codebooks, len(model.codebooks)
    rows = integer_vectors(df.drop("code", "error"), vector, made).where(F.size(made) == model.size)
    names = [c for c in rows.columns if c != made]
    schema = rows.drop(made).schema.add("code", "string").add("error", "long")

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book, shift) for book in books]
        for frame in frames:
            cut = _matrix(frame.column(made), parts)
            codes, error = np.zeros((len(cut), parts), np.uint8), np.zeros(len(cut), np.int64)
            for p in range(parts if books.shape[1] else 0):
                best, distance = grids[p].nearest(cut[:, p])
                codes[:, p], error = best, error + distance
            yield pa.RecordBatch.from_arrays([*[frame.column(c) for c in names], pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    return rows.mapInArrow(batch, schema)


def with_group_total(df: DataFrame, key: str, value: str, out: str, hot: float = HOT) -> DataFrame:
    """`df` with `out`: the sum of `value` over equal `key`s, nulls together.

    Keys that hold more than `hot` of all rows, fewer than 1 / hot by that, are joined by a broadcast, the others by a shuffle: no key's rows
    meet in one task.
    """
    totals = written(df.groupBy(F.col(key).alias("__k")).agg(F.sum(value).alias(out), F.count("*").alias("__n")))
    least = (totals.agg(F.sum("__n")).first()[0] or 0) * hot
    large, small = totals.where(F.col("__n") > least).drop("__n"), totals.where(F.col("__n") <= least).drop("__n")
    found = df.drop(out).join(F.broadcast(large.withColumnRenamed(out, "__large")), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    rest = found.where("__large is null").join(small, F.col(key).eqNullSafe(F.col("__k"))).drop("__k", "__large")
    return found.where("__large is not null").withColumnRenamed("__large", out).select(*rest.columns).unionByName(rest)


def label_errors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """One row a usable row of `df`: vec_id, label, code, error, label_error (of all rows of its label) and codebooks_sha256."""
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    model = fit(rows, "v")
    coded = written(encode(rows, model, "v").drop("v"))
    return with_group_total(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(model.digest()))
