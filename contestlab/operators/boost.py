"""Gradient-boosted trees over contests (E20 to E22): binned features, one grouped histogram job a tree level, splits chosen from bins.

The binned table has one row a contest, so that a contest's entrants meet without a shuffle in every later job. A job over it sums
gradients and Hessians by (fit, node, feature, bin) inside the tasks, and Spark adds up the partial sums; what comes to the driver is bounded by
fits x nodes x features x bins, whatever the number of contests. Gradients are rounded to multiples of 2^-24 and summed as
integers, so that a fit is the same in whatever order and partitions its rows come. Any number of fits, each with its own label, features, role
of rows and objective, grow side by side in the same jobs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from contestlab.storage import dropped, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Roles of a contest in a fit; others are not used.
TRAIN, VALID, TEST = 1, 2, 3
#: Gradients are whole multiples of 1 / GRAIN.
GRAIN = 1 << 24
#: Margins are stored after so many trees; newer trees are applied where the table is read.
STORE_EVERY = 10
LEAST_P = 1e-9


@dataclass(frozen=True)
class Fit:
    """One model to grow. `objective`: `binary` (log-loss of each entrant) or `softmax` (of a contest's winner). `role` names a column of roles."""

    name: str
    label: str = "win"
    features: tuple[str, ...] | None = None
    objective: str = "binary"
    role: str = "role"
    trees: int = 50
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    least: int = 20
    patience: int = 10


@dataclass
class Binned:
    """A table of contests (part, roles, slots, labels by name, flat bins of entrants x features) and how features were binned. Bin 0 is missing."""

    df: DataFrame
    features: list[str]
    labels: list[str]
    roles: list[str]
    cuts: dict[str, list[float]]
    categorical: tuple[str, ...]

    @property
    def bins(self) -> int:
        return 1 + max([len(c) + (f not in self.categorical) for f, c in self.cuts.items()], default=1)


@dataclass
class Model:
    """Trees over binned features; `history` has the mean losses by role after 0, 1, ... trees."""

    fit: Fit
    features: list[str]
    cuts: dict[str, list[float]]
    categorical: tuple[str, ...]
    base: float = 0.0
    trees: list[dict] = field(default_factory=list)
    history: list[dict[int, float]] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def importance(self) -> list[tuple[str, float]]:
        """(feature, share of all gain), greatest first."""
        total = sum(self.gains.values()) or 1.0
        return sorted(((f, g / total) for f, g in self.gains.items()), key=lambda x: (-x[1], x[0]))

    def best_trees(self) -> int:
        """The number of trees with the least validation loss (of equals the fewest); all without validation rows."""
        losses = [h.get(VALID) for h in self.history]
        if not losses or losses[0] is None:
            return len(self.trees)
        return min(range(len(losses)), key=lambda k: (round(losses[k], 9), k))


def cut_points(df: DataFrame, features: list[str], bins: int = 32, categorical: tuple[str, ...] = ()) -> dict[str, list[float]]:
    """Up to bins - 1 quantiles of each numeric feature in one job, and the values of categorical ones in another (an error if there are over 250)."""
    numeric, cuts = [f for f in features if f not in categorical], {}
    if numeric:
        at = [k / bins for k in range(1, bins)]
        row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), at, 10_000).alias(f) for f in numeric]).first()
        cuts = {f: sorted(set(row[f] or [])) for f in numeric}
    for f in categorical:
        found = [r[0] for r in df.select(F.col(f).cast("double").alias("v")).where("v is not null").distinct().limit(251).collect()]
        if len(found) > 250:
            raise ValueError(f"{f} has over 250 values: too many for a categorical feature")
        cuts[f] = sorted(found)
    return cuts


def to_bins(values: np.ndarray, cuts: list[float], categorical: bool) -> np.ndarray:
    """Bins of one feature: 1 + the number of cuts below the value; of a categorical one 1 + its place, 0 if it is new. Missing: 0."""
    points = np.asarray(cuts, float)
    if categorical:
        at = np.searchsorted(points, values)
        same = (at < len(points)) & (points[np.minimum(at, max(0, len(points) - 1))] == values) if len(points) else np.zeros(len(values), bool)
        return np.where(same, at + 1, 0).astype(np.uint8)
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(points, values)).astype(np.uint8)


def bin_contests(df: DataFrame, part: str, slot: str, features: list[str], labels: list[str], roles: list[str], bins: int = 32,
                 categorical: tuple[str, ...] = (), cuts: dict[str, list[float]] | None = None, train: Column | None = None) -> Binned:
    """One row a contest, written once. A contest's entrants are few by meaning, and meet in one row.

    Cuts come from the rows where `train` holds (all without it). Null and NaN features are missing; null labels are false; a contest has the
    roles of its first slot.
    """
    cuts = cuts or cut_points(df.where(train) if train is not None else df, features, bins, categorical)
    one = F.struct(F.col(slot).alias("slot"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y_{c}") for c in labels],
                   *[F.coalesce(F.col(r).cast("int"), F.lit(0)).alias(f"r_{r}") for r in roles])
    whole = df.groupBy(F.col(part).alias("part")).agg(F.sort_array(F.collect_list(one)).alias("e")).select(
        "part", F.col("e.slot").alias("slots"), F.flatten("e.x").alias("x"), *[F.col(f"e.y_{c}").alias(f"y_{c}") for c in labels], *[F.get(f"e.r_{r}", F.lit(0)).alias(f"r_{r}") for r in roles])
    n, schema = len(features), whole.drop("x").schema.add("bins", "binary")

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            x = frame.column("x")
            values = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            made = np.stack([to_bins(values[:, k], cuts[f], f in categorical) for k, f in enumerate(features)], axis=1) if n else np.zeros((len(values), 0), np.uint8)
            ends = np.append(0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(made.tobytes())])
            names = [c for c in schema.names if c != "bins"]
            yield pa.RecordBatch.from_arrays([*[frame.column(c) for c in names], blobs], names=[*names, "bins"])

    return Binned(written(whole.mapInArrow(batch, schema)), features, labels, roles, cuts, categorical)


def walk(tree: dict, columns: list[bytes], levels: int | None = None) -> np.ndarray:
    """The node of each row after `levels` steps (all by default); children of node k are 2k + 1 and 2k + 2. `columns`: the rows' bins, feature by feature."""
    levels = tree["depth"] if levels is None else levels
    kind = np.uint8 if levels < 8 else np.int64
    node = np.zeros(len(columns[0]) if columns else 0, kind)
    for level in range(levels):
        came = node
        for k in range((1 << level) - 1, min((2 << level) - 1, len(tree["feature"]))):
            f = tree["feature"][k]
            if f >= 0:
                went = np.frombuffer(columns[f].translate(_sides(tree["left"][k])), np.uint8).astype(kind, copy=False)
                node = np.where(came == k, 2 * k + 1 + went, node).astype(kind, copy=False) if level else (1 + went).astype(kind, copy=False)
    return node


def _sides(left: np.ndarray) -> bytes:
    """0 for each bin that goes left, 1 for others, as a table of 256."""
    return np.append(~left, np.ones(256 - len(left), bool)).astype(np.uint8).tobytes()


def add_trees(margin: np.ndarray, trees: list[dict], columns: list[bytes]) -> np.ndarray:
    for tree in trees:
        margin = margin + (tree["value"][walk(tree, columns)] if columns else tree["value"][0])
    return margin


def gradients(objective: str, margin: np.ndarray, y: np.ndarray, starts: np.ndarray, measured: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(gradient, Hessian, loss if `measured`) of each row; `starts` are the first rows of contests. The loss of a contest without a winner is 0, as are its gradients."""
    if objective == "binary":
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6), -np.log(np.maximum(np.where(y > 0, p, 1 - p), LEAST_P)) if measured else None
    n = np.diff(np.append(starts, len(margin)))
    spread = lambda v: np.repeat(v, n)
    e = np.exp(margin - spread(np.maximum.reduceat(margin, starts)))
    p = e / spread(np.add.reduceat(e, starts))
    won = spread(np.add.reduceat(y, starts)) > 0
    share = np.where(won, y / np.maximum(spread(np.add.reduceat(y, starts)), 1), 0.0)
    return np.where(won, p - share, 0.0), np.where(won, np.maximum(p * (1 - p), 1e-6), 0.0), share * -np.log(np.maximum(p, LEAST_P)) if measured else None


def _arrays(frame: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins by row, first row of each contest, contest of each row)."""
    n = frame.column("slots").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    blobs = frame.column("bins").cast(pa.large_binary())
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset: blobs.offset + len(blobs) + 1] if len(blobs) else np.zeros(2, np.int64)
    bins = np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0]: ends[-1]].reshape(-1, n_features) if ends[-1] > ends[0] else np.zeros((int(n.sum()), n_features), np.uint8)
    return bins, np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)


def _columns(bins: np.ndarray) -> list[bytes]:
    """Each feature's bins of all rows."""
    return [c.tobytes() for c in bins.T]


def _sums(node: np.ndarray, places: list[tuple[list[int], np.ndarray]], steps: np.ndarray, width: int, features: int, bins: int) -> np.ndarray:
    """Sums of gradients, Hessians and rows by (node, feature, bin); rows at node `width` are left out. Two features share a count by both their bins."""
    out = np.zeros((3, width, features, bins), np.int64)
    for own, place in places:
        cells = bins ** len(own)
        at = place + node * cells if width > 1 or node.any() else place
        for s in range(3):
            found = np.bincount(at, steps[s] if s < 2 else None, (width + 1) * cells)[: width * cells].reshape(width, *[bins] * len(own))
            for k, f in enumerate(own):
                # whole numbers below 2^53, so that any order of adding gives the same
                out[s, :, f] = found if len(own) == 1 else found.sum(axis=2 - k)
    return out


def _margins(frame: pa.RecordBatch, k: int, rows: int, base: float) -> np.ndarray:
    """The stored margin of fit k; before the first store, the base."""
    name = f"m_{k}"
    return frame.column(name).flatten().to_numpy(zero_copy_only=False).astype(float) if name in frame.schema.names else np.full(rows, base)


def _places(bins: np.ndarray, n_bins: int, width: int) -> list[tuple[list[int], np.ndarray]]:
    """Features in twos (alone where a count by both would be large) and each row's cell in them."""
    columns = [c.astype(np.int64) for c in bins.T]
    step = 2 if (width + 1) * n_bins ** 2 <= 1 << 15 else 1
    return [(list(range(f, min(f + step, len(columns)))), columns[f] * n_bins + columns[f + 1] if step == 2 and f + 1 < len(columns) else columns[f]) for f in range(0, len(columns), step)]


def _histograms(table: DataFrame, binned: Binned, models: list[Model], fresh: list[int], growing: list[dict | None], level: int) -> dict:
    """{fit: (G, H, N) by (node, feature, bin)} of the nodes at `level`, and {(fit, role): (loss, n)}; one job. `fresh`: trees already in the margins."""
    features, bins, width = len(binned.features), binned.bins, 1 << level
    plans = [(k, m.fit, m.base, m.trees[fresh[k]:], growing[k]) for k, m in enumerate(models) if growing[k] is not None]

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((3, width, features, bins), np.int64) for k, *_ in plans}
        losses: dict[tuple[int, int], list] = {}
        for frame in frames:
            every, starts, contest = _arrays(frame, features)
            n = np.bincount(contest, minlength=len(frame))
            for name in dict.fromkeys(fit.role for _, fit, *_ in plans):
                role = frame.column(f"r_{name}").to_numpy(zero_copy_only=False)
                taught = role[contest] == TRAIN
                # the losses of all roles are summed with the first level, later ones need the training rows only
                kept = np.ones(len(every), bool) if level == 0 else taught
                own, at = _columns(every[kept]), n if level == 0 else n[role == TRAIN]
                first, places = np.cumsum(at) - at, _places(every[taught], bins, width)
                for k, fit, base, trees, tree in plans:
                    if fit.role != name or not len(first):
                        continue
                    y = frame.column(f"y_{fit.label}").flatten().to_numpy(zero_copy_only=False).astype(float)[kept]
                    margin = add_trees(_margins(frame, k, len(every), base)[kept], trees, own)
                    g, h, loss = gradients(fit.objective, margin, y, first, level == 0)
                    if level == 0:
                        for r in (TRAIN, VALID, TEST):
                            used = role[contest] == r
                            held = losses.setdefault((k, r), [0, 0])
                            held[0] += int(np.rint(loss[used] * GRAIN).astype(np.int64).sum())
                            held[1] += int(used.sum()) if fit.objective == "binary" else int((role == r).sum())
                        g, h = g[taught], h[taught]
                    node = walk(tree, own, level).astype(np.int64) - (width - 1) if level else np.zeros(len(g), np.int64)
                    node = np.where(node >= 0, node, width) if level else node
                    sums[k] += _sums(node, places, np.rint(np.stack([g, h]) * GRAIN), width, features, bins)
        out = [np.zeros((7, 0), np.int64)]
        for k, s in sums.items():
            at = np.nonzero(s[2])
            out.append(np.stack([np.full(len(at[0]), k), *at, *s[(slice(None), *at)]]))
        out.append(np.array([(k, -r, 0, 0, loss, 0, n) for (k, r), (loss, n) in losses.items()], np.int64).reshape(-1, 7).T)
        columns = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["fit", "node", "feature", "bin", "g", "h", "n"])

    needed = dict.fromkeys(["slots", "bins", *[f"{c}_{v}" for _, fit, *_ in plans for c, v in (("y", fit.label), ("r", fit.role))], *[f"m_{k}" for k, *_ in plans if f"m_{k}" in table.columns]])
    found = table.select(*needed).mapInArrow(batch, "fit long, node long, feature long, bin long, g long, h long, n long").groupBy("fit", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    rows = found.toPandas()
    out = {k: np.zeros((3, width, features, bins)) for k, *_ in plans}
    losses = {(int(r.fit), -int(r.node)): (r.g / GRAIN, int(r.n)) for r in rows[rows["node"] < 0].itertuples()}
    rows = rows[rows["node"] >= 0]
    for k in out:
        own = rows[rows["fit"] == k]
        at = (own["node"].to_numpy(), own["feature"].to_numpy(), own["bin"].to_numpy())
        for s, c in enumerate("ghn"):
            out[k][s][at] = own[c].to_numpy() / (GRAIN if c != "n" else 1)
    return {"sums": out, "losses": losses}


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, allowed: list[int], categorical: set[int], l2: float, least: int) -> tuple | None:
    """(gain, feature, bins that go left) of one node's sums by (feature, bin), or None. Missing values go where that gains more.

    Of equal gains (to 9 digits) the first by feature, place of the missing, and cut.
    """
    best = None
    for f in allowed:
        total_g, total_h, total_n = g[f].sum(), h[f].sum(), n[f].sum()
        if not total_n:
            continue
        order = np.arange(1, g.shape[1])
        if f in categorical:
            order = order[np.argsort(g[f, 1:] / (h[f, 1:] + l2), kind="stable")]
            order = order[n[f, order] > 0]
        for missing in ((0, 1) if n[f, 0] else (0,)):
            gl, hl, nl = (np.cumsum(a[f, order]) + missing * a[f, 0] for a in (g, h, n))
            gr, hr, nr = total_g - gl, total_h - hl, total_n - nl
            gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - total_g ** 2 / (total_h + l2)
            gain = np.where((nl >= least) & (nr >= least), np.round(gain, 9), -1.0)
            if not len(gain):
                continue
            cut = int(gain.argmax())
            if gain[cut] > 0 and (best is None or gain[cut] > best[0]):
                left = np.zeros(g.shape[1], bool)
                left[order[: cut + 1]] = True
                left[0] = bool(missing)
                best = (float(gain[cut]), f, left)
    return best


def _bases(table: DataFrame, fits: list[Fit]) -> list[float]:
    """The margin that a binary fit starts from: the log-odds of its label over the training rows, with one row of each kind added. Softmax starts from 0."""
    own = [F.when(F.col(f"r_{f.role}") == TRAIN, F.struct(F.aggregate(f"y_{f.label}", F.lit(0).cast("long"), lambda a, y: a + y).alias("y"), F.size("slots").cast("long").alias("n"))) for f in fits]
    sums = table.agg(*[c for k, x in enumerate(own) for c in (F.sum(x["y"]).alias(f"y{k}"), F.sum(x["n"]).alias(f"n{k}"))]).first()
    odds = [((sums[f"y{k}"] or 0) + 1) / ((sums[f"n{k}"] or 0) - (sums[f"y{k}"] or 0) + 1) for k in range(len(fits))]
    return [float(np.log(o)) if f.objective == "binary" else 0.0 for f, o in zip(fits, odds)]


def _empty_tree(depth: int, bins: int) -> dict:
    return {"depth": depth, "feature": np.full((1 << depth) - 1, -1, np.int64), "left": np.zeros(((1 << depth) - 1, bins), bool), "value": np.zeros((1 << (depth + 1)) - 1)}


def boost(binned: Binned, fits: list[Fit]) -> dict[str, Model]:
    """Grow all `fits` side by side; each stops after its trees, or `patience` trees without a lower validation loss, and is cut back to its best.

    Without training rows a model has no trees and gives its base. Jobs: the depth of the deepest fit for each tree, whatever the number of fits.
    """
    index = {f: k for k, f in enumerate(binned.features)}
    bases = _bases(binned.df, fits)
    categorical = {index[f] for f in binned.categorical}
    models = [Model(fit, binned.features, binned.cuts, binned.categorical, base) for fit, base in zip(fits, bases)]
    allowed = [[index[f] for f in (fit.features if fit.features is not None else binned.features)] for fit in fits]
    live, table, fresh = set(range(len(fits))), binned.df, [0] * len(fits)
    for at in range(max((f.trees for f in fits), default=0) + 1):
        growing = [_empty_tree(m.fit.depth, binned.bins) if k in live else None for k, m in enumerate(models)]
        for level in range(max((m.fit.depth for k, m in enumerate(models) if k in live), default=0)):
            found = _histograms(table, binned, models, fresh, [t if t is None or level < t["depth"] else None for t in growing], level)
            for k in sorted(live) if level == 0 else ():
                models[k].history.append({role: loss / n for (own, role), (loss, n) in found["losses"].items() if own == k and n})
            for k in sorted(live) if level == 0 else ():
                best, m = models[k].best_trees(), models[k]
                if at >= m.fit.trees or (VALID in m.history[-1] and len(m.trees) - best >= m.fit.patience) or not found["sums"][k][2].any():
                    live.discard(k)
                    growing[k] = None
            for k, (g, h, n) in found["sums"].items():
                if growing[k] is None:
                    continue
                tree, fit, first = growing[k], models[k].fit, (1 << level) - 1
                for node in range(1 << level):
                    split = best_split(g[node], h[node], n[node], allowed[k], categorical, fit.l2, fit.least)
                    if level == 0 and node == 0:
                        tree["value"][0] = 0.0 if not n[0].any() else -fit.rate * g[0, 0].sum() / (h[0, 0].sum() + fit.l2)
                    if split is None:
                        continue
                    gain, f, left = split
                    tree["feature"][first + node], tree["left"][first + node] = f, left
                    models[k].gains[binned.features[f]] = models[k].gains.get(binned.features[f], 0.0) + gain
                    for child, side in ((1, left), (2, ~left)):
                        tree["value"][2 * (first + node) + child] = -fit.rate * g[node, f, side].sum() / (h[node, f, side].sum() + fit.l2)
        for k in live:
            models[k].trees.append(growing[k])
        if not live:
            break
        if (at + 1) % STORE_EVERY == 0:
            table, old = _stored(table, binned, models, fresh), table
            fresh = [len(m.trees) for m in models]
            if old is not binned.df:
                dropped(old)
    if table is not binned.df:
        dropped(table)
    for m in models:
        m.trees = m.trees[: m.best_trees()]
    return {m.fit.name: m for m in models}


def _stored(table: DataFrame, binned: Binned, models: list[Model], fresh: list[int]) -> DataFrame:
    """The table with each fit's margins after its trees so far, written."""
    plans = [(k, m.base, m.trees[fresh[k]:]) for k, m in enumerate(models)]
    kept, features = [c for c in table.columns if not c.startswith("m_")], len(binned.features)
    schema = table.select(*kept).schema
    for k, *_ in plans:
        schema = schema.add(f"m_{k}", ArrayType(DoubleType()))

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            own, starts, _ = _arrays(frame, features)
            columns = _columns(own)
            ends = pa.array(np.append(starts, len(own)).astype(np.int32))
            made = [pa.ListArray.from_arrays(ends, pa.array(add_trees(_margins(frame, k, len(own), base), trees, columns))) for k, base, trees in plans]
            yield pa.RecordBatch.from_arrays([*[frame.column(c) for c in kept], *made], names=schema.names)

    return written(table.mapInArrow(batch, schema))


def predict(df: DataFrame, model: Model, part: str, out: str = "q") -> DataFrame:
    """`df` with each entrant's probability: of its label for `binary` (not normalised), of winning its contest for `softmax`. The model goes with the tasks."""
    fit, cuts, categorical, trees, base = model.fit, model.cuts, model.categorical, model.trees, model.base

    def margin(*columns: pd.Series) -> pd.Series:
        bins = np.stack([to_bins(c.to_numpy(float, na_value=np.nan), cuts[f], f in categorical) for f, c in zip(model_features, columns)], axis=1)
        return pd.Series(add_trees(np.full(len(bins), base), trees, _columns(bins)))

    model_features = model.features
    scored = df.withColumn(out, F.pandas_udf(margin, "double")(*[F.col(f).cast("double") for f in model_features]))
    if fit.objective == "binary":
        return scored.withColumn(out, 1 / (1 + F.exp(-F.col(out))))
    w = Window.partitionBy(part)
    scored = scored.withColumn(out, F.exp(F.col(out) - F.max(out).over(w)))
    return scored.withColumn(out, F.col(out) / F.sum(out).over(w))


def ablation_fits(base: Fit, groups: dict[str, list[str]], features: list[str], folds: list[str], add: bool = False) -> list[Fit]:
    """For each fold (a column of roles) a fit of all features, named `fold/`, and for each group one without it (`add`: the other way round, a
    fit without any group and one with each)."""
    grouped = {f for fs in groups.values() for f in fs}
    out = []
    for fold in folds:
        out.append(replace(base, name=f"{fold}/", role=fold, features=tuple(f for f in features if not (add and f in grouped))))
        for name, own in groups.items():
            kept = [f for f in features if (f not in grouped or f in own if add else f not in own)]
            out.append(replace(base, name=f"{fold}/{name}", role=fold, features=tuple(kept)))
    return out


def contest_losses(binned: Binned, models: dict[str, Model], role: int = TEST) -> DataFrame:
    """(part, fit, loss): log-loss of the winner by each fit's normalised probabilities, for contests with that role in the fit; one pass for all fits.

    Contests without a winner are left out.
    """
    plans = [(m.fit, m.base, m.trees) for m in models.values()]
    features = len(binned.features)
    kind = binned.df.schema["part"].dataType.simpleString()

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            own, starts, contest = _arrays(frame, features)
            columns = _columns(own)
            for fit, base, trees in plans:
                y = frame.column(f"y_{fit.label}").flatten().to_numpy(zero_copy_only=False).astype(float)
                p = add_trees(np.full(len(own), base), trees, columns)
                p = np.exp(p) if fit.objective == "softmax" else 1 / (1 + np.exp(-p))
                p = p / np.repeat(np.add.reduceat(p, starts), np.diff(np.append(starts, len(own)))) if len(own) else p
                won = np.add.reduceat(y, starts) if len(own) else np.zeros(0)
                loss = np.add.reduceat(np.where(y > 0, -np.log(np.maximum(p, LEAST_P)), 0.0), starts) / np.maximum(won, 1) if len(own) else won
                used = np.flatnonzero((frame.column(f"r_{fit.role}").to_numpy(zero_copy_only=False) == role) & (won > 0))
                yield pa.RecordBatch.from_arrays([frame.column("part").take(pa.array(used)), pa.array([fit.name] * len(used), pa.string()), pa.array(loss[used])], names=["part", "fit", "loss"])

    return binned.df.mapInArrow(batch, f"part {kind}, fit string, loss double")


def ablate(binned: Binned, fits: list[Fit]) -> tuple[DataFrame, dict[str, Model]]:
    """(part, fold, group, diff) and the models: how much each contest's loss changes against the fold's base fit; all fits share the binned table.

    Positive: the base fit is better. Feed it to `study.paired_verdict` by group.
    """
    models = boost(binned, fits)
    losses = contest_losses(binned, models)
    named = losses.select("part", F.substring_index("fit", "/", 1).alias("fold"), F.substring_index("fit", "/", -1).alias("group"), "loss")
    base = named.where("group = ''").select("part", "fold", F.col("loss").alias("base"))
    return named.where("group <> ''").join(base, ["part", "fold"]).select("part", "fold", "group", (F.col("loss") - F.col("base")).alias("diff")), models


def history_role(age: Column, start: int, test: int, valid: int, days: int | None) -> Column:
    """The role of a row `age` days before the last one: TEST for the `test` days from `start` on, VALID for the `valid` days before these, TRAIN for the
    `days` before them (None: all), else 0."""
    taught = age >= start + test + valid
    if days is not None:
        taught = taught & (age < start + test + valid + days)
    return F.when((age >= start) & (age < start + test), TEST).when((age >= start + test) & (age < start + test + valid), VALID).when(taught, TRAIN).otherwise(0)


def refit(binned: Binned, base: Fit, folds: dict[str, tuple[str, str]], factor: float, least: int = 1) -> tuple[Binned, dict[str, Model]]:
    """For each fold (roles with validation, roles without) the tuned model, and one taught without validation with `factor` times the trees that the tuned one kept."""
    tuned = boost(binned, [replace(base, name=a, role=a) for a, _ in folds.values()])
    again = boost(binned, [replace(base, name=b, role=b, trees=max(least, round(len(tuned[a].trees) * factor))) for a, b in folds.values()])
    return binned, tuned | again


def compare_histories(binned: Binned, models: dict[str, Model], folds: dict[str, tuple[str, str]]) -> DataFrame:
    """(fold, fit, trees, contests, loss, change, z): each fit's mean loss on its fold's test, and how far it lies below that of the fold's base, contest by contest.

    folds: fit -> (fold, its base fit). Contests are told apart by one shuffle; positive change: better than the base.
    """
    names = {name: (fold, base, len(models[name].trees)) for name, (fold, base) in folds.items()}
    losses = contest_losses(binned, models)
    per = losses.groupBy("part").pivot("fit", list(names)).agg(F.first("loss"))
    rows = per.select(F.inline(F.array(*[F.struct(F.lit(fold).alias("fold"), F.lit(name).alias("fit"), F.lit(trees).alias("trees"), F.col(name).alias("loss"), (F.col(base) - F.col(name)).alias("d")) for name, (fold, base, trees) in names.items()]))).where("loss is not null")
    out = rows.groupBy("fold", "fit", "trees").agg(F.count("*").alias("contests"), F.avg("loss").alias("loss"), F.avg("d").alias("change"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("__se"))
    return out.withColumn("z", F.when(F.col("__se") > 0, F.col("change") / F.col("__se")).otherwise(0.0)).drop("__se")
