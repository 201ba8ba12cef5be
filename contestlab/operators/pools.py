"""Losses of many pooled probabilities at once, in Arrow batches of contests."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers that are held at once: entrants of some contests times cells.
BLOCK = 1 << 18


def cell_losses(cells: list[tuple[float, float]]):
    """A function for mapInArrow over contests, each a list of structs (lp, lm, hit): for each cell (a, b) the sum of a task's losses, and the contests with a winner.

    A contest's loss is that of its winners under exp(a * lp + b * lm), as shares of the contest's sum.
    """
    a, b = np.array(cells, np.float64).reshape(-1, 2).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, seen = np.zeros(len(a)), 0, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen, lists = True, batch.column(0)
            rows, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            starts = ends[:-1] - ends[0]
            ends = ends[1:] - ends[0]
            lp, lm = (rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            won = rows.field(2).fill_null(False).to_numpy(zero_copy_only=False)
            known = np.logical_or.reduceat(won, starts)
            own_lp, own_lm = (np.add.reduceat(np.where(won, x, 0.0), starts) for x in (lp, lm))
            step, at = max(1, BLOCK // max(1, len(a))), 0
            while at < len(starts):
                # whole contests of about `step` entrants
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, side="right")))
                some = slice(starts[at], ends[to - 1])
                total = np.add.reduceat(np.exp(np.outer(lp[some], a) + np.outer(lm[some], b)), starts[at:to] - starts[at], axis=0)
                loss = np.log(total) - np.outer(own_lp[at:to], a) - np.outer(own_lm[at:to], b)
                sums += loss[known[at:to]].sum(axis=0)
                at = to
            n += int(known.sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sums), pa.array([n] * len(a), pa.int64())], ["a", "b", "loss", "n"])

    return run
