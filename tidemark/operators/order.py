"""Figures of sliding windows that need their values in order: shares that are not larger than a row's own, medians, maxima.

Rows of an entity are numbered and dealt to blocks; a block also gets the rows just before it, as many as a window holds,
so that blocks are counted by themselves, whatever the entity's length. Where few rows of a block are asked for, their
windows are laid out side by side; shares of many rows are counted with a wavelet matrix of the values' ranks: one bit of
rank after the other, each with the numbers of zeros up to every place. It takes as many array steps as ranks have bits,
and memory for the block's rows, however long the windows are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096
CELLS = 2**20  # of windows laid out at once


class Figure(NamedTuple):
    """What is told of a column's known values in the window (first, last) relative to a row, if there are at least `least`: their `share` that is at most the row's own, their `median` or their `max`."""

    stat: str
    column: str
    window: tuple[int, int]
    least: int = 1


def laid_out(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """values[lo[i]:hi[i]] as rows of matrices, filled up with nan, and which i they are."""
    width = int(max(1, (hi - lo).max(initial=0)))
    step = max(1, CELLS // width)
    for s in range(0, len(lo), step):
        i = lo[s : s + step, None] + np.arange(width)
        yield slice(s, s + step), np.where(i < hi[s : s + step, None], values[np.minimum(i, len(values) - 1)], np.nan)


def median(window: np.ndarray, total: np.ndarray) -> np.ndarray:
    ordered, row = np.sort(window, axis=1), np.arange(len(window))  # nan comes last
    return (ordered[row, np.maximum(total - 1, 0) // 2] + ordered[row, np.minimum(total // 2, window.shape[1] - 1)]) / 2


def figure(stat: str, values: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The figure of values[lo[i]:hi[i]] for each row at[i], and how many of these values are known."""
    if stat == "share" and len(at) * (hi - lo).max(initial=0) > 16 * len(values):
        total, n = not_larger(values, lo, hi, at)
        return n / np.maximum(1, total), total
    out, total = np.full(len(at), np.nan), np.zeros(len(at), np.int64)
    for rows, window in laid_out(values, lo, hi):
        total[rows] = n = (~np.isnan(window)).sum(axis=1)
        if stat == "share":
            out[rows] = (window <= values[at[rows], None]).sum(axis=1) / np.maximum(1, n)
        else:
            out[rows] = median(window, n) if stat == "median" else np.fmax.reduce(window, axis=1)
    return out, total


def not_larger(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each i how many values[lo[i]:hi[i]] are known, and how many of them are at most values[i] (values[at[i]], if given); nan is unknown."""
    known = ~np.isnan(values)
    upto = np.r_[0, np.cumsum(known)]
    left, right = upto[lo], upto[hi]
    total = right - left
    distinct, rank = np.unique(values[known], return_inverse=True)
    below = np.zeros(len(values), np.int64)
    below[known] = rank + 1  # ranks under this are counted
    below = below if at is None else below[at]
    count = np.zeros(len(below), np.int64)
    for bit in range(len(distinct).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.r_[0, np.cumsum(~one)]
        zl, zr = zeros[left], zeros[right]
        up = (below >> bit) & 1 == 1
        count += np.where(up, zr - zl, 0)
        left, right = np.where(up, zeros[-1] + left - zl, zl), np.where(up, zeros[-1] + right - zr, zr)
        rank = np.r_[rank[~one], rank[one]]
    return total, count


def window_shares(rows: DataFrame, values: Mapping[str, str], window: tuple[int, int], least: int = 1, by: Sequence[str] = ("code",), at: str = "idx", count_rows: bool = True, block: int = BLOCK) -> DataFrame:
    """rows with, for each name in values, the share of its column's known values in the window that are at most the row's own; see window_figures."""
    return window_figures(rows, {n: Figure("share", c, window, least) for n, c in values.items()}, by, at, count_rows, block)


def window_figures(rows: DataFrame, figures: Mapping[str, Figure], by: Sequence[str] = ("code",), at: str = "idx", count_rows: bool = True, block: int = BLOCK, only: str | None = None) -> DataFrame:
    """rows with a column for each figure. With `only`, a boolean column, all rows stand in windows, but only those that it marks are told of and kept.

    A window is (first, last) relative to a row, both at most 0: in rows of the entity ordered by `at`, or, without
    count_rows, in `at` itself, a whole number. A figure is unknown where the window knows fewer than `least`, a share
    also where the row's own value is. nan counts as unknown. Several rows of one place are in each other's window if 0 is in it.
    """
    first = min(f.window[0] for f in figures.values())
    if not all(f.window[0] <= f.window[1] <= 0 for f in figures.values()) or -first > block:
        raise ValueError("a window ends at a row or before it, and is no longer than a block")
    keep = rows.columns
    place: Column = F.row_number().over(Window.partitionBy(*by).orderBy(at)).cast("long") if count_rows else F.col(at).cast("long")
    home = F.floor(F.col("_place") / block)
    near_end = F.col("_place") >= (F.col("_home") + 1) * block + first
    dealt = rows.withColumn("_place", place).withColumn("_home", home).withColumn("_block", F.explode(F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))))
    dealt = dealt.where(F.col("_place").isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_block").orderBy("_place")))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in figures)])

    def count(t: pa.Table) -> pa.Table:
        # blocks lie one after the other, each with its places from -block on, too far apart to meet in a window
        nth = t["_nth"].to_numpy()
        p = t["_place"].to_numpy() - t["_block"].to_numpy() * block + np.cumsum(nth == 1) * 4 * block
        own = t["_home"].to_numpy() == t["_block"].to_numpy()
        if only:
            own &= t[only].fill_null(False).to_numpy()
        asked = np.flatnonzero(own)
        out = []
        for f in figures.values():
            x = t[f.column].cast(pa.float64()).to_numpy()
            lo, hi = np.searchsorted(p, p[asked] + f.window[0], "left"), np.searchsorted(p, p[asked] + f.window[1], "right")
            found, total = figure(f.stat, x, lo, hi, asked)
            unknown = total < max(1, f.least)
            out.append(pa.array(found, pa.float64(), mask=unknown | np.isnan(x[asked]) if f.stat == "share" else unknown))
        t = t.take(pa.array(asked))
        return pa.table([*(t[c] for c in keep), *out], [*keep, *figures])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks, many small ones at once: what a batch begins and doesn't end waits for the next."""
        held: list[pa.RecordBatch] = []
        for b in found:
            starts = np.flatnonzero(b["_nth"].to_numpy() == 1)
            if held and len(starts):
                cut = int(starts[-1])
                yield from count(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()).to_batches()
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from count(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return dealt.mapInArrow(batches, schema)
