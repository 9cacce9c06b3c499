"""Runs of repeated words by recompression.

The words of many texts are numbered and put one after the other with separators that occur once. Rounds of block
compression (a letter repeated k times becomes one symbol) and pair compression (letters are dealt to a left and a right
side, and each left one followed by a right one becomes one symbol) turn them into a run-length grammar: equal stretches
are cut alike, so that they have equal symbols but near their ends. The longest common extension of two places climbs
the grammar while both stand before equal symbols, and comes down where they differ.

A run of period q and at least t*q words holds (t-1)*q places in a row whose word is repeated q words on, and so one on
the grid of multiples of (t-1)*q. Those grid places whose word is repeated are extended both ways. Over all q a text of n
words has about n*ln(n)/(t-1) grid places; they are formed in pieces of bounded size.

Defined cases: a null, empty or blank text has no words, no runs and the digests of empty strings; ties of the longest run
go to the smaller start, then period; texts of any length are taken whole (one text is one row, which bounds what a task
holds); repeated rows are repeated in the result; an empty table gives an empty result. Other columns are kept, but for
those named like a result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import mix, plus, slices

_CANDIDATES = 1 << 20


class Grammar:
    """A run-length grammar of symbols, whose levels lie one after the other in flat arrays.

    An index stands for a symbol of a level and for the place before it. symbol and size say what begins there and how many
    words it holds; right and left count the equal symbols from there on and up to there; up and down are the same place
    one level higher (-1: inside a symbol) and lower (-1: none).
    """

    def __init__(self, words: np.ndarray, lone: np.ndarray):
        """lone marks separators: symbols that occur once and stay as they are. The first and the last symbol are such."""
        levels: list[list[np.ndarray]] = []
        sym, size, fresh = words.astype(np.int64), np.ones(len(words), np.int64), int(words.max(initial=0)) + 1
        left_over = 0
        for turn in range(4 * max(1, len(words)).bit_length()):
            n = len(sym)
            first = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]])
            many = np.diff(np.r_[first, n])
            at = np.arange(n)
            block = np.repeat(np.arange(len(first)), many)
            right, left = (first + many)[block] - at, at - first[block] + 1
            if len(first) < n:
                up = np.full(n, -1, np.int64)
                up[first] = np.arange(len(first))
                levels.append([sym, size, right, left, up])
                new = sym[first].copy()
                again = np.flatnonzero(many > 1)
                code, seen = pd.factorize((new[again] << 32) | many[again])
                new[again] = fresh + code
                fresh += len(seen)
                sym, size, lone = new, size[first] * many, lone[first]
                n = len(sym)
                right = left = np.ones(n, np.int64)
            side = (mix((sym + (turn << 40)).view(np.uint64)) & np.uint64(1)).astype(bool)
            free = ~lone[:-1] & ~lone[1:]
            one, two = ~side[:-1] & side[1:] & free, side[:-1] & ~side[1:] & free
            pair = np.flatnonzero(one if one.sum() >= two.sum() else two)
            left_over = 0 if len(pair) else left_over + 1
            if left_over > 3 or not free.any():
                break
            if not len(pair):
                continue
            keep = np.ones(n, bool)
            keep[pair + 1] = False
            up = np.where(keep, np.cumsum(keep) - 1, -1)
            levels.append([sym, size, right, left, up])
            code, seen = pd.factorize((sym[pair] << 32) | sym[pair + 1])
            sym, size = sym.copy(), size.copy()
            sym[pair] = fresh + code
            size[pair] += size[pair + 1]
            fresh += len(seen)
            sym, size, lone = sym[keep], size[keep], lone[keep]
        n = len(sym)
        levels.append([sym, size, np.ones(n, np.int64), np.ones(n, np.int64), np.full(n, -1, np.int64)])
        begin = np.cumsum([0, *(len(v[0]) for v in levels)])
        down = np.full(begin[-1], -1, np.int64)
        for i, v in enumerate(levels[:-1]):
            inner = np.flatnonzero(v[4] >= 0)
            v[4] = np.where(v[4] >= 0, v[4] + begin[i + 1], -1)
            down[v[4][inner]] = inner + begin[i]
        self.symbol, self.size, self.right, self.left, self.up = (np.concatenate([v[j] for v in levels]) for j in range(5))
        self.down = down

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many words from the places a and b on (with back: up to them) are alike. a and b are different places."""
        out, who = np.zeros(len(a), np.int64), np.arange(len(a))
        step, run = (1, self.left) if back else (0, self.right)
        while len(who):
            x, y = self.up[a], self.up[b]
            rise = (x >= 0) & (y >= 0) & (self.symbol[x - step] == self.symbol[y - step])
            alike = ~rise & (self.symbol[a - step] == self.symbol[b - step])
            fall = ~rise & ~alike
            m = np.where(alike, np.minimum(run[a - step], run[b - step]), 0)
            out[who] += m * self.size[a - step]
            m = -m if back else m
            a = np.where(rise, x, np.where(fall, self.down[a], a + m))
            b = np.where(rise, y, np.where(fall, self.down[b], b + m))
            left = a >= 0
            a, b, who = a[left], b[left], who[left]
        return out


def _pieces(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of count that add up to about most."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto


def find_runs(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (text, start, end, period) of the maximal runs of texts that lie in symbols at begin, with a symbol before, between and after them that occurs once.

    In order of text, start and end. A run has at least `least` words and `times` periods; times is 2 or more.
    """
    lone = np.ones(len(symbols), bool)
    lone[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())] = False
    most = np.where(size >= least, size // times, 0)
    doc = np.repeat(np.arange(len(size)), most)
    if not len(doc):
        return np.zeros((0, 4), np.int64)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (size[doc] - period - 1) // ((times - 1) * period) + 1
    hits = []
    for lo, hi in _pieces(points, _CANDIDATES):
        k = points[lo:hi]
        who = np.repeat(np.arange(lo, hi), k)
        q = period[who]
        place = begin[doc[who]] + (np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k)) * (times - 1) * q
        same = symbols[place] == symbols[place + q]
        hits.append(np.stack([doc[who][same], place[same], q[same]], 1))
    d, a, q = np.concatenate(hits).T
    if not len(d):
        return np.zeros((0, 4), np.int64)
    g, found = Grammar(symbols, lone), []
    for i in range(0, len(d), _CANDIDATES):
        x, p = a[i : i + _CANDIDATES], q[i : i + _CANDIDATES]
        lo, hi = x - g.extension(x, x + p, True), x + p + g.extension(x, x + p, False)
        keep = hi - lo >= np.maximum(least, times * p)
        found.append(np.stack([d[i : i + _CANDIDATES][keep], lo[keep], hi[keep], p[keep]], 1))
    r = np.concatenate(found)
    r = r[np.lexsort(r.T[::-1])]
    # a stretch that repeats with a multiple of its period is found with both: the smallest is its period
    r = r[np.r_[True, (r[1:, :3] != r[:-1, :3]).any(1)]] if len(r) else r
    r[:, 1:3] -= begin[r[:, 0]][:, None]
    return r


def repeated_words(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4, spans: bool = False) -> DataFrame:
    """docs' other columns with the number of runs, the longest run, and digests of all runs and of the text without repeats.

    With spans also all runs, and the text in which of each run only the first period is left.
    """
    made = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}
    made |= {"runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"} if spans else {}
    keep = [c for c in docs.columns if c != text and c not in made]
    schema = plus(docs.select(*keep), made)

    def rows(s: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(x or "").encode().split() for x in s.column(text).to_pylist()]
        size = np.array([len(w) for w in texts], np.int64)
        begin = np.cumsum(size + 1) - size  # a separator before each text
        ids: dict[bytes, int] = {}
        symbols = np.zeros(int(size.sum()) + len(texts) + 1, np.int64)
        numbers = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, int(size.sum()))
        inner = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        symbols[np.r_[begin - 1, len(symbols) - 1]] = len(ids) + np.arange(len(texts) + 1)
        symbols[inner] = numbers
        r = find_runs(symbols, begin, size, least, times)
        gone = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(gone, begin[r[:, 0]] + r[:, 1] + r[:, 3], 1)
        np.add.at(gone, begin[r[:, 0]] + r[:, 2], -1)
        there = np.cumsum(gone) == 0
        upto = np.searchsorted(r[:, 0], np.arange(len(texts) + 1))
        out: list[tuple] = []
        for i, w in enumerate(texts):
            mine = [(a, b - a, p) for _, a, b, p in r[upto[i] : upto[i + 1]].tolist()]
            mine.sort(key=lambda x: (x[0], x[2]))
            best = min(mine, key=lambda x: (-x[1], x[0], x[2]), default=None)
            left = b" ".join(compress(w, there[begin[i] : begin[i] + size[i]].tolist()) if mine else w)
            sha = hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in mine).encode()).hexdigest()
            row = (len(mine), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha, hashlib.sha256(left).hexdigest())
            out.append((*row, [dict(zip(("start", "length", "period"), x, strict=True)) for x in mine], left.decode()) if spans else row)
        kinds = [schema[c].dataType for c in made]
        from pyspark.sql.pandas.types import to_arrow_type

        columns = list(zip(*out, strict=True)) if out else [()] * len(made)
        return pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), *(pa.array(v, to_arrow_type(t)) for v, t in zip(columns, kinds, strict=True))], [*keep, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, text):
                yield rows(s)

    return docs.select(*keep, text).mapInArrow(run, schema)
