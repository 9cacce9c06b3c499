"""Language identification by cross-parsing entropy.

A suffix automaton is built from labelled text of each language. A text is cut greedily into the longest phrases
that the automaton recognises; the language that needs the fewest phrases for each letter wins. Automata are turned
into tables whose missing transitions restart at the root and count a phrase, so that many texts are parsed side by
side, one character a step. Every learned letter has a code of its own: common ones a column of the table, the others
a sorted list of transitions, so that a script of thousands of letters costs what its sample holds.

Defined cases: a null text or one without letters gives `und` and score 0; no labelled rows give `und` everywhere;
ties go to the smaller language name; repeated rows are repeated in the result; an empty table gives an empty result;
a letter that no language's sample holds is a phrase of its own in all of them.
Texts of any length are parsed whole: stretches of a long one are parsed side by side, and again from the state in
which the stretch before has ended, until no such state changes, so that the count is that of one parse.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import flat_codes, plus, slices

STRETCH = 4096
#: Letters whose transitions are columns of a table; those of rarer letters are sorted lists. Results don't depend on it.
COLUMNS = 44


def sample_texts(docs: DataFrame, rows_per_lang: int = 64, chars_per_lang: int = 20_000) -> dict[str, str]:
    """Labelled text of each language, at most rows_per_lang rows and chars_per_lang characters: a bounded sample.

    Copies of a text count once. Texts are taken in the order of a hash, shorter ones (an eighth of the budget) first, so
    that many fit in. Of a language with more than 8 * rows_per_lang distinct texts about that many are looked at.
    """
    named = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 8 * rows_per_lang / max(1, n)))])
    few = named.where(F.shiftrightunsigned("h", 1) / float(1 << 63) <= part[F.col("lang")])
    few = few.groupBy("lang", "h").agg(F.min(F.struct(F.length("text").alias("n"), F.substring("text", 1, chars_per_lang).alias("text"))).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.col("x.n") > chars_per_lang // 8, "h")
    rows = few.select("lang", "h", "x.text", F.row_number().over(order).alias("r")).where(F.col("r") <= rows_per_lang).orderBy("lang", "r").collect()
    out: dict[str, str] = {}
    for r in rows:
        if len(out.get(r["lang"], "")) < chars_per_lang:
            out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[:chars_per_lang]
    return out


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of codes: the transitions of each state."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = cur
    return moves


@functools.lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and the code point of its small form."""
    chars = [chr(i) for i in range(0x110000)]
    small = np.arange(0x110000, dtype=np.uint32)
    alpha = np.fromiter(map(str.isalpha, chars), bool, len(chars))
    at = np.flatnonzero(alpha)
    small[at] = [ord(low) if len(low := chars[i].lower()) == 1 else i for i in at]
    return alpha, small


class Machine(NamedTuple):
    """The automata of all languages. A state is where its row of the table begins; a move holds the next state and a flag."""

    langs: list[str]
    code: np.ndarray  #: of each code point: 0 no letter, 1 a letter not learned, then the learned ones, the commonest first
    width: int  #: codes from here on have no column
    table: np.ndarray
    roots: np.ndarray
    flag: int  #: added to a move that ends a phrase
    keys: np.ndarray  #: state * rare + code - width of the moves that have no column, in order
    moves: np.ndarray
    restarts: np.ndarray  #: by language and code - width: the state in which a phrase that begins with it is

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The moves of states, by texts and languages, on one code for each text."""
        far = np.flatnonzero(c >= self.width)
        if not len(far):
            return self.table[state + c[:, None]]
        out = self.table[state + np.where(c < self.width, c, 0)[:, None]]
        s, r = state[far].astype(np.int64), c[far].astype(np.int64) - self.width
        key = s * self.restarts.shape[1] + r[:, None]
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        fresh = self.restarts[:, r].T + np.where(s == self.roots[None, :], 0, self.flag)
        out[far] = np.where(self.keys[at] == key, self.moves[at], fresh)
        return out


@functools.lru_cache(2)
def machine(texts: tuple[tuple[str, str], ...]) -> Machine:
    alpha, small = _letters()
    sets = {k: small[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for k, t in texts}
    seen = Counter(int(x) for s in sets.values() for x in s[alpha[s]])
    own = sorted(seen, key=lambda x: (-seen[x], x))
    width, rare = 2 + min(COLUMNS, len(own)), max(0, len(own) - COLUMNS)
    of_small = np.ones(0x110000, np.int32)
    of_small[own] = 2 + np.arange(len(own))
    code = np.where(alpha, of_small[small], 0).astype(np.int32)
    graphs = []
    for k, _ in texts:
        c = code[sets[k]]
        graphs.append(automaton(c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]].tolist() if len(c) else []))
    size = sum(len(g) + 1 for g in graphs) * width
    kind, flag = (np.int32, 1 << 30) if size < 1 << 30 else (np.int64, 1 << 62)
    tables, roots, keys, moves, restarts = [], [], [], [], np.zeros((len(texts), rare), np.int64)
    base = 0
    for i, g in enumerate(graphs):
        # a code that no phrase holds is a phrase of its own: after it, in the last state, all codes begin a phrase
        t = np.full((len(g) + 1, width), -1, np.int64)
        restarts[i] = base + len(g) * width
        for s, m in enumerate(g):
            for x, to in m.items():
                if x < width:
                    t[s, x] = to
                else:
                    keys.append((base + s * width) * rare + x - width)
                    moves.append(base + to * width)
                    if s == 0:
                        restarts[i, x - width] = base + to * width
        restart = np.where(t[0] >= 0, t[0], len(g))
        ends = np.where(t >= 0, 0, flag)
        ends[0] = 0
        tables.append(((np.where(t >= 0, t, restart[None, :]) * width + base) | ends).astype(kind).ravel())
        roots.append(base)
        base += t.size
    order = np.argsort(np.array(keys, np.int64))
    table = np.concatenate(tables)
    return Machine([k for k, _ in texts], code, width, table, np.array(roots, kind), flag, np.array(keys, np.int64)[order], np.array(moves, np.int64)[order], restarts)


def phrases(texts: list[str | None], model: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text in each language, and each text's letters."""
    m = machine(model)
    langs, code, roots = m.langs, m.code, m.roots
    points, at = flat_codes(texts)
    c = code[points]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    letters = np.bincount(doc[c > 0], minlength=len(texts))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
    c, size = c[keep].astype(np.int32), np.bincount(doc[keep], minlength=len(texts))
    begin = np.r_[0, np.cumsum(size)[:-1]]
    parts = -(-size // STRETCH)
    owner = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begin[owner] + nth * STRETCH
    length = np.minimum(STRETCH, size[owner] - nth * STRETCH)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    nth = nth[order]
    # where in this order the stretch before and the next one of the same text are
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    follows = np.flatnonzero(nth > 0)
    before = place[order[follows] - 1]
    enter = np.repeat(roots[None, :], len(owner), 0)
    leave, count = enter.copy(), np.zeros(enter.shape, np.int32)
    todo = np.arange(len(owner))
    while len(todo):
        state, found = enter[todo], np.zeros((len(todo), len(langs)), np.int32)
        n, first = length[todo], start[todo]
        active = np.searchsorted(-n, -np.arange(int(n[0])), "left")
        for t, k in enumerate(active):
            v = m.step(state[:k], c[first[:k] + t])
            found[:k] += v >= m.flag
            state[:k] = v & (m.flag - 1)
        leave[todo], count[todo] = state, found
        changed = (enter[follows] != leave[before]).any(1)
        enter[follows] = leave[before]
        todo = np.sort(follows[changed])
    count[nth == 0] += 1
    out = np.zeros((len(texts), len(langs)))
    for i in range(len(langs)):
        out[:, i] = np.bincount(owner, count[:, i], len(texts))
    return out, letters


def detect(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """docs' other columns, with lang_pred and score: the runner-up's phrases as a part of both languages' phrases."""
    model = tuple(sorted(samples.items()))
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = plus(docs.select(*keep), {"lang_pred": "string", "score": "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, text):
                n = s.num_rows
                if model:
                    got, letters = phrases(s.column(text).to_pylist(), model)
                    best = got.argmin(1)
                    low = got[np.arange(n), best]
                    rest = got.copy()
                    rest[np.arange(n), best] = np.inf
                    second = rest.min(1)
                    score = np.where(letters > 0, np.where(np.isinf(second), 1.0, second / np.maximum(1e-9, second + low)), 0.0)
                    score[np.isnan(score)] = 1.0
                    names = [model[i][0] if k else "und" for i, k in zip(best, letters, strict=True)]
                else:
                    names, score = ["und"] * n, np.zeros(n)
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, text).mapInArrow(run, schema)
