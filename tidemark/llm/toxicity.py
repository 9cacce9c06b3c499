"""Toxicity: disguised words are decoded through a noisy channel, then the restored text is scored.

The channel writes letters as look-alike signs, parts them with blanks or marks, and repeats them. Each suspicious
stretch becomes a lattice of what every sign may stand for; Viterbi search under a character language model, counted
over all texts, picks the likeliest original. It replaces the stretch only if each sign that it changes makes the text
e**GAIN times likelier on average than the stretch as it is written, so that ordinary words with doubled letters, numbers,
addresses and hashes stay. The restored text is scored by its distinct letter sequences: those that
labelled toxic rows have far more often than others are weighed by their log-odds, and a logistic curve turns the sum
into a score.

Sequences are chosen on one half of a bounded sample of labelled rows and the curve is fitted on the other half.

Defined cases: a null or empty text has no sequence and gets the score of such texts (the curve's start); without
labels of both kinds every score is 0; documents labelled both ways are not learned from; repeated rows are repeated
in the result; an empty table gives an empty result; very long texts are decoded and scored whole; of readings that are
equally likely the last in order counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_codes, plus, slices
from tidemark.llm.langid import _letters

#: What signs may stand for (fixed values).
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
MARKS = ".-_*~'^"
#: What each changed sign must add to the log-likelihood, on average.
GAIN = 4.0
_CODES = 64


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A code below 64 for each code point (0: no letter), and a kind: 1 letter, 2 sign, 4 mark, 8 white space."""
    alpha, small = _letters()
    code = np.where(alpha, 27 + small % (_CODES - 27), 0).astype(np.uint8)
    for i in range(26):
        code[[65 + i, 97 + i]] = 1 + i
    kind = alpha.astype(np.uint8)
    for c in SIGNS:
        kind[ord(c)] = 2
    for c in MARKS:
        kind[ord(c)] = 4
    kind[[9, 10, 11, 12, 13, 32, 0xA0]] = 8
    return code, kind


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each of which begins and ends with 0 and has single zeros only, and each code's text."""
    points, at = flat_codes(texts)
    n = np.diff(at)
    c = np.zeros(len(points) + 2 * len(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), n + 2)
    inner = np.ones(len(c), bool)
    first = np.cumsum(n + 2) - (n + 2)
    inner[first] = inner[first + n + 1] = False
    c[inner] = _tables()[0][points]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
    return c[keep], doc[keep]


def suspicious(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Stretches of each text that the channel may have written."""
    points, at = flat_codes(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(points):
        return out
    code, kinds = _tables()
    k, c = kinds[points], code[points]
    n = len(k)
    k = np.r_[k, np.full(3, 8, np.uint8)]
    white = np.r_[k[:n] == 8, True, True, True]
    white_at = np.zeros(n + 3, bool)
    white_at[at] = True  # a text begins: the one before has ended
    before = np.r_[np.uint8(8), k[: n - 1]]
    before[at[:-1][at[:-1] < n]] = 8
    after = np.where(white_at[1 : n + 1], 8, k[1 : n + 1])
    after2 = np.where(white_at[1 : n + 1] | white_at[2 : n + 2], 8, k[2 : n + 2])
    sign = k[:n] == 2
    bang = (points == 33) | (points == 40)
    hit = sign & ((after == 1) | ((before == 1) & ~bang & ((after == 8) | ((after == 2) & (after2 == 8)))))
    hit |= (k[:n] == 4) & (before <= 2) & (before > 0) & (after <= 2) & (after > 0) & np.isin(np.r_[after2[1:], np.uint8(8)], (1, 2)) & (after2 == 4)
    three = np.zeros(n, bool)
    three[2:] = (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (c[2:] > 0)
    three[at[:-1][at[:-1] < n]] = False
    hit |= three
    # words: from white space to white space, or a text's edge
    start = np.flatnonzero(~white[:n] & (np.r_[True, white[: n - 1]] | white_at[:n]))
    if not len(start):
        return out
    begins = np.zeros(n, np.int32)
    begins[start] = 1
    word = np.cumsum(begins, dtype=np.int32) - 1
    end = np.flatnonzero(~white[:n] & (white[1 : n + 1] | white_at[1 : n + 1])) + 1
    doc = np.searchsorted(at, start, "right") - 1
    marked = np.zeros(len(start), bool)
    marked[word[hit]] = True
    has_letter = np.zeros(len(start), bool)
    has_letter[word[(k[:n] == 1)]] = True
    marked &= has_letter
    # three or more letters or signs standing alone, a letter among them
    alone = (end - start == 1) & ((k[start] == 1) | (k[start] == 2))
    letters = np.r_[0, np.cumsum(k[start] == 1)]
    run = alone.copy()
    run[1:-1] = alone[1:-1] & alone[:-2] & alone[2:] & (doc[1:-1] == doc[:-2]) & (doc[1:-1] == doc[2:]) if len(run) > 2 else False
    run[[0, -1]] = False
    for i in np.flatnonzero(marked):
        out[doc[i]].append((int(start[i] - at[doc[i]]), int(end[i] - at[doc[i]])))
    middle = np.flatnonzero(run)
    if len(middle):
        for g in np.split(middle, np.flatnonzero(np.diff(middle) > 1) + 1):
            a, b = g[0] - 1, g[-1] + 1
            if letters[b + 1] > letters[a]:
                out[doc[a]].append((int(start[a] - at[doc[a]]), int(end[b] - at[doc[a]])))
    return [sorted(x) for x in out]


def _options(ch: str, run: int) -> list[tuple[str, float, int]]:
    """What a sign may stand for, what the channel takes for it, and whether that changes the sign."""
    if _tables()[0][ord(ch)]:
        return [(ch, 0.0, 0)] + ([("", -0.5 if run > 2 else -3.0, 1)] if run > 1 else [])
    if ch in SIGNS:
        return [(x, -0.7, 1) for x in SIGNS[ch]] + [(" ", -4.0, 0), ("", -7.0, 1)]
    if ch == " " or ch in MARKS:
        return [(" ", -0.5, 0), ("", -1.0, 1)]
    return [(" ", 0.0, 0)]


def decode(word: str, logp: np.ndarray) -> str:
    """The likeliest original of a stretch."""
    return _decoded(word, logp)[0]


def _decoded(word: str, logp: np.ndarray) -> tuple[str, float, int]:
    """The likeliest original, its log-likelihood and how many signs it changes: Viterbi search over the last two codes."""
    code = _tables()[0]
    # each state has its score, the signs changed, and its path: the last piece and the path before
    states: dict[tuple[int, int], tuple[float, int, tuple | None]] = {(0, 0): (0.0, 0, None)}
    chars = word.lower()
    run = 0
    for i, ch in enumerate(chars):
        run = run + 1 if i and ch == chars[i - 1] else 1
        options = _options(ch, run)
        new: dict[tuple[int, int], tuple[float, int, tuple | None]] = {}
        for (a, b), (score, n, path) in states.items():
            for x, cost, changed in options:
                if x == "" or x == " " and b == 0:
                    key, value, text = (a, b), score + cost, (x, path) if x == " " and path and path[0] != " " else path
                else:
                    d = int(code[ord(x)])
                    key, value, text = (b, d), score + cost + float(logp[a, b, d]), (x, path)
                if key not in new or value > new[key][0]:
                    new[key] = (value, n + changed, text)
        states = new
    best = max(((score + float(logp[a, b, 0]) if b else score, _joined(path), n) for (a, b), (score, n, path) in states.items()), key=lambda x: (x[0], x[1]))
    return best[1], best[0], best[2]


def as_written(word: str, logp: np.ndarray) -> float:
    """The log-likelihood of a stretch none of whose signs is changed, under the same channel."""
    code = _tables()[0]
    a = b = 0
    score = 0.0
    for ch in word.lower():
        x, cost, _ = next(o for o in _options(ch, 1) if not o[2])
        d = int(code[ord(x)])
        score += cost
        if d or b:
            score += float(logp[a, b, d])
            a, b = b, d
    return score + (float(logp[a, b, 0]) if b else 0.0)


def original(word: str, logp: np.ndarray) -> str:
    """The likeliest original of a stretch if it gains enough for what it changes, else the stretch."""
    text, score, n = _decoded(word, logp)
    return text if n and score - as_written(word, logp) >= GAIN * n else word


def _joined(path: tuple | None) -> str:
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def restore(texts: list[str], logp: np.ndarray, cache: dict[str, str]) -> list[str]:
    out = []
    for t, found in zip(texts, suspicious(texts), strict=True):
        if found:
            parts, at = [], 0
            for a, b in found:
                if a < at:
                    continue
                w = t[a:b]
                if (r := cache.get(w)) is None:
                    r = original(w, logp)
                    if len(cache) > 50_000:
                        cache.clear()
                    if len(w) <= 40:
                        cache[w] = r
                parts += [t[at:a], r]
                at = b
            t = "".join(parts) + t[at:]
        out.append(t)
    return out


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of four codes, then of five, and each one's text; none spans two texts."""
    c, doc = _codes(texts)
    c, doc = c.astype(np.int32), doc.astype(np.int32)
    g = np.zeros(max(0, len(c) - 3), np.int32)
    for i in range(4):
        g = (g << 6) | c[i : len(c) - 3 + i]
    ok = doc[: len(g)] == doc[3:]
    yield doc[: len(g)][ok], g[ok] | (1 << 30)
    g = (g[:-1] << 6) | c[4:] if len(g) else g
    ok = doc[: len(g)] == doc[4:] if len(g) else np.zeros(0, bool)
    yield doc[: len(g)][ok], g[ok]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, sequence)."""
    u = np.unique(np.concatenate([(d.astype(np.int64) << 32) | g for d, g in _grams(texts)]))
    return u >> 32, u & 0xFFFFFFFF


def _spot(g: np.ndarray) -> np.ndarray:
    return (g ^ (g >> 13)) & 0xFFFFF


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(code | two codes before), from all texts. At most 64**3 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(_CODES**3, np.int64)
        for b in batches:
            for s in slices(b, text):
                c, _ = _codes([t or "" for t in s.column(text).to_pylist()])
                c = c.astype(np.int32)
                own += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=_CODES**3)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], ["g", "n"])

    got = docs.select(text).mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(_CODES**3)
    n[got["g"].to_numpy()] = got["n"].to_numpy()
    n = n.reshape(_CODES, _CODES, _CODES)
    one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * _CODES)
    two = (n.sum(0) + 8 * one) / (n.sum(0).sum(-1, keepdims=True) + 8)
    return np.log((n + 8 * two) / (n.sum(-1, keepdims=True) + 8)).astype(np.float32)


class Model:
    """A fitted scorer: the language model, weighed sequences, and the curve."""

    def __init__(self, logp: np.ndarray, ids: np.ndarray, weights: np.ndarray, curve: np.ndarray):
        self.logp, self.curve = logp, curve
        order = np.argsort(ids)
        self.ids, self.weights = ids[order], weights[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_spot(self.ids.astype(np.int32))] = True

    def evidence(self, texts: list[str]) -> np.ndarray:
        keys = []
        for d, g in _grams(texts):
            some = self.maybe[_spot(g)]
            keys.append((d[some].astype(np.int64) << 32) | g[some])
        u = np.unique(np.concatenate(keys))
        doc, g = u >> 32, u & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.ids, g), max(0, len(self.ids) - 1))
        hit = self.ids[at] == g if len(self.ids) else np.zeros(0, bool)
        w = self.weights[at[hit]] if len(self.ids) else np.zeros(0)
        total = np.bincount(doc[hit], w, len(texts))
        best = np.zeros(len(texts))
        np.maximum.at(best, doc[hit], w)
        return np.stack([np.ones(len(texts)), np.log1p(total), best], 1)

    def scores(self, texts: list[str], cache: dict[str, str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(restore(texts, self.logp, cache)) @ self.curve, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 4000, features: int = 20_000) -> Model | None:
    """Learns from rows for which `learn` holds: at most `rows` toxic and 2 * rows other ones (a bounded sample), and at most `features` sequences."""
    spark = docs.sparkSession
    logp = language_model(docs, text)
    marked = labels.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("k", F.col("y").cast("int").alias("y"), F.xxhash64("k").alias("h"))
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    picked = marked.where(F.col("y") == 1).orderBy("h", "k").limit(rows).union(marked.where(F.col("y") == 0).orderBy("h", "k").limit(2 * rows))
    picked = F.broadcast(picked.select("k", "y", (F.col("h") % 2 == 0).alias("choose")))  # at most 3 * rows rows
    sample = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).join(picked, "k").select("t", "y", "choose")
    sent = spark.sparkContext.broadcast(logp)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for b in batches:
            for s in slices(b, "t"):
                y = s.column("y").to_numpy()
                doc, g = grams(restore(s.column("t").to_pylist(), sent.value, cache))
                u, back = np.unique(g, return_inverse=True)
                bad = np.bincount(back, y[doc], len(u)).astype(np.int64)
                seen = np.bincount(back, minlength=len(u))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(bad), pa.array(seen - bad)], ["g", "bad", "good"])

    size = {r["y"]: r["n"] for r in sample.where("choose").groupBy("y").agg(F.count("*").alias("n")).collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    if not t or not c:
        return None
    counts = sample.where("choose").select("t", "y").mapInArrow(count, "g long, bad long, good long").groupBy("g").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (t + 1.0)) - F.log((F.col("good") + 0.5) / (c + 1.0))
    best = counts.where("bad >= 4").withColumn("w", odds).where("w > 2").orderBy((F.col("bad") * F.col("w")).desc(), "g").limit(features).toArrow()
    model = Model(logp, best["g"].to_numpy().astype(np.int64), best["w"].to_numpy(), np.zeros(3))
    held = spark.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for b in batches:
            for s in slices(b, "t"):
                x = held.value.evidence(restore(s.column("t").to_pylist(), held.value.logp, cache))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), s.column("y")], ["a", "b", "y"])

    got = sample.where("not choose").select("t", "y").mapInArrow(look, "a double, b double, y int").toArrow()  # three numbers for each sampled row
    y = got["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.ones(len(y)), got["a"].to_numpy(), got["b"].to_numpy()], 1)
    weight = np.where(y == 1, n[1] / max(1, y.sum()), n[0] / max(1, (1 - y).sum()))
    weight /= weight.mean()
    beta = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        r = weight * p * (1 - p)
        beta = beta + np.linalg.solve((x * r[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (weight * (y - p)) - 0.05 * beta)
    model.curve = beta
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' columns (without the text unless keep_text) with score and predicted."""
    keep = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text)]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the language model's and the sequences' number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for b in batches:
            for s in slices(b, text):
                y = sent.value.scores([t or "" for t in s.column(text).to_pylist()], cache) if sent.value else np.zeros(s.num_rows)
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, plus(docs.select(*keep), {"score": "double", "predicted": "int"}))


