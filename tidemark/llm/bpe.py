"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer file, by tree concatenation.

Texts up to LEAF bytes are encoded where they lie. Longer texts are halved again and again until the parts have at
most LEAF bytes; the parts are rows of their own, which Spark spreads over all tasks. Neighbouring parts are then
joined pair by pair: a window around each join is encoded anew and grows until it agrees with both sides, at a place
where all start a new word, or inside one endless word at a token that all have alike.

Inside a task the words of many texts are found with array operations, and each distinct word is merged once. Texts
with letters beyond the Latin blocks go through the tokenizer library itself; results are the same.

Defined cases: null text is an empty text (0 tokens); the special token's own spelling inside a text becomes the
special token, as in the library; repeated rows are repeated in the result; other columns are kept, but for those
named like a result column, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_name, flat_codes, plus, prefix_hash, slices, span_hash

LEAF = 1 << 15
_CACHED = 400_000


class Vocabulary:
    """A byte-level BPE file, with one entry for each token's bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.pieces = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for t, i in ranks.items():
            self.pieces[i] = t
        for t, i in self.special.items():
            self.pieces[i] = t.encode()
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[int, bytes] = {}
        # classes of code points: 0 other, 1 letter, 2 number, 3 white space, 4 a plain space, 5 left to the library
        kind = np.full(0x110000, 5, np.uint8)
        import unicodedata

        for i in [*range(0x250), *range(0x2010, 0x2027), 0x20AC]:
            kind[i] = {"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 0)
        kind[[9, 10, 11, 12, 13, 0xA0]] = 3
        kind[32] = 4
        kind[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = 5
        self.kind = kind

    def words(self, k: np.ndarray, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words begin: k has the classes, first says where a text begins."""
        n = len(k)
        space = k >= 3
        prev, prev_k = np.r_[True, space[:-1]] | first, np.r_[np.uint8(9), k[:-1]]
        prev_k = np.where(first, 9, prev_k)
        start = (k != prev_k) | first
        start &= ~(space & (prev_k >= 3) & ~first & (prev_k != 9))  # white space runs, plain or not, are one
        last = np.r_[first[1:], True]
        after = np.r_[space[1:], True] | last
        # the last white space before a word stands alone, or if plain begins the word
        tail = space & ~after
        start |= tail
        start &= ~(~space & np.r_[False, (k[:-1] == 4)] & ~first)
        quote = np.flatnonzero((points == 39) & start & (prev_k != 4))
        for q in quote:
            for size in (2, 3):
                w = points[q + 1 : q + size]
                if len(w) == size - 1 and not first[q + 1 : q + size].any() and bytes(min(255, x) for x in w.tolist()) in _SHORT:
                    start[q + 1 : q + size] = False
                    if q + size < n and not first[q + size] and k[q + size] < 3:
                        start[q + size] = True
                    break
        return start

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's ids begin, and the words: where in the ids, and where in the bytes of all texts, each begins."""
        texts = [t or "" for t in texts]
        points, at = flat_codes(texts)
        k = self.kind[points]
        odd = np.add.reduceat(np.r_[k == 5, False], np.minimum(at[:-1], len(k))) * (np.diff(at) > 0) > 0 if len(texts) else np.zeros(0, bool)
        odd = odd.astype(bool)
        for t in self.special:
            odd |= np.fromiter((t in x for x in texts), bool, len(texts))
        if odd.any():
            return self._mixed(texts, odd)
        first = np.zeros(len(k), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF)
        byte_at = np.r_[0, np.cumsum(size)]
        begin = np.flatnonzero(self.words(k, points, first))
        data = "".join(texts).encode()
        lo = byte_at[begin]
        hi = np.r_[lo[1:], len(data)]
        h = span_hash(prefix_hash(np.frombuffer(data, np.uint8)), lo, hi).view(np.int64)
        back, uniq = pd.factorize(h)
        where = np.zeros(len(uniq), np.int64)
        where[back[::-1]] = np.arange(len(h) - 1, -1, -1)
        if len(self.cache) > _CACHED:
            self.cache.clear()
        get, merge, out = self.cache.get, self.merge, []
        for key, a, b in zip(uniq.tolist(), lo[where].tolist(), hi[where].tolist(), strict=True):
            ids = get(key)
            if ids is None:
                ids = self.cache[key] = array("I", merge(data[a:b])).tobytes()
            out.append(ids)
        count = np.fromiter((len(x) >> 2 for x in out), np.int64, len(out))
        pool = np.frombuffer(b"".join(out), "<u4")
        begins = np.cumsum(count) - count
        n = count[back]
        word_at = np.cumsum(n) - n
        total = int(n.sum())
        ids = pool[np.repeat(begins[back] - word_at, n) + np.arange(total)]
        text_word = np.searchsorted(begin, at)
        return ids, np.r_[word_at, total][text_word], word_at, lo

    def _mixed(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts, sizes, words, los = [], [], [], []
        done = base = 0
        for t, o in zip(texts, odd.tolist(), strict=True):
            if o:
                e = self.library.encode(t, add_special_tokens=False)
                ids = np.array(e.ids, np.uint32)
                w = np.array([-1 if x is None else x for x in e.word_ids], np.int64)
                new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]] | (w < 0)) if len(w) else np.zeros(0, np.int64)
                lo = (np.cumsum(self.lengths[ids]) - self.lengths[ids])[new]
            else:
                ids, _, new, lo = self.encode([t])
            parts.append(ids)
            words.append(new + done)
            los.append(lo + base)
            sizes.append(len(ids))
            done += len(ids)
            base += len(t.encode())
        return np.concatenate(parts), np.r_[0, np.cumsum(sizes)], np.concatenate(words), np.concatenate(los)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


#: Endings that the pattern splits off (fixed values).
_SHORT = {b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"}


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def halves(data: bytes, leaf: int) -> list[tuple[int, int]]:
    """Parts of at most leaf bytes, by halving, none of which cuts a character."""
    todo, out = [(0, len(data))], []
    while todo:
        a, b = todo.pop()
        if b - a <= max(8, leaf):
            out.append((a, b))
            continue
        m = (a + b) // 2
        while m > a and data[m] & 0xC0 == 0x80:
            m -= 1
        todo += [(m, b), (a, m)]
    return out


class Part:
    """The tokens of data[lo:hi]: ids, where each begins, and which begin a word."""

    def __init__(self, lo: int, hi: int, ids: np.ndarray, begin: np.ndarray, word: np.ndarray):
        self.lo, self.hi, self.ids, self.begin, self.word = lo, hi, ids, begin, word


def leaf_part(voc: Vocabulary, data: bytes, lo: int, hi: int) -> Part:
    ids, _, word_at, _ = voc.encode([data[lo:hi].decode()])
    size = voc.lengths[ids]
    word = np.zeros(len(ids), bool)
    word[word_at] = True
    return Part(lo, hi, ids, lo + np.cumsum(size) - size, word)


def join(voc: Vocabulary, data: bytes, a: Part, b: Part, window: int = 64) -> Part:
    """The tokens of two neighbouring parts as one text."""
    c = a.hi
    while True:
        lo, hi = max(a.lo, c - window), min(b.hi, c + window)
        while lo > a.lo and data[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < b.hi and data[hi] & 0xC0 == 0x80:
            hi += 1
        w = leaf_part(voc, data, lo, hi)
        deep = window >= 1024
        left = (0, 0) if lo == a.lo else _agree(a, w, lo, c, deep, True)
        right = (len(w.ids), len(b.ids)) if hi == b.hi else _agree(b, w, c, hi, deep, False)
        if left and right and left[1] <= right[0]:
            i, j, k, m = left[0], left[1], right[0], right[1]
            return Part(a.lo, b.hi, *(np.concatenate([getattr(a, x)[:i], getattr(w, x)[j:k], getattr(b, x)[m:]]) for x in ("ids", "begin", "word")))
        window *= 2


def _agree(side: Part, w: Part, lo: int, hi: int, deep: bool, left: bool) -> tuple[int, int] | None:
    """A place strictly between lo and hi where both start a word, or if deep have the same token: positions in side and w (for the right side: in w and side)."""
    for words in (True, False)[: 1 + deep]:
        x = np.flatnonzero((side.begin > lo) & (side.begin < hi) & (side.word | (not words)))
        y = np.flatnonzero((w.begin > lo) & (w.begin < hi) & (w.word | (not words)))
        _, i, j = np.intersect1d(side.begin[x], w.begin[y], return_indices=True)
        i, j = x[i], y[j]
        if not words:
            same = side.ids[i] == w.ids[j]
            i, j = i[same], j[same]
            inner = (i < len(side.ids) - 1) & (j > 0) if left else (i > 0) & (j < len(w.ids) - 1)
            i, j = i[inner], j[inner]
        if len(i):
            at = -1 if left else 0
            return (int(i[at]), int(j[at])) if left else (int(j[at]), int(i[at]))
    return None


def concatenate(voc: Vocabulary, data: bytes, parts: list[Part]) -> np.ndarray:
    """Joins neighbours pair by pair until one part is left."""
    while len(parts) > 1:
        parts = [join(voc, data, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].ids


def _digests(voc: Vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(voc.decode(ids).encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: bool = False, leaf: int = LEAF) -> DataFrame:
    """docs' other columns with n_tokens, ids_sha256 and decoded_sha256; with ids also the ids and the decoded text."""
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if ids else {})
    keep = [c for c in docs.columns if c != text and c not in made]
    schema = plus(docs.select(*keep), made)
    rest = [v.strip() for v in made]

    def rows(b: pa.RecordBatch, voc: Vocabulary, found: list[np.ndarray]) -> pa.RecordBatch:
        n, i, d = zip(*(_digests(voc, x) for x in found), strict=True) if found else ((), (), ())
        cols = [pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
        if ids:
            cols += [pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([voc.decode(x) for x in found], pa.string())]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *rest])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            for s in slices(b, text):
                got, at, _, _ = voc.encode(s.column(text).to_pylist())
                yield rows(s, voc, [got[at[i] : at[i + 1]] for i in range(s.num_rows)])

    no, part = column_name(docs, "part_no"), column_name(docs, "part_text")
    key, own_ids, own_word = (column_name(docs, c) for c in ("row_key", "part_ids", "part_word"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(text)[i].as_py().encode()
                spans = halves(data, leaf)
                take = b.select([*keep, key]).take(pa.array([i] * len(spans)))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(range(len(spans)), pa.int32()), pa.array([data[x:y].decode() for x, y in spans], pa.string())], [*keep, key, no, part])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            found = [leaf_part(voc, t.encode(), 0, len(t.encode())) for t in b.column(part).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.ids.astype("<u4").tobytes() for p in found], pa.binary()), pa.array([np.packbits(p.word).tobytes() for p in found], pa.binary())], [*b.schema.names, own_ids, own_word])

    def whole(t: pa.Table) -> pa.Table:
        voc = vocabulary(path)
        t = t.sort_by(no).combine_chunks()
        texts = [x.encode() for x in t.column(part).to_pylist()]
        parts, lo = [], 0
        for x, i, w in zip(texts, t.column(own_ids).to_pylist(), t.column(own_word).to_pylist(), strict=True):
            got = np.frombuffer(i, "<u4")
            size = voc.lengths[got]
            parts.append(Part(lo, lo + len(x), got, lo + np.cumsum(size) - size, np.unpackbits(np.frombuffer(w, np.uint8), count=len(got)).astype(bool)))
            lo += len(x)
        return pa.Table.from_batches([rows(t.slice(0, 1).combine_chunks().to_batches()[0], voc, [concatenate(voc, b"".join(texts), parts)])])

    long = F.octet_length(F.coalesce(F.col(text), F.lit(""))) > leaf
    small = docs.where(~long).select(*keep, text).mapInArrow(short, schema)
    cut_schema = plus(docs.select(*keep), {key: "long", no: "int", part: "string"})
    pieces = docs.where(long).select(*keep, text, F.monotonically_increasing_id().alias(key)).mapInArrow(cut, cut_schema)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = pieces.repartition(n, key, no).mapInArrow(leaves, plus(pieces, {own_ids: "binary", own_word: "binary"}))
    return small.unionByName(done.groupBy(key).applyInArrow(whole, schema))
