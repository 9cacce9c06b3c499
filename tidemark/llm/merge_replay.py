"""Byte-level BPE with a file of ranks, by replaying all merges over the corpus's distinct words.

Texts are split into the pattern's matches (words). An index from token pair to the places where it stands in all words
at hand lets every merge be applied once, in rank order, to all its places; only the pairs of touched neighbours are
looked up again and listed under their own merges. A pair is listed under the token that it makes, so that a token's
merge holds all ways of splitting it, as the library's does.

First all distinct words of the corpus are counted. Those that are most frequent, HEAD of at most LONGEST bytes each, are
replayed once for the whole corpus and broadcast, a table of at most 2**18 words of 64 bytes and their ids. Rarer
words are replayed by the same index where their texts lie, for all texts of a slice together. No word is left out.

Replay in rank order equals the library's order within each word if every token is made by merges below its own rank,
which holds of trained vocabularies and is tested; a lower merge that becomes possible later is taken up again at once.

Defined cases: a null or empty text has no tokens and the digests of empty strings; words of any length are merged
whole, and texts of any length encoded whole (one text is one row, which bounds what a task holds); ties of rank go to
the leftmost place; repeated rows are repeated in the result; an empty table gives an empty result. Other columns are
kept, but for those named like a result column.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_codes, materialize, plus, slices

HEAD, LONGEST = 1 << 18, 64
SLICE, INDEX = 4 << 20, 4 << 20
#: A merge with fewer places is applied place by place.
FEW = 24
#: Endings that the pattern splits off (fixed values).
ENDINGS = frozenset(("s", "t", "re", "ve", "m", "ll", "d"))


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space, 4 the plain space, as the library's patterns have them."""
    import tiktoken

    chars = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    kind = np.zeros(0x110000, np.uint8)
    for i, p in enumerate((r"\p{L}", r"\p{N}", r"\s"), 1):
        e = tiktoken.Encoding("own", pat_str=p, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        kind[np.frombuffer(bytes(e.encode_ordinary(chars)).decode().encode("utf-32-le"), np.uint32)] = i
    kind[32] = 4
    return kind


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin; first marks where texts begin."""
    k = classes()[points]
    space = k >= 3
    before = np.where(first, 9, np.r_[np.uint8(9), k[:-1]])
    ends = np.r_[first[1:], True]
    start = first | (~space & (k != before) & (before != 4)) | (space & (before < 3))
    # of white space before a word the last is apart: alone, or the plain space that begins the word
    start[:-1] |= space[:-1] & ~space[1:] & ~ends[:-1]
    for q in np.flatnonzero((points == 39) & start).tolist():
        for n in (1, 2):
            if q + n < len(k) and not first[q + 1 : q + n + 1].any() and "".join(map(chr, points[q + 1 : q + n + 1].tolist())) in ENDINGS:
                start[q + 1 : q + n + 1] = False
                if q + n + 1 < len(k) and not space[q + n + 1]:
                    start[q + n + 1] = True
                break
    return start


def split(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts one after the other, and where each text's begin (one more at the end)."""
    texts = [t or "" for t in texts]
    points, at = flat_codes(texts)
    if not len(points):
        return [], np.zeros(len(texts) + 1, np.int64)
    first = np.zeros(len(points), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    begin = np.flatnonzero(word_starts(points, first))
    byte_at = np.r_[0, np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))]
    data = "".join(texts).encode()
    edge = [*byte_at[begin].tolist(), len(data)]
    return [data[a:b] for a, b in zip(edge, edge[1:], strict=False)], np.searchsorted(begin, at)


class Merges:
    """A file of ranks, with what each pair of tokens makes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = dict(zip(self.rank.values(), self.rank, strict=True))
        byte = [self.rank[bytes([i])] for i in range(256)]
        self.byte = np.array(byte, np.int64)
        get = self.rank.get
        self.makes = {(a << 32) | b: r for t, r in self.rank.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None}
        self._pairs = pd.Index(np.fromiter(self.makes, np.int64, len(self.makes)))
        self._made = np.r_[np.fromiter(self.makes.values(), np.int64, len(self.makes)), -1]

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs make; -1: nothing."""
        return self._made[self._pairs.get_indexer((a << 32) | b)]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            upto, size = at, 0
            while upto < len(words) and (upto == at or size + len(words[upto]) <= INDEX):
                size += len(words[upto])
                upto += 1
            out += self._replay(words[at:upto])
            at = upto
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = int(size.sum())
        token = np.r_[self.byte[np.frombuffer(b"".join(words), np.uint8)], -1]
        # a place is where a token begins; n stands for no place
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(size)
        after[ends[size > 0] - 1] = n
        before[(ends - size)[size > 0]] = n
        after[n] = before[n] = n
        makes = np.full(n + 1, -1)
        inner = np.flatnonzero(after[:n] < n)
        makes[inner] = self.made(token[inner], token[after[inner]])
        index: dict[int, list[np.ndarray | int]] = {}
        heap: list[int] = []

        def enlist(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            edge = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1], True]).tolist()
            for a, b in zip(edge, edge[1:], strict=False):
                r = int(ranks[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places[a:b])

        some = inner[makes[inner] >= 0]
        if len(some):
            enlist(makes[some], some)
        t_, a_, b_, m_ = map(memoryview, (token, after, before, makes))
        get = self.makes.get
        while heap:
            r = heapq.heappop(heap)
            listed = index.pop(r)
            if sum(1 if type(x) is int else len(x) for x in listed) < FEW:
                places = sorted({p for x in listed for p in ((x,) if type(x) is int else x.tolist())})
                for p in places:
                    if m_[p] != r:
                        continue
                    q = a_[p]
                    s, o = a_[q], b_[p]
                    t_[p], t_[q], m_[q], a_[p] = r, -1, -1, s
                    if s < n:
                        b_[s] = p
                        m_[p] = x = get((r << 32) | t_[s], -1)
                        if x >= 0:
                            if x not in index:
                                index[x] = []
                                heapq.heappush(heap, x)
                            index[x].append(p)
                    else:
                        m_[p] = -1
                    if o < n:
                        m_[o] = x = get((t_[o] << 32) | r, -1)
                        if x >= 0:
                            if x not in index:
                                index[x] = []
                                heapq.heappush(heap, x)
                            index[x].append(o)
                continue
            p = np.unique(np.concatenate([np.atleast_1d(x) for x in listed]))
            p = p[makes[p] == r]
            if not len(p):
                continue
            # where one place's second token is the next place's first, every other of the chain is merged
            chained = np.r_[False, after[p[:-1]] == p[1:]]
            head = np.flatnonzero(~chained)
            p = p[(np.arange(len(p)) - head[np.cumsum(~chained) - 1]) % 2 == 0]
            q = after[p]
            s = after[q]
            token[p], token[q], makes[q], after[p] = r, -1, -1, s
            before[s] = p
            before[n] = n
            touched = np.unique(np.concatenate([p, before[p]]))
            touched = touched[touched < n]
            next_to = after[touched]
            made = np.where(next_to < n, self.made(token[touched], token[next_to]), -1)
            makes[touched] = made
            if (made >= 0).any():
                enlist(made[made >= 0], touched[made >= 0])
        left = np.flatnonzero(token[:n] >= 0)
        ids = token[left].astype("<u4").tobytes()
        edge = [0, *(4 * np.searchsorted(left, ends)).tolist()]
        return [ids[a:b] for a, b in zip(edge, edge[1:], strict=False)]


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, and the distinct words."""
    seen: dict[bytes, int] = {}
    at = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return at, list(seen)


def frequent_words(docs: DataFrame, path: str, text: str = "text", most: int = HEAD) -> pa.Table:
    """word and ids of the corpus's most frequent words that aren't tokens, at most `most`, replayed together.

    All words are counted; tasks add up their own first. The least count is a power of two, chosen from the number of
    words for each power, so that no list of words is sorted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = merges(path).rank
        for b in batches:
            for s in slices(b, text, SLICE):
                at, words = numbered(split(s.column(text).to_pylist())[0])
                n = np.bincount(at, minlength=len(words))
                take = [i for i, w in enumerate(words) if len(w) <= LONGEST and w not in rank]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in take], pa.binary()), pa.array(n[take])], ["word", "n"])

    words = materialize(docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["c"] for r in words.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()}
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        if (total := total + sizes[p]) > most:
            break
        least = p

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [w for b in batches for w in b.column("word").to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(merges(path).replay(found), pa.binary())], ["word", "ids"])

    head = words.where(F.log2("n") >= least).select("word")
    return head.repartition(max(1, most >> 16), F.xxhash64("word")).mapInArrow(replayed, "word binary, ids binary").toArrow()


_heads: dict[str, dict[bytes, bytes]] = {}


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: bool = False, head: int = HEAD) -> DataFrame:
    """docs' other columns with n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256; with ids also the ids and the decoded bytes."""
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "binary"} if ids else {})
    keep = [c for c in docs.columns if c != text and c not in made]
    schema = plus(docs.select(*keep), made)
    known = frequent_words(docs, path, text, head)
    sent, name = docs.sparkSession.sparkContext.broadcast((known["word"].to_pylist(), known["ids"].to_pylist())), uuid.uuid4().hex

    def rows(s: pa.RecordBatch, table: Merges, known: dict[bytes, bytes]) -> pa.RecordBatch:
        words, begin = split(s.column(text).to_pylist())
        at, words = numbered(words)
        get = table.rank.get
        own = [known.get(w) if (r := get(w)) is None else r.to_bytes(4, "little") for w in words]
        rest = [i for i, x in enumerate(own) if x is None]
        for i, x in zip(rest, table.replay([words[i] for i in rest]), strict=True):
            own[i] = x
        count = np.fromiter((len(x) >> 2 for x in own), np.int64, len(own))
        said = [" ".join(map(str, memoryview(x).cast("I"))).encode() for x in own]
        token = table.token
        decoded = [b"".join([token[i] for i in memoryview(x).cast("I")]) for x in own]
        found: list[tuple] = []
        for i in range(s.num_rows):
            mine = at[begin[i] : begin[i + 1]]
            numbers = mine.tolist()
            back = b"".join([decoded[x] for x in numbers])
            row = (int(count[mine].sum()), hashlib.sha256(b" ".join([said[x] for x in numbers])).hexdigest(), hashlib.sha256(back).hexdigest())
            found.append((*row, np.frombuffer(b"".join([own[x] for x in numbers]), "<i4"), back) if ids else row)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary())
        columns = list(zip(*found, strict=True)) if found else [()] * len(made)
        return pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), *(pa.array(v, t) for v, t in zip(columns, kinds, strict=False))], [*keep, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _heads:  # once for each Python worker
            _heads.clear()
            _heads[name] = dict(zip(*sent.value, strict=True))
        for b in batches:
            for s in slices(b, text, SLICE):
                yield rows(s, merges(path), _heads[name])

    return docs.select(*keep, text).mapInArrow(run, schema)
