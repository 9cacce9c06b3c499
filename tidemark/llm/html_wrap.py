"""Main text of web pages by wrappers inferred for each host.

A page is a stream of block tags and text slots; inline markup belongs to the text around it, and end tags that may be
left out are put in. A token is a block of text, known by its path of tags and marks (without numbers and titles) and by
how far up the page has left its elements since the block before. A text that at least half of the host's pages with
that path share is a token of its own, a constant of the template.

Wrappers: side-by-side repeats of a page's tokens are folded into repeated groups. The distinct expressions of a host
are aligned in groups of bounded size, round after round, until one is left: what only some have becomes optional, and
a group takes in its single form. The expression is free of unions. Each page is then matched against its host's
wrapper (the cheapest path through it), so that each block falls to a position of it. Constancy, length and links are
counted for each position over all pages, and a page's main text is chosen from its own positions, so that a host may
mix templates: positions inside `article` or `main`, else those that vary and hold text rather than links, in the
deepest element that has most of the host's text.

Defined cases: a null or empty page has an empty text; a page of any length is read whole, in one task; a page without
a host shares a wrapper with others of the kind; repeated rows are repeated in the result; other columns are kept, but
for those named text and n_chars; an empty table gives an empty result. A page of a host with one page is judged by its
own wrapper. A constant stays if the page's main positions hold no other text.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_name, materialize, plus, slices

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)/?>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's elements by kind.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NOT_IN_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPE = set("ul ol dl table article section div body nav aside main footer header blockquote form td".split())
OUTSIDE = set("head title nav header footer aside form button select option menu dialog object audio video canvas".split())
MAIN = {"article", "main"}
BOILER = re.compile(r"(?:^|[^a-z])(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|header|masthead|footer|foot|comments?|disqus|repl(?:y|ies)|respond|cookies?|consent|notices?|alert|popup|modal|share|sharing|social|related|recommend\w*|newsletter|subscribe|breadcrumbs?|pager|pagination|login|search|copyright|toolbar|widget|tags?)(?:$|[^a-z])")
BODY = re.compile(r"(?:^|[^a-z])(?:article|content|main|post|entry|story|body)(?:$|[^a-z])")


@functools.lru_cache(10_000)
def _common(mark: str) -> str:
    """A mark without what only one page may have: numbers, and of titles all but the words that tell slots."""
    mark = re.sub(r"[0-9]+", "#", re.sub(r"[0-9a-f]{8,}", lambda m: "#" if re.search("[0-9]", m[0]) else m[0], mark))
    if len(mark) > 32 or len(re.findall("[-_]", mark)) > 3:
        words = sorted((m.start(), m[0].strip("-_.# ")) for r in (BOILER, BODY) for m in r.finditer(mark))
        mark = "-".join([*dict.fromkeys(w for _, w in words), "#"])
    return mark


def blocks(page: str) -> list[tuple[str, str, int, int]]:
    """(path, text, characters in links, elements that are open since before the block ahead) of each block of text, in page order."""
    stack: list[tuple[str, str]] = []
    out: list[tuple[str, str, int, int]] = []
    path = ""
    held: list[str] = []
    in_link = links = at = low = 0

    def flush() -> None:
        nonlocal held, links, low
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text:
                out.append((path, text, links, low))
                low = len(stack)
            held, links = [], 0

    def text(part: str) -> None:
        nonlocal links
        if part:
            held.append(part)
            if in_link:
                links += len(part)

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not m[2]
            elif name == "br":
                held.append(" ")
            continue
        flush()
        in_link = 0
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            shut = CLOSES.get(name, set()) | ({"p"} if name in NOT_IN_P else set())
            while stack and stack[-1][0] in shut:
                stack.pop()
            if name in VOID:
                continue
            mark = ".".join(_common(x.lower()) for a in ATTRIBUTE.finditer(m[4] or "") for x in (a[1] or a[2] or a[3] or "").split())
            stack.append((name, f"{name}.{mark}" if mark else name))
        low = min(low, len(stack) - (not m[2]))
        path = ">".join(s for _, s in stack)
    text(page[at:])
    flush()
    return out


# Expressions: lists of slots' paths, ["+", ...] repeated and ["?", ...] optional groups.


def fold(seq: list, widest: int = 8) -> list:
    """Makes side-by-side repeats repeated groups."""
    changed = True
    while changed:
        changed = False
        for w in range(1, widest + 1):
            i = 0
            out: list = []
            while i < len(seq):
                body = seq[i : i + w]
                if len(body) == w and (w > 1 or body[0][0] != "+"):
                    j = i + w
                    while seq[j : j + w] == body:
                        j += w
                    group = ["+", *body]
                    if j > i + w or (w == 1 and seq[i + 1 : i + 2] == [group]):
                        if seq[j : j + 1] == [group]:
                            j += 1
                        out.append(group)
                        i = j
                        changed = True
                        continue
                if out and out[-1] == ["+", *body] and w == len(body):
                    i += w
                    changed = True
                    continue
                out.append(seq[i])
                i += 1
            seq = out
    return seq


def _required(item: object) -> object:
    while isinstance(item, list) and item[0] == "?" and len(item) == 2:
        item = item[1]
    return item


def align(a: list, b: list) -> list:
    """One expression for two: what only one has becomes optional, and a group takes in its single form."""
    bare = lambda x: _required(x)[1] if isinstance(_required(x), list) and len(_required(x)) == 2 else _required(x)
    ka, kb = [json.dumps(bare(x)) for x in a], [json.dumps(bare(x)) for x in b]
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                rx, ry = _required(x), _required(y)
                body = rx if isinstance(rx, list) else ry
                out.append(["?", body] if x is not rx or y is not ry else body)
        else:
            for x in [*a[i:j], *b[k:m]]:
                out.append(x if isinstance(x, list) and x[0] == "?" else ["?", x])
    return fold(out)


class Wrapper:
    """An expression's positions, and how pages are matched against it."""

    def __init__(self, expression: list):
        self.labels: list[str] = []
        self.needed: list[int] = []  # how many positions before each one can't be left out
        self.groups: list[list[tuple[int, int]]] = []  # repeated groups around each position, from the inside
        self._add(expression, False)
        self.needed.append(self.needed[-1] + self._last if self.labels else 0)
        self.at: dict[str, list[int]] = {}
        for i, x in enumerate(self.labels):
            self.at.setdefault(x, []).append(i)

    def _add(self, items: list, optional: bool) -> None:
        for x in items:
            if isinstance(x, str):
                self.needed.append(self.needed[-1] + self._last if self.labels else 0)
                self._last = int(not optional)
                self.labels.append(x)
                self.groups.append([])
            else:
                begin = len(self.labels)
                self._add(x[1:], optional or x[0] == "?")
                if x[0] == "+":
                    for g in self.groups[begin:]:
                        g.append((begin, len(self.labels)))

    def step(self, p: int, c: int) -> int:
        """Positions that have to be left out to go from p to c; a leap back outside a repeated group costs as much as the whole."""
        if c > p:
            return self.needed[c] - self.needed[p + 1]
        for i, j in self.groups[p]:
            if i <= c:
                return self.needed[j] - self.needed[p + 1] + self.needed[c] - self.needed[i]
        return 1 + len(self.labels)

    def match(self, tokens: list[str]) -> list[int]:
        """The position of each token on the cheapest path, ties to earlier positions; -1 for a token that the wrapper hasn't."""
        ways: dict[int, tuple[int, tuple | None]] = {-1: (0, None)}
        for t in tokens:
            new = {}
            for c in self.at.get(t, ()):
                cost, p = min((w[0] + (self.step(q, c) if q >= 0 else self.needed[c]), q) for q, w in ways.items())
                new[c] = (cost, (c, ways[p][1]))
            ways = new or {q: (w[0], (-1, w[1])) for q, w in ways.items()}
        path = min((w[0], q) for q, w in ways.items())[1]
        out, x = [], ways[path][1]
        while x:
            out.append(x[0])
            x = x[1]
        return out[::-1]


@functools.lru_cache(10_000)
def _outside(path: str) -> bool:
    parts = path.split(">")
    inner = max((i for i, p in enumerate(parts) if p.split(".")[0] in MAIN), default=-1)
    for i, p in enumerate(parts):
        name, _, mark = p.partition(".")
        if name in OUTSIDE and not (name == "header" and i > inner >= 0):
            return True
        if mark and name not in MAIN and name not in ("html", "body") and BOILER.search(mark) and not (BODY.search(mark) and not re.search("comment|sidebar|footer|nav|repl", mark)):
            return True
    return False


def _marked(path: str) -> bool:
    return any(x.split(".")[0] in MAIN or ".main" in x for x in path.split(">"))


def main_slots(slots: list[tuple[int, str]], weights: dict[int, float]) -> set[int]:
    """Which of a page's positions (with their paths) are the main text; weights are those of the host's unmarked positions that vary and aren't left out."""
    path_of = {s: p for s, p in slots if not _outside(p)}
    marked = {s for s, p in path_of.items() if _marked(p)}
    if marked:
        return marked
    own = {s: p for s, p in path_of.items() if s in weights}
    named = {s: p for s, p in own.items() if any(BODY.search(x.partition(".")[2]) for x in p.split(">"))}
    own = named or own
    # the deepest element that still holds most of the text
    total = sum(weights[s] for s in own)
    best = ""
    prefixes = {">".join(p.split(">")[:i]) for p in own.values() for i in range(1, len(p.split(">")) + 1)}
    for x in sorted(prefixes, key=lambda x: (x.count(">"), x)):
        if sum(weights[s] for s, p in own.items() if (p + ">").startswith(x + ">")) >= 0.7 * total and x.count(">") >= best.count(">"):
            best = x
    while best.split(">")[-1].split(".")[0] in {"p", "li", "h1", "h2", "h3", "h4", "td", "pre", "blockquote"} and ">" in best:
        best = best.rpartition(">")[0]
    return {s for s, p in own.items() if (p + ">").startswith(best + ">")}


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(100_000)
def _path_hash(path: str) -> int:
    return _hash(path)


def constants(paths: list[str], texts: list[str], shared: set[tuple[int, int]]) -> list[int | None]:
    """The hash of each block's text where it is shared on the host's pages."""
    if not shared:
        return [None] * len(paths)
    return [h if (_path_hash(p), h := _hash(t)) in shared else None for p, t in zip(paths, texts, strict=True)]


def tokens(paths: list[str], lows: list[int], fixed: list[int | None]) -> list[str]:
    """A page's stream; constants have their text's hash."""
    return [f"{low}|{p}" if c is None else f"{low}|{p}={c}" for p, low, c in zip(paths, lows, fixed, strict=True)]


#: Expressions that are aligned in one task, about.
GROUP = 32
PARSED = {"host": "string", "paths": "array<string>", "texts": "array<string>", "links": "array<int>", "lows": "array<int>"}


def parse(pages: DataFrame, url: str, html: str, names: dict[str, str], keep: list[str]) -> DataFrame:
    """keep's columns with each page's host and blocks; names are those of the new columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, html):
                got = [blocks(x or "") for x in s.column(html).to_pylist()]
                lists = [pa.array([[x[i] for x in g] for g in got], pa.list_(t)) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int32()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array([host_of(u) for u in s.column(url).to_pylist()], pa.string()), *lists], [*keep, *names.values()])

    return pages.select(*dict.fromkeys([*keep, url, html])).mapInArrow(run, plus(pages.select(*keep), {names[k]: v for k, v in PARSED.items()}))


def _rows(b: pa.RecordBatch, names: dict[str, str]) -> Iterator[tuple]:
    return zip(*(b.column(names[c]).to_pylist() for c in PARSED), strict=True)


def shared_texts(parsed: DataFrame, names: dict[str, str]) -> DataFrame:
    """(host, shared): path and text, as hashes, of unmarked blocks that at least three pages and half of those with the path have, as JSON. At most two texts for each of a page's blocks of a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int, int | None], int] = {}
            for host, paths, texts, _, _ in _rows(b, names):
                own = {(_path_hash(p), _hash(t)) for p, t in zip(paths, texts, strict=True) if not _outside(p) and not _marked(p)}
                for k in [(host, p, t) for p, t in own] + [(host, p, None) for p in {p for p, _ in own}]:
                    seen[k] = seen.get(k, 0) + 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, n) for k, n in seen.items()), strict=True) if seen else [[]] * 4, kinds, strict=True)], ["host", "path", "same", "pages"])

    counts = materialize(parsed.select(*names.values()).mapInArrow(run, "host string, path long, same long, pages long").groupBy("host", "path", "same").agg(F.sum("pages").alias("pages")).where("pages >= 3"), "shared")
    whole = counts.where("same is null").select("host", "path", F.col("pages").alias("all"))
    often = counts.where("same is not null").join(whole, ["host", "path"]).where("2 * pages >= all")
    return often.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array("path", "same")))).alias("shared"))


@functools.lru_cache(256)
def _shared(text: str | None) -> set[tuple[int, int]]:
    return {tuple(x) for x in json.loads(text or "[]")}


def wrappers(parsed: DataFrame, shared: DataFrame, names: dict[str, str]) -> DataFrame:
    """(host, wrapper): one expression for each host, as JSON."""
    host = names["host"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {(r[0], json.dumps(fold(tokens(r[1], r[4], constants(r[1], r[2], _shared(sh)))))) for r, sh in zip(_rows(b, names), b.column("shared").to_pylist(), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["host", "wrapper"])

    def merge(t: pa.Table) -> pa.Table:
        one = functools.reduce(align, map(json.loads, sorted(t.column("wrapper").to_pylist())))
        return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [json.dumps(one)]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    kinds = "host string, wrapper string"
    joined = parsed.select(*names.values()).join(shared.withColumnRenamed("host", "its_host"), F.col(host) == F.col("its_host"), "left").drop("its_host")
    found = materialize(joined.mapInArrow(run, kinds).distinct(), "expressions")
    while True:
        number = found.groupBy("host").agg(F.count("*").alias("n"))
        if not number.where("n > 1").limit(1).count():
            return found
        dealt = found.join(number, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / GROUP)))
        found = materialize(dealt.groupBy("host", "part").applyInArrow(merge, kinds).distinct(), "expressions")


@functools.lru_cache(256)
def _wrapper(text: str) -> tuple[Wrapper, dict[tuple[str, ...], list[int]]]:
    return Wrapper(json.loads(text)), {}


def positions(wrapper: str, stream: list[str]) -> list[int]:
    w, known = _wrapper(wrapper)
    key = tuple(stream)
    if key not in known:
        if len(known) > 200:
            known.clear()
        known[key] = w.match(stream)
    return known[key]


def judged(parsed: DataFrame, rules: DataFrame, names: dict[str, str]) -> DataFrame:
    """(host, weights): text that isn't in links for each unmarked position that varies, as JSON."""
    host = names["host"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, int], list] = {}
            for (h, paths, texts, links, lows), w, sh in zip(_rows(b, names), b.column("wrapper").to_pylist(), b.column("shared").to_pylist(), strict=True):
                if all(_outside(p) or _marked(p) for p in paths):
                    continue
                whole: dict[int, list[str]] = {}
                for i, p, t, n in zip(positions(w, tokens(paths, lows, constants(paths, texts, _shared(sh)))), paths, texts, links, strict=True):
                    if i < 0 or _outside(p) or _marked(p):
                        continue
                    x = found.setdefault((h, i), [0, 0, 0, None, None])
                    x[1] += len(t)
                    x[2] += n
                    whole.setdefault(i, []).append(t)
                for i, ts in whole.items():
                    x, c = found[h, i], zlib.crc32(" ".join(ts).encode("utf-8", "replace"))
                    x[0], x[3], x[4] = x[0] + 1, min(c, c if x[3] is None else x[3]), max(c, c if x[4] is None else x[4])
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, *x) for k, x in found.items()), strict=True) if found else [[]] * 7, kinds, strict=True)], ["host", "slot", "pages", "chars", "links", "lo", "hi"])

    joined = parsed.select(*names.values()).join(rules.withColumnRenamed("host", "its_host"), F.col(host) == F.col("its_host")).drop("its_host")
    stats = joined.mapInArrow(run, "host string, slot int, pages long, chars long, links long, lo long, hi long").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fine = stats.where("not (pages >= 3 and lo = hi) and 2 * links <= chars")
    return fine.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("slot", F.greatest(F.lit(0), F.col("chars") - 2 * F.col("links")))))).alias("weights"))


@functools.lru_cache(256)
def _weights(text: str | None) -> dict[int, float]:
    return {int(k): v for k, v in json.loads(text or "{}").items()}


def main_text(paths: list[str], texts: list[str], lows: list[int], wrapper: str, shared: str | None, weights: str | None) -> str:
    """The text of a page's main positions without the template's constants."""
    fixed = constants(paths, texts, _shared(shared))
    place = positions(wrapper, tokens(paths, lows, fixed))
    keep = main_slots(list(zip(place, paths, strict=True)), _weights(weights))
    own = [(t, c) for i, t, c in zip(place, texts, fixed, strict=True) if i in keep]
    return " ".join([t for t, c in own if c is None] or [t for t, _ in own])


def inferred(parsed: DataFrame, names: dict[str, str]) -> DataFrame:
    """(host, wrapper, shared, weights) from all pages of each host."""
    shared = materialize(shared_texts(parsed, names), "constants")
    rules = materialize(wrappers(parsed, shared, names).join(shared, "host", "left"), "wrappers")
    return materialize(rules.join(judged(parsed, rules, names), "host", "left"), "rules")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages' columns (without the markup) with text and n_chars."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    names = {c: column_name(pages, c) for c in PARSED}
    parsed = materialize(parse(pages, url, html, names, keep), "blocks")
    rule = {c: column_name(parsed, c) for c in ("its_host", "wrapper", "shared", "weights")}
    rules = inferred(parsed, names).select(F.col("host").alias(rule["its_host"]), *(F.col(c).alias(rule[c]) for c in ("wrapper", "shared", "weights")))
    joined = parsed.join(rules, F.col(names["host"]) == F.col(rule["its_host"]), "left").drop(rule["its_host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(r[1], r[2], r[4], *x) for r, x in zip(_rows(b, names), zip(*(b.column(rule[c]).to_pylist() for c in ("wrapper", "shared", "weights")), strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*keep, "text", "n_chars"])

    return joined.mapInArrow(run, plus(pages.select(*keep), {"text": "string", "n_chars": "long"}))
