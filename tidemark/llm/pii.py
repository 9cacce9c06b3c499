"""Personal data, also in disguise, with spans in the source text.

Plain patterns are found in the text as it is. Then a chain of transducers rewrites the text: look-alike letters and
digits become ASCII, spelled digits become digits, and "at" and "dot" in words or brackets become @ and full stops.
Each rewritten character remembers which source characters it stands for, so that what the same patterns find in the
rewritten text is mapped back to spans of the source. Such a span is added unless it overlaps a plain one of its kind.

Defined cases: null text is an empty text (no spans); texts of any length are read whole, one at a time; ties can't occur, since spans of a kind don't overlap; repeated
rows are repeated in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import plus, slices

Span = tuple[int, int]

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d += d * (i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in s.split("."))


def find(text: str) -> dict[str, list[Span]]:
    """Plain spans of each kind: leftmost, not overlapping; a match that fails its test is dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = [m.span() for m in EMAIL.finditer(text)]
    if re.search("[0-9]", text):
        out["ip"] = [m.span() for m in IP.finditer(text) if _is_ip(m[0])]
        out["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like ASCII ones, and spelled digits of four languages.
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_NUMBER})|plus|[0-9]+)(?:[\x20.,-]{{1,2}}(?:(?:dot|punkt|point|punto)[\x20.,-]{{1,2}})*(?:(?:{_NUMBER})|[0-9]+)(?![^\W_]))+", re.I)
_WORD = re.compile(r"[^\W\d_]+|[0-9]+|[\x20.,-]+")
_AT_BOX = r"[\x20]*[\[({<][\x20]*(?:at|@|arroba|arobase)[\x20]*[\])}>][\x20]*"
_AT = _AT_BOX + r"|[\x20]+(?:at|arroba|arobase)[\x20]+"
_DOT = r"[\x20]*[\[({<][\x20]*(?:dot|\.|punkt|point|punto)[\x20]*[\])}>][\x20]*|[\x20]+(?:dot|punkt|point|punto)[\x20]+"
_MAIL = re.compile(rf"[A-Za-z0-9._%+-]+(?:(?:{_DOT})[A-Za-z0-9_%+-]+)*(?:{_AT_BOX}|@)[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)+", re.I)
_MAIL_PART = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_ADDRESS = re.compile(rf"[0-9]{{1,3}}(?:(?:{_DOT})[0-9]{{1,3}}){{3}}", re.I)
#: What a disguise can't do without (in RE2's syntax too): letters of other scripts, unbroken blanks, raised digits, bracketed signs, "at" before a host, spelled digits in a row.
_HINT_TEXT = (
    r"[^\x00-\x{24F}]|[\x{A0}\x{AD}\x{B2}\x{B3}\x{B9}]|(?i:[\[({<] *(?:at|@|arroba|arobase|dot|\.|punkt|point|punto) *[\])}>]|\b(?:at|arroba|arobase) +[A-Za-z0-9-]+(?:\.[A-Za-z0-9]| +(?:dot|punkt|point|punto)\b)"
    r"|(?:[0-9]|\b(?:" + _NUMBER + r")) +(?:dot|punkt|point|punto) +(?:[0-9]|(?:" + _NUMBER + r")\b)|\b(?:" + _NUMBER + r")[ .,-]+(?:" + _NUMBER + r")[ .,-]+(?:" + _NUMBER + r")\b"
    r"|\b(?:" + _NUMBER + r")[ .,-]{1,2}[0-9]|[0-9][ .,-]{1,2}(?:" + _NUMBER + r")\b|\bplus[ .,-]{1,2}(?:" + _NUMBER + r"|[0-9]))"
)
_HINT = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", _HINT_TEXT))
#: Last labels that a host in plain words must have after a full stop, or after a word for it other than "dot", which may be a word of the sentence.
_LAST = "com|org|net|edu|gov|info|io|co|uk|eu|de|fr|es|at|ch|us|ai|dev|app|me|example|test|invalid"
_BARE = re.compile(rf"[A-Za-z0-9._%+-]+(?:[\x20]+(?:dot|punkt|point|punto)[\x20]+[A-Za-z0-9_%+-]+)*[\x20]+(?:at|arroba|arobase)[\x20]+[A-Za-z0-9-]+(?:(?:[\x20]+(?:dot|punkt|point|punto)[\x20]+|\.)[A-Za-z0-9-]+)*(?:[\x20]+dot[\x20]+[A-Za-z]{{2,63}}|(?:[\x20]+(?:punkt|point|punto)[\x20]+|\.)(?:{_LAST}))(?![\w-])", re.I)

Traced = tuple[str, list[int], list[int]]


def _rewrite(t: Traced, pattern: re.Pattern, by: Callable[[re.Match], list[tuple[int, int, str]]]) -> Traced:
    """Replaces parts of t; a replacement stands for all source characters of what it replaces."""
    text, lo, hi = t
    out, a, b, at = [], [], [], 0
    for m in pattern.finditer(text):
        for i, j, new in by(m):
            out.append(text[at:i])
            a += lo[at:i]
            b += hi[at:i]
            out.append(new)
            a += [lo[i]] * len(new)
            b += [hi[j - 1]] * len(new)
            at = j
    return "".join(out) + text[at:], a + lo[at:], b + hi[at:]


def _plain_letters(text: str) -> Traced:
    out, lo, hi = [], [], []
    for i, c in enumerate(text):
        if c > "\x7f":
            if c in _INVISIBLE:
                continue
            c = LOOKALIKES.get(c) or (n if len(n := unicodedata.normalize("NFKC", c)) == 1 and n < "\x80" else str(unicodedata.digit(c, c)))
        out.append(c)
        lo.append(i)
        hi.append(i + 1)
    return "".join(out), lo, hi


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Spelled digits of a run as digits without what parts them; "plus" and "dot" as signs."""
    out = []
    for w in _WORD.finditer(m[0]):
        word = w[0].lower()
        new = SPELLED.get(word) or {"plus": "+", "dot": ".", "punkt": ".", "point": ".", "punto": "."}.get(word) or ("" if word.strip(" .,-") == "" else word)
        out.append((m.start() + w.start(), m.start() + w.end(), new))
    return out if any(w[0].lower() in SPELLED or w[0].lower() == "plus" for w in _WORD.finditer(m[0])) else []


def _signs(m: re.Match) -> list[tuple[int, int, str]]:
    return [(m.start() + p.start(), m.start() + p.end(), "@" if p["at"] else ".") for p in _MAIL_PART.finditer(m[0])]


def disguised(text: str) -> dict[str, list[Span]]:
    """Spans that show only once the text is rewritten."""
    if not _HINT.search(text):
        return {k: [] for k in KINDS}
    t = _plain_letters(text)
    t = _rewrite(t, _RUN, _spelled)
    t = _rewrite(t, _MAIL, _signs)
    t = _rewrite(t, _BARE, _signs)
    t = _rewrite(t, _ADDRESS, _signs)
    if t[0] == text:
        return {k: [] for k in KINDS}
    return {k: [(t[1][i], t[2][j - 1]) for i, j in v] for k, v in find(t[0]).items()}


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans; and all spans."""
    base = find(text)
    more = disguised(text)
    both = {k: sorted([*base[k], *(s for s in more[k] if not any(s[0] < e and b < s[1] for b, e in base[k]))]) for k in KINDS}
    return base, both


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


_ANY = "[0-9@]|" + _HINT_TEXT


def detect(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """docs' other columns with n_email, n_ip, n_card, n_phone (plain spans), base_sha256 and spans; with redact also the text, each span of which is replaced by its kind in brackets."""
    made = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"} | ({text: "string"} if redact else {})
    keep = [c for c in docs.columns if c not in made and c != text]
    schema = plus(docs.select(*keep), made)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, text):
                n = s.num_rows
                col = s.column(text)
                maybe = pc.fill_null(pc.match_substring_regex(col, _ANY), False).to_numpy(zero_copy_only=False)
                count = {k: [0] * n for k in KINDS}
                sha, spans, new = [none] * n, [""] * n, col.to_pylist() if redact else []
                for i in maybe.nonzero()[0].tolist():
                    t = col[i].as_py()
                    base, every = all_spans(t)
                    for k in KINDS:
                        count[k][i] = len(base[k])
                    sha[i] = hashlib.sha256(listed(base).encode()).hexdigest()
                    spans[i] = listed(every)
                    if redact:
                        new[i] = redacted(t, every)
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), *(pa.array(count[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), *([pa.array(new, pa.string())] if redact else [])], [*keep, *made])

    return docs.select(*keep, text).mapInArrow(run, schema)


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """Overlapping spans are replaced as one, by the kind of the first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
