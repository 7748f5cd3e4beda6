"""Operator 7: personal data, plain and disguised, with offsets into the source text.

Plain e-mail addresses, IP addresses, card and phone numbers are found first (the base spans). Then a chain of
transducers rewrites the text: look-alike and compatibility characters to ASCII, invisible characters to nothing,
runs of spelled digits to digits, "at" and "dot" disguises to the signs. Each writes (output, source start, source
end) pieces, so a span found in the rewritten text maps back to source characters. A span is added if a rewritten
piece lies in it and no base span of its kind overlaps it; base spans stay as they are.

All searches are linear in the text: they start only at "@", "+", or the first digit of a run.

Defined results: a null text is empty and has no spans; offsets are code points, end exclusive; of overlapping
added spans of a kind the leftmost counts; equal rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Look-alikes of ASCII letters that Unicode does not fold, and digits spelled in four languages.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u2024": ".", "\u3002": ".", "\u00b7": ".", "\u00a0": " ",
}
SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT_OF = {w: str(i) for words in SPELLED.values() for i, w in enumerate(words.split())} | {"oh": "0"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_WORDS = "|".join(sorted(DIGIT_OF, key=lambda w: (-len(w), w)))
_RUN = re.compile(rf"(?<!\w)(?:(?:plus[ -])?(?:{_WORDS})(?:[ -]{{1,2}}|(?:,| dot| point)? ))(?:(?:{_WORDS}|[0-9]+)(?:[ -]{{1,2}}|(?:,| dot| point)? ))*(?:{_WORDS}|[0-9]+)(?!\w)", re.IGNORECASE)
_PART = re.compile(rf"(?P<plus>plus[ -])|(?P<word>{_WORDS})|(?P<dot> (?:dot|point) )|(?P<gap>[ ,-]+)|[0-9]+", re.IGNORECASE)
_SIGN = re.compile(r"[ \t]{0,3}(?:[\[({<][ ]?(?:(?P<at>at|@|arroba|chez)|(?P<dot>dot|\.|point|punkt|punto))[ ]?[\])}>])[ \t]{0,3}", re.IGNORECASE)
_PROSE = re.compile(r"(?<= )(?P<at>at)(?= )|(?<= )(?P<dot>dot)(?= )|(?P<sign>@)", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_HINT_SIGN = re.compile(r" [dD][oO][tT] |[\[({<] ?(?:[aA][tT]|@|[dD][oO][tT]|\.|arroba|chez|point|punkt|punto) ?[\])}>]")
_HINT_WORDS = tuple(w for words in SPELLED.values() for w in words.split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain identifiers, by start, then kind."""
    found = [(s, e, "email") for s, e in emails(text)]
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(n := x.lstrip("0")) <= 3 and int(n or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15] if "+" in text else []
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


_folded: dict[str, str] = {}


def fold(ch: str) -> str:
    """ASCII for a look-alike, compatibility form or foreign digit; nothing for an invisible character; else itself."""
    if ch not in _folded:
        plain = LOOKALIKES.get(ch) or ("" if ch in INVISIBLE else unicodedata.normalize("NFKC", ch))
        if not plain.isascii() and (digit := unicodedata.decimal(ch, None)) is not None:
            plain = str(digit)
        _folded[ch] = plain if plain.isascii() and len(plain) <= 1 else ch
        if len(_folded) > 100_000:
            return _folded.pop(ch)
    return _folded[ch]


def _changed() -> str:
    """The characters that fold() changes, as ranges of a character class; none is beyond U+1FFFF."""
    codes = [c for c in range(0x80, 0x20000) if (ch := chr(c)) in LOOKALIKES or ch in INVISIBLE or unicodedata.decimal(ch, None) is not None or unicodedata.decomposition(ch)]
    codes = [c for c in codes if fold(chr(c)) != chr(c)]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


#: Something a transducer could rewrite; most texts have nothing of the kind.
_HINT_CHARS = re.compile(f"[\u00a0\u00ad\u00b7\u0131\u0250-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2000-\u209f\u2212\u2460-\u24ff\u3002\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff{_changed()}]")


class Rewritten:
    """A text under rewriting: its pieces that differ, as (start, end) in the text now and in the source."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[tuple[int, int, int, int]] = []  # now start, now end, source start, source end

    def apply(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces [start, end) of the present text, in order and apart from each other."""
        if not changes:
            return
        parts, edits, at, shift = [], [], 0, 0
        old = deque(self.edits)
        for start, end, new in changes:
            parts += (self.text[at:start], new)
            src_start, src_end = self.source(start, end)
            while old and old[0][1] <= start:
                a, b, c, d = old.popleft()
                edits.append((a + shift, b + shift, c, d))
            while old and old[0][0] < end:
                old.popleft()  # swallowed; its source span lies within this one
            edits.append((start + shift, start + shift + len(new), src_start, src_end))
            shift += len(new) - (end - start)
            at = end
        self.edits = edits + [(a + shift, b + shift, c, d) for a, b, c, d in old]
        self.text = "".join([*parts, self.text[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of the present [start, end)."""
        return self._left(start), self._right(end)

    def _left(self, at: int) -> int:
        i = bisect_right(self.edits, at, key=lambda e: e[0]) - 1
        while i >= 0 and self.edits[i][0] == self.edits[i][1] == at:  # deleted just before: not part of what follows
            return self.edits[i][3]
        if i < 0:
            return at
        a, b, c, d = self.edits[i]
        return c if at < b else d + at - b

    def _right(self, at: int) -> int:
        i = bisect_right(self.edits, at - 1, key=lambda e: e[0]) - 1
        if i < 0:
            return at
        a, b, c, d = self.edits[i]
        return d if at <= b else d + at - b

    def touched(self, start: int, end: int) -> bool:
        i = bisect_right(self.edits, start, key=lambda e: e[1])
        while i < len(self.edits) and self.edits[i][0] < end:
            if self.edits[i][1] > start:
                return True
            i += 1
        return False


def _prose_signs(r: Rewritten) -> list[tuple[int, int, str]]:
    """Changes for `name at host dot tld`: an at or @ with a name before it and a host with at least one disguised dot after it.

    A dot that was rewritten before counts as disguised; a plain one may stand between others, but does not make a host
    of what follows an at.
    """
    out: list[tuple[int, int, str]] = []
    text, marks = r.text, list(_PROSE.finditer(r.text))
    for k, m in enumerate(marks):
        wide = 0 if m["sign"] else 1  # the spaces around a word belong to the disguise
        if m["dot"] or m.start() < 1 + wide or text[m.start() - wide - 1] not in LOCAL:
            continue
        label, j, dots, hidden, good = _LABEL.match(text, m.end() + wide), k + 1, [], False, -1
        while label:
            end, ok = label.end(), hidden and len(label[0]) >= 2 and label[0].isalpha()
            if j < len(marks) and marks[j]["dot"] and marks[j].start() == end + 1 and (label := _LABEL.match(text, marks[j].end() + 1)):
                dots.append(marks[j])
                hidden, j = True, j + 1
            elif text[end : end + 1] == "." and (label := _LABEL.match(text, end + 1)):
                rewritten = r.touched(end, end + 1)
                good, hidden = len(dots) if ok and not rewritten else good, hidden or rewritten
            else:
                good = len(dots) if ok else good
                break
        if good > 0 or good == 0 and m["at"]:
            before, i = [], k - 1
            left = m.start() - wide
            while i >= 0 and marks[i]["dot"] and _one_word(text[marks[i].end() + 1 : left]) and marks[i].start() >= 2 and text[marks[i].start() - 2] in LOCAL:
                before.append(marks[i])
                left, i = marks[i].start() - 1, i - 1
            signs = [*reversed(before), *([] if m["sign"] else [m]), *dots[:good]]
            out += [(x.start() - 1, x.end() + 1, "." if x["dot"] else "@") for x in signs]
    return [c for k, c in enumerate(out) if not k or c[0] >= out[k - 1][1]]


def _one_word(s: str) -> bool:
    return bool(s) and all(c in LOCAL for c in s)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Changes for runs of spelled digits of at least four digits in all."""
    out = []
    for run in _RUN.finditer(text):
        parts = list(_PART.finditer(text, *run.span()))
        if sum(1 if p["word"] else len(p[0]) for p in parts if p["word"] or p[0].isdigit()) < 4:
            continue
        for k, p in enumerate(parts):
            if p["word"]:
                out.append((*p.span(), DIGIT_OF[p["word"].lower()]))
            elif p["plus"]:
                out.append((*p.span(), "+"))
            elif p["dot"]:
                out.append((*p.span(), "."))
            elif p["gap"] and 0 < k < len(parts) - 1:
                out.append((*p.span(), ""))
    return out


def rewrite(text: str) -> Rewritten | None:
    """The text after all transducers, None if none has anything to do."""
    chars = _HINT_CHARS.search(text)
    low = text.lower() if not chars else ""
    spelled = bool(chars) or sum(low.count(w) for w in _HINT_WORDS) >= 2 and _RUN.search(text)
    if not (chars or spelled or _HINT_SIGN.search(text)):
        return None
    r = Rewritten(text)
    if chars:
        r.apply([(m.start(), m.end(), new) for m in _HINT_CHARS.finditer(text) if (new := fold(m[0])) != m[0]])
    r.apply([(*m.span(), "@" if m["at"] else ".") for m in _SIGN.finditer(r.text) if _inside(r.text, m)])
    if spelled:
        r.apply(_spelled(r.text))
    r.apply(_prose_signs(r))
    return r if r.edits else None


def _inside(text: str, m: re.Match) -> bool:
    """Whether letters or digits touch the disguised sign on both sides."""
    return 0 < m.start() and m.end() < len(text) and text[m.start() - 1].isalnum() and text[m.end()].isalnum()


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and added spans), each by start, then kind."""
    base = base_spans(text)
    r = rewrite(text)
    if not r:
        return base, base
    plain = {kind: [x for x in base if x[2] == kind] for kind in KINDS}  # apart from each other, so their ends ascend too
    added: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)  # where the last added span of a kind ends
    for start, end, kind in base_spans(r.text):
        if r.touched(start, end):
            s, e = r.source(start, end)
            before = bisect_left(plain[kind], e, key=lambda x: x[0]) - 1
            if s >= free[kind] and (before < 0 or plain[kind][before][1] <= s):
                added.append((s, e, kind))
                free[kind] = e
    return base, sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    parts, at = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            parts += (text[at:s], f"<{kind.upper()}>")
        at = max(at, e)
    return "".join([*parts, text[at:]])


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, the digest of the base spans and all spans, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "")
                rows.append((*(sum(k == kind for _, _, k in base) for kind in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield table(batch, ("text",), **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, cols, strict=False)}, base_sha256=pa.array(cols[4], pa.string()), spans=pa.array(cols[5], pa.string()))

    schema = docs.select("doc_id").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def mask_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in text, n_chars brought up to date, and all other columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [x if x is None else mask(x, all_spans(x)[1]) for x in batch.column(i).to_pylist()]
            yield batch.set_column(i, "text", pa.array(texts, batch.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
