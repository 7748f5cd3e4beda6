"""Go functions: where one stands in a file, its signature in types, and a digest of its body without comments, layout and local names.

Signatures and digests are meant for comparison with each other only. A signature has one type per parameter and result, also where
names share one, so that renaming changes nothing and ``(x, y int)`` equals ``(x int, y int)``. Locals are parameters, named results and what `:=` and `var` declare;
wherever a local's spelling occurs in the body it is replaced by its number, field selectors included. Receivers, the
parameters of function literals and all types in the signature have no part in it. A function without a body has the digest "".
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from factloom.operators.dispatch import classify

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<newline>\n)|(?P<space>[ \t\r]+)|(?P<literal>`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|\.?[0-9](?:[eEpP][+-]|[\w.])*)"
    r"|(?P<word>[^\W\d]\w*)|(?P<sign><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)",
    re.S,
)
# Go's keywords, and those after which a line's end closes a statement.
_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_ENDING = frozenset("break continue fallthrough return".split())


def _tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text), with the semicolons that ends of lines stand for, and without those and commas that a bracket makes needless."""
    out: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(source + "\n"):
        kind, text = m.lastgroup, m.group()
        if kind == "newline" or kind == "comment" and (text.startswith("//") or "\n" in text):
            if text.startswith("//") or not out:
                continue  # a line comment's own newline follows
            last, word = out[-1]
            if last == "literal" or last == "word" and (word not in _KEYWORDS or word in _ENDING) or word in (")", "]", "}", "++", "--"):
                out.append(("sign", ";"))
        elif kind not in ("space", "comment"):
            if text in (")", "}") and out and out[-1][1] in (";", ","):
                out.pop()
            out.append((kind, text))
    return out


def _close(tokens: list[tuple[str, str]], at: int) -> int:
    """The index of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i][1] in ("(", "[", "{")) - (tokens[i][1] in (")", "]", "}"))
        if not depth:
            return i
    return len(tokens) - 1


def _name(token: tuple[str, str]) -> bool:
    return token[0] == "word" and token[1] not in _KEYWORDS


def _parts(group: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """A list's members, split at its own commas."""
    parts, i, start = [], 0, 0
    while i <= len(group):
        if i == len(group) or group[i][1] == ",":
            parts.append(group[start:i])
            start = i + 1
        elif group[i][1] in ("(", "[", "{"):
            i = _close(group, i)
        i += 1
    return [p for p in parts if p]


def _typed(p: list[tuple[str, str]]) -> bool:
    """Whether a member of a list is a name with its type."""
    if len(p) < 2 or not _name(p[0]) or p[1][1] == ".":
        return False
    return p[1][1] != "[" or _close(p, 1) < len(p) - 1


def _declared(group: list[tuple[str, str]]) -> list[str]:
    """The names that a list of parameters or results declares; none if it holds types only."""
    parts = _parts(group)
    return [p[0][1] for p in parts if _name(p[0])] if any(map(_typed, parts)) else []


def _text(tokens: list[tuple[str, str]]) -> str:
    out = ""
    for kind, text in tokens:
        out += " " * bool(out and kind == "word" and (out[-1].isalnum() or out[-1] in "_)}")) + text
    return out


def _types(group: list[tuple[str, str]]) -> list[str]:
    """A type for each parameter or result of a list."""
    parts = _parts(group)
    if not any(map(_typed, parts)):
        return [_text(p) for p in parts]
    out: list[str] = []
    for p in reversed(parts):
        out.append(_text(p[1:]) if _typed(p) or not out else out[-1])
    return out[::-1]


def _names_before(body: list[tuple[str, str]], at: int) -> list[str]:
    out, i = [], at - 1
    while i >= 0 and _name(body[i]):
        out.append(body[i][1])
        if i < 2 or body[i - 1][1] != ",":
            break
        i -= 2
    return out[::-1]


def _names_from(body: list[tuple[str, str]], at: int) -> list[str]:
    out = []
    while at < len(body) and _name(body[at]):
        out.append(body[at][1])
        if at + 1 >= len(body) or body[at + 1][1] != ",":
            break
        at += 2
    return out


def _header(tokens: list[tuple[str, str]], at: int) -> tuple[str, str, int]:
    """(name, type of the receiver or "", index after the name and its type parameters) of the func at ``at``."""
    at, owner = at + 1, ""
    if at < len(tokens) and tokens[at][1] == "(":
        end = _close(tokens, at)
        named = _types(tokens[at + 1 : end])
        owner = re.sub(r"^[*\s(]+|[\[)].*$", "", named[0]) if named else ""
        at = end + 1
    name = tokens[at][1] if at < len(tokens) else ""
    at += 1
    if at < len(tokens) and tokens[at][1] == "[":
        at = _close(tokens, at) + 1
    return name, owner, at


def _signature_end(tokens: list[tuple[str, str]], at: int) -> int:
    """The index of the body's opening brace, of the semicolon where there is no body, or the length."""
    while at < len(tokens) and tokens[at][1] not in ("{", ";"):
        if tokens[at][1] in ("(", "["):
            at = _close(tokens, at)
        elif tokens[at][1] in ("interface", "struct") and at + 1 < len(tokens) and tokens[at + 1][1] == "{":
            at = _close(tokens, at + 1)
        at += 1
    return at


def declaration(source: str | None, name: str, receiver: str = "") -> tuple[str, str] | None:
    """(signature, body digest) of the function, or of the method of the type ``receiver``; None if the file has none."""
    tokens, at = _tokens(source or ""), 0
    while at < len(tokens):
        if tokens[at] == ("word", "func"):
            found, owner, start = _header(tokens, at)
            end = _signature_end(tokens, start)
            after = _close(tokens, end) + 1 if end < len(tokens) and tokens[end][1] == "{" else end
            if (found, owner) == (name, receiver):
                return _signature(tokens, start, end), _digest(tokens[at:after])
            at = after
        elif tokens[at][1] in ("(", "[", "{"):
            at = _close(tokens, at) + 1
        else:
            at += 1
    return None


def _signature(tokens: list[tuple[str, str]], start: int, end: int) -> str:
    close = _close(tokens, start) if start < end else end
    given, back = _types(tokens[start + 1 : close]), tokens[close + 1 : end]
    if back and back[0][1] == "(" and _close(back, 0) == len(back) - 1:
        results = _types(back[1:-1])
    else:
        results = [_text(back)] if back else []
    return f"({', '.join(given)})" + (f" {results[0]}" if len(results) == 1 else f" ({', '.join(results)})" if results else "")


def signature(source: str | None) -> str:
    """The signature of the first function of a text, "" if there is none."""
    tokens = _tokens(source or "")
    at = next((i for i, t in enumerate(tokens) if t == ("word", "func")), None)
    if at is None:
        return ""
    start = _header(tokens, at)[2]
    return _signature(tokens, start, _signature_end(tokens, start))


def body_digest(source: str | None) -> str:
    return _digest(_tokens(source or ""))


def _digest(tokens: list[tuple[str, str]]) -> str:
    at = next((i for i, t in enumerate(tokens) if t == ("word", "func")), len(tokens)) + 1
    if at < len(tokens) and tokens[at][1] == "(":  # a receiver
        at = _close(tokens, at) + 1
    at += 1
    if at < len(tokens) and tokens[at][1] == "[":  # type parameters
        at = _close(tokens, at) + 1
    names: list[str] = []
    while at < len(tokens) and tokens[at][1] != "{":
        if tokens[at][1] == ";":
            return ""
        if tokens[at][1] == "(":
            end = _close(tokens, at)
            if tokens[at - 1][1] != "func":
                names += _declared(tokens[at + 1 : end])
            at = end
        elif tokens[at][1] in ("interface", "struct") and at + 1 < len(tokens) and tokens[at + 1][1] == "{":
            at = _close(tokens, at + 1)
        at += 1
    if at >= len(tokens):
        return ""
    body = tokens[at : _close(tokens, at) + 1]
    for i, (_, text) in enumerate(body):
        if text == ":=":
            names += _names_before(body, i)
        elif text == "var" and i + 1 < len(body) and body[i + 1][1] == "(":
            end = _close(body, i + 1)
            names += [n for j in range(i + 2, end) if j == i + 2 or body[j - 1][1] == ";" for n in _names_from(body, j)]
        elif text == "var":
            names += _names_from(body, i + 1)
    number = {n: f"_v{k}" for k, n in enumerate(x for x in dict.fromkeys(names) if x != "_")}
    return hashlib.sha256("\n".join(number.get(t, t) if k == "word" else t for k, t in body).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_hash(source: pd.Series) -> pd.Series:
    return source.map(body_digest)


@F.pandas_udf(StructType().add("signature", StringType()).add("hash", StringType()))
def declared(source: pd.Series, symbol: pd.Series) -> pd.DataFrame:
    """signature and body digest of `pkg.Func` or `pkg.(Recv).Method` in a file; both null if the file or the function is missing."""

    def one(text: str | None, name: str | None) -> tuple[str | None, str | None]:
        if text is None or not name:
            return None, None
        method = re.search(r"\(([^)]*)\)\.([^.]+)$", name)
        return (declaration(text, method[2], method[1]) if method else declaration(text, name.rpartition(".")[2])) or (None, None)

    return pd.DataFrame([one(*x) for x in zip(source, symbol, strict=True)], columns=["signature", "hash"])


def classify_sources(symbols: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, symbol, change) of symbols (path, symbol), whose files (path, content) were other ones before and after."""
    for side, files in (("before", before), ("after", after)):
        symbols = symbols.join(files.select("path", F.col("content").alias("__text")), "path", "left").withColumn("__d", declared("__text", "symbol"))
        symbols = symbols.select(*[c for c in symbols.columns if not c.startswith("__")], F.col("__d.signature").alias(f"sig_{side}"), F.col("__d.hash").alias(f"hash_{side}"))
    return classify(symbols).select("path", "symbol", "change")
