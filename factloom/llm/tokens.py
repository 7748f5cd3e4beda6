"""Token ids of whole texts, as the tokenizers library gives them, for the packing and the binary output.

Two public vocabularies are much faster to apply by another path that gives the same ids: byte-level BPE files through
tiktoken with the same ranks, word BPE files by encoding each distinct word of a batch once. Both are used only for
texts of plain Latin-1 characters, on which the pre-tokenizers of the libraries agree; all others go through
the tokenizers library itself.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
# Fixed value: the pre-tokenizer pattern of the public byte-level vocabulary.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The word vocabulary's pattern 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+ within lower-case Latin-1.
_L, _N = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
#: Distinct words kept per worker (about 200 MB).
MEMO_WORDS = 1_000_000

#: Characters of text that are tokenised together.
CHUNK_CHARS = 4_000_000

_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = None
        model, before = spec["model"], spec["pre_tokenizer"]
        if model.get("end_of_word_suffix") == "</w>" and spec["normalizer"]:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
            self.words = Tokenizer.from_file(path)  # the same model for words that are split and normalised already
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.words.encode_special_tokens = True
            self._forget()
            self.fast = self._by_words
        elif before["type"] == "ByteLevel" and not before["add_prefix_space"] and not spec["normalizer"]:
            import tiktoken

            special = {t["id"] for t in spec["added_tokens"]}
            chars = _byte_chars()
            ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if i not in special}
            self.tiktoken = tiktoken.Encoding("plain", pat_str=_BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fast = lambda texts: [np.array(self.tiktoken.encode_ordinary(t), np.uint32) for t in texts]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as uint32; some CHUNK_CHARS of text at a time."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            yield from self._encode(texts[at:end])
            at = end

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and not _PLAIN.search(t) for t in texts]
        quick = iter(self.fast([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        return [next(quick) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, plain, strict=True)]

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        """Looks each word up in a memo of ids; new words are encoded by the library, many at a time."""
        words = [_WORD.findall(t.lower()) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        new = list(set(itertools.chain.from_iterable(words)) - self.memo.keys())
        parts = []
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = np.array(self.words.encode("\n".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # a word whose ids do not end as words do
                each = [np.array(self.library.encode(w, add_special_tokens=False).ids, np.uint32) for w in part]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            parts.append((ids, np.diff(ends, prepend=0)))
        if parts:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *(x for x, _ in parts)])
            self.sizes = np.concatenate([self.sizes, *(n for _, n in parts)])
            self.starts = np.cumsum(self.sizes) - self.sizes
        counts = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(counts.sum()))
        sizes = self.sizes[index]
        before = np.cumsum(sizes) - sizes
        out = self.flat[np.repeat(self.starts[index] - before, sizes) + np.arange(int(sizes.sum()))]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.split(out, total[np.cumsum(counts)[:-1]])


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}
