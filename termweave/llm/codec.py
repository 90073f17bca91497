"""Tokenizer access for worker processes, with bounded per-worker caches of pre-tokens.

A pre-token is encoded once per worker and then looked up. Texts outside the range of characters for which the
splitting pattern is certain, and texts that hold a special token's string, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

# Letters and numbers up to U+024F, as the Unicode classes L and N have them.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
# No separators U+001C-001F, U+0085, U+00A0 and no U+0130, on which libraries differ; some general punctuation.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f¡-įı-ɏ‐-‧‰-›]*")
# Where texts are lower-cased first, only letters whose lower case lies in the same range.
_PLAIN_WORD = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f¡-įı-ſ‐-‧‰-›]*")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# Words come first: no short form starts like one.
_BYTE = re.compile(rf" ?[{_L}]+|{_SHORT}| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD = re.compile(rf"[{_L}]+|{_SHORT}|[{_N}]|[^\s{_L}{_N}]+")
_BLANK_WORD = re.compile(rf" [{_L}]+").fullmatch

CACHE_ENTRIES = 600_000
#: So many pre-tokens are encoded as one text.
JOINED = 500
_CODECS: dict[tuple, Codec] = {}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Codec:
    """Splits a text into pre-tokens and keeps a value per pre-token.

    kind "byte": byte-level pre-tokens with leading blanks; kind "word": lower-cased words without white space;
    anything else: texts always go to the library whole.
    """

    def __init__(self, path: str, kind: str, limit: int = CACHE_ENTRIES):
        self.tok, self.kind, self.limit = load_tokenizer(path), kind, limit
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.width = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.plain = (_PLAIN_WORD if kind == "word" else _PLAIN).fullmatch
        vocab = self.tok.get_vocab()
        self.mark = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.mark[[i for w, i in vocab.items() if (w.endswith("</w>") if kind == "word" else w.startswith("\u0120"))]] = True
        self.pinned: dict = {}
        self.cache: dict = {}

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens, or None where only the library can tell."""
        if self.kind not in ("byte", "word") or not (text.isascii() and not _has_rare(text) or self.plain(text)):
            return None
        if any(s in text for s in self.specials):
            return None
        return _BYTE.findall(text) if self.kind == "byte" else _WORD.findall(text.lower())

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, as bytes.

        Most are encoded joined, which is faster, and cut where a token is marked as a word's last, or as the first of a
        word after a blank. Where the cuts don't fit, each is encoded by itself.
        """
        if self.kind == "word":
            return self._joined(words, " ", last=True)
        plain, rest = [], []
        for w in words:
            (plain if _BLANK_WORD(w) else rest).append(w)
        words[:] = plain + rest
        return self._joined(plain, "", last=False) + self._each(rest)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, self.width).tobytes() for ids in self.whole(words)]

    def _joined(self, words: list[str], by: str, last: bool) -> list[bytes]:
        ids = np.array(self.whole([by.join(words)])[0], self.width)
        cuts = np.flatnonzero(self.mark[ids])
        if not words or len(cuts) != len(words):
            return self._each(words)
        data, size = ids.tobytes(), self.width.itemsize
        ends = ((cuts + 1) * size if last else np.append(cuts[1:], len(ids)) * size).tolist()
        return [data[p:q] for p, q in zip([0, *ends[:-1]], ends, strict=True)]

    def fill(self, splits: list, count: bool = False) -> dict:
        """Make sure that every pre-token of the batch is in the cache: with its ids, or only their number."""
        need: set[str] = set()
        for words in splits:
            if words:
                need.update(words)
        miss = list(need.difference(self.cache))
        if miss and len(self.cache) + len(miss) > self.limit + len(self.pinned):
            self.cache = dict(self.pinned)
            miss = list(need.difference(self.cache))
        size = self.width.itemsize
        for i in range(0, len(miss), JOINED):
            part = miss[i : i + JOINED]
            got = self.parts(part)
            self.cache.update(zip(part, (len(x) // size for x in got) if count else got, strict=True))
        return self.cache

    def counts(self, texts: list[str]) -> list[int]:
        splits = [self.split(t) for t in texts]
        get = self.fill(splits, count=True).__getitem__
        return [sum(map(get, w)) if w is not None else len(self.whole([t])[0]) for w, t in zip(splits, texts, strict=True)]

    def ids(self, texts: list[str]):
        """An array of ids for each text, one at a time."""
        splits = [self.split(t) for t in texts]
        get = self.fill(splits).__getitem__
        for w, t in zip(splits, texts, strict=True):
            yield np.frombuffer(b"".join(map(get, w)), self.width) if w is not None else np.array(self.whole([t])[0], self.width)


def _has_rare(text: str, _find=re.compile("[\x1c-\x1f]").search) -> bool:
    return _find(text) is not None


def codec(path: str, kind: str, use: str, limit: int = CACHE_ENTRIES) -> Codec:
    """The worker's codec for one use; it outlives the task."""
    key = (path, kind, use, limit)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, kind, limit)
    return _CODECS[key]


def kind_of(path: str) -> str:
    """Which splitter fits a tokenizer file; read on the driver."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    parts = pre.get("pretokenizers") or [{}]
    names = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    wanted = _SHORT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if names == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern", {}).get("Regex") == wanted:
        return "word"
    return "whole"
