"""Statistics of one text, by numpy over its bytes and words. Words are runs of anything but ASCII white space."""

from __future__ import annotations

import math

import numpy as np

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "exclaim", "pipes", "distinct", "top_share", "long_word", "line_words", "lines", "high_bytes", "byte_entropy", "marked_ends", "letters", "adjacent")
WINDOW = 8
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_MARKS = frozenset(b"#*$%&|<>!")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of eight words found twice or more."""
    n = len(ids)
    if n <= WINDOW:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _PRIME
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    m, h = n - WINDOW + 1, np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h += mixed[k : k + m] * _POWERS[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def stats(text: str) -> tuple[list[int], list[float]]:
    """The counts of BASE and the figures of MORE."""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, size = len(words), len(raw)
    chars = size - int(hist[0x80:0xC0].sum())
    word_chars, symbols = chars - int(hist[_BLANKS].sum()), int(hist[_SYMBOLS].sum())
    seen, dup, filled = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            filled += 1
            dup += line in seen
            seen.add(line)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    base = [n, word_chars, symbols, dup, repeats]
    w, c = max(n, 1), max(word_chars, 1)
    share = hist[hist > 0] / max(size, 1)
    letters = int(hist[65:91].sum() + hist[97:123].sum())
    more = [
        math.log1p(n), word_chars / w, symbols / w, dup / max(filled, 1), repeats / w, int(hist[65:91].sum()) / c, int(hist[48:58].sum()) / c, int(hist[_PUNCT].sum()) / c,
        int(hist[33]) / w, int(hist[124]) / w, len(index) / w, (int(np.bincount(ids).max()) if n else 0) / w, max(map(len, words), default=0), n / max(filled, 1), filled,
        int(hist[0x80:].sum()) / max(size, 1), float(-(share * np.log2(share)).sum()), sum(x[-1] in _MARKS for x in words) / w, letters / c, (int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0) / w,
    ]
    return base, more
