"""Counts over one text that several operators use."""

from __future__ import annotations

import numpy as np


def _pairs(a: np.ndarray, b: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """Dense numbers for pairs of dense numbers."""
    values, dense = np.unique(a * base + b, return_inverse=True)
    return dense, len(values)


def windows(words: list[bytes], n: int = 5) -> np.ndarray:
    """A number for each n-word window, equal where the windows are equal (exactly: no hashing)."""
    count = len(words) - n + 1
    if count < 1:
        return np.zeros(0, np.int64)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    base = len(names)
    if base**n < 2**62:
        codes = ids[:count].copy()
        for j in range(1, n):
            codes = codes * base + ids[j : j + count]
        return codes
    codes = ids[:count]
    for j in range(1, n):
        codes, _ = _pairs(codes, ids[j : j + count], base)
    return codes


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more in the text, the first occurrence included."""
    codes = windows(words, n)
    if len(codes) < 2:
        return 0
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(codes), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())
