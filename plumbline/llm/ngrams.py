"""Hashed character n-grams of whole texts, as arrays."""

from __future__ import annotations

import sys

import numpy as np

_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def folded(text: str) -> np.ndarray:
    """Lower-case code points; runs of anything but letters become one space, with one at either end. Empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as its space
    points = points[keep]
    if points[0] != 32:
        points = np.concatenate([np.array([32], np.uint32), points])
    return points if points[-1] == 32 else np.concatenate([points, np.array([32], np.uint32)])


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Unsigned 32-bit hashes of all runs of n code points, in order."""
    if len(points) < n:
        return np.empty(0, np.uint32)
    h = points[: len(points) - n + 1] * np.uint32(0x9E3779B1)
    for i in range(1, n):
        h ^= h >> np.uint32(15)
        h += points[i : len(points) - n + 1 + i]
        h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
