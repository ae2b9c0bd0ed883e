"""Burrows-Wheeler transforms of string collections, merged without sorting suffixes again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Symbols packed into the first sort: 7 of 9 bits.
PACKED = 7


@dataclass
class Transform:
    """Transform of a collection in suffix order.

    ``bwt`` is the symbol before each suffix (0: the suffix is a whole string), ``heads``
    the first symbol of each (0: the end of a string), ``place`` where it starts in the
    concatenation, ``longest`` the longest string with its end. Suffixes equal up to their
    ends are in the order of their strings.
    """

    bwt: np.ndarray
    heads: np.ndarray
    place: np.ndarray
    longest: int

    def following(self) -> np.ndarray:
        """Rank of the suffix one symbol later; the end of a string stays where it is."""
        # Suffixes sorted by the symbol before them are the suffixes that begin with it.
        out = np.argsort(self.bwt, kind="stable").astype(np.int32)
        ends = int(np.searchsorted(self.heads, 0, "right"))
        out[:ends] = np.arange(ends)
        return out


def transform(flat: np.ndarray, sizes: np.ndarray, base: int = 0) -> Transform:
    """Transform of strings given as bytes in a row and their sizes.

    Prefix doubling: suffixes are sorted by 7 symbols, then by pairs of ranks, until the
    longest string is covered.
    """
    total = len(flat) + len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(total + PACKED, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    text[:total][inside] = flat.astype(np.int64) + 1
    end_of = np.repeat(ends, sizes + 1)
    at = np.arange(total)
    longest = int(sizes.max(initial=0)) + 1

    key = np.zeros(total, np.int64)
    for j in range(PACKED):
        key = key << 9 | np.where(at + j <= end_of, text[at + j], 0)
    depth = PACKED
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if depth >= longest or rank[order[-1]] == total - 1:
            break
        key = rank * total + rank[np.minimum(at + depth, end_of)]
        depth *= 2
    before = np.zeros(total, np.int16)
    before[1:] = text[: total - 1]
    return Transform(before[order], text[order].astype(np.int16), order + base, longest)


def _interleave(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of the values of two sorted arrays in their common order."""
    new_a = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    new_b = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
    ua, ub = a[new_a], b[new_b]
    at = np.searchsorted(ua, ub)
    common = np.zeros(len(ub), bool)
    common[at < len(ua)] = ua[at[at < len(ua)]] == ub[at < len(ua)]
    only = ub[~common]
    id_a = np.arange(len(ua)) + np.searchsorted(only, ua)
    id_b = np.empty(len(ub), np.int64)
    id_b[common] = id_a[at[common]]
    id_b[~common] = np.arange(len(only)) + at[~common]
    return id_a[np.cumsum(new_a) - 1], id_b[np.cumsum(new_b) - 1]


def merge(a: Transform, b: Transform) -> Transform:
    """Transform of both collections, strings of ``a`` first.

    The interleave of the two suffix orders is refined step by step: knowing it for the
    first d symbols, a suffix is placed for 2d symbols by its place and that of the suffix
    d later. Each side is already in order, so a step only merges two sorted lists.
    """
    longest = max(a.longest, b.longest)
    fa, fb = a.following(), b.following()
    ca, cb = _interleave(a.heads.astype(np.int64), b.heads.astype(np.int64))
    depth = 1
    while depth < longest:
        width = max(int(ca[-1]), int(cb[-1])) + 1
        ca, cb = _interleave(ca * width + ca[fa], cb * width + cb[fb])
        depth *= 2
        if depth < longest:
            fa, fb = fa[fa], fb[fb]
    # What is still level is equal up to the ends: strings of a come first.
    at_a = np.arange(len(ca)) + np.searchsorted(cb, ca, "left")
    at_b = np.arange(len(cb)) + np.searchsorted(ca, cb, "right")

    def woven(x, y):
        out = np.empty(len(x) + len(y), x.dtype)
        out[at_a], out[at_b] = x, y
        return out

    return Transform(
        woven(a.bwt, b.bwt), woven(a.heads, b.heads), woven(a.place, b.place), longest
    )


def merge_all(parts: list[Transform]) -> Transform:
    """Neighbours are merged until one transform is left."""
    while len(parts) > 1:
        pairs = [merge(x, y) for x, y in zip(parts[::2], parts[1::2])]
        parts = pairs + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def repeated_intervals(t: Transform, depth: int) -> np.ndarray:
    """Number of the interval of suffixes with the same first ``depth`` symbols, in order.

    Two neighbours share a prefix of ``depth`` symbols if and only if the numbers are the
    same; intervals for d symbols come from those for d/2 in one pass.
    """
    def dense(key):
        return np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))

    # What is left after the last doubling is walked in steps of its own powers of two.
    rest = depth - (1 << (depth.bit_length() - 1))
    steps = {1: t.following()}
    level = dense(t.heads.astype(np.int64))
    done = 1
    while done < depth:
        if done * 2 <= depth:
            jump, shift = steps[done], done
        else:
            shift = depth - done
            jump, left = None, shift
            for d in sorted(steps, reverse=True):
                if left & d:
                    jump = steps[d] if jump is None else steps[d][jump]
                    left -= d
        level = dense(level * (int(level[-1]) + 1) + level[jump])
        done += shift
        if shift in steps and 2 * shift <= depth:
            steps[2 * shift] = steps[shift][steps[shift]]
            if not rest & shift:
                del steps[shift]
    return level
