"""Fuzzy string ratios, 0 to 100, as Arrow functions (K4, K5, L7-L9): many pairs at once, with plain forms of a single pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel steps over b."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * common(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a window of the longer one, windows over its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    letters = set(a)
    for end in range(1, len(b) + n):
        window = b[max(0, end - n) : min(len(b), end)]
        # a character that the shorter text lacks at the end that moves: the window beside it is as good
        if (window[-1] if end <= len(b) else window[0]) in letters:
            best = max(best, ratio(a, window))
            if best == 100.0:
                break
    return best


def token_sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def ordered(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_ratio(a: str, b: str) -> float:
    both, x, y = token_sets(a, b)
    best = ratio(ordered(a), ordered(b))
    if both and not (x and y):
        return 100.0
    left, right = f"{both} {x}".strip(), f"{both} {y}".strip()
    best = max(best, ratio(left, right))
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, x, y = token_sets(a, b)
    return 100.0 if both else max(partial_ratio(ordered(a), ordered(b)), partial_ratio(x, y))


def weighted_ratio(a: str | None, b: str | None) -> float:
    """Whole-text ratio for texts of like length, windows and token sets at a discount for others."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if longer < 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


# Many pairs at once: each pair or window is a lane of a 64-bit integer, whose bits stand for the characters of the shorter
# text; a step takes one character of the other text in all lanes.

#: longest text that fits a lane's bits; pairs of longer ones are compared one by one
BITS = 64
#: lanes that are worked on together
LANES = 200_000


def code_rows(texts: list[str]) -> np.ndarray:
    """A row of code points for each text, 0 behind its end."""
    width = max(map(len, texts), default=0) or 1
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def masks(short: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, codes): for each pair and code the bits of short's places with it; other in codes, those short lacks as 0."""
    letters = np.unique(short)
    letters = letters[letters > 0]
    number = lambda x: np.where(letters.take(np.searchsorted(letters, x), mode="clip") == x, np.searchsorted(letters, x) + 1, 0)
    mine, bits = number(short), np.zeros((len(short), len(letters) + 1), np.uint64)
    for i in range(short.shape[1]):
        bits[np.arange(len(short)), mine[:, i]] |= np.uint64(1) << np.uint64(i)
    bits[:, 0] = 0
    return bits, number(other)


def common_lanes(bits: np.ndarray, lane: np.ndarray, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row of codes with the pair ``lane`` names, whose text has ``length`` characters."""
    state = np.full(len(codes), ~np.uint64(0))
    for j in range(codes.shape[1]):
        hit = state & bits[lane, codes[:, j]]
        state = (state + hit) | (state - hit)
    full = np.where(length >= BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(length, BITS - 1).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & full).astype(np.int64)


def chunks(weights: np.ndarray) -> list[slice]:
    """Runs of pairs whose weights sum to some LANES."""
    at = np.searchsorted(np.cumsum(weights), np.arange(LANES, int(weights.sum()) + LANES, LANES))
    ends = np.unique(np.minimum(at + 1, len(weights)))
    return [slice(a, b) for a, b in zip([0, *ends[:-1]], ends)]


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio of each pair."""
    out, swap = np.zeros(len(a)), [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    size = np.array([(len(x), len(y)) for x, y in swap], np.int64).reshape(-1, 2)
    odd = np.array([len(x) > BITS or "\0" in x or "\0" in y for x, y in swap], bool)
    for k in np.flatnonzero(odd):
        out[k] = ratio(*swap[k])
    order = np.flatnonzero(~odd)
    order = order[np.argsort(size[order, 1], kind="stable")]  # pairs of like length together
    for part in chunks(np.ones(len(order), np.int64) * 8) if len(order) else []:
        k = order[part]
        bits, codes = masks(code_rows([swap[i][0] for i in k]), code_rows([swap[i][1] for i in k]))
        total = size[k].sum(1)
        out[k] = np.where(total > 0, 200.0 * common_lanes(bits, np.arange(len(k)), codes, size[k, 0]) / np.maximum(total, 1), 100.0)
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """partial_ratio of each pair: all windows of the longer text are lanes."""
    out, swap = np.zeros(len(a)), [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    size = np.array([(len(x), len(y)) for x, y in swap], np.int64).reshape(-1, 2)
    odd = np.array([not x or len(x) > BITS or "\0" in x or "\0" in y for x, y in swap], bool)
    for k in np.flatnonzero(odd):
        out[k] = partial_ratio(*swap[k])
    order = np.flatnonzero(~odd)
    order = order[np.lexsort((size[order, 1], size[order, 0]))]
    for n in np.unique(size[order, 0]):
        same = order[size[order, 0] == n]  # windows have the shorter text's length
        for part in chunks(size[same, 1] + n):
            k = same[part]
            bits, codes = masks(code_rows([swap[i][0] for i in k]), code_rows([swap[i][1] for i in k]))
            shown = np.pad(code_rows([swap[i][1] for i in k]) > 0, ((0, 0), (n - 1, n - 1)))
            codes = np.pad(codes, ((0, 0), (n - 1, n - 1)))
            count = codes.shape[1] - n + 1
            windows = np.lib.stride_tricks.sliding_window_view(codes, n, axis=1).reshape(-1, n)
            length = np.lib.stride_tricks.sliding_window_view(shown, n, axis=1).sum(2).reshape(-1)
            lane = np.repeat(np.arange(len(k)), count)
            score = 200.0 * common_lanes(bits, lane, windows, np.full(len(lane), n)) / (n + length)
            out[k] = np.where(length > 0, score, 0.0).reshape(len(k), count).max(1)
    return out


def weighted_ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """weighted_ratio of each pair."""
    out = np.zeros(len(a))
    some = [k for k, (x, y) in enumerate(zip(a, b)) if x and y]
    if not some:
        return out
    x, y = [a[k] for k in some], [b[k] for k in some]
    best = ratios(x, y)
    longer = np.array([max(len(p), len(q)) / min(len(p), len(q)) for p, q in zip(x, y)])
    like, far = np.flatnonzero(longer < 1.5), np.flatnonzero(longer >= 1.5)
    sets = [token_sets(p, q) for p, q in zip(x, y)]
    if len(like):
        whole = ratios([ordered(x[k]) for k in like], [ordered(y[k]) for k in like])
        left, right = ([f"{sets[k][0]} {sets[k][side]}".strip() for k in like] for side in (1, 2))
        sides = ratios(left, right)
        for i, k in enumerate(like):
            both, p, q = sets[k]
            token = max(whole[i], sides[i])
            if both:  # it begins both sides, so it is what it has in common with each
                token = 100.0 if not (p and q) else max(token, *(200.0 * len(both) / (len(both) + len(t)) for t in (left[i], right[i])))
            best[k] = max(best[k], 0.95 * token)
    if len(far):
        scale = np.where(longer[far] < 8, 0.9, 0.6)
        windows = partial_ratios([x[k] for k in far], [y[k] for k in far])
        none = [i for i, k in enumerate(far) if not sets[k][0]]
        token = np.full(len(far), 100.0)
        if none:
            rows = [far[i] for i in none]
            sorted_ = partial_ratios([ordered(x[k]) for k in rows], [ordered(y[k]) for k in rows])
            token[none] = np.maximum(sorted_, partial_ratios([sets[k][1] for k in rows], [sets[k][2] for k in rows]))
        best[far] = np.maximum(best[far], np.maximum(scale * windows, 0.95 * scale * token))
    out[some] = best
    return out


def _column(fn):
    """Pairs that repeat within an Arrow batch are compared once."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        place: dict = {}
        at = [place.setdefault(pair, len(place)) for pair in zip(a, b)]
        left, right = zip(*place) if place else ((), ())
        return pd.Series(fn(list(left), list(right))[at] if at else np.zeros(0), dtype="float64")

    return run


def weighted_ratio_of(a, b):
    return _column(weighted_ratios)(a, b)


def some_partial_ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    return np.where([bool(x and y) for x, y in zip(a, b)], partial_ratios([x or "" for x in a], [y or "" for y in b]), 0.0)


def partial_ratio_of(a, b):
    return _column(some_partial_ratios)(a, b)
