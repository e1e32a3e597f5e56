"""Anchors: a lossless choice of places at which equal windows meet.

The anchor of a window is the place of its smallest gram hash. Equal windows have equal anchors, each place
is the anchor of a run of neighbouring windows, and only about 2 / (grams in a window + 1) of all places are
anchors of any window. A window can repeat only if its anchor's gram repeats.
"""

from __future__ import annotations

import numpy as np


_PLACE = 26  # bits of a place; hashes are compared without as many low bits


def anchor_of(grams: np.ndarray, span: int) -> np.ndarray:
    """For each of len(grams) - span + 1 windows of span grams the place of the leftmost smallest one.

    Hash and place share one word, so the sliding minimum, by doubling, brings the place along.
    """
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << _PLACE) - 1)
    if len(grams) > 1 << _PLACE:  # one very long text: in pieces that overlap
        step = (1 << _PLACE) - span
        return np.concatenate([anchor_of(grams[lo : lo + step + span - 1], span) + lo for lo in range(0, n, step)])
    m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    w = 1
    while 2 * w <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < span:
        m = np.minimum(m[:n], m[span - w : span - w + n])
    return (m & low).astype(np.int64)


def places(anchor: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The distinct anchors of the valid windows; anchors never step back."""
    at = anchor[valid]
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def runs(ok: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last window of each run of neighbouring ok windows with one anchor."""
    at = np.flatnonzero(ok)
    if not len(at):
        return at, at
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]])))
    first = np.flatnonzero(new)
    return at[first], np.concatenate((at[first[1:] - 1], at[-1:])) + 1
