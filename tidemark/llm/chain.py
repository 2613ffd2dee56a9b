"""Forward and backward recursions over many sequences at once.

Sequences of similar length are laid out step by step: a step's rows are the
sequences that are that long, the longest first, so that one array operation
serves them all. Every step is scaled to sum to one; the logarithms of the
scales add up to the exact log-likelihood.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

ROWS_AT_ONCE = 1 << 19
SLICE = 1 << 14  # rows whose moves are added up together


def by_length(lengths: np.ndarray, rows_at_once: int = ROWS_AT_ONCE) -> Iterator[np.ndarray]:
    """Numbers of the non-empty sequences, longest first, in runs of about `rows_at_once` rows."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return
    run = (np.cumsum(lengths[order]) - lengths[order]) // rows_at_once
    yield from np.split(order, np.flatnonzero(np.diff(run)) + 1)


class Steps:
    """Where the rows of sequences (longest first) lie when laid out step by step."""

    def __init__(self, lengths: np.ndarray):
        n, longest = len(lengths), int(lengths[0])
        self.active = n - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
        self.begin = np.append(0, np.cumsum(self.active))
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.sequence = np.repeat(np.arange(n), lengths)
        #: For each row, sequence by sequence, its place in the layout.
        self.place = self.begin[within] + self.sequence
        self.last = self.begin[lengths - 1] + np.arange(n)


def forward(steps: Steps, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool = True):
    """(scaled forward rows or None, scales); `emit` has a row per place."""
    scale, ones = np.empty(len(emit)), np.ones(emit.shape[1])
    rows = np.empty_like(emit) if keep else None
    state = None
    for a, n in zip(steps.begin.tolist(), steps.active.tolist()):
        here = emit[a : a + n]
        now = rows[a : a + n] if keep else np.empty_like(here)
        if state is None:
            np.multiply(start, here, out=now)
        else:
            np.matmul(state[:n], move, out=now)
            now *= here
        c = np.matmul(now, ones, out=scale[a : a + n])
        now /= c[:, None]
        state = now
    return rows, scale


def backward(steps: Steps, move: np.ndarray, emit: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled backward rows: forward times backward is the chance of each state."""
    return backward_in_place(steps, move, emit.copy(), scale)


def backward_in_place(steps: Steps, move: np.ndarray, emit: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The same; `emit` becomes what comes into each row but the first step's: emission times backward over the scale."""
    rows = np.ones_like(emit)
    emit /= scale[:, None]
    back = np.ascontiguousarray(move.T)
    begin, active = steps.begin.tolist(), steps.active.tolist()
    for t in range(len(active) - 2, -1, -1):
        a, b, n = begin[t], begin[t + 1], active[t + 1]
        into = emit[b : b + n]
        into *= rows[b : b + n]
        np.matmul(into, back, out=rows[a : a + n])
    return rows


def transitions(steps: Steps, alpha: np.ndarray, move: np.ndarray, emit: np.ndarray, scale: np.ndarray, beta: np.ndarray):
    """Expected number of moves between states, added up some rows at a time."""
    return _moves(steps, alpha, move, lambda a, b: emit[a:b] * beta[a:b] / scale[a:b, None])


def transitions_into(steps: Steps, alpha: np.ndarray, move: np.ndarray, into: np.ndarray):
    """The same from what `backward_in_place` leaves."""
    return _moves(steps, alpha, move, lambda a, b: into[a:b])


def _moves(steps: Steps, alpha: np.ndarray, move: np.ndarray, into: Callable[[int, int], np.ndarray]):
    total = np.zeros_like(move)
    first, rows = int(steps.begin[1]), len(alpha)
    gone = np.repeat(steps.active[:-1], steps.active[1:])  # how far back a row's step before lies
    for a in range(first, rows, SLICE):
        b = min(a + SLICE, rows)
        total += np.take(alpha, np.arange(a, b) - gone[a - first : b - first], axis=0).T @ into(a, b)
    return move * total
