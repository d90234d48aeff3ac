"""A run-length grammar of a sequence by recompression, and longest common extensions read off its levels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Level:
    """The symbols of one level, their parents on the next, and the first child of each parent.

    ``blocks``: a parent is a stretch of one symbol; else it is one symbol, or a pair of a left and a right one.
    """

    symbols: np.ndarray
    parent: np.ndarray
    child: np.ndarray
    blocks: bool


class Grammar:
    """Block and pair compression in turn, until one symbol is left.

    Equal stretches become equal symbols, as what happens to a symbol depends on it and its neighbours alone: blocks
    are maximal stretches of one symbol, and a pair is a symbol of the left class before one of the right class, the
    classes drawn anew on each level.  The first and the last symbol of the sequence must occur once.
    """

    def __init__(self, sequence: np.ndarray):
        symbols, names = np.unique(sequence, return_inverse=True)
        count, symbols = len(symbols), names.astype(np.int64)
        self.levels: list[Level] = []
        draw = np.random.default_rng(len(sequence))
        while len(symbols) > 1:
            heads = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            if len(heads) < len(symbols):
                sizes = np.diff(heads, append=len(symbols))
                symbols, count = self._level(symbols, heads, sizes > 1, sizes, count, True)
            left = draw.integers(0, 2, count, dtype=np.int8)[symbols] == 0
            paired = np.concatenate([left[:-1] & ~left[1:], [False]])
            if paired.any():
                heads = np.flatnonzero(np.concatenate([[True], ~paired[:-1]]))
                after = symbols[np.minimum(heads + 1, len(symbols) - 1)]
                symbols, count = self._level(symbols, heads, paired[heads], after, count, False)

    def _level(self, symbols: np.ndarray, heads: np.ndarray, joined: np.ndarray, other: np.ndarray, count: int,
               blocks: bool) -> tuple[np.ndarray, int]:
        """The next level: where ``joined``, (symbol, other) gets a name of its own, the rest keep theirs."""
        parent = np.zeros(len(symbols), np.int64)
        parent[heads[1:]] = 1
        above = symbols[heads]
        keys, names = np.unique(above[joined] * (int(other.max()) + 1) + other[joined], return_inverse=True)
        above[joined] = count + names
        self.levels.append(Level(symbols, np.cumsum(parent), np.append(heads, len(symbols)), blocks))
        held, above = np.unique(above, return_inverse=True)  # names stay as few as the symbols in use
        return above.astype(np.int64), len(held)

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How far the sequence reads alike from ``left`` and from ``right`` on, for each pair of unequal positions.

        On the way up a pair steps to where both start a parent, or differ for good; on the way down the first
        children that differ are taken.  A level costs a few operations, whatever the length of the extension.
        """
        i, j = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        stopped = np.full(len(i), len(self.levels))
        active = np.arange(len(i))
        for n, level in enumerate(self.levels):
            a, b = i[active], j[active]
            inside = (level.child[level.parent[a]] != a) | (level.child[level.parent[b]] != b)
            alike = level.symbols[a] == level.symbols[b]
            steps, apart = _steps(level, a, b)
            move = inside & alike
            a, b = a + np.where(move, steps, 0), b + np.where(move, steps, 0)
            differ = inside & (~alike | apart)
            i[active], j[active] = np.where(differ, a, level.parent[a]), np.where(differ, b, level.parent[b])
            stopped[active[differ]] = n
            active = active[~differ]
        for n in range(len(self.levels) - 1, -1, -1):
            level, below = self.levels[n], np.flatnonzero(stopped > n)
            if not len(below):
                continue
            a, b = level.child[i[below]], level.child[j[below]]
            steps, _ = _steps(level, a, b)
            steps = np.where(level.symbols[a] == level.symbols[b], steps, 0)
            i[below], j[below] = a + steps, b + steps
        return i - left


def _steps(level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal symbols to step over at two positions, and whether the symbols behind them differ for sure."""
    if not level.blocks:
        return np.ones(len(a), np.int64), np.zeros(len(a), bool)
    rest_a, rest_b = level.child[level.parent[a] + 1] - a, level.child[level.parent[b] + 1] - b
    return np.minimum(rest_a, rest_b), rest_a != rest_b
