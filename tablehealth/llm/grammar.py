"""Least-cost repair of role sequences: min-plus transfer matrices over a Re-Pair grammar.

A repaired conversation's role initials are ``(s?(ua)+)?``. Four states tell how far that is: nothing yet, after the
system turn, a user's turn is open, it is answered. A row is a 4 x 4 matrix: what the cheapest edits cost that lead from one
state to another, insertions in front of the row included. A sequence is the min-plus product of its rows.

Of equally cheap edits the least in ASCII wins. As every cell's edits end with their last row's own letter, no two
cells of one matrix hold edits of which one is the beginning of the other. So cells compare by ranks, and a product's ranks
follow from those of its factors: a matrix is 16 costs and 16 ranks however long its edits are. These are a rope: a
cell knows the state in the middle, and so the cells of its two parts.

Sequences share their matrices through a grammar: the most frequent neighbours become a symbol, again and again, and each
rule's matrix is made once from those of its two parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATES = 4
NEVER = 1 << 48
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows by role initial, in capitals if truncated; other initials are ``o``, and ``x`` has to be deleted.
SYMBOLS = "xsuaoSUAO"
#: Cheapest insertions from state to state, by the initials of what is inserted.
INSERTED = {
    (0, 0): "", (0, 2): "u", (0, 3): "ua", (1, 1): "", (1, 2): "u", (1, 3): "ua", (2, 2): "", (2, 3): "a", (3, 3): "",
    (3, 2): "u",
}
#: Where a role leads from each state.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def letters(edits: str) -> str:
    """Initials of the edits, which name the inserted (u, a) and the new roles (U, A) themselves."""
    return edits.translate(str.maketrans("uaUA", "IIRR"))


def _row_edits(symbol: str) -> list[tuple[int, int, int, str]]:
    """From state, to state, cost and letter of all that can be done with a row."""
    found = [(i, i, DELETE, "D") for i in range(STATES)]
    if symbol == "x":
        return found
    extra = TRUNCATED if symbol.isupper() else 0
    found += [(i, j, KEEP + extra, "K") for i, j in _NEXT.get(symbol.lower(), {}).items()]
    for role in "ua":
        found += [(i, j, REROLE + extra, role.upper()) for i, j in _NEXT[role].items()]
    return found


@dataclass
class Matrices:
    """Costs and ranks of n matrices, each n x 4 x 4."""

    cost: np.ndarray
    rank: np.ndarray

    def __getitem__(self, at) -> Matrices:
        return Matrices(self.cost[at], self.rank[at])


def _of_symbols() -> tuple[Matrices, list[dict[tuple[int, int], str]]]:
    costs, ranks, edits = [], [], []
    for symbol in SYMBOLS:
        cells: dict[tuple[int, int], tuple[int, str, str]] = {}
        for (i, k), before in INSERTED.items():
            for start, j, cost, letter in _row_edits(symbol):
                if start == k:
                    text = before + letter
                    new = (INSERT * len(before) + cost, letters(text), text)
                    cells[i, j] = min(cells.get((i, j), new), new)
        order = sorted({audit for _, audit, _ in cells.values()})
        cost = np.full((STATES, STATES), NEVER, np.int64)
        rank = np.zeros((STATES, STATES), np.int64)
        for at, (price, audit, _) in cells.items():
            cost[at], rank[at] = price, order.index(audit)
        costs.append(cost)
        ranks.append(rank)
        edits.append({at: text for at, (_, _, text) in cells.items()})
    return Matrices(np.array(costs), np.array(ranks)), edits


def product(left: Matrices, right: Matrices) -> tuple[Matrices, np.ndarray]:
    """The matrices of sequences that follow one another, and the state in the middle of each cell."""
    cost = left.cost[:, :, :, None] + right.cost[:, None, :, :]
    order = (cost << 8) + (left.rank[:, :, :, None] << 4) + right.rank[:, None, :, :]
    via = order.argmin(axis=2)
    best = order.min(axis=2)
    cells = (best & 255).reshape(len(best), -1)
    rank = (cells[:, :, None] > cells[:, None, :]).sum(axis=2).reshape(best.shape)
    return Matrices(np.minimum(best >> 8, NEVER), rank), via


OF_SYMBOLS, EDITS = _of_symbols()


class Grammar:
    """Rules for some sequences, each of which becomes one symbol, and the matrices of all symbols.

    Symbols below ``len(SYMBOLS)`` are rows; ``parts[s - len(SYMBOLS)]`` are the two parts of the others.
    """

    def __init__(self, sequences: list[str]) -> None:
        self.parts = np.zeros((0, 2), np.int64)
        number = {c: k for k, c in enumerate(SYMBOLS)}
        flat = np.array([number[c] for s in sequences for c in s], np.int64)
        owner = np.repeat(np.arange(len(sequences)), np.array(list(map(len, sequences)), np.int64))
        #: Symbol of each sequence; -1 for empty ones.
        self.roots = np.full(len(sequences), -1, np.int64)
        while len(flat):
            flat, owner = self._set_aside(flat, owner)
            if not len(flat):
                break
            flat, owner = self._round(flat, owner)
        self._evaluate()

    def _set_aside(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of one symbol are done."""
        change = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        single = change[:-1][np.diff(change) == 1]
        self.roots[owner[single]] = flat[single]
        return np.delete(flat, single), np.delete(owner, single)

    def _round(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace the most frequent neighbours, and others nearly as frequent that share no symbol with them."""
        base = int(flat.max()) + 1
        at = np.flatnonzero(owner[1:] == owner[:-1])
        pair = flat[at] * base + flat[at + 1]
        found, where, often = np.unique(pair, return_inverse=True, return_counts=True)
        if often.max() < 2:
            # No pair occurs twice: neighbours are joined two by two until each sequence is one symbol.
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            inside = at - first[np.searchsorted(first, at, "right") - 1]
            chosen = at[inside % 2 == 0]
            rule = self._rules(np.stack([flat[chosen], flat[chosen + 1]], axis=1))
            return self._replaced(flat, owner, chosen, rule)
        used, picked = set(), []
        for k in np.argsort(-often, kind="stable").tolist():
            if 2 * often[k] < often.max() or often[k] < 2:
                break
            sides = set(divmod(int(found[k]), base))
            if not sides & used:
                used |= sides
                picked.append(k)
        rule_of = np.full(len(found), -1, np.int64)
        rule_of[picked] = self._rules(np.stack(np.divmod(found[picked], base), axis=1))
        rule = rule_of[where]
        chosen, rule = at[rule >= 0], rule[rule >= 0]
        # Equal symbols in a row overlap: every other place of such a run is taken, from its beginning.
        follows = (np.diff(chosen, prepend=-2) == 1) & (np.diff(rule, prepend=-1) == 0)
        starts = np.flatnonzero(~follows)
        inside = np.arange(len(chosen)) - starts[np.cumsum(~follows) - 1]
        take = inside % 2 == 0
        return self._replaced(flat, owner, chosen[take], rule[take])

    def _rules(self, parts: np.ndarray) -> np.ndarray:
        first = len(SYMBOLS) + len(self.parts)
        self.parts = np.concatenate([self.parts, parts])
        return np.arange(first, first + len(parts))

    @staticmethod
    def _replaced(
        flat: np.ndarray, owner: np.ndarray, at: np.ndarray, rule: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        flat = flat.copy()
        flat[at] = rule
        return np.delete(flat, at + 1), np.delete(owner, at + 1)

    def _evaluate(self) -> None:
        """Matrices bottom-up, all rules of one height at a time."""
        base, n = len(SYMBOLS), len(self.parts)
        height = np.zeros(base + n, np.int64)
        for k, (a, b) in enumerate(self.parts.tolist()):
            height[base + k] = 1 + max(height[a], height[b])
        shape = (base + n, STATES, STATES)
        self.matrices = Matrices(np.zeros(shape, np.int64), np.zeros(shape, np.int64))
        self.matrices.cost[:base], self.matrices.rank[:base] = OF_SYMBOLS.cost, OF_SYMBOLS.rank
        self.via = np.zeros(shape, np.int64)
        for level in range(1, int(height.max(initial=0)) + 1):
            rules = np.flatnonzero(height == level)
            a, b = self.parts[rules - base].T
            made, via = product(self.matrices[a], self.matrices[b])
            self.matrices.cost[rules], self.matrices.rank[rules], self.via[rules] = made.cost, made.rank, via

    def edits(self, symbol: int, start: int, end: int) -> str:
        """The edits of a cell, read off its rope."""
        base, out, open_ = len(SYMBOLS), [], [(symbol, start, end)]
        while open_:
            symbol, i, j = open_.pop()
            if symbol < base:
                out.append(EDITS[symbol][i, j])
                continue
            left, right = self.parts[symbol - base].tolist()
            k = int(self.via[symbol, i, j])
            open_ += [(right, k, j), (left, i, k)]
        return "".join(out)
