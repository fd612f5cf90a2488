"""Consensus of a few similar strings over a partial order graph of their letters."""

from __future__ import annotations

import numpy as np

#: Scores of equal and other letters and of a letter against nothing.
EQUAL, OTHER, GAP = 2, -4, -4


class LetterGraph:
    """Letters as nodes, neighbours in a string as edges; nodes that strings put in one place share a column.

    Columns are kept in an order that every string follows, so nodes need no sorting: a new column
    is put behind the one of the letter before it."""

    def __init__(self):
        self.letter: list[int] = []
        self.before: list[list[int]] = []
        self.after: list[list[int]] = []
        self.columns: list[list[int]] = []  # nodes of each column, in order
        self.walks: list[list[int]] = []

    def _node(self, letter: int) -> int:
        self.letter.append(letter)
        self.before.append([])
        self.after.append([])
        return len(self.letter) - 1

    def add(self, text: np.ndarray) -> None:
        """Aligns a string globally to the graph and adds it as a walk."""
        pairs = self._aligned(text)
        at = -1  # column of the letter before
        column_of = {v: c for c, own in enumerate(self.columns) for v in own}
        walk: list[int] = []
        fresh: list[tuple[int, int]] = []  # (column behind which, node)
        for v, j in pairs:
            if j is None:
                continue
            code = int(text[j])
            if v is None:
                node = self._node(code)
                fresh.append((at, node))
            else:
                at = column_of[v]
                node = next((u for u in self.columns[at] if self.letter[u] == code), None)
                if node is None:
                    node = self._node(code)
                    self.columns[at].append(node)
            if walk and node not in self.after[walk[-1]]:
                self.after[walk[-1]].append(node)
                self.before[node].append(walk[-1])
            walk.append(node)
        for place in sorted({a for a, _ in fresh}, reverse=True):
            self.columns[place + 1 : place + 1] = [[n] for a, n in fresh if a == place]
        self.walks.append(walk)

    def _aligned(self, text: np.ndarray) -> list[tuple[int | None, int | None]]:
        """(node, place) of the best global alignment, either None for a gap."""
        order = [v for own in self.columns for v in own]
        m = len(text)
        place = np.arange(m + 1)
        rows = np.empty((len(order) + 1, m + 1), np.int64)
        rows[0] = GAP * place
        index = {v: i + 1 for i, v in enumerate(order)}
        for i, v in enumerate(order, 1):
            score = np.where(text == self.letter[v], EQUAL, OTHER)
            best = np.full(m + 1, -(1 << 40), np.int64)
            for p in [index[u] for u in self.before[v]] or [0]:
                best = np.maximum(best, rows[p] + GAP)
                best[1:] = np.maximum(best[1:], rows[p][:-1] + score)
            if self._begins(v):
                best = np.maximum(best, rows[0] + GAP)
                best[1:] = np.maximum(best[1:], rows[0][:-1] + score)
            # letters of the string alone: a running maximum along the row
            rows[i] = np.maximum.accumulate(best - GAP * place) + GAP * place
        ends = [v for v in order if not self.after[v] or self._ends(v)]
        i = max((index[v] for v in ends), key=lambda k: (rows[k, m], -k), default=0)
        j, out = m, []
        while i or j:
            if i:
                v = order[i - 1]
                froms = [index[u] for u in self.before[v]]
                if not froms or self._begins(v):
                    froms.append(0)
                step = EQUAL if j and text[j - 1] == self.letter[v] else OTHER
                hit = next((p for p in froms if j and rows[p, j - 1] + step == rows[i, j]), None)
                if hit is not None:
                    out.append((v, j - 1))
                    i, j = hit, j - 1
                    continue
                hit = next((p for p in froms if rows[p, j] + GAP == rows[i, j]), None)
                if hit is not None:
                    out.append((v, None))
                    i = hit
                    continue
            out.append((None, j - 1))
            j -= 1
        return out[::-1]

    def _begins(self, v: int) -> bool:
        return any(w and w[0] == v for w in self.walks)

    def _ends(self, v: int) -> bool:
        return any(w and w[-1] == v for w in self.walks)

    def table(self) -> np.ndarray:
        """[string, column]: the letter, 0 for a gap."""
        column_of = {v: c for c, own in enumerate(self.columns) for v in own}
        out = np.zeros((len(self.walks), len(self.columns)), np.int64)
        for i, walk in enumerate(self.walks):
            for v in walk:
                out[i, column_of[v]] = self.letter[v]
        return out

    def heaviest(self, weights: list[int]) -> str:
        """The letters along the heaviest edges, a string weighing as given (0 for those that take no part)."""
        edge: dict[tuple[int, int], int] = {}
        for walk, w in zip(self.walks, weights):
            if w:
                for u, v in zip([-1, *walk], [*walk, -2]):
                    edge[u, v] = edge.get((u, v), 0) + w
        outs: dict[int, list[tuple[int, int]]] = {}
        for (u, v), w in edge.items():
            outs.setdefault(u, []).append((v, w))
        score, chosen = {-2: 0}, {}
        for u in [v for own in reversed(self.columns) for v in reversed(own)] + [-1]:
            if u in outs:
                v, w = max(outs[u], key=lambda x: (x[1], score[x[0]], -x[0]))
                chosen[u], score[u] = v, w + score[v]
        out, at = [], chosen.get(-1, -2)
        while at != -2:
            out.append(chr(self.letter[at]))
            at = chosen[at]
        return "".join(out)


def two_groups(rows: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """For each row of a table of columns, whether it belongs to the second group.

    Columns count in which the second most frequent letter (or gap) has ``least`` of the weight. The one
    where it has most parts the rows; each row then joins the group whose letters it has in
    more of these columns. All rows are of one group if there is no such column or the smaller group is too light."""
    one = np.zeros(len(rows), bool)
    if len(rows) < 2:
        return one
    shares = np.array([[weight[rows[:, c] == x].sum() for x in (0, 65, 67, 71, 78, 84)] for c in range(rows.shape[1])]).reshape(-1, 6)
    order = np.sort(shares, axis=1)
    odd = np.flatnonzero(order[:, -2] >= least)
    if not len(odd):
        return one
    seed = odd[np.argmax(order[odd, -2])]
    top = np.argsort(-shares[seed], kind="stable")[:2]
    own = rows[:, seed] == (0, 65, 67, 71, 78, 84)[top[1]]
    for _ in range(4):
        if not own.any() or own.all():
            return one
        sides = [np.array([max(set(rows[g, c].tolist()), key=lambda x: (weight[g][rows[g, c] == x].sum(), -x)) for c in odd]) for g in (~own, own)]  # noqa: B023
        away = [(rows[:, odd] != s).sum(axis=1) for s in sides]
        new = away[1] < away[0]
        if (new == own).all():
            break
        own = new
    return own if least <= weight[own].sum() and least <= weight[~own].sum() else one


def consensus(strings: list[str], least_share: float = 0.25) -> list[str]:
    """One or two consensus strings, the heavier group's first.

    Equal strings are aligned once and weigh as many as they are. A second group needs
    ``least_share`` of the strings and two of them at least; letters other than A, C, G, T count as N."""
    counts: dict[str, int] = {}
    for s in strings:
        s = "".join(c if c in "ACGT" else "N" for c in s.upper())
        counts[s] = counts.get(s, 0) + 1
    ordered = sorted(counts, key=lambda s: (-counts[s], s))
    if len(ordered) < 2:
        return ordered
    graph = LetterGraph()
    for s in ordered:
        graph.add(np.frombuffer(s.encode("ascii"), np.uint8))
    weight = np.array([counts[s] for s in ordered])
    second = two_groups(graph.table(), weight, max(2, least_share * weight.sum()))
    groups = [g for g in (~second, second) if g.any()]
    groups.sort(key=lambda g: -weight[g].sum())
    return [graph.heaviest(np.where(g, weight, 0).tolist()) for g in groups]
