"""Probabilistic automata from examples by state merging (ALERGIA).

Strings are sequences of symbols. A prefix tree counts how often each state is reached, left by each symbol and is an
end; states whose frequencies agree within Hoeffding's bound, and whose successors do so too, are merged.
"""

from __future__ import annotations

import math
from collections import Counter

#: Hoeffding confidence: the smaller, the more is merged.
ALPHA = 0.05

#: Symbols that a chain reckons with at least: five classes, six marks and the end.
ALPHABET = 12


def symbols(text: str) -> str:
    """Character classes: h and l for a-f and other small letters, H and U for large ones, d for digits; others stay."""
    return text.translate(_CLASSES)


_CLASSES = {ord(c): k for k, cs in (("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ"), ("d", "0123456789")) for c in cs}


class Automaton:
    """States are numbers; ``next[q]`` maps a symbol to (state, count); ``ends[q]`` and ``seen[q]`` count ends and visits."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, list[int]]] = [{}]
        self.ends, self.seen = [0], [0]
        self.lengths = Counter(map(len, strings))
        for s in strings:
            self._add(s)
        self._merge_states(math.sqrt(0.5 * math.log(2 / alpha)))
        self._compact()

    def _add(self, s: str) -> None:
        q = 0
        self.seen[0] += 1
        for c in s:
            edge = self.next[q].get(c)
            if edge is None:
                self.next.append({})
                self.ends.append(0)
                self.seen.append(0)
                edge = self.next[q][c] = [len(self.next) - 1, 0]
            edge[1] += 1
            q = edge[0]
            self.seen[q] += 1
        self.ends[q] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b], bound):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, self.seen[a], y[1] if y else 0, self.seen[b], bound):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.seen[a] += self.seen[b]
            for c, (to, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    todo.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, n]

    def _merge_states(self, bound: float) -> None:
        red = [0]
        while True:
            blue = sorted({(self.next[q][c][0], q, c) for q in red for c in self.next[q]} - {x for x in ((self.next[q][c][0], q, c) for q in red for c in self.next[q]) if x[0] in set(red)}, key=lambda x: (-self.seen[x[0]], x))
            if not blue:
                return
            to, q, c = blue[0]
            for r in red:
                if self._compatible(r, to, bound):
                    self.next[q][c][0] = r
                    self._fold(r, to)
                    break
            else:
                red.append(to)

    def _compact(self) -> None:
        order, at = [0], {0: 0}
        for q in order:
            for to, _ in self.next[q].values():
                if to not in at:
                    at[to] = len(order)
                    order.append(to)
        self.next = [{c: [at[to], n] for c, (to, n) in self.next[q].items()} for q in order]
        self.ends, self.seen = [self.ends[q] for q in order], [self.seen[q] for q in order]

    def log_likelihood(self, s: str, floor: float = 1e-4) -> float:
        """Natural log of the probability of a symbol string with its end; missing moves count as ``floor`` and stay."""
        q, out = 0, 0.0
        for c in s:
            edge = self.next[q].get(c)
            out += math.log(max(floor, edge[1] / self.seen[q])) if edge else math.log(floor)
            q = edge[0] if edge else q
        return out + math.log(max(floor, self.ends[q] / self.seen[q]))


    def log_length(self, n: int) -> float:
        """How much rarer this length is than the most common one: merging forgets lengths, formats have them."""
        return math.log((self.lengths[n] + 1) / (max(self.lengths.values(), default=0) + 1))


class Chain:
    """Chain of symbols given the two before them, drawn to the chain given one (BACK counts' worth), and that one smoothed by adding
    one: what ordinary strings look like, words in capitals and numbers among them."""

    BACK = 2.0

    def __init__(self, strings: list[str]):
        self.one: dict[str, dict[str, int]] = {}
        self.two: dict[str, dict[str, int]] = {}
        self.alphabet = max(ALPHABET, len({c for s in strings for c in s}) + 2)
        for s in strings:
            for a, b, c in zip("^^" + s, "^" + s, s + "$", strict=False):
                for table, context in ((self.one, b), (self.two, a + b)):
                    row = table.setdefault(context, {})
                    row[c] = row.get(c, 0) + 1
        self.totals = {k: sum(r.values()) for table in (self.one, self.two) for k, r in table.items()}

    def log_likelihood(self, s: str) -> float:
        out, none = 0.0, {}
        for a, b, c in zip("^^" + s, "^" + s, s + "$", strict=False):
            near = (self.one.get(b, none).get(c, 0) + 1) / (self.totals.get(b, 0) + self.alphabet)
            out += math.log((self.two.get(a + b, none).get(c, 0) + self.BACK * near) / (self.totals.get(a + b, 0) + self.BACK))
        return out
