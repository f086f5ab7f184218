"""Probabilistic automata inferred from examples by merging prefix-tree states.

The prefix tree of the examples has a state for each prefix, with how often it is passed, where it
ends and what follows. States are taken in breadth-first order; each is merged with the first
earlier kept one that it is statistically compatible with: the ends and all following symbols,
recursively, have frequencies that differ by no more than a Hoeffding bound. A state that is
compatible with none is kept. What remains is a deterministic automaton with probabilities.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable

#: Character classes, the automata's symbols, with their number of characters. Others are symbols
#: themselves.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
TO_CLASS = str.maketrans({c: k for k, chars in CLASSES.items() for c in chars})
SIZE = {k: math.log(len(chars)) for k, chars in CLASSES.items()}
SMOOTHING, SYMBOLS = 0.5, 12


class Automaton:
    def __init__(self, examples: Iterable[str], alpha: float = 0.05):
        self.passed, self.ends, self.next, self.edge = [0], [0], [{}], [Counter()]
        lengths: Counter[int] = Counter()
        for word, n in Counter(x.translate(TO_CLASS) for x in examples).items():
            lengths[len(word)] += n
            state = 0
            self.passed[0] += n
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.edge.append(Counter())
                    self.passed.append(0)
                    self.ends.append(0)
                self.edge[state][c] += n
                state = self.next[state][c]
                self.passed[state] += n
            self.ends[state] += n
        self.root = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._score(lengths)

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.root * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if a == b or not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.edge[a][c], n, self.edge[b][c], m):
                    return False
                x, y = self.next[a].get(c), self.next[b].get(c)
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree's counts to the kept state's."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ends[a] += self.ends[b]
            self.edge[a].update(self.edge[b])
            for c, y in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], y))
                else:
                    self.next[a][c] = y

    def _merge(self) -> None:
        kept, seen = [0], {0}
        todo = deque((0, c) for c in sorted(self.next[0]))
        while todo:
            parent, c = todo.popleft()
            state = self.next[parent].get(c)
            if state is None or state in seen:
                continue
            for k in kept:
                if self._compatible(k, state):
                    self.next[parent][c] = k
                    before = {x: set(self.next[x]) for x in kept}
                    self._fold(k, state)
                    todo.extend((x, s) for x in kept for s in sorted(self.next[x].keys() - before[x]))
                    break
            else:
                kept.append(state)
                seen.add(state)
                todo.extend((state, s) for s in sorted(self.next[state]))
        self.kept = kept

    def _score(self, lengths: Counter[int]) -> None:
        """Log probabilities: of a symbol in a state, with its class's size; of a length."""
        self.step = {}
        for s in self.kept:
            edge, total = self.edge[s], sum(self.edge[s].values()) + SMOOTHING * SYMBOLS
            self.step[s] = ({c: (math.log((edge[c] + SMOOTHING) / total) - SIZE.get(c, 0.0), x) for c, x in self.next[s].items()}, math.log(SMOOTHING / total))
        n = sum(lengths.values())
        self.length = {k: math.log(0.95 * v / n) for k, v in lengths.items()}
        self.other_length = math.log(0.05 / 100)
        del self.passed, self.ends, self.next, self.edge

    def log_likelihood(self, classes: str) -> float:
        """Of a string of classes, each standing for one character of it."""
        total, state = self.length.get(len(classes), self.other_length), 0
        for c in classes:
            known, other = self.step[state]
            found = known.get(c)
            if found is None:
                total += other - SIZE.get(c, 0.0)
            else:
                total += found[0]
                state = found[1]
        return total
