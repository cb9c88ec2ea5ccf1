"""A weighted context-free grammar and an Earley parser that keeps the best-scoring parse.

Terminals are anchored expressions matched where the parser stands, so the chart has columns
only at positions that some terminal reached. No rule derives the empty text. The rules of a
symbol share one tree of prefixes, so that what they have in common is parsed once, and a
symbol is predicted only where one of the terminals that can begin it matches. Scores are sums
of rule weights; of several derivations of the same span the highest is kept (an item whose
score improves is processed again, which ends because cycles never gain).
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field


@dataclass
class Grammar:
    """Rules are ``(left, symbols, weight)``; a symbol ending in ``?`` may be left out."""

    terminals: dict[str, str]
    rules: list[tuple[str, str, float]]
    start: str
    _match: dict = field(default_factory=dict, repr=False)
    #: Per state: its steps over terminals ``(name, matcher, next)``, over symbols ``(symbol, next)``, and, where a rule ends, its symbol and weight.
    _states: list = field(default_factory=list, repr=False)
    _roots: dict = field(default_factory=dict, repr=False)
    #: Per symbol: the terminals that can begin it.
    _first: dict = field(default_factory=dict, repr=False)

    def compiled(self) -> Grammar:
        """Expand options, build the trees of prefixes and compile the terminals, once."""
        if self._states:
            return self
        self._match = {name: re.compile(pattern).match for name, pattern in self.terminals.items()}
        trees: dict[str, dict] = {}
        for left, right, weight in self.rules:
            forms: list[tuple[str, ...]] = [()]
            for symbol in right.split():
                bare = symbol.rstrip("?")
                forms = [f + (bare,) for f in forms] + (forms if symbol.endswith("?") else [])
            for form in forms:
                if form:
                    at = trees.setdefault(left, {})
                    for symbol in form:
                        at = at.setdefault(symbol, {})
                    at[None] = max(weight, at.get(None, weight))
        for left, tree in trees.items():
            self._roots[left] = self._state(left, tree)
        firsts = {left: set(tree) for left, tree in trees.items()}
        changed = True
        while changed:
            changed = False
            for first in firsts.values():
                more = set().union(*(firsts[s] for s in first if s in firsts)) - first
                changed = changed or bool(more)
                first |= more
        self._first = {left: sorted(s for s in first if s in self._match) for left, first in firsts.items()}
        return self

    def _state(self, left: str, tree: dict) -> int:
        number = len(self._states)
        self._states.append(None)
        steps = [(s, self._state(left, below)) for s, below in tree.items() if s is not None]
        self._states[number] = (
            [(s, self._match[s], n) for s, n in steps if s in self._match],
            [(s, n) for s, n in steps if s not in self._match],
            (left, tree[None]) if None in tree else None,
        )
        return number


@dataclass
class Parse:
    """Captured terminals in order ``(terminal, start, end, match)``, the score, and how far the parse reached."""

    tokens: list[tuple[str, int, int, re.Match]]
    score: float
    end: int


def parse(grammar: Grammar, text: str) -> Parse | None:
    """The highest-scoring derivation of the longest prefix of ``text``, or None."""
    states, roots, firsts, match, start = grammar._states, grammar._roots, grammar._first, grammar._match, grammar.start
    # chart[pos][item] = (score, back); item = (state, origin); back = (previous pos, previous item, terminal, match or completed item)
    chart: dict[int, dict] = {0: {(roots[start], 0): (0.0, None)}}
    waiting: dict[int, dict[str, list]] = {}
    heap = [0]
    best: tuple[int, tuple, float] | None = None
    while heap:
        pos = heapq.heappop(heap)
        column = chart[pos]
        wait = waiting[pos] = {}
        agenda = list(column)
        tried: dict[str, re.Match | None] = {}
        while agenda:
            item = agenda.pop()
            state, origin = item
            score = column[item][0]
            over_terminals, over_symbols, ended = states[state]
            if ended is not None:
                left, weight = ended
                total = score + weight
                if left == start and origin == 0 and (best is None or best[0] < pos or best[2] < total):
                    best = (pos, item, total)
                held_at = chart[origin]
                for parent, after in waiting[origin].get(left, ()):
                    up = (after, parent[1])
                    sum_ = held_at[parent][0] + total
                    held = column.get(up)
                    if held is None or held[0] < sum_:
                        column[up] = (sum_, (origin, parent, None, item))
                        agenda.append(up)
            for symbol, after in over_symbols:
                seen = wait.get(symbol)
                if seen is not None:
                    if (item, after) not in seen:
                        seen.append((item, after))
                    continue
                for name in firsts[symbol]:
                    if name not in tried:
                        tried[name] = match[name](text, pos)
                    if tried[name] is not None:
                        wait[symbol] = [(item, after)]
                        new = (roots[symbol], pos)
                        if new not in column:
                            column[new] = (0.0, None)
                            agenda.append(new)
                        break
            for name, matcher, after in over_terminals:
                if name in tried:
                    found = tried[name]
                else:
                    found = tried[name] = matcher(text, pos)
                if found is None:
                    continue
                end = found.end()
                if end == pos:
                    continue
                into = chart.get(end)
                if into is None:
                    into = chart[end] = {}
                    heapq.heappush(heap, end)
                reached = (after, origin)
                held = into.get(reached)
                if held is None or held[0] < score:
                    into[reached] = (score, (pos, item, name, found))
    if best is None:
        return None
    end, item, score = best
    tokens = []
    stack = [(end, item)]
    while stack:
        at, one = stack.pop()
        back = chart[at][one][1]
        if back is None:
            continue
        before, previous, name, found = back
        stack.append((before, previous))
        if name is None:
            stack.append((at, found))
        else:
            tokens.append((name, found.start(), found.end(), found))
    tokens.reverse()
    return Parse(tokens, score, end)
