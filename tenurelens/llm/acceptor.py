"""Minimal acceptors of word sets, and their composition with a transducer that makes one edit.

States are shared by all acceptors of one register: a state is the set of endings it
accepts, so two equal states accept the same endings, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise


class Register:
    """States by what they accept. ``arcs[q]`` maps a character to a state and the number of words before it; ``size[q]`` words are accepted from q."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []

    def state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        signature = (final, *arcs)
        q = self.known.get(signature)
        if q is None:
            q = self.known[signature] = len(self.arcs)
            before, out = int(final), {}
            for c, target in arcs:
                out[c] = (target, before)
                before += self.size[target]
            self.arcs.append(out)
            self.final.append(final)
            self.size.append(before)
        return q

    def acceptor(self, words: list[str]) -> int:
        """Initial state of the minimal acceptor of distinct words in ascending order.

        A state is closed, and known from then on, as soon as no later word passes it. The words' places
        are the sums of the numbers along their paths.
        """
        open_: list[tuple[bool, list[tuple[str, int]]]] = [(bool(words) and not words[0], [])]

        def close(depth: int, word: str) -> None:
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                open_[-1][1].append((word[len(open_) - 1], self.state(final, arcs)))

        for word, after in pairwise([*words, ""]):
            for _ in range(len(word) - len(open_) + 1):
                open_.append((False, []))
            if word:
                open_[-1] = (True, open_[-1][1])
            shared = 0
            while shared < len(word) and shared < len(after) and word[shared] == after[shared]:
                shared += 1
            close(shared, word)
        return self.state(*open_[0])

    def replaced(self, start: int) -> Iterator[tuple[int, int]]:
        """Places of words of one acceptor that differ in one replaced character, the smaller one first."""
        todo = [(start, 0)]
        while todo:
            q, place = todo.pop()
            arcs = list(self.arcs[q].items())
            for i, (_, (p, a)) in enumerate(arcs):
                todo.append((p, place + a))
                for _, (r, b) in arcs[i + 1 :]:
                    yield from self._alike(p, r, place + a, place + b)

    def inserted(self, start: int, longer: int, at_end: bool) -> Iterator[tuple[int, int]]:
        """Places of words of the first acceptor and of the second that have one character more.

        The character stands where the two words first differ; ``at_end`` allows it behind the shorter word.
        """
        todo = [(start, longer, 0, 0)]
        while todo:
            q, r, place, other = todo.pop()
            ours, theirs = self.arcs[q], self.arcs[r]
            for c, (after, b) in theirs.items():
                if c in ours:
                    p, a = ours[c]
                    todo.append((p, after, place + a, other + b))
                if at_end and self.final[q] and self.final[after]:
                    yield place, other + b
                beyond = self.arcs[after]
                for x in ours.keys() & beyond.keys():
                    if x != c:
                        (p, a), (s, d) = ours[x], beyond[x]
                        yield from self._alike(p, s, place + a, other + b + d)

    def _alike(self, p: int, q: int, place: int, other: int) -> Iterator[tuple[int, int]]:
        """Places of the endings that both states accept: the edit is made, so the rest is the same."""
        todo = [(p, q, place, other)]
        while todo:
            p, q, place, other = todo.pop()
            if p == q:
                yield from zip(range(place, place + self.size[p]), range(other, other + self.size[p]))
                continue
            if self.final[p] and self.final[q]:
                yield place, other
            ours, theirs = self.arcs[p], self.arcs[q]
            for c in ours.keys() & theirs.keys():
                (s, a), (t, b) = ours[c], theirs[c]
                todo.append((s, t, place + a, other + b))
