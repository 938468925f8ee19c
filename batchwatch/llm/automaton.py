"""Deterministic automata over bytes: regex -> NFA -> subset construction -> minimisation -> transition arrays."""

from __future__ import annotations

import re._constants as C
import re._parser as sre
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Nfa:
    """Edges are (source, byte set, target); a byte set of None is an empty move."""

    edges: list[tuple[int, frozenset[int] | None, int]] = field(default_factory=list)
    size: int = 0

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, items, start: int, ignore_case: bool) -> int:
        """Append a parsed regex behind ``start``; returns its last state."""
        for op, arg in items:
            start = self._item(op, arg, start, ignore_case)
        return start

    def _item(self, op, arg, start: int, ignore_case: bool) -> int:
        if op in (C.LITERAL, C.IN, C.ANY, C.NOT_LITERAL):
            end = self.state()
            self.edges.append((start, _bytes(op, arg, ignore_case), end))
            return end
        if op is C.SUBPATTERN:
            return self.add(arg[3], start, ignore_case)
        if op is C.BRANCH:
            end = self.state()
            for branch in arg[1]:
                self.edges.append((self.add(branch, start, ignore_case), None, end))
            return end
        if op is C.MAX_REPEAT:
            least, most, body = arg
            for _ in range(least):
                start = self.add(body, start, ignore_case)
            if most is C.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.edges += [(start, None, loop), (loop, None, end), (self.add(body, loop, ignore_case), None, loop)]
                return end
            end = self.state()
            self.edges.append((start, None, end))
            for _ in range(most - least):
                start = self.add(body, start, ignore_case)
                self.edges.append((start, None, end))
            return end
        raise ValueError(f"regex item {op} has no automaton here")


def _bytes(op, arg, ignore_case: bool) -> frozenset[int]:
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    if op is C.LITERAL:
        got = {arg}
    elif op is C.NOT_LITERAL:
        got = set(range(256)) - {arg}
    else:
        got, negate = set(), False
        for kind, value in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                got.add(value)
            elif kind is C.RANGE:
                got.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"class item {kind} has no automaton here")
        if negate:
            got = set(range(256)) - got
    if ignore_case:
        got |= {b ^ 32 for b in got if 65 <= b & ~32 <= 90}
    return frozenset(got)


@dataclass
class Dfa:
    """``table[state * classes + class_of[byte]]`` is the next state times ``classes``. States are numbered so that
    those from ``accepting`` on accept; ``marks[state]`` has the rules they accept. State 0 is the first one."""

    table: list[int]
    class_of: bytes
    classes: int
    first: int
    accepting: int
    marks: list[tuple[int, ...]]
    dead: int

    @property
    def states(self) -> int:
        return len(self.marks)


def compile_dfa(patterns: list[tuple[str, bool]], backwards: bool) -> Dfa:
    """One automaton for all (regex, ignore case) rules. Forwards it is anchored at its first byte and accepts whole
    matches. Backwards it reads a text from its end and accepts where a match of a rule starts."""
    nfa, ends = Nfa(), []
    for pattern, ignore_case in patterns:
        start = nfa.state()
        ends.append((start, nfa.add(sre.parse(pattern), start, ignore_case)))
    edges = [(t, b, s) for s, b, t in nfa.edges] if backwards else nfa.edges
    begins = {e if backwards else s for s, e in ends}
    goal = {(s if backwards else e): k for k, (s, e) in enumerate(ends)}

    empty, moves = [[] for _ in range(nfa.size)], [[] for _ in range(nfa.size)]
    for s, b, t in edges:
        (empty[s].append(t) if b is None else moves[s].append((b, t)))
    signature = [tuple(byte in b for _, b, _ in edges if b is not None) for byte in range(256)]
    kinds = {sig: k for k, sig in enumerate(dict.fromkeys(signature))}
    class_of = bytes(kinds[sig] for sig in signature)
    sample = [class_of.index(k) for k in range(len(kinds))]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    subsets = {closure(begins): 0}
    order, table = list(subsets), []
    for subset in order:  # grows while it is read
        row = []
        for byte in sample:
            reached = {t for s in subset for b, t in moves[s] if byte in b}
            target = closure(reached | begins if backwards else reached)
            if target not in subsets:
                subsets[target] = len(order)
                order.append(target)
            row.append(subsets[target])
        table.append(row)
    marks = [tuple(sorted(goal[s] for s in subset if s in goal)) for subset in order]
    return _minimal(np.array(table, dtype=np.int64), marks, class_of, len(kinds), order.index(frozenset()) if frozenset() in subsets else -1)


def _minimal(table: np.ndarray, marks: list[tuple[int, ...]], class_of: bytes, classes: int, dead: int) -> Dfa:
    """Merge states that no input tells apart: split by what they accept, then by where their bytes lead."""
    names = {m: k for k, m in enumerate(sorted(set(marks)))}
    block = np.array([names[m] for m in marks])
    while True:
        _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            break
        block = new
    _, one = np.unique(block, return_index=True)
    rank = np.argsort(np.argsort([bool(marks[i]) for i in one], kind="stable"), kind="stable")  # accepting states last
    one = one[np.argsort(rank)]
    small = rank[block[table[one]]]
    return Dfa(
        (small * classes).ravel().tolist(), class_of, classes, int(rank[block[0]]) * classes,
        sum(not marks[i] for i in one) * classes, [marks[i] for i in one], int(rank[block[dead]]) * classes if dead >= 0 else -1,
    )
