"""Regular expressions over bytes compiled to minimal deterministic automata, as arrays of transitions.

The syntax is a small part of the usual one: literals, \\xNN and escaped characters, [classes], (groups), (?i:groups in
either ASCII case), |, ?, *, +, {m}, {m,}, {m,n}. A tree is built, then an automaton with empty moves (Thompson), then
sets of its states (subset construction) over classes of bytes that no rule tells apart, then the coarsest partition of
those that keeps what they accept (Moore).
"""

from __future__ import annotations

import numpy as np

ALL = frozenset(range(256))


class Parser:
    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} in {self.text!r}")
        return tree

    def either(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def sequence(self):
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeated())
        return ("then", found)

    def repeated(self):
        tree = self.atom()
        while self.peek() in ("?", "*", "+", "{"):
            sign = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign, (0, 0))
            if sign == "{":
                end = self.text.index("}", self.at)
                a, comma, b = self.text[self.at : end].partition(",")
                low, high, self.at = int(a), (int(b) if b else None) if comma else int(a), end + 1
            tree = ("times", tree, low, high)
        return tree

    def atom(self):
        sign = self.take()
        if sign == "(":
            fold = self.fold
            if self.text.startswith("?", self.at):
                head = self.text[self.at : self.text.index(":", self.at) + 1]
                if head not in ("?:", "?i:"):
                    raise ValueError(f"unknown group {head!r}")
                self.at, self.fold = self.at + len(head), fold or head == "?i:"
            tree = self.either()
            self.fold = fold
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            self.take()
            return tree
        if sign == "[":
            return ("byte", self.members())
        return ("byte", self.folded({self.escaped() if sign == "\\" else ord(sign)}))

    def escaped(self) -> int:
        sign = self.take()
        if sign == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(sign, ord(sign))

    def members(self) -> frozenset:
        negated, found = self.peek() == "^", set()
        self.at += negated
        while self.peek() != "]" or not found and not negated and self.peek() == "":
            a = self.escaped() if (c := self.take()) == "\\" else ord(c)
            b = a
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                b = self.escaped() if (c := self.take()) == "\\" else ord(c)
            found |= set(range(a, b + 1))
        self.take()
        found = self.folded(found)
        return ALL - found if negated else found

    def folded(self, found: set) -> frozenset:
        if max(found, default=0) > 127:
            raise ValueError("only ASCII literals")
        return frozenset(ord(c) for b in found for c in ((chr(b).lower(), chr(b).upper()) if self.fold else chr(b)))


class Moves:
    """An automaton with empty moves."""

    def __init__(self):
        self.on: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def build(self, tree, start: int, backward: bool = False) -> int:
        """Adds what reads tree from start on; returns the state in which it has been read."""
        kind = tree[0]
        if kind == "byte":
            end = self.state()
            self.on[start].append((tree[1], end))
            return end
        if kind == "then":
            for part in reversed(tree[1]) if backward else tree[1]:
                start = self.build(part, start, backward)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.build(part, first, backward)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.build(part, start, backward)
        if high is None:
            first, end = self.state(), self.state()
            self.free[start] += [first, end]
            self.free[self.build(part, first, backward)] += [first, end]
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.build(part, start, backward)
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


class Automaton:
    """classes: the class of each byte; moves[state, class]: the next state; accepts[state]: a bit for each rule. Starts in 0."""

    def __init__(self, classes: np.ndarray, moves: np.ndarray, accepts: np.ndarray):
        self.classes, self.moves, self.accepts = classes, moves, accepts
        #: States that can't be left and accept nothing.
        self.dead = np.flatnonzero((moves == np.arange(len(moves))[:, None]).all(1) & (accepts == 0))

    def run(self, data: bytes, backward: bool = False) -> int:
        """The longest prefix (suffix, if backward) of data that is accepted; -1 if none is."""
        rows, accepts, dead = self.lists()
        state, found = 0, 0 if accepts[0] else -1
        for n, b in enumerate(reversed(data) if backward else data, 1):
            state = rows[state][b]
            if accepts[state]:
                found = n
            elif state in dead:
                break
        return found

    def lists(self):
        if not hasattr(self, "_lists"):
            self._lists = self.moves[:, self.classes].tolist(), self.accepts.tolist(), set(self.dead.tolist())
        return self._lists


def compiled(pattern: str, anywhere: bool = False, backward: bool = False) -> Automaton:
    """The minimal automaton of a pattern; anywhere: a match may begin at each byte; backward: texts are read from their end."""
    nfa = Moves()
    root = nfa.state()
    end = nfa.build(Parser(pattern).parse(), root, backward)
    if anywhere:
        start = nfa.state()
        nfa.free[start].append(root)
        nfa.on[start].append((ALL, start))
        root = start
    sets = list({s for moves in nfa.on for s, _ in moves})
    classes, example = told_apart([tuple(b in s for s in sets) for b in range(256)])
    step = lambda states, b: nfa.closed({t for s in states for on, t in nfa.on[s] if b in on})
    todo, table = reached(nfa.closed([root]), step, example)
    return minimal(classes, table, np.array([end in states for states in todo], np.int64))


def combined(patterns: list[str]) -> Automaton:
    """One minimal automaton for matches of all patterns that may begin anywhere.

    The sets of states are built for each pattern first and made minimal, then for all together, so that the many sets of
    one pattern don't multiply with those of another.
    """
    each = [compiled(p, anywhere=True) for p in patterns]
    classes, example = told_apart([tuple(int(a.classes[b]) for a in each) for b in range(256)])
    rows = [a.moves[:, a.classes].tolist() for a in each]
    step = lambda states, b: tuple(r[s][b] for r, s in zip(rows, states))
    todo, table = reached((0,) * len(each), step, example)
    return minimal(classes, table, np.array([sum(int(a.accepts[s]) << k for k, (a, s) in enumerate(zip(each, states))) for states in todo], np.int64))


def told_apart(kinds: list[tuple]) -> tuple[np.ndarray, list[int]]:
    """Classes of bytes of the same kind, and a byte of each class."""
    number: dict[tuple, int] = {}
    classes = np.array([number.setdefault(k, len(number)) for k in kinds], np.uint8)
    return classes, [int(np.flatnonzero(classes == c)[0]) for c in range(len(number))]


def reached(start, step, example: list[int]) -> tuple[list, np.ndarray]:
    """All states from start on, and the number of the next state by state and class."""
    found, todo, table = {start: 0}, [start], []
    for states in todo:  # grows meanwhile
        row = []
        for b in example:
            after = step(states, b)
            if after not in found:
                found[after] = len(found)
                todo.append(after)
            row.append(found[after])
        table.append(row)
    return todo, np.array(table, np.int32)


def minimal(classes: np.ndarray, moves: np.ndarray, accepts: np.ndarray) -> Automaton:
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first)  # the start state's block holds state 0, so it comes first
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return Automaton(classes, rank[block[moves[first[order]]]].astype(np.int32), accepts[first[order]])


class Scanner:
    """A forward automaton over a buffer of many texts: the buffer is cut into equal lanes that are stepped together.

    A lane begins in the start state, as most texts allow after a byte or two. Where the lane before ends in another state, the
    lane is stepped again from that one, until it comes to a state that it had been in there; the rest holds. States in
    which lanes really begin are few, so each is tried on all lanes at once, and the lanes' ends are then followed.
    """

    def __init__(self, automaton: Automaton):
        self.automaton, self.width = automaton, automaton.moves.shape[1]
        self.table = (automaton.moves * self.width).ravel().astype(np.int32)  # states are held as the place of their row
        self.accepting = np.repeat(automaton.accepts != 0, self.width)
        if automaton.moves[:, automaton.classes[10]].any() or automaton.accepts[0]:
            raise ValueError("no rule may match a line feed or nothing at all")

    def ends(self, buffer: bytes, lanes: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """For each byte after which rules accept: its place, ascending, and the rules' bits. buffer ends with a line feed."""
        n = len(buffer)
        lanes = max(1, min(lanes, n // 64))
        size = -(-n // lanes)
        data = np.frombuffer(buffer + b"\n" * (lanes * size - n), np.uint8).reshape(lanes, size)
        classes = np.ascontiguousarray(self.automaton.classes[data].T).astype(np.int32)  # by step and lane
        state, states = np.zeros(lanes, np.int32), np.empty_like(classes)
        for i in range(size):
            state = self.table[state + classes[i]]
            states[i] = state
        starts = self.true_starts(classes, states)
        self.step_again(classes, states, np.flatnonzero(starts), starts, write=True)
        step, lane = np.nonzero(self.accepting[states])
        places = lane * size + step
        order = np.argsort(places, kind="stable")
        return places[order], self.automaton.accepts[states[step, lane][order] // self.width]

    def step_again(self, classes: np.ndarray, states: np.ndarray, lanes: np.ndarray, starts: np.ndarray, write: bool = False) -> np.ndarray:
        """The last states of lanes that begin in starts[lane]; write: their new states are put into states."""
        last, state = states[-1].copy(), starts[lanes]
        for i in range(len(classes)):
            state = self.table[state + classes[i, lanes]]
            other = state != states[i, lanes]
            lanes, state = lanes[other], state[other]
            if not len(lanes):
                break
            if write:
                states[i, lanes] = state
        last[lanes] = state
        return last

    def true_starts(self, classes: np.ndarray, states: np.ndarray) -> np.ndarray:
        lanes = len(classes[0])
        last = {0: states[-1].tolist()}  # by the state that lanes begin in
        starts, state = np.zeros(lanes, np.int32), 0
        for k in range(lanes):
            if state not in last:
                last[state] = self.step_again(classes, states, np.arange(k, lanes), np.full(lanes, state, np.int32)).tolist()
            starts[k] = state
            state = last[state][k]
        return starts
