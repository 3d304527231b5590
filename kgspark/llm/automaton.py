"""Regular expressions to one minimal deterministic automaton over bytes.

``parse`` reads a small regex language (literals, escapes, classes, groups,
alternation, ``? + * {m} {m,} {m,n}``, inline ``(?i:...)`` groups for letters in
either case). ``Automaton`` joins any number of rules by subset construction,
merges equivalent states by partition refinement and keeps the transitions as
rows of row references, one column for each class of bytes that no rule tells apart.

The automaton yields spans, not only a verdict: for each rule its leftmost, then
longest, non-overlapping matches. So a subset is ordered: for each rule a list of
attempts, the oldest first, each a set of the rule's NFA states. An attempt loses
states that an older one holds (the older one wins whatever follows), and an
attempt that accepts ends all newer ones, which began inside its match. The start
of an attempt whose states all lie at one depth follows from that depth; all other
starts are registers, and the few transitions that set or read one carry an
operation. Bytes that do neither cost one table step for all rules together.
"""

from __future__ import annotations

from operator import length_hint

import numpy as np

# A pattern is a tree: ("set", frozenset of bytes), ("cat", [..]), ("alt", [..]), ("rep", node, least, most or None).


def _fold(bytes_: set[int]) -> set[int]:
    return {c for b in bytes_ for c in ({b, b ^ 32} if chr(b).isalpha() and b < 128 else {b})}


class _Parser:
    def __init__(self, pattern: str) -> None:
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        c = self.s[self.i]
        self.i += 1
        return c

    def alternation(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node: tuple) -> tuple:
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                body = self.s[self.i : self.s.index("}", self.i)]
                self.i += len(body) + 1
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "r": "\r", "t": "\t"}.get(c, c))

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            was = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            node = self.alternation()
            if self.take() != ")":
                raise ValueError(f"group not closed in {self.s}")
            self.fold = was
            return node
        if c == "[":
            chosen: set[int] = set()
            negated = self.peek() == "^"
            self.i += negated
            while (c := self.take()) != "]":
                low = self.escape() if c == "\\" else ord(c)
                high = low
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.take()
                    high = self.escape() if (c := self.take()) == "\\" else ord(c)
                chosen |= set(range(low, high + 1))
            chosen = _fold(chosen) if self.fold else chosen
            return ("set", frozenset(set(range(256)) - chosen if negated else chosen))
        if c == ".":
            return ("set", frozenset(set(range(256)) - {10}))
        byte = self.escape() if c == "\\" else ord(c)
        return ("set", frozenset(_fold({byte}) if self.fold else {byte}))


def parse(pattern: str) -> tuple:
    p = _Parser(pattern)
    node = p.alternation()
    if p.peek():
        raise ValueError(f"unread: {p.s[p.i:]}")
    return node


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node: tuple, start: int) -> int:
        """Build ``node`` from ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for option in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(option, first)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end


#: A start that is read from a register, or follows from the depth of an attempt; and the matches that wait for an attempt to end.
_HELD, _DEPTH, _WAIT = "held", "depth", "wait"


class Automaton:
    """Minimal DFA of several rules, none of which may match the empty string."""

    def __init__(self, patterns: list[str]) -> None:
        nfa = _Nfa()
        self._roots, self._finals = [], []
        for pattern in patterns:
            self._roots.append(nfa.state())
            self._finals.append(nfa.add(parse(pattern), self._roots[-1]))
        self.classes, members = self._byte_classes(nfa)
        self.stop = members  # the class of the end of the data
        self._close(nfa)
        if any(f in self._first[k] for k, f in enumerate(self._finals)):
            raise ValueError("a rule matches the empty string")
        self._fix_depths(nfa)
        table, ops = self._subsets(members + 1)
        self.table, self.ops = self._minimise(table, ops)
        for name in [n for n in self.__dict__ if n.startswith("_")]:
            delattr(self, name)
        self._link()

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> tuple[bytes, int]:
        """Bytes that belong to the same sets of moves share a class."""
        sets = sorted({chars for moves in nfa.moves for chars, _ in moves}, key=sorted)
        seen: dict[tuple, int] = {}
        classes = bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256))
        return classes, len(seen)

    def _close(self, nfa: _Nfa) -> None:
        """For each state and class of bytes the states that follow, free moves included."""
        finals = set(self._finals)

        def closure(state: int) -> frozenset[int]:
            seen, todo = {state}, [state]
            while todo:
                for nxt in nfa.free[todo.pop()]:
                    if nxt not in seen:
                        seen.add(nxt)
                        todo.append(nxt)
            return frozenset(s for s in seen if nfa.moves[s] or s in finals)

        closures = [closure(s) for s in range(len(nfa.moves))]
        self._first = [closures[r] for r in self._roots]
        self._next: list[dict[int, frozenset[int]]] = []
        for moves in nfa.moves:
            to: dict[int, frozenset[int]] = {}
            for chars, nxt in moves:
                for c in {self.classes[b] for b in chars}:
                    to[c] = to.get(c, frozenset()) | closures[nxt]
            self._next.append(to)

    def _fix_depths(self, nfa: _Nfa) -> None:
        """Bytes from a rule's begin to each state, or None where paths differ."""
        self._depth: dict[int, int | None] = {}
        todo: list[tuple[int, int | None]] = [(r, 0) for r in self._roots]
        while todo:
            state, depth = todo.pop()
            if state in self._depth:
                if self._depth[state] is None or self._depth[state] == depth:
                    continue
                depth = None
            self._depth[state] = depth
            todo += [(nxt, depth) for nxt in nfa.free[state]]
            todo += [(nxt, None if depth is None else depth + 1) for _, nxt in nfa.moves[state]]

    def _source(self, attempts: tuple, j: int) -> tuple[str, int]:
        """Where the start of attempt ``j`` is found."""
        if self._stored(attempts[j]):
            return _HELD, sum(map(self._stored, attempts[:j]))
        return _DEPTH, self._depth[next(iter(attempts[j][0]))]

    def _stored(self, attempt: tuple) -> bool:
        return attempt[1] or attempt[2] or any(self._depth[s] is None for s in attempt[0])

    def _step(self, k: int, attempts: tuple, c: int) -> tuple[tuple, tuple | None]:
        """Attempts of rule ``k`` after a byte of class ``c``, and what the registers have to do.

        An attempt is (states, whether it has matched, whether matches wait for
        it). A match of an attempt that ends waits for the next older one, whose
        own match would contain its begin. The operation is (rule, matches that
        are final, new registers); a register has a source of the start, whether
        the end is here (else: as held), and the matches that wait.
        """
        final, taken, moved = self._finals[k], set(), []
        for j, (states, _, _) in enumerate(attempts):
            to = frozenset().union(*(self._next[s].get(c, frozenset()) for s in states)) - taken
            taken |= to
            moved.append((to, j))
        if c != self.stop:
            moved.append((frozenset().union(*(self._next[s].get(c, frozenset()) for s in self._first[k])) - taken, None))
        winner = next((i for i, (to, _) in enumerate(moved) if final in to), len(moved))
        done: list[tuple] = []
        live: list[tuple] = []
        for to, j in moved[: winner + 1]:
            states, matched, waiting = (frozenset(), False, False) if j is None else attempts[j]
            source = (_DEPTH, 0) if j is None else self._source(attempts, j)
            here = final in states and final not in to
            own = [(_WAIT, source[1], False)] if waiting else []
            if to:
                live.append((to, matched or final in to, source, here, [] if final in to else own))
            else:
                (live[-1][-1] if live else done).extend(([(*source, here)] if matched else []) + own)
        after = tuple((to, matched, bool(wait)) for to, matched, _, _, wait in live)
        registers = tuple((source, here, tuple(wait)) for (_, _, source, here, wait), attempt in zip(live, after, strict=True) if self._stored(attempt))
        same = not done and len(registers) == sum(map(self._stored, attempts)) and all(r in (((_HELD, i), False, ()), ((_HELD, i), False, ((_WAIT, i, False),))) for i, r in enumerate(registers))
        return after, None if same else (k, tuple(done), registers)

    def _subsets(self, width: int) -> tuple[np.ndarray, list[tuple]]:
        """All reachable (attempts of all rules, operation on arrival) and their transitions."""
        rules = range(len(self._roots))
        begin = (tuple(() for _ in rules), ())
        index, order, rows = {begin: 0}, [begin], []
        memo: dict[tuple, tuple] = {}
        for config, _ in order:
            row = []
            for c in range(width):
                parts = []
                for k in rules:
                    key = k, config[k], c
                    if key not in memo:
                        memo[key] = self._step(*key)
                    parts.append(memo[key])
                target = tuple(p[0] for p in parts), tuple(p[1] for p in parts if p[1])
                if target not in index:
                    index[target] = len(order)
                    order.append(target)
                row.append(index[target])
            rows.append(row)
        return np.array(rows, dtype=np.int64), [ops for _, ops in order]

    @staticmethod
    def _minimise(table: np.ndarray, ops: list[tuple]) -> tuple[np.ndarray, list[tuple]]:
        """Refine the partition by operations until no class of bytes splits a block; the begin stays state 0."""
        names: dict[tuple, int] = {}
        block = np.array([names.setdefault(op, len(names)) for op in ops])
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        first = np.unique(block, return_index=True)[1]
        order = np.argsort(first)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return place[block[table[first[order]]]], [ops[i] for i in first[order].tolist()]

    def _link(self) -> None:
        """Rows as lists of row references; the last entry is the operation on arrival."""
        width = self.table.shape[1]
        self.rows = [[None] * width + [op] for op in self.ops]
        for row, targets in zip(self.rows, self.table.tolist(), strict=True):
            row[:width] = [self.rows[t] for t in targets]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._link()

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of every rule's leftmost, then longest, non-overlapping matches, in one pass over the bytes."""
        row, out = self.rows[0], []
        held: dict[int, list[tuple[int, int, list]]] = {}
        codes = data.translate(self.classes) + bytes([self.stop])
        steps = iter(codes)
        for c in steps:
            row = row[c]
            if row[-1]:
                at = len(codes) - length_hint(steps) - 1  # bytes before this one
                for k, done, registers in row[-1]:
                    old = held.get(k, [])

                    def matches(items: tuple, old: list = old, k: int = k, at: int = at) -> list[tuple[int, int, int]]:
                        found = []
                        for how, n, here in items:
                            found += old[n][2] if how == _WAIT else [(old[n][0], k, at if here else old[n][1])]
                        return found

                    if done:
                        out += matches(done)
                    held[k] = [(old[n][0] if how == _HELD else at - n, at if here or how != _HELD else old[n][1], matches(wait)) for (how, n), here, wait in registers]
        return out
