"""Regular expressions over bytes to one minimal combined automaton.

parse -> Thompson NFA -> subset construction for all rules at once -> partition
refinement -> transition rows. The dialect is what secret rules need: literals,
classes, groups, alternation, ?, *, +, {m}, {m,} and {m,n}.
"""

from __future__ import annotations


class Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


class _Reader:
    """Recursive descent to a tree of tuples."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.p, self.i, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def choice(self):
        options = [self.chain()]
        while self.peek() == "|":
            self.take()
            options.append(self.chain())
        return options[0] if len(options) == 1 else ("or", options)

    def chain(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.counted())
        return ("then", parts)

    def counted(self):
        part = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                a, comma, b = body.partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            part = ("times", part, low, high)
        return part

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def fold(self, values) -> frozenset[int]:
        out = set(values)
        if self.any_case:
            out |= {v ^ 32 for v in out if 65 <= v & ~32 <= 90}
        if max(out) > 255:
            raise ValueError("only bytes can be matched")
        return frozenset(out)

    def atom(self):
        if self.peek() == "(":
            self.take()
            inner = self.choice()
            if self.take() != ")":
                raise ValueError("unbalanced group")
            return inner
        if self.peek() == "[":
            self.take()
            inverted = self.peek() == "^" and bool(self.take())
            out: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    out |= set(range(low, self.byte() + 1))
                else:
                    out.add(low)
            self.take()
            chosen = self.fold(out)
            return ("set", frozenset(range(256)) - chosen if inverted else chosen)
        return ("set", self.fold({self.byte()}))


def parse(pattern: str, any_case: bool = False):
    reader = _Reader(pattern, any_case)
    tree = reader.choice()
    if reader.i != len(pattern):
        raise ValueError(f"can't read {pattern!r} from {reader.i}")
    return tree


def reverse(tree):
    kind = tree[0]
    if kind == "then":
        return ("then", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    if kind == "times":
        return ("times", reverse(tree[1]), *tree[2:])
    return tree


def shortest(tree):
    """Without the repetitions at its end: every match begins with a match of this, and every match of this is one."""
    kind = tree[0]
    if kind == "times":
        return ("times", shortest(tree[1]), 1, 1) if tree[2] == 1 else ("times", tree[1], tree[2], tree[2])
    if kind == "or":
        return ("or", [shortest(x) for x in tree[1]])
    if kind == "then":
        parts = list(tree[1])
        while parts and parts[-1][0] == "times" and parts[-1][2] == 0:
            parts.pop()
        return ("then", [*parts[:-1], *map(shortest, parts[-1:])])
    return tree


def build(nfa: Nfa, tree, start: int) -> int:
    """Add the tree behind `start`; returns its last state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "then":
        for part in tree[1]:
            start = build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for part in tree[1]:
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.empty[build(nfa, part, first)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = build(nfa, part, start)
    end = nfa.state()
    if high is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[build(nfa, part, loop)].append(loop)
        nfa.empty[loop].append(end)
        return end
    for _ in range(high - low):
        nfa.empty[start].append(end)
        start = build(nfa, part, start)
    nfa.empty[start].append(end)
    return end


class Dfa:
    """classes: 256 bytes, the class of each byte; rows: next state by class; accepts: the rules that end in a state. State 0 starts."""

    def __init__(self, classes: bytes, rows: list[list[int]], accepts: list[frozenset[int]], dead: int | None) -> None:
        self.classes, self.rows, self.accepts, self.dead = classes, rows, accepts, dead

    def longest(self, data: bytes, start: int, stop: int, step: int = 1) -> int | None:
        """Where the longest accepted run from `start` towards `stop` (not read) ends, None if none."""
        state, best, i = 0, None, start
        while i != stop:
            state = self.rows[state][self.classes[data[i]]]
            if state == self.dead:
                break
            i += step
            if self.accepts[state]:
                best = i
        return best


def compile_rules(trees: list, search: bool) -> Dfa:
    """One minimal automaton for all trees; search: a match may start at any byte."""
    nfa = Nfa()
    root, ends = nfa.state(), {}
    for rule, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[build(nfa, tree, first)] = rule
    # bytes that no rule tells apart share a class
    marks = [frozenset(i for i, s in enumerate(dict.fromkeys(s for row in nfa.moves for s, _ in row)) if b in s) for b in range(256)]
    kinds = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    classes = bytes(kinds[m] for m in marks)
    sample = [classes.index(k) for k in range(len(kinds))]
    start = nfa.closure([root])
    names, order, rows = {start: 0}, [start], []
    for states in order:
        row = []
        for byte in sample:
            target = nfa.closure([to for s in states for on, to in nfa.moves[s] if byte in on] + [root] * search)
            if target not in names:
                names[target] = len(order)
                order.append(target)
            row.append(names[target])
        rows.append(row)
    accepts = [frozenset(ends[s] for s in states if s in ends) for states in order]
    # refine the partition by accepted rules until successors agree
    block = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    part, count = [block[a] for a in accepts], 0
    while count != len(set(part)):
        count, seen = len(set(part)), {}
        part = [seen.setdefault((part[s], *(part[t] for t in rows[s])), len(seen)) for s in range(len(rows))]
    first = {}
    for s, p in enumerate(part):
        first.setdefault(p, s)
    small = [[part[t] for t in rows[first[p]]] for p in range(count)]
    accepted = [accepts[first[p]] for p in range(count)]
    dead = next((p for p in range(count) if not accepted[p] and set(small[p]) == {p}), None)
    return Dfa(classes, small, accepted, dead)
