"""Secret scan: all rules in one minimised deterministic automaton over bytes, run in one pass."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
from pyspark.sql import DataFrame

from .common import kept_in_worker, per_batch, whole_texts


@dataclass(frozen=True)
class Rule:
    """``head`` then one or more bytes of class ``body``, taken as far as they go.

    ``fold``: letters of the head in either case. ``run``: bytes of the body that the automaton itself asks for.
    ``keep``: shortest body, ``least``: shortest match that counts; a match that is shorter is dropped, but the text
    it covers is used up. Heads must not hold one another.
    """

    name: str
    head: str
    body: str
    fold: bool = False
    run: int = 1
    keep: int = 1
    least: int = 1


# The three base rules, then further well-known forms of credentials. The trace has a byte for each combination of marks that occurs, which these fill well; many more rules would need another scanner.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", fold=True, keep=6),
    Rule("access", "AKIA", "[A-Z0-9]", least=20),
    Rule("hex", "", "[0-9a-f]", run=24, least=24),
)
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", keep=30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY----", "-"),
    Rule("gitlab", "glpat-", "[A-Za-z0-9_-]", keep=20),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", keep=10),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]", keep=16),
)


class _Nfa:
    """Thompson's construction for literals, classes, groups, ``|``, ``?``, ``*`` and ``+``."""

    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, pattern: str, start: int, fold: bool) -> int:
        """Hangs ``pattern`` onto ``start`` and returns its last state."""
        end, at = self._either(pattern, 0, start, fold)
        if at != len(pattern):
            raise ValueError(f"can't read {pattern[at:]!r}")
        return end

    def _either(self, p: str, i: int, start: int, fold: bool) -> tuple[int, int]:
        end = self.state()
        while True:
            last, i = self._sequence(p, i, start, fold)
            self.free[last].append(end)
            if i >= len(p) or p[i] != "|":
                return end, i
            i += 1

    def _sequence(self, p: str, i: int, at: int, fold: bool) -> tuple[int, int]:
        while i < len(p) and p[i] not in "|)":
            begin = self.state()
            self.free[at].append(begin)
            if p[i] == "(":
                last, i = self._either(p, i + 1, begin, fold)
                i += 1
            else:
                chars, i = _bytes(p, i, fold)
                last = self.state()
                self.step[begin].append((chars, last))
            if i < len(p) and p[i] in "?*+":
                after = self.state()
                self.free[last].append(after)
                if p[i] in "?*":
                    self.free[begin].append(after)
                if p[i] in "*+":
                    self.free[last].append(begin)
                last, i = after, i + 1
            at = last
        return at, i

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def backwards(self) -> _Nfa:
        other = _Nfa()
        for _ in self.step:
            other.state()
        for s, moves in enumerate(self.step):
            for chars, t in moves:
                other.step[t].append((chars, s))
            for t in self.free[s]:
                other.free[t].append(s)
        return other


def _bytes(p: str, i: int, fold: bool) -> tuple[frozenset[int], int]:
    def one(i: int) -> tuple[int, int]:
        if p[i] == "\\":
            return (int(p[i + 2 : i + 4], 16), i + 4) if p[i + 1] == "x" else (ord(p[i + 1]), i + 2)
        return ord(p[i]), i + 1

    found: set[int] = set()
    if p[i] == "[":
        i += 1
        while p[i] != "]":
            low, i = one(i)
            high = low
            if p[i] == "-" and p[i + 1] != "]":
                high, i = one(i + 1)
            found |= set(range(low, high + 1))
        i += 1
    else:
        c, i = one(i)
        found.add(c)
    if fold:
        found |= {ord(chr(c).swapcase()) for c in found if chr(c).isascii() and chr(c).isalpha()}
    return frozenset(found), i


def subsets(nfa: _Nfa, start: set[int], floating: bool) -> tuple[np.ndarray, list[frozenset[int]]]:
    """Transition array (states x 256) by subset construction. ``floating``: a match may begin at every byte."""
    first = nfa.closure(start)
    number, order, rows = {first: 0}, [first], []
    for members in order:  # grows meanwhile
        goal: list[set[int]] = [set() for _ in range(256)]
        for s in members:
            for chars, t in nfa.step[s]:
                for c in chars:
                    goal[c].add(t)
        row, seen = [], {}
        for g in goal:
            key = frozenset(g)
            if key not in seen:
                target = nfa.closure(g) | (first if floating else frozenset())
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                seen[key] = number[target]
            row.append(seen[key])
        rows.append(row)
    return np.array(rows, np.int32), order


def minimised(moves: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges states that no text tells apart (Moore); the first state stays first."""
    _, group = np.unique(tags, return_inverse=True)
    n = group.max() + 1
    while True:
        _, group = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        group = group.ravel()
        if group.max() + 1 == n:
            break
        n = group.max() + 1
    place = np.unique(group, return_index=True)[1]
    rank = np.argsort(np.argsort(place))  # by first member, so that state 0 stays 0
    place = np.sort(place)
    return rank[group[moves[place]]], tags[place]


@dataclass
class Automaton:
    """``moves``: state x byte; ``tags``: per state a bit pair for each rule, its body has just become long enough / goes on."""

    rules: tuple[Rule, ...]
    moves: np.ndarray
    tags: np.ndarray
    back: list[tuple[np.ndarray, np.ndarray]]

    def rows(self) -> list[list]:
        """The transition array as lists that hold one another, ending in the number of the state's tags."""
        self.kinds, number = np.unique(self.tags, return_inverse=True)
        rows: list[list] = [[] for _ in range(len(self.moves))]
        for row, move, k in zip(rows, self.moves.tolist(), number.tolist()):
            row.extend(rows[t] for t in move)
            row.append(k)
        return rows


def compile_rules(rules: tuple[Rule, ...] = BASE + MORE) -> Automaton:
    nfa = _Nfa()
    start = nfa.state()
    marks: list[tuple[int, int]] = []
    back = []
    for rule in rules:
        chars = _bytes(rule.body, 0, False)[0]
        at = nfa.add(rule.head, start, rule.fold)
        for _ in range(rule.run):
            nxt = nfa.state()
            nfa.step[at].append((chars, nxt))
            at = nxt
        on = nfa.state()
        nfa.step[at].append((chars, on))
        nfa.step[on].append((chars, on))
        marks.append((at, on))
        own = _Nfa()
        first = own.state()
        last = own.add(rule.head, first, rule.fold)
        for _ in range(rule.run):
            nxt = own.state()
            own.step[last].append((chars, nxt))
            last = nxt
        moves, members = subsets(own.backwards(), {last}, False)
        back.append((moves, np.array([(1 if first in m else 0) | (2 if not m else 0) for m in members])))
    moves, members = subsets(nfa, {start}, True)
    tags = np.zeros(len(members), np.int64)
    for s, m in enumerate(members):
        for r, (fresh, on) in enumerate(marks):
            tags[s] |= (fresh in m) << (2 * r) | (fresh in m or on in m) << (2 * r + 1)
    return Automaton(rules, *minimised(moves, tags), back)


class Scanner:
    def __init__(self, automaton: Automaton) -> None:
        self.a = automaton
        self.start = automaton.rows()[0]
        self.back = [(m.tolist(), t.tolist()) for m, t in automaton.back]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, per rule leftmost and not overlapping, in order of start, then rule."""
        if not data:
            return []
        trace = np.frombuffer(bytes(map(itemgetter(256), accumulate(data, getitem, initial=self.start))), np.uint8)[1:]
        seen = np.flatnonzero(np.bincount(trace, minlength=len(self.a.kinds)))
        found = []
        for r, rule in enumerate(self.a.rules):
            fresh = (self.a.kinds >> (2 * r)) & 1
            if not fresh[seen].any():
                continue
            at = np.flatnonzero(fresh[trace])
            stops = np.flatnonzero(((self.a.kinds >> (2 * r + 1)) & 1)[trace] == 0)
            used = i = 0
            while i < len(at):
                p = int(at[i])
                begin = self._begin(data, r, p, used)
                if begin < 0:
                    i += 1
                    continue
                j = int(np.searchsorted(stops, p))
                end = int(stops[j]) if j < len(stops) else len(data)
                if end - (p - rule.run + 1) >= rule.keep and end - begin >= rule.least:
                    found.append((r, begin, end))
                used = end
                i = int(np.searchsorted(at, end))
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _begin(self, data: bytes, r: int, p: int, used: int) -> int:
        """Leftmost start, not before ``used``, of the match whose body is just long enough at ``p``; -1 if there is none."""
        moves, tags = self.back[r]
        state, best = 0, -1
        while p >= used and not tags[state] & 2:
            state = moves[state][data[p]]
            if tags[state] & 1:
                best = p
            p -= 1
        return best


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array<struct<kind, start, end>>): every secret of every whole text, in code points, end exclusive.

    The rules are compiled on the driver into one transition array (subset construction, then minimisation), which is
    as large as the rules make it. One pass over a text's bytes leaves the trace of states; matches end where a rule's
    bit goes out, and a small automaton that runs backwards finds where they begin. Null and empty texts have none;
    repeated rows, and null ids, give rows of their own; the length of a text does not matter.
    """
    automaton = compile_rules(rules)

    def work(cols: dict) -> dict:
        scanner = kept_in_worker(("secrets", rules), lambda: Scanner(automaton))
        names = [rule.name for rule in rules]
        out = []
        for text in cols["text"]:
            data = text.encode()
            spans = scanner.scan(data)
            if spans and not text.isascii():
                points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                place = lambda b: int(points[b - 1]) if b else 0
                spans = [(r, place(s), place(e)) for r, s, e in spans]
            out.append([{"kind": names[r], "start": s, "end": e} for r, s, e in spans])
        return {"doc_id": cols["doc_id"], "found": out}

    return per_batch(whole_texts(docs, id_col, text_col), work, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more) from ``find_secrets``."""
    base = [r.name for r in BASE]

    def work(cols: dict) -> dict:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_more")}
        for found in cols["found"]:
            said = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in found]
            own = [s for k, s in said if k in base]
            for k in base:
                out[f"n_{k}"].append(sum(x[0] == k for x in said))
            out["base_sha256"].append(hashlib.sha256(",".join(own).encode()).hexdigest())
            out["spans"].append(",".join(s for _, s in said))
            out["n_more"].append(len(said) - len(own))
        return {"doc_id": cols["doc_id"]} | out

    return per_batch(find_secrets(docs, rules), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long")
