"""Regular expressions that read a text piece by piece.

A pattern becomes a nondeterministic automaton. What a piece of text does to it is a
small summary: whether a match lies inside, which states are alive at the end, and where
each state that may be alive at its beginning leads. Summaries of neighbours compose, so
a text that is cut in pieces, joined by single spaces, is searched as if it were whole:
no piece is put together with another one and no pattern needs a bounded length.

Characters: ``.`` is anything but a line end, words and digits are ASCII, white space is
that of the source texts, letters match in both cases. Groups only group; back references,
look-around and the start of the text are refused.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from re import _constants as rc
from re import _parser as rp

from pyspark import cloudpickle

from tiergraph.functions.text import BLANKS

# Executors get this module with the job and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE_ENDS = "\n\r\u2028\u2029"
#: States of the remembered deterministic automaton; beyond, it is built anew.
MOST_STATES = 20_000
#: Characters of a thread that must go on for a place to be looked at, and the least length of
#: a text that is worth looking ahead in.
AHEAD, LONG_TEXT = 6, 64
#: Summaries of short pieces that are remembered, and how long those may be.
MOST_PIECES, SHORT_PIECE = 20_000, 120
Test = Callable[[str], bool]


def _is_word(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalnum())


def _category(name) -> Test:
    return {
        rc.CATEGORY_DIGIT: lambda c: c.isascii() and c.isdigit(),
        rc.CATEGORY_NOT_DIGIT: lambda c: not (c.isascii() and c.isdigit()),
        rc.CATEGORY_SPACE: lambda c: c in BLANKS,
        rc.CATEGORY_NOT_SPACE: lambda c: c not in BLANKS,
        rc.CATEGORY_WORD: _is_word,
        rc.CATEGORY_NOT_WORD: lambda c: not _is_word(c),
    }[name]


def _both_cases(test: Test) -> Test:
    def either(c: str) -> bool:
        return test(c) or (c.isascii() and c.isalpha() and test(c.swapcase()))

    return either


def _in_set(items: Iterable) -> Test:
    items = list(items)
    negated = bool(items) and items[0][0] is rc.NEGATE

    def one(kind, value) -> Test:
        if kind is rc.LITERAL:
            return lambda c: ord(c) == value
        if kind is rc.RANGE:
            return lambda c: value[0] <= ord(c) <= value[1]
        return _category(value)

    tests = [one(k, v) for k, v in items[negated:]]
    within = _both_cases(lambda c: any(t(c) for t in tests))
    return (lambda c: not within(c)) if negated else within


@dataclass
class Summary:
    """What a piece does; ``tail`` is the piece as the last one, without a space after it."""

    found: bool = False
    alive: int = 0
    leads: dict[int, int] = field(default_factory=dict)
    accepts: int = 0
    tail_found: bool = False
    tail_accepts: int = 0

    def then(self, other: Summary) -> Summary:
        """The summary of this piece and the next one."""

        def led(states: int) -> int:
            out = 0
            for s, to in other.leads.items():
                if states >> s & 1:
                    out |= to
            return out

        through = lambda accepts: sum(1 << s for s, to in self.leads.items() if to & accepts)
        leads = {s: to for s, t in self.leads.items() if (to := led(t))}
        return Summary(
            found=self.found or other.found or bool(self.alive & other.accepts),
            alive=other.alive | led(self.alive),
            leads=leads,
            accepts=self.accepts | through(other.accepts),
            tail_found=self.found or other.tail_found or bool(self.alive & other.tail_accepts),
            tail_accepts=self.accepts | through(other.tail_accepts),
        )

    def opened(self) -> Summary:
        """This summary where nothing comes before the piece."""
        return Summary(self.found, self.alive, {}, 0, self.tail_found, 0)

    def dump(self) -> str:
        leads = [[s, t] for s, t in self.leads.items()]
        return json.dumps([self.found, self.alive, leads, self.accepts, self.tail_found, self.tail_accepts])

    @staticmethod
    def load(text: str) -> Summary:
        found, alive, leads, *rest = json.loads(text)
        return Summary(found, alive, dict(leads), *rest)


class Automaton:
    """A pattern, read by states that are sets of positions kept as bits."""

    def __init__(self, pattern: str):
        self.tests: list[Test] = []
        #: Per state: (test, state) of characters, (assertion, state) without one.
        self.moves: list[list[tuple[int, int]]] = []
        self.jumps: list[list[tuple[object, int]]] = []
        self.first = self._state()
        self.last = self._sequence(rp.parse(pattern), self.first)
        self._classes: dict[str, int] = {}
        self._table: dict[int, int] = {}
        self._signs: dict[tuple, int] = {}
        self._members: list[tuple[bool, list[bool]]] = []
        self._forget()
        space = self._class_of(" ")
        hit = self._members[space][1]
        self.entries = sorted({to for moves in self.moves for t, to in moves if hit[t]})

    # --- building -------------------------------------------------------------------

    def _state(self) -> int:
        self.moves.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def _sequence(self, items, at: int) -> int:
        for kind, value in items:
            at = self._item(kind, value, at)
        return at

    def _on(self, test: Test, at: int) -> int:
        to = self._state()
        self.tests.append(test)
        self.moves[at].append((len(self.tests) - 1, to))
        return to

    def _item(self, kind, value, at: int) -> int:
        if kind is rc.LITERAL:
            return self._on(_both_cases(lambda c: ord(c) == value), at)
        if kind is rc.NOT_LITERAL:
            is_it = _both_cases(lambda c: ord(c) == value)
            return self._on(lambda c: not is_it(c), at)
        if kind is rc.ANY:
            return self._on(lambda c: c not in LINE_ENDS, at)
        if kind is rc.IN:
            return self._on(_in_set(value), at)
        if kind is rc.SUBPATTERN:
            return self._sequence(value[3], at)
        if kind is rc.BRANCH:
            end = self._state()
            for branch in value[1]:
                self.jumps[self._sequence(branch, at)].append((None, end))
            return end
        if kind in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, body = value
            for _ in range(least):
                at = self._sequence(body, at)
            if most is rc.MAXREPEAT:
                loop, end = self._state(), self._state()
                self.jumps[at].append((None, loop))
                self.jumps[self._sequence(body, loop)].append((None, loop))
                self.jumps[loop].append((None, end))
                return end
            end = self._state()
            for _ in range(most - least):
                self.jumps[at].append((None, end))
                at = self._sequence(body, at)
            self.jumps[at].append((None, end))
            return end
        if kind is rc.AT and value in (rc.AT_BOUNDARY, rc.AT_NON_BOUNDARY, rc.AT_END):
            to = self._state()
            self.jumps[at].append((value, to))
            return to
        raise ValueError(f"patterns with {kind} cannot be read in pieces")

    # --- reading --------------------------------------------------------------------

    def _forget(self) -> None:
        self._number: dict[tuple[int, bool, bool], int] = {}
        self._states: list[tuple[int, bool, bool]] = []
        self._next: list[dict[str, int]] = []
        self._known: dict[str, Summary] = {}
        self._leave: dict[int, re.Pattern | None] = {}

    def _class_of(self, c: str) -> int:
        found = self._classes.get(c)
        if found is None:
            hit = [t(c) for t in self.tests]
            sign = (_is_word(c), *hit)
            found = self._signs.setdefault(sign, len(self._members))
            if found == len(self._members):
                self._members.append((sign[0], hit))
                self._leave = {}
            self._classes[c] = found
            self._table[ord(c)] = found
        return found

    def _classed(self, text: str) -> str:
        """The text with every character's class in its place."""
        for c in set(text).difference(self._classes):
            self._class_of(c)
        return text.translate(self._table)

    def _closed(self, states: int, word_before: bool, word_after: bool, ends: bool) -> int:
        todo, seen = states, 0
        while todo:
            s = todo.bit_length() - 1
            todo &= ~(1 << s)
            seen |= 1 << s
            for need, to in self.jumps[s]:
                holds = (
                    need is None
                    or (need is rc.AT_BOUNDARY and word_before != word_after)
                    or (need is rc.AT_NON_BOUNDARY and word_before == word_after)
                    or (need is rc.AT_END and ends)
                )
                if holds and not seen >> to & 1:
                    todo |= 1 << to
        return seen

    def _step(self, number: int, c: str) -> int:
        """The state after a character of class ``c``; -1 once a match is complete."""
        states, search, word_before = self._states[number]
        word, hit = self._members[ord(c)]
        closed = self._closed(states, word_before, word, False)
        to = 0
        if closed >> self.last & 1:
            found = -1
        else:
            for s in range(closed.bit_length()):
                if closed >> s & 1:
                    for test, target in self.moves[s]:
                        if hit[test]:
                            to |= 1 << target
            found = self._numbered(to | (1 << self.first) * search, search, word)
        self._next[number][c] = found
        return found

    def _numbered(self, states: int, search: bool, word_before: bool) -> int:
        key = (states, search, word_before)
        found = self._number.setdefault(key, len(self._states))
        if found == len(self._states):
            self._states.append(key)
            self._next.append({})
        return found

    def _ahead(self, s: int, depth: int, home: int) -> str:
        """A pattern over classes that every text has which a thread outlives from ``s``.

        Assertions count as met and classes that came up later as fitting, so it holds for
        more places than needed, never for fewer.
        """
        closed = self._open(1 << s)
        if not depth or closed >> self.last & 1:
            return ""
        ways: dict[str, list[str]] = {}
        for q in range(closed.bit_length()):
            if closed >> q & 1:
                for test, to in self.moves[q]:
                    if home >> to & 1:
                        continue
                    fits = "".join(re.escape(chr(c)) for c, (_, hit) in enumerate(self._members) if hit[test])
                    if fits:
                        ways.setdefault(self._ahead(to, depth - 1, home), []).append(fits)
        if not ways:
            return "(?!)"
        parts = [f"[{''.join(fits)}]{tail}" for tail, fits in ways.items()]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    def _open(self, states: int) -> int:
        """All states that jumps may lead to, whatever they assert."""
        todo, seen = states, 0
        while todo:
            s = todo.bit_length() - 1
            todo &= ~(1 << s)
            seen |= 1 << s
            for _, to in self.jumps[s]:
                if not seen >> to & 1:
                    todo |= 1 << to
        return seen

    def _leaving(self, number: int) -> re.Pattern | None:
        """Finds the next place where a state that stays what it is may begin to change.

        None where some part of it would not stay for every character.
        """
        states, search, _ = self._states[number]
        own = [s for s in range(states.bit_length()) if states >> s & 1]
        if all(self._stays(s, search) for s in own):
            parts = [self._ahead(s, AHEAD, states) for s in own]
            if all(parts):
                return re.compile("|".join(parts))
        return None

    def _stays(self, s: int, search: bool) -> bool:
        """Whether a state leads to itself by every class, as the start of a search does."""
        if search and s == self.first:
            return True
        free, todo = 0, 1 << s
        while todo:
            q = todo.bit_length() - 1
            todo &= ~(1 << q)
            free |= 1 << q
            for need, to in self.jumps[q]:
                if need is None and not free >> to & 1:
                    todo |= 1 << to
        back = {t for q in range(free.bit_length()) if free >> q & 1
                for t, to in self.moves[q] if self._returns(to, s)}
        return all(any(hit[t] for t in back) for _, hit in self._members)

    def _returns(self, at: int, s: int) -> bool:
        """Whether a state is ``s`` or comes to it by plain jumps alone."""
        seen = {at}
        todo = [at]
        while todo:
            q = todo.pop()
            if q == s:
                return True
            for need, to in self.jumps[q]:
                if need is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return False

    def _run(self, number: int, classes: str) -> int:
        """Read characters from a state; -1 when a match is complete."""
        steps, leave, n = self._next, self._leave, len(classes)
        # Places whose threads can be looked ahead in; the last characters are always read.
        most = n - AHEAD + 1 if n >= LONG_TEXT else 0
        at = 0
        while at < n:
            if at < most:
                if number not in leave:
                    leave[number] = self._leaving(number)
                if leave[number] is not None:
                    hit = leave[number].search(classes, at)
                    place = min(hit.start(), most) if hit else most
                    if place > at:
                        states, search, _ = self._states[number]
                        number = self._numbered(states, search, self._members[ord(classes[place - 1])][0])
                        at = place
            c = classes[at]
            to = steps[number].get(c)
            if to is None:
                to = self._step(number, c)
            if to < 0 or not self._states[to][0]:
                return to
            number, at = to, at + 1
        return number

    def _ends_in_match(self, number: int) -> bool:
        states, _, word_before = self._states[number]
        return bool(self._closed(states, word_before, False, True) >> self.last & 1)

    def summary(self, text: str) -> Summary:
        """What ``text`` and a space after it do."""
        if text in self._known:
            return self._known[text]
        if len(self._states) > MOST_STATES or len(self._known) > MOST_PIECES:
            self._forget()
        out = self._read(text)
        if len(text) <= SHORT_PIECE:
            self._known[text] = out
        return out

    def _read(self, text: str) -> Summary:
        classes, space = self._classed(text), self._classed(" ")
        out = Summary()
        at = self._run(self._numbered(1 << self.first, True, False), classes)
        out.tail_found = at < 0 or self._ends_in_match(at)
        after = self._run(at, space) if at >= 0 else at
        out.found = after < 0
        out.alive = self._states[after][0] & ~(1 << self.first) if after >= 0 else 0
        for s in self.entries:
            at = self._run(self._numbered(1 << s, False, False), classes)
            if at < 0 or self._ends_in_match(at):
                out.tail_accepts |= 1 << s
            after = self._run(at, space) if at >= 0 and self._states[at][0] else at
            if after < 0:
                out.accepts |= 1 << s
            elif self._states[after][0]:
                out.leads[s] = self._states[after][0]
        return out
