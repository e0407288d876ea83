"""Strings that a text must contain for a pattern to match in it, taken out of the pattern.

The pattern is walked once. A run of plain characters has to be in every match, one that stands in a group that may be left
out doesn't; of alternatives, one has to be there. Whatever isn't understood for certain ends a run, so the answer
is never too strict. ASCII letters are compared without their case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Shorter strings are in nearly every text.
SHORTEST = 3

_QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d+)(?:,\d*)?\})[?+]?")
_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[xupP]\{[^}]*\}|k<[^>]*>|c[A-Za-z]|\d+|.)", re.DOTALL)
_GROUP = re.compile(r"\((?:\?(?:[:=!]|<[=!]|<[A-Za-z_]\w*>))?")
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


def _better(found: frozenset[str] | None, other: frozenset[str] | None) -> frozenset[str] | None:
    """The one that fewer texts pass: with the longest shortest string, then with fewer strings."""
    known = [x for x in (found, other) if x]
    return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@dataclass
class _Walk:
    regex: str
    at: int = 0

    def alternatives(self) -> frozenset[str] | None:
        """Up to the end of the group: one of these strings must be there, or None where nothing must."""
        branches = [self.branch()]
        while self.at < len(self.regex) and self.regex[self.at] == "|":
            self.at += 1
            branches.append(self.branch())
        return None if None in branches else frozenset().union(*branches)

    def branch(self) -> frozenset[str] | None:
        best, run = None, ""
        while self.at < len(self.regex) and self.regex[self.at] not in "|)":
            char, inside, width = self.atom()
            least = self.least()
            if width == 0:
                continue  # holds no character: the run goes on behind it
            if char is not None and least != 0:
                # A repeated character may follow itself, so a new run begins with it.
                run += char
                if least is not None:
                    best, run = _better(best, _of(run)), char
                continue
            best, run = _better(best, _of(run)), ""
            if least != 0:
                best = _better(best, inside)
        return _better(best, _of(run))

    def atom(self) -> tuple[str | None, frozenset[str] | None, int]:
        """A plain character, or what a group must contain; and 0 for what holds no character."""
        regex, c = self.regex, self.regex[self.at]
        if c == "(":
            head = _GROUP.match(regex, self.at)[0]
            self.at += len(head)
            inside = self.alternatives()
            self.at += 1
            around = head in ("(?=", "(?!", "(?<=", "(?<!")
            return None, None if around else inside, 0 if around else 1
        if c == "[":
            self.at += 1
            while self.at < len(regex) and regex[self.at] != "]":
                self.at += 2 if regex[self.at] == "\\" else 1
            self.at += 1
            return None, None, 1
        if c == "\\":
            escape = (_ESCAPE.match(regex, self.at) or re.match(r"\\", regex[self.at :]))[0]
            self.at += len(escape)
            name = escape[1:]
            if name in ("b", "B"):
                return None, None, 0
            plain = _CONTROLS.get(name) or (name if len(name) == 1 and not name.isalnum() else None)
            return plain, None, 1
        self.at += 1
        if c in "^$":
            return None, None, 0
        return (None if c == "." else c), None, 1

    def least(self) -> int | None:
        """How often the atom before must be there; None without a quantifier."""
        found = _QUANTIFIER.match(self.regex, self.at)
        if not found:
            return None
        self.at = found.end()
        return {"*": 0, "+": 1, "?": 0}[found[1]] if found[1] else int(found[2])


def _of(run: str) -> frozenset[str] | None:
    return frozenset([run]) if len(run) >= SHORTEST else None


def required(regex: str) -> frozenset[str] | None:
    """Strings of which every text with a match has one, ASCII letters in either case; None if no such are known."""
    walk = _Walk(regex)
    found = walk.alternatives()
    return found if walk.at == len(regex) else None
