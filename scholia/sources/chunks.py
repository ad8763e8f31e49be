"""Where entries begin in a file that is read in chunks.

Whether an ``@`` at the start of a line begins an entry depends on all text before it: it may stand inside a string. So a chunk cannot be
cut by itself. But what the reader is doing at the start of a line is one of a few states, some with a depth of braces: looking
for an entry, between an entry's name and its opening, before a field, inside a braced string, and so on. A chunk is a map
from the state that it is entered in to the state that it is left in, with the place of the first entry that begins at column 0 by that way. Maps of
successive chunks compose, which gives the true state of each chunk, and so the places where the file may be cut.

All ways through a chunk meet at the next entry that each of them finds, so a map costs little more than one pass. Depths beyond
``DEPTHS`` are not in the map; ``enter`` follows such a state by itself when it turns up.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from scholia.sources.bibtext import _ID, first_on_line

#: Depths of braces, inside a braced string, that a map holds one by one; a chunk that closes no more of them needs no others.
DEPTHS = 64
KINDS = ("preamble", "string", "entry")


class State(NamedTuple):
    """What the reader looks for at the start of a line, in what kind of entry, and how deep in braces."""

    mode: str
    kind: str = ""
    depth: int = 0


SEEK = State("seek")
#: States without a depth.
PLAIN = (
    SEEK, State("name"), State("open", "include"), State("key", "entry"), State("after_key", "entry"),
    *(State(mode, kind) for kind in KINDS for mode in ("open", "value", "more")), *(State(mode, kind) for kind in KINDS[1:] for mode in ("field", "equals")),
)

_SKIP = re.compile(r"(?:[ \t\n\v\f\r]++|%[^\n]*+\n?+)*+")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_KEY = re.compile(r"[^,\s]*")
_BRACES = re.compile(r"[{}]")
_QUOTED = re.compile(r'\\\\|\\"|["{}]')
_PAIRS = {"{": re.compile(r"[{}]"), "(": re.compile(r"[()]")}


def next_entry(text: str, i: int) -> int:
    """The next @ from i on that only white space precedes on its line; -1 without one."""
    at = text.find("@", i)
    while at >= 0 and not first_on_line(text, at):
        at = text.find("@", at + 1)
    return at


def end_of_quoted(text: str, i: int, depth: int) -> tuple[int, int]:
    """Behind the quote that ends a string, at depth 0; or -1 and the depth at the end of the text."""
    n = len(text)
    while m := _QUOTED.search(text, i):
        t, i = m[0], m.end()
        if t == '"':
            if not depth:
                return i, 0
        elif t == '\\"':
            if not depth:
                if i == n:
                    break
                i += 1  # a quote after a backslash takes the next character with it
        elif t != "\\\\":
            depth += 1 if t == "{" else -1
    return -1, depth


def follow(text: str, i: int, state: State) -> tuple[int, State]:
    """From place i in a state on to the next @ that begins an entry, or, with -1, to the end of the text and the state there."""
    mode, kind, depth = state
    n = len(text)
    while True:
        if mode == "seek":
            at = next_entry(text, i)
            return (at, SEEK) if at >= 0 else (-1, SEEK)
        if mode == "braced":
            for m in _BRACES.finditer(text, i):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    break
            if depth:
                return -1, State("braced", kind, depth)
            i, mode = m.end(), "more"
        elif mode == "quoted":
            i, depth = end_of_quoted(text, i, depth)
            if i < 0:
                return -1, State("quoted", kind, depth)
            mode = "more"
        elif mode == "group":  # its kind is the opening sign
            for m in _PAIRS[kind].finditer(text, i):
                depth += 1 if m[0] == kind else -1
                if not depth:
                    break
            if depth:
                return -1, State("group", kind, depth)
            i, mode = m.end(), "seek"
            continue
        i = _SKIP.match(text, i).end()
        if i >= n:
            return -1, State(mode, kind, 0)
        c = text[i]
        i += 1
        if mode == "name":
            m = _NAME.match(text, i - 1)
            if m is None:
                mode = "seek"
            else:
                i, mode = m.end(), "open"
                kind = m[0].lower() if m[0].lower() in ("include", "preamble", "string") else "entry"
        elif mode == "open":
            if c not in "{(":
                mode = "seek"
            elif kind == "include":
                mode, kind, depth = "group", c, 1
            else:
                mode = {"preamble": "value", "string": "field", "entry": "key"}[kind]
        elif mode == "key":
            i, mode = _KEY.match(text, i - 1).end(), "after_key"
        elif mode == "after_key":
            mode = "field" if c == "," else "seek"
        elif mode == "field":
            end = _ID.match(text, i - 1).end()
            i, mode = (end, "equals") if end >= i else (i, "seek")
        elif mode == "equals":
            mode = "value" if c == "=" else "seek"
        elif mode == "value":
            depth = 0
            if c == "{":
                mode, depth = "braced", 1
            elif c == '"':
                mode = "quoted"
            elif "0" <= c <= "9":
                while i < n and "0" <= text[i] <= "9":
                    i += 1
                mode = "more"
            elif c.isalpha():
                i, mode = _ID.match(text, i - 1).end(), "more"
            else:
                i, mode = i - 1, "seek"
        else:  # after a part of a value
            mode = "value" if c == "#" else "field" if kind == "entry" and c == "," else "seek"


class Way(NamedTuple):
    """Where the first entry at column 0 begins, or -1, and the state at the end of the chunk."""

    cut: int
    state: State


class Chunk:
    """The ways through a chunk, which begins at the start of a line and ends with one, or with the file."""

    def __init__(self, text: str):
        self.text = text
        self._from: dict[int, Way] = {}

    def from_entry(self, at: int) -> Way:
        """The way from an entry's @ on."""
        trail = []
        while at not in self._from:
            trail.append(at)
            after, state = follow(self.text, at + 1, State("name"))
            if after < 0:
                self._from[at] = Way(-1, state)
                break
            at = after
        way = self._from[at]
        for at in reversed(trail):
            flush = at == 0 or self.text[at - 1] == "\n"
            way = self._from[at] = Way(at if flush else way.cut, way.state)
        return way

    def enter(self, state: State, at: int = 0) -> Way:
        """The way of a state at the start of the chunk."""
        entry, end = follow(self.text, at, state)
        return Way(-1, end) if entry < 0 else self.from_entry(entry)

    def ways(self) -> tuple[dict[State, Way], int, int]:
        """The map of the chunk, by states; how many braces it closes at most beyond those that it opens, and how many it opens
        in all: a braced string deeper than the first is still open at the end, deeper by the second."""
        out = {s: self.enter(s) for s in PLAIN}
        depth = most = 0
        for m in _BRACES.finditer(self.text):
            depth += 1 if m[0] == "{" else -1
            if -depth > most:
                most = -depth
                if most <= DEPTHS:
                    out |= {State("braced", kind, most): self.enter(State("more", kind), m.end()) for kind in KINDS}
        for begin in (0, 1):
            at, left = end_of_quoted(self.text, 0, begin)
            out |= {State("quoted", kind, begin): self.enter(State("more", kind), at) if at >= 0 else Way(-1, State("quoted", kind, left)) for kind in KINDS}
        return out, most, depth


def look_up(ways: dict[State, Way], most: int, rise: int, state: State) -> Way | None:
    """The way of a state by a chunk's map, or None if the map does not hold it."""
    if state in ways:
        return ways[state]
    if state.mode == "braced" and state.depth > most:
        return Way(-1, State("braced", state.kind, state.depth + rise))
    return None

