"""Parser and prettyprinter of bibliography text in two dialects.

One pass over a file's text gives its entries, diagnostics, tokens and the prettyprinted text. The text is decoded as
ISO-8859-1, so that a character is a byte. The text may be a part of a file that begins with an entry at the start of a line; what
``chunks`` says about where entries begin must hold here.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from scholia.functions import checking, fixes
from scholia.functions.text import FIELD_NAMES
from scholia.options import Options

#: Layout of the output, token types and names (fixed values).
FIELD_INDENT, VALUE_INDENT = 2, 17
TOKENS = ["UNKNOWN", "ABBREV", "AT", "COMMA", "COMMENT", "ENTRY", "EQUALS", "FIELD", "INCLUDE", "INLINE", "KEY", "LBRACE", "LITERAL", "NEWLINE", "PREAMBLE", "RBRACE", "SHARP", "SPACE", "STRING", "VALUE"]
ENTRY_NAMES = {"Deathesis": "DEAthesis", "Inbook": "InBook", "Incollection": "InCollection", "Inproceedings": "InProceedings", "Mastersthesis": "MastersThesis", "Phdthesis": "PhdThesis", "Techreport": "TechReport"}
SPACE = " \t\n\v\f\r"
SCRIBE_PAIRS = {"{": "}", "[": "]", "(": ")", "<": ">", "'": "'", '"': '"', "`": "`"}
LINEBREAK, PARBREAK, HIDDEN = "\x02", "\x03", "\x01"
GERMAN = "\"-<>AEIOU'`acefilmnopstu|"

_ID = re.compile(r"[!$&*+\-./0-9:;<>?@A-Z\[\\\]^_`a-z|~\x80-\xff]*")
_SCRIBE_ID = re.compile(r"[A-Za-z0-9.#&%]*")
_BLANKS = re.compile(r"[ \t\v\f\r]+")
_SPACES = re.compile(r"[ \t\n\v\f\r]+")
#: Characters of a braced and of a quoted string that stand for themselves, a word of a value, and what is written at once.
_BRACED, _QUOTED = re.compile(r"(?:[^ \t\n\v\f\r\\{}]++| (?![ \t\n\v\f\r]))+"), re.compile(r'(?:[^ \t\n\v\f\r\\{}"]++| (?![ \t\n\v\f\r]))+')
_OTHER_SPACE = re.compile(r"[\t\n\v\f\r\x02\x03]")
_WORD, _STRETCH = re.compile(r"[^ \t\n\v\f\r\x02\x03]*"), re.compile(r"[^ \x02\x03]*")


class Lost(Exception):
    """The text at hand is no entry; the parser goes on at the next one."""


@dataclass
class Field:
    name_raw: str
    name: str
    line: int
    value: str = ""
    parts: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Entry:
    kind: str
    line: int
    entry_name: str = ""
    cite_key: str = ""
    open_delim: str = ""
    fields: list[Field] = field(default_factory=list)
    body: str = ""


class Page:
    """Output text that knows its column and can take back white space."""

    def __init__(self, width: int):
        self.lines: list[str] = []
        self.cur = ""
        self.done = 0  # characters of lines with their ends
        self.uncounted = 0  # characters of cur before a line end that was taken back: the column starts after them
        self.width = width

    def put(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.cur += first
        for piece in rest:
            self.end_line(self.cur.rstrip(" \t"))
            self.cur = piece

    def end_line(self, text: str) -> None:
        self.lines.append(text)
        self.done += len(text) + 1
        self.cur, self.uncounted = "", 0

    def place(self) -> tuple[int, int, int]:
        """Byte, line and column of what comes next."""
        return self.done + len(self.cur), len(self.lines) + 1, len(self.cur)

    def spaces(self, n: int) -> None:
        self.cur += " " * n

    def to_column(self, n: int) -> None:
        self.spaces(n - len(self.cur) + self.uncounted)

    def rstrip(self) -> None:
        self.cur = self.cur.rstrip(SPACE)
        while not self.cur and self.lines:
            self.done -= len(self.lines[-1]) + 1
            self.cur = self.lines.pop().rstrip(SPACE)
            self.uncounted = len(self.cur)
        if "%" in self.cur:  # a comment needs its line end
            self.put("\n")

    def drop_line(self) -> None:
        self.cur = ""

    def text(self) -> str:
        return "\n".join([*self.lines, self.cur])


class NoPage(Page):
    """A page that nothing is written to."""

    def put(self, text: str) -> None:
        pass

    spaces = to_column = end_line = put

    def rstrip(self) -> None:
        pass


def first_on_line(text: str, at: int) -> bool:
    """Whether only white space precedes on the line; looks back no further than that."""
    while at and text[at - 1] in " \t\v\f\r":
        at -= 1
    return not at or text[at - 1] == "\n"


def wrap_into(page: Page, text: str, keep_spaces: bool) -> None:
    """Writes a value, breaking at a space where the word after it would pass the page's width; the last word counts one
    more, for the comma to come."""
    if isinstance(page, NoPage):
        return
    if not _OTHER_SPACE.search(text):
        cur, *words = text.split(" ")
        cur, last = page.cur + cur, len(words) - 1
        for k, word in enumerate(words):
            if len(cur) + 1 + len(word) + (k == last) > page.width:
                page.end_line(cur.rstrip(" \t"))
                cur = " " * VALUE_INDENT + word
            else:
                cur += " " + word
        page.cur = cur
        return
    k, n = 0, len(text)
    while k < n:
        c = text[k]
        if c == " ":
            end = _WORD.match(text, k + 1).end()
            word = end - k - 1 + (end == n)
            if len(page.cur) + 1 + word > page.width:
                page.put("\n")
                page.spaces(VALUE_INDENT)
            else:
                page.cur += " "
            k += 1
        elif c in (LINEBREAK, PARBREAK):
            page.put("\n" if c == LINEBREAK else "\n\n")
            if not keep_spaces:
                page.spaces(VALUE_INDENT)
            k += 1
            while c == LINEBREAK and not keep_spaces and k < n and text[k] == " ":
                k += 1
        else:
            end = _STRETCH.match(text, k).end()
            page.put(text[k:end])
            k = end


class Parser:
    """Cleans one file. Results: entries, diagnostics, tokens, page."""

    def __init__(self, text: str, options: Options | None = None, file: str = "stdin", patterns=None, keywords=None, isbn_ranges=None, first_line: int = 1, more: bool = False, scan: bool = False, checker: checking.Checker | None = None):
        """With scan, values get the fixes alone that need their TeX, nothing is checked or laid out, and ``seen`` has, in order, what was
        found: fields, citation keys and what the parser itself reports. first_line is the line of the text's start in its file; more says that the file goes on with another entry, whose @ is
        seen, but not passed. checker is that of patterns and isbn_ranges, where many texts share it."""
        self.stop = len(text)
        text += "@" * more
        self.s, self.n, self.i = text, len(text), 0
        self.first_line, self.more = first_line, more
        self.o = options or Options()
        self.file = file
        self.keywords = FIELD_NAMES if keywords is None else keywords
        self.checker = checking.Checker(patterns, isbn_ranges) if checker is None else checker
        self.scan = scan
        self.seen: list[tuple] = []
        self.page = NoPage(self.o.width) if scan else Page(self.o.width)
        self.entries: list[Entry] = []
        self.diagnostics: list[dict] = []
        self.places: list[int] = []  # lines of output that were written before each diagnostic
        self.tokens: list[tuple[int, int, str, str]] = []
        self.level = 0
        self.close = "}"
        self.entry = Entry("other", first_line)
        self.field = Field("", "", first_line)
        self.value_line = first_line
        self.marks: dict[str, tuple[int, ...]] = {}
        self._lines = [m.start() for m in re.finditer("\n", text)]
        self.verbatim = False

    # positions and messages

    def line(self, at: int | None = None) -> int:
        return bisect.bisect_left(self._lines, self.i if at is None else at) + self.first_line

    def expand(self, message: str) -> str:
        """%e, %f, %k, %v and %% stand for entry, field, key, value and a percent sign; any other
        percent leaves the whole message as it is."""
        if re.search(r"%(?![efkv%])", message):
            return message
        what = {"e": self.entry.entry_name, "f": self.field.name, "k": self.entry.cite_key, "v": self.field.value, "%": "%"}
        return re.sub(r"%([efkv%])", lambda m: what[m[1]], message)

    def report(self, severity: str, code: str, message: str, line: int | None = None) -> None:
        if severity == "warning" and not self.o.warnings:
            return
        text = self.expand(message)
        where = "\n".join(self.positions()) if self.o.file_position else ""
        self.diagnostics.append({"position": where, "line": self.value_line if line is None and severity == "warning" else (line or self.line()), "severity": severity, "code": code, "entry_name": self.entry.entry_name, "cite_key": self.entry.cite_key, "field": self.field.name, "value": self.field.value, "message": text})
        self.places.append(len(self.page.lines))
        if self.scan:
            self.seen.append(("said", self.diagnostics[-1]))

    def warn(self, code: str, message: str) -> None:
        self.report("warning", code, message)

    def here(self) -> tuple[int, ...]:
        """Byte, line and column of input and output."""
        line = self.line()
        before = line - self.first_line
        begin = self._lines[before - 1] + 1 if before else 0
        return (self.i, line, self.i - begin, *self.page.place())

    def mark(self, what: str) -> None:
        if self.o.file_position:
            self.marks[what] = self.here()

    def positions(self) -> list[str]:
        """Where the entry, the value and the reader are."""
        rows = [(what, self.marks.get(what, (0,) * 6)) for what in ("Entry", "Value")] + [("Current", self.here())]
        return [f"  File positions:  input [{self.file}]  output [stdout]", *("  {:<7} input byte={} line={} column={:2} output byte={} line={} column={:2}".format(what, *at) for what, at in rows)]

    def error(self, code: str, message: str) -> None:
        """Reports at the line of the value, and in the output text, below what is written so far."""
        self.report("error", code, message, self.value_line)
        if self.o.prettyprint:
            where = self.positions() if self.o.file_position else []
            self.page.end_line(self.page.cur)
            for line in (f" {self.expand(message)}.", *where):
                wrap_into(self.page, "??" + line, False)
                self.page.end_line(self.page.cur)

    def lost(self, code: str, message: str, text: str = "") -> Lost:
        self.emit("LITERAL", text) if text and not self.o.prettyprint else self.page.put(text)
        self.error(code, message)
        return Lost()

    # reading

    def peek(self) -> str:
        return self.s[self.i] if self.i < self.n else ""

    def get(self) -> str:
        c = self.peek()
        self.i += 1
        if c == "{":
            self.level += 1
        elif c == "}":
            self.level -= 1
        return c

    def first_on_line(self, at: int) -> bool:
        return first_on_line(self.s, at)

    def emit(self, kind: str, text: str, line: int | None = None) -> None:
        if text:
            self.tokens.append((self.line() if line is None else line, TOKENS.index(kind), kind, text))

    def out(self, kind: str, text: str) -> None:
        """A token, or its text on the page."""
        if self.o.prettyprint:
            if kind in ("INLINE", "COMMA"):
                self.page.put(text)
            else:
                wrap_into(self.page, text, self.o.keep_spaces)
        else:
            self.emit(kind, text)

    def newline(self) -> None:
        if self.o.prettyprint:
            self.page.put("\n")
        else:
            self.emit("NEWLINE", "\n")

    def inline_comment(self) -> str:
        """A comment to the end of its line, with the blanks that begin the next."""
        end = self.s.find("\n", self.i)
        end = self.n if end < 0 else end + 1
        m = _BLANKS.match(self.s, end)
        start, self.i = self.i, m.end() if m else end
        return self.s[start : self.i]

    def skip(self) -> bool:
        """Passes white space and comments; whether there was space."""
        seen = False
        while (c := self.peek()) and (c in SPACE or (c == "%" and not self.o.scribe)):
            if c == "%":
                self.out("INLINE", self.inline_comment())
            elif c == "\n":
                seen = True
                self.i += 1
                if not self.o.prettyprint:
                    if not self.level:
                        self.emit("NEWLINE", "\n", self.line(self.i - 1))
                elif not self.level or self.verbatim:
                    self.page.put("\n")
            else:
                seen = True
                m = _BLANKS.match(self.s, self.i)
                self.i = m.end()
                if not self.o.prettyprint:
                    self.emit("SPACE", m[0])
                elif self.o.keep_spaces or self.verbatim:
                    self.page.put(m[0])
        return seen

    def non_blank(self) -> None:
        while self.peek() and self.peek() in SPACE:
            self.i += 1

    # the file

    def run(self) -> Parser:
        while self.i < self.stop:
            self.skip()
            self.other()
            if self.i >= self.stop:
                break
            self.entry = Entry("entry", self.line())
            self.field = Field("", "", self.line())
            self.verbatim = self.drop_comma = False
            self.level = 0
            self.value_line = self.line()
            begin = self.i
            try:
                self.scribe_entry() if self.o.scribe else self.bibtex_entry()
                self.entries.append(self.entry)
            except Lost:
                self.entry.kind = "error"
                self.resync()
                self.entry.body = self.s[begin : self.i]
                self.entries.append(self.entry)
            self.verbatim = False
        if self.more:
            return self
        if self.o.prettyprint:
            self.page.rstrip()
            self.page.put("\n")
        if self.level:
            self.error("brace_level", "Non-zero brace level at end-of-file")
        return self

    def resync(self) -> None:
        """Copies text as it is up to the next @ that begins a line."""
        at = self.i
        while True:
            at = self.s.find("@", at)
            if at < 0 or self.first_on_line(at):
                break
            at += 1
        end = self.n if at < 0 else at
        if self.o.prettyprint:
            self.page.put(self.s[self.i : end])
        else:
            self.emit("LITERAL", self.s[self.i : end])
        self.i, self.level = end, 0

    def other(self) -> None:
        """Text between entries."""
        at = self.i
        while True:
            at = self.s.find("@", at)
            if at < 0 or self.first_on_line(at):
                break
            at += 1
        end = self.n if at < 0 else at
        text = self.s[self.i : end]
        if text:
            self.entries.append(Entry("other", self.line(), body=text))
            if self.o.prettyprint:
                self.page.put(text)
            else:
                pos = self.i
                for m in re.finditer(r"\n|[ \t\v\f\r]+|[^\n]+", text):
                    kind = "NEWLINE" if m[0] == "\n" else "SPACE" if not m[0].strip(SPACE) else "INLINE" if m[0][0] == "%" else "LITERAL"
                    self.emit(kind, m[0], self.line(pos + m.start()))
        self.i = end

    def tight(self) -> None:
        """Passes space and comments, and takes back the space written for them."""
        self.skip()
        if self.o.prettyprint:
            self.page.rstrip()

    def head(self) -> None:
        self.get()
        self.mark("Entry")
        self.out("AT", "@")
        self.tight()
        m = re.compile(r"[A-Za-z][A-Za-z0-9_-]*").match(self.s, self.i)
        if m is None:
            raise self.lost("entry_name", "Non-alphabetic character begins an entry name", self.get())
        self.i = m.end()
        name = m[0][0].upper() + m[0][1:].lower()
        self.entry.entry_name = ENTRY_NAMES.get(name, name)
        self.out({"Include": "INCLUDE", "Preamble": "PREAMBLE", "String": "STRING", "Comment": "COMMENT"}.get(name, "ENTRY"), self.entry.entry_name)

    def bibtex_entry(self) -> None:
        self.head()
        name = self.entry.entry_name
        if name == "Include":
            self.entry.kind = "include"
            self.group()
        elif name == "Preamble":
            self.entry.kind = "preamble"
            self.verbatim = self.o.keep_preamble_spaces
            self.tight()
            self.open()
            self.skip()
            self.value()
            self.skip()
            self.end()
        elif name == "String":
            self.string()
        else:
            self.tight()
            self.open()
            self.body()
            self.end()
        self.between()

    def string(self) -> None:
        self.entry.kind = "string"
        self.verbatim = self.o.keep_string_spaces
        self.tight()
        self.scribe_open() if self.o.scribe else self.open()
        self.skip()
        self.pair()
        self.skip()
        self.scribe_end() if self.o.scribe else self.end()

    def body(self) -> None:
        self.skip()
        m = re.compile(r"[^,\s]*").match(self.s, self.i)
        self.entry.cite_key = m[0]
        for c in m[0]:
            self.level += (c == "{") - (c == "}")
        self.i = m.end()
        self.out("KEY", m[0])
        self.value_line = self.line()
        self.mark("Value")
        if self.scan:
            self.seen.append(("key", self.entry, self.value_line, self.line()))
        else:
            self.checker.key(self)
        self.skip()
        self.comma()
        self.skip()
        while self.pair():
            self.skip()
            self.comma()
            if self.i >= self.n:
                return
            self.skip()

    def open(self) -> None:
        c = self.peek()
        if c not in ("{", "("):
            if not c:
                return
            raise self.lost("expected_open", "Expected open brace or parenthesis.  Last entry = ``@%e{%k,''", self.get())
        self.get()
        self.level += c == "("
        self.entry.open_delim, self.close = c, "}" if c == "{" else ")"
        self.out("LBRACE", "{")

    def end(self) -> None:
        c = self.get()
        if not c:
            return
        if c != self.close:
            raise self.lost("expected_close", "Expected closing brace or parenthesis in entry ``@%e{%k,''", c)
        self.level -= c == ")"
        self.out("RBRACE", "}")
        if self.level:
            raise self.lost("brace_level", "Non-zero brace level after @name{...} processed.  Last key = ``%k''")

    drop_comma = False

    def comma(self) -> None:
        self.value_line = self.line()
        self.mark("Value")
        c = self.peek()
        if c == ",":
            self.get()
        elif not c:
            return
        elif c != self.close:
            raise self.lost("expected_comma", "Expected comma after last field ``%f''", self.get())
        elif self.level != 1 and not self.o.scribe:
            raise self.lost("brace_level", "Non-zero brace level after @name{...} processed.  Last entry = ``@%e{%k,''", self.get())
        if not self.drop_comma:
            self.out("COMMA", ",")
            self.newline()
        self.drop_comma = False

    def pair(self) -> bool:
        """One field and its value, if there is one."""
        start = self.i
        m = (_SCRIBE_ID if self.o.scribe else _ID).match(self.s, self.i)
        raw = m[0]
        if not raw:
            return False
        in_string = self.entry.kind == "string"
        if not raw[0].isalpha():
            self.error("field_name", "Non-alphabetic character begins a field name")
        self.i = m.end()
        name = raw if in_string else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        if not in_string:
            opt = name.startswith("opt") and len(name) > 3
            name = "OPT" + self.keywords.get(name[3:], name[3:]) if opt else self.keywords.get(name, name)
            name = "OPT" if name == "opt" else name
        self.field = Field(raw, name, self.line(start))
        self.value_line = self.field.line
        if self.o.prettyprint:
            if not in_string:
                self.page.spaces(FIELD_INDENT)
            self.page.put(name)
        else:
            self.emit("ABBREV" if in_string else "FIELD", name)
        space = self.skip()
        self.equals(space)
        self.non_blank_kept()
        self.scribe_value() if self.o.scribe else self.value()
        if self.field.value != '""' or not self.o.delete_empty_values:
            self.entry.fields.append(self.field)
        return True

    def non_blank_kept(self) -> None:
        self.skip()

    def equals(self, space: bool) -> None:
        self.value_line = self.line()
        self.mark("Value")
        c = self.peek()
        if c == "=" or (self.o.scribe and c == "/"):
            self.get()
        elif not c or (self.o.scribe and space):
            pass
        else:
            raise self.lost("expected_equals", "Expected \"=\" after field ``%f''" if not self.o.scribe else 'Expected Scribe separator "=", "/", or " " for field ``%f\'\'', self.get())
        self._equals_sign()

    def _equals_sign(self) -> None:
        if not self.o.prettyprint:
            self.emit("EQUALS", "=")
            return
        if self.verbatim:
            self.page.put("=")
        else:
            self.page.put(" ")
            if self.o.align_equals:
                self.page.to_column(VALUE_INDENT - 2)
            self.page.put("= ")
        self.page.to_column(VALUE_INDENT)

    def between(self) -> None:
        """One blank line between entries."""
        if self.o.keep_spaces or not self.o.prettyprint:
            return
        self.non_blank()
        self.page.put("\n\n" if self.i < self.n else "\n")

    def group(self) -> None:
        """Balanced text that is copied as it is."""
        self.skip()
        if self.o.prettyprint:
            self.page.rstrip()
        if self.peek() not in ("{", "("):
            raise self.lost("expected_open", "Expected open brace or parenthesis", self.get())
        close, depth, start = ("}" if self.peek() == "{" else ")"), 0, self.i
        opener = self.peek()
        while self.i < self.n:
            c = self.s[self.i]
            self.i += 1
            depth += (c == opener) - (c == close)
            if not depth:
                break
        body = self.s[start + 1 : self.i - 1]
        self.entry.body = body
        if self.o.prettyprint:
            body = body.rstrip(SPACE)
            self.page.put("{" + body + ("\n}" if "%" in body.rpartition("\n")[2] else "}"))
        else:
            self.emit("LITERAL", "{" + body + "}")

    # values

    def value(self) -> None:
        """Simple strings joined by #."""
        if not self.o.prettyprint:
            self._value_tokens()
            return
        self.value_line = self.line()
        self.mark("Value")
        parts: list[tuple[str, str]] = []
        whole = self._part(parts)
        whole += self._hidden()
        while self.peek() == "#":
            self.get()
            whole += ("#" if self.verbatim else " # ") + self._hidden()
            whole += self._part(parts)
            whole += self._hidden()
        self.finish(whole, parts)

    def _value_tokens(self) -> None:
        self.value_line = self.line()
        self.mark("Value")
        parts: list[tuple[str, str]] = []
        while True:
            text = self._part(parts)
            self.emit("VALUE" if text.startswith('"') else "ABBREV", text, self.value_line)
            self.skip()
            if self.peek() != "#":
                break
            self.get()
            for kind, t in (("SPACE", " "), ("SHARP", "#"), ("SPACE", " ")):
                self.emit(kind, t)
            self.skip()
        self.field.parts, self.field.value = parts, " # ".join(t for _, t in parts)

    def _hidden(self) -> str:
        out = ""
        while (c := self.peek()) and (c in SPACE or c == "%"):
            if c == "%":
                out += HIDDEN + self.inline_comment() + HIDDEN
            else:
                out += c if self.verbatim else ""
                self.i += 1
        return out

    def _part(self, parts: list[tuple[str, str]]) -> str:
        at = self.i
        self.non_blank()
        if not self.o.parbreaks and re.search(r"\n[ \t\v\r]*\n|\f", self.s[at : self.i]):
            raise self.lost("paragraph_break", "Unexpected paragraph break for field ``%f''")
        c = self.peek()
        if c == "{":
            kind, text = "braced", self.braced()
        elif c == '"':
            kind, text = "quoted", self.quoted()
        elif "0" <= c <= "9":
            m = re.compile("[0-9]+").match(self.s, self.i)
            self.i = m.end()
            kind, text = "digits", f'"{m[0]}"'
        elif c.isalpha():
            m = _ID.match(self.s, self.i)
            self.i = m.end()
            kind, text = "abbrev", m[0]
        elif not c:
            return ""
        else:
            raise self.lost("expected_value", "Expected BibTeX value string for field ``%f''")
        self.checker.length(self, len(text))
        parts.append((kind, text))
        return text

    def _space(self, text: str, at: int, so_far: list[str]) -> str:
        """What a run of white space in a string becomes."""
        if "\f" in text or text.count("\n") > 1:
            if not self.o.parbreaks:
                self.i = at + len(text)
                raise self.lost("paragraph_break", "Unexpected paragraph break for field ``%f''", "".join(so_far) + " ")
            if self.o.keep_parbreaks and not self.o.keep_linebreaks and not self.verbatim:
                return PARBREAK
        if "\n" in text and (self.o.keep_linebreaks or self.verbatim):
            return LINEBREAK * (1 if self.o.keep_linebreaks or self.verbatim else 0)
        return " "

    def braced(self) -> str:
        """A braced string as a quoted one."""
        start, depth, out = self.i, 0, []
        while self.i < self.n:
            if m := _BRACED.match(self.s, self.i):
                self.i = m.end()
                out.append(m[0])
                continue
            c = self.s[self.i]
            if c in SPACE:
                m = _SPACES.match(self.s, self.i)
                self.i = m.end()
                out.append(" " if m[0] == " " else self._space(m[0], m.start(), out))
                continue
            self.i += 1
            if c == "\\" and self.i < self.n:
                nxt = self.s[self.i]
                if nxt == "\\":
                    self.i += 1
                    out.append("\\\\")
                    m = re.compile(r"[ \t\v\r]*\n\s*").match(self.s, self.i)
                    if m:
                        self.i = m.end()
                        out.append(LINEBREAK)
                    continue
            depth += (c == "{") - (c == "}")
            out.append(c)
            if not depth:
                break
        else:
            self.error("eof_in_string", "End-of-file in braced string")
            return '"' + "".join(out)[1:] + '"'
        return '"' + self._quotes("".join(out)[1:-1]) + '"'

    def _quotes(self, body: str) -> str:
        """Quotes at the outer level of a braced string go into braces."""
        if '"' not in body:
            return body
        out, depth, k = [], 0, 0
        while k < len(body):
            c = body[k]
            depth += (c == "{") - (c == "}")
            if c != '"' or depth:
                out.append(c)
                k += 1
                continue
            nxt = body[k + 1 : k + 2]
            if self.o.german_style:
                if nxt and nxt in GERMAN:
                    out.append('{"' + nxt + "}")
                    k += 2
                else:
                    out.append('{"}')
                    self.warn("german_quote", "Unexpected quote usage in German-style braced string")
                    k += 1
            elif out and out[-1] == "\\":
                m = re.compile(r"\"\{[^{}]\}").match(body, k)
                out.pop()
                take = m[0] if m else '"' + nxt
                out.append("{\\" + take + "}")
                k += len(take)
            else:
                out.append('{"}')
                k += 1
        return "".join(out)

    def quoted(self) -> str:
        """A quoted string, which ends at a quote outside braces."""
        self.i += 1
        depth, out = 0, ['"']
        while self.i < self.n:
            if m := _QUOTED.match(self.s, self.i):
                self.i = m.end()
                out.append(m[0])
                continue
            c = self.s[self.i]
            if c in SPACE:
                m = _SPACES.match(self.s, self.i)
                self.i = m.end()
                out.append(" " if m[0] == " " else self._space(m[0], m.start(), out))
                continue
            self.i += 1
            if c == "\\" and self.s[self.i : self.i + 1] == "\\":
                self.i += 1
                out.append("\\\\")
                m = re.compile(r"[ \t\v\r]*\n\s*").match(self.s, self.i)
                if m:
                    self.i = m.end()
                    out.append(LINEBREAK)
                continue
            depth += (c == "{") - (c == "}")
            if c == '"' and not depth:
                if out[-1] == "\\" and self.i < self.n:
                    out[-1] = '{\\"' + self.s[self.i] + "}"
                    self.i += 1
                    continue
                out.append(c)
                return "".join(out)
            out.append(c)
        self.error("eof_in_string", "End-of-file in quoted string")
        return "".join(out)

    def finish(self, whole: str, parts: list[tuple[str, str]]) -> None:
        """Fixes, checks and writes a value."""
        f = self.field
        f.parts, f.value = parts, checking.trim(whole)
        if self.entry.kind not in ("preamble", "string"):
            if self.scan:
                f.value = fixes.fix_tex(f.name, f.value, self.o, self.warn)
                self.seen.append(("field", self.entry, f, self.value_line, self.line()))
                return
            f.value = fixes.fix(f.name, f.value, self.o, self.warn)
            if self.o.check_values and f.value != '""':
                self.checker.check(self)
            if self.o.remove_opt_prefixes and f.name.startswith("OPT") and len(f.name) > 3 and len(f.value) > 2:
                f.name = f.name[3:]
                self.page.drop_line()
                self.page.spaces(FIELD_INDENT)
                self.page.put(f.name)
                self._equals_sign()
            elif self.o.delete_empty_values and f.value == '""':
                self.page.drop_line()
                self.drop_comma = True
                return
        if self.entry.kind == "preamble":
            self.entry.body = f.value
        for k, piece in enumerate(f.value.split(HIDDEN)):
            if k % 2:
                self.out("INLINE", piece)
            elif piece:
                self.out("VALUE" if piece.startswith('"') else "ABBREV", piece)
                self.checker.length(self, len(piece))

    # the second dialect

    def scribe_entry(self) -> None:
        self.head()
        name = self.entry.entry_name
        if name == "Comment":
            self.scribe_comment()
        elif name == "Begin" and self.scribe_block():
            pass
        elif name == "String":
            self.string()
        else:
            self.tight()
            self.scribe_open()
            self.body()
            self.scribe_end()
        self.between()

    def scribe_open(self) -> None:
        c = self.peek()
        if not c:
            return
        if c not in SCRIBE_PAIRS:
            raise self.lost("scribe_open", "Expected Scribe open delimiter, one of { [ ( < ' \" ` for field ``%f''", self.get())
        self.i += 1
        self.level = 1
        self.entry.open_delim, self.close = c, SCRIBE_PAIRS[c]
        self.outer = self.close
        self.out("LBRACE", "{")

    outer = "}"

    def scribe_end(self) -> None:
        c = self.peek()
        if not c:
            return
        self.i += 1
        if c != self.outer:
            raise self.lost("scribe_close", "Expected Scribe close delimiter ``%c'', but got ``%c'' instead for field ``%f''", c)
        self.level = 0
        self.out("RBRACE", "}")

    def scribe_comment(self) -> None:
        self.entry.kind = "comment"
        self.tight()
        self.scribe_open()
        end = self.s.find(self.outer, self.i)
        end = self.n if end < 0 else end
        body = self.s[self.i : end]
        self.entry.body, self.i, self.level = body, min(self.n, end + 1), 0
        if self.o.prettyprint:
            self.page.put(_balanced(body) + "}")
        else:
            self.emit("LITERAL", body)
            self.emit("RBRACE", "}")

    def scribe_block(self) -> bool:
        """@Begin{comment} up to @End{comment} becomes a comment entry."""
        m = re.compile(r"\s*[{\[(<'\"`]\s*comment\s*[}\])>'\"`]", re.I).match(self.s, self.i)
        if not m:
            return False
        e = re.compile(r"@end\s*[{\[(<'\"`]\s*comment\s*[}\])>'\"`]", re.I).search(self.s, m.end())
        body = self.s[m.end() : e.start() if e else self.n]
        self.i = e.end() if e else self.n
        self.entry.kind, self.entry.entry_name, self.entry.body = "comment", "Comment", body
        if self.o.prettyprint:
            self.page.cur = re.sub("@Begin$", "", self.page.cur)
            self.page.put("@Comment{" + _balanced(body) + "}")
        else:
            self.emit("LITERAL", body)
        return True

    def scribe_value(self) -> None:
        self.value_line = self.line()
        self.mark("Value")
        c = self.peek()
        if c.isalnum() and c:
            m = _SCRIBE_ID.match(self.s, self.i)
            self.i = m.end()
            text = f'"{m[0]}"'
        elif c in SCRIBE_PAIRS:
            text = self._scribe_string()
        elif not c:
            return
        else:
            raise self.lost("scribe_value", "Expected Scribe value string for field ``%f''", self.get())
        self.checker.length(self, len(text))
        if self.o.prettyprint:
            self.finish(text, [("scribe", text)])
        else:
            self.field.value = fixes.fix(self.field.name, checking.trim(text), self.o, self.warn)
            self.emit("VALUE", self.field.value, self.value_line)

    def _scribe_string(self) -> str:
        close = SCRIBE_PAIRS[self.s[self.i]]
        self.i += 1
        self.non_blank()
        out = ['"']
        while self.i < self.n:
            c = self.s[self.i]
            if c == close and out[-1] != "\\":
                self.i += 1
                break
            if c in SPACE:
                m = re.compile(r"[ \t\n\v\f\r]+").match(self.s, self.i)
                self.i = m.end()
                out.append(self._space(m[0], m.start(), out))
                continue
            self.i += 1
            if c == '"':
                if out[-1] == "\\":
                    nxt = self.s[self.i : self.i + 1]
                    self.i += 1
                    out[-1] = '{\\"' if nxt == "{" else '{\\"' + nxt + "}"
                else:
                    out.append('{"}')
            else:
                out.append(c)
        out.append('"')
        return "".join(out)


def _balanced(body: str) -> str:
    """A comment's text with a brace opened for each that it only closes."""
    out, depth = [], 0
    for c in body:
        if c == "}" and not depth:
            out.append("{")
        else:
            depth += (c == "{") - (c == "}")
        out.append(c)
    return "".join(out) + "}" * depth


def escape(text: str) -> str:
    """A token's text between quotes."""
    names = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
    return "".join(names.get(c) or (c if " " <= c <= "~" else f"\\{ord(c):03o}") for c in text)


def broken(line: str, width: int) -> str:
    """A line with a backslash and a line end before each character beyond the last column but one."""
    most = max(1, width - 1)
    return line if len(line) <= most else "\\\n".join(line[k : k + most] for k in range(0, len(line), most))


def token_lines(tokens: list[tuple[int, int, str, str]], file: str, last: int = 0, width: int = 1 << 60) -> list[str]:
    """Tokens as lines no wider than width, with a line directive wherever the line number grows."""
    out = []
    for line, number, name, text in tokens:
        if line > last:
            out.append(broken(f'# line {line} "{file}"', width))
            last = line
        out.append(broken(f'{number}\t{name}\t"{escape(text)}"', width))
    return out
