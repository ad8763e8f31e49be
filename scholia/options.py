"""Options of the cleaner, and how option words resolve to them."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Frozen options of one file; a later file starts from those of the file before it."""

    align_equals: bool = False
    brace_protect: bool = False
    check_values: bool = True
    debug_match_failures: bool = False
    delete_empty_values: bool = False
    file_position: bool = False
    fix_accents: bool = False
    fix_braces: bool = False
    fix_font_changes: bool = False
    fix_initials: bool = True
    fix_math: bool = False
    fix_names: bool = True
    german_style: bool = False
    keep_linebreaks: bool = False
    keep_parbreaks: bool = False
    keep_preamble_spaces: bool = False
    keep_spaces: bool = False
    keep_string_spaces: bool = False
    max_width: int | None = None
    parbreaks: bool = True
    prettyprint: bool = True
    read_init_files: bool = True
    remove_opt_prefixes: bool = False
    scribe: bool = False
    warnings: bool = True

    @property
    def width(self) -> int:
        """The last column of wrapped values; not positive means without limit."""
        limit = (72 if self.prettyprint else 0) if self.max_width is None else self.max_width
        return limit if limit > 0 else 1 << 60


_FLAGS = {f.name.replace("_", "-"): f.name for f in dataclasses.fields(Options) if f.name != "max_width"}
#: Options that take a word, or print something; they belong to the caller.
OUTSIDE = ("author", "copyleft", "copyright", "error-log", "help", "init-file", "isbn-file", "keyword-file", "output-file", "print-isbn-table", "print-keyword-table", "print-patterns", "trace-file-opening", "version")


class UnknownOption(ValueError):
    pass


def resolve(words: list[str], start: Options | None = None) -> tuple[Options, list[tuple[str, str | None]], list[str]]:
    """(options, outside options with their word, file names). Names are case-insensitive, may be cut short
    where that is unambiguous, begin with one or two hyphens, and no- denies them."""
    got, outside, files = dataclasses.asdict(start or Options()), [], []
    it = iter(words)
    for w in it:
        if not w.startswith("-") or w == "-":
            files.append(w)
            continue
        name = w.lstrip("-").lower()
        deny = name.startswith("no-")
        name = name.removeprefix("no-")
        known = [*_FLAGS, "max-width", "quiet", *OUTSIDE]
        hits = [k for k in known if k == name] or [k for k in known if k.startswith(name)]
        if len(hits) != 1:
            raise UnknownOption(w)
        if hits[0] == "max-width":
            got["max_width"] = int(next(it))
        elif hits[0] == "quiet":
            got["warnings"] = deny
        elif hits[0] in _FLAGS:
            got[_FLAGS[hits[0]]] = not deny
        else:
            takes = hits[0].endswith(("-file", "-log")) and hits[0] != "trace-file-opening"
            outside.append((hits[0], next(it) if takes else None))
    return Options(**got), outside, files
