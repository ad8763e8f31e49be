"""Value fixes that need brace depth or TeX structure; a value is a quoted string or an expression of several."""

from __future__ import annotations

import re
from collections.abc import Callable

from scholia.functions.text import MONTH_MACROS
from scholia.options import Options

#: Word lists and macros (fixed values).
JUNIORS = ("Jr", "Jr.", "Sr", "Sr.", "SJ", "S.J.", "S. J.")
FONTS = ("bf", "em", "it", "rm", "sf", "sl", "tt")
ACCENT_SIGNS, ACCENT_LETTERS = "`'^\"~=.", "uvHtcdbr"
LIGATURES = ("oe", "OE", "ae", "AE", "aa", "AA", "o", "O", "l", "L", "ss", "i", "j")
MATH_WORDS = "arccos arcsin arctan arg cos cosh cot coth csc deg det dim exp gcd hom inf ker lg lim liminf limsup ln log max min sec sin sinh sup tan tanh Pr".split()

Warn = Callable[[str, str], None]


def _depths(s: str) -> list[int]:
    """The brace depth before each character."""
    out, depth = [], 0
    for c in s:
        depth -= c == "}"
        out.append(depth)
        depth += c == "{"
    return out


def _showing(message: str, value: str) -> str:
    """A message about what a value has become so far."""
    return message.replace("%v", value.replace("%", "%%"))


def squeeze(s: str) -> str:
    return re.sub(r"(\s)\s+", r"\1", s, flags=re.A)


def fix_pages(v: str) -> str:
    """Page ranges with en-dashes."""

    def dash(m: re.Match) -> str:
        before, after = v[: m.start()].rstrip(), v[m.end() : m.end() + 1]
        a = before[-1:] if before else ""
        wide = after == "?" or (a.isdigit() and after.isalnum()) or (a.isalpha() and after.isalpha())
        return "--" if wide else "-"

    return re.sub(r"\s*-[\s-]*", dash, v)


def fix_month(v: str) -> str:
    """Month names inside quotes become macros."""
    out, quoted, depth = [], False, 0
    for m in re.finditer(r"[A-Za-z]+\.?|.", v, re.S):
        t = m[0]
        if t == '"' and not depth:
            quoted = not quoted
        depth += (t == "{") - (t == "}")
        macro = MONTH_MACROS.get(t.lower()) if quoted and len(t) > 1 else None
        out.append(f'" # {macro} # "' if macro else t)
    s = "".join(out)
    parts = re.findall(r'"(?:\{(?:[^{}]|\{[^{}]*\})*\}|[^"{}])*"|[^"#]*[^"#\s]', s)
    full = [p.strip() for p in parts if p != '""']
    return " # ".join(full) if full and "#" in s and "\x01" not in s and len(full) < len(parts) else s


def looks_junior(last: str) -> bool:
    """Whether a name's last part has a comma, or a part like Jr. or a Roman number, outside braces."""
    for k, (c, d) in enumerate(zip(last, _depths(last), strict=True)):
        if d:
            continue
        if c == ",":
            return True
        if c in " \t":
            rest = last[k + 1 :]
            if rest[:1] in ("I", "V", "X") or any(rest.lower().startswith(j.lower()) for j in JUNIORS):
                return True
    return False


def name_order(name: str) -> str:
    """Last, First becomes First Last; parts that would be torn apart get braces."""
    commas = [k for k, (c, d) in enumerate(zip(name, _depths(name), strict=True)) if c == "," and not d]
    if "(" in name or not commas:
        return name
    last, first = name[: commas[-1]], name[commas[-1] + 1 :].lstrip()
    return first + " " + ("{" + last + "}" if looks_junior(last) else last)


def initials(name: str) -> str:
    """A space after periods between capitals outside braces."""
    d = _depths(name)
    capital = lambda c: "A" <= c <= "Z"
    return "".join(c + (" " if c == "." and not d[k] and capital(name[k - 1 : k]) and capital(name[k + 1 : k + 2]) else "") for k, c in enumerate(name))


def fix_names(v: str, o: Options) -> str:
    """Every name of a quoted list."""
    if not (v.startswith('"') and v.endswith('"') and len(v) > 1):
        return v
    body = v[1:-1]
    if o.scribe:
        body = re.sub(r"\s*;\s*", " and ", body)
    names = []
    for n in body.split(" and "):
        n = name_order(n) if o.fix_names else n
        names.append(initials(n) if o.fix_initials else n)
    return '"' + " and ".join(names) + '"'


def fix_accents(v: str) -> str:
    """Accent and ligature macros in braces of their own: {\\'e}, {\\H{o}}, {\\ss}."""
    out, k, n = [], 0, len(v)

    def argument(k: int) -> tuple[str, int] | None:
        """A letter or control word, in braces or not; white space after a bare control word goes with it."""
        m = re.compile(r"\s*(?:\{(\\[ij]|[^{}\\])\}|(\\[ij]|\\[A-Za-z]+)\s*|([A-Za-z]))").match(v, k)
        return (m[1] or m[2] or m[3], m.end()) if m else None

    while k < n:
        if v[k] != "\\":
            out.append(v[k])
            k += 1
            continue
        m = re.compile(r"\\([A-Za-z]+|.)", re.S).match(v, k)
        if not m:
            out.append(v[k:])
            break
        name, end, bare = m[1], m.end(), not (out and out[-1] == "{")
        if name in ACCENT_SIGNS and len(name) == 1 and (arg := argument(end)):
            text, end = "\\" + name + arg[0], arg[1]
        elif name in ACCENT_LETTERS and len(name) == 1 and (arg := argument(end)):
            text, end = "\\" + name + (arg[0] if arg[0][0] == "\\" else "{" + arg[0] + "}"), arg[1]
        elif name in LIGATURES:
            text = "\\" + name
            if bare:
                space = re.compile(r"\s*").match(v, end)
                end = space.end()
        else:
            out.append(m[0])
            k = end
            continue
        out.append("{" + text + "}" if bare else text)
        k = end
    return "".join(out)


def _pieces(s: str) -> list[tuple[str, str]]:
    """Math, control sequences with the space after them, braces, blanks and other characters, in order."""
    kinds = r"(?P<math>(\$\$?)(?:\\.|[^\\$])*\2)|(?P<macro>\\(?:[A-Za-z]+|.)\s*)|(?P<open>\{)|(?P<close>\})|(?P<other>.)"
    return [(m.lastgroup, m[0]) if m.lastgroup else ("math", m[0]) for m in re.finditer(kinds, s, re.S)]


def fix_bracing(v: str, warn: Warn) -> str:
    """Takes away inner braces that protect nothing, and widens outer ones to whole words. Groups that begin with a
    macro, arguments of macros, math, and braced spaces stay."""
    def once(m: re.Match) -> str:
        return "{" + m[2] + "}" if len(m[1]) == len(m[3]) else m[0]

    v = re.sub(r"(?<=[A-Za-z])(\{{2,})([A-Za-z]?)(\}{2,})", once, v)  # pairs inside a word, one around the other
    out: list[str] = []
    starts: list[tuple[int, bool]] = []  # where groups begin in out, and whether they must stay
    macro = False
    pieces = _pieces(v)
    k = 0
    while k < len(pieces):
        kind, t = pieces[k]
        if kind == "open" and [x[1] for x in pieces[k + 1 : k + 3]] == [" ", "}"]:
            out.append("{ }")
            k += 3
            continue
        if kind == "macro":
            macro = True
            out.append(t)
        elif kind == "open":
            nxt = pieces[k + 1 : k + 3]
            keep = macro or any(p[0] == "macro" for p in nxt[:1])
            if any(p[0] == "macro" for p in nxt):
                macro = True
            if not macro and out and out[-1] == "}" and not starts:
                out.pop()  # two groups side by side become one
                depth, j = 1, len(out) - 1
                while depth and j >= 0:
                    depth += (out[j] == "}") - (out[j] == "{")
                    j -= 1
                starts.append((j + 1, keep))
                k += 1
                continue
            at = len(out)
            if not keep and not starts:
                while at and len(out[at - 1]) == 1 and (out[at - 1].isalnum() and out[at - 1].isascii() or out[at - 1] == "."):
                    at -= 1
            out.insert(at, "{")
            starts.append((at, keep))
        elif kind == "close":
            out.append("}")
            at, keep = starts.pop() if starts else (None, True)
            if at is not None and not keep and not macro:
                if starts:  # inside another group, braces protect nothing more
                    before = "".join(out[:at])[-1:]
                    if not before.isalpha() and out[at + 1 : at + 2] and not out[at + 1].startswith("\\"):
                        del out[-1], out[at]
                else:
                    while k + 1 < len(pieces) and pieces[k + 1][0] == "other" and pieces[k + 1][1].isalnum() and pieces[k + 1][1].isascii():
                        out.insert(len(out) - 1, pieces[k + 1][1])
                        k += 1
            if not starts:
                macro = False if t == "}" and not keep else macro
        else:
            out.append(t)
            if t.isspace():
                macro = False
        k += 1
    s = squeeze("".join(out))
    if _balance(v):
        warn("unbalanced_braces", "Unbalanced brace(s) in value ``%v''")
    return s


def _balance(s: str) -> int:
    return s.count("{") - s.count("}")


def _capital(formula: str) -> bool:
    """Whether a formula has a capital outside groups that are scripts, arguments or plain text, or a macro that begins with one."""
    if re.search(r"\\[A-Z]", formula):
        return True
    formula = re.sub(r"\\[^A-Za-z]", "", formula)
    while (inner := re.sub(r"(\\[A-Za-z]+|[_^])\{[^{}]*\}|\{(?!\\)[^{}]*\}", r"\1", formula)) != formula:
        formula = inner
    return bool(re.search(r"[A-Z]", re.sub(r"\\[a-z]+", "", formula)))


_MATH_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[A-Za-z]|[0-9]+(?:\.[0-9]+)?|:=|<=|>=|\s+|.", re.S)
#: How a token of a formula binds. Relations and operators take space on both sides if they have operands there; what opens takes none after itself.
OPERATORS = {*"=+-/:<>*", ":=", "<=", ">="}
OPENS, CLOSES, SEPARATES, SCRIPTS = "([{", ")]", ",;", "^_"


def math_tokens(body: str) -> list[str]:
    """The tokens of a formula; white space is one blank, and none beside a script sign; a script of one character has no braces."""
    text = re.sub(r"\s*([_^])\s*", r"\1", body.strip())
    text = re.sub(r"([_^])\{\s*([A-Za-z0-9])\s*\}", r"\1\2", text)
    return [" " if t.isspace() else t for t in _MATH_TOKEN.findall(text)]


def math_spacing(body: str) -> str:
    """The inside of a formula with spaces around relations and operators, after commas, and between operands."""
    tokens = math_tokens(body)
    if len("".join(tokens)) <= 1:
        return "".join(tokens)
    out: list[str] = []
    prev, depth = "", 0
    for k, t in enumerate(tokens):
        following = next((x for x in tokens[k + 1 : k + 3] if x != " "), "")
        before = after = False  # whether space stands on a side of the token
        if t == " ":
            if out and out[-1] == "{" and depth:
                out.append(" ")  # text
            elif out and prev[-1:] not in (*OPENS, *SCRIPTS):
                out.append(" ")
            continue
        if t in OPERATORS:
            operand = prev not in ("", *OPENS, ",", *SCRIPTS) and prev not in OPERATORS
            before = operand and following != "}" or prev in OPERATORS
            after = operand and following != "}" or not prev
        elif t in SEPARATES:
            after = True
        elif t[0] == "\\":
            before, after = bool(prev) and prev not in (*SCRIPTS, *OPENS), True
        elif t.isalnum():
            before = prev.isalnum() and not depth and out[-1][-1:] not in SCRIPTS
        elif t in OPENS:
            before = len(out) > 1 and out[-2] in SCRIPTS  # after a script of one character
            depth += t == "{"
        elif t == "}":
            depth -= 1
        if t in (*SEPARATES, *CLOSES, *SCRIPTS):
            while out and out[-1] == " ":
                out.pop()
        if before:
            out.append(" ")
        out.append(t)
        if after:
            out.append(" ")
        prev = t
    return re.sub(r" +", " ", "".join(out)).strip()


_FORMULA = re.compile(r"(?<!\\)(\$\$?)((?:\\.|[^\\$])*)\1", re.S)


def fix_math(v: str, o: Options, warn: Warn, brace_capitals: bool = False) -> str:
    """Spacing inside dollar signs; with brace_capitals, formulas with capitals outside braces get braces, and so do those right after a capital."""
    out, last = [], 0
    depth = _depths(v)
    ties = False
    for m in _FORMULA.finditer(v):
        body = math_spacing(m[2]) if o.fix_math else m[2]
        scripts = body[:1] in "_^" or body[:3] in ("{}_", "{}^")
        text = m[1] + (body if len(body) <= 1 or scripts or not o.fix_math else f" {body} ") + m[1]
        if brace_capitals and not depth[m.start()] and (_capital(body) or "A" <= v[m.start() - 1 : m.start()] <= "Z"):
            text = "{" + text + "}"
        if o.fix_math and not depth[m.start()] and len(body) == 1 and body.isalpha() and re.match("[A-Za-z0-9>]", v[m.end() : m.end() + 1]):
            text += " "
        for w in MATH_WORDS if o.fix_math else ():
            if re.search(rf"(?<![\\A-Za-z]){w}(?![A-Za-z])", m[2]):
                warn("math_word", "Unbackslashed math word in math mode in value ``%v''")
        out += [v[last : m.start()], text]
        last = m.end()
        ties = ties or "~" in body
        if o.fix_math and re.search("<=|>=|==|:=", m[2]):
            warn("compound_operator", "Unusual compound assignment or equality-test operator in math mode value ``%v'' (e.g., perhaps replace <= by \\leq)")
    rest = v[last:]
    if o.fix_math and (m := re.search(r"(?<!\\)\$\$?", rest)):  # a formula that does not end
        quote = '"' * rest.endswith('"')
        rest = rest[: m.end()] + " " + math_spacing(rest[m.end() :].removesuffix('"')) + quote
    out.append(rest)
    fixed = squeeze("".join(out))
    plain = re.sub(r"(?<!\\)\$\$?(?:\\.|[^\\$])*\$\$?|\\.", "", v)
    if o.fix_math:
        for sign, code, name in (("_", "subscript", "Subscript"), ("^", "superscript", "Superscript")):
            if sign in plain:
                warn(code, _showing(f"{name} operator outside math mode in value ``%v''", fixed))
        if "$" in plain:
            warn("unbalanced_dollars", _showing("Unbalanced math-mode dollar(s) in value ``%v''", fixed))
        if ties:
            warn("math_ties", _showing("Unexpected TeX tie[s] (tilde[s]) in math mode ``%v''", fixed))
    return fixed


def font_braces(v: str) -> str:
    """A second pair of braces around outer groups that change the font."""
    out, k = [], 0
    d = _depths(v)
    while k < len(v):
        if v[k] == "{" and not d[k] and re.match(r"\{\s*\\(?:" + "|".join(FONTS) + ")", v[k:]):
            end = next((j for j in range(k + 1, len(v)) if v[j] == "}" and not d[j]), None)
            if end is not None:
                out.append("{" + v[k : end + 1] + "}")
                k = end + 1
                continue
        out.append(v[k])
        k += 1
    return "".join(out)


def protect_acronyms(v: str) -> str:
    """Braces around words outside braces that hold a capital after their first letter."""
    d = _depths(v)
    return re.sub(r"[A-Za-z0-9]*[A-Z][A-Za-z0-9]*", lambda m: "{" + m[0] + "}" if not d[m.start()] and re.search(".[A-Z]", m[0]) and v[m.start() - 1 : m.start()] != "\\" else m[0], v)


def _closing(v: str) -> dict[int, int]:
    """Where each group that is closed ends, by where it begins."""
    out, stack = {}, []
    for m in re.finditer("[{}]", v):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


_TITLE_PART = re.compile(rf"\$\$(?:\\.|[^\\$]|\$(?!\$))*\$\$|\$(?:\\.|[^\\$])+\$|(?P<group>\{{)|\\(?P<accent>[{ACCENT_LETTERS}])(?:\{{(?P<braced>[A-Za-z])\}}|\s+(?P<letter>[A-Za-z]))|\\(?:[A-Za-z]+|.)|[^\\{{$]+|.", re.S)
_CONTROL = re.compile(r"\\(?:[A-Za-z]+|.)", re.S)


def _own_letters(v: str, k: int, end: int, ends: dict[int, int]) -> str:
    """The text of a group, without control words, their arguments and inner groups, but with the letters of accents."""
    out, accent = [], False
    while k < end:
        if v[k] == "{" and k in ends:
            if accent:
                out.append(v[k : ends[k]])
            k = ends[k] + 1
            continue
        m = _CONTROL.match(v, k)
        if m:
            accent, k = m[0][1:] in (*ACCENT_LETTERS, *ACCENT_SIGNS), m.end()
            continue
        accent = accent and v[k].isspace()
        out.append(v[k])
        k += 1
    return "".join(out)


def title_accents(v: str) -> str:
    """Outside braces and formulas, groups that begin with a control sequence and hold a capital get a second pair, and accents get one if their letter
    stands bare, or if they hold a capital."""
    out, k, ends = [], 0, _closing(v)
    while m := _TITLE_PART.match(v, k):
        text, k = m[0], m.end()
        if m["group"] and k - 1 in ends:
            k, start = ends[k - 1] + 1, k - 1
            text = v[start:k]
            if text[1] == "\\" and re.search("[A-Z]", _own_letters(v, start + 1, k - 1, ends)):
                text = "{" + text + "}"
        elif m["letter"]:
            text = "{\\" + m["accent"] + "{" + m["letter"] + "}}"
        elif m["accent"] and (m["accent"] + m["braced"]) != (m["accent"] + m["braced"]).lower():
            text = "{" + text + "}"
        out.append(text)
    return "".join(out)


def math_left_open(v: str) -> bool:
    """Whether a formula, inline or displayed, does not end."""
    inside = ""
    for m in re.finditer(r"\\.|\$\$|\$", v, re.S):
        if m[0][0] == "\\":
            continue
        if not inside:
            inside = m[0]
        elif inside == "$" and m[0] == "$$":
            pass  # one ends and another begins
        elif m[0] == inside:
            inside = ""
    return bool(inside)


def fix_title(v: str, o: Options, warn: Warn) -> str:
    v = fix_spacing(v, o, warn)
    v = title_accents(v)
    v = re.sub(r"(?<!\\)\$([^$]+)\$\$([_^](?:\\.|[^\\$])+)\$", r"$\1\2$", v)
    if o.fix_math:
        v = fix_math(v, o, warn, brace_capitals=True)
    else:
        v = _brace_formulas(v)
    if o.brace_protect:
        v = protect_acronyms(v)
    body = v[1:-1] if v.startswith('"') and v.endswith('"') else v
    if math_left_open(body):
        warn("unclosed_math", _showing("Unclosed math mode in value ``%v''", v))
    if body.endswith("."):
        warn("final_period", _showing("Final period/dot/fullstop is unexpected, and often wrong, in BibTeX title ``%v''", v))
    if "..." in body:
        warn("ellipsis", _showing("Literal ellipsis ... should probably be \\ldots{} in BibTeX title ``%v''", v))
    if _balance(v):
        warn("unbalanced_braces", _showing("Unbalanced brace(s) in value ``%v''", v))
    return font_braces(v) if o.fix_font_changes else v


def _brace_formulas(v: str) -> str:
    """Formulas side by side with capitals, outside braces, get braces as one."""
    d = _depths(v)

    def brace(m: re.Match) -> str:
        t = re.sub(r"\$\$(?=[_^])", "", m[0]) if re.match(r"\$[^$]+\$\$[_^]", m[0]) else m[0]
        return "{" + t + "}" if not d[m.start()] and _capital(m[0]) else m[0]

    return re.sub(r"(?<!\\)\$\$?(?:\\.|[^\\$])+\$\$?", brace, v)


def fix_spacing(v: str, o: Options, warn: Warn) -> str:
    """Accents and braces by option."""
    v = fix_accents(v) if o.fix_accents else v
    return fix_bracing(v, warn) if o.fix_braces else v


def fix(name: str, v: str, o: Options, warn: Warn) -> str:
    """The fixes of a field."""
    n = name.lower().removeprefix("opt") if name.startswith("OPT") else name.lower()
    if n in ("abstract", "annote", "note", "remark"):
        v = fix_spacing(v, o, warn)
        return fix_math(v, o, warn) if o.fix_math else v
    if n in ("author", "editor"):
        v = fix_names(v, o)
        return fix_spacing(v, o, warn)
    if n in ("title", "booktitle"):
        return fix_title(v, o, warn)
    if n == "month":
        return fix_month(v)
    return fix_pages(v) if n == "pages" else v


def fix_tex(name: str, v: str, o: Options, warn: Warn) -> str:
    """Those fixes of a field that need the structure of its TeX; the others are column expressions."""
    n = name.lower().removeprefix("opt") if name.startswith("OPT") else name.lower()
    plain = n in ("month", "pages") or n in ("author", "editor") and not names_need_tex(o)
    return v if plain else fix(name, v, o, warn)


def names_need_tex(o: Options) -> bool:
    """Whether accents or braces of names are fixed, which comes after their order."""
    return o.fix_accents or o.fix_braces
