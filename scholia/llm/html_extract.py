"""Main text of web pages by consensus paths of their host.

Every page's elements are scored as containers: the text of the blocks directly in one counts whole, that of blocks one
element deeper half, less what is link text. The page votes for the path of its best container, tag and class names
down from the root with digits generalised, with the container's share of all scores; a container inside an article stands for the
whole article, any other for the smallest one around it, below the body, that holds more text. Spark adds up the votes of each host and path.
A page is then extracted again from the elements whose path won at its host, or from those of the
next path that it has, or, where it has none of them or they hold much less than its own article, from its own best container. A host's PATHS_OF_HOST paths
with the most votes are looked up; a page that has none of these is left with the container that it voted for itself.

Menus, headers outside the article, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
known by tag, role, or class and id names, and are neither scored nor extracted; names and forms do not drop what is around the article. Character references are decoded, white space inside a
block becomes one space, blocks join by an empty line.

Hosts may be any size: votes are partially aggregated, and the paths of all hosts are broadcast up to BROADCAST_BYTES, else
joined with a salt.

Defined cases: null and empty pages give an empty text; a null URL is a host of its own; unclosed and crossed tags close
as their context asks, a head at the first tag that cannot be in it; formulas are text; what is hidden is dropped; tags whose quotes do not end take time in proportion to the page; text without a tag is one block; equal scores go to the first element, equal votes to the
smaller path; repeated rows give a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Tags by their role, and names that mark what is not the article (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas select".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP_TAGS = frozenset("nav footer aside button menu dialog head fieldset annotation annotation-xml".split()) | RAW
#: What a head may hold; any other tag ends it.
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
CONTAINERS = frozenset("article main section div td body html blockquote".split())
PAIRED = {"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|newsletter|subscribe|signup|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|foot|header|masthead|comments?|disqus|replies|respond|related|recommend\w*|share|sharing|social|widget|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
#: Words of a class or id that say what an element has, not what it is.
MODIFIERS = re.compile(r"(?<!\S)(?:has|no|with|without)[-_]\S+", re.I)
#: Words that, inside an article, name a place in it.
PLACE_NAME = re.compile(r"(?<![^\s_-])(?:header|side|foot)(?![^\s_-])", re.I)
#: Names of parts that may be longer than the article, or hold articles of their own.
OTHER_TEXT = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond|related|recommend\w*)(?:$|[\s_-])", re.I)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Paths of a host that its pages look up.
PATHS_OF_HOST = 16
#: Bytes of all hosts' paths that are broadcast at most.
BROADCAST_BYTES, SALTS = 16_000_000, 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|\Z)", re.I)
#: Characters, as a multiple of the page's, that are read in vain for the ends of quoted attributes; beyond, a tag ends at its next ">".
VAIN = 8


class Page:
    """Elements and text blocks of a page. Elements: parent, path (by number), tag; blocks: element, text, link characters. Time and memory
    are linear in the page, however tags nest or stay open."""

    def __init__(self, source: str):
        self.parent, self.tag = [-1], [""]
        self.paths: dict[tuple[int, str], int] = {}  # a tree of paths: of the path above and a label
        self.above: list[tuple[int, str]] = [(-1, "")]
        self.path = [0]
        self.in_article = [False]  # by tags or names
        self.block, self.container = [0], [0]  # the nearest from the element up
        self.dropped = [False]
        self.forms: list[int] = []
        self.named: dict[int, bool] = {}  # blocks dropped by a name, and whether it is of OTHER_TEXT
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source)
        self._drop_forms()
        self._drop_named()

    def _parse(self, s: str) -> None:
        stack, pos, n = [0], 0, len(s)
        last_end, vain = s.rfind(">"), VAIN * n
        text: list[str] = []
        linked, in_link, owner = 0, 0, 0
        low_cache: str | None = None
        opened: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
        block_at = [0]  # where in the stack blocks are open, and the root

        def flush() -> None:
            nonlocal text, linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((owner, joined, linked))
                text, linked = [], 0

        def pop_to(k: int) -> None:
            nonlocal owner, in_link
            for e in reversed(stack[k:]):
                opened[self.tag[e]].pop()
                if self.tag[e] in BLOCK:
                    flush()
                    block_at.pop()
                if self.tag[e] == "a":
                    in_link = max(0, in_link - 1)
            del stack[k:]
            owner = stack[block_at[-1]]

        def last(tags) -> int:
            return max((opened[t][-1] for t in tags if opened[t]), default=0)

        while pos < n:
            at = s.find("<", pos)
            if at < 0:
                at = n
            if at > pos:
                run = s[pos:at]
                if not self.dropped[stack[-1]]:
                    run = html_lib.unescape(run) if "&" in run else run
                    text.append(run)
                    if in_link:
                        linked += len(run.strip())
                pos = at
                continue
            # beyond the last ">" only a comment can still begin
            m = None
            if at < last_end or s.startswith("<!--", at):
                if vain > 0 and (m := _TOKEN.match(s, at)) is None:
                    vain -= n - at
                m = m or (_TOKEN if s.startswith("<!", at) else _LOOSE).match(s, at)
            if m is None:  # a bare "<" is text
                if not self.dropped[stack[-1]]:
                    text.append("<")
                pos = at + 1
                continue
            pos = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if opened["head"] and tag not in HEAD_TAGS and not (m[1] and tag != "body"):
                pop_to(opened["head"][-1])
            if m[1]:
                if tag in VOID:
                    if tag == "br" and not self.dropped[stack[-1]]:
                        text.append(" ")
                    continue
                k = last((tag,))
                if k and (tag in BLOCK or k > block_at[-1]):  # else a stray end
                    pop_to(k)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif not self.dropped[stack[-1]] and tag == "br":
                    text.append(" ")
                continue
            if tag in RAW:
                if m[3].endswith("/"):
                    continue
                low_cache = low_cache or s.lower()
                if len(low_cache) != n:  # a letter whose lower case is longer
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(s, pos)
                    end = end.start() if end else -1
                else:
                    end = low_cache.find(f"</{tag}", pos)
                close = s.find(">", end) if end >= 0 else -1
                pos = n if end < 0 else (n if close < 0 else close + 1)
                continue
            if tag in BLOCK and self.tag[stack[block_at[-1]]] == "p":
                pop_to(block_at[-1])
            if tag in SAME:
                k = last((tag, *PAIRED.get(tag, ())))
                if k > last(SAME[tag]):
                    pop_to(k)
            if tag in BLOCK:
                flush()
            self._open(tag, m[3], stack)
            opened[tag].append(len(stack) - 1)
            if tag == "a":
                in_link += 1
            if tag in BLOCK:
                block_at.append(len(stack) - 1)
                owner = stack[-1]
        pop_to(1)
        flush()

    def _open(self, tag: str, attrs: str, stack: list[int]) -> None:
        up, names, role, hidden, path = stack[-1], "", "", False, tag
        if "=" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    names += " " + value
                if name == "class" and (cls := ".".join(sorted(set(_DIGITS.sub("#", value.lower()).split())))):
                    path = f"{tag}.{cls}".replace(">", "")
                elif name == "role":
                    role = value.lower()
                elif name == "hidden":
                    hidden = True
                elif name == "style":
                    hidden = hidden or "display:none" in value.replace(" ", "").lower()
        if "hidden" in attrs.lower():
            hidden = hidden or bool(_HIDDEN.search(_ATTR.sub(" ", attrs)))
        article = self.in_article[up]
        drop = self.dropped[up] or tag in DROP_TAGS or (tag == "header" and not article) or role in DROP_ROLES or hidden
        if names and not drop and tag not in ("html", "body", "article", "main"):
            names = MODIFIERS.sub("", names)
            if DROP_NAMES.search(PLACE_NAME.sub("", names) if article else names):
                if tag in BLOCK:  # what it holds decides
                    self.named[len(self.tag)] = bool(OTHER_TEXT.search(names))
                else:
                    drop = True
        if tag == "form" and not drop:
            self.forms.append(len(self.tag))
        self.parent.append(up)
        self.tag.append(tag)
        # inline elements never hold a container, so their names would only split the votes
        label, e = (self.path[up], path), len(self.tag) - 1
        if tag in BLOCK and label not in self.paths:
            self.paths[label] = len(self.above)
            self.above.append(label)
        self.path.append(self.paths[label] if tag in BLOCK else self.path[up])
        self.in_article.append(article or (tag in BLOCK and ("article" in path or "main" in path)))
        self.block.append(e if tag in BLOCK else self.block[up])
        self.container.append(e if tag in CONTAINERS else self.container[up])
        self.dropped.append(drop)
        stack.append(len(self.tag) - 1)

    def _drop_forms(self) -> None:
        """Drops forms, with all inside, but those around the whole page: that hold main, all of its article elements or more than nine
        tenths of its text that is no link."""
        if not self.forms:
            return
        size, articles, mains = self._held()
        for e in self.forms:
            whole = mains[e] or (articles[e] and articles[e] == articles[0]) or 10 * size[e] > 9 * size[0]
            self.dropped[e] = self.dropped[e] or not whole
        for e in range(1, len(self.tag)):
            self.dropped[e] = self.dropped[e] or self.dropped[self.parent[e]]
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    def _held(self) -> tuple[list[int], list[int], list[int]]:
        """Of each element, with all inside: text that is no link, articles and mains."""
        size, articles, mains = ([0] * len(self.tag) for _ in range(3))
        for e, text, linked in self.blocks:
            size[e] += max(0, len(text) - linked)
        for e in range(len(self.tag) - 1, 0, -1):
            if not self.dropped[e]:
                articles[e] += self.tag[e] == "article"
                mains[e] += self.tag[e] == "main"
            for x in (size, articles, mains):
                x[self.parent[e]] += x[e]
        return size, articles, mains

    def _drop_named(self) -> None:
        """Drops blocks by name, with all inside, but those that are around the page's article: that hold main, all of its
        article elements or more than half of its text that is no link."""
        if not self.named:
            return
        size, articles, mains = self._held()
        for e in range(1, len(self.tag)):
            up = self.dropped[self.parent[e]]
            if e in self.named and not up:
                most, every = 2 * size[e] > size[0], articles[e] > 0 and articles[e] == articles[0] and not mains[0]
                up = not (mains[e] or ((most and every) if self.named[e] else (most or every)))
            self.dropped[e] = self.dropped[e] or up

    def _chain(self, e: int, nearest: list[int]) -> Iterator[int]:
        """The blocks or containers from an element up, the root last."""
        while True:
            e = nearest[e]
            yield e
            if e == 0:
                return
            e = self.parent[e]

    def path_text(self, e: int) -> str:
        labels, at = [], self.path[e]
        while at:
            at, label = self.above[at]
            labels.append(label)
        return "".join(f">{x}" for x in reversed(labels))

    def with_path(self, path: str) -> set[int]:
        """The blocks, not dropped, that have a path."""
        at = 0
        for label in path.split(">")[1:]:
            if (at := self.paths.get((at, label), -1)) < 0:
                return set()
        return {e for e, p in enumerate(self.path) if p == at and (self.tag[e] in BLOCK or e == 0) and not self.dropped[e]}

    def scores(self) -> dict[int, float]:
        """Scores of the containers."""
        out: dict[int, float] = defaultdict(float)
        for e, text, linked in self.blocks:
            if self.dropped[e]:
                continue
            size, weight = max(0, len(text) - linked), 1.0
            for c in self._chain(e, self.container):
                out[c] += weight * size * (1.25 if self.tag[c] in ("article", "main") else 1.0)
                weight /= 2
                if weight < 0.2:
                    break
        return out

    def best(self) -> tuple[int, float] | None:
        """The best container and its share of all scores."""
        s = self.scores()
        if not s:
            return None
        top = max(s, key=lambda e: (s[e], -e))
        return self._lifted(top), s[top] / (sum(s.values()) or 1.0)

    def _lifted(self, top: int) -> int:
        """The article or main around a container; without one the smallest container around it, below the body, that holds other text."""
        around = [e for e in self._chain(top, self.container) if e and self.tag[e] not in ("body", "html")]
        for tag in ("article", "main"):
            if (e := next((e for e in around if self.tag[e] == tag), None)) is not None:
                return e
        size, articles = [0] * len(self.tag), [0] * len(self.tag)
        for b in self.blocks:
            size[b[0]] += 0 if self.dropped[b[0]] else self._size([b])
        for e in range(len(self.tag) - 1, 0, -1):
            articles[e] += self.tag[e] in ("article", "main") and not self.dropped[e]
            size[self.parent[e]] += size[e]
            articles[self.parent[e]] += articles[e]
        if top not in around or articles[top]:
            return top
        return next((e for e in around if size[e] > size[top]), top)

    def _around(self, top: int, elements: set[int]) -> bool:
        """Whether an element is one of some elements or around one."""
        inside = [False] * len(self.tag)
        for e in range(len(self.tag)):
            inside[e] = e == top or (e > 0 and inside[self.parent[e]])
        return any(inside[e] for e in elements)

    @staticmethod
    def _size(blocks: list[tuple[int, str, int]]) -> int:
        """Characters of blocks that are more text than links."""
        return sum(len(t) - linked for _, t, linked in blocks if 2 * linked < len(t))

    def text_of(self, elements: set[int]) -> str:
        return "\n\n".join(t for _, t, _ in self._within(elements))

    def _within(self, elements: set[int]) -> list[tuple[int, str, int]]:
        """The blocks in any of the elements, in page order."""
        memo: dict[int, bool] = {-1: False}

        def inside(e: int) -> bool:
            chain = []
            while e not in memo and e not in elements:
                chain.append(e)
                e = self.parent[e]
            got = e in elements or memo[e]
            memo.update((c, got) for c in chain)
            return got

        return [b for b in self.blocks if not self.dropped[b[0]] and inside(b[0])]


def vote(source: str | None) -> tuple[str, float] | None:
    """The path that a page votes for, and the weight of its vote."""
    page = Page(source or "")
    best = page.best()
    return (page.path_text(best[0]), best[1]) if best else None


def extract(source: str | None, paths: list[str]) -> str:
    """The page's text from the first path that it has text in; from its own best container where that is an article or
    around the path's elements and has more than twice their text."""
    page = Page(source or "")
    best = page.best()
    for path in paths:
        mine = page.with_path(path)
        if mine and (text := page.text_of(mine)):
            own = best[0] if best else 0
            if best and (page.tag[own] in ("article", "main") or page._around(own, mine)) and page._size(page._within({own})) > 2 * page._size(page._within(mine)):
                return page.text_of({own})
            return text
    return page.text_of({best[0]}) if best else ""


def _host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the PATHS_OF_HOST paths with the most votes, first the winner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, str], float] = defaultdict(float)
            for host, source in zip(b.column(0), b.column(1), strict=True):
                if got := vote(source.as_py()):
                    votes[host.as_py(), got[0]] += got[1]
            rows = sorted(votes)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string()), pa.array([round(votes[r], 6) for r in rows], pa.float64())], ["host", "path", "votes"])

    # decimals add up alike in any order
    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, votes double").groupBy("host", "path").agg(F.sum(F.col("votes").cast("decimal(28,6)")).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))  # a row for each distinct path of a host
    top = votes.withColumn("rank", rank).filter(F.col("rank") <= PATHS_OF_HOST)
    return top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    won = materialize(host_paths(pages), "html-paths")
    size = won.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "")) + 16 * F.size("paths") + 40)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        both = pages.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(h.as_py(), p.as_py() or []) for h, p in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
