"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets
form a class, named by a hash of the set. Classes are branched by trees: under a tree's own order
of all shingles, a class descends along its minwise tokens, and classes with the same first
``level`` tokens share a node. Two sets of similarity J meet in a node with probability near J**level, so
independent trees are repeated until the chance that a pair at the threshold meets nowhere is below 1e-6.

Nodes are compared exhaustively, and only emit what joins components, never their pairs. So groups of any size stay
linear:

1. every class is confirmed against the node pivot that it meets most often, which joins big groups as stars;
2. where a big node still has many classes outside its largest component, all its classes meet once each, in blocks dealt anew in each of a few
   rounds, and the pairs that 256-byte sketches call similar are confirmed as far as they would join components of the block;
3. a node of up to NODE_MAX classes is a part. Of a bigger one the classes outside its largest component are compared in pairs of blocks, or, where
   they are more than GRID_NODES times NODE_MAX, branch deeper, with more trees. The largest component's own classes are not repeated in its
   nodes: each class outside is set against the whole component once, however many nodes they share, by blocks of both;
4. in every part each class is confirmed with the most alike of other components; where sketches leave more links between components
   possible, the words of those classes meet in the part's task and are compared exactly.

At the last level pairs of blocks take nodes of any size. Sketches rule a pair out where they are five standard deviations below
the threshold, a chance below 1e-6 a pair. Links are confirmed on the shingles themselves, not on their hashes.

Long paths say little of small sets: one of fewer tokens than the path meets only equal sets. So the classes that branch deeper with up to SMALL
shingles are first joined exactly, by the subsets that two of them may have in common (small_links).

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text with fewer words
than a shingle is one shingle; rows that repeat a doc_id each have the component_id of their own set, and keep_one keeps or drops each by
it, so exactly repeated rows stay or go together; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, mix64, scratch_scope, shingle_set, text_slices, tidy, unused, word_hashes

#: (tokens on a path, trees), by depth of branching.
LEVELS = ((2, 16), (4, 32), (6, 64))
#: Most classes that a node compares in one task, classes of a side of a block of a grid, and how many times NODE_MAX a grid of a node takes.
NODE_MAX, GRID, GRID_NODES = 256, 512, 8
#: Rounds of step 2, and the share of joined classes below which there is no other round.
ROUNDS, GAIN = 4, 0.05
#: Classes of a star that one task confirms.
STAR_PART = 64
SKETCH = 256
#: Shingles of the largest set that, at similarity 0.8, a deeper level of LEVELS may miss with a chance above 1e-6 (12 shared of 15).
SMALL = 15
#: Subset keys that a worker holds at a time.
KEYS_OF_BATCH = 200_000
#: Edges, 16 bytes each, that one task joins at most.
EDGES_OF_TASK = 200_000
#: Most alike classes that a class is confirmed with before the exact step.
BEST = 2
#: Ids that are broadcast at most, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGES = (np.arange(SKETCH, dtype=np.uint64) << np.uint64(56)).astype(np.uint64)


def _tree_seeds(trees: int, level: int) -> np.ndarray:
    return mix64(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level))


def path_keys(tokens: np.ndarray, level: int, trees: int) -> np.ndarray:
    """One node key for each tree: the hash of the level smallest tokens under the tree's order."""
    seeds = _tree_seeds(trees, level)
    keys = np.empty(trees, np.uint64)
    step = max(1, (1 << 17) // max(1, len(tokens)))
    for a in range(0, trees, step):
        h = mix64(tokens[None, :] ^ seeds[a : a + step, None])
        low = np.sort(np.partition(h, level - 1, axis=1)[:, :level] if h.shape[1] > level else h, axis=1)
        key = seeds[a : a + step].copy()
        for k in range(low.shape[1]):
            key = mix64(key ^ low[:, k]) + np.uint64(k)
        keys[a : a + step] = key
    return keys


def sketch(tokens: np.ndarray) -> bytes:
    """A byte for each of 256 bins of the hash range: of the smallest member's hash, 0 if none."""
    at = np.searchsorted(tokens, _EDGES)
    to = np.append(at[1:], len(tokens))
    out = np.zeros(SKETCH, np.uint8)
    full = to > at
    out[full] = (mix64(tokens[at[full]]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def class_id(tokens: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return int(mix64(np.array([np.sum(mix64(tokens + np.uint64(len(tokens))), dtype=np.uint64)]))[0].astype(np.int64))


def signatures(docs: DataFrame, width: int, level: int, trees: int, id_col: str = "doc_id", text_col: str = "text", sketches: bool = True) -> DataFrame:
    """(doc_id, n_shingles, cid, paths, sketch) of every row; cid is null without shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, offs, raw in text_slices(b.column(0), b.column(1)):
                words, at = word_hashes(offs, raw)
                n, cid, paths, sk = [], [], [], []
                for a, z in zip(at[:-1], at[1:], strict=True):
                    s = shingle_set(words[a:z], width)
                    n.append(len(s))
                    cid.append(class_id(s) if len(s) else None)
                    paths.append(path_keys(s, level, trees).view(np.int64) if len(s) else np.zeros(0, np.int64))
                    sk.append(sketch(s) if sketches else b"")
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "cid", "paths", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, cid bigint, paths array<bigint>, sketch binary")


def small_or_shuffled(ids: DataFrame) -> DataFrame:
    """Marks ids for a broadcast if a count shows that they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def word_shingles(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The set of a text as words, not hashes."""
    w = _WORD.findall(text.encode().lower())
    return set(zip(*(w[k:] for k in range(min(width, len(w)))), strict=False)) if w else set()


def numbered_shingles(texts: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """The sets of some texts, a number for each distinct shingle of words."""
    number: dict[bytes, int] = {}
    rows = []
    for text in texts:
        w = [number.setdefault(x, len(number) + 1) for x in _WORD.findall(text.as_py().encode().lower())]
        rows.append(np.array(w + [0] * (width - len(w)) if w else [], np.int64))  # 0 is no word
    n = [max(0, len(r) - width + 1) for r in rows]
    if not sum(n):
        return [np.zeros(0, np.int64) for _ in rows]
    windows = [np.concatenate([r[k : k + m] for r, m in zip(rows, n, strict=True)]) for k in range(width)]
    ids = windows[0]
    for k in range(1, width):  # pairs of numbers below 2**31 fit a number each
        ids = np.unique(ids << 32 | windows[k], return_inverse=True)[1]
    return [np.unique(x) for x in np.split(ids, np.cumsum(n)[:-1])]


def _own(width: int, schema: str, at: int):
    """Of rows with a class, cid, and at column at a text, those whose text has that set, as rows that repeat a doc_id may hold another."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cids = 0, b.column(b.schema.get_field_index("cid"))
            for _, offs, raw in text_slices(cids, b.column(at)):
                words, starts = word_hashes(offs, raw)
                sets = [shingle_set(words[x:y], width) for x, y in zip(starts[:-1], starts[1:], strict=True)]
                keep = [len(t) > 0 and class_id(t) == c.as_py() for t, c in zip(sets, cids.slice(row, len(sets)), strict=True)]
                yield b.slice(row, len(sets)).filter(pa.array(keep, pa.bool_()))
                row += len(sets)

    return run, schema


def texts_of(docs: DataFrame, ids: DataFrame, n: int, width: int) -> DataFrame:
    """(cid, text) of the classes (cid, rep), of which there are n at most; rows that repeat a document repeat."""
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return docs.join(ids, docs["doc_id"] == ids["rep"]).select("cid", "text").mapInArrow(*_own(width, "cid bigint, text string", 1))


def confirm(pairs: DataFrame, n: int, classes: DataFrame, docs: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """Those of the n distinct pairs (a, b) of classes that are similar on their full sets of words; written. The classes paired
    with one a are dealt in parts of STAR_PART, each with a's text."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_PART).alias("parts")).filter("parts > 1")
    hot = materialize(hot, f"{label}-hot", n)
    dealt = pairs.join(small_or_shuffled(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    need = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("cid")).union(dealt.select("a", "part", F.lit(0), F.col("a").alias("cid")).distinct())
    need = need.join(classes.select("cid", "rep"), "cid")
    need = F.broadcast(need) if 2 * n <= BROADCAST_IDS else need
    rows = docs.join(need, docs["doc_id"] == need["rep"]).select("a", "part", "role", "cid", "text")
    rows = rows.mapInArrow(*_own(width, "a bigint, part bigint, role int, cid bigint, text string", 4))

    @tidy
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, set()
        for b in batches:
            out = []
            for a, part, role, cid, text in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), strict=True):
                text = text.as_py()
                if role == 0:
                    if at != (a, part):
                        at, first = (a, part), word_shingles(text, width)
                    continue
                mine = word_shingles(text, width)
                both = len(first & mine) if at == (a, part) else 0
                if both and 100 * both >= percent * (len(first) + len(mine) - both):
                    out.append((a, cid))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    joined = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return materialize(joined.mapInArrow(test, "a bigint, b bigint"), f"{label}-links")


def common_slack(percent: int, common: int) -> int:
    """How many tokens two linked sets may have, together, beyond so many that they share."""
    return common * (100 - percent) // percent


@cache
def _left_out(n: int, d: int) -> np.ndarray:
    """All choices of d of n members, a row each."""
    return np.array(list(combinations(range(n), d)), np.int64)


def subset_keys(tokens: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(d, class_id of each subset without d tokens) for every d that a link of the set to another allows."""
    n = len(tokens)
    for d in range(n):
        if d > common_slack(percent, n - d):
            break
        h = mix64(tokens + np.uint64(n - d))
        yield d, mix64(np.sum(h, dtype=np.uint64) - h[_left_out(n, d)].sum(axis=1, dtype=np.uint64)).view(np.int64)


def small_links(sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Links (a, b) that join the components of small sets (cid, tokens) exactly; written. Linked sets meet at what they share, c tokens,
    as c with d and e more, d + e <= common_slack(c). Where d is the least at c, each other linked with any there
    is linked with that one too, so a star holds all of c's components."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "cid", "d", "slack"]

        def out(rows: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
            reps = [len(r[0]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows])), *(pa.array(np.repeat(np.array([r[k] for r in rows], np.int64), reps)) for k in (1, 2, 3))], names)

        rows, held = [], 0
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                for d, keys in subset_keys(tokens, percent):
                    rows.append((keys, c, d, common_slack(percent, len(tokens) - d)))
                    held += len(keys)
                if held >= KEYS_OF_BATCH:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    keys = materialize(sets.select("cid", "tokens").mapInArrow(run, "key bigint, cid bigint, d bigint, slack bigint"), f"{label}-keys")
    heads = keys.groupBy("key").agg(F.min(F.struct("d", "cid")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    heads = materialize(heads.select("key", F.col("head.cid").alias("a"), F.col("head.d").alias("e")), f"{label}-heads")
    links = keys.join(heads, "key").filter("cid <> a and d + e <= slack")
    return materialize(links.select("a", F.col("cid").alias("b")).distinct(), f"{label}-links")


@tidy
def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, comp) of all edges (hi, lo) in one task."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
    every = [(c, forest.find(c)) for c in list(forest.root)]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, r in every if c != r], pa.int64()), pa.array([r for c, r in every if c != r], pa.int64())], ["cid", "comp"])


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(cid, comp): for each node of the edges (a, b) that reaches a smaller one, the smallest. Up to EDGES_OF_TASK edges
    are joined in one task; more by large-star and small-star steps, alternating until nothing changes."""
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    e = materialize(e, label)
    n, before = e.count(), None
    if n <= EDGES_OF_TASK:
        return materialize(e.coalesce(1).mapInArrow(_join_all, "cid bigint, comp bigint"), label, n)
    while True:
        both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        m = materialize(m, label, 2 * n)  # plain tables on both sides, so that a hub's rows can be split
        large = materialize(both.join(m, "u").filter("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), label, 2 * n)
        m = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), label, 2 * n)
        small = large.join(m, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = materialize(small.union(m.toDF("hi", "lo")).distinct(), label, 2 * n)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("hi").alias("cid"), F.col("lo").alias("comp"))
        before = now


def _labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("cid"))
    return members.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _by_part(schema: pa.Schema, handle):
    """Calls handle for each node part of sorted rows; it returns lists of columns."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            key, part = t["key"].to_numpy(), t["part"].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1), len(key)]
            got = [handle(t.slice(a, z - a)) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z - a > 1]
            cols = [np.concatenate([g[k] for g in got]) if got else [] for k in range(len(schema))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
            if held and (held[0].column("key")[0].as_py(), held[0].column("part")[0].as_py()) != (key[0], part[0]):
                yield flush(pa.Table.from_batches(held))
                held = []
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))  # the last part may go on in the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _columns(t: pa.Table) -> list[np.ndarray]:
    return [t[c].to_numpy() for c in ("cid", "comp", "n_shingles", "role")]


def _possible(percent: int, t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, other rows, their estimated similarity) where sketches leave a link between components possible."""
    j = percent / 100
    cid, comp, n, role = _columns(t)
    sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
    has = sk > 0
    for i in np.flatnonzero(role == 0):
        other = np.flatnonzero((comp != comp[i]) & (n * j <= n[i]) & (n[i] * j <= n))
        if len(other):
            either = np.count_nonzero(has[other] | has[i], axis=1)
            same = np.count_nonzero((sk[other] == sk[i]) & has[i], axis=1)
            ok = same >= either * j - 5 * np.sqrt(either * j * (1 - j))
            if ok.any():
                yield i, other[ok], same[ok] / either[ok]


#: What a part's comparison returns: kind 0 is the most alike (cid, other) of another component, kind 1 a class with a possible link to one.
FOUND = "kind int, key bigint, part bigint, cid bigint, comp bigint, role int, other bigint, alike double"


def _compare(percent: int):
    """Rows of FOUND of a part."""

    def handle(t: pa.Table):
        cid, comp, _, role = _columns(t)
        some: set[int] = set()
        mine, best, alike = [], [], []
        for i, other, est in _possible(percent, t):
            k = int(np.lexsort((cid[other], -est))[0])
            mine.append(i)
            best.append(cid[other[k]])
            alike.append(est[k])
            some.update((i, *other.tolist()))
        at = np.array(mine + sorted(some), np.int64)
        kind = np.repeat([0, 1], [len(mine), len(some)])
        fill = [0] * len(some)
        key, part = (np.full(len(at), t[c][0].as_py()) for c in ("key", "part"))
        return [kind, key, part, cid[at], comp[at], role[at], np.array(best + fill, np.int64), np.array(alike + fill, float)]

    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return _by_part(pa.schema([(c.split()[0], types[c.split()[1]]) for c in FOUND.split(", ")]), handle)


class Forest:
    """Disjoint sets."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, c: int) -> int:
        root = self.root
        while (up := root.setdefault(c, c)) != c:
            root[c] = root[up]
            c = up
        return c

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def _spanning(percent: int):
    """(a, b): pairs that sketches call similar, the most alike first, as many as would join a part's components."""

    def handle(t: pa.Table):
        cid, comp, _, role = _columns(t)
        a, b, est = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, other, alike in _possible(percent, t):
            ok = ((other > i) | (role[other] == 1)) & (alike >= percent / 100)
            a.append(np.full(int(ok.sum()), i))
            b.append(other[ok])
            est.append(alike[ok])
        a, b, est = (np.concatenate(x) for x in (a, b, est))
        forest, out = Forest(), []
        for k in np.lexsort((b, a, -est)).tolist():
            if forest.join(int(comp[a[k]]), int(comp[b[k]])):
                out.append(sorted((int(cid[a[k]]), int(cid[b[k]]))))
        return [np.array([x[k] for x in out], np.int64) for k in (0, 1)]

    return _by_part(pa.schema([("a", pa.int64()), ("b", pa.int64())]), handle)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, by products of slices of the member matrix."""
    r = len(sets)
    every, row = np.concatenate(sets), np.repeat(np.arange(r), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else new
    col, row = col[shared], row[shared]
    col = np.cumsum(np.concatenate([[0], np.diff(col) != 0])) if len(col) else col
    out = np.zeros((r, r), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        lo, hi = np.searchsorted(col, (a, a + 4096))
        m = np.zeros((r, 4096), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _exact(percent: int, width: int):
    """(a, b): links of a part on its words, as many as join its components."""

    def handle(t: pa.Table):
        cid, comp, role = (t[c].to_numpy() for c in ("cid", "comp", "role"))
        sets = numbered_shingles(t["text"], width)
        n = np.array([len(x) for x in sets])
        both = common_counts(sets)
        ok = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :]) & ((role[:, None] == 0) | (role[None, :] == 0))
        forest, out = Forest(), []
        for i, k in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
            if forest.join(int(comp[i]), int(comp[k])):
                out.append((min(cid[i], cid[k]), max(cid[i], cid[k])))
        return [np.array([x[k] for x in out], np.int64) for k in (0, 1)]

    return _by_part(pa.schema([("a", pa.int64()), ("b", pa.int64())]), handle)


def _members(classes: DataFrame, label: str) -> tuple[DataFrame, int]:
    """(key, cid, pivot) of all nodes with two classes or more, and how many rows; pivot is the smallest class."""
    nodes = classes.select("cid", F.explode("paths").alias("key"))
    multi = materialize(nodes.groupBy("key").agg(F.min("cid").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), f"{label}-nodes")
    n = multi.agg(F.sum("n")).first()[0] or 0
    return materialize(nodes.join(multi.select("key", "pivot"), "key"), f"{label}-members", n), n


_PART = ("key", "part", "role", "cid", "comp")


def _one_of(n: Column, size: int, of: str = "cid") -> Column:
    """The block of a row, where n rows make blocks of about size."""
    return F.pmod(F.xxhash64(of), F.ceil(n / size)).cast("long")


def _blocks(rows: DataFrame, crowded: DataFrame, turn: int) -> DataFrame:
    """The classes of crowded nodes, each in one block of NODE_MAX of the biggest such node."""
    rows = rows.join(crowded, "key").select("cid", "comp", F.struct("n", "key", "giant").alias("node"))
    rows = rows.groupBy("cid", "comp").agg(F.max("node").alias("node"))
    part = F.pmod(F.xxhash64("cid", F.lit(turn)), F.ceil(F.col("node.n") / NODE_MAX)).cast("long")
    return rows.select(F.col("node.key").alias("key"), part.alias("part"), F.when(F.col("comp") == F.col("node.giant"), 1).otherwise(0).alias("role"), "cid", "comp")


def _parts(rows: DataFrame, mixed: DataFrame, last: bool) -> DataFrame:
    """The parts of nodes: a small node whole; of a big one what is outside its largest component, in one part or a grid of
    blocks. Classes with role 0 are compared with all of their part, those with role 1 with
    role 0 only."""
    rows = rows.join(mixed, "key")
    outside = F.col("comp") != F.col("giant")
    role = F.when(outside, 0).otherwise(1)
    zero = F.lit(0).cast("long")
    rows = rows.filter((F.col("n") <= NODE_MAX) | outside)
    outs = F.col("n") - F.col("largest")
    few = rows.filter((F.col("n") <= NODE_MAX) | (outs <= NODE_MAX)).select("key", zero.alias("part"), role.alias("role"), "cid", "comp")
    rows = rows.filter((F.col("n") > NODE_MAX) & (outs > NODE_MAX) & (F.lit(last) | (outs <= GRID_NODES * NODE_MAX)))
    blocks = F.ceil((F.col("n") - F.col("largest")) / GRID)
    mine = _one_of(F.col("n") - F.col("largest"), GRID)

    def pair(k: Column) -> Column:
        return F.struct((F.least(k, mine) * blocks + F.greatest(k, mine)).alias("part"), F.when(k >= mine, 0).otherwise(1).alias("role"))

    grid = rows.select("key", "cid", "comp", F.explode(F.transform(F.sequence(zero, blocks - 1), pair)).alias("p"))
    return few.union(grid.select("key", "p.part", "p.role", "cid", "comp"))


def _against(rows: DataFrame, big: DataFrame, comps: DataFrame | None, bound: int) -> DataFrame:
    """Parts of the largest components of big nodes with what stands outside in any of them: a grid of blocks of both."""
    out = rows.join(big.select("key", "giant"), "key").filter("comp <> giant").select("giant", "cid", "comp").distinct()
    out = materialize(out, "neardup-out", bound)
    n_out = out.groupBy("giant").agg(F.count("*").alias("n_out"))
    all_ = n_out.select("giant", F.col("giant").alias("cid"))  # the component's name is its least class
    if comps is not None:
        all_ = all_.union(comps.join(n_out.select(F.col("giant").alias("comp")), "comp", "left_semi").select("comp", "cid"))
    all_ = materialize(all_.distinct(), "neardup-giants", bound)
    sizes = n_out.join(all_.groupBy("giant").agg(F.count("*").alias("n_in")), "giant")
    n_in, n_out = F.col("n_in"), F.col("n_out")
    zero = F.lit(0).cast("long")
    key = F.xxhash64(F.lit("component"), F.col("giant")).alias("key")
    inside = all_.join(sizes, "giant").withColumn("block", _one_of(n_in, GRID)).withColumn("other", F.explode(F.sequence(zero, F.ceil(n_out / GRID) - 1)))
    inside = inside.select(key, (F.col("block") * F.ceil(n_out / GRID) + F.col("other")).alias("part"), F.lit(1).alias("role"), "cid", F.col("giant").alias("comp"))
    outside = out.join(sizes, "giant").withColumn("block", _one_of(n_out, GRID)).withColumn("other", F.explode(F.sequence(zero, F.ceil(n_in / GRID) - 1)))
    return inside.union(outside.select(key, (F.col("other") * F.ceil(n_out / GRID) + F.col("block")).alias("part"), F.lit(0).alias("role"), "cid", "comp"))


def _sorted(parts: DataFrame) -> DataFrame:
    return parts.repartition("key", "part").sortWithinPartitions("key", "part")


def _tokens(texts: DataFrame, width: int) -> DataFrame:
    """(cid, tokens) of texts, the sorted shingle hashes as bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, offs, raw in text_slices(b.column(0), b.column(1)):
                words, at = word_hashes(offs, raw)
                yield pa.RecordBatch.from_arrays([ids, pa.array([shingle_set(words[x:y], width).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["cid", "tokens"])

    return texts.mapInArrow(run, "cid bigint, tokens binary")


def _mixed(members: DataFrame, n: int, comps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, cid, comp) of the nodes, and (key, n, largest, giant) of those with more than one component."""
    rows = materialize(_labelled(members.select("key", "cid"), comps), "neardup-rows", n)
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    return rows, materialize(mixed.select("key", "n", F.col("top.c").alias("largest"), F.col("top.comp").alias("giant")), "neardup-mixed", n)


def _merged(comps: DataFrame | None, links: DataFrame, bound: int) -> DataFrame | None:
    """Components with the links (a, b) of classes added; at most bound classes."""
    n = links.count()
    if not n:
        return comps
    if comps is None:
        return connected(links, "neardup-merge")
    if n + comps.count() <= EDGES_OF_TASK:
        both = links.select("a", "b").union(comps.select("cid", "comp"))
        return materialize(both.coalesce(1).mapInArrow(_join_all, "cid bigint, comp bigint"), "neardup-comps", bound)
    named = _labelled(_labelled(links.withColumnRenamed("a", "cid"), comps).select(F.col("comp").alias("ca"), F.col("b").alias("cid")), comps)
    merged = connected(named.select(F.col("ca").alias("a"), F.col("comp").alias("b")), "neardup-merge")
    over = merged.select(F.col("cid").alias("comp"), F.col("comp").alias("root"))
    old = comps.join(over, "comp", "left").select("cid", F.coalesce("root", "comp").alias("comp"))
    return materialize(old.union(merged.join(comps.select("cid"), "cid", "left_anti")), "neardup-comps", bound)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row. Links are pairs with
    100 * intersection >= percent * union; percent is at least 50."""
    return _found(docs, width, percent, id_col, text_col, levels).drop("cid")


def _found(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text", levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """The rows of near_duplicates, with cid."""
    with scratch_scope(docs.sparkSession, "neardup-sigs", "neardup-names"):
        return _joined(docs, width, percent, id_col, text_col, levels)


def _joined(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level, trees = levels[0]
    sigs = materialize(signatures(docs, width, level, trees), "neardup-sigs")
    classes = materialize(
        sigs.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")),
        "neardup-classes",
    )
    members, n_members = _members(classes, "neardup")
    # stars: each class with the pivot that it meets in most trees
    met = members.filter("cid <> pivot").groupBy("cid", "pivot").agg(F.count("*").alias("met")).filter(F.col("met") >= max(2, trees // 6))
    best = met.groupBy("cid").agg(F.max(F.struct("met", (-F.col("pivot")).alias("less"), "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("cid").alias("b"))
    best = materialize(best, "neardup-stars", n_members)
    comps = None
    if n_best := best.count():
        stars = confirm(best, n_best, classes, docs, width, percent, "neardup-star")
        comps = None if stars.isEmpty() else connected(stars, "neardup-roots")
    bound = 2 * n_best
    sketches = classes.select("cid", "n_shingles", "sketch")

    def compared(parts: DataFrame) -> DataFrame:
        """What the parts' sketches say, after each class was confirmed with the most alike ones."""
        nonlocal comps, bound
        found = materialize(_sorted(parts.join(sketches, "cid")).mapInArrow(_compare(percent), FOUND), "neardup-found")
        near = found.filter("kind = 0").groupBy("cid", "other").agg(F.max("alike").alias("alike"))
        near = near.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("alike", "other")), False), 1, BEST).alias("best"))  # at most one for each of the class's parts
        near = near.select("cid", F.explode("best.other").alias("other")).select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
        near = materialize(near, "neardup-near", n_members)
        if n_near := near.count():
            bound += 2 * n_near
            comps = _merged(comps, confirm(near, n_near, classes, docs, width, percent, "neardup-near"), bound)
        return found.filter("kind = 1").select(*_PART)

    for k in range(len(levels)):
        last = k == len(levels) - 1
        outs = F.col("n") - F.col("largest")
        big, many = F.col("n") > NODE_MAX, outs > GRID_NODES * NODE_MAX
        rows, mixed = _mixed(members, n_members, comps)
        crowded = big & (outs > NODE_MAX)
        for turn in range(ROUNDS if k == 0 else 0):
            if mixed.filter(crowded).isEmpty():
                break
            blocks = materialize(_blocks(rows, mixed.filter(crowded), turn), "neardup-blocks", n_members)
            near = _sorted(blocks.join(sketches, "cid")).mapInArrow(_spanning(percent), "a bigint, b bigint")
            near = materialize(near, "neardup-near", n_members)
            n_near = near.count()
            bound += 2 * n_near
            links = confirm(near, n_near, classes, docs, width, percent, "neardup-near")
            comps = _merged(comps, links, bound)
            rows, mixed = _mixed(members, n_members, comps)
            if links.count() < GAIN * blocks.count():
                break
        parts = _parts(rows, mixed, last)
        if not mixed.filter(big).isEmpty():
            parts = parts.union(_against(rows, mixed.filter(big), comps, n_members))
        some = compared(parts)
        # exactly what is left: parts that still have classes of more than one component
        some = _labelled(some.drop("comp"), comps)
        left = some.groupBy("key", "part").agg((F.min("comp") < F.max("comp")).alias("open")).filter("open").select("key", "part")
        some = materialize(some.join(left, ["key", "part"], "left_semi"), "neardup-involved")
        if n_some := some.count():
            ids = some.select("cid").distinct().join(classes.select("cid", "rep"), "cid")
            words = texts_of(docs, ids, n_some, width).dropDuplicates(["cid"])
            links = _sorted(some.join(words, "cid")).mapInArrow(_exact(percent, width), "a bigint, b bigint").distinct()
            bound += 2 * n_members
            comps = _merged(comps, materialize(links, "neardup-links", n_members), bound)
        deferred = mixed.filter(big & many)
        if last or deferred.isEmpty():
            break
        deep = rows.join(deferred.select("key", "giant"), "key").filter("comp <> giant").select("cid").distinct()
        deep = materialize(deep.join(classes.select("cid", "rep", "n_shingles"), "cid"), "neardup-deep", n_members)
        if k == 0:  # what is deferred later was deferred here
            few = materialize(deep.filter(F.col("n_shingles") <= SMALL).select("cid", "rep"), "neardup-few", n_members)
            if n_few := few.count():
                bound += 2 * n_few
                comps = _merged(comps, small_links(_tokens(texts_of(docs, few, n_few, width), width).dropDuplicates(["cid"]), percent, "neardup-few"), bound)
        level, trees = levels[k + 1]
        sub = docs.join(small_or_shuffled(deep.select(F.col("rep").alias("doc_id")).distinct()), "doc_id")
        paths = signatures(sub, width, level, trees, sketches=False).filter("cid is not null").select("cid", "paths").dropDuplicates(["cid"])
        members, n_members = _members(paths.join(deep.select("cid"), "cid", "left_semi"), "neardup-deeper")
    # every class of a component of two documents or more gets the smallest doc_id
    if comps is None:
        comps = classes.select("cid", F.col("cid").alias("comp")).limit(0)
    n_linked = 2 * comps.count()
    named = materialize(comps.union(comps.select(F.col("comp").alias("cid"), "comp")).distinct().join(classes.select("cid", "rep"), "cid"), "neardup-named", n_linked)
    least = materialize(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "neardup-least", n_linked)
    linked = named.join(least, "comp").select("cid", "component_id")
    single = classes.select("cid", "rep").join(sigs.groupBy("cid").agg(F.count("*").alias("c")).filter("c > 1"), "cid", "left_semi").join(named.select("cid"), "cid", "left_anti").toDF("cid", "component_id")
    names = materialize(linked.union(single), "neardup-names")
    out = sigs.select("doc_id", "n_shingles", "cid").join(names, "cid", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "cid")


def _with_class(docs: DataFrame, width: int, name: str) -> DataFrame:
    """docs with the class of each row's text."""
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids = []
            for _, offs, raw in text_slices(b.column(at), b.column(at)):
                words, starts = word_hashes(offs, raw)
                sets = [shingle_set(words[x:y], width) for x, y in zip(starts[:-1], starts[1:], strict=True)]
                cids += [class_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cids, pa.int64())], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; all columns stay, whatever their names."""
    cid = unused(docs, "__cid")
    found = _found(docs, width, percent)
    gone = materialize(found.filter("not kept").select("doc_id", F.col("cid").alias(cid)).distinct(), "neardup-gone")
    ids = materialize(gone.select("doc_id").distinct(), "neardup-gone-ids")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(small_or_shuffled(ids), "doc_id", "left_anti").select(*columns)
    # ids that repeat with another text that stays
    both = materialize(found.filter("kept").select("doc_id").join(small_or_shuffled(ids), "doc_id", "left_semi").distinct(), "neardup-both")
    if both.isEmpty():
        return kept
    rows = _with_class(docs.join(small_or_shuffled(both), "doc_id", "left_semi").select(*columns), width, cid)
    return kept.union(rows.join(small_or_shuffled(gone), ["doc_id", cid], "left_anti").select(*columns))


#: The rows of near_duplicates(documents, width=4).
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT p.y, reach.c FROM reach JOIN p ON p.x = reach.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
