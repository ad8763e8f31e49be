"""One file parsed by many tasks, with the rows that one task would give.

1. ``read_chunks``: Spark reads the lines of a file's splits; they are put together to chunks of some MB.
2. ``cut``: each chunk is scanned once, wherever it lies, into a map from the states that it may begin in to those that it ends in (see
   ``sources.chunks``). The maps of a file, a few hundred bytes each, are composed in order, and a state that a map does not hold is
   followed in another round over that chunk alone. Of more than ``RUN`` chunks, runs of that many are composed to one map each, then the runs, and then
   the chunks of each run from the state that it begins in, so that no task holds more than a run or a row for each run. Then each chunk is cut at the first entry that begins a line in it; what stands before goes to the
   part that the entry before it began in.
3. The parts are parsed in parallel; numbers of entries, diagnostics and tokens count on over the parts of a file.

A part is as long as a chunk and the entries that cross its end; an entry, however long, is one row of one task. Files in the second
dialect, without paragraph breaks in strings, or with positions of output in messages are read whole (``bibliography.entries``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.checking import Checker
from scholia.operators import bibliography as B
from scholia.operators import rules, scratch
from scholia.options import Options
from scholia.sources import chunks as K
from scholia.sources.bibtext import Parser

CHUNK_BYTES = 4 << 20
#: Chunks whose places are broadcast; beyond, they are joined by shuffle.
BROADCAST_CHUNKS = 200_000
#: The part before the first cut.
START = -1
#: Chunks of a run, whose maps are composed in one task, about.
RUN = 2000
#: Maps of a batch.
BATCH_MAPS = 500
#: Depths of a braced string at the start of a run that its map holds in any case.
RUN_DEPTHS = 8


def read_chunks(spark: SparkSession, paths: list[str] | str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file, ord, text, size) of files in any file system that Spark reads: stretches of whole lines, ordered by ord, and the file's size.
    A character is a byte."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0  # (file, block, size) and what is held of it
        done = 0  # bytes of the block in earlier chunks

        def chunk() -> pa.RecordBatch:
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, sum(map(len, held))], pa.int32()), pa.concat_arrays(held)), b"\n")
            text = joined[0].as_py() + b"\n"
            return pa.RecordBatch.from_pydict({"file": [at[0]], "ord": [at[1] + done], "text": [text.decode("latin-1")], "size": [at[2]]})

        for b in batches:
            files, blocks = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            names, codes = files.dictionary.to_pylist(), files.indices.to_numpy()
            lengths = pc.binary_length(b.column(3)).to_numpy() + 1
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(codes)], strict=True):
                if start == end:
                    continue
                here = (names[codes[start]], int(blocks[start]), b.column(2)[start].as_py())
                if here != at:
                    if held:
                        yield chunk()
                    at, held, size, done = here, [], 0, 0
                total = np.cumsum(lengths[start:end])
                k = 0
                while k < end - start:
                    before = int(total[k - 1]) if k else 0
                    to = int(np.searchsorted(total, before + max(1, chunk_bytes - size))) + 1
                    to = min(to, end - start)
                    held.append(b.column(3).slice(start + k, to - k))
                    size += int(total[to - 1]) - before
                    k = to
                    if size >= chunk_bytes:
                        yield chunk()
                        held, done, size = [], done + size, 0
        if held:
            yield chunk()

    plain = lambda path: F.regexp_replace(path, "^file:/+", "/")
    rows = lines.select(*meta, F.col("value").cast("binary").alias("value")).mapInArrow(gather, "file string, ord bigint, text string, size bigint")
    rows = rows.withColumn("file", plain(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))))
    empty = spark.read.format("binaryFile").load(paths).where("length = 0").select(plain(F.col("path")).alias("file"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("text"), F.lit(0).cast("long").alias("size"))
    return rows.unionByName(empty)


def _dump(ways: dict[K.State, K.Way]) -> str:
    return json.dumps([[*s, w.cut, *w.state] for s, w in ways.items()])


def _load(text: str) -> dict[K.State, K.Way]:
    return {K.State(*r[:3]): K.Way(r[3], K.State(*r[4:])) for r in json.loads(text)}


_MAP = "file string, ord bigint, n_bytes bigint, n_lines bigint, size bigint, most bigint, rise bigint, ways string"


def _map_row(file: str, place: int, text: str, size: int | None) -> dict:
    ways, most, rise = K.Chunk(text).ways()
    return {"file": file, "ord": place, "n_bytes": len(text), "n_lines": text.count("\n"), "size": size, "most": most, "rise": rise, "ways": _dump(ways)}


def _mapped(rows: DataFrame, make) -> DataFrame:
    """A row of a map for each row, some hundred in a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(_MAP))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for scalars in zip(*b.columns, strict=True):
                held.append(make(*(x.as_py() for x in scalars)))
                if len(held) >= BATCH_MAPS:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return rows.mapInArrow(scan, _MAP)


def chunk_maps(chunks: DataFrame) -> DataFrame:
    """A row for each chunk: its map, its lines and bytes."""
    return _mapped(chunks.select("file", "ord", "text", "size"), _map_row)


def _enter(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ways of states that maps do not hold, as further rows of maps."""

    def enter(file: str, place: int, text: str, state: str) -> dict:
        s = K.State(*json.loads(state))
        return {"file": file, "ord": place, "n_bytes": 0, "n_lines": 0, "size": None, "most": 0, "rise": 0, "ways": _dump({s: K.Chunk(text).enter(s)})}

    return _mapped(chunks.join(F.broadcast(wanted.select("file", "ord", "missing")), ["file", "ord"]).select("file", "ord", "text", "missing"), enter)


_PLACE = "file string, ord bigint, cut bigint, part bigint, line bigint, last boolean, phantom boolean, missing string"


def _in_order(maps: pd.DataFrame) -> Iterator[tuple]:
    """The chunks of a map's rows in order: the row of the chunk itself, and its ways, of all rows."""
    rows = sorted(maps.itertuples(index=False), key=lambda r: (r.ord, -r.n_bytes, r.size != r.size))
    for _, same in groupby(rows, key=lambda r: r.ord):
        same = list(same)
        yield max(same, key=lambda r: len(r.ways)), {k: v for r in same for k, v in _load(r.ways).items()}


def _compose(maps: pd.DataFrame, state: K.State = K.SEEK, part: int = START, line: int = 1) -> pd.DataFrame:
    """The maps of one file, or of one run from its first state on, in order: where each chunk is cut, which part its head belongs to, and the line
    that it begins with."""
    out, known = [], True
    total = int(maps["n_bytes"].sum())
    for first, ways in _in_order(maps):
        way = K.look_up(ways, first.most, first.rise, state) if known else None
        missing = json.dumps(state) if known and way is None else None
        known = way is not None
        cut = way.cut if way else -1
        out.append([first.file, first.ord, cut, part, line, False, False, missing])
        if way:
            state, part = way.state, first.ord if way.cut >= 0 else part
        line += first.n_lines
    sizes = maps["size"].dropna()
    out[-1][6] = bool(len(sizes)) and total == int(sizes.iloc[0]) + 1  # the last line had no end
    for row in out:  # the last part, in whichever chunks it lies
        row[5] = part == (row[1] if row[2] >= 0 else row[3])
    return pd.DataFrame(out, columns=["file", "ord", "cut", "part", "line", "last", "phantom", "missing"])


def _compose_file(maps: pd.DataFrame) -> pd.DataFrame:
    return _compose(maps)


# runs of chunks


def in_runs(maps: DataFrame, n: int) -> DataFrame:
    """n maps with the number of their run: stretches of a file's successive chunks."""
    return maps.repartitionByRange(-(-n // RUN), "file", "ord").withColumn("run", F.spark_partition_id())


_RUN_MAP = "file string, run int, n_bytes bigint, n_lines bigint, size bigint, most bigint, rise bigint, ways string"


def _run_map(maps: pd.DataFrame) -> pd.DataFrame:
    """The maps of a run as one: for each state that it may begin in, or that is asked for, the last chunk that is cut by its way, or -1, the state at
    the end, and the chunk that does not hold the state, if there is one (then the state is that one)."""
    ask = maps["ask"].iloc[0]
    ways, now, most, rise, n_lines = [], None, 0, 0, 0
    for first, here in _in_order(maps):
        if now is None:
            begin = [K.State(*json.loads(ask))] if isinstance(ask, str) else {**here, **{K.State("braced", kind, k): None for kind in K.KINDS for k in range(1, RUN_DEPTHS + 1)}}
            now = {(s, -1): [s] for s in begin}
        after: dict[tuple, list] = {}
        for (state, part), begun in now.items():
            way = K.look_up(here, first.most, first.rise, state)
            if way is None:
                ways += [[*s, part, first.ord, *state] for s in begun]
            else:
                after.setdefault((way.state, first.ord if way.cut >= 0 else part), []).extend(begun)
        now = after
        most, rise, n_lines = max(most, first.most - rise), rise + first.rise, n_lines + first.n_lines
    ways += [[*s, part, None, *state] for (state, part), begun in now.items() for s in begun]
    sizes = maps["size"].dropna()
    row = [maps["file"].iloc[0], maps["run"].iloc[0], maps["n_bytes"].sum(), n_lines, sizes.iloc[0] if len(sizes) else None, most, rise, json.dumps(ways)]
    return pd.DataFrame([row], columns=[c.split()[0] for c in _RUN_MAP.split(", ")])


def _run_maps(maps: DataFrame) -> DataFrame:
    return scratch.write(maps.groupBy("file", "run").applyInPandas(_run_map, _RUN_MAP), "run-maps")


_BEGUN = "file string, run int, state string, begun bigint, from_line bigint, end bigint, unended boolean, known boolean, ord bigint, missing string"


def _compose_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """The runs of one file in order: the state, part and line that each begins with. Not known is the way through a run whose map lacks that state or in
    which a chunk's map lacks one; that chunk and state are named."""
    out, state, part, line, total, known = [], K.SEEK, START, 1, 0, True
    for number, same in groupby(sorted(runs.itertuples(index=False), key=lambda r: r.run), key=lambda r: r.run):
        same = list(same)
        first = same[0]
        ways: dict[K.State, list] = {}
        for r in same:  # a state that was asked for again has come further
            for w in json.loads(r.ways):
                s = K.State(*w[:3])
                if s not in ways or ways[s][1] is not None and (w[4] is None or w[4] > ways[s][1]):
                    ways[s] = w[3:]
        begun, from_line = (json.dumps(state), line) if known else (None, None)
        place = missing = None
        if known:
            way = ways.get(state)
            if way is None and state.mode == "braced" and state.depth > first.most:
                way = [-1, None, "braced", state.kind, state.depth + first.rise]
            here = part
            known = way is not None and way[1] is None
            if way is not None:
                if not known:
                    place, missing = way[1], json.dumps(way[2:])
                state, part = K.State(*way[2:]), way[0] if way[0] >= 0 else part
            out.append([first.file, number, begun, here, from_line, None, False, known, place, missing])
        line += first.n_lines
        total += first.n_bytes
    sizes = runs["size"].dropna()
    if known:
        out[-1][6] = bool(len(sizes)) and int(total) == int(sizes.iloc[0]) + 1
    for row in out:
        row[5] = part
    return pd.DataFrame(out, columns=[c.split()[0] for c in _BEGUN.split(", ")])


def _place_run(maps: pd.DataFrame) -> pd.DataFrame:
    """The chunks of a run from where it begins."""
    r = maps.iloc[0]
    out = _compose(maps, K.State(*json.loads(r["state"])), int(r["begun"]), int(r["from_line"]))
    out["last"] = out["ord"].where(out["cut"] >= 0, out["part"]) == int(r["end"])
    out["phantom"] = False
    out.loc[len(out) - 1, "phantom"] = bool(r["unended"])
    return out


def _places_of_runs(chunks: DataFrame, maps: DataFrame, n: int) -> DataFrame:
    maps = scratch.write(in_runs(maps, n), "chunk-runs")
    runs = _run_maps(maps.withColumn("ask", F.lit(None).cast("string")))
    while True:
        begun = scratch.write(runs.groupBy("file").applyInPandas(_compose_runs, _BEGUN), "runs-begun")
        lost = begun.where("not known")
        if lost.isEmpty():
            break
        gone = lost.where("missing is not null")
        if not gone.isEmpty():
            more = scratch.write(_enter(chunks, gone), "chunk-maps")
            maps = maps.unionByName(more.join(F.broadcast(gone.select("file", "ord", "run")), ["file", "ord"]))
        runs = runs.unionByName(_run_maps(maps.join(F.broadcast(lost.select("file", "run", F.col("state").alias("ask"))), ["file", "run"])))
    begun = begun.select("file", "run", "state", "begun", "from_line", "end", "unended")
    placed = maps.join(F.broadcast(begun), ["file", "run"]).groupBy("file", "run").applyInPandas(_place_run, _PLACE)
    return scratch.write(placed, "chunk-places")


def places(chunks: DataFrame) -> DataFrame:
    """A written row for each chunk, from as many rounds as its maps need."""
    maps = scratch.write(chunk_maps(chunks), "chunk-maps")
    n = maps.count()
    if n > RUN:
        return _places_of_runs(chunks, maps, n)
    while True:
        found = scratch.write(maps.groupBy("file").applyInPandas(_compose_file, _PLACE), "chunk-places")
        wanted = found.where("missing is not null")
        if wanted.isEmpty():
            return found
        maps = maps.unionByName(scratch.write(_enter(chunks, wanted), "chunk-maps"))


def cut(chunks: DataFrame) -> DataFrame:
    """(file, part, line, last, text): parts of files that begin with the file or with an entry at the start of a line."""
    where = places(chunks)
    small = where.count() <= BROADCAST_CHUNKS
    both = chunks.select("file", "ord", "text").join(F.broadcast(where) if small else where, ["file", "ord"])
    text = F.when(F.col("phantom"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    both = both.withColumn("text", text).withColumn("head", F.expr("if(cut < 0, text, substring(text, 1, cut))"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    none = F.lit(None).cast("long")
    head = F.struct(F.col("part").alias("part"), F.struct(F.col("ord"), none.alias("line"), F.col("head").alias("text")).alias("piece"), ((F.col("cut") < 0) & F.col("last")).alias("last"))
    tail = F.struct(F.col("ord").alias("part"), F.struct(F.col("ord"), (F.col("line") + lines(F.col("head"))).cast("long").alias("line"), F.expr("substring(text, cut + 1)").alias("text")).alias("piece"), F.col("last"))
    pieces = both.select("file", F.explode(F.when(F.col("cut") < 0, F.array(head)).otherwise(F.array(head, tail))).alias("p")).select("file", "p.*")
    parts = pieces.groupBy("file", "part").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.max("last").alias("last"))
    return parts.select("file", "part", F.coalesce(F.col("pieces")[0]["line"], F.lit(1)).alias("line"), "last", F.array_join(F.col("pieces.text"), "").alias("text"))


def _check(options: Options) -> Options:
    if options.scribe or not options.parbreaks or options.file_position:
        raise ValueError("files in this dialect, without paragraph breaks or with positions are not cut")
    return options


def _run(parts: DataFrame, options: Options, schema: str, rows, **config) -> DataFrame:
    """Rows of the parser for each part, with the part."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = f"part bigint, {schema}"
    arrow = to_arrow_schema(T._parse_datatype_string(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = Checker(config.get("patterns"), config.get("isbn_ranges"))

        def found() -> Iterator[tuple[int, list[dict]]]:
            for b in batches:
                for scalars in zip(*b.columns, strict=True):
                    file, part, line, last, text = (x.as_py() for x in scalars)
                    yield len(text), [{"part": part, **r} for r in rows(file, Parser(text, options, file, **config, first_line=line, more=not last, checker=checker).run())]

        yield from B.batches_of(found(), arrow)

    return parts.select("file", "part", "line", "last", "text").mapInArrow(run, columns)


def _numbered(rows: DataFrame, seq: str) -> DataFrame:
    """Rows of parts whose numbers count on from the parts before."""
    counts = rows.groupBy("file", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = rows.schema[seq].dataType
    return rows.join(counts.select("file", "part", before.alias("before")), ["file", "part"]).withColumn(seq, (F.col(seq) + F.col("before")).cast(kind)).drop("part", "before")


def entries(parts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """A row for each entry and each stretch of text between entries."""
    o = _check(options or Options())
    rows = scratch.write(_run(parts, o, B.ENTRIES, B._entry_rows, scan=True, **config), "entries")
    return rules.fix_entries(_numbered(rows, "entry_seq"), o, config.get("isbn_ranges")).select(*T._parse_datatype_string(B.ENTRIES).names)


def diagnostics(parts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    o = _check(options or Options())
    if not rules.by_columns(o):
        rows = _run(parts, o, B.DIAGNOSTICS, B._diagnostic_rows, **config)
    else:
        found = rules.check(_run(parts, o, rules.SEEN, rules.seen_rows, scan=True, **config), o, config.get("patterns"), config.get("isbn_ranges"), "part")
        rows = found.withColumn("diag_seq", (F.row_number().over(Window.partitionBy("file", "part").orderBy("tick", "place")) - 1).cast("long"))
    return _numbered(scratch.write(rows, "diagnostics"), "diag_seq").select(*T._parse_datatype_string(B.DIAGNOSTICS).names)


def tokens(parts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    rows = scratch.write(_run(parts, replace(_check(options or Options()), prettyprint=False), B.TOKENS, B._token_rows, **config), "tokens")
    return _numbered(rows, "tok_seq").select(*T._parse_datatype_string(B.TOKENS).names)


def prettyprint(parts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """(file, part, text): the standard layout of a file in pieces, which follow each other by part."""
    return _run(parts, _check(options or Options()), B.OUTPUT, lambda file, p: [{"file": file, "text": p.page.text()}], **config).select("file", "part", "text")

