"""Command line: python -m scholia [options] files. Without files, or for the name -, standard input is read. Cleaned
text goes to the output file or standard output, diagnostics to the error log or standard error; the exit code is 1 if there were errors.

Before the words are read, initialization, ISBN and keyword files are looked for in the folders of
SCHOLIA_SYSTEM_PATH, then of SCHOLIA_USER_PATH, unless -no-read-init-files is among the words."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from scholia import options as O
from scholia.operators import bibliography as B
from scholia.plans import pipeline
from scholia.sources import config as C

READERS = {"init-file": C.apply_init, "keyword-file": C.apply_keywords, "isbn-file": C.apply_isbn}
PRINTERS = {"print-keyword-table": C.keyword_lines, "print-patterns": C.pattern_lines, "print-isbn-table": C.isbn_lines}
#: Files that are read where they are found, and what reads them, in order.
DEFAULTS = (("scholia.ini", C.apply_init), ("scholia.isbn", C.apply_isbn), ("scholia.key", C.apply_keywords))
PATHS = ("SCHOLIA_SYSTEM_PATH", "SCHOLIA_USER_PATH")


def open_file(name: str, mode: str, trace: bool):
    """A file by its expanded name; with trace, every attempt is told on standard error."""
    failed = ": FAILED"
    try:
        f = open(C.expand_path(name), mode, encoding="latin-1")
        failed = ""
        return f
    finally:
        if trace:
            print(f"%% open file   [{name}]{failed}", file=sys.stderr)


def defaults(config: C.Config, trace: bool = False) -> C.Config:
    """config after the files found on the two paths."""
    for name, reader in DEFAULTS:
        for path in PATHS:
            found = C.find_file(os.environ[path], name) if os.environ.get(path) else None
            if found:
                with open_file(found, "r", trace) as f:
                    config = reader(config, f.read())
    return config


def main(words: list[str]) -> int:
    try:
        opts, outside, files = O.resolve(words)
    except O.UnknownOption as e:
        print(f"unknown option: {e}", file=sys.stderr)
        return 1
    trace = any(name == "trace-file-opening" for name, _ in outside)
    config = C.Config()
    if opts.read_init_files:
        config = defaults(config, trace)
    config.options = O.resolve(words, config.options)[0]
    where, printed = {"output-file": None, "error-log": None}, False
    for name, value in outside:
        if name in READERS:
            with open_file(value, "r", trace) as f:
                config = READERS[name](config, f.read())
        elif name in PRINTERS:
            print("\n".join(PRINTERS[name](config)))
            printed = True
        elif name in where:
            where[name] = value
    if not files and printed:
        return 0
    files = files or ["-"]
    read = sys.stdin.buffer.read().decode("latin-1") if "-" in files else ""
    spark = SparkSession.builder.appName("scholia").getOrCreate()
    result = pipeline.run(spark, files, config, read)
    out = open_file(where["output-file"], "w", trace) if where["output-file"] else sys.stdout
    log = open_file(where["error-log"], "w", trace) if where["error-log"] else sys.stderr
    for r in (result.output if config.options.prettyprint else result.token_text).toLocalIterator():  # one file at a time
        out.write(r["text"] if r["text"].endswith("\n") else r["text"] + "\n")
    d = result.diagnostics
    for r in d.select("severity", "position", B.message_line(d["severity"], d["file"], d["line"], d["message"]).alias("m")).toLocalIterator():
        print(r["m"], file=log)
        for line in filter(None, r["position"].split("\n")):
            print(("??" if r["severity"] == "error" else "%%") + line, file=log)
    code = result.exit_code()
    result.close()
    for f, standard in ((out, sys.stdout), (log, sys.stderr)):
        if f is not standard:
            f.close()
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
