"""One output file for each input, under its name: a data source that tasks write and the driver commits.

A task writes each of its files under a name of its own; only when all tasks are done are these moved to their final names, so that a task which
is run again, or a job that fails, leaves no half-written file. The folder must be one that all executors and the driver see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "scholia_files"


@dataclass
class Written(WriterCommitMessage):
    """Names that files were written under, and their final names."""

    files: list[tuple[str, str]] = field(default_factory=list)


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.root = options["path"].rstrip("/"), options.get("root", "")

    def name(self, file: str) -> str:
        """A file's place in the folder: its name below the root, or its last part."""
        return file.removeprefix(self.root).lstrip("/") if self.root and file.startswith(self.root) else file.rpartition("/")[2]

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows (file, text), those of a file one after another."""
        system, folder = _file_system(self.folder)
        done, now, out = Written(), None, None
        try:
            for row in iterator:
                if row["file"] != now:
                    if out is not None:
                        out.close()
                    now = row["file"]
                    final = f"{folder}/{self.name(now)}"
                    done.files.append((f"{final}.{uuid.uuid4().hex}", final))
                    system.create_dir(final.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(done.files[-1][0])
                out.write((row["text"] or "").encode("latin-1"))
        except BaseException:
            if out is not None:
                out.close()
            self.abort([done])
            raise
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _file_system(self.folder)
        files = [f for m in messages if m for f in m.files]
        if len({final for _, final in files}) < len(files):
            raise ValueError("several inputs have one output name; give their common folder as root")
        for own, final in files:
            system.move(own, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _file_system(self.folder)
        for own, _ in (f for m in messages if m for f in m.files):
            with suppress(FileNotFoundError):
                system.delete_file(own)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options))


def write_files(output: DataFrame, folder: str, root: str = "") -> None:
    """(file, text), or (file, part, text) in pieces, as one file for each name; a file is written by one task, piece after piece, as its bytes."""
    output.sparkSession.dataSource.register(FilesSource)
    parts = output if "part" in output.columns else output.withColumn("part", F.lit(0))
    rows = parts.select("file", "part", "text").repartition("file").sortWithinPartitions("file", "part").select("file", "text")
    rows.write.format(FORMAT).mode("append").option("root", root).save(folder)
