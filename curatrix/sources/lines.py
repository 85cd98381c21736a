"""Text files whose lines are written in pieces: a task holds a piece, not the line."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .json_object import located

FORMAT = "line_pieces"


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class LinePieces(DataSource):
    """Rows of line (any text, equal for the pieces of one line), head, text; options path, title, divider."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    """A file for each task, in the order of tasks; files appear when all are written."""

    def __init__(self, options: dict):
        self.path, self.title, self.divider = options["path"], options.get("title", ""), options.get("divider", "")
        self.pending = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        out, line, name = None, None, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tsv"
        for row in rows:
            if out is None:
                fs, folder = located(self.pending)
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}")
                out.write(f"{self.title}\n".encode() if self.title else b"")
                new = True
            else:
                new = row.line != line
                out.write(b"\n" if new else self.divider.encode())
            out.write(((row.head if new else "") + row.text).encode())
            line = row.line
        if out is None:
            return _Written(None)
        out.write(b"\n")
        out.close()
        return _Written(name)

    def commit(self, messages: list[_Written]) -> None:
        fs, folder = located(self.path)
        fs.create_dir(folder, recursive=True)
        pending = located(self.pending)[1]
        for m in messages:
            if m is not None and m.file:
                fs.move(f"{pending}/{m.file}", f"{folder}/{m.file}")
        with fs.open_output_stream(f"{folder}/_SUCCESS"):
            pass
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, pending = located(self.pending)
        if fs.get_file_info(pending).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(pending)


def write_lines(df: DataFrame, path: str, line: str, order: list[Column], head: Column, text: Column, title: str = "", divider: str = "") -> None:
    """A line for each value of `line`: its head, then the texts of its rows, in order, between dividers. Lines and pieces stand in the order given, which begins with what tells lines apart; all pieces of a line are in one file."""
    df.sparkSession.dataSource.register(LinePieces)
    ordered = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    lines = [f"_o{i}" for i in range(len(order) - 1)]  # the last tells a line's pieces apart
    ordered = ordered.repartitionByRange(*lines, line).sortWithinPartitions(*lines, line, f"_o{len(order) - 1}")
    ordered.select(F.col(line).alias("line"), head.alias("head"), text.alias("text")).write.format(FORMAT).mode("append").options(path=path, title=title, divider=divider).save()
