"""CSV export that a spreadsheet cannot run as formulas."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from tanteo.functions.text import csv_cell, safe_cell


def safe_cells(df: DataFrame) -> DataFrame:
    """Every cell as the text to export, formula-like text defused, nulls empty."""
    return df.select(
        *[safe_cell(F.col(f"`{f.name}`"), isinstance(f.dataType, StringType)).alias(f.name) for f in df.schema]
    )


def quoted_cells(df: DataFrame) -> DataFrame:
    """``safe_cells`` with the quotes a CSV line carries."""
    return df.select(
        *[csv_cell(F.col(f"`{f.name}`"), isinstance(f.dataType, StringType)).alias(f.name) for f in df.schema]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the export in parallel part files, each with the byte-order mark that spreadsheets need and the header.

    Cells are quoted by Spark; the files are written by ``MarkedCsv`` below. ``mode`` is errorifexists, overwrite or append.
    """
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"mode {mode}")
    spark = df.sparkSession
    spark.dataSource.register(MarkedCsv)
    quote = lambda name: '"' + name.replace('"', '""') + '"'
    header = ",".join(quote(name) for name in df.columns)
    cells = quoted_cells(df)
    lines = cells.select(F.concat_ws(",", *[F.col(f"`{c}`") for c in cells.columns]).alias("line"))
    writer = lines.write.format(MarkedCsv.name()).option("path", path).option("header", header).option("new", mode == "errorifexists")
    writer.mode("overwrite" if mode == "overwrite" else "append").save()


class MarkedCsv(DataSource):
    """Writes lines to files that begin with a byte-order mark and the header.

    In two phases: tasks write under a temporary folder, each attempt a file of its own, and only the files of attempts that succeeded
    are moved into place when the job commits. A job that fails leaves the folder as it was; of ``overwrite``, the old files go
    only when the new ones are complete.
    """

    @classmethod
    def name(cls) -> str:
        return "marked_csv"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _MarkedWriter(dict(self.options), overwrite)


@dataclass
class _Part(WriterCommitMessage):
    name: str


class _MarkedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options["header"], overwrite
        self.temporary = f"_temporary-{uuid.uuid4().hex}"
        files, folder = _opened(self.path)
        if options["new"].lower() == "true" and files.get_file_info(folder).type != FileType.NotFound:
            raise FileExistsError(f"{self.path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        files, folder = _opened(self.path)
        files.create_dir(f"{folder}/{self.temporary}", recursive=True)
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.csv"
        with files.open_output_stream(f"{folder}/{self.temporary}/{part}") as out:
            out.write(f"\ufeff{self.header}\n".encode())
            for batch in iterator:
                text = "\n".join(batch.column(0).to_pylist())
                out.write(f"{text}\n".encode() if batch.num_rows else b"")
        return _Part(part)

    def commit(self, messages: list[_Part | None]) -> None:
        files, folder = _opened(self.path)
        files.create_dir(f"{folder}/{self.temporary}", recursive=True)
        there = files.get_file_info(FileSelector(folder))
        for message in messages:
            if message is not None:
                files.move(f"{folder}/{self.temporary}/{message.name}", f"{folder}/{message.name}")
        if self.overwrite:
            for old in there:
                if old.type == FileType.File:
                    files.delete_file(old.path)
        files.delete_dir(f"{folder}/{self.temporary}")
        files.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[_Part | None]) -> None:
        files, folder = _opened(self.path)
        if files.get_file_info(f"{folder}/{self.temporary}").type == FileType.Directory:
            files.delete_dir(f"{folder}/{self.temporary}")


def _opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or address, and the folder in it."""
    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"{Path.cwd()}/{path}")
