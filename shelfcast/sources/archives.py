"""Zipped CSV files as a Spark data source: one partition for each member of an archive, or for small members of an archive together.

    spark.dataSource.register(ZippedCsv)
    spark.read.format("zipped_csv").option("columns", "qty,price").load(folder)

Planning reads only the archives' directories, which stand at their ends. A task opens its archive where the
member begins and streams it in pieces of lines, so neither an archive nor a member has to fit into memory, and a lost task reads
its own member again. Files are reached by ``pyarrow.fs``, so a path can be local or in any store that it knows.

Defined cases: a column that a member lacks is null, and so are fields that a short line lacks; more fields than headers are
left out; a member without lines gives no rows; a folder without archives gives no rows; what an encoding cannot read after the
first 128 kB becomes the replacement character; other members than CSV files are ignored.
"""

from __future__ import annotations

import codecs
import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Encodings in the order in which they are tried, for the ledger's archives and for uploads.
ENCODINGS = ("utf-8-sig", "gbk", "gb18030")
UPLOAD_ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")
#: Bytes that decide on the encoding, and lines of a piece.
START, LINES = 128 * 1024, 20_000
#: Bytes, as text, of members that a task reads one after another where members are small and many; a larger member has a task of its own.
TASK_BYTES = 32 << 20
ORIGIN = ("source_file", "source_member")


def clean_header(name: str) -> str:
    return name.replace("﻿", "").replace("\t", "").strip().strip("\"'").strip().lower()


def first_encoding(start: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that reads the file's beginning; a character cut at its end doesn't count."""
    for name in encodings:
        try:
            codecs.getincrementaldecoder(name)("strict").decode(start, False)
            return name
        except UnicodeDecodeError:
            continue
    return encodings[-1]


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Members(InputPartition):
    """Consecutive members of an archive."""

    path: str
    names: list[str]
    size: int

    def __init__(self, path: str, names: list[str], size: int) -> None:
        super().__init__(None)
        self.path, self.names, self.size = path, names, size


class MemberReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], encodings: tuple[str, ...], together: int = 0) -> None:
        self.folder, self.columns, self.encodings, self.together = folder, columns, encodings, together

    def partitions(self) -> list[Members]:
        files, root = store(self.folder)
        found = [root] if root.lower().endswith(".zip") else [f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.lower().endswith(".zip")]
        members: list[Members] = []
        for path in sorted(found):
            with files.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                own: list[Members] = []
                for m in archive.infolist():
                    if not m.filename.lower().endswith(".csv"):
                        continue
                    if not own or own[-1].size + m.file_size > self.together:
                        own.append(Members(path, [], 0))
                    own[-1].names.append(m.filename)
                    own[-1].size += m.file_size
                members += own
        # the largest first, so that none is left to run alone
        return sorted(members, key=lambda m: (-m.size, m.path, m.names)) or [Members("", [], 0)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = store(self.folder)
        with files.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            for name in partition.names:
                yield from self._member(archive, partition.path, name)

    def _member(self, archive: zipfile.ZipFile, path: str, name: str) -> Iterator[pa.RecordBatch]:
        with archive.open(name) as member:
            encoding = first_encoding(member.read(START), self.encodings)
        with archive.open(name) as member:
            lines = csv.reader(io.TextIOWrapper(member, encoding, errors="replace", newline=""))
            header = [clean_header(h) for h in next(lines, [])]
            at = [header.index(c) if c in header else None for c in self.columns]
            piece: list[list] = []
            for line in lines:
                if line:
                    piece.append([line[i] if i is not None and i < len(line) else None for i in at])
                if len(piece) == LINES:
                    yield self._batch(piece, path, name)
                    piece = []
            if piece:
                yield self._batch(piece, path, name)

    def _batch(self, rows: list[list], path: str, name: str) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows), pa.string()), pa.array([name] * len(rows), pa.string())], names=[*self.columns, *ORIGIN])


class ZippedCsv(DataSource):
    """Options: path, columns (cleaned headers, comma-separated), encodings (comma-separated, in the order in which they are tried), together (bytes of members that are read together)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c]

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in (*self._columns(), *ORIGIN)])

    def reader(self, schema: StructType) -> DataSourceReader:
        given = self.options.get("encodings")
        return MemberReader(self.options["path"], self._columns(), tuple(given.split(",")) if given else ENCODINGS, int(self.options.get("together", "0")))


def read_zipped_csv(spark: SparkSession, folder: str, columns: list[str], encodings: tuple[str, ...] = ENCODINGS, together: int = 0) -> DataFrame:
    """All CSV members of all archives in ``folder`` as text columns, with the archive and member that they came from."""
    if bad := [c for c in columns if "," in c]:
        raise ValueError(f"a comma in {bad}")
    spark.dataSource.register(ZippedCsv)
    return spark.read.format("zipped_csv").option("columns", ",".join(columns)).option("encodings", ",".join(encodings)).option("together", together).load(folder)


def write_zipped_csv(df: DataFrame, folder: str, headers: dict[str, str] | None = None, encodings: tuple[str, ...] = ("utf-8-sig",), lines: int = 100_000) -> None:
    """One archive for each partition, in members of at most ``lines`` lines; partitions take turns at the encodings. ``headers``: column to header.

    A file has its partition's number, so a task that runs again writes the same one. An existing folder is an error.
    """
    files, root = store(folder)
    if files.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} exists")
    files.create_dir(root)
    names = df.columns
    titles = [(headers or {}).get(c, c) for c in names]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, total = TaskContext.get().partitionId(), 0
        encoding = encodings[number % len(encodings)]
        own, _ = store(folder)
        with own.open_output_stream(f"{root}/part-{number:05d}.zip") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            left = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            k = 0
            while (first := next(left, None)) is not None or not k:
                with archive.open(f"part-{k:04d}.csv", "w") as raw, io.TextIOWrapper(raw, encoding, newline="") as text:
                    out = csv.writer(text)
                    out.writerow(titles)
                    row, n = first, 0
                    while row is not None:
                        out.writerow(["" if v is None else v for v in row])
                        n += 1
                        row = next(left, None) if n < lines else None
                total, k = total + n, k + 1
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    df.select(*[df[c].cast("string") for c in names]).mapInArrow(write, "n bigint").agg({"n": "sum"}).collect()
