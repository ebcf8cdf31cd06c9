"""Records inside tar archives. Archives are streamed, never held in memory."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .records import ARCHIVE_ENDINGS, list_files

MEMBER_SCHEMA = "path string, member string, start bigint, size bigint, record_no bigint, text string, error string"
MEMBER_COLUMNS = ["path", "member", "start", "size", "record_no", "text", "error"]
BATCH = 512
MOST_TASKS = 50_000


def _open(uri: str):
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(path)


def _open_output(uri: str):
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":/", ":///", 1))
    filesystem.create_dir(path.rsplit("/", 1)[0])
    return filesystem.open_output_stream(path, compression=None)


class _Forward(io.RawIOBase):
    """``size`` bytes of a handle from where it stands, front to back."""

    def __init__(self, handle, size: int):
        self.handle, self.left = handle, size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.handle.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _forward(handle, size: int) -> io.BufferedReader:
    return io.BufferedReader(_Forward(handle, size))


def _texts(stream, name: str, errors: str) -> Iterator[str]:
    """Records of one member: a header line after a blank line opens the next one."""
    lowered = name.lower()
    if lowered.endswith(".gz"):
        stream = gzip.open(stream)
    elif lowered.endswith(".bz2"):
        stream = bz2.open(stream)
    lines, blank = [], False
    for line in io.TextIOWrapper(stream, encoding="utf-8", errors=errors):
        if blank and line.startswith("[") and lines:
            yield "".join(lines)
            lines = []
        blank = not line.strip()
        if lines or not blank:
            lines.append(line)
    if lines:
        yield "".join(lines)


def _member_rows(path: str, name: str, stream, errors: str) -> Iterator[tuple]:
    number = 0
    try:
        for number, text in enumerate(_texts(stream, name, errors), start=1):
            yield path, name, None, None, number, text, None
    except Exception as problem:  # a bad member must not stop its archive
        yield path, name, None, None, number + 1, None, f"{type(problem).__name__}: {problem}"


def _wanted(name: str) -> bool:
    return name.lower().endswith((".pgn", ".gz", ".bz2"))


def _archive_rows(path: str, errors: str) -> Iterator[tuple]:
    """Compressed archives stream their records; plain ones only list their members."""
    plain = path.lower().endswith(".tar")
    try:
        with _open(path) as handle, tarfile.open(fileobj=handle, mode="r:" if plain else "r|*") as tar:
            for member in tar:
                if member.isfile() and _wanted(member.name):
                    if plain:
                        yield path, member.name, member.offset_data, member.size, None, None, None
                    else:
                        yield from _member_rows(path, member.name, _forward(tar.extractfile(member), member.size), errors)
    except Exception as problem:
        yield path, None, None, None, None, None, f"{type(problem).__name__}: {problem}"


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == BATCH:
            yield pd.DataFrame(batch, columns=MEMBER_COLUMNS).astype(_TYPES)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=MEMBER_COLUMNS).astype(_TYPES)


_TYPES = {"start": "Int64", "size": "Int64", "record_no": "Int64"}


def scan_archives(spark: SparkSession, path: str, errors: str = "replace") -> DataFrame:
    """``path, member, record_no, text, error`` for every record in every archive below ``path``.

    A compressed archive is one sequential task, whose raw records are dealt out to all tasks before
    anything else is done to them. The members of a plain tar are listed first and then read side by side.
    """

    def open_archives(batches):
        yield from _frames(row for pdf in batches for p in pdf["path"] for row in _archive_rows(p, errors))

    def read_members(batches):
        def rows():
            for pdf in batches:
                for p, name, start, size, error in zip(*[pdf[c] for c in ("path", "member", "start", "size", "error")]):
                    if error is not None:  # an archive that can't be listed to its end
                        yield p, None, None, None, None, None, error
                        continue
                    with _open(p) as handle:
                        handle.seek(int(start))
                        yield from _member_rows(p, name, _forward(handle, int(size)), errors)

        yield from _frames(rows())

    ship_package(spark)
    files = list_files(spark, path, ARCHIVE_ENDINGS).select("path")
    # one task per archive, however many files a listing's partition holds
    archives = files.where(~F.lower("path").endswith(".tar"))
    tasks = max(1, min(archives.count(), MOST_TASKS))
    packed = archives.repartition(tasks, "path").mapInPandas(open_archives, MEMBER_SCHEMA)
    packed = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "member", "record_no")
    plain = files.where(F.lower("path").endswith(".tar")).mapInPandas(open_archives, MEMBER_SCHEMA)
    members = plain.repartition("path", "member", "start").mapInPandas(read_members, MEMBER_SCHEMA)
    return packed.unionByName(members).drop("start", "size")
