"""Game records read from ranges of files, and a row for all that could not be read.

A listing of files becomes a table of ranges, which Spark deals out to tasks. A task reads its range
in pieces and cuts it at record borders: a blank line, in either style of line ends, followed by ``[``. A
record belongs to the range its first byte lies in, so a range begins at its first
border and is read on past its end. Compressed files are one range; their raw records are
dealt out again before anything else is done to them.

What is damaged ends in a row of its own with the reason, the place in the file and the unfinished record.
"""

from __future__ import annotations

import bz2
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship_package
from .archives import _open
from .records import TEXT_ENDINGS, list_files, listed

RANGE = 64 << 20
PIECE = 1 << 18
BATCH = 8 << 20
BORDER = re.compile(rb"\n\r?\n(?=\[)")
PACKED = r"\.(gz|bz2)$"
LOOK_BACK = 3  # bytes of the longest border
#: Most tasks that ranges are dealt to; each then reads several.
TASKS = 50_000
RAW = "path string, file_name string, modified bigint, block bigint, offset bigint, value binary, reason string, damaged_at bigint"


class Damage(Exception):
    """What stops a file from being read, and the bytes of it that came before."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.at = at


def plain_pieces(handle) -> Iterator[tuple[int, bytes]]:
    while piece := handle.read(PIECE):
        yield 0, piece


def _zlib_pieces(handle, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(start of the member, bytes) of each member of a gzip file; its checksum and length are verified by zlib."""
    data = handle.read(PIECE)
    while data:
        member, inflate = at, zlib.decompressobj(31)
        while True:
            saved = inflate.copy()
            try:
                out = inflate.decompress(data, 4 * PIECE)
            except zlib.error:
                # again from before this piece, byte by byte, for all that can still be had
                for k in range(len(data)):
                    try:
                        if out := saved.decompress(data[k : k + 1]):
                            yield member, out
                    except zlib.error as problem:
                        raise Damage(f"gzip: {problem}", at + k) from None
                raise Damage("gzip: invalid data", at + len(data)) from None
            if out:
                yield member, out
            if inflate.eof:
                at, data = at + len(data) - len(inflate.unused_data), inflate.unused_data
                break
            at, data = at + len(data) - len(inflate.unconsumed_tail), inflate.unconsumed_tail
            if not data and not (data := handle.read(PIECE)):
                raise Damage("gzip: the file ends inside a member", at)
        data = data or handle.read(PIECE)
        while data and not data.strip(b"\0"):  # padding
            at, data = at + len(data), handle.read(PIECE)
        if data and not data.startswith(b"\x1f\x8b"[: len(data)]):
            raise Damage("gzip: other data after a member", at)


def _bz2_pieces(handle, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(start of the stream, bytes) of each stream of a bzip2 file; each block's checksum is verified."""
    data = handle.read(PIECE)
    while data:
        stream, inflate = at, bz2.BZ2Decompressor()
        while not inflate.eof:
            try:
                out = inflate.decompress(data, 1 << 16)
            except (OSError, ValueError) as problem:
                raise Damage(f"bzip2: {problem}", at) from None
            if out:
                yield stream, out
            if not inflate.eof:
                at, data = at + len(data), b""
                if inflate.needs_input and not (data := handle.read(PIECE)):
                    raise Damage("bzip2: the file ends inside a stream", at)
        at, data = at + len(data) - len(inflate.unused_data), inflate.unused_data or handle.read(PIECE)
        if data and not data.startswith(b"BZh"[: len(data)]):
            raise Damage("bzip2: other data after a stream", at)


def cut(
    pieces: Iterable[tuple[int, bytes]], at: int = 0, before: bytes = b"", done: Callable = lambda block, offset: False
) -> Iterator[tuple[int, int, bytes]]:
    """(block, offset, record) of the records that begin in the pieces, until one for which ``done``.

    ``block`` is the member or stream in which a record begins, and ``offset`` its place there; ``at`` is that of the first
    piece. ``before`` holds the bytes in front of it, at most ``LOOK_BACK``; without any a file begins. If the
    pieces end in ``Damage``, the record that was open comes with it.
    """
    # places in the text are numbered from the first byte of ``buffer`` that there ever was
    buffer, base, searched, begins = bytearray(before), 0, 0, None if before else 0
    starts, blocks = [], []  # where blocks begin, less the offset there, and their names

    def place(where: int) -> tuple[int, int]:
        i = max(bisect_right(starts, where) - 1, 0)
        return (blocks[i], where - starts[i]) if blocks else (0, at)

    def record(until: int) -> tuple[int, int, bytes]:
        return (*place(begins), bytes(buffer[begins - base : until - base]).rstrip(b"\r\n"))

    try:
        for block, piece in pieces:
            if not blocks or blocks[-1] != block:
                starts.append(base + len(buffer) - (0 if blocks else at))
                blocks.append(block)
            buffer += piece
            while found := BORDER.search(buffer, searched):
                where = base + found.end()
                searched = found.end()
                if begins is not None:
                    yield record(where)
                    begins = None
                if where < len(before):
                    continue
                if done(*place(where)):
                    return
                begins = where
            searched = max(searched, len(buffer) - LOOK_BACK)
            if begins is None and blocks and done(*place(base + searched)):
                return
            drop = (begins - base) if begins is not None else searched
            if drop > PIECE:
                del buffer[:drop]
                base, searched = base + drop, searched - drop
                past = max(bisect_right(starts, base) - 1, 0)
                del starts[:past], blocks[:past]
    except Damage as damage:
        damage.open = record(base + len(buffer)) if begins is not None else (*place(base + len(buffer)), b"")
        raise
    if begins is not None:
        yield record(base + len(buffer))


def _range_rows(path: str, start: int, end: int, before: bytes | None = None) -> Iterator[tuple]:
    """(block, offset, value, reason, damaged_at) of one range; of a packed file from a member to another."""
    lowered = path.lower()
    packed = lowered.endswith((".gz", ".bz2"))
    try:
        with _open(path) as handle:
            if packed:
                handle.seek(start)
                pieces = (_zlib_pieces if lowered.endswith(".gz") else _bz2_pieces)(handle, start)
                rows = cut(pieces, 0, before or b"", lambda block, offset: block >= end)
            else:
                handle.seek(max(0, start - LOOK_BACK))
                before = handle.read(min(start, LOOK_BACK))
                rows = cut(plain_pieces(handle), start, before, lambda block, offset: offset >= end)
            for block, offset, value in rows:
                if value.strip():
                    yield block, offset, value, None, None
    except Damage as damage:
        block, offset, value = damage.open
        if not packed or block < end:  # another range's record otherwise, which tells of the damage as well
            yield block, offset, value, str(damage), damage.at
    except Exception as problem:  # an unreadable file must not stop the others
        yield start if packed else 0, start, None, f"{type(problem).__name__}: {problem}", start


def file_pieces(path: str) -> Iterator[bytes]:
    """The bytes of a plain, gzip or bzip2 file, a piece at a time."""
    lowered = path.lower()
    with _open(path) as handle:
        for _, piece in (_zlib_pieces if lowered.endswith(".gz") else _bz2_pieces if lowered.endswith(".bz2") else plain_pieces)(handle):
            yield piece


def _members(path: str) -> Iterator[tuple[int, bytes, int]]:
    """(start, last bytes in front, bytes of text) of each member or stream of a packed file, as far as it can be read."""
    lowered, before, own, known = path.lower(), b"", b"", None
    size = 0
    try:
        with _open(path) as handle:
            for block, piece in (_zlib_pieces if lowered.endswith(".gz") else _bz2_pieces)(handle, 0):
                if block != known:
                    if known is not None:
                        yield known, before, size
                    known, before, size = block, own, 0
                own, size = (own + piece)[-LOOK_BACK:], size + len(piece)
    except Exception:  # the reader of the last member meets the damage again, and tells of it
        pass
    if known is not None:
        yield known, before, size


def _frames(batches: Iterable[pd.DataFrame], rows_of: Callable) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded number of bytes."""
    names = [c.split()[0] for c in RAW.split(", ")]
    held, size = [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(held, columns=names).astype({"damaged_at": "Int64"})

    for batch in batches:
        for r in batch.itertuples():
            for row in rows_of(r.path, int(r.start), int(r.end), r.before):
                held.append((r.path, r.file_name, r.modified, *row))
                size += len(row[2] or b"")
                if size >= BATCH:
                    yield frame()
                    held, size = [], 0
    if held:
        yield frame()


def member_table(listing: DataFrame) -> DataFrame:
    """``path, start, before, text_bytes``: where the members or streams of the listed packed files begin.

    Each file is read through once, in one task; kept as a table, it lets later reads start in many places.
    """
    ship_package(listing.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                members = _members(path)
                while some := list(islice(members, 10_000)):
                    yield pd.DataFrame([(path, *m) for m in some], columns=["path", "start", "before", "text_bytes"])

    files = listing.where("bytes > 0").where(F.lower("path").rlike(PACKED)).select("path")
    return files.repartition(max(1, min(files.count(), TASKS)), "path").mapInPandas(rows, "path string, start bigint, before binary, text_bytes bigint")


def _packed_ranges(files: DataFrame, members: DataFrame | None, range_bytes: int) -> DataFrame:
    """One range per packed file, or with a table of members one per so many bytes of text."""
    whole = files.select("path", "file_name", "modified", F.lit(0).cast("bigint").alias("start"), F.col("bytes").alias("end"), F.lit(None).cast("binary").alias("before"))
    if members is None:
        return whole
    # members of a file in runs; the numbers of one file's members are few against its text
    upto = Window.partitionBy("path").orderBy("start")
    numbered = members.withColumn("run", F.floor((F.sum("text_bytes").over(upto) - F.col("text_bytes")) / range_bytes))
    runs = numbered.groupBy("path", "run").agg(F.min("start").alias("start"), F.min_by("before", "start").alias("before"))
    runs = runs.withColumn("next", F.lead("start").over(upto))
    known = runs.join(files, "path").select("path", "file_name", "modified", "start", F.coalesce("next", "bytes").alias("end"), "before")
    return known.unionByName(whole.join(members.select("path").distinct(), "path", "left_anti"))


def read_ranges(listing: DataFrame, range_bytes: int = RANGE, members: DataFrame | None = None) -> DataFrame:
    """Raw records and damage of the listed files, ``RAW`` columns.

    A packed file is one range, whose raw records are dealt out again; with its rows of ``member_table`` it is
    read from several members side by side.
    """
    spark = listing.sparkSession
    ship_package(spark)
    files = listing.where("bytes > 0").withColumns({"modified": F.unix_micros("modified"), "packed": F.lower("path").rlike(PACKED)})
    zero, step = F.lit(0).cast("bigint"), F.lit(range_bytes).cast("bigint")
    starts = F.explode(F.sequence(zero, F.col("bytes") - 1, step))
    plain = files.where("NOT packed").select("path", "file_name", "modified", starts.alias("start"))
    plain = plain.select("*", (F.col("start") + range_bytes).alias("end"), F.lit(None).cast("binary").alias("before"))
    packed = _packed_ranges(files.where("packed"), members, range_bytes)

    def rows(batches):
        yield from _frames(batches, _range_rows)

    def read(some: DataFrame) -> DataFrame:
        # an explicit number: a listing is so small that it would be merged into one task
        return some.repartition(max(1, min(some.count(), TASKS)), "path", "start").mapInPandas(rows, RAW)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = read(packed).repartition(partitions, "path", "block", "offset")
    return read(plain).unionByName(spread)


def records_of(listing: DataFrame, errors: str = "replace", range_bytes: int = RANGE, members: DataFrame | None = None) -> DataFrame:
    """``path, file_name, modified, record_id, text, damage, damaged_at`` of every record in the listed files.

    ``damage`` is null for a record that was read whole. A file that can't be read to its end gives one more row
    with the reason, the bytes of the file before the damage and the text of the unfinished
    record. Ids come from path and place, so they are the same for any size of the ranges.
    """
    raw = read_ranges(listing, range_bytes, members)
    text = F.ltrim(T.decode(F.col("value").cast("string"), errors), F.lit("\ufeff"))
    return raw.select(
        "path",
        "file_name",
        F.timestamp_micros("modified").alias("modified"),
        F.xxhash64("path", "block", "offset").alias("record_id"),
        text.alias("text"),
        F.col("reason").alias("damage"),
        "damaged_at",
    )


def read_records(
    spark: SparkSession, path: str, errors: str = "replace", endings: Sequence[str] = TEXT_ENDINGS, range_bytes: int = RANGE
) -> DataFrame:
    """``records_of`` all files below ``path`` by ending."""
    return records_of(list_files(spark, path, endings), errors, range_bytes)


def stream_files(spark: SparkSession, path: str, endings: Sequence[str] = TEXT_ENDINGS, files_per_batch: int = 1000) -> DataFrame:
    """The listing of files as they arrive, in batches; their contents are not read."""
    content = "path string, modificationTime timestamp, length bigint, content binary"
    found = (
        spark.readStream.format("binaryFile").schema(content).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return listed(found, endings)
