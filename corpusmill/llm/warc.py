"""Operator 8: a converter from legacy ARC records to WARC, and both formats' readers.

ARC has two header lines, told apart by their number of fields:
version 1 is ``url ip date type length``,
version 2 is ``url ip date type result checksum location offset file length``.
A WARC file here is written by Spark's text sink: a record is a line that ends with the two
line breaks WARC asks for, so any store that Spark can write to will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from ..sources.ranges import file_pieces

BREAK = b"\r\n\r\n"
V1 = ("url", "ip", "date", "type", "length")
V2 = ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length")
MOST_TASKS = 50_000
READ = (
    "record_id string, source_id bigint, record_type string, target_uri string, warc_date string, "
    "payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
)


class BadRecord(ValueError):
    pass


# --- ARC -----------------------------------------------------------------------------------


def parse_arc(record: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields of either version, and the declared number of bytes that follow them."""
    line, _, rest = record.partition(b"\n")
    values = line.decode().split(" ")
    names = {len(V1): V1, len(V2): V2}.get(len(values))
    if names is None:
        raise BadRecord(f"an ARC header of {len(values)} fields")
    head = dict(zip(names, values))
    length = int(head["length"])
    if len(rest) < length:
        raise BadRecord(f"{len(rest)} of {length} bytes")
    return head, rest[:length]


def arc_address(url: Column) -> Column:
    """The URL as a header field: white space percent-encoded, ``-`` for none."""
    address = F.regexp_replace(F.coalesce(url, F.lit("")), r"\s", "%20")
    return F.when(address == "", F.lit("-")).otherwise(address)


def arc_record(url: Column, html: Column, version: Column, date: str = "20240101000000") -> Column:
    """An ARC record of a page: header line, HTTP response, line break. Null counts as empty."""
    body = F.coalesce(html, F.lit(""))
    address = arc_address(url)
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    length = (F.octet_length(head) + F.octet_length(body)).cast("string")
    first = F.concat(address, F.lit(f" 0.0.0.0 {date} text/html "))
    middle = F.when(version == 2, F.lit("200 - - 0 pages.arc ")).otherwise(F.lit(""))
    return F.concat(first, middle, length, F.lit("\n"), head, body, F.lit("\n"))


def separated(spark: SparkSession, path: str, sep: bytes) -> DataFrame:
    """``value``: the bytes between separators, in order, every file whole within one task.

    Spark's text source reads packed files so, and splits others, which it would cut inside of records; those are
    read from end to end by a task each.
    """
    packed = spark.read.option("lineSep", sep.decode()).option("pathGlobFilter", "*.gz").text(path)
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "length")
    plain = files.where((F.col("length") > 0) & ~F.col("path").endswith(".gz")).select("path")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                rest = b""
                for piece in file_pieces(name):
                    *whole, rest = (rest + piece).split(sep)
                    if whole:
                        yield pd.DataFrame({"value": whole})
                if rest:
                    yield pd.DataFrame({"value": [rest]})

    read = plain.repartition(max(1, min(plain.count(), MOST_TASKS)), "path").mapInPandas(rows, "value binary")
    return packed.select(F.col("value").cast("binary").alias("value")).unionByName(read)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files, one ``arc`` binary each, cut by their declared lengths.

    A file of any size is read in order by one task. A version block ``filedesc://`` is left out; blank lines
    between records are skipped.
    """
    ship_package(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        missing = 0
        for batch in batches:
            out = []
            for line in batch["value"]:
                data = bytes(line) + b"\n"
                if not held:
                    if not data.strip():
                        continue
                    missing = int(data.split(b" ")[-1])
                    held = [data]
                else:
                    held.append(data)
                    missing -= len(data)
                if missing <= 0:
                    whole, held = b"".join(held), []
                    if not whole.startswith(b"filedesc://"):
                        out.append(whole)
            yield pd.DataFrame({"arc": pd.Series(out, dtype=object)})
        if held:
            raise BadRecord("an ARC file ends within a record")

    return separated(spark, path, b"\n").mapInPandas(cut, "arc binary")


# --- WARC ----------------------------------------------------------------------------------


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    head, found, payload = block.partition(BREAK)
    return (head + BREAK, payload) if found else (b"", block)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(source: int | None, url: str, date: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{source} {url} {date}").urn


def to_warc(arc: bytes, source: int | None, first: int | None, first_url: str | None = None) -> bytes:
    """The WARC record, without its closing line breaks, that says what the ARC record says.

    It is a ``revisit`` of record ``first``, without the payload, if that is another one; with the
    address of that record it names it by its identifier, as the records of one crawl share their date.
    """
    head, block = parse_arc(arc)
    http, payload = payload_of(block)
    d = head["date"].ljust(14, "0")
    revisit = first is not None and first != source
    if revisit:
        block = http
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(source, head['url'], head['date'])}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {head['url']}",
        f"WARC-IP-Address: {head['ip']}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if source is not None:
        lines.append(f"X-Source-ID: {source}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Source-ID: {first}")
        if first_url is not None:
            lines.append(f"WARC-Refers-To: <{record_id(first, first_url, head['date'])}>")
            lines.append(f"WARC-Refers-To-Target-URI: {first_url}")
    return "\r\n".join(lines).encode() + BREAK + block


def convert(df: DataFrame, arc: str = "arc", source: str = "source_id", first: str = "first_id", first_url: str | None = None) -> DataFrame:
    """One ``warc`` string for each ARC record; ``first`` is the record that a revisit names, or null, and ``first_url`` its address."""
    ship_package(df.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = ([None if pd.isna(x) else int(x) for x in batch[c]] for c in (source, first))
            records = zip(batch[arc], *ids, batch["__url"])
            made = [to_warc(a.encode() if isinstance(a, str) else bytes(a), s, f, u).decode() for a, s, f, u in records]
            yield pd.DataFrame({"warc": pd.Series(made, dtype=object)})

    # identifiers travel as text: an integer column with nulls would turn into floats
    ids = [F.col(c).cast("string").alias(c) for c in (source, first)]
    address = F.lit(None).cast("string") if first_url is None else F.col(first_url)
    return df.select(arc, *ids, address.alias("__url")).mapInPandas(rows, "warc string")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of a frame with one column of records."""
    options = {"lineSep": BREAK.decode(), "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    records.write.options(**options).text(path)


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record; ``pieces`` are the bytes between line breaks of two.

    Blocks are cut by the declared length, so a block may hold such breaks itself.
    """
    buffer, head, length = bytearray(), None, 0
    for piece in pieces:
        if head is None and not buffer:
            piece = piece.lstrip(b"\r\n")
            if not piece:
                continue
        buffer += piece + BREAK
        while buffer:
            if head is None:
                at = buffer.find(BREAK)
                if at < 0:
                    break
                lines = bytes(buffer[:at]).decode().split("\r\n")
                head = dict(x.split(": ", 1) for x in lines[1:]) | {"version": lines[0]}
                length = int(head["Content-Length"])
                del buffer[: at + len(BREAK)]
            if len(buffer) < length + len(BREAK):
                break
            yield head, bytes(buffer[:length])
            head = None
            del buffer[: length + len(BREAK)]
            while buffer[:2] == b"\r\n":
                del buffer[:2]
    if head is not None or buffer.strip():
        raise BadRecord("a WARC file ends within a record")


def read_warc(spark: SparkSession, path: str, columns: str = READ) -> DataFrame:
    """Records of WARC files. Digests of responses are checked against their payloads."""
    ship_package(spark)
    names = [c.split()[0] for c in columns.split(", ")]

    def row(head: dict[str, str], block: bytes) -> dict:
        kind, payload = head["WARC-Type"], payload_of(block)[1]
        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != said:
            raise BadRecord(f"{head['WARC-Record-ID']}: its payload has another digest")
        return {
            "record_id": head["WARC-Record-ID"].strip("<>"),
            "source_id": head.get("X-Source-ID"),
            "record_type": kind,
            "target_uri": head["WARC-Target-URI"],
            "warc_date": head["WARC-Date"],
            "payload_digest": said,
            "payload_bytes": int(head["X-Payload-Length"]),
            "refers_to": head.get("X-Refers-To-Source-ID"),
            "payload": payload,
        }

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = (bytes(x) for batch in batches for x in batch["value"])
        out: list[dict] = []
        size = 0
        for head, block in records_of(pieces):
            out.append({k: v for k, v in row(head, block).items() if k in names})
            size += len(block)
            if size > 1 << 23 or len(out) == 10_000:
                yield frame(out)
                out, size = [], 0
        yield frame(out)

    def frame(out: list[dict]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=names)
        for name in {"source_id", "refers_to"} & set(names):
            made[name] = pd.array([pd.NA if x is None else int(x) for x in made[name]], dtype="Int64")
        return made

    return separated(spark, path, BREAK).mapInPandas(rows, columns)


# --- pages ---------------------------------------------------------------------------------


def first_copies(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add ``first_id`` and ``first_url``: the smallest page_id with the same payload of ``least`` bytes or more, else null.

    Payloads are told apart by SHA-256. Only digests that repeat are joined, so one payload that
    a third of all pages share leaves one row here and Spark splits its side of the join.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    key = F.when(F.octet_length(body) >= least, F.sha2(body.cast("binary"), 256))
    marked = pages.withColumn("__key", key)
    firsts = (
        marked.where("__key IS NOT NULL")
        .groupBy("__key")
        .agg(F.min("page_id").alias("first_id"), F.min_by(arc_address(F.col("url")), "page_id").alias("first_url"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    return marked.join(firsts, "__key", "left").drop("__key")


def archive_pages(pages: DataFrame, least: int = 0, path: str | None = None) -> str:
    """Turn pages into ARC records, convert them to WARC files, and return their folder.

    Null html is an empty payload, a null URL is written as ``-``, one with white space percent-encoded.
    Rows that repeat the smallest page_id of a payload are responses too; null ids are never named.
    Other columns are ignored. An empty table gives a folder without records.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    copies = first_copies(pages.select("page_id", "url", "html"), least)
    version = F.when(F.col("page_id") % 2 == 1, 2).otherwise(1)
    arcs = copies.select(arc_record(F.col("url"), F.col("html"), version).alias("arc"), F.col("page_id").alias("source_id"), "first_id", "first_url")
    write_warc(convert(arcs, first_url="first_url"), path)
    return path
