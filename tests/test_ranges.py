"""Ranges of files, damaged files, and what is told about them."""

from __future__ import annotations

import bz2
import gzip
import random
import zlib

import pytest
from games import rated
from pyspark.sql import functions as F

from corpusmill.sources import ranges as G
from corpusmill.sources.records import parse_records, scan_records

R = random.Random(3)


def games(n: int, newline: str = "\n") -> list[str]:
    return [rated(moves=f"{{game {i} {'é' * R.randint(0, 60)}}}{newline * (i % 3)} 1. e4 e5 1-0").replace("\n", newline) for i in range(n)]


def corpus_of(some: list[str], newline: str = "\n") -> bytes:
    return newline.join(g.rstrip("\r\n") + newline for g in some).encode()


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_every_record_lies_in_one_range(tmp_path, newline, size):
    some = games(40, newline)
    path = tmp_path / "a.pgn"
    path.write_bytes(corpus_of(some, newline))
    total, found = path.stat().st_size, []
    for start in range(0, total, size):
        for block, offset, value, reason, _ in G._range_rows(f"file://{path}", start, start + size):
            assert block == 0 and reason is None and start <= offset < start + size
            found.append((offset, value.decode()))
    assert [v for _, v in sorted(found)] == [g.rstrip("\r\n") for g in some]


def test_small_pieces_and_members(tmp_path, monkeypatch):
    some = games(60)
    path = tmp_path / "a.pgn.gz"
    whole = corpus_of(some)
    cuts = sorted(R.sample(range(1, len(whole)), 25))
    parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
    path.write_bytes(b"".join(gzip.compress(p) for p in parts) + b"\0" * 100)
    want = [g.rstrip("\n") for g in some]
    seen = set()
    for piece in (5, 64, 1 << 18):
        monkeypatch.setattr(G, "PIECE", piece)
        rows = list(G._range_rows(f"file://{path}", 0, 1 << 60))
        assert [r[2].decode() for r in rows] == want and all(r[3] is None for r in rows)
        seen.add(tuple(r[:2] for r in rows))
    assert len(seen) == 1  # places do not depend on how the file was read
    other = tmp_path / "a.pgn.bz2"
    other.write_bytes(b"".join(bz2.compress(p) for p in parts))
    assert [r[2].decode() for r in G._range_rows(f"file://{other}", 0, 1 << 60)] == want


def damage_of(path) -> tuple[list[str], tuple]:
    rows = list(G._range_rows(f"file://{path}", 0, 1 << 60))
    assert rows[-1][3] is not None and all(r[3] is None for r in rows[:-1])
    return [r[2].decode("utf-8", "replace") for r in rows[:-1]], rows[-1]


def test_damaged_files(tmp_path):
    some = games(400)
    want, whole = [g.rstrip("\n") for g in some], gzip.compress(corpus_of(some))
    path = tmp_path / "a.pgn.gz"

    path.write_bytes(whole[: len(whole) // 2])
    good, row = damage_of(path)
    assert good == want[: len(good)] and 100 < len(good) < 300 and row[4] == len(whole) // 2 and "ends inside" in row[3]
    assert want[len(good)].startswith(row[2].decode("utf-8", "ignore")[:40])

    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0xFF
    path.write_bytes(flipped)
    good, row = damage_of(path)
    assert good[:100] == want[:100] and row[4] >= len(whole) // 2

    path.write_bytes(whole[:-8] + b"\1" * 8)  # another checksum: all is read, and the last record is in doubt
    good, row = damage_of(path)
    assert good == want[:-1] and row[2].decode() == want[-1] and "check" in row[3]

    path.write_bytes(whole + b"tail")
    good, row = damage_of(path)
    assert good == want[:-1] and "other data" in row[3] and row[4] == len(whole)

    path.write_bytes(b"no gzip")
    assert damage_of(path)[0] == []

    packed = bz2.compress(corpus_of(games(40_000)), 1)
    other = tmp_path / "a.pgn.bz2"
    other.write_bytes(packed[: len(packed) // 2])
    good, row = damage_of(other)
    assert len(good) > 10_000 and "bzip2" in row[3]
    assert list(G._range_rows(f"file://{tmp_path}/none.pgn", 0, 9))[0][3].startswith("FileNotFoundError")


def test_records_of_all_files(spark, tmp_path):
    some, windows = games(3000), games(3000, "\r\n")
    (tmp_path / "a.pgn").write_bytes(corpus_of(some))
    (tmp_path / "b.PGN").write_bytes(b"\xef\xbb\xbf" + corpus_of(windows, "\r\n"))
    (tmp_path / "c.pgn.gz").write_bytes(gzip.compress(corpus_of(some)))
    (tmp_path / "d.pgn.bz2").write_bytes(bz2.compress(corpus_of(some)))
    (tmp_path / "half.pgn.gz").write_bytes(gzip.compress(corpus_of(some))[:9000])
    (tmp_path / "empty.pgn").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("none")
    G.read_records(spark, str(tmp_path), range_bytes=100_000).withColumn("task", F.spark_partition_id()).write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    rows = found.where("damage IS NULL AND file_name != 'half.pgn.gz'").collect()
    for name, want in (("a.pgn", some), ("b.PGN", windows), ("c.pgn.gz", some), ("d.pgn.bz2", some)):
        assert sorted(r.text for r in rows if r.file_name == name) == sorted(g.rstrip("\r\n") for g in want)
    (damage,) = found.where("damage IS NOT NULL").collect()
    assert damage.file_name == "half.pgn.gz" and damage.damaged_at == 9000
    parsed = parse_records(found.where("damage IS NULL"))
    assert parsed.where("error IS NOT NULL OR size(moves) != 2").count() == 0
    ids = {r.record_id for r in found.select("record_id").collect()}
    assert ids == {r.record_id for r in G.read_records(spark, str(tmp_path)).select("record_id").collect()} and len(ids) == found.count()
    # several tasks read the file of the other line ends
    assert found.where("file_name = 'b.PGN'").select("task").distinct().count() > 2
    # the plain reader finds the same records where nothing is damaged
    again = scan_records(spark, str(tmp_path)).where("file_name = 'c.pgn.gz'").select(F.rtrim("text", F.lit("\n")).alias("t"))
    assert again.exceptAll(found.where("file_name = 'c.pgn.gz'").select("text")).isEmpty()


def test_crc_of_each_member_is_checked():
    good = gzip.compress(b"a" * 1000)
    bad = bytearray(good)
    bad[-5] ^= 1
    assert zlib.decompress(good, 31) == b"a" * 1000
    import io

    with pytest.raises(G.Damage):
        list(G._zlib_pieces(io.BytesIO(good + bytes(bad))))


@pytest.mark.parametrize("pack, name", [(gzip.compress, "a.pgn.gz"), (bz2.compress, "a.pgn.bz2")])
def test_members_are_read_side_by_side(spark, tmp_path, pack, name):
    some = games(300)
    whole = corpus_of(some)
    cuts = sorted(R.sample(range(1, len(whole)), 40))
    # also cuts at and inside the borders of records
    cuts += [whole.index(b"\n\n[", k) + d for k, d in zip(range(0, len(whole) // 2, 3000), (0, 1, 2, 3))]
    cuts = sorted(set(cuts))
    path = tmp_path / name
    path.write_bytes(b"".join(pack(whole[a:b]) for a, b in zip([0, *cuts], [*cuts, len(whole)])))
    table = list(G._members(f"file://{path}"))
    assert len(table) == len(cuts) + 1 and sum(t[2] for t in table) == len(whole)
    one = list(G._range_rows(f"file://{path}", 0, 1 << 60))
    many = []
    for (start, before, _), (end, _, _) in zip(table, [*table[1:], (1 << 60, b"", 0)]):
        many += G._range_rows(f"file://{path}", start, end, before)
    assert many == one and [r[2].decode() for r in one] == [g.rstrip("\n") for g in some]
    listing = G.list_files(spark, str(tmp_path))
    members = G.member_table(listing)
    found = G.records_of(listing, range_bytes=2000, members=members)
    want = G.records_of(listing).select("record_id", "text", "damage")
    got = found.select("record_id", "text", "damage")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 300
    path.write_bytes(path.read_bytes()[:-30])  # the damage is told once
    listing = G.list_files(spark, str(tmp_path))
    assert G.records_of(listing, range_bytes=2000, members=G.member_table(listing)).where("damage IS NOT NULL").count() == 1
