"""Reading and parsing records from files of every kind."""

import bz2
import gzip
import io
import tarfile

import pytest
from games import LC0, LICHESS, rated
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.quality import quality_filter, with_moves, with_result
from corpusmill.sources import records as S
from corpusmill.sources.archives import scan_archives


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "lichess_a.pgn").write_text(LICHESS)
    (tmp_path / "deep" / "lc0_b.PGN").write_text(LC0)
    (tmp_path / "deep" / "er" / "c.pgn.gz").write_bytes(gzip.compress(LC0.encode()))
    (tmp_path / "deep" / "d.pgn.bz2").write_bytes(bz2.compress(LICHESS.encode()))
    (tmp_path / "notes.txt").write_text("no games here")
    (tmp_path / "crlf.pgn").write_bytes(LC0.replace("\n", "\r\n").encode())
    (tmp_path / "empty.pgn").write_text("")
    (tmp_path / "broken.pgn.gz").write_bytes(b"not gzip at all")
    return str(tmp_path)


def test_scan_finds_every_record(spark, corpus):
    parsed = S.parse_records(S.scan_records(spark, corpus))
    rows = parsed.select("file_name", F.size("moves").alias("n"), "result", "error").collect()
    assert all(r.error is None for r in rows)
    counts = {}
    for r in rows:
        counts.setdefault(r.file_name, []).append((r.n, r.result))
    two = [(16, "1/2-1/2"), (20, "1-0")]
    lichess = [(20, "0-1"), (20, "1-0")]
    assert {k: sorted(v) for k, v in counts.items()} == {
        "lichess_a.pgn": lichess, "d.pgn.bz2": lichess, "lc0_b.PGN": two, "c.pgn.gz": two, "crlf.pgn": two,
    }


def test_listing_and_unread_files(spark, corpus):
    listing = S.list_files(spark, corpus)
    assert listing.count() == 6  # Spark's file listings leave out empty files
    missing = S.unread_files(listing, S.scan_records(spark, corpus))
    assert sorted(r.file_name for r in missing.collect()) == ["broken.pgn.gz"]


def test_records_survive_file_splits(spark, tmp_path):
    games = [rated(moves=f"{{game {i} {'x' * (i % 90)}}} 1. e4 e5 1-0") for i in range(3000)]
    (tmp_path / "lichess.pgn").write_text("\n".join(games))
    (tmp_path / "lichess.pgn.bz2").write_bytes(bz2.compress("\n".join(games).encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = S.scan_records(spark, str(tmp_path))
        assert scan.rdd.getNumPartitions() > 10
        numbers = S.parse_records(scan).select(
            "file_name", F.regexp_extract("text", r"game (\d+) ", 1).cast("int").alias("i"), F.size("moves").alias("n"),
            F.size("headers").alias("h"),
        )
        rows = numbers.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("lichess.pgn", "lichess.pgn.bz2"):
        assert sorted(r.i for r in rows if r.file_name == name) == list(range(3000))
    assert {(r.n, r.h) for r in rows} == {(2, 5)}


def add(tar, name, data):
    entry = tarfile.TarInfo(name)
    entry.size = len(data)
    tar.addfile(entry, io.BytesIO(data))


@pytest.mark.parametrize("ending,mode", [("tar", "w"), ("tar.gz", "w:gz"), ("tbz2", "w:bz2")])
def test_archives(spark, tmp_path, ending, mode):
    with tarfile.open(tmp_path / f"lichess.{ending}", mode) as tar:
        folder = tarfile.TarInfo("dir.pgn")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        add(tar, "a/one.pgn", LICHESS.encode())
        add(tar, "two.pgn.gz", gzip.compress(LC0.encode()))
        add(tar, "three.pgn.bz2", bz2.compress(LC0.encode()))
        add(tar, "bad.pgn.gz", b"nothing packed")
        add(tar, "readme.md", b"[Event \"no\"]\n\n1. e4 1-0\n")
        add(tar, "last.PGN", rated().encode())
    (tmp_path / f"torn.{ending}").write_bytes(b"garbage")
    rows = scan_archives(spark, str(tmp_path)).collect()
    good = [(r.member, r.record_no) for r in rows if r.error is None]
    assert sorted(good) == [
        ("a/one.pgn", 1), ("a/one.pgn", 2), ("last.PGN", 1), ("three.pgn.bz2", 1), ("three.pgn.bz2", 2), ("two.pgn.gz", 1), ("two.pgn.gz", 2),
    ]
    assert sorted((r.member, r.path.rsplit("/", 1)[-1]) for r in rows if r.error is not None and r.member) == [("bad.pgn.gz", f"lichess.{ending}")]
    assert [r.path.rsplit("/", 1)[-1] for r in rows if r.error is not None and not r.member] == [f"torn.{ending}"]
    assert all(r.text.startswith("[Event") and r.text.rstrip().endswith(("1-0", "0-1", "1/2-1/2")) for r in rows if r.error is None)


def test_undecodable_bytes(spark, tmp_path):
    (tmp_path / "x.pgn").write_bytes(b'[Event "caf\xe9"]\n[Result "1-0"]\n\n1. e4 1-0\n')
    events = {
        errors: S.parse_records(S.scan_records(spark, str(tmp_path), errors=errors)).first().headers["Event"]
        for errors in ("replace", "ignore")
    }
    assert events == {"replace": "caf�", "ignore": "caf"}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_parsing_variants(spark):
    cases = [
        rated(moves="1. e4 {good; (really)} e5 $1 2. Nf3! (2. f4 (2. d4 exd4) exf4) 2... Nc6?! ; rest (\n3. Bb5 1-0"),
        rated(result="*", moves="1. e4 0-1"),
        rated(result="*", moves="*"),
        rated(moves="1-0"),
        rated(moves="1. e4 (1. d4 1-0"),
        "junk",
        rated(extra='\n[Event "later"]'),
        rated(extra='\n[Annotator "a \\"b\\" \\\\c"]'),
        "1. e4 e5 2. d4 *",
    ]
    rows = S.parse_records(frame(spark, cases)).orderBy("i").collect()
    assert rows[0].moves == ["e4", "e5", "Nf3", "Nc6", "Bb5"] and rows[0].error is None
    assert rows[1].result == "0-1"
    assert rows[2].error == "no moves and no result"
    assert rows[3].error is None and rows[3].moves == []
    assert rows[4].error.startswith("unbalanced")
    assert rows[5].moves == ["junk"]
    assert rows[6].headers["Event"] == "later"
    assert rows[7].headers["Annotator"] == 'a "b" \\c'
    assert rows[8].moves == ["e4", "e5", "d4"] and rows[8].result == "*"
    good, bad = S.split_errors(S.parse_records(frame(spark, cases)))
    assert good.count() == 7 and sorted(r.i for r in bad.collect()) == [2, 4]


def nested(depth):
    return "1. e4 " + "(x " * depth + ") " * depth + "1-0"


def test_variation_depth(spark):
    rows = S.parse_records(frame(spark, [rated(moves=nested(8)), rated(moves=nested(9))])).orderBy("i").collect()
    assert rows[0].error is None and rows[0].moves == ["e4"]
    assert rows[1].error is None and rows[1].moves == ["e4"]


QUALITY = [
    (rated(), True, True),
    (rated(white="1799"), False, False),
    (rated(white=None), False, False),
    (rated(black="?"), False, False),
    (rated(event="rated blitz GAME"), True, False),
    (rated(event="Rated Blitz game!"), False, False),
    (rated(termination="normal"), False, True),
    (rated(termination="Time forfeit"), False, False),
    (rated(termination=None), False, False),
    (rated(event="Rated Classical game", white="1800", black="1800"), True, True),
]


def test_quality_rules(spark):
    parsed = S.parse_records(frame(spark, [q[0] for q in QUALITY])).withColumn("source", F.lit("lichess"))
    for rules, place in (("strict", 1), ("encoder", 2)):
        kept = {r.i for r in quality_filter(parsed, rules).collect()}
        assert kept == {i for i, q in enumerate(QUALITY) if q[place]}
    other = parsed.withColumn("source", F.lit("lc0"))
    assert quality_filter(other, "strict").count() == len(QUALITY)


def test_result_and_move_filters(spark):
    parsed = S.parse_records(frame(spark, [rated(), rated(result="2-0"), rated(result="*", moves="1. e4 *"), rated(moves="1-0")]))
    assert {r.i for r in with_moves(with_result(parsed)).collect()} == {0}


def test_labels(spark):
    names = [("Lichess_db.pgn", "/raw/train/x"), ("other.pgn", "/raw/test/x"), ("LC0_1.pgn", "/raw/x")]
    df = S.label_split(spark.createDataFrame(names, "file_name string, path string"))
    df = S.label_source(S.label_source(df), rules=[("lichess", "lichess"), ("lc0", "lc0")], default=None, out="strict")
    assert [(r.source, r.strict, r.split) for r in df.collect()] == [
        ("lichess", "lichess", "train"), ("lc0", None, "test"), ("lc0", "lc0", None),
    ]


def test_canonical_text_is_stable(spark):
    messy = LICHESS.split("\n\n[")[0].replace("\n", "\r\n").replace("e4 e5", "e4   e5") + "\r\n\r\n"
    df = frame(spark, [messy])
    once = df.select(X.canonical_text("text").alias("text"))
    assert once.first().text == LICHESS.split("\n\n[")[0] + "\n"
    assert once.select(X.canonical_text("text")).first()[0] == once.first().text
