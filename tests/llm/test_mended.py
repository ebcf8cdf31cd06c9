"""Cases that once failed: long runs of digits, large system turns, archives of several splits."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat, private, warc

R = random.Random(23)


def test_long_runs_of_separated_digits(spark):
    text = " ".join(R.choice("0123456789") for _ in range(30_000))
    card = "4111 1111 1111 1111"
    rows = [(1, text, "mine", "also"), (2, f"pay {card} now", "x", "y"), (2, f"pay {card} now", "x", "y")]
    table = spark.createDataFrame(rows, "id int, text string, found string, new string")
    private.pseudonymise(table.where("id = 2"), "k").collect()  # code is compiled
    start = time.perf_counter()
    got = private.pseudonymise(table, "k").collect()
    assert time.perf_counter() - start < 60  # a step that copies all before it takes many minutes
    assert all(r["found"] == o[2] and r["new"] == o[3] for r, o in zip(sorted(got, key=lambda r: r["id"]), rows))
    long = next(r for r in got if r["id"] == 1)
    assert len(long["text"]) == len(text) and re.sub(r"\d", "0", long["text"]) == re.sub(r"\d", "0", text)
    assert long["n_private"] > 500


def test_blocks_of_groups_do_not_matter(spark, monkeypatch):
    texts = [" ".join(R.choice("0123456789") * R.randint(1, 3) for _ in range(n)) for n in (13, 40, 255, 256, 257, 700)]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    seen = []
    for size in (1, 7, 256, 100_000):
        monkeypatch.setattr(private, "GROUPS", size)
        seen.append([r["text"] for r in private.pseudonymise(table, "k", found=None).collect()])
    assert all(s == seen[0] for s in seen)


def test_a_day_has_one_pseudonym(spark):
    table = spark.createDataFrame([("1984-02-29",), ("29/02/1984",)], "text string")
    iso, slashed = [r["text"] for r in private.pseudonymise(table, "k", found=None).collect()]
    assert iso == "-".join(reversed(slashed.split("/"))) != "1984-02-29"


def tokens(text: str) -> int:
    return len(re.findall(r"\w+|[^\w\s]", text))


@pytest.mark.parametrize("system", [0, 50, 380, 450, 505, 600])
def test_windows_keep_within_the_budget(spark, system):
    words = lambda n: " ".join("w" * R.randint(1, 5) for _ in range(n))
    rows = [(1, 0, "system", words(system))] if system else []
    rows += [(1, k + 1, ("user", "assistant")[k % 2], words(R.randint(1, 30))) for k in range(80)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(table, budget=512, history=128)
    found = windows.collect()
    lead = tokens(f"### system: {rows[0][3]}</turn>") if system else 0
    for r in found:
        own = r["formatted"].count("</turn>\n") - r["n_repeated"]
        assert tokens(r["formatted"]) <= 512 or own == 1 or lead >= 512
    got = chat.digest_windows(windows).first()
    assert got["n_turns"] == len(rows)


def test_archives_of_several_splits(spark, tmp_path):
    pages = [(k, f"http://a/{k}", "x\n\r\n\r\n" * R.randint(0, 400)) for k in range(400)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    arcs = [r["a"] for r in table.select(warc.arc_record(F.col("url"), F.col("html"), F.col("page_id") % 2 + 1).alias("a")).collect()]
    (tmp_path / "arc").mkdir()
    for part in range(2):
        (tmp_path / "arc" / f"{part}.arc").write_bytes("".join(arcs[part::2]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [warc.parse_arc(bytes(r["arc"])) for r in warc.read_arc(spark, str(tmp_path / "arc")).collect()]
        in_order = lambda records: sorted(records, key=lambda r: r[0]["url"])
        assert in_order(got) == in_order(warc.parse_arc(a.encode()) for a in arcs)
        path = warc.archive_pages(table)
        (tmp_path / "warc").mkdir()
        import glob
        import gzip

        whole = [gzip.open(name).read() for name in sorted(glob.glob(f"{path.removeprefix('file:')}/*.gz"))]
        for k, data in enumerate(whole):  # the same archives, unpacked
            (tmp_path / "warc" / f"{k}.warc").write_bytes(data)
        read = lambda p: sorted((r["source_id"], r["record_type"], bytes(r["payload"])) for r in warc.read_warc(spark, p).collect())
        assert read(str(tmp_path / "warc")) == read(path) and len(read(path)) == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_revisits_name_their_record():
    arc = b"http://b/ 0.0.0.0 20240101000000 text/html 2\nhi"
    record = warc.to_warc(arc, 7, 3, "http://a/").decode()
    first = warc.to_warc(b"http://a/ 0.0.0.0 20240101000000 text/html 2\nhi", 3, 3).decode()
    named = re.search("WARC-Record-ID: (.*)\r", first)[1]
    assert f"WARC-Refers-To: {named}\r" in record and "WARC-Type: revisit" in record and "Refers-To" not in first
