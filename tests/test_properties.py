"""Properties over generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import board as B
from corpusmill.functions.hashing import chosen_suffixes
from corpusmill.functions.text import movetext_tokens, parse_headers
from corpusmill.operators.integrity import assert_same
from corpusmill.operators.sampling import global_shuffle
from corpusmill.sources.sinks import with_chunks

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@given(st.floats(0.0005, 0.9995), st.integers(0, 10**6), st.sampled_from([2, 3]))
def test_suffix_sets(fraction, seed, chars):
    chosen = chosen_suffixes(fraction, seed, chars)
    assert len(chosen) == len(set(chosen)) == max(1, round(16**chars * fraction))
    assert all(len(s) == chars for s in chosen) and chosen == chosen_suffixes(fraction, seed, chars)


@few
@given(st.lists(st.lists(st.integers(0, 895), max_size=40, unique=True), min_size=1, max_size=20))
def test_flips_are_their_own_inverse(spark, boards):
    df = spark.createDataFrame([(sorted(b),) for b in boards], "b array<smallint>")
    for kind in ("h", "v", "hv"):
        assert df.where(B.flip(B.flip("b", kind), kind) != F.col("b")).count() == 0
    assert df.where(B.flip(B.flip("b", "h"), "v") != B.flip("b", "hv")).count() == 0
    assert df.where(B.to_sparse(B.to_dense("b", 896)) != F.col("b")).count() == 0


@few
@given(st.integers(1, 400), st.integers(1, 97), st.integers(0, 1000))
def test_chunks_are_exact(spark, rows, size, seed):
    df = spark.range(rows).withColumn("g", F.col("id") % 3)
    chunked = with_chunks(df, size, ["id"], seed, ["g"]).cache()
    counts = chunked.groupBy("g", "chunk_id").count().collect()
    for g in range(3):
        total = (rows - g + 2) // 3
        sizes = [r["count"] for r in sorted(counts, key=lambda r: r.chunk_id) if r.g == g]
        assert sizes == [size] * (total // size) + ([total % size] if total % size else [])
    assert_same(df, chunked.drop("row_index", "chunk_id"))
    assert_same(df, global_shuffle(df, ["id"], seed))


token = st.text("abcdefghKQRBNx12345678=+#-", min_size=1, max_size=6).filter(lambda t: t not in ("1-0", "0-1") and not t.isdigit())
noise = st.sampled_from(["{a comment (with) 1. moves}", "$14", "(a side (line) 2. x)", "; to the end\n", "!?", "\n", "{}"])


@few
@given(st.lists(st.tuples(token, st.lists(noise, max_size=2)), min_size=1, max_size=25))
def test_noise_leaves_the_mainline(spark, plies):
    text = " ".join(f"{i + 1}. {move} {' '.join(extra)}" for i, (move, extra) in enumerate(plies)) + " 1-0"
    row = spark.createDataFrame([(text,)], "t string").select(movetext_tokens("t").alias("m")).first()
    assert row.m == [move for move, _ in plies]


@few
@given(st.lists(st.tuples(st.text("abcXYZ_9", min_size=1, max_size=5), st.text("ab \\\"'[]é", max_size=8)), max_size=12))
def test_headers_round_trip(spark, tags):
    tags = [(k, v) for k, v in tags if not k.startswith("_")]
    escape = lambda v: v.replace("\\", "\\\\").replace('"', '\\"')
    text = "\n".join(f'[{k} "{escape(v)}"]' for k, v in tags) + "\n\n1. e4 1-0\n"
    row = spark.createDataFrame([(text,)], "t string").select(parse_headers("t").alias("h")).first()
    assert row.h == dict(tags)
