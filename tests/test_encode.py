"""The four games through the encoder, against hand-worked expectations."""

import json

import pytest
from games import LC0, LICHESS, rated
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusmill.functions import board as B
from corpusmill.functions import moves as M
from corpusmill.functions.conform import TRAIN_SCHEMA, conform, source_flags
from corpusmill.operators.integrity import assert_same
from corpusmill.operators.sequence import prior_occurrences, sequence_targets
from corpusmill.plans.encode import encode_corpus, encode_positions, failed_games, replay_selected, select_games
from corpusmill.plans.holdout import holdout_profile
from corpusmill.plans.shard import from_shards, shard_corpus
from corpusmill.sources.chunks import file_manifest, list_chunks, refresh_manifest, same_paths
from corpusmill.sources.records import label_source, label_split, scan_records
from corpusmill.sources.sinks import reshuffle, resume


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    (base / "train").mkdir()
    (base / "train" / "lichess_a.pgn").write_text(LICHESS)
    (base / "train" / "lc0_a.pgn").write_text(LC0)
    return str(base)


@pytest.fixture(scope="module")
def records(spark, raw):
    return label_split(label_source(scan_records(spark, raw)))


@pytest.fixture(scope="module")
def plies(spark, records):
    return replay_selected(select_games(records)).cache()


@pytest.fixture(scope="module")
def positions(plies):
    return encode_positions(plies).cache()


def test_counts_and_targets(positions):
    rows = positions.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("game_id").alias("games"),
        *[F.count_if(F.col("value_target") == v).alias(f"v{v}") for v in range(3)],
        F.min("material_raw").alias("lo"), F.max("material_raw").alias("hi"), F.max("material_category").alias("cat"),
    ).collect()
    found = {r.source: (r.n, r.games, r.v0, r.v1, r.v2, r.lo, r.hi, r.cat) for r in rows}
    assert found == {"lichess": (40, 2, 20, 0, 20, -3, 3, 8), "lc0": (36, 2, 10, 16, 10, -1, 3, 8)}


def test_first_game(positions):
    game = positions.where(F.col("game_id").contains("club/open")).orderBy("ply").collect()
    assert [r.ply_target for r in game] == list(range(19, -1, -1))
    assert {r.total_plys_in_game for r in game} == {20}
    assert [r.side_to_move for r in game] == [True, False] * 10
    # e2e4: two squares north from 12; 20 legal moves at the start
    assert game[0].policy_target == 1 * 64 + 12 and len(game[0].legal_mask) == 20
    assert not any(r.rep_count_ge1 or r.is_960_game for r in game)
    assert all(r.policy_target in r.legal_mask for r in game)
    # all four castling rights until white castles at ply 10
    assert [b for b in game[0].bitboards if b >= 768] == [768, 775, 824, 831]
    assert [b for b in game[11].bitboards if b >= 768] == [824, 831]
    assert 13 * 64 + 20 in game[1].bitboards


def test_schema(positions):
    trained = conform(positions, TRAIN_SCHEMA)
    assert dict(trained.dtypes)["value_target"] == "bigint" and dict(trained.dtypes)["ply_target"] == "smallint"
    flags = source_flags(positions).select((F.col("is_lichess_game") != F.col("is_lc0_game")).alias("x"))
    assert flags.distinct().collect() == [(True,)]


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        conform(spark.sql("SELECT 40000 AS ply_target"), {"ply_target": "smallint"}).collect()


def test_replay_agrees_with_windows(plies):
    ok = plies.select("game_id", "ply", "total_plys", "rep_count", "fen")
    counted = prior_occurrences(ok.withColumnRenamed("rep_count", "r"), ["game_id"], ["fen"], ["ply"])
    assert counted.where(F.col("r") != F.col("rep_count")).count() == 0
    targets = sequence_targets(ok.withColumnRenamed("ply", "p").withColumnRenamed("total_plys", "t"), ["game_id"], ["p"])
    assert targets.where((F.col("p") != F.col("ply")) | (F.col("t") != F.col("total_plys"))).count() == 0


def test_bad_games_are_set_aside(spark):
    cases = [
        ("a", "Nf3 Nf6 Ng1 Ng8 Nf3 Nf6 Ng1 Ng8 Nf3", None, None), ("b", "e4 e5 Ke3", None, None), ("c", "e4", None, "Crazyhouse"),
        ("d", "O-O", "4k3/8/8/8/8/8/8/4K1R1 w G - 0 1", "Chess960"), ("e", "e4", "bad fen", None), ("f", "e4 --", None, None),
    ]
    games = spark.createDataFrame(cases, "game_id string, m string, fen string, variant string").select(
        "game_id", F.lit("train").alias("split"), F.lit("lc0").alias("source"), F.lit("1-0").alias("result"),
        F.split("m", " ").alias("moves"), "fen", "variant",
    )
    plies = replay_selected(games)
    assert sorted(r.game_id for r in failed_games(plies).collect()) == ["b", "c", "e"]
    rows = encode_positions(plies).orderBy("game_id", "ply").collect()
    seen = [(r.rep_count_ge1, r.rep_count_ge2) for r in rows if r.game_id == "a"]
    assert seen == [(False, False)] * 4 + [(True, False)] * 4 + [(True, True)]
    castled = [r for r in rows if r.game_id == "d"][0]
    # king takes own rook: two squares east from e1, plane 15
    assert castled.is_960_game and castled.policy_target == 15 * 64 + 4
    assert [r.policy_target for r in rows if r.game_id == "f"][1] is None


def test_plane_facts(spark):
    pairs = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("s"), (F.col("id") % 64).cast("int").alias("t"))
    planes = pairs.select(M.base_plane("s", "t").alias("p"), *[
        M.under_promotion_plane("s", "t", F.lit(x)).alias(x) for x in "nbr"
    ])
    row = planes.agg(
        F.count("p").alias("all"), F.count_if(F.col("p") < 56).alias("rays"), F.count_distinct("p").alias("planes"),
        F.sum(F.col("n").isNotNull().cast("int") + F.col("b").isNotNull().cast("int") + F.col("r").isNotNull().cast("int")).alias("under"),
    ).first()
    assert tuple(row) == (1792, 1456, 64, 132)
    one = spark.range(1).select(M.move_plane(F.lit(52), F.lit(60), F.lit("n")), M.move_plane(F.lit(10), F.lit(1), F.lit("R")))
    assert tuple(one.first()) == (65, 70)


def test_material_extremes(spark):
    boards = [("QQQ5/8/8/8/8/8/8/8", 27, 10), ("8/8/8/8/8/8/8/qk6", -9, 0), ("P7/8/8/8/8/8/8/n7", -2, 3), ("8/8/8/8/8/8/8/8", 0, 5)]
    df = spark.createDataFrame(boards, "p string, raw int, cat int").withColumn("b", B.material_balance("p"))
    assert df.where((F.col("b") != F.col("raw")) | (B.material_category("b") != F.col("cat"))).count() == 0


def test_whole_flow(spark, raw, tmp_path):
    shards = str(tmp_path / "shards")
    seen = Observation()
    totals = shard_corpus(spark, raw, shards, fraction=0.3, seed=1, observation=seen)
    assert seen.get["records"] == 4 and seen.get["chars"] > 1000
    grand = [r for r in totals.collect() if r.level == 3]
    assert grand[0].rows == 4
    again = from_shards(scan_records(spark, shards, endings=(".txt",)))
    assert {r.source for r in again.select("source").collect()} == {"lichess", "lc0"}

    out = str(tmp_path / "tensors")
    row = encode_corpus(again, out, size=16).first().asDict()
    assert sum(v for k, v in row.items() if k.endswith("_positions")) == 76
    (line,) = [p for p in (tmp_path / "tensors" / "manifest").glob("*.json")]
    manifest = json.loads(line.read_text())
    assert manifest["chunk_size"] == 16 and "preprocessing_date" in manifest

    chunks = f"{out}/chunks"
    sizes = file_manifest(spark.read.parquet(chunks)).collect()
    assert sum(r.rows for r in sizes) == 76 and max(r.rows for r in sizes) == 16
    assert sum(v for k, v in row.items() if k.endswith("_chunks")) == len(sizes)

    other = str(tmp_path / "again")
    second = reshuffle(spark, chunks, other, 16, ["game_id", "ply"], 7).first().asDict()
    assert {k: v for k, v in second.items() if "lichess" in k} == {k: v for k, v in row.items() if "lichess" in k}
    a, b = (spark.read.parquet(p).select("game_id", "ply", "row_index") for p in (chunks, other))
    assert a.exceptAll(b).count() > 0

    held, outcome, planes = holdout_profile(spark, chunks, n=1, draws=50, seed=3)
    assert held.count() == 2
    assert [round(sum(r[s] for r in outcome.collect()), 9) for s in ("share_a", "share_b")] == [1.0, 1.0]
    assert planes.count() == 73


def test_write_is_refused_or_checked(spark, tmp_path, positions):
    with pytest.raises(FileNotFoundError):
        resume(spark, str(tmp_path / "nothing"))
    positions.limit(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        resume(spark, str(tmp_path / "empty"))
    moved = positions.withColumn("material_raw", (F.col("material_raw") + 1).cast("tinyint"))
    with pytest.raises(ValueError):
        assert_same(positions, moved)
    # same column sums, values swapped between rows
    a = spark.createDataFrame([(1, 10), (2, 20)], "x int, y int")
    with pytest.raises(ValueError):
        assert_same(a, spark.createDataFrame([(1, 20), (2, 10)], "x int, y int"))


def test_manifest_refresh(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(2).write.parquet(path)
    first = refresh_manifest(spark, path, None)
    first = spark.createDataFrame(first.collect(), first.schema)
    assert sum(r.rows for r in first.collect()) == 100
    unchanged = refresh_manifest(spark, path, first)
    assert same_paths(first, unchanged) and same_paths(first, list_chunks(spark, path))
    spark.range(7).coalesce(1).write.mode("append").parquet(path)
    grown = refresh_manifest(spark, path, first)
    assert sum(r.rows for r in grown.collect()) == 107 and not same_paths(first, grown)


def test_single_game_text(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "lichess.pgn").write_text(rated(moves="1. e4 e5 (1... c5) 2. Nf3 {x} 1-0") + "\n" + rated(moves="1. e4 Ke2 1-0"))
    records = label_split(label_source(scan_records(spark, str(tmp_path))))
    plies = replay_selected(select_games(records))
    assert encode_positions(plies).count() == 3 and failed_games(plies).count() == 1
