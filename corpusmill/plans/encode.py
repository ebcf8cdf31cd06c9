"""Records → one row per position → shuffled chunks and a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import board as B
from ..functions import moves as M
from ..functions.conform import POSITION_SCHEMA, conform
from ..functions.outcome import outcome_for_mover
from ..functions.text import RESULTS, header, parse_headers, record_id
from ..operators.groups import HOT_ROWS
from ..operators.integrity import assert_same
from ..operators.quality import keeps
from ..operators.replay import replay_games
from ..operators.sequence import prior_occurrences, sequence_targets
from ..session import materialize, path_exists
from ..sources.records import parse_records
from ..sources.sinks import manifest_row, write_chunks, write_manifest

GAME_COLUMNS = ["game_id", "split", "source", "result"]


def told_games(records: DataFrame, rules="encoder") -> DataFrame:
    """Every labelled record with its ``fate``: selected, filtered or quarantined, and the ``reason`` of the last.

    Header rules come first: they are cheap and spare rejected games the movetext work.
    """
    unread = F.col("unread") if "unread" in records.columns else F.lit(None).cast("string")
    rated = records.withColumns({"__unread": unread, "headers": parse_headers("text")}).withColumn("__passes", keeps(rules))
    parsed = parse_records(rated.withColumn("__text", F.when(F.col("__passes"), F.col("text"))), "__text")
    reason = F.coalesce("__unread", F.when(F.col("__passes"), F.col("error")))
    playable = F.col("__passes") & F.col("result").isin(*RESULTS) & (F.size("moves") > 0)
    fate = F.when(reason.isNotNull(), "quarantined").when(playable, "selected").otherwise("filtered")
    told = parsed.withColumns({"reason": reason, "fate": fate})
    # a file may repeat a game, so the record number is part of the key
    key = F.concat_ws("#", record_id("path", "headers"), F.col("record_id").cast("string"))
    return told.select(
        key.alias("game_id"), "split", "source", "result", "moves",
        header("headers", "FEN").alias("fen"), header("headers", "Variant").alias("variant"),
        "fate", "reason", "path", F.when(F.col("fate") == "quarantined", F.col("text")).alias("text"),
    )


def select_games(records: DataFrame, rules="encoder") -> DataFrame:
    """Playable games of labelled records. All filters stand before the replay."""
    return told_games(records, rules).where("fate = 'selected'").drop("fate", "reason", "path", "text")


def spread(games: DataFrame, key: str = "game_id") -> DataFrame:
    """Games over all tasks before the costly step: a gzip file arrives as a single one.

    The explicit number keeps the small rows of games from being merged into few tasks.
    """
    partitions = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return games.repartition(partitions, key)


def replay_selected(games: DataFrame, carry=GAME_COLUMNS) -> DataFrame:
    """One row per ply, and one row with an error per game that cannot be played."""
    return replay_games(games, carry, "moves", "fen", "variant")


def failed_games(plies: DataFrame, carry=GAME_COLUMNS) -> DataFrame:
    return plies.where(F.col("error").isNotNull()).select(*carry, "error")


def numbered_plies(moves: DataFrame, order: Sequence[str], game: Sequence[str] = ("game_id",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """A ply table from rows of positions, in the form that the replay gives, by windows only.

    ``moves`` has a row per ply: fen, move_from, move_to, promotion, legal (packed moves), result, is_960 and more. Added are
    ``ply, total_plys, rep_count`` and an empty ``error``; a position recurs if board, side, castling and
    en passant do. Games of any length are split where they are hot.
    """
    game, order = list(game), list(order)
    numbered = sequence_targets(moves, game, order, hot_rows=hot_rows).drop("ply_target")
    stated = numbered.withColumn("__state", F.array_join(F.slice(F.split("fen", " "), 1, 4), " "))
    counted = prior_occurrences(stated, game, ["__state"], order, hot_rows)
    return counted.drop("__state", "rep_count_ge1", "rep_count_ge2").withColumn("error", F.lit(None).cast("string"))


def encode_positions(plies: DataFrame, cap: int = 512) -> DataFrame:
    """The position table. Ply numbers and repetitions come from the replay, where a game
    is still one row, so no exchange is needed; all else is native over the position string.
    """
    ok = plies.where(F.col("error").isNull())
    white = B.white_to_move("fen")
    balance = B.material_balance(B.fen_field("fen", 1))
    left = F.greatest(F.lit(0), F.col("total_plys") - (F.col("ply") + 1))
    featured = ok.withColumns(
        {
            "bitboards": B.board_planes("fen"),
            "policy_target": M.policy_index("move_from", "move_to", F.col("promotion")),
            "legal_mask": M.legal_mask("legal"),
            "material_raw": balance,
            "material_category": B.material_category(balance),
            "value_target": outcome_for_mover("result", white),
            "ply_target": F.least(left, F.lit(cap)),
            "total_plys_in_game": F.col("total_plys"),
            "is_960_game": F.col("is_960"),
            "side_to_move": white,
            "rep_count_ge1": F.col("rep_count") >= 1,
            "rep_count_ge2": F.col("rep_count") >= 2,
        }
    )
    return conform(featured, POSITION_SCHEMA, ["game_id", "ply", "split"])


def job_counts(told: DataFrame, plies: DataFrame) -> dict[str, int]:
    """Games read, and what became of them; the last four add up to the first."""
    read = told.agg(F.count(F.lit(1)), F.count_if(F.col("fate") == "filtered"), F.count_if(F.col("fate") == "quarantined")).first()
    played = plies.agg(F.count_if(F.col("error").isNull() & (F.col("ply") == 0)), F.count_if(F.col("error").isNotNull())).first()
    names = ("games_read", "games_filtered", "games_quarantined", "games_encoded", "games_unplayable")
    return dict(zip(names, (*read, *played)))


def encode_corpus(
    records: DataFrame, out: str, size: int = 8192, seed: int = 2024, shuffle: bool = True, rules="encoder", resume_from: str | None = None,
    verify: bool = False,
) -> DataFrame:
    """Write shuffled chunks and the manifest; returns the manifest row, with the job's counts of games.

    The records are read and parsed once. ``quarantine`` holds the games that can't be played, and the records that can't be
    parsed with their text. With ``resume_from`` the two intermediate tables go to that folder, and a later
    call continues from those that are finished. ``verify`` reads the chunks again and compares them with the
    encoded positions.
    """
    spark = records.sparkSession

    def step(make, name: str) -> DataFrame:
        if resume_from is None:
            return materialize(make(), name)
        path = f"{resume_from}/{name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    told = step(lambda: told_games(records, rules), "games")
    # written once, because chunking reads its input twice: keys to count, rows to place
    plies = step(lambda: replay_selected(spread(told.where("fate = 'selected'"))), "plies")
    positions = encode_positions(plies)
    write_chunks(positions, f"{out}/chunks", size, ("game_id", "ply"), seed, shuffle=shuffle)
    written = spark.read.parquet(f"{out}/chunks")
    if verify:
        assert_same(positions, written.select(*[F.col(c).cast(positions.schema[c].dataType).alias(c) for c in positions.columns]))
    bad = told.where("fate = 'quarantined'").select("path", "split", "source", "text", F.col("reason").alias("error"))
    failed_games(plies).unionByName(bad, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}/quarantine")
    params = {"chunk_size": size, "seed": seed, "final_shuffle_skipped": not shuffle}
    row = manifest_row(written, params={**params, **job_counts(told, plies)})
    write_manifest(row, f"{out}/manifest")
    return row
