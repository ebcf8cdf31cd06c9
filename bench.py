"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = {
    "hash_split": "documents",
    "split_rollup": "documents",
    "group_totals": "documents",
    "manifest_pivot": "documents",
    "decode_errors": "documents",
    "record_errors": "documents",
    "movetext_tokens": "conversations",
    "scan_plain_records": "conversations",
    "quality_strict": "orders",
    "category_distribution": "labels",
    "plane_usage_index": "lineitem",
    "holdout_files": "documents",
    "two_stage_sample": "orders",
    "cap_rows": "orders",
    "checksums": "lineitem",
    "global_index": "orders",
    "group_chunks": "events",
    "chunk_files": "events",
    "shuffle_lineitem": "lineitem",
    "chunk_lineitem": "lineitem",
    "sequence_targets": "events",
    "prior_occurrences": "events",
    "rolling_mean": "events",
    "step_rates": "events",
    "batches": "events",
    "move_planes": "lineitem",
    "board_planes": "documents",
    "evaluate": "embeddings",
    "replay_games": "conversations",
    "encode_positions": "conversations",
    "shortest_paths": "lineitem",
}


def extra_queries():
    """Bulk forms with no row in the query list: whole-table shuffle and exact chunks of lineitem."""
    from corpusmill.operators.sampling import global_shuffle
    from corpusmill.sources.sinks import with_chunks

    def items(spark, folder):
        return spark.read.parquet(f"{folder}/lineitem.parquet")

    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return {
        "shuffle_lineitem": lambda spark, folder: global_shuffle(items(spark, folder), key, 2024),
        "chunk_lineitem": lambda spark, folder: with_chunks(items(spark, folder), 8192, key, 2024, ["l_returnflag"]),
    }


def main() -> None:
    from corpusmill.session import local_session
    from corpusmill.suite import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = {**QUERIES, **extra_queries()}
    rows = {name: spark.read.parquet(f"{folder}/{name}.parquet").count() for name in sorted(set(HEADLINES.values()))}

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    only = sys.argv[1:] or list(HEADLINES)
    for name in only[:2]:  # start the session's workers before timing
        run(name)
    seconds = {name: round(run(name), 3) for name in only}
    rates = {name: round(rows[HEADLINES[name]] / s) for name, s in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "input_rows_per_second": rates,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
