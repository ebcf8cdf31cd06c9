"""What Parquet files say about themselves, read on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .archives import _open

FOOTER = "path string, modified bigint, bytes bigint, rows bigint, names array<string>, types array<string>, problem string"
#: Most tasks that files are dealt to; each then reads the footers of several.
TASKS = 20_000
FILES_PER_TASK = 200


def _footer(path: str) -> tuple:
    """(rows, names, types, problem) of one file."""
    import pyarrow.parquet as pq

    try:
        with _open(path) as handle:
            found = pq.read_metadata(handle)
            schema = found.schema.to_arrow_schema()
        return found.num_rows, schema.names, [str(t) for t in schema.types], None
    except Exception as problem:  # one unreadable file must not stop the others
        return None, None, None, f"{type(problem).__name__}: {problem}"[:500]


def read_footers(listing: DataFrame) -> DataFrame:
    """``listing`` (path, modified, bytes) with ``rows``, ``names`` and ``types`` of the top-level columns, and ``problem``.

    Only footers are read, many tasks side by side. A file without a readable footer has null
    figures and its ``problem``.
    """
    ship_package(listing.sparkSession)
    names = [c.split()[0] for c in FOOTER.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*key, *_footer(key[0])) for key in batch[["path", "modified", "bytes"]].itertuples(index=False)]
            yield pd.DataFrame(found, columns=names).astype({"rows": "Int64"})

    tasks = max(1, min(TASKS, -(-listing.count() // FILES_PER_TASK)))
    # times go through pandas as numbers: no time zone can shift them
    plain = listing.select("path", F.unix_micros("modified").alias("modified"), "bytes")
    found = plain.repartition(tasks, "path").mapInPandas(rows, FOOTER)
    return found.withColumn("modified", F.timestamp_micros("modified"))


def lacking(footers: DataFrame, columns: list[str]) -> DataFrame:
    """``footers`` with ``missing``, those of ``columns`` that a file has not; null for an unreadable one."""
    return footers.withColumn("missing", F.array_except(F.array(*map(F.lit, columns)), F.col("names")))
