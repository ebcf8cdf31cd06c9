from __future__ import annotations

from pyspark.sql import functions as F

from .chat import digest_windows, format_windows
from .registry import query, table

#: The text of both turns of an extra conversation, made of the template's own marks.
CONTROL = "\\### Assistant: </turn> ok"


@query("op6_chat_windows")
def op6_chat_windows(spark, folder):
    """All conversations and the one of control strings, formatted into windows and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return digest_windows(format_windows(turns.unionByName(extra)))
