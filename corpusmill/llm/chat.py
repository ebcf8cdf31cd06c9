"""Operator 6: conversations cut into windows of a token budget, with DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line break. Inside role and text the
backslash, ``<`` and ``#`` are written as ``\\b``, ``\\l`` and ``\\h`` (and ``:`` in a role as ``\\c``), so a
mark of the template cannot occur in them, and every backslash starts exactly one escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Written form of each reserved character; the backslash comes first when writing, last when reading.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
COLON = (":", "\\c")


def escape(text: Column, role: bool = False) -> Column:
    for plain, written in (*ESCAPES, *([COLON] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed((*ESCAPES, COLON)):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def count_tokens(text: Column) -> Column:
    """Words and single marks, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))).cast("long")


def format_windows(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Windows of each conversation: conv_id, window, formatted, n_repeated, loss_spans.

    Prefix sums of the turns' tokens choose the spans. A window repeats the leading system turn and
    up to ``history`` tokens of earlier turns (``n_repeated`` turns in all), then holds
    its own whole turns, in ``budget`` tokens together, the template's marks included, unless the system turn or a single
    turn is larger. A large system turn leaves less room to earlier turns, half of what is left at most.
    ``loss_spans`` (start, length in characters) covers the texts of own assistant turns, so each of
    them is a target once. Rows are ordered by turn, then role and text. Null text and role count as
    empty, null conversation ids are one conversation, null turns come first, rows that repeat are
    turns of their own. Other columns are ignored; an empty table has no windows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    written = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns(
        {
            "head": F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MIDDLE)),
            "body": escape(F.col("text")),
        }
    )
    rows = written.withColumn("string", F.concat("head", "body", F.lit(CLOSE))).withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("tokens", count_tokens(F.col("string")))
    rows = rows.withColumn("leading", (F.col("pos") == 1) & (F.col("role") == "system"))
    led = F.first(F.when(F.col("leading"), F.col("string")), ignorenulls=False)
    led_tokens = F.first(F.when(F.col("leading"), F.col("tokens")).otherwise(F.lit(0)))
    own = F.when(F.col("leading"), F.lit(0)).otherwise(F.col("tokens"))
    rows = rows.withColumns(
        {
            "system": F.coalesce(led.over(upto), F.lit("")),
            "free": F.greatest(F.lit(budget) - led_tokens.over(upto), F.lit(0)),
            "end": F.sum(own).over(upto),
            "chars": F.sum(F.length("string")).over(upto) - F.length("string"),
        }
    ).withColumn("start", F.col("end") - own)
    past = F.least(F.lit(history), F.floor(F.col("free") / 2))
    rows = rows.withColumns({"past": past, "room": F.greatest(F.col("free") - past, F.lit(1))})
    # whole turns within one block of tokens form a span, a turn across a border is one of its own
    block = F.floor(F.col("start") / F.col("room"))
    last = F.floor((F.col("end") - 1) / F.col("room"))
    rows = rows.withColumns({"block": block, "crosses": (block != last) & ~F.col("leading")})
    fresh_start = (
        (F.col("block") != F.lag("block").over(order)) | F.col("crosses") | F.lag("crosses").over(order)
    ) & ~F.coalesce(F.lag("leading").over(order), F.lit(False))
    rows = rows.withColumn("window", F.sum(F.coalesce(fresh_start, F.lit(False)).cast("long")).over(upto))
    # a turn has one token at least, so this frame holds few rows; the system turn is at -1
    by_tokens = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-history, -1)
    rows = rows.withColumn("at", F.when(F.col("leading"), F.lit(-(2**40))).otherwise(F.col("start")))
    near = F.collect_list(F.struct("pos", "string", "at")).over(by_tokens)
    rows = rows.withColumn("before", F.filter(near, lambda t: t["at"] >= F.col("at") - F.col("past")))
    windows = rows.groupBy("conv_id", "window").agg(
        F.min_by(F.struct("system", "before", "chars"), F.when(~F.col("leading"), F.col("pos"))).alias("opens"),
        F.bool_or("leading").alias("with_system"),
        F.first("system").alias("system"),
        F.array_sort(
            F.collect_list(
                F.when(
                    ~F.col("leading"),
                    F.struct("pos", "string", "chars", F.length("head").alias("head"), F.length("body").alias("body"), "role"),
                )
            )
        ).alias("own"),
    )
    past = F.transform(F.array_sort(F.coalesce(F.col("opens.before"), F.array().cast("array<struct<pos:int,string:string,at:bigint>>"))), lambda t: t["string"])
    prefix = F.concat("system", F.array_join(past, ""))
    windows = windows.withColumns({"prefix": prefix, "n_past": F.size(past)})
    base = F.length("prefix") - F.coalesce(F.col("opens.chars"), F.lit(0))
    spans = F.transform(
        F.filter("own", lambda t: t["role"] == "assistant"),
        lambda t: F.struct((base + t["chars"] + t["head"]).cast("int").alias("start"), t["body"].alias("length")),
    )
    return windows.select(
        "conv_id",
        "window",
        F.concat("prefix", F.array_join(F.transform("own", lambda t: t["string"]), "")).alias("formatted"),
        (F.col("n_past") + ((F.col("system") != "") & ~F.col("with_system")).cast("int")).alias("n_repeated"),
        spans.alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Own turns (array of role, text) and target texts of each window, read from its string alone."""
    pieces = F.split("formatted", r"</turn>\n")
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def parse(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(piece, at + len(MIDDLE), F.length(piece))).alias("text"),
        )

    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.withColumns({"turns": F.transform(pieces, parse), "targets": targets})


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation: number and digest of the turns, length and digest of the target text, size."""
    read = read_windows(windows).select(
        "conv_id",
        F.size("turns").alias("n"),
        F.length("formatted").alias("chars"),
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("targets"),
        ).alias("part"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    turns = F.array_join(F.transform("parts", lambda p: p["turns"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["targets"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
