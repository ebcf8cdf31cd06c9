"""Game-record text: header tags, movetext, canonical form and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .losses import let

# Fixed values of the record format.
HEADER_LINE = r'(?m)^[ \t]*\[([A-Za-z0-9][A-Za-z0-9_+#=:-]*)[ \t]+"([^\r\n]*)"[ \t]*\][ \t]*\r?$'
RESULTS = ["1-0", "0-1", "1/2-1/2"]
ID_FIELDS = [
    ("Site", "UnknownSite"),
    ("Date", "UnknownDate"),
    ("Round", "?"),
    ("White", "UnknownWhite"),
    ("Black", "UnknownBlack"),
    ("Result", "*"),
]
# Comments and annotations. The look-ahead passes over plain text quickly.
COMMENTS = r"(?m)(?=[{;%$!?])(?:\{[^}]*\}|;[^\n]*$|^%[^\n]*$|\$\d+|[!?]+)"
MOVE_NUMBERS = r"(?=\d)(?<!\S)\d+\.+"
ESCAPES = [("\0", "\0a"), ("\ufffd", "\0b")]


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def decode(raw, errors: str = "replace") -> Column:
    """Text with undecodable bytes as U+FFFD (``replace``) or dropped (``ignore``)."""
    if errors not in ("replace", "ignore"):
        raise ValueError("errors is 'replace' or 'ignore'")
    if errors == "replace":
        return F.make_valid_utf8(_col(raw))
    # a U+FFFD that the source holds is written with an escape while the marks of bad bytes are dropped
    text = _col(raw).cast("string")
    for old, new in ESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    for old, new in reversed(ESCAPES):
        text = F.replace(text, F.lit(new), F.lit(old))
    return text


def unify_newlines(text) -> Column:
    return F.replace(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _opens_with_header(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\r\n")).startswith("[")


def header_block(text) -> Column:
    """Everything before the first blank line, nothing when no header opens the text."""
    block = F.regexp_extract(_col(text), r"(?s)\A\s*(.*?)(?:\r?\n[ \t]*\r?\n|\z)", 1)
    return F.when(_opens_with_header(_col(text)), block).otherwise(F.lit(""))


def movetext_block(text) -> Column:
    """Everything after the first blank line; the whole text when no header opens it."""
    body = F.regexp_extract(_col(text), r"(?s)\A\s*.*?\r?\n[ \t]*\r?\n(.*)\z", 1)
    return F.when(_opens_with_header(_col(text)), body).otherwise(_col(text))


def parse_headers(text) -> Column:
    """Header tags as a map; the last of repeated tags wins."""
    block = header_block(text)
    tags = F.struct(
        F.regexp_extract_all(block, F.lit(HEADER_LINE), F.lit(1)).alias("k"),
        F.regexp_extract_all(block, F.lit(HEADER_LINE), F.lit(2)).alias("v"),
    )

    def last_of_each(t: Column) -> Column:
        entries = F.zip_with(t["k"], t["v"], lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        return F.filter(entries, lambda e, i: ~F.array_contains(F.slice(t["k"], i + 2, F.size(t["k"])), e["k"]))

    return F.map_from_entries(
        F.transform(let(tags, last_of_each), lambda e: F.struct(e["k"], F.regexp_replace(e["v"], r'\\(["\\])', "$1")))
    )


def header(headers, name: str, default: str | None = None) -> Column:
    """One header value, or the default when absent."""
    value = F.element_at(_col(headers), name)
    return value if default is None else F.coalesce(value, F.lit(default))


def header_int(headers, name: str, default: int = 0) -> Column:
    """A header as an integer: the default when absent, NULL when not a number."""
    value = F.element_at(_col(headers), name)
    return F.when(value.isNull(), F.lit(default)).otherwise(F.trim(value).try_cast("int"))


def record_id(path, headers) -> Column:
    """Path and six header fields, blanks as underscores. Not unique when a file repeats a game."""
    fields = [_col(path), *[header(headers, name, default) for name, default in ID_FIELDS]]
    return F.concat_ws("_", *[F.replace(f, F.lit(" "), F.lit("_")) for f in fields])


def _without_variations(text: Column) -> Column:
    """One pass over the pieces between parentheses, whatever the depth; unbalanced text is left as it is."""

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.startswith("("), piece.startswith(")")
        depth = state["depth"] + opens.cast("int") - closes.cast("int")
        plain = F.when(closes, F.concat(F.lit(" "), F.substring(piece, F.lit(2), F.length(piece)))).otherwise(piece)
        return F.struct(
            depth.alias("depth"),
            F.least(state["low"], depth).alias("low"),
            F.when(depth == 0, F.concat(state["out"], plain)).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"), F.lit("").alias("out"))
    whole = lambda s: F.when((s["depth"] == 0) & (s["low"] == 0), s["out"])
    return F.coalesce(F.aggregate(F.split(text, r"(?=[()])"), start, step, whole), text)


def strip_movetext(movetext) -> Column:
    """Movetext without comments, annotations, variations and move numbers.

    Unbalanced variations leave a parenthesis behind.
    """
    text = F.regexp_replace(_col(movetext), COMMENTS, " ")
    text = let(text, lambda t: F.when(t.contains("("), _without_variations(t)).otherwise(t))
    # blanks unified once, so that the splits below take the fast single-character path
    return F.trim(F.regexp_replace(F.regexp_replace(text, MOVE_NUMBERS, " "), r"\s+", " "))


def plain_tokens(plain) -> Column:
    """Mainline move tokens of stripped movetext, the closing result removed."""
    return F.filter(F.split(_col(plain), " "), lambda t: (t != "") & ~t.isin(*RESULTS, "*"))


def plain_result(plain) -> Column:
    """The result that closes stripped movetext, or NULL."""
    found = F.filter(F.split(_col(plain), " "), lambda t: t.isin(*RESULTS, "*"))
    return F.try_element_at(found, F.lit(-1))


def movetext_tokens(movetext) -> Column:
    return plain_tokens(strip_movetext(movetext))


def movetext_result(movetext) -> Column:
    return plain_result(strip_movetext(movetext))


def canonical_text(text) -> Column:
    """Headers in source order, a blank line, then movetext with blanks and line ends unified."""
    clean = unify_newlines(text)
    block = header_block(clean)
    keys = F.regexp_extract_all(block, F.lit(HEADER_LINE), F.lit(1))
    values = F.regexp_extract_all(block, F.lit(HEADER_LINE), F.lit(2))
    lines = F.zip_with(keys, values, lambda k, v: F.concat(F.lit("["), k, F.lit(' "'), v, F.lit('"]')))
    moves = F.regexp_replace(F.regexp_replace(movetext_block(clean), r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    moves = F.regexp_replace(moves, r"\A\s+|\s+\z", "")
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), moves, F.lit("\n"))
