"""Quality rules as data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RESULTS


@dataclass(frozen=True)
class Rule:
    field: str
    op: str  # at_least, equals, equals_lower, one_of, matches
    value: object


# Fixed values of the two published filters.
STRICT = (
    Rule("WhiteElo", "at_least", 1800),
    Rule("BlackElo", "at_least", 1800),
    Rule("Termination", "equals", "Normal"),
    Rule("Event", "matches", "(?i)Rated (?:Classical|Blitz) game"),
)
ENCODER = (
    Rule("WhiteElo", "at_least", 1800),
    Rule("BlackElo", "at_least", 1800),
    Rule("Termination", "equals_lower", "normal"),
    Rule("Event", "one_of", ("Rated Blitz game", "Rated Classical game")),
)
RULE_SETS = {"strict": STRICT, "encoder": ENCODER}


def _holds(rule: Rule, value: Column) -> Column:
    if rule.op == "at_least":
        # absent counts as 0; text that is no number rejects the row
        number = F.when(value.isNull(), F.lit(0)).otherwise(F.trim(value).try_cast("int"))
        test = number >= rule.value
    else:
        text = F.coalesce(value, F.lit(""))
        if rule.op == "equals":
            test = text == rule.value
        elif rule.op == "equals_lower":
            test = F.lower(text) == rule.value
        elif rule.op == "one_of":
            test = text.isin(*rule.value)
        elif rule.op == "matches":
            test = text.rlike(rf"\A(?:{rule.value})\z")
        else:
            raise ValueError(f"unknown rule {rule.op}")
    return F.coalesce(test, F.lit(False))


def passes(rules: Sequence[Rule], field: Callable[[str], Column]) -> Column:
    """All rules hold."""
    return reduce(lambda a, b: a & b, [_holds(rule, field(rule.field)) for rule in rules])


def keeps(
    rules: Sequence[Rule] | str = "strict",
    source: str | None = "lichess",
    headers: str = "headers",
    field: Callable[[str], Column] | None = None,
) -> Column:
    """Whether a row passes; with ``source`` the rules bind only that source's rows."""
    rules = RULE_SETS[rules] if isinstance(rules, str) else rules
    field = field or (lambda name: F.element_at(F.col(headers), name))
    keep = passes(rules, field)
    return keep if source is None else keep | ~F.col("source").eqNullSafe(F.lit(source))


def quality_filter(df: DataFrame, *args, **options) -> DataFrame:
    """Only rows that pass; arguments as for ``keeps``."""
    return df.where(keeps(*args, **options))


def with_result(df: DataFrame, result: str = "result") -> DataFrame:
    """Only decided games and draws."""
    return df.where(F.col(result).isin(*RESULTS))


def with_moves(df: DataFrame, moves: str = "moves") -> DataFrame:
    return df.where(F.size(moves) > 0)
