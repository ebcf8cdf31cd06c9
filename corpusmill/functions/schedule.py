"""Weights that change with the step."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    start_weight: float
    end_weight: float
    duration_steps: int
    start_step: int = 0
    kind: str = "linear"
    decay_rate: float = 0.1
    # "reference" keeps the published formulas, whose cosine and exponential forms run
    # from end to start between the plateaus; "monotone" runs from start to end
    variant: str = "monotone"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scheduled_weight(step, spec: Schedule) -> Column:
    step = _col(step)
    first, last = F.lit(float(spec.start_weight)), F.lit(float(spec.end_weight))
    progress = (step - spec.start_step).cast("double") / float(spec.duration_steps)
    if spec.kind == "cosine":
        share = 0.5 * (1.0 + F.cos(F.lit(math.pi) * (1.0 - progress)))
        between = last + share * (first - last) if spec.variant == "reference" else first + share * (last - first)
    elif spec.kind == "exponential":
        decayed = F.exp(-10.0 * spec.decay_rate * progress)
        if spec.variant == "reference":
            share = decayed
        else:
            share = (1.0 - decayed) / (1.0 - math.exp(-10.0 * spec.decay_rate))
        between = first + share * (last - first)
    else:
        between = first + progress * (last - first)
    return (
        F.when(step <= spec.start_step, first)
        .when(step >= spec.start_step + spec.duration_steps, last)
        .otherwise(between)
    )


def schedule_phase(step, spec: Schedule) -> Column:
    """pre, active or post."""
    step = _col(step)
    return (
        F.when(step <= spec.start_step, "pre")
        .when(step >= spec.start_step + spec.duration_steps, "post")
        .otherwise("active")
    )


def scheduled_weights(
    step, static: Mapping[str, float], schedules: Mapping[str, Mapping[str, object]], steps: int, variant: str = "monotone"
) -> dict[str, Column]:
    """A weight per name of ``static`` at each step: scheduled where ``schedules`` has an entry, else as it is.

    What an entry leaves open is filled in: both weights with the static one, the duration with all ``steps``. Entries
    for other names are passed over.
    """

    def weight(name: str, value: float) -> Column:
        if name not in schedules:
            return F.lit(float(value))
        whole = {"start_weight": value, "end_weight": value, "duration_steps": steps, "variant": variant, **schedules[name]}
        return scheduled_weight(step, Schedule(**whole))

    return {name: weight(name, value) for name, value in static.items()}
