"""Risk ladders as one CASE over the rung table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurelens import rules


def ladder(score: Column, variant: str) -> Column:
    rungs, bottom = rules.LADDERS[variant]
    level = None
    for bound, closed, name in rungs:
        hit = score >= bound if closed else score > bound
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return level.otherwise(bottom)


def action(level: Column) -> Column:
    out = None
    for name, act in rules.ACTIONS.items():
        out = F.when(level == name, act) if out is None else out.when(level == name, act)
    return out


def risk_rank(level: Column) -> Column:
    out = None
    for name, rank in rules.RISK_RANK.items():
        out = F.when(level == name, rank) if out is None else out.when(level == name, rank)
    return out.otherwise(4)
