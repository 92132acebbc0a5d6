"""Deterministic scores of agent runs, as column expressions over arrays.

A run has ``tools`` (names in call order), ``required``, ``allowed`` and ``forbidden``
tools, checked arguments, an answer text and judge scores as input columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tool_selection(tools: Column, required: Column, allowed: Column, forbidden: Column) -> Column:
    """0 for a forbidden or unlisted call, else the share of required tools that were called."""
    bad = F.arrays_overlap(tools, forbidden) | (F.size(F.array_except(tools, allowed)) > 0)
    hit = F.size(F.array_intersect(F.array_distinct(required), tools)) / F.nullif(F.size(F.array_distinct(required)), F.lit(0))
    return F.when(F.coalesce(bad, F.lit(False)), 0.0).otherwise(F.coalesce(hit, F.lit(1.0)))


def argument_share(pairs: Column) -> Column:
    """``pairs``: array of (expected, actual); the share that agrees, 1 where nothing is checked."""
    good = F.size(F.filter(pairs, lambda p: p["expected"].eqNullSafe(p["actual"])))
    return F.coalesce(good / F.nullif(F.size(pairs), F.lit(0)), F.lit(1.0))


def efficiency(tools: Column, budget: Column) -> Column:
    """0 for a repeated call, 1 within the budget, a quarter less per call beyond it."""
    n = F.size(tools)
    return F.when(n > F.size(F.array_distinct(tools)), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.25 * F.greatest(F.lit(0), n - budget)))


def in_scope(subjects: Column, scope: Column) -> Column:
    return (~F.exists(subjects, lambda s: s != scope)).cast("double")


def headings(answer: Column, wanted: Sequence[str]) -> Column:
    """The share of ``## Heading`` lines that the answer has."""
    found = [answer.rlike(rf"(?m)^##\s+{h}\s*$").cast("int") for h in wanted]
    return sum(found[1:], found[0]) / float(len(wanted))


def no_match(answer: Column, patterns: Sequence[str]) -> Column:
    """1 where no pattern occurs, whatever the case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | answer.rlike(f"(?i){p}")
    return (~hit).cast("double")


def human_review(answer: Column, needed: Column) -> Column:
    """1 where a decision that needs a person says so, or none is needed."""
    return (~needed | answer.rlike(r"(?i)\bhuman review\b")).cast("double")


def sections(answer: Column) -> Column:
    """Headings of level two and the bullet lines under each, as an array of structs."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), answer), r"\n##\s+"), lambda b: F.trim(b) != "")
    lines = lambda b: F.transform(F.filter(F.split(b, "\n"), lambda x: F.trim(x).rlike(r"^[-*]\s")), lambda x: F.regexp_replace(F.trim(x), r"^[-*]\s+", ""))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.element_at(F.split(b, "\n"), 1)).alias("title"), lines(b).alias("items")))


def weighted(scores: Mapping[str, float]) -> Column:
    """Weights must add up to one; clamped to 0..1."""
    if abs(sum(scores.values()) - 1.0) > 1e-9:
        raise ValueError("weights must add up to 1")
    total = None
    for name, w in scores.items():
        total = F.col(name) * w if total is None else total + F.col(name) * w
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def case_gates(df: DataFrame, least: Mapping[str, float]) -> DataFrame:
    """``failure_reasons`` in the order of the gates, and ``case_pass``."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c) >= v, F.lit(False)), F.lit(f"{c}_below_{v:g}")) for c, v in least.items()]))
    return df.withColumn("failure_reasons", reasons).withColumn("case_pass", F.size("failure_reasons") == 0)


def run_summary(cases: DataFrame, run: str, scores: Sequence[str], least: Mapping[str, float]) -> DataFrame:
    """Means per run and the gates over them.  Means have nine digits: the order of summation decides no gate."""
    mean = lambda c: F.round(F.avg(c), 9)
    out = cases.groupBy(run).agg(F.count(F.lit(1)).alias("cases"), mean(F.col("case_pass").cast("double")).alias("pass_rate"), *[mean(c).alias(f"mean_{c}") for c in scores])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c) >= v, F.lit(False)), F.lit(c)) for c, v in least.items()]))
    return out.withColumn("failed_gates", failed).withColumn("overall_pass", F.size("failed_gates") == 0)


def fresh_enough(runs: DataFrame, at: str, as_of: str, days: int = 7) -> DataFrame:
    """The latest run, whether it passed, and whether its evidence is recent enough."""
    last = runs.orderBy(F.col(at).desc()).limit(1)
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(at))
    return last.withColumn("evidence_age_days", age).withColumn("may_promote", F.col("overall_pass") & (age <= days))
