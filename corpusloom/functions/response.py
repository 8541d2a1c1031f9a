"""Answers of a scoring model, read and guarded by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The states of a decision.
STATES = ("INCLUDED", "EXCLUDED", "NEEDS_REVIEW")
#: Inclusion codes that hold only together with IC1.
DEPENDENT = ("IC2", "IC3", "IC4", "IC5")


def _text(answer: Column, path: str) -> Column:
    return F.try_variant_get(answer, path, "string")


def _state(name: Column) -> Column:
    return F.when(name.isin(*STATES), name)


def _with_prefix(codes: Column, prefix: str) -> Column:
    return F.filter(codes, lambda c: c.startswith(prefix))


def parse_answer(content: Column) -> Column:
    """struct(status, confidence, codes) of a model's JSON answer.

    Text that is no JSON object, or names no state, needs review with confidence 0. Codes are those
    evaluated as the boolean true, in the answer's order, else the older list. Codes of both kinds
    keep the exclusions, sorted, and can't include; a dependent code without IC1 needs review.
    """
    answer = F.try_parse_json(content)
    named = F.coalesce(_state(_text(answer, "$.decision")), _state(_text(answer, "$.status")))
    verdicts = F.try_variant_get(answer, "$.criteria_evaluation", "map<string,variant>")
    true = F.map_filter(verdicts, lambda _, v: F.to_json(v) == "true")
    evaluated = F.filter(F.coalesce(F.json_object_keys(F.get_json_object(content, "$.criteria_evaluation")), F.array().cast("array<string>")), lambda k: F.coalesce(F.map_contains_key(true, k), F.lit(False)))
    listed = F.coalesce(F.try_variant_get(answer, "$.applied_criteria_codes", "array<string>"), F.array().cast("array<string>"))
    codes = F.when(F.size(evaluated) > 0, evaluated).otherwise(listed)
    ic, ec = _with_prefix(codes, "IC"), _with_prefix(codes, "EC")
    both, only_ic = (F.size(ic) > 0) & (F.size(ec) > 0), (F.size(ic) > 0) & (F.size(ec) == 0)
    orphan = only_ic & F.arrays_overlap(ic, F.array(*map(F.lit, DEPENDENT))) & ~F.array_contains(ic, "IC1")
    status = F.when(orphan, "NEEDS_REVIEW").when(both & (named == "INCLUDED"), "EXCLUDED").otherwise(named)
    confidence = F.when(status == "NEEDS_REVIEW", 0.5).otherwise(1.0)
    failed = F.struct(F.lit("NEEDS_REVIEW").alias("status"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("codes"))
    read = F.struct(status.alias("status"), confidence.alias("confidence"), F.when(both, F.array_sort(F.array_distinct(ec))).otherwise(codes).alias("codes"))
    return F.when(named.isNull(), failed).otherwise(read)


def parse_quality(content: Column) -> Column:
    """struct(q1, q2, q3, q4, score): numbers of a JSON answer, 0 where there is none."""
    answer = F.try_parse_json(content)
    parts = [F.coalesce(F.try_variant_get(answer, f"$.q{i}", "double"), F.lit(0.0)) for i in range(1, 5)]
    return F.struct(*[p.alias(f"q{i}") for i, p in enumerate(parts, 1)], (parts[0] + parts[1] + parts[2] + parts[3]).alias("score"))
