"""Rule tables of the file and row contracts: what is wrong with a row, by name, as columns.

Each function takes the columns that it needs and gives rules for
``rules.violations``, ``rules.reasons`` or ``rules.split_by``. A null where a
value is required breaks the rule about it; rules that look at other rows are
in ``operators/review.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import finite_between, violations

Rules = dict[str, Column]


def _not(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _text(c: Column, most: int) -> Column:
    return F.coalesce(F.length(F.trim(c)).between(1, most), F.lit(False))


def proposal_rules(label: Column, labels: list[str], t: Column, probability: Column, status: Column, covered: tuple[Column, Column], duration: Column) -> Rules:
    """Of proposed events: known label, time in the file and in what was covered, probability, and the status of a candidate."""
    low, high = covered
    return {
        "label": _not(label.isin(labels)),
        "time": _not(~F.isnan(t) & (t >= 0) & (t < duration)),
        "probability": ~finite_between(probability, 0, 1),
        "status": _not(status == "candidate"),
        "covered_range": _not((low >= 0) & (low <= high) & (high <= duration + 0.05)),
        "outside_coverage": _not((t >= low) & (t < high)),
    }


def review_rules(score: Column, confidence: Column, observation: Column, uncertainty: Column) -> Rules:
    """Of a visual review: scores in range, texts there and short enough."""
    return {"score": ~finite_between(score, 0, 100), "confidence": ~finite_between(confidence, 0, 1), "observation": ~_text(observation, 800), "uncertainty": ~_text(uncertainty, 800)}


def rating_rules(ratings: Column, flags: Column, stages: Column, confidence: Column, low: Column, high: Column) -> Rules:
    """Of ratings (map to 0-4 or null), flags (map to boolean or null) and stages (array of (start, end), nulls unknown) of a span.

    Stages lie within the span and come in order of their starts; a row that is
    safe to include is visible and free of suspected injury; laughter isn't told by sight.
    """
    known = F.filter(stages, lambda s: s["start"].isNotNull() | s["end"].isNotNull())
    starts = F.transform(known, lambda s: s["start"])
    inside = F.forall(known, lambda s: F.coalesce((s["start"] >= low) & (s["end"] <= high) & (s["start"] <= s["end"]), F.lit(False)))
    return {
        "rating": F.exists(F.map_values(ratings), lambda v: F.coalesce(~v.between(0, 4), F.lit(False))),
        "laughter": ratings["related_laughter"].isNotNull() | flags["laughter_linked"].isNotNull(),
        "stage_outside": ~inside,
        "stage_order": inside & (F.array_sort(starts) != starts),
        "confidence": ~finite_between(confidence, 0, 1),
        "unsafe": F.coalesce(flags["safe"], F.lit(False)) & _not(~flags["injury"] & flags["visible"]),
    }


def window_rules(points: list[Column], low: Column, high: Column, action: Column, actions: list[str], complete: Column) -> Rules:
    """Of a reviewed window (start, action start, peak, action end, end) within a clip."""
    a, b, peak, c, d = points
    return {
        "incomplete": _not(complete),
        "not_finite": F.lit(False) | F.greatest(*[F.coalesce(F.isnan(p) | p.isNull(), F.lit(True)).cast("int") for p in points]).cast("boolean"),
        "order": _not((a <= b) & (b < peak) & (peak < c) & (c <= d)),
        "outside": _not((a >= low) & (d <= high)),
        "action": _not(action.isin(actions)),
    }


def prediction_rules(label: Column, labels: list[str], t: Column, confidence: Column, duration: Column, cited: Column, known: Column) -> Rules:
    """Of predicted actions: known label, time and confidence in range, and at least one cited frame, all of them known."""
    return {
        "label": _not(label.isin(labels)), "time": _not(~F.isnan(t) & (t >= 0) & (t < duration)), "confidence": ~finite_between(confidence, 0, 1),
        "no_evidence": _not(F.size(cited) > 0), "unknown_evidence": F.coalesce(F.size(F.array_except(cited, known)) > 0, F.lit(False)),
    }


def timing_rules(fps: Column, stated_fps: Column, frames: Column, counted: Column, stated: Column, duration: Column, start: Column) -> Rules:
    """Of a sample's clock: the rate and frames stated, counted and implied by its duration agree and it starts at 0."""
    return {
        "fps": _not((fps > 0) & (fps == stated_fps)),
        "frames": _not((frames > 0) & (frames == counted) & (frames >= stated)),
        "duration": _not(F.abs(duration - F.try_divide(frames, fps)) <= 0.001),
        "origin": _not(F.abs(start) <= 1e-6),
    }


def decision_rules(decision: Column, item: Column, anchor: Column, placement: Column, contacts: Column, confidence: Column, reason: Column, items: list[str]) -> Rules:
    """Of a choice of ``items`` or ``skip``: a skip names nothing, others name a known item, its anchor, place and contacts."""
    skip = decision == "skip"
    return {
        "decision": _not(decision.isin("use", "skip")),
        "confidence": ~finite_between(confidence, 0, 1),
        "reason": ~_text(reason, 1000),
        "contradictory_skip": F.coalesce(skip & (item.isNotNull() | anchor.isNotNull() | placement.isNotNull()), F.lit(False)),
        "unknown_item": F.coalesce(~skip & _not(item.isin(items)), F.lit(False)),
        "missing_timing": F.coalesce(~skip & (placement.isNull() | anchor.isNull() | _not(F.size(contacts) > 0)), F.lit(False)),
        "repeated_contact": F.coalesce(F.size(F.array_distinct(contacts)) < F.size(contacts), F.lit(False)),
    }


def cue_violations(cues: DataFrame, plan: list[str], id_: str, at: str, start: str, end: str, duration: str, most: int = 2) -> DataFrame:
    """(plan, id, rule) of sound cues: number, ids, lengths of 0.1 to 5, end within the duration, no overlap with the cue before."""
    n, same = F.count(F.lit(1)).over(Window.partitionBy(*plan)), F.count(F.lit(1)).over(Window.partitionBy(*plan, id_))
    length = F.col(end) - F.col(start)
    w = Window.partitionBy(*plan).orderBy(at, id_, length)  # cues alike in both go by their length
    rows = cues.withColumn("_n", n).withColumn("_same", same).withColumn("_before", F.lag(F.col(at) + length).over(w))
    return violations(rows, [*plan, id_], {
        "too_many": F.col("_n") > most, "repeated_id": F.col("_same") > 1, "length": ~finite_between(length, 0.1, 5.0),
        "truncated": _not(finite_between(F.col(at), 0, 1e9) & (F.col(at) + length <= F.col(duration))), "overlap": F.coalesce(F.col("_before") > F.col(at), F.lit(False)),
    })


def threshold_rules(thresholds: Column, labels: Column) -> Rules:
    """Of a map of thresholds: not empty, of known labels only, all in [0, 1]."""
    return {
        "empty": _not(F.size(thresholds) > 0),
        "unknown_label": F.coalesce(F.size(F.array_except(F.map_keys(thresholds), labels)) > 0, F.lit(False)),
        "range": F.exists(F.map_values(thresholds), lambda v: ~finite_between(v, 0, 1)),
    }


def coverage_violations(expected: DataFrame, got: DataFrame, on: list[str]) -> DataFrame:
    """(on, rule): expected rows that are missing, rows that were not expected, rows that come twice. Null keys are equal."""
    sides = expected.select(*on).distinct().withColumn("_want", F.lit(1)).withColumn("_got", F.lit(0)).unionByName(got.select(*on).withColumn("_want", F.lit(0)).withColumn("_got", F.lit(1)))
    c = sides.groupBy(*on).agg(F.sum("_want").alias("_want"), F.sum("_got").alias("_got"))
    return violations(c, on, {"missing": F.col("_got") == 0, "unexpected": F.col("_want") == 0, "repeated": F.col("_got") > 1})


def needs_fallback(visible: Column, detections: Column, label: str = "ball", least: float = 0.25) -> Column:
    """Whether nothing was seen and no detection (label, confidence) is sure enough of it."""
    return _not(visible) & ~F.coalesce(F.exists(detections, lambda d: (d["label"] == label) & (d["confidence"] >= least)), F.lit(False))
