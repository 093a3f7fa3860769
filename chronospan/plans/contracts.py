"""Queries of the contracts' rule tables over rows derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.functions import contracts as K
from chronospan.functions import rules as R

from .sequences import EV
from .tables import HOUR, events, table


def _listed(rules: dict[str, str]) -> str:
    """SQL of the names of the rules that hold, one a row."""
    return "unnest([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + "]) AS rule"


def d12_proposals(spark, sf_dir):
    e = events(spark, sf_dir)
    t = F.when(F.col("k") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    status = F.when(F.col("k") % 5 > 0, F.lit("candidate"))
    return R.violations(e, ["event_id"], K.proposal_rules(F.col("event_type"), ["click", "view", "purchase"], t, F.col("k") / 95, status, (F.lit(2.0), F.lit(40.0)), F.lit(45.0)))


D12 = f"""WITH {EV}, x AS (SELECT event_id, event_type, k, CASE WHEN k % 17 > 0 THEN value END AS t FROM e),
v AS (SELECT event_id, {_listed({"label": "event_type NOT IN ('click', 'view', 'purchase')", "time": "t IS NULL OR t < 0 OR t >= 45", "probability": "NOT k / 95 BETWEEN 0 AND 1", "status": "k % 5 = 0", "outside_coverage": "t IS NULL OR t < 2 OR t >= 40"})} FROM x)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d13_reviews(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    c = table(spark, sf_dir, "customer")
    return K.coverage_violations(c.where("c_custkey % 3 > 0").select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


D13 = """WITH w AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0), g AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT c_custkey, w.c_custkey IS NOT NULL AS want, coalesce(n, 0) AS n FROM w FULL JOIN g USING (c_custkey)),
v AS (SELECT c_custkey, unnest([CASE WHEN n = 0 THEN 'missing' END, CASE WHEN c_custkey % 3 = 0 OR NOT EXISTS (SELECT 1 FROM w WHERE w.c_custkey = j.c_custkey) THEN 'unexpected' END, CASE WHEN n > 1 THEN 'repeated' END]) AS rule FROM j)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d13_review_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    rules = K.review_rules((F.col("n_chars") % 130).cast("double"), (F.col("doc_id") % 13) / 12.5, F.col("text"), F.when(F.col("doc_id") % 11 > 0, F.col("source")))
    return R.violations(d, ["doc_id"], rules)


D13R = f"""WITH v AS (SELECT doc_id, {_listed({"score": "n_chars % 130 > 100", "confidence": "doc_id % 13 / 12.5 > 1", "observation": "text IS NULL OR NOT length(trim(text)) BETWEEN 1 AND 800", "uncertainty": "doc_id % 11 = 0 OR source IS NULL OR NOT length(trim(source)) BETWEEN 1 AND 800"})} FROM documents)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d15_cues(spark, sf_dir):
    e = events(spark, sf_dir)
    cues = e.select("user_id", (F.col("event_id") % 50).alias("cue"), (F.floor(F.col("us") / HOUR) % 100).cast("double").alias("at"), F.lit(0.0).alias("a"), (F.col("k") / 18).alias("b"), F.lit(99.0).alias("whole"), "event_id")
    return K.cue_violations(cues, ["user_id"], "cue", "at", "a", "b", "whole", 20).groupBy("user_id", "rule").agg(F.count(F.lit(1)).alias("n"))


D15 = f"""WITH {EV}, c AS (SELECT user_id, event_id % 50 AS cue, (us // 3600000000 % 100)::DOUBLE AS t, k / 18 AS len FROM e),
w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, count(*) OVER (PARTITION BY user_id, cue) AS same, lag(t + len) OVER (PARTITION BY user_id ORDER BY t, cue, len) AS before FROM c),
v AS (SELECT user_id, {_listed({"too_many": "n > 20", "repeated_id": "same > 1", "length": "NOT len BETWEEN 0.1 AND 5", "truncated": "t + len > 99", "overlap": "before > t"})} FROM w)
SELECT user_id, rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY ALL"""


def d16_thresholds(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.max(F.struct("value", "event_type")).alias("top"), F.collect_set("event_type").alias("types"))
    m = F.map_from_arrays("types", F.transform("types", lambda t: F.col("top.value") / F.when(t == F.col("top.event_type"), 30).otherwise(60)))
    return R.violations(e, ["user_id", "day"], K.threshold_rules(m, F.array(F.lit("click"), F.lit("view"), F.lit("purchase"))))


D16 = f"""WITH {EV}, g AS (SELECT user_id, us // 86400000000 AS day, event_type, max(value) AS own FROM e GROUP BY ALL), m AS (SELECT user_id, day, max(own) AS v, bool_or(event_type NOT IN ('click', 'view', 'purchase')) AS odd, count(*) AS n FROM g GROUP BY ALL),
v AS (SELECT user_id, day, unnest([CASE WHEN odd THEN 'unknown_label' END, CASE WHEN v / 30 > 1 OR (n > 1 AND v / 60 > 1) THEN 'range' END]) AS rule FROM m)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d25_windows(spark, sf_dir):
    e = events(spark, sf_dir)
    v, k = F.col("value"), F.col("k")
    points = [v - 2, v - F.when(k % 4 == 0, 3).otherwise(1), v, v + k / 50, F.when(k % 13 > 0, v + 1.5)]
    return R.violations(e, ["event_id"], K.window_rules(points, F.lit(1.0), F.lit(40.0), F.col("event_type"), ["purchase", "click", "error"], k % 6 > 0))


D25 = f"""WITH {EV}, p AS (SELECT event_id, event_type, k, value - 2 AS a, value - CASE WHEN k % 4 = 0 THEN 3 ELSE 1 END AS b, value AS p, value + k / 50 AS c, CASE WHEN k % 13 > 0 THEN value + 1.5 END AS d FROM e),
v AS (SELECT event_id, {_listed({"incomplete": "k % 6 = 0", "not_finite": "d IS NULL", "order": "NOT coalesce(a <= b AND b < p AND p < c AND c <= d, false)", "outside": "NOT coalesce(a >= 1 AND d <= 40, false)", "action": "event_type NOT IN ('purchase', 'click', 'error')"})} FROM p)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d27_predictions(spark, sf_dir):
    e = events(spark, sf_dir)
    cited = F.when(F.col("k") % 7 > 0, F.array(F.col("k") % 5, F.col("k") % 11)).otherwise(F.array().cast("array<bigint>"))
    return R.violations(e, ["event_id"], K.prediction_rules(F.col("event_type"), ["purchase", "click"], F.col("value"), F.col("k") / 90, F.lit(50.0), cited, F.array(*[F.lit(i).cast("long") for i in range(8)])))


D27 = f"""WITH {EV}, v AS (SELECT event_id, {_listed({"label": "event_type NOT IN ('purchase', 'click')", "time": "value < 0 OR value >= 50", "confidence": "k / 90 > 1", "no_evidence": "k % 7 = 0", "unknown_evidence": "k % 7 > 0 AND k % 11 > 7"})} FROM e)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d28_timing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key, size = F.col("p_partkey"), F.col("p_size")
    fps = F.when(key % 9 == 0, F.lit(0.0)).otherwise(F.lit(25.0))
    return R.violations(p, ["p_partkey"], K.timing_rules(fps, F.lit(25.0), size, size - (key % 7 == 0).cast("int"), size + (key % 5 == 0).cast("int"), size / 25 + F.when(key % 4 == 0, 0.01).otherwise(0.0), F.when(key % 11 == 0, 0.5).otherwise(0.0)))


D28 = f"""WITH v AS (SELECT p_partkey, {_listed({"fps": "p_partkey % 9 = 0", "frames": "p_partkey % 7 = 0 OR p_partkey % 5 = 0", "duration": "p_partkey % 9 = 0 OR p_partkey % 4 = 0", "origin": "p_partkey % 11 = 0"})} FROM part) SELECT * FROM v WHERE rule IS NOT NULL"""


def d29_ratings(spark, sf_dir):
    e = events(spark, sf_dir)
    k, v = F.col("k"), F.col("value")
    ratings = F.create_map(F.lit("clarity"), (k % 7).cast("int"), F.lit("related_laughter"), F.when(k % 19 == 0, 1))
    flags = F.create_map(F.lit("safe"), k % 2 == 0, F.lit("injury"), F.when(k % 3 > 0, k % 5 == 0), F.lit("visible"), F.lit(True), F.lit("laughter_linked"), F.lit(None).cast("boolean"))
    stage = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    stages = F.array(stage(v, v + 1), stage(F.when(k % 4 > 0, v + k / 40 - 1), F.when(k % 4 > 0, v + k / 40)))
    return R.violations(e, ["event_id"], K.rating_rules(ratings, flags, stages, k / 95, F.lit(1.0), F.lit(60.0)))


D29 = f"""WITH {EV}, x AS (SELECT *, value AS a, value + 1 AS b, value + k / 40 - 1 AS c, value + k / 40 AS d, k % 4 > 0 AS two FROM e), i AS (SELECT *, a >= 1 AND b <= 60 AND (NOT two OR (c >= 1 AND d <= 60)) AS inside FROM x),
v AS (SELECT event_id, {_listed({"rating": "k % 7 > 4", "laughter": "k % 19 = 0", "stage_outside": "NOT inside", "stage_order": "inside AND two AND c < a", "confidence": "k / 95 > 1", "unsafe": "k % 2 = 0 AND NOT coalesce(CASE WHEN k % 3 > 0 THEN k % 5 <> 0 END, false)"})} FROM i)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d33_decisions(spark, sf_dir):
    e = events(spark, sf_dir)
    k = F.col("k")
    choice = F.when(k % 9 == 0, "maybe").when(k % 3 == 0, "skip").otherwise("use")
    contacts = F.when(k % 4 > 0, F.array(k % 5, k % 7))
    return R.violations(e, ["event_id"], K.decision_rules(choice, F.when(k % 2 == 0, F.col("event_type")), F.when(k % 5 > 0, k), F.when(k % 6 > 0, k), contacts, k / 95, F.when(k % 8 > 0, F.col("event_type")), ["click", "view"]))


D33 = f"""WITH {EV}, x AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'maybe' WHEN k % 3 = 0 THEN 'skip' ELSE 'use' END AS choice FROM e),
v AS (SELECT event_id, {_listed({"decision": "choice = 'maybe'", "confidence": "k / 95 > 1", "reason": "k % 8 = 0", "contradictory_skip": "choice = 'skip' AND (k % 2 = 0 OR k % 5 > 0 OR k % 6 > 0)", "unknown_item": "choice <> 'skip' AND (k % 2 > 0 OR event_type NOT IN ('click', 'view'))", "missing_timing": "choice <> 'skip' AND (k % 6 = 0 OR k % 5 = 0 OR k % 4 = 0)", "repeated_contact": "k % 4 > 0 AND k % 5 = k % 7"})} FROM x)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d40_fallback(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.bool_or(F.col("event_type") == "view").alias("seen"), F.collect_list(F.struct(F.col("event_type").alias("label"), (F.col("k") / 100).alias("confidence"))).alias("d"))
    return e.where(K.needs_fallback(F.col("seen"), F.col("d"), "click")).select("user_id", "hour")


D40 = f"""WITH {EV} SELECT user_id, us // 3600000000 AS hour FROM e GROUP BY ALL HAVING NOT bool_or(event_type = 'view') AND NOT bool_or(event_type = 'click' AND k / 100 >= 0.25)"""

QUERIES = {
    "d12_proposals": d12_proposals, "d13_reviews": d13_reviews, "d13_review_rules": d13_review_rules, "d15_cues": d15_cues, "d16_thresholds": d16_thresholds, "d25_windows": d25_windows, "d27_predictions": d27_predictions,
    "d28_timing": d28_timing, "d29_ratings": d29_ratings, "d33_decisions": d33_decisions, "d40_fallback": d40_fallback,
}
ORACLE_SQL = {
    "d12_proposals": D12, "d13_reviews": D13, "d13_review_rules": D13R, "d15_cues": D15, "d16_thresholds": D16, "d25_windows": D25, "d27_predictions": D27, "d28_timing": D28, "d29_ratings": D29, "d33_decisions": D33, "d40_fallback": D40,
}
