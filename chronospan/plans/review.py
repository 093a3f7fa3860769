"""Queries of the contracts between tables, evaluation reports and choices, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.functions import scalars as C
from chronospan.operators import joins as J
from chronospan.operators import metrics as M
from chronospan.operators import review as V
from chronospan.operators import select as S

from .sequences import EV
from .tables import DAY, HOUR, events, spans, table

SP = "s AS (SELECT event_id, user_id, event_type, value, k, us AS a, us + 3600000000 + k * 60000000 AS b FROM e WHERE event_type IN ('purchase', 'error'))"


def _clips(spark, sf_dir):
    """Spans with a clip of half an hour more on either side, cut by an hour where k is a multiple of 7."""
    s = spans(spark, sf_dir)
    k = F.pmod(F.col("event_id"), F.lit(7)) == 0
    return s.withColumn("clip_start", F.col("start") + F.when(k, HOUR).otherwise(-HOUR // 2)).withColumn("clip_end", F.col("end") + HOUR // 2)


def d10_selection(spark, sf_dir):
    known = spans(spark, sf_dir).where("event_id % 11 <> 0").select("event_id")
    chosen = S.top_k_each(_clips(spark, sf_dir), ["user_id"], [F.desc("value"), "event_id"], 3).withColumn("rank", F.when(F.col("event_id") % 5 == 0, F.col("rank") + 1).otherwise(F.col("rank")))
    return V.selection_violations(chosen, known, ["user_id"], "event_id", "rank", "event_type", ("clip_start", "clip_end"), ("start", "end"), 3, 1000)


D10 = f"""WITH {EV}, {SP}, p AS (SELECT *, a + CASE WHEN event_id % 7 = 0 THEN 3600000000 ELSE -1800000000 END AS ca, b + 1800000000 AS cb FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM p QUALIFY r <= 3), c AS (SELECT *, r + (event_id % 5 = 0)::INT AS rank FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS size,
 max(cb) OVER (PARTITION BY user_id, event_type ORDER BY ca, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
v AS (SELECT user_id, event_id, unnest([CASE WHEN event_id % 11 = 0 THEN 'unknown' END, CASE WHEN rank <> place THEN 'rank' END, CASE WHEN size <> 3 THEN 'count' END,
 CASE WHEN ca > a OR cb < b THEN 'cut' END, CASE WHEN ca < before - 1000 THEN 'overlap' END]) AS rule FROM w)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d18_anchors(spark, sf_dir):
    e = events(spark, sf_dir)
    claims = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("claim"), F.col("event_id").alias("peak"), (F.col("event_id") - F.col("k") % 4 * 10).alias("lead"), F.when(F.col("k") % 3 > 0, F.col("event_id") + F.col("k")).alias("tail"))
    frames = e.where("event_id % 13 <> 0").withColumn("user_id", F.lit(0).cast("long")).select("user_id", "event_id", "us")
    found = V.anchored(claims.withColumn("user_id", F.lit(0).cast("long")), frames, ["user_id"], ["lead", "peak", "tail"], "event_id", "us")
    return V.anchor_violations(found, ["claim"], ["lead", "peak", "tail"])


D18 = f"""WITH {EV}, c AS (SELECT event_id AS claim, event_id AS peak, event_id - k % 4 * 10 AS lead, CASE WHEN k % 3 > 0 THEN event_id + k END AS tail FROM e WHERE event_type = 'purchase'),
f AS (SELECT event_id AS id, us FROM e WHERE event_id % 13 <> 0), j AS (SELECT c.*, l.us AS l, p.us AS p, t.us AS t FROM c LEFT JOIN f l ON l.id = c.lead LEFT JOIN f p ON p.id = c.peak LEFT JOIN f t ON t.id = c.tail),
v AS (SELECT claim, unnest([CASE WHEN lead IS NOT NULL AND l IS NULL THEN 'unknown_lead' END, CASE WHEN p IS NULL THEN 'unknown_peak' END, CASE WHEN tail IS NOT NULL AND t IS NULL THEN 'unknown_tail' END,
 CASE WHEN l > p THEN 'lead_after_peak' END, CASE WHEN p > t THEN 'peak_after_tail' END]) AS rule FROM j)
SELECT * FROM v WHERE rule IS NOT NULL"""


def d22_boundary(spark, sf_dir):
    e = events(spark, sf_dir)
    x = F.col("value")
    why = V.boundary_problem(F.col("k") / 100, F.col("event_type") != "error", x, x / 60, F.col("k") / 150, F.pmod("event_id", F.lit(9)) > 0, 0.15, 2.0)
    return e.select("event_id", why.alias("problem"))


D22 = f"""WITH {EV} SELECT event_id, CASE WHEN k / 100 < 0.15 THEN 'unresolved' WHEN event_type = 'error' OR value < 2 THEN 'rejected' WHEN event_id % 9 = 0 THEN 'not_resolved'
 WHEN value / 60 < 0.35 AND k / 150 < 0.35 THEN 'need_both' WHEN value / 60 < 0.35 THEN 'need_before' WHEN k / 150 < 0.35 THEN 'need_after' END AS problem FROM e"""


def d23_flips(spark, sf_dir):
    e = events(spark, sf_dir)
    one, two = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return V.flipped(one, two, ["user_id"], "us", "event_type", (["purchase"], ["error", "view"]), 6 * HOUR)


D23 = f"""WITH {EV} SELECT a.user_id, a.us, a.event_type, b.us AS other_t, b.event_type AS other_label FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND abs(a.us - b.us) <= 21600000000
 AND ((a.event_type = 'purchase' AND b.event_type IN ('error', 'view')) OR (b.event_type = 'purchase' AND a.event_type IN ('error', 'view')))"""


def d26_grounded(spark, sf_dir):
    e = events(spark, sf_dir)
    frames = e.where("event_id % 13 <> 0").select(F.lit(0).alias("run"), F.col("event_id").alias("frame"), (F.floor(F.col("us") / HOUR) * HOUR).alias("t"))
    claims = e.select(F.lit(0).alias("run"), (F.col("event_id") - F.col("k") % 5).alias("frame"), "event_type", F.col("value").alias("confidence"), (F.col("k") % 6 > 0).alias("observable"), (F.col("us") - 30 * HOUR).alias("a"), (F.col("us") + 12 * HOUR).alias("b"))
    good, bad = V.grounded(claims, frames, ["run"], "frame", "t", "event_type", "confidence", "observable", ("a", "b"))
    cols = ["frame", "event_type", "confidence"]
    return good.select(*cols, F.lit("accepted").alias("reason")).unionByName(bad.select(*cols, "reason"))


D26 = f"""WITH {EV}, f AS (SELECT event_id AS frame, us // 3600000000 * 3600000000 AS t FROM e WHERE event_id % 13 <> 0),
c AS (SELECT event_id - k % 5 AS frame, event_type, value AS confidence, k % 6 > 0 AS observable, us - 108000000000 AS a, us + 43200000000 AS b FROM e),
j AS (SELECT c.*, t, CASE WHEN t IS NULL THEN 'unknown_frame' WHEN NOT observable THEN 'unobservable' WHEN t < a OR t >= b THEN 'owned_by_neighbour' END AS reason FROM c LEFT JOIN f USING (frame)),
g AS (SELECT frame, event_type, confidence, 'accepted' AS reason FROM j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY event_type, t ORDER BY confidence DESC, frame) = 1)
SELECT * FROM g UNION ALL SELECT frame, event_type, confidence, reason FROM j WHERE reason IS NOT NULL"""


def d9_named(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.col("role"), F.col("turn").cast("string")).alias("name"), F.length("text").cast("long").alias("value")))).alias("entries"))
    m = V.named_once(F.col("entries"), ["assistant1", "user0"])
    return c.select("conv_id", m["user0"].alias("first"), m["assistant1"].alias("second"))


D9 = """WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role || turn = 'user0') AS u, count(*) FILTER (role || turn = 'assistant1') AS a, max(length(text)) FILTER (role || turn = 'user0') AS x, max(length(text)) FILTER (role || turn = 'assistant1') AS y FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n = 2 AND u = 1 AND a = 1 THEN x END AS first, CASE WHEN n = 2 AND u = 1 AND a = 1 THEN y END AS second FROM c"""


def g21_context(spark, sf_dir):
    e = events(spark, sf_dir)
    peak, k = F.col("value"), F.col("k")
    first = V.initial_context(peak - k / 20, F.when(k % 4 > 0, peak + k / 30), peak, F.lit(2.0), F.lit(60.0), 9.0)
    grown = V.expanded_context(F.col("c.a"), F.col("c.b"), k % 2 == 0, k % 3 == 0, F.lit(2.0), F.lit(60.0), 12.0)
    r = lambda c: F.round(c, 6)
    return e.select("event_id", "value", "k", first.alias("c")).select("event_id", r(F.col("c.a")).alias("a"), r(F.col("c.b")).alias("b"), r(grown["a"]).alias("more_a"), r(grown["b"]).alias("more_b"))


G21 = f"""WITH {EV}, x AS (SELECT event_id, k, greatest(2.0, least(value - k / 20 - 0.75, value - 2.0)) AS a, least(60.0, greatest(coalesce(CASE WHEN k % 4 > 0 THEN value + k / 30 END, value + 3.0) + 1.0, value + 3.0)) AS b FROM e),
c AS (SELECT event_id, k, CASE WHEN b - a <= 9 THEN a END AS a, CASE WHEN b - a <= 9 THEN b END AS b FROM x),
g AS (SELECT *, CASE WHEN k % 2 = 0 THEN greatest(2.0, a - greatest(1.5, (b - a) * 0.4)) ELSE a END AS l, CASE WHEN k % 3 = 0 THEN least(60.0, b + greatest(1.5, (b - a) * 0.4)) ELSE b END AS r FROM c),
o AS (SELECT *, a IS NOT NULL AND NOT ((k % 2 = 0 AND l >= a - 1e-6) OR (k % 3 = 0 AND r <= b + 1e-6) OR r - l > 12) AS ok FROM g)
SELECT event_id, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN ok THEN round(l, 6) END AS more_a, CASE WHEN ok THEN round(r, 6) END AS more_b FROM o"""


def c26_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 70) / 100.0).alias("x"), ((F.col("p_size") % 80) / 100.0).alias("y"))
    box = V.padded_box(F.col("x"), F.col("y"), F.least(F.lit(1.0), F.col("x") + 0.35), F.least(F.lit(1.0), F.col("y") + 0.1))
    return p.select("p_partkey", *[F.round(box[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


C26 = """WITH p AS (SELECT p_partkey, (p_partkey % 70) / 100.0::DOUBLE AS x, (p_size % 80) / 100.0::DOUBLE AS y FROM part), b AS (SELECT *, least(1.0, x + 0.35::DOUBLE) AS x2, least(1.0, y + 0.1::DOUBLE) AS y2 FROM p),
s AS (SELECT *, least(1.0, greatest(0.45::DOUBLE, x2 - x + 0.16::DOUBLE)) AS w, least(1.0, greatest(0.40::DOUBLE, y2 - y + 0.16::DOUBLE)) AS h FROM b),
o AS (SELECT p_partkey, w, h, greatest(0.0, least(1 - w, (x + x2) / 2 - w / 2)) AS l, greatest(0.0, least(1 - h, (y + y2) / 2 - h / 2)) AS t FROM s)
SELECT p_partkey, round(l, 6) AS x0, round(t, 6) AS y0, round(l + w, 6) AS x1, round(t + h, 6) AS y1 FROM o"""


def c3_head_line(spark, sf_dir):
    e = events(spark, sf_dir)
    people = F.collect_list(F.struct((F.col("k") / 100).alias("confidence"), F.col("value").alias("y0"), (F.col("value") + F.col("k")).alias("y1")))
    line = e.groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).agg(V.head_line(people, 100.0).alias("h"))
    return line.select("user_id", "day", "h.n", F.round("h.line", 6).alias("line"))


C3 = f"""WITH {EV} SELECT user_id, us // 86400000000 AS day, (count(*) FILTER (k / 100 >= 0.4))::INT AS n, round(coalesce(median(value + 0.15 * k) FILTER (k / 100 >= 0.4), 40), 6) AS line FROM e GROUP BY ALL"""


def c5_summary(spark, sf_dir):
    s = V.summary_of(spans(spark, sf_dir), ["user_id"], "start", "end", "event_id")
    return s.select("user_id", F.col("n").cast("int").alias("n_gaps"), F.array_join(F.transform("longest", lambda g: g["start"].cast("string")), ",").alias("longest"), F.array_join(F.transform("examples", lambda i: i.cast("string")), ",").alias("examples"))


C5 = f"""WITH {EV}, {SP}, l AS (SELECT user_id, list(a ORDER BY b - a DESC, a) AS g, list(event_id ORDER BY event_id) AS i FROM s GROUP BY 1)
SELECT user_id, len(g)::INT AS n_gaps, array_to_string(g[1:3], ',') AS longest, array_to_string(i[1:3], ',') AS examples FROM l"""


def f22_candidates(spark, sf_dir):
    c = _clips(spark, sf_dir).withColumn("grade", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5))
    truth, found = c.where("event_type = 'purchase'"), c.where("event_type = 'error'")
    chosen = S.top_k_each(found, ["user_id"], [F.desc("value"), "event_id"], 5)
    m = M.candidate_recall(truth, found, chosen, ["user_id"], "event_id", 3.0 * HOUR, 0.1, "grade")
    return m.select(*[F.round(x, 9).alias(x) if x in ("candidate_recall", "quality", "completeness") else x for x in m.columns])


F22C = f"""WITH {EV}, {SP}, c AS (SELECT *, a + CASE WHEN event_id % 7 = 0 THEN 3600000000 ELSE -1800000000 END AS ca, b + 1800000000 AS cb, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS grade FROM s),
t AS (SELECT * FROM c WHERE event_type = 'purchase'), f AS (SELECT * FROM c WHERE event_type = 'error'), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5),
o AS (SELECT t.user_id, t.event_id AS tid, f.event_id AS fid, (least(t.b, f.b) - greatest(t.a, f.a)) / (greatest(t.b, f.b) - least(t.a, f.a)) AS iou, f.ca <= t.ca AND f.cb >= t.cb AS whole FROM t JOIN f ON t.user_id = f.user_id AND t.a < f.b AND f.a < t.b),
n AS (SELECT user_id, count(*) AS annotated FROM t GROUP BY 1), v AS (SELECT user_id, count(DISTINCT tid) AS covered FROM o WHERE iou >= 0.1 GROUP BY 1),
p AS (SELECT user_id, count(*) AS selected, count(grade) AS judged, avg(grade) AS quality FROM k GROUP BY 1),
m AS (SELECT user_id, whole FROM o WHERE iou >= 0.1 AND fid IN (SELECT event_id FROM k) QUALIFY row_number() OVER (PARTITION BY fid ORDER BY iou DESC, tid) = 1),
q AS (SELECT user_id, count(*) AS matched, avg(whole::INT) AS completeness FROM m GROUP BY 1)
SELECT user_id, coalesce(annotated, 0) AS annotated, CASE WHEN annotated > 0 THEN round(coalesce(covered, 0) / annotated, 9) END AS candidate_recall, coalesce(selected, 0) AS selected, coalesce(judged, 0) AS judged, round(quality, 9) AS quality,
 coalesce(matched, 0) AS matched, round(completeness, 9) AS completeness FROM n FULL JOIN p USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN q USING (user_id)"""

#: Two pointers over sorted times as a recursion: a pair within the tolerance is a match, else the earlier side moves on.
MATCHED = f"""WITH RECURSIVE {EV}, x AS (SELECT user_id, event_type, coalesce(list(us ORDER BY us) FILTER (event_id % 2 = 0), []) AS t, coalesce(list(us ORDER BY us) FILTER (event_id % 2 = 1), []) AS p FROM e GROUP BY ALL),
r AS (SELECT user_id, event_type, t, p, 1 AS i, 1 AS j, 0 AS tp FROM x
 UNION ALL SELECT user_id, event_type, t, p, CASE WHEN m OR t[i] < p[j] THEN i + 1 ELSE i END, CASE WHEN m OR t[i] >= p[j] THEN j + 1 ELSE j END, tp + m::INT FROM r, LATERAL (SELECT abs(t[i] - p[j]) <= 86400000000 AS m) WHERE i <= len(t) AND j <= len(p)),
c AS (SELECT user_id, event_type, max(tp) AS tp, max(len(p)) - max(tp) AS fp, max(len(t)) - max(tp) AS fn FROM r GROUP BY ALL)"""


def f23_micro(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("us").cast("double"))
    c = J.match_counts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "t", 24.0 * HOUR)
    m = M.micro_and_per_class(c, "event_type")
    return m.select(*[F.round(x, 9).alias(x) if x in ("precision", "recall", "f1") else x for x in m.columns])


F23 = f"""{MATCHED}, g AS (SELECT event_type, grouping(event_type)::INT AS is_total, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP (event_type))
SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM g"""


def f20_pooled(spark, sf_dir):
    return M.max_pooled(events(spark, sf_dir), ["user_id"], "event_type", "value", {"deal": ["purchase", "click"], "fault": ["error"], "any": ["purchase", "error", "view"]})


F20 = """WITH m AS (SELECT * FROM (VALUES ('deal', 'purchase'), ('deal', 'click'), ('fault', 'error'), ('any', 'purchase'), ('any', 'error'), ('any', 'view')) AS t(category, event_type))
SELECT user_id, category, max(value) AS score FROM events JOIN m USING (event_type) GROUP BY ALL"""


def g31_first_passing(spark, sf_dir):
    e = events(spark, sf_dir)
    cues = e.where("event_type = 'error'").select("user_id", "event_id", "us")
    frames = e.select("user_id", F.col("us").alias("frame"), "value")
    return S.first_passing(cues, frames, ["user_id"], "event_id", "us", "frame", 24 * HOUR, F.col("value") >= 12)


G31 = f"""WITH {EV} SELECT c.event_id, min(f.us) AS at FROM e c LEFT JOIN e f ON f.user_id = c.user_id AND f.us BETWEEN c.us AND c.us + 86400000000 AND f.value >= 12 WHERE c.event_type = 'error' GROUP BY 1"""


def h7_settled(spark, sf_dir):
    return S.best_unless_open(events(spark, sf_dir).withColumn("settled", F.col("k") % 3 > 0), ["user_id"], ["value", "event_id"], "settled")


H7 = f"""WITH {EV}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM e), s AS (SELECT * FROM b WHERE k % 3 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r) = 1)
SELECT user_id, value, event_id FROM s WHERE r = 1"""


def i9_tags(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("tags"))
    want, allowed = F.array(F.lit("error"), F.lit("purchase")), F.array(*map(F.lit, ("click", "view", "purchase")))
    return e.select("user_id", F.array_join(F.array_intersect("tags", want), ",").alias("both"), F.arrays_overlap("tags", want).alias("any"), (F.size(F.array_except("tags", allowed)) == 0).alias("within"))


I9 = """WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS tags FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter(tags, lambda x: x IN ('error', 'purchase')), ',') AS both, list_has_any(tags, ['error', 'purchase']) AS "any", len(list_filter(tags, lambda x: x NOT IN ('click', 'view', 'purchase'))) = 0 AS within FROM e"""


def c17_masked(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Authorization: Bearer t"), "c_custkey", F.lit(" api_key='k"), "c_custkey", F.lit("', sk-abcdef"), "c_custkey", F.lit("00 password=p; note "), "c_mktsegment").alias("t"))
    return c.select("c_custkey", C.redacted(F.col("t")).alias("text"))


C17 = "SELECT c_custkey, 'Authorization: Bearer [redacted] api_key=''[redacted]'', [redacted] password=[redacted] note ' || c_mktsegment AS text FROM customer"

QUERIES = {
    "c3_head_line": c3_head_line, "c5_summary": c5_summary, "c17_masked": c17_masked, "c26_boxes": c26_boxes, "d9_named": d9_named, "d10_selection": d10_selection, "d18_anchors": d18_anchors,
    "d22_boundary": d22_boundary, "d23_flips": d23_flips, "d26_grounded": d26_grounded, "f20_pooled": f20_pooled, "f22_candidates": f22_candidates, "f23_micro": f23_micro, "g21_context": g21_context,
    "g31_first_passing": g31_first_passing, "h7_settled": h7_settled, "i9_tags": i9_tags,
}
ORACLE_SQL = {
    "c3_head_line": C3, "c5_summary": C5, "c17_masked": C17, "c26_boxes": C26, "d9_named": D9, "d10_selection": D10, "d18_anchors": D18, "d22_boundary": D22, "d23_flips": D23, "d26_grounded": D26,
    "f20_pooled": F20, "f22_candidates": F22C, "f23_micro": F23, "g21_context": G21, "g31_first_passing": G31, "h7_settled": H7, "i9_tags": I9,
}
