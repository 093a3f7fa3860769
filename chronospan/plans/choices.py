"""Queries of reserved places, ordered pairs, growing spans, detail budgets and signal alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.functions import scalars as C
from chronospan.operators import choices as H
from chronospan.operators import joins as J
from chronospan.operators import motion as V
from chronospan.operators import select as S
from chronospan.operators import signals as G

from .sequences import EV
from .tables import DAY, HOUR, WEEK, events, placed


def h4_distinct(spark, sf_dir):
    e = events(spark, sf_dir).where("value >= 5")
    got = H.distinct_candidates(e, ["user_id"], "us", [F.desc("value"), F.desc("k"), "event_id"], F.col("event_type").isin("error", "purchase"), DAY, 3)
    return got.select("user_id", "event_id", "place")


H4 = f"""WITH RECURSIVE {EV}, c AS (SELECT user_id, list(struct_pack(v := -value, k := -k, id := event_id, us := us, f := event_type IN ('error', 'purchase')) ORDER BY -value, -k, event_id) AS l FROM e WHERE value >= 5 GROUP BY 1),
r AS (SELECT user_id, 1 AS n, l[1] AS top, list_filter(l, lambda x: abs(x.us - l[1].us) >= 86400000000) AS rest FROM c
 UNION ALL SELECT user_id, n + 1, rest[1], list_filter(rest, lambda x: abs(x.us - rest[1].us) >= 86400000000) FROM r WHERE len(rest) > 0),
p AS (SELECT *, first(top.f) OVER (PARTITION BY user_id ORDER BY n) AS f FROM r), q AS (SELECT *, min(CASE WHEN top.f <> f THEN n END) OVER (PARTITION BY user_id) AS spot FROM p),
z AS (SELECT user_id, top.id AS event_id, (CASE WHEN n = spot THEN 2 WHEN n > 1 AND n < spot THEN n + 1 ELSE n END)::INT AS place FROM q)
SELECT * FROM z WHERE place <= 3"""


def e21_pairs(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("left_id"), F.col("us").alias("t"), F.explode(F.array(*[F.floor(F.col("us") / (12 * HOUR)) + d for d in (-1, 0, 1)])).alias("b"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("right_id"), F.col("us").alias("u"), F.floor(F.col("us") / (12 * HOUR)).alias("b"))
    gap = F.abs(F.col("t") - F.col("u")) / F.lit(float(HOUR))
    edges = a.join(b, ["user_id", "b"]).withColumn("distance", gap).where("distance < 12")
    return H.pairs_in_order(edges, ["user_id"], "left_id", "right_id", "distance", 0.25).withColumn("distance", F.round("distance", 9))


E21 = f"""WITH RECURSIVE {EV}, d AS (SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id, abs(a.us - b.us) / 3600000000.0::DOUBLE AS d FROM e a JOIN e b ON a.user_id = b.user_id
 WHERE a.event_type = 'purchase' AND b.event_type = 'view' AND abs(a.us - b.us) / 3600000000.0::DOUBLE < 12),
c AS (SELECT user_id, left_id, list(struct_pack(d := d, id := right_id) ORDER BY d, right_id) AS l FROM d GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY left_id) AS i FROM c),
r AS (SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS left_id, NULL::STRUCT(d DOUBLE, id BIGINT) AS pick FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.i, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.id) END, o.left_id, hit
 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT list_filter(o.l, lambda x: NOT list_contains(used, x.id)) AS open) f,
  LATERAL (SELECT CASE WHEN len(open) = 1 OR (len(open) > 1 AND open[2].d - open[1].d >= 0.25) THEN open[1] END AS hit) h)
SELECT user_id, left_id, pick.id AS right_id, round(pick.d, 9) AS distance FROM r WHERE pick IS NOT NULL"""


def e7_expand(spark, sf_dir):
    e = events(spark, sf_dir)
    spans = e.where("event_type = 'error'").select("user_id", "event_id", F.col("us").alias("start"), (F.col("us") + HOUR + F.col("k") * 60_000_000).alias("end"))
    parts = e.where("event_type <> 'error'").select("user_id", (F.col("us") - 2 * HOUR).alias("start"), (F.col("us") + HOUR * (F.col("k") % 7)).alias("end"))
    return S.expand_over(spans, parts, ["user_id"], "event_id", bucket=WEEK)


E7 = f"""WITH RECURSIVE {EV}, s AS (SELECT user_id, event_id, us AS a, us + 3600000000 + k * 60000000 AS b FROM e WHERE event_type = 'error'),
p AS (SELECT user_id, list(struct_pack(a := us - 7200000000, b := us + 3600000000 * (k % 7)) ORDER BY us - 7200000000, us + 3600000000 * (k % 7)) AS l FROM e WHERE event_type <> 'error' GROUP BY 1),
r AS (SELECT s.*, 0 AS n, 0 AS i, coalesce(l, []) AS l FROM s LEFT JOIN p USING (user_id)
 UNION ALL SELECT user_id, event_id, CASE WHEN m THEN least(a, x.a) ELSE a END, CASE WHEN m THEN greatest(b, x.b) ELSE b END, n + m::INT, i + 1, l
 FROM r, LATERAL (SELECT l[i + 1] AS x) y, LATERAL (SELECT greatest(a, x.a) < least(b, x.b) AS m) z WHERE i < len(l))
SELECT user_id, event_id, a AS "start", b AS "end", n FROM r WHERE i = len(l)"""


def g16_detail(spark, sf_dir):
    frames = events(spark, sf_dir).select("user_id", "event_id", (F.col("us") / 1e6).alias("t"), (F.col("k") < 40).alias("active"))
    return H.detail_plan(frames, ["user_id"], "t", "event_id", "active", 12)


G16 = f"""WITH RECURSIVE {EV}, p AS (SELECT user_id, event_id, us / 1e6::DOUBLE AS t, k < 40 AS a, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
d AS (SELECT *, t - lag(t) OVER w AS d, lag(a) OVER w AS pa FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)), u AS (SELECT user_id, coalesce(median(d), 0) AS usual FROM d GROUP BY 1),
g AS (SELECT d.*, sum(CASE WHEN a AND NOT coalesce(pa AND d <= 1.5 * usual + 1e-6, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) - 1 AS region FROM d JOIN u USING (user_id)),
runs AS (SELECT user_id, region, min(i) AS lo, count(*) AS len, (min(t) + max(t)) / 2 AS middle FROM g WHERE a GROUP BY ALL),
ranks AS (SELECT *, len >= 3 AND row_number() OVER (PARTITION BY user_id, len >= 3 ORDER BY len DESC, lo) <= 4 AS served FROM runs),
sized AS (SELECT *, least(len, 7, 12 // greatest(1, count(*) FILTER (served) OVER (PARTITION BY user_id))) AS size FROM ranks),
near AS (SELECT s.user_id, s.region, arg_min(g.i, struct_pack(d := abs(g.t - s.middle), i := g.i)) - any_value(s.lo) AS nearest FROM sized s JOIN g ON g.user_id = s.user_id AND g.region = s.region AND g.a WHERE served GROUP BY ALL),
starts AS (SELECT s.*, s.lo + greatest(0, least(len - size, nearest - (size - 1) // 2)) AS first FROM sized s LEFT JOIN near USING (user_id, region)),
bursts AS (SELECT user_id, unnest(range(first::BIGINT, (first + size)::BIGINT)) AS i FROM starts WHERE served),
sums AS (SELECT p.user_id, any_value(n) AS n, least(12, any_value(n)) AS want, list(t ORDER BY p.i) AS tl FROM p GROUP BY 1),
room AS (SELECT s.*, want - (SELECT count(*) FROM bursts b WHERE b.user_id = s.user_id) AS k FROM sums s),
evens AS (SELECT user_id, unnest(CASE WHEN k <= 0 THEN [] WHEN n <= k THEN range(n) WHEN k = 1 THEN [n // 2] ELSE list_transform(range(k), lambda j: round_even(j * (n - 1) / greatest(1, k - 1)::DOUBLE, 0)::BIGINT) END) AS i FROM room),
base AS (SELECT user_id, list(DISTINCT i) AS chosen FROM (FROM bursts UNION ALL FROM evens) GROUP BY 1),
r AS (SELECT user_id, chosen, want, n, tl FROM base JOIN sums USING (user_id)
 UNION ALL SELECT user_id, list_append(chosen, list_min(list_transform(list_filter(range(n), lambda x: NOT list_contains(chosen, x)), lambda x: struct_pack(d := -list_min(list_transform(chosen, lambda c: abs(tl[x + 1] - tl[c + 1]))), i := x))).i), want, n, tl
 FROM r WHERE len(chosen) < want),
last AS (SELECT user_id, chosen FROM r WHERE len(chosen) >= want)
SELECT g.user_id, g.event_id, list_contains(chosen, g.i) AS chosen, CASE WHEN a THEN g.region END::INT AS region,
 CASE WHEN NOT a THEN NULL WHEN served THEN 'burst' WHEN s.len < 3 THEN 'too_short' ELSE 'over_budget' END AS status
FROM g JOIN last USING (user_id) LEFT JOIN sized s ON s.user_id = g.user_id AND s.region = g.region AND g.a"""


def l19_alignment(spark, sf_dir):
    hours = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count_if(F.col("user_id") % 2 == 0).cast("double").alias("x"), F.count_if(F.col("user_id") % 2 == 1).cast("double").alias("y"))
    return G.best_lag(hours, ["event_type"], "hour", "x", "y", 24).withColumn("correlation", F.round("correlation", 6))


L19 = f"""WITH {EV}, h AS (SELECT event_type, us // 3600000000 AS p, (count(*) FILTER (user_id % 2 = 0))::DOUBLE AS x, (count(*) FILTER (user_id % 2 = 1))::DOUBLE AS y FROM e GROUP BY ALL),
m AS (SELECT event_type, avg(x) AS mx, avg(y) AS my FROM h GROUP BY 1), c AS (SELECT event_type, p, x - mx AS x, y - my AS y FROM h JOIN m USING (event_type)),
n AS (SELECT event_type, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny FROM c GROUP BY 1), g AS (SELECT unnest(range(-24, 25)) AS lag),
s AS (SELECT a.event_type, lag, sum(coalesce(a.x * b.y, 0)) AS s FROM c a CROSS JOIN g LEFT JOIN c b ON b.event_type = a.event_type AND b.p = a.p + lag GROUP BY ALL)
SELECT event_type, 'checked' AS status, lag, round(s / (nx * ny), 6) AS correlation FROM s JOIN n USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY s DESC, lag) = 1"""

def g13_impulses(spark, sf_dir):
    """Each user's events as a path: 25 places a second, value and k as coordinates."""
    p = placed(events(spark, sf_dir)).select("user_id", (F.col("pos") / 25.0).alias("t"), (F.col("value") / 2000).alias("x"), (F.col("k") / 10000.0).alias("y"))
    found = V.impulses(p, ["user_id"], "t", "x", "y", V.Impulses(error=0.02, jump=0.05))
    return found.select("user_id", F.round("t", 6).alias("t"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("jump", 6).alias("jump"), F.round("error", 6).alias("error"), "left_out")


def h5_cues(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "us", "k", (F.col("event_id") % 7).alias("label"), F.floor(F.col("us") / DAY).alias("day"))
    return S.spaced_choice(e, ["user_id"], "us", "k", "label", "day", 4, 1, 36 * HOUR).select("user_id", "event_id")


H5 = f"""WITH RECURSIVE {EV}, c AS (SELECT user_id, list(struct_pack(t := us, label := event_id % 7, day := us // 86400000000, id := event_id) ORDER BY k DESC, us, event_id % 7) AS l FROM e GROUP BY 1),
r AS (SELECT user_id, l, 0 AS i, l[1:0] AS kept FROM c
 UNION ALL SELECT user_id, l, i + 1, CASE WHEN len(list_filter(kept, lambda x: x.day = l[i + 1].day)) < 1 AND len(list_filter(kept, lambda x: abs(x.t - l[i + 1].t) < 129600000000 OR x.label = l[i + 1].label)) = 0 THEN list_append(kept, l[i + 1]) ELSE kept END
 FROM r WHERE i < len(l) AND len(kept) < 4)
SELECT user_id, unnest(list_transform(kept, lambda x: x.id)) AS event_id FROM (SELECT user_id, arg_max(kept, i) AS kept FROM r GROUP BY 1)"""


def g23_snap(spark, sf_dir):
    e = events(spark, sf_dir)
    cuts = e.where("event_type = 'error'").select(
        "user_id", "event_id", (F.col("us") - HOUR).alias("lead"), (F.col("us") + HOUR).alias("tail"),
        F.least(F.col("us") - HOUR, F.col("us") - (F.col("k") % 3 + 1) * HOUR).alias("left"), F.greatest(F.col("us") + HOUR, F.col("us") + F.col("k") * 60_000_000).alias("right"),
    )
    return J.snapped_outwards(cuts, e, ["user_id"], "lead", "tail", "us", ("left", "right"), WEEK, 0).select("event_id", "lead", "tail")


G23 = f"""WITH {EV}, c AS (SELECT user_id, event_id, us - 3600000000 AS lead, us + 3600000000 AS tail, least(us - 3600000000, us - (k % 3 + 1) * 3600000000) AS l, greatest(us + 3600000000, us + k * 60000000) AS r FROM e WHERE event_type = 'error')
SELECT event_id, coalesce((SELECT max(us) FROM e WHERE e.user_id = c.user_id AND us <= l), lead) AS lead, coalesce((SELECT min(us) FROM e WHERE e.user_id = c.user_id AND us >= r), tail) AS tail FROM c"""


def g15_hints(spark, sf_dir):
    p = placed(events(spark, sf_dir)).select("user_id", (F.col("pos") / 16.0).alias("t"), (F.col("value") / 250).alias("x"), (F.col("k") / 100.0).alias("y"))
    spans = p.groupBy("user_id").agg(F.lit(0.0).alias("start"), F.max("t").alias("end"))
    h = V.hint_windows(p, spans, ["user_id"], "t", "x", "y")
    return h.select("user_id", *[F.round(c, 6).alias(c) for c in ("start", "end", "x0", "y0", "x1")])


G15 = f"""WITH {EV}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) / 16.0::DOUBLE AS t, value / 250 AS x, k / 100.0::DOUBLE AS y FROM e),
s AS (SELECT user_id, max(t) AS b, greatest(1, ceil(max(t) / 1.2::DOUBLE)) AS n FROM p GROUP BY 1), w AS (SELECT user_id, b / n AS w, unnest(range(n::INT)) AS win FROM s),
m AS (SELECT w.user_id, win, win * w AS lo, (win + 1) * w AS hi, t, x, y, t - lag(t) OVER (PARTITION BY w.user_id, win ORDER BY t) AS hole FROM w JOIN p ON p.user_id = w.user_id AND t >= win * w - 0.25 AND t <= (win + 1) * w + 0.25),
b AS (SELECT user_id, lo, hi, count(*) AS n, min(t) AS t0, max(t) AS t1, max(hole) AS hole, min(x) AS x0, max(x) AS x1, min(y) AS y0 FROM m GROUP BY user_id, win, lo, hi),
z AS (SELECT *, least(1.0, greatest(0.42::DOUBLE, x1 - x0 + 0.28::DOUBLE)) AS wide, greatest(lo, t0) AS a, least(hi, t1) AS e FROM b WHERE n >= 3 AND t0 <= lo + 0.2 AND t1 >= hi - 0.2 AND hole <= 0.35),
f AS (SELECT *, greatest(0.0, least(1 - wide, (x0 + x1) / 2 - wide / 2)) AS l FROM z WHERE wide <= 0.82 AND a < e)
SELECT user_id, round(a, 6) AS "start", round(e, 6) AS "end", round(l, 6) AS x0, round(greatest(0.0, least(0.35::DOUBLE, y0 - 0.12::DOUBLE)), 6) AS y0, round(l + wide, 6) AS x1 FROM f"""


def l29_pool(spark, sf_dir):
    """Clips of a timeline as a pool to judge: padded, within the recording, with an id of their own."""
    e = events(spark, sf_dir)
    whole = e.groupBy("user_id").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    clip = C.padded_span(F.col("us"), F.col("us") + F.col("k") * 60_000_000, 2 * HOUR, 3 * HOUR, F.col("low"), F.col("high"))
    return e.join(whole, "user_id").select(C.item_digest(F.lit("pool"), "user_id", "event_id").alias("item"), "event_type", clip["start"].alias("clip_start"), clip["end"].alias("clip_end"))


L29 = f"""WITH {EV}, w AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS low, max(us) OVER (PARTITION BY user_id) AS high FROM e)
SELECT left(sha256(concat_ws('|', 'pool', user_id::VARCHAR, event_id::VARCHAR)), 20) AS item, event_type, greatest(low, us - 7200000000) AS clip_start, least(high, us + k * 60000000 + 10800000000) AS clip_end FROM w"""

def g10_follow(spark, sf_dir):
    """Each user's values as a path in days, followed at four places a day."""
    e = events(spark, sf_dir).groupBy("user_id", (F.col("us") / DAY).alias("t")).agg(F.max("value").alias("x"))
    got = V.follow_path(e, ["user_id"], "t", "x", 4.0, 20.0, 0.25, 5, 7.0)
    return got.select("user_id", F.round("t", 6).alias("t"), F.round("x", 6).alias("x"))


G10 = f"""WITH {EV}, p AS (SELECT user_id, us / 86400000000::DOUBLE AS t, max(value) AS x FROM e GROUP BY ALL), s AS (SELECT user_id, min(t) AS a, max(t) AS b FROM p GROUP BY 1),
g AS (SELECT user_id, a, unnest(range(floor((b - a) * 4)::BIGINT + 1)) AS i FROM s), h AS (SELECT user_id, i, i / 4.0::DOUBLE + a AS t FROM g),
l AS (SELECT h.*, p.t AS t0, p.x AS x0 FROM h ASOF JOIN p ON h.user_id = p.user_id AND h.t >= p.t), m AS (SELECT l.*, p.t AS t1, p.x AS x1 FROM l ASOF LEFT JOIN p ON l.user_id = p.user_id AND l.t <= p.t),
v AS (SELECT user_id, i, t, x0 + coalesce((x1 - x0) * (t - t0) / nullif(t1 - t0, 0), 0) AS v, least(t - t0, t1 - t) AS far, max(i) OVER (PARTITION BY user_id) AS n FROM m),
k AS (SELECT v.user_id, v.i, sum(w.v) / 5 AS s FROM v, (SELECT unnest([-2, -1, 0, 1, 2]) AS d) d JOIN v w ON w.user_id = v.user_id AND w.i = least(greatest(v.i + d, 0), v.n) GROUP BY ALL)
SELECT user_id, round(t, 6) AS t, round(greatest(0, least(1, 2 - far / 0.25)) * s + (1 - greatest(0, least(1, 2 - far / 0.25))) * 20, 6) AS x FROM v JOIN k USING (user_id, i)"""

QUERIES = {"g10_follow": g10_follow, "h5_cues": h5_cues, "g23_snap": g23_snap, "g15_hints": g15_hints, "l29_pool": l29_pool, "g13_impulses": g13_impulses, "h4_distinct": h4_distinct, "e21_pairs": e21_pairs, "e7_expand": e7_expand, "g16_detail": g16_detail, "l19_alignment": l19_alignment}
ORACLE_SQL = {"g10_follow": G10, "h5_cues": H5, "g23_snap": G23, "g15_hints": G15, "l29_pool": L29, "h4_distinct": H4, "e21_pairs": E21, "e7_expand": E7, "g16_detail": G16, "l19_alignment": L19}
