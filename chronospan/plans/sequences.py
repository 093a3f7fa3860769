"""Queries of the sequence and bin operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospan.operators import aggregate as A
from chronospan.operators import islands as I
from chronospan.operators import select as S
from chronospan.operators import sequence as Q

from .tables import DAY, HOUR, WEEK, events, placed, table

EV = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def g1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Q.sessionize(events(spark, sf_dir), ["user_id"], "us", 2 * HOUR, "event_id", slack=1, bucket=WEEK)
    a = s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.round(F.sum("value"), 4).alias("total"))
    return S.top_k(a, [F.desc("n"), "start_us", "user_id"], 50)


G1 = f"""WITH {EV},
f AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000001 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(us) AS start_us, max(us) AS end_us, round(sum(value), 4) AS total
FROM s GROUP BY user_id, session ORDER BY n DESC, start_us, user_id LIMIT 50"""


def f5_bursts(spark, sf_dir):
    return Q.bursts(events(spark, sf_dir), ["user_id", "event_type"], "us", 12 * HOUR, 2, "event_id", WEEK)


F5 = f"""WITH {EV},
f AS (SELECT *, CASE WHEN us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, event_type, min(us) AS "start", max(us) AS "end", count(*) AS n FROM s GROUP BY user_id, event_type, session HAVING count(*) >= 2"""


def f1_fixed_bins(spark, sf_dir):
    return A.fixed_bins(
        events(spark, sf_dir), ["event_type"], "us", 6 * HOUR,
        {"n": F.count(F.lit(1)), "high_share": F.round(F.avg((F.col("value") > 20).cast("double")), 6), "users": F.count_distinct("user_id")},
    )


F1 = f"""WITH {EV},
h AS (SELECT event_type, us // 21600000000 AS bin, count(*) AS n, round(avg((value > 20)::INT), 6) AS high_share, count(DISTINCT user_id) AS users FROM e GROUP BY ALL),
s AS (SELECT event_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM h GROUP BY event_type)
SELECT event_type, bin, coalesce(n, 0) AS n, coalesce(high_share, 0) AS high_share, coalesce(users, 0) AS users FROM s LEFT JOIN h USING (event_type, bin)"""


def f3_histogram(spark, sf_dir):
    return A.histogram(events(spark, sf_dir), ["user_id"], "event_type")


F3 = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"


def f4_scaled_percentile(spark, sf_dir):
    return A.scaled_percentile(events(spark, sf_dir), ["event_type"], "value", 0.85).withColumn("scale", F.round("scale", 6))


F4 = "SELECT event_type, round(greatest(1.0, quantile_cont(value, 0.85)), 6) AS scale FROM events GROUP BY event_type"


def f6_rule_score(spark, sf_dir):
    e = events(spark, sf_dir)
    score = A.rule_score({"length": F.col("value") / 37, "recency": F.col("k") / 80.0, "kind": F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.3)}, {"length": 50.0, "recency": 30.0, "kind": 20.0})
    return e.select("event_id", F.round(score, 3).alias("score"))


F6 = f"""WITH {EV}
SELECT event_id, round(round_even(least(greatest(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.3 END, 0), 1)::DOUBLE * 20, 3)
 + round_even(least(greatest(value / 37, 0), 1) * 50, 3) + round_even(least(greatest(k / 80.0::DOUBLE, 0), 1) * 30, 3), 3) AS score FROM e"""


def f7_null_aware(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    m = F.create_map(
        F.lit("quantity"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity") / 12.5),
        F.lit("discount"), F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 40),
        F.lit("tax"), F.col("l_tax") * 50,
    )
    s = A.null_aware_score(m, {"quantity": 2.0, "discount": 1.0, "tax": 1.0})
    rows = l.select("l_returnflag", "l_linestatus", s.alias("s"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("s.score"), 6).alias("score"), F.round(F.avg("s.observed_weight"), 6).alias("weight"), F.sum(F.size("s.unknown")).alias("unknown"))


F7 = """WITH m AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag <> 'A' THEN l_quantity / 12.5 END AS q,
 CASE WHEN l_linestatus = 'F' THEN l_discount * 40 END AS d, l_tax * 50 AS t FROM lineitem),
s AS (SELECT *, (q IS NOT NULL)::INT * 2 + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT AS w FROM m)
SELECT l_returnflag, l_linestatus, round(avg(25 * (coalesce(2 * q, 0) + coalesce(d, 0) + coalesce(t, 0)) / w), 6) AS score, round(avg(w / 4), 6) AS weight,
 sum((q IS NULL)::INT + (d IS NULL)::INT + (t IS NULL)::INT)::BIGINT AS unknown FROM s GROUP BY ALL"""


def f8_window_scores(spark, sf_dir):
    e = placed(events(spark, sf_dir)).withColumn("pos", F.col("pos") - 1)
    return A.window_mean_sigmoid(e.withColumn("x", F.col("value") / 20 - 1), ["user_id"], "pos", "x", 8, 4).withColumn("probability", F.round("probability", 6))


F8 = f"""WITH {EV}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS pos, value / 20 - 1 AS x FROM e)
SELECT user_id, pos, round(1 / (1 + exp(-avg(x))), 6) AS probability FROM p GROUP BY user_id, pos"""


def f27_robust_z(spark, sf_dir):
    z = A.robust_z(events(spark, sf_dir), ["event_type"], "value", 3.0)
    return A.jumps(z, ["user_id"], "us", "value", 9.0, "event_id", WEEK).select("event_id", F.round("z", 6).alias("z"), "transient")


F27 = f"""WITH {EV}, c AS (SELECT event_type, median(value) AS c FROM e GROUP BY 1), d AS (SELECT * FROM e JOIN c USING (event_type)),
s AS (SELECT event_type, greatest(3.0, median(abs(value - c)) * 1.4826) AS s FROM d GROUP BY 1)
SELECT event_id, round((value - c) / s, 6) AS z, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) > 9, false) AS transient FROM d JOIN s USING (event_type)"""


def f28_status(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(A.status(F.bool_and(F.col("value") > 1), F.bool_or(F.col("value") > 1)).alias("status"), F.round(F.sum("value"), 4).alias("total"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


F28 = """SELECT user_id, CASE WHEN bool_and(value > 1) THEN 'complete' WHEN bool_or(value > 1) THEN 'partial' ELSE 'unavailable' END AS status,
 round(sum(value), 4) AS total, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id"""


def g4_missing_runs(spark, sf_dir):
    b = A.fixed_bins(events(spark, sf_dir), ["user_id"], "us", 6 * HOUR, {"n": F.count(F.lit(1))})
    return Q.missing_runs(b.drop("n").withColumn("seen", F.lit(True)).join(b.select("user_id", "bin", "n"), ["user_id", "bin"]), ["user_id"], "bin", F.col("n") > 0, 4)


G4 = f"""WITH {EV}, h AS (SELECT user_id, us // 21600000000 AS bin FROM e GROUP BY ALL),
s AS (SELECT user_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM h GROUP BY user_id),
m AS (SELECT s.*, s.bin - row_number() OVER (PARTITION BY s.user_id ORDER BY s.bin) AS isl FROM s ANTI JOIN h ON s.user_id = h.user_id AND s.bin = h.bin)
SELECT user_id, min(bin) AS "start", max(bin) + 1 AS "end", count(*) AS n FROM m GROUP BY user_id, isl HAVING count(*) <= 4"""


def g2_islands(spark, sf_dir):
    b = A.fixed_bins(events(spark, sf_dir), ["user_id"], "us", 12 * HOUR, {"n": F.count(F.lit(1))})
    return Q.sessionize(b.where("n > 0"), ["user_id"], "bin", 2, bucket=1024).groupBy("user_id", "session").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end"), F.sum("n").alias("n")).drop("session")


G2 = f"""WITH {EV}, h AS (SELECT user_id, us // 43200000000 AS bin, count(*) AS n FROM e GROUP BY ALL),
f AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY user_id ORDER BY bin) > 2 THEN 1 ELSE 0 END AS b FROM h),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(bin) AS "start", max(bin) + 1 AS "end", sum(n)::BIGINT AS n FROM s GROUP BY user_id, g"""


def g6_runs(spark, sf_dir):
    e = I.ranked(events(spark, sf_dir), ["event_type"], F.floor(F.col("us") / DAY), ["us", "event_id"])
    return Q.runs(e, ["event_type"], "pos", F.col("value") >= 12, F.col("value"))


G6 = f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS pos FROM e),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY event_type ORDER BY pos) AS isl FROM p WHERE value >= 12)
SELECT event_type, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS n, max(value) AS peak FROM i GROUP BY event_type, isl"""


def g3_split(spark, sf_dir):
    e = events(spark, sf_dir)
    day = e.groupBy("user_id").agg(F.min("us").alias("start"), (F.max("us") + 1).alias("end"))
    cores = Q.bursts(e.where("value > 12"), ["user_id"], "us", 12 * HOUR, 2, "event_id", WEEK).select("user_id", "start", "end")
    return Q.split_at(day, cores, ["user_id"], width=WEEK).select("user_id", F.col("start").cast("long"), F.col("end").cast("long"))


G3 = f"""WITH {EV}, d AS (SELECT user_id, min(us) AS a, max(us) + 1 AS b FROM e GROUP BY 1),
f AS (SELECT *, CASE WHEN us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS n FROM e WHERE value > 12 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM f),
c AS (SELECT user_id, min(us) AS x, max(us) AS y FROM s GROUP BY user_id, g HAVING count(*) >= 2),
m AS (SELECT user_id, (y + lead(x) OVER (PARTITION BY user_id ORDER BY x)) / 2 AS cut FROM c),
p AS (SELECT user_id, a::DOUBLE AS t FROM d UNION ALL SELECT user_id, b FROM d UNION ALL SELECT user_id, cut FROM m WHERE cut IS NOT NULL),
q AS (SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e2 FROM p)
SELECT user_id, trunc(s)::BIGINT AS "start", trunc(e2)::BIGINT AS "end" FROM q WHERE e2 IS NOT NULL"""


def g7_dilate(spark, sf_dir):
    return Q.dilate(events(spark, sf_dir), ["user_id"], "us", F.col("event_type") == "error", HOUR).select("event_id", "near_hit")


G7 = f"""WITH {EV} SELECT event_id, max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 3600000000 FOLLOWING) = 1 AS near_hit FROM e"""


def g9_smooth(spark, sf_dir):
    return Q.smooth_edges(placed(events(spark, sf_dir)), ["user_id"], "pos", "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


G9 = f"""WITH {EV}, p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
o AS (SELECT event_id, user_id, least(greatest(pos + d, 1), n) AS at FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS d))
SELECT o.event_id, round(sum(p.value) / 5, 6) AS smooth FROM o JOIN p ON o.user_id = p.user_id AND o.at = p.pos GROUP BY o.event_id"""


def g11_peaks(spark, sf_dir):
    e = I.ranked(events(spark, sf_dir), ["event_type"], F.floor(F.col("us") / DAY), ["us", "event_id"])
    return Q.local_peaks(e, ["event_type"], "pos", "value", 15.0, 1 << 16).select("event_id", "pos")


G11P = f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS pos FROM e),
l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM p WINDOW w AS (PARTITION BY event_type ORDER BY pos))
SELECT event_id, pos FROM l WHERE value >= 15 AND value > coalesce(a, -1e300) AND value >= coalesce(b, -1e300)"""


def g11_nms(spark, sf_dir):
    e = events(spark, sf_dir).where("value >= 10").withColumn("t", F.col("us").cast("double"))
    return Q.suppress(e.select("event_id", "user_id", "event_type", "t", "value"), ["user_id", "event_type"], "t", "value", 24.0 * HOUR).select("event_id", "user_id", "event_type")


#: Greedy suppression as a recursion: the best row left is kept and takes those near it out.
G11N = f"""WITH RECURSIVE {EV}, c AS (SELECT user_id, event_type, list(struct_pack(v := -value, us := us, id := event_id) ORDER BY -value, us) AS l FROM e WHERE value >= 10 GROUP BY ALL),
r AS (SELECT user_id, event_type, l[1] AS top, list_filter(l, lambda x: abs(x.us - l[1].us) > 86400000000) AS rest FROM c
 UNION ALL SELECT user_id, event_type, rest[1], list_filter(rest, lambda x: abs(x.us - rest[1].us) > 86400000000) FROM r WHERE len(rest) > 0)
SELECT top.id AS event_id, user_id, event_type FROM r"""


def g12_soft_targets(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", (F.col("us") - F.lit(1704067200000000)) / 3.6e9)
    return Q.soft_targets(e, ["user_id"], "t", 1.0, 2.0, 720).withColumn("target", F.round("target", 6))


G12 = f"""WITH {EV}, t AS (SELECT user_id, (us - 1704067200000000) / 3.6e9 AS t FROM e),
x AS (SELECT user_id, t, unnest(range(greatest(ceil(t - 6), 0)::BIGINT, least(floor(t + 6), 719)::BIGINT + 1)) AS frame FROM t)
SELECT user_id, frame, round(max(exp(-0.5 * ((frame - t) / 2) * ((frame - t) / 2))), 6) AS target FROM x GROUP BY ALL"""


def g18_windows(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    rel = e.select("user_id", ((F.col("b") - F.col("a")) / 3.6e9).alias("d"))
    return Q.windows(rel, F.lit(0.0), F.col("d"), 24.0, 4.0).select("user_id", "win", "win_start", F.round("win_end", 6).alias("win_end"))


G18 = f"""WITH {EV}, d AS (SELECT user_id, (max(us) - min(us)) / 3.6e9 AS d FROM e GROUP BY 1),
w AS (SELECT user_id, d, unnest(range(0, greatest(1, ceil((d - 4) / 20))::INT)) AS win FROM d)
SELECT user_id, win, win * 20.0::DOUBLE AS win_start, round(least(win * 20.0 + 24, d), 6) AS win_end FROM w"""


def g19_owned_windows(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(((F.max("us") - F.min("us")) / 3.6e9).alias("d"))
    return Q.owned_windows(e, ["user_id"], F.lit(0.0), F.col("d"), 24.0, 4.0).select("user_id", "win", F.round("own_start", 6).alias("own_start"), F.round("own_end", 6).alias("own_end"))


G19 = f"""WITH {EV}, d AS (SELECT user_id, (max(us) - min(us)) / 3.6e9 AS d FROM e GROUP BY 1),
w AS (SELECT user_id, d, unnest(range(0, greatest(1, ceil((d - 4) / 20))::INT)) AS win FROM d), x AS (SELECT *, win * 20.0::DOUBLE AS a, least(win * 20.0 + 24, d) AS b FROM w)
SELECT user_id, win, round(coalesce((lag(b) OVER o + a) / 2, a), 6) AS own_start, round(coalesce((b + lead(a) OVER o) / 2, b), 6) AS own_end FROM x WINDOW o AS (PARTITION BY user_id ORDER BY win)"""


def g24_samples(spark, sf_dir):
    return Q.sample_slots(events(spark, sf_dir), ["user_id"], "us", F.lit(1704067200000000), 24.0 * HOUR).select("event_id", "user_id", "slot")


G24 = f"""WITH {EV}, s AS (SELECT *, floor((us - 1704067200000000) / 86400000000.0::DOUBLE + 1e-6)::BIGINT AS slot FROM e)
SELECT event_id, user_id, slot FROM s QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY us) = 1"""


def g26_offsets(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return Q.running_offsets(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "q"], "q")


G26 = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q FROM lineitem)
SELECT *, (sum(q) OVER w)::BIGINT AS offset_end, (sum(q) OVER w - q)::BIGINT AS offset_start FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, q ROWS UNBOUNDED PRECEDING)"""


def g5_merge_capped(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", (F.col("us") - 2 * HOUR).alias("start"), (F.col("us") + 2 * HOUR).alias("end"))
    return Q.merge_capped(e, ["user_id"], "start", "end", 12 * HOUR)


G5 = f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, us - 7200000000 AS a, us + 7200000000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e),
r AS (SELECT user_id, i, a, b, 1 AS n, 1 AS g FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.i, CASE WHEN m THEN r.a ELSE o.a END, CASE WHEN m THEN greatest(o.b, r.b) ELSE o.b END, CASE WHEN m THEN r.n + 1 ELSE 1 END, CASE WHEN m THEN r.g ELSE r.g + 1 END
 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT o.a <= r.b AND greatest(o.b, r.b) - r.a <= 43200000000 AS m))
SELECT user_id, max(a) AS "start", max(b) AS "end", max(n) AS n FROM r GROUP BY user_id, g"""


def g25_refractory(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "us")
    return Q.refractory(e, ["user_id"], "us", 24 * HOUR, "event_id")


G25 = f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1
 UNION ALL SELECT r.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = r.user_id AND e.us >= r.us + 86400000000) AS us FROM r WHERE r.us IS NOT NULL)
SELECT e.event_id, e.user_id, e.us FROM e JOIN r ON e.user_id = r.user_id AND e.us = r.us"""


def g8_reversals(spark, sf_dir):
    return Q.reversals(placed(events(spark, sf_dir)), ["user_id"], "us", "value", 1, 5.0, 24 * HOUR, "pos")


G8 = f"""WITH RECURSIVE {EV}, w AS (SELECT user_id, us, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY us) AS b, lead(value) OVER (PARTITION BY user_id ORDER BY us) - value AS a FROM e),
t AS (SELECT user_id, us, value FROM w WHERE b * a < 0 AND abs(b) >= 5 AND abs(a) >= 5), r AS (SELECT user_id, min(us) AS us FROM t GROUP BY 1
 UNION ALL SELECT r.user_id, (SELECT min(t.us) FROM t WHERE t.user_id = r.user_id AND t.us >= r.us + 86400000000) AS us FROM r WHERE r.us IS NOT NULL)
SELECT t.user_id, t.us, t.value FROM t JOIN r ON t.user_id = r.user_id AND t.us = r.us"""


def c4_kinematics(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("us") / 1e6).withColumn("y", F.col("k").cast("double"))
    return Q.kinematics(e, ["user_id"], "t", "value", "y", 0.0333, 100.0, "event_id", WEEK / 1e6).select("event_id", F.round("dt", 4).alias("dt"), F.round("speed", 8).alias("speed"))


C4 = f"""WITH {EV} SELECT event_id, round(coalesce(us / 1e6 - lag(us / 1e6) OVER w, 0.0333), 4) AS dt,
 round(sqrt(pow(coalesce(value - lag(value) OVER w, 0), 2) + pow(coalesce(k - lag(k) OVER w, 0), 2)) / (coalesce(us / 1e6 - lag(us / 1e6) OVER w, 0.0333) * 100), 8) AS speed
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)"""


def j8_tumbling(spark, sf_dir):
    c = Q.tumbling(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3)
    label = c.groupBy("conv_id", "block").agg(F.max(F.struct(F.length("text"), "role", "turn")).alias("m"))
    return c.select("conv_id", "turn", "block").join(label.select("conv_id", "block", F.col("m.role").alias("label")), ["conv_id", "block"])


J8 = """WITH c AS (SELECT conv_id, turn, turn // 3 AS block, role, length(text) AS n FROM conversations),
l AS (SELECT conv_id, block, max(struct_pack(n := n, role := role, turn := turn)).role AS label FROM c GROUP BY ALL)
SELECT conv_id, turn, block, label FROM c JOIN l USING (conv_id, block)"""


def j9_buffer(spark, sf_dir):
    b = Q.rolling_buffer(placed(events(spark, sf_dir)), ["user_id"], "pos", "event_id", 9)
    return b.select("event_id", F.array_join(F.transform("buffer", lambda x: x.cast("string")), ",").alias("buffer"))


J9 = f"""WITH {EV}, p AS (SELECT *, list(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 8 PRECEDING) AS l, first(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS f FROM e)
SELECT event_id, array_to_string(list_concat(list_resize([]::BIGINT[], 9 - len(l), f), l), ',') AS buffer FROM p"""

QUERIES = {
    "g1_sessions": g1_sessions, "f1_fixed_bins": f1_fixed_bins, "f3_histogram": f3_histogram, "f4_scaled_percentile": f4_scaled_percentile,
    "f5_bursts": f5_bursts, "f6_rule_score": f6_rule_score, "f7_null_aware": f7_null_aware, "f8_window_scores": f8_window_scores, "f27_robust_z": f27_robust_z,
    "f28_status": f28_status, "g2_islands": g2_islands, "g3_split": g3_split, "g4_missing_runs": g4_missing_runs, "g5_merge_capped": g5_merge_capped,
    "g6_runs": g6_runs, "g7_dilate": g7_dilate, "g8_reversals": g8_reversals, "g9_smooth": g9_smooth, "g11_peaks": g11_peaks, "g11_nms": g11_nms,
    "g12_soft_targets": g12_soft_targets, "g18_windows": g18_windows, "g19_owned_windows": g19_owned_windows, "g24_samples": g24_samples,
    "g25_refractory": g25_refractory, "g26_offsets": g26_offsets, "c4_kinematics": c4_kinematics, "j8_tumbling": j8_tumbling, "j9_buffer": j9_buffer,
}
ORACLE_SQL = {
    "g1_sessions": G1, "f1_fixed_bins": F1, "f3_histogram": F3, "f4_scaled_percentile": F4, "f5_bursts": F5, "f6_rule_score": F6, "f7_null_aware": F7,
    "f8_window_scores": F8, "f27_robust_z": F27, "f28_status": F28, "g2_islands": G2, "g3_split": G3, "g4_missing_runs": G4, "g5_merge_capped": G5,
    "g6_runs": G6, "g7_dilate": G7, "g8_reversals": G8, "g9_smooth": G9, "g11_peaks": G11P, "g11_nms": G11N, "g12_soft_targets": G12, "g18_windows": G18,
    "g19_owned_windows": G19, "g24_samples": G24, "g25_refractory": G25, "g26_offsets": G26, "c4_kinematics": C4, "j8_tumbling": J8, "j9_buffer": J9,
}
