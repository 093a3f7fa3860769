"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.operators import joins as J

from .sequences import EV
from .tables import HOUR, WEEK, events, spans, table

SP = f"{EV}, s AS (SELECT event_id, user_id, event_type, value, us AS a, us + 3600000000 + k * 60000000 AS b FROM e WHERE event_type IN ('purchase', 'error'))"


def _two_kinds(spark, sf_dir):
    s = spans(spark, sf_dir)
    p = s.where("event_type = 'purchase'").select("event_id", "user_id", "start", "end")
    q = s.where("event_type = 'error'").select(F.col("event_id").alias("other_id"), "user_id", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return p, q


def e6_overlap(spark, sf_dir):
    p, q = _two_kinds(spark, sf_dir)
    met = J.overlap_join(p, q, ["user_id"], 2.0 * HOUR)
    return met.select("event_id", "other_id", F.least("start", "other_start").alias("span_start"), F.greatest("end", "other_end").alias("span_end"))


E6 = f"""WITH {SP} SELECT p.event_id, q.event_id AS other_id, least(p.a, q.a) AS span_start, greatest(p.b, q.b) AS span_end
FROM s p JOIN s q ON p.user_id = q.user_id AND p.event_type = 'purchase' AND q.event_type = 'error' AND greatest(p.a, q.a) < least(p.b, q.b)"""


def e10_contained(spark, sf_dir):
    e = events(spark, sf_dir)
    inner = e.where("event_type = 'click'").select("event_id", "user_id", F.col("us").alias("start"), (F.col("us") + 600_000_000).alias("end"))
    outer = spans(spark, sf_dir).select(F.col("event_id").alias("other_id"), "user_id", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return J.contained_join(inner, outer, ["user_id"], 2.0 * HOUR).select("event_id", "other_id")


E10 = f"""WITH {SP} SELECT e.event_id, s.event_id AS other_id FROM e JOIN s ON e.user_id = s.user_id AND e.event_type = 'click' AND s.a <= e.us AND e.us + 600000000 <= s.b"""


def e11_points(spark, sf_dir):
    pts = events(spark, sf_dir).where("event_type = 'view'").select("event_id", "user_id", "us")
    iv = spans(spark, sf_dir).select(F.col("event_id").alias("other_id"), "user_id", "start", "end")
    met = J.point_join(pts, iv, ["user_id"], "us", 2.0 * HOUR)
    return met.groupBy("other_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


E11 = f"""WITH {SP} SELECT s.event_id AS other_id, count(*) AS n, min(e.event_id) AS first_id FROM e JOIN s ON e.user_id = s.user_id AND e.event_type = 'view' AND s.a <= e.us AND e.us < s.b GROUP BY 1"""


def _near(anti):
    def q(spark, sf_dir):
        e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "us")
        return J.near_any(e.where("event_type = 'click'"), e.where("event_type = 'signup'").select("user_id", F.col("us").alias("o")), ["user_id"], "us", "o", 6.0 * HOUR, anti).select("event_id", "user_id")

    return q


def _near_sql(word):
    return f"""WITH {EV} SELECT event_id, user_id FROM e WHERE event_type = 'click' AND {word} EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.event_type = 'signup' AND abs(o.us - e.us) <= 21600000000)"""


def _asof(following):
    def q(spark, sf_dir):
        e = events(spark, sf_dir)
        probe = e.where("event_type = 'click'").select("event_id", "user_id", "us")
        data = e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"))
        return J.asof(probe, data, ["user_id"], "us", "view_id", following, bucket=WEEK).select("event_id", F.col("matched").alias("view_id"))

    return q


def _asof_sql(op, far):
    return f"""WITH {EV}, p AS (SELECT * FROM e WHERE event_type = 'click'), d AS (SELECT user_id, us, event_id AS view_id FROM e WHERE event_type = 'view'),
l AS (SELECT user_id, {far}(view_id, us) AS far FROM d GROUP BY 1)
SELECT p.event_id, coalesce(d.view_id, l.far) AS view_id FROM p ASOF LEFT JOIN d ON p.user_id = d.user_id AND p.us {op} d.us LEFT JOIN l ON p.user_id = l.user_id"""


def e20_neighbours(spark, sf_dir):
    e = events(spark, sf_dir)
    return J.neighbours(e, ["user_id"], "us", F.col("value") > 60, "event_id", bucket=WEEK).select("event_id", "previous", "following")


E20 = f"""WITH {EV} SELECT event_id, last_value(CASE WHEN value > 60 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
first_value(CASE WHEN value > 60 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM e"""


def e5_nearest(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    points = F.transform(F.sequence(F.lit(2), F.lit(62), F.lit(2)), lambda i: F.struct(F.get("v", i).alias("x"), F.get("v", i + 1).alias("y")))
    n = J.nearest_element(points, F.col("v")[0], F.col("v")[1])
    return v.select("vec_id", n["index"].alias("nearest"), F.round(n["distance"], 5).alias("distance"))


E5 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT vec_id, i, sqrt(pow(v[2 * i + 3] - v[1], 2) + pow(v[2 * i + 4] - v[2], 2)) AS d FROM v, (SELECT unnest(range(0, 31)) AS i))
SELECT vec_id, i::INT AS nearest, round(d, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1"""


def e9_boxes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    box = lambda i: F.struct(F.least(F.get("v", i), F.get("v", i + 2)).alias("x0"), F.greatest(F.get("v", i), F.get("v", i + 2)).alias("x1"), F.least(F.get("v", i + 1), F.get("v", i + 3)).alias("y0"), F.greatest(F.get("v", i + 1), F.get("v", i + 3)).alias("y1"))
    boxes = F.transform(F.sequence(F.lit(2), F.lit(58), F.lit(4)), box)
    return v.select("vec_id", J.any_box_contains(boxes, F.col("v")[0], F.col("v")[1], 0.12).alias("inside"))


E9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
b AS (SELECT vec_id, v[1] AS x, v[2] AS y, least(v[i+1], v[i+3]) AS x0, greatest(v[i+1], v[i+3]) AS x1, least(v[i+2], v[i+4]) AS y0, greatest(v[i+2], v[i+4]) AS y1 FROM v, (SELECT unnest(range(2, 59, 4)) AS i))
SELECT vec_id, bool_or(x BETWEEN x0 - (x1 - x0) * 0.12::DOUBLE AND x1 + (x1 - x0) * 0.12::DOUBLE AND y BETWEEN y0 - (y1 - y0) * 0.12::DOUBLE AND y1 + (y1 - y0) * 0.12::DOUBLE) AS inside FROM b GROUP BY 1"""


def e13_uncovered(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return c.join(o.where("o_totalprice > 400000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


E13 = "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"


def e18_semi(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l.where("l_discount > 0.09"), o.o_orderkey == l.l_orderkey, "left_semi").select("o_orderkey", "o_orderpriority")


E18 = "SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)"


def e15_reviewed_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    reviewed = o.where("o_totalprice > 300000").select("o_orderkey", F.lit("reviewed").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return o.join(reviewed.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(reviewed)


E15 = """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT coalesce(o_totalprice > 300000, false)
UNION ALL SELECT o_orderkey, 'reviewed', o_totalprice * 2 FROM orders WHERE o_totalprice > 300000"""


def e19_dimension(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    placed = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return placed.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


E19 = """SELECT r_name, n_name, count(s_suppkey) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


def e24_best_overlap(spark, sf_dir):
    p, q = _two_kinds(spark, sf_dir)
    return J.best_overlap(p, q, ["user_id"], "event_id", "other_id", 2.0 * HOUR).select("event_id", "best", "overlap")


E24 = f"""WITH {SP}, m AS (SELECT p.event_id, q.event_id AS best, least(p.b, q.b) - greatest(p.a, q.a) AS overlap FROM s p JOIN s q ON p.user_id = q.user_id AND p.event_type = 'purchase' AND q.event_type = 'error' AND greatest(p.a, q.a) < least(p.b, q.b)),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, best) = 1)
SELECT s.event_id, t.best, t.overlap FROM s LEFT JOIN t USING (event_id) WHERE s.event_type = 'purchase'"""


def e23_iou(spark, sf_dir):
    p, q = _two_kinds(spark, sf_dir)
    met = J.overlap_join(p, q, ["user_id"], 2.0 * HOUR)
    iou = J.overlap_ratio(*[F.col(c).cast("double") for c in ("start", "end", "other_start", "other_end")])
    return met.select("event_id", "other_id", F.round(iou, 6).alias("iou")).where("iou >= 0.5")


E23 = f"""WITH {SP}, m AS (SELECT p.event_id, q.event_id AS other_id, least(p.b, q.b) - greatest(p.a, q.a) AS i, p.b - p.a + q.b - q.a AS t FROM s p JOIN s q ON p.user_id = q.user_id AND p.event_type = 'purchase' AND q.event_type = 'error' AND greatest(p.a, q.a) < least(p.b, q.b))
SELECT event_id, other_id, round(i / (t - i), 6) AS iou FROM m WHERE round(i / (t - i), 6) >= 0.5"""


def e25_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    other = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    c = J.compare_rows(o.where("o_orderkey % 13 <> 0"), other, ["o_orderkey"], ["o_orderpriority", "o_orderstatus", "o_totalprice"])
    return c.groupBy("side", F.array_join("differing", ",").alias("differing")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


E25 = """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS st, o_orderpriority AS pr, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS tp FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, CASE WHEN b.o_orderkey IS NULL THEN 'left' WHEN a.o_orderkey IS NULL THEN 'right' ELSE 'both' END AS side, a.o_orderstatus IS DISTINCT FROM st AS ds, a.o_totalprice IS DISTINCT FROM tp AS dt FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT side, CASE WHEN side <> 'both' THEN '' ELSE concat_ws(',', CASE WHEN ds THEN 'o_orderstatus' END, CASE WHEN dt THEN 'o_totalprice' END) END AS differing, count(*) AS n, min(k) AS first_key FROM j GROUP BY 1, 2"""


def e28_overlay(spark, sf_dir):
    s = spans(spark, sf_dir)
    span = events(spark, sf_dir).groupBy("user_id").agg(F.floor(F.min("us") / HOUR).alias("a"), F.floor(F.max("us") / HOUR).alias("b"))
    bins = span.select("user_id", F.explode(F.sequence("a", "b")).alias("bin"))
    o = J.bin_overlay(s, ["user_id"], "start", "end", "value", bins, float(HOUR))
    return o.select("user_id", "bin", "score")


E28 = f"""WITH {SP}, u AS (SELECT user_id, unnest(range(min(us) // 3600000000, max(us) // 3600000000 + 1)) AS bin FROM e GROUP BY user_id),
x AS (SELECT user_id, value, unnest(range(a // 3600000000, ((b + 3599999999) // 3600000000))) AS bin FROM s), m AS (SELECT user_id, bin, max(value) AS v FROM x GROUP BY ALL)
SELECT user_id, bin, coalesce(v, 0) AS score FROM u LEFT JOIN m USING (user_id, bin)"""


def e26_match(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("us") / 3.6e9).select("user_id", "event_type", "t")
    return J.match_counts(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], "t", 3.0)


#: Two pointers over sorted times as a recursion: a pair within the tolerance is a match, else the earlier side moves on.
E26 = f"""WITH RECURSIVE {EV}, x AS (SELECT user_id, coalesce(list(us / 3.6e9 ORDER BY us) FILTER (event_type = 'click'), []) AS t, coalesce(list(us / 3.6e9 ORDER BY us) FILTER (event_type = 'view'), []) AS p FROM e WHERE event_type IN ('click', 'view') GROUP BY 1),
r AS (SELECT user_id, t, p, 1 AS i, 1 AS j, 0 AS tp FROM x
 UNION ALL SELECT user_id, t, p, CASE WHEN m OR t[i] < p[j] THEN i + 1 ELSE i END, CASE WHEN m OR t[i] >= p[j] THEN j + 1 ELSE j END, tp + m::INT FROM r, LATERAL (SELECT abs(t[i] - p[j]) <= 3.000000001 AS m) WHERE i <= len(t) AND j <= len(p))
SELECT user_id, max(tp)::BIGINT AS tp, (max(len(p)) - max(tp))::BIGINT AS fp, (max(len(t)) - max(tp))::BIGINT AS fn FROM r GROUP BY 1"""


QUERIES = {
    "e3_asof_next": _asof(True), "e4_asof_previous": _asof(False), "e5_nearest": e5_nearest, "e6_overlap": e6_overlap, "e9_boxes": e9_boxes,
    "e10_contained": e10_contained, "e11_points": e11_points, "e12_near_semi": _near(False), "e14_near_anti": _near(True), "e13_uncovered": e13_uncovered,
    "e15_reviewed_union": e15_reviewed_union, "e18_semi": e18_semi, "e19_dimension": e19_dimension, "e20_neighbours": e20_neighbours, "e23_iou": e23_iou,
    "e24_best_overlap": e24_best_overlap, "e25_compare": e25_compare, "e26_match": e26_match, "e28_overlay": e28_overlay,
}
ORACLE_SQL = {
    "e3_asof_next": _asof_sql("<=", "arg_max"), "e4_asof_previous": _asof_sql(">=", "arg_min"), "e5_nearest": E5, "e6_overlap": E6, "e9_boxes": E9,
    "e10_contained": E10, "e11_points": E11, "e12_near_semi": _near_sql(""), "e14_near_anti": _near_sql("NOT"), "e13_uncovered": E13, "e15_reviewed_union": E15,
    "e18_semi": E18, "e19_dimension": E19, "e20_neighbours": E20, "e23_iou": E23, "e24_best_overlap": E24, "e25_compare": E25, "e26_match": E26, "e28_overlay": E28,
}
