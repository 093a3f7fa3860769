"""Queries of stateful smoothing, final scores, served requests, session windows and joins of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.session import scratch
from chronospan.streaming import prefix as P
from chronospan.streaming import streams as T

from .sequences import EV
from .tables import events, placed, table


def g28_smooth(spark, sf_dir):
    return T.sizes_batch(placed(events(spark, sf_dir)), "user_id", "pos", "value")


G28 = f"""WITH RECURSIVE {EV}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, value AS v FROM e),
r AS (SELECT user_id, 0::BIGINT AS pos, 0::DOUBLE AS level, []::DOUBLE[] AS raw, []::DOUBLE[] AS acc, 0::BIGINT AS size FROM p WHERE pos = 1
 UNION ALL SELECT p.user_id, p.pos, CASE WHEN ok THEN moved ELSE level END, CASE WHEN ok THEN kept ELSE raw END,
  CASE WHEN NOT ok THEN acc WHEN len(acc) = 0 THEN [v] ELSE list_append(acc, round_even(moved, 0))[-12:] END, CASE WHEN NOT ok THEN round_even(base, 0)::BIGINT WHEN len(acc) = 0 THEN trunc(v)::BIGINT ELSE round_even(moved, 0)::BIGINT END
 FROM r JOIN p ON p.user_id = r.user_id AND p.pos = r.pos + 1,
  LATERAL (SELECT coalesce(v > 0, false) AS ok, CASE WHEN level > 0 THEN level WHEN len(acc) > 0 THEN list_aggregate(acc, 'median') ELSE 0 END AS base, list_append(raw, v)[-5:] AS kept) a,
  LATERAL (SELECT kept[-3:] AS recent, greatest(3, 0.55::DOUBLE * base) AS reach) b, LATERAL (SELECT len(recent) = 3 AND (list_min(recent) > base OR list_max(recent) < base) AS trend) c,
  LATERAL (SELECT CASE WHEN len(acc) = 0 THEN v WHEN trend THEN least(greatest(base * (1 - 0.6::DOUBLE) + list_aggregate(recent, 'median') * 0.6::DOUBLE, 3), 40)
   ELSE least(greatest(base * (1 - 0.3::DOUBLE) + least(greatest(v, base - reach), base + reach) * 0.3::DOUBLE, 3), 40) END AS moved) d)
SELECT user_id, pos, size FROM r WHERE pos > 0"""


def j1_session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


J1 = """WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, g"""


def j7_shared_scan(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(revenue).alias("revenue"), F.max("l_shipdate").alias("shipped"))
    met = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    late = F.col("shipped") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")
    return met.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.round(F.sum("revenue"), 2).alias("revenue"), F.count_if(late).alias("late"))


J7 = """WITH p AS (SELECT l_orderkey, count(*) AS lines, sum(l_extendedprice * (1 - l_discount)) AS revenue, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS orders, coalesce(sum(lines), 0)::BIGINT AS lines, round(sum(revenue), 2) AS revenue, count(*) FILTER (shipped > o_orderdate + INTERVAL 90 DAYS) AS late FROM orders LEFT JOIN p ON o_orderkey = l_orderkey GROUP BY 1"""

def _scored(spark, sf_dir):
    return placed(events(spark, sf_dir)).select("user_id", (F.col("pos") - 1).alias("pos"), (F.col("value") / 20 - 1).alias("x"))


def j12_prefix(spark, sf_dir):
    return P.final_scores(_scored(spark, sf_dir), ["user_id"], "pos", "x", 8, 3).withColumn("probability", F.round("probability", 6))


def j12_stream(spark, sf_dir):
    """The same rows by a stream over the scored events, four files a batch, as fast as they come.

    A user's events are in one file, so that its state is read and written in one batch, however many batches there are.
    """
    rows, path = _scored(spark, sf_dir), scratch(spark, "scored")
    rows.repartition("user_id").write.parquet(path)
    name, store = P.STATE_STORE
    was = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
        found = T.collect_stream(P.final_scores_stream(stream, "user_id", "pos", "x", 8, 3), "append", scratch(spark, "final"), scratch(spark, "progress"))
    finally:
        spark.conf.set(name, was)
    return found.withColumn("probability", F.round("probability", 6))


J12 = f"""WITH {EV}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS pos, value / 20 - 1 AS x, count(*) OVER (PARTITION BY user_id) AS n FROM e),
l AS (SELECT *, CASE WHEN n < 8 THEN 0 ELSE ((n - 8) // 3 + 1) * 3 END AS stop FROM p),
w AS (SELECT *, unnest(range(greatest(ceil((pos - 7) / 3.0::DOUBLE), 0)::BIGINT, pos // 3 + 1)) AS win FROM l),
s AS (SELECT user_id, win, avg(x) AS score FROM w WHERE win * 3 < stop GROUP BY ALL)
SELECT user_id, pos, round(1 / (1 + exp(-avg(score))), 6) AS probability FROM w JOIN s USING (user_id, win) WHERE pos < stop GROUP BY user_id, pos"""


def j11_served(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    asked = e.where("event_type IN ('purchase', 'error')").withColumn("until", F.timestamp_micros(F.col("us") + 3_600_000_000 + F.col("k") * 60_000_000))
    met = P.served(asked, e.where("event_type NOT IN ('purchase', 'error')"), "user_id", "event_id", "ts", "until", "ts", "3 HOURS", "1 hour")
    got = met.groupBy("user_id", "event_id").agg(F.count("t").alias("frames"), F.unix_micros(F.min("t")).alias("first_us"))
    return got.withColumn("status", F.when(F.col("frames") > 0, "served").otherwise("unavailable"))


J11 = f"""WITH {EV} SELECT a.user_id, a.event_id, count(b.us) AS frames, min(b.us) AS first_us, CASE WHEN count(b.us) > 0 THEN 'served' ELSE 'unavailable' END AS status
FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_type NOT IN ('purchase', 'error') AND b.us >= a.us AND b.us < a.us + 3600000000 + a.k * 60000000
WHERE a.event_type IN ('purchase', 'error') GROUP BY ALL"""

QUERIES = {"j11_served": j11_served, "j12_prefix": j12_prefix, "j12_stream": j12_stream, "g28_smooth": g28_smooth, "j1_session_windows": j1_session_windows, "j7_shared_scan": j7_shared_scan}
ORACLE_SQL = {"j11_served": J11, "j12_prefix": J12, "j12_stream": J12, "g28_smooth": G28, "j1_session_windows": J1, "j7_shared_scan": J7}
