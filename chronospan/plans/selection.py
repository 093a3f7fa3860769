"""Queries of top-K, greedy selection, deduplication and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.functions import scalars as C
from chronospan.operators import select as S

from .sequences import EV
from .tables import HOUR, events, spans, table


def h1_shortlist(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return S.top_k(o.select("o_orderkey", "o_totalprice", "o_orderdate"), [F.desc("o_totalprice"), "o_orderdate", "o_orderkey"], 30).select("o_orderkey", "o_totalprice")


H1 = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 30"


def h6_best_each(spark, sf_dir):
    e = events(spark, sf_dir)
    return S.top_k_each(e, ["user_id"], [F.desc("value"), "us", "event_id"], 3).select("user_id", "rank", "event_id")


H6 = f"""WITH {EV} SELECT user_id, row_number() OVER w AS rank, event_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, us, event_id) QUALIFY rank <= 3"""


def h3_greedy(spark, sf_dir):
    s = spans(spark, sf_dir)
    return S.greedy_non_overlapping(s, ["user_id"], "start", "end", "value", "event_id", 5, 96.0 * HOUR).select("user_id", "event_id", "pick")


H3 = f"""WITH RECURSIVE {EV}, s AS (SELECT event_id, user_id, value, us AS a, us + 3600000000 + k * 60000000 AS b FROM e WHERE event_type IN ('purchase', 'error')),
c AS (SELECT user_id, list(struct_pack(v := -value, a := a, id := event_id, b := b) ORDER BY -value, a, event_id) AS l FROM s GROUP BY 1),
r AS (SELECT user_id, 1 AS pick, l[1] AS top, list_filter(l, lambda x: x.b <= l[1].a OR l[1].b <= x.a) AS rest FROM c
 UNION ALL SELECT user_id, pick + 1, rest[1], list_filter(rest, lambda x: x.b <= rest[1].a OR rest[1].b <= x.a) FROM r WHERE len(rest) > 0 AND pick < 5)
SELECT user_id, top.id AS event_id, pick FROM r"""


def h2_diverse(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("day", F.floor(F.col("start") / (24 * HOUR)).cast("long"))
    return S.diverse_top_k(s, ["day"], "user_id", "event_type", "start", "end", "value", "event_id", 5, 2.0 * HOUR).select("day", "event_id", "pick")


#: Each step takes the first best of the pool out; unless it overlaps a chosen one of its source it is picked and costs the rest.
H2 = f"""WITH RECURSIVE {EV}, s AS (SELECT event_id, user_id, event_type, value, us AS a, us + 3600000000 + k * 60000000 AS b FROM e WHERE event_type IN ('purchase', 'error')),
c AS (SELECT a // 86400000000 AS day, list(struct_pack(adj := value, src := user_id, kind := event_type, a := a, b := b, id := event_id) ORDER BY value DESC, user_id, a, event_id) AS pool FROM s GROUP BY 1),
r AS (SELECT day, 0 AS pick, NULL::BIGINT AS event_id, pool, pool[1:0] AS chosen FROM c
 UNION ALL SELECT day, CASE WHEN skip THEN pick ELSE pick + 1 END, CASE WHEN skip THEN NULL ELSE best.id END,
  CASE WHEN skip THEN rest ELSE list_transform(rest, lambda x: struct_pack(adj := x.adj - (3.0 * (x.src = best.src AND abs(x.a - best.a) < 7200000000)::INT + 1.0 * (x.kind = best.kind)::INT), src := x.src, kind := x.kind, a := x.a, b := x.b, id := x.id)) END,
  CASE WHEN skip THEN chosen ELSE list_append(chosen, best) END
 FROM r, LATERAL (SELECT list_position(list_transform(pool, lambda x: x.adj), list_max(list_transform(pool, lambda x: x.adj))) AS spot) p, LATERAL (SELECT pool[spot] AS best, list_concat(pool[1:spot - 1], pool[spot + 1:len(pool)]) AS rest) q,
  LATERAL (SELECT len(list_filter(chosen, lambda x: x.src = best.src AND greatest(x.a, best.a) < least(x.b, best.b))) > 0 AS skip) z
 WHERE pick < 5 AND len(pool) > 0)
SELECT day, event_id, pick FROM r WHERE event_id IS NOT NULL"""


def i3_merge(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("peak", (F.col("start") + F.col("end")) / 2)
    return S.merge_duplicates(s, ["user_id", "event_type"], "start", "end", "peak", ["value"], "event_id", 2.0 * HOUR, 0.6, 96.0 * HOUR).select("user_id", "event_type", "event_id", F.array_join("ids", ",").alias("ids"))


#: Rows in order, each against those kept: the newest it duplicates takes its id, and its place if it is worth less.
I3 = f"""WITH RECURSIVE {EV}, s AS (SELECT event_id, user_id, event_type, value, us AS a, us + 3600000000 + k * 60000000 AS b FROM e WHERE event_type IN ('purchase', 'error')),
o AS (SELECT user_id, event_type, struct_pack(a := a, b := b, p := (a + b) / 2, v := value, id := event_id, ids := [event_id]) AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY a, b, event_id) AS i FROM s),
r AS (SELECT user_id, event_type, i, [x] AS kept FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.event_type, o.i, CASE WHEN spot IS NULL THEN list_append(kept, x) ELSE list_transform(range(1, len(kept) + 1), lambda j: CASE WHEN j <> spot THEN kept[j] ELSE struct_pack(
   a := CASE WHEN x.v > kept[j].v THEN x.a ELSE kept[j].a END, b := CASE WHEN x.v > kept[j].v THEN x.b ELSE kept[j].b END, p := CASE WHEN x.v > kept[j].v THEN x.p ELSE kept[j].p END,
   v := CASE WHEN x.v > kept[j].v THEN x.v ELSE kept[j].v END, id := CASE WHEN x.v > kept[j].v THEN x.id ELSE kept[j].id END, ids := list_sort(list_append(kept[j].ids, x.id))) END) END
 FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.i = r.i + 1,
  LATERAL (SELECT list_max(list_filter(range(1, len(kept) + 1), lambda j: abs(x.p - kept[j].p) <= 7200000000 AND (least(x.b, kept[j].b) - greatest(x.a, kept[j].a)) / least(x.b - x.a, kept[j].b - kept[j].a) >= 0.6)) AS spot) z),
g AS (SELECT user_id, event_type, arg_max(kept, i) AS kept FROM r GROUP BY user_id, event_type), l AS (SELECT user_id, event_type, unnest(kept) AS x FROM g)
SELECT user_id, event_type, x.id AS event_id, array_to_string(x.ids, ',') AS ids FROM l"""


def h9_cohorts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")
    return S.cohorts(d, ["lang"], F.col("quality") == 1, "doc_id", 10, 30)


H9 = """WITH d AS (SELECT doc_id, lang, quality, quality = 1 AS positive FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, positive ORDER BY doc_id) AS i FROM d) SELECT doc_id, lang, quality, positive FROM r WHERE i <= CASE WHEN positive THEN 10 ELSE 30 END"""


def h10_even(spark, sf_dir):
    return S.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 7, F.floor(F.col("doc_id") / 4096))


H10 = """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM r WHERE n <= 7 OR i IN (SELECT round_even(j * (n - 1) / 6, 0) FROM (SELECT unnest(range(0, 7)) AS j))"""


def h14_shuffled(spark, sf_dir):
    return S.shuffled(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 20).select("p_brand", "p_partkey", "place")


H14 = "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(concat_ws('|', '20', p_brand, p_partkey::VARCHAR)), p_partkey) AS place FROM part"


def h15_blind_pool(spark, sf_dir):
    items = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    made = items.withColumn("condition", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("rater", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return made.select(C.item_digest(F.lit("v1"), "p_partkey").alias("item"), "condition", "rater", "p_size")


H15 = "SELECT left(sha256(concat_ws('|', 'v1', p_partkey::VARCHAR)), 20) AS item, condition, rater, p_size FROM part, (SELECT unnest(['a', 'b']) AS condition), (SELECT unnest([1, 2, 3]) AS rater)"


def i1_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").withColumn("mode", F.lit("rules"))
    parts = {p[0]: o.where(F.col("o_orderpriority") == p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    return S.top_k(S.namespaced_union(parts, "o_orderkey", ["mode"]), [F.desc("o_totalprice"), "o_orderkey"], 100).select("o_orderkey", "part", "o_totalprice")


I1 = """SELECT left(o_orderpriority, 1) || '__' || o_orderkey AS o_orderkey, left(o_orderpriority, 1) AS part, o_totalprice FROM orders
ORDER BY o_totalprice DESC, 1 LIMIT 100"""


def i4_best_per_key(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("event_type", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.max(F.struct("value", "event_id")).alias("b")).select("event_type", "hour", "b.event_id", "b.value")


I4 = f"""WITH {EV} SELECT event_type, us // 3600000000 AS hour, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY event_type, us // 3600000000 ORDER BY value DESC, event_id DESC) = 1"""


def i6_set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_totalprice > 200000").select("o_custkey"), o.where("o_orderstatus = 'F'").select("o_custkey")
    both, only = a.intersect(b).withColumn("side", F.lit("both")), a.exceptAll(b).distinct().join(b, "o_custkey", "left_anti").withColumn("side", F.lit("only"))
    return both.unionByName(only)


I6 = """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, 'both' AS side FROM a SEMI JOIN b USING (o_custkey) UNION ALL SELECT o_custkey, 'only' FROM a ANTI JOIN b USING (o_custkey)"""


def i7_split_guard(spark, sf_dir):
    from chronospan.functions import rules

    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    s = rules.shared_values(l, "l_returnflag", "l_partkey")
    return s.select("l_partkey", F.array_join("splits", ",").alias("splits"))


I7 = "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1"

QUERIES = {
    "h1_shortlist": h1_shortlist, "h2_diverse": h2_diverse, "h3_greedy": h3_greedy, "h6_best_each": h6_best_each, "h9_cohorts": h9_cohorts, "h10_even": h10_even,
    "h14_shuffled": h14_shuffled, "h15_blind_pool": h15_blind_pool, "i1_union": i1_union, "i3_merge": i3_merge, "i4_best_per_key": i4_best_per_key,
    "i6_set_difference": i6_set_difference, "i7_split_guard": i7_split_guard,
}
ORACLE_SQL = {"h1_shortlist": H1, "h2_diverse": H2, "h3_greedy": H3, "h6_best_each": H6, "h9_cohorts": H9, "h10_even": H10, "h14_shuffled": H14, "h15_blind_pool": H15, "i1_union": I1, "i3_merge": I3, "i4_best_per_key": I4, "i6_set_difference": I6, "i7_split_guard": I7}
