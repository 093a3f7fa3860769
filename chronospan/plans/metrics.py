"""Queries of the ranking metrics and rating agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.operators import metrics as M
from chronospan.operators.quantiles import exact_quantiles

from .tables import events, ratings, scored

SC = "s AS (SELECT doc_id, lang, quality = 1 AS truth, least(floor(n_chars / 50), 100) / 100.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
RT = "r AS (SELECT event_id, epoch_us(ts) // 3600000000 AS unit, (user_id % 3)::INT AS rater, event_type AS kind, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 <> 0 THEN least(floor(value / 10), 4)::INT END AS grade FROM events)"
TG = f"""{SC}, g AS (SELECT lang, score, sum(truth::INT) AS p, sum((NOT truth)::INT) AS n FROM s GROUP BY ALL),
t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""


def f16_ap_auroc(spark, sf_dir):
    m = M.ap_auroc(scored(spark, sf_dir), ["lang"], "truth", "score")
    return m.withColumn("ap", F.round("ap", 9)).withColumn("auroc", F.round("auroc", 9))


F16 = f"""WITH {TG}, m AS (SELECT lang, sum(p) AS np, sum(n) AS nn, sum(p * tp / (tp + fp)) AS ap, sum(n * (tp - p / 2)) AS auc FROM t GROUP BY 1)
SELECT lang, np::BIGINT AS n_pos, nn::BIGINT AS n_neg, CASE WHEN np > 0 AND nn > 0 THEN round(ap / np, 9) END AS ap, CASE WHEN np > 0 AND nn > 0 THEN round(auc / (np * nn), 9) END AS auroc FROM m"""


def f18_macro(spark, sf_dir):
    m = M.ap_auroc(scored(spark, sf_dir), ["lang"], "truth", "score", empty_is_null=False)
    return m.agg(F.round(F.avg("ap"), 9).alias("macro_ap"), F.count(F.lit(1)).alias("groups"))


F18 = f"""WITH {TG}, m AS (SELECT lang, coalesce(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 0) AS ap FROM t GROUP BY 1) SELECT round(avg(ap), 9) AS macro_ap, count(*) AS groups FROM m"""


def f17_hits(spark, sf_dir):
    return M.hit_at(scored(spark, sf_dir), ["lang"], "truth", "score", "doc_id", 5)


F17 = f"""WITH {SC}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS i FROM s)
SELECT lang, max(truth::INT) FILTER (i = 1) AS hit_1, max(truth::INT) AS hit_k FROM k WHERE i <= 5 GROUP BY lang"""


def f19_folds(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("hit", (F.col("score") >= 0.5))
    tp, fp, fn = F.count_if(F.col("hit") & F.col("truth")), F.count_if(F.col("hit") & ~F.col("truth")), F.count_if(~F.col("hit") & F.col("truth"))
    c = s.rollup("lang").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.grouping("lang").cast("int").alias("is_total"))
    return c.select("lang", "is_total", "tp", "fp", "fn", *[F.round(x, 9).alias(n) for x, n in zip(M.prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)])


F19 = f"""WITH {SC}, c AS (SELECT lang, grouping(lang)::INT AS is_total, count(*) FILTER (score >= 0.5 AND truth) AS tp, count(*) FILTER (score >= 0.5 AND NOT truth) AS fp, count(*) FILTER (score < 0.5 AND truth) AS fn FROM s GROUP BY ROLLUP (lang))
SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c"""


def f21_threshold(spark, sf_dir):
    return M.f2_threshold(scored(spark, sf_dir), ["lang"], "truth", "score").withColumn("f2", F.round("f2", 9))


F21 = f"""WITH {TG}, n AS (SELECT lang, sum(p) AS np, max(score) AS top FROM g GROUP BY 1),
c AS (SELECT lang, score AS th, tp, fp, np FROM t JOIN n USING (lang) UNION ALL SELECT lang, 1.0, 0, 0, np FROM n WHERE top < 1),
f AS (SELECT lang, th, coalesce(5 * tp / nullif(tp + 4 * np + fp, 0), 0) AS f2 FROM c)
SELECT lang, th AS threshold, round(f2, 9) AS f2 FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(f2, 15) DESC, th DESC) = 1"""


def f10_consensus(spark, sf_dir):
    return M.consensus(ratings(spark, sf_dir), ["unit"], "grade")


F10 = f"""WITH {RT} SELECT unit, count(grade) AS n, max(grade) - min(grade) >= 2 AS disputed, CASE WHEN count(grade) >= 3 THEN median(grade) END AS consensus FROM r GROUP BY unit"""


def f11_majority(spark, sf_dir):
    return M.majority(ratings(spark, sf_dir).withColumn("high", F.col("grade") >= 3), ["unit"], "high")


F11 = f"""WITH {RT}, c AS (SELECT unit, count(*) FILTER (grade >= 3) AS yes, count(*) FILTER (grade < 3) AS no FROM r GROUP BY unit)
SELECT *, CASE WHEN yes + no >= 3 AND yes <> no THEN yes > no END AS majority, yes > 0 AND no > 0 AS contradicted FROM c"""


def f9_alpha(spark, sf_dir):
    return M.ordinal_alpha(ratings(spark, sf_dir), ["unit"], "grade", ["kind"]).withColumn("alpha", F.round("alpha", 9))


F9 = f"""WITH {RT}, x AS (SELECT kind, unit, grade, count(*) OVER (PARTITION BY kind, unit) AS m, row_number() OVER () AS i FROM r WHERE grade IS NOT NULL),
y AS (SELECT * FROM x WHERE m >= 2),
o AS (SELECT a.kind, a.grade AS j, b.grade AS k, sum(1 / (a.m - 1)) AS o FROM y a JOIN y b ON a.kind = b.kind AND a.unit = b.unit AND a.i <> b.i GROUP BY ALL),
n AS (SELECT kind, j, sum(o) AS n FROM o GROUP BY ALL), g AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY j) - n / 2 AS mid FROM n),
s AS (SELECT a.kind, sum(coalesce(o, 0) * pow(a.mid - b.mid, 2)) AS ob, sum(a.n * b.n * pow(a.mid - b.mid, 2)) AS ex, sum(coalesce(o, 0)) AS n FROM g a JOIN g b ON a.kind = b.kind LEFT JOIN o ON o.kind = a.kind AND o.j = a.j AND o.k = b.j GROUP BY 1)
SELECT kind, round(n, 6) AS n_pairable, CASE WHEN ex > 0 THEN round(1 - (n - 1) * ob / ex, 9) END AS alpha, CASE WHEN n < 2 THEN 'no_pairs' WHEN ex <= 0 THEN 'no_variation' ELSE 'ok' END AS status FROM s"""


def f13_ndcg(spark, sf_dir):
    r = ratings(spark, sf_dir).where("grade is not null").withColumn("score", F.col("event_id") * 7919 % 1000)
    return M.ndcg(r, ["unit"], "grade", "score", "event_id").select("unit", *[F.round(c, 9).alias(c) for c in ("dcg", "ideal", "ndcg")])


F13 = f"""WITH {RT}, x AS (SELECT unit, grade, row_number() OVER (PARTITION BY unit ORDER BY event_id * 7919 % 1000 DESC, event_id) AS i, row_number() OVER (PARTITION BY unit ORDER BY grade DESC, event_id) AS j FROM r WHERE grade IS NOT NULL),
s AS (SELECT unit, sum(CASE WHEN i <= 5 THEN grade / log2(i + 1) ELSE 0 END) AS d, sum(CASE WHEN j <= 5 THEN grade / log2(j + 1) ELSE 0 END) AS b FROM x GROUP BY 1)
SELECT unit, round(d, 9) AS dcg, round(b, 9) AS ideal, round(d / nullif(b, 0), 9) AS ndcg FROM s"""


def f14_bootstrap(spark, sf_dir):
    b = M.bootstrap_mean(events(spark, sf_dir), ["event_type"], "user_id", "value", draws=500)
    return b.select("event_type", "clusters", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


F14 = f"""WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL), d AS (SELECT *, unnest(range(1, 501)) AS draw FROM m),
u AS (SELECT *, ('0x' || left(md5(concat_ws('|', '7', event_type, user_id::VARCHAR, draw::VARCHAR)), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d),
w AS (SELECT *, {' + '.join(f'(u >= {p!r}::DOUBLE)::INT' for p in M.POISSON)} AS w FROM u),
g AS (SELECT event_type, draw, count(*) AS n, avg(m) AS mean, sum(w) AS w, sum(w * m) AS s FROM w GROUP BY ALL)
SELECT event_type, max(n) AS clusters, round(max(mean), 6) AS mean, round(quantile_cont(CASE WHEN n >= 10 AND w > 0 THEN s / w END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN n >= 10 AND w > 0 THEN s / w END, 0.975), 6) AS high FROM g GROUP BY 1"""


def f22_timings(spark, sf_dir):
    e = events(spark, sf_dir)
    points = exact_quantiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return points.join(mean, "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean")


F22 = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1"


def f24_grid(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i / 10.0)))
    hit = F.col("score") >= F.col("threshold")
    c = s.groupBy("lang", "threshold").agg(F.count_if(hit & F.col("truth")).alias("tp"), F.count_if(hit & ~F.col("truth")).alias("fp"), F.count_if(~hit & F.col("truth")).alias("fn"))
    f1 = F.coalesce(F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9), F.lit(0.0))
    return c.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "threshold")).alias("b")).select("lang", "b.f1", "b.threshold")


F24 = f"""WITH {SC}, c AS (SELECT lang, i / 10.0::DOUBLE AS threshold, count(*) FILTER (score >= i / 10.0::DOUBLE AND truth) AS tp, count(*) FILTER (score >= i / 10.0::DOUBLE AND NOT truth) AS fp, count(*) FILTER (score < i / 10.0::DOUBLE AND truth) AS fn FROM s, (SELECT unnest(range(1, 10)) AS i) GROUP BY ALL)
SELECT lang, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1, threshold FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold DESC) = 1"""

def f15_report(spark, sf_dir):
    """Agreement and consensus of each kind's judged pool in one row: alpha over units, and what the medians of three or more say."""
    r = ratings(spark, sf_dir)
    alpha = M.ordinal_alpha(r, ["unit"], "grade", ["kind"]).select("kind", F.round("alpha", 9).alias("alpha"), "status")
    c = M.consensus(r, ["kind", "unit"], "grade").groupBy("kind").agg(
        F.count(F.lit(1)).alias("units"), F.count("consensus").alias("judged"), F.count_if("disputed").alias("disputed"), F.round(F.avg("consensus"), 9).alias("mean")
    )
    return c.join(alpha, "kind", "left")


F15 = f"""WITH a AS (SELECT kind, alpha, status FROM ({F9})), r2 AS (WITH {RT} SELECT kind, unit, count(grade) AS n, max(grade) - min(grade) >= 2 AS disputed, CASE WHEN count(grade) >= 3 THEN median(grade) END AS consensus FROM r GROUP BY ALL),
c AS (SELECT kind, count(*) AS units, count(consensus) AS judged, count(*) FILTER (disputed) AS disputed, round(avg(consensus), 9) AS mean FROM r2 GROUP BY 1)
SELECT kind, units, judged, disputed, mean, alpha, status FROM c LEFT JOIN a USING (kind)"""

QUERIES = {
    "f15_report": f15_report,
    "f9_alpha": f9_alpha, "f10_consensus": f10_consensus, "f11_majority": f11_majority, "f13_ndcg": f13_ndcg, "f14_bootstrap": f14_bootstrap, "f16_ap_auroc": f16_ap_auroc,
    "f17_hits": f17_hits, "f18_macro": f18_macro, "f19_folds": f19_folds, "f21_threshold": f21_threshold, "f22_timings": f22_timings, "f24_grid": f24_grid,
}
ORACLE_SQL = {"f15_report": F15, "f9_alpha": F9, "f10_consensus": F10, "f11_majority": F11, "f13_ndcg": F13, "f16_ap_auroc": F16, "f17_hits": F17, "f18_macro": F18, "f19_folds": F19, "f21_threshold": F21, "f14_bootstrap": F14, "f22_timings": F22, "f24_grid": F24}
