"""Queries of the row rules, scalar functions and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronospan.functions import rules as R
from chronospan.functions import scalars as C

from .sequences import EV
from .tables import HOUR, events, table


def d7_violations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    v = R.violations(l, ["l_orderkey", "l_linenumber", "l_partkey"], {
        "large_discount": ~R.finite_between(F.col("l_discount"), 0.0, 0.08),
        "late": F.col("l_shipdate") > F.lit("2001-06-01").cast("timestamp_ntz"),
        "flag_status": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"),
    })
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"), F.sum("l_partkey").alias("parts"))


D7 = """WITH v AS (SELECT *, unnest([CASE WHEN NOT coalesce(l_discount BETWEEN 0 AND 0.08, false) THEN 'large_discount' END, CASE WHEN l_shipdate > TIMESTAMP '2001-06-01' THEN 'late' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'flag_status' END]) AS rule FROM lineitem)
SELECT rule, count(*) AS n, min(l_orderkey) AS first_order, sum(l_partkey)::BIGINT AS parts FROM v WHERE rule IS NOT NULL GROUP BY rule"""


def d6_eligibility(spark, sf_dir):
    e = events(spark, sf_dir)
    r = R.reasons({"weak": F.col("value") < 10, "stale": F.col("k") > 80, "kind": ~F.col("event_type").isin("purchase", "click")})
    return e.select("event_id", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("eligible"))


D6 = f"""WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN value < 10 THEN 'weak' END, CASE WHEN k > 80 THEN 'stale' END, CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'kind' END) AS reasons,
NOT (value < 10 OR k > 80 OR event_type NOT IN ('purchase', 'click')) AS eligible FROM e"""


def d34_veto(spark, sf_dir):
    e = events(spark, sf_dir)
    _, rejected = R.split_by(e, {"weak": F.col("value") < 10, "stale": F.col("k") > 80, "kind": F.col("event_type") == "error"})
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


D34 = f"""WITH {EV}, r AS (SELECT event_id, CASE WHEN value < 10 THEN 'weak' WHEN k > 80 THEN 'stale' WHEN event_type = 'error' THEN 'kind' END AS reason FROM e)
SELECT reason, count(*) AS n, min(event_id) AS first_id FROM r WHERE reason IS NOT NULL GROUP BY 1"""


def d21_coverage(spark, sf_dir):
    e = events(spark, sf_dir)
    return R.coverage(e, ["user_id"], "us", F.lit(1704067200000000), F.lit(1704067200000000 + 30 * 24 * HOUR), 36 * HOUR, 3, 7 * 24 * HOUR)


D21 = f"""WITH {EV}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e),
a AS (SELECT user_id, count(*) AS n, coalesce(max(gap), 0) AS largest_gap, min(us) - 1704067200000000 AS h, 1704067200000000 + 2592000000000 - max(us) AS t FROM g GROUP BY 1)
SELECT user_id, n, largest_gap, n >= 3 AND largest_gap <= 129600000000 AND h <= 129600000000 AND t <= 129600000000 AS ok FROM a"""


def d31_contiguous(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    c = c.withColumn("start", F.col("turn") * 100).withColumn("end", F.col("start") + F.when(F.col("n") % 9 == 0, 99).otherwise(100))
    return R.contiguous(c, ["conv_id"], "turn", "start", "end").select("conv_id", "turn", "start", "expected")


D31 = """WITH c AS (SELECT conv_id, turn, turn * 100 AS s, turn * 100 + CASE WHEN length(text) % 9 = 0 THEN 99 ELSE 100 END AS e FROM conversations),
l AS (SELECT *, lag(e) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM c) SELECT conv_id, turn, s AS start, expected FROM l WHERE expected IS NOT NULL AND expected <> s"""


def i8_duplicates(spark, sf_dir):
    return R.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


I8 = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def a8_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    name = F.concat_ws(".", F.year("o_orderdate"), F.month("o_orderdate"), F.when(F.col("o_orderkey") % 17 == 0, F.lit(32)).otherwise(F.dayofmonth("o_orderdate")), F.col("o_orderkey") % 5)
    p = o.select("o_orderkey", C.source_name(name).alias("p"))
    return p.select("o_orderkey", F.date_format("p.date", "yyyy-MM-dd").alias("date"), "p.part")


A8 = """SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 5 >= 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 5 >= 1 THEN (o_orderkey % 5)::INT END AS part FROM orders"""


def c8_snap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(C.snapped(F.col("p_retailprice"), 0.1), 9).alias("place"), F.array_join(F.transform(C.even_indices(F.col("p_size"), 5), lambda x: x.cast("string")), ",").alias("even"))


C8 = """WITH i AS (SELECT p_partkey, p_size AS n, p_retailprice / 0.1::DOUBLE AS q FROM part)
SELECT p_partkey, round(CASE WHEN abs(q - round(q)) <= 1e-9 THEN round(q) ELSE q END, 9) AS place,
array_to_string(CASE WHEN n <= 0 THEN [] WHEN n <= 5 THEN range(0, n) ELSE list_transform(range(0, 5), lambda j: round_even(j * (n - 1) / 4, 0)::BIGINT) END, ',') AS even FROM i"""


def c9_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", C.first_match(F.col("p_name"), [("ring", "jewel"), ("widget", "tool"), ("small", "little")], "other").alias("label"), C.item_digest(F.lit(7), "p_brand", "p_partkey").alias("digest"))


C9 = """SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'jewel' WHEN contains(p_name, 'widget') THEN 'tool' WHEN contains(p_name, 'small') THEN 'little' ELSE 'other' END AS label,
left(sha256(concat_ws('|', '7', p_brand, p_partkey::VARCHAR)), 20) AS digest FROM part"""


def c17_redact(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", "url")
    return d.select("page_id", C.redacted(F.concat(F.lit("token="), "url", F.lit(" ok"))).alias("text"))


C17 = r"SELECT page_id, 'token=[redacted] ok' AS text FROM pages"


def c27_clamp(spark, sf_dir):
    e = events(spark, sf_dir)
    s = C.clamped_span(F.col("value"), F.lit(20.0), F.lit(0.0), F.lit(100.0))
    return e.select("event_id", F.round(s["start"], 6).alias("a"), F.round(s["end"], 6).alias("b"))


C27 = "WITH s AS (SELECT event_id, greatest(0.0, least(value - 10, 80.0)) AS a FROM events) SELECT event_id, round(a, 6) AS a, round(least(a + 20, 100.0), 6) AS b FROM s"


def c21_lines(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    return p.select("conv_id", "turn", F.array_join(C.wrapped_lines(F.col("t"), 16), "/").alias("lines"))


def c20_units(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.normalized_text(F.col("text")).alias("text"))
    return t.select("conv_id", "turn", F.size(C.text_units(F.col("text"))).alias("units"), F.md5("text").alias("digest"))


C20 = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\t\v\f\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]', ' ', 'g') AS text FROM conversations)
SELECT conv_id, turn, length(regexp_replace(text, '[\p{M}\x{200C}\x{200D}\x{1F3FB}-\x{1F3FF}]', '', 'g'))::INT AS units, md5(text) AS digest FROM t"""


def c21_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_partkey") % 3 == 0, "，").when(F.col("p_partkey") % 3 == 1, "！").otherwise("")
    title = F.concat(F.substring("p_name", 1, 4), mark, F.expr("substring(p_name, 5)"))
    return p.select("p_partkey", F.array_join(C.title_lines(title), "/").alias("lines"))


C21 = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND length(p_name) > 4 THEN p_name[1:4] || '/' || p_name[5:] WHEN p_partkey % 3 = 1 AND length(p_name) > 4 THEN p_name[1:4] || '！/' || p_name[5:]
 WHEN length(t) > 9 THEN t[1:length(t) // 2] || '/' || t[length(t) // 2 + 1:] ELSE t END AS lines FROM (SELECT *, p_name[1:4] || CASE p_partkey % 3 WHEN 0 THEN '，' WHEN 1 THEN '！' ELSE '' END || p_name[5:] AS t FROM part)"""

QUERIES = {
    "c20_units": c20_units, "c21_titles": c21_titles,
    "a8_names": a8_names, "c8_snap": c8_snap, "c9_labels": c9_labels, "c17_redact": c17_redact, "c21_lines": c21_lines, "c27_clamp": c27_clamp, "d6_eligibility": d6_eligibility,
    "d7_violations": d7_violations, "d21_coverage": d21_coverage, "d31_contiguous": d31_contiguous, "d34_veto": d34_veto, "i8_duplicates": i8_duplicates,
}
ORACLE_SQL = {"c20_units": C20, "c21_titles": C21, "a8_names": A8, "c8_snap": C8, "c9_labels": C9, "c17_redact": C17, "c27_clamp": C27, "d6_eligibility": D6, "d7_violations": D7, "d21_coverage": D21, "d31_contiguous": D31, "d34_veto": D34, "i8_duplicates": I8}
