"""Tie-correct ranking metrics, agreement and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import overlap_join, overlap_ratio


def tie_groups(df: DataFrame, key: list[str], truth: str, score: str) -> DataFrame:
    """One row a distinct score with counts and running counts from the top: (pos, neg, tp, fp).

    Rows of equal score are combined map-side first, so the running sum goes
    over distinct scores of a key, not over rows.
    """
    g = df.groupBy(*key, score).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    w = Window.partitionBy(*key).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))


def ap_auroc(df: DataFrame, key: list[str], truth: str, score: str, empty_is_null: bool = True) -> DataFrame:
    """(key, n_pos, n_neg, ap, auroc) with equal scores as one step.

    Without both classes: nulls, or ap 0 where there are no positives if ``empty_is_null`` is off.
    """
    g = tie_groups(df, key, truth, score)
    m = g.groupBy(*key).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("_auc"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    ap = F.col("_ap") / F.when(F.col("n_pos") > 0, F.col("n_pos"))
    ap = F.when(both, ap) if empty_is_null else F.coalesce(ap, F.lit(0.0))
    return m.select(*key, "n_pos", "n_neg", ap.alias("ap"), F.when(both, F.col("_auc") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def hit_at(df: DataFrame, key: list[str], truth: str, score: str, tie: str, k: int) -> DataFrame:
    """(key, hit_1, hit_k): positives among the first 1 and k by falling score, earliest first among equals."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), tie))
    top = df.withColumn("_r", rank).where(F.col("_r") <= k)
    hit = F.col(truth).cast("int")
    return top.groupBy(*key).agg(F.max(F.when(F.col("_r") == 1, hit)).alias("hit_1"), F.max(hit).alias("hit_k"))


def f2_threshold(df: DataFrame, key: list[str], truth: str, score: str) -> DataFrame:
    """(key, threshold, f2): best F2 = 5tp / (5tp + 4fn + fp) over the observed scores and 1.0; ties go to the higher.

    Fractions of bounded integers are compared as DECIMAL cross products would be:
    by value rounded to 15 places, then by threshold.
    """
    g = tie_groups(df, key, truth, score)
    total = g.groupBy(*key).agg(F.sum("pos").alias("n_pos"), F.max(score).alias("_top"))
    rows = g.join(total, key).select(*key, F.col(score).cast("double").alias("threshold"), "tp", "fp", "n_pos")
    one = total.where(F.col("_top") < 1.0).select(*key, F.lit(1.0).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "n_pos")
    f2 = F.try_divide(5.0 * F.col("tp"), F.col("tp") + 4 * F.col("n_pos") + F.col("fp"))
    best = F.max(F.struct(F.round(F.coalesce(f2, F.lit(0.0)), 15).alias("f2"), "threshold")).alias("b")
    return rows.unionByName(one).groupBy(*key).agg(best).select(*key, "b.threshold", "b.f2")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; null where 0/0."""
    return [F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]


def consensus(df: DataFrame, key: list[str], value: str, least: int = 3) -> DataFrame:
    """(key, n, consensus, disputed): the median of at least ``least`` known ratings; disputed when they span 2 or more."""
    a = df.groupBy(*key).agg(F.count(value).alias("n"), F.median(value).alias("_m"), (F.max(value) - F.min(value) >= 2).alias("disputed"))
    return a.withColumn("consensus", F.when(F.col("n") >= least, F.col("_m"))).drop("_m")


def majority(df: DataFrame, key: list[str], flag: str, least: int = 3) -> DataFrame:
    """(key, majority, contradicted): true, false, or null below ``least`` known flags or at a tie."""
    yes, no = F.count_if(F.col(flag)), F.count_if(~F.col(flag))
    a = df.groupBy(*key).agg(yes.alias("yes"), no.alias("no"))
    known = F.col("yes") + F.col("no") >= least
    return a.withColumn("majority", F.when(known & (F.col("yes") != F.col("no")), F.col("yes") > F.col("no"))).withColumn("contradicted", (F.col("yes") > 0) & (F.col("no") > 0))


def ordinal_alpha(df: DataFrame, unit: list[str], value: str, group: list[str]) -> DataFrame:
    """(group, n_pairable, alpha, status): Krippendorff's alpha for ordinal ratings.

    Units with fewer than two ratings don't count. The coincidence matrix has
    one row a pair of rating levels, so it stays small however many ratings
    there are. status is ok, no_pairs or no_variation.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, *unit, value).agg(F.count(F.lit(1)).alias("c"))
    m = Window.partitionBy(*group, *unit)
    counts = counts.withColumn("m", F.sum("c").over(m)).where("m >= 2")
    other = counts.select(*group, *unit, F.col(value).alias("k"), F.col("c").alias("ck"))
    pairs = counts.withColumnRenamed(value, "j").join(other, [*group, *unit])
    o = pairs.groupBy(*group, "j", "k").agg(F.sum((F.col("c") * (F.col("ck") - (F.col("j") == F.col("k")).cast("int"))) / (F.col("m") - 1)).alias("o"))
    marginal = o.groupBy(*group, "j").agg(F.sum("o").alias("n"))
    w = Window.partitionBy(*group).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    mid = marginal.withColumn("mid", F.sum("n").over(w) - F.col("n") / 2)
    a, b = mid.select(*group, "j", F.col("n").alias("nj"), F.col("mid").alias("mj")), mid.select(*group, F.col("j").alias("k"), F.col("n").alias("nk"), F.col("mid").alias("mk"))
    every = a.join(b, group).join(o, [*group, "j", "k"], "left") if group else a.crossJoin(b).join(o, ["j", "k"], "left")
    d = F.pow(F.col("mj") - F.col("mk"), 2)
    s = every.groupBy(*group).agg(F.sum(F.coalesce("o", F.lit(0.0)) * d).alias("observed"), F.sum(F.col("nj") * F.col("nk") * d).alias("expected"), F.sum(F.coalesce("o", F.lit(0.0))).alias("n"))
    alpha = F.when(F.col("expected") > 0, 1 - (F.col("n") - 1) * F.col("observed") / F.col("expected"))
    return s.select(*group, F.round("n", 6).alias("n_pairable"), alpha.alias("alpha"), F.when(F.coalesce("n", F.lit(0.0)) < 2, "no_pairs").when(F.col("expected") <= 0, "no_variation").otherwise("ok").alias("status"))


def ndcg(df: DataFrame, key: list[str], grade: str, score: str, tie: str, k: int = 5) -> DataFrame:
    """(key, dcg, ideal, ndcg) with linear gain at ``k``; null where the ideal is 0."""
    by = Window.partitionBy(*key)
    ranked = df.withColumn("_r", F.row_number().over(by.orderBy(F.desc(score), tie))).withColumn("_i", F.row_number().over(by.orderBy(F.desc(grade), tie)))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col(grade) / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    return ranked.groupBy(*key).agg(gain("_r").alias("dcg"), gain("_i").alias("ideal")).withColumn("ndcg", F.try_divide("dcg", F.when(F.col("ideal") > 0, F.col("ideal"))))


#: Cumulated probabilities of 0, 1, 2... under a Poisson law of mean 1.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(12)]


def bootstrap_mean(df: DataFrame, group: list[str], cluster: str, value: str, draws: int = 2000, seed: int = 7, least: int = 10) -> DataFrame:
    """(group, clusters, mean, low, high): mean of cluster means; a seeded 95 % cluster bootstrap from ``least`` clusters on.

    Every cluster has a Poisson weight in every draw, from a digest of seed,
    group, cluster and draw, so draws are sums that combine map-side and don't
    depend on the order or place of rows.
    """
    means = df.groupBy(*group, cluster).agg(F.avg(value).alias("m"))
    drawn = means.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*group, cluster, "draw"]]
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long") / float(1 << 32)
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))
    weighted = drawn.withColumn("w", weight).groupBy(*group, "draw").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("m")).alias("s"), F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"))
    drawn_mean = F.when((F.col("n") >= least) & (F.col("w") > 0), F.col("s") / F.col("w"))
    ends = F.percentile(drawn_mean, F.array(F.lit(0.025), F.lit(0.975)))
    out = weighted.groupBy(*group).agg(F.max("n").alias("clusters"), F.max("mean").alias("mean"), ends.alias("ends"))
    return out.select(*group, "clusters", "mean", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def micro_and_per_class(counts: DataFrame, label: str) -> DataFrame:
    """(label, is_total, tp, fp, fn, precision, recall, f1): counts added up by class and, with null label, over all."""
    c = counts.rollup(label).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], F.grouping(label).cast("int").alias("is_total"))
    scores = zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)
    return c.select(label, "is_total", "tp", "fp", "fn", *[x.alias(n) for x, n in scores])


def max_pooled(frames: DataFrame, clip: list[str], label: str, score: str, mapping: dict[str, list[str]]) -> DataFrame:
    """(clip, category, score): the largest score of any frame and any label that the category holds."""
    of = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(x).alias("_label")) for c, labels in mapping.items() for x in labels])
    names = frames.sparkSession.range(1).select(F.explode(of).alias("m")).select("m.*")
    best = frames.groupBy(*clip, label).agg(F.max(score).alias("score"))
    return best.join(F.broadcast(names), best[label] == names["_label"]).groupBy(*clip, "category").agg(F.max("score").alias("score"))


def candidate_recall(truth: DataFrame, candidates: DataFrame, chosen: DataFrame, key: list[str], id_: str, width: float, iou: float, grade: str) -> DataFrame:
    """Quality of candidates and of a choice among them, a key: how many true intervals a candidate covers, what the choice is worth.

    (key, annotated, candidate_recall, selected, judged, quality, matched, completeness): recall counts true
    intervals that overlap a candidate by ``iou``; quality is the mean grade of judged
    picks; of picks whose best true interval (the smaller id if equal) overlaps them by ``iou``, completeness
    is the share whose clip holds that interval's clip. Nothing known is null, never 0.
    """
    t = truth.select(*key, F.col(id_).alias("_id"), "start", "end", F.col("clip_start").alias("_cs"), F.col("clip_end").alias("_ce"))
    other = lambda df: df.select(*key, F.col(id_).alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), "clip_start", "clip_end")
    ratio = overlap_ratio(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
    covered = overlap_join(t, other(candidates), key, width).where(ratio >= iou).select(*key, "_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("covered"))
    met = overlap_join(t, other(chosen), key, width).withColumn("_ratio", ratio).where(F.col("_ratio") >= iou)
    best = met.groupBy(*key, "other_id").agg(F.min(F.struct((-F.col("_ratio")).alias("r"), "_id", ((F.col("clip_start") <= F.col("_cs")) & (F.col("clip_end") >= F.col("_ce"))).alias("whole"))).alias("b"))
    complete = best.groupBy(*key).agg(F.count(F.lit(1)).alias("matched"), F.avg(F.col("b.whole").cast("int")).alias("completeness"))
    n = t.groupBy(*key).agg(F.count(F.lit(1)).alias("annotated"))
    picks = chosen.groupBy(*key).agg(F.count(F.lit(1)).alias("selected"), F.count(grade).alias("judged"), F.avg(grade).alias("quality"))
    out = n.join(covered, key, "left").join(picks, key, "full_outer").join(complete, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    recall = F.when(F.col("annotated") > 0, F.coalesce("covered", F.lit(0)) / F.col("annotated"))
    return out.select(*key, zero("annotated"), recall.alias("candidate_recall"), zero("selected"), zero("judged"), "quality", zero("matched"), "completeness")
