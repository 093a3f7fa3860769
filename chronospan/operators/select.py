"""Top-K selection, greedy choices and merges of near-equal events."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronospan.session import stored

from .islands import carried, fold_sorted, islands, ranked, same_key_join
from .joins import asof


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows: a bounded heap a task, merged on the driver side of the shuffle."""
    return df.orderBy(*order).limit(k)


def top_k_each(df: DataFrame, key: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their 1-based rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def greedy_non_overlapping(df: DataFrame, key: list[str], start: str, end: str, score: str, tie: str, k: int, bucket: float | None = None) -> DataFrame:
    """By falling score, keep rows that overlap none kept of their key, at most k a key, with ``pick``.

    Rows that no chain of overlaps connects don't affect each other, so each
    such island is chosen from alone and the best k of all kept rows are the picks.
    """
    a, b = df.columns.index(start), df.columns.index(end)

    def choose(rows: list[tuple]) -> list[tuple]:
        starts: list = []
        kept: list[tuple] = []  # in order of time, disjoint
        for row in rows:
            i = bisect_left(starts, row[a])
            if all(row[b] <= x[a] or x[b] <= row[a] for x in kept[max(0, i - 1) : i + 1]):
                starts.insert(i, row[a])
                kept.insert(i, row)
        return kept

    cut = islands(df, key, start, end, 0, bucket)
    order = [F.desc(score), start, tie]
    return top_k_each(fold_sorted(cut, [*key, "island"], order, choose).drop("island"), key, order, k, "pick")


#: Best rows of a key from which a choice is first tried, and how many times more each further try takes.
SHORTLIST, MORE = 256, 16


def shortlisted(df: DataFrame, key: list[str], order: list, choose: Callable[[list[tuple], int], list[tuple] | None], limit: int) -> DataFrame:
    """Chosen rows of each key with ``pick``, their place from 1, where a key's best rows mostly settle the choice.

    ``choose`` gets up to ``limit`` rows of a key by ``order``, and one more if there are more, and returns the chosen ones, or None
    if rows beyond the limit could be among them; such keys are tried again with more. A task holds no more of a key than the limit.
    """

    def tried(rows: list[tuple], limit: int) -> list[tuple]:
        chosen = choose(rows, limit)
        return [(*rows[0], 0)] if chosen is None else [(*row, n) for n, row in enumerate(chosen, 1)]

    by = Window.partitionBy(*key).orderBy(*order)
    done, rows = [], df
    while True:
        best = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= limit + 1).drop("_r")
        found = stored(fold_sorted(best, key, order, lambda held, n=limit: tried(held, n), add={"pick": "long"}), "picks")
        done.append(found.where("pick > 0"))
        open_ = found.where("pick = 0").select(*[F.col(c).alias(f"_on_{c}") for c in key])
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done).withColumn("pick", F.col("pick").cast("int"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in key])
        rows, limit = df.join(open_, same, "left_semi"), limit * MORE


def diverse_top_k(df: DataFrame, key: list[str], source: str, kind: str, start: str, end: str, score: str, tie: str, k: int, near: float, near_cost: float = 3.0, same_cost: float = 1.0, strict: bool = False, shortlist: int = SHORTLIST) -> DataFrame:
    """Repeatedly the best of score less ``near_cost`` a chosen row of the source less than ``near`` away and ``same_cost`` a chosen row of the kind.

    Equal adjusted scores go to the higher score, then to source, start and
    ``tie``. A best row that overlaps a chosen one of its source is passed over
    for good. Fewer than k picks of a key raise with ``strict``.

    A cost only lowers a score, so a key's picks are known from its best rows as long as
    every one considered has an adjusted score that the first row left out does not
    beat. A task holds ``shortlist`` rows of a key; keys whose picks these don't settle, which are few, are tried with more.
    """
    at = {c: df.columns.index(c) for c in (source, kind, start, end, score)}

    def choose(rows: list[tuple], limit: int) -> list[tuple] | None:
        bound = rows[limit][at[score]] if len(rows) > limit else None
        left = [[row[at[score]], row] for row in rows[:limit]]
        chosen: list[tuple] = []
        while left and len(chosen) < k:
            i = max(range(len(left)), key=lambda n: left[n][0])  # the first of equal ones
            adjusted, best = left.pop(i)
            if bound is not None and adjusted < bound:
                return None
            of_source = [c for c in chosen if c[at[source]] == best[at[source]]]
            if any(max(c[at[start]], best[at[start]]) < min(c[at[end]], best[at[end]]) for c in of_source):
                continue
            chosen.append(best)
            for x in left:
                close = x[1][at[source]] == best[at[source]] and abs(x[1][at[start]] - best[at[start]]) < near
                x[0] -= near_cost * close + same_cost * (x[1][at[kind]] == best[at[kind]])
        if len(chosen) < k and bound is not None:
            return None
        if strict and len(chosen) < k:
            raise ValueError(f"{len(chosen)} of {k} picks")
        return chosen

    return shortlisted(df, key, [F.desc(score), source, start, tie], choose, shortlist)


def merge_duplicates(df: DataFrame, key: list[str], start: str, end: str, peak: str, better: list[str], id_: str, peak_gap: float, share: float, bucket: float | None = None) -> DataFrame:
    """Merge events of a key whose peaks are near and whose overlap is a ``share`` of the shorter: the better stays.

    In order of start and end, each row meets the kept ones newest first; the
    row that is greater by the columns ``better``, in order, takes the place, and
    ``ids`` gathers all merged ids.
    """
    a, b, p, i = (df.columns.index(c) for c in (start, end, peak, id_))
    ranks = [df.columns.index(c) for c in better]

    def merge(rows: list[tuple]) -> list[tuple]:
        kept: list[list] = []
        open_: list[list] = []  # those that a later row, which starts later, can still overlap
        for row in rows:
            open_ = [x for x in open_ if x[0][b] > row[a]]
            for x in reversed(open_):
                other = x[0]
                meet, short = min(row[b], other[b]) - max(row[a], other[a]), min(row[b] - row[a], other[b] - other[a])
                if abs(row[p] - other[p]) <= peak_gap and short > 0 and meet / short >= share:
                    x[1].add(row[i])
                    if [row[n] for n in ranks] > [other[n] for n in ranks]:
                        x[0] = row
                    break
            else:
                kept.append([row, {row[i]}])
                open_.append(kept[-1])
        return [(*row, sorted(ids)) for row, ids in kept]

    cut = islands(df, key, start, end, 0, bucket)
    return fold_sorted(cut, [*key, "island"], [start, end, id_], merge, add={"ids": id_}).drop("island")


def evenly_spaced(df: DataFrame, key: list[str], order: list, k: int, part: Column | None = None) -> DataFrame:
    """k rows a key (all if fewer) at the half-even rounded places i (n - 1) / (k - 1) of its order.

    ``part`` is a whole number that never falls along the order; keys are ranked a part at a time.
    """
    rows = ranked(df, key, part if part is not None else F.lit(0), order, "_i").withColumn("_i", F.col("_i") - 1)
    sized = same_key_join(rows, rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key)
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(1, k - 1))).cast("long"))
    return sized.where((F.col("_n") <= k) | F.array_contains(steps, F.col("_i"))).drop("_i", "_n")


def cohorts(df: DataFrame, key: list[str], positive: Column, order: str, n_pos: int, n_neg: int) -> DataFrame:
    """The first positives and negatives of each key by ``order``. Tasks hand on no more than the larger number of each."""
    r = F.row_number().over(Window.partitionBy(*key, "positive").orderBy(order))
    rows = df.withColumn("positive", positive).withColumn("_r", r).where(F.col("_r") <= max(n_pos, n_neg))
    return rows.where(F.col("_r") <= F.when(F.col("positive"), n_pos).otherwise(n_neg)).drop("_r")


def shuffled(df: DataFrame, key: list[str], id_: str, seed: int, rank: str = "place", parts: int = 64) -> DataFrame:
    """A seeded order a key that doesn't depend on the input's order: by the SHA-256 of seed, key and id, ranked in ``parts`` ranges of it."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], F.col(id_).cast("string")), 256)
    part = F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("long") * parts / 65536)
    return ranked(df.withColumn("_h", h), key, part, ["_h", id_], rank).drop("_h")


def namespaced_union(parts: dict[str, DataFrame], id_: str, same: list[str]) -> DataFrame:
    """Union of parts with ids prefixed by part; a column of ``same`` must have one value in all, which one aggregate over the parts checks at once."""
    out = None
    for name, part in parts.items():
        rows = part.withColumn(id_, F.concat_ws("__", F.lit(name), F.col(id_).cast("string"))).withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if same:
        ends = out.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in same]).first()
        if differ := [c for c in same if ends[c].lo != ends[c].hi]:
            raise ValueError(f"{', '.join(differ)} differs between parts")
    return out


def spaced_choice(df: DataFrame, key: list[str], t: str, score: str, label: str, group: str, most: int, per_group: int, gap: float, shortlist: int = SHORTLIST) -> DataFrame:
    """By falling score (earlier first): at most ``most`` a key and ``per_group`` a group, no label twice, all at least ``gap`` apart.

    A key's choice is made among its best rows; where they don't fill its places and more are left, among more of them.
    """
    at = {c: df.columns.index(c) for c in (t, label, group)}

    def choose(rows: list[tuple], limit: int) -> list[tuple] | None:
        kept: list[tuple] = []
        for row in rows[:limit]:
            crowded = sum(row[at[group]] == x[at[group]] for x in kept) >= per_group
            if not crowded and all(abs(row[at[t]] - x[at[t]]) >= gap and row[at[label]] != x[at[label]] for x in kept):
                kept.append(row)
                if len(kept) == most:
                    return kept
        return kept if len(rows) <= limit else None

    return shortlisted(df, key, [F.desc(score), t, label, group], choose, shortlist).drop("pick")


def expand_over(spans: DataFrame, parts: DataFrame, key: list[str], span_id: str, start: str = "start", end: str = "end", bucket: float | None = None) -> DataFrame:
    """Each span grown over the parts it overlaps, taken in order of start, growth included: (key, span_id, start, end, n).

    The first part met is the first whose furthest end so far is beyond the span's start; from there on each part is met
    that starts before the end reached, which is the end of the last chain of overlapping parts that starts before the
    span's end. So two as-of joins find both, and ``n`` is the difference of their places. With
    ``bucket``, a width of time, keys are sorted a bucket at a time. Empty parts are never met.
    """
    of = F.floor(F.col("s") / F.lit(bucket)) if bucket else F.lit(0).cast("long")
    real = parts.where(F.col(start) < F.col(end)).select(*key, F.col(start).alias("s"), F.col(end).alias("e"))
    chains = islands(real, key, "s", "e", -5e-324, bucket, "chain")  # touching ones are apart
    chains = ranked(chains, key, of, ["s", "e"], "place")
    chains = carried(chains.withColumn("_part", of), key, "_part", F.max("e"), F.max, "_beyond")
    here = F.max("e").over(Window.partitionBy(*key, "_part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    reach = chains.withColumn("reach", F.greatest(here, F.coalesce("_beyond", here)))
    firsts = reach.select(*key, F.col("reach").alias("at"), "place", F.struct("place", "s").alias("v"))
    lasts = reach.groupBy(*key, "chain").agg(F.max("e").alias("e"), F.max("place").alias("place")).select(*key, F.col("chain").alias("at"), F.struct("e", "place").alias("v"))
    probe = spans.select(*key, span_id, F.col(start).alias("_s"), F.col(end).alias("_e"))
    one = asof(probe.withColumn("at", F.col("_s")), firsts, key, "at", "v", True, False, "place", bucket, True).withColumnRenamed("matched", "_first").drop("matched_t")
    two = asof(one.withColumn("at", F.col("_e")), lasts, key, "at", "v", False, False, None, bucket, True)
    met = (F.col("_s") < F.col("_e")) & (F.col("_first.s") < F.col("_e"))
    kinds = dict(spans.dtypes)
    grown = lambda a, b: F.when(met, a).otherwise(b)
    return two.select(
        *key, span_id, grown(F.least("_s", "_first.s"), F.col("_s")).cast(kinds[start]).alias(start), grown(F.greatest("_e", "matched.e"), F.col("_e")).cast(kinds[end]).alias(end),
        grown(F.col("matched.place") - F.col("_first.place") + 1, F.lit(0)).cast("int").alias("n"),
    )


def first_passing(cues: DataFrame, frames: DataFrame, key: list[str], cue_id: str, t: str, frame_t: str, within: float, ok: Column) -> DataFrame:
    """(cue_id, at): the first frame of the key from the cue's time to ``within`` later that passes; null without any.

    Frames and cues meet in buckets of ``within``, so a key's frames aren't all tried.
    """
    dealt = cues.withColumn("_bucket", F.explode(F.array(F.floor(F.col(t) / within), F.floor(F.col(t) / within) + 1)))
    near = dealt.join(frames.withColumn("_bucket", F.floor(F.col(frame_t) / within)), [*key, "_bucket"])
    first = near.where((F.col(frame_t) >= F.col(t)) & (F.col(frame_t) <= F.col(t) + within) & ok).groupBy(cue_id).agg(F.min(frame_t).alias("at"))
    return cues.select(cue_id).join(first, cue_id, "left")


def best_unless_open(df: DataFrame, key: list[str], order: list[str], settled: str) -> DataFrame:
    """The best settled row of each key by the columns of ``order``; none where an unsettled row could still beat it."""
    rank = F.struct(*order)
    a = df.groupBy(*key).agg(F.max(F.when(F.col(settled), rank)).alias("best"), F.max(F.when(~F.col(settled), rank)).alias("open"))
    return a.where(F.col("best").isNotNull() & (F.col("open").isNull() | (F.col("open") <= F.col("best")))).select(*key, "best.*")
