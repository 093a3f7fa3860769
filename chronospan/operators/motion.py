"""Trajectories: contact impulses by local fits, follow-the-point paths, hint boxes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import carried, haloed, same_key_join
from .joins import asof, neighbours
from .quantiles import exact_quantiles
from .sequence import sessionize, smooth_edges


class Fit(NamedTuple):
    """A path near a time: position, velocity and curvature there, the change of velocity (0 without a kink), the error, and samples left out."""

    position: np.ndarray
    velocity: np.ndarray
    jump: np.ndarray
    error: float
    left_out: int


def local_fit(t: np.ndarray, xy: np.ndarray, center: float, kink: bool, share: float = 0.85, least_error: float = 0.004) -> Fit:
    """Both coordinates by one quadratic in time, with a change of slope at ``center`` if ``kink``.

    Samples off by more than the ``share`` quantile of all distances, and more than ``least_error``, are left out of a
    second fit if that leaves three more samples than it has terms. The error is the quantile of all samples' distances.
    """
    d = t - center
    terms = np.vstack([np.ones_like(d), d, d * d, np.maximum(d, 0)][: 4 if kink else 3]).T
    solved = np.linalg.lstsq(terms, xy, rcond=None)[0]
    off = np.hypot(*(terms @ solved - xy).T)
    near = off <= max(least_error, float(np.quantile(off, share)))
    if near.sum() >= terms.shape[1] + 3:
        solved = np.linalg.lstsq(terms[near], xy[near], rcond=None)[0]
        off = np.hypot(*(terms @ solved - xy).T)
    jump = solved[3] if kink else np.zeros(2)
    return Fit(solved[0], solved[1], jump, float(np.quantile(off, share)), int((~near).sum()))


class Impulses(NamedTuple):
    """When a kink counts. Lengths are in widths, times in seconds; ``reach`` and ``exclude`` are also at least so many intervals between samples."""

    samples: int = 12
    interval: float = 0.065
    gap: tuple[float, float, float] = (0.075, 3.5, 0.15)
    reach: tuple[float, float] = (0.24, 7.1)
    exclude: float = 0.6
    side: int = 4
    side_span: float = 0.12
    error: float = 0.0045
    jump: float = 0.22
    speed: float = 2.1
    apart: float = 0.2


def kink_at(t: np.ndarray, xy: np.ndarray, center: float, interval: float, rule: Impulses) -> tuple | None:
    """(time, start, end, jump, error, vx and vy before, left out) of an impulse at ``center`` of one unbroken path, if there is one."""
    reach = max(rule.reach[0], interval * rule.reach[1])
    near = np.abs(t - center) <= reach
    before, after = t[near & (t < center - interval * rule.exclude)], t[near & (t > center + interval * rule.exclude)]
    if min(len(before), len(after)) < rule.side or min(np.ptp(before), np.ptp(after)) < rule.side_span:
        return None
    fit = local_fit(t[near], xy[near], center, True)
    jump = float(np.hypot(*fit.jump))
    fastest = max(np.hypot(*fit.velocity), np.hypot(*(fit.velocity + fit.jump)))
    if fit.error > rule.error or jump < rule.jump or fastest > rule.speed:
        return None
    return float(center), float(before[-1]), float(after[0]), jump, fit.error, float(fit.velocity[0]), float(fit.velocity[1]), fit.left_out


#: Samples of the fits that are worked out at a time.
CELLS = 1 << 19


def _quantile(off: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """``np.quantile`` of the first ``n`` numbers of each row, in the same steps; beyond them a row has infinities."""
    ordered = np.sort(off, axis=1)
    place = (n - 1) * share
    low = np.floor(place).astype(int)
    rows, g = np.arange(len(n)), place - low
    a, b = ordered[rows, low], ordered[rows, np.minimum(low + 1, n - 1)]
    return np.where(g >= 0.5, b - (b - a) * (1 - g), a + (b - a) * g)


def _solved(terms: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of each matrix, and whether its columns are well apart; what others are told is of no use."""
    q, r = np.linalg.qr(terms)
    size = np.abs(np.diagonal(r, axis1=1, axis2=2))
    sound = size.min(1) > 1e-7 * size.max(1)
    r = np.where(sound[:, None, None], r, np.eye(r.shape[1]))
    return np.linalg.solve(r, q.transpose(0, 2, 1) @ xy), sound


def local_fits(d: np.ndarray, xy: np.ndarray, n: np.ndarray, share: float = 0.85, least_error: float = 0.004) -> tuple[np.ndarray, ...]:
    """(terms, error, left out, sound) of :func:`local_fit` with a kink, of many paths at once; the first ``n`` places of a row are samples."""
    there = np.arange(d.shape[1]) < n[:, None]
    terms = np.stack([np.ones_like(d), d, d * d, np.maximum(d, 0)], 2) * there[:, :, None]
    xy = xy * there[:, :, None]

    def distance(solved: np.ndarray) -> np.ndarray:
        gap = terms @ solved - xy
        return np.where(there, np.hypot(gap[:, :, 0], gap[:, :, 1]), np.inf)

    solved, sound = _solved(terms, xy)
    off = distance(solved)
    near = there & (off <= np.maximum(least_error, _quantile(off, n, share))[:, None])
    again = np.flatnonzero((near.sum(1) >= terms.shape[2] + 3) & (near.sum(1) < n))
    if len(again):
        kept = near[again][:, :, None]
        solved[again], well = _solved(terms[again] * kept, xy[again] * kept)
        sound[again] &= well
        off = distance(solved)
    return solved, _quantile(off, n, share), (there & ~near).sum(1), sound


def kinks(center: np.ndarray, interval: np.ndarray, counts: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, rule: Impulses) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, columns of :func:`kink_at`) of the impulses at the centers and midway to the next sample.

    Each center has the next ``counts`` samples (t, x, y), of which those of its own unbroken stretch count.
    """
    low, times, most = rule.gap
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((t, row))
    t, x, y = t[order], x[order], y[order]
    limit = np.minimum(most, np.maximum(low, interval * times))
    new = np.ones(len(t), bool)
    new[1:] = (row[1:] != row[:-1]) | (t[1:] - t[:-1] > limit[row[1:]])
    stretch = np.cumsum(new)
    start = np.cumsum(counts) - counts
    here = start + np.bincount(row, t < center[row], len(counts)).astype(int)
    following = np.minimum(here + 1, max(len(t) - 1, 0))
    between = np.flatnonzero((here + 1 < len(t)) & (stretch[following] == stretch[here]))
    owner = np.concatenate([np.arange(len(counts)), between])
    at = np.concatenate([center, (center[between] + t[following[between]]) / 2])
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]

    n = counts[owner]
    number = np.repeat(np.arange(len(owner)), n)
    sample = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[owner], n)
    reach = np.maximum(rule.reach[0], interval * rule.reach[1])[owner]
    near = (stretch[sample] == stretch[here[owner]][number]) & (np.abs(t[sample] - at[number]) <= reach[number])
    number, sample = number[near], sample[near]
    n, ts = np.bincount(number, minlength=len(owner)), t[sample]
    first = np.cumsum(n) - n
    aside = interval[owner] * rule.exclude
    before = np.bincount(number, ts < (at - aside)[number], len(owner)).astype(int)
    after = np.bincount(number, ts > (at + aside)[number], len(owner)).astype(int)
    some = np.flatnonzero(np.minimum(before, after) >= rule.side)
    b0, b1, a0, a1 = (ts[first[some] + k] for k in (0, before[some] - 1, n[some] - after[some], n[some] - 1))
    wide = np.minimum(b1 - b0, a1 - a0) >= rule.side_span
    some, b1, a0 = some[wide], b1[wide], a0[wide]

    hits, found = [], []
    some_n = n[some]
    by_size = np.argsort(some_n, kind="stable")
    while len(by_size):
        widest = int(some_n[by_size[-1]])
        part, by_size = by_size[-max(1, CELLS // widest) :], by_size[: -max(1, CELLS // widest)]
        k = some[part]
        cell = np.minimum(first[k][:, None] + np.arange(widest), len(sample) - 1)
        pick = sample[cell]
        xy = np.stack([x[pick], y[pick]], 2)
        there = np.arange(widest) < n[k][:, None]
        finite = (np.isfinite(t[pick]) & np.isfinite(xy).all(2) | ~there).all(1)
        xy = np.where(there[:, :, None] & finite[:, None, None], xy, 0.0)
        d = np.where(there & finite[:, None], t[pick] - at[k][:, None], 0.0)
        solved, error, left, sound = local_fits(d, xy, n[k])
        sound &= finite
        jump, velocity = solved[:, 3], solved[:, 1]
        length = np.hypot(jump[:, 0], jump[:, 1])
        fastest = np.maximum(np.hypot(velocity[:, 0], velocity[:, 1]), np.hypot(*(velocity + jump).T))
        good = np.flatnonzero(sound & ~((error > rule.error) | (length < rule.jump) | (fastest > rule.speed)))
        hits.append(k[good])
        found.append(np.stack([at[k[good]], b1[part[good]], a0[part[good]], length[good], error[good], velocity[good, 0], velocity[good, 1], left[good]], 1))
        for i in np.flatnonzero(~sound):  # columns that depend on each other, or no numbers
            own = sample[first[k[i]] : first[k[i]] + n[k[i]]]
            hit = kink_at(t[own], np.stack([x[own], y[own]], 1), float(at[k[i]]), float(interval[owner[k[i]]]), rule)
            if hit:
                hits.append(k[i : i + 1])
                found.append(np.array([hit], float))
    if not hits:
        return np.empty(0, int), []
    columns = np.concatenate(found).T
    return owner[np.concatenate(hits)], [*columns[:7], columns[7].astype(int)]


def impulses(df: DataFrame, key: list[str], t: str, x: str, y: str, rule: Impulses = Impulses(), parts: int = 16) -> DataFrame:
    """(key, t, start, end, jump, error, vx, vy, left_out): times at which a path's velocity changes at once, as by a contact.

    A key needs ``rule.samples`` samples, ``rule.interval`` apart or less by their median. Its path is broken where they are
    further apart than ``rule.gap`` (least, intervals, most). Centers are samples and the times midway between them; each is tried
    with the samples of its stretch within reach alone, which a window brings together, so a key is dealt over tasks by time.
    Of impulses less than ``rule.apart`` after one another, that of the least error stays, with the start and end of all.
    """
    low, times, most = rule.gap
    rows = df.where(F.col(t).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    widest = max(rule.reach[0], rule.interval * rule.reach[1]) + most
    width = parts * widest
    part = F.floor(F.col("t") / F.lit(width))
    steps = carried(rows.withColumn("_part", part), key, "_part", F.max("t"), F.max, "_last")
    step = F.col("t") - F.coalesce(F.lag("t").over(Window.partitionBy(*key, "_part").orderBy("t")), "_last")
    intervals = exact_quantiles(steps.withColumn("_step", step), key, "_step", {"_interval": 0.5})
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    known = same_key_join(same_key_join(rows, counts, key), intervals, key).where((F.col("_n") >= rule.samples) & (F.col("_interval") > 0) & (F.col("_interval") <= rule.interval))
    # Stretches by the longest gap of any key first; the key's own, which is no longer, cuts within them below.
    broken = F.least(F.lit(most), F.greatest(F.lit(low), F.col("_interval") * times))
    sized = same_key_join(known, _stretch_sizes(known.withColumn("_gap", broken), key, width), [*key, "t"])  # before samples are gathered, which are many times the rows
    near = haloed(sized, key, "t", width, widest, widest)
    micros = int(widest * 1e6) + 2  # frames of a window are whole numbers
    w = Window.partitionBy(*key, "_part").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-micros, micros)
    local = near.withColumn("_near", F.collect_list(F.struct("t", "x", "y")).over(w)).where("_own")
    names = ["t", "_interval", "_near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            center, interval = (batch.column(c).to_numpy(zero_copy_only=False) for c in names[:2])
            held = batch.column("_near")
            ends = held.offsets.to_numpy()
            flat = [x[ends[0] : ends[-1]] for x in (held.values.field(j).to_numpy(zero_copy_only=False) for j in range(3))]
            at, found = kinks(center, interval, np.diff(ends), *flat, rule)
            if len(at):
                kinds = [pa.float64()] * 7 + [pa.int64()]
                arrays = [pa.array(v, k) for v, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in key), *arrays], [*key, *FOUND])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"{c} {'long' if c == 'left_out' else 'double'}" for c in FOUND)])
    hits = local.where(F.col("_size") >= rule.samples).select(*key, *names).mapInArrow(run, schema)
    groups = sessionize(hits, key, "t", rule.apart, "error", out="_group", bucket=width)
    best = groups.groupBy(*key, "_group").agg(F.min(F.struct("error", "t", "jump", "vx", "vy", "left_out")).alias("b"), F.min("start").alias("start"), F.max("end").alias("end"))
    return best.select(*key, "b.t", "start", "end", "b.jump", "b.error", "b.vx", "b.vy", "b.left_out")


FOUND = ("t", "start", "end", "jump", "error", "vx", "vy", "left_out")


def _stretch_sizes(rows: DataFrame, key: list[str], width: float) -> DataFrame:
    """(key, t, _size): how many samples the unbroken stretch of each sample has; a row's own ``_gap`` breaks it."""
    cut = carried(rows.withColumn("_part", F.floor(F.col("t") / F.lit(width))), key, "_part", F.max("t"), F.max, "_last")
    w = Window.partitionBy(*key, "_part").orderBy("t")
    step = F.col("t") - F.coalesce(F.lag("t").over(w), "_last")
    new = carried(cut.withColumn("_new", F.when(step.isNull() | (step > F.col("_gap")), F.col("t"))), key, "_part", F.max("_new"), F.max, "_from")
    begun = new.withColumn("_stretch", F.coalesce(F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_from"))
    sizes = begun.groupBy(*key, "_stretch").agg(F.count(F.lit(1)).alias("_size"))
    return same_key_join(begun.select(*key, "t", "_stretch"), sizes, [*key, "_stretch"]).select(*key, "t", "_size").distinct()


def follow_path(df: DataFrame, key: list[str], t: str, x: str, rate: float, center: float, hold: float, width: int = 15, bucket: float | None = None) -> DataFrame:
    """(key, t, x) at ``rate`` a second: interpolated, smoothed with repeated ends, and blended to ``center`` far from any sample.

    Nearer than ``hold`` to a sample the path counts in full, from twice that on not at all. Each time finds the samples
    before and after it by as-of joins, a ``bucket`` of time at a time if given; places are smoothed a block at a time.
    """
    rows = df.where(F.col(t).isNotNull() & F.col(x).isNotNull()).select(*key, F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("_x"))
    ends = rows.groupBy(*key).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    grid = ends.select(*key, "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a")) * rate))).alias("_i")).select(*key, "_i", (F.col("_i") / F.lit(float(rate)) + F.col("_a")).alias("t"))
    before = asof(grid, rows, key, "t", "_x", False, True, None, bucket).withColumnRenamed("matched", "_x0").withColumnRenamed("matched_t", "_t0")
    both = asof(before, rows, key, "t", "_x", True, True, None, bucket).withColumnRenamed("matched", "_x1").withColumnRenamed("matched_t", "_t1")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("_t0"), F.col("_t1") - F.col("_t0")), F.lit(0.0))
    drawn = both.withColumn("_v", F.col("_x0") + (F.col("_x1") - F.col("_x0")) * share).withColumn("_far", F.least(F.col("t") - F.col("_t0"), F.col("_t1") - F.col("t")))
    smooth = smooth_edges(drawn, key, "_i", "_v", width, "_s")
    whole = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 - F.col("_far") / hold))
    return smooth.select(*key, "t", (whole * F.col("_s") + (1 - whole) * center).alias("x"))


def hint_boxes(df: DataFrame, key: list[str], t: str, x: str, y: str, start: Column, end: Column, longest: float, least: int) -> DataFrame:
    """(key, win, x0, y0, x1, y1, n) over equal windows of at most ``longest``; windows of fewer than ``least`` samples give no box."""
    n = F.ceil((end - start) / longest)
    win = F.least(F.floor((F.col(t) - start) / ((end - start) / n)), n - 1).cast("int")
    rows = df.where((F.col(t) >= start) & (F.col(t) <= end)).withColumn("win", win)
    boxes = rows.groupBy(*key, "win").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("n"))
    return boxes.where(F.col("n") >= least)


def hint_windows(samples: DataFrame, spans: DataFrame, key: list[str], t: str, x: str, y: str, longest: float = 1.2, near: float = 0.25, edge: float = 0.2, hole: float = 0.35, least: int = 3, room: tuple[float, float] = (0.42, 0.28), widest: float = 0.82, above: float = 0.12, highest: float = 0.35) -> DataFrame:
    """(key, start, end, x0, y0, x1): where to look in each of the equal windows of at most ``longest`` that a key's span (key, start, end) is cut into.

    A window sees the samples from ``near`` before to ``near`` after it. It gives a box if there are ``least`` of them, the first and
    last within ``edge`` of its ends and none ``hole`` apart: as wide as the samples with ``room`` (least, and more),
    unless that is over ``widest``, from ``above`` the highest sample, ``highest`` at most, down to the bottom. Times are cut to what was seen.
    """
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest))
    s = spans.where(F.col("start") < F.col("end")).select(*key, F.col("start").alias("_a"), F.col("end").alias("_b"), n.alias("_n")).withColumn("_w", (F.col("_b") - F.col("_a")) / F.col("_n"))
    rows = samples.select(*key, F.col(t).cast("double").alias("_t"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    met = same_key_join(rows, s, key).where((F.col("_t") >= F.col("_a")) & (F.col("_t") <= F.col("_b")))
    first, last = (F.floor((F.col("_t") - F.col("_a") + d) / F.col("_w")) for d in (-near, near))
    held = met.withColumn("_win", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.col("_n") - 1))))  # one more, as ends count and shares are rounded
    low, high = F.col("_a") + F.col("_win") * F.col("_w"), F.col("_a") + (F.col("_win") + 1) * F.col("_w")
    seen = held.withColumn("_low", low).withColumn("_high", high).where((F.col("_t") >= F.col("_low") - near) & (F.col("_t") <= F.col("_high") + near))
    by = Window.partitionBy(*key, "_win").orderBy("_t")
    box = seen.withColumn("_hole", F.col("_t") - F.lag("_t").over(by)).groupBy(*key, "_win", "_low", "_high").agg(
        F.count(F.lit(1)).alias("_m"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.max("_hole").alias("_hole"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0")
    )
    ok = box.where((F.col("_m") >= least) & (F.col("_t0") <= F.col("_low") + edge) & (F.col("_t1") >= F.col("_high") - edge) & (F.col("_hole") <= hole))
    wide = F.least(F.lit(1.0), F.greatest(F.lit(room[0]), F.col("_x1") - F.col("_x0") + room[1]))
    start, end = F.greatest("_low", "_t0"), F.least("_high", "_t1")
    left = F.greatest(F.lit(0.0), F.least(1 - F.col("_wide"), (F.col("_x0") + F.col("_x1")) / 2 - F.col("_wide") / 2))
    top = F.greatest(F.lit(0.0), F.least(F.lit(highest), F.col("_y0") - above))
    fits = ok.withColumn("_wide", wide).withColumn("start", start).withColumn("end", end).where((F.col("_wide") <= widest) & (F.col("start") < F.col("end")))
    return fits.select(*key, "start", "end", left.alias("x0"), top.alias("y0"), (left + F.col("_wide")).alias("x1"))


def trusted_gaps(df: DataFrame, key: list[str], t: str, x: str, seen: Column, speed: float, longest: float, supports: int = 2, bucket: float | None = None) -> DataFrame:
    """Unseen rows whose value fits between the seen rows around them.

    The gap between the anchors is at most ``longest``, the value within
    ``speed`` times the time to the nearer anchor of the line between them, and
    at least ``supports`` rows of the same gap fit.
    """
    told = neighbours(df.withColumn("_v", F.struct(F.col(t).alias("t"), F.col(x).alias("x"))), key, t, seen, "_v", None, bucket).drop("_v")
    rows = told.withColumnRenamed("previous", "_a").withColumnRenamed("following", "_b")
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col(t) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    near = F.least(F.col(t) - F.col("_a.t"), F.col("_b.t") - F.col(t))
    fits = ~seen & (F.col("_b.t") - F.col("_a.t") <= longest) & (F.abs(F.col(x) - line) <= speed * near)
    good = rows.where(fits).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key, "_a.t", "_b.t")))
    return good.where(F.col("_n") >= supports).drop("_a", "_b", "_n")
