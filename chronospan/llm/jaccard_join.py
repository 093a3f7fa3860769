"""Set-similarity self-join by signature trees (operator 7).

Documents are sets of hashed word n-grams. The join finds the components of
the graph whose links are pairs of documents with Jaccard similarity of at
least num / den.

1. Documents of equal sets collapse into one class at once.
2. *Roots.* Each set is split by hash into more parts than two linked sets of
   its size can differ in, so linked sets agree on a whole part and meet under
   that part's key (pigeonhole: no link is lost). Sizes are banded so that both
   sides split alike; sets near a band's end take part in the next one too. A
   part that is empty gives a key only for sets with so many empty parts that
   they may agree on nothing else. With ``lossless`` off, keys are bands of
   MinHash values instead (see ``BANDS``).
3. Under each key, all documents are compared exactly with the key's smallest
   one, a number of pairs in proportion to the keys; links found give classes.
4. *Trees.* Documents under keys where classes still meet unlinked are compared
   by dual traversal of trees of size bands, tiles of about ``TILE`` documents
   and documents. Nodes hold the OR of their members' token bitmaps, their size
   range, the most tokens any member loses to bit collisions and their range of
   classes. A pair of nodes goes on only if the sizes are compatible, the largest
   overlap that the bitmaps allow would be enough and the two are not one class
   already, so a group of thousands of near copies is not expanded; pairs of
   documents left are compared exactly.
5. Components of all links.

Defined results: null text or text without words is an empty set, linked with
nothing, also not with other empty sets; texts shorter than the n-gram are one
n-gram; rows of one doc_id are one document, whose rows all get its component:
with different texts it is linked with documents of a set equal to any of them,
and with near ones by the greatest text; empty input gives no rows; other
columns are ignored, whatever their names; null doc_ids are left out of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, components, maybe_broadcast, words

#: Upper end over lower end of a size band.
RATIO = 1.3
#: 64-bit words of a token bitmap.
BITMAP = 16
TILE = 64
#: MinHash bands and values a band when not lossless: a pair at similarity 0.8 is missed once in 300,000 times.
BANDS, ROWS = 24, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: Column, k: int) -> Column:
    """Distinct hashed word ``k``-grams of a text with A-Z lower-cased."""
    w = words(F.translate(text, _UPPER, _LOWER))

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.size(w), F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= k, F.array_distinct(each)).otherwise(short)

    return F.transform(F.array(w), grams)[0]  # the words are bound once, not worked out at each use


@lru_cache(maxsize=8)
def size_bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends, parts, parts that linked sets always agree on) of the size bands up to ``largest``."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, int(np.ceil(low[-1] * RATIO))))
    low.append(max(low[-1] + 1, int(np.ceil(low[-1] * RATIO))))
    lows = np.array(low, np.int64)
    differ = 2 * (lows[1:] - 1) * (den - num) // (den + num)
    empty = (differ + 1) * np.exp(-lows[:-1] / (differ + 1))
    spare = np.where(empty > 0.02, np.ceil(empty + 3 * np.sqrt(empty)), 0).astype(np.int64)
    return lows, differ + 1 + spare, 1 + spare


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def part_keys(flat: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) for all sets of a batch, whose elements lie in ``flat`` one set after the other."""
    lows, parts, agree = size_bands(num, den, int(sizes.max(initial=1)))
    some = np.flatnonzero(sizes > 0)
    band = np.searchsorted(lows, sizes[some], side="right") - 1
    both = sizes[some] * den >= num * lows[band + 1]
    owner, band = np.concatenate([some, some[both]]), np.concatenate([band, band[both] + 1])
    m = parts[band]
    base = np.cumsum(m) - m
    start = np.cumsum(sizes) - sizes
    n = sizes[owner]
    element = np.repeat(start[owner] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    h = flat[element].view(np.uint64)
    slot = np.repeat(base, n) + (h % np.repeat(m, n).astype(np.uint64)).astype(np.int64)
    sums = np.zeros(int(m.sum()), np.uint64)
    filled = np.zeros(len(sums), bool)
    with np.errstate(over="ignore"):
        np.add.at(sums, slot, mixed(h + _MIX))
        filled[slot] = True
        empties = m - np.add.reduceat(filled.astype(np.int64), base) if len(m) else m
        emit = filled | np.repeat(empties >= agree[band], m)
        part = np.arange(len(sums)) - np.repeat(base, m)
        key = mixed(sums + mixed((np.repeat(band, m) << 32 | part).astype(np.uint64) * _MIX))
    return np.repeat(owner, m)[emit], key[emit].view(np.int64)


def band_keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`part_keys`, from bands of MinHash values."""
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return some, flat[:0]
    start = (np.cumsum(sizes) - sizes)[some]
    h, out = flat.view(np.uint64), []
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(some), b, np.uint64)
            for r in range(ROWS):
                seed = mixed(np.array([b * ROWS + r + 1], np.uint64) * _MIX)[0]
                key = mixed((key ^ np.minimum.reduceat((h ^ seed) * (seed | np.uint64(1)), start)) + _MIX)
            out.append(key.view(np.int64))
    return np.tile(some, BANDS), np.concatenate(out)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def keyed_sets(sets: DataFrame, num: int, den: int, lossless: bool) -> DataFrame:
    """Rows (doc_id, n, set_hash, set_hash2, keys) from rows (doc_id, sh)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _flat(batch.column(1))
            owner, key = part_keys(flat, sizes, num, den) if lossless else band_keys(flat, sizes)
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int32)
            sums, sums2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(over="ignore"):
                np.add.at(sums, row, mixed(flat.view(np.uint64)))
                np.add.at(sums2, row, mixed(flat.view(np.uint64) * _MIX + np.uint64(1)))
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(sums.view(np.int64)), pa.array(sums2.view(np.int64)), keys],
                ["doc_id", "n", "set_hash", "set_hash2", "keys"],
            )

    return sets.mapInArrow(run, "doc_id long, n long, set_hash long, set_hash2 long, keys array<long>")


def with_bitmaps(sets: DataFrame) -> DataFrame:
    """Rows (doc_id, n, sh, bits, lost): token bitmap, and the tokens beyond the first on their bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _flat(batch.column(1))
            wide = 64 * BITMAP
            on = np.zeros((len(sizes), wide), bool)
            on[np.repeat(np.arange(len(sizes)), sizes), (flat.view(np.uint64) >> np.uint64(20)) % np.uint64(wide)] = True
            packed = np.packbits(on, axis=1, bitorder="little").view(np.int64).ravel()
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BITMAP), pa.array(packed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), batch.column(1), bits, pa.array(sizes - on.sum(axis=1))], ["doc_id", "n", "sh", "bits", "lost"]
            )

    return sets.mapInArrow(run, "doc_id long, n long, sh array<long>, bits array<long>, lost long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets' similarity is at least num / den."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb"))
    sizes = F.size("sa") + F.size("sb")
    enough = F.transform(F.array(F.size(F.array_intersect("sa", "sb")).cast("long")), lambda c: den * c >= num * (sizes - c))[0]
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def compatible(num: int, den: int) -> Column:
    """Whether any members of nodes l and r may give a new link: sizes, the largest overlap that the bitmaps allow, classes."""
    sizes = (F.col("l.hi") * den >= F.col("r.lo") * num) & (F.col("r.hi") * den >= F.col("l.lo") * num)
    shared = sum((F.bit_count(F.col(f"l.b{i}").bitwiseAND(F.col(f"r.b{i}"))) for i in range(1, BITMAP)), F.bit_count(F.col("l.b0").bitwiseAND(F.col("r.b0"))))
    overlap = F.least(shared + F.col("l.lost"), shared + F.col("r.lost"), F.col("l.hi"), F.col("r.hi"))
    one_class = (F.col("l.cls_lo") == F.col("l.cls_hi")) & (F.col("r.cls_lo") == F.col("r.cls_hi")) & (F.col("l.cls_lo") == F.col("r.cls_lo"))
    return sizes & ~one_class & (overlap * (num + den) >= num * (F.col("l.lo") + F.col("r.lo")))


def leaf_pairs(num: int, den: int) -> Column:
    """Pairs (a, b) of documents of leaf nodes l and r of different classes that sizes and bitmaps allow."""

    def fits(x: Column, y: Column) -> Column:
        shared = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda acc, c: acc + c)
        overlap = F.least(shared + x["lost"], shared + y["lost"])
        sizes = (x["n"] * den >= y["n"] * num) & (y["n"] * den >= x["n"] * num)
        return (x["cls"] != y["cls"]) & sizes & (overlap * (num + den) >= num * (x["n"] + y["n"]))

    pair = lambda x: F.transform(F.filter("r.docs", lambda y: fits(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))
    return F.flatten(F.transform("l.docs", pair))


def node_columns() -> list[Column]:
    return [
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("lost").alias("lost"), F.min("cls_lo").alias("cls_lo"), F.max("cls_hi").alias("cls_hi"),
        *[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(BITMAP)],
    ]


def traverse(met: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) left after dual traversal, of members (doc_id, cls, n, lost, bits) that meet as (key, doc_id, pivot).

    A member's tree is that of the smallest pivot it meets. Trees that share a
    key are traversed against each other and themselves: tree, size band, tile
    of about ``TILE`` members, and at last members within pairs of tiles, where
    only pairs that may be linked become rows.
    """
    of = met.groupBy("doc_id").agg(F.min("pivot").alias("tree"))
    leaf = members.join(of, "doc_id").select(
        "tree", "doc_id", "n", "lost", "cls", "bits", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.05)))).cast("int").alias("band")
    )
    leaf = Stored(leaf, "tree_leaves").df
    counts = leaf.groupBy("tree", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles"))
    dealt = leaf.join(counts, ["tree", "band"]).withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")))
    single = dealt.select(
        "tree", "band", "tile", F.col("n").alias("lo"), F.col("n").alias("hi"), "lost", F.col("cls").alias("cls_lo"), F.col("cls").alias("cls_hi"),
        *[F.col("bits")[i].alias(f"b{i}") for i in range(BITMAP)], F.struct(F.col("doc_id").alias("id"), "n", "lost", "cls", "bits").alias("doc"),
    )
    tiles = Stored(single.groupBy("tree", "band", "tile").agg(*node_columns(), F.collect_list("doc").alias("docs")), "tree_tiles").df
    bands = Stored(tiles.groupBy("tree", "band").agg(*node_columns()), "tree_bands").df
    trees = bands.groupBy("tree").agg(*node_columns())
    of_key = met.join(of, "doc_id").select("key", "tree").distinct()
    several = of_key.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    of_key = of_key.join(several, "key")
    other = of_key.select("key", F.col("tree").alias("other"))
    pairs = of_key.join(other, "key").where("tree < other").select("tree", "other").distinct()
    pairs = pairs.unionByName(trees.select("tree", F.col("tree").alias("other")))
    now = pairs.select(F.struct("tree").alias("x"), F.struct(F.col("other").alias("tree")).alias("y"))
    for nodes, up in ((trees, ["tree"]), (bands, ["tree"]), (tiles, ["tree", "band"])):
        own = [c for c in ("tree", "band", "tile") if c in nodes.columns]
        on_left = [F.col(f"x.{c}") == F.col(f"l.{c}") for c in up]
        on_right = [F.col(f"y.{c}") == F.col(f"r.{c}") for c in up]
        once = (F.col("x") != F.col("y")) | (F.struct(*[F.col(f"l.{c}") for c in own]) <= F.struct(*[F.col(f"r.{c}") for c in own]))
        here = now.join(nodes.alias("l"), on_left).join(nodes.alias("r"), on_right).where(once & compatible(num, den))
        if nodes is not tiles:
            now = here.select(F.struct(*[F.col(f"l.{c}") for c in own]).alias("x"), F.struct(*[F.col(f"r.{c}") for c in own]).alias("y"))
    found = here.select(F.explode(leaf_pairs(num, den)).alias("p")).select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"))
    return found.distinct()


def link_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, lossless: bool = True) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one a row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    sets = rows.select("doc_id", shingles(F.col("text"), k).alias("sh"))
    keyed = Stored(keyed_sets(sets, num, den, lossless), "jaccard_keys").df
    same = ["n", "set_hash", "set_hash2"]
    classes = keyed.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    reps = keyed.join(classes, same).select("doc_id", "rep")  # equal rows agree
    own = keyed.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    met = own.select("doc_id", F.explode("keys").alias("key"))
    first = met.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last").select("key", "pivot")
    shared = Stored(first, "jaccard_shared")
    member = Stored(met.join(maybe_broadcast(shared), "key").distinct(), "jaccard_members").df

    active = member.select("doc_id").distinct()
    text_of = rows.join(active, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    big = Stored(with_bitmaps(text_of.select("doc_id", shingles(F.col("text"), k).alias("sh"))), "jaccard_sets").df

    stars = member.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    near = Stored(verified(stars, big, num, den), "jaccard_links").df
    grouped = Stored(components(near, "jaccard_classes"), "jaccard_grouped").df
    named = big.select("doc_id", "n", "lost", "bits").join(grouped, F.col("doc_id") == F.col("id"), "left")
    named = named.withColumn("cls", F.coalesce("component", "doc_id")).drop("id", "component")

    others = member.where("doc_id <> pivot")  # pivots have met all others of their keys
    of_key = others.join(named.select("doc_id", "cls"), "doc_id")
    mixed_keys = of_key.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    unsettled = Stored(others.join(mixed_keys, "key"), "jaccard_unsettled").df
    left = traverse(unsettled, named, num, den)
    more = Stored(verified(left, big, num, den), "jaccard_more").df

    final = Stored(components(near.unionByName(more), "jaccard_components"), "jaccard_final").df
    placed = reps.join(final, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).distinct()
    return keyed.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, lossless: bool = False) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component; one row of equal ids' rows stays."""
    found = link_components(docs, k, num, den, lossless)
    lost = Stored(found.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard_lost")
    return docs.join(maybe_broadcast(lost), "doc_id", "left_anti").select(*docs.columns)
