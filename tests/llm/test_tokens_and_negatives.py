"""Operators 11 to 13 against the tokenizers' libraries and plain Python: round trips, ties, repeats, nulls, empty tables, clashing names."""

import hashlib
import itertools
import random
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospan.llm import bpe, hard_negatives, prefix_bpe, queries, token_alignment

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n", "  a  b ", "a\n", "\na", "a \nb", "a\n b", "\n\n", "don't I'LL we'VE", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "ΣΑΣ İstanbul é é ﬁ ẞ", "中文 字\n日本語" * 40,
    "🙂👩‍👩‍👧 ½ ⅷ 12345", "\x85a\x1cb\x00c\ta\r\nb\xa0c", "</w> a</w>b", "a" * 3000, "▁a b", "a▁b", "<s> x </s> <unk> <0x0A>", "﻿x", "!!!???...", " x ", "same text twice", "same text twice", "word " * 30_000,
]


def documents(spark, texts):
    rows = [(i, t, "ids", "x", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, key string, a int").withColumn("decoded", F.lit(0)).withColumn("b", F.lit(2)).withColumn("cuts", F.lit(3))


def sampled(spark, n=150):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(prefix_bpe.default_vocabulary())


def test_prefix_bpe_equals_the_library(spark, word_library):
    texts = ODD + sampled(spark)
    got = {r.doc_id: r for r in prefix_bpe.digests(prefix_bpe.encode(documents(spark, texts))).collect()}
    assert len(got) == len(texts) + 1
    for i, text in [*enumerate(texts), (None, "no id")]:
        ids = word_library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), repr(text)[:60]
        assert got[i].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest(), repr(text)[:60]
        assert got[i].decoded_sha256 == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), repr(text)[:60]
    assert prefix_bpe.encode(documents(spark, []).where("false")).count() == 0


def test_prefix_bpe_on_every_plain_character(word_library):
    own = prefix_bpe.load(prefix_bpe.default_vocabulary())
    for c in map(chr, range(0x260)):
        text = f"a{c}b {c} {c}{c}"
        assert list(memoryview(own.encode(text)).cast("I")) == word_library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_last_tokens_equal_merging_by_definition():
    """Random merges, so that ranks tie and cross: the last token of every prefix is that of the prefix merged by definition."""
    r = random.Random(6)
    for _ in range(150):
        made, tokens = {}, list(range(3))
        for rank in range(r.randint(1, 12)):
            pair = (r.choice(tokens), r.choice(tokens))
            if pair not in made:
                made[pair] = (rank, len(tokens))
                tokens.append(len(tokens))
        merges = prefix_bpe.Merges(made)
        spelt = {i: (i,) for i in range(3)}
        for (a, b), (_, t) in sorted(made.items(), key=lambda x: x[1]):
            spelt[t] = spelt[a] + spelt[b]
        own = {t for t, s in spelt.items() if prefix_bpe.merged(list(s), made) == [t]}
        for a, b in itertools.product(own, own):
            whole = prefix_bpe.merged([*spelt[a], *spelt[b]], made)
            assert merges.compatible(a, b) == (whole == [a, b]), (made, a, b)


def test_alignment_equals_brute_force(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = token_alignment.load(bpe.default_vocabulary(), token_alignment.default_piece_model())
    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=token_alignment.default_piece_model())
    texts = [*ODD[:-1], *sampled(spark)]
    want, links, counts = {}, {}, Counter()
    for i, text in [*enumerate(texts), (None, "no id")]:
        a = library.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        sizes = [[len(t.bytes[x]) for x in ids] for t, ids in ((one, a), (two, b))]
        if not text or any(b"".join(t.bytes[x] for x in ids) != f" {text}".encode() for t, ids in ((one, a), (two, b))):
            want[i], links[i] = (0, 0, 0, ""), []
            continue
        ends = [list(itertools.accumulate(s)) for s in sizes]
        groups, at, links[i] = [], [0, 0], []
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(end, p) + 1 for e, p in zip(ends, at, strict=True)]
            groups.append("|".join(",".join(map(str, ids[p:q])) for ids, p, q in zip((a, b), at, to, strict=True)))
            links[i].append((a[to[0] - 1], b[to[1] - 1]))
            at = to
        counts.update(links[i])
        want[i] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    got = {r.doc_id: r for r in token_alignment.alignment_report(documents(spark, texts)).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.n_a, r.n_b, r.n_groups, r.groups_sha256) == want[i] and r.n_links == len(links[i])
        assert (r.n_best, r.count_sum) == (sum(counts[x] == top[x[1]] for x in links[i]), sum(counts[x] for x in links[i]))
    assert token_alignment.alignment_report(documents(spark, []).where("false")).count() == 0


def negatives(rows, anchor, k=5):
    """By definition, one anchor after the other, in Python's own whole numbers."""
    points = sorted({(i, label, tuple(int(np.floor(256 * float(x))) for x in v)) for i, label, v in rows})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, q in (p for p in points if anchor(p[0])):
        scored = sorted(((-dot(q, v), j, other) for j, other, v in points if j != i))
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **sizes):
    usable = hard_negatives.points(df, "vec_id", "label", "embedding")
    got = hard_negatives.mine(usable, F.col("id") % 10 == 0, **sizes)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        v = rng.normal(size=6) * rng.choice([0.05, 0.3, 1.0, 4.0])
        rows.append((i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in v]))
    rows += [(i, i % 2, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 520)]  # one vector many times: ties
    rows += [(400, 0, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0])] * 3 + [(30, 1, [1.0] * 6), (7, 2, [0.3, 0.2]), (8, 1, [])]
    left_out = [(900, None, [1.0] * 6), (910, 1, None), (920, 1, [1.0, None]), (930, 1, [float("nan"), 1.0]), (940, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (950, 2, [1e12] * 6)]
    schema = "vec_id long, label int, embedding array<float>"
    df = spark.createDataFrame(rows + left_out, schema).withColumn("id", F.lit("x")).withColumn("norm", F.lit(0)).withColumn("block", F.lit(1)).withColumn("q", F.lit(1)).repartition(5)
    kept = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    want = negatives(kept, lambda i: i % 10 == 0)
    assert mined(df, bucket_rows=32, block_rows=8) == want and want
    assert mined(df) == want
    assert mined(df.where("false")) == [] and mined(df.where("vec_id = 10")) == []


def test_buckets_that_no_window_can_reach_are_not_joined(spark):
    rows = [(i, i % 2, [0.01 * (i + 1), 0.0]) for i in range(200)]
    usable = hard_negatives.points(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "vec_id", "label", "embedding")
    found = hard_negatives.mine(usable, F.col("id") == 190, bucket_rows=10, block_rows=4)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect()) == negatives(rows, lambda i: i == 190)


def test_exploded_blocks_are_not_broadcast(spark, monkeypatch):
    """Each block came with its vectors once a bucket, and all of them went through the driver."""
    seen, stored = [], hard_negatives._stored
    monkeypatch.setattr(hard_negatives, "_stored", lambda df, name: (seen.append(df), stored(df, name))[1])
    monkeypatch.setattr(hard_negatives, "TOPS", 4)
    rng = random.Random(6)
    rows = [(i, i % 3, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    usable = hard_negatives.points(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "vec_id", "label", "embedding")
    assert len(hard_negatives._buckets(usable, 5)[2]) <= 4
    assert hard_negatives.mine(usable, F.col("id") % 10 == 0, bucket_rows=5, block_rows=4).count() > 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 2 and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_whole_numbers_beyond_floating_point(spark):
    big = 2.0**19
    rows = [(0, 0, [big, big - 1]), (1, 0, [big - 2, big]), (2, 1, [big - 3, big - 1]), (3, 1, [big - 3, big - 2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df) == negatives(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("name", ["op11_prefix_bpe", "op12_token_alignment", "op13_hard_negatives"])
def test_the_queries_read_whole_tables(spark, name):
    got = queries.QUERIES[name](spark, SF)
    if name != "op13_hard_negatives":
        assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert got.select("anchor_id").where("anchor_id % 100 <> 0").count() == 0 and got.count() > 0


def test_groups_as_text_equal_groups_cut_one_by_one():
    rng = np.random.default_rng(4)
    for size in (1, 2, 9, 400):
        a, b = (rng.integers(0, 70_000, 3 * size).astype(np.int32) for _ in "ab")
        a_at, b_at = (np.sort(rng.choice(3 * size, size, replace=False)) for _ in "ab")
        want, last = [], (-1, -1)
        for i, j in zip(a_at, b_at):
            want.append(",".join(map(str, a[last[0] + 1 : i + 1])) + "|" + ",".join(map(str, b[last[1] + 1 : j + 1])))
            last = i, j
        assert token_alignment._group_text(a, b, a_at, b_at, 70_000) == ";".join(want)
    assert token_alignment._group_text(a, b, a_at[:0], b_at[:0], 70_000) == ""


def test_alignment_takes_ends_from_the_encoded_documents(spark, capsys):
    """Running ends by a window over all tokens sorted each side twice."""
    docs = documents(spark, ["one two", "", "three"]).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    made = lambda dealt: token_alignment.encoded(dealt, bpe.default_vocabulary(), token_alignment.default_piece_model())
    held = token_alignment.Bucketed(docs, made, "key", ["a_end", "b_end"], "ends_test")
    rows = {r.doc_id: r for r in held.df.collect()}
    assert (rows[0].a_end[-1], rows[0].b_end[-1]) == (8, 8) and rows[1].a_end == rows[1].b_end == [] and rows[2].a_end[-1] == 6
    assert all(len(r.a) == len(r.a_end) and r.a_end == sorted(r.a_end) and len(r.b) == len(r.b_end) for r in rows.values())
    token_alignment.align(held.df).explain()
    assert "Window" not in capsys.readouterr().out
    held.drop()
