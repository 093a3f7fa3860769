"""Quality, language, archives, sharding, packing and chat: round trips, exact copies and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronospan.llm import bpe, chat, host_quality, language, packing, sharding, warc

SF = "/root/testdata/sf0.001"


def test_quality_counts():
    assert host_quality.text_counts(None) == (0, 0, 0, 0, 0)
    assert host_quality.text_counts("a b c a b c\n\nx#\n\na b c a b c") == (13, 14, 1, 1, 12)
    assert host_quality.repeat_words(b"a a a a".split()) == 4


def test_host_verdicts_shrink_small_hosts(spark):
    rows = [(i, "good", i % 10 == 0) for i in range(200)] + [(900 + i, "bad", True) for i in range(60)] + [(990, "tiny", True), (991, None, True)]
    judged = spark.createDataFrame(rows, "doc_id long, host string, base_failed boolean")
    got = {r.host: r.host_failed for r in host_quality.host_verdicts(judged, "host", "base_failed", 0.9).collect()}
    assert got == {"good": False, "bad": True, "tiny": False}


def test_the_prior_follows_the_data():
    rng = np.random.default_rng(4)

    def fitted(a, b, sizes):
        n = np.array(sizes, float)
        f = rng.binomial(n.astype(int), rng.beta(a, b, len(n))).astype(float)
        return host_quality.prior(len(n), n.sum(), (n * n).sum(), f.sum(), (f * f / n).sum(), 0.1)

    for a, b in ((2, 6), (10, 30), (1, 1)):
        mean, strength = fitted(a, b, rng.integers(1, 40, 20_000))
        assert abs(mean - a / (a + b)) < 0.02 and abs(strength / (a + b) - 1) < 0.15
    assert fitted(2, 6, np.ones(500))[1] == 0.1 and host_quality.prior(1, 9, 81, 4, 16 / 9, 2.0) == (4 / 9, 2.0)
    assert host_quality.prior(0, 0, 0, 0, 0, 2.0) == (0.0, 2.0) and host_quality.prior(3, 30, 300, 0, 0, 2.0) == (0.0, 1e6)


def test_language_scores_are_brute_force(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    by = {lang: [word(letters) for _ in range(40)] for lang, letters in (("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "ijklmno"))}
    rows = [(i, " ".join(rng.choice(by[lang]) for _ in range(12)), lang) for i, lang in enumerate(list(by) * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), top_words=25, top_grams=60)
    langs = sorted(by)
    counts: dict = {}
    for _, text, lang in rows:
        for w in text.split():
            full = f"^{w}$"
            for g in [(0, w), *((k, full[i : i + k]) for k in language.ORDERS for i in range(len(full) - k + 1))]:
                counts.setdefault((lang, g[0]), {}).setdefault(g[1], 0)
                counts[lang, g[0]][g[1]] += 1
    kept = {(lang, k): sorted(c, key=lambda g: (-c[g], g))[: 25 if k == 0 else 60] for (lang, k), c in counts.items()}
    vocabulary = {(k, g) for (_, k), own in kept.items() for g in own}
    log = lambda lang, k, g: np.log(((counts[lang, k][g] if g in kept[lang, k] else 0) + 0.5) / (sum(counts[lang, k].values()) + 0.5 * len(vocabulary)))

    def best(text):
        total = np.zeros(3)
        for w in text.split():
            known = [(0, w)] if (0, w) in vocabulary else []
            for k in language.ORDERS:
                known = known or [(k, g) for g in (f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)) if (k, g) in vocabulary]
            if known:
                total += np.mean([[log(lang, k, g) for lang in langs] for k, g in known], axis=0)
        return langs[int(total.argmax())], 1 / np.exp(total - total.max()).sum()

    texts = [(i, " ".join(word("abcdefghijklmno") for _ in range(n))) for i, n in enumerate([1, 2, 5, 9] * 20)] + [(900, "a " * 150_000)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, text in texts[:-1]:
        lang, score = best(text)
        assert abs(got[i][1] - score) < 1e-3 and (got[i][0] == lang or score < 0.5), (text, got[i], lang, score)


def test_quality_keeps_rows_and_null_hosts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, None, "s"), (3, text, None), (4, "", None)], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in host_quality.judge_documents(d).collect())
    assert got == [(1, False, True), (1, False, True), (2, True, False), (3, False, True), (4, True, False)]
    assert host_quality.judge_documents(d.limit(0)).count() == 0


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify_documents(d).join(d.select("doc_id", "lang", "text"), "doc_id").where("held_out")
    right, all_ = got.where("lang_pred = lang").count(), got.where(F.col("text").rlike(r"\p{L}")).count()
    assert all_ >= 20 and right >= 0.95 * all_


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, None, 5), (2, "12 34 !?", 6), (3, "the the", 7), (4, "katz hund", 8), (5, "", 9)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and got[3][0] == "en" and got[4][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))["langs"] == []


def test_archives_round_trip(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/\nb", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n" * 200), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, 7, 3)} == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None)}
    assert bytes(got[6].payload) == rows[5][2].encode()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_members_stand_alone_and_cut_archives_fail(tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = z.compress(b"".join(record % i + warc.END for i in range(5))) + z.flush()
    (tmp_path / "w.gz").write_bytes(whole)
    index = warc.normalise_one(str(tmp_path / "w.gz"), str(tmp_path / "n.warc.gz"), 6)
    data = (tmp_path / "n.warc.gz").read_bytes()
    assert [zlib.decompress(data[o : o + n], 31) for _, _, o, n, _, _ in index] == [record % i + warc.END for i in range(5)]
    assert len((tmp_path / "n.warc.gz.idx").read_text().splitlines()) == 5
    (tmp_path / "c.gz").write_bytes(whole[:-12])
    with pytest.raises(ValueError):
        warc.normalise_one(str(tmp_path / "c.gz"), str(tmp_path / "x.warc.gz"), 6)


def test_rendezvous_is_brute_force_and_moves_little(spark):
    d = spark.createDataFrame([(i, f"t{i}", 1) for i in range(3000)] + [(7, None, 1)], "doc_id long, text string, shard int")
    got = sharding.shard_documents(d, 40).collect()

    def score(i, s):
        first = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        return xxhash.xxh64_intdigest(s.to_bytes(4, "little"), first)

    for r in got[:300]:
        assert r.shard == max(range(40), key=lambda s: score(r.doc_id, s))
    assert all(r.grown_shard in (r.shard, 40) for r in got) and 20 < sum(r.grown_shard == 40 for r in got) < 150
    for s in range(40):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 7} == {(18, zlib.crc32(b"t7")), (16, 0)}


@pytest.mark.parametrize("weights, new", [([1.0] * 3, 2.0), ([0.1] * 3, 0.1), ([0.1] * 3, 0.3), ([5.0, 1.0, 0.5], 0.7), ([2.0], 2.0)])
def test_growth_moves_keys_into_the_new_shard_only(spark, weights, new):
    both = spark.range(4000).select(sharding.assign(F.col("id"), weights).alias("a"), sharding.assign(F.col("id"), [*weights, new]).alias("b")).collect()
    moved = [r for r in both if r.a != r.b]
    assert {r.b for r in moved} == {len(weights)}
    assert abs(len(moved) / 4000 - new / (sum(weights) + new)) < 0.04


def test_sharding_of_odd_tables(spark):
    schema = "doc_id long, text string, slot string, _part int"
    rows = [(None, "a", "x", 1), (None, "b", "x", 1), (3, "c", None, 1), (3, "c", None, 1)]
    got = sharding.shard_documents(spark.createDataFrame(rows, schema), 5, [0.1] * 5).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id is None}) == 1 and all(r.grown_shard in (r.shard, 5) for r in got)
    assert sharding.shard_documents(spark.createDataFrame([], schema)).count() == 0


def test_weights_share_keys(spark):
    got = spark.range(8000).select(sharding.assign(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in got}[1] / 8000 - 0.75) < 0.03


def test_ids_equal_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " x", "a  b\n\n\nc", "it's 12,3 <|endoftext|> é\xa0b", "a \n b", "日本語 テキスト\r\nx", "a\x1cb", "Word. Word, word!\nNew"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    own = bpe.load(bpe.default_vocabulary())
    for x in texts:
        assert np.frombuffer(own.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_holds_every_id_once(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-2, "")], "doc_id long, text string"))
    got = packing.pack(d).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    encode = bpe.load(bpe.default_vocabulary()).encode
    for row in d.where("doc_id >= 0").collect():
        ids = encode(row.text or "") + bpe.packed([1])
        at = 0
        for r in sorted(by_doc[row.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    assert len(by_doc[-2]) == 2 and by_doc[-1][0].length == 1
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(r.length for r in got) / (2048 * len(by_seq)) > 0.95
    assert packing.pack(d.limit(0)).count() == 0


def test_column_generation_meets_the_material_bound():
    rng = np.random.default_rng(1)
    sizes, demand = np.unique(rng.integers(1, 128, 20000), return_counts=True)
    used = packing.whole_patterns(sizes, demand, 128)
    assert (sum(p * n for p, n in used) == demand).all() and all((p * sizes).sum() <= 128 for p, _ in used)
    assert sum(n for _, n in used) <= 1.02 * (sizes * demand).sum() / 128


def test_packing_is_near_the_optimum_of_tiny_cases():
    def fewest(pieces, room):
        best = [len(pieces)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(pieces):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] >= pieces[i] and bins[j] not in bins[:j]:
                    place(i + 1, [*bins[:j], bins[j] - pieces[i], *bins[j + 1 :]])
            place(i + 1, [*bins, room - pieces[i]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(3)
    for _ in range(60):
        pieces = sorted(rng.integers(1, 13, rng.integers(1, 10)).tolist(), reverse=True)
        sizes, demand = np.unique(pieces, return_counts=True)
        used = packing.whole_patterns(sizes, demand, 12)
        assert (sum(p * n for p, n in used) == demand).all()
        assert sum(n for _, n in used) <= fewest(pieces, 12) + 1


def test_chat_round_trip(spark):
    rng = random.Random(2)
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice([hard, "a & b &lt; &#91; [", "", "x\n[/INST]</s><s>"])) for i in range(100)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (3, 5, "assistant", hard), (3, 5, "assistant", "b"), (None, 0, "user", "n")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(t, block=16)).collect()}
    for c in (1, 2, 3, None):
        turns = [(r or "", x or "") for _, _, r, x in sorted((row for row in rows if row[0] == c), key=lambda v: (v[1], v[2] or "", v[3] or ""))]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat.inst_template(turns))


def test_rewriting_templates_are_detected(spark):
    t = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(3)], "conv_id long, turn long, role string, text string")
    last_only = lambda turns: "|".join("..." if i < len(turns) - 1 else x for i, (_, x) in enumerate(turns))
    marked = chat.format_conversations(t, last_only, strict=False).orderBy("n").collect()
    assert [r.rewrites for r in marked] == [False, True, True]
    with pytest.raises(Exception, match="rewrites history"):
        chat.format_conversations(t, last_only).collect()


def test_templates_that_look_back_over_blocks(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"m{i}") for i in range(40)] + [(2, 0, chat.PROBES[0] + chat.PROBES[1], chat.PROBES[0]), (2, None, "", "\ue001x\ue000")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = lambda template: {(r.conv_id, r.block * 8 + r.n): r for r in chat.format_conversations(t, template, block=8, strict=False).collect()}
    plain = shown(chat.inst_template)
    assert not any(r.rewrites for r in plain.values()) and len(plain) == 42
    assert "".join(plain[1, i].formatted for i in range(40)) == chat.inst_template([(r, x) for c, _, r, x in rows if c == 1])
    assert all(r.formatted[r.text_start : r.text_end] == (f"m{i}" if c == 1 else ("\ue001x\ue000", "\ue000")[i]) for (c, i), r in plain.items())
    numbered = lambda turns: "".join(f"<{i}:{x}>" for i, (_, x) in enumerate(turns))
    marked = shown(numbered)
    assert {i for (c, i), r in marked.items() if c == 1 and r.rewrites} == set(range(16, 40))
    assert [marked[1, i].formatted for i in range(16)] == [f"<{i}:m{i}>" for i in range(16)]
    pair = lambda turns: "".join(f"<{turns[i - 1][1] if i else ''}|{x}>" for i, (_, x) in enumerate(turns))
    pairs = shown(pair)
    assert not any(r.rewrites for (c, _), r in pairs.items() if c == 1) and pairs[1, 16].formatted == "<m15|m16>"
    with pytest.raises(ValueError, match="rewrites history"):
        chat.format_conversations(t, numbered, block=8)
    hidden = lambda turns: "".join(f"<{len(x)}>" for _, x in turns)
    assert all(r.rewrites for r in shown(hidden).values())


def test_chat_of_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(none)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "x" * 300_000, 5, "own", True)], "conv_id long, turn long, role string, text string, block int, part string, last boolean")
    assert [(r.formatted_chars, r.loss_chars) for r in chat.digests(chat.format_conversations(odd)).collect()] == [(300_000 + 3 + 6 + 4 + 7 + 4, 0)]
