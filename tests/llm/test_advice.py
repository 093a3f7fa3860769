"""Cases in which operators once did less than the whole job."""

import random
import zlib

from pyspark.sql import functions as F

from chronospan.llm import bpe, decontaminate, line_dedup, packing, sentence_spans

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def found(spark, rows, items):
    got = decontaminate.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return {(r.doc_id, r.item_id): r.kind for r in got}


def test_quantities_do_not_shift_tokens(spark):
    item = "the 9 boats carry 40 crates over 6 rivers and then 9 boats carry 15 crates back home"
    docs = [(1, f"first we ran 3.5 km uphill. {item} again"), (2, f"1,200 kg of it, {item.replace('40', '41')} again")]
    assert found(spark, docs, [(7, item)]) == {(1, 7): "verbatim", (2, 7): "reparameterised"}


def test_template_has_the_positions_of_the_tokens(spark):
    texts = ["ran 3.5 km and 1,200 kg", "at 12:30 h he paid $4.50 for 7, 8. 3/4 cups", "5 kg Bella 6km 1.5x v1.5 9%"]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS).select("doc_id", decontaminate.canonical(F.col("text")).alias("v"))
    rows = d.select("doc_id", "v", decontaminate.template(F.col("v")).alias("t")).orderBy("doc_id").collect()
    assert all(len(r.v) == len(r.t) for r in rows)
    assert rows[0].t == ["ran", "\ue002", "and", "\ue002"] and rows[0].v == ["ran", "\ue00235km", "and", "\ue0021200kg"]


def test_items_full_of_slots_and_short_items_are_found(spark):
    series, short = "What comes next: 2 4 8 16 32 64 128", "Name the 3 rivers"
    docs = [(1, f"so, {series.lower()}?"), (2, f"x y. {short} z"), (3, "name the 4 rivers"), (4, "What comes next: 1 3 9 27 81 243 729"), (5, "name the 3"), (6, series.upper())]
    assert found(spark, docs, [(1, series), (2, short), (3, " ")]) == {(1, 1): "verbatim", (2, 2): "verbatim", (6, 1): "verbatim"}


def test_names_at_sentence_starts_are_slots(spark):
    item = "Tom has 5 apples in his bag. Tom buys 3 (Tom likes them).\nTom eats 2 of all those apples. How many remain?"
    other = item.replace("Tom", "Anna").replace("5", "7").replace("3", "4")
    mixed = item.replace("Tom", "Anna", 1).replace("Tom", "Eva")
    assert found(spark, [(1, other), (2, f"well {item}"), (3, mixed)], [(1, item)]) == {(1, 1): "reparameterised", (2, 1): "verbatim"}


def test_two_values_may_become_one(spark):
    item = "a farmer sold 5 apples and then 8 pears to the baker who lives next door in town"
    assert found(spark, [(1, item.replace("5", "6").replace("8", "6"))], [(1, item)]) == {(1, 1): "reparameterised"}


def test_windows_full_of_slots_count_beside_others(spark):
    item = "please add up all of the numbers 4 7 9 12 15 18 21 24"
    docs = [(1, item.replace("4 7 9", "5 6 8")), (2, "please add up all of the numbers 1 but not those that are odd or small")]
    assert found(spark, docs, [(1, item)]) == {(1, 1): "reparameterised"}


def numbered(name, sizes):
    return " ".join(" ".join(f"{name}{i}x{j}" for j in range(n)).capitalize() + "." for i, n in enumerate(sizes))


def cleaned(spark, rows):
    return {r.doc_id: r.text for r in sentence_spans.clean_documents(spark.createDataFrame(rows, DOCS)).collect()}


def test_tails_of_repeated_passages_go(spark):
    passage = numbered("p", [9, 8, 6, 19, 9, 3, 7])
    rows = [(1, f"{passage} {numbered('a', [5, 30])}"), (2, f"{numbered('b', [5, 30])} {passage} {numbered('c', [4, 12])}")]
    assert cleaned(spark, rows) == {1: rows[0][1], 2: f"{numbered('b', [5, 30])} {numbered('c', [4, 12])}"}


def test_every_sentence_of_a_long_repeat_is_covered():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 15))]
        found = sentence_spans.runs(numbered("w", sizes))
        assert (sum(sizes) >= 25) == (bool(found) and min(i for _, i, _ in found) == 0 and {n for _, i, j in found for n in range(i, j + 1)} == set(range(len(sizes))))


def test_unspaced_scripts_have_sentences_and_words(spark):
    passage = "昨日は雨が降っていましたので家にいました。今日は天気がとても良いです。明日は友達と山へ行きます！「はい。」と言った。"
    assert [passage[a:b] for a, b in sentence_spans.sentences(passage)] == ["昨日は雨が降っていましたので家にいました。", "今日は天気がとても良いです。", "明日は友達と山へ行きます！", "「はい。」", "と言った。"]
    rows = [(1, passage + "これは最初の文書です。"), (2, "別の文書はここから始まります。" + passage)]
    assert cleaned(spark, rows) == {1: rows[0][1], 2: "別の文書はここから始まります。"}


def test_span_dedup_equals_all_runs_of_any_length(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(1, 14))).capitalize() + "."
    shared = [sentence() for _ in range(14)]
    rows = [(i, " ".join(sentence() for _ in range(8))) for i in range(12)]
    rows += [(30 + i, f"Lead{i}. {' '.join(shared[rng.randint(0, 3) : rng.randint(9, 14)])} Rest{i} of it.") for i in range(8)] + [(50, rows[3][1]), (51, rows[3][1] + "\n" + rows[3][1])]
    first, runs, want = {}, [], {}
    for d, t in rows:
        s = [t[a:b].strip() for a, b in sentence_spans.sentences(t)]
        runs += [(tuple(s[a : b + 1]), d, a, b) for a in range(len(s)) for b in range(a, len(s)) if sum(len(x.split()) for x in s[a : b + 1]) >= 25]
    for key, d, a, _ in runs:
        first[key] = min(first.get(key, (d, a)), (d, a))
    for key, d, a, b in runs:
        if (d, a) != first[key]:
            want.setdefault(d, set()).update(range(a, b + 1))
    got = sentence_spans.removals(spark.createDataFrame(rows, DOCS)).collect()
    assert len(want) >= 8 and {r.doc_id: {n for a, b in r.spans for n in range(a, b + 1)} for r in got} == want


def test_added_tokens_in_a_text_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"{end}{end}", f"x \n {end}\n  y  {end} ", f"1{end}2", "<|endoftext|", f"<{end}>", "plain text", ""]
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert want[0] == [50256]
    assert {i: (r.doc_tokens, r.ids_crc32) for i, r in got.items()} == {i: (len(ids) + 1, zlib.crc32(bpe.packed([*ids, packing.END_ID]))) for i, ids in want.items()}


def test_unspaced_lines_are_compared_as_brute_force_does(spark):
    rng = random.Random(11)
    line = lambda n: "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(n))
    base = [line(rng.randint(90, 140)) for _ in range(60)]
    early = [x[:3] + line(1) + x[4:] for x in base]
    late = [x[:60] + line(1) + x[61:] for x in base]
    lines = [*base, *early, *late, *(line(100) for _ in range(20))]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    assert all(100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets[:60], sets[60:120], strict=True))
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.removed_lines(spark.createDataFrame(list(enumerate(lines)), DOCS)).collect()}
    want = {60 * k + i: i for i in range(60) for k in (1, 2)}
    assert got.items() <= want.items() and len(got) >= 0.99 * len(want)
