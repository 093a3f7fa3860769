"""Rows of one id, odd tables, recall of fuzzy lines, and the pipeline stage by stage."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from chronospan.llm import bpe, jaccard_join, line_dedup, packing, sentence_spans, warc
from chronospan.llm.common import store

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def components(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def line_truth(rows):
    """{place: keeper} of all occurrences to remove, by comparing all lines."""
    occ: dict = {}
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                occ.setdefault(x, []).append((d, n))
    names = sorted(occ)
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in names]
    order = sorted(range(len(names)), key=lambda i: len(sets[i]))
    links = []
    for p, i in enumerate(order):
        for j in order[p + 1 :]:
            if 80 * len(sets[j]) > 100 * len(sets[i]):
                break
            c = len(sets[i] & sets[j])
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                links.append((i, j))
    groups: dict = {}
    for i, c in components(links, range(len(names))).items():
        groups.setdefault(c, []).extend(occ[names[i]])
    return {o: min(g) for g in groups.values() for o in g if o != min(g)}


def test_fuzzy_lines_of_all_lengths_and_scripts_are_found(spark):
    rng = random.Random(17)
    letters = ["abcdefghij klmnop", "".join(map(chr, range(0x4E00, 0x4F00))), "абвгдежз ийкл", "0123456789abcdef/-_"]
    lines = []
    for alphabet in letters:
        for n in (3, 12, 30, 60, 75, 90, 250, 300, 700):
            for _ in range(6):
                x = "".join(rng.choice(alphabet) for _ in range(n)).strip() or "x"
                at = rng.randrange(len(x))
                lines += [x, x[:at] + rng.choice(alphabet) + x[at + 1 :], x]
    hub = "".join(rng.choice(letters[0]) for _ in range(200))
    for _ in range(150):
        x = list(hub)
        for _ in range(rng.randint(1, 9)):
            x[rng.randrange(len(x))] = rng.choice(letters[0])
        lines.append("".join(x))
    rows = list(enumerate(lines))
    want = line_truth(rows)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.removed_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(want) > 350 and got.keys() <= want.keys() and len(got) >= 0.98 * len(want)


def test_lines_of_odd_rows(spark):
    schema = "doc_id long, text string, _of int, _lost string, line_no int, hash long"
    a, b = "a line that is long enough to matter here", "another line, quite unlike the first one"
    rows = [(5, f"{a}\n\n \nok"), (5, f"{b}\nok"), (5, f"{a}\n\n \nok"), (None, f"{b}\nunique words of a null"), (9, f"{a}!\nlast"), (10, None), (11, " \n\n")]
    d = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    kept = sorted((repr(r.doc_id), r.text or "-") for r in line_dedup.without_lines(d).collect())
    assert kept == sorted([("5", f"{a}\n\n "), ("5", f"{a}\n\n "), ("5", "ok"), ("None", f"{b}\nunique words of a null"), ("9", "last"), ("10", "-"), ("11", " \n\n")]), kept
    assert line_dedup.without_lines(d.limit(0)).count() == 0 and line_dedup.without_lines(d).columns == d.columns


def test_rows_of_one_page(spark):
    big, other = "<p>a</p>" * 200, "<p>b</p>" * 200
    rows = [(1, "u", big, "d"), (1, "u", other, "d"), (2, "a\x01 b", big, "d"), (None, "u", big, "d"), (3, None, "small", "d"), (2, "u", big, "d")]
    got = sorted((repr(r.page_id), r.record_type, r.refers_to, r.payload_digest) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string")).collect())
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert got == sorted([("1", "revisit", 2, sha(big)), ("1", "response", None, sha(other)), ("2", "response", None, sha(big)), ("None", "response", None, sha(big)), ("3", "response", None, sha("small")), ("2", "response", None, sha(big))])
    url = spark.createDataFrame([("a\x01 b\x7f", 1), (None, 2), ("http://é", 3)], "u string, i int").select("i", warc.safe_url(F.col("u")).alias("u"))
    assert {r.i: r.u for r in url.collect()} == {1: "a%01%20b%7F", 2: "about:blank", 3: "http://é"}


def test_texts_of_one_document(spark):
    one, two = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, one), (5, one), (5, two), (7, two), (8, f"{two} end")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows, DOCS)).collect())
    assert {c for d, c in got if d == 5} == {1} and len(got) == 5
    assert got == sorted((r.doc_id, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows[::-1], DOCS)).collect())


def test_spans_of_odd_rows(spark):
    passage = " ".join(f"The {i} ship sails to port {i} with nine men." for i in "abcdefgh")
    rows = [(5, f"{passage} One more."), (5, f"Lead. {passage}"), (5, f"{passage} One more."), (None, f"{passage} Of a null."), (6, None), (7, ""), (8, "x " * 200_000)]
    d = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, first int, mark string")
    got = sorted((repr(r.doc_id), len(r.text) if r.text is not None else -1) for r in sentence_spans.clean_documents(d).collect())
    assert len(got) == 7 and ("None", len(rows[3][1])) in got and ("6", -1) in got and ("5", len("Lead.")) in got and got.count(("5", len("One more."))) == 2
    assert sentence_spans.clean_documents(d.limit(0)).columns == d.columns


def near_truth(rows, k=5):
    sets = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        w = (t or "").translate(low).replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    by = sorted(ids, key=lambda d: len(sets[d]))
    links = []
    for p, a in enumerate(by):
        for b in by[p + 1 :]:
            if 80 * len(sets[b]) > 100 * len(sets[a]) or not sets[a]:
                break
            c = len(sets[a] & sets[b])
            if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                links.append((a, b))
    return components(links, ids)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    at, rows = [docs], [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at.append(store(stage(spark, at[-1], SF), f"test_{name}"))
        rows.append({r.doc_id: r.text for r in at[-1].collect()})
        assert at[-1].columns == docs.columns and rows[-1].keys() <= rows[-2].keys()
    read, told, lines, near, clean = rows
    assert all(told[d] == read[d] for d in told) and len(told) >= 0.9 * len(read)
    lost = line_truth(sorted(told.items()))
    left = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in lost) for d, t in told.items()}
    want = {d: t for d, t in left.items() if t.strip() or not told[d].strip()}
    assert sum(lines.get(d) == t for d, t in want.items()) >= 0.97 * len(want) and len(lines) <= 1.03 * len(want)
    truth = near_truth(sorted(lines.items()))
    assert set(near) == set(truth.values())
    assert clean.keys() <= near.keys() and all(near[d] == clean[d] for d in clean)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in t.lower()).split())} "
    copies = {d for d, t in near.items() if any(words(x) in words(t) for x in items)}
    assert copies and not copies & clean.keys()
    ids = bpe.load(bpe.default_vocabulary()).ids
    pieces: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == clean.keys()
    for d, own in pieces.items():
        whole, start = ids(clean[d]) + bpe.packed([packing.END_ID]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == start and r.ids_crc32 == zlib.crc32(whole[4 * start : 4 * (start + r.length)])
            start += r.length
        assert 4 * start == len(whole)
