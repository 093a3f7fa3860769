"""Line dedup, set join, decontamination and span dedup against brute force."""

import random
import re

from pyspark.sql import functions as F

from chronospan.llm import common, decontaminate, jaccard_join, line_dedup, sentence_spans

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, extra string, id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", -i) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def components(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 90))) for i in range(60)]
    base = prose(rng, 120)
    rows += [(100 + i, edited(rng, base, rng.randint(0, 6))) for i in range(60)]
    rows += [(200 + i, base.upper()) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"), (305, "One two"), (306, prose(rng, 20000)), (100, rows[60][1])]
    return rows


def jaccard_truth(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[b]]
    return {i: (len(sets[i]), c) for i, c in components(links, ids).items()}


def test_set_join_is_brute_force(spark):
    rows = corpus()
    got = jaccard_join.link_components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_truth(rows, 3, 90, 100)


def test_one_of_each_near_duplicate(spark):
    rows = corpus(6)
    truth = jaccard_truth(rows, 5, 80, 100)
    got = jaccard_join.one_of_each(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "extra", "id"]
    assert sorted({r.doc_id for r in got.collect()}) == sorted({c for _, c in truth.values()})


def test_empty_tables(spark):
    none = docs(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.link_components(none).count() == 0
    assert line_dedup.removed_lines(none).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert sentence_spans.removals(none).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(900, 901), (901, 901)], "a long, b long")
    got = {r.id: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 900: 900, 901: 900}


def test_gapless_rank(spark):
    df = spark.createDataFrame([(i % 3, i // 2) for i in range(100)], "g int, id long")
    got = common.gapless_rank(df, ["g"], ["id"], F.xxhash64("id"), 8, "slot").collect()
    for g in range(3):
        mine = sorted(r.slot for r in got if r.g == g)
        assert mine == list(range(len(mine)))


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(8)
    lines = [prose(rng, rng.randint(1, 30)) for _ in range(40)]
    pool = lines + [edited(rng, x, 1) for x in lines] + [lines[0]] * 5 + ["short"] * 4 + [""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in range(40)] + [(90, None), (91, ""), (92, "\n\n"), (0, None)]
    occ: dict = {}
    for i, t in rows:
        for j, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                occ.setdefault(x, []).append((i, j))
    sets = {x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in occ}
    names = sorted(occ)
    links = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if 100 * len(sets[names[a]] & sets[names[b]]) >= 80 * len(sets[names[a]] | sets[names[b]])]
    groups: dict = {}
    for n, c in components(links, range(len(names))).items():
        groups.setdefault(c, []).extend(occ[names[n]])
    want = {(o, min(g)) for g in groups.values() for o in g if o != min(g)}
    got = {((r.doc_id, r.line_no), (r.kept_doc_id, r.kept_line_no)) for r in line_dedup.removed_lines(docs(spark, rows)).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want) and any(len(x) < 10 for x in occ)
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(docs(spark, rows[:40] + rows[40:43])).collect()}
    assert {90, 91, 92} <= kept.keys() and kept[90] is None
    gone = {o for o, _ in got}
    for i, t in rows[:40]:
        left = [x for j, x in enumerate(t.split("\n")) if (i, j) not in gone]
        assert kept.get(i, "") == "\n".join(left) or i not in kept and not "".join(left).strip()


def test_templates_find_copies_and_reparameterised_questions(spark):
    q = "If Anna buys 12 apples at 3 dollars each and Anna sells 12 pears, how many coins remain with Anna?"
    items = spark.createDataFrame([(1, q, 0), (2, None, 0), (3, "too short", 0), (1, q, 0)], "item_id long, text string, doc_id int")
    rows = [
        (10, "x. " + q.replace("Anna", "Bella").replace("12", "40").replace("3 d", "7 d") + " ok"),
        (11, q.upper()), (11, q), (12, q.replace("12", "40", 1).replace("12", "41")), (13, None), (14, ""), (15, "nothing like it " * 400),
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    assert got == {(10, 1): "reparameterised", (11, 1): "verbatim"}
    assert {r.doc_id for r in decontaminate.without_leaks(docs(spark, rows), items).collect()} == {12, 13, 14, 15}


def test_native_operators_have_no_python_in_their_plans(spark):
    d = docs(spark, corpus())
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    for df in (decontaminate.leaks(d, items), line_dedup.removed_lines(d)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def spans_truth(rows, least):
    """Sentences that any repeated run of at least ``least`` words covers, but for the first."""
    first: dict = {}
    runs = []
    for i, t in rows:
        s = [t[a:b].strip() for a, b in sentence_spans.sentences(t)] if t else []
        for a in range(len(s)):
            for b in range(a, len(s)):
                if sum(len(x.split()) for x in s[a : b + 1]) >= least:
                    runs.append((tuple(s[a : b + 1]), i, a, b))
    for key, i, a, _ in runs:
        first[key] = min(first.get(key, (i, a)), (i, a))
    out: dict = {}
    for key, i, a, b in runs:
        if (i, a) != first[key]:
            out.setdefault(i, set()).update(range(a, b + 1))
    return out


def test_span_dedup_is_brute_force(spark):
    rng = random.Random(4)
    sentence = lambda: prose(rng, rng.randint(1, 14)).capitalize() + rng.choice(".!?")
    shared = " ".join(sentence() for _ in range(9))
    rows = [(i, " ".join(sentence() for _ in range(12))) for i in range(20)]
    rows += [(30 + i, f"{prose(rng, 9)} {shared} {prose(rng, 30)}") for i in range(6)]
    rows += [(50, rows[3][1]), (51, rows[3][1] + "\n" + rows[3][1]), (60, None), (61, ""), (62, "Short. Short. Short."), (3, rows[3][1])]
    got = sentence_spans.removals(docs(spark, rows)).collect()
    found = {r.doc_id: {n for a, b in r.spans for n in range(a, b + 1)} for r in got}
    assert found == spans_truth(rows[:-1], sentence_spans.MIN_WORDS)
    assert all(r.n_removed == len(found[r.doc_id]) for r in got)
    clean = {r.doc_id: r.text for r in sentence_spans.clean_documents(docs(spark, rows[:-1])).collect()}
    assert clean[50] == "" and clean[0] == rows[0][1] and clean[60] is None and shared[40:300] not in clean[32]


def test_aligned_tokens_are_compared_once_for_all_windows(spark, capsys):
    """A filter on the windows worked out the comparison of all tokens again for each window."""
    text = " ".join(f"word{i}" for i in range(40)) + " Anna has 12 apples and 7 pears"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = decontaminate.leaks(docs(spark, [(5, "before it " + text.replace("12", "31") + " after it")]), items)
    assert [(r.doc_id, r.item_id, r.kind) for r in found.collect()] == [(5, 1, "reparameterised")]
    found.explain()
    assert "forall(slice" not in capsys.readouterr().out
