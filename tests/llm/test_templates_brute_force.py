"""Decontamination against a comparison of every item with every place of every document."""

import random

from chronospan.llm import decontaminate as D


def signed(text):
    """(sign, word) of tokens: n for a number, f for a name after a lower-case word, c for another capitalised word."""
    out, before = [], ""
    for w in text.split(" "):
        if w.isdigit():
            out.append(("n", w))
        elif w[0].isupper():
            out.append(("f" if before and before[-1].islower() else "c", w.lower()))
        else:
            out.append(("", w))
        before = w
    return out


def judged(item, doc, shift, loose):
    slots = "nfc" if loose else "nf"
    kind = lambda s: "n" if s == "n" else "f" if s and s in slots else ""
    k = min(len(item), D.WINDOW)

    def ok(i):
        if not 0 <= i + shift < len(doc):
            return False
        (a, x), (b, y) = item[i], doc[i + shift]
        return x == y or len(item) >= D.WINDOW and kind(a) != "" and kind(a) == kind(b)

    fine = [ok(i) for i in range(len(item))]
    starts = [i for i in range(len(item) - k + 1) if all(fine[i : i + k])]
    windows = len(item) - k + 1
    if not starts or not (len(starts) >= D.ENOUGH or len(starts) >= D.SHARE * windows):
        return None
    pairs = set()
    for i in range(starts[0], starts[-1] + k):
        if 0 <= i + shift < len(doc) and kind(item[i][0]) and kind(item[i][0]) == kind(doc[i + shift][0]):
            pairs.add((item[i][1], doc[i + shift][1]))
    if len({a for a, _ in pairs}) < len(pairs):
        return None
    return len(starts), all(a == b for a, b in pairs)


def truth(docs, items):
    out = {}
    for d, text in docs:
        for n, item in items:
            t, u = signed(item), signed(text)
            found = [x for shift in range(1 - len(t), len(u)) for loose in (False, True) if (x := judged(t, u, shift, loose))]
            if found:
                out[d, n] = "verbatim" if max(found)[1] else "reparameterised"
    return out


def test_findings_equal_brute_force(spark):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "ku", "ma", "ne", "po") for b in ("l", "rt", "sk", "m")]
    names = ["Anna", "Bert", "Carl", "Dora", "Emil", "Fred"]

    def item(n):
        out = [rng.choice(words) for _ in range(n)]
        for _ in range(max(1, n // 8)):
            out[rng.randrange(1, n)] = str(rng.randint(2, 99))
            out[rng.randrange(n)] = rng.choice(names)
        return " ".join(out)

    items = [(i, item(rng.choice([3, 7, 8, 9, 14, 22]))) for i in range(24)]
    docs = []
    for d in range(90):
        text = rng.choice(items)[1].split(" ")
        way = d % 6
        values = {w: (str(rng.randint(100, 999)) if w.isdigit() else rng.choice(names)) for w in text if w.isdigit() or w[0].isupper()}
        if way == 1:
            text = [values.get(w, w) for w in text]
        elif way == 2:
            text = [str(rng.randint(100, 999)) if w.isdigit() else rng.choice(names) if w[0].isupper() else w for w in text]
        elif way == 3:
            text = [w.upper() if not w.isdigit() else w for w in text]
        elif way == 4:
            text = text[len(text) // 3 :]
        elif way == 5:
            text[rng.randrange(len(text))] = "other"
        lead, tail = ([rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(2))
        docs.append((d, " ".join([*lead, *text, *tail])))
    want = truth(docs, items)
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 40 and {"verbatim", "reparameterised"} == set(want.values())
    assert {(r.doc_id, r.item_id): r.kind for r in got} == want


ITEM = "The farmer sold 40 baskets of ripe apples to Anna before the market closed at noon on Friday"


def found(spark, docs, items=((1, ITEM),)):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in D.leaks(rows, known).collect()}, sorted(map(tuple, D.without_leaks(rows, known).collect()), key=str)


def test_copies_across_white_space_of_any_kind(spark):
    blanks = [" ", " ", "　", " ", " ​", "\n", " ", "\u0085"]
    got, kept = found(spark, [(i, "so it goes " + ITEM.replace(" ", b) + " and on") for i, b in enumerate(blanks)] + [(99, "nothing of it here")])
    assert got == {(i, 1): "verbatim" for i in range(len(blanks))} and [r[0] for r in kept] == [99]


def test_copies_in_scripts_without_blanks(spark):
    item = "农夫在星期五中午市场关门之前卖出了许多篮成熟的苹果"
    other = "今天天气很好我们一起去公园散步然后回家吃晚饭看电视"
    got, kept = found(spark, [(1, f"前言很长{item}后记也长"), (2, other), (3, f"abc {item}"), (4, "ขาย" + item)], [(7, item)])
    assert got == {(1, 7): "verbatim", (3, 7): "verbatim", (4, 7): "verbatim"} and [r[0] for r in kept] == [2]


def test_null_and_repeated_ids(spark):
    clean = "a quiet text of its own without any passage that a benchmark would hold"
    got, kept = found(spark, [(None, ITEM), (None, clean), (5, ITEM), (5, clean), (6, None), (None, None), (5, clean)])
    assert got == {(None, 1): "verbatim", (5, 1): "verbatim"}
    assert kept == sorted([(None, clean), (5, clean), (6, None), (None, None), (5, clean)], key=str)


def test_a_very_long_text(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(100_000))
    got, _ = found(spark, [(1, f"{long} {ITEM.replace('40', '55').replace('Anna', 'Dora')} {long}"), (2, long)])
    assert got == {(1, 1): "reparameterised"}


def test_recall_of_planted_questions_with_other_values(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    names = ["Anna", "Bert", "Carl", "Dora", "Emil", "Fred", "Gina", "Hugo"]

    def question(n):
        out = [rng.choice(words) for _ in range(n)]
        for at in rng.sample(range(n), n // 7):
            out[at] = rng.choice([str(rng.randint(2, 99)), f"{rng.randint(2, 99)} km", rng.choice(names)])
        return out

    def other(word):
        if word.split(" ")[0].isdigit():
            return " ".join([str(rng.randint(100, 999)), *word.split(" ")[1:]])
        return word

    items = [(i, question(rng.randint(16, 40))) for i in range(60)]
    docs = []
    for i, (_, q) in enumerate(items * 3):
        renamed = dict(zip(names, rng.sample(names, len(names))))
        values = {w: other(renamed.get(w, w)) for w in q}
        lead, tail = (" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(2))
        docs.append((i, f"{lead} {' '.join(values[w] for w in q)} {tail}"))
    docs += [(1000 + i, " ".join(rng.choice(words) for _ in range(150))) for i in range(100)]
    got, _ = found(spark, docs, [(i, " ".join(q)) for i, q in items])
    hits = sum((i, i % 60) in got for i in range(180))
    assert hits >= 0.95 * 180 and not any(d >= 1000 for d, _ in got)
