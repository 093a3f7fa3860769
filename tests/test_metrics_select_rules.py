from pyspark.sql import functions as F

from chronospan.functions import rules as R
from chronospan.functions import scalars as C
from chronospan.operators import metrics as M
from chronospan.operators import select as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ap_with_ties(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, 1.0), ("a", True, 1.0), ("b", False, 3.0), ("b", True, 2.0), ("b", True, 1.0), ("c", True, 1.0)], "k string, y boolean, s double")
    got = {r.k: (r.ap, r.auroc) for r in M.ap_auroc(df, ["k"], "y", "s").collect()}
    assert abs(got["a"][0] - 2 / 3) < 1e-12 and got["a"][1] == 0.5
    assert abs(got["b"][0] - 7 / 12) < 1e-12
    assert got["c"] == (None, None)


def test_f2_ties_go_to_the_higher_threshold(spark):
    df = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.2)], "k string, y boolean, s double")
    assert rows(M.f2_threshold(df, ["k"], "y", "s"), "threshold", "f2") == [(0.9, 1.0)]
    none = spark.createDataFrame([("a", False, 0.9)], "k string, y boolean, s double")
    assert rows(M.f2_threshold(none, ["k"], "y", "s"), "threshold", "f2") == [(1.0, 0.0)]


def test_alpha_is_one_when_all_agree_and_has_states(spark):
    df = spark.createDataFrame([("g", u, v) for u, v in ((1, 0), (1, 0), (2, 3), (2, 3))] + [("h", 1, 2), ("h", 1, 2)] + [("i", 1, 2)], "g string, u int, v int")
    got = {r.g: (r.alpha, r.status) for r in M.ordinal_alpha(df, ["u"], "v", ["g"]).collect()}
    assert got == {"g": (1.0, "ok"), "h": (None, "no_variation")}


def test_consensus_needs_three(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (2, 3), (2, None)], "u int, v int")
    assert rows(M.consensus(df, ["u"], "v"), "u", "consensus", "disputed") == [(1, 2.0, True), (2, None, True)]


def test_bootstrap_needs_ten_clusters(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("b", 1, 2.0)], "g string, c int, v double")
    got = {r.g: r for r in M.bootstrap_mean(df, ["g"], "c", "v", 200).collect()}
    assert got["a"].low < got["a"].mean == 5.5 < got["a"].high and got["b"].low is None


def test_greedy_choice_skips_overlaps_and_stops(spark):
    df = spark.createDataFrame([(1, 0, 10, 9.0, 1), (1, 5, 15, 8.0, 2), (1, 10, 20, 7.0, 3), (1, 30, 40, 1.0, 4)], "k int, a long, b long, s double, id int")
    assert rows(S.greedy_non_overlapping(df, ["k"], "a", "b", "s", "id", 2), "id", "pick") == [(1, 1), (3, 2)]


def test_diversity_costs_change_the_choice(spark):
    df = spark.createDataFrame([(0, "u", "x", 0, 1, 10.0, 1), (0, "u", "y", 5, 6, 9.0, 2), (0, "w", "z", 0, 1, 8.0, 3)], "g int, src string, kind string, a long, b long, s double, id int")
    assert rows(S.diverse_top_k(df, ["g"], "src", "kind", "a", "b", "s", "id", 2, 90.0), "id", "pick") == [(1, 1), (3, 2)]


def test_merge_keeps_the_better_and_all_ids(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 5.0, 1.0, 1), (1, 1.0, 11.0, 6.0, 2.0, 2), (1, 50.0, 60.0, 55.0, 1.0, 3)], "k int, a double, b double, p double, s double, id int")
    assert rows(S.merge_duplicates(df, ["k"], "a", "b", "p", ["s"], "id", 2.0, 0.6), "id", "ids") == [(2, [1, 2]), (3, [3])]


def test_even_sample_and_shuffle_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "k int, id int")
    assert [r[1] for r in rows(S.evenly_spaced(df, ["k"], ["id"], 4), "k", "id")] == [0, 3, 6, 9]
    a, b = S.shuffled(df, ["k"], "id", 1), S.shuffled(df.orderBy(F.desc("id")), ["k"], "id", 1)
    assert rows(a, "id", "place") == rows(b, "id", "place")


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, 50.0)], "id int, x double")
    v = R.violations(df, ["id"], {"range": ~R.finite_between(F.col("x"), 0, 10), "large": F.col("x") > 40})
    assert rows(v, "id", "rule") == [(2, "range"), (3, "large"), (3, "range"), (4, "large"), (4, "range")]
    ok, bad = R.split_by(df, {"unknown": F.col("x").isNull()})
    assert ok.count() == 3 and rows(bad, "id", "reason") == [(2, "unknown")]


def test_names_lines_and_indices(spark):
    df = spark.createDataFrame([("2026.2.3.4",), ("2026.2.30.1",), ("2026.1.1.0",), ("x",)], "n string")
    got = [r.p for r in df.select(C.source_name(F.col("n")).alias("p")).collect()]
    assert (str(got[0].date), got[0].part) == ("2026-02-03", 4) and got[1:] == [None, None, None]
    one = spark.range(1)
    assert one.select(C.wrapped_lines(F.lit("aa bb  cccccccc d"), 5)).first()[0] == ["aa bb", "cccccccc", "d"]
    assert one.select(C.even_indices(F.lit(10), 4)).first()[0] == [0, 3, 6, 9]
    assert one.select(C.padded_indices(F.lit(2), 4)).first()[0] == [0, 1, 1, 1]
    assert one.select(C.redacted(F.lit("password: abc Bearer x.y"))).first()[0] == "password: [redacted] Bearer [redacted]"
    for text, want in {
        "token=https://x.org/?a=1,b ok": "token=[redacted],b ok", '{"api_key": "k1", "n": 2}': '{"api_key": "[redacted]", "n": 2}', "API-KEY = q r": "API-KEY = [redacted] r",
        "Authorization: bearer abc": "Authorization: bearer [redacted]", "Authorization:Bearer abc": "Authorization:Bearer [redacted]", "the password is safe": "the password is safe",
        "see sk-abcdefgh1, not sk-short": "see [redacted], not sk-short", "": "", "secret:": "secret:", "mytoken=1 secret=2}": "mytoken=1 secret=[redacted]}",
    }.items():
        assert one.select(C.redacted(F.lit(text))).first()[0] == want, text
    assert one.select(C.redacted(F.lit(None).cast("string"))).first()[0] is None


def test_a_table_without_rows_passes_every_guard(spark):
    empty = spark.createDataFrame([], "k int, t long")
    R.require_empty(R.duplicates(empty, ["k"]), "duplicates")
    assert R.coverage(empty, ["k"], "t", F.lit(0), F.lit(9), 1, 1).count() == 0


def test_units_titles_and_counters(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("c")).first().c
    family = "\U0001F468\u200d\U0001F469"
    assert first(C.text_units(F.lit(f"ae\u0301{family}\U0001F44D\U0001F3FDx"))) == ["a", "e\u0301", family, "\U0001F44D\U0001F3FD", "x"]
    assert first(C.normalized_text(F.lit("e\u0301\ta\r\nb\rc\u00a0d"))) == "\u00e9 a\nb\nc d" and first(C.normalized_text(F.lit(None).cast("string"))) is None
    assert [first(C.title_lines(F.lit(x))) for x in ("ab，cd", "ab！cd", "ab！", "abcdefghijk", "short")] == [["ab", "cd"], ["ab！", "cd"], ["ab！"], ["abcde", "fghijk"], ["short"]]
    counts = F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(-1), F.lit("c"), F.lit(None).cast("int"), F.lit("d"), F.lit(4))
    assert first(C.safe_counters(counts, ["a", "b", "c"])) == {"a": 3}
