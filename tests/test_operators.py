"""Hand-computed cases and invariants of the core operators."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from credence.functions import arrow, scalars, spans
from credence.operators import domains, features, labels, metrics, outcomes, reports, selection, splits
from credence.sources import readers


def one(df):
    return df.first().asDict()


def scored(spark, rows):
    return spark.createDataFrame(rows, "y boolean, p double")


@pytest.mark.parametrize(
    "rows, auc",
    [
        ([(True, 0.9), (False, 0.1)], 1.0),
        ([(True, 0.1), (False, 0.9)], 0.0),
        ([(True, 0.5), (False, 0.5), (True, 0.5)], 0.5),
        ([(True, 0.5), (True, 0.7)], None),
        ([], None),
        ([(True, 0.8), (False, 0.8), (True, 0.3), (False, 0.1)], 0.625),
    ],
)
def test_auc(spark, rows, auc):
    assert one(metrics.roc_auc(scored(spark, rows), F.col("y"), F.col("p")))["auc"] == auc


def test_auc_is_that_of_spark_ml(spark):
    draw = random.Random(1)
    rows = scored(spark, [(draw.random() < 0.4, round(draw.random(), 2)) for _ in range(500)])
    want = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="l").evaluate(rows.withColumn("l", F.col("y").cast("double")))
    assert one(metrics.roc_auc(rows, F.col("y"), F.col("p")))["auc"] == pytest.approx(want, abs=1e-9)


def test_skill_and_f1_edges(spark):
    assert one(metrics.brier_skill(scored(spark, [(True, 1.0), (False, 0.0)]), F.col("y"), F.col("p")))["bss"] == 1.0
    assert one(metrics.brier_skill(scored(spark, [(True, 1.0)]), F.col("y"), F.col("p")))["bss"] is None
    assert one(metrics.accuracy_f1(scored(spark, [(False, 0.1)]), F.col("y"), F.col("p")))["f1"] == 0.0
    sweep = metrics.f1_sweep(scored(spark, [(True, 0.35), (False, 0.2)]), F.col("y"), F.col("p")).where("is_best").collect()
    assert [r["tenth"] for r in sweep] == [3]


def test_hit_at_k(spark):
    rows = [(1, 10, 0.9, False), (1, 11, 0.9, True), (2, 1, 0.5, True), (3, 1, 0.7, False)]
    got = {r["k"]: r for r in metrics.hit_at_k(spark.createDataFrame(rows, "sample int, line int, score double, is_error boolean"), (1, 2, 9)).collect()}
    assert (got[1]["candidates"], got[1]["eligible"], got[1]["hits"]) == (3, 2, 1)
    assert got[2]["hits"] == got[9]["hits"] == 2
    sweep = metrics.hit_at_1_by_threshold(spark.createDataFrame(rows, "sample int, line int, score double, e boolean").withColumn("y", F.col("e").cast("double"))).collect()
    assert len({(r["eligible"], r["hits"]) for r in sweep}) == 1  # labels of 0 and 1: no threshold changes them
    assert [r["tenth"] for r in sweep if r["is_best"]] == [1]


def test_random_baseline_is_near_its_expectation(spark):
    rows = [(s, i, i % 4 == 0) for s in range(60) for i in range(1 + s % 9)]
    lines = spark.createDataFrame(rows, "sample int, line int, is_error boolean")
    want = {r["k"]: r["expected"] for r in metrics.expected_random_hit(lines).collect()}
    for r in metrics.random_hit_baseline(lines, 200, "x").collect():
        assert r["mean_rate"] == pytest.approx(want[r["k"]], abs=0.03)


def test_line_labels(spark):
    rows = [(1, 0, 1, True, False), (1, 1, 1, False, True), (1, 2, 2, False, False), (1, 3, 3, None, False), (1, 4, 4, True, True)]
    t = spark.createDataFrame(rows, "sample int, ordinal int, line int, tok_is_correct boolean, ws_comment boolean")
    clean = {r["line"]: r["line_is_clean"] for r in labels.line_error_map(t, ["sample"]).collect()}
    assert clean == {1: True, 2: False, 3: True, 4: True}
    derived = {r["line"]: r["line_is_error"] for r in labels.derived_line_label(t, ["sample"]).collect()}
    assert derived == {1: False, 2: True, 3: None, 4: None}
    mapped = spark.createDataFrame([(1, 1, False)], "sample int, line int, line_is_clean boolean")
    assert {r["line"]: r["line_is_error"] for r in labels.line_truth(t, mapped, ["sample"]).collect()} == {1: True, 2: True, 3: None, 4: None}
    assert {r["line"] for r in labels.sequence_items(t, ["sample"]).collect()} == {1, 2, 3}
    assert one(labels.has_clean_line(t, ["sample"]))["any_clean_line"] is True


TOPK = [
    (41, lambda i: {5: 9.0, 17: 8.0, 23: 7.0, 10: 6.0}.get(i, i / 10), {}, [5, 17]),
    (6, lambda i: [0.1, 0.5, 0.2, 0.9, 0.7, 0.6][i], {"k": 3, "least": 5.0}, [3, 4, 5]),
    (22, float, {"quantile": 0.2}, [18, 19, 20, 21]),
    (18, float, {"least": 5.5, "most": 7.1}, [7]),
    (5, lambda i: [0.1, 0.9, 0.2, 0.8, 0.05][i], {"k": 2}, [1, 3]),
    (3, lambda i: 1.0, {"k": 2}, [0, 1]),
]


@pytest.mark.parametrize("n, score, options, want", TOPK)
def test_top_scored(spark, n, score, options, want):
    rows = spark.createDataFrame([(1, i, score(i)) for i in range(n)], "c int, pos int, score double")
    assert sorted(r["pos"] for r in selection.top_scored(rows, ["c"], **options).collect()) == want


def test_append_last_and_fallback(spark):
    t = spark.createDataFrame([(1, i, [0.1, 0.8, 0.2, 0.3, 0.9][i]) for i in range(5)] + [(2, 0, None)], "c int, pos int, score double")
    top = selection.top_scored(t, ["c"], k=2)
    assert sorted((r["c"], r["pos"]) for r in selection.with_last(top, t, ["c"]).collect()) == [(1, 1), (1, 4), (1, 4), (2, 0)]
    assert sorted((r["c"], r["pos"]) for r in selection.or_first_last(top, t, ["c"]).collect()) == [(1, 1), (1, 4), (2, 0)]


def test_match_precedence(spark):
    f = [("s", "e1", "train", 0, 0, "h0"), ("s", "e1", "train", 0, 1, "h1"), ("s", "e2", "test", 1, 5, "h9"), ("s", "e2", "test", 1, 1, None)]
    feats = spark.createDataFrame(f, "sample_id string, entry string, split string, split_priority int, cand_idx int, token_hash string")
    rows = [("s", 0, "h0", "train"), ("s", 0 + 1, "h0", "train"), ("s", 1, "h9", "test"), ("s", 7, "zz", "train"), ("s", 5, None, "train")]
    for sample, idx, h, want in [(*rows[0][:3], ("e1", 0, "index")), (*rows[1][:3], ("e1", 0, "fingerprint")), (*rows[3][:3], None), (*rows[4][:3], ("e2", 5, "index"))]:
        lab = spark.createDataFrame([(sample, idx, h, "train")], "sample_id string, cand_idx int, token_hash string, expected_split string")
        got = features.matched(lab, feats).collect()
        assert [(r["entry"], r["feature_idx"], r["method"]) for r in got] == ([want] if want else [])
        assert features.unmatched(lab, features.matched(lab, feats)).count() == (want is None)
    lab = spark.createDataFrame([("s", 1, "h9", "test")], "sample_id string, cand_idx int, token_hash string, expected_split string")
    assert one(features.matched(lab, feats))["feature_idx"] == 1  # the entry's own hash is missing: by index, before the fingerprint


def test_fingerprint_is_that_of_compact_json(spark):
    import hashlib
    import json

    ids = [1, 22, 333]
    got = spark.createDataFrame([(ids,)], "a array<bigint>").select(features.fingerprint(F.col("a")).alias("h")).first()["h"]
    assert got == hashlib.sha1(json.dumps(ids, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("keys, ask, want", [([0, 2], -3, None), ([0, 1, 2], -3, 0), ([1, 2, 3, 4], -3, 2), ([5], -1, None), ([0, 1], -1, 1), ([0, 1, 2, 3, 4], -1, None), ([0, 7], 7, 7)])
def test_negative_positions(spark, keys, ask, want):
    rows = spark.createDataFrame([(1, 0, k) for k in keys], "c int, layer int, pos int")
    got = [r["pos"] for r in features.resolved_positions(rows, ["c"], [ask]).collect()]
    assert got == ([] if want is None else [want])


def test_vectors(spark):
    rows = spark.createDataFrame([(1, 1, 0, [3.0, 4.0]), (1, 0, 0, [1.0, 2.0])], "c int, layer int, pos int, vec array<double>")
    assert one(features.concatenated(rows, ["c"]))["vec"] == [1.0, 2.0, 3.0, 4.0]
    assert one(features.averaged(rows, ["c"]))["vec"] == [2.0, 3.0]
    assert one(features.sequences(rows, ["c"], [1, 0]))["sequence"] == [[[3.0, 4.0], [1.0, 2.0]]]
    assert one(rows.where("layer = 1").select(features.normalised(F.col("vec")).alias("v")))["v"] == [0.6, 0.8]
    assert one(spark.createDataFrame([([0.0],)], "v array<double>").select(features.normalised(F.col("v")).alias("v")))["v"] == [0.0]


@given(st.integers(0, 500), st.sampled_from([(0.6, 0.2, 0.2), (0.8, 0.2), (1 / 3, 1 / 3, 1 / 3), (1.0, 0.0)]))
def test_allocation(n, ratios):
    got = splits.allocated(n, ratios)
    assert sum(got) == n and all(abs(g - n * r) < 1 + 1e-9 for g, r in zip(got, ratios, strict=True))


def test_allocation_cases():
    assert [splits.allocated(n, (0.6, 0.2, 0.2)) for n in (0, 1, 2, 7)] == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [4, 2, 1]]
    with pytest.raises(ValueError):
        splits.check_ratios((0.5, 0.4))


def test_splits_are_exact_and_disjoint(spark):
    rows = spark.range(103).withColumn("s", F.col("id") % 4 == 0)
    got = splits.split(rows, "id", (0.6, 0.2, 0.2), "a", strata="s")
    assert got.select("id").distinct().count() == 103
    sizes = {(r["s"], r["split"]): r["count"] for r in got.groupBy("s", "split").count().collect()}
    assert [sizes[True, x] for x in splits.SPLITS] == splits.allocated(26, (0.6, 0.2, 0.2))
    stats = spark.range(200).select("id", (F.col("id") % 7 + 1).alias("n"), (F.col("id") % 3).alias("n_correct"))
    assert splits.greedy(stats, "id", (0.6, 0.2, 0.2)).count() == 200


def greedy_one_by_one(groups, ratios, rate):
    """The rule itself: groups (n, n_correct) in order, each to the split with the least weighted sum of absolute errors over all splits."""
    from fractions import Fraction

    total, right = sum(g[0] for g in groups), sum(g[1] for g in groups)
    target = [splits.allocated(x, ratios) for x in (total, right, len(groups))]
    now = [[0] * len(ratios) for _ in range(3)]
    out = []
    for n, c in groups:
        costs = []
        for s in range(len(ratios)):
            after = [[x + (a if i == s else 0) for i, x in enumerate(now[k])] for k, a in enumerate((n, c, 1))]
            costs.append(sum(w * sum(abs(x - t) for x, t in zip(after[k], target[k], strict=True)) for k, w in enumerate((Fraction(1), Fraction(2), Fraction(1, 5)))))
        s = costs.index(min(costs))
        out.append(s)
        for k, a in enumerate((n, c, 1)):
            now[k][s] += a
    return out


@pytest.mark.parametrize("seed", range(12))
def test_greedy_split_is_the_rule_group_by_group(seed):
    from collections import Counter
    from fractions import Fraction

    draw = random.Random(seed)
    ratios = draw.choice([(0.6, 0.2, 0.2), (0.8, 0.1, 0.1), (0.5, 0.25, 0.25)])
    kinds = Counter()
    for _ in range(draw.randrange(1, 30)):
        n = draw.randrange(0, 9)
        kinds[n, draw.randrange(0, n + 1)] += draw.choice([1, 2, 7, 150, 700])
    total, right = sum(n * k for (n, _), k in kinds.items()), sum(c * k for (_, c), k in kinds.items())
    rate = Fraction(right, total) if total else Fraction(0)
    order = sorted(kinds, key=lambda x: (-x[0], -abs(Fraction(x[1], x[0]) - rate) if x[0] else 0, x[1]))
    want = greedy_one_by_one([k for k in order for _ in range(kinds[k])], ratios, rate)
    runs = splits.dealt([(*k, m) for k, m in kinds.items()], ratios)
    assert [s for k in order for s, many in runs[k] for _ in range(many)] == want


def test_greedy_split_of_a_table(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7 + 1).cast("bigint").alias("n"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 2).cast("bigint").alias("n_correct"))
    got = splits.greedy(rows, "id", (0.6, 0.2, 0.2)).collect()
    assert len({r["id"] for r in got}) == len(got) == 2000
    per = {}
    for r in got:
        per.setdefault((r["n"], r["n_correct"]), []).append(r["split"])
    runs = splits.dealt([(*k, len(v)) for k, v in per.items()], (0.6, 0.2, 0.2))
    for k, v in per.items():
        want = [0, 0, 0]
        for s, many in runs[k]:
            want[s] += many
        assert [v.count(x) for x in splits.SPLITS] == want
    assert splits.greedy(rows.limit(0), "id", (0.6, 0.2, 0.2)).count() == 0


def test_split_of_many_strata(spark):
    rows = spark.range(500).withColumn("s", F.when(F.col("id") % 10 > 0, (F.col("id") % 10).cast("string")))
    got = splits.split(rows, "id", (0.6, 0.2, 0.2), "a", strata="s")
    sizes = {(r["s"], r["split"]): r["count"] for r in got.groupBy("s", "split").count().collect()}
    assert all([sizes[s, x] for x in splits.SPLITS] == [30, 10, 10] for s in (None, *map(str, range(1, 10))))
    assert splits.split(rows.limit(0), "id", (0.6, 0.2, 0.2), "a").count() == 0


def test_auc_and_percentiles_of_any_scale(spark):
    draw = random.Random(7)
    for scale in (1e-6, 1.0, -4e5):
        data = [(draw.random() < 0.3, draw.choice([draw.random() * scale, 0.5 * scale])) for _ in range(700)]
        want = sum((p > n) + (p == n) / 2 for y, p in data if y for z, n in data if not z) / (sum(y for y, _ in data) * sum(not y for y, _ in data))
        for cells in (4, 256):
            assert one(metrics.roc_auc(scored(spark, data), F.col("y"), F.col("p"), cells))["auc"] == pytest.approx(want, abs=1e-8)
        values = sorted(p for _, p in data)
        rows = spark.createDataFrame([(i % 2 == 0, None if i % 50 == 49 else v) for i, v in enumerate(values)] + [(None, 1.0)], "g boolean, v double")
        for r in reports.percentiles(rows, "v", (0.0, 33.0, 90.0), ["g"], between=(50.0,)).collect():
            own = sorted(v for i, v in enumerate(values) if (i % 2 == 0) == r["g"] and i % 50 != 49) if r["g"] is not None else [1.0]
            pick = lambda p: own[int(np.rint(p / 100 * (len(own) - 1)))]  # noqa: B023, E731
            assert (r["n"], r["p0"], r["p33"], r["p90"]) == (len(own), pick(0), pick(33), pick(90)) and r["m50"] == pytest.approx(np.median(own))


def test_random_baseline_is_the_drawn_order(spark):
    import hashlib
    import statistics

    rows = [(s, i, i % 3 == s % 3) for s in range(40) for i in range(1 + s % 7)] + [(99, 1, False)]
    lines = spark.createDataFrame(rows, "sample int, line int, is_error boolean")
    rates = {1: [], 2: [], 3: []}
    for trial in range(15):
        firsts = []
        for s in {r[0] for r in rows}:
            own = sorted((hashlib.md5(f"x|{trial}|{s}|{i}".encode()).hexdigest(), e) for t, i, e in rows if t == s)
            if any(e for _, e in own):
                firsts.append(1 + [e for _, e in own].index(True))
        for k in rates:
            rates[k].append(sum(f <= k for f in firsts) / len(firsts))
    for r in metrics.random_hit_baseline(lines, 15, "x").collect():
        assert r["mean_rate"] == pytest.approx(statistics.mean(rates[r["k"]])) and r["std_rate"] == pytest.approx(statistics.pstdev(rates[r["k"]]), abs=1e-8)
    many = {r["k"]: r["mean_rate"] for r in metrics.random_hit_baseline(lines, 400, "y").collect()}
    for r in metrics.expected_random_hit(lines).collect():  # drawn orders are as good as random ones
        assert many[r["k"]] == pytest.approx(r["expected"], abs=0.02)


def test_row_windows(spark):
    rows = spark.range(20).withColumn("k", 19 - F.col("id"))
    ids = lambda *a, **b: [r["k"] for r in selection.row_window(rows, ["k"], *a, **b).collect()]
    assert ids(3, 4) == [3, 4, 5, 6] and ids(0, 2) == [0, 1] and ids(17) == [17, 18, 19]
    assert ids(3, 5, absolute=True) == [3, 4] and ids(5, 3, absolute=True) == [] and ids(30, 2) == []


def test_domains(spark):
    libs = spark.createDataFrame([(1, "numpy"), (1, "Flask"), (2, "who")], "task int, lib string")
    dims = spark.createDataFrame([("numpy", "Computation"), ("flask", "Network")], "lib string, domain string")
    got = {r["task"]: r["domains"] for r in domains.domains_of(libs, dims).collect()}
    assert got == {1: ["Computation", "Network"], 2: []}
    assert {r["task"]: r["is_held_out"] for r in domains.held_out(domains.domains_of(libs, dims), "network").collect()} == {1: True, 2: False}


def test_cursor_join_pads(spark):
    records = spark.createDataFrame([("t", 1, 2), ("t", 2, 2), ("u", 1, 1)], "task string, seq int, n int")
    scores = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("t", 3, True)], "task string, score_seq int, value boolean")
    got = sorted((r["task"], r["seq"], r["place"], r["is_correct"], r["padded"]) for r in outcomes.cursor_joined(records, scores, "task", "seq", "n").collect())
    assert got == [("t", 1, 0, True, False), ("t", 1, 1, False, False), ("t", 2, 0, True, False), ("t", 2, 1, False, True), ("u", 1, 0, False, True)]


def test_filter_reconciles(spark):
    rows = spark.createDataFrame([(1, True, False), (1, False, False), (2, False, True)], "p int, is_no_program boolean, is_no_fix boolean")
    for r in ("line_filter", "no_correct_line", "correct"):
        rows = rows.withColumn(f"is_{r}", F.lit(None).cast("boolean"))
    c = one(outcomes.filter_counts(rows))
    assert c["total"] == c["kept"] + c["dropped"] == 3 and c["kept"] == outcomes.filtered(rows).count()
    p = one(outcomes.row_counts(spark.createDataFrame([(1,), (2,), (3,)], "p int"), rows, "p"))
    assert (p["rows_kept"], p["rows_dropped"], p["rows_empty"]) == (1, 1, 1)


@pytest.mark.parametrize(
    "text, want",
    [
        ("none", None),
        ("```py\nx", None),
        ("a```py\nx = 1\n```b", "x = 1\n"),
        ("```\na\n``` t ```py\nbb```", "bb"),
        ("```a\nb\n``` and ```", " and "),
        ("``````", None),
        ("```a\n```", None),
    ],
)
def test_code_span(spark, text, want):
    span = one(spark.createDataFrame([(text,)], "t string").select(scalars.code_span(F.col("t")).alias("s")))["s"]
    assert (None if span is None else text[span["start"] : span["end"]]) == want


def test_scalars(spark):
    t = lambda v, f, kind="string": one(spark.createDataFrame([(v,)], f"v {kind}").select(f(F.col("v")).alias("x")))["x"]
    assert [t(v, scalars.truthy) for v in ("TRUE", " 1 ", "yes", "pass", None)] == [True, True, True, False, False]
    assert [t(v, scalars.truthy_score) for v in ("passed", "OK", "no")] == [True, True, False]
    assert [t(v, scalars.flags) for v in ("true", "[true, 0]", '"pass"', "1")] == [[True], [True, False], [True], [True]]
    assert t("['a', \"b\"]", scalars.library_list) == ["a", "b"] and t("a, b,", scalars.library_list) == ["a", "b"] and t("x", scalars.library_list) == ["x"]
    assert t("**0.90** (x)", scalars.first_number) == 0.9 and t("n/a", scalars.first_number) is None
    assert t("org/model v1", scalars.safe_name) == "org_model_v1"
    start = "<|start|>assistant<|channel|>%s<|message|>"
    assert t(start % "analysis" + " one <|end|>" + start % "final" + "two<|end|>", scalars.stripped_channels) == "one\ntwo" and t(" plain", scalars.stripped_channels) == "plain"
    assert t("x<|channel|>final<|message|> a<|channel|>analysis<|message|>b<|return|>", scalars.stripped_channels) == "a\nb"
    assert t("valid", scalars.canonical_split) == "validation"
    assert t([1, 3, 7], lambda c: scalars.nearest_line(c, F.lit(4)), "array<int>") == 7
    assert t([1, 3], lambda c: scalars.nearest_line(c, F.lit(4)), "array<int>") == 3
    assert t("1.0 2\nx", lambda c: scalars.same_output(c, F.lit("1 2.00\n x "))) is True
    assert t("1", lambda c: scalars.same_output(c, F.lit("2"))) is False
    assert t("a\nb\nc", lambda c: scalars.line_of(c, F.lit(4))) == 3
    assert t([0.0] * 4, scalars.token_entropy, "array<double>") == pytest.approx(math.log(4))
    assert t([0.0] * 4, lambda c: scalars.token_entropy(c, 2), "array<double>") == pytest.approx(1.5 * math.log(2))


def test_mask_in_both_modes(spark):
    text = '"""doc"""\nx = 1 # "c"\n'
    pieces = ['"""doc""', '"', "\n", "x", " = 1", " ", '# "c"', "\n"]
    got = spark.createDataFrame([(text, pieces)], "t string, p array<string>").withColumn("o", spans.spans_from("p"))
    a, b = got.select(spans.forced_mask(F.col("t"), F.col("o")), spans.forced_mask(F.col("t"), F.col("o"), True)).first()
    assert b == [True, True, True, False, False, True, True, True]
    assert a[0] and not a[3] and a[6]


def test_specifiers(spark):
    specs = scalars.parsed_specifiers(["0", "-1", "junk", "code_to_end", "0"])
    assert specs == [0, -1, "code_to_end"] and scalars.parsed_specifiers(["?"]) == [-1]
    rows = spark.createDataFrame([(5, 2, 3), (5, 0, 0)], "n int, a int, b int")
    got = [r[0] for r in rows.select(scalars.resolved_specifiers([*specs, 9, "last_code_token"], F.col("n"), F.col("a"), F.col("b"))).collect()]
    assert got == [[0, 4, 2, 3], [0, 4]]


def test_digamma_and_reliability(spark):
    assert arrow.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-10)
    assert arrow.reliability([-1.0, -2.0]) == pytest.approx(-1 * (arrow.digamma(np.array([3.0])) - arrow.digamma(np.array([2.0])))[0])
    assert arrow.reliability([]) is None


@settings(max_examples=40)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_difference_labels(a, b):
    got = arrow.difference_labels(a, b)
    assert len(got) == len(a) and (a != b or all(got))
    for tag, i, j, _, _ in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag in ("replace", "delete"):
            assert not any(got[i:j])


def test_cases_as_json(spark):
    import base64
    import json
    import zlib

    cases = [{"input": "1", "output": "2", "testtype": "stdin"}]
    stored = [json.dumps(cases), base64.b64encode(zlib.compress(json.dumps(cases).encode())).decode(), "gibberish"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in stored], "s string").select(arrow.test_cases("s")).collect()]
    assert got[0] == got[1] and got[0][0]["output"] == "2" and got[2] is None


def test_percentile_and_pearson(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(1, 7)], "v double")
    assert one(reports.percentiles(rows, "v", (50.0, 90.0)))["p50"] == 3.0  # rint(2.5) = 2, zero-based
    assert one(rows.agg(reports.nearest_rank(F.collect_list("v"), 50.0).alias("x")))["x"] == 3.0
    assert one(reports.pearson(rows.withColumn("w", F.lit(1.0)), "v", "w"))["r"] is None
    assert one(reports.pearson(rows.withColumn("w", F.col("v") * -2), "v", "w"))["r"] == -1.0


def test_replayed_bootstrap(spark):
    rows = spark.createDataFrame([("m", i, float(i)) for i in range(6)], "model string, id int, value double")
    draw, own = random.Random(42), [float(i) for i in range(6)]
    means = sorted(sum(own[draw.randrange(6)] for _ in own) / 6 for _ in range(400))
    got = one(reports.replayed_bootstrap(rows, 400))
    assert (got["low"], got["high"]) == (means[9], means[389])


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "p", "output": ["o1", "o2"], "program": ["x"], "is_correct": true, "code_token_idx": [[0, 0], [2, 5]], "line_error_map": [{"1": true, "2": false}], "token_labels": [[{"token_id": 1, "label": false, "line": 2}]]}\n\n')
    rec = readers.split_records(spark, {"train": str(tmp_path / "a.jsonl")})
    got = readers.candidates(rec).orderBy("cand_idx").collect()
    assert [(r["program"], r["is_correct"], r["span_start"], r["span_end"]) for r in got] == [("x", True, None, None), ("", False, 2, 5)]
    assert {(r["line"], r["line_is_clean"]) for r in readers.lines(rec).collect()} == {(1, True), (2, False)}
    assert [(r["line"], r["tok_is_correct"], r["ws_comment"]) for r in readers.tokens(rec).collect()] == [(2, False, False)]
    assert readers.split_paths(["train=/a", "val:/b", "junk"]) == ({"train": "/a", "val": "/b"}, ["junk"])
    text = "### M1\n| Baseline Model | roc_auc | rank |\n|---|---|---|\n| A | **0.91** | 1 |\n| B | 0.5 |\n\ntext\n\n| Baseline Model | roc_auc | rank |\n|---|---|---|\n| C | 0.7 | 2 |\n"
    rows = readers.metric_tables(spark.createDataFrame([("f", text)], "source string, value string")).orderBy("ord").collect()
    assert [(r["model"], r["table_ord"], r["baseline"], r["roc_auc"], r["rank"]) for r in rows] == [("M1", 1, "A", 0.91, "1"), ("M1", 2, "C", 0.7, "2")]


def test_stream_equals_batch(spark, tmp_path):
    from credence.streaming import labels as stream

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text('{"id": "p%d", "output": ["o"], "program": ["x"], "fixed_program": ["y"], "token_labels": [[{"label": false, "line": 2}, {"label": true, "line": 1}]]}\n' % k)
    q = stream.line_maps(stream.landed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("maps").start()
    q.processAllAvailable()
    q.stop()
    batch = stream.line_maps(readers.json_lines(spark, str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("maps").collect())) == sorted(map(tuple, batch.collect()))


def test_further_scalars(spark):
    row = spark.createDataFrame([([10, 11, 12, 13, 14], '[{"token_text": "a", "label": true, "line": 2}]', '{"tokens": [["b", false]]}', "x")], "v array<int>, a string, b string, c string")
    got = row.select(
        scalars.token_slice(F.col("v"), F.lit(1), F.lit(2), F.lit(1)).alias("s"), scalars.shifted(F.col("v"), F.lit(0)).alias("h0"), scalars.shifted(F.col("v"), F.lit(3)).alias("h3"),
        scalars.valid_range(F.lit("3"), F.lit("2")).alias("r"), *[scalars.annotation_tokens(F.col(c)).alias(f"t{c}") for c in "abc"],
    ).first()
    assert got["s"] == [12, 13] and (got["h0"], got["h3"], got["r"]) == (10, 12, None)
    assert [tuple(x) for x in got["ta"]] == [("a", True, 2)] and [tuple(x) for x in got["tb"]] == [("b", False, -1)] and got["tc"] is None
    assert one(row.select(metrics.selection_score(F.lit(float("nan")), F.lit(0.4)).alias("x")))["x"] == 0.4


def test_roles_and_layers(spark):
    rows = spark.createDataFrame([(1, 3, p) for p in (0, 4, 9)] + [(2, 3, p) for p in range(5)], "c int, layer int, pos int")
    assert sorted((r["pos"], r["role"]) for r in features.role_positions(rows.where("c = 1"), ["c"]).collect()) == [(0, "first"), (4, "second_last"), (9, "last")]
    assert sorted((r["c"], r["pos"]) for r in features.role_positions(rows, ["c"], -2).collect()) == [(1, 4)]
    assert sorted((r["c"], r["pos"]) for r in features.role_positions(rows, ["c"], -1).collect()) == [(1, 9), (2, 4)]
    got = features.layers_of(rows.withColumn("a", F.when(F.col("c") == 2, F.array(F.lit(7)))).withColumn("d", F.array().cast("array<int>")), ["c"], "a", "d")
    assert {r["c"]: (r["layers"], r["how"]) for r in got.collect()} == {1: ([3], "occurs"), 2: ([7], "asked")}
    pieces = spark.createDataFrame([(1, "a"), (2, "<end>")], "token_id int, piece string")
    got = {r["token_id"]: r["piece"] for r in features.decoded(spark.createDataFrame([(1,), (2,), (3,)], "token_id int"), pieces, [2]).collect()}
    assert got == {1: "a", 2: "", 3: None}


def test_probes(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    from credence.operators import probes

    draw = random.Random(3)
    rows = probes.prepared(spark.createDataFrame([([draw.gauss(y, 0.4), draw.gauss(-y, 0.4)], bool(y)) for y in (0, 1) for _ in range(60)], "vec array<double>, y boolean"))
    judge = lambda df: one(metrics.roc_auc(df, F.col("y") > 0, F.col("score")))["auc"]
    model = probes.fitted("logistic", rows, 2, weighted=True)
    assert judge(probes.scores(model, rows)) > 0.9
    probes.saved(model, str(tmp_path / "m"))
    assert judge(probes.scores(probes.loaded(LogisticRegressionModel, str(tmp_path / "m")), rows)) > 0.9
    rate, best, trees = probes.swept("gbt", rows, rows, 2, (0.1, 0.1, 0.3), judge, rounds=3)
    assert rate in (0.1, 0.3) and judge(probes.scores(best, rows, trees)) > 0.9
    assert probes.in_two_dimensions(rows.withColumn("id", F.monotonically_increasing_id()), ["id"]).count() == 120


def test_streams_of_candidates_and_windows(spark, tmp_path):
    """The candidate filter on a stream keeps what it keeps on the finished files; late scores go."""
    from credence.streaming import labels as stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text('{"id": "p%d", "output": ["o", "o", "o"], "program": ["x", "", "z"], "fixed_program": ["y", "y", %s], "line_filter": [%s, false, false], "is_correct": "true"}\n' % (k, "null" if k == 1 else '"w"', "true" if k == 2 else "false"))
    q = stream.kept_candidates(stream.landed(spark, str(tmp_path / "in"))).select("sample_id", "cand_idx").writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    want = stream.kept_candidates(readers.json_lines(spark, str(tmp_path / "in"))).select("sample_id", "cand_idx")
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, want.collect())) == [("p0", 0), ("p0", 2), ("p1", 0), ("p2", 2)]

    schema = "ts timestamp, kind string, value double"
    (tmp_path / "ev").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "ev"))
    q = stream.windowed_scores(source).select("w.start", "kind", "n", "mean").writeStream.format("memory").queryName("windows").outputMode("append").start()
    for name, rows in (("0", [("2024-01-01T00:01:00Z", 1.0), ("2024-01-01T00:09:00Z", 3.0)]), ("1", [("2024-01-01T02:00:00Z", 5.0)]), ("2", [("2024-01-01T00:02:00Z", 100.0), ("2024-01-01T04:00:00Z", 7.0)])):
        (tmp_path / "ev" / f"{name}.json").write_text("".join('{"ts": "%s", "kind": "a", "value": %s}\n' % r for r in rows))
        q.processAllAvailable()
    q.stop()
    got = sorted((str(r["start"]), r["n"], r["mean"]) for r in spark.table("windows").collect())
    assert got[0][1:] == (2, 2.0) and all(x[1] == 1 for x in got[1:])  # what came after the watermark had passed its window didn't count


def test_probe_names_find_what_is_there(spark):
    """Every estimator of the registry, early stopping included, on two separate clouds."""
    from credence.operators import probes

    draw = random.Random(5)
    rows = probes.prepared(spark.createDataFrame([([draw.gauss(3 * y, 0.5), draw.gauss(-3 * y, 0.5), draw.gauss(0, 1), draw.gauss(0, 1)], bool(y), i % 4 == 0) for i in range(60) for y in (0, 1)], "vec array<double>, y boolean, held boolean")).cache()
    judge = lambda df: one(metrics.roc_auc(df, F.col("y") > 0, F.col("score")))["auc"]
    for name, options in (("gbt", {"early_stop": True, "rounds": 12}), ("mlp_two_hidden", {}), ("mlp_one_hidden", {}), ("mlp_halving", {})):
        model = probes.fitted(name, rows, 4, **options)
        assert judge(probes.scores(model, rows)) > 0.95, name
        assert name != "gbt" or model.getNumTrees <= 12


def test_alignment_of_whole_tables(spark):
    """Both alignments on texts of any length, as the alignment itself gives them."""
    draw = random.Random(6)
    texts = [[draw.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 5, 80, 700)]
    rows = [(i, t, [w for k, w in enumerate(t) if k % 7 != 3], len(t) // 4, len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, given array<string>, fixed array<string>, a int, b int").withColumn("o", F.floor(F.col("a") * 6 / 7).cast("int"))
    got = {r["id"]: r for r in df.select("id", "o", arrow.token_labels("given", "fixed").alias("x"), arrow.code_token_labels("given", "fixed", "o", "a", "b").alias("y")).collect()}
    for i, given, fixed, a, b in rows:
        whole = [True] * len(given)
        for tag, s, e, _, _ in SequenceMatcher(None, given, fixed, autojunk=False).get_opcodes():
            if tag == "insert" and given:
                whole[min(s, len(given) - 1)] = False
            elif tag != "equal":
                whole[s:e] = [False] * (e - s)
        assert got[i]["x"] == whole
        stands = {a + m.a + k for m in SequenceMatcher(None, given[a:b], fixed[got[i]["o"] :], autojunk=False).get_matching_blocks() for k in range(m.size)}
        assert got[i]["y"] == [ok and (k < a or k in stands) for k, ok in enumerate(whole)]


def test_reports_render_and_parse(spark, tmp_path):
    from credence.sources import writers

    rows = spark.createDataFrame([("m1", 2, "b", 0.5), ("m1", 1, "a", None), ("m2", 1, "c", 0.25)], "model string, ord int, baseline string, auc double")
    text = {r["value"].split("\n")[0]: r["value"] for r in writers.markdown_tables(rows, "model", "ord", {"baseline": "Baseline Model", "auc": "roc_auc"}).collect()}
    assert text["### m1"] == "### m1\n\n| Baseline Model | roc_auc |\n| --- | --- |\n| a |  |\n| b | 0.5 |\n"
    whole = writers.summary("Title", {"rows": 3}, {"Table": rows.where("model = 'm2'")})
    assert whole.startswith("# Title\n\n- rows: 3\n\n### Table\n") and "| m2 | 1 | c | 0.25 |" in whole
    with pytest.raises(FileNotFoundError):
        writers.features(rows.withColumn("split", F.lit("train")).withColumn("layer", F.lit(1)), str(tmp_path / "f"))
        readers.features(spark, str(tmp_path / "f"), "test")


def test_offsets_of_ids(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = tokenizers.Tokenizer.from_file(path)
    text = "def f(x):\n    return x + 1  # done"
    own = known.encode(text, add_special_tokens=False).ids
    odd = [known.token_to_id(c) for c in "return"]  # letter by letter: not what the tokenizer makes of the word
    rows = spark.createDataFrame([(1, own), (2, odd), (3, []), (4, None)], "i int, ids array<int>")
    got = {r["i"]: r["o"] for r in rows.select("i", arrow.token_offsets(path)("ids").alias("o")).collect()}
    assert got[1]["text"] == text and "".join(text[a:b] for a, b in got[1]["spans"]) == text
    assert (got[2]["text"], [tuple(x) for x in got[2]["spans"]]) == ("return", [(k, k + 1) for k in range(6)])
    assert (got[3]["text"], got[3]["spans"]) == ("", []) and (got[4] is None or got[4]["spans"] is None)
