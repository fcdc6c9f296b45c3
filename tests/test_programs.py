"""Alignments, spans, leaves, scans, sinks, cases, sweeps and large bootstraps against plain versions of the same rules."""

import ast
import base64
import json
import keyword
import os
import pickle
import random
import time
import zlib
from decimal import Decimal
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credence.functions import alignment, arrow, scalars, spans
from credence.operators import features, labels, metrics, probes, reports, selection, splits
from credence.plans import further, programs
from credence.sources import readers, writers

SHORT = st.lists(st.integers(0, 3), max_size=24)


def merged(blocks):
    out = []
    for i, j, n in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


@settings(max_examples=300, deadline=None)
@given(SHORT, SHORT, st.sampled_from([(8, 16), (1, 2), (2, 3), (3,)]))
def test_blocks_are_those_of_the_rule(a, b, sizes):
    before, alignment.LONG = alignment.LONG, sizes
    try:
        assert merged(alignment.matching_blocks(a, b)) == [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]
    finally:
        alignment.LONG = before


@pytest.mark.parametrize("items", ["few", "frequent", "same"])
def test_long_alignments(items):
    rng = random.Random(2)
    a = [{"few": rng.randrange(5000), "frequent": int(rng.paretovariate(0.7)), "same": 1}[items] for _ in range(200_000)]
    b = [x for i, x in enumerate(a) if i % 7 != 3 or items == "same"]
    began = time.time()
    blocks = alignment.matching_blocks(a, b)
    assert time.time() - began < 10 and all(a[i : i + n] == b[j : j + n] for i, j, n in blocks) and sum(n for _, _, n in blocks) > (0.1 if items == "frequent" else 0.9) * len(b)


def fix_rule(given_, fixed, gmask, fmask):
    """Labels, whether anything is equal, and insertions, straight from the rule."""
    labels_ = [False] * len(given_)
    if not given_ or not fixed:
        return labels_, False, []
    codes = SequenceMatcher(None, given_, fixed, autojunk=False).get_opcodes()
    inserts = [a for tag, a, _, c, d in codes if tag == "insert" and not all(fmask[c:d])]
    g, f = [i for i, m in enumerate(gmask) if not m], [i for i, m in enumerate(fmask) if not m]
    for m in SequenceMatcher(None, [given_[i] for i in g], [fixed[i] for i in f], autojunk=False).get_matching_blocks():
        for k in range(m.size):
            labels_[g[m.a + k]] = True
    return labels_, any(c[0] == "equal" for c in codes), inserts


@settings(max_examples=150, deadline=None)
@given(SHORT, SHORT, st.randoms())
def test_labels_from_fix(a, b, r):
    ma, mb = [r.random() < 0.3 for _ in a], [r.random() < 0.3 for _ in b]
    assert arrow.labels_from_fix(a, b, ma, mb) == fix_rule(a, b, ma, mb)


def test_candidates_from_fixes(spark):
    """Insertions go to lines of code, spread over them and count for the two filters, as by hand-written loops."""
    rng = random.Random(4)
    tokens, inserts = [], []
    for c in range(60):
        for line in range(1, 9):
            tokens += [(c, line, rng.random() < 0.8, rng.random() < 0.5) for _ in range(rng.randrange(4))]
        if c % 3:
            inserts += [(c, rng.randrange(1, 11)) for _ in range(rng.randrange(3))]
    t = spark.createDataFrame(tokens, "c int, line int, tok_is_correct boolean, ws_comment boolean")
    spread, per = labels.fixed_candidates(t, spark.createDataFrame(inserts, "c int, line int"), ["c"], 3)
    got = {r["c"]: (r["wrong_lines"], r["is_line_filter"], r["is_no_correct_line"]) for r in per.collect()}
    sums = {r["c"]: r["n"] for r in spread.groupBy("c").agg(F.count_if("tok_is_correct").alias("n")).collect()}
    for c in {x[0] for x in tokens}:
        own = [x[1:] for x in tokens if x[0] == c]
        code = sorted({line for line, _, m in own if not m})
        forced = set()
        for line in (x[1] for x in inserts if x[0] == c):
            later, earlier = [x for x in code if x >= line], [x for x in code if x < line]
            forced |= {later[0]} if later else {earlier[-1]} if earlier else set()
        wrong = forced | {line for line, ok, m in own if not ok and not m}
        assert got[c] == (len(wrong), len(wrong) >= 3, not set(code) - wrong)
        assert sums[c] == sum(m or line not in wrong for line, _, m in own)


def test_spans_and_masks_of_long_texts(spark):
    """100 000 tokens and 10 000 comments take well under two seconds, and agree with a check of every span."""
    pieces = [w for i in range(10_000) for w in ("é = ", "x", " ", "+ 1 ", "y  ", f"# {i}", "\n", "\t", "b()", "\n")]
    text = "".join(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    began = time.time()
    made = spans.masked(text, starts, ends)
    assert time.time() - began < 2
    assert made.tolist() == [p.isspace() or p.startswith("#") for p in pieces]
    rows = spark.createDataFrame([(1, ["a ", "", "# é", "\n", " ", "b"]), (2, []), (3, None), (4, ['r"""x', '"""', "\n", "c"])], "i int, p array<string>")
    rows = rows.withColumn("t", F.array_join("p", "")).withColumn("o", spans.spans_from("p"))
    got = {r["i"]: r for r in rows.select("i", "o", spans.forced_mask(F.col("t"), F.col("o"), True).alias("m"), spans.line_numbers("t", "o").alias("l")).collect()}
    assert [tuple(x) for x in got[1]["o"]] == [(0, 2), (2, 2), (2, 5), (5, 6), (6, 7), (7, 8)] and got[1]["m"] == [False, False, True, True, True, False] and got[1]["l"] == [1, 1, 1, 1, 2, 2]
    assert got[2]["o"] == [] and got[2]["m"] == [] and got[3]["o"] is None and got[3]["m"] is None and got[4]["m"] == [True, True, True, False]


@settings(max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6))), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6))))
def test_overlaps(tokens, found):
    t, s = [(a, a + n) for a, n in tokens], [(a, a + n) for a, n in found]
    got = spans.overlapping(np.array([a for a, _ in t], int), np.array([b for _, b in t], int), np.array(s, int).reshape(-1, 2))
    assert got.tolist() == [any(a < d and b > c for c, d in s) for a, b in t]


SOURCE = '''def f(a, b=0x1F):  # first
    """doc
    string"""
    return f"{a!r} and {b + 1}" + r'\\d' if a else None  # it's
x = 'no end
y = 1.5e3 @ z
'''


def test_leaves():
    found = list(spans.lexed(SOURCE))
    assert all(a < b for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    named = [(SOURCE[a:b], k) for a, b, k in found]
    assert [t for t, k in named if k == "comment"] == ["# first", "# it's"]
    assert [t for t, k in named if k == "identifier"] == ["f", "a", "b", "a", "r", "b", "a", "x", "y", "z"]
    assert [t for t, k in named if k == "keyword"] == ["def", "return", "if", "else", "None"] and ("0x1F", "number") in named and ("1.5e3", "number") in named
    assert [t for t, k in named if k == "string_content"] == ["doc\n    string", " and ", "\\d", "no end"]
    assert list(spans.lexed("")) == [] and [k for _, _, k in spans.lexed('"""never')] == ["string_start", "string_content"]
    whole = "".join(SOURCE[a:b] for a, b, _ in found)
    assert whole.replace(" ", "") == "".join(SOURCE.split()).replace(" ", "") or set(SOURCE) - set(whole) <= set(" \n")


def test_leaves_of_python_agree_with_its_own_parser():
    """Names that the compiler sees in a module of this library are the identifiers of the lexer, keywords aside."""
    source = open(spans.__file__).read()
    lines = np.concatenate([[0], np.cumsum([len(x) for x in source.splitlines(keepends=True)])])
    wanted = {(int(lines[n.lineno - 1]) + n.col_offset, n.id) for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Name) and source.splitlines()[n.lineno - 1].isascii()}
    found = {(a, source[a:b]) for a, b, k in spans.lexed(source) if k == "identifier"}
    assert wanted <= found and len(wanted) > 300 and not any(keyword.iskeyword(t) for _, t in found)


def test_selections_by_leaves(spark):
    rng = random.Random(9)
    rows = []
    for i in range(25):
        text = "".join(rng.choice(["x", "if ", "# c", "\n", " ", "'s'", "12", "+", "name_1 ", "\t"]) for _ in range(rng.randrange(40)))
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(12))})
        rows.append((i, [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [""]))
    df = spark.createDataFrame([*rows, (90, ["# only"]), (91, [" ", "\n"])], "k int, p array<string>").withColumn("t", F.array_join("p", "")).withColumn("o", spans.spans_from("p"))
    tokens = df.select("k", F.posexplode("p").alias("pos", "w")).withColumn("entropy", F.col("pos") % 3 + 0.5)
    leaves = df.select("k", F.explode(spans.leaves("t", "o")).alias("x")).select("k", "x.*")
    first = selection.first_leaves(tokens, leaves, ["k"]).groupBy("k").agg(F.sort_array(F.collect_list("pos")).alias("a"))
    rest = selection.without_kinds(tokens, leaves, ["k"]).groupBy("k").agg(F.sort_array(F.collect_list("pos")).alias("b"))
    got = {r["k"]: (r["a"], r["b"]) for r in first.join(rest, "k").collect()}
    for k, p in [*rows, (90, ["# only"]), (91, [" ", "\n"])]:
        text, at = "".join(p), 0
        places = []
        for w in p:
            places.append((at, at + len(w)))
            at += len(w)
        found = list(spans.lexed(text))
        best = {}
        for a, _, kind in found:
            token = next((i for i, (s, e) in enumerate(places) if s <= a < e), None)
            row, col = text[:a].count("\n"), a - (text[:a].rfind("\n") + 1)
            if kind != "comment" and token is not None and (row not in best or col < best[row][0]):
                best[row] = (col, token)
        chosen = sorted({t for _, t in best.values()} | {len(p) - 1}) if found else sorted({0, len(p) - 1})
        marked = {i for a, b, kind in found if kind in ("comment", "identifier") for i, (s, e) in enumerate(places) if e > a and s < b}
        kept = [i for i in range(len(p)) if i not in marked] or sorted({0, len(p) - 1})
        assert got[k] == (chosen, kept), (k, p)


@pytest.mark.parametrize("damage", ["cut", "page", "none"])
def test_damaged_files_are_counted_and_skipped(spark, tmp_path, damage):
    for split, ids in (("train", range(0, 6000)), ("test", range(5990, 6100))):
        rows = spark.createDataFrame([(f"s{i}" if i % 10 else None, [float(i), 1.0]) for i in ids], "sample_id string, vec array<double>")
        rows.repartition(2).write.option("parquet.block.size", 32 << 10).option("compression", "gzip").parquet(f"{tmp_path}/f/split={split}")
    hit = sorted(p for p in (tmp_path / "f" / "split=train").iterdir() if p.suffix == ".parquet")[0]
    data = hit.read_bytes()
    if damage != "none":
        hit.write_bytes(data[: len(data) // 2] if damage == "cut" else data[: len(data) // 2] + bytes(300) + data[len(data) // 2 + 300 :])
        (hit.parent / f".{hit.name}.crc").unlink()
    rows, audit = readers.audited_features(spark, f"{tmp_path}/f", "sample_id string, vec array<double>")
    got = {r["split"]: r for r in audit.collect()}
    lost = int(damage != "none")
    assert (got["train"]["files_scanned"], got["train"]["files_loaded"], got["train"]["files_skipped"]) == (2, 2 - lost, lost) and got["test"]["files_skipped"] == 0
    assert rows.where("split = 'train'").count() == got["train"]["rows"] == (3000 if lost else 6000) and rows.where("sample_id is null").count() == 0
    assert lost or got["train"]["collisions"] == got["test"]["collisions"] == 9


def test_stored_features_are_joined_without_moving_them(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 50).alias("cand"), (F.col("id") / 50).cast("bigint").alias("pos"), F.array(F.col("id").cast("float")).alias("vec"))
    writers.bucketed(rows, "stored_features", f"file://{tmp_path}/b", ["cand", "pos"], 8)
    spark.sql("DROP TABLE stored_features")  # as another session finds it
    stored = readers.bucketed(spark, "stored_features", f"file://{tmp_path}/b", "cand bigint, pos bigint, vec array<float>", ["cand", "pos"], 8)
    labelled = spark.range(1500).select((F.col("id") % 50).alias("cand"), F.lit(3).alias("code_start"), (F.col("id") / 50).cast("bigint").alias("tok_idx"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = labels.at_positions(labelled, stored, ["cand"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(i for i, x in enumerate(plan.split("\n")) if "FileScan" in x and "vec" in x)
    join = max(i for i, x in enumerate(plan.split("\n")[:scan]) if "SortMergeJoin" in x)
    assert "Exchange" not in plan.split("\n")[scan - 1] + plan.split("\n")[scan - 2] and plan.count("Exchange") == 1 and join < scan


def test_a_sink_that_died_goes_on(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    rows = spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    assert readers.committed(spark, at, "key bigint, x bigint").count() == 0
    assert writers.resumed(rows.where("key < 100"), "key", at) == 100
    dies = rows.withColumn("x", F.when(F.col("key") == 250, F.raise_error("killed")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="killed"):
        writers.resumed(dies.repartitionByRange(4, "key"), "key", at)
    writers.batch(rows.where("key > 280"), at)  # written in full, but not committed
    assert readers.committed(spark, at, "key bigint, x bigint").count() == 100
    assert [writers.resumed(rows, "key", at) for _ in range(2)] == [200, 0]
    found = readers.committed(spark, at, "key bigint, x bigint").collect()
    assert sorted((r["key"], r["x"]) for r in found) == [(i, 2 * i) for i in range(300)]


class Calls:
    def __reduce__(self):
        return os.system, ("exit 3",)


def test_cases_in_all_forms():
    cases = [{"input": "1 ☃", "output": "2\n" * 500, "testtype": "stdin"}, {"input": "", "output": None, "testtype": "functional", "more": [1, (2.5, True), {"a": None}]}]
    text = json.dumps(cases)
    b = lambda x: base64.b64encode(x).decode()
    want = [{k: c[k] for k in ("input", "output", "testtype")} for c in cases]
    for protocol in range(6):
        for value in (text, cases):
            data = pickle.dumps(value, protocol)
            assert arrow.decoded_cases(b(zlib.compress(data))) == want == arrow.decoded_cases(b(data)), protocol
            assert arrow.plain_pickle(data) == value
    assert arrow.decoded_cases(text) == arrow.decoded_cases(json.dumps(text)) == arrow.decoded_cases(b(zlib.compress(text.encode()))) == want
    for protocol in range(6):
        for bad in (Calls(), [Calls()], {"input": os.system}, print, complex(1, 2), {1, 2} if protocol > 3 else Calls()):
            assert arrow.decoded_cases(b(zlib.compress(pickle.dumps(bad, protocol)))) is None
    for data in (b"cos\nsystem\n(S'exit 3'\ntR.", b"(S'exit 3'\nios\nsystem\n.", b"", b".", b"]", b"(", b"h\x05.", b"\x80\x05K\x01\x85R."):
        assert arrow.decoded_cases(b(data)) is None and arrow.decoded_cases(b(zlib.compress(data))) is None
    assert arrow.decoded_cases("gibberish") is None and arrow.decoded_cases('{"a": 1}') is None


def plain_same(want, got):
    a, b = ([x.strip() for x in t.strip().split("\n")] for t in (want, got))
    if len(a) != len(b):
        return False
    for x, y in zip(a, b, strict=True):
        if x != y:
            try:
                if [Decimal(t) for t in x.split()] != [Decimal(t) for t in y.split()]:
                    return False
            except ArithmeticError:
                return False
    return True


def test_outputs_as_decimals(spark):
    rng = random.Random(1)
    forms = ["0", "-0", "+0.0", "00", ".0", "1e-19", "2e-19", "0.1", ".1", "1E-1", "10", "1e1", "1_0", "123456789012345678901234", "123456789012345678901234.0", "1e999999", "1e1000000", "inf", "-Infinity", "nan", "NaN", "-5.", "-5", "5", "e5", ".", "-", "1e", "x", "", "0x1", "1 2", "1.0  2", "--1", "1e+2", "100"]
    pairs = [(a, b) for a in forms for b in forms] + [("\n".join(rng.choices(forms, k=3)), "\n".join(rng.choices(forms, k=3))) for _ in range(100)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scalars.same_output(F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        assert r["x"] == plain_same(r["a"], r["b"]), (r["a"], r["b"])


def plain_libraries(raw):
    text = raw.strip()
    if not text:
        return []
    try:
        parsed = ast.literal_eval(text)
        if isinstance(parsed, list | tuple):
            return [x for x in parsed if isinstance(x, str)]
    except (SyntaxError, ValueError):
        pass
    if "," in text:
        return [p for p in (x.strip().strip("'\"") for x in text.strip("[]").split(",")) if p]
    return [text.strip("'\"")]


def test_library_lists(spark):
    forms = ["['a,b', \"c\"]", "[\"it's\", 'x\\'y', '\\\\']", "('a', 'b')", "('a')", "('a',)", "'a', 'b'", "'a'", "a, b,", "[a, b]", "[numpy]", "numpy", "[]", "()", " ", "", "[1, 'a', 2.5, None]", "['a', b]", "['a'", "a,'b,c'", "['a',]", "[,]", "['a' ,  u'b']", "'", "[['a']]x,y"]
    got = spark.createDataFrame([(x,) for x in forms], "t string").select("t", scalars.library_list(F.col("t")).alias("x")).collect()
    for r in got:
        assert r["x"] == plain_libraries(r["t"]), r["t"]


def test_best_number_of_trees_of_all_prefixes(spark):
    rng = random.Random(7)
    rows = [([rng.gauss(0.8 * y, 1.0), rng.gauss(0, 1)], bool(y), i % 2) for i in range(240) for y in (0, 1)]
    df = probes.prepared(spark.createDataFrame(rows, "vec array<double>, y boolean, part int")).cache()
    train, validation = df.where("part = 0"), df.where("part = 1")
    swept = probes.sweep("gbt", train, validation, 2, (0.9, 0.2, 0.2), rounds=6, depth=4)
    assert [r["rate"] for r in swept] == [0.2, 0.9]
    for r in swept:
        losses = []
        for n in range(1, 7):
            scored = probes.scores(r["model"], validation, n)
            losses.append(scored.agg(F.avg(-2 * F.ln(F.when(F.col("y") > 0, F.col("score")).otherwise(1 - F.col("score"))))).first()[0] / 2)
        assert r["trees"] == 1 + int(np.argmin(np.round(losses, 9)))
        whole = {tuple(x) for x in probes.scores(r["model"], validation).select(F.round("score", 9)).collect()}
        assert whole == {tuple(x) for x in probes.scores(r["model"], validation, 6).select(F.round("score", 9)).collect()}
    assert swept[1]["trees"] < 6  # a high rate fits too much soon


def test_probes_tell_labels_from_chance(spark):
    """AUC on separate clouds, and on the same vectors with shuffled labels, for every probe; and judged as plain numbers say."""
    rng = random.Random(11)
    rows = [([rng.gauss(3 * y, 0.5), rng.gauss(-3 * y, 0.5), rng.gauss(0, 1), 0.0], bool(y), bool(rng.randrange(2)), i % 2) for i in range(200) for y in (0, 1)]
    df = spark.createDataFrame(rows, "vec array<double>, y boolean, z boolean, part int").cache()
    auc = lambda d: metrics.roc_auc(d, F.col("y") > 0, F.col("score")).first()["auc"]
    for name in probes.PROBES:
        for own, low, high in (("y", 0.97, 1.0), ("z", 0.35, 0.65)):
            known = probes.prepared(df.select("vec", F.col(own).alias("y"), "part"))
            scored = probes.scores(probes.fitted(name, known.where("part = 0"), 4, rounds=8), known.where("part = 1"))
            assert low <= auc(scored) <= high, (name, own)


def test_large_bootstrap(spark):
    """Cells' draws add up to n in every resample; the interval is that of the replayed one within its error; order doesn't matter."""
    sizes = np.array([5, 0, 17, 3, 9])
    draws = np.stack([reports.draws_of_cell(sizes, c, 500, 3) for c in range(5)])
    assert (draws.sum(axis=0) == 34).all() and abs(draws.mean(axis=1) - sizes).max() < 1 and (draws[1] == 0).all()
    rng = random.Random(5)
    rows = [(m, i, rng.gauss(k, 1 + k)) for k, m in enumerate(["a", "b"]) for i in range(400)] + [("c", 0, 1.5), ("d", 0, None)]
    df = spark.createDataFrame(rows, "model string, id int, value double")
    got = {r["model"]: r for r in reports.large_bootstrap(df, 2000, 42, ["model"], cell_values=50).collect()}
    other = {r["model"]: r for r in reports.replayed_bootstrap(df.where("value is not null"), 2000).collect()}
    assert set(got) == {"a", "b", "c"} and (got["c"]["low"], got["c"]["high"], got["c"]["n"]) == (1.5, 1.5, 1)
    for m, k in (("a", 0), ("b", 1)):
        width = 4 * (1 + k) / 20
        assert abs(got[m]["low"] - other[m]["low"]) < 0.15 * width and abs(got[m]["high"] - other[m]["high"]) < 0.15 * width
    again = {r["model"]: tuple(r) for r in reports.large_bootstrap(df.repartition(3, "value"), 2000, 42, ["model"], cell_values=50).collect()}
    assert again == {m: tuple(r) for m, r in got.items()}
    whole = reports.large_bootstrap(df.where("model = 'a'").select("id", "value"), 500, 1).first()
    assert whole["low"] < whole["mean"] < whole["high"]


def test_large_bootstrap_of_many_cells(spark):
    """Thousands of cells, a third of them empty: the sums of plain draws over all sizes, for a group without a name too, in time that
    grows with the values (sizes were looked up by every cell for every other, by a search each)."""
    sizes = {"a": 7000, None: 300, "b": 1}
    df = spark.createDataFrame([(m, i, float(i * i % 1009)) for m, n in sizes.items() for i in range(n)], "model string, id int, value double")
    began = time.monotonic()
    got = {r["model"]: r for r in reports.large_bootstrap(df, 40, 42, ["model"], cell_values=1).collect()}
    took = time.monotonic() - began
    cells = {}
    for r in df.select("model", "id", "value", F.pmod(F.xxhash64("id", F.lit(42)), F.when(F.col("model") == "a", 7000).when(F.col("model") == "b", 1).otherwise(300)).alias("cell")).orderBy("id").collect():
        cells.setdefault(r["model"], {}).setdefault(r["cell"], []).append(r["value"])
    for m, n in sizes.items():
        counts, total = np.array([len(cells[m].get(c, ())) for c in range(n)]), np.zeros(40)
        assert n == 1 or (counts == 0).sum() > n / 4
        for c, own in cells[m].items():
            rng = np.random.default_rng([42, 0, c])
            total += [np.array(own)[rng.integers(0, len(own), k)].sum() for k in reports.draws_of_cell(counts, c, 40, 42)]
        means = sorted(total / n)
        assert (got[m]["n"], got[m]["low"], got[m]["high"]) == (n, pytest.approx(means[0], abs=2e-6), pytest.approx(means[38], abs=2e-6)), m
    assert took < 60, took


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=20))
def test_allotted_in_spark(spark, counts):
    got = spark.createDataFrame([(n,) for n in counts], "n bigint").select("n", splits.allotted(F.col("n"), (0.6, 0.2, 0.2)).alias("x"), splits.allotted(F.col("n"), (0.5, 0.5)).alias("y")).collect()
    for r in got:
        assert r["x"] == splits.allocated(r["n"], (0.6, 0.2, 0.2)) and r["y"] == splits.allocated(r["n"], (0.5, 0.5))


def test_layers_of_nothing(spark):
    none = spark.createDataFrame([], "c int, layer int, a array<int>, d array<int>")
    assert features.layers_of(none, ["c"], "a", "d").count() == 0


def test_judged_as_sql_says(spark, monkeypatch):
    """AUC, best F1 and Brier skill of stored scores against DuckDB over the same rows."""
    import duckdb
    import pandas as pd

    from credence.plans import further

    rng = random.Random(12)
    rows = [(float(rng.random() < 0.4), round(rng.random() * rng.random(), 2)) for _ in range(900)]
    monkeypatch.setattr(probes, "scores", lambda model, test, trees=None: test)
    got = further._judged(None, spark.createDataFrame(rows, "y double, score double")).first()
    t = pd.DataFrame(rows, columns=["y", "score"])  # noqa: F841
    auc, bss = duckdb.sql("SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), (SELECT 1 - avg((y - score) ** 2) / (avg(y) * (1 - avg(y))) FROM t) FROM t p JOIN t n ON p.y = 1 AND n.y = 0").fetchall()[0]
    f1 = duckdb.sql("SELECT max(2.0 * tp / (2 * tp + fp + fn)) FROM (SELECT k, count(*) FILTER (score >= k / 10 AND y = 1) AS tp, count(*) FILTER (score >= k / 10 AND y = 0) AS fp, count(*) FILTER (score < k / 10 AND y = 1) AS fn FROM t, range(1, 10) r(k) GROUP BY k)").fetchall()[0][0]
    assert (got["auc"], got["bss"], got["f1"]) == (pytest.approx(auc, abs=1e-8), pytest.approx(bss, abs=1e-8), pytest.approx(f1, abs=1e-8))


def test_blocks_of_many_rows_at_once():
    """Rows that are aligned together have the blocks, labels and insertions that each has by itself, empty and null ones among them."""
    draw = random.Random(21)
    rows = []
    for size in [0, 1, 5, 40, 0, 300] * 20:
        a = [str(draw.randrange(draw.choice([2, 9, 500]))) for _ in range(size)]
        rows.append((a, [x for x in a if draw.random() > 0.15] + ["end"] * draw.randrange(2)))
    ends = [np.cumsum([0, *[len(r[k]) for r in rows]]) for k in (0, 1)]
    x, y = alignment.numbered([w for a, _ in rows for w in a], [w for _, b in rows for w in b])
    got = alignment.blocks_in(x, y, np.stack([ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:]]))
    assert [tuple(c) for c in got.T.tolist()] == [(i + ends[0][r], j + ends[1][r], n) for r, (a, b) in enumerate(rows) for i, j, n in alignment.matching_blocks(a, b)]
    left, right = (pa.array([*[r[k] for r in rows], *([None, ["a"]][:: 1 - 2 * k])], pa.list_(pa.string())) for k in (0, 1))
    cuts = [(len(b) // 3, len(a) // 2, len(a)) for a, b in rows] + [(0, 0, 0)] * 2
    made = arrow._labels(left, right, [pa.array(c) for c in zip(*cuts, strict=True)]).to_pylist()
    assert made == [*[arrow.difference_labels(a, b, o, (s, e)) for (a, b), (o, s, e) in zip(rows, cuts, strict=False)], None, None]


def test_labelled_candidates_aligns_once(spark, tmp_path):
    """Labels are made once, and counted by line before they are shuffled: no row for each token is sorted."""
    texts = [" ".join(f"w{(i * k) % 13}" for i in range(k)) for k in (1, 9, 45, 160)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = further.labelled_candidates(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Window" not in plan and "Join" not in plan
    want = []
    for d, t in enumerate(texts):
        a = t.split(" ")
        start = len(a) // 4
        ok = arrow.difference_labels(a, [w for i, w in enumerate(a) if i % 7 != 3], sum(i % 7 != 3 for i in range(start)), (start, len(a)))
        lines = [ok[i : i + 10] for i in range(0, len(a), 10)]
        if any(all(x) for x in lines):
            want.append((d, len(a), sum(len(x) for x in lines if all(x))))
    assert sorted(map(tuple, found.collect())) == want


def test_labels_from_fixes_shuffles_lines_only(spark, tmp_path):
    """Program and fix are made in one row, without a join of whole texts, and tokens are counted by line before a shuffle: the totals are those of the labels."""
    texts = ["", "one two", *(" ".join(f"w{(i * k) % 11}" + ("." if i % 9 == 8 else "") + ("\n" if i % 12 == 11 else "") for i in range(k)) for k in (30, 70, 200))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    real, programs.stored = programs.stored, lambda rows, name: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), real(rows, name))[1]
    try:
        got = {r["doc_id"]: r for r in programs.labels_from_fixes(spark, str(tmp_path)).collect()}
    finally:
        programs.stored = real
    assert len(seen) == 1 and "Join" not in seen[0] and seen[0].count("Exchange") == 1
    for d, t in enumerate(texts):
        s = t.replace(". ", " # ") + '\n"""' + t + '"""\nx = 1'
        p = [w + " " for w in s.split(" ")]
        q = [x for i, w in enumerate(p) for x in ([] if i % 7 == 3 else [w, "more "] if i % 11 == 5 else [w])]
        ends = [np.cumsum([0, *map(len, x)]) for x in (p, q)]
        m, n = (spans.masked("".join(x), e[:-1], e[1:]) for x, e in zip((p, q), ends, strict=True))
        line = ["".join(p)[:a].count("\n") + 1 for a in ends[0][:-1]]
        ok, _, inserts = arrow.labels_from_fix(p, q, m, n)
        code = sorted({x for x, k in zip(line, m, strict=True) if not k})
        asked = {line[i] if i < len(line) else line[-1] + 1 for i in inserts}
        bad = {min((c for c in code if c >= x), default=code[-1]) for x in asked if code} | {x for x, k, y in zip(line, m, ok, strict=True) if not k and not y}
        want = (len(p), sum(bool(k) or x not in bad for x, k in zip(line, m, strict=True)), int(m.sum()), len(bad), len(bad) >= 4, not set(code) - bad)
        assert tuple(got[d])[1:] == want


def test_selections_in_rows_are_those_of_tables(spark, tmp_path):
    """Selections over arrays of tokens and leaves equal those over tables of both; the query shuffles whole texts only."""
    texts = ["", "x", "#", "a b", "1 + 2 # c\n", "if x : y = f( 'one two' ) # d. e\n  z", " ", "\n\n 3 * 4", "w " * 40 + '"""doc', "f'{a} b' + 1 2 3 4 5 6 7"]
    p = F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit(" ")))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("doc_id", p.alias("p"))
    rows = rows.select("doc_id", "p", F.array_join("p", "").alias("s"), spans.spans_from("p").alias("o")).select("doc_id", "p", spans.leaves("s", "o").alias("leaves"))
    entropy = lambda w: F.pmod(F.xxhash64(w), F.lit(5)) / 5.0
    tokens = rows.select("doc_id", F.posexplode("p").alias("pos", "w")).select("doc_id", "pos", entropy(F.col("w")).alias("score"))
    found = rows.select("doc_id", F.explode("leaves").alias("x")).select("doc_id", "x.*")
    kept = selection.without_kinds(tokens, found, ["doc_id"])
    want = [{(r["doc_id"], r["pos"]) for r in t.collect()} for t in (selection.first_leaves(tokens, found, ["doc_id"]), kept, selection.top_scored(kept, ["doc_id"], k=4))]
    inside = rows.select("doc_id", F.transform("p", lambda w, i: F.struct(i.alias("pos"), entropy(w).alias("score"))).alias("tokens"), "leaves")
    left = selection.without_kinds_in(F.col("tokens"), F.col("leaves"))
    made = inside.select("doc_id", selection.first_leaves_in(F.col("tokens"), F.col("leaves")).alias("a"), F.transform(left, lambda t: t["pos"]).alias("b"), selection.top_scored_in(left, "score", 4).alias("c")).collect()
    for k, own in enumerate(want):
        got = [(r["doc_id"], pos) for r in made for pos in r[k + 1]]
        assert len(got) == len(own) and set(got) == own
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = programs.leaf_selections(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
