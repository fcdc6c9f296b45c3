"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.llm import audit, contamination, negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(doc, items):
    own, hit, found = words(doc), set(), set()
    for item_id, text in items:
        w = words(text)
        size = min(len(w), contamination.WINDOW)
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1) if size else ():
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= {str(item_id)} if item_id is not None else set()
    return len(own), sorted(hit), sorted(found)


def some_texts(seed, n, vocabulary, longest):
    rng = random.Random(seed)
    marks = [" ", ", ", "\n", ".\x00", " — ", "'"]
    return ["".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(longest))) for _ in range(n)]


ITEMS = [(7, "a b A, b a b a b a b a b"), (7, "x y"), (None, "b b b"), (9, None), (10, "..."), (11, "Été à la mer"), (12, "a"), (100, "b c d")]


def as_scan(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"], r["n_words"], sorted({p for s in r["hit"] for p in range(s["first"], s["last"] + 1)}), r["items"], r["n_hit"]) for r in rows)


@pytest.mark.parametrize("pass_bytes,stretch", [(1 << 24, 4096), (1 << 24, 12), (40, 12)])
def test_leaks_are_those_of_brute_force(spark, docs, pass_bytes, stretch):
    rng = random.Random(5)
    items = ITEMS + [(200 + i, t) for i, t in enumerate(some_texts(1, 30, ["a", "b", "c", "dd", "É", "7"], 40))]
    texts = some_texts(2, 60, ["a", "B", "c", "dd", "é", "7", "zz"], 120)
    texts += [rng.choice(items)[1] for _ in range(10)] + [None, "", "...", "x  Y", "a", "word " * 3000 + "x y"]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("w", F.lit("x")).withColumn("doc_id", F.lit(3))
    found = contamination.scan(docs(rows), benchmark, pass_bytes, stretch).collect()
    key = lambda x: repr(x)
    assert sorted(as_scan(found), key=key) == sorted(((i is not None, i, n, hit, ids, len(hit)) for i, t in rows for n, hit, ids in [leaks(t, items)]), key=key)
    for r in found:  # stretches are apart and in order
        spans = [(s["first"], s["last"]) for s in r["hit"]]
        assert all(a <= b for a, b in spans) and all(b + 1 < c for (_, b), (c, _) in itertools.pairwise(spans))


def test_leaks_of_nothing_and_digest(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.scan(docs([(1, "a b")]).limit(0), none).count() == 0
    (row,) = contamination.digest(contamination.scan(docs([(1, "a b")]), none)).collect()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"], row["items_sha256"]) == (2, 0, 0, False, hashlib.sha256(b"").hexdigest())
    items = spark.createDataFrame([(10, "one two"), (9, "two three")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in contamination.digest(contamination.scan(docs([(1, "One two. three"), (2, "two"), (None, "one two")]), items)).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["items_sha256"]) == (3, 2, hashlib.sha256(b"10,9").hexdigest())
    assert not got[2]["contaminated"] and got[None]["contaminated"]
    assert sorted(r["doc_id"] or 0 for r in contamination.clean(docs([(1, "One two. three"), (2, "two"), (None, "one two")]), items).collect()) == [0, 2]


def test_windows_that_share_a_hash_stay_apart():
    """Whatever the words' hashes are, only the same bytes are an occurrence."""
    search = contamination.Search(["1", "2"], pa.array(["ab cd", "ef gh"], pa.large_string()))
    made = contamination.Words(pa.array(["ab ce x", "ab cd"], pa.large_string()), contamination.NO_WORD)
    pattern = search.patterns[0][0]
    at = np.array([0, 3])
    assert contamination.same_words(made, at, search.words, np.array([0, 0]), 2).tolist() == [False, True]
    assert pattern.most == 1 and pattern.shift.max() == 1


def test_long_texts_skip_and_hot_passages():
    rng = np.random.default_rng(3)
    item = " ".join(f"w{x}" for x in rng.integers(0, 900, 60))
    search = contamination.Search([str(i) for i in range(3000)], pa.array([item] * 3000, pa.large_string()))  # one passage in all items
    text = " ".join(f"w{x}" for x in rng.integers(0, 900, 300_000)) + " " + item
    began = time.time()
    found = search.found(pa.array([text, None, item], pa.large_string()))
    assert time.time() - began < 20
    assert found["n_hit"].tolist() == [60, 0, 60] and found["n_words"].tolist() == [300_060, 0, 60]
    assert [len(x) for x in found["items"].to_pylist()] == [3000, 0, 3000]


def audited(rows, labels):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    flags, parts = [], {}
    for doc_id, text, lang in rows:
        text = text or ""
        w = split.findall(text)
        same = [i for i, t, _ in rows if i is not None and (t or "") == text]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and any(i < doc_id for i in same)}
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        flags.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
        parts[lang or ""] = 1
    out = {}
    for part in parts:
        own = [x for x in flags if x[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                kept = [x for x in left if not x[1][f]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def test_audit_is_that_of_brute_force(spark, docs):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(120))
    bodies = [long, long.upper(), "x " * 150, long + " #", "A B", "", None, "é" * 50 + " $", "Y" + "é" * 9, long + "\x0b", "YZ" + "é" * 18]
    rows = [(i if i % 11 else None, rng.choice(bodies), rng.choice(["en", "de", None, ""])) for i in range(150)] + [(3, long, "fr"), (3, long, "fr"), (900, "x " * 20_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(2, 1, 0), (None, 1, 1)]
    made = audit.audit(audit.flagged(docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit(1)).withColumn("A", F.lit("x"))))
    got = {(r["part"], r["filter_order"], r["step"]): [r[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in made.collect()}
    assert got == audited(rows, labels) and len(got) == 4 * 600


def test_audit_of_nothing_and_survivors_of_all_parts(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    flags = audit.flagged(docs([(1, "a", "en"), (2, "a", "de")]), none)
    assert audit.audit(flags.limit(0)).count() == 0
    every = {r["subset"]: r["n"] for r in audit.survivors(flags).where("all_parts").collect()}
    assert every[0] == 2 and every[0b10000] == 1 and 1 not in every  # both are short, one is a copy


def mined(rows, relabel):
    usable = [(i, relabel(i, lab), [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    usable = sorted({(i, lab, tuple(v)) for i, lab, v in usable})
    out = []
    for a, lab, v in usable:
        if a % 5:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=True))  # noqa: B023, E731
        ranked = sorted((-score(w), i, other == lab) for i, other, w in usable if i != a and len(w) == len(v))
        for s, p in [(-s, i) for s, i, own in ranked if own][: negatives.POSITIVES]:
            inside = [(i, -t) for t, i, own in ranked if not own and 50 * s <= -100 * t <= 95 * s]
            out += [(a, p, k, i, s, t) for k, (i, t) in enumerate(inside[: negatives.NEGATIVES], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_negatives_are_those_of_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) + (i % 3 == 0)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 1.0, 0.0, 0.0], i % 2) for i in range(60)]  # one vector, many times, with two labels
    rows += [(2000 + i, [0.1 * i, 1.0], i % 3) for i in range(30)]  # another length
    rows += [(3000, None, 1), (3005, [], 1), (3010, [float("nan"), 1.0], 1), (3015, [1.0, None], 1), (3020, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (3025, [0.0, 0.0], 2), (3030, [float("inf"), 0.0], 0), rows[5], rows[700]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("rank", F.lit("x")).withColumn("block", F.lit("x")).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 4).otherwise(F.col("label"))
    found = negatives.mined(df, F.col("vec_id") % 5 == 0, label, block)
    got = sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == mined(rows, lambda i, x: (x + 1) % 4 if i % 7 == 0 else x) and len(got) > 500


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mined(none, F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_hold_and_select():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-3000, 3000, (5000, 32)).astype(np.int32)
    block = negatives.Block(vectors, np.zeros(5000, np.int64), np.arange(5000)[:, None])
    query = rng.integers(-3000, 3000, 32).astype(np.float64)
    low, high = block.bounds(query, 0, 5000)
    exact = block.scores(query, np.arange(5000))
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= np.partition(low, -6)[-6]).sum() < 200  # few are measured
    assert block.own_label(query, 0, 6) == sorted(((int(s), int(i)) for s, i in zip(exact, block.ids[:, 0], strict=True)), key=lambda p: (-p[0], p[1]))[:6]
