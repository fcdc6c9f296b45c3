import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from credence.llm import minhash, simhash
from credence.llm.common import Words, shingle_hashes, texts_of
from credence.llm.components import components

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ODD = ["", " ", "\t\n", "One", "Two words", "É é ÀB  c d\x0be", "a b c d e f", "a  b\nc d e f", None]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, k):
    w = words(text)
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(text):
    s = shingles(text, 3)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t 中", max_size=30), max_size=6))
def test_words_and_fingerprints(texts):
    block = texts_of(pa.array(texts, pa.string()))
    got = Words(block)
    for i, t in enumerate(texts):
        own = [bytes(got.data[a:b]).decode() for a, b in zip(got.starts[got.first[i] : got.first[i + 1]], got.ends[got.first[i] : got.first[i + 1]], strict=True)]
        assert own == words(t)
    assert simhash.fingerprints_of(block).tolist() == [fingerprint(t) for t in texts]
    h, first = shingle_hashes(got, 3)
    assert np.diff(first).tolist() == [len(shingles(t, 3)) for t in texts]


def brute(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_simhash_components(docs):
    draw = random.Random(3)
    base = [" ".join(draw.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(60)) for _ in range(12)]
    texts = [*ODD, *base, *base[:4], *[b.rsplit(" ", 1)[0] + " zz" for b in base]]
    rows = list(enumerate(texts, start=5))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    want = brute([i for i, _ in rows], [fingerprint(t) for _, t in rows])
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["fp"] % (1 << 64) == fingerprint(dict(rows)[d]) for d, r in got.items())


@pytest.mark.parametrize("most", [2, 64])
def test_links_of_crowded_cells(spark, most):
    """A dense ball of fingerprints, compared pair by pair or by common neighbours: the same components."""
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(40)}
    centre = draw.getrandbits(64)
    while len(prints) < 240:
        x = centre
        for _ in range(draw.randrange(5)):
            x ^= 1 << draw.randrange(64)
        prints.add(x)
    prints |= {0, (1 << 64) - 1, 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.links(classes, most=most)).collect()}
    want = brute(signed, [p % (1 << 64) for p in signed])
    groups = {}
    for p, c in want.items():
        groups.setdefault(c, set()).add(p)
    for members in groups.values():
        assert {roots.get(p, p) for p in members} == {min(members)}


@pytest.mark.parametrize("segments", [4, 8, 16])
def test_cells_hold_every_close_pair(spark, segments):
    from pyspark.sql import functions as F

    draw = random.Random(segments)
    rows = []
    for k in range(60):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), k % 3):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    near = lambda c: (lambda pair: F.array_compact(F.array(*pair[1](pair[0]))))(simhash.cells_near(F.col(c), segments))
    assert all(r[0] for r in df.select(F.arrays_overlap(near("a"), near("b"))).collect())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 40)] + [(70, 71), (71, 70), (9, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1, 40), 1), 70: 70, 71: 70}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_deduplicated_keeps_one_row(docs):
    t = "some words that repeat in every copy of this text"
    rows = [(4, t), (2, t), (2, t), (9, "other words here entirely"), (7, None), (6, "")]
    got = simhash.deduplicated(docs(rows))
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 6, 9]
    assert got.columns == docs(rows).columns
    assert simhash.deduplicated(docs([])).count() == 0


def test_minhash_against_brute_force(docs):
    draw = random.Random(8)
    texts = [*ODD, *[" ".join(draw.choice("ab cd ef gh ij kl mn".split()) for _ in range(draw.randrange(1, 80))) for _ in range(30)]]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in minhash.compared(docs(rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    jaccard = lambda a, b: (lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y))(set(shingles(a, 5)), set(shingles(b, 5)))
    for (d, t), (d2, t2) in zip(order, order[1:] + order[:1], strict=True):
        t, t2 = t or "", t2 or ""
        e = t[: len(t) - len(t) // 3] + t2[: len(t) // 3]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(t, e), abs=0.27) and r["near_next"] == pytest.approx(jaccard(t, t2), abs=0.27)
        assert (r["fingerprint"] == got[d2]["fingerprint"]) == (set(shingles(t, 5)) == set(shingles(t2, 5))) or r["near_next"] > 0.9
    assert minhash.compared(docs([])).count() == 0
    assert minhash.compared(docs([(1, "a b")])).first()["near_next"] == 1.0


def test_minhash_at_many_partitions_and_odd_ids(spark, docs):
    """2,000 parts plan and run; repeated and null doc_ids and a very long text are rows like others."""
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(7, "a b c"), (7, "a b d"), (7, "a b c"), (None, "x y"), (None, None), (1, long), (9, "z"), (-4, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        parts = minhash._ordered(docs([(i, str(i)) for i in range(3000)]), 2000).select("part", "own", "doc_id").collect()
        ordered = sorted((r for r in parts if r["own"]), key=lambda r: -r["doc_id"])
        assert [r["doc_id"] for r in ordered] == list(range(2999, -1, -1))
        assert [r["part"] for r in ordered] == sorted(r["part"] for r in ordered) and len({r["part"] for r in ordered}) > 900
        got = minhash.compared(docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = [(9, "z"), (7, "a b d"), (7, "a b c"), (7, "a b c"), (1, long), (-4, ""), (None, "x y"), (None, "")]
    want = sorted((str(d), len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()) for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want


def test_hot_band_of_unlike_texts(docs):
    """Texts that share a long passage and many bands, in many small groups: divided by further bands, all groups are found, in no more than a few comparisons."""
    draw = random.Random(21)
    head = [f"h{i}" for i in range(120)]
    rows, want = [], {}
    for k in range(150):
        tail = [f"t{k}x{j}" for j in range(60)]
        for i in range(2):
            w = head + tail
            if i:
                w[draw.randrange(len(w))] = f"edit{k}"
            rows.append((2 * k + i, " ".join(w)))
            want[2 * k + i] = 2 * k
    sets = [set(shingles(t, 5)) for _, t in rows]
    assert all(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for i in range(0, 40, 2) for j in range(i))
    for levels in (0, 1, 2):
        found, roots = minhash.grouped(docs(rows), ["doc_id"], block=8, levels=levels)
        root = {r["fp"]: r["root"] for r in roots.collect()}
        least = {}
        for r in found.collect():
            least.setdefault(root.get(r["fp"], r["fp"]), []).append(r["doc_id"])
        assert {d: min(g) for g in least.values() for d in g} == want


def test_alike_against_pairs():
    draw = random.Random(12)
    for _ in range(60):
        sets = [np.unique(np.array(draw.sample(range(40), draw.randrange(0, 30)), np.int64)) for _ in range(draw.randrange(1, 14))]
        group = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if len(a & b) >= 0.5 * len(a | b) and group[i] != group[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
        assert minhash.alike(sets, 0.5).tolist() == group


@pytest.mark.parametrize("block", [2, 128])
def test_minhash_classes(docs, block):
    draw = random.Random(2)
    long = [[f"w{draw.randrange(9000)}" for _ in range(200)] for _ in range(6)]
    texts = [" ".join(w) for w in long] + [" ".join([*w[:190], "changed", *w[191:]]) for w in long[:3]] + [" ".join(long[0])] * 3 + [None, "", "x"]
    texts += [" ".join([*long[3][:k], "other", *long[3][k + 1 :]]) for k in range(20, 180, 20)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(list(enumerate(texts))), block=block).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0, 7: 1, 8: 2, 9: 0, 10: 0, 11: 0, 12: 12, 13: 12, 14: 14} | dict.fromkeys(range(15, 23), 3)
    assert minhash.near_duplicates(docs([])).count() == 0


def test_pipeline_stage_against_jaccard_pairs(spark, docs):
    """Near copies with J >= 0.8 over five words go, whatever their SimHash distance; those below stay."""
    import corpus_pipeline

    draw = random.Random(11)
    long = [[f"w{draw.randrange(9000)}" for _ in range(200)] for _ in range(8)]
    texts = [" ".join(w) for w in long]
    for w in long:
        for edits in (1, 2, 3, 9):
            changed = list(w)
            for at in draw.sample(range(len(w)), edits):
                changed[at] = f"x{at}"
            texts.append(" ".join(changed))
    sets = [set(shingles(t, 5)) for t in texts]
    group = list(range(len(texts)))
    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                wide += bin(fingerprint(texts[i]) ^ fingerprint(texts[j])).count("1") > 2
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert wide > 10
    got = corpus_pipeline.distinct(spark, docs(list(enumerate(texts))), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(group))


def test_full_bands_link_across_blocks(docs):
    """A band of many texts in several components: blocks of any size give the same classes."""
    head = " ".join(f"h{i}" for i in range(60))
    rows = [(100 * k + i, f"{head} {' '.join(f't{k}x{j}' for j in range(40))} end{i}") for k in range(3) for i in range(12)]
    want = {d: 100 * (d // 100) for d, _ in rows}
    for block in (3, 128):
        assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(rows), block=block).collect()} == want


@pytest.mark.parametrize("method", [simhash, minhash])
def test_deduplicated_keeps_a_row_of_each_group(docs, method):
    """Null doc_ids, and different texts of one doc_id, lose no group."""
    own = {k: " ".join(f"{k}{j}" for j in range(40)) for k in "abcdef"}
    rows = [(None, own["a"]), (None, own["b"]), (None, own["b"]), (3, own["c"]), (None, own["c"]), (4, own["d"]), (4, own["e"]), (2, own["d"]), (5, own["f"].upper()), (5, own["f"])]
    got = [(r["doc_id"], r["text"]) for r in method.deduplicated(docs(rows)).collect()]
    want = [(None, own["a"]), (None, own["b"]), (2, own["d"]), (3, own["c"]), (4, own["e"]), (5, own["f"].upper())]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprint_of_a_very_long_text():
    """More shingles than are counted at once."""
    draw = random.Random(9)
    text = " ".join(f"w{draw.randrange(500)}" for _ in range(70_000))
    assert simhash.fingerprints_of(texts_of(pa.array([text, "a b"]))).tolist() == [fingerprint(text), fingerprint("a b")]


def test_minhash_recall_on_a_hot_band(docs):
    """A passage shared by thousands of texts: near copies of each are found, at a recall of 0.9 at least, and nothing else is linked."""
    draw = random.Random(31)
    head = [f"h{i}" for i in range(40)]
    rows, want = [], 0
    for k in range(2500):
        tail = [f"t{k}x{j}" for j in range(30)]
        w = head + tail
        rows.append((4 * k, " ".join(w)))
        w = list(w)
        w[draw.choice([0, len(w) - 1])] = f"e{k}"
        rows.append((4 * k + 1, " ".join(w)))
    sets = [set(shingles(t, 5)) for _, t in rows[:60]]
    assert len(sets[0] & sets[2]) < 0.8 * len(sets[0] | sets[2]) and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(rows)).collect()}
    assert all(c // 4 == d // 4 for d, c in got.items())
    assert sum(got[d] == d - 1 for d in got if d % 4 == 1) >= 0.99 * 2500


def test_blocks_are_bounded_in_shingles(docs, monkeypatch):
    """Long texts count as several: those of one band are dealt out, and the classes stay the same."""
    monkeypatch.setattr(minhash, "TEXT_SHINGLES", 20)
    groups, links = [], minhash._links

    def counted(similarity):
        run = links(similarity)

        def group(key, rows):
            with open(path, "a") as f:
                f.write(f"{sum(len(x) for x in rows['shingles'])}\n")
            return run(key, rows)

        return group

    import tempfile

    path = tempfile.mktemp()
    monkeypatch.setattr(minhash, "_links", counted)
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"{base} end{i}") for i in range(40)] + [(100, "other words altogether and more of them"), (101, base + " x y z")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(rows), block=128).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 100: 100, 101: 0}
    groups = [int(x) for x in open(path)]
    assert len(groups) > 4 and max(groups) < 4 * 128 * 20 < 41 * 397


def test_simhash_classes_are_candidates(spark, docs, monkeypatch):
    """The pipeline's stage takes its candidates from SimHash's grid too: pairs that it links are found where they share no MinHash band, and verified."""
    import corpus_pipeline

    draw = random.Random(17)
    texts = []
    for _ in range(25):
        w = [f"w{draw.randrange(9000)}" for _ in range(500)]
        texts += [" ".join(w), " ".join([*w[:250], "changed", *w[251:]])]
    near = {i for i in range(0, 50, 2) if bin(fingerprint(texts[i]) ^ fingerprint(texts[i + 1])).count("1") <= 2}
    texts += ["a a a a a a a b", "a a a a a a a a a a a a a b c d"]
    table = docs(list(enumerate(texts)))

    def linked(classes):
        found, roots = minhash.grouped(table, ["doc_id"], rows=64, classes=classes)  # a single band
        root = {r["doc_id"]: r["root"] for r in found.join(roots, "fp").collect()}
        return {i for i in range(0, 52, 2) if i in root and root[i] == root.get(i + 1)}

    made = simhash.classes_of_rows(table)
    keyed, keys = simhash.row_keys(table)
    rows = {r["doc_id"]: r["class"] for r in keyed.join(made, keys).collect()}
    assert {i for i in range(0, 50, 2) if rows[i] == rows[i + 1]} == near and len(rows) == len(texts)
    assert near and not near <= linked(None) and near <= linked(made) and 50 not in linked(made)
    called = []
    monkeypatch.setattr(simhash, "classes_of_rows", lambda d, real=simhash.classes_of_rows: (called.append(d), real(d))[1])
    assert corpus_pipeline.distinct(spark, table, "").count() == 27 and called
