import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.llm import langid, ngram, quality
from credence.llm.common import texts_of

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def corpus(n, seed=1):
    draw = random.Random(seed)
    return [" ".join(draw.choice(["the", "Cat", "sat", "on", "mat", "dog,", "ran"]) for _ in range(draw.randrange(0, 40))) for _ in range(n)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [None]


def brute_kneser_ney(train, texts):
    c, b = collections.Counter(), collections.Counter()
    for t in train:
        x = tokens(t)
        c.update(x)
        b.update(zip([0, *x[:-1]], x, strict=True))
    n, v = sum(c.values()), len(c)
    left = collections.Counter(w for _, w in b)

    def off(counts):
        k = collections.Counter(counts)
        if min(k[i] for i in (1, 2, 3, 4)) == 0:
            return [0, 0.5, 1, 1.5]
        y = k[1] / (k[1] + 2 * k[2])
        d = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]]
        return [0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]

    d2, d1 = off(b.values()), off(left.values())
    follow = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in b.items():
        follow[a][min(k, 3)] += 1
    spare = sum(d1[min(k, 3)] for k in left.values()) / len(b) if b else 1.0
    total = {**c, 0: len(train)}

    def p(a, w):
        k = left.get(w, 0)
        low = max(k - d1[min(k, 3)], 0) / max(1, len(b)) + spare / (v + 1)
        if not total.get(a):
            return low
        k = b.get((a, w), 0)
        return max(k - d2[min(k, 3)], 0) / total[a] + sum(x * y for x, y in zip(d2, follow[a], strict=True)) / total[a] * low

    return [(len(x := tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), sum(math.log10(p(a, w)) for a, w in zip([0, *x[:-1]], x, strict=True))) for t in texts], lambda a: sum(p(a, w) for w in c) + p(a, "unseen word")


@pytest.mark.parametrize("train", [corpus(60), [], [None, ""], ["a b a b", "b a"]])
def test_ngram_scores(spark, docs, train):
    texts = [*corpus(5, 2), None, "", "never seen words", "the the the", "cat\x0bSAT"]
    at = ngram.train(docs(list(enumerate(train))))
    got = {r["doc_id"]: r for r in ngram.scored(docs(list(enumerate(texts))), at).collect()}
    want, mass = brute_kneser_ney(train, texts)
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], at["tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    if train and train[0]:
        assert mass(tokens(train[0])[0]) == pytest.approx(1) and mass(0) == pytest.approx(1)


def test_ngram_counts_above_the_stored_width(spark, docs, monkeypatch):
    at = ngram.train(docs([(1, "x " * 70_000)]))
    assert ngram.Model(at).pairs(*[np.array([ngram.tokens(texts_of(pa.array(["x x"])))[0][0]], np.uint64)] * 2).tolist() == [69_999]
    monkeypatch.setattr(ngram, "FLUSH", 8)  # many partial counts give the same
    few = ngram.train(docs(list(enumerate(corpus(40)))))
    assert few["tokens"] == sum(len(tokens(t)) for t in corpus(40))


def test_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    """Shards come by pyarrow's file systems, a few at a time, and are removed again."""
    monkeypatch.setattr(ngram, "OPEN_SHARDS", 3)
    far = ngram.Store(f"file://{tmp_path}", local=False)
    for i in range(8):
        far.put(f"words/{i}", [np.arange(i, dtype=np.uint64), np.full(3, i, np.int64), np.zeros(1, np.uint32), np.arange(3 * i, dtype=np.uint32)])
    for store in (far, ngram.Store(f"file://{tmp_path}")):
        for i in [*range(8), 0, 7]:
            a, b, c, d = store.get(f"words/{i}", ngram.WORDS)
            assert a.tolist() == list(range(i)) and b.tolist() == [i] * 3 and c.tolist() == [0] and d.tolist() == list(range(3 * i))
        assert store.get("words/9", ngram.WORDS) is None and len(store.open_) <= 3
    import os

    assert len(os.listdir(far.own.name)) <= 3 and sorted(os.listdir(f"{tmp_path}/words")) == [str(i) for i in range(8)]


def test_ngram_shards_follow_the_input(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, t) for i, t in enumerate(corpus(60))] * 2, "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    whole = ngram.scored(docs, few := ngram.train(docs)).collect()
    monkeypatch.setattr(ngram, "SHARD_BYTES", 100)
    again = ngram.scored(docs, many := ngram.train(docs)).collect()
    assert many["shards"] > few["shards"] and len(whole) == 120
    near = lambda rows: sorted((r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in rows)
    assert near(whole) == near(again)


def exact(word, number, p):
    """Log of the sum over all segmentations, place by place."""
    longest = max(map(len, number))
    alpha = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        parts = [alpha[i] + math.log(p[number[word[i:j]]]) for i in range(max(0, j - longest), j) if word[i:j] in number]
        top = max(parts)
        alpha[j] = top + math.log(sum(math.exp(x - top) for x in parts))
    return alpha[-1]


def test_forward_sums_all_segmentations(monkeypatch):
    pieces = langid.vocabulary(VOCABULARY)
    lattice, draw, chars = langid.Lattice(pieces), np.random.default_rng(0), random.Random(1)
    assert max(map(len, pieces)) > 16
    p = draw.dirichlet(np.ones(len(pieces)), 2).T
    number = {x: i for i, x in enumerate(pieces)}
    unspaced = "".join(chr(chars.randrange(0x4E00, 0x5200)) for _ in range(10_000))
    words = [b" the", b" " + "été".encode(), b" " + b"zq" * 12, b" a", max(pieces, key=len), b" " + unspaced.encode(), b" " + b"internationalisation" * 40]
    for cells in (langid.CELLS, 500):
        monkeypatch.setattr(langid, "CELLS", cells)
        for some in (words, words[:5]):
            got = langid.word_scores(some, lattice, p)
            for w, g in zip(some, got, strict=True):
                assert g.tolist() == pytest.approx([exact(w, number, p[:, lang]) for lang in (0, 1)], rel=1e-9)


def test_expected_counts_are_those_of_all_segmentations():
    """Against listing every segmentation of short words."""
    pieces = langid.vocabulary(VOCABULARY)
    lattice, p = langid.Lattice(pieces), np.random.default_rng(2).dirichlet(np.ones(len(pieces)))
    number = {x: i for i, x in enumerate(pieces)}

    def ways(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in number:
                for rest in ways(word[k:]):
                    yield [number[word[:k]], *rest]

    words, counts, want = [b" then", b" other", b" \xc3\xa9t"], np.array([3.0, 1.0, 2.0]), np.zeros(len(pieces))
    for w, n in zip(words, counts, strict=True):
        every = [(s, np.prod(p[s])) for s in ways(w)]
        for s, weight in every:
            np.add.at(want, s, n * weight / sum(x for _, x in every))
    assert langid.expected_counts(words, counts, lattice, np.log(p)) == pytest.approx(want, rel=1e-9, abs=1e-12)


def labelled(seed):
    draw = random.Random(seed)
    say = {"en": ["the", "cat", "with", "house", "and"], "de": ["der", "Katze", "mit", "Häuser", "und"], "fr": ["le", "chat", "avec", "maison", "été"]}
    return [(i, " ".join(draw.choice(say[k]) for _ in range(draw.randrange(5, 30))), k) for i, k in enumerate([*say] * 30)]


def test_language_id(docs):
    rows = labelled(1)
    langs, logp = langid.train(docs(rows), VOCABULARY)
    assert langs == ["de", "en", "fr"] and np.exp(logp).sum(axis=0) == pytest.approx(np.ones(3))
    test = [*labelled(2), (900, None, "en"), (901, "", "en"), (902, "12 %% ! —", "en"), (903, "é", "fr"), (904, "x" * 200_000, "en"), (905, "中文", "en")]
    got = {r["doc_id"]: r for r in langid.predict(docs(test), langs, logp, VOCABULARY).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in labelled(2)) >= 88
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(got[i]["lang_pred"] in langs and 0 <= got[i]["score"] <= 1 for i in (903, 904, 905))
    assert langid.predict(docs([]), langs, logp, VOCABULARY).count() == 0
    doubled = {r["doc_id"]: r for r in langid.predict(docs(test * 2), langs, logp, VOCABULARY).collect()}
    assert doubled == got and langid.predict(docs(test * 2), langs, logp, VOCABULARY).count() == 2 * len(test)


def test_posteriors_against_brute_force(docs):
    """The whole query on a small table: every text's score from sums over all segmentations, place by place."""
    langs, logp = langid.train(docs(labelled(1)), VOCABULARY)
    number = {x: i for i, x in enumerate(langid.vocabulary(VOCABULARY))}
    texts = ["der Hund und the dog", "unspacedmaison" * 9, "中文中文", "Été, 12 ÉTÉ!", "x"]
    got = {r["doc_id"]: r for r in langid.predict(docs(list(enumerate(texts))), langs, logp, VOCABULARY).collect()}
    for i, t in enumerate(texts):
        runs = re.findall(rb"[a-z\x80-\xff]+", t.translate(LOW).encode())
        total = np.array([sum(exact(b" " + r, number, np.exp(logp[:, k])) for r in runs) for k in range(len(langs))])
        k = int(total.argmax())
        assert got[i]["lang_pred"] == langs[k] and got[i]["score"] == pytest.approx(1 / np.exp(total - total[k]).sum())


def test_language_id_without_labels(docs):
    langs, logp = langid.train(docs([(1, None, None), (2, "x", None)]), VOCABULARY)
    assert langs == [] and langid.predict(docs([(1, "some text")]), langs, logp, VOCABULARY).first()["lang_pred"] == "und"


def test_quality(spark, docs):
    draw = random.Random(9)
    common = [f"w{k}" for k in range(400)]
    rows, marks = [], []
    for i in range(900):
        words = [draw.choice(common) for _ in range(60)]
        if i % 9 == 0:
            words[draw.randrange(60)] = draw.choice(["nasty", "vile"])
        if i % 9 == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 9 != 1), int(i % 9 == 0)))
    labels = spark.createDataFrame([m for m in marks if m[0] < 700] + [(5000, 1, 1), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    model = quality.train(docs(rows), labels)
    got = {r["doc_id"]: r for r in quality.scored(docs([*rows, (2000, None), (2001, ""), (2002, "w1 " * 90_000)]), *model).collect()}
    right = [(got[i]["p_good"] >= quality.KEEP) == (i % 9 > 1) for i in range(700, 900)]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["p_good"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values()) and len(got) == 903
    again = quality.train(docs(rows).repartition(7), labels)
    assert (again[0] == model[0]).all()  # whatever the order of rows
    assert quality.scored(docs([]), *model).count() == 0


def test_a_document_rated_twice_counts_once_with_the_least(spark, docs):
    rows = [(i, f"good words here {i}") if i % 2 else (i, f"nasty words here {i}") for i in range(200)]
    once = [(i, int(i % 2), 0) for i in range(200)]
    make = lambda x: spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")
    want = quality.train(docs(rows), make(once))
    got = quality.train(docs(rows), make(once + [(0, 1, 0), (2, 1, None), (1, 1, 0)]))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_quality_query_against_its_formula(spark, docs):
    """Every document's grade from the model's weights, document by document."""
    rows = [(i, f"{'GOOD' if i % 3 else 'bad!!'} text number {i} " * (1 + i % 4)) for i in range(300)] + [(900, None), (901, ""), (902, "a " * 5000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 6 == 0)) for i in range(250)], "doc_id bigint, quality int, toxic int")
    weights, cuts = quality.train(docs(rows), labels)
    got = {r["doc_id"]: r for r in quality.scored(docs(rows), weights, cuts).collect()}
    for i, t in rows:
        buckets, _ = quality.features(texts_of(pa.array([t], pa.string())))
        s = float(np.float32(weights)[buckets].astype(float).sum())
        above = [1 - 1 / (1 + math.exp(-(c - s))) for c in cuts]
        assert got[i]["expected_grade"] == pytest.approx(sum(above)) and got[i]["p_good"] == pytest.approx(above[-1])


def test_quality_without_labels(spark, docs):
    model = quality.train(docs([(1, "x")]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert quality.scored(docs([(1, "x")]), *model).first()["p_good"] == pytest.approx(1 / 3)


def test_crc_of_doc_id_as_text(spark):
    from credence.llm.common import crc_mod

    got = spark.range(50).select(crc_mod(F.col("id"), 10).alias("m")).collect()
    assert [r["m"] for r in got] == [zlib.crc32(str(i).encode()) % 10 for i in range(50)]


def test_a_task_passes_over_the_shards_once(spark, docs, monkeypatch):
    """With 1 000 shards, in a store that is not mounted and of which 40 may be there at once, none is fetched twice a pass; scores don't
    depend on how much a pass holds."""
    monkeypatch.setattr(ngram, "shards_for", lambda size, least: 1000)
    monkeypatch.setattr(ngram, "OPEN_SHARDS", 40)
    texts = corpus(300)
    df = docs(list(enumerate(texts)))
    at = ngram.train(df)
    assert at["shards"] == 1000
    model = ngram.Model(at)
    model.store = ngram.Store(at["folder"], local=False)
    opened, mapped = [], model.store._mapped
    model.store._mapped = lambda name: opened.append(name) or mapped(name)
    blocks = [ngram.tokens(texts_of(pa.array(texts[i : i + 30]))) for i in range(0, 300, 30)]
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in blocks]))])
    found = model.scores(np.concatenate([w for w, _ in blocks]), first)
    assert 40 < len(opened) == len(set(opened)) <= at["shards"] + at["parts"]
    whole = {r["doc_id"]: r["score"] for r in ngram.scored(df, at).collect()}
    small = {r["doc_id"]: r["score"] for r in ngram.scored(df, at, held_tokens=50).collect()}
    assert whole == small == dict(enumerate(found["score"].tolist()))


def test_shards_widen():
    assert [ngram.shards_for(x, 8) for x in (0, 1 << 30, 1 << 37, 1 << 40, 100 << 40)] == [8, 64, 8192, 8192, 819200]
