import os
import re

import pytest

import corpus_pipeline
from credence.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def survivors(texts):
    """The smallest doc_id of each group of texts linked by a Jaccard similarity of 0.8 or more over five-word shingles, pair by pair."""
    ids = sorted(texts)
    sets = [shingles(texts[d]) for d in ids]
    group = {d: d for d in ids}
    for i, a in enumerate(ids):
        for j, b in enumerate(ids[:i]):
            both = len(sets[i] & sets[j])
            if (sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return set(group.values())


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        docs.write.parquet(path := f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= ids
        if name == "language_id":  # every text with letters has a language here
            assert now == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
        if name == "simhash_dedup":
            assert now == survivors(before)
        if name == "quality":
            gone = ids - now
            assert sum(labels[d]["quality"] == 1 and labels[d]["toxic"] == 0 for d in gone if d in labels) <= 0.03 * len(labels)
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [4, None]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score string, lang_pred string, p_good string, k0 string, t string, k1 string, row_key_a string, root string, set_text string, piece string"


def odd_rows():
    prose = {"en": "the cat sat on the mat with a house and a dog that ran over the hill", "de": "der Hund lief mit der Katze über das Haus und die Wiese am Abend"}
    rows = [(i, f"{prose[k]} {i} {prose[k]}", k) for i, k in enumerate(["en", "de"] * 8)]
    rows += [(3, rows[3][1], "de"), (None, "und der Hund mit der Katze", "de"), (None, "the dog and the cat", None), (50, None, "en"), (51, "", "en"), (52, " \t", None), (53, "12 %%", "en"), (54, "the cat and the dog " * 60_000, "en")]
    return [(i, t, k, None, None, *["x"] * 11) for i, t, k in rows]


@pytest.mark.parametrize("rated", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, rated):
    """Nulls, empty and very long texts, repeated rows, clashing columns: no stage fails, and each keeps what it says."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    labels = [(i, 1, 0) for i in range(0, 16)] + [(3, None, None), (None, 1, 0)] if rated else []
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    named = stage["language_id"](spark, docs, str(tmp_path))
    assert named.columns == docs.columns and named.dtypes == docs.dtypes
    got = sorted(str(r["doc_id"]) for r in named.collect())
    assert got == sorted([*map(str, range(16)), "3", "None", "None", "54"])
    good = stage["quality"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and sorted(map(str, good.collect())) == sorted(map(str, docs.collect()))  # nothing speaks against any
    one = stage["simhash_dedup"](spark, docs, str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in one.collect() if r["doc_id"] is not None}
    whole = {}
    for i, t, *_ in odd_rows():
        if i is not None:
            whole[i] = t
    assert one.columns == docs.columns and set(left) == survivors(whole) and one.where("doc_id is null").count() == 2
    packed = stage["best_fit_packing"](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == docs.count()
    assert packed.where("doc_id = 50").select("length").collect() == [(1,)]


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_language_and_quality_stages_against_their_rules(spark):
    """Row by row: a document stays if what the operator says of its text alone meets the stage's rule."""
    import numpy as np
    import pyarrow as pa
    import public_tokenizers

    from credence.llm import langid, quality
    from credence.llm.common import texts_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    langs, logp = langid.train(docs, vocabulary)
    scorer = langid.Scorer(langs, logp, vocabulary)
    weights, cuts = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    named, kept = set(), set()
    for r in docs.collect():
        text = texts_of(pa.array([r["text"]], pa.string()))
        total = scorer.totals(text)[0]
        if any(c.isalpha() for c in r["text"] or "") and 1 / np.exp(total - total.max()).sum() >= corpus_pipeline.LEAST_SCORE:
            named.add(r["doc_id"])
        buckets, _ = quality.features(text)
        if 1 - 1 / (1 + np.exp(weights.astype(np.float32)[buckets].astype(float).sum() - cuts[-1])) >= quality.KEEP:
            kept.add(r["doc_id"])
    stage = dict(corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in stage["language_id"](spark, docs, SF).collect()} == named
    assert {r["doc_id"] for r in stage["quality"](spark, docs, SF).collect()} == kept


def test_registered_names():
    assert [sum(n.startswith(f"op{k}_") for n in queries.queries()) for k in range(1, 11)] == [1] * 10


def test_contract_columns(spark):
    want = {
        "op1_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op4_": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op5_": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op9_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    }
    for name, f in queries.queries().items():
        for prefix, columns in want.items():
            if name.startswith(prefix):
                assert {k: v for k, v in f(spark, SF).dtypes if k in columns} == columns


def test_texts_of_no_learned_language_go(spark):
    """Texts in a language that no row is labelled with go; clean ones stay, short ones and those without a label too."""
    import random

    rng = random.Random(3)
    words = {"en": "the water house garden people reading little before under music other time".split(), "de": "das Wasser Haus Garten Leute lesen klein bevor unter Musik andere Zeit".split(), None: "qzxv jkwq vvxz zzkq xqxj wqzk kjxv qqvz".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.choice([3, 30, 300])), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200 + i, text("en", 4), None, "s", 0) for i in range(5)] + [(300 + i, text(None, 40), None, "s", 0) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, df, SF).collect()}
    assert kept == set(range(120)) | set(range(200, 205))


def test_rows_without_ids_are_drawn_like_others(spark):
    from credence.llm import langid

    rows = [(None if i % 2 else 5, f"text {i}", "en") for i in range(2000)]
    drawn, sizes = langid._drawn(langid._known(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), 400)
    ids = [r["doc_id"] for r in drawn.collect()]
    assert sizes == {"en": 2000} and 300 < len(ids) < 500 and 120 < sum(i is None for i in ids) < 280
