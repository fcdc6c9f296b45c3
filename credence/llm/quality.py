"""Document quality by ordinal cumulative-link regression over hashed text (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, NO_LETTER, Words, map_texts, mix, raw_bytes, sums_of_rows

#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 18

#: Weights, one for each hash bucket.
BUCKETS = 1 << 20

#: Rated documents that the model is fitted on, at most (about: they are drawn by a hash of doc_id).
SAMPLE_DOCUMENTS = 20_000

#: Fitted documents that must hold a bucket for it to get a weight.
LEAST_DOCUMENTS = 4

#: Standard errors by which a bucket's share of documents below some grade must differ from that of all for it to get a weight.
LEAST_DEVIATION = 3.5

EPOCHS = 12
STEP = 0.3
RIDGE = 1e-5

#: A document stays if the probability of the best grade is at least this.
KEEP = 0.5

#: Neither letter, digit nor white space, in ASCII.
_NO_SYMBOL = np.ones(256, dtype=bool)
_NO_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum()]] = False
_UPPER, _DIGIT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True


def grade(quality, toxic):
    """0: toxic, 1: of low quality, 2: good; null where both ratings are null."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality.isNotNull() | toxic.isNotNull(), 2)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hash buckets of each text, row after row, and where each row's start.

    Runs of letters, runs of symbols, and the text's shape: shares of capitals, digits, symbols and distinct
    words, its words' mean length and its own length, each in steps.
    """
    n = len(texts)
    data, offsets = raw_bytes(texts)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask):
        sums = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    def hashed(ends_word: np.ndarray, seed: int = 0):
        """(row, bucket) of each run, as one number; the words go before the next kind of them is made."""
        words = Words(texts, ends_word)
        codes = mix(words.hashes + np.uint64(seed)) if seed else words.hashes
        return words.rows * BUCKETS + (codes % np.uint64(BUCKETS)).astype(np.int64)

    spaced = Words(texts, _SPACE)
    counts = np.diff(spaced.first)
    pairs = np.unique(spaced.hashes ^ mix(spaced.rows.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(spaced.rows[pairs], minlength=n) / np.maximum(counts, 1)
    del spaced, pairs
    width = size / np.maximum(counts, 1)
    shape = [share(_UPPER) * 20, share(_DIGIT) * 20, share(~_NO_SYMBOL) * 20, distinct * 10, np.minimum(width, 40) / 2, np.log2(size)]
    codes = [np.arange(n) * BUCKETS + (mix(x.astype(np.uint64) + np.uint64(1000 * (k + 1))) % np.uint64(BUCKETS)).astype(np.int64) for k, x in enumerate(shape)]
    keys = np.unique(np.concatenate([hashed(NO_LETTER), hashed(_NO_SYMBOL, 1), *codes]))
    return (keys % BUCKETS).astype(np.int32), np.searchsorted(keys, np.arange(n + 1) * BUCKETS)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(buckets: np.ndarray, first: np.ndarray, grades: np.ndarray, classes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of P(grade <= j) = sigmoid(threshold_j - score), by adaptive gradient steps.

    A document's score is the sum of its buckets' weights; only buckets that go with the grade get one.
    Without documents, all weights are 0 and the thresholds such that every grade is as likely.
    """
    cuts = np.log(np.arange(1, classes) / (classes - np.arange(1, classes)))
    weights = np.zeros(BUCKETS)
    n = len(grades)
    if not n:
        return weights, cuts
    share = np.cumsum(np.bincount(grades, minlength=classes))[:-1] + 1.0
    cuts = np.log(share / (n + classes - share))
    cuts = np.maximum.accumulate(cuts + np.arange(classes - 1) * 1e-3)
    rows = np.repeat(np.arange(n), np.diff(first))
    holding = np.bincount(buckets, minlength=BUCKETS)
    telling = np.zeros(BUCKETS, bool)
    for j in range(classes - 1):
        p = (grades <= j).mean()
        seen = np.bincount(buckets, (grades <= j)[rows], BUCKETS)
        telling |= np.abs(seen - p * holding) >= LEAST_DEVIATION * np.sqrt(np.maximum(p * (1 - p) * holding, 1e-9))
    telling &= holding >= LEAST_DOCUMENTS
    rows, kept = rows[telling[buckets]], buckets[telling[buckets]]
    starts = np.searchsorted(rows, np.arange(n + 1))
    seen, seen_cuts = np.full(BUCKETS, 1e-8), np.full(classes - 1, 1e-8)
    draw = np.random.default_rng(3)
    for _ in range(EPOCHS):
        order = draw.permutation(n)
        for a in range(0, n, 128):
            batch = order[a : a + 128]
            lengths = starts[batch + 1] - starts[batch]
            at = np.repeat(starts[batch] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            row, own = np.repeat(np.arange(len(batch)), lengths), kept[at]
            score = np.bincount(row, weights[own], len(batch))
            below = np.concatenate([np.zeros((len(batch), 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((len(batch), 1))], axis=1)
            slope = below * (1 - below)
            g, i = grades[batch], np.arange(len(batch))
            p = np.maximum(below[i, g + 1] - below[i, g], 1e-12)
            d_score = (slope[i, g + 1] - slope[i, g]) / p
            touched, which = np.unique(own, return_inverse=True)
            gradient = np.bincount(which, d_score[row], len(touched)) + RIDGE * len(batch) * weights[touched]
            seen[touched] += gradient**2
            weights[touched] -= STEP * gradient / np.sqrt(seen[touched])
            d_cuts = np.zeros(classes - 1)
            np.add.at(d_cuts, g[g < classes - 1], -(slope[i, g + 1] / p)[g < classes - 1])
            np.add.at(d_cuts, g[g > 0] - 1, (slope[i, g] / p)[g > 0])
            seen_cuts += d_cuts**2
            cuts = np.maximum.accumulate(cuts - STEP * d_cuts / np.sqrt(seen_cuts))
    return weights, cuts


def prior_of_best(cuts: np.ndarray) -> float:
    """The probability of the best grade of a document without any weighted bucket."""
    return float(1 - _sigmoid(cuts[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from rated documents: about `sample` of them, drawn by a hash of doc_id.

    Of several ratings of a document the smallest grade counts; rows without doc_id or rating are left out.
    """
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("g")).where("g is not null and doc_id is not null").groupBy("doc_id").agg(F.min("g").alias("g"))
    share = min(1.0, sample / max(1, rated.count()))
    drawn = rated.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_003)) / 1_000_003.0 < share)
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("g", "text")  # about `sample` ids and grades

    def hashed(texts):
        buckets, first = features(texts)
        return {"buckets": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets, pa.int32()))}

    rows = map_texts(chosen, "text", {"g": "g"}, hashed, "buckets array<int>", BLOCK_BYTES).toArrow()
    lists = rows["buckets"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    grades = rows["g"].to_numpy().astype(np.int64)
    buckets = lists.flatten().to_numpy()
    sizes = lists.value_lengths().to_numpy()
    parts = np.split(buckets, np.cumsum(sizes)[:-1]) if len(sizes) else []
    order = sorted(range(len(parts)), key=lambda i: (grades[i], parts[i].tobytes()))  # rows may come in any order
    buckets = np.concatenate([parts[i] for i in order]) if len(sizes) else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
    return fit(buckets, first, grades[order])


def scored(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray, keep: dict[str, str] | None = None) -> DataFrame:
    """expected_grade and p_good (the probability of the best grade) of every whole text; a null text counts as empty.

    Repeated rows get the same result each; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cuts))  # BUCKETS numbers: a fixed size

    def score(texts):
        w, c = model.value
        buckets, first = features(texts)
        s = sums_of_rows(w[buckets].astype(np.float64), first)
        above = 1 - _sigmoid(c[None, :] - s[:, None])
        return {"expected_grade": above.sum(axis=1), "p_good": above[:, -1]}

    return map_texts(docs, "text", keep or {"doc_id": "doc_id"}, score, "expected_grade double, p_good double", BLOCK_BYTES)
