"""Language identification by segmentation-marginalised unigrams (operator 7)."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE_VALUES, _INVERSE, NO_LETTER, Words, _powers, chunks, discard, map_texts, mix, release_memory, small_batches, sums_of_rows, texts_of, written

#: Labelled documents a language is learned from.
SAMPLE_DOCUMENTS = 2000

#: Rounds of expectation maximisation, and the count every piece has besides.
ROUNDS = 3
SMOOTHING = 0.01

#: Words a worker remembers before it starts anew.
CACHE_WORDS = 400_000

#: Bytes of words, padded, that are worked on at once, and words of them.
CELLS, MOST_WORDS = 400_000, 20_000

#: Places after which running sums are divided by the last, lest they underflow.
RESCALE = 8


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file that can stand in a run of letters, A-Z lower-cased, with a space before it, and every byte."""
    ok = ~NO_LETTER.copy()
    ok[65:91] = False
    found = {bytes([b]) for b in range(256) if ok[b] or b == 32}
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            body = token[1:] if token[:1] == b" " else token
            if body and all(ok[b] for b in body):
                found.add(token)
    return sorted(found)


class Lattice:
    """For a list of words: which piece, if any, stands at each place with each length."""

    def __init__(self, pieces: list[bytes]):
        self.tables, self.starts = {}, {}
        for size in sorted({len(p) for p in pieces}):
            own = [(i, p) for i, p in enumerate(pieces) if len(p) == size]
            h = self._hash(np.frombuffer(b"".join(p for _, p in own), np.uint8).reshape(-1, size))
            order = np.argsort(h)
            self.tables[size] = h[order], np.array([i for i, _ in own])[order]
            self.starts[size] = np.zeros(1 << 16, bool)  # which upper halves of halves occur: most places have no piece of a length
            self.starts[size][h >> np.uint64(48)] = True

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = h * np.uint64(_INVERSE) + _BYTE_VALUES[rows[:, j]]
        return mix(h * np.uint64(pow(_BASE, rows.shape[1] - 1, 1 << 64)))

    def find(self, rows: np.ndarray, lengths: np.ndarray) -> dict[int, np.ndarray]:
        """rows: the words' bytes, padded to one width. For each piece length, the piece's number at each place or -1."""
        n, width = rows.shape
        powers, down = _powers(width + 1)
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_BYTE_VALUES[rows] * powers[:width], axis=1, out=sums[:, 1:])
        found = {}
        for size, (keys, numbers) in self.tables.items():
            if size > width:
                break
            here = np.full((n, width - size + 1), -1, np.int32)
            inside = np.arange(width - size + 1) + size <= lengths[:, None]
            h = mix((sums[:, size:] - sums[:, :-size]) * down[: width - size + 1])[inside]
            number = np.full(len(h), -1, np.int32)
            likely = np.flatnonzero(self.starts[size][h >> np.uint64(48)])
            at = np.searchsorted(keys, h[likely])
            at[at == len(keys)] = 0
            number[likely] = np.where(keys[at] == h[likely], numbers[at], -1)
            here[inside] = number
            found[size] = here
        return found


@functools.lru_cache(maxsize=2)
def lattice_of(path: str) -> tuple[list[bytes], Lattice]:
    pieces = vocabulary(path)
    return pieces, Lattice(pieces)


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width), lengths


def batches_of(words: list[bytes]):
    """The words' numbers, from short to long, in batches of about CELLS padded bytes; together they are all words."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = min(MOST_WORDS, len(order) - at)
        while n > 1 and n * sizes[order[at + n - 1]] > CELLS:
            n = max(1, n // 2)
        yield order[at : at + n]
        at += n


def _starting(lattice: Lattice, rows: np.ndarray, lengths: np.ndarray):
    """For each place, in order, the pieces that start there: (place, [(size, rows, numbers)])."""
    longest, span = max(lattice.tables), max(64, CELLS // len(rows))
    for base in range(0, rows.shape[1], span):
        found = lattice.find(rows[:, base : base + span + longest - 1], lengths - base)
        for at in range(min(span, rows.shape[1] - base)):
            here = []
            for size, number in found.items():
                if at >= number.shape[1]:
                    break
                own = np.flatnonzero(number[:, at] >= 0)
                if len(own):
                    here.append((size, own, number[own, at]))
            yield base + at, here


def word_scores(words: list[bytes], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability in each language, over all its segmentations, whatever its length.

    p[piece, language] are probabilities. A forward pass: of all places, the sums of as many as the longest piece has
    bytes are held, divided by a common factor whose logarithm is kept.
    """
    made = np.zeros((len(words), p.shape[1]))
    slots = max(lattice.tables) + 1
    for part in batches_of(words):
        rows, lengths = padded([words[i] for i in part.tolist()])
        ring, logs = np.zeros((slots, len(part), p.shape[1])), np.zeros((len(part), p.shape[1]))
        ring[0] = 1
        done = 0
        for at, here in _starting(lattice, rows, lengths):
            now = ring[at % slots]
            for size, own, number in here:
                ring[(at + size) % slots, own] += now[own] * p[number]
            now[:] = 0
            reached = ring[(at + 1) % slots]
            to = int(np.searchsorted(lengths, at + 1, "right"))  # they go from short to long
            if to > done:
                made[part[done:to]] = np.log(reached[done:to]) + logs[done:to]
                done = to
            if (at + 1) % RESCALE == 0:
                by = np.where(reached > 0, reached, 1.0)
                ring /= by
                logs += np.log(by)
    return made


def expected_counts(words: list[bytes], counts: np.ndarray, lattice: Lattice, logp: np.ndarray | None) -> np.ndarray:
    """How often each piece is expected in the words, each as often as `counts` says, over all segmentations.

    Without probabilities, every place where a piece stands counts its length: to start with, longer pieces are as likely as they are frequent.
    """
    size_of = np.zeros(sum(len(n) for _, n in lattice.tables.values()))
    for size, (_, numbers) in lattice.tables.items():
        size_of[numbers] = size
    made = np.zeros(len(size_of))
    for part in batches_of(words):
        rows, lengths = padded([words[i] for i in part.tolist()])
        n, width, own_counts = len(part), rows.shape[1], counts[part]
        places = [(at, here) for at, here in _starting(lattice, rows, lengths)]
        if logp is None:
            for _, here in places:
                for size, own, number in here:
                    made += np.bincount(number, own_counts[own] * size, len(made))
            continue
        ahead, back = np.full((n, width + 1), -np.inf), np.full((n, width + 1), -np.inf)
        ahead[:, 0] = 0
        back[np.arange(n), lengths] = 0
        for at, here in places:
            for size, own, number in here:
                ahead[own, at + size] = np.logaddexp(ahead[own, at + size], ahead[own, at] + logp[number])
        for at, here in reversed(places):
            for size, own, number in here:
                back[own, at] = np.logaddexp(back[own, at], back[own, at + size] + logp[number])
        whole = ahead[np.arange(n), lengths]
        for at, here in places:
            for size, own, number in here:
                weight = np.exp(ahead[own, at] + logp[number] + back[own, at + size] - whole[own])
                made += np.bincount(number, weight * own_counts[own], len(made))
    return made


def _units(texts: pa.Array) -> tuple[Words, bytes]:
    words = Words(texts, NO_LETTER)
    return words, words.data.tobytes()


def _unit(words: Words, data: bytes, i: int) -> bytes:
    return b" " + data[words.starts[i] : words.ends[i]]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text): runs of letters, lower-cased, with a space before."""

    def counted(batches):
        for batch in batches:
            langs, all_texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in chunks(all_texts):
                words, data = _units(all_texts.slice(a, b - a))
                order = {x: i for i, x in enumerate(dict.fromkeys(langs[a:b]))}
                group = np.array([order[x] for x in langs[a:b]], np.int64)[words.rows]
                for name, g in order.items():
                    own = np.flatnonzero(group == g)
                    _, at, n = np.unique(words.hashes[own], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([_unit(words, data, i) for i in own[at].tolist()], pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])
        release_memory()

    small_batches(docs.sparkSession)
    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(counted, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(vocabulary_file: str, logp: dict[str, np.ndarray] | None):
    """Over rows (lang, word, n): each language's expected counts of pieces above 0, for this task's words."""

    def run(batches):
        _, lattice = lattice_of(vocabulary_file)
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, counts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().astype(float)
            words = batch.column(1).to_pylist()
            for name in dict.fromkeys(names):
                own = np.flatnonzero(names == name)
                found = expected_counts([words[i] for i in own.tolist()], counts[own], lattice, None if logp is None else logp[name])
                held[name] = found + held.get(name, 0.0)
        for name, found in held.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])], names=["lang", "piece", "n"])
        release_memory()

    return run


def train(labelled: DataFrame, vocabulary_file: str, sample: int = SAMPLE_DOCUMENTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each piece in each) from documents (doc_id, text, lang).

    Learns from about `sample` documents a language, drawn by a hash of doc_id and text, and all words of these, by expectation
    maximisation over segmentations: each round is one pass over the counted words in Spark, of which the driver gets
    a number for each piece and language. Rows without text or lang are left out.
    """
    drawn, sizes = _drawn(_known(labelled), sample)
    pieces, _ = lattice_of(vocabulary_file)
    if not sizes:
        return [], np.zeros((len(pieces), 0))
    counts = written(word_counts(drawn), "language-words")
    langs = sorted(sizes)
    logp = None
    for _ in range(rounds):
        rows = counts.select("lang", "word", "n").mapInArrow(_expected(vocabulary_file, logp), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        names, at, n = rows["lang"].to_numpy(zero_copy_only=False), rows["piece"].to_numpy(), rows["n"].to_numpy()
        logp = {}
        for lang in langs:
            expected = np.full(len(pieces), SMOOTHING)
            expected[at[names == lang]] += n[names == lang]
            logp[lang] = np.log(expected / expected.sum())
    discard(counts)
    return langs, np.stack([logp[x] for x in langs], axis=1)


#: A text is of no learned language if its best log-probability a byte of letters is below what is learned: so many standard deviations below
#: the mean of a language's documents, or so many times the mean, whichever is less, and by so much over the root of its bytes besides.
DEVIATIONS, TIMES, SHORT = 6.0, 2.0, 8.0


def _drawn(known: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """About `sample` documents of each language of known (doc_id, text, lang), and how many documents each has."""
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return known, sizes
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    return known.where(draw < share[F.col("lang")]), sizes


def _known(labelled: DataFrame) -> DataFrame:
    return labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))


def least_of(labelled: DataFrame, langs: list[str], logp: np.ndarray, vocabulary_file: str, sample: int = SAMPLE_DOCUMENTS) -> dict[str, float]:
    """For each language the least log-probability a byte that its texts have, by the documents that it was learned from."""
    if not langs:
        return {}
    drawn, _ = _drawn(_known(labelled), sample)
    found = predict(drawn, langs, logp, vocabulary_file, {"lang": "lang"}).where("lang = lang_pred and n_bytes > 0")
    rows = found.groupBy("lang").agg(F.avg("per_byte").alias("m"), F.stddev_pop("per_byte").alias("s")).collect()  # a row a language
    learned = {r["lang"]: min(r["m"] - DEVIATIONS * r["s"], TIMES * r["m"]) for r in rows}
    return {x: learned.get(x, -float("inf")) for x in langs}


def within_range(least: dict[str, float]):
    """Whether a row of predict() is within its language's learned range; true for `und`, which has none."""
    if not least:
        return F.lit(True)
    of = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.col("per_byte") >= of[F.col("lang_pred")] - SHORT / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1))), F.lit(True))


class Scorer:
    """Per-language log-probabilities of texts; words seen before come from a bounded memory."""

    def __init__(self, langs: list[str], logp: np.ndarray, vocabulary_file: str):
        _, lattice = lattice_of(vocabulary_file)
        self.langs, self.lattice, self.p = langs, lattice, np.exp(logp)
        self._forget()

    def _forget(self):
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))

    def totals(self, texts: pa.Array) -> np.ndarray:
        words, data = _units(texts)
        keys, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)) if len(self.keys) else np.arange(len(keys))
        if len(new):
            made = word_scores([_unit(words, data, i) for i in first[new].tolist()], self.lattice, self.p)
            self.scores = np.insert(self.scores, at[new], made, axis=0)
            self.keys = np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return sums_of_rows(self.scores[at][which], words.first)


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, vocabulary_file: str, keep: dict[str, str] | None = None) -> DataFrame:
    """lang_pred, score, n_bytes and per_byte of every whole text: the most probable language and its posterior under even priors; the
    bytes of its letters, and its log-probability in that language over these.

    `und` with score 0 for a null text, one without letters, or where no language was learned. Ties go to the
    language first in alphabetical order. Repeated rows get the same result each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((langs, logp.astype(np.float64)))  # pieces x languages: fixed by the vocabulary
    memory: dict = {}

    def scored(texts):
        if "scorer" not in memory:
            memory["scorer"] = Scorer(*model.value, vocabulary_file)
        s = memory["scorer"]
        total = s.totals(texts)
        words = Words(texts, NO_LETTER)
        pred, score = [], []
        ascii_letter = np.zeros(len(texts), bool)
        hit = words.data[words.starts] < 128
        ascii_letter[words.rows[hit]] = True
        n_bytes = sums_of_rows((words.ends - words.starts).astype(float), words.first)
        for i, ok in enumerate(ascii_letter.tolist()):
            ok = ok or (words.first[i + 1] > words.first[i] and any(c.isalpha() for c in texts[i].as_py()))
            if not ok or not s.langs:
                pred.append("und")
                score.append(0.0)
                continue
            k = int(total[i].argmax())
            pred.append(s.langs[k])
            score.append(float(1 / np.exp(total[i] - total[i][k]).sum()))
        best = total.max(axis=1) if s.langs else np.zeros(len(texts))
        return {"lang_pred": pred, "score": score, "n_bytes": n_bytes.astype(np.int64), "per_byte": best / np.maximum(n_bytes, 1)}

    return map_texts(docs, "text", keep or {"doc_id": "doc_id"}, scored, "lang_pred string, score double, n_bytes bigint, per_byte double")
