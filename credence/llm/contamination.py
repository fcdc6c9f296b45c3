"""Passages of benchmarks in documents, by Wu and Manber's multi-pattern search over words (operator 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, map_texts, mix, sums_of_rows, texts_of, written

#: Words of a window; an item of fewer is one window.
WINDOW = 10

#: Words of a block of the shift and bucket tables, at most.
BLOCK = 3

#: Bytes of item texts, about, whose tables go to the workers in one pass over the documents; more take further passes.
PASS_BYTES = 16 << 20

#: Words of an item's text that one row of patterns holds; longer items are cut into stretches that share all but one word of a window.
STRETCH = 4096

#: What separates words, in texts whose A-Z are lower-cased.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Bytes that end a word, before lower-casing: all of ASCII but digits and letters.
NO_WORD = np.ones(256, dtype=bool)
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Positions of a text that one lane of the search walks through.
LANE = 64

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def block_codes(hashes: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """A code for the `size` words that end at each place of `last`; places before the first word wrap around."""
    code = np.zeros(len(last), np.uint64)
    for j in range(size):
        code += hashes[last - j] * _FACTORS[j]
    return mix(code)


def same_words(a: Words, at: np.ndarray, b: Words, bt: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` words from at[i] of a and from bt[i] of b are the same, byte for byte."""
    same = np.ones(len(at), bool)
    for j in range(size):
        own = np.flatnonzero(same)
        s, t = a.starts[at[own] + j], b.starts[bt[own] + j]
        n = a.ends[at[own] + j] - s
        same[own[n != b.ends[bt[own] + j] - t]] = False
        fits = same[own]
        own, s, t, n = own[fits], s[fits], t[fits], n[fits]
        pair = np.repeat(np.arange(len(own)), n)
        off = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        same[own[pair[a.data[s[pair] + off] != b.data[t[pair] + off]]]] = False
    return same


class Patterns:
    """Windows of one length with their tables: how far a block of words allows to go on, and buckets of windows by their last block.

    words: the items' words; first: where each distinct window starts in them.
    """

    def __init__(self, words: Words, first: np.ndarray, size: int):
        self.words, self.size, self.block = words, size, min(BLOCK, size)
        self.most = size - self.block + 1
        bits = max(10, int(np.ceil(np.log2(8 * max(1, len(first))))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.most, np.uint8)
        for j in range(self.block - 1, size):
            np.minimum.at(self.shift, (block_codes(words.hashes, first + j, self.block) >> self.down).astype(np.int64), np.uint8(size - 1 - j))
        keys = self.keys(words, first + size - 1)
        order = np.argsort(keys, kind="stable")
        self.bucket, self.first = keys[order], first[order]

    def keys(self, words: Words, last: np.ndarray) -> np.ndarray:
        """Buckets: half of the code of the last block of words, then half of the first one's."""
        half = np.uint64(32)
        return block_codes(words.hashes, last, self.block) >> half << half | block_codes(words.hashes, last - self.size + self.block, self.block) >> half

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of each occurrence in these texts, none across two of them."""
        n, none = len(words.hashes), np.zeros(0, np.int64)
        if n < self.size or not len(self.first):
            return none, none
        at = np.arange(self.size - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        ends = []
        while len(at):
            step = self.shift[(block_codes(words.hashes, at, self.block) >> self.down).astype(np.int64)]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        end = np.sort(np.concatenate(ends))
        end = end[words.rows[end] == words.rows[end - self.size + 1]]
        keys = self.keys(words, end)
        low, high = np.searchsorted(self.bucket, keys, "left"), np.searchsorted(self.bucket, keys, "right")
        times = high - low
        place = np.repeat(end, times) - self.size + 1
        window = np.repeat(low, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        same = same_words(words, place, self.words, self.first[window], self.size)
        return place[same], window[same]


class Search:
    """Windows of items, to be found in blocks of texts.

    ids: the items' ids as strings, null for items that have none, whose windows count as hits of no item; an id may come
    several times (stretches of one item).
    """

    def __init__(self, ids: list[str | None], texts: pa.Array, size: int = WINDOW):
        self.words = words = Words(texts, NO_WORD)
        self.ids = sorted({x for x in ids if x is not None}, key=str.encode)
        number = {x: i for i, x in enumerate(self.ids)}
        of_row = np.array([number.get(x, -1) for x in ids], np.int64)
        counts = np.diff(words.first)
        self.patterns: list[tuple[Patterns, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(counts, size)).tolist():
            rows = np.flatnonzero((counts >= size) if length == size else (counts == length))
            if not length:
                continue
            n = counts[rows] - length + 1
            start = np.repeat(words.first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, window = _distinct(words, start, length)
            made = Patterns(words, first, length)
            place = np.empty(len(first), np.int64)  # of each window among the sorted ones
            place[np.argsort(made.keys(words, first + length - 1), kind="stable")] = np.arange(len(first))
            items = np.unique(np.stack([place[window], of_row[words.rows[start]]]), axis=1)
            items = items[:, items[1] >= 0]
            self.patterns.append((made, *_sets(items, len(first))))
        self.sets = [(s, np.append(np.flatnonzero(np.diff(s[0], prepend=-1)), len(s[0]))) for _, _, s in self.patterns]

    def found(self, texts: pa.Array) -> dict:
        """n_words, hit: stretches of words within occurrences (first word, last word), items: ids of the items found, of each text."""
        words = Words(texts, NO_WORD)
        n, rows = len(words.hashes), len(texts)
        cover = np.zeros(n + 1, np.int32)
        pairs = [np.zeros((2, 0), np.int64)]
        for (made, set_of, _), (sets, first) in zip(self.patterns, self.sets, strict=True):
            place, window = made.occurrences(words)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + made.size, -1)
            own = np.unique(np.stack([words.rows[place], set_of[window]]), axis=1)
            own = own[:, own[1] >= 0]
            times = first[own[1] + 1] - first[own[1]]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs.append(np.unique(np.stack([np.repeat(own[0], times), sets[1][np.repeat(first[own[1]], times) + nth]]), axis=1))
        row, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
        hit = np.cumsum(cover[:-1]) > 0
        begins, stops = hit.copy(), hit.copy()
        begins[1:] &= ~hit[:-1] | (words.rows[1:] != words.rows[:-1])
        stops[:-1] &= ~hit[1:] | (words.rows[1:] != words.rows[:-1])
        a, b = np.flatnonzero(begins), np.flatnonzero(stops)
        own = words.rows[a]
        spans = pa.StructArray.from_arrays([pa.array(x - words.first[own]) for x in (a, b)], names=["first", "last"])
        listed = lambda of, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), values)
        ids = pa.array(self.ids, pa.string()).take(pa.array(item))
        return {"n_words": np.diff(words.first), "n_hit": sums_of_rows(hit.astype(float), words.first).astype(np.int64), "hit": listed(own, spans), "items": listed(row, ids)}


def _distinct(words: Words, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where distinct windows start, and the number of each window among these. Windows are told apart by a hash of their words, and
    those that share it with other words stay by themselves."""
    code = np.zeros(len(start), np.uint64)
    for j in range(size):
        code = mix(code * _FACTORS[0] + words.hashes[start + j])
    _, at, window = np.unique(code, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_words(words, start, words, start[at[window]], size))
    window[odd] = len(at) + np.arange(len(odd))
    return np.concatenate([start[at], start[odd]]), window


def _sets(pairs: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """From sorted (window, item): each window's number of a set of items, -1 for none, and the sets as sorted (set, item).

    Windows of the same passage have the same items, so there are few sets.
    """
    window, item = pairs
    first = np.searchsorted(window, np.arange(windows + 1))
    kinds: dict[bytes, int] = {}
    set_of = np.array([kinds.setdefault(item[a:b].tobytes(), len(kinds)) if b > a else -1 for a, b in zip(first, first[1:], strict=False)], np.int64)
    held = [np.frombuffer(x, np.int64) for x in kinds]
    return set_of, np.stack([np.repeat(np.arange(len(held)), [len(x) for x in held]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *held])])


_FOUND = "n_words bigint, n_hit bigint, hit array<struct<first:bigint,last:bigint>>, items array<string>"


def _pieces(benchmark: DataFrame, stretch: int) -> DataFrame:
    """The items' texts, cut into stretches of words where they are long."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.filter(F.split(low, SEPARATORS), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    step = stretch - WINDOW + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(step))
    return words.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.array_join(F.slice("w", F.col("at") + 1, stretch), " ").alias("text"))


def scan(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES, stretch: int = STRETCH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, hit, items.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. hit: the stretches of words (first, last, from
    0, inclusive) within occurrences of a window of an item, n_hit: their words; items: the ids of the items of which a window
    occurs, as strings, sorted. A null text has no words; an item without words has no window; one without item_id has windows
    that hit words, but is not listed; items that share an item_id are listed once. Repeated documents give a row each; empty
    tables give no rows or no hits; columns other than doc_id, text and item_id are not read.

    The tables of about `pass_bytes` of item texts go to the workers at once. A benchmark beyond that takes several passes over the
    documents, each with its own share of the items, of which only documents with hits leave rows to be merged.
    """
    spark = docs.sparkSession
    pieces = _pieces(benchmark, stretch).distinct()
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // pass_bytes)
    if passes <= 1:
        return _pass(docs, pieces)
    pieces = written(pieces.withColumn("nth", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))), "benchmark-pieces")
    rows = written(docs.select(F.struct(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("rid")), "decontaminated-rows")
    keyed = rows.select(F.col("rid").alias("doc_id"), "text")
    found = [_pass(keyed, pieces.where(F.col("nth") == i)).select(F.lit(i).alias("nth"), F.col("doc_id").alias("rid"), "n_words", "hit", "items") for i in range(passes)]
    every = found[0]
    for one in found[1:]:
        every = every.union(one.where(F.size("hit") > 0))
    every = every.groupBy("rid").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = every.withColumn("hit", merged(F.col("hit")))
    n_hit = F.aggregate("hit", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"] + 1)
    made = written(every.join(rows.select("rid", "doc_id"), "rid").select("doc_id.doc_id", "n_words", n_hit.alias("n_hit"), "hit", "items"), "decontaminated")
    for old in (pieces, rows):
        discard(old)
    return made


def merged(spans):
    """Sorted stretches (first, last) without overlaps: one begins where all before it have ended, and lasts until the next begins.

    Stretches that touch become one, as the words between hits decide.
    """
    before = F.transform(spans, lambda _, i: F.array_max(F.transform(F.slice(spans, 1, i), lambda x: x["last"])))
    begins = F.filter(F.transform(spans, lambda x, i: F.struct(x["first"].alias("first"), F.get(before, i).alias("before"))), lambda x: x["before"].isNull() | (x["first"] > x["before"] + 1))
    return F.transform(begins, lambda x, i: F.struct(x["first"].alias("first"), F.coalesce(F.get(begins, i + 1)["before"], F.array_max(F.transform(spans, lambda y: y["last"]))).alias("last")))


def _pass(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    held = pieces.select("item_id", "text").orderBy("item_id", "text").toArrow()  # at most about PASS_BYTES of text
    model = docs.sparkSession.sparkContext.broadcast((held["item_id"].to_pylist(), texts_of(held["text"])))
    made: list[Search] = []

    def found(texts):
        if not made:
            made.append(Search(*model.value))
        return made[0].found(texts)

    return map_texts(docs, "text", {"doc_id": "doc_id"}, found, _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns. Documents without doc_id stay, as there is nothing to tell them by."""
    hit = scan(docs.where("doc_id is not null"), benchmark).where("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"] == hit["_hit"], "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what scan() finds."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows and n-grams of whole texts, joined by their text.
SCAN_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT rid, i, size, item FROM grams JOIN windows USING (size, gram)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)"""
