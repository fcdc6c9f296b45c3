"""Interpolated modified Kneser-Ney bigram scores (operator 3).

Bigrams are counted in Spark and stored as sorted hash arrays in the shared folder, which workers map into memory.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from math import isqrt
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, input_bytes, mix, new_folder, release_memory, small_batches, texts_of

#: Tokens whose bigrams a task counts before it passes the counts on.
FLUSH = 1 << 22

#: Bytes of training text for each shard, about; beyond MANY_SHARDS shards they widen up to WIDE_BYTES before there are more of them.
SHARD_BYTES, MANY_SHARDS, WIDE_BYTES = 16 << 20, 8192, 128 << 20

#: Shards that a worker has mapped at once, and tokens whose bigrams a task looks up in one pass over the shards.
OPEN_SHARDS = 400
HELD_TOKENS = 1 << 21

#: The arrays of a shard of bigrams (upper and lower parts of the hash, count, large counts) and of words (hash, count, kinds of words before, kinds after by count).
BIGRAMS = (np.uint32, np.uint16, np.uint16, np.int64)
WORDS = (np.uint64, np.int64, np.uint32, np.uint32)

#: A context's bigrams are dealt over so many shards, so that no context fills one.
SPREAD = np.uint64(16)

END = np.uint64(0xE4D0E4D0E4D0E4D1)
BEGIN = np.uint64(0xB0B0B0B0B0B0B0B1)

_STATS = "kind int, figures array<bigint>"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and of one end after them, and where each text's tokens start."""
    words = Words(texts)
    counts = np.diff(words.first)
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    made = np.full(first[-1], END, dtype=np.uint64)
    made[np.arange(len(words.hashes)) + words.rows] = words.hashes
    return made, first


def contexts(made: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each, and BEGIN before a text's first."""
    before = np.empty_like(made)
    before[1:] = made[:-1]
    before[first[:-1]] = BEGIN
    return before


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) * np.uint64(3) + w)


def _shard(v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return (mix(v * SPREAD + mix(w) % SPREAD) % np.uint64(n)).astype(np.int64)


def _summed(keys: np.ndarray, *columns: np.ndarray):
    """Distinct keys in order, one place of each, and sums of the columns over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(c[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for c in columns]
    return keys[starts], order[starts], *sums


class Store:
    """A folder of shards, each one file of arrays, that workers map into memory.

    A folder of a mounted file system is mapped as it is. From any other store that pyarrow knows (hdfs, s3, gs, abfs), a
    worker fetches the shards that it needs into a folder of its own, which it removes; at most OPEN_SHARDS are there.
    """

    def __init__(self, folder: str, local: bool | None = None):
        self.folder, at = folder, urlparse(folder)
        self.local = at.scheme in ("", "file") if local is None else local
        self.base = at.path
        self.open_: OrderedDict[str, np.ndarray | None] = OrderedDict()
        self.own: tempfile.TemporaryDirectory | None = None
        if not self.local:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(folder)

    def put(self, name: str, arrays: list[np.ndarray]) -> None:
        """The arrays on end, each from a multiple of 8 bytes, after their lengths; a task that is run again replaces a file by the same."""
        data = [np.array([a.nbytes for a in arrays], np.int64).tobytes()]
        data += [np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays]
        path = f"{self.base}/{name}"
        part = f"{path}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(part, "wb") as f:
                f.writelines(data)
            os.replace(part, path)
            return
        self.fs.create_dir(os.path.dirname(path))
        with self.fs.open_output_stream(part) as f:
            for x in data:
                f.write(x)
        self.fs.move(part, path)

    def get(self, name: str, kinds: tuple) -> list[np.ndarray] | None:
        """A shard's arrays of these kinds, or None where there is none."""
        if name in self.open_:
            self.open_.move_to_end(name)
        else:
            while len(self.open_) >= OPEN_SHARDS:
                gone, _ = self.open_.popitem(last=False)
                if self.own:
                    with contextlib.suppress(FileNotFoundError):
                        os.remove(f"{self.own.name}/{gone.replace('/', '-')}")
            self.open_[name] = self._mapped(name)
        data = self.open_[name]
        if data is None:
            return None
        sizes = data[: 8 * len(kinds)].view(np.int64)
        found, at = [], 8 * len(kinds)
        for kind, n in zip(kinds, sizes.tolist(), strict=True):
            found.append(data[at : at + n].view(kind))
            at += n + -n % 8
        return found

    def _mapped(self, name: str) -> np.ndarray | None:
        path = f"{self.base}/{name}"
        if not self.local:
            from pyarrow import fs

            if self.fs.get_file_info(path).type == fs.FileType.NotFound:
                return None
            self.own = self.own or tempfile.TemporaryDirectory(prefix="ngram-")
            path, source = f"{self.own.name}/{name.replace('/', '-')}", path
            with self.fs.open_input_stream(source) as f, open(path, "wb") as out:
                shutil.copyfileobj(f, out)
        return np.asarray(np.memmap(path, np.uint8, "r")) if os.path.exists(path) else None


def _counter(shards: int):
    """Over texts: bigrams and their counts, packed, a row for each shard and FLUSH tokens."""

    def rows(parts):
        v, w = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        parts.clear()
        _, at, n = _summed(_pair(v, w), np.ones(len(v), np.int64))
        v, w = v[at], w[at]
        shard = _shard(v, w, shards)
        order = np.lexsort((v, shard))
        v, w, n, shard = v[order], w[order], n[order].astype(np.uint32), shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        own = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
        pack = lambda a: pa.array([a[cuts[i] : cuts[i + 1]].tobytes() for i in own], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pack(v), pack(w), pack(n)], names=["shard", "v", "w", "n"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts):
                made, first = tokens(texts.slice(a, b - a))
                parts.append((contexts(made, first), made))
                held += len(made)
                if held >= FLUSH:
                    yield rows(parts)
                    parts, held = [], 0
        if held:
            yield rows(parts)
        release_memory()

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _bigrams(folder: str, parts: int):
    """Merges a shard's counts, stores it, and passes on what its words need: (part, kind, h, x)."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        v, w, n = (_joined(rows[c], k) for c, k in (("v", np.uint64), ("w", np.uint64), ("n", np.uint32)))
        keys, at, n = _summed(_pair(v, w), n)
        v, w = v[at], w[at]
        large = np.flatnonzero(n >= 65535)
        Store(folder).put(f"bigrams/{shard:08d}", [(keys >> np.uint64(32)).astype(np.uint32), (keys >> np.uint64(16)).astype(np.uint16), np.minimum(n, 65535).astype(np.uint16), np.stack([large, n[large]])])
        words, _, count, left = _summed(w, n, np.ones(len(n), np.int64))
        heads, _, *follow = _summed(v, n == 1, n == 2, n >= 3)
        out: dict[str, list] = {"part": [-1], "kind": [2], "h": [b""], "x": [np.array([*((n == k).sum() for k in (1, 2, 3, 4)), len(n)], np.int64).tobytes()]}
        for kind, h, columns in ((0, words, (count, left)), (1, heads, follow)):
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for i in range(parts):
                own = order[cuts[i] : cuts[i + 1]]
                if len(own):
                    out["part"].append(i)
                    out["kind"].append(kind)
                    out["h"].append(h[own].tobytes())
                    out["x"].append(np.stack([c[own] for c in columns]).astype(np.uint32).tobytes())
        return pa.table(out, schema=pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("x", pa.binary())]))

    return run


def _words(folder: str):
    """Merges what shards say of a part's words, stores it, and returns its figures."""

    def run(rows: pa.Table) -> pa.Table:
        part, schema = rows["part"][0].as_py(), pa.schema([("kind", pa.int32()), ("figures", pa.list_(pa.int64()))])
        if part < 0:
            figures = np.sum([np.frombuffer(x, np.int64) for x in rows["x"].to_pylist()], axis=0)
            return pa.table({"kind": [2], "figures": [figures.tolist()]}, schema=schema)
        h, columns = [], [[] for _ in range(5)]
        for kind, a, x in zip(rows["kind"].to_pylist(), rows["h"].to_pylist(), rows["x"].to_pylist(), strict=True):
            a = np.frombuffer(a, np.uint64)
            x = np.frombuffer(x, np.uint32).reshape(-1, len(a))
            h.append(a)
            for i in range(5):
                j = i if kind == 0 else i - 2
                columns[i].append(x[j] if 0 <= j < len(x) and (i < 2) == (kind == 0) else np.zeros(len(a), np.uint32))
        keys, _, count, left, n1, n2, n3 = _summed(np.concatenate(h), *[np.concatenate(c) for c in columns])
        Store(folder).put(f"words/{part:08d}", [keys, count, left.astype(np.uint32), np.stack([n1, n2, n3]).astype(np.uint32)])
        known = left[count > 0]
        figures = [int(count.sum()), int((count > 0).sum()), *[int((known == k).sum()) for k in (1, 2, 3, 4)], int((known >= 3).sum())]
        return pa.table({"kind": [0], "figures": [figures]}, schema=schema)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 0, 1, 2 and 3 or more; a half of each where counts of counts are missing."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.95, 2.95])])


def shards_for(size: int, least: int) -> int:
    """Number of shards for so many bytes of training text."""
    return max(least, min(-(-size // SHARD_BYTES), max(MANY_SHARDS, -(-size // WIDE_BYTES))))


def train(texts: DataFrame, folder: str | None = None) -> dict:
    """Counts the bigrams of all texts (column `text`; null: empty) and stores the model; returns its place and totals.

    folder: where the model is to stay, in a store that driver and executors share; else it goes when the application ends.
    """
    spark = texts.sparkSession
    small_batches(spark)
    shards = shards_for(input_bytes(texts), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(shards, max(64, 8 * isqrt(shards)))  # a shard makes a row for each: far fewer than shards, where these are many
    folder = folder or new_folder(spark, "ngram")
    Store(folder)  # fails here, and not in every task, where the store is none that workers can write to
    counted = texts.select(F.col("text").cast("string")).mapInArrow(_counter(shards), "shard int, v binary, w binary, n binary")
    # a shard for each task: Spark would put several together
    shared = counted.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(_bigrams(folder, parts), "part int, kind int, h binary, x binary")
    figures = shared.groupBy("part").applyInArrow(_words(folder), _STATS).groupBy("kind").agg(*[F.sum(F.get("figures", F.lit(i))).alias(f"f{i}") for i in range(7)]).collect()
    words = next(([*r][1:] for r in figures if r["kind"] == 0), [0] * 7)
    pairs = next(([*r][1:6] for r in figures if r["kind"] == 2), [0] * 5)
    return {"folder": folder, "shards": shards, "parts": parts, "tokens": words[0], "types": words[1], "left": words[2:7], "pairs": pairs}


def _by_shard(shard: np.ndarray, key: np.ndarray):
    """(shard, places in order of the key) for each shard that occurs."""
    order = np.lexsort((key, shard))
    starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


class Model:
    """A stored model, mapped into memory as it is needed."""

    def __init__(self, at: dict):
        self.at, self.store = at, Store(at["folder"])
        self.pair_off = discounts(*at["pairs"][:4])
        m1, m2, _, _, m3 = at["left"]
        self.left_off = discounts(*at["left"][:4])
        self.all_pairs = max(1, at["pairs"][4])
        self.spare = float(np.dot(self.left_off[1:], [m1, m2, m3])) / self.all_pairs if at["pairs"][4] else 1.0

    def words(self, h: np.ndarray) -> np.ndarray:
        """Rows count, left, n1, n2, n3 of distinct hashes; zeros for unknown ones."""
        found = np.zeros((5, len(h)), np.int64)
        for i, own in _by_shard((h % np.uint64(self.at["parts"])).astype(np.int64), h):
            if table := self.store.get(f"words/{i:08d}", WORDS):
                keys, count, left, follow = table
                follow = follow.reshape(3, -1)
                at = np.minimum(np.searchsorted(keys, h[own]), len(keys) - 1)
                ok = keys[at] == h[own]
                own, at = own[ok], at[ok]
                found[0, own], found[1, own], found[2:, own] = count[at], left[at], follow[:, at]
        return found

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How often each w came after v."""
        key, shard = _pair(v, w), _shard(v, w, self.at["shards"])
        found = np.zeros(len(v), np.int64)
        for i, own in _by_shard(shard, key):
            if not (table := self.store.get(f"bigrams/{i:08d}", BIGRAMS)):
                continue
            high, low, n, large = table
            large = large.reshape(2, -1)
            want, check = (key[own] >> np.uint64(32)).astype(np.uint32), (key[own] >> np.uint64(16)).astype(np.uint16)
            at = np.searchsorted(high, want)
            while len(own):  # past others with the same upper half
                inside = at < len(high)
                own, at, want, check = own[inside], at[inside], want[inside], check[inside]
                same = high[at] == want
                own, at, want, check = own[same], at[same], want[same], check[same]
                hit = low[at] == check
                value = n[at[hit]].astype(np.int64)
                if (value == 65535).any():
                    big = value == 65535
                    value[big] = large[1][np.searchsorted(large[0], at[hit][big])]
                found[own[hit]] = value
                own, at, want, check = own[~hit], at[~hit] + 1, want[~hit], check[~hit]
        return found

    def scores(self, w: np.ndarray, first: np.ndarray) -> dict:
        """n_tokens, n_known, base_score and score of texts, given their tokens on end and where each text's start. Every shard that
        holds one of their words or bigrams is looked at once."""
        v = contexts(w, first)
        distinct, inverse = np.unique(np.concatenate([w, v]), return_inverse=True)
        count, left, *follow = self.words(distinct)
        at_w, at_v = inverse[: len(w)], inverse[len(w) :]
        n, kinds = self.at["tokens"], self.at["types"]
        base = np.log10((count[at_w] + 0.1) / (n + 0.1 * (kinds + 1)))
        below = np.maximum(left - self.left_off[np.minimum(left, 3)], 0) / self.all_pairs + self.spare / (kinds + 1)
        begins = count[np.searchsorted(distinct, END)] if len(distinct) else 0
        total = np.where(distinct == BEGIN, begins, count)
        spare = np.dot(self.pair_off[1:], np.stack(follow)) / np.maximum(total, 1)
        _, one, which = np.unique(at_v * len(distinct) + at_w, return_index=True, return_inverse=True)  # each bigram once
        seen = self.pairs(v[one], w[one])[which]
        above = np.maximum(seen - self.pair_off[np.minimum(seen, 3)], 0) / np.maximum(total[at_v], 1)
        p = np.where(total[at_v] > 0, above + spare[at_v] * below[at_w], below[at_w])
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(x) else x
        return {"n_tokens": np.diff(first), "n_known": add((count[at_w] > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}


def scored(docs: DataFrame, at: dict, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probabilities) of every whole text under a trained model.

    A text is its words and one end; a null text is empty: an end alone. Without training texts every token has
    probability 1. Repeated rows get the same result each; an empty table gives no rows.

    A task keeps its texts' hashed tokens until there are `held_tokens` of them (a longer text by itself), and then makes one pass over
    the shards: from a store that isn't mounted, each is fetched once a pass.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("t"))

    def run(batches):
        model, ids, parts, held = Model(at), [], [], 0

        def made() -> pa.RecordBatch:
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
            found = model.scores(np.concatenate([w for w, _ in parts]), first)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array(x) for x in found.values()]], names=["doc_id", *found])

        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts):
                ids.append(batch.column(0).slice(a, b - a))
                parts.append(tokens(texts.slice(a, b - a)))
                held += len(parts[-1][0])
                if held >= held_tokens:
                    yield made()
                    ids, parts, held = [], [], 0
        if parts:
            yield made()
        release_memory()

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
