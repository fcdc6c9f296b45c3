"""Best-fit packing of token sequences (operator 9)."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SAFE_CUT, safe_parts
from .common import chunks, release_memory, small_batches, texts_of

SEQUENCE_LENGTH = 1024
END_ID = 2

#: Bins that a packer holds open at once.
OPEN_BINS = 2048

#: Pieces that a packer takes at once, longest first: short ones then find the gaps that long ones leave.
WINDOW = 2048

#: Bytes of words and ids that a worker remembers before it starts anew, bytes that an entry takes besides, and characters of the longest part that is kept.
CACHE_BYTES = 128 << 20
ENTRY_BYTES = 150
LONGEST_KEPT = 64

#: Bytes of texts that are encoded at once, and characters of a text beyond which it is cut at safe boundaries for that.
BLOCK_BYTES, LONGEST_TEXT = 1 << 19, 1 << 16

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class OpenBins:
    """Online best fit with a bounded number of open bins.

    Bit f of `free` is set while a bin with f free places is open, so the tightest bin for a piece is
    the lowest set bit at or above its length. With `limit` bins open the fullest is closed first.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.free, self.bins, self.open, self.made = capacity, limit, 0, {}, 0, count()

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to `capacity` places."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            name = self._take(room)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            room, name = self.capacity, next(self.made)
        if room > length:
            rest = room - length
            self.bins.setdefault(rest, []).append(name)
            self.free |= 1 << rest
            self.open += 1
        return name, self.capacity - room

    def _take(self, room: int) -> int:
        found = self.bins[room]
        name = found.pop()
        if not found:
            del self.bins[room]
            self.free &= ~(1 << room)
        self.open -= 1
        return name


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@functools.lru_cache(maxsize=2)
def word_encoder(path: str):
    """Ids of one pre-token's bytes by the merges of a byte-level BPE file, or None where it is another model.

    Where merges stand in the order of the ids that they make, as here, the ids are ranks: the pair that makes the least
    id is merged first either way.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", ())]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if model["type"] != "BPE" or model.get("dropout") or made != list(range(256, 256 + len(made))) or len(model["vocab"]) != 256 + len(made):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the names of tokens; the others follow 255 in order
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"

#: Runs of letters, with a space before if there is one, and what stands between.
RUNS = re.compile(rf" ?[{_LETTERS}]+|(?:(?! ?[{_LETTERS}]).)+", re.DOTALL)

WORD = re.compile(rf" [{_LETTERS}]+")

#: With an apostrophe, a character beyond these, or white space before other white space than a space,
#: the pattern's matches may cross the ends of such runs.
CROSSING = re.compile(rf"[^\n\x20-\x26\x28-\x7e{_LETTERS}]|\s\n")


class CachedEncoder:
    """Token ids, as bytes of little-endian unsigned 32-bit integers, part by part.

    A text is cut where no pre-token crosses: at the ends of RUNS, or, if CROSSING finds anything, at safe
    boundaries (a single space between two other characters). So the ids of the parts on end are the ids of
    the text. Parts seen before come from a bounded memory, the others go to the tokenizer in one call.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        self.path, self.limit, self.known, self.held = path, limit, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a long one is encoded a stretch at a time, so that its parts aren't all there at once."""
        made = self._batch([t if len(t) <= LONGEST_TEXT else "" for t in texts])
        for i, t in enumerate(texts):
            if len(t) > LONGEST_TEXT:
                made[i] = b"".join([ids for p in safe_parts(t, LONGEST_TEXT) for ids in self._batch([p])])
        return made

    def _batch(self, texts: list[str]) -> list[bytes]:
        if self.held > self.limit:
            self.known, self.held = {}, 0
        made, missing, parts, known = [], [], set(), self.known.get
        for t in texts:
            if CROSSING.search(t):
                found = SAFE_CUT.split(t)
                found[1:] = [" " + p for p in found[1:]]
            else:
                found = RUNS.findall(t)
            ids = list(map(known, found))
            if None in ids:
                new = [j for j, x in enumerate(ids) if x is None]
                parts.update([found[j] for j in new])
                missing.append((ids, found, new))
            made.append(ids)
        if missing:
            fresh = self._encoded(parts)
            for ids, found, new in missing:
                for j in new:
                    ids[j] = fresh[found[j]]
            for p, ids in fresh.items():
                if len(p) <= LONGEST_KEPT:
                    self.known[p] = ids
                    self.held += ENTRY_BYTES + 2 * len(p) + len(ids)
        return [b"".join(ids) for ids in made]

    def _encoded(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of the parts; a space and letters are one pre-token, which needs no tokenizer but its merges."""
        found, single = {}, word_encoder(self.path)
        if single:
            found = {p: array("I", single(p.encode())).tobytes() for p in parts if WORD.fullmatch(p)}
        other = [p for p in parts if p not in found]
        for p, e in zip(other, tokenizer(self.path).encode_batch_fast(other, add_special_tokens=False), strict=True):
            found[p] = array("I", e.ids).tobytes()
        return found


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but perhaps the first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = SEQUENCE_LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, window: int = WINDOW) -> DataFrame:
    """Packs every document's ids and an end id into sequences of at most `capacity` ids.

    A document of at most `capacity` ids stays whole; a longer one is cut into full pieces after a first
    one that may be shorter. Each input partition packs its own rows in one pass, without a shuffle, `window`
    pieces after the other, the longest of them first: a null text is one end id, repeated rows are packed
    each by itself, an empty table gives no rows and other columns are ignored. sequence_id holds the
    partition's number in its upper bits. A task that is run again reads the same rows in the same order
    and so makes the same sequences.
    """
    small_batches(docs.sparkSession)
    tail = np.array([end_id], dtype="<u4").tobytes()
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        base = TaskContext.get().partitionId() << 36
        bins, encoder = OpenBins(capacity, open_bins), CachedEncoder(tokenizer_file)

        def placed(pieces: list[tuple]) -> pa.RecordBatch:
            rows = []
            for row in sorted(pieces, key=lambda r: -r[3]):  # equal lengths stay in the order they came in
                name, offset = bins.place(row[3])
                rows.append((*row, base + name, offset))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        held: list[tuple] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in chunks(texts, BLOCK_BYTES):
                for doc_id, found in zip(ids[a:b], encoder.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    found += tail
                    for piece, (start, length) in enumerate(cuts(len(found) // 4, capacity)):
                        held.append((doc_id, piece, start, length, zlib.crc32(found[4 * start : 4 * (start + length)])))
                while len(held) >= window:
                    yield placed(held[:window])
                    held = held[window:]
        if held:
            yield placed(held)
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
