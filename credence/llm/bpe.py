"""Byte-level BPE with a local rank file (operator 8)."""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Texts longer than this many characters are cut at safe boundaries before they are encoded.
LONG_TEXT = 65536

#: A safe boundary: one space between two characters that are no white space. The next match of the
#: pattern always starts at such a space, whatever stands before it.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Runs of this many white-space characters are encoded by themselves.
LEAST_RUN = 4096

#: White space of the pattern: the property of Unicode, which Python's class exceeds by four control characters.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LEAST_RUN)


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """The text cut at safe boundaries into parts of at least `size` characters (the last may be shorter)."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


def encode(text: str, rank_file: str, pattern: str, size: int = LONG_TEXT) -> list[int]:
    """Token ids of the whole text; the same for every `size`.

    Of a run of white space before another character, all but the last make one match of the pattern, and at the end
    of the text all do: long runs go to the ranks as they are, as the library's search for a match can't hold them.
    """
    enc = encoding(rank_file, pattern)
    made: list[int] = []
    at = 0
    for run in LONG_RUN.finditer(text) if len(text) >= LEAST_RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in safe_parts(text[at : run.start()], size):
            made += enc.encode_ordinary(part)
        made += enc._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    for part in safe_parts(text[at:], size):
        made += enc.encode_ordinary(part)
    return made


def decode(ids, rank_file: str, pattern: str) -> bytes:
    """The raw bytes of the ids; a cut inside a character is kept as it is."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Every whole text encoded, decoded again, and both digested.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded bytes). A null text counts as empty: no ids, digests of no bytes.
    Rows are independent: repeated rows give repeated results, an empty table none; other columns are ignored.
    """

    def digests(texts):
        n, a, b = [], [], []
        for t in texts.to_pylist():
            ids = encode(t, rank_file, pattern)
            n.append(len(ids))
            a.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
        return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_texts(docs, "text", {"doc_id": "doc_id"}, digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
